"""Page pictures as rows: facts, detection of balloons and panels, cleaning, proof that artwork stayed.

Each picture is one binary value, so a page is the unit of parallel work and nothing is shuffled.
A picture that cannot be read gives a row with its fault instead of an end of the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.operators import pixels as px
from glyphmill.sources.png import decode, encode


@dataclass(frozen=True)
class Options:
    """Shares of the page's area, or of its shorter side, that tell lettering from artwork."""

    balloon_area: tuple[float, float] = (0.0006, 0.13)
    balloon_side: float = 0.05
    solidity: float = 0.42
    ink: tuple[float, float] = (0.015, 0.55)
    glyph: tuple[float, float] = (0.004, 0.22)
    gutter_ink: float = 0.008
    gutter_span: float = 0.012
    panel_area: float = 0.02


def grey(picture: np.ndarray) -> np.ndarray:
    return picture if picture.ndim == 2 else np.rint(picture @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def balloons(page: np.ndarray, options: Options = Options()) -> list[dict]:
    """Light areas inside an outline that hold lettering, and dark ones; the solider of two that overlap."""
    from glyphmill.operators.layout import suppress

    h, w = page.shape
    short = min(h, w)
    found = []
    for polarity, shown in (("light", page), ("dark", 255 - page)):
        solid = px.filled(shown > px.otsu(shown), int(options.glyph[1] * short))
        labels, many = px.components(solid)
        box = px.component_boxes(labels, many)
        x, y, bw, bh, area = box.T
        edges = (x <= 1).astype(int) + (y <= 1) + (x + bw >= w - 1) + (y + bh >= h - 1)
        share = area / (h * w)
        good = (share >= options.balloon_area[0]) & (share <= options.balloon_area[1]) & (np.minimum(bw, bh) >= max(12, options.balloon_side * short)) & (area / (bw * bh) >= options.solidity) & (edges < 2)
        for k in np.flatnonzero(good):
            cut = np.s_[y[k] : y[k] + bh[k], x[k] : x[k] + bw[k]]
            inside = labels[cut] == k + 1
            inside |= px.enclosed(inside)
            ink = float((shown[cut][inside] < 128).mean())
            if options.ink[0] <= ink <= options.ink[1]:
                found.append({"bbox": [int(v) for v in box[k, :4]], "polarity": polarity, "ink": ink, "solidity": float(area[k] / (bw[k] * bh[k])), "text": text_box(shown, box[k, :4], inside, options)})
    found.sort(key=lambda b: (-b["solidity"], b["bbox"]))
    return [b for b, kept in zip(found, suppress(b["bbox"] for b in found)) if kept]


def text_box(shown: np.ndarray, box: np.ndarray, inside: np.ndarray, options: Options = Options()) -> list[int] | None:
    """The box of the glyph-sized marks inside a balloon; ``inside`` leaves its outline and the artwork in its corners out."""
    x, y, w, h = map(int, box)
    window = shown[y : y + h, x : x + w]
    dark = (window <= px.otsu(window)) & inside
    edge = max(1, int(0.05 * min(w, h)))
    inner = np.zeros_like(dark)
    inner[edge:-edge, edge:-edge] = dark[edge:-edge, edge:-edge]
    labels, many = px.components(inner)
    if not many:
        return None
    marks = px.component_boxes(labels, many)
    side = marks[:, 2:4].max(axis=1)
    low, high = (g * min(shown.shape) for g in options.glyph)
    marks = marks[(side >= low) & (side <= high) & (marks[:, 4] >= 4)]
    if not len(marks):
        return None
    left, top = marks[:, :2].min(axis=0)
    right, bottom = (marks[:, :2] + marks[:, 2:4]).max(axis=0)
    return [int(x + left), int(y + top), int(right - left), int(bottom - top)]


def page_panels(page: np.ndarray, options: Options = Options()) -> list[list[int]]:
    ink = page < np.median(page) - 40
    h, w = page.shape
    boxes = px.panels(ink, options.gutter_ink, max(2, int(options.gutter_span * min(h, w))))
    return [list(map(int, b)) for b in boxes if b[2] * b[3] >= options.panel_area * h * w]


def _rows(df: DataFrame, key: str, columns: list[str], make: Callable[..., dict], fields: list[tuple[str, pa.DataType]], kinds: str) -> DataFrame:
    """``make`` of each row's columns, or its fault."""
    schema = pa.schema([*fields, ("fault", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                try:
                    rows.append(make(*values))
                except (ValueError, TypeError) as fault:
                    rows.append({"fault": str(fault)})
            made = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=[key, *schema.names])

    return df.select(key, *columns).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {kinds}, fault string")


def _picture(data: bytes | None) -> np.ndarray:
    if data is None:
        raise ValueError("no picture")
    return decode(data)


def facts(df: DataFrame, key: str, picture: str) -> DataFrame:
    """Size, hash of the pixels, an 8x8 appearance and the share of ink of each picture."""

    def make(data: bytes | None) -> dict:
        page = _picture(data)
        shade = grey(page)
        return {"width": page.shape[1], "height": page.shape[0], "pixels": hashlib.sha256(np.ascontiguousarray(page)).hexdigest(), "appearance": px.appearance(shade).ravel().tolist(), "ink": float((shade <= px.otsu(shade)).mean())}

    fields = [("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.string()), ("appearance", pa.list_(pa.int32())), ("ink", pa.float64())]
    return _rows(df, key, [picture], make, fields, "width int, height int, pixels string, appearance array<int>, ink double")


def detect(df: DataFrame, key: str, picture: str, options: Options = Options()) -> DataFrame:
    """Panels and balloons with their lettering of each page."""

    def make(data: bytes | None) -> dict:
        page = grey(_picture(data))
        return {"panels": page_panels(page, options), "balloons": balloons(page, options)}

    balloon = pa.struct([("bbox", pa.list_(pa.int32())), ("polarity", pa.string()), ("ink", pa.float64()), ("solidity", pa.float64()), ("text", pa.list_(pa.int32()))])
    kinds = "panels array<array<int>>, balloons array<struct<bbox: array<int>, polarity: string, ink: double, solidity: double, text: array<int>>>"
    return _rows(df, key, [picture], make, [("panels", pa.list_(pa.list_(pa.int32()))), ("balloons", pa.list_(balloon))], kinds)


def clean(df: DataFrame, key: str, picture: str, boxes: str, grow: int = 2) -> DataFrame:
    """Pages with the lettering in ``boxes`` painted over where the ground is flat; what is not flat is refused.

    Gives the picture, its mask, and for each box `flat` or `refused`. Not a byte outside the mask changes.
    """

    def make(data: bytes | None, areas: list[list[int]] | None) -> dict:
        page = _picture(data)
        shade, out, mask, outcomes = grey(page), page.copy(), np.zeros(page.shape[:2], np.uint8), []
        for x, y, w, h in areas or []:
            cut = np.s_[max(0, y - grow) : y + h + grow, max(0, x - grow) : x + w + grow]
            window = shade[cut]
            if not window.size:
                outcomes.append("refused")
                continue
            light = px.otsu(window)
            ink = window <= light if (window > light).mean() >= 0.5 else window > light
            own = px.grown(ink, grow)
            how, colour = px.strategy(page[cut], own)
            outcomes.append("flat" if how == "flat" else "refused")
            if how == "flat":
                weight = own.astype(np.uint8) * 255
                out[cut] = px.composite(out[cut], np.broadcast_to(np.asarray(colour).reshape(1, 1, -1) if page.ndim == 3 else colour[0], out[cut].shape), weight)
                mask[cut] = np.maximum(mask[cut], weight)
        return {"cleaned": encode(out), "mask": encode(mask), "outcomes": outcomes}

    fields = [("cleaned", pa.binary()), ("mask", pa.binary()), ("outcomes", pa.list_(pa.string()))]
    return _rows(df, key, [picture, boxes], make, fields, "cleaned binary, mask binary, outcomes array<string>")


def proofs(df: DataFrame, key: str, before: str, after: str, mask: str) -> DataFrame:
    """Pixels changed outside the mask, pixels there, the worst change, and the share of ink that survived."""

    def make(was: bytes | None, now: bytes | None, within: bytes | None) -> dict:
        a, b, m = _picture(was), _picture(now), _picture(within)
        if a.shape != b.shape or a.shape[:2] != m.shape[:2]:
            raise ValueError("sizes differ")
        changed, total, worst = px.changed_outside(a, b, m)
        return {"changed": changed, "outside": total, "worst": worst, "surviving": px.surviving_ink(grey(a), grey(b), m), "coverage": float((m > 0).mean())}

    fields = [("changed", pa.int64()), ("outside", pa.int64()), ("worst", pa.int32()), ("surviving", pa.float64()), ("coverage", pa.float64())]
    return _rows(df, key, [before, after, mask], make, fields, "changed long, outside long, worst int, surviving double, coverage double")
