"""Boxes of a page against one another: overlaps, suppression, clusters, reading order.

Pairs are joined by page and by tiles of the page, so boxes far apart never meet; what depends on
order (greedy suppression, banding) folds over the boxes of one page, which are few by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import boxes as B
from glyphmill.session import checkpointed

#: Side of a tile, about that of a large balloon.
TILE = 512


def _tiled(df: DataFrame, box: str, reach: int = 0) -> DataFrame:
    x0, y0, x1, y1 = B.corners(F.col(box))
    cut = lambda v: F.floor(v / TILE).cast("int")
    across = F.sequence(cut(x0 - reach), F.greatest(cut(x1 + reach), cut(x0 - reach)))
    down = F.sequence(cut(y0 - reach), F.greatest(cut(y1 + reach), cut(y0 - reach)))
    return df.withColumn("tx", F.explode(across)).withColumn("ty", F.explode(down))


def close_pairs(df: DataFrame, page: list[str], key: str, box: str, keep: Callable[[Column, Column], Column], reach: int = 0) -> DataFrame:
    """Pairs ``a`` < ``b`` of one page for which ``keep`` holds; they must lie within ``reach``."""
    held = df.select(*page, key, box).where(F.col(box).isNotNull())
    left = _tiled(held, box, reach).select(*page, "tx", "ty", F.col(key).alias("a"), F.col(box).alias("box_a"))
    right = _tiled(held, box).select(*page, "tx", "ty", F.col(key).alias("b"), F.col(box).alias("box_b"))
    met = left.join(right, [*page, "tx", "ty"]).where("a < b").where(keep(F.col("box_a"), F.col("box_b")))
    return met.drop("tx", "ty").dropDuplicates([*page, "a", "b"])


def overlaps(df: DataFrame, page: list[str], key: str, box: str) -> DataFrame:
    """Overlapping pairs with the shared area and the intersection over union."""
    pairs = close_pairs(df, page, key, box, lambda a, b: B.overlap(a, b) > 0)
    return pairs.withColumns({"shared": B.overlap(F.col("box_a"), F.col("box_b")), "iou": B.iou(F.col("box_a"), F.col("box_b"))})


def first_container(inner: DataFrame, outer: DataFrame, page: list[str], key: str, share: float = 0.6) -> DataFrame:
    """``key`` and ``outer_id`` of the first outer box, by ``nr``, that holds the share of the inner
    box's area, or null. ``inner`` has key and box, ``outer`` outer_id, nr and outer_box."""
    met = _tiled(inner, "box").join(_tiled(outer.withColumnRenamed("outer_box", "o"), "o"), [*page, "tx", "ty"])
    held = met.where(B.contains(F.col("o"), F.col("box"), share)).groupBy(*page, key).agg(F.min_by("outer_id", "nr").alias("outer_id"))
    return inner.select(*page, key).join(held, [*page, key], "left")


def nearest(small: DataFrame, large: DataFrame, page: list[str], reach: int) -> DataFrame:
    """For each small box, the nearest large one of its page within reach; ties go to the smaller key."""
    near = _tiled(small, "box", reach).join(_tiled(large.select(*page, F.col("key").alias("host"), F.col("box").alias("host_box")), "host_box"), [*page, "tx", "ty"])
    near = near.withColumn("gap", B.gap(F.col("box"), F.col("host_box"))).where((F.col("gap") <= reach) & (F.col("key") != F.col("host")))
    return near.groupBy(*page, "key").agg(F.min_by("host", F.struct("gap", "host")).alias("host"), F.min("gap").alias("gap"))


def clusters(df: DataFrame, page: list[str], key: str, box: str, reach: float = 1.1, largest: int | None = 400, rounds: int = 30) -> DataFrame:
    """``key`` and ``cluster``, the smallest key of its group of marks close for their size.

    Two marks are close if their gap is at most ``reach`` times the longer of their sides. Labels
    spread along links, with pointers doubled each round, until nothing changes.
    ``largest`` marks of a page are clustered, the feature's bound on screentone; None takes all.
    """
    if largest is not None:
        _, _, w, h = B.sides(F.col(box))
        df = df.withColumn("_nr", F.row_number().over(Window.partitionBy(*page).orderBy(F.desc(w * h), key))).where(F.col("_nr") <= largest).drop("_nr")
    side = lambda b: F.greatest(B.sides(b)[2], B.sides(b)[3])
    longest = df.groupBy().agg(F.max(side(F.col(box)))).first()[0] or 0
    links = close_pairs(df, page, key, box, lambda a, b: B.gap(a, b) <= reach * F.greatest(side(a), side(b)), int(reach * longest) + 1)
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = checkpointed(df.select(F.col(key).alias("a"), F.col(key).alias("cluster")))
    for _ in range(rounds):
        least = both.join(label.select(F.col("a").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("least"))
        spread = label.join(least, "a", "left").select("a", F.least("cluster", F.coalesce("least", "cluster")).alias("cluster"), F.col("cluster").alias("was"))
        root = spread.select(F.col("a").alias("cluster"), F.col("cluster").alias("root"))
        step = checkpointed(spread.join(root, "cluster", "left").select("a", F.least("cluster", F.coalesce("root", "cluster")).alias("cluster"), "was"))
        label = step.drop("was")
        if step.where("cluster <> was").isEmpty():
            return label.withColumnRenamed("a", key)
    raise ValueError(f"labels still move after {rounds} rounds")


def hull(box: str) -> Column:
    """An aggregate: the box around all boxes."""
    x0, y0, x1, y1 = B.corners(F.col(box))
    return F.array(F.min(x0), F.min(y0), F.max(x1) - F.min(x0), F.max(y1) - F.min(y0))


# --- folds over one page -------------------------------------------------------------------


def suppress(boxes: Iterable[tuple], most: float = 0.35, inside: float = 0.9) -> list[bool]:
    """Which of the boxes, best first, are kept: none that overlaps or lies in a kept one."""
    kept: list[tuple] = []
    out = []
    for x, y, w, h in boxes:
        good = True
        for a, b, c, d in kept:
            shared = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
            whole = w * h + c * d - shared
            if whole > 0 and shared / whole > most or w * h > 0 and shared >= inside * w * h:
                good = False
                break
        out.append(good)
        if good:
            kept.append((x, y, w, h))
    return out


def bands(boxes: list[tuple], tolerance: float = 0.35) -> list[int]:
    """The number of the row each box stands in: the first row, from above, that it reaches into."""
    rows: list[list[float]] = []  # top and bottom
    out = [0] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda k: (boxes[k][1], k)):
        _, y, _, h = boxes[i]
        for nr, (top, bottom) in enumerate(rows):
            if y < bottom - tolerance * min(h, bottom - top):
                rows[nr] = [min(top, y), max(bottom, y + h)]
                out[i] = nr
                break
        else:
            out[i] = len(rows)
            rows.append([y, y + h])
    return out


def reading_places(boxes: list[tuple], leftward: bool, tolerance: float = 0.35) -> list[int]:
    """Places from 1: row by row, in a row by the centre in the direction of reading."""
    row = bands(boxes, tolerance)
    order = sorted(range(len(boxes)), key=lambda i: (row[i], -(boxes[i][0] + boxes[i][2] / 2) if leftward else boxes[i][0] + boxes[i][2] / 2, i))
    out = [0] * len(boxes)
    for place, i in enumerate(order, 1):
        out[i] = place
    return out


def fold_pages(df: DataFrame, page: list[str], key: str, columns: list[str], function: Callable[[list[dict]], list], out: str, kind: str) -> DataFrame:
    """``key`` and ``out``: what ``function`` makes of the rows of each page, in order of the key.

    A page is gathered into one row by the JVM, so Python gets batches of many pages; a page holds
    few regions by nature.
    """
    rows = df.select(*page, F.struct(key, *columns).alias("r")).groupBy(*page).agg(F.array_sort(F.collect_list("r")).alias("rows")).select("rows")
    types = {"int": pa.int32(), "boolean": pa.bool_()}
    name = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, made = [], []
            for rows in batch.column(0).to_pylist():
                keys += [r[key] for r in rows]
                made += function(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type.value_type.field(key).type), pa.array(made, types[kind])], names=[key, out])

    return rows.mapInArrow(run, f"{key} {name}, {out} {kind}")


def _box(value: list | None) -> tuple:
    return tuple(map(int, value)) if value is not None and len(value) == 4 else (0, 0, 0, 0)


def page_places(boxes: list[tuple], panels: list[str | None], leftward: bool) -> list[int]:
    """Places of a page's regions: panels by their hulls first, in each the regions, those without a panel last."""
    groups: dict[str | None, list[int]] = {}
    for i, p in enumerate(panels):
        groups.setdefault(p, []).append(i)
    named = [p for p in groups if p is not None]
    hulls = []
    for p in named:
        own = [boxes[i] for i in groups[p]]
        x, y = min(r[0] for r in own), min(r[1] for r in own)
        hulls.append((x, y, max(r[0] + r[2] for r in own) - x, max(r[1] + r[3] for r in own) - y))
    sequence = [p for _, p in sorted(zip(reading_places(hulls, leftward), named))] + [None] * (None in groups)
    out, done = [0] * len(boxes), 0
    for p in sequence:
        for i, place in zip(groups[p], reading_places([boxes[i] for i in groups[p]], leftward)):
            out[i] = done + place
        done += len(groups[p])
    return out


def reading_order(df: DataFrame, page: list[str], key: str, box: str, panel: str, leftward: str) -> DataFrame:
    """``key`` and ``place``: panels by their own order, regions without one last."""

    def fold(rows: list[dict]) -> list[int]:
        return page_places([_box(r[box]) for r in rows], [r[panel] for r in rows], bool(rows[0][leftward]))

    return fold_pages(df, page, key, [box, panel, leftward], fold, "place", "int")


def suppressed(df: DataFrame, page: list[str], key: str, box: str, order: str) -> DataFrame:
    """``key`` and ``kept`` of a greedy suppression over each page, the largest ``order`` first."""

    def fold(rows: list[dict]) -> list[bool]:
        best = sorted(range(len(rows)), key=lambda i: (-rows[i][order], i))
        out = [False] * len(rows)
        for i, kept in zip(best, suppress(_box(rows[i][box]) for i in best)):
            out[i] = kept
        return out

    return fold_pages(df, page, key, [box, order], fold, "kept", "boolean")
