"""Boxes `[x, y, w, h]` as column expressions; rounding is half-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sides(box: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.get(box, F.lit(i)).cast("long") for i in range(4))


def corners(box: Column) -> tuple[Column, Column, Column, Column]:
    x, y, w, h = sides(box)
    return x, y, x + w, y + h


def area(box: Column) -> Column:
    _, _, w, h = sides(box)
    zero = F.lit(0).cast("long")
    return F.greatest(w, zero) * F.greatest(h, zero)


def overlap(a: Column, b: Column) -> Column:
    """Area that both boxes cover."""
    ax, ay, aX, aY = corners(a)
    bx, by, bX, bY = corners(b)
    zero = F.lit(0).cast("long")
    return F.greatest(F.least(aX, bX) - F.greatest(ax, bx), zero) * F.greatest(F.least(aY, bY) - F.greatest(ay, by), zero)


def intersection(a: Column, b: Column) -> Column:
    """The common box; zeros if there is none."""
    ax, ay, aX, aY = corners(a)
    bx, by, bX, bY = corners(b)
    x, y = F.greatest(ax, bx), F.greatest(ay, by)
    w, h = F.least(aX, bX) - x, F.least(aY, bY) - y
    return F.when((w > 0) & (h > 0), F.array(x, y, w, h)).otherwise(F.array(*[F.lit(0).cast("long")] * 4))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def contains(outer: Column, inner: Column, slack: float = 0.9) -> Column:
    return F.when(area(inner) > 0, overlap(outer, inner) >= F.lit(slack) * area(inner)).otherwise(F.lit(False))


def gap(a: Column, b: Column) -> Column:
    """Distance between the nearest sides; 0 if they meet."""
    ax, ay, aX, aY = corners(a)
    bx, by, bX, bY = corners(b)
    zero = F.lit(0).cast("long")
    dx = F.greatest(ax - bX, bx - aX, zero)
    dy = F.greatest(ay - bY, by - aY, zero)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def center(box: Column) -> tuple[Column, Column]:
    x, y, w, h = sides(box)
    return x + w / 2, y + h / 2


def clamp(box: Column, width: Column, height: Column) -> Column:
    """Rounded and cut to the page; at least one pixel wide and high."""
    x0, y0, x1, y1 = (F.bround(v).cast("long") for v in corners(box))
    zero = F.lit(0).cast("long")
    left, top = F.least(F.greatest(x0, zero), width - 1), F.least(F.greatest(y0, zero), height - 1)
    right, bottom = F.least(F.greatest(x1, left + 1), width), F.least(F.greatest(y1, top + 1), height)
    return F.array(left, top, right - left, bottom - top)


def expand(box: Column, margin: Column, width: Column, height: Column) -> Column:
    x, y, w, h = sides(box)
    return clamp(F.array(x - margin, y - margin, w + 2 * margin, h + 2 * margin), width, height)


def parse(text: Column, least_side: int = 4) -> Column:
    """A box typed as `x y w h`, commas allowed; null unless whole, not negative and large enough."""
    parts = F.filter(F.split(F.trim(text), r"[\s,]+"), lambda p: p != "")
    box = F.transform(parts, lambda p: p.try_cast("long"))
    good = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull() | (v < 0)) & (F.get(box, F.lit(2)) >= least_side) & (F.get(box, F.lit(3)) >= least_side)
    return F.when(good, box)
