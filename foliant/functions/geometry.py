"""Boxes [x0, y0, x1, y1], polygons and rotation of pages."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@dataclass
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(name: str) -> Box:
        return Box(*(F.col(name)[i] for i in range(4)))

    @staticmethod
    def columns(prefix: str) -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2

    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.x1 - self.x0) * F.greatest(F.lit(0.0), self.y1 - self.y0)

    def clip(self, width: Column, height: Column) -> Box:
        zero = F.lit(0.0)
        return Box(*(F.greatest(zero, F.least(v, m)) for v, m in ((self.x0, width), (self.y0, height), (self.x1, width), (self.y1, height))))

    def valid(self) -> Column:
        return (self.x1 > self.x0) & (self.y1 > self.y0)

    def thousandths(self, width: Column, height: Column) -> list[Column]:
        """The box on a page of 1000 by 1000, rounded half to even and clipped."""
        return [F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(v * 1000.0 / m).cast("int"))) for v, m in ((self.x0, width), (self.y0, height), (self.x1, width), (self.y1, height))]

    def polygon(self) -> Column:
        return F.array(F.array(self.x0, self.y0), F.array(self.x1, self.y0), F.array(self.x1, self.y1), F.array(self.x0, self.y1))


def overlap(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def iou(a: Box, b: Box) -> Column:
    shared = overlap(a, b)
    return shared / F.greatest(F.lit(1e-6), a.area() + b.area() - shared)


def closeness(a: Box, b: Box) -> Column:
    """The larger of IoU and a score that falls with the distance of the centres."""
    scale = F.greatest(F.lit(1.0), (F.sqrt(a.area()) + F.sqrt(b.area())) / 2)
    return F.greatest(iou(a, b), F.greatest(F.lit(0.0), 1 - F.hypot(a.cx - b.cx, a.cy - b.cy) / (3 * scale)))


def polygon_area(polygon: Column) -> Column:
    """Shoelace formula."""
    n = F.size(polygon)
    terms = F.transform(polygon, lambda p, i: p[0] * polygon[F.pmod(i + 1, n)][1] - polygon[F.pmod(i + 1, n)][0] * p[1])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


def polygon_box(polygon: Column) -> Column:
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def relation_features(s: Box, t: Box) -> dict[str, Column]:
    """The ten features of an ordered pair of boxes."""
    tiny = F.lit(1e-6)
    sides = [F.greatest(tiny, b.x1 - b.x0) * F.greatest(tiny, b.y1 - b.y0) for b in (s, t)]
    shared, zero = overlap(s, t), F.lit(0.0)
    return {
        "delta_x": t.cx - s.cx,
        "delta_y": t.cy - s.cy,
        "distance": F.sqrt((t.cx - s.cx) * (t.cx - s.cx) + (t.cy - s.cy) * (t.cy - s.cy)),
        "horizontal_gap": F.greatest(zero, t.x0 - s.x1, s.x0 - t.x1),
        "vertical_gap": F.greatest(zero, t.y0 - s.y1, s.y0 - t.y1),
        "iou": shared / F.greatest(tiny, sides[0] + sides[1] - shared),
        "same_line": (F.greatest(s.y0, t.y0) <= F.least(s.y1, t.y1)).cast("double"),
        "same_column": (F.greatest(s.x0, t.x0) <= F.least(s.x1, t.x1)).cast("double"),
        "target_is_right": (t.cx >= s.cx).cast("double"),
        "target_is_below": (t.cy >= s.cy).cast("double"),
    }


@dataclass
class PageRotation:
    """Turn of a page about its centre on a canvas that holds all of it: x' = a x + b y + c, y' = -b x + a y + f."""

    a: Column
    b: Column
    c: Column
    f: Column
    width: Column
    height: Column

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.a * x + self.b * y + self.c, -self.b * x + self.a * y + self.f

    def restore(self, x: Column, y: Column) -> tuple[Column, Column]:
        u, v = x - self.c, y - self.f
        return self.a * u - self.b * v, self.b * u + self.a * v


def page_rotation(width: Column, height: Column, degrees: Column) -> PageRotation:
    turn = F.radians(degrees)
    a, b = F.cos(turn), F.sin(turn)
    wide, high = F.abs(a) * width + F.abs(b) * height, F.abs(a) * height + F.abs(b) * width
    new_w, new_h = (F.greatest(F.lit(1.0), F.ceil(v - 1e-9).cast("double")) for v in (wide, high))
    return PageRotation(a, b, wide / 2 - a * width / 2 - b * height / 2, high / 2 + b * width / 2 - a * height / 2, new_w, new_h)


def _hull(points: list) -> list[tuple[float, float]] | None:
    """Corners of the convex hull, counter-clockwise; None without an extent or with a number that isn't finite."""
    try:
        p = sorted({(float(x), float(y)) for x, y in points})
    except (TypeError, ValueError):
        return None
    if len(p) < 3 or not all(math.isfinite(v) for q in p for v in q):
        return None

    def chain(order):
        out: list[tuple[float, float]] = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = chain(p) + chain(reversed(p))
    return hull if len(hull) > 2 else None


def _area(p: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def hull_iou(left: list, right: list) -> float | None:
    """IoU of the convex hulls of two lists of points: the left one is cut along each side of the right one. None where one has no extent."""
    a, b = _hull(left), _hull(right)
    if a is None or b is None:
        return None
    cut = a
    for p, q in zip(b, b[1:] + b[:1], strict=True):
        side = [(q[0] - p[0]) * (v[1] - p[1]) - (q[1] - p[1]) * (v[0] - p[0]) for v in cut]
        kept = []
        for k, v in enumerate(cut):
            w, s, t = cut[k - 1], side[k - 1], side[k]
            if (s < 0) != (t < 0):
                kept.append((w[0] + (v[0] - w[0]) * s / (s - t), w[1] + (v[1] - w[1]) * s / (s - t)))
            if t >= 0:
                kept.append(v)
        cut = kept
        if not cut:
            return 0.0
    shared = max(0.0, _area(cut))
    return min(1.0, shared / (_area(a) + _area(b) - shared))


@F.pandas_udf(DoubleType())
def convex_iou(left: pd.Series, right: pd.Series) -> pd.Series:
    """``hull_iou`` of two columns of polygons (arrays of points)."""
    return pd.Series([None if a is None or b is None else hull_iou(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")
