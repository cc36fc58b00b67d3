"""Rectangles as Column expressions; integer or double coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}" if prefix else name)


def normalise(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    return F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)


def rect(prefix: str = "", y: tuple[str, str] = ("y0", "y1")) -> tuple[Column, Column, Column, Column]:
    return normalise(c(prefix, "x0"), c(prefix, y[0]), c(prefix, "x1"), c(prefix, y[1]))


def area(r) -> Column:
    return (r[2] - r[0]) * (r[3] - r[1])


def overlap_area(a, b) -> Column:
    """Clipped product; 0 where the rectangles are apart."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def iou(a, b) -> Column:
    """0 where the union has no area."""
    i = overlap_area(a, b).cast("double")
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


def touches(a, b, pad: float = 0) -> Column:
    """Boxes meet once b is padded: the join residual that prunes pairs before any IoU."""
    return (a[0] < b[2] + pad) & (a[2] > b[0] - pad) & (a[1] < b[3] + pad) & (a[3] > b[1] - pad)


def flip_y(top: Column, bottom: Column, height: Column) -> tuple[Column, Column]:
    """Top-down to bottom-left: (y0, y1)."""
    return height - bottom, height - top


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def pixel_box(r, height: Column, dpi: float = 144.0, pad: float = 4.0):
    """Points, bottom-left, to pixels, top-down, padded."""
    s = dpi / 72.0
    return (r[0] - pad) * s, (height - r[3] - pad) * s, (r[2] + pad) * s, (height - r[1] + pad) * s


def rect_like(path: str = "path", x0: str = "x0", y0: str = "top", x1: str = "x1", y1: str = "bottom") -> Column:
    """A closed path of m/l/c/h steps whose anchors all lie near a corner of its box, by min(6, half the shorter side + 0.5)."""
    tol = F.least(F.lit(6.0), F.least(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)) / 2 + 0.5)
    p = F.col(path)
    near = lambda v, a, b: (F.abs(v - F.col(a)) <= tol) | (F.abs(v - F.col(b)) <= tol)
    return (F.size(p) > 0) & (F.element_at(p, 1)["op"] == "m") & (F.element_at(p, -1)["op"] == "h") & F.forall(p, lambda s: s["op"].isin("m", "l", "c", "h") & ((s["op"] == "h") | (near(s["x"], x0, x1) & near(s["y"], y0, y1))))
