"""Strokes and check boxes of scanned pages: threshold, skew, ruling lines, squares. Pixels are numpy arrays; a task holds one page at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Threshold window and offset, search for skew in degrees, sizes in points, slack in pixels.
WINDOW, OFFSET, SIGMA = 25, 10, 4.1
SEARCH, COARSE, FINE, PEAK = 10, 1.0, 0.05, 2.0
LINE_LEAST, VERTICAL_LEAST, BOX_LEAST, BOX_MOST, BOX_SLACK = 20, 10, 18, 32, 8
JOIN_Y, JOIN_X, EDGE_SLACK, SIDE_SLACK = 4, 15, 6, 3
MEAN_MOST, FAR, FAR_SHARE = 4.0, 40, 0.02

SCANS = "doc_id string, page int, dpi int, height int, width int, pixels binary"
STROKES = "doc_id string, page int, kind string, x0 double, x1 double, top double, bottom double, width double, height double, fill boolean, stroke boolean, skew double"


def binarise(gray: np.ndarray) -> np.ndarray:
    """True where a pixel, after a median of 3 x 3, is at least OFFSET darker than the Gaussian mean around it."""
    p = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    g = np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)
    k = np.exp(-((np.arange(WINDOW) - WINDOW // 2) ** 2) / (2 * SIGMA**2))
    k, half, mean = k / k.sum(), WINDOW // 2, g
    for axis in (0, 1):
        pad = np.pad(mean, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        mean = sum(k[i] * (pad[i : i + h] if axis == 0 else pad[:, i : i + w]) for i in range(WINDOW))
    return g - np.rint(mean) <= -OFFSET


def turned(ink: np.ndarray, degrees: float, border: float = 0) -> np.ndarray:
    """Turned counter-clockwise about the middle, nearest pixel; what comes from outside is `border`."""
    if not degrees:
        return ink.astype(float)
    h, w = ink.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - w / 2, y - h / 2
    sx, sy = np.rint(c * dx - s * dy + w / 2).astype(int), np.rint(s * dx + c * dy + h / 2).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(ok, ink[sy.clip(0, h - 1), sx.clip(0, w - 1)], border)


def peakedness(ink: np.ndarray, degrees: float) -> float:
    """Variance of the row sums over their squared mean; corners that turning leaves open count as the page's own mean."""
    rows = turned(ink, degrees, ink.mean()).sum(axis=1)
    return float(rows.var() / rows.mean() ** 2) if rows.mean() > 0 else 0.0


def skew(ink: np.ndarray) -> float:
    """Degrees that straighten the page: the peak in steps of COARSE, then of FINE about it; 0 if the coarse peak isn't twice the median. Ties go to the smaller turn."""
    sweep = lambda angles: sorted((-peakedness(ink, a), abs(a), a) for a in angles)
    coarse = sweep(np.arange(-SEARCH, SEARCH + COARSE / 2, COARSE))
    if -coarse[0][0] <= PEAK * np.median([-s for s, _, _ in coarse]):
        return 0.0
    n = round(COARSE / FINE)
    return float(round(sweep([coarse[0][2] + i * FINE for i in range(-n, n + 1)])[0][2], 6))


def runs(ink: np.ndarray, least: float) -> np.ndarray:
    """Rows y, x0, x1 (exclusive) of the horizontal runs of ink at least `least` long."""
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    keep = b - a >= least
    return np.stack([y[keep], a[keep], b[keep]], axis=1)


def strokes(ink: np.ndarray, least: float) -> list[list[float]]:
    """x0, x1, y0, y1 of horizontal strokes: runs in order of y and x join the first stroke within JOIN_Y below and JOIN_X beside it."""
    found: list[list[float]] = []
    for y, a, b in runs(ink, least):
        for s in reversed(found):
            if y - s[3] <= JOIN_Y and a - s[1] <= JOIN_X and s[0] - b <= JOIN_X:
                s[0], s[1], s[3] = min(s[0], a), max(s[1], b), y + 1
                break
        else:
            found.append([a, b, y, y + 1])
    return found


def squares(flat: list[list[float]], upright: list[list[float]], pt: float) -> list[tuple[float, float, float, float]]:
    """x0, x1, y0, y1 of boxes: two level strokes of a box's length, one above the other, with uprights at both ends."""
    lo, hi, found = (BOX_LEAST - 2) * pt, (BOX_MOST + 2) * pt, []
    short = [s for s in flat if lo <= s[1] - s[0] <= hi]
    for a in short:
        for b in short:
            w, h = a[1] - a[0], b[3] - a[2]
            if lo <= h <= hi and abs(w - h) <= BOX_SLACK * pt and abs(a[0] - b[0]) <= EDGE_SLACK and abs(a[1] - b[1]) <= EDGE_SLACK:
                side = lambda x: any(abs((u[0] + u[1]) / 2 - x) <= EDGE_SLACK and u[2] <= a[3] + EDGE_SLACK and u[3] >= b[2] - EDGE_SLACK for u in upright)  # noqa: B023, E731
                if side(a[0]) and side(a[1]):
                    found.append((a[0], a[1], a[2], b[3]))
    return found


def read_page(gray: np.ndarray, dpi: int) -> tuple[float, list[tuple[str, float, float, float, float]]]:
    """The skew, and kind, x0, x1, top, bottom in points: lines, verticals and check boxes. A turned page's centres are turned back, sizes stay."""
    ink, pt = binarise(gray), dpi / 72
    angle = skew(ink)
    level = turned(ink, angle) > 0.5
    flat = strokes(level, BOX_LEAST * pt * 0.8)
    upright = [[y0, y1, a, b] for a, b, y0, y1 in strokes(level.T, VERTICAL_LEAST * pt)]
    boxes = squares(flat, upright, pt)

    def bracketed(s):
        at = lambda x: any(abs((u[0] + u[1]) / 2 - x) <= EDGE_SLACK and u[2] - EDGE_SLACK <= s[3] and u[3] + EDGE_SLACK >= s[2] and 0.4 <= (u[3] - u[2]) / (s[1] - s[0]) <= 2.5 for u in upright)
        return at(s[0]) and at(s[1])

    on_side = lambda u: any(min(abs((u[0] + u[1]) / 2 - b[0]), abs((u[0] + u[1]) / 2 - b[1])) <= SIDE_SLACK * pt and u[2] >= b[2] - SIDE_SLACK * pt and u[3] <= b[3] + SIDE_SLACK * pt for b in boxes)
    found = [("line", s) for s in flat if s[1] - s[0] >= LINE_LEAST * pt and not bracketed(s)]
    found += [("vertical", u) for u in upright if not on_side(u)] + [("checkbox", b) for b in boxes]
    h, w = gray.shape
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    out = []
    for kind, (x0, x1, y0, y1) in found:
        dx, dy = (x0 + x1) / 2 - w / 2, (y0 + y1) / 2 - h / 2
        mx, my = c * dx - s * dy + w / 2, s * dx + c * dy + h / 2
        out.append((kind, (mx - (x1 - x0) / 2) / pt, (mx + (x1 - x0) / 2) / pt, (my - (y1 - y0) / 2) / pt, (my + (y1 - y0) / 2) / pt))
    return angle, out


def page_strokes(scans: DataFrame) -> DataFrame:
    """Stroke rows (as page-object rects, with kind and skew) of scans: one row a page, 8-bit grey pixels row by row. Pages without pixels give none."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STROKES.split(", ")]
        for frame in frames:
            for p in frame.itertuples():
                if not p.pixels:
                    continue
                angle, found = read_page(np.frombuffer(p.pixels, dtype=np.uint8).reshape(p.height, p.width), p.dpi)
                yield pd.DataFrame([(p.doc_id, p.page, k, x0, x1, t, b, x1 - x0, b - t, k == "checkbox", k != "checkbox", angle) for k, x0, x1, t, b in found], columns=names)

    return scans.select("doc_id", "page", "dpi", "height", "width", "pixels").mapInPandas(read, STROKES)


def same_picture(pairs: DataFrame) -> DataFrame:
    """Adds mean_diff, far_share and same for pixels a and b of equal size: mean difference at most 4, at most 2 % of pixels over 40 apart."""

    @F.pandas_udf("mean double, far double")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        diffs = [np.abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(y, np.uint8)) if x and y and len(x) == len(y) else np.array([255]) for x, y in zip(a, b)]
        return pd.DataFrame({"mean": [float(d.mean()) for d in diffs], "far": [float((d > FAR).mean()) for d in diffs]})

    d = pairs.withColumn("_d", compare("a", "b"))
    return d.withColumns({"mean_diff": F.col("_d.mean"), "far_share": F.col("_d.far"), "same": (F.col("_d.mean") <= MEAN_MOST) & (F.col("_d.far") <= FAR_SHARE)}).drop("_d")
