"""Boxes as struct<x0, y0, x1, y1: double> columns, with coordinates in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioqc.params import DEFAULT


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def centre_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2.0


def centre_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2.0


def _side(lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.0), hi - lo)


def area(b: Column) -> Column:
    return _side(b["x0"], b["x1"]) * _side(b["y0"], b["y1"])


def intersection(a: Column, b: Column) -> Column:
    return _side(F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"])) * _side(F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"]))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a's area that b covers; 0 for an empty a. Not symmetric."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def contains(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def ordered(b: Column) -> Column:
    """Coordinates clamped, corners put in order; null gives the full page."""
    x0, y0, x1, y1 = (clamp(b[n]) for n in ("x0", "y0", "x1", "y1"))
    return F.when(b.isNull(), whole_page()).otherwise(box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)))


def from_array(values: Column) -> Column:
    """A box from an array; a length other than four gives the full page."""
    return F.when(F.size(values) == 4, ordered(box(*(F.get(values, F.lit(i)) for i in range(4))))).otherwise(whole_page())


def whole_page() -> Column:
    return box(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))


def scaled(b: Column, width: Column, height: Column) -> Column:
    """A box in page units as shares of the page."""
    return F.when(b.isNull(), whole_page()).otherwise(box(clamp(b["x0"] / width), clamp(b["y0"] / height), clamp(b["x1"] / width), clamp(b["y1"] / height)))


def from_emu(left: Column, top: Column, width: Column, height: Column, page_w: Column, page_h: Column) -> Column:
    """Left, top, width and height in EMU; extents are at least one unit and corners in order."""
    w, h = F.greatest(page_w, F.lit(1)), F.greatest(page_h, F.lit(1))
    x0, y0 = clamp(left / w), clamp(top / h)
    return box(x0, y0, F.greatest(x0, clamp((left + F.greatest(width, F.lit(1))) / w)), F.greatest(y0, clamp((top + F.greatest(height, F.lit(1))) / h)))


def rotate_point(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A point of the unit page turned by 0, 90, 180 or 270 degrees."""
    a = F.pmod(angle, F.lit(360))
    rx = F.when(a == 90, y).when(a == 180, 1.0 - x).when(a == 270, 1.0 - y).otherwise(x)
    ry = F.when(a == 90, 1.0 - x).when(a == 180, 1.0 - y).when(a == 270, x).otherwise(y)
    return rx, ry


def map_box(b: Column, angle: Column, target_w, target_h, off_x, off_y, scaled_w, scaled_h) -> Column:
    """The hull of b's corners after turning, scaling to the fitted size and moving."""
    xs, ys = [], []
    for x in ("x0", "x1"):
        for y in ("y0", "y1"):
            rx, ry = rotate_point(b[x], b[y], angle)
            xs.append((rx * scaled_w + off_x) / F.greatest(target_w, F.lit(1)))
            ys.append((ry * scaled_h + off_y) / F.greatest(target_h, F.lit(1)))
    return box(clamp(F.least(*xs)), clamp(F.least(*ys)), clamp(F.greatest(*xs)), clamp(F.greatest(*ys)))


def fitted(b: Column, target_w, target_h, off_x, off_y, fit_w, fit_h) -> Column:
    """A box moved to a canvas on which the page was fitted."""
    return map_box(b, F.lit(0), target_w, target_h, off_x, off_y, fit_w, fit_h)


def expanded(b: Column, margin: float = 0.03, least: float = 0.12) -> Column:
    """A box grown by a margin and to a least size about its centre, within the page."""

    def grow(lo: Column, hi: Column) -> tuple[Column, Column]:
        lo, hi = F.greatest(F.lit(0.0), lo - margin), F.least(F.lit(1.0), hi + margin)
        mid = (lo + hi) / 2.0
        small = hi - lo < least
        return F.when(small, F.greatest(F.lit(0.0), mid - least / 2)).otherwise(lo), F.when(small, F.least(F.lit(1.0), mid + least / 2)).otherwise(hi)

    (x0, x1), (y0, y1) = grow(b["x0"], b["x1"]), grow(b["y0"], b["y1"])
    return box(x0, y0, x1, y1)


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def position_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.sqrt(F.pow(centre_x(a) - centre_x(b), 2) + F.pow(centre_y(a) - centre_y(b), 2)) / DEFAULT.position_scale)


def grid_cell(b: Column) -> Column:
    """The name of the ninth of the page in which the centre lies."""
    v = F.when(centre_y(b) < 0.33, "top").when(centre_y(b) < 0.66, "middle").otherwise("bottom")
    h = F.when(centre_x(b) < 0.33, "left").when(centre_x(b) < 0.66, "center").otherwise("right")
    return F.concat(v, F.lit("-"), h)


def in_edge_band(b: Column, band: float = DEFAULT.edge_band) -> Column:
    return (b["x1"] <= band) | (b["x0"] >= 1.0 - band) | (b["y1"] <= band) | (b["y0"] >= 1.0 - band)


def drifts(a: Column, b: Column) -> Column:
    """Left, top, centre or width differ by the allowed amount or more; height is not looked at."""
    p = DEFAULT
    centre = F.hypot(centre_x(a) - centre_x(b), centre_y(a) - centre_y(b))
    width = F.abs((a["x1"] - a["x0"]) - (b["x1"] - b["x0"]))
    return (F.abs(a["x0"] - b["x0"]) >= p.drift_left) | (F.abs(a["y0"] - b["y0"]) >= p.drift_top) | (centre >= p.drift_centre) | (width >= p.drift_width)


def crop_pixels(b: Column, width: Column, height: Column) -> Column:
    """Pixel rectangle of a box, at least one pixel; halves round to even."""
    x0 = F.greatest(F.lit(0), F.least(width - 1, F.bround(b["x0"] * width).cast("int")))
    y0 = F.greatest(F.lit(0), F.least(height - 1, F.bround(b["y0"] * height).cast("int")))
    x1 = F.greatest(x0 + 1, F.least(width, F.bround(b["x1"] * width).cast("int")))
    y1 = F.greatest(y0 + 1, F.least(height, F.bround(b["y1"] * height).cast("int")))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def scaled_pixels(x: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(x * factor).cast("int"))


def emu_to_pixels(emu: Column, dpi: int = 240) -> Column:
    return F.greatest(F.lit(1), F.bround(emu / 914400.0 * dpi).cast("int"))


def scaled_pixel_box(x: Column, y: Column, w: Column, h: Column, by_x: Column, by_y: Column) -> Column:
    """A box in whole pixels after scaling; halves round to even, sides keep a pixel."""
    at = lambda v, k: F.bround(v * k).cast("int")
    return F.struct(at(x, by_x).alias("x"), at(y, by_y).alias("y"), scaled_pixels(w, by_x).alias("w"), scaled_pixels(h, by_y).alias("h"))


def preferred_size(reference_w: Column, reference_h: Column, candidate_w: Column, candidate_h: Column) -> Column:
    """The candidate's size, enlarged in its own aspect as far as the reference holds it, but never
    reduced; the reference's for a candidate without area."""
    empty = (candidate_w <= 0) | (candidate_h <= 0)
    k = F.greatest(F.lit(1.0), F.least(reference_w / F.greatest(candidate_w, F.lit(1)), reference_h / F.greatest(candidate_h, F.lit(1))))
    grown = lambda v: F.greatest(v, F.bround(v * k).cast("int"))
    return F.struct(F.when(empty, reference_w).otherwise(grown(candidate_w)).alias("w"), F.when(empty, reference_h).otherwise(grown(candidate_h)).alias("h"))


def hull_of_points(points: Column, width: Column, height: Column) -> Column:
    """The clamped box around points (x, y) given in shares of the page if they are `normalized`, else
    in page units; without points the full page."""
    xs = F.transform(points["xy"], lambda p: F.when(points["normalized"], p["x"]).otherwise(p["x"] / F.greatest(width, F.lit(1.0))))
    ys = F.transform(points["xy"], lambda p: F.when(points["normalized"], p["y"]).otherwise(p["y"] / F.greatest(height, F.lit(1.0))))
    found = box(clamp(F.array_min(xs)), clamp(F.array_min(ys)), clamp(F.array_max(xs)), clamp(F.array_max(ys)))
    return F.when(F.coalesce(F.size(points["xy"]), F.lit(0)) > 0, found).otherwise(whole_page())


def aspect_score(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    return F.lit(0.0) - F.abs(w1 / F.greatest(h1, F.lit(1)) - w2 / F.greatest(h2, F.lit(1)))
