"""Small rasters as arrays in row-major order, and image kernels in NumPy for page images.

Kernels agree with common imaging libraries region by region, not pixel by pixel: their borders,
rounding and resampling differ slightly.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioqc.params import DEFAULT


def ncc(a: Column, b: Column) -> Column:
    """Mean-centred correlation of two equal-length arrays; -1 when either is flat."""

    def centred(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
        return F.zip_with(x, F.array_repeat(mean, F.size(x)), lambda p, q: p - q)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    x, y = centred(a), centred(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, F.lit(-1.0)).otherwise(dot(x, y) / norm)


def rotate_grid(grid: Column, side: int, turns: int) -> Column:
    """A square grid turned counter-clockwise by quarter turns."""
    index = np.rot90(np.arange(side * side).reshape(side, side), turns).ravel()
    return F.array(*(F.get(grid, F.lit(int(i))) for i in index))


def content_box(grid: Column, side: int, threshold: float) -> Column:
    """Rows and columns between which cells lie below the threshold; null if none does."""
    cells = F.filter(F.transform(grid, lambda v, i: F.when(v < threshold, i)), lambda i: i.isNotNull())
    ys, xs = F.transform(cells, lambda i: F.floor(i / side).cast("int")), F.transform(cells, lambda i: (i % side).cast("int"))
    return F.when(F.size(cells) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def label_components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, area) of 8-connected components in raster order of their first pixel."""
    h, w = mask.shape
    parent: list[int] = []
    labels = np.full((h, w), -1, int)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(h):
        for x in np.flatnonzero(mask[y]):
            near = [labels[y, x - 1]] if x else []
            if y:
                near += labels[y - 1, max(0, x - 1) : x + 2].tolist()
            roots = sorted({root(n) for n in near if n >= 0})
            if not roots:
                parent.append(len(parent))
                labels[y, x] = len(parent) - 1
            else:
                labels[y, x] = roots[0]
                for r in roots[1:]:
                    parent[r] = roots[0]
    found: dict[int, list[int]] = {}
    for y, x in zip(*np.nonzero(mask)):
        b = found.setdefault(root(labels[y, x]), [x, y, x, y, 0])
        b[0], b[2], b[3], b[4] = min(b[0], x), max(b[2], x), y, b[4] + 1
    return [tuple(int(v) for v in b) for b in found.values()]


def best_turns(pairs: DataFrame, side: int, angles: tuple[int, ...] = DEFAULT.rotations) -> DataFrame:
    """vec_id, angle of pairs (vec_id, grid, other): the turn of other that is most like grid, the first of equal ones."""
    turned = F.explode(F.array(*(F.struct(F.lit(n).alias("nth"), F.lit(a).alias("angle"), ncc(F.col("grid"), rotate_grid(F.col("other"), side, a // 90)).alias("score")) for n, a in enumerate(angles))))
    return pairs.select("vec_id", turned.alias("t")).groupBy("vec_id").agg(F.max_by("t.angle", F.struct(F.col("t.score"), -F.col("t.nth"))).alias("angle"))


def masks_of_grids(pairs: DataFrame, side: int, threshold: float = DEFAULT.content_threshold) -> DataFrame:
    """vec_id and the content, missing and geometry masks (arrays of 0 and 1) of grey pairs (vec_id, ref, cand)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for v, ref, cand in zip(pdf["vec_id"], pdf["ref"], pdf["cand"]):
                a, b = (blurred(np.asarray(g, float).reshape(side, side)) < threshold for g in (ref, cand))
                rows.append((v, *(m.astype(int).ravel().tolist() for m in (a, missing_mask(a, b), geometry_mask(a, b)))))
            yield pd.DataFrame(rows, columns=["vec_id", "content", "missing", "geometry"])

    return pairs.mapInPandas(run, "vec_id long, content array<int>, missing array<int>, geometry array<int>")


def grids_as_png(pairs: DataFrame, side: int) -> DataFrame:
    """vec_id, content: each reference grid (vec_id, ref) as a grey PNG image."""

    def run(batches):
        from folioqc.sources import png

        for pdf in batches:
            yield pd.DataFrame([(v, png.encode(np.asarray(g).reshape(side, side))) for v, g in zip(pdf["vec_id"], pdf["ref"])], columns=["vec_id", "content"])

    return pairs.select("vec_id", "ref").mapInPandas(run, "vec_id long, content binary")


def fits(pairs: DataFrame) -> DataFrame:
    """id, off_x, off_y, scaled_w, scaled_h of references fitted to candidates by their contents.
    Pairs have id, ref_height, ref_width, ref, cand_height, cand_width, cand (RGB bytes). Equal pairs
    of a batch are fitted once."""

    def run(batches):
        for pdf in batches:
            rows, known = [], {}
            for i, *pair in pdf[["id", "ref_height", "ref_width", "ref", "cand_height", "cand_width", "cand"]].itertuples(index=False):
                rh, rw, ref, ch, cw, cand = pair
                key = rh, rw, hashlib.sha256(ref).digest(), ch, cw, hashlib.sha256(cand).digest()
                if key not in known:
                    x, y, w, h = content_bounds(np.frombuffer(cand, np.uint8).reshape(ch, cw, 3))
                    _, offset, size = fitted(np.frombuffer(ref, np.uint8).reshape(rh, rw, 3), cw, ch, (x + w / 2, y + h / 2))
                    known[key] = *offset, *size
                rows.append((i, *known[key]))
            yield pd.DataFrame(rows, columns=["id", "off_x", "off_y", "scaled_w", "scaled_h"])

    return pairs.mapInPandas(run, "id long, off_x int, off_y int, scaled_w int, scaled_h int")


def pixels_of(colour: tuple[int, int, int]):
    """A function of RGB bytes: how many pixels have the colour."""

    @F.pandas_udf("bigint")
    def count(content: pd.Series) -> pd.Series:
        of = np.asarray(colour, np.uint8)
        return pd.Series([None if c is None else int((np.frombuffer(c, np.uint8).reshape(-1, 3) == of).all(axis=1).sum()) for c in content], dtype="Int64")

    return count


def framed_as_png(pages: DataFrame) -> DataFrame:
    """id, content (PNG) of pages (id, height, width, image: RGB bytes) under the frame of a reference."""

    def run(batches):
        from folioqc.sources import png

        for pdf in batches:
            rows = [(i, png.encode(bordered(np.frombuffer(image, np.uint8).reshape(h, w, 3)))) for i, h, w, image in pdf[["id", "height", "width", "image"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["id", "content"])

    return pages.mapInPandas(run, "id long, content binary")


def components(grids: DataFrame, side: int, threshold: float, least_area: int = 1, least_ratio: float = 0.0) -> DataFrame:
    """vec_id, region_ord, x0, y0, x1, y1, area of cells below the threshold, through both gates."""

    def run(batches):
        for pdf in batches:
            rows = [
                (v, n, *c)
                for v, g in zip(pdf["vec_id"], pdf["grid"])
                for n, c in enumerate(gated(np.asarray(g).reshape(side, side) < threshold, least_area, least_ratio))
            ]
            yield pd.DataFrame(rows, columns=["vec_id", "region_ord", "x0", "y0", "x1", "y1", "area"])

    return grids.mapInPandas(run, "vec_id long, region_ord int, x0 int, y0 int, x1 int, y1 int, area int")


def _window(image: np.ndarray, size: int, reduce) -> np.ndarray:
    r = size // 2
    padded = np.pad(image, r, mode="edge")
    return reduce(np.lib.stride_tricks.sliding_window_view(padded, (size, size)), axis=(2, 3))


def dilate(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return _window(mask, size, np.max)


def erode(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return _window(mask, size, np.min)


def opened(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return dilate(erode(mask, size), size)


def closed(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return erode(dilate(mask, size), size)


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def blurred(image: np.ndarray) -> np.ndarray:
    k = np.array([1, 4, 6, 4, 1]) / 16
    padded = np.pad(image.astype(float), 2, mode="reflect")
    across = sum(w * padded[:, i : i + image.shape[1]] for i, w in enumerate(k))
    return sum(w * across[i : i + image.shape[0]] for i, w in enumerate(k))


def content_mask(rgb: np.ndarray, threshold: float = DEFAULT.content_threshold) -> np.ndarray:
    return blurred(gray(rgb)) < threshold


def crop_to_content(rgb: np.ndarray, padding: int = DEFAULT.crop_padding) -> np.ndarray:
    ys, xs = np.nonzero(content_mask(rgb))
    if not len(ys):
        return rgb
    h, w = rgb.shape[:2]
    return rgb[max(0, ys.min() - padding) : min(h, ys.max() + 1 + padding), max(0, xs.min() - padding) : min(w, xs.max() + 1 + padding)]


@functools.lru_cache(maxsize=64)
def _kernel(n: int, m: int, how: str) -> np.ndarray:
    """(m, n) weights that resample n samples to m: area (linear when growing), cubic, or lanczos."""
    if how == "area" and m < n:
        edges = np.arange(m + 1) * n / m
        cover = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
        return np.clip(cover, 0, None) * m / n
    at = (np.arange(m) + 0.5) * n / m - 0.5
    wide = max(1.0, n / m) if how == "lanczos" else 1.0
    reach = {"area": 1, "cubic": 2, "lanczos": 3}[how] * wide
    out = np.zeros((m, n))
    for i, x in enumerate(at):
        taps = np.arange(int(np.ceil(x - reach)), int(np.floor(x + reach)) + 1)
        if how == "lanczos":
            taps = taps[(taps >= 0) & (taps < n)]
        d = np.abs(taps - x) / wide
        if how == "area":
            w = np.clip(1 - d, 0, None)
        elif how == "cubic":
            # Fixed value: the cubic's parameter, -0.75.
            w = np.where(d <= 1, (1.25 * d - 2.25) * d * d + 1, np.where(d < 2, ((-0.75 * d + 3.75) * d - 6) * d + 3, 0))
        else:
            w = np.sinc(d) * np.sinc(d / 3) * (d < 3)
        np.add.at(out[i], np.clip(taps, 0, n - 1), w / w.sum())
    return out


def resized(image: np.ndarray, width: int, height: int, how: str = "area") -> np.ndarray:
    flat = image.reshape(*image.shape[:2], -1).astype(float)
    out = np.einsum("yh,hwc->ywc", _kernel(image.shape[0], height, how), flat, optimize=True)
    out = np.einsum("xw,ywc->yxc", _kernel(image.shape[1], width, how), out, optimize=True)
    return out.reshape(height, width, *image.shape[2:])


def _bytes(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def rotated(image: np.ndarray, angle: int) -> np.ndarray:
    """Turned counter-clockwise by 0, 90, 180 or 270 degrees."""
    if angle % 90:
        raise ValueError(f"no quarter turn: {angle}")
    return np.rot90(image, angle // 90 % 4)


def content_bounds(rgb: np.ndarray) -> tuple[int, int, int, int]:
    """x, y, width, height of the content; of the whole page if there is none."""
    ys, xs = np.nonzero(content_mask(rgb))
    if not len(ys):
        return 0, 0, rgb.shape[1], rgb.shape[0]
    return int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1


def fitted(rgb: np.ndarray, width: int, height: int, centre: tuple[float, float] | None) -> tuple[np.ndarray, tuple[int, int], tuple[int, int]]:
    """A white canvas with the image scaled to fit, its content's centre at the given one as far as
    the canvas allows (else in the middle); the offset and the scaled size."""
    h, w = rgb.shape[:2]
    scale = min(width / w, height / h)
    size = max(1, round(w * scale)), max(1, round(h * scale))
    small = _bytes(resized(rgb, *size, "cubic" if scale > 1 else "area"))
    x, y = (width - size[0]) // 2, (height - size[1]) // 2
    if centre is not None:
        bx, by, bw, bh = content_bounds(small)
        x, y = round(centre[0] - (bx + bw / 2)), round(centre[1] - (by + bh / 2))
        x, y = max(0, min(x, width - size[0])), max(0, min(y, height - size[1]))
    canvas = np.full((height, width, 3), 255, np.uint8)
    canvas[y : y + size[1], x : x + size[0]] = small
    return canvas, (x, y), size


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return float((a * b).sum() / norm) if norm else -1.0


def aspect(width: int, height: int, other_width: int, other_height: int) -> float:
    return -abs(other_width / max(other_height, 1) - width / max(height, 1))


def page_similarity(a: np.ndarray, b: np.ndarray, aspect_weight: float = 0.0) -> float:
    """Correlation of two pages' contents in grey at one size; with a weight, nearness of aspect counts too."""
    w, h = DEFAULT.similarity_size
    x, y = crop_to_content(a), crop_to_content(b)
    found = correlation(gray(_bytes(resized(x, w, h))), gray(_bytes(resized(y, w, h))))
    if found == -1.0 or not aspect_weight:
        return found
    return found + aspect_weight * aspect(x.shape[1], x.shape[0], y.shape[1], y.shape[0])


def aligned(ref: np.ndarray, cand: np.ndarray, rotations: tuple[int, ...] = DEFAULT.rotations, aspect_weight: float = 0.0) -> dict:
    """The first of the rotations in which the reference, fitted to the candidate, is most similar."""
    h, w = cand.shape[:2]
    x, y, bw, bh = content_bounds(cand)
    best = None
    for angle in rotations:
        canvas, offset, size = fitted(rotated(ref, angle), w, h, (x + bw / 2, y + bh / 2))
        score = page_similarity(canvas, cand, aspect_weight)
        if best is None or score > best["similarity"]:
            best = {"angle": angle, "canvas": canvas, "similarity": score, "target": (w, h), "offset": offset, "scaled": size}
    return best


def missing_mask(ref: np.ndarray, cand: np.ndarray) -> np.ndarray:
    return closed(opened(ref & ~cand))


def geometry_mask(ref: np.ndarray, cand: np.ndarray) -> np.ndarray:
    return dilate(closed(opened(ref ^ cand)))


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) scaled to bytes."""
    c = rgb / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([(116 * f[..., 1] - 16) * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)


def colour_mask(ref: np.ndarray, cand: np.ndarray, both: np.ndarray, distance: float = DEFAULT.colour_distance) -> np.ndarray:
    soft = lambda rgb: _bytes(np.stack([blurred(rgb[..., k]) for k in range(3)], axis=-1))
    far = np.linalg.norm(lab(soft(ref)) - lab(soft(cand)), axis=-1) >= distance
    return dilate(closed(opened(far & erode(both))))


def gated(mask: np.ndarray, least_area: int, least_ratio: float) -> list[tuple[int, int, int, int, int]]:
    total = mask.shape[0] * mask.shape[1]
    return [c for c in label_components(mask) if c[4] >= least_area and c[4] / total >= least_ratio]


def compare(ref: np.ndarray, cand: np.ndarray, rotations: tuple[int, ...] = DEFAULT.rotations) -> tuple[dict, dict[str, np.ndarray], dict[str, list[tuple[int, int, int, int, int]]]]:
    """The alignment, the three masks, and the regions of each that pass its gates, of two RGB pages of any size."""
    best = aligned(ref, cand, rotations)
    a, b = content_mask(best["canvas"]), content_mask(cand)
    masks = {"missing": missing_mask(a, b), "geometry": geometry_mask(a, b), "color": colour_mask(best["canvas"], cand, a & b)}
    gates = {"missing": DEFAULT.missing_gate, "geometry": DEFAULT.geometry_gate, "color": DEFAULT.colour_gate}
    return best, masks, {k: gated(m, *gates[k]) for k, m in masks.items()}


_REGION = "kind: string, region_ord: int, x0: double, y0: double, x1: double, y1: double, area_ratio: double"
COMPARED = f"job_id long, page_index int, angle int, similarity double, target_w int, target_h int, off_x int, off_y int, scaled_w int, scaled_h int, regions array<struct<{_REGION}>>, missing_mask binary, geometry_mask binary, color_mask binary"


def compared(pairs: DataFrame, masks: bool = False) -> DataFrame:
    """Alignment, regions and, if asked, mask images (PNG) of page pairs, in one pass over them.

    Pairs have job_id, page_index, ref_height, ref_width, ref, cand_height, cand_width, cand (RGB bytes).
    """

    def run(batches):
        from folioqc.sources import png

        for pdf in batches:
            rows = []
            for job, page, rh, rw, ref, ch, cw, cand in pdf[["job_id", "page_index", "ref_height", "ref_width", "ref", "cand_height", "cand_width", "cand"]].itertuples(index=False):
                best, found, regions = compare(np.frombuffer(ref, np.uint8).reshape(rh, rw, 3), np.frombuffer(cand, np.uint8).reshape(ch, cw, 3))
                listed = [
                    {"kind": kind, "region_ord": n, "x0": x0 / cw, "y0": y0 / ch, "x1": (x1 + 1) / cw, "y1": (y1 + 1) / ch, "area_ratio": area / (ch * cw)}
                    for kind, cs in regions.items() for n, (x0, y0, x1, y1, area) in enumerate(cs)
                ]
                images = [png.encode(m.astype(np.uint8) * 255) if masks else None for m in found.values()]
                rows.append((job, page, best["angle"], best["similarity"], *best["target"], *best["offset"], *best["scaled"], listed, *images))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return pairs.mapInPandas(run, COMPARED)


_COLUMNS = ["job_id", "page_index", "angle", "similarity", "target_w", "target_h", "off_x", "off_y", "scaled_w", "scaled_h", "regions", "missing_mask", "geometry_mask", "color_mask"]


def page_regions(found: DataFrame) -> DataFrame:
    """job_id, page_index, kind, region_ord, x0, y0, x1, y1, area_ratio of compared pages."""
    return found.select("job_id", "page_index", F.explode("regions").alias("r")).select("job_id", "page_index", "r.*")


def downscaled(rgb: np.ndarray, most: int) -> np.ndarray:
    """No side longer than most, if most is positive."""
    h, w = rgb.shape[:2]
    if most <= 0 or max(h, w) <= most:
        return rgb
    scale = most / max(h, w)
    return _bytes(resized(rgb, max(1, round(w * scale)), max(1, round(h * scale)), "lanczos"))


def on_canvas(rgb: np.ndarray, width: int, height: int) -> tuple[np.ndarray, tuple[int, int], tuple[int, int]]:
    """A white canvas with the image scaled to fit in its middle; the offset and the fitted size."""
    h, w = rgb.shape[:2]
    scale = min(width / w, height / h)
    size = max(1, round(w * scale)), max(1, round(h * scale))
    x, y = (width - size[0]) // 2, (height - size[1]) // 2
    canvas = np.full((height, width, 3), 255, np.uint8)
    canvas[y : y + size[1], x : x + size[0]] = _bytes(resized(rgb, *size, "lanczos"))
    return canvas, (x, y), size


def cropped(rgb: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A box in shares of the page, at least one pixel; halves round to even."""
    h, w = rgb.shape[:2]
    x0, y0 = max(0, min(w - 1, round(box[0] * w))), max(0, min(h - 1, round(box[1] * h)))
    return rgb[y0 : max(y0 + 1, min(h, round(box[3] * h))), x0 : max(x0 + 1, min(w, round(box[2] * w)))]


def _grown(box: tuple[float, float, float, float], margin: float = 0.02, least: float = 0.08) -> tuple[float, float, float, float]:
    sides = []
    for lo, hi in ((box[0], box[2]), (box[1], box[3])):
        lo, hi = max(0.0, lo - margin), min(1.0, hi + margin)
        mid = (lo + hi) / 2
        sides.append((max(0.0, mid - least / 2), min(1.0, mid + least / 2)) if hi - lo < least else (lo, hi))
    return sides[0][0], sides[1][0], sides[0][1], sides[1][1]


def evidence_crops(candidate: np.ndarray, reference: np.ndarray, found: list[tuple[tuple, tuple]], offset: tuple[int, int], size: tuple[int, int], most: int = DEFAULT.most_evidence) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate and reference crops of (candidate box, reference box) pairs, `most` at most. The
    reference lies on a canvas, at offset and in size."""
    h, w = reference.shape[:2]
    out = []
    for c, r in found[:most]:
        moved = tuple(max(0.0, min(1.0, (v * size[k % 2] + offset[k % 2]) / max((w, h)[k % 2], 1))) for k, v in enumerate(r))
        out.append((cropped(candidate, _grown(c)), cropped(reference, _grown(moved))))
    return out


# Letters of the panel's labels, five pixels wide and seven high.
_LETTERS = {
    "A": "01110 10001 10001 11111 10001 10001 10001", "C": "01111 10000 10000 10000 10000 10000 01111", "D": "11110 10001 10001 10001 10001 10001 11110",
    "E": "11111 10000 10000 11110 10000 10000 11111", "F": "11111 10000 10000 11110 10000 10000 10000", "I": "11111 00100 00100 00100 00100 00100 11111",
    "N": "10001 11001 10101 10011 10001 10001 10001", "P": "11110 10001 10001 11110 10000 10000 10000", "R": "11110 10001 10001 11110 10100 10010 10001",
    "T": "11111 00100 00100 00100 00100 00100 00100", "X": "10001 01010 00100 00100 00100 01010 10001", " ": "00000 00000 00000 00000 00000 00000 00000",
}


def _label(text: str, height: int) -> np.ndarray:
    rows = [" ".join(_LETTERS[c].split()[y] + "0" for c in text).replace(" ", "") for y in range(7)]
    k = max(1, height // 7)
    return np.kron(np.asarray([[int(x) for x in r] for r in rows]), np.ones((k, k), int)).astype(bool)


def side_by_side(candidate: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Both pages at one height in framed panes under their labels. Labels are drawn in a built-in
    face of pixels, so they differ from a font's; places and sizes do not."""
    target = max(candidate.shape[0], reference.shape[0])
    gutter, header = max(28, round(target * 0.02)), max(72, round(target * 0.08))
    pad = max(24, gutter)
    panes = []
    for image in (candidate, reference):
        h, w = image.shape[:2]
        panes.append(image if h == target else _bytes(resized(image, max(1, round(w * (target / max(h, 1)))), target, "lanczos")))
    panel = np.full((pad * 2 + header + target, pad * 2 + panes[0].shape[1] + panes[1].shape[1] + gutter, 3), 244, np.uint8)
    top, left = pad + header, pad
    for pane, name in zip(panes, ("PPTX CANDIDATE", "PDF REFERENCE")):
        w = pane.shape[1]
        panel[top - 1 : top + target + 1, left - 1 : left + w + 1] = 214
        panel[top : top + target, left : left + w] = pane
        mark = _label(name, max(18, round(header * 0.32)))
        y = pad + (header - mark.shape[0]) // 2
        area = panel[y : y + mark.shape[0], left : left + mark.shape[1]]
        area[mark[: area.shape[0], : area.shape[1]]] = 40
        left += w + gutter
    return panel


def bordered(rgb: np.ndarray) -> np.ndarray:
    """With the red frame of a reference page."""
    out = rgb.copy()
    h, w = out.shape[:2]
    thick = max(6, round(min(w, h) * 0.012))
    inset = max(1, thick // 2)
    frame = np.zeros((h, w), bool)
    frame[inset : h - inset, inset : w - inset] = True
    frame[inset + thick : h - inset - thick, inset + thick : w - inset - thick] = False
    out[frame] = (220, 40, 40)
    return out


def composed(reference: np.ndarray, candidate: np.ndarray | None, size: tuple[int, int] | None = None, rotations: tuple[int, ...] = (0,)) -> tuple[np.ndarray, int, float]:
    """A reference page as a full slide picture, its angle and score: fitted to the candidate's
    content, or to a given size by aspect alone."""
    best = None
    if candidate is not None:
        (ch, cw), (rh, rw) = candidate.shape[:2], reference.shape[:2]
        scale = max(1.0, min(rw / cw, rh / ch))
        width, height = max(cw, round(cw * scale)), max(ch, round(ch * scale))
        x, y, bw, bh = content_bounds(candidate)
        kx, ky = width / cw, height / ch
        centre = (round(x * kx) + max(1, round(bw * kx)) / 2, round(y * ky) + max(1, round(bh * ky)) / 2)
    else:
        (width, height), centre = size, None
    for angle in rotations:
        turned = rotated(reference, angle)
        canvas, _, _ = fitted(turned, width, height, centre)
        score = page_similarity(canvas, candidate, DEFAULT.aspect_weight) if candidate is not None else aspect(turned.shape[1], turned.shape[0], width, height)
        if best is None or score > best[2]:
            best = canvas, angle, score
    return best


def painted_pages(boxes: DataFrame) -> DataFrame:
    """id, height, width, image (RGB bytes) of white pages with one filled box each (id, height, width,
    x, y, w, h, red, green, blue)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, height, width, x, y, w, h, *colour in pdf[["id", "height", "width", "x", "y", "w", "h", "red", "green", "blue"]].itertuples(index=False):
                page = np.full((height, width, 3), 255, np.uint8)
                page[y : y + h, x : x + w] = colour
                rows.append((i, height, width, page.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "height", "width", "image"])

    return boxes.mapInPandas(run, "id long, height int, width int, image binary")


def prepared(pairs: DataFrame, most: int) -> DataFrame:
    """What a model is shown of page pairs (as compared() takes them): both pages with no side over
    most and the panel of both, as PNG, and their heights and widths."""
    names = ("candidate", "reference", "panel")

    def run(batches):
        from folioqc.sources import png

        for pdf in batches:
            rows = []
            for job, page, rh, rw, ref, ch, cw, cand in pdf[["job_id", "page_index", "ref_height", "ref_width", "ref", "cand_height", "cand_width", "cand"]].itertuples(index=False):
                a, b = (downscaled(np.frombuffer(i, np.uint8).reshape(h, w, 3), most) for i, h, w in ((cand, ch, cw), (ref, rh, rw)))
                rows.append((job, page, *(v for image in (a, b, side_by_side(a, b)) for v in (*image.shape[:2], png.encode(image)))))
            yield pd.DataFrame(rows, columns=["job_id", "page_index", *(f"{n}_{k}" for n in names for k in ("height", "width", "png"))])

    return pairs.mapInPandas(run, "job_id long, page_index int, " + ", ".join(f"{n}_height int, {n}_width int, {n}_png binary" for n in names))
