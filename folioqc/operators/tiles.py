"""Connected components of rasters that are larger than one task should hold.

A raster is a relation of tiles. Each is labelled where it is; only the pixels along its border
leave it, to meet those of its neighbours, and labels that touch are united by the components of
that relation. Then boxes and areas are sums over parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioqc.operators.folds import components

SIDE = 512
TILE = "id long, ty int, tx int, height int, width int, mask binary"
PART = "id long, ty int, tx int, label int, x0 int, y0 int, x1 int, y1 int, area long, first_y int, first_x int, border array<struct<y: int, x: int>>"


def tiles_of(masks: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of masks (id, height, width, mask: a byte a pixel, row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, h, w = (batch.column(k)[i].as_py() for k in range(3))
                pixels = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8).reshape(h, w)
                for y in range(0, h, side):
                    cut = [np.ascontiguousarray(pixels[y : y + side, x : x + side]) for x in range(0, w, side)]
                    yield pa.RecordBatch.from_pylist([{"id": key, "ty": y // side, "tx": n, "height": t.shape[0], "width": t.shape[1], "mask": t.tobytes()} for n, t in enumerate(cut)], schema=TILE_SCHEMA)

    return masks.select("id", "height", "width", "mask").mapInArrow(run, TILE)


TILE_SCHEMA = pa.schema([("id", pa.int64()), *((n, pa.int32()) for n in ("ty", "tx", "height", "width")), ("mask", pa.binary())])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of set pixels, in raster order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return y, x0, np.nonzero(edge == -1)[1] - 1


def labelled(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The number of the component of each run, by its first run: runs of two rows that follow touch
    when their columns overlap or are neighbours."""
    parent = list(range(len(y)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows = np.searchsorted(y, np.arange(y[-1] + 2)) if len(y) else np.zeros(1, int)
    for above, here, end in zip(rows, rows[1:], rows[2:]):
        i, j = above, here
        while i < here and j < end:
            if x0[i] <= x1[j] + 1 and x0[j] <= x1[i] + 1:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    return np.asarray([root(i) for i in range(len(y))], int)


def parts(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """The components of each tile, in the raster's coordinates, with their pixels on its border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, ty, tx, h, w, mask = (batch.column(k)[i].as_py() for k in range(6))
                y, x0, x1 = runs(np.frombuffer(mask, np.uint8).reshape(h, w) > 0)
                label = labelled(y, x0, x1)
                order = np.argsort(label, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(label[order])) + 1, len(order)) if len(order) else []
                out, lo = [], 0
                for hi in ends:
                    mine = order[lo:hi]
                    lo = hi
                    yy, aa, bb = y[mine], x0[mine], x1[mine]
                    border = []
                    for r, a, b in zip(yy.tolist(), aa.tolist(), bb.tolist()):
                        across = range(a, b + 1) if r in (0, h - 1) else sorted({c for c in (0, w - 1) if a <= c <= b})
                        border += [{"y": ty * side + r, "x": tx * side + c} for c in across]
                    out.append({
                        "id": key, "ty": ty, "tx": tx, "label": int(label[mine[0]]), "x0": tx * side + int(aa.min()), "y0": ty * side + int(yy[0]), "x1": tx * side + int(bb.max()), "y1": ty * side + int(yy[-1]),
                        "area": int((bb - aa + 1).sum()), "first_y": ty * side + int(yy[0]), "first_x": tx * side + int(aa[0]), "border": border,
                    })
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=PART_SCHEMA)

    return tiles.mapInArrow(run, PART)


PART_SCHEMA = pa.schema([
    ("id", pa.int64()), *((n, pa.int32()) for n in ("ty", "tx", "label", "x0", "y0", "x1", "y1")), ("area", pa.int64()), ("first_y", pa.int32()), ("first_x", pa.int32()),
    ("border", pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32())]))),
])


def large_components(tiles: DataFrame, side: int = SIDE, least_area: int = 1) -> DataFrame:
    """id, region_ord, x0, y0, x1, y1, area of the 8-connected components of rasters of tiles (id, ty,
    tx, height, width, mask), in raster order of their first pixel; smaller ones are left out and
    not numbered. A raster without set pixels has none."""
    found = parts(tiles, side).withColumn("node", F.struct("ty", "tx", "label"))
    pixels = found.select("id", "ty", "tx", "node", F.explode("border").alias("p")).select("id", "ty", "tx", "node", "p.y", "p.x")
    ahead = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("d")
    reach = pixels.select("id", "ty", "tx", F.col("node").alias("a"), "y", "x", ahead).select("id", "ty", "tx", "a", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    reach = reach.where((F.floor(F.col("y") / side) != F.col("ty")) | (F.floor(F.col("x") / side) != F.col("tx"))).drop("ty", "tx")
    edges = reach.join(pixels.select("id", "y", "x", F.col("node").alias("b")), ["id", "y", "x"]).select("id", "a", "b").distinct()
    united = found.join(components(edges, ["id"]), ["id", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct("first_y", "first_x")).alias("first")
    whole = united.groupBy("id", "component").agg(*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")), F.sum("area").alias("area"), first).where(F.col("area") >= least_area)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("first")) - 1
    return whole.select("id", nth.alias("region_ord"), "x0", "y0", "x1", "y1", "area")
