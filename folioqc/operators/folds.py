"""Order-dependent folds over the findings of a slide.

A dropped row must not suppress a later one, so these are folds over the slide's ordered rows and
not anti-joins. Slides (and types) pass in order through a task as a stream, many in a batch, and
only an open one is held, 40 bytes a finding; a row is compared with all kept ones at once. Only rows that overlap enough have to do with each other, so
the rows of a large slide are first parted into the components of that relation, and shares of
components are folded in tasks of their own, with the same result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioqc.functions import geometry as G
from folioqc.operators import spatial
from folioqc.params import DEFAULT

#: Rows that a group may have before it is parted, and rows that a share of it has, about.
LARGE, SHARE = 20_000, 2_000

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def _area(b: np.ndarray) -> np.ndarray:
    return np.maximum(0, b[..., 2] - b[..., 0]) * np.maximum(0, b[..., 3] - b[..., 1])


def _shared(kept: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(kept[:, 2], b[2]) - np.maximum(kept[:, 0], b[0])
    h = np.minimum(kept[:, 3], b[3]) - np.maximum(kept[:, 1], b[1])
    return np.maximum(0, w) * np.maximum(0, h)


def ious(kept: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = _shared(kept, b)
    union = _area(kept) + _area(b) - both
    return np.where((both > 0) & (union > 0), both / np.where(union > 0, union, 1), 0.0)


def covered(kept: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of b's area that each kept box covers."""
    area = _area(b)
    return _shared(kept, b) / area if area > 0 else np.zeros(len(kept))


Chosen = tuple[np.ndarray, dict[str, np.ndarray]]


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component (the smallest node reachable) of nodes that edges (keys, a, b) mention.

    The smallest label passes along edges and then along labels until none changes. Rounds are cut
    by reliable checkpoints in the shared folder; only whether a label changed comes to the driver.
    """
    ensure_checkpoints(edges.sparkSession)
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(*keys, "a").agg(F.min("b").alias("least")).select(*keys, F.col("a").alias("node"), F.least("least", "a").alias("component")).checkpoint()
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        stepped = labels.join(heard, [*keys, "node"]).select(*keys, "node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        further = labels.select(*keys, F.col("node").alias("component"), F.col("component").alias("further"))
        new = stepped.join(further, [*keys, "component"], "left").select(*keys, "node", "old", F.least("component", F.coalesce("further", "component")).alias("component")).checkpoint()
        if new.where("component <> old").isEmpty():
            return new.drop("old")
        labels = new.drop("old")


def ensure_checkpoints(spark) -> None:
    """The session's own folder; in plain local mode only, a temporary one stands in for it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    if not folder:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="folioqc-")
    context.setCheckpointDir(folder)


def _parted(flat: DataFrame, keys: list[str], order: list[str], depends) -> DataFrame:
    """flat with `share`: rows of a group that have to do with each other, directly or through
    others, have the same. Groups of up to LARGE rows have one share."""
    sizes = flat.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > LARGE)
    if sizes.isEmpty():
        return flat.withColumn("share", F.lit(0))
    # At most one row for every LARGE ones; a list that is long all the same is left to shuffle.
    n = F.ceil(F.col("rows") / SHARE).cast("int")
    large = flat.join(sizes, keys).withColumn("node", F.struct(*order))
    boxes = large.select(*keys, "node", G.box(*(F.col(f"bbox_{c}") for c in ("x0", "y0", "x1", "y1"))).alias("bbox"))
    met = spatial.pairs(boxes, boxes, keys, lambda a, b: (F.col("node_l") < F.col("node_r")) & depends(a, b))
    edges = met.select(*(F.col(f"{k}_l").alias(k) for k in keys), F.col("node_l").alias("a"), F.col("node_r").alias("b"))
    named = large.join(components(edges, keys), [*keys, "node"], "left")
    share = F.pmod(F.xxhash64(F.coalesce("component", "node")), n).cast("int")
    parted = named.withColumn("share", share).select(*flat.columns, "share")
    return flat.join(sizes.select(*keys), keys, "left_anti").withColumn("share", F.lit(0)).unionByName(parted)


def _folded(df: DataFrame, keys: list[str], order: list[str], more: list[str], names: list[str], choose: Callable[[np.ndarray, dict[str, np.ndarray]], Chosen], depends, **new_types: str) -> DataFrame:
    """The named columns of rows that choose(boxes, more columns), in order, keeps by number; it also
    gives the new columns. depends(a, b) holds for all boxes of which one may decide on the other."""
    fields = [*order, *more]
    flat = df.select(*keys, *fields, *(F.col("bbox")[n].alias(f"bbox_{n}") for n in ("x0", "y0", "x1", "y1")))

    def fold(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """What stays of the groups that begin at starts; the last one ends where rows do."""
        boxes = np.stack([rows[f"bbox_{n}"].to_numpy() for n in ("x0", "y0", "x1", "y1")], axis=1)
        others = {f: rows[f].to_numpy() for f in more}
        kept, new = [], {n: [] for n in new_types}
        for lo, hi in zip(starts, np.append(starts[1:], len(boxes))):
            numbers, found = choose(boxes[lo:hi], {f: v[lo:hi] for f, v in others.items()})
            kept.append(numbers + lo)
            for n, v in found.items():
                new[n].append(v)
        out = rows.take(pa.array(np.concatenate(kept), pa.int64())).combine_chunks()
        flatly = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
        box = pa.StructArray.from_arrays([flatly(out[f"bbox_{n}"]) for n in ("x0", "y0", "x1", "y1")], ["x0", "y0", "x1", "y1"])
        columns = {c: flatly(out[c]) for c in (*keys, *fields)} | {"bbox": box} | {n: pa.array(np.concatenate(v)) for n, v in new.items()}
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of the group that the batches so far have left open.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("nth")).to_numpy() == 1)
            if len(starts):
                rows = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
                if rows.num_rows:
                    before = sum(h.num_rows for h in held)
                    yield fold(rows, np.unique(np.append(0, starts[:-1] + before)))
                held = [batch.slice(starts[-1])]
            else:
                held.append(batch)
        if held and sum(h.num_rows for h in held):
            yield fold(pa.Table.from_batches(held), np.array([0]))

    types = dict(df.dtypes) | {"bbox": BOX} | new_types
    ordered = Window.partitionBy(*keys, "share").orderBy(*(F.asc_nulls_last(c) for c in order))
    numbered = _parted(flat, keys, order, depends).withColumn("nth", F.row_number().over(ordered))
    return numbered.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names))


def keep_first(df: DataFrame, threshold: float = DEFAULT.dedup_rule) -> DataFrame:
    """Rows (slide, type, ord, bbox) whose box no earlier kept row of its type overlaps."""

    def choose(boxes: np.ndarray, _: dict) -> Chosen:
        kept = np.empty(len(boxes), np.int64)
        n = 0
        for i, b in enumerate(boxes):
            if not (ious(boxes[kept[:n]], b) >= threshold).any():
                kept[n] = i
                n += 1
        return kept[:n], {}

    return _folded(df, ["slide", "type"], ["ord"], [], ["slide", "type", "ord", "bbox"], choose, lambda a, b: G.iou(a, b) >= threshold)


def keep_best(df: DataFrame, threshold: float = DEFAULT.dedup_model) -> DataFrame:
    """Rows (slide, type, ord, bbox, confidence); a row that matches a kept one takes the place of
    the first such if it is strictly more confident, and is dropped otherwise. place is the
    position that a row holds among its type, place_ord the ord of the row that opened it."""

    def choose(boxes: np.ndarray, more: dict) -> Chosen:
        kept = np.empty(len(boxes), np.int64)
        opened, confidence, n = [], more["confidence"], 0
        for i, b in enumerate(boxes):
            hit = np.flatnonzero(ious(boxes[kept[:n]], b) >= threshold)
            if not len(hit):
                kept[n] = i
                opened.append(i)
                n += 1
            elif confidence[i] > confidence[kept[hit[0]]]:
                kept[hit[0]] = i
        return kept[:n], {"place_ord": more["own"][opened]}

    own = df.withColumn("own", F.col("ord").cast("bigint"))
    found = _folded(own, ["slide", "type"], ["ord"], ["confidence", "own"], ["slide", "type", "place_ord", "ord", "bbox", "confidence"], choose, lambda a, b: G.iou(a, b) >= threshold, place_ord="bigint")
    place = F.row_number().over(Window.partitionBy("slide", "type").orderBy("place_ord")) - 1
    return found.select("slide", "type", place.alias("place"), "place_ord", "ord", "bbox", "confidence")


def suppress_covered(df: DataFrame, threshold: float = DEFAULT.region_overlap, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Rows (slide, the columns of order, fixed, bbox) in order; rows that are not fixed go if a kept
    row of any type covers the threshold (above 0) of their area."""

    def choose(boxes: np.ndarray, more: dict) -> Chosen:
        kept = np.empty(len(boxes), np.int64)
        n = 0
        for i, b in enumerate(boxes):
            if more["fixed"][i] or not (covered(boxes[kept[:n]], b) >= threshold).any():
                kept[n] = i
                n += 1
        return kept[:n], {}

    either = lambda a, b: (G.overlap_ratio(a, b) >= threshold) | (G.overlap_ratio(b, a) >= threshold)
    return _folded(df, ["slide"], list(order), ["fixed"], ["slide", *order, "fixed", "bbox"], choose, either)
