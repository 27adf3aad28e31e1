"""Steps that failed or grew too slow on large tables, on small ones that show the same."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from folioqc.functions import fuzzy
from folioqc.operators import folds, layouts, raster, spatial
from folioqc.plans import catalog
from folioqc.sources import ooxml, png

SCORES = "page long, ref_ord long, cand_ord long, score double"


def test_a_score_of_zero_is_taken_where_none_is_asked_for(spark):
    rows = [(1, 1, 7, 0.0), (1, 2, 7, 0.4), (1, 2, 8, 0.0), (2, 1, 5, -0.5)]
    found = fuzzy.greedy_by_score(spark.createDataFrame(rows, SCORES), 0.0).collect()
    assert sorted((r.page, r.ref_ord, r.cand_ord, r.score) for r in found[:]) == [(1, 1, 7, 0.0), (1, 2, 8, 0.0), (2, 1, None, None)]


def test_greedy_choice_over_streams_of_many_pages(spark):
    random.seed(4)
    rows = [(p, r, c, random.randrange(5) / 4) for p in range(30) for r in range(p % 7 + 1) for c in range(p % 5 + 1)]
    want = []
    for page in sorted({r[0] for r in rows}):
        used = set()
        for ref in sorted({r[1] for r in rows if r[0] == page}):
            free = sorted((-v, c) for p, r, c, v in rows if (p, r) == (page, ref) and v >= 0.5 and c not in used)
            used |= {c for _, c in free[:1]}
            want.append((page, ref, free[0][1] if free else None, -free[0][0] if free else None))
    scores = spark.createDataFrame(random.sample(rows, len(rows)), SCORES)
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = fuzzy.greedy_by_score(scores, 0.5)
            assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # No page is a group of its own in Python.
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_folds_over_streams_of_many_slides(spark):
    random.seed(6)
    rows = [(s, "a", n, (x := random.random() / 4), 0.1, x + 0.5, 0.6, random.random()) for s in range(12) for n in range(s + 1)]
    given = spark.createDataFrame(random.sample(rows, len(rows)), "slide long, type string, ord long, x0 double, y0 double, x1 double, y1 double, confidence double")
    boxes = given.select("slide", "type", "ord", "confidence", F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    want = []
    for s in range(12):
        kept = []
        for r in (r for r in rows if r[0] == s):
            if all((both := max(0, min(r[5], k[5]) - max(r[3], k[3])) * 0.5) / (0.5 - both) < 0.72 for k in kept):
                kept.append(r)
        want += [(s, k[2]) for k in kept]
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = folds.keep_first(boxes)
            assert sorted((r.slide, r.ord) for r in found.collect()) == want
            assert folds.keep_best(boxes).count() == len({(r.slide, r.place) for r in folds.keep_best(boxes).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # No slide is a group of its own in Python.
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_rows_in_cells_are_never_broadcast(spark):
    box = F.struct(*(F.lit(v).alias(n) for n, v in (("x0", 0.1), ("y0", 0.1), ("x1", 0.9), ("y1", 0.9))))
    rows = spark.range(3).select(F.col("id").alias("slide"), F.col("id").alias("ord"), box.alias("bbox"))
    found = spatial.uncovered(rows, rows)
    assert not found.collect() and "BroadcastHashJoin" not in found._jdf.queryExecution().toString()


def test_a_page_text_meets_its_items_once(spark):
    texts = spark.createDataFrame([(1, 0, "  aß😀cdefgh "), (2, 0, None)], "job_id long, page_index int, text string")
    given = [(1, 0, 5, [(0, 4), (5, 6)], 0.5), (1, 0, 6, [(8, 99)], None), (1, 0, 7, None, 0.1), (2, 0, 1, [(0, 3)], 0.2), (3, 0, 1, [(0, 3)], 0.3), (1, 0, 8, [(3, 1), (None, 2)], 0.4)]
    items = spark.createDataFrame(given, "job_id long, page_index int, item long, segments array<struct<start: long, end: long>>, confidence double")
    found = layouts.anchored_text(items, texts)
    assert sorted((r.job_id, r.item, r.text, r.confidence) for r in found.collect()) == [(1, 5, "aßc", 0.5), (1, 6, "fgh", None), (1, 7, "", 0.1), (1, 8, "", 0.4), (2, 1, "", 0.2), (3, 1, "", 0.3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") > plan.index("explode") and "Aggregate" in plan[plan.index("Join") :]


def test_small_files_of_much_work_are_dealt_to_many_tasks(spark):
    for name in ("snk10_framed_pages", "im2_im4_fitted_pages"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pixels_of_a_colour_and_rows_without_filters(spark):
    image = np.random.default_rng(3).integers(0, 2, (7, 5, 3), np.uint8)
    rows = spark.createDataFrame([(bytearray(image.tobytes()),), (None,)], "content binary")
    assert [r[0] for r in rows.select(raster.pixels_of((1, 0, 1))("content")).collect()] == [int((image == (1, 0, 1)).all(axis=-1).sum()), None]
    assert (png.decode(png.encode(image)) == image).all()


def test_blocks_equal_difflib():
    random.seed(2)
    for _ in range(400):
        letters = random.choice(["ab", "abcdefgh é😀", "a" * 50 + "bcdefghijkl"])
        a, b = ("".join(random.choices(letters, k=random.randrange(random.choice([1, 6, 60, 400])))) for _ in "ab")
        assert fuzzy.ratio_of(a, b) == SequenceMatcher(None, a, b).ratio()


def test_pages_of_items_pass_as_a_stream(spark):
    schema = "job_id long, page_index int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
    side = lambda t: spark.createDataFrame([(p, 0, i, f"{t} {i}" if p % 4 else " ", 0.0, i / 9, 0.2, i / 9 + 0.1) for p in range(250) for i in range(p % 3 + 1)] + [(900, 0, 0, None, 0.0, 0.0, 0.1, 0.1)], schema)
    found = fuzzy.text_discrepancies(side("total"), side("totals").where("page_index = 0 and job_id <> 6"))
    want = [(p, i, f"total {i}", f"totals {i}") for p in range(250) if p % 4 and p != 6 for i in range(p % 3 + 1)]
    assert sorted((r.job_id, r.ord, r.reference_text, r.candidate_text) for r in found.collect()) == want
    # No page is a group of its own in Python.
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()


def test_items_of_a_page_meet_once(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    at = (0.1, 0.2, 0.3, 0.4)
    lines = spark.createDataFrame([(1, 0, 5, 1, "b", at), (1, 0, 5, 0, "a", at), (1, 0, 2, 9, " \x1c\n", at), (2, 0, 1, 0, " ", at)], f"job_id long, page_index int, para_ord long, line_ord long, text string, bbox {box}")
    paragraphs = spark.createDataFrame([(1, 0, 5, "a b", at), (2, 0, 1, "p", at), (3, 0, 4, "q", at), (3, 0, 3, "", at), (3, 1, 0, "r", at)], f"job_id long, page_index int, para_ord long, text string, bbox {box}")
    items = layouts.text_items(lines, paragraphs)
    assert sorted((r.job_id, r.page_index, r.ord, r.text) for r in items.collect()) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (3, 0, 0, "q"), (3, 1, 0, "r")]
    assert "Join" not in items._jdf.queryExecution().optimizedPlan().toString()
    # The text goes with its box: a page's items are not worked out twice to be joined.
    plan = catalog.QUERIES["prj4_pl9_text_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 4


def test_only_the_ends_of_a_text_are_stripped(spark):
    spaces = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
    texts = ["", " ", "a", f"{spaces}a {spaces}b\n{spaces}", spaces, "​x​", "ß😀 ", "a\r\n"]
    row = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(layouts.stripped(F.col("t")).alias("s"))
    assert [r.s for r in row.collect()] == [*(t.strip() for t in texts), None]
    assert "regexp" not in row._jdf.queryExecution().optimizedPlan().toString()


def test_packages_are_made_and_listed_once_and_few_at_a_time(spark):
    found = catalog.QUERIES["ag12_next_ids"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "FlatMap" not in plan and "MapInPandas" not in plan
    assert "FlatMap" not in catalog.QUERIES["snk3_media_parts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    most = []

    def run(rows):
        held = list(rows)
        most.append(len(held))
        return held if held[0][0] else []

    batches = [pa.RecordBatch.from_arrays([pa.array(range(100))], ["n"]), pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])]
    out = list(ooxml._in_turn(batches, run, {"n": pa.int64()}))
    assert max(most) == ooxml.FEW and [n for b in out for n in b.column(0).to_pylist()] == list(range(ooxml.FEW, 100))


def test_next_numbers_of_packages_with_and_without_such_parts(spark):
    listed = spark.createDataFrame([("a", "s/slide7.xml"), ("a", "s/slide12.xml"), ("a", "m/image3.png"), ("b", "x")], "path string, part string")
    found = ooxml.next_numbers(listed, slide="slide([0-9]+)[.]xml$", image="image([0-9]+)[.]")
    assert sorted(map(tuple, found.collect())) == [("a", 13, 4), ("b", 1, 1)]
    images = spark.createDataFrame([("lost.pptx", 0, None, "a.png", b"x")], "path string, ord int, after int, name string, data binary")
    with pytest.raises(Exception, match="no package lost.pptx"):
        ooxml.with_reference_slides(spark.createDataFrame([], "path string, content binary"), images).collect()
