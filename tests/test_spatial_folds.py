"""Spatial joins by grids and folds by components against plain loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from folioqc.functions import geometry as G
from folioqc.operators import folds, spatial

SCHEMA = "slide long, type string, ord long, x0 double, y0 double, x1 double, y1 double, confidence double, fixed boolean"


def area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def shared(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def iou(a, b):
    both = shared(a, b)
    union = area(a) + area(b) - both
    return both / union if both > 0 and union > 0 else 0.0


def ratio(a, b):
    return shared(a, b) / area(a) if area(a) > 0 else 0.0


def made(seed, n, slides=2, size=0.2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.choice([rng.random(), rng.randrange(8) / 8]), rng.choice([rng.random(), rng.randrange(8) / 8])
        w, h = rng.choice([0.0, 0.125, 1.0 if rng.random() < 0.1 else 0.25, rng.random() * size, rng.random() * 0.01]), rng.random() * size
        rows.append((rng.randrange(slides), rng.choice("ab"), i, x, y, min(1.2, x + w), min(1.2, y + h), rng.randrange(4) / 4, rng.random() < 0.3))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("bbox", G.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).drop("x0", "y0", "x1", "y1")


def touches(a, b):
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return iou(a, b) >= 0.08 or (b[0] <= x <= b[2] and b[1] <= y <= b[3])


@pytest.mark.parametrize("seed", range(3))
def test_joins_test_every_pair_that_matters(spark, seed):
    left, right = made(seed, 150), made(seed + 50, 150)
    a, b = frame(spark, left), frame(spark, right)
    box = lambda r: r[3:7]
    near = lambda l, test: {l[2]} if any(l[0] == r[0] and test(box(l), box(r)) for r in right) else set()  # noqa: E731, E741
    ords = lambda df: sorted(r.ord for r in df.collect())
    on = sorted(set().union(*(near(r, touches) for r in left)))
    assert ords(spatial.on_text(a, b)) == on
    assert ords(spatial.uncovered(a, b)) == sorted({r[2] for r in left} - set().union(*(near(r, lambda x, y: ratio(x, y) >= 0.35) for r in left)))
    sure = {r[2] for r in left if r[7] >= 0.9}
    assert ords(spatial.visual_fallback(a, b)) == sorted(sure - set(on))
    third = lambda v: (v >= 0.33) + (v >= 0.66)
    ninth = lambda q: (third((q[0] + q[2]) / 2), third((q[1] + q[3]) / 2))
    assert ords(spatial.supported(a, b)) == sorted(set().union(*(near(r, lambda x, y: touches(x, y) or ninth(x) == ninth(y)) for r in left)))
    got = {(r.slide, r.para): (r.n_lines, r.lines) for r in spatial.lines_of_paragraphs(b, a).collect()}
    lines = {(p[0], p[2]): [q[2] for q in right if q[0] == p[0] and ratio(box(p), box(q)) >= 0.55] for p in left}
    assert got == {k: (len(v), sorted(v)) for k, v in lines.items()}
    met = spatial.pairs(a, b, ["slide"], lambda x, y: G.iou(x, y) >= 0.3).collect()
    assert sorted((r.ord_l, r.ord_r) for r in met) == sorted((p[2], q[2]) for p in left for q in right if p[0] == q[0] and iou(box(p), box(q)) >= 0.3)


def test_joins_with_repeated_rows_and_none(spark):
    rows = made(9, 30)
    a = frame(spark, rows + rows)
    assert spatial.on_text(a, a).count() == 2 * spatial.on_text(frame(spark, rows), a).count()
    assert spatial.on_text(a, a.limit(0)).count() == 0 and spatial.uncovered(a, a.limit(0)).count() == 60
    assert all(r.n_lines == 0 and r.lines == [] for r in spatial.lines_of_paragraphs(a.limit(0), a).collect())


@pytest.mark.parametrize("seed", range(2))
def test_large_slides_fold_by_components(spark, monkeypatch, seed):
    """The same rows whether a slide is folded as one group or in shares of its components."""
    a = frame(spark, made(seed, 400, 2, 0.1)).cache()
    folded = [lambda: folds.keep_first(a, 0.3), lambda: folds.keep_best(a, 0.3), lambda: folds.suppress_covered(a.drop("type", "confidence"), 0.5)]
    whole = [sorted(map(str, f().collect())) for f in folded]
    monkeypatch.setattr(folds, "LARGE", 60)
    monkeypatch.setattr(folds, "SHARE", 20)
    assert [sorted(map(str, f().collect())) for f in folded] == whole
    assert 0 < len(whole[0]) < 400 and 0 < len(whole[2]) < 400


def test_components_reach_as_far_as_chains(spark):
    edges = [(1, i, i + 1) for i in range(40)] + [(1, 100, 102), (1, 101, 102), (2, 5, 6)]
    got = {(r.slide, r.node): r.component for r in folds.components(spark.createDataFrame(edges, "slide long, a long, b long"), ["slide"]).collect()}
    assert got == {(1, i): 0 for i in range(41)} | {(1, i): 100 for i in (100, 101, 102)} | {(2, 5): 5, (2, 6): 5}
