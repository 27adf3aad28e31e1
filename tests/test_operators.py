"""Folds, matching, packages, intake and kernels against plain Python."""

import io
import json
import random
import zipfile
from difflib import SequenceMatcher

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioqc.functions import fuzzy
from folioqc.functions import geometry as G
from folioqc.functions.text import normalise_strict, normalise_text
from folioqc.operators import folds, raster
from folioqc.plans import model_qc
from folioqc.sources import files, ooxml


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return w * h / (area(a) + area(b) - w * h)


def random_findings(n=160, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(6) * 0.05, rng.randrange(5) * 0.07
        rows.append((rng.randrange(4), i, rng.choice("ab"), rng.randrange(50) / 50, (x, y, x + 0.5, y + 0.5)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "slide long, ord long, type string, confidence double, bbox struct<x0:double,y0:double,x1:double,y1:double>")


def test_keep_first_is_a_fold(spark):
    rows, kept = random_findings(), []
    for r in rows:
        if not any(k[0] == r[0] and k[2] == r[2] and iou(k[4], r[4]) >= 0.72 for k in kept):
            kept.append(r)
    got = folds.keep_first(frame(spark, rows)).select("slide", "ord").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[1]) for r in kept)


def test_keep_best_replaces_first_match(spark):
    rows, groups = random_findings(seed=2), {}
    for r in rows:
        kept = groups.setdefault((r[0], r[2]), [])
        hit = next((i for i, k in enumerate(kept) if iou(k[4], r[4]) >= 0.82), None)
        if hit is None:
            kept.append(r)
        elif r[3] > kept[hit][3]:
            kept[hit] = r
    got = folds.keep_best(frame(spark, rows)).select("slide", "type", "place", "ord").collect()
    assert sorted(map(tuple, got)) == sorted((*g, i, r[1]) for g, k in groups.items() for i, r in enumerate(k))


def test_folds_of_nothing(spark):
    assert folds.keep_first(frame(spark, [])).count() == folds.keep_best(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=4, max_size=4))
def test_rotation_by_quarter_turns_returns(v):
    x, y = v[0], v[1]
    for _ in range(4):
        x, y = y, 1 - x
    assert abs(x - v[0]) < 1e-9 and abs(y - v[1]) < 1e-9


def test_boxes(spark):
    row = spark.range(1).select(
        G.from_array(F.array(*map(F.lit, (0.9, 0.2, 0.1, 1.5)))).alias("a"), G.from_array(F.array(F.lit(0.1))).alias("b"), G.emu_to_pixels(F.lit(914400 * 2)).alias("p")
    ).first()
    assert tuple(row.a) == (0.1, 0.2, 0.9, 1.0) and tuple(row.b) == (0, 0, 1, 1) and row.p == 480


def test_ratio_depends_on_order():
    assert fuzzy.ratio_of("tide", "diet") == SequenceMatcher(None, "tide", "diet").ratio() == 0.25
    assert fuzzy.ratio_of("diet", "tide") == 0.5


def test_normalisation():
    assert normalise_text(" “Straße” –  x ") == '"strasse" - x'
    assert normalise_strict("co- operate​") == "co-operate"


def test_greedy_takes_best_unused(spark):
    schema = "job_id long, page_index int, ord int, text string"
    ref = spark.createDataFrame([(1, 0, 0, "alpha beta"), (1, 0, 1, "alpha beta"), (1, 0, 2, "zzz")], schema)
    cand = spark.createDataFrame([(1, 0, 0, "alpha bets"), (1, 0, 1, "alpha beta")], schema)
    got = {r.ref_ord: r.cand_ord for r in fuzzy.greedy_matches(ref, cand).collect()}
    assert got == {0: 1, 1: 0, 2: None}


def test_components_are_eight_connected():
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 4] = mask[4, 5] = True
    assert raster.label_components(mask) == [(0, 0, 1, 1, 2), (4, 4, 5, 4, 2)]


def test_page_compare_finds_kinds():
    ref, cand = (np.full((300, 400, 3), 255, np.uint8) for _ in range(2))
    ref[50:120, 60:180] = 0
    best, masks, found = raster.compare(ref, cand)
    assert found["missing"] and not found["color"] and best["similarity"] == -1.0 and masks["missing"].shape == (300, 400)
    cand[50:120, 60:180] = (200, 0, 0)
    ref[50:120, 60:180] = (0, 0, 200)
    best, _, found = raster.compare(ref, cand)
    assert found["color"] and not found["missing"] and (best["angle"], best["offset"], best["scaled"]) == (0, (0, 0), (400, 300)) and best["similarity"] > 0.9


def package() -> bytes:
    p, a = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    xfrm = f'<a:xfrm xmlns:a="{a}"><a:off x="10" y="20"/><a:ext cx="30" cy="40"/></a:xfrm>'
    shape = f'<p:sp><p:spPr>{xfrm}</p:spPr><p:txBody><a:p><a:r><a:t>Hello  there</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{shape}<p:grpSp><p:grpSpPr>{xfrm}</p:grpSpPr>{shape}</p:grpSp></p:spTree></p:cSld></p:sld>'
    pres = f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>'
    rels = '<Relationships xmlns="x"><Relationship Id="rId1" Target="slides/slide1.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("ppt/presentation.xml", pres), ("ppt/_rels/presentation.xml.rels", rels), ("ppt/slides/slide1.xml", slide)):
            z.writestr(name, data)
    return out.getvalue()


def test_package_reader_and_patch(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(package())
    (tmp_path / "b.pptx").write_bytes(b"not a package")
    packs = ooxml.read_packages(spark, str(tmp_path))
    m = {r.path[-6:]: tuple(r)[1:] for r in ooxml.slide_metrics(packs).collect()}
    assert m == {"a.pptx": (1, 9144000, 6858000), "b.pptx": (None, None, None)}
    good = packs.where(F.endswith("path", F.lit("a.pptx")))
    text = ooxml.slide_text(good).orderBy("ord").collect()
    assert [(r.left, r.top, r.text) for r in text] == [(10, 20, "Hello there"), (20, 40, "Hello there")]
    add = good.select("path", F.lit("ppt/new.xml").alias("part"), F.lit("x").cast("binary").alias("data"))
    new = ooxml.patched(good, add)
    assert "ppt/new.xml" in {r.part for r in ooxml.parts(new).collect()}
    wanted = good.select("path", F.lit(0).alias("ord"))
    assert ooxml.new_numbers(ooxml.parts(new), wanted, "slide([0-9]+)[.]xml$").first().number == 2


def test_env_file_and_listing(spark, tmp_path):
    (tmp_path / "env").write_text("# c\nexport A='x # y'\nB=1 # note\nB=2\nbad\n")
    assert dict(map(tuple, files.env_file(spark, str(tmp_path / "env")).collect())) == {"A": "x # y", "B": "2"}
    for n in ("Slide_1", "Slide_10", "Slide_11", "Slide_2"):
        (tmp_path / f"{n}.png").write_bytes(b"x")
    (tmp_path / "Slide_3.png").write_bytes(b"")
    got = files.image_listing(spark, str(tmp_path)).orderBy("page_index").collect()
    assert [r.name for r in got] == ["Slide_1.png", "Slide_2.png", "Slide_10.png", "Slide_11.png"]


def test_model_errors_stay_on_their_page(spark):
    def model(page):
        if page["slide"] == 1:
            raise RuntimeError("down")
        return json.dumps({"status": "ok", "bullets": [], "findings": []}) if page["slide"] == 0 else "{"

    got = {r.slide: (r.result is not None, r.error is not None) for r in model_qc.call_model(spark.range(3).withColumnRenamed("id", "slide"), model).collect()}
    assert got == {0: (True, False), 1: (False, True), 2: (False, True)}
