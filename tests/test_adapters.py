"""Pages, decks, converters and sinks with fake readers, recognisers and programs."""

import io
import random
import sys
import zipfile
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_operators import package

from folioqc.functions import fuzzy
from folioqc.functions.text import casefolded, normalise_text, normalised
from folioqc.operators import fonts, layouts, raster, report
from folioqc.plans import conversion, model_qc, rule_qc
from folioqc.sources import files, ooxml, pdf, png

# Workers cannot import this file, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def painted(height, width, *boxes, colour=(0, 0, 0)):
    image = np.full((height, width, 3), 255, np.uint8)
    for x0, y0, x1, y1 in boxes:
        image[y0:y1, x0:x1] = colour
    return image


def filtered_png(image, kind):
    """A PNG whose rows all use one filter, written as the format says."""
    h, w, n = image.shape
    rows = []
    for y in range(h):
        row, up = image[y].ravel().astype(int), image[y - 1].ravel().astype(int) if y else np.zeros(w * n, int)
        out = []
        for i in range(w * n):
            a, b, c = row[i - n] if i >= n else 0, up[i], up[i - n] if i >= n else 0
            near = min((abs(a + b - c - v), k) for k, v in enumerate((a, b, c)))[1]
            guess = (0, a, b, (a + b) // 2, (a, b, c)[near])[kind]
            out.append((row[i] - guess) % 256)
        rows.append(bytes([kind, *out]))
    data = png.encode(image)
    head, tail = data[:33], data[-12:]
    body = zlib.compress(b"".join(rows))
    return head + len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big") + tail


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert (png.decode(filtered_png(image, kind)) == image).all()


def test_page_images(spark):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    rows = spark.createDataFrame([(1, png.encode(grey)), (2, b"no image"), (3, None)], "page_index int, content binary")
    got = {r.page_index: (r.height, r.width, r.content) for r in png.page_images(rows, ["page_index"]).collect()}
    assert got[1][:2] == (3, 4) and bytes(got[1][2]) == np.repeat(grey[..., None], 3, 2).tobytes() and got[2] == got[3] == (None, None, None)


def test_engines_fall_back(spark):
    def broken(content, dpi):
        raise OSError("no program")

    deck = spark.createDataFrame([(1, b"two"), (2, b"bad")], "job_id long, content binary")

    def plain(content, dpi):
        if content == b"bad":
            raise ValueError("no pages")
        return [png.encode(painted(4, 4)), f"{dpi}".encode()]

    got = [(r.job_id, r.page_index, r.engine, r.error) for r in pdf.rendered(deck, {"first": broken, "second": plain}).orderBy("job_id", "page_index").collect()]
    assert got == [(1, 0, "second", None), (1, 1, "second", None), (2, None, None, "no pages")]
    assert {r.error for r in pdf.rendered(deck, {"first": broken, "second": plain}, "first").collect()} == {"no program"}
    with pytest.raises(ValueError):
        pdf.rendered(deck, {}, "third")


def fake_text(content):
    span = lambda block, line, n, text, kind=0, font="ABCDEF+Face": {"block": block, "block_type": kind, "line": line, "span": n, "text": text, "font": font, "bbox": {"x0": 10.0, "y0": 20.0, "x1": 110.0, "y1": 40.0}}
    if content == b"blank":
        return [{"page_w": 200.0, "page_h": 100.0}]
    spans = [span(0, 0, 0, " Hello "), span(0, 0, 1, "world\u00a0"), span(0, 1, 0, "\u2003 "), span(1, 0, 0, "picture", 1), span(2, 0, 0, "x", font="Other")]
    return [{"page_w": 200.0, "page_h": 100.0, "spans": spans, "fonts": [{"name": "ABCDEF+Face", "type": "Type1", "embedded": False, "subset": False}]}]


def test_native_text_and_fonts(spark):
    pages = pdf.texts(spark.createDataFrame([(1, b"text"), (2, b"blank")], "job_id long, content binary"), fake_text)
    lines = layouts.lines_of_spans(pdf.spans_of(pages), pages.select("job_id", "page_index", "page_w", "page_h"))
    assert sorted((r.para_ord, r.text, tuple(r.bbox)) for r in lines.collect()) == [(0, "Hello world", (0.05, 0.2, 0.55, 0.4)), (2, "x", (0.05, 0.2, 0.55, 0.4))]
    native = layouts.measures(pages.select("job_id", "page_index"), layouts.paragraphs_of_lines(lines), False)
    assert {r.job_id: (r.total_characters, r.average_confidence) for r in native.collect()} == {1: (11, 1.0), 2: (0, 0.0)}
    assert {r.job_id for r in native.where(layouts.visual_only(native)).collect()} == {2}
    found = {(r.name, r.type): (r.embedded, r.subset, r.pages, [tuple(c) for c in r.counts]) for r in fonts.inspected(pdf.font_references(pages), pdf.font_spans(pages)).collect()}
    assert found == {("Face", "Type1"): (False, True, [1], [(1, 10)]), ("Other", "Unknown"): (False, False, [1], [(1, 1)])}


def test_recognition_where_text_is_sparse(spark):
    keys = "job_id long, page_index int, content binary"
    images = spark.createDataFrame([(1, 0, b"a"), (2, 0, b"b")], keys)

    def provider(content):
        box = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 0.5}
        return [{"kind": "line", "text": "eighteen characters", "bbox": box, "confidence": None}] + ([{"kind": "paragraph", "text": "words of a paragraph here", "bbox": box, "confidence": 0.4}] if content == b"b" else [])

    items = pdf.recognise(images, provider)
    lines, paragraphs = layouts.recognised(items.where("kind = 'line'"), items.where("kind = 'paragraph'"))
    got = {r.job_id: (r.text, r.n_lines, r.confidence) for r in paragraphs.collect()}
    assert got == {1: ("eighteen characters", 1, 0.85), 2: ("words of a paragraph here", 1, 0.4)} and lines.count() == 2
    pages = images.select("job_id", "page_index")
    none = paragraphs.limit(0)
    chosen = layouts.chosen(layouts.measures(pages, none, False), layouts.measures(pages, paragraphs, True)).collect()
    assert {(r.job_id, r.extracted_with_ocr) for r in chosen} == {(1, True), (2, True)} and pdf.recognise(images, None).count() == 0


def test_alignment_turns_scales_and_centres():
    shape = ((30, 20, 90, 40), (30, 60, 50, 90))
    ref = painted(120, 160, *shape)
    cand = np.rot90(painted(120, 160, *shape))
    best = raster.aligned(ref, cand)
    assert best["angle"] == 90 and best["similarity"] > 0.99 and best["target"] == (120, 160)
    big = raster.aligned(raster._bytes(raster.resized(ref, 320, 240, "cubic")), ref)
    assert big["angle"] == 0 and big["scaled"] == (160, 120) and big["similarity"] > 0.95
    canvas, offset, size = raster.fitted(painted(50, 50, (20, 20, 30, 30)), 200, 100, (150, 50))
    assert size == (100, 100) and offset == (100, 0) and canvas[:, :100].min() == 255
    assert raster.page_similarity(painted(40, 40), painted(40, 40)) == -1.0


def test_resampling_keeps_flat_images_and_means():
    flat = np.full((9, 13, 3), 77.0)
    noise = np.random.default_rng(1).integers(0, 256, (12, 12)).astype(float)
    for how in ("area", "cubic", "lanczos"):
        for size in ((5, 4), (30, 21), (13, 9)):
            assert np.allclose(raster.resized(flat, *size, how), 77)
    assert np.allclose(raster.resized(noise, 6, 6), noise.reshape(6, 2, 6, 2).mean((1, 3)))
    assert np.allclose(raster.resized(noise, 12, 12, "lanczos"), noise) and np.allclose(raster.resized(noise, 12, 12, "cubic"), noise)


def test_panel_crops_and_frame():
    a, b = painted(240, 320), painted(120, 160, (0, 0, 160, 120), colour=(9, 9, 9))
    panel = raster.side_by_side(a, b)
    assert panel.shape == (24 * 2 + 72 + 240 + 8, 28 * 2 + 320 + 320 + 28, 3) and (panel[0, 0] == 244).all() and (panel == 40).any()
    assert (panel[28 + 72 + 5, 28 + 320 + 28 + 5] == 9).all() and raster.downscaled(a, 160).shape == (120, 160, 3) and raster.downscaled(a, 0) is a
    canvas, offset, size = raster.on_canvas(b, 200, 300)
    assert offset == (0, 75) and size == (200, 150) and canvas.shape == (300, 200, 3)
    (crop,) = raster.evidence_crops(a, canvas, [((0.5, 0.5, 0.51, 0.51), (0.0, 0.0, 1.0, 1.0))] , offset, size)
    # From 0.465 to 0.545 of either side, as the box is less than 0.08 wide.
    assert crop[0].shape[:2] == (131 - 112, 174 - 149)
    assert crop[1].shape[:2] == (162, 200)
    framed = raster.bordered(painted(100, 100))
    assert (framed[3:9, 50] == (220, 40, 40)).all() and (framed[50, 50] == 255).all() and (framed[0, 0] == 255).all()
    out, angle, score = raster.composed(painted(270, 480), None, (960, 540))
    assert out.shape == (540, 960, 3) and angle == 0 and score == 0
    out, _, _ = raster.composed(painted(270, 480, (50, 50, 100, 100)), painted(54, 96, (10, 10, 20, 20)))
    assert out.shape == (270, 480, 3)


def test_pages_are_compared_in_one_pass(spark):
    both = ((10, 10, 390, 40), (300, 200, 340, 240))
    ref, cand = painted(300, 400, (60, 100, 180, 170), *both), painted(300, 400, *both)
    pairs = spark.createDataFrame([(1, 0, 300, 400, ref.tobytes(), 300, 400, cand.tobytes())], "job_id long, page_index int, ref_height int, ref_width int, ref binary, cand_height int, cand_width int, cand binary")
    found = raster.compared(pairs, masks=True).cache()
    row = found.first()
    assert row.angle == 0 and (row.target_w, row.target_h, row.scaled_w, row.scaled_h) == (400, 300, 400, 300)
    assert png.decode(bytes(row.missing_mask)).shape == (300, 400, 3)
    regions = raster.page_regions(found).where("kind = 'missing'").collect()
    assert regions and all(r.area_ratio > 0.0008 for r in regions)


def test_deck_with_reference_slides(spark):
    shape = {"left": 1, "top": 2, "width": 3, "height": 4, "kind": "text", "texts": ["one", "two & <three>"]}
    table = {**shape, "kind": "table", "texts": ["a", "", "b"]}
    decks = spark.createDataFrame([("d", 0, [shape]), ("d", 1, [table])], "path string, page_index int, shapes array<struct<left: long, top: long, width: long, height: long, kind: string, texts: array<string>>>")
    made = ooxml.written(decks).cache()
    assert [(r.slide_index, r.kind, r.text) for r in ooxml.slide_text(made).orderBy("slide_index", "ord").collect()] == [(0, "paragraph", "one"), (0, "paragraph", "two & <three>"), (1, "table_cell", "a"), (1, "table_cell", "b")]
    images = spark.createDataFrame([("d", 0, 1, 'q"1.png', b"A"), ("d", 1, 0, "p0.JPG", b"B"), ("d", 2, None, "x.png", b"C")], "path string, ord int, after int, name string, data binary")
    out = bytes(ooxml.with_reference_slides(made, images).first().content)
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert ooxml.slide_order(z) == [f"ppt/slides/slide{n}.xml" for n in (1, 3, 2, 4, 5)]
        assert [z.read(f"ppt/media/{n}") for n in ("image1.jpg", "image2.png", "image3.png")] == [b"B", b"A", b"C"]
        types = z.read("[Content_Types].xml").decode()
        assert types.count("/ppt/slides/slide") == 3 and 'Extension="jpg"' in types and 'Extension="png"' in types
        rels = z.read("ppt/slides/_rels/slide4.xml.rels").decode()
        assert "../slideLayouts/slideLayout2.xml" in rels and "../media/image2.png" in rels
        assert sorted(s.get("id") for s in ooxml.ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{ooxml.P}sldId")) == ["256", "257", "258", "259", "260"]
    assert ooxml.metrics_of(out)[0] == 5 and ooxml.reference_slide_parts(out, []) == {}
    with pytest.raises(ValueError):
        ooxml.reference_slide_parts(out, [(0, "a.gif", b"")])


def test_broken_media_is_copied_as_it_is():
    source = io.BytesIO()
    with zipfile.ZipFile(source, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "<a/>")
        z.writestr("ppt/media/image1.png", b"picture" * 50)
    data = bytearray(source.getvalue())
    at = data.rindex(b"PK\x01\x02")
    data[at + 16] ^= 1  # the check sum that the directory has of the picture
    with pytest.raises(zipfile.BadZipFile), zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        z.read("ppt/media/image1.png")
    with zipfile.ZipFile(io.BytesIO(ooxml.rewritten(bytes(data), {"a.xml": b"<b/>"}))) as z:
        assert z.read("a.xml") == b"<b/>" and z.read("ppt/media/image1.png") == b"picture" * 50
    assert ooxml.renamed(b"no package") == b"no package"
    assert ooxml.metrics_of(package()) == (1, 9144000, 6858000)


def test_sinks_replace_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/x/a.bin", b"1"), (f"file://{tmp_path}/x/b.bin", b"2")], "target string, content binary")
    files.write_files(rows)
    files.write_files(rows.withColumn("content", F.lit("new").cast("binary")))
    files.copy_files(spark.createDataFrame([(f"{tmp_path}/x/a.bin", f"{tmp_path}/y/c.bin")], "source string, target string"))
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()) == ["x/a.bin", "x/b.bin", "y/c.bin"]
    assert (tmp_path / "y/c.bin").read_bytes() == (tmp_path / "x/b.bin").read_bytes() == b"new"


def test_uploads_and_manifest_files(spark, tmp_path):
    (tmp_path / "up").mkdir()
    for n in ("A.PDF", "b.pptx", "c.doc"):
        (tmp_path / "up" / n).write_bytes(b"x")
    assert sorted(r.kind for r in files.uploads(spark, str(tmp_path / "up")).collect()) == ["pdf", "pptx", "unsupported"]
    actions = spark.createDataFrame([("INSERT", 1, "b.png", 1), ("INSERT", 0, "a.png", 2), ("APPEND", None, "c.png", 3)], "action string, page_index int, image string, ord int")
    files.write_manifest(actions, str(tmp_path / "m"))
    assert [tuple(r) for r in files.manifest(spark, str(tmp_path / "m")).collect()] == [("INSERT", 1, "b.png"), ("INSERT", 0, "a.png"), ("APPEND", None, "c.png")]


class Fake:
    def __init__(self, name, works=True, there=True):
        self.name, self.works, self.there = name, works, there

    def available(self):
        return self.there

    def to_pdf(self, deck):
        if not self.works:
            raise OSError(self.name)
        return f"{deck} by {self.name}"


def test_converters():
    both = ["powerpoint", "libreoffice"]
    assert conversion.in_order(both) == ["libreoffice", "powerpoint"] and conversion.in_order(both, office_first=False) == ["libreoffice"]
    assert conversion.in_order(both, " PowerPoint ") == ["powerpoint", "libreoffice"] and conversion.in_order(both, "powerpoint", False) == ["powerpoint"]
    assert conversion.in_order(["powerpoint"], office_first=False) == ["powerpoint"] and conversion.in_order([], "libreoffice") == []
    call = lambda c: c.to_pdf("deck")
    assert conversion.first_that_works([Fake("a", there=False), Fake("b", works=False), Fake("c")], call) == ("c", "deck by c")
    for none in ([], [Fake("a", there=False)], [Fake("b", works=False)]):
        with pytest.raises(RuntimeError):
            conversion.first_that_works(none, call)


def test_ratios_with_bounds_equal_plain_ones():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["x" * 250 + "abc", "x" * 250 + "abd"]
    ratios = fuzzy.Ratios(texts)
    for wanted in texts[::5]:
        plain = [SequenceMatcher(None, wanted, t).ratio() for t in texts]
        for least in (-1.0, 0.3, 0.72):
            for k, p in enumerate(plain):
                got = ratios.above(wanted, k, least)
                assert got == p if p > least else got <= least
    item = lambda t, y: type("Item", (), {"text": t, "x0": 0.0, "y0": y, "x1": 1.0, "y1": y + 0.1})()
    left, right = [item(t, i / 80) for i, t in enumerate(texts[:25])], [item(t, i / 70) for i, t in enumerate(texts[20:50])]
    strict = fuzzy.normalise_strict
    free, want = list(range(len(right))), []
    for i, a in enumerate(left):
        best = None
        for j in free if strict(a.text) else ():
            if strict(right[j].text):
                t, p = SequenceMatcher(None, strict(a.text), strict(right[j].text)).ratio(), fuzzy.position_score(fuzzy._box(a), fuzzy._box(right[j]))
                total = t * 0.55 + p * 0.45 + 0.04 * (fuzzy._cell(fuzzy._box(a)) == fuzzy._cell(fuzzy._box(right[j])))
                if best is None or total > best[0]:
                    best = (total, j, t, p)
        if best:
            free.remove(best[1])
            want.append((i, *best[1:]))
    assert fuzzy.block_matches(left, right) == want
    for a in left:
        pairs = [(SequenceMatcher(None, strict(a.text), strict(o.text)).ratio(), fuzzy.position_score(fuzzy._box(a), fuzzy._box(o))) for o in right if strict(o.text)]
        assert fuzzy.nearest(a, right) == max([(0.0, 0.0), *(pairs if strict(a.text) else [])])


def test_discrepancies_stop_at_the_limit(spark):
    schema = "job_id long, page_index int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
    left = spark.createDataFrame([(1, 0, i, f"reference {'abcdefghijklmnop'[i]}{i}", 0.0, i / 40, 0.2, i / 40 + 0.01) for i in range(16)], schema)
    right = spark.createDataFrame([(1, 0, i, f"reference {'abcdefghijklmnop'[i]}{i + 1}", 0.0, i / 40, 0.2, i / 40 + 0.01) for i in range(16)] + [(1, 0, 99, "zzzz qqqq", 0.9, 0.95, 1.0, 1.0)], schema)
    got = fuzzy.text_discrepancies(left, right).orderBy("ord").collect()
    assert len(got) == 12 and {r.label for r in got} == {"numeric-token mismatch"}
    (only,) = [r for r in fuzzy.text_discrepancies(left.limit(1), right).collect() if r.label.startswith("candidate-only")][-1:]
    assert only.candidate_text == "zzzz qqqq"


@pytest.mark.parametrize("text", ["Straße ŉ ΐ", "ΣΑΣ ς", "ſchön İ", "ﬁ ＡＢ Ⅷ", "Ꭰ ꭰ", "plain ASCII"])
def test_folding_equals_python(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(casefolded(F.col("t")).alias("c"), normalised(F.col("t")).alias("n")).first()
    assert row.n == normalise_text(text) and row.c == text.casefold()


def test_rule_review_of_pages(spark):
    """The cases of a page review: line breaks, drift, low alignment, low recognition, pictures only."""
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    para = f"slide long, ord long, text string, bbox {box}, n_lines int"
    same = (0.1, 0.1, 0.5, 0.2)
    ref = spark.createDataFrame([(1, 0, "A title of words", same, 1), (2, 0, "Same text here", same, 1), (3, 0, "Gone from the slide", same, 1), (4, 0, "Fine", same, 1)], para)
    cand = spark.createDataFrame([(1, 0, "a  Title of words", same, 2), (2, 0, "Same text here", (0.16, 0.1, 0.56, 0.2), 1), (4, 0, "Fine", same, 1)], para)
    page = "slide long, angle int, target_w int, target_h int, off_x int, off_y int, scaled_w int, scaled_h int, similarity double, total_characters long, ocr boolean, ocr_confidence double"
    pages = spark.createDataFrame([(i, 0, 100, 100, 0, 0, 100, 100, s, c, o, f) for i, s, c, o, f in ((1, 0.9, 9, False, 1.0), (2, 0.9, 9, False, 1.0), (3, 0.9, 9, False, 1.0), (4, 0.12, 9, False, 1.0), (5, 0.9, 0, False, 1.0), (6, 0.9, 9, True, 0.5))], page)
    regions = spark.createDataFrame([(1, "geometry", 0, same, 0.01), (3, "missing", 0, (0.6, 0.6, 0.9, 0.9), 0.01), (3, "missing", 1, same, 0.5), (3, "color", 2, (0.6, 0.6, 0.8, 0.8), 0.01)], f"slide long, kind string, ord long, bbox {box}, area_ratio double")
    blank = lambda d: d.withColumn("blank", rule_qc.blank(F.col("text")))
    found = rule_qc.findings(rule_qc.matches_of(ref, cand), blank(ref), blank(cand), regions, pages).cache()
    got = sorted((r.slide, r.finding_id, r.type, round(r.confidence, 4)) for r in found.collect())
    assert got == [(1, 1, "line_break_issue", 0.86), (2, 1, "size_position_issue", 0.94), (3, 1, "missing_content", 0.88), (3, 2, "missing_content", 0.9)]
    states = {r.slide: (r.status, r.note) for r in rule_qc.results(pages, found).collect()}
    assert states == {1: ("findings", None), 2: ("findings", None), 3: ("findings", None), 4: ("manual_review", rule_qc.LOW_ALIGNMENT), 5: ("ok", rule_qc.VISUAL_ONLY), 6: ("manual_review", rule_qc.LOW_OCR)}


def test_statuses_of_models(spark):
    slides = spark.createDataFrame([(1, True), (2, False), (3, True)], "slide long, manual boolean")
    kept = spark.createDataFrame([(3,)], "slide long")
    assert {r.slide: r.status for r in model_qc.slide_statuses(slides, kept).collect()} == {1: "manual_review", 2: "ok", 3: "findings"}
    assert {c for c in report.counts_by_type(spark.createDataFrame([("a",), ("a",)], "type string")).columns} == {"type", "n"}
