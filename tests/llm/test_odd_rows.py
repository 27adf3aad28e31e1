"""Nulls, empty and long texts, ties, repeated rows, no rows and clashing names: what each gives."""

import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioqc.llm import bpe_tree, exact_dedup, html_main, jaccard, language, line_quality, mixing, pii, sstable, toxicity

RANKS, BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
CLASH = ("size key recipe component kept range row doc host lines ids shas n_words clean_text heavy text_key line salt fine s before budget end_range "
         "keep_id group_size gone_doc_id gone_sha sha again digest bytes turn n_shingles items sig __host __id __times __row __sha __copy label batch")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH.split()) + ", `a.b` string"
LONG = "word " * 30000
PROSE = " ".join(f"w{i}" for i in range(80))
NEAR = PROSE.replace("w3 ", "x3 ")
TEXTS = [None, "", " \n\t", LONG, PROSE, PROSE, NEAR, PROSE.replace(" ", "\n "), "a@b.example.com +1 (743) 555-3824", "one two", "ONE two", "é" * 3]


def rows():
    extra = ["k"] * (len(CLASH.split()) + 1)
    made = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, 1, *extra) for i, t in enumerate(TEXTS)]
    return [*made, made[4], (None, PROSE, None, None, 0, *extra), *((None, f"{PROSE} {w} {w} tail{w}", None, None, 0, *extra) for w in "xyz")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return found


def test_personal_data(odd, none):
    got = by_id(pii.find(odd), "n_email", "n_phone", "spans", "base_sha256")
    empty = (0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[8] == [(1, 1, "email:0:15,phone:16:33", hashlib.sha256(b"email:0:15,phone:16:33").hexdigest())]
    assert all(set(got[i]) == {empty} for i in got if i != 8) and len(got[4]) == 2 and len(got[None]) == 4
    assert pii.find(none).count() == 0


def test_exact_dedup(odd, none):
    got = by_id(exact_dedup.equal_texts(odd), "keep_id", "group_size", "kept")
    assert got[0] == [(0, 2, True)] and got[1] == [(0, 2, False)] and got[2] == [(2, 1, True)]
    assert sorted(got[4]) == [(4, 5, False), (4, 5, True)] and got[5] == [(4, 5, False)] == got[7]
    assert Counter(got[None]) == {(4, 5, False): 1, (None, 1, True): 3} and got[10] == [(10, 1, True)]
    stay = exact_dedup.drop_copies(odd)
    assert stay.columns == odd.columns and Counter(r.doc_id for r in stay.collect()) == {0: 1, 2: 1, 3: 1, 4: 1, 6: 1, 8: 1, 9: 1, 10: 1, 11: 1, None: 3}
    assert exact_dedup.equal_texts(none).count() == exact_dedup.drop_copies(none).count() == 0


def test_shards(odd, none):
    t = Tokenizer.from_file(BPE)
    got = by_id(sstable.token_shards(odd, BPE, 2), "start", "n_tokens", "ids_crc32", "found")
    assert set(got) == {*range(12), None} and len(got[4]) == 2 and len(got[None]) == 4
    flat = sorted(x for v in got.values() for x in v)
    assert all(a[0] + a[1] == b[0] for a, b in zip(flat, flat[1:])) and all(x[3] for x in flat)
    assert min(x[0] for x in got[None]) == sum(x[1] for i, v in got.items() if i is not None for x in v)
    for i in range(12):
        ids = [*t.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert {(x[1], x[2]) for x in got[i]} == {(len(ids), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in ids)))}
    assert sstable.token_shards(none, BPE, 2).count() == 0


def test_mix(odd, none):
    got = by_id(mixing.mix(odd), "size", "source", "source_size", "target", "taken")
    assert got[0][0][0] == got[1][0][0] == got[2][0][0] == 0 == got[0][0][4] and got[3][0][0] == 30000 and len(got[4]) == 2 and len(got[None]) == 4
    flat = [x for v in got.values() for x in v]
    assert all(x[4] in (0, x[0], 2 * x[0]) for x in flat)
    for s in {x[1] for x in flat}:
        own = [x for x in flat if x[1] == s]
        assert sum(x[0] for x in own) == own[0][2] and abs(sum(x[4] for x in own) - own[0][3]) <= max(x[0] for x in own) / 2 + 1e-6
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("ranges,finer", ((1, 1), (1, 4096), (1024, 1), (64, 8)))
def test_mix_does_not_depend_on_its_ranges(odd, ranges, finer):
    pick = lambda df: sorted(map(str, df.select("doc_id", "source", "size", "taken").collect()))
    assert pick(mixing.mix(odd, ranges=ranges, finer=finer)) == pick(mixing.mix(odd))


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1, "x"), (4, 1, 1, "x"), (None, 0, 1, "x"), (9, None, None, None)], "doc_id long, quality int, toxic int, text string")
    got = by_id(toxicity.classify(odd, labels), "held_out", "score", "predicted")
    assert len(got[4]) == 2 and len(got[None]) == 4 and all(p == 0 and s < 0.3 for v in got.values() for _, s, p in v)
    assert {i for i, v in got.items() if v[0][0]} == {i for i in range(12) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert toxicity.classify(none, labels).count() == 0 == toxicity.classify(none, labels.limit(0)).count()


def test_language(odd, none):
    got = by_id(language.identify(odd), "lang_pred", "score")
    assert all(got[i] == [("und", 0.0)] for i in (0, 1, 2)) and all(v[0][0] == "en" for i, v in got.items() if i not in (0, 1, 2)) and len(got[None]) == 4
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_byte_pairs(odd, none):
    got = by_id(bpe_tree.encode_documents(odd, RANKS, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256", "n_joins")
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[0] == got[1] == [(0, nothing, nothing, 0)] and got[3][0][2] == hashlib.sha256(LONG.encode()).hexdigest() and got[3][0][3] > 1000
    assert len(got[4]) == 2 and len(got[None]) == 4 and bpe_tree.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_jaccard(odd, none):
    got = by_id(jaccard.similar_components(odd), "n_shingles", "component_id")
    assert all(got[i] == [(0, i)] for i in (0, 1, 2)) and got[3] == [(1, 3)] and got[9] == got[9] == [(1, 9)] and got[10] == [(1, 9)]
    assert got[4] == [(76, 4)] * 2 and got[5] == got[7] == [(76, 4)] and got[6] == [(76, 4)] and all(c is None for _, c in got[None])
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 8: 1, 9: 1, 11: 1, None: 4}
    assert jaccard.similar_components(none).count() == jaccard.one_of_each(none).count() == 0


def test_quality(odd, none):
    got = by_id(line_quality.verdicts(odd), "n_words", "word_chars", "n_repeat_words", "base_failed", "kept")
    assert got[0] == got[1] == got[2] == [(0, 0, 0, True, False)] and got[3] == [(30000, 120000, 30000, True, False)]
    assert got[4] == [(80, 230, 0, False, True)] * 2 and got[7] == [(80, 230, 0, False, True)] and len(got[None]) == 4
    assert line_quality.verdicts(none).count() == 0


def test_pages(odd, none):
    page = lambda d: d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "size", "row", F.lit("x").alias("text"))
    got = {}
    for r in html_main.extract(page(odd)).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert got[0] == got[1] == got[2] == [("", 0)] and len(got[4]) == 2 and got[4][0] == got[4][1] and len(got[None]) == 4
    assert all(n == len(t) for v in got.values() for t, n in v) and html_main.extract(page(none)).count() == 0


def test_pipeline_stages(spark, odd, none):
    """Every stage on odd rows: which rows come out, how often, and that no column is lost."""
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    run = {name: stage for name, stage in corpus_pipeline.STAGES}
    quality = run["quality rules"](spark, odd, "")
    assert quality.columns == odd.columns and ids(quality) == {4: 2, 5: 1, 6: 1, 7: 1, None: 4}
    assert all(r.n_chars == len(r.text) and r["a.b"] == "k" for r in quality.collect())
    assert ids(run["exact dedup"](spark, odd, "")) == {0: 1, 2: 1, 3: 1, 4: 1, 6: 1, 8: 1, 9: 1, 10: 1, 11: 1, None: 3}
    assert ids(run["n-gram jaccard join"](spark, odd, "")) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 8: 1, 9: 1, 11: 1, None: 4}
    mixed = run["mix sources"](spark, odd, "")
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.taken // r.size if r.size else 0
    assert mixed.columns == odd.columns and ids(mixed) == +want
    assert run["byte-level bpe"](spark, odd, "").count() == odd.count()
    assert all(stage(spark, none, "").count() == 0 for stage in run.values())


def test_mix_of_rows_without_identifiers(spark):
    """Each row counts for itself: none is multiplied by others of its doc_id."""
    made = [(None, f"text number {w} of three", "a") for w in ("one", "two", "six")] + [(7, "the same words", "b"), (7, "other words here", "b"), (7, "the same words", "b")]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(docs, keep_rows=True).collect():
        taken[r.row.text] += r.taken // r.size
    got = Counter(r.text for r in corpus_pipeline.mix(spark, docs, "").collect())
    assert got == +taken and sum(got.values()) <= 12
    for s, rows in (("a", made[:3]), ("b", made[3:])):
        target = {r.source: r.target for r in mixing.mix(docs).collect()}[s]
        words = sum(n * len(t.split()) for t, n in got.items() if t in {r[1] for r in rows})
        assert abs(words - target) <= 2.5


def test_scratch_tables_go(spark, odd):
    """What an operator cuts on its way is deleted; what its result is read from stays."""
    from pathlib import Path

    from folioqc.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:")) / "folioqc"
    names = lambda: {p.name.rsplit("-", 1)[0] for p in folder.iterdir()} if folder.exists() else set()
    before = set(folder.iterdir()) if folder.exists() else set()
    kept = jaccard.one_of_each(odd)
    new = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert new == {"near-copies"} and "near-copies" in names() and kept.count() == 13
    before = set(folder.iterdir())
    assert exact_dedup.drop_copies(odd).count() == 12 and {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"dropped"}
