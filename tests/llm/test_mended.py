"""Results that an earlier version got wrong, each held by a small case."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from folioqc.llm import common, html_main, jaccard, language, line_quality, pii


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_pipeline_keeps_one_of_every_popular_text(spark):
    """Equal and nearly equal texts of one host, more of them than the limit of a line."""
    lines = [prose(k, 20) for k in range(6)]
    same = [(i, "\n".join(lines), "h") for i in range(25)]
    near = [(100 + i, "\n".join([*(prose(50 + k, 20) for k in range(6)), f"the {i} tail"]), "h") for i in range(30)]
    foot = [(200 + i, f"{prose(300 + i, 80)}\nsubscribe to all our letters now", "h") for i in range(30)]
    docs = spark.createDataFrame([*same, *near, *foot], "doc_id long, text string, source string")
    kept = corpus_pipeline.quality(spark, docs, "")
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert {0, 100} <= set(texts) and texts[0] == "\n".join(lines) and all(200 + i in texts for i in range(30))
    assert sum("subscribe" in t for t in texts.values()) == 1
    left = corpus_pipeline.near_dedup(spark, corpus_pipeline.dedup(spark, kept, ""), "").collect()
    assert sum(r.doc_id < 100 for r in left) == 1 and sum(100 <= r.doc_id < 200 for r in left) == 1 and sum(r.doc_id >= 200 for r in left) == 30
    # As a rule over documents without copies it is what it was.
    assert not any(r.kept for r in line_quality.verdicts(docs.where("doc_id < 100")).collect())


def test_numerals_are_no_letters(spark):
    docs = [(1, "½ ² ①", None), (2, "Ⅷ 五", None), (3, "123 _ !", None), *((10 + i, "the cat is on the mat", "en") for i in range(20)), *((40 + i, "der Hund und die Katze", "de") for i in range(20))]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got[1] == got[3] == "und" and got[2] != "und"


def test_pages_without_markup_are_their_text():
    net = html_main.train([], steps=30)
    assert html_main.main_texts(net, ["Just plain text without any markup in it.", "a &amp; b\n c", "", None, "<nav>Menu</nav>"])[:4] == ["Just plain text without any markup in it.", "a & b c", "", ""]


def test_short_numbers_that_repeat_a_span_are_found():
    rng_texts = [f"Server 10.{i}.3.4 said hello. Later 10-{i}-3-4 again. Order {1000 + i} of 12-{i}-7." for i in range(60)]
    field = pii.train(rng_texts)
    (base, spans), (_, none), (_, other) = pii.label(field, ["host 8.8.8.8 is up, host 8-8-8-8 too", "host 8-8-8-8 only", "host 8.8.8.8 and 9-9-9-9"])
    assert len(base) == 1 and (25, 32, 1) in spans and not none and len(other) == 1


@pytest.mark.parametrize("seed", range(4))
def test_chunks_meet_as_by_all_pairs(seed):
    """Sets of many sizes that share passages: the first few shingles find every link."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(-(2**62), 2**62, 4000)
    sets = []
    for k in range(120):
        own = rng.choice(pool, int(rng.integers(1, 60)), replace=False)
        if k % 3:
            other = sets[int(rng.integers(0, len(sets)))] if sets else own
            own = np.concatenate([other[: max(1, int(len(other) * rng.uniform(0.7, 1)))], own[: int(rng.integers(0, 6))]])
        sets.append(np.unique(own))
    asks = rng.random(len(sets)) < 0.5
    component = rng.integers(0, 90, len(sets))
    rows = pa.table({"doc_id": pa.array(range(len(sets)), pa.int64()), "asks": pa.array(asks), "component": pa.array(component, pa.int64()), "items": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    got = jaccard._meet_all(rows).to_pylist()
    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
    want = {(a, int(component[b])) for a in range(len(sets)) if asks[a] for b in range(len(sets)) if not asks[b] and component[a] != component[b] and linked(sets[a], sets[b])}
    assert {(r["a"], int(component[r["b"]])) for r in got} == want and len(got) == len(want)
    assert all(linked(sets[r["a"]], sets[r["b"]]) for r in got)


def test_long_lists_meet_behind_a_bitmap(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("id % 5000 as k", "cast(id as string) as v")
    listed = spark.range(300).selectExpr("id * 7 as k", "id as w")
    want = {how: sorted(map(str, rows.join(listed, "k", how).select("k", "v", *(["w"] if how != "left_anti" else [])).collect())) for how in ("left", "inner", "left_anti")}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    for bits in (1 << 29, 0):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        assert sorted(map(str, common.meet(rows, listed, ["k"], "left").select("k", "v", "w").collect())) == want["left"]
        assert sorted(map(str, common.meet(rows, listed, ["k"]).select("k", "v", "w").collect())) == want["inner"]
        assert sorted(map(str, common.but_for(rows, listed, ["k"]).select("k", "v").collect())) == want["left_anti"]
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 29)
    split = common.may_match(rows, listed, ["k"], 300).groupBy("may").count().collect()
    assert {r.may: r["count"] for r in split}[False] > 15_000


def test_sample_by_turns_is_the_same_in_shares(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i}", "ab"[i % 10 == 0]) for i in range(3000)], "doc_id long, text string, lang string")
    want = [r.doc_id for r in common.sample_rows(rows, "text", 50, 1 << 20, "s", "lang")]
    monkeypatch.setattr(common, "SHARES", 1)
    assert [r.doc_id for r in common.sample_rows(rows, "text", 50, 1 << 20, "s", "lang")] == want and len(want) == 50
