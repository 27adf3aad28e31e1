"""Corpus operators against brute force, round trips, SQL and held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioqc.llm import bpe_tree, catalog, common, exact_dedup, html_main, jaccard, language, line_quality, mixing, pii, sstable, toxicity

FOLDER = "/root/testdata/sf0.001"
RANKS, BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def plain():
    return duckdb.sql(f"select doc_id, text, lang, source from '{FOLDER}/documents.parquet' order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    show = lambda df: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert show(catalog.QUERIES[name](spark, FOLDER).toPandas()) == show(con.sql(catalog.ORACLES[name]).df())


def test_clashing_digests_are_told_apart(spark, docs, monkeypatch):
    """With a digest that always clashes, only contents can tell chunks apart."""
    want = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.equal_texts(docs).collect()}
    monkeypatch.setattr(exact_dedup, "digest", lambda chunk: F.length(chunk).cast("bigint") % 2)
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.equal_texts(docs).collect()} == want


def test_groups_too_many_to_broadcast(spark, monkeypatch):
    made = [(i, f"text {i % 7}" if i < 300 else f"other {i}") for i in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = sorted(map(tuple, exact_dedup.equal_texts(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "LARGE_GROUP", 40)
    assert sorted(map(tuple, exact_dedup.equal_texts(docs).collect())) == want and len({w[1] for w in want}) == 107


def test_chunks_are_cut_by_content_in_any_script(spark):
    rng = random.Random(2)
    for letters in ("abcdefghij klmnop", "日本語文字列機械学習中国漢", "абвгдежзик лмноп"):
        text = "".join(rng.choice(letters) for _ in range(9000))
        cut_at = [spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).first().c for t in (text, "xyz" + text)]
        assert all("".join(c).encode("latin-1").decode() in ("xyz" + text, text) for c in cut_at)
        assert len(cut_at[0]) > 8 and len(set(cut_at[0]) & set(cut_at[1])) >= len(cut_at[0]) - 3


def brute_components(listed):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t in listed:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * 100 >= (len(sets[a]) + len(sets[b]) - both) * 75:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_equals_brute_force(docs, plain):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect()}
    assert got == brute_components([(r[0], r[1]) for r in plain])


def test_jaccard_of_short_and_edited_texts(spark):
    rng = random.Random(4)
    base = [f"t{i}" for i in range(60)]
    made = []
    for i in range(160):
        n = rng.choice([1, 3, 5, 6, 7, 9, 12, 60])
        w = base[:n] + [f"u{rng.randrange(3)}"] * rng.randrange(2)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(4)}"
        made.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == brute_components(made)


def test_tree_encoding_equals_library():
    tree = bpe_tree.TreeCodec(RANKS, public_tokenizers.PATTERN, leaf_chars=8)
    with pytest.raises(ValueError):
        bpe_tree.TreeCodec(RANKS, r"\s+|\S+")

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="ab '\n\t1.é日s ", max_size=200))
    def check(text):
        ids = tree.encode(text)
        assert ids == tree._encode(text) and tree.decode(ids) == text.encode()

    check()


def test_bpe_query_equals_tiktoken(spark, plain):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in catalog.op7_bpe_tree(spark, FOLDER).collect()}
    for i, t, *_ in plain:
        ids = np.asarray(enc.encode_ordinary(t or ""), "<u4")
        assert got[i].n_joins > 0 or len(t or "") <= bpe_tree.LEAF_CHARS
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_shards_round_trip_and_lookup(spark, plain, tmp_path):
    t = Tokenizer.from_file(BPE)
    want, start = {}, 0
    for i, text, *_ in plain:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = catalog.op3_token_shards(spark, FOLDER).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want and all(r.found for r in rows)
    with open(tmp_path / "a.sst", "wb") as f:
        w = sstable.ShardWriter(f)
        for i in range(0, 3000, 3):
            w.add(sstable.make_key(i - 900), np.arange(i % 70, dtype=np.uint32) * 1000)
        w.add(sstable.make_key(None), np.asarray([70000], np.uint32))
        w.finish()
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.sst")) as f:
        r = sstable.ShardReader(f)
        assert len(r.index) > 1 and r.get(-900).tolist() == [] and r.get(0).tolist() == (np.arange(900 % 70) * 1000).tolist()
        assert r.get(None).tolist() == [70000] and r.get(1) is None and sum(r.may_hold(k) for k in range(-899, 2000, 3)) < 60


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    kind = json.load(open(BPE, encoding="utf-8"))
    kind["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    (tmp_path / "t.json").write_text(json.dumps(kind), encoding="utf-8")
    e = sstable.WordEncoder(str(tmp_path / "t.json"))
    assert not e.in_pieces and sstable.WordEncoder(BPE).in_pieces
    texts = ["some words, and\nmore words", "a b"]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == [e.whole(t).tolist() for t in texts]


def test_word_encoder_equals_library():
    e = sstable.WordEncoder(BPE, memo_words=10)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="ab  \n\t's1é.,<|\0", max_size=60), max_size=4))
    def check(texts):
        assert [x.tolist() for x in e.encode(pa.array(texts, pa.string()))] == [e.whole(x).tolist() for x in texts]

    check()


def test_mix_meets_targets(docs):
    got = mixing.mix(docs).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max() / 2 + 1e-6
    assert (got["taken"] <= 2 * got["size"]).all() and abs(got.groupby("source")["target"].first().sum() - 1.5 * got["size"].sum()) < 1e-3
    again = mixing.mix(docs).toPandas().sort_values("doc_id")["taken"].tolist()
    assert again == got.sort_values("doc_id")["taken"].tolist()


def test_targets_equal_repeated_sharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, "d": 3, "e": 77, None: 50}
    left = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [3.0, 1.0, 2.0] * 2))
    weight, target = dict(left), {}
    rest = 1.5 * sum(sizes.values())
    while left:
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            del left[s]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert weight and all(abs(got[s] - target[s]) < 1e-9 for s in sizes)


def test_base_spans_equal_patterns():
    e, i = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    c, p = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def want(t):
        out = [(m.start(), m.end(), 0) for m in e.finditer(t)]
        out += [(m.start(), m.end(), 1) for m in i.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), m.end(), 2) for m in c.finditer(t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        out += [(m.start(), m.end(), 3) for m in p.finditer(t) if 10 <= len(digits(m[0])) <= 15]
        return sorted(out, key=lambda s: (s[0], s[2]))

    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("ab0123459.@@+-() \n%") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == want(t)


def test_long_texts_take_linear_time():
    for t in ("a" * 300000, "1" * 300000, "1." * 150000, "@" * 100000, "+1" * 100000, "<" * 50000, "x" * 300000 + "@"):
        pii.label(pii.train([]), [t])
    assert html_main.blocks("<" * 20000 + "<p>a") and len(jaccard.shingles("a b " * 100000)) == 2


def test_skip_edges_carry_labels():
    rng, docs = random.Random(8), []
    for _ in range(300):
        d = "".join(rng.choice("0123456789") for _ in range(10))
        parts = [f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", "4111111111111111", f"10.1.{rng.randrange(255)}.3", f"me.{d[:4]}@mail1.example.com"]
        docs.append(" some words ".join(rng.sample(parts * 2, rng.randrange(1, 5))))
    field = pii.train(docs)
    text = "Call +1 (743) 555-3824. " + "word " * 100 + "or 7435553824; 5551239876 is no such number"
    (base, spans), (_, alone) = pii.label(field, [text, "or 7435553824 alone"])
    assert [text[a:b] for a, b, _ in spans] == ["+1 (743) 555-3824", "7435553824"] and len(base) == 1 and not alone
    # One full number and thirty bare ones: the evidence is one step away from each of them.
    text = "Call +1 (743) 555-3824. " + ("word " * 30 + "or 7435553824 ") * 30
    ((base, spans),) = pii.label(field, [text])
    assert len(base) == 1 and len(spans) == 31
    # Without skip potentials the same nodes give nothing: only the skip edges find them.
    ((base, spans),) = pii.label(pii.Field(field.node, field.chain, field.skip * 0), [text])
    assert base == spans and len(base) == 1
    # What else a batch holds does not matter.
    assert pii.label(field, [text, "a", text[:400]])[0] == pii.label(field, [text])[0]


def test_numbers_side_by_side_are_cut_apart():
    phone, card, ip = "+1 (269) 555-3296", "4524132264652876", "70.123.182.155"
    assert pii.luhn(card)
    field = pii.train([f"a {phone} b {card} c {ip} d" for _ in range(200)])
    for first, second, kinds in ((phone, card, (3, 2)), (card, ip, (2, 1)), (ip, card, (1, 2)), (phone, ip, (3, 1))):
        text = f"see {first} {second} here"
        ((base, spans),) = pii.label(field, [text])
        assert set(base) <= set(spans) and [(text[a:b], k) for a, b, k in spans] == list(zip((first, second), kinds)), text
    assert pii.label(field, ["id 4524132264652877 12 token 89e7068c0026514394582020 and 1234567"]) == [([], [])]


def test_classifiers_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in catalog.op5_pu_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    hits = sum(r.predicted and labels[r.doc_id] for r in got)
    assert hits >= 0.6 * sum(labels[r.doc_id] for r in got) and sum(r.predicted and not labels[r.doc_id] for r in got) <= 0.05 * len(got)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = [r for r in catalog.op6_gru_language(spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.93 * len(got)


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b"], hidden=3)
    for o, k in net.parameters():
        setattr(o, k, getattr(o, k).astype(np.float64))
    x, y = rng.integers(1, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = net.learn(x, np.ones((5, 4)), y)
    for (o, k), g in zip(net.parameters(), grads):
        v = getattr(o, k)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = v[at], 1e-2
        v[at] = old + eps
        up = net.learn(x, np.ones((5, 4)), y)[0]
        v[at] = old - eps
        down = net.learn(x, np.ones((5, 4)), y)[0]
        v[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 5e-3 + 0.05 * abs(g[at])


def test_pages_give_their_articles(spark):
    import html as h

    got = {r.page_id: r.text for r in catalog.op10_lstm_html(spark, FOLDER).collect()}
    right = 0
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        right += got[r.page_id] == " ".join(h.unescape(re.sub(r"<[^>]*>", "", inner)).split())
    assert right >= 0.95 * len(got)


def test_pipeline_against_its_stages(spark):
    """Keeps no copies or near copies before the mix, and its tokens are those of the texts."""
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = corpus_pipeline.quality(spark, d, FOLDER)
    second = corpus_pipeline.dedup(spark, first, FOLDER)
    third = corpus_pipeline.near_dedup(spark, second, FOLDER)
    assert first.columns == second.columns == third.columns == d.columns
    a, b, c = ({r.doc_id: r.text for r in x.collect()} for x in (first, second, third))
    groups = {}
    for i in sorted(a):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", a[i]), i)
    assert set(b) == set(groups.values())
    assert set(c) == {i for i, (_, k) in brute_components(list(b.items())).items() if i == k}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(third).collect() if r.taken}
    assert Counter(r.doc_id for r in out) == times and 1 in times.values() and set(times.values()) <= {1, 2}
    assert all(r.decoded_sha256 == hashlib.sha256(c[r.doc_id].encode()).hexdigest() for r in out)


def test_lines_count_documents_and_empty_ones_go(spark):
    """Equal texts of many documents count as many; rows of one document count once; what is left decides."""
    prose = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    same = [(i, prose(0, 60) + "\nshared line of five words", "a") for i in range(30)]
    once = [(100, prose(1, 60) + "\none document alone", "a")] * 30
    long = [(200 + i, prose(i, 60) + "\n" + prose("b", 5000), "b") for i in range(21)]
    few = [(300 + i, prose(i, 60) + "\nShared  LINE", "c") for i in range(20)]
    short = [(400 + i, prose(i, 52) + "\nfour more words here", "d") for i in range(25)]
    none = [(None, prose(i, 60) + "\nwithout a number", "e") for i in range(25)]
    docs = spark.createDataFrame([*same, *once, *long, *few, *short, *none], "doc_id long, text string, source string")
    got = {}
    for r in line_quality.verdicts(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_removed_lines, r.n_words_left, r.kept))
    assert all(got[i] == [(2, 0, False)] for i in range(30)) and set(got[100]) == {(0, 63, True)}
    assert all(got[200 + i] == [(1, 60, False)] for i in range(21)) and all(got[300 + i] == [(0, 62, True)] for i in range(20))
    assert all(got[400 + i] == [(1, 52, True)] for i in range(25))
    assert set(got[None]) == {(1, 60, True)} and len(got[None]) == 25


def test_lists_of_lines_too_long_to_broadcast(spark, monkeypatch):
    made = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + ("\nshared line" if i < 40 else ""), "big") for i in range(60)]
    docs = spark.createDataFrame([*made, made[0]], "doc_id long, text string, source string")
    pick = lambda: sorted((r.doc_id, r.n_removed_lines, r.clean_text, r.kept) for r in line_quality.verdicts(docs).collect())
    want = pick()
    monkeypatch.setattr(line_quality, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert pick() == want and sum(w[1] for w in want) == 41


def test_pages_without_semantic_tags_keep_their_text():
    net = html_main.train([])
    page = '<div class="nav"><a href="/">Home</a> <a href="/x">About</a></div><div class="wrap"><h1>The title here</h1><p>One long paragraph, of many words, that says something of note.</p><p>Another paragraph with words in it, as usual.</p></div><div class="foot">Copyright 2020 Company</div>'
    assert html_main.main_texts(net, [page, "plain text without tags, of some length."]) == [
        "The title here One long paragraph, of many words, that says something of note. Another paragraph with words in it, as usual.", "plain text without tags, of some length."
    ]


def test_semantic_tags_are_not_needed(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    plainer = lambda h: re.sub(r'\s(?:class|id)="[^"]*"', "", re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b", r"<\1div", h))
    net = html_main.train([r.html for r in rows[:125]])
    whole, plain = (html_main.main_texts(net, [f(r.html) for r in rows[125:]]) for f in (str, plainer))
    assert sum(a == b and bool(a) for a, b in zip(whole, plain)) >= 0.95 * len(whole)


def test_long_pages_take_linear_time():
    import time

    pages = ["<b>" * 40000 + "<div>x</div>" * 40000, "<div>x" * 80000, "<a " * 300000, "<a ='" * 150000 + ">", '<a =">" ' * 150000, "<script>" + "</script " * 100000,
             "<i><div>" + "<b>" * 60000 + "</i>x" * 60000, "".join(f"<div class=c{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}>x" for i in range(40000))]
    for page in pages:
        began = time.time()
        html_main.vectors(html_main.blocks(page))
        assert time.time() - began < 12, page[:40]
    assert [b.text for b in html_main.blocks("<p title='a > b'>one</p><p =\"x>two <b>three")] == ["one", "two three"]


def test_head_may_be_left_open_and_formulas_stay():
    texts = lambda page: [b.text for b in html_main.blocks(page)]
    rest = "<article><p>one</p><p>two</p></article>"
    for start in ("<head><title>t</title><body>", "<head><title>t</title>", "<html><head><meta charset=x><script>a<b</script></head><body>", "<head><title>t</title></body>"):
        assert texts(start + rest) == ["one", "two"], start
    assert texts("<head><title>t</title> \n bare text <p>one") == ["bare text", "one"]
    assert texts("<head><noscript><img src=a>no</noscript><title>t</title></head><p>one") == ["one"]
    assert texts("<p>let <math><mfrac><mn>1</mn><mn>2</mn></mfrac><mspace/><mo>=</mo><mi>x</mi></math> hold</p><p>b") == ["let 1 2 = x hold", "b"]


def test_special_token_in_a_text_is_as_the_library_has_it():
    texts = ["a <|endoftext|> b", "plain words here", "<|endoftext|>", "a <|end b"]
    library = Tokenizer.from_file(BPE)
    got = [x.tolist() for x in sstable.WordEncoder(BPE).encode(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [64, 220, 50256, 275]
