"""Archives, resampling and repair against brute force, SQL and odd rows."""

import hashlib
import io
import itertools
import math
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from folioqc.llm import catalog, conversations, importance, warc

FOLDER = "/root/testdata/sf0.001"
CLASH = "digest bytes n first size grouped keep_id keep_url keep_rows copy unique said letter early said_in firsts head is_row order signature row_number_here range place rank weight score buckets total"


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH.split() if c not in df.columns), F.lit(1).alias("a.b"))


# ---- archives ---------------------------------------------------------------------------------


def pages(spark):
    long = "<p>" + "long page " * 300_000
    rows = [
        (1, "http://a/1", "<p>" + "x" * 200), (2, "http://a/2", "<p>" + "x" * 200), (3, None, "short"), (4, "http://a/4", "short"),
        (5, "u r l\r\nX-Evil: 1", None), (6, "", ""), (7, "http://a/7", long), (8, "http://a/8", long), (2, "http://a/2", "<p>" + "x" * 200),
        (None, "http://n/1", "<p>" + "x" * 200), (None, "http://n/2", "é" * 120), (None, "http://n/2", "é" * 120), (None, "http://n/3", "é" * 120), (9, "http://a/9", "y" * 99), (10, "http://a/10", "y" * 99), (11, "ü%41", "z" * 100), (11, "ü%41", "z" * 100),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_on_odd_rows(spark):
    df = pages(spark)
    got = warc.archived(clashing(df), with_payload=True).collect()
    assert len(got) == df.count() and not any(r.problem for r in got) and len({r.record_id for r in got}) == len(got)
    want = Counter((r.page_id, r.url, hashlib.sha256((r.html or "").encode()).hexdigest(), len((r.html or "").encode())) for r in df.collect())
    assert Counter((r.page_id, r.url, r.payload_digest, r.payload_bytes) for r in got) == want
    for digest, same in itertools.groupby(sorted(got, key=lambda r: r.payload_digest), key=lambda r: r.payload_digest):
        same = list(same)
        first = [r for r in same if r.record_type == "response"]
        keep = min((r.page_id is None, r.page_id or 0) for r in same)
        if same[0].payload_bytes < 100:
            assert len(first) == len(same)
            continue
        assert len(first) == 1 and (first[0].page_id is None, first[0].page_id or 0) == keep and hashlib.sha256(first[0].payload).hexdigest() == digest
        assert all(r.refers_to == first[0].page_id and r.payload is None for r in same if r.record_type == "revisit")
    assert warc.archived(df.limit(0)).count() == 0


def test_archives_when_groups_are_too_many_to_broadcast(spark, monkeypatch):
    from folioqc.llm import common

    df = pages(spark)
    want = Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.archived(df).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.archived(df).collect()) == want
    monkeypatch.setattr(common, "FILTER_BITS", 0)
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.archived(df).collect()) == want


def one_record(payload=b"p" * 300, digest=None, kind="response", size=None, refers_to=None):
    digest = digest or hashlib.sha256(payload).hexdigest()
    return warc.page_record(warc.record_id("t", payload[:9]), 1, "http://a/", kind, refers_to, len(payload) if size is None else size, digest, payload)


def archive(records, sample=None):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, records if sample is None else sample)
    for r in records:
        writer.add(r)
    return out.getvalue()


def read(data):
    return list(warc.records(io.BytesIO(data)))


def test_reader_against_the_library_alone():
    """The frames are ordinary ones: zstandard itself reads them with the dictionary of the head."""
    made = [one_record(f"<p>page {i} ".encode() * 40) for i in range(300)]
    data = archive(made)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 20))
    plain = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True).read()
    assert plain == b"".join(made)
    assert [r.payload for r, _ in read(data)] == [f"<p>page {i} ".encode() * 40 for i in range(300)]
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[8 + size :], max_output_size=1 << 20)


def test_dictionary_may_be_plain_or_missing():
    made = [one_record(f"<p>page {i} ".encode() * 40) for i in range(300)]
    packed = archive(made)
    size = struct.unpack("<I", packed[4:8])[0]
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(packed[8 : 8 + size])
    assert [p for _, p in read(struct.pack("<II", 0x184D2A5D, len(raw)) + raw + packed[8 + size :])] == [None] * 300
    none = archive(made[:3], sample=[])
    assert none[:4] == struct.pack("<I", 0xFD2FB528) and [p for _, p in read(none)] == [None] * 3
    assert read(struct.pack("<II", 0x184D2A5D, 4) + b"what")[0][1] == "the leading frame holds no dictionary"
    assert read(b"") == []


@pytest.mark.parametrize("harm, says", [
    (lambda r: r.replace(b"Content-Length: 300", b"Content-Length: 299"), "the payload is not what its length and digest say"),
    (lambda r: r.replace(b"pppp", b"qqqq", 1), "the payload is not what its length and digest say"),
    (lambda r: r.replace(b"WARC/1.1", b"WARC/3.0"), "the version line is unknown"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), "WARC-Date is missing"),
    (lambda r: r.replace(b"sha256:", b"md5:"), "WARC-Payload-Digest is no sha256"),
    (lambda r: r[:-4], "the block is not as long as Content-Length says"),
    (lambda r: r + b"more", "the block is not as long as Content-Length says"),
    (lambda r: r.replace(b"Page-ID: 1", b"Page-ID: one"), "Page-ID is no number"),
    (lambda r: r.replace(b"Page-ID: 1", b"Page ID: 1"), "the record's head has a line that is no field"),
    (lambda r: r.replace(b"Page-ID: 1", b"WARC-Type: response"), "the record has WARC-Type twice"),
    (lambda r: b"no head", "the record's head has no end"),
])
def test_damaged_records_are_told_and_passed_over(harm, says):
    good = one_record()
    assert [p for _, p in read(archive([good, harm(good), good]))] == [None, says, None]


def test_damaged_frames_end_an_archive():
    good = one_record()
    data = archive([good, good])
    assert read(data[:-3])[-1][1] == "the archive ends within a frame"
    assert read(data + b"xx")[-1][1] == "no frame begins where the last one ended"
    flipped = bytearray(data)
    flipped[-1] ^= 1  # the checksum
    assert read(bytes(flipped))[0][1] is None and read(bytes(flipped))[-1][1]
    revisit = one_record(kind="revisit", refers_to=5)
    assert read(archive([revisit]))[0][0].refers_to == 5
    assert "does not name" in read(archive([revisit.replace(b"Refers-To-Page-ID: 5", b"Refers-To-Page-ID: 6")]))[0][1]


def test_missing_records_are_told(spark, tmp_path):
    store, root = fs.FileSystem.from_uri(tmp_path.as_uri())
    with store.open_output_stream(f"{root}/a.warc.zst") as out:
        out.write(archive([one_record()]))
    listed = spark.createDataFrame([(f"{root}/a.warc.zst", 2)], warc.ARCHIVE)
    assert [r.problem for r in warc.read_archives(listed, tmp_path.as_uri()).collect()] == [None, "1 of 2 records were found"]


# ---- resampling -------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return len(words), [zlib.crc32(f.encode()) % buckets for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def brute(docs, target, buckets=10_000):
    t = Counter(b for text in target for b in features(text, buckets)[1])
    rows = [(i, *features(text, buckets)) for i, text in docs]
    s = Counter(b for r in rows for b in r[2])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in range(buckets)]
    scored = []
    for i, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(long[: len(long) * 25 // 100], 1)}
    return sorted((str(r[0]), r[2], r[3], r[4], drawn.get(id(r), 0)) for r in scored)


def odd_documents(spark):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    more = [(9000, None), (9001, ""), (9002, " ,;\n"), (9003, "one " * 3000), (9004, "x" * 5000 + " y"), (9005, "A a\0B é_É 1"), (None, "word " * 25), (9006, "z" * 9000)]
    return base + more


@pytest.mark.parametrize("characters", [4 << 20, 700])
def test_resampling_against_loops(spark, monkeypatch, characters):
    """Whatever the size of the parts that texts are counted in."""
    docs = odd_documents(spark)[-60:] if characters < 1000 else odd_documents(spark)
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    monkeypatch.setattr(importance, "CHARACTERS", characters)
    got = importance.resample(clashing(spark.createDataFrame(docs, "doc_id long, text string")), clashing(spark.createDataFrame([(t,) for t in target], "text string")))
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r.rank or 0) for r in got.collect()) == brute(docs, target)


def test_resampling_of_repeated_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text)] * 400 + [(6, text + " tail")] * 3, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = importance.resample(docs, none).collect()
    assert len(got) == 403 and sorted(r.rank for r in got if r.rank) == list(range(1, 101)) and {r.n_features for r in got} == {59, 61}
    assert importance.resample(docs.limit(0), none).collect() == []


def test_parts_of_long_texts_hold_every_pair_once():
    text = "a bb  ccc, dddd\neeeee f gg " * 40
    for most in (1, 5, 17, 64, 10_000):
        words, pairs = [], []
        for _, carried, part in importance.pieces(iter([(0, text)]), most):
            found = WORD.findall(part)
            words += found[carried:]
            pairs += list(zip(found, found[1:]))
        whole = WORD.findall(text)
        assert words == whole and pairs == list(zip(whole, whole[1:]))


# ---- repair -----------------------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit) by trying all edits of a short list of (initial, fault)."""
    found = (99, "~")

    def go(at, inserted, cost, audit, roles):
        nonlocal found
        if cost > found[0]:
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found = min(found, (cost, audit))
        if inserted < 2:
            for r in "ua":
                go(at, inserted + 1, cost + 2, audit + "I", roles + r)
        if at < len(rows):
            role, fault = rows[at]
            go(at + 1, 0, cost + 3, audit + "D", roles)
            if fault not in ("blank", "duplicate"):
                stays = fault == "truncated"
                go(at + 1, 0, cost + stays, audit + "K", roles + role)
                for r in "ua":
                    go(at + 1, 0, cost + 2 + stays, audit + "R", roles + r)

    go(0, 0, 0, "", "")
    return found


def test_repairs_are_the_cheapest():
    signs = ["", *conversations.LETTERS, *(a + b for a in conversations.LETTERS for b in "ABCDEM"), *("".join(x) for x in itertools.product("ABCN", repeat=3)), "ABCM", "CCAB", "BBFC", "AAAA"]
    for sign in signs:
        repair = conversations.Repair(sign)
        assert cheapest(repair.rows) == (repair.result()[4], repair.result()[5]), sign


def test_long_signatures_do_not_exhaust_the_stack():
    for sign in ("BC" * 20_000, "D" * 20_000, "A" + "GB" * 10_000):
        faults = conversations.Repair(sign).result()
        assert len(faults[5].replace("I", "")) == len(sign)


def plain_repair(rows):
    """The contract of one conversation's rows, in order: (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[:1] if r[:1] in "sua" and r else "x" for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(list(zip(initials, faults))) if rows else (0, "")
    at, out = 0, []
    for e in audit:
        if e in "KRI":
            # The role that the pattern asks for here.
            role = ("user" if len([o for o in out if not o.startswith("s")]) % 2 == 0 else "assistant") if e != "K" else rows[at][1]
            out.append(f"{role}:{'' if e == 'I' else rows[at][2]}")
        at += e != "I"
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_on_odd_rows(spark):
    long = "word " * 50_000 + "."
    made = {
        1: [(0, "system", "Be kind."), (1, "user", "Hi?"), (2, "assistant", long)],
        2: [(None, "user", "a."), (3, "user", "a."), (9, "assistant", "b")],
        3: [(0, "assistant", " "), (0, "assistant", " "), (1, "tool", "x.")],
        4: [(5, "user", "q!"), (5, "user", "q!"), (7, "assistant", "r. ")],
        5: [(0, " ", " ")],
        None: [(0, "user", "one."), (1, "assistant", "two."), (1, "user", "three.")],
        7: [(0, "", "no role.")],
    }
    rows = [(c, t, r, x) for c, listed in made.items() for t, r, x in listed]
    df = clashing(spark.createDataFrame([*rows, (8, None, None, None)], "conv_id long, turn long, role string, text string"))
    made[8] = [(None, " ", " ")]
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(df).collect()}
    assert set(got) == set(made)
    for conv, listed in made.items():
        order = sorted(listed, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{x[1]}\0{x[2]}".encode()).digest()))
        assert got[conv] == plain_repair(order), conv
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert [tuple(r) for r in conversations.repair(df.where("conv_id = 1"), df.where("false")).collect()] == [(1, *nothing)]
    assert conversations.repair(df.limit(0)).collect() == []


def test_repeats_are_told_whatever_their_number(spark, monkeypatch):
    from folioqc.llm import common

    df = spark.createDataFrame([(c, t, "user", f"said {t % 3}.") for c in range(4) for t in range(9)], "conv_id long, turn long, role string, text string")
    want = sorted(conversations.repair(df).collect())
    assert all(r.duplicate == 6 for r in want)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(conversations.repair(df).collect()) == want


def test_damage_follows_the_checksum(spark):
    df = spark.createDataFrame([(c, t, "assistant", f"a. {c}! b? {t}") for c in range(40) for t in range(9)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    want = Counter()
    for r in df.collect():
        role, text = r.role or " ", r.text or " "
        harm = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            want[(r.conv_id, r.turn, "user" if harm == 4 else role, text)] += 2 if harm == 3 else 1
    assert Counter(map(tuple, conversations.damaged(df).collect())) == want
