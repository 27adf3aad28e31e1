"""N-gram Jaccard join by universe partition and pigeonhole.

A document is its set of distinct 5-word shingles, as 64-bit hashes. For documents of one size
band the hash universe is split into m segments; a segment's subset of the set, hashed, is a
signature. Two sets that differ in at most H elements agree in all but H segments, so a set that
looks up any H + 1 of its non-empty segments finds every partner:

* every set indexes all its non-empty segments in the scheme of its own band, and of the band
  below if it may have partners there;
* signatures are counted over all documents. One that no other set has costs nothing to look up;
  each set spends the rest of its H + 1 on the signatures with the fewest other holders (the
  cost-based allocation), so a passage or line that thousands share is not looked up by sets that
  have enough rarer segments;
* a set with too few non-empty segments for that (a thin set) also indexes the one-deletion
  neighbourhoods of its segments, each worth two units instead of one, and if these too are
  too few its empty segments. A pair of thin sets then meets in one of these; a pair with one set that is
  not thin meets through that one.

Candidates are verified by the exact size of intersection and union of the sets of 64-bit shingle
hashes; sets of equal size and equal 128-bit digest are taken for equal and are one set throughout. Holders of a signature first meet only through single members, so a large group
of near copies is joined up along stars; then every holder pair that is still apart is verified,
so no link between different texts is lost and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioqc.llm.common import BROADCAST_ROWS, but_for, cut, packed, release, scratch, slices, unpacked

SHINGLE = 5
#: Two sets link when 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
SEGMENTS_PER_SIZE = 0.42
BAND_RATIO = 1.7
STAR_ROUNDS = 3
#: Bytes of packed signatures that one bucket holds, and entries that a task sends at once.
BUCKET_BYTES = 24 << 20
FLUSH_ENTRIES = 1 << 20
#: Signatures that HOT_COUNT of a sample's sets hold are dealt to tasks by set, not by signature. The
#: sample, which only decides how signatures travel, has HOT_SAMPLE sets or one in HOT_EVERY.
HOT_SAMPLE, HOT_EVERY, HOT_COUNT, HOT_MOST = 8192, 16384, 16, 2_000_000
#: Shingles of the sets of a block that ask, and of those that it meets at a time; holders in a list.
BLOCK_ITEMS, CHUNK_ITEMS, LIST_DOCS = 1 << 18, 1 << 20, 4096

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PLACE = _mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | _U(1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order. In bytes, lower() and split() know ASCII alone."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; empty without words."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return _mix(np.sum(w * _PLACE[: len(w)], keepdims=True, dtype=np.uint64) + _U(len(w)))
    n = len(w) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += w[k : k + n] * _PLACE[k]
    return np.unique(_mix(total))


def _bands() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(int(edges[-1] * BAND_RATIO) + 1)
    return np.asarray(edges)


BANDS = _bands()


def band_of(n: int) -> int:
    return int(np.searchsorted(BANDS, n, "right")) - 1


def segments(band: int) -> int:
    return int(SEGMENTS_PER_SIZE * BANDS[band + 1]) + 2


def schemes(n: int) -> list[tuple[int, int]]:
    """(band, H) of each scheme in which a set of n elements takes part.

    |X| + |Y| = s and 100 i >= 75 u give a difference of at most s / 7.
    """
    own, most = band_of(n), 100 * n // THRESHOLD
    t = 100 - THRESHOLD, 100 + THRESHOLD
    found = [(own, (n + most) * t[0] // t[1])]
    if own and -(-n * THRESHOLD // 100) < BANDS[own]:
        found.append((own - 1, (n + int(BANDS[own]) - 1) * t[0] // t[1]))
    return found


def segment_of(items: np.ndarray, band: int) -> np.ndarray:
    """The segment of each element of a sorted set; it ascends."""
    return ((items >> _U(32)) * _U(segments(band))) >> _U(32)


def signatures(items: np.ndarray, band: int, most: int) -> tuple[np.ndarray, int, bool]:
    """Signatures of a sorted set in a scheme, the number of non-empty segments, and if it is thin."""
    m = segments(band)
    seg = segment_of(items, band)
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    at = seg[first]
    mixed = _mix(items ^ _U(0x5851F42D4C957F2D))
    sums = np.add.reduceat(mixed, first)
    name = _mix(at + _U(band) * _U(1 << 40) + _U(1))
    exact = _mix(sums ^ name)
    if len(first) > most:
        return exact, len(first), False
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(items))))
    count = np.bincount(owner)
    several = count[owner] > 1
    dropped = _mix((sums[owner] - mixed)[several] ^ name[owner][several])
    parts = [exact, dropped]
    if len(first) + int((count > 1).sum()) <= most:
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
        parts.append(_mix(_mix(empty + _U(band) * _U(1 << 40) + _U(1))))
    return np.unique(np.concatenate(parts)), len(first), True


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest (h1, h2) of the set of every whole text, and for each
    scheme of the set (part) its non-empty segments, H, and if it is thin."""
    part = pa.struct([("part", pa.int32()), ("filled", pa.int64()), ("most", pa.int64()), ("thin", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, h1, h2, parts = [], [], [], []
            for text in batch.column(1).to_pylist():
                items = shingles(text)
                n.append(len(items))
                h1.append(int(np.sum(_mix(items), dtype=np.uint64).view(np.int64)))
                h2.append(int(np.sum(_mix(items ^ _U(0xD6E8FEB86659FD93)), dtype=np.uint64).view(np.int64)))
                listed = []
                for k, (band, most) in enumerate(schemes(len(items)) if len(items) else []):
                    seg = segment_of(items, band)
                    filled = 1 + int(np.count_nonzero(seg[1:] != seg[:-1]))
                    listed.append({"part": k, "filled": filled, "most": most, "thin": filled <= most})
                parts.append(listed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, h1, h2)), pa.array(parts, pa.list_(part))], ["doc_id", "n_shingles", "h1", "h2", "parts"]
            )

    return _slim(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, parts array<struct<part: int, filled: bigint, most: bigint, thin: boolean>>")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def hot_signatures(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Sorted signatures that many sets of a sample hold."""
    every = max(1, n_docs // max(HOT_SAMPLE, n_docs // HOT_EVERY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                items = shingles(text)
                for band, most in schemes(len(items)) if len(items) else []:
                    yield pa.RecordBatch.from_arrays([pa.array(signatures(items, band, most)[0].view(np.int64))], ["sig"])

    seen = _slim(docs).where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(every)) == 0).mapInArrow(run, "sig bigint")
    counted = seen.groupBy("sig").count().where(F.col("count") >= HOT_COUNT).orderBy(F.desc("count"), "sig").limit(HOT_MOST)
    return np.sort(np.asarray([r.sig for r in counted.select("sig").collect()], np.int64).view(np.uint64))


def shared_signatures(docs: DataFrame, n_buckets: int, hot: np.ndarray) -> DataFrame:
    """doc_id, part, sig, holders for every signature that two or more sets hold.

    Signatures travel packed: a task sends, for each bucket of the signature space, one array of
    signatures and one of document numbers, and a bucket is sorted as a whole where it arrives. So
    that no bucket has to hold all holders of a very common signature, hot ones go to as many
    buckets more, by document; these hold what they are sent, and the holders are counted after.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, docs_seen, n = [], [], [], 0

        def flush():
            sig, own = np.concatenate(sigs), np.concatenate(owners)
            ids = np.asarray(docs_seen, np.int64)
            bucket = ((sig >> _U(32)) * _U(n_buckets)) >> _U(32)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, sig), len(hot) - 1)
                by_doc = _U(n_buckets) + ((_mix(ids.view(np.uint64))[own] >> _U(32)) * _U(n_buckets) >> _U(32))
                bucket = np.where(hot[at] == sig, by_doc, bucket)
            order = np.argsort(bucket, kind="stable")
            sig, own, bucket = sig[order], own[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
            out = [[], [], [], []]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                s, o = sig[lo:hi], own[lo:hi]
                used, local = np.unique(o, return_inverse=True)
                for column, value in zip(out, (int(bucket[lo]), s.tobytes(), local.astype("<u4").tobytes(), ids[used].tobytes())):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "sigs", "owners", "ids"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items = shingles(text)
                if not len(items):
                    continue
                for part, (band, most) in enumerate(schemes(len(items))):
                    sig, _, _ = signatures(items, band, most)
                    sigs.append(sig)
                    # The low bit of the owner's number says in which of its schemes.
                    owners.append(np.full(len(sig), len(docs_seen), np.uint32))
                    docs_seen.append((doc_id << 1) | part)
                    n += len(sig)
                if n >= FLUSH_ENTRIES:
                    yield flush()
                    sigs, owners, docs_seen, n = [], [], [], 0
        if n:
            yield flush()

    def gather(key: tuple, packed: pa.Table) -> pa.Table:
        sig, own = [], []
        for s, o, i in zip(packed["sigs"], packed["owners"], packed["ids"]):
            sig.append(np.frombuffer(s.as_py(), np.uint64))
            own.append(np.frombuffer(i.as_py(), np.int64)[np.frombuffer(o.as_py(), "<u4")])
        sig, own = np.concatenate(sig), np.concatenate(own)
        order = np.argsort(sig, kind="stable")
        sig, own = sig[order], own[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        count = np.diff(np.append(np.flatnonzero(new), len(sig)))
        holders = np.repeat(count, count)
        if key[0].as_py() >= n_buckets:
            holders[:] = 0
        keep = holders != 1
        return pa.table(
            [pa.array(own[keep] >> 1, pa.int64()), pa.array((own[keep] & 1).astype(np.int32), pa.int32()), pa.array(sig[keep].view(np.int64), pa.int64()), pa.array(holders[keep].astype(np.int32), pa.int32())],
            ["doc_id", "part", "sig", "holders"],
        )

    packed = _slim(docs).mapInArrow(emit, "bucket bigint, sigs binary, owners binary, ids binary")
    found = packed.groupBy("bucket").applyInArrow(gather, "doc_id bigint, part int, sig bigint, holders int")
    if not len(hot):
        return found
    found = cut(found, "packed-signatures")
    counts = cut(found.where("holders = 0").groupBy("sig").agg(F.count("*").cast("int").alias("n")), "hot")
    return found.join(F.broadcast(counts), "sig", "left").where("coalesce(n, holders) > 1").select("doc_id", "part", "sig", F.coalesce("n", "holders").alias("holders"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that links (a, b) mention.

    Smallest labels pass along links and then along labels until none changes; each round is
    written to the shared folder. Only the count of changed rows comes to the driver.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("heard"))
        stepped = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        new = cut(stepped.join(jump, F.col("component") == F.col("via"), "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        release(labels)
        if new.where("component <> old").isEmpty():
            release(both)
            return new.select("node", "component")
        labels = new


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with a doc_id in ids; the identifiers are broadcast when their count allows it."""
    return docs.join(_short(ids), "doc_id", "left_semi")


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Texts without words (null, empty, blank) have an empty set and link with nothing: their
    component is their own doc_id. Fewer than five words are one shingle. Rows that repeat a
    doc_id or a text share a set. Rows with a null doc_id take no part in links and get a null
    component. No row gives no row. Columns but doc_id and text are not read.
    """
    with scratch() as keep:
        return keep(cut(_components_of(docs), "components"))


def _components_of(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    profile = cut(profiles(docs), "profiles")
    has_set = profile.where("n_shingles > 0 and doc_id is not null")
    sets = cut(has_set.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("rows")), "sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = min(1 << 31, max(-(-int(total * 0.75) * 10 // BUCKET_BYTES), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    # One row for each distinct set stands for it; copies are left out before signatures are made.
    copies = cut(has_set.join(sets.where("rows > 1").select("h1", "h2", F.col("doc_id").alias("first")), ["h1", "h2"]).where("doc_id <> first").select("doc_id").distinct(), "copies")
    whole = _slim(docs).where("doc_id is not null")
    single = whole.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "doc_id", "left_anti")
    hot = hot_signatures(single, sets.count())
    shared = cut(shared_signatures(single, n_buckets, hot), "signatures")

    allowed = has_set.select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*").dropDuplicates(["doc_id", "part"])
    links = cut(_links(spark, single, shared, sets, allowed), "links")
    labelled = sets.join(components(spark, links).withColumnRenamed("node", "doc_id"), "doc_id", "left").select("h1", "h2", F.coalesce("component", "doc_id").alias("component"))
    found = profile.select("doc_id", "n_shingles", "h1", "h2").join(labelled.where("h1 is not null"), ["h1", "h2"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"))


def _links(spark: SparkSession, single: DataFrame, shared: DataFrame, sets: DataFrame, allowed: DataFrame) -> DataFrame:
    """Verified links (a, b) between distinct sets that connect all that are linked."""
    probes = cut(_lookups(shared, allowed), "lookups")

    members = cut(shared.select("doc_id", "sig").distinct().join(probes.select("sig").distinct(), "sig", "left_semi").join(sets.select("doc_id", "n_shingles"), "doc_id"), "members")
    items = cut(_sets_of(_only(single, cut(members.select("doc_id").distinct(), "in-buckets"))), "sets-of")

    links = done = None
    for turn in range(STAR_ROUNDS):
        marked = _marked(spark, members, links)
        chosen = F.min_by(F.struct("doc_id", "component", "n_shingles"), F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("doc_id"))
        spans = marked.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), chosen.alias("centre")).where("lo <> hi").select("sig", "centre")
        pairs = (
            marked.join(spans, "sig")
            .where("component <> centre.component")
            .where(_sizes_allow(F.col("n_shingles"), F.col("centre.n_shingles")))
            .groupBy("doc_id").agg(F.min("centre.doc_id").alias("other"))
            .select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
        )
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        tried = cut(_verified(cut(pairs, "pairs"), items), "verified")
        new = tried.where("linked").select("a", "b")
        links = new if links is None else links.union(new)
        done = tried.select("a", "b") if done is None else done.union(tried.select("a", "b"))
    return links.union(_rest(_marked(spark, members, links), probes, items))


def _marked(spark: SparkSession, members: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return members.withColumn("component", F.col("doc_id"))
    labels = components(spark, links).withColumnRenamed("node", "doc_id")
    return cut(members.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "marked")


def _blocks(seated: DataFrame, keys: list[str]) -> DataFrame:
    """seated with the number of blocks of about BLOCK_ITEMS shingles that its kind and name fill."""
    crowd = cut(seated.groupBy(*keys).agg(F.ceil(F.sum("n_shingles") / BLOCK_ITEMS).alias("blocks")), "crowds")
    return seated.join(_short(crowd), keys)


def _short(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows. The other side then stays where it is, so a key of very
    many rows lands in no one task."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _rest(marked: DataFrame, probes: DataFrame, items: DataFrame) -> DataFrame:
    """Links (a, b) between components that still share a signature which one of them looked up.

    Sets that look up are put in blocks of about BLOCK_ITEMS shingles: those of a component that
    fills one together, in blocks that leave out its other members; else those whose most crowded
    signature is the same, if they fill one; else those whose most crowded signatures have about as
    many holders, as holders of crowded signatures are often the same sets.
    A block meets every set that holds one of its signatures, in chunks of about CHUNK_ITEMS
    shingles, as sets of a stated query against all others: no row is made for a pair, and a set
    goes to a block once, however many signatures it has in common with it. Holder lists travel in
    pieces of about LIST_DOCS.
    """
    spans = marked.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("sig", "n")
    apart = cut(marked.join(spans, "sig"), "apart")
    crowded = apart.agg(F.max("n")).first()[0] or 1
    slots = 32
    while slots * LIST_DOCS < crowded:
        slots *= 2
    seekers = probes.join(apart, ["doc_id", "sig"]).select("doc_id", "sig", "n", "component", "n_shingles")
    home = seekers.groupBy("doc_id").agg(F.max_by("sig", F.struct("n", "sig")).alias("home"), F.max("n").alias("n"), F.first("component").alias("component"), F.first("n_shingles").alias("n_shingles"))
    home = cut(home, "homes")

    def full(key: str, name: str) -> DataFrame:
        return _short(cut(home.groupBy(key).agg(F.sum("n_shingles").alias("all")).where(F.col("all") >= BLOCK_ITEMS).select(key, F.lit(True).alias(name)), name))

    band = F.floor(F.log2("n")).cast("long")
    kind = F.when(F.col("large"), "component").when(F.col("crowded"), "signature").otherwise("band")
    seated = home.join(full("component", "large"), "component", "left").join(full("home", "crowded"), "home", "left")
    seated = seated.select("doc_id", "n_shingles", "home", F.when(F.col("large"), F.col("component")).alias("own"), kind.alias("kind"), F.when(F.col("large"), F.col("component")).when(F.col("crowded"), F.col("home")).otherwise(band).alias("name"))
    dealt = F.pmod(F.xxhash64(F.when(F.col("kind") == "band", F.col("home")).otherwise(F.col("doc_id"))), F.col("blocks"))
    placed = cut(_blocks(seated, ["kind", "name"]).select("doc_id", "own", F.xxhash64("kind", "name", dealt).alias("block")), "blocks")
    wanted = seekers.select("doc_id", "sig").join(placed, "doc_id").select("block", "own", "sig").distinct()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot")
    lists = apart.select("sig", "doc_id", "component", slot).groupBy("sig", "slot").agg(F.collect_list(F.struct("doc_id", "component")).alias("docs"))

    def unite(key: tuple, lists: pa.Table) -> pa.Table:
        own = lists["own"][0].as_py()
        parts = []
        for c in lists["docs"].chunks:
            ids, component = (x.to_numpy(zero_copy_only=False) for x in c.flatten().flatten())
            parts.append(ids if own is None else ids[component != own])
        found = np.unique(np.concatenate(parts))
        return pa.table([pa.array(np.full(len(found), key[0].as_py()), pa.int64()), pa.array(found, pa.int64())], ["block", "doc_id"])

    met = wanted.join(lists, "sig").select("block", "slot", "own", "docs").groupBy("block", "slot").applyInArrow(unite, "block bigint, doc_id bigint")
    about = apart.select("doc_id", "component", "n_shingles").distinct()
    met = cut(met.join(about, "doc_id"), "met")
    chunks = cut(met.groupBy("block").agg(F.ceil(F.sum("n_shingles") / CHUNK_ITEMS).cast("int").alias("chunks")), "chunks")
    chunks = _short(chunks)
    ys = met.join(chunks, "block").select("block", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"), "doc_id", "component", F.lit(False).alias("asks"))
    xs = placed.join(chunks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id").join(about.select("doc_id", "component"), "doc_id")
    rows = ys.unionByName(xs.withColumn("asks", F.lit(True))).join(items, "doc_id").select("block", "chunk", "doc_id", "asks", "component", "items")
    return rows.groupBy("block", "chunk").applyInArrow(_meet_all, "a bigint, b bigint")


def _meet_all(rows: pa.Table) -> pa.Table:
    """One link (a, b) for each asking set and component that it is linked with, by exact counts.

    Shingles are ranked from the rarest of the chunk to the most common. Sets that are linked share
    one among the first few of each (the more of these, the smaller the overlap that a partner's
    size may ask for), so only sets that do are compared: what a whole crowd shares is not met.
    """
    rows = rows.combine_chunks()
    asks = rows["asks"].to_numpy()
    ids, parts = rows["doc_id"].to_numpy(), rows["component"].to_numpy()
    column = rows["items"].chunk(0) if rows["items"].num_chunks else pa.array([], pa.list_(pa.int64()))
    ends = column.offsets.to_numpy()
    values, size = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    # One number a shingle, its set's and its rank, sorts each set's shingles where they are.
    both_keys = owner.astype(np.int64) << 32 | rank[place]
    del values, place
    both_keys.sort()
    value = (both_keys & 0xFFFFFFFF).astype(np.int32)
    del both_keys
    start = np.cumsum(size) - size
    at = np.arange(len(value), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
    # Against a partner that is no larger (far), and no smaller (near).
    far = at < np.repeat(size - -(-size * THRESHOLD // 100) + 1, size)
    near = at < np.repeat(size - -(-size * 2 * THRESHOLD // (100 + THRESHOLD)) + 1, size)
    del at

    def index(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = np.flatnonzero(first & ~asks[owner])
        chosen = chosen[np.argsort(value[chosen], kind="stable")]
        return value[chosen], owner[chosen]

    def holders(indexed: tuple[np.ndarray, np.ndarray], sought: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(indexed[0], sought, "left"), np.searchsorted(indexed[0], sought, "right")
        n = hi - lo
        return indexed[1][np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    near_index, far_index = index(near), index(far)
    marked = np.zeros(len(count), np.int16)
    a, b = [], []
    for k in np.flatnonzero(asks):
        mine = slice(start[k], start[k] + size[k])
        smaller, larger = holders(near_index, value[mine][far[mine]]), holders(far_index, value[mine][near[mine]])
        found = np.unique(np.concatenate([smaller[size[smaller] <= size[k]], larger[size[larger] > size[k]]]))
        found = found[(parts[found] != parts[k]) & (np.minimum(size[found], size[k]) * 100 >= np.maximum(size[found], size[k]) * THRESHOLD)]
        if not len(found):
            continue
        marked[value[mine]] = 1
        n = size[found]
        ahead = np.cumsum(n) - n
        both = np.add.reduceat(marked[value[np.repeat(start[found] - ahead, n) + np.arange(n.sum())]], ahead, dtype=np.int64)
        marked[value[mine]] = 0
        ok = found[both * 100 >= (size[k] + n - both) * THRESHOLD]
        _, first = np.unique(parts[ok], return_index=True)
        a += [int(ids[k])] * len(first)
        b += ids[ok][first].tolist()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sizes_allow(x, y):
    return (F.least(x, y) * 100 >= F.greatest(x, y) * THRESHOLD)


def _lookups(shared: DataFrame, allowed: DataFrame) -> DataFrame:
    """doc_id, sig: the signatures that each set has to look up among its shared ones."""
    by_cost = Window.partitionBy("doc_id", "part").orderBy("holders", "sig")
    everything = Window.partitionBy("doc_id", "part")
    ranked = shared.withColumn("nth", F.row_number().over(by_cost)).withColumn("n_shared", F.count("*").over(everything))
    need = F.when(F.col("thin"), F.col("n_shared")).otherwise(F.col("most") + 1 - (F.col("filled") - F.col("n_shared")))
    return ranked.join(allowed, ["doc_id", "part"]).where(F.col("nth") <= need).select("doc_id", "sig").distinct()


def _sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, items (sorted shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            items = [shingles(text).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "items"])

    return docs.mapInArrow(run, "doc_id bigint, items array<bigint>")


def _verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """a, b, linked by the exact intersection and union of their sets."""
    left = items.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = items.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("bigint")
    return pairs.join(right, "b").join(left, "a").select("a", "b", (both * 100 >= (F.size("x") + F.size("y") - both) * THRESHOLD).alias("linked"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; null identifiers and texts
    without words stay, and so do rows that repeat one that stays. Columns may have any names."""
    with scratch() as keep:
        gone = keep(cut(similar_components(docs).where("component_id <> doc_id").select("doc_id").distinct(), "near-copies"))
    return unpacked(but_for(packed(docs, F.col("doc_id").cast("bigint").alias("doc_id")), gone, ["doc_id"]), docs.columns)
