"""Importance resampling towards a target set, by hashed n-grams.

DuckDB counts within each task: SQL unnests the words, a window pairs each with its successor, and
a registered zlib function gives each run its bucket. Every document's buckets, and every task's
counts of them, are spilled to Parquet; Spark merges the counts, turns them into gains and scores
the documents, which are not read again.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioqc.llm.common import cut, release, scratch

BUCKETS = 10_000
#: Characters that one run of the SQL takes, but for a single word that is longer.
CHARACTERS = 4 << 20
#: Memory that DuckDB may take in a task.
MEMORY = "512MB"
#: Ranges that the ranking is dealt to, for each shuffle partition of the session.
RANGES = 1

#: ASCII, and what it becomes: small letters and digits stay, capitals are made small, the rest separates.
ASCII = "".join(map(chr, range(128)))
FOLDED = "".join(c.lower() if c.isalnum() else " " for c in ASCII)
SEPARATOR = re.compile("[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")

WORDS = """
create or replace temp table runs as
with listed as (select doc, carried, string_split(translate(text, $ascii, $folded), ' ') as words from piece),
spread as (select doc, carried, unnest(words) as word, generate_subscripts(words, 1) as pos from listed),
paired as (
  select doc, word, lead(word) over in_order as following, carried and row_number() over in_order = 1 as seen
  from spread where word <> '' window in_order as (partition by doc order by pos)
),
features as (
  select doc, true as single, word as feature from paired where not seen
  union all
  select doc, false, word || ' ' || following from paired where following is not null
)
select doc, single, (crc32(feature) % $buckets)::integer as bucket from features
"""
BY_DOCUMENT = "select doc, count(*) filter (where single) as n_words, list(bucket) as buckets from runs group by doc order by doc"
TOTALS = "insert into totals select bucket, count(*) from runs group by bucket"
MERGED = "select bucket, sum(n)::bigint as n from totals group by bucket order by bucket"

SPILLED = "doc_id bigint, n_words bigint, buckets array<int>, total_bucket array<int>, total array<bigint>"


def crc32(features: pa.Array) -> pa.Array:
    """zlib's CRC of the UTF-8 bytes of each string."""
    values = features.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return pa.array(np.fromiter(map(zlib.crc32, values), np.int64, len(values)))


def _connection():
    import duckdb

    found = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    found.create_function("crc32", crc32, ["VARCHAR"], "BIGINT", type="arrow")
    found.execute("create table totals (bucket integer, n bigint)")
    return found


def pieces(texts: Iterator[tuple[int, str]], most: int) -> Iterator[tuple[int, bool, str]]:
    """(document, carried, text) of parts of at most about `most` characters.

    A part ends at a separator; the next one repeats its last word, and says so, so that no pair of
    words is lost or counted twice.
    """
    for doc, text in texts:
        at, carried = 0, ""
        while len(text) - at > most:
            end = next((m.start() for m in SEPARATOR.finditer(text, at + most)), len(text))
            yield doc, bool(carried), carried + text[at:end]
            stop = end
            while stop > at and SEPARATOR.match(text, stop - 1):
                stop -= 1
            first = max((m.end() for m in SEPARATOR.finditer(text, at, stop)), default=at)
            if first < stop:
                carried = text[first:stop] + " "
            at = end
        yield doc, bool(carried), carried + text[at:]


def batches_of(parts: Iterator[tuple[int, bool, str]], most: int) -> Iterator[list[tuple[int, bool, str]]]:
    """Parts in lists of at most about `most` characters, no document twice in one."""
    now, size = [], 0
    for part in parts:
        if now and (size + len(part[2]) > most or now[-1][0] == part[0]):
            yield now
            now, size = [], 0
        now.append(part)
        size += len(part[2])
    if now:
        yield now


def spilled(rows: DataFrame, buckets: int, what: str) -> DataFrame:
    """n_words and buckets of each document (doc_id, text), and, in a row of its own for each task,
    the task's counts of buckets."""
    names = ["doc_id", "n_words", "buckets", "total_bucket", "total"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        settings = {"ascii": ASCII, "folded": FOLDED, "buckets": buckets}
        read: dict[int, int] = {}

        def texts() -> Iterator[tuple[int, str]]:
            number = itertools.count()
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        nth = next(number)
                        read[nth] = doc_id
                        yield nth, text

        def counted(parts: list[tuple[int, bool, str]]) -> pa.Table:
            columns = [pa.array(c, t) for c, t in zip(zip(*parts), (pa.int64(), pa.bool_(), pa.string()))]
            con.register("piece", pa.table(columns, ["doc", "carried", "text"]))
            con.execute(WORDS, settings)
            con.unregister("piece")
            con.execute(TOTALS)
            return con.execute(BY_DOCUMENT).to_arrow_table()

        held: list[pa.Table] = []  # of a document that is not read to its end

        def rows_of(last: int, done: pa.Table) -> pa.RecordBatch:
            """Documents up to a number, those without words included."""
            numbers = sorted(n for n in read if n <= last)
            place = {n: i for i, n in enumerate(done.column("doc").to_pylist())}
            at = pa.array([place.get(n) for n in numbers], pa.int64())
            found = done.combine_chunks()
            taken = found.column("buckets").combine_chunks().take(at) if found.num_rows else pa.nulls(len(numbers), pa.list_(pa.int32()))
            counts = found.column("n_words").combine_chunks().take(at) if found.num_rows else pa.nulls(len(numbers), pa.int64())
            ids = pa.array([read.pop(n) for n in numbers], pa.int64())
            empty = pa.nulls(len(numbers), types[3]), pa.nulls(len(numbers), types[4])
            return pa.RecordBatch.from_arrays([ids, pc.fill_null(counts, 0), taken.cast(types[2]), *empty], names)

        def joined(tables: list[pa.Table]) -> pa.Table:
            """The parts of one document as one row."""
            lists = [t.column("buckets").combine_chunks().values for t in tables if t.num_rows]
            words = sum(pc.sum(t.column("n_words")).as_py() or 0 for t in tables)
            doc = next((t.column("doc")[0].as_py() for t in tables if t.num_rows), None)
            if doc is None:
                return tables[0]
            values = pa.concat_arrays(lists)
            whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.table([pa.array([doc], pa.int64()), pa.array([words], pa.int64()), whole], ["doc", "n_words", "buckets"])

        waiting = None
        for parts in batches_of(pieces(texts(), CHARACTERS), CHARACTERS):
            if waiting is not None and parts[0][0] != waiting:
                yield rows_of(waiting, joined(held))
                held, waiting = [], None
            found = counted(parts)
            if len(parts) == 1:  # maybe one of several parts
                held.append(found)
                waiting = parts[0][0]
            else:
                if waiting is not None:
                    first = found.filter(pc.equal(found.column("doc"), waiting))
                    yield rows_of(waiting, joined([*held, first]))
                    held, waiting = [], None
                yield rows_of(parts[-1][0] - 1, found)
                held, waiting = [found.filter(pc.equal(found.column("doc"), parts[-1][0]))], parts[-1][0]
        if waiting is not None:
            yield rows_of(waiting, joined(held))
        merged = con.execute(MERGED).to_arrow_table()
        con.close()
        yield pa.RecordBatch.from_pylist([{"total_bucket": merged.column("bucket").to_pylist(), "total": merged.column("n").to_pylist()}], schema=pa.schema(list(zip(names, types))))

    return cut(rows.mapInArrow(run, SPILLED), what)


def texts_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def totals(spill: DataFrame) -> DataFrame:
    """bucket and n, over all tasks."""
    single = spill.where("total is not null").select(F.explode(F.arrays_zip("total_bucket", "total")).alias("t"))
    return single.groupBy(F.col("t.total_bucket").alias("bucket")).agg(F.sum("t.total").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> Column:
    """The gains of all buckets in order, as a literal list: `buckets` numbers, whatever the input."""
    spark = raw.sparkSession
    counts = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    counts = counts.unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t")))
    counts = counts.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    both = counts.agg(F.sum("s").alias("S"), F.sum("t").alias("T"), F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("each"))
    gain = F.transform("each", lambda b: F.floor(F.lit(1000.0) * F.log((b["t"] + 1) * (F.col("S") + buckets) / ((b["s"] + 1) * (F.col("T") + buckets)))))
    found = both.select(F.to_json(gain.cast("array<bigint>")).alias("gains")).first().gains
    return F.from_json(F.lit(found), "array<bigint>")


def luck(seed: int) -> Column:
    """The Gumbel term of a document, from a digest of its identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("bigint")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their rank from 1 in the given order, without a task that holds them all: ranges
    of the order are sorted apart, and each starts after the rows of those before it. Rows that are
    equal in the order are told apart by their number, so that they too are dealt out."""
    spark = rows.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.col("row_number_here")]
    told = rows.withColumn("row_number_here", F.monotonically_increasing_id())
    sorted_rows = told.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("row_number_here")
    numbered = cut(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "ranges").withColumn("range", F.shiftright("place", 33))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = numbered.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    inside = F.col("place") - F.shiftleft(F.col("range"), 33)
    return numbered.join(F.broadcast(starts), "range").withColumn("rank", F.col("before") + inside + 1).drop("range", "place", "before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    target needs text only. Of the documents with at least least_words words, percent in a hundred
    are drawn: those of the highest score (weight and luck), smaller doc_id first among equals; rank
    says in which place, null for the others. A null text has no words, so its weight is 0; a null
    doc_id has luck of its own and comes last among equals; rows that repeat a doc_id count as many,
    and which of several equal ones gets the smaller rank makes no difference. No row, no output; an
    empty target makes rare features gain. Other columns are not read. Long texts are counted in
    parts and whole. What goes to all tasks is one list of `buckets` numbers.
    """
    with scratch() as keep:
        spill = keep(spilled(texts_of(docs), buckets, "buckets"))
        wanted = spilled(texts_of(target.withColumn("doc_id", F.lit(None)) if "doc_id" not in target.columns else target), buckets, "target-buckets")
        gain = gains(totals(spill), totals(wanted), buckets)
        rows = spill.where("total is null").select("doc_id", "n_words", F.coalesce("buckets", F.array().cast("array<int>")).alias("buckets"))
        each = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda a, b: a + F.get(gain, b))
        n = F.size("buckets").cast("bigint")
        weight = F.when(n > 0, F.floor(each / n)).otherwise(F.lit(0)).cast("bigint")
        scored = keep(cut(rows.select("doc_id", "n_words", n.alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + luck(seed)), "scores"))
    release(spill)
    long = scored.where(F.col("n_words") >= least_words)
    drawn = long.count() * percent // 100
    in_order = ranked(long, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    in_order = in_order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return in_order.unionByName(rest).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))
