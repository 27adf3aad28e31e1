"""Tables, the shared folder, whole rows as structs and bounded samples, for all corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: list[str] = []
_local = threading.local()
#: Narrow rows (identifiers, digests; about 100 bytes each in memory) that are broadcast at once;
#: beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Tasks that one very common key is dealt to where a list is too long to broadcast.
SALTS = 16
#: Shares that the rows of a value are ranked in before they are ranked together.
SHARES = 64
#: Bits of the largest bitmap that is broadcast to keep rows from a shuffle (64 MB).
FILTER_BITS = 1 << 29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in plain local mode, where driver and executors are one process, a temporary folder
    stands in for an unset setting; on a cluster an unset setting is an error. A folder without a
    scheme is one of Hadoop's default file system, for every reader and writer alike.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(f"file://{tempfile.mkdtemp(prefix='folioqc-')}")
        folder = _own_folder[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/folioqc/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends at replicated files."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._cut_folder = path
    if scopes := _scopes():
        scopes[-1].append(found)
    return found


def _scopes() -> list[list[DataFrame]]:
    return _local.__dict__.setdefault("scopes", [])


@contextlib.contextmanager
def scratch():
    """Within, tables that are cut live until the end, but for those that the given function keeps:

        with scratch() as keep:
            return keep(cut(result, "name"))
    """
    scopes, kept = _scopes(), []
    scopes.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        gone = [t for t in scopes.pop() if not any(t is k for k in kept)]
        if scopes:
            scopes[-1].extend(kept)
        release(*gone)


def release(*tables: DataFrame) -> None:
    """Delete the files of cut tables that nothing reads any more."""
    for df in tables:
        spark, folder = df.sparkSession, getattr(df, "_cut_folder", None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of a few rows, so that Python holds few whole texts at once. Spark
    bounds the batches themselves by bytes; no setting of the session is touched."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def named(column: str) -> Column:
    return F.col(f"`{column}`")


def packed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Each row of docs as a struct `row` beside the given columns: whatever names docs has, no
    column of an operator can clash with them."""
    return docs.select(F.struct(*map(named, docs.columns)).alias("row"), *columns)


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The rows that packed() took, with new values for some columns."""
    return df.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def may_match(rows: DataFrame, listed: DataFrame, keys: list[str], n: int) -> DataFrame | None:
    """rows with a flag `may`: false where the keys are certainly not among the n rows of listed.

    A bitmap with sixteen bits for each listed row is broadcast in blocks of 4 KB, at most
    FILTER_BITS in all; None where the list is too long for one. Built-in functions only.
    """
    bits = 1 << max(15, (16 * n - 1).bit_length())
    if bits > FILTER_BITS:
        return None
    place = F.pmod(F.xxhash64(*map(named, keys)), F.lit(bits)) + 1
    blocks = listed.select(F.bitmap_bucket_number(place).alias("bit_block"), F.bitmap_bit_position(place).alias("bit"))
    blocks = blocks.groupBy("bit_block").agg(F.bitmap_construct_agg("bit").alias("bit_map"))
    byte = F.conv(F.hex(F.substring("bit_map", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("bit_block", F.bitmap_bucket_number(place)).withColumn("bit", F.bitmap_bit_position(place))
    found = placed.join(F.broadcast(blocks), "bit_block", "left").withColumn("bit_byte", byte)
    hit = F.expr("shiftright(bit_byte, cast(bit % 8 as int)) & 1 = 1")
    return found.withColumn("may", F.coalesce(hit, F.lit(False))).drop("bit_block", "bit", "bit_map", "bit_byte")


def meet(rows: DataFrame, narrow: DataFrame, keys: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """Join (inner or left) with a table whose rows have no key twice; keys are not null.

    A short table is broadcast. Of a longer one a bitmap is, so that rows that cannot match stay
    where they are; the others meet it by shuffle, each key dealt to SALTS tasks.
    """
    n = narrow.count()
    if n <= (BROADCAST_ROWS if most is None else most):
        return rows.join(F.broadcast(narrow), keys, how)
    salted = narrow.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def shuffled(part: DataFrame) -> DataFrame:
        return part.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")

    split = may_match(rows, narrow, keys, n)
    if split is None:
        return shuffled(rows)
    met = shuffled(split.where("may").drop("may"))
    if how == "inner":
        return met
    more = {f.name: f.dataType for f in narrow.schema if f.name not in keys}
    return met.unionByName(split.where("not may").drop("may").select("*", *(F.lit(None).cast(t).alias(c) for c, t in more.items())))


def but_for(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose keys (nulls equal nulls) are in gone. A list of at most
    BROADCAST_ROWS is broadcast, so rows stay where they are; of a longer one a bitmap is, and only
    rows that it does not rule out are shuffled."""
    names = [f"gone_{k}" for k in keys]
    listed = gone.select(*(F.col(k).alias(n) for k, n in zip(keys, names)))
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    n = gone.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(listed), same, "left_anti")
    split = may_match(rows, gone, keys, n)
    if split is None:
        return rows.join(listed, same, "left_anti")
    return split.where("not may").drop("may").unionByName(split.where("may").drop("may").join(listed, same, "left_anti"))


def sample_rows(rows: DataFrame, text: str, max_rows: int, max_bytes: int, salt: str, turns: str | None = None) -> list[Row]:
    """A bounded sample of distinct rows, whole, on the driver: at most max_rows rows and max_bytes
    bytes of text, in the order of a digest; with `turns`, the first row of every value of that
    column, then the second ones, and so on. A text that does not fit what is left is passed over;
    equal rows count once. The narrow pass moves digests and lengths only, and brings at most
    4 * max_rows of them; the second one brings the chosen rows."""
    tagged = rows.select("*", F.xxhash64(F.lit(salt), *map(named, rows.columns)).alias("digest"), F.octet_length(text).alias("bytes"))
    narrow, order = tagged.select(*([turns] if turns else []), "digest", "bytes"), ["digest"]
    if turns:
        # The first of each of many shares, then of these: no task holds all rows of a common value.
        share = F.pmod(F.hash("digest"), F.lit(SHARES))
        for by in ([turns, share], [turns]):
            nth = F.row_number().over(Window.partitionBy(*by).orderBy("digest"))
            narrow = narrow.withColumn("nth", nth).where(F.col("nth") <= max_rows)
        order = ["nth", "digest"]
    left, chosen = max_bytes, {}
    for r in narrow.select(*order, "bytes").orderBy(*order).limit(4 * max_rows).collect():
        if len(chosen) < max_rows and r.digest not in chosen and r.bytes <= left:
            chosen[r.digest] = len(chosen)
            left -= r.bytes
    if not chosen:
        return []
    found = tagged.where(F.expr(f"digest in ({', '.join(f'{d}L' for d in chosen)})")).dropDuplicates(["digest"]).collect()
    return sorted(found, key=lambda r: chosen[r.digest])


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo 4; remainder 2 is held out of all learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
