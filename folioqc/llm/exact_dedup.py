"""Exact deduplication by content-defined chunk recipes.

Each normalised text is cut where its bytes say so, in any script; a chunk has a 64-bit digest and
the SHA-256 of its content, and the ordered chunks are the document's recipe. Chunks are
deduplicated to verified identifiers: a digest that stands for one SHA-256 over all documents is
its own identifier, one that stands for several is told apart by it. Documents are equal when
their ordered lists of identifiers are. Texts are read once, where they are: only digests travel.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioqc.llm.common import BROADCAST_ROWS, but_for, cut, packed, scratch, unpacked

SPACE = "[\\x20\\x09-\\x0D]+"
#: Least and greatest bytes of a chunk, and the share of byte values in each class of a cut.
LEAST, MOST, CLASS_SHARE = 512, 8192, 0.3
#: Groups of at least so many rows are joined apart from the others, and tasks that one is dealt to.
LARGE_GROUP, SALTS = 256, 16


def _byte_class(step: int) -> str:
    """A regular expression class of the byte values whose multiple by an odd step, modulo 256, is low."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if b * step % 256 < 256 * CLASS_SHARE) + "]"


#: A chunk ends after LEAST bytes where three bytes in a row fall in their classes (about one place in
#: forty, whatever the script, as the classes are spread over all byte values), and at MOST at the latest.
CHUNK = f"(?s).{{{LEAST},{MOST - 3}}}?{''.join(map(_byte_class, (167, 101, 59)))}|.{{1,{MOST}}}"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE, " ")


def chunks(norm: Column) -> Column:
    """The chunks of a text, as strings of one character for each byte."""
    return F.regexp_extract_all(F.decode(norm.cast("binary"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def digest(chunk: Column) -> Column:
    return F.xxhash64(chunk, F.length(chunk))


def recipes(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text_sha256, ids (digests of the chunks in order) and their SHA-256."""
    norm = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised().alias("norm"))
    listed = norm.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    return listed.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "text_sha256",
        F.transform("chunks", digest).alias("ids"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c.cast("binary"), 256))).alias("shas"),
    )


def _verified(table: DataFrame) -> DataFrame:
    """table with ids verified: where a digest stands for several contents, over all documents, the
    list of a document that has it is followed by the number of each content in its digest."""
    single = table.select(F.explode(F.arrays_zip("ids", "shas")).alias("c")).select("c.ids", "c.shas")
    clashes = single.groupBy("ids").agg(F.min("shas").alias("lo"), F.max("shas").alias("hi")).where("lo <> hi").select("ids")
    number = F.dense_rank().over(Window.partitionBy("ids").orderBy("shas"))
    clashes = cut(single.join(clashes, "ids", "left_semi").distinct().select("ids", "shas", number.alias("variant")), "clashes")
    if clashes.isEmpty():
        return table
    placed = table.select("row_id", F.posexplode(F.arrays_zip("ids", "shas")).alias("pos", "c")).select("row_id", "pos", "c.ids", "c.shas")
    told = placed.join(clashes, ["ids", "shas"], "left").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("variant", F.lit(0)).cast("bigint").alias("v")))).alias("v"), F.count("variant").alias("n"))
    hit = told.where("n > 0").select("row_id", F.col("v.v").alias("variants"))
    return table.join(hit, "row_id", "left").withColumn("ids", F.when(F.col("variants").isNull(), F.col("ids")).otherwise(F.concat("ids", "variants"))).drop("variants")


def _with_groups(table: DataFrame, groups: DataFrame) -> DataFrame:
    """table with keep_id, keep_row and group_size of the group of its ids, if there is one.

    A short list of groups is broadcast. Of a long one the large groups are (they are at most one
    for LARGE_GROUP rows), or are dealt to SALTS tasks each; small ones meet their rows by shuffle.
    """

    def count(g: DataFrame) -> int:
        return g.agg(F.coalesce(F.sum(F.size("ids") + 4), F.lit(0))).first()[0]

    if count(groups) <= BROADCAST_ROWS:
        return table.join(F.broadcast(groups), "ids", "left")
    large, small = groups.where(F.col("group_size") >= LARGE_GROUP), groups.where(F.col("group_size") < LARGE_GROUP)
    if count(large) <= BROADCAST_ROWS:
        first = table.join(F.broadcast(large), "ids", "left")
    else:
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        first = table.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int")).join(salted, ["ids", "salt"], "left").drop("salt")
    done = first.where("group_size is not null")
    return done.unionByName(first.where("group_size is null").select(table.columns).join(small, "ids", "left"))


def equal_texts(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Null texts count as empty and all empty texts are equal. Of rows that share a doc_id and text
    exactly one is kept. A null doc_id loses to any number. Only doc_id and text are read, so
    other columns may have any name. No row, no output. Texts of any length are read whole.
    """
    table = cut(recipes(docs), "recipes")
    verified = _verified(table)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id")))
    groups = cut(
        verified.groupBy("ids").agg(first.alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
        .select("ids", F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row"), "group_size"),
        "groups",
    )
    out = _with_groups(verified.drop("shas"), groups)
    grouped = F.col("group_size").isNotNull()
    return out.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(grouped, F.col("keep_row") == F.col("row_id")).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, whole. Of equal texts the smallest doc_id stays.

    Rows that repeat a doc_id and text are one document and come out once. Columns of docs may
    have any names. Documents stay where they are unless the list of dropped ones is too long to
    broadcast.
    """
    with scratch() as keep:
        judged = equal_texts(docs).where("not kept").select("doc_id", F.unhex("text_sha256").alias("sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again"))
        dropped = keep(cut(judged.distinct(), "dropped"))
    rows = packed(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("sha"))
    stay = but_for(rows, dropped.where("not again"), ["doc_id", "sha"])
    again = dropped.where("again")
    if not again.isEmpty():
        # Of rows with one identifier and text, one is left; they are one document.
        repeated = again.select(F.col("doc_id").alias("d"), F.col("sha").alias("s"))
        twice = stay.join(repeated, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s")), "left_semi").dropDuplicates(["doc_id", "sha"])
        stay = but_for(stay, again, ["doc_id", "sha"]).unionByName(twice)
    return unpacked(stay, docs.columns)


