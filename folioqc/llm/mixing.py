"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / quality, with u from a digest of its identifier,
so reruns agree. Within a source documents are taken in ascending key order: complete epochs
first, then the fraction of a further epoch that the token budget leaves. A prefix sum over all
documents of a source is never made in one task: keys fall in ranges of their logarithm whose
sums are added up first; the range in which a source's budget ends is cut into finer ranges in
the same way, and only the one of these in which it ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioqc.llm.common import BROADCAST_ROWS, cut, packed

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
CAP = 2.0
#: Ranges of keys for each doubling of the key, and finer ranges in each of them. A range holds at
#: most about 0.4 / RANGES of the documents of a source that have the same quality, whatever it is.
RANGES, FINER = 1024, 4096


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def quality_of(text: Column) -> Column:
    """Weight of a document: 1 without symbols, falling to 0.05 as a tenth of it is symbols."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - symbols * F.lit(10.0) / F.greatest(F.length(t), F.lit(1)))


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1], from the first 48 bits of the md5 of the identifier, or of the text without one."""
    seed = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.coalesce(text.cast("string"), F.lit(""))))
    return (F.conv(F.substring(F.md5(seed.cast("binary")), 1, 12), 16, 10).cast("double") + 1.0) / F.lit(float(1 << 48))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with target, by water-filling.

    Sharing the excess again and again by weight ends where every open source gets the same level
    times its weight. Sources sorted by cap / weight are capped up to some point; the level there
    follows from sums before it. The windows run over one row for each source, in one task: the rank
    of a source among all is what the weights are defined by, and sources are far fewer than rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(CAP))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        capped.withColumn("total", F.sum("source_size").over(everything) * F.lit(TOTAL_SHARE))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    )
    # The first source, by cap / weight, whose cap is not reached at its level sets the level.
    open_level = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return summed.withColumn("target", F.least(F.col("cap"), F.coalesce(open_level * F.col("weight"), F.col("cap")))).select("source", "source_size", "target")


def _ends(rows: DataFrame, level: str, budgets: DataFrame) -> DataFrame:
    """budgets (s, budget, before and more; one row for each source) with `end`, the first range of
    the given column in which the sizes of the source's rows, added to before, pass its budget,
    and before moved to where that range begins. A budget that no range passes has a null end."""
    sums = rows.groupBy("source", F.col(level).alias("end")).agg(F.sum("size").alias("range_size"))
    in_source = Window.partitionBy("source").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    listed = sums.withColumn("inside", F.coalesce(F.sum("range_size").over(in_source), F.lit(0)))
    joined = budgets.join(listed, F.col("source").eqNullSafe(F.col("s")), "left")
    past = F.col("before") + F.col("inside") + F.col("range_size") > F.col("budget")
    first = F.min(F.when(past, F.struct("end", (F.col("before") + F.col("inside")).alias("before")))).alias("first")
    kept = [c for c in budgets.columns if c not in ("s", "before")]
    found = joined.groupBy("s", "before", *kept).agg(first)
    return found.select("s", *kept, F.coalesce("first.before", "before").alias("before"), F.col("first.end").alias(f"end_{level}"))


def _per_source(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the one row of their source; short lists are broadcast."""
    return rows.join(F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources, F.col("source").eqNullSafe(F.col("s")), how)


def mix(docs: DataFrame, keep_rows: bool = False, ranges: int = RANGES, finer: int = FINER) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs, chosen for every row of docs, and
    with keep_rows the row itself as a struct `row`.

    taken is size times the complete epochs, plus size for documents chosen for the fraction. The
    budget of the fraction ends at the document that brings the sum nearest to it, so each source
    is within half its largest document of its target. Null texts have size 0; a null source is a
    source of its own; ties in key and repeated rows are ordered by doc_id and size, and every row
    of docs gives one row, whatever its identifier. No row gives no row; long texts are counted
    whole. Rows are written once and meet one row of their source, so nothing is shuffled but sums
    and the rows of the last range of each source.
    """
    keyed = packed(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"),
                   (-F.log(uniform(F.col("doc_id"), F.col("text"))) / quality_of(F.col("text"))).alias("key"))
    at = F.log2(F.greatest("key", F.lit(1e-300))) * F.lit(float(ranges))
    keyed = keyed.withColumn("range", F.floor(at).cast("bigint")).withColumn("fine", F.floor((at - F.floor(at)) * F.lit(float(finer))).cast("bigint"))
    keyed = cut(keyed if keep_rows else keyed.drop("row"), "keys")
    narrow = keyed.select("source", "size", "range", "fine")

    per_source = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    per_source = per_source.withColumn("epochs", epochs).select(
        F.col("source").alias("s"), "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"), F.lit(0).cast("bigint").alias("before")
    )
    coarse = cut(_ends(narrow, "range", per_source), "ranges")
    inside = _per_source(narrow, coarse.select("s", "end_range")).where(F.col("range") == F.col("end_range")).select("source", "size", "fine")
    placed = cut(_ends(inside, "fine", coarse), "finer")

    joined = _per_source(keyed, placed)
    # Of a source without an end all rows are within the budget.
    whole = F.col("end_range").isNull() | (F.col("range") < F.col("end_range")) | ((F.col("range") == F.col("end_range")) & (F.col("end_fine").isNull() | (F.col("fine") < F.col("end_fine"))))
    ending = F.coalesce((F.col("range") == F.col("end_range")) & (F.col("fine") == F.col("end_fine")), F.lit(False))
    decided = joined.where(~ending).withColumn("chosen", whole & (F.col("size") > 0))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    nearer = F.col("so_far") + F.col("size") - F.col("budget") <= F.col("budget") - F.col("so_far")
    split = joined.where(ending).withColumn("so_far", so_far).withColumn("chosen", nearer & (F.col("size") > 0)).drop("so_far")
    taken = (F.col("size") * (F.col("epochs") + F.col("chosen").cast("bigint"))).alias("taken")
    columns = ["doc_id", "source", "size", "source_size", "target", taken, "epochs", "chosen", *(["row"] if keep_rows else [])]
    return decided.unionByName(split).select(*columns)
