"""Fonts of a document: grouping, key resolution, character counts and the report.

References are (job_id, page, name, type, embedded, subset), spans (job_id, page, name, chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioqc.functions import text as X


def font_table(refs: DataFrame) -> DataFrame:
    """(job_id, name, type): any embedded, any subset, the sorted pages and the first of them."""
    return refs.groupBy("job_id", "name", "type").agg(
        F.bool_or("embedded").alias("embedded"), F.bool_or("subset").alias("subset"), F.sort_array(F.collect_set("page")).alias("pages"), F.min("page").alias("first_page")
    )


def resolve(spans: DataFrame, fonts: DataFrame) -> DataFrame:
    """Spans with the type of their font: known types before "Unknown", then by name, among fonts
    seen on the span's page or before; a name without any is of type "Unknown"."""
    f = fonts.select(F.col("job_id").alias("j2"), F.col("name").alias("n2"), "type", "first_page")
    seen = (F.col("job_id") == F.col("j2")) & (F.col("name") == F.col("n2")) & (F.col("first_page") <= F.col("page"))
    keys = spans.select("job_id", "name", "page").distinct()
    picked = keys.join(f, seen, "left").groupBy("job_id", "name", "page").agg(F.min_by("type", F.struct((F.col("type") == "Unknown").alias("u"), F.col("type").alias("t"))).alias("type"))
    return spans.join(picked, ["job_id", "name", "page"]).withColumn("type", F.coalesce("type", F.lit("Unknown")))


def usage(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("job_id", "name", "type", "page").agg(F.sum("chars").cast("bigint").alias("chars"))


def page_totals(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """job_id, page, chars of every page (job_id, page), 0 where no span is."""
    sums = spans.groupBy("job_id", "page").agg(F.sum("chars").cast("bigint").alias("chars"))
    return pages.join(sums, ["job_id", "page"], "left").withColumn("chars", F.coalesce("chars", F.lit(0)))


def inspected(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """(job_id, name, type) of all fonts, also those that only spans name: embedded, subset, sorted
    pages of references and spans, and characters by page."""
    used = usage(resolve(spans, font_table(refs)))
    pages = refs.select("job_id", "name", "type", "page", "embedded", "subset", F.lit(0).cast("bigint").alias("chars")).unionByName(
        used.select("job_id", "name", "type", "page", F.lit(False).alias("embedded"), ((F.col("type") == "Unknown") & X.font_is_subset(F.col("name"))).alias("subset"), "chars")
    )
    by_page = pages.groupBy("job_id", "name", "type", "page").agg(F.bool_or("embedded").alias("embedded"), F.bool_or("subset").alias("subset"), F.sum("chars").alias("chars"))
    counted = F.when(F.col("chars") > 0, F.struct("page", "chars"))
    return by_page.groupBy("job_id", "name", "type").agg(
        F.bool_or("embedded").alias("embedded"), F.bool_or("subset").alias("subset"), F.sort_array(F.collect_list("page")).alias("pages"), F.sort_array(F.collect_list(counted)).alias("counts")
    )


def ranked(fonts: DataFrame) -> DataFrame:
    """fonts with their place in the document: embedded ones first, then by small-letter name."""
    order = Window.partitionBy("job_id").orderBy(F.col("embedded").desc(), F.lower("name"), "name", "type")
    return fonts.withColumn("place", F.row_number().over(order).cast("bigint"))


def counted(fonts: DataFrame) -> DataFrame:
    return fonts.groupBy("job_id").agg(F.count("*").alias("fonts"), F.count_if("embedded").alias("embedded_fonts"))


def report_json(fonts: DataFrame, totals: DataFrame) -> DataFrame:
    """job_id, report: counts, characters of each page and the ranked fonts as JSON."""
    font = F.struct("place", "name", F.col("type").alias("fontType"), "embedded", "subset", F.col("pages").alias("pageNumbers"), F.map_from_entries(F.transform("counts", lambda c: F.struct(c["page"].cast("string"), c["chars"]))).alias("pageCharacterCounts"))
    # Maps cannot be sorted; the order is the place's, and there are few fonts in a document.
    listed = ranked(fonts).groupBy("job_id").agg(F.count("*").alias("fontCount"), F.count_if("embedded").alias("embeddedFontCount"), F.collect_list(font).alias("fonts"))
    ordered = F.array_sort("fonts", lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1))
    slim = F.transform(ordered, lambda f: f.dropFields("place"))
    pages = totals.groupBy("job_id").agg(F.count("*").alias("pageCount"), F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("page", "chars"))), lambda p: F.struct(p["page"].cast("string"), p["chars"]))).alias("pageCharacterTotals"))
    return listed.join(pages, "job_id").select("job_id", F.to_json(F.struct("fontCount", "embeddedFontCount", "pageCount", "pageCharacterTotals", slim.alias("fonts"))).alias("report"))
