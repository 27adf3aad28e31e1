"""Pages and slides joined by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def place(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Full outer join on (job_id, page_index) with the status of each position."""
    r = reference.select("job_id", "page_index", F.lit(True).alias("has_reference"))
    c = candidate.select("job_id", "page_index", F.lit(True).alias("has_candidate"))
    status = F.when(F.col("has_reference") & F.col("has_candidate"), "placed").when(F.col("has_candidate"), "no_matching_pdf_page").otherwise("extra_pdf_page")
    return r.join(c, ["job_id", "page_index"], "full_outer").select("job_id", "page_index", F.coalesce(status, F.when(F.col("has_candidate"), "no_matching_pdf_page").otherwise("extra_pdf_page")).alias("status"))


# What a placement says of itself.
MESSAGES = {
    "placed": "Prepared the PDF page as a full-slide reference image",
    "extra_pdf_page": "Appended unmatched PDF page as a new reference slide",
    "no_matching_pdf_page": "No matching PDF page for this slide",
}


def described(placements: DataFrame) -> DataFrame:
    """placements with the slide and the page that they name (null: none) and their message."""
    said = F.create_map(*(F.lit(v) for pair in MESSAGES.items() for v in pair))[F.col("status")]
    slide = F.when(F.col("status") != "extra_pdf_page", F.col("page_index"))
    page = F.when(F.col("status") != "no_matching_pdf_page", F.col("page_index"))
    return placements.withColumn("candidate_slide_index", slide).withColumn("reference_page_index", page).withColumn("message", said)


def with_image(placements: DataFrame) -> DataFrame:
    """Placed and extra pages that have an image."""
    return placements.where(F.col("image").isNotNull() & F.col("status").isin("placed", "extra_pdf_page"))


def page_totals(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Pages to process for each job: the larger of the two counts."""
    a = reference.groupBy("job_id").agg(F.count("*").alias("n_reference"))
    b = candidate.groupBy("job_id").agg(F.count("*").alias("n_candidate"))
    return a.join(b, "job_id", "full_outer").fillna(0, ["n_reference", "n_candidate"]).withColumn("total", F.greatest("n_reference", "n_candidate"))


def with_default(pages: DataFrame, layouts: DataFrame, column: str, default) -> DataFrame:
    """Pages with a looked-up column, or the default where there is no layout."""
    return pages.join(layouts.select("job_id", "page_index", column), ["job_id", "page_index"], "left").withColumn(column, F.coalesce(column, F.lit(default)))


def deck_order(placements: DataFrame) -> DataFrame:
    """Each slide, then its reference page; pages without a slide last. position counts from 1."""
    slides = placements.where("status <> 'extra_pdf_page'").select("job_id", "page_index", F.lit("original").alias("kind"), F.lit(0).alias("late"), F.lit(0).alias("part"))
    references = placements.where("status = 'placed'").select("job_id", "page_index", F.lit("reference").alias("kind"), F.lit(0).alias("late"), F.lit(1).alias("part"))
    extras = placements.where("status = 'extra_pdf_page'").select("job_id", "page_index", F.lit("extra").alias("kind"), F.lit(1).alias("late"), F.lit(1).alias("part"))
    order = Window.partitionBy("job_id").orderBy("late", "page_index", "part")
    return slides.union(references).union(extras).withColumn("position", F.row_number().over(order).cast("bigint")).select("job_id", "position", "kind", "page_index")


def insert_actions(placements: DataFrame) -> DataFrame:
    """INSERT actions in reverse slide order, then APPEND actions in page order."""
    ins = placements.where("status = 'placed'").select("job_id", "page_index", F.lit("INSERT").alias("action"), (-F.col("page_index")).alias("k"), F.lit(0).alias("late"))
    app = placements.where("status = 'extra_pdf_page'").select("job_id", "page_index", F.lit("APPEND").alias("action"), F.col("page_index").alias("k"), F.lit(1).alias("late"))
    order = Window.partitionBy("job_id").orderBy("late", "k")
    return ins.union(app).withColumn("ord", F.row_number().over(order).cast("bigint")).select("job_id", "ord", "action", "page_index")


def missing_page_findings(placements: DataFrame) -> DataFrame:
    """The manual-review finding of every slide without a reference page."""
    return placements.where("status = 'no_matching_pdf_page'").select(
        "job_id", "page_index", F.lit("manual_review").alias("slide_status"), F.lit("missing_content").alias("type"),
        *(F.lit(v).alias(n) for v, n in zip((0.03, 0.03, 0.97, 0.97), ("x0", "y0", "x1", "y1"))), F.lit(1.0).alias("confidence"),
    )
