"""Statuses, comments, notes on slides and the nested report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioqc.functions import text as X


def rule_status(manual: Column, n_findings: Column) -> Column:
    return F.when(manual, "manual_review").when(n_findings > 0, "findings").otherwise("ok")


def model_status(manual: Column, n_findings: Column) -> Column:
    return F.when(n_findings > 0, "findings").when(manual, "manual_review").otherwise("ok")


def counts_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("n"))


def summed_up(results: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: slides, slides for manual review, and the counts by type as JSON with sorted names."""
    slides = results.agg(F.count("*").alias("slide_count"), F.count_if(F.col("status") == "manual_review").alias("manual_review_count"))
    counts = counts_by_type(findings).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n"))))).alias("counts_by_type"))
    both = slides.withColumn("counts_by_type", F.lit(None).cast("string")).unionByName(counts, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def numbered(findings: DataFrame, *order: str) -> DataFrame:
    return findings.withColumn("finding_id", F.row_number().over(Window.partitionBy("slide").orderBy(*(order or ("ord",)))).cast("bigint"))


def mean_confidence(findings: DataFrame, kept: Column) -> DataFrame:
    """slide, mean_confidence of the findings for which kept holds; 0 if there is none."""
    return findings.groupBy("slide").agg(F.coalesce(F.avg(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"))


def union_boxes(findings: DataFrame) -> DataFrame:
    """slide and the box around all its findings."""
    b = F.col("bbox")
    return findings.groupBy("slide").agg(F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1")).alias("bbox"))


def with_findings_count(slides: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """slides with the number of their findings, joined by position."""
    n = findings.groupBy(*keys).agg(F.count("*").alias("n"))
    return slides.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def comments(results: DataFrame) -> DataFrame:
    """summary, bullets and note of rows with raw_summary, raw_note, raw_bullets, messages and
    types (of the kept findings); all are null or empty where nothing is kept."""
    none = F.size("messages") == 0
    summary = F.coalesce(said(F.col("raw_summary"), F.col("raw_note")), F.lit(X.REVIEW_TITLE))
    kept = X.first_of_each(X.kept_bullets(given_bullets(F.col("raw_bullets")), F.array_contains("types", "wrong_color")))
    bullets = F.when(F.size(kept) > 0, kept).otherwise(given_bullets(F.col("messages")))
    out = results.withColumn("summary", F.when(~none, summary)).withColumn("bullets", F.when(none, F.array().cast("array<string>")).otherwise(bullets))
    return out.withColumn("note", X.note_text(F.col("summary"), F.col("bullets")))


def said(summary: Column, note: Column) -> Column:
    return F.coalesce(X.non_blank(summary), X.non_blank(note))


def given_bullets(bullets: Column) -> Column:
    return F.filter(F.transform(F.coalesce(bullets, F.array().cast("array<string>")), lambda b: F.trim(b)), lambda b: b.isNotNull() & (b != ""))


def merged_comments(results: DataFrame) -> DataFrame:
    """summary, bullets and note of two results on a slide, a general one and one on text.

    Rows have general_summary, general_note, general_bullets, general_types (of its kept findings),
    the same for text_ but types, text_kept, and messages of all findings.
    """
    general = F.size("general_types") > 0
    first = F.when(general, said(F.col("general_summary"), F.col("general_note")))
    second = F.when(F.col("text_kept"), said(F.col("text_summary"), F.col("text_note")))
    none = F.array().cast("array<string>")
    mine = F.when(general, X.kept_bullets(given_bullets(F.col("general_bullets")), F.array_contains("general_types", "wrong_color"))).otherwise(none)
    other = F.when(F.col("text_kept"), given_bullets(F.col("text_bullets"))).otherwise(none)
    bullets = X.first_of_each(F.concat(mine, other))
    bullets = F.when(F.size(bullets) > 0, bullets).otherwise(given_bullets(F.col("messages")))
    out = results.withColumn("bullets", bullets)
    summary = F.when(first.isNotNull() & second.isNotNull() & (first != second), X.REVIEW_TITLE).otherwise(F.coalesce(first, second, F.when(F.size("bullets") > 0, X.REVIEW_TITLE)))
    listed = F.transform("bullets", lambda b: F.concat(F.lit("- "), b))
    note = F.array_join(F.concat(F.when(F.col("summary").isNotNull(), F.array("summary")).otherwise(none), listed), "\n")
    return out.withColumn("summary", summary).withColumn("note", X.non_blank(note))


def slide_notes(results: DataFrame, width: int, height: int) -> DataFrame:
    """slide, kind, left, top, width, height and lines of the note that a slide gets, if any.

    Slides with findings get a summary (or the note's first line) and bullets (or the note), in a
    box that grows with the bullets; slides for manual review get a pill with the note. results
    has slide, status, summary, bullets, note.
    """
    bullets = given_bullets(F.col("bullets"))
    summary = F.coalesce(X.non_blank(F.col("summary")), F.trim(F.split_part(F.trim("note"), F.lit("\n"), F.lit(1))))
    has_note = F.coalesce(F.col("note"), F.lit("")) != ""
    findings = (F.col("status") == "findings") & ((F.coalesce(F.col("summary"), F.lit("")) != "") | (F.size(F.coalesce("bullets", F.array().cast("array<string>"))) > 0) | has_note)
    manual = (F.col("status") == "manual_review") & has_note
    kind = F.when(findings, "summary").when(manual, "manual_review")
    mark = F.lit("• ")
    last = F.when(has_note, F.array(F.when(summary.isNotNull(), F.concat(mark, "note")).otherwise(F.col("note")))).otherwise(F.array().cast("array<string>"))
    rest = F.when(F.size(bullets) > 0, F.transform(bullets, lambda b: F.concat(mark, b))).otherwise(last)
    lines = F.when(findings, F.concat(F.filter(F.array(summary), lambda s: s.isNotNull() & (s != "")), rest)).otherwise(F.array("note"))
    # Shares of the slide that a note takes.
    share = F.when(findings, F.least(F.lit(0.42), F.lit(0.10) + F.greatest(F.lit(1), F.size(bullets)) * F.lit(0.045))).otherwise(0.08)
    w = (F.lit(width) * F.when(findings, F.lit(0.42)).otherwise(0.38)).cast("int")
    h = (F.lit(height) * share).cast("int")
    placed = results.select("slide", kind.alias("kind"), w.alias("width"), h.alias("height"), lines.alias("lines")).where("kind is not null")
    left, top = F.lit(width) - F.col("width") - F.lit(int(width * 0.03)), F.lit(height) - F.col("height") - F.lit(int(height * 0.03))
    return placed.select("slide", "kind", left.alias("left"), top.alias("top"), "width", "height", "lines")


def report_json(results: DataFrame, findings: DataFrame) -> DataFrame:
    """job_id, report: the nested report of each job as JSON, slides and findings in order.

    results has job_id, slide_index, page_index, status, alignment_confidence, reference_source,
    candidate_source, summary, bullets, note; findings job_id, slide_index, id, type, severity,
    bbox, message, confidence. Absent values are written as null, so every key is there.
    """
    b = F.col("bbox")
    finding = F.struct("id", "type", "severity", F.array(b["x0"], b["y0"], b["x1"], b["y1"]).alias("bbox"), "message", "confidence")
    listed = findings.groupBy("job_id", "slide_index").agg(F.sort_array(F.collect_list(finding)).alias("findings"))
    joined = results.join(listed, ["job_id", "slide_index"], "left")
    none = F.array().cast(listed.schema["findings"].dataType)
    slide = F.struct(
        F.col("slide_index").alias("slideIndex"), F.col("page_index").alias("pageIndex"), "status", F.col("alignment_confidence").alias("alignmentConfidence"),
        F.col("reference_source").alias("referenceSource"), F.col("candidate_source").alias("candidateSource"), "summary", "bullets", "note", F.coalesce("findings", none).alias("findings"),
    )
    counts = findings.groupBy("job_id", "type").agg(F.count("*").alias("n")).groupBy("job_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("counts"))
    whole = joined.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "manual_review").alias("manual"), F.sort_array(F.collect_list(slide)).alias("slides"))
    empty = F.create_map().cast("map<string,bigint>")
    report = F.struct(F.col("n").alias("slideCount"), F.col("manual").alias("manualReviewCount"), F.coalesce("counts", empty).alias("countsByType"), "slides")
    return whole.join(counts, "job_id", "left").select("job_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))
