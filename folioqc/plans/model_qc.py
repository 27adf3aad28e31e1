"""Review by an injected model: raw findings filtered, deduplicated, numbered and summed up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioqc.operators import folds, report, spatial

ALLOWED = ("missing_content", "extra_content", "wrong_text", "wrong_color")
# The response's schema.
FINDING = "array<struct<type:string,severity:string,message:string,confidence:double,bbox:array<double>>>"
RESULT = f"status string, summary string, bullets array<string>, note string, comparison_confidence double, findings {FINDING}"
STATUSES = ("ok", "findings", "manual_review")
TYPES = (*ALLOWED, "line_break_issue", "size_position_issue")
SEVERITIES = ("high", "medium", "low")
COMPARISON_CONFIDENCE = 0.8


def materialised(findings: DataFrame) -> DataFrame:
    """Allowed types only, messages stripped, confidence within [0, 1]."""
    kept = findings.where(F.col("type").isin(*ALLOWED)).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))
    return kept.withColumn("message", F.trim("message")) if "message" in findings.columns else kept


def reviewed(findings: DataFrame, regions: DataFrame) -> DataFrame:
    """slide, type, finding_id, confidence of what stays of a slide's findings."""
    kept = folds.keep_best(spatial.visual_filter(materialised(findings), regions))
    return report.numbered(kept, "place_ord").select("slide", "type", "finding_id", "ord", "confidence")


def slide_statuses(slides: DataFrame, kept: DataFrame) -> DataFrame:
    """slide, n_findings, status of slides (slide, manual)."""
    counted = report.with_findings_count(slides, kept, ["slide"])
    return counted.select("slide", F.col("n").alias("n_findings"), report.model_status(F.col("manual"), F.col("n")).alias("status"))


def slide_results(responses: DataFrame, found: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that stay, and for each slide its status, comments and confidence.

    responses has slide, status, summary, note, bullets, comparison_confidence; found slide, ord,
    type, confidence, message, bbox."""
    messages = found.select("slide", "ord", F.trim("message").alias("message"))
    kept = reviewed(found, regions).join(messages, ["slide", "ord"])
    per = kept.groupBy("slide").agg(F.transform(F.sort_array(F.collect_list(F.struct("finding_id", "message"))), lambda m: m["message"]).alias("messages"), F.collect_set("type").alias("types"))
    none = F.array().cast("array<string>")
    joined = responses.join(per, "slide", "left").select(
        "slide", F.col("status").alias("said"), "comparison_confidence", F.col("summary").alias("raw_summary"), F.col("note").alias("raw_note"), F.col("bullets").alias("raw_bullets"),
        F.coalesce("messages", none).alias("messages"), F.coalesce("types", none).alias("types"),
    )
    n = F.size("messages")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("comparison_confidence", F.lit(COMPARISON_CONFIDENCE))))
    told = report.comments(joined).select("slide", report.model_status(F.col("said") == "manual_review", n).alias("status"), n.cast("bigint").alias("n_findings"), "summary", "bullets", "note", confidence.alias("alignment_confidence"))
    return kept, told


def image_metadata(width: Column, content: Column) -> Column:
    """What a debug record says of an image: width, bytes and SHA-256 of its content."""
    return F.to_json(F.struct(width.alias("width"), F.octet_length(content).alias("png_bytes"), F.sha2(content, 256).alias("sha256")))


def valid(result: Column) -> Column:
    """If a parsed response fits the schema: its states, types and severities are known, numbers lie
    within bounds, boxes have four sides and no required field is missing."""
    between = lambda c: (c >= 0) & (c <= 1)
    fits = F.forall(
        F.coalesce(result["findings"], F.array().cast(FINDING)),
        lambda f: F.coalesce(f["type"].isin(*TYPES) & F.coalesce(f["severity"], F.lit("medium")).isin(*SEVERITIES) & f["message"].isNotNull() & between(f["confidence"]) & (F.size(f["bbox"]) == 4), F.lit(False)),
    )
    return F.coalesce(result["status"].isin(*STATUSES) & between(F.coalesce(result["comparison_confidence"], F.lit(COMPARISON_CONFIDENCE))) & fits, F.lit(False))


def parsed(answers: DataFrame) -> DataFrame:
    """slide, result, error of answers (slide, json, error): the JSON against RESULT."""
    read = answers.withColumn("result", F.from_json("json", RESULT))
    bad = F.col("error").isNull() & ~valid(F.col("result"))
    return read.select("slide", F.when(F.col("error").isNull() & ~bad, F.col("result")).alias("result"), F.coalesce("error", F.when(bad, F.lit("response does not fit the schema"))).alias("error"))


def failed_pages(answers: DataFrame) -> DataFrame:
    """The manual-review result of every page whose call or response failed."""
    return answers.where("error is not null").select("slide", F.lit("manual_review").alias("status"), F.lit(0.0).alias("alignment_confidence"), F.concat(F.lit("GPT slide comparison failed for this page: "), "error").alias("note"))


def call_model(pages: DataFrame, model: Callable[[dict], str]) -> DataFrame:
    """slide, result, error: the model's JSON for every page row, parsed against RESULT. An error
    of one page, of the call or of the schema, makes that page a manual review and no other."""
    names = pages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for values in pdf.itertuples(index=False):
                try:
                    rows.append((values.slide, model(dict(zip(names, values))), None))
                except Exception as e:
                    rows.append((values.slide, None, str(e)))
            yield pd.DataFrame(rows, columns=["slide", "json", "error"])

    return parsed(pages.mapInPandas(run, "slide long, json string, error string"))
