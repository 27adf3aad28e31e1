"""Rule-based review of pages: text matches, drift, line breaks, regions, dedup and status.

A page is a slide. Paragraphs have slide, ord, bbox, n_lines and blank (no text once normalised);
matches slide, ref_ord, cand_ord (null: none), score; pages slide, angle, target_w, target_h,
off_x, off_y, scaled_w, scaled_h, similarity, total_characters, ocr, ocr_confidence; regions slide,
kind (missing, geometry or color), ord, bbox, area_ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioqc.functions import fuzzy
from folioqc.functions import geometry as G
from folioqc.functions import text as X
from folioqc.operators import folds, report, spatial
from folioqc.params import DEFAULT, Params

# Messages and notes.
MISSING_TEXT = "Text or content from the PDF appears to be missing on this slide."
WRONG_PLACE = "Matched content is in the wrong size or position compared with the PDF reference."
LOW_ALIGNMENT = "Page alignment confidence is too low for automated QC."
LOW_OCR = "Reference OCR confidence is too low for reliable automated QC."
VISUAL_ONLY = "Visual-only QC was used because the reference PDF does not expose text."
#: Fixed values for regions: finding, severity, base and slope of the confidence, its ceiling, message.
REGIONS = {
    "missing": ("missing_content", "high", 0.72, 18, 0.95, "A visual element from the PDF appears to be missing on this slide."),
    "geometry": ("size_position_issue", "medium", 0.70, 16, 0.93, "An element appears to be in the wrong size or position compared with the PDF reference."),
    "color": ("wrong_color", "medium", 0.72, 16, 0.92, "An element appears to use the wrong color compared with the PDF reference."),
}
_PLACE = ("angle", "target_w", "target_h", "off_x", "off_y", "scaled_w", "scaled_h")
#: Findings come in phases, and within one by number.
TEXT, MATCHES, PHASES = 0, 1, {"missing": 2, "geometry": 3, "color": 4}


def matches_of(reference: DataFrame, candidate: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """slide, ref_ord, cand_ord, score of paragraphs (slide, ord, text)."""
    page = lambda d: d.select(F.col("slide").alias("job_id"), F.lit(0).alias("page_index"), "ord", "text")
    return fuzzy.greedy_matches(page(reference), page(candidate), p.paragraph_match).select(F.col("job_id").alias("slide"), "ref_ord", "cand_ord", "score")


def mapped(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Reference paragraphs with their boxes where the alignment puts them on the slide."""
    return paragraphs.join(pages.select("slide", *_PLACE).hint("merge"), "slide").withColumn("bbox", G.map_box(F.col("bbox"), *map(F.col, _PLACE))).drop(*_PLACE)


def text_findings(matches: DataFrame, reference: DataFrame, candidate: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Missing text, line breaks and drift; reference boxes are mapped ones. A line break comes
    before drift; scores in between give nothing."""
    r = reference.select("slide", F.col("ord").alias("ref_ord"), F.col("bbox").alias("ref_box"), F.col("n_lines").alias("ref_lines"), F.col("blank").alias("ref_blank"))
    c = candidate.select("slide", F.col("ord").alias("cand_ord"), F.col("bbox").alias("cand_box"), F.col("n_lines").alias("cand_lines"), F.col("blank").alias("cand_blank"))
    j = matches.join(r.hint("merge"), ["slide", "ref_ord"]).join(c.hint("merge"), ["slide", "cand_ord"], "left")
    missing = F.col("cand_ord").isNull()
    breaks = (F.col("score") >= p.line_break_match) & (F.col("cand_lines") > F.col("ref_lines")) & ~F.col("ref_blank") & ~F.col("cand_blank")
    drifts = (F.col("score") >= p.strong_match) & G.drifts(F.col("ref_box"), F.col("cand_box"))
    kind = F.when(missing, "missing_content").when(breaks, "line_break_issue").when(drifts, "size_position_issue")
    confidence = (
        F.when(missing, F.lit(p.missing_text_confidence))
        .when(breaks, F.least(F.lit(p.line_break_most), p.line_break_base + (F.col("cand_lines") - F.col("ref_lines")) * p.line_break_step))
        .otherwise(F.least(F.lit(p.drift_most), F.greatest(F.col("score"), F.lit(p.drift_least))))
    )
    box = F.when(missing, F.col("ref_box")).when(breaks, F.col("cand_box")).otherwise(G.union_box(F.col("ref_box"), F.col("cand_box")))
    wraps = F.format_string("Paragraph wraps into %d lines on the slide versus %d lines in the PDF.", F.col("cand_lines"), F.col("ref_lines"))
    message = F.when(missing, MISSING_TEXT).when(breaks, wraps).otherwise(WRONG_PLACE)
    phase = F.when(missing, TEXT).otherwise(MATCHES)
    return j.select("slide", phase.alias("phase"), F.col("ref_ord").cast("bigint").alias("ord"), kind.alias("type"), F.when(missing, "high").otherwise("medium").alias("severity"), G.clamp(confidence).alias("confidence"), message.alias("message"), box.alias("bbox")).where("type is not null")


def region_findings(regions: DataFrame, reference: DataFrame, found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Findings of regions that text does not explain: missing regions that no mapped reference box
    covers, then geometry and colour regions that no earlier finding of any kind covers."""
    missing = spatial.uncovered(regions.where("kind = 'missing'"), reference, p.missing_overlap)
    late = F.when(F.col("kind") == "missing", PHASES["missing"]).when(F.col("kind") == "geometry", PHASES["geometry"]).otherwise(PHASES["color"])
    rest = missing.unionByName(regions.where("kind <> 'missing'")).select("slide", late.alias("phase"), F.col("ord").cast("bigint").alias("ord"), (F.col("kind") == "missing").alias("fixed"), "bbox", "kind", "area_ratio")
    before = found.select("slide", "phase", "ord", F.lit(True).alias("fixed"), "bbox")
    kept = folds.suppress_covered(before.unionByName(rest.select("slide", "phase", "ord", "fixed", "bbox")), p.region_overlap, ("phase", "ord"))
    joined = kept.select("slide", "phase", "ord").join(rest.hint("merge"), ["slide", "phase", "ord"])

    def by_kind(value) -> Column:
        out = None
        for name, row in REGIONS.items():
            out = F.when(F.col("kind") == name, value(row)) if out is None else out.when(F.col("kind") == name, value(row))
        return out

    confidence = by_kind(lambda r: F.least(F.lit(r[4]), r[2] + F.col("area_ratio") * r[3]))
    return joined.select("slide", "phase", "ord", by_kind(lambda r: F.lit(r[0])).alias("type"), by_kind(lambda r: F.lit(r[1])).alias("severity"), G.clamp(confidence).alias("confidence"), by_kind(lambda r: F.lit(r[5])).alias("message"), "bbox")


def findings(matches: DataFrame, reference: DataFrame, candidate: DataFrame, regions: DataFrame, pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """slide, finding_id, type, severity, confidence, message, bbox of every page's kept findings.
    Identifiers count all findings in the order in which they arise; dropped ones leave gaps.

    Text findings and the numbered ones are read several times, so each is worked out once and cut
    by a reliable checkpoint. No side of a join is broadcast: all grow with the pages."""
    folds.ensure_checkpoints(matches.sparkSession)
    reference = mapped(reference, pages)
    text = text_findings(matches, reference, candidate, p).checkpoint()
    everything = report.numbered(text.unionByName(region_findings(regions, reference, text, p)), "phase", "ord").checkpoint()
    kept = folds.keep_first(everything.select("slide", "type", F.col("finding_id").alias("ord"), "bbox"), p.dedup_rule).select("slide", F.col("ord").alias("finding_id"))
    return everything.drop("phase", "ord").join(kept.hint("merge"), ["slide", "finding_id"])


def results(pages: DataFrame, found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """slide, n_findings, status, note, alignment_confidence of pages."""
    low = F.col("similarity") < p.min_alignment
    bad = F.col("ocr") & (F.col("ocr_confidence") < p.min_ocr_confidence)
    counted = report.with_findings_count(pages, found, ["slide"])
    note = F.when(bad, LOW_OCR).when(low, LOW_ALIGNMENT).when((F.col("total_characters") == 0) & ~F.col("ocr"), VISUAL_ONLY)
    return counted.select("slide", F.col("n").alias("n_findings"), report.rule_status(low | bad, F.col("n")).alias("status"), note.alias("note"), F.col("similarity").alias("alignment_confidence"))


def blank(text: Column) -> Column:
    return X.normalised(text) == ""
