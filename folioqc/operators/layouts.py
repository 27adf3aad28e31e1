"""Text layouts of pages: lines, paragraphs and their measures, native or recognised.

Tables are keyed by (job_id, page_index). Lines have para_ord (null outside of paragraphs),
line_ord, text, bbox, confidence; paragraphs para_ord, text, bbox, confidence, n_lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioqc.functions import geometry as G
from folioqc.functions import text as X
from folioqc.params import DEFAULT

KEYS = ["job_id", "page_index"]
SEGMENTS = "array<struct<start: bigint, end: bigint>>"


#: Fixed value: white space as str.strip() sees it.
SPACES = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def stripped(t: Column) -> Column:
    """Without white space, of any kind, at both ends; only the ends are looked at."""
    return F.btrim(t, F.lit(SPACES))


def lines_of_spans(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of text blocks: the stripped concatenation of their spans, blank ones left out.

    spans has job_id, page_index, block, block_type, line, span, text and the line's box in page
    units (null: the whole page); pages has page_w and page_h. Only blocks of type 0 are text. Spans
    are dealt out by page once: lines, paragraphs and a page's items need no more than that.
    """
    dealt = spans.where("block_type = 0").repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)
    w, h = F.greatest("page_w", F.lit(1.0)), F.greatest("page_h", F.lit(1.0))
    joined = dealt.groupBy(*KEYS, "block", "line").agg(F.sort_array(F.collect_list(F.struct("span", F.coalesce("text", F.lit("")).alias("t")))).alias("s"), F.first("bbox").alias("raw"))
    said = joined.select(*KEYS, F.col("block").alias("para_ord"), F.col("line").alias("line_ord"), stripped(F.array_join(F.col("s.t"), "")).alias("text"), "raw").where("text <> ''")
    return said.join(pages, KEYS).select(*KEYS, "para_ord", "line_ord", "text", G.scaled(F.col("raw"), w, h).alias("bbox"), F.lit(1.0).alias("confidence"))


def paragraphs_of_lines(lines: DataFrame) -> DataFrame:
    """Each block's lines joined by spaces, with the box around them."""
    b = F.col("bbox")
    around = F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))
    listed = lines.groupBy(*KEYS, "para_ord").agg(F.sort_array(F.collect_list(F.struct("line_ord", "text"))).alias("l"), around.alias("bbox"))
    return listed.select(*KEYS, "para_ord", stripped(F.array_join(F.col("l.text"), " ")).alias("text"), "bbox", F.lit(1.0).alias("confidence"), F.size("l").alias("n_lines"))


def anchored_text(items: DataFrame, texts: DataFrame) -> DataFrame:
    """items (job_id, page_index, item, segments: array<struct<start, end>>) with the stripped text
    that the segments cut out of the page's text, in order; ends past the text stop there."""
    more = [c for c in items.columns if c not in (*KEYS, "segments")]
    known = F.filter(F.coalesce("segments", F.array().cast(SEGMENTS)), lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    listed = items.groupBy(*KEYS).agg(F.collect_list(F.struct(*more)).alias("rows"), F.collect_list(known).alias("segments"))
    joined = listed.join(texts.select(*KEYS, F.col("text").alias("whole")).hint("merge"), KEYS, "left")
    flat = F.flatten("segments")
    cut = pieces(F.col("whole"), F.transform("segments", F.size), flat["start"], flat["end"])
    said = joined.select(*KEYS, F.explode(F.arrays_zip("rows", cut.alias("texts"))).alias("r"))
    return said.select(*KEYS, *(F.col("r.rows")[c].alias(c) for c in more), stripped(F.col("r.texts")).alias("text"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def pieces(whole: pd.Series, sizes: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """For each item of a page what its segments (as many as sizes says, one item's after another's) cut
    out of the text, joined. A page's text is met once with all its items: one copy for each item
    would grow with the square of its length."""
    found = []
    for text, counts, lo, hi in zip(whole, sizes, starts, ends):
        cuts = iter([(text or "")[a : a + max(0, b - a)] for a, b in zip(map(int, lo), map(int, hi))])
        found.append(["".join(next(cuts) for _ in range(n)) for n in counts])
    return pd.Series(found)


def recognised(lines: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and paragraphs of a recogniser's rows (job_id, page_index, item, text, bbox, confidence):
    blank ones left out, missing confidence by default, a paragraph's lines those that cover enough
    of it. On pages without paragraphs each line is one."""
    known = lambda df: df.where(stripped(F.col("text")) != "").withColumn("confidence", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(DEFAULT.ocr_confidence)))
    l, p = known(lines), known(paragraphs)
    hit = (F.col("p.job_id") == F.col("l.job_id")) & (F.col("p.page_index") == F.col("l.page_index")) & (G.overlap_ratio(F.col("p.bbox"), F.col("l.bbox")) >= DEFAULT.line_overlap)
    counted = p.alias("p").join(l.select(*KEYS, "item", "bbox").alias("l"), hit, "left").groupBy("p.job_id", "p.page_index", F.col("p.item").alias("item")).agg(F.count("l.item").cast("int").alias("n_lines"))
    own = p.join(counted, [*KEYS, "item"]).select(*KEYS, F.col("item").alias("para_ord"), "text", "bbox", "confidence", "n_lines")
    alone = l.join(p.select(*KEYS).distinct(), KEYS, "left_anti").select(*KEYS, F.col("item").alias("para_ord"), "text", "bbox", "confidence", F.lit(1).alias("n_lines"))
    return l.select(*KEYS, F.lit(None).cast("bigint").alias("para_ord"), F.col("item").alias("line_ord"), "text", "bbox", "confidence"), own.unionByName(alone)


def measures(pages: DataFrame, paragraphs: DataFrame, ocr: bool) -> DataFrame:
    """pages (job_id, page_index) with total_characters (without white space), n_paragraphs,
    average_confidence (0 without paragraphs) and extracted_with_ocr."""
    found = paragraphs.groupBy(*KEYS).agg(F.sum(X.solid_length(F.col("text"))).cast("bigint").alias("c"), F.count("*").alias("n"), F.avg("confidence").alias("a"))
    joined = pages.join(found, KEYS, "left")
    return joined.select(*pages.columns, F.coalesce("c", F.lit(0)).alias("total_characters"), F.coalesce("n", F.lit(0)).alias("n_paragraphs"), F.coalesce("a", F.lit(0.0)).alias("average_confidence"), F.lit(ocr).alias("extracted_with_ocr"))


def needs_ocr(layouts: DataFrame, sparse: int = DEFAULT.sparse_text) -> DataFrame:
    return layouts.where((F.col("total_characters") < sparse) | (F.col("n_paragraphs") == 0))


def chosen(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Measures of each page: those of recognition where the native text is sparse and recognition
    found as much or more, else the native ones."""
    wanted = needs_ocr(native).select(*KEYS, F.col("total_characters").alias("least"))
    better = ocr.join(wanted, KEYS).where(F.col("total_characters") >= F.col("least")).drop("least")
    return native.join(better.select(*KEYS), KEYS, "left_anti").unionByName(better)


def visual_only(layouts: DataFrame) -> Column:
    """If a reference page exposes no text, and none was recognised."""
    return (F.col("total_characters") == 0) & ~F.col("extracted_with_ocr")


def text_items(lines: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """job_id, page_index, ord, text, bbox: a page's lines if it has any, blank or not, else its
    paragraphs; blank ones are left out after that choice."""
    zero = F.lit(0).cast(lines.schema["line_ord"].dataType)
    l = lines.select(*KEYS, F.lit(True).alias("line"), F.struct("para_ord", "line_ord").alias("at"), "text", "bbox")
    p = paragraphs.select(*KEYS, F.lit(False).alias("line"), F.struct(F.col("para_ord"), zero.alias("line_ord")).alias("at"), "text", "bbox")
    # A page's rows meet once, where any of them tells if there are lines.
    page = Window.partitionBy(*KEYS)
    has = l.unionByName(p).withColumn("lines", F.max("line").over(page)).where(F.col("line") == F.col("lines"))
    solid = has.where(stripped(F.col("text")) != "")
    return solid.select(*KEYS, (F.row_number().over(page.orderBy("at")) - 1).alias("ord"), "text", "bbox")


def text_regions(items: DataFrame, *more: str) -> DataFrame:
    """Boxes of non-blank items, in order, with more of their columns."""
    return items.select(*KEYS, "ord", *more, G.ordered(F.col("bbox")).alias("bbox"))


def reading_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with its place by top, then left, then given order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("bbox.y0"), F.col("bbox.x0"), "ord")).cast("bigint"))


def top_items(df: DataFrame, keys: list[str], most: int = DEFAULT.listed_items) -> DataFrame:
    """The first rows in reading order, and how many more there are."""
    total = F.count("*").over(Window.partitionBy(*keys))
    return reading_order(df.withColumn("total", total), keys).where(F.col("place") <= most).withColumn("omitted", F.greatest(F.col("total") - most, F.lit(0))).drop("total")


def listings(pages: DataFrame, items: DataFrame) -> DataFrame:
    """job_id, page_index, listing of every page: its first items with the cell they lie in."""
    line = F.concat(F.lit("- "), G.grid_cell(F.col("bbox")), F.lit(": "), X.trimmed(F.col("text")))
    top = top_items(items, KEYS).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("l"), F.max("omitted").alias("omitted"))
    more = F.when(F.col("omitted") > 0, F.concat(F.lit("\n- ... "), F.col("omitted").cast("string"), F.lit(" more text blocks omitted"))).otherwise("")
    joined = pages.select(*KEYS).join(top.select(*KEYS, F.concat(F.array_join(F.col("l.line"), "\n"), more).alias("listing")), KEYS, "left")
    return joined.withColumn("listing", F.coalesce("listing", F.lit("- No extracted text available.")))


#: Fixed value: what stands before a candidate's listing.
CONTEXT = (
    "Supporting candidate-side text extracted from the PPTX file is provided below. Use it to verify small or shaky text regions on the PPTX candidate side only. "
    "Do not assume any PDF text extraction is available.\n\nCandidate PowerPoint text:\n"
)


def text_contexts(listed: DataFrame) -> DataFrame:
    return listed.select(*KEYS, F.concat(F.lit(CONTEXT), "listing").alias("context"))


def discrepancy_lines(found: DataFrame) -> DataFrame:
    """job_id, page_index, lines of discrepancies (job_id, page_index, ord, bbox, label, reference_text, candidate_text)."""
    quoted = lambda n: F.concat(F.lit('="'), X.trimmed(F.col(n), 120), F.lit('"'))
    line = F.concat(F.lit("- "), G.grid_cell(F.col("bbox")), F.lit(" ("), "label", F.lit("): reference"), quoted("reference_text"), F.lit(" | candidate"), quoted("candidate_text"))
    return found.groupBy(*KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def evidence_text(found: DataFrame, most: int = DEFAULT.most_evidence) -> DataFrame:
    """job_id, page_index, nth, text: what is said of each of a page's first discrepancies."""
    n = F.row_number().over(Window.partitionBy(*KEYS).orderBy("ord"))
    said = lambda who, c: F.concat(F.lit(f'{who} reads "'), X.trimmed(F.col(c), 100), F.lit('". '))
    ref, cand = said("Reference", "reference_text"), said("Candidate", "candidate_text")
    both = F.when((F.col("reference_text") != "") & (F.col("candidate_text") != ""), F.concat(ref, cand))
    what = both.when(F.col("candidate_text") != "", F.concat(F.lit("Reference has no matching extracted text item in this region. "), cand)).otherwise(F.concat(ref, F.lit("Candidate has no matching extracted text item in this region. ")))
    tail = F.lit("The next image is the candidate text crop and the image after that is the reference text crop for the matching region.")
    return found.withColumn("nth", n).where(F.col("nth") <= most).select(*KEYS, "nth", F.concat(F.lit("Suspicious text diff "), F.col("nth").cast("string"), F.lit(" ("), "label", F.lit("). "), what, tail).alias("text"))


def unmatched_copies(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """side, keys, norm, nth: copies of a text that the other side does not have as often. Inputs: keys, ord, norm."""
    n = reference.withColumn("side", F.lit("r")).unionByName(candidate.withColumn("side", F.lit("c")))
    nth = n.withColumn("nth", F.row_number().over(Window.partitionBy("side", *keys, "norm").orderBy("ord")).cast("bigint")).drop("ord")
    other = nth.withColumn("side", F.when(F.col("side") == "r", "c").otherwise("r"))
    return nth.join(other, ["side", *keys, "norm", "nth"], "left_anti")


def first_of_equal(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The first row, by ord, of those whose text is equal but for case."""
    keyed = df.withColumn("key", X.casefolded(F.col(text)))
    return keyed.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "key").orderBy("ord"))).where("n = 1").drop("n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
