"""The relations of the comparison, derived from the driver's tables; SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioqc.functions import geometry as G

TYPES = {"view": "missing_content", "click": "extra_content", "purchase": "wrong_text", "error": "wrong_color", "signup": "size_position_issue"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as a shuffle has: a table of few bytes is one file of one task, however
    much work its rows are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pages(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """job_id, page_index, text: the turns of one role, numbered from 0."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == role)
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return turns.select(F.col("conv_id").alias("job_id"), nth.alias("page_index"), "text")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide, ord, type, confidence, bbox from events."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "(-?[0-9]+)", 1).cast("int")
    x0, y0 = (k % 10) / 10.0, F.floor(k / 10) / 10.0
    x1 = F.least(F.lit(1.0), x0 + (3 + 5 * (F.col("event_id") % 4)) / 100.0)
    y1 = F.least(F.lit(1.0), y0 + (3 + 5 * (F.col("event_id") % 3)) / 100.0)
    kind = F.create_map(*(F.lit(v) for pair in TYPES.items() for v in pair))[F.col("event_type")]
    return e.select(F.col("user_id").alias("slide"), F.col("event_id").alias("ord"), kind.alias("type"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"), G.box(x0, y0, x1, y1).alias("bbox"))


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As findings, with large boxes that overlap in chains."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "(-?[0-9]+)", 1).cast("int")
    x0, y0 = (k % 8) * 0.05, (F.floor(k / 8) % 4) * 0.1
    kind = F.create_map(*(F.lit(v) for pair in TYPES.items() for v in pair))[F.col("event_type")]
    a0, b0 = (k % 10) / 10.0, F.floor(k / 10) / 10.0
    small = G.box(a0, b0, F.least(F.lit(1.0), a0 + (3 + 5 * (F.col("event_id") % 4)) / 100.0), F.least(F.lit(1.0), b0 + (3 + 5 * (F.col("event_id") % 3)) / 100.0))
    return e.select(F.col("user_id").alias("slide"), F.col("event_id").alias("ord"), kind.alias("type"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"), G.box(x0, y0, x0 + 0.6, y0 + 0.6).alias("bbox"), small.alias("small"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text regions: the boxes of wrong_text findings."""
    return findings(spark, sf_dir).where("type = 'wrong_text'").select("slide", "ord", "bbox")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, line: the lines of every document, numbered from 0."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, name, span_name, type, page, chars, embedded, subset from documents and labels."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = d.join(labels, "doc_id", "left")
    return joined.select(
        (F.col("doc_id") % 20).alias("job_id"), F.col("source").alias("name"), F.when(F.col("doc_id") % 11 == 0, "ABCDEF").otherwise(F.col("source")).alias("span_name"),
        F.col("lang").alias("type"), (F.floor(F.col("doc_id") / 20) % 50).alias("page"),
        F.length(F.regexp_replace("text", "(?U)[\\s\\x1C-\\x1F]+", "")).cast("bigint").alias("chars"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("embedded"), (F.col("doc_id") % 7 == 0).alias("subset"),
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, grid: the 64 numbers of an embedding as an 8 x 8 grid."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("grid"))


def raster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, grid, other: each grid and that of the next vector."""
    r = rasters(spark, sf_dir)
    return r.join(r.select((F.col("vec_id") - 1).alias("vec_id"), F.col("grid").alias("other")), "vec_id")


def grey_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, ref, cand: raster pairs as grey values from 0 to 255."""
    grey = lambda c: F.transform(c, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(v * 60) + 240)).cast("double"))
    return raster_pairs(spark, sf_dir).select("vec_id", grey("grid").alias("ref"), grey("other").alias("cand"))


def paragraph_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Matches, reference and candidate paragraphs, regions and pages (plans.rule_qc) from events."""
    f = overlapping(spark, sf_dir).withColumnRenamed("small", "b2")
    wide = f.select("slide", "ord", "type", "confidence", F.col("bbox").alias("wide"), "b2")
    text = wide.where("type in ('wrong_text', 'extra_content')")
    s = text.withColumn("k", (F.col("ord") % 5) * 0.012)
    moved = G.box(F.col("b2.x0") * 0.9 + 0.03 + F.col("k"), F.col("b2.y0") * 0.7 / 0.75 + 0.02 / 0.75, F.col("b2.x1") * 0.9 + 0.03 + F.col("k"), F.col("b2.y1") * 0.7 / 0.75 + 0.02 / 0.75)
    reference = text.select("slide", "ord", F.col("b2").alias("bbox"), (F.lit(1) + F.col("ord") % 2).cast("int").alias("n_lines"), (F.col("ord") % 13 == 0).alias("blank"))
    candidate = s.select("slide", "ord", moved.alias("bbox"), (F.lit(1) + F.col("ord") % 3).cast("int").alias("n_lines"), F.lit(False).alias("blank"))
    score = (F.lit(60) + F.col("ord") % 41) / 100.0
    matches = text.select("slide", F.col("ord").alias("ref_ord"), F.when(score >= 0.72, F.col("ord")).alias("cand_ord"), score.alias("score"))
    kind = F.when(F.col("type") == "missing_content", "missing").when(F.col("type") == "size_position_issue", "geometry").otherwise("color")
    regions = wide.where("type in ('missing_content', 'size_position_issue', 'wrong_color')").select(
        "slide", kind.alias("kind"), "ord", F.when(F.col("ord") % 3 == 0, F.col("wide")).otherwise(F.col("b2")).alias("bbox"), (F.col("confidence") / 50.0).alias("area_ratio"))
    slide = F.col("slide")
    pages = f.select("slide").distinct().select(
        "slide", F.when(slide % 4 == 0, (slide / 4).cast("bigint") % 4 * 90).otherwise(F.lit(0)).cast("int").alias("angle"), *(F.lit(v).alias(n) for n, v in (("target_w", 1000), ("target_h", 750), ("off_x", 30), ("off_y", 20), ("scaled_w", 900), ("scaled_h", 700))),
        ((slide % 10) / 10.0).alias("similarity"), F.when(slide % 3 == 0, 0).otherwise(100).cast("bigint").alias("total_characters"), (slide % 7 == 0).alias("ocr"), ((slide % 9) / 9.0).alias("ocr_confidence"))
    return matches, reference, candidate, regions, pages


_KIND = "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in TYPES.items()) + " end"
_IOU = "(case when {i} > 0 then {i} / ({a} + {b} - {i}) else 0 end)"


def sql_intersection(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def sql_area(a: str) -> str:
    return f"(greatest(0, {a}.x1 - {a}.x0) * greatest(0, {a}.y1 - {a}.y0))"


def sql_iou(a: str, b: str) -> str:
    return _IOU.format(i=sql_intersection(a, b), a=sql_area(a), b=sql_area(b))


def sql_overlap(a: str, b: str) -> str:
    return f"(case when {sql_area(a)} > 0 then {sql_intersection(a, b)} / {sql_area(a)} else 0 end)"


def sql_touches(a: str, b: str) -> str:
    x, y = f"(({a}.x0 + {a}.x1) / 2)", f"(({a}.y0 + {a}.y1) / 2)"
    return f"({sql_iou(a, b)} >= 0.08::double or ({x} between {b}.x0 and {b}.x1 and {y} between {b}.y0 and {b}.y1))"


def sql_cell(a: str) -> str:
    x, y = f"(({a}.x0 + {a}.x1) / 2)", f"(({a}.y0 + {a}.y1) / 2)"
    return f"((case when {y} < 0.33::double then 'top' when {y} < 0.66::double then 'middle' else 'bottom' end) || '-' || (case when {x} < 0.33::double then 'left' when {x} < 0.66::double then 'center' else 'right' end))"


def sql_edge(a: str) -> str:
    return f"({a}.x1 <= 0.045::double or {a}.x0 >= 1 - 0.045::double or {a}.y1 <= 0.045::double or {a}.y0 >= 1 - 0.045::double)"


SQL_REF = "ref as (select conv_id as job_id, (row_number() over (partition by conv_id order by turn) - 1)::int as page_index, text from conversations where role = 'user')"
SQL_CAND = "cand as (select conv_id as job_id, (row_number() over (partition by conv_id order by turn) - 1)::int as page_index, text from conversations where role = 'assistant')"
SQL_FINDINGS = f"""k as (select *, regexp_extract(props, '(-?[0-9]+)', 1)::int as k from events),
b as (select *, (k % 10) / 10.0::double as x0, floor(k / 10.0::double) / 10.0::double as y0 from k),
f as (select user_id as slide, event_id as ord, {_KIND} as type, least(1.0::double, value / 100.0::double) as confidence,
  x0, y0, least(1.0::double, x0 + (3 + 5 * (event_id % 4)) / 100.0::double) as x1, least(1.0::double, y0 + (3 + 5 * (event_id % 3)) / 100.0::double) as y1 from b)"""
SQL_OVERLAP = f"""k as (select *, regexp_extract(props, '(-?[0-9]+)', 1)::int as k from events),
b as (select *, (k % 8) * 0.05::double as x0, (floor(k / 8.0::double)::int % 4) * 0.1::double as y0 from k),
o as (select user_id as slide, event_id as ord, {_KIND} as type, least(1.0::double, value / 100.0::double) as confidence, x0, y0, x0 + 0.6::double as x1, y0 + 0.6::double as y1 from b)"""
SQL_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as ord from documents)"
SQL_FONTS = r"""fonts as (select doc_id % 20 as job_id, source as name, case when doc_id % 11 = 0 then 'ABCDEF' else source end as span_name, lang as type, (doc_id // 20) % 50 as page, length(regexp_replace(text, '[\s\p{Z}]+', '', 'g'))::bigint as chars,
  coalesce(quality = 1, false) as embedded, doc_id % 7 = 0 as subset from documents left join labels using (doc_id))"""
SQL_RASTER = "r as (select vec_id, list_transform(embedding, lambda x: x::double) as grid from embeddings)"
SQL_GREY = f"""{SQL_RASTER}, pairs as (select a.vec_id, list_transform(a.grid, lambda v: greatest(0, least(255, floor(v * 60) + 240))) as ref,
 list_transform(b.grid, lambda v: greatest(0, least(255, floor(v * 60) + 240))) as cand from r a join r b on b.vec_id = a.vec_id + 1)"""
SQL_PARAGRAPHS = f"""{SQL_FINDINGS.replace("k as (", "kf as (").replace("from k)", "from kf)").replace("b as (", "bf as (").replace("from b)", "from bf)")}, {SQL_OVERLAP},
tx as (select * from f where type in ('wrong_text', 'extra_content')),
rp as (select slide, ord, x0, y0, x1, y1, (1 + ord % 2)::int as n_lines, ord % 13 = 0 as blank from tx),
cp as (select slide, ord, x0 * 0.9::double + 0.03::double + (ord % 5) * 0.012::double as x0, y0 * 0.7::double / 0.75::double + 0.02::double / 0.75::double as y0,
 x1 * 0.9::double + 0.03::double + (ord % 5) * 0.012::double as x1, y1 * 0.7::double / 0.75::double + 0.02::double / 0.75::double as y1, (1 + ord % 3)::int as n_lines from tx),
mt as (select slide, ord as ref_ord, case when (60 + ord % 41) / 100.0::double >= 0.72::double then ord end as cand_ord, (60 + ord % 41) / 100.0::double as score from tx),
rg as (select f.slide, case f.type when 'missing_content' then 'missing' when 'size_position_issue' then 'geometry' else 'color' end as kind, f.ord,
 case when f.ord % 3 = 0 then o.x0 else f.x0 end as x0, case when f.ord % 3 = 0 then o.y0 else f.y0 end as y0, case when f.ord % 3 = 0 then o.x1 else f.x1 end as x1, case when f.ord % 3 = 0 then o.y1 else f.y1 end as y1,
 f.confidence / 50.0::double as area_ratio from f join o using (slide, ord) where f.type in ('missing_content', 'size_position_issue', 'wrong_color')),
pg as (select distinct slide, (case when slide % 4 = 0 then (slide // 4) % 4 * 90 else 0 end)::int as angle, (slide % 10) / 10.0::double as similarity, case when slide % 3 = 0 then 0 else 100 end as total_characters, slide % 7 = 0 as ocr, (slide % 9) / 9.0::double as ocr_confidence from f)"""
