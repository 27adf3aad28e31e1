"""Queries of the page-comparison operators and the DuckDB SQL each must equal.

Names start with the identifiers of the operators they cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioqc.functions import fuzzy
from folioqc.functions import geometry as G
from folioqc.functions import text as X
from folioqc.operators import folds, placement, raster, report, spatial, tiles
from folioqc.plans import model_qc, rule_qc
from folioqc.plans import ratios as R
from folioqc.plans import views as V
from folioqc.plans.registry import ORACLES, QUERIES, query  # noqa: F401

def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return V.pages(s, d, "user"), V.pages(s, d, "assistant")


def _corners(df: DataFrame, *more) -> DataFrame:
    return df.select(*more, *(F.round(F.col("bbox")[n], 6).alias(n) for n in ("x0", "y0", "x1", "y1")))


_PLACED = f"""with {V.SQL_REF}, {V.SQL_CAND}, p as (select coalesce(r.job_id, c.job_id) as job_id, coalesce(r.page_index, c.page_index) as page_index,
 case when r.job_id is null then 'no_matching_pdf_page' when c.job_id is null then 'extra_pdf_page' else 'placed' end as status
 from ref r full join cand c on r.job_id = c.job_id and r.page_index = c.page_index)"""
_SWAPPED = _PLACED.replace("from ref r full join cand c", "from cand r full join ref c")
_F = f"with {V.SQL_FINDINGS}"
_O = f"with {V.SQL_OVERLAP}"
_ROUND = "round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1"


@query(f"{_PLACED} select status, count(*) as n from p group by status")
def jn1_placement_counts(s, d):
    return placement.place(*_sides(s, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_SWAPPED} select job_id, page_index, status from p")
def jn1_placement_swapped(s, d):
    a, b = _sides(s, d)
    return placement.place(b, a)


@query(f"{_PLACED} select p.job_id, p.page_index, coalesce(length(c.text), 0)::bigint as chars from p left join cand c using (job_id, page_index)")
def jn2_lookup_default(s, d):
    a, b = _sides(s, d)
    return placement.with_default(placement.place(a, b).drop("status"), b.withColumn("chars", F.length("text").cast("bigint")), "chars", 0)


@query(f"""with {V.SQL_REF}, {V.SQL_CAND} select coalesce(a.job_id, b.job_id) as job_id, coalesce(n1, 0) as n_reference, coalesce(n2, 0) as n_candidate, greatest(coalesce(n1, 0), coalesce(n2, 0)) as total
 from (select job_id, count(*) as n1 from ref group by 1) a full join (select job_id, count(*) as n2 from cand group by 1) b on a.job_id = b.job_id""")
def ag16_page_totals(s, d):
    return placement.page_totals(*_sides(s, d))


@query(f"""{_PLACED}, o as (select job_id, page_index, 'original' as kind, 0 as late, 0 as part from p where status <> 'extra_pdf_page'
 union all select job_id, page_index, 'reference', 0, 1 from p where status = 'placed' union all select job_id, page_index, 'extra', 1, 1 from p where status = 'extra_pdf_page')
 select job_id, row_number() over (partition by job_id order by late, page_index, part) as position, kind, page_index from o""")
def jn9_deck_order(s, d):
    return placement.deck_order(placement.place(*_sides(s, d)))


@query(f"""{_PLACED} select job_id, row_number() over (partition by job_id order by status <> 'placed', case when status = 'placed' then -page_index else page_index end) as ord,
 case when status = 'placed' then 'INSERT' else 'APPEND' end as action, page_index from p where status <> 'no_matching_pdf_page'""")
def snk5_so6_insert_actions(s, d):
    return placement.insert_actions(placement.place(*_sides(s, d)))


@query(f"""{_SWAPPED} select job_id, page_index, 'manual_review' as slide_status, 'missing_content' as type, 0.03::double as x0, 0.03::double as y0, 0.97::double as x1, 0.97::double as y1, 1.0::double as confidence
 from p where status = 'no_matching_pdf_page'""")
def pl6_missing_page(s, d):
    a, b = _sides(s, d)
    return placement.missing_page_findings(placement.place(b, a))


@query(f"{_F} select type, count(*) as n from f group by type")
def ag1_counts_by_type(s, d):
    return report.counts_by_type(V.findings(s, d))


@query(f"{_F} select slide, ord, row_number() over (partition by slide order by ord) as finding_id from f")
def wn1_finding_ids(s, d):
    return report.numbered(V.findings(s, d)).select("slide", "ord", "finding_id")


@query(f"{_F} select {V.sql_cell('f')} as cell, count(*) as n from f group by 1")
def fn12_grid_cells(s, d):
    return V.findings(s, d).groupBy(G.grid_cell(F.col("bbox")).alias("cell")).agg(F.count("*").alias("n"))


@query(f"{_F} select slide, ord, {_ROUND} from f where {V.sql_edge('f')}")
def flt6_edge_band(s, d):
    return _corners(V.findings(s, d).where(G.in_edge_band(F.col("bbox"))), "slide", "ord")


@query(f"{_F} select slide, ord, type, round(confidence, 6) as confidence from f where type in ('missing_content', 'extra_content', 'wrong_text', 'wrong_color')")
def flt4_prj3_allowed(s, d):
    return model_qc.materialised(V.findings(s, d)).select("slide", "ord", "type", F.round("confidence", 6).alias("confidence"))


_FILTERED = f"""{_F}, t as (select * from f where type = 'wrong_text'), v as (
 select * from f where type in ('missing_content', 'extra_content') and not {V.sql_edge('f')}
 union all select * from t
 union all select * from f where type = 'wrong_color' and confidence >= 0.9::double and exists (select 1 from t where t.slide = f.slide and {V.sql_touches('f', 't')}))"""


@query(f"{_FILTERED} select slide, ord, type from v")
def flt5_jn6_visual_filter(s, d):
    return spatial.visual_filter(V.findings(s, d), V.regions(s, d)).select("slide", "ord", "type")


@query(f"{_F}, t as (select * from f where type = 'wrong_text') select slide, ord from f where type = 'missing_content' and not exists (select 1 from t where t.slide = f.slide and {V.sql_overlap('f', 't')} >= 0.35::double)")
def jn5_ge3_uncovered(s, d):
    return spatial.uncovered(V.findings(s, d).where("type = 'missing_content'"), V.regions(s, d)).select("slide", "ord")


@query(f"{_F}, t as (select * from f where type = 'wrong_text') select slide, ord from f where type = 'wrong_color' and exists (select 1 from t where t.slide = f.slide and ({V.sql_touches('f', 't')} or {V.sql_cell('f')} = {V.sql_cell('t')}))")
def jn13_supported(s, d):
    return spatial.supported(V.findings(s, d).where("type = 'wrong_color'"), V.regions(s, d)).select("slide", "ord")


@query(f"{_F}, t as (select * from f where type = 'wrong_text') select slide, ord from f where type = 'extra_content' and confidence >= 0.9::double and not exists (select 1 from t where t.slide = f.slide and {V.sql_touches('f', 't')})")
def flt14_visual_fallback(s, d):
    return spatial.visual_fallback(V.findings(s, d).where("type = 'extra_content'"), V.regions(s, d)).select("slide", "ord")


_BOX = "struct_pack(ord := ord, x0 := x0, y0 := y0, x1 := x1, y1 := y1{more})"


def _fold_sql(view: str, keys: str, more: str, body: str, result: str, order: str = "ord") -> str:
    return f"""{view}, g as (select {keys}, list({_BOX.format(more=more)} order by {order}) as rows from {{source}} group by {keys}),
 h as (select {keys}, list_reduce(list_transform(rows, lambda r: [r]), lambda acc, x: {body}) as kept from g) {result}"""


@query(
    _fold_sql(_O, "slide, type", "", f"case when len(list_filter(acc, lambda k: {V.sql_iou('k', 'x[1]')} >= 0.72::double)) > 0 then acc else acc || x end",
              "select slide, type, unnest(kept).ord as ord from h").replace("{source}", "o")
)
def wn2_keep_first(s, d):
    return folds.keep_first(V.overlapping(s, d)).select("slide", "type", "ord")


_BEST = _fold_sql(
    _O, "slide, type", ", confidence := confidence",
    f"""case when len(list_filter(acc, lambda k: {V.sql_iou('k', 'x[1]')} >= 0.82::double)) = 0 then acc || x
 else list_transform(acc, lambda k, i: case when i = list_position(list_transform(acc, lambda q: {V.sql_iou('q', 'x[1]')} >= 0.82::double), true) and x[1].confidence > k.confidence then x[1] else k end) end""",
    "select slide, type, unnest(kept).ord as ord, (unnest(range(len(kept))))::int as place from h",
).replace("{source}", "o")


@query(_BEST)
def wn3_keep_best(s, d):
    return folds.keep_best(V.overlapping(s, d)).select("slide", "type", "ord", "place")


_STAGED = """(select slide, (case type when 'missing_content' then 0 when 'size_position_issue' then 1 else 2 end) as stage, ord, type = 'missing_content' as fixed, x0, y0, x1, y1
 from o where type in ('missing_content', 'size_position_issue', 'wrong_color'))"""


@query(
    _fold_sql(_O, "slide", ", fixed := fixed", f"case when not x[1].fixed and len(list_filter(acc, lambda k: {V.sql_overlap('x[1]', 'k')} >= 0.55::double)) > 0 then acc else acc || x end",
              "select slide, unnest(kept).ord as ord from h", "stage, ord").replace("{source}", _STAGED)
)
def wn4_suppress_covered(s, d):
    o = V.overlapping(s, d).where("type in ('missing_content', 'size_position_issue', 'wrong_color')")
    stage = F.when(F.col("type") == "missing_content", 0).when(F.col("type") == "size_position_issue", 1).otherwise(2)
    staged = o.select("slide", stage.alias("stage"), "ord", (F.col("type") == "missing_content").alias("fixed"), "bbox")
    return folds.suppress_covered(staged, order=("stage", "ord")).select("slide", "ord")


@query(f"""{_F}, c as (select slide, count(*) as n from f where type = 'wrong_text' group by slide), p as (select distinct slide, slide % 5 = 0 as manual from f)
 select p.slide, coalesce(n, 0) as n_findings, case when manual then 'manual_review' when coalesce(n, 0) > 0 then 'findings' else 'ok' end as rule_status,
 case when coalesce(n, 0) > 0 then 'findings' when manual then 'manual_review' else 'ok' end as model_status from p left join c using (slide)""")
def fn17_statuses(s, d):
    f = V.findings(s, d)
    pages = f.select("slide", (F.col("slide") % 5 == 0).alias("manual")).distinct()
    n = f.where("type = 'wrong_text'").groupBy("slide").agg(F.count("*").alias("n_findings"))
    j = pages.join(n, "slide", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    return j.select("slide", "n_findings", report.rule_status(F.col("manual"), F.col("n_findings")).alias("rule_status"), report.model_status(F.col("manual"), F.col("n_findings")).alias("model_status"))


_L = f"with {V.SQL_LINES}"
_WS = r"[\s\p{Z}]+"


@query(rf"{_L} select doc_id, count(*) as n from lines where regexp_replace(line, '{_WS}', '', 'g') <> '' group by doc_id")
def flt1_ag15_line_counts(s, d):
    return V.lines(s, d).where(X.collapse(F.col("line")) != "").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"{_L} select doc_id, sum(length(regexp_replace(line, '{_WS}', '', 'g')))::bigint as chars from lines group by doc_id")
def ag3_solid_characters(s, d):
    return V.lines(s, d).groupBy("doc_id").agg(F.sum(X.solid_length(F.col("line"))).cast("bigint").alias("chars"))


@query(rf"{_L} select doc_id, string_agg(trim(regexp_replace(line, '{_WS}', ' ', 'g')), ' ' order by ord) as joined from lines where regexp_replace(line, '{_WS}', '', 'g') <> '' group by doc_id")
def ag7_fn4_ordered_concat(s, d):
    t = X.clean(F.col("line"))
    listed = V.lines(s, d).where(t != "").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", t.alias("t")))).alias("r"))
    return listed.select("doc_id", F.array_join(F.col("r.t"), " ").alias("joined"))


@query(rf"{_L}, c as (select *, trim(regexp_replace(line, '{_WS}', ' ', 'g')) as t from lines) select doc_id, ord, case when length(t) > 180 then rtrim(t[1:179]) || '…' else t end as short from c")
def fn6_trimmed(s, d):
    return V.lines(s, d).select("doc_id", "ord", X.trimmed(F.col("line")).alias("short"))


@query(rf"{_L} select doc_id, ord, replace(lower(trim(regexp_replace(replace(replace(replace(replace(replace(line, '’', ''''), '“', '""'), '”', '""'), '–', '-'), '—', '-'), '{_WS}', ' ', 'g'))), 'ß', 'ss') as norm from lines".replace('""', '"'))
def fn1_normalised(s, d):
    return V.lines(s, d).select("doc_id", "ord", X.normalised(F.col("line")).alias("norm"))


@query(rf"{_L} select doc_id, ord, replace(lower(trim(regexp_replace(line, '{_WS}', ' ', 'g'))), 'ß', 'ss') as norm from lines")
def fn1_normalised_built_in(s, d):
    return V.lines(s, d).select("doc_id", "ord", X.normalised_fast(F.col("line")).alias("norm"))


@query("""select o_orderkey, round(o_totalprice * 100)::bigint as emu, greatest(1, round_even(round(o_totalprice * 100) / 914400.0::double * 240, 0))::int as pixels from orders""")
def fn21_emu_to_pixels(s, d):
    o = V.table(s, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("emu"))
    return o.withColumn("pixels", G.emu_to_pixels(F.col("emu")))


@query("""select o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') || '-' || md5(o_orderkey::varchar)[1:8] as job, least(100, round(o_orderkey % 7 * 100.0::double / greatest(o_orderkey % 5, 1)))::int as done from orders""")
def fn22_fn26_jobs(s, d):
    o = V.table(s, d, "orders")
    token = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    return o.select("o_orderkey", X.job_identifier(F.col("o_orderdate"), token).alias("job"), X.percent_done(F.col("o_orderkey") % 7, F.col("o_orderkey") % 5).alias("done"))


_G = f"""{_F}, m as (select slide, ord, x0, y0, x1, y1, (ord % 4 * 90)::int as angle from f),
 c as (select *, [x0, x0, x1, x1] as xs, [y0, y1, y0, y1] as ys from m),
 t as (select *, case angle when 90 then ys when 180 then list_transform(xs, lambda v: 1 - v) when 270 then list_transform(ys, lambda v: 1 - v) else xs end as rx,
  case angle when 90 then list_transform(xs, lambda v: 1 - v) when 180 then list_transform(ys, lambda v: 1 - v) when 270 then xs else ys end as ry from c)"""


@query(f"""{_G} select slide, ord, round(greatest(0, least(1, (list_min(rx) * 900 + 30) / 1000.0::double)), 6) as x0, round(greatest(0, least(1, (list_min(ry) * 700 + 20) / 750.0::double)), 6) as y0,
 round(greatest(0, least(1, (list_max(rx) * 900 + 30) / 1000.0::double)), 6) as x1, round(greatest(0, least(1, (list_max(ry) * 700 + 20) / 750.0::double)), 6) as y1 from t""")
def ge9_ge10_mapped_boxes(s, d):
    f = V.findings(s, d).withColumn("angle", F.col("ord") % 4 * 90)
    return _corners(f.withColumn("bbox", G.map_box(F.col("bbox"), F.col("angle"), *map(F.lit, (1000, 750, 30, 20, 900, 700)))), "slide", "ord")


@query(f"""{_F}, a as (select slide, ord, greatest(0, x0 - 0.03::double) as a0, greatest(0, y0 - 0.03::double) as b0, least(1, x1 + 0.03::double) as a1, least(1, y1 + 0.03::double) as b1 from f)
 select slide, ord, round(case when a1 - a0 < 0.12::double then greatest(0, (a0 + a1) / 2 - 0.06::double) else a0 end, 6) as x0, round(case when b1 - b0 < 0.12::double then greatest(0, (b0 + b1) / 2 - 0.06::double) else b0 end, 6) as y0,
 round(case when a1 - a0 < 0.12::double then least(1, (a0 + a1) / 2 + 0.06::double) else a1 end, 6) as x1, round(case when b1 - b0 < 0.12::double then least(1, (b0 + b1) / 2 + 0.06::double) else b1 end, 6) as y1 from a""")
def ge11_expanded(s, d):
    return _corners(V.findings(s, d).withColumn("bbox", G.expanded(F.col("bbox"))), "slide", "ord")


@query("""select l_orderkey, l_linenumber, round(least(1, l_quantity / 60.0::double), 6) as x0, round(least(1, l_discount), 6) as y0,
 round(greatest(least(1, l_quantity / 60.0::double), least(1, (l_quantity + greatest(l_linenumber, 1)) / 60.0::double)), 6) as x1, round(greatest(least(1, l_discount), least(1, l_discount + 1)), 6) as y1 from lineitem""")
def ge8_ge1_from_emu(s, d):
    b = G.from_emu(F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber"), F.lit(0), F.lit(60), F.lit(1))
    return _corners(V.table(s, d, "lineitem").withColumn("bbox", b), "l_orderkey", "l_linenumber")


@query(f"""{_F}, c as (select slide, ord, greatest(0, least(319, round_even(x0 * 320, 0)::int)) as x0, greatest(0, least(239, round_even(y0 * 240, 0)::int)) as y0, round_even(x1 * 320, 0)::int as x1, round_even(y1 * 240, 0)::int as y1 from f)
 select slide, ord, x0, y0, greatest(x0 + 1, least(320, x1)) as x1, greatest(y0 + 1, least(240, y1)) as y1 from c""")
def ge15_crop_pixels(s, d):
    c = G.crop_pixels(F.col("bbox"), F.lit(320), F.lit(240))
    return V.findings(s, d).withColumn("c", c).select("slide", "ord", "c.x0", "c.y0", "c.x1", "c.y1")


@query("""select l_orderkey, l_linenumber, round(0 - abs(l_quantity / greatest(l_linenumber, 1) - 1.5::double), 6) as score from lineitem""")
def ge17_aspect(s, d):
    li = V.table(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(G.aspect_score(F.col("l_quantity"), F.col("l_linenumber"), F.lit(1.5), F.lit(1.0)), 6).alias("score"))


_NCC = f"""with {V.SQL_RASTER}, p as (select a.vec_id, a.grid as g, b.grid as h from r a join r b on b.vec_id = a.vec_id + 1),
 q as (select vec_id, list_transform(g, lambda v: v - list_avg(g)) as g, list_transform(h, lambda v: v - list_avg(h)) as h from p)"""


_TURN = "list_transform(range(64), lambda i: h[(i % 8) * 8 + 8 - (i // 8)])"


@query(f"""with {V.SQL_RASTER}, c as (select vec_id, unnest(grid) as v, unnest(range(64)) as i from r)
 select vec_id, min(i % 8)::int as x0, min(i // 8)::int as y0, max(i % 8)::int as x1, max(i // 8)::int as y1 from c where v < -0.2::double group by vec_id""")
def ag10_content_box(s, d):
    b = V.rasters(s, d).select("vec_id", raster.content_box(F.col("grid"), 8, -0.2).alias("b")).where("b is not null")
    return b.select("vec_id", "b.x0", "b.y0", "b.x1", "b.y1")


_CC = f"""with recursive {V.SQL_RASTER}, c as (select vec_id, v, i % 8 as x, i // 8 as y, i from (select vec_id, unnest(grid) as v, unnest(range(64)) as i from r) where v < 0),
 reach as (select vec_id, i as root, x, y, i from c union select p.vec_id, p.root, c.x, c.y, c.i from reach p join c on p.vec_id = c.vec_id and abs(p.x - c.x) <= 1 and abs(p.y - c.y) <= 1),
 lab as (select vec_id, i, any_value(x) as x, any_value(y) as y, min(root) as root from reach group by vec_id, i)"""


@query(f"{_CC} select vec_id, (row_number() over (partition by vec_id order by root) - 1)::int as region_ord, min(x)::int as x0, min(y)::int as y0, max(x)::int as x1, max(y)::int as y1, count(*)::int as area from lab group by vec_id, root")
def ag11_so7_flt7_components(s, d):
    return raster.components(V.rasters(s, d), 8, 0.0)


_SHEETS = f"""with recursive {V.SQL_RASTER}, c as (select vec_id // 64 as id, vec_id % 8 * 8 + i % 8 as x, vec_id % 64 // 8 * 8 + i // 8 as y from (select vec_id, unnest(grid) as v, unnest(range(64)) as i from r) where v < -0.12::double),
 reach as (select id, y * 64 + x as root, x, y from c union select p.id, p.root, c.x, c.y from reach p join c on p.id = c.id and abs(p.x - c.x) <= 1 and abs(p.y - c.y) <= 1),
 lab as (select id, x, y, min(root) as root from reach group by id, x, y)"""


@query(f"{_SHEETS} select id, (row_number() over (partition by id order by root) - 1)::int as region_ord, min(x)::int as x0, min(y)::int as y0, max(x)::int as x1, max(y)::int as y1, count(*)::bigint as area from lab group by id, root")
def ag11_so7_large_rasters(s, d):
    """Sixty-four grids a sheet, each a tile."""
    v = F.col("vec_id")
    bits = F.unhex(F.array_join(F.transform("grid", lambda x: F.when(x < -0.12, "01").otherwise("00")), ""))
    sheets = V.rasters(s, d).select(F.floor(v / 64).alias("id"), F.floor(v % 64 / 8).cast("int").alias("ty"), (v % 8).cast("int").alias("tx"), F.lit(8).alias("height"), F.lit(8).alias("width"), bits.alias("mask"))
    return tiles.large_components(sheets, 8)


def _paragraphs(pages: DataFrame) -> DataFrame:
    """Every line of each page as a paragraph in a column of boxes: 16 places, or more if the page has more lines."""
    lines = X.split_lines(F.col("text"))
    p = pages.select("job_id", "page_index", F.greatest(F.lit(16), F.size(lines) + 1).alias("places"), F.posexplode(lines).alias("ord", "text"))
    y = F.col("ord") / F.col("places")
    high = F.when(F.col("places") == 16, F.lit(0.05)).otherwise(0.8 / F.col("places"))
    return p.withColumn("bbox", G.box(F.lit(0.1), y, F.least(F.lit(0.9), 0.1 + F.length("text") / 200.0), y + high)).withColumn("n_lines", F.lit(1) + F.floor(F.length("text") / 80)).drop("places")


_LINED = r"""{name} as (select job_id, page_index, (row_number() over (partition by job_id, page_index order by nth) - 1)::int as ord, piece as text from (
  select job_id, page_index, unnest(string_split_regex(text, '[\r\n\v]+')) as piece, generate_subscripts(string_split_regex(text, '[\r\n\v]+'), 1) as nth from {source}) where trim(piece) <> '')"""


def _folded(v: str) -> str:
    return f"replace(lower(trim(regexp_replace({v}, '{_WS}', ' ', 'g'))), 'ß', 'ss')"


_GREEDY = """
 sc as (select job_id, page_index, ref_ord, cand_ord, ratio as score from rt join nr using (id) where ratio >= 0.72::double),
 st as (select job_id, page_index, ref_ord, list(struct_pack(c := cand_ord, s := score) order by score desc, cand_ord) as l from sc group by all),
 gg as (select job_id, page_index, list(ref_ord order by ref_ord) as refs, list(l order by ref_ord) as ls from st group by all),
 zz as (select job_id, page_index, refs, list_reduce(ls, lambda acc, x: acc || [coalesce(list_filter(x, lambda q: not coalesce(list_contains(list_transform(acc, lambda e: e.c), q.c), false))[1], struct_pack(c := null::int, s := null::double))], []::struct(c int, s double)[]) as picks from gg),
 gm as (select job_id, page_index, unnest(refs) as ref_ord, unnest(picks).c as cand_ord, unnest(picks).s as score from zz)"""


def _matched_sql(pairs: str, reference: str) -> str:
    """SQL of greedy matches: pairs makes pp, reference names the table of all references."""
    return f"""{pairs}, {R.SQL_BOUNDED.format(least='0.72::double')}, {R.SQL_RATIOS}, {_GREEDY}
 select r.job_id, r.page_index, r.ord as ref_ord, coalesce(gm.cand_ord, -1) as cand_ord, round(coalesce(gm.score, -1), 6) as score from {reference} r left join gm on gm.job_id = r.job_id and gm.page_index = r.page_index and gm.ref_ord = r.ord"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("job_id", "page_index", "ref_ord", F.coalesce("cand_ord", F.lit(-1)).alias("cand_ord"), F.round(F.coalesce("score", F.lit(-1.0)), 6).alias("score"))


_PAIRED = f"""with recursive {V.SQL_REF}, {V.SQL_CAND}, {_LINED.format(name='rl', source='ref')}, {_LINED.format(name='cl', source='cand')},
 pp as (select rl.job_id, rl.page_index, rl.ord as ref_ord, cl.ord as cand_ord, {_folded('rl.text')} as a, {_folded('cl.text')} as b from rl join cl using (job_id, page_index))"""


@query(_matched_sql(_PAIRED, "rl"))
def jn3_fn3_greedy_matches(s, d):
    a, b = _sides(s, d)
    cols = ("job_id", "page_index", "ord", "text")
    return _shown(fuzzy.greedy_matches(_paragraphs(a).select(*cols), _paragraphs(b).select(*cols)))


@query()
def pl7_jn4_jn12_text_discrepancies(s, d):
    a, b = _sides(s, d)
    flat = lambda p: _paragraphs(p).select("job_id", "page_index", "ord", "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    return fuzzy.text_discrepancies(flat(a), flat(b))


def _named_lines(s: SparkSession, d: str) -> DataFrame:
    """slide, ord, text: a line for each part, eight parts a slide."""
    p = V.table(s, d, "part")
    return p.select(F.floor(F.col("p_partkey") / 8).alias("slide"), (F.col("p_partkey") % 8).alias("ord"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


def _whole_review(s: SparkSession, d: str) -> DataFrame:
    """Findings of slides whose candidate side is the reference's lines, some as they are, some wrapped
    anew, moved, changed, turned round or cut short, and whose regions are those of a raster."""
    lines, k = _named_lines(s, d), (F.col("slide") + F.col("ord")) % 6
    y, high, size = F.col("ord") / 16.0, 0.05, F.length("text")
    x1 = F.least(F.lit(0.9), 0.1 + size / 200.0)
    told = lines.select("slide", "ord", "text", y.alias("y0"), (y + high).alias("y1"), x1.alias("x1"), (F.lit(1) + F.floor(size / 80)).cast("int").alias("n_lines"), k.alias("k"))
    blank = F.lit(False).alias("blank")
    reference = told.select("slide", "ord", "text", G.box(F.lit(0.1), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"), "n_lines", blank)
    other = F.when(F.col("k") == 2, F.concat("text", F.lit("  "))).when(F.col("k") == 3, F.regexp_replace("text", "[ae]", "o")).when(F.col("k") == 4, F.reverse("text")).when(F.col("k") == 5, F.substring("text", F.lit(1), F.floor(F.length("text") * 3 / 5).cast("int"))).otherwise(F.col("text"))
    moved = F.when(F.col("k") == 2, 0.05).otherwise(0.0)
    at = lambda v, scale, off, total: (F.col(v) if isinstance(v, str) else v) * scale / total + off / total
    place = G.box(at(F.lit(0.1), 900.0, 30.0, 1000.0) + moved, at("y0", 700.0, 20.0, 750.0), at("x1", 900.0, 30.0, 1000.0) + moved, at("y1", 700.0, 20.0, 750.0))
    candidate = told.select("slide", "ord", other.alias("text"), place.alias("bbox"), (F.col("n_lines") + (F.col("k") == 1).cast("int")).alias("n_lines"), blank)
    kind = F.when(F.col("region_ord") % 3 == 0, "missing").when(F.col("region_ord") % 3 == 1, "geometry").otherwise("color")
    c = raster.components(V.rasters(s, d), 8, 0.0).join(lines.select(F.col("slide").alias("vec_id")).distinct(), "vec_id", "left_semi")
    regions = c.select(F.col("vec_id").alias("slide"), kind.alias("kind"), F.col("region_ord").cast("long").alias("ord"), G.box(F.col("x0") / 8.0, F.col("y0") / 8.0, (F.col("x1") + 1) / 8.0, (F.col("y1") + 1) / 8.0).alias("bbox"), (F.col("area") / 640.0).alias("area_ratio"))
    pages = lines.select("slide").distinct().select("slide", *(F.lit(v).alias(n) for n, v in (("angle", 0), ("target_w", 1000), ("target_h", 750), ("off_x", 30), ("off_y", 20), ("scaled_w", 900), ("scaled_h", 700))))
    return rule_qc.findings(rule_qc.matches_of(reference, candidate), reference.drop("text"), candidate.drop("text"), regions, pages)


_REVIEWED = f"""{_CC}, ll as (select p_partkey // 8 as slide, p_partkey % 8 as ord, concat_ws(' ', p_name, p_type, p_brand) as text, (p_partkey // 8 + p_partkey % 8) % 6 as kk from part),
 rp as (select slide, ord, text, 0.1::double as x0, ord / 16.0::double as y0, least(0.9::double, 0.1::double + length(text) / 200.0::double) as x1, ord / 16.0::double + 0.05::double as y1, (1 + length(text) // 80)::int as n_lines, false as blank, kk from ll),
 cp as (select slide, ord, x0 * 900.0::double / 1000 + 30.0::double / 1000 + mv as x0, y0 * 700.0::double / 750 + 20.0::double / 750 as y0, x1 * 900.0::double / 1000 + 30.0::double / 1000 + mv as x1, y1 * 700.0::double / 750 + 20.0::double / 750 as y1, n_lines + (kk = 1)::int as n_lines,
  case kk when 2 then text || '  ' when 3 then regexp_replace(text, '[ae]', 'o', 'g') when 4 then reverse(text) when 5 then text[1:length(text) * 3 // 5] else text end as text from (select *, case when kk = 2 then 0.05::double else 0 end as mv from rp)),
 pp as (select r.slide as job_id, 0 as page_index, r.ord as ref_ord, c.ord as cand_ord, {_folded('r.text')} as a, {_folded('c.text')} as b from rp r join cp c using (slide)),
 {R.SQL_BOUNDED.format(least='0.72::double')}, {R.SQL_RATIOS}, {_GREEDY},
 mt as (select r.slide, r.ord as ref_ord, gm.cand_ord, gm.score from rp r left join gm on gm.job_id = r.slide and gm.ref_ord = r.ord),
 cc as (select vec_id, row_number() over (partition by vec_id order by root) - 1 as region_ord, min(x) as cx0, min(y) as cy0, max(x) as cx1, max(y) as cy1, count(*) as area from lab group by vec_id, root),
 rg as (select vec_id as slide, case region_ord % 3 when 0 then 'missing' when 1 then 'geometry' else 'color' end as kind, region_ord as ord, cx0 / 8.0::double as x0, cy0 / 8.0::double as y0, (cx1 + 1) / 8.0::double as x1, (cy1 + 1) / 8.0::double as y1, area / 640.0::double as area_ratio from cc where vec_id in (select slide from rp)),
 pg as (select distinct slide, 0 as angle from rp)"""


# The other modules register theirs.
from folioqc.plans import deck_queries, finding_queries, text_queries  # noqa: E402, F401
