"""Queries over findings, reviews, comments and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioqc.functions import geometry as G
from folioqc.operators import layouts, placement, report, spatial
from folioqc.plans import catalog as C
from folioqc.plans import model_qc, rule_qc
from folioqc.plans import views as V
from folioqc.plans.registry import query

_F, _O = f"with {V.SQL_FINDINGS}", f"with {V.SQL_OVERLAP}"
_B = ("x0", "y0", "x1", "y1")


def _flat(df, *more):
    return df.select(*more, *(F.round(F.col("bbox")[n], 6).alias(n) for n in _B))


@query(f"""{C._PLACED}, q as (select user_id as page_index, count(*) as n from events group by 1)
 select job_id, p.page_index, coalesce(n, 0) as n from p left join q on p.page_index = q.page_index where status <> 'extra_pdf_page'""")
def jn10_slide_results(s, d):
    slides = placement.place(*C._sides(s, d)).where("status <> 'extra_pdf_page'").select("job_id", "page_index")
    return report.with_findings_count(slides, V.table(s, d, "events").withColumnRenamed("user_id", "page_index"), ["page_index"]).select("job_id", "page_index", "n")


@query(f"{_F} select slide, round(min(x0), 6) as x0, round(min(y0), 6) as y0, round(max(x1), 6) as x1, round(max(y1), 6) as y1 from f group by slide")
def ag2_union_box(s, d):
    return _flat(report.union_boxes(V.findings(s, d)), "slide")


@query(f"{_F} select slide, round(coalesce(avg(confidence) filter (type = 'wrong_color'), 0), 6) as mean_confidence from f group by slide")
def ag4_mean_confidence(s, d):
    return report.mean_confidence(V.findings(s, d), F.col("type") == "wrong_color").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"""{_O}, p as (select * from o where type = 'wrong_text'), l as (select * from o where type = 'wrong_color')
 select p.slide, p.ord as para, count(l.ord) as n_lines, coalesce(string_agg(l.ord::varchar, ',' order by l.ord), '') as lines
 from p left join l on p.slide = l.slide and {V.sql_overlap('p', 'l')} >= 0.55::double group by p.slide, p.ord""")
def jn7_lines_of_paragraphs(s, d):
    o = V.overlapping(s, d)
    found = spatial.lines_of_paragraphs(o.where("type = 'wrong_color'"), o.where("type = 'wrong_text'"))
    return found.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query(f"{_F} select slide, ord, row_number() over (partition by slide order by y0, x0, ord) as place from f")
def so1_reading_order(s, d):
    return layouts.reading_order(V.findings(s, d), ["slide"]).select("slide", "ord", "place")


@query(f"{_F} select slide, ord, greatest(total - 36, 0) as omitted from (select *, row_number() over (partition by slide order by y0, x0, ord) as rn, count(*) over (partition by slide) as total from f) where rn <= 36")
def so2_top_items(s, d):
    return layouts.top_items(V.findings(s, d), ["slide"]).select("slide", "ord", "omitted")


_CENTRE = "sqrt(((x0 + x1) / 2 - (u0 + u1) / 2) ** 2 + ((y0 + y1) / 2 - (v0 + v1) / 2) ** 2)"


@query(f"""{_F}, p as (select slide, ord, x0, y0, x1, y1, lead(x0) over w as u0, lead(y0) over w as v0, lead(x1) over w as u1, lead(y1) over w as v1 from f window w as (partition by slide order by ord))
 select slide, ord, round(greatest(0, 1 - {_CENTRE} / 1.2::double), 6) as position,
 abs(x0 - u0) >= 0.026::double or abs(y0 - v0) >= 0.028::double or {_CENTRE} >= 0.036::double or abs((x1 - x0) - (u1 - u0)) >= 0.05::double as drifts
 from p where u0 is not null""")
def ge13_flt8_drift(s, d):
    nxt = F.lead("bbox").over(Window.partitionBy("slide").orderBy("ord"))
    p = V.findings(s, d).withColumn("other", nxt).where("other is not null")
    return p.select("slide", "ord", F.round(G.position_similarity(F.col("bbox"), F.col("other")), 6).alias("position"), G.drifts(F.col("bbox"), F.col("other")).alias("drifts"))


@query(f"""{_F}, st as (select slide, case when slide % 5 = 0 then 'manual_review' when slide % 5 = 1 then 'ok' else 'findings' end as status from (select distinct slide from f))
 select (select count(*) from st) as slide_count, (select count(*) from st where status = 'manual_review') as manual_review_count,
 (select '{{' || string_agg('"' || type || '":' || n, ',' order by type) || '}}' from (select type, count(*) as n from f group by type)) as counts_by_type""")
def ag1_report_counts(s, d):
    f = V.findings(s, d)
    status = F.when(F.col("slide") % 5 == 0, "manual_review").when(F.col("slide") % 5 == 1, "ok").otherwise("findings")
    return report.summed_up(f.select("slide").distinct().withColumn("status", status), f)


_SEVERITY = "case when type in ('missing_content', 'extra_content') then 'high' else 'medium' end"
_NUM = "case when {v} = floor({v}) then ({v})::bigint::varchar || '.0' else ({v})::varchar end"


@query(rf"""{_F}, r as (select *, slide % 10 as job_id, row_number() over (partition by slide order by ord) as id from f),
 sl as (select distinct job_id, slide from r),
 fs as (select job_id, slide, '[' || string_agg('{{"id":' || id || ',"type":"' || type || '","severity":"' || {_SEVERITY} || '","bbox":[' ||
  {_NUM.format(v="round(x0, 2)")} || ',' || {_NUM.format(v="round(y0, 2)")} || ',' || {_NUM.format(v="round(x1, 2)")} || ',' || {_NUM.format(v="round(y1, 2)")} || '],"message":"Finding ' || ord || '","confidence":' || {_NUM.format(v="floor(confidence * 100) / 100")} || '}}', ',' order by id) || ']' as items from r group by all),
 ct as (select job_id, '{{' || string_agg('"' || type || '":' || n, ',' order by type) || '}}' as counts from (select job_id, type, count(*) as n from r group by all) group by job_id)
 select sl.job_id, '{{"slideCount":' || count(*) || ',"manualReviewCount":' || count(*) filter (sl.slide % 4 = 0) || ',"countsByType":' || any_value(counts) || ',"slides":[' ||
  string_agg('{{"slideIndex":' || sl.slide || ',"pageIndex":' || sl.slide || ',"status":"' || case when sl.slide % 4 = 0 then 'manual_review' else 'findings' end || '","alignmentConfidence":' || case when sl.slide % 4 = 0 then '0.0' else '0.9' end ||
  ',"referenceSource":"native","candidateSource":"native","summary":' || case when sl.slide % 3 = 0 then 'null' else '"Slide ' || sl.slide || '"' end || ',"bullets":' || case when sl.slide % 3 = 0 then '[]' else '["one","two"]' end ||
  ',"note":' || case when sl.slide % 4 = 0 then '"see \"this\""' else 'null' end || ',"findings":' || items || '}}', ',' order by sl.slide) || ']}}' as report
 from sl join fs using (job_id, slide) join ct on ct.job_id = sl.job_id group by sl.job_id""")
def snk1_report_json(s, d):
    f = report.numbered(V.findings(s, d)).withColumn("job_id", F.col("slide") % 10)
    severity = F.when(F.col("type").isin("missing_content", "extra_content"), "high").otherwise("medium")
    b = F.col("bbox")
    found = f.select("job_id", F.col("slide").alias("slide_index"), F.col("finding_id").alias("id"), "type", severity.alias("severity"), G.box(*(F.round(b[n], 2) for n in _B)).alias("bbox"),
                     F.concat(F.lit("Finding "), F.col("ord").cast("string")).alias("message"), (F.floor(F.col("confidence") * 100) / 100).alias("confidence"))
    i = F.col("slide")
    manual, silent = i % 4 == 0, i % 3 == 0
    results = f.select("job_id", "slide").distinct().select(
        "job_id", i.alias("slide_index"), i.alias("page_index"), F.when(manual, "manual_review").otherwise("findings").alias("status"), F.when(manual, 0.0).otherwise(0.9).alias("alignment_confidence"),
        F.lit("native").alias("reference_source"), F.lit("native").alias("candidate_source"), F.when(~silent, F.concat(F.lit("Slide "), i.cast("string"))).alias("summary"),
        F.when(silent, F.array().cast("array<string>")).otherwise(F.array(F.lit("one"), F.lit("two"))).alias("bullets"), F.when(manual, 'see "this"').alias("note"))
    return report.report_json(results, found)


_KEPT = C._fold_sql(
    C._FILTERED, "slide, type", ", confidence := confidence, own := ord",
    f"""case when len(list_filter(acc, lambda k: {V.sql_iou('k', 'x[1]')} >= 0.82::double)) = 0 then acc || x
 else list_transform(acc, lambda k, i: case when i = list_position(list_transform(acc, lambda q: {V.sql_iou('q', 'x[1]')} >= 0.82::double), true) and x[1].confidence > k.confidence then struct_pack(ord := x[1].ord, x0 := x[1].x0, y0 := x[1].y0, x1 := x[1].x1, y1 := x[1].y1, confidence := x[1].confidence, own := k.own) else k end) end""",
    "", ).replace("{source}", "v") + """, u as (select slide, type, unnest(kept).ord as ord, unnest(kept).own as own, unnest(kept).confidence as confidence from h),
 n as (select *, row_number() over (partition by slide order by own) as finding_id from u)"""


@query(f"{_KEPT} select slide, type, finding_id, ord, round(confidence, 6) as confidence from n")
def pl3_model_review(s, d):
    return model_qc.reviewed(V.findings(s, d), V.regions(s, d)).withColumn("confidence", F.round("confidence", 6))


_BULLETS = """case when slide % 4 = 0 then ['Wrong COLOR of the title', ' ', 'Text differs', 'text DIFFERS', 'The box is shifted'] when slide % 4 = 1 then ['The box is shifted', 'a Colour'] when slide % 4 = 2 then [] else ['Straße fehlt', 'STRASSE FEHLT', 'line-break'] end"""
_DROPPED = "regexp_matches(lower(b), 'position|alignment|aligned|shifted|too far|narrower|wider|wrap|line break|line-break')"


@query(f"""{_KEPT}, per as (select slide, list('Finding ' || ord order by finding_id) as messages, bool_or(type = 'wrong_color') as colour from n group by slide),
 rs as (select distinct slide, case when slide % 3 = 0 then 'manual_review' when slide % 3 = 1 then 'ok' else 'findings' end as said, case when slide % 5 = 0 then '  ' else 'Slide ' || slide || ' ' end as summary,
  case when slide % 2 = 0 then ' a note ' end as note, {_BULLETS} as bullets, (slide % 13) / 10.0::double as confidence from f),
 jj as (select rs.*, messages, colour, messages is not null as has, list_filter(list_transform(bullets, lambda b: trim(b)), lambda b: b <> '' and not {_DROPPED} and (coalesce(colour, false) or not regexp_matches(lower(b), 'color|colour|shade'))) as raw from rs left join per using (slide)),
 kk as (select *, list_filter(raw, lambda b, i: list_position(list_transform(raw, lambda q: replace(lower(q), 'ß', 'ss')), replace(lower(b), 'ß', 'ss')) = i) as firsts from jj),
 z as (select *, case when not has then [] when len(firsts) > 0 then firsts else messages end as shown, case when has then coalesce(nullif(trim(summary), ''), nullif(trim(note), ''), 'AI review findings') end as head from kk)
 select slide, case when has then 'findings' when said = 'manual_review' then 'manual_review' else 'ok' end as status, coalesce(len(messages), 0)::bigint as n_findings, head as summary, array_to_string(shown, '|') as bullets,
 case when has then array_to_string([head] || list_transform(shown, lambda b: '- ' || b), chr(10)) end as note, round(greatest(0, least(1, confidence)), 6) as alignment_confidence from z""")
def pl3_fn15_flt10_comments(s, d):
    f = V.findings(s, d).withColumn("message", F.concat(F.lit(" Finding "), F.col("ord").cast("string"), F.lit(" ")))
    i = F.col("slide")
    listed = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    bullets = F.when(i % 4 == 0, listed("Wrong COLOR of the title", " ", "Text differs", "text DIFFERS", "The box is shifted")).when(i % 4 == 1, listed("The box is shifted", "a Colour")).when(i % 4 == 2, listed()).otherwise(listed("Straße fehlt", "STRASSE FEHLT", "line-break"))
    responses = f.select("slide").distinct().select(
        "slide", F.when(i % 3 == 0, "manual_review").when(i % 3 == 1, "ok").otherwise("findings").alias("status"), F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit("Slide "), i.cast("string"), F.lit(" "))).alias("summary"),
        F.when(i % 2 == 0, " a note ").alias("note"), bullets.alias("bullets"), ((i % 13) / 10.0).alias("comparison_confidence"))
    _, told = model_qc.slide_results(responses, f, V.regions(s, d))
    return told.withColumn("bullets", F.array_join("bullets", "|")).withColumn("alignment_confidence", F.round("alignment_confidence", 6))


_MERGE = """with g as (select p_partkey as id, case when p_size % 4 = 0 then [] when p_size % 4 = 1 then ['wrong_color'] else ['wrong_text'] end as types, p_size % 3 <> 0 as kept,
 case when p_size % 5 = 0 then ' ' else p_brand end as gs, case when p_size % 7 = 0 then 'n' end as gn, ['Color ' || p_brand, p_name, upper(p_name)] as gb, case when p_size % 6 = 0 then null when p_size % 6 = 1 then p_brand else p_type end as ts, [lower(p_name), ' x '] as tb from part),
 h as (select *, case when len(types) > 0 then coalesce(nullif(trim(gs), ''), nullif(trim(gn), '')) end as a, case when kept then nullif(trim(ts), '') end as b,
  list_filter((case when len(types) > 0 then list_filter(list_transform(gb, lambda v: trim(v)), lambda v: v <> '' and (list_contains(types, 'wrong_color') or not regexp_matches(lower(v), 'color|colour|shade')) and not regexp_matches(lower(v), 'position|alignment|aligned|shifted|too far|narrower|wider|wrap|line break|line-break')) else [] end)
   || (case when kept then list_filter(list_transform(tb, lambda v: trim(v)), lambda v: v <> '') else [] end), lambda v: true) as raw from g),
 k as (select *, list_filter(raw, lambda v, i: list_position(list_transform(raw, lambda q: lower(q)), lower(v)) = i) as firsts from h),
 z as (select *, case when len(firsts) > 0 then firsts when id % 2 = 0 then ['m'] else [] end as shown from k),
 w as (select *, case when a is not null and b is not null and a <> b then 'AI review findings' else coalesce(a, b, case when len(shown) > 0 then 'AI review findings' end) end as head from z)
 select id, head as summary, array_to_string(shown, '|') as bullets, nullif(array_to_string((case when head is null then [] else [head] end) || list_transform(shown, lambda v: '- ' || v), chr(10)), '') as note from w"""


@query(_MERGE)
def fn16_merged_comments(s, d):
    p, k = V.table(s, d, "part"), F.col("p_size")
    none = F.array().cast("array<string>")
    rows = p.select(
        F.col("p_partkey").alias("id"), F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(F.lit("wrong_color"))).otherwise(F.array(F.lit("wrong_text"))).alias("general_types"), (k % 3 != 0).alias("text_kept"),
        F.when(k % 5 == 0, " ").otherwise(F.col("p_brand")).alias("general_summary"), F.when(k % 7 == 0, "n").alias("general_note"), F.array(F.concat(F.lit("Color "), "p_brand"), "p_name", F.upper("p_name")).alias("general_bullets"),
        F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, F.col("p_brand")).otherwise(F.col("p_type")).alias("text_summary"), F.lit(None).cast("string").alias("text_note"), F.array(F.lower("p_name"), F.lit(" x ")).alias("text_bullets"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("m"))).otherwise(none).alias("messages"))
    return report.merged_comments(rows).select("id", "summary", F.array_join("bullets", "|").alias("bullets"), "note")


@query("""with r as (select p_partkey as slide, case when p_size % 3 = 0 then 'findings' when p_size % 3 = 1 then 'manual_review' else 'ok' end as status, case when p_size % 4 = 0 then null else p_name end as summary,
 case when p_size % 5 = 0 then [] else list_transform(range(p_size % 12), lambda i: 'b' || i) end as bullets, case when p_size % 7 = 0 then null else ' note ' || p_brand || ' ' || chr(10) || 'more' end as note from part),
 k as (select *, coalesce(nullif(trim(summary), ''), trim(split_part(trim(note), chr(10), 1))) as head, case when status = 'findings' and (coalesce(summary, '') <> '' or len(bullets) > 0 or coalesce(note, '') <> '') then 'summary' when status = 'manual_review' and note is not null then 'manual_review' end as kind from r),
 z as (select *, floor(12192000 * case when kind = 'summary' then 0.42::double else 0.38::double end)::int as w, floor(6858000 * case when kind = 'summary' then least(0.42::double, 0.10::double + greatest(1, len(bullets)) * 0.045::double) else 0.08::double end)::int as h from k where kind is not null)
 select slide, kind, (12192000 - w - floor(12192000 * 0.03::double)::int)::int as left, (6858000 - h - floor(6858000 * 0.03::double)::int)::int as top, w as width, h as height,
 case when kind = 'summary' then array_to_string(list_filter([head], lambda v: v is not null and v <> '') || case when len(bullets) > 0 then list_transform(bullets, lambda b: '• ' || b) when note is null then [] when head is null then [note] else ['• ' || note] end, '|') else note end as lines from z""")
def snk11_slide_notes(s, d):
    p, k = V.table(s, d, "part"), F.col("p_size")
    none = F.array().cast("array<string>")
    bullets = F.when((k % 5 == 0) | (k % 12 == 0), none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), k % 12 - 1)), lambda i: F.concat(F.lit("b"), i.cast("string"))))
    rows = p.select(F.col("p_partkey").alias("slide"), F.when(k % 3 == 0, "findings").when(k % 3 == 1, "manual_review").otherwise("ok").alias("status"), F.when(k % 4 != 0, F.col("p_name")).alias("summary"), bullets.alias("bullets"),
                    F.when(k % 7 != 0, F.concat(F.lit(" note "), "p_brand", F.lit(" \nmore"))).alias("note"))
    return report.slide_notes(rows, 12192000, 6858000).withColumn("lines", F.array_join("lines", "|"))


# The whole rule review, from matches on, in SQL: map, text findings, regions, suppression, dedup.
_MAPPED = """rot as (select rp.*, angle, [x0, x1, x1, x0] as xs, [y0, y0, y1, y1] as ys from rp join pg using (slide)),
 tur as (select *, case angle when 90 then ys when 180 then list_transform(xs, lambda v: 1 - v) when 270 then list_transform(ys, lambda v: 1 - v) else xs end as rx,
  case angle when 90 then list_transform(xs, lambda v: 1 - v) when 180 then list_transform(ys, lambda v: 1 - v) when 270 then xs else ys end as ry from rot),
 mp as (select slide, ord, n_lines, blank, greatest(0, least(1, (list_min(rx) * 900 + 30) / 1000.0::double)) as x0, greatest(0, least(1, (list_min(ry) * 700 + 20) / 750.0::double)) as y0,
  greatest(0, least(1, (list_max(rx) * 900 + 30) / 1000.0::double)) as x1, greatest(0, least(1, (list_max(ry) * 700 + 20) / 750.0::double)) as y1 from tur)"""
_DRIFT = """(abs(a.x0 - b.x0) >= 0.026::double or abs(a.y0 - b.y0) >= 0.028::double or sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) ** 2 + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) ** 2) >= 0.036::double or abs((a.x1 - a.x0) - (b.x1 - b.x0)) >= 0.05::double)"""
_TEXT = f"""jt as (select m.slide, m.ref_ord, m.cand_ord, m.score, case when cand_ord is null then 'missing' when score >= 0.98::double and b.n_lines > a.n_lines and not a.blank then 'breaks' when score >= 0.92::double and {_DRIFT} then 'drifts' end as why,
  a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1, a.n_lines as an, b.n_lines as bn
  from mt m join mp a on a.slide = m.slide and a.ord = m.ref_ord left join cp b on b.slide = m.slide and b.ord = m.cand_ord),
 tf as (select slide, case when why = 'missing' then ref_ord else 1000000000 + ref_ord end as ord, case why when 'missing' then 'missing_content' when 'breaks' then 'line_break_issue' else 'size_position_issue' end as type,
  case when why = 'missing' then 'high' else 'medium' end as severity, case why when 'missing' then 0.88::double when 'breaks' then least(0.96::double, 0.80::double + (bn - an) * 0.06::double) else least(0.94::double, greatest(score, 0.82::double)) end as confidence,
  case why when 'missing' then 'Text or content from the PDF appears to be missing on this slide.' when 'breaks' then 'Paragraph wraps into ' || bn || ' lines on the slide versus ' || an || ' lines in the PDF.' else 'Matched content is in the wrong size or position compared with the PDF reference.' end as message,
  case why when 'missing' then ax0 when 'breaks' then bx0 else least(ax0, bx0) end as x0, case why when 'missing' then ay0 when 'breaks' then by0 else least(ay0, by0) end as y0,
  case why when 'missing' then ax1 when 'breaks' then bx1 else greatest(ax1, bx1) end as x1, case why when 'missing' then ay1 when 'breaks' then by1 else greatest(ay1, by1) end as y1 from jt where why is not null)"""
_REGIONS = f"""ra as (select slide, (case kind when 'missing' then 2 when 'geometry' then 3 else 4 end)::bigint * 1000000000 + ord as ord, kind = 'missing' as fixed, kind, area_ratio, x0, y0, x1, y1 from rg
  where kind <> 'missing' or not exists (select 1 from mp where mp.slide = rg.slide and {V.sql_overlap('rg', 'mp')} >= 0.35::double)),
 al as (select slide, ord, true as fixed, x0, y0, x1, y1 from tf union all select slide, ord, fixed, x0, y0, x1, y1 from ra),
 ag as (select slide, list(struct_pack(ord := ord, x0 := x0, y0 := y0, x1 := x1, y1 := y1, fixed := fixed) order by ord) as rows from al group by slide),
 ah as (select slide, unnest(list_reduce(list_transform(rows, lambda r: [r]), lambda acc, x: case when not x[1].fixed and len(list_filter(acc, lambda k: {V.sql_overlap('x[1]', 'k')} >= 0.55::double)) > 0 then acc else acc || x end)).ord as ord from ag),
 rf as (select ra.slide, ra.ord, case kind when 'missing' then 'missing_content' when 'geometry' then 'size_position_issue' else 'wrong_color' end as type, case when kind = 'missing' then 'high' else 'medium' end as severity,
  case kind when 'missing' then least(0.95::double, 0.72::double + area_ratio * 18) when 'geometry' then least(0.93::double, 0.70::double + area_ratio * 16) else least(0.92::double, 0.72::double + area_ratio * 16) end as confidence,
  case kind when 'missing' then 'A visual element from the PDF appears to be missing on this slide.' when 'geometry' then 'An element appears to be in the wrong size or position compared with the PDF reference.' else 'An element appears to use the wrong color compared with the PDF reference.' end as message, x0, y0, x1, y1
  from ra join ah using (slide, ord)),
 ev as (select *, row_number() over (partition by slide order by ord) as id from (select * from tf union all select * from rf)),
 dg as (select slide, type, list(struct_pack(ord := id, x0 := x0, y0 := y0, x1 := x1, y1 := y1) order by id) as rows from ev group by slide, type),
 dh as (select slide, unnest(list_reduce(list_transform(rows, lambda r: [r]), lambda acc, x: case when len(list_filter(acc, lambda k: {V.sql_iou('k', 'x[1]')} >= 0.72::double)) > 0 then acc else acc || x end)).ord as id from dg),
 fin as (select ev.* from ev join dh using (slide, id))"""
_RULE = f"with {V.SQL_PARAGRAPHS}, {_MAPPED}, {_TEXT}, {_REGIONS}"


@query(f"{_RULE} select slide, id as finding_id, type, severity, round(greatest(0, least(1, confidence)), 6) as confidence, message, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1 from fin")
def pl1_rule_findings(s, d):
    found = rule_qc.findings(*V.paragraph_rows(s, d))
    return _flat(found.withColumn("confidence", F.round("confidence", 6)), "slide", "finding_id", "type", "severity", "confidence", "message")


@query(f"{C._REVIEWED}, {_MAPPED}, {_TEXT}, {_REGIONS} select slide, id as finding_id, type, severity, round(greatest(0, least(1, confidence)), 6) as confidence, message, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1 from fin")
def pl1_texts_to_findings(s, d):
    found = C._whole_review(s, d)
    return _flat(found.withColumn("confidence", F.round("confidence", 6)), "slide", "finding_id", "type", "severity", "confidence", "message")


@query(f"""{_RULE}, n as (select slide, count(*) as n from fin group by slide)
 select pg.slide, coalesce(n, 0) as n_findings, case when similarity < 0.28::double or (ocr and ocr_confidence < 0.55::double) then 'manual_review' when coalesce(n, 0) > 0 then 'findings' else 'ok' end as status,
 case when ocr and ocr_confidence < 0.55::double then 'Reference OCR confidence is too low for reliable automated QC.' when similarity < 0.28::double then 'Page alignment confidence is too low for automated QC.'
  when total_characters = 0 and not ocr then 'Visual-only QC was used because the reference PDF does not expose text.' end as note, round(similarity, 6) as alignment_confidence from pg left join n using (slide)""")
def pl2_flt13_rule_results(s, d):
    matches, reference, candidate, regions, pages = V.paragraph_rows(s, d)
    found = rule_qc.findings(matches, reference, candidate, regions, pages)
    return rule_qc.results(pages, found).withColumn("alignment_confidence", F.round("alignment_confidence", 6))


@query(f"""{_RULE} select slide, (select count(*) from jt j where j.slide = pg.slide and why = 'breaks') as breaks, (select count(*) from jt j where j.slide = pg.slide and why = 'drifts') as drifts from pg""")
def flt9_line_breaks(s, d):
    matches, reference, candidate, _, pages = V.paragraph_rows(s, d)
    found = rule_qc.text_findings(matches, rule_qc.mapped(reference, pages), candidate)
    n = found.groupBy("slide").agg(F.count_if(F.col("type") == "line_break_issue").alias("breaks"), F.count_if(F.col("type") == "size_position_issue").alias("drifts"))
    return pages.select("slide").join(n, "slide", "left").select("slide", F.coalesce("breaks", F.lit(0)).alias("breaks"), F.coalesce("drifts", F.lit(0)).alias("drifts"))


# Greedy one-to-one matching over given scores: each reference takes the best candidate that is left.
_ITEMS = "select l_orderkey as page, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ord from lineitem"


@query(f"""with i as ({_ITEMS}), c as (select page, r.ord as ref_ord, c.ord as cand_ord, ((r.l_partkey * 7 + c.l_suppkey * 13 + r.ord * c.ord * 31) % 101) / 100.0::double as score from i r join i c using (page)),
 s as (select page, ref_ord, list(struct_pack(c := cand_ord, s := score) order by score desc, cand_ord) as l from c where score > 0 group by all),
 g as (select page, list(ref_ord order by ref_ord) as refs, list(l order by ref_ord) as ls from s group by page),
 z as (select page, refs, list_reduce(ls, lambda acc, x: acc || [coalesce(list_filter(x, lambda k: k.s >= 0.72::double and not coalesce(list_contains(list_transform(acc, lambda a: a.c), k.c), false))[1], struct_pack(c := null::bigint, s := null::double))], []::struct(c bigint, s double)[]) as picks from g)
 select page, unnest(refs)::bigint as ref_ord, coalesce(unnest(picks).c, -1)::bigint as cand_ord, coalesce(unnest(picks).s, -1) as score from z""")
def jn3_greedy_by_score(s, d):
    from folioqc.functions import fuzzy

    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("bigint")
    items = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("page"), "l_partkey", "l_suppkey", nth.alias("ord"))
    r, c = items.select("page", F.col("ord").alias("ref_ord"), "l_partkey"), items.select("page", F.col("ord").alias("cand_ord"), "l_suppkey")
    score = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("ref_ord") * F.col("cand_ord") * 31) % 101 / 100.0
    scores = r.join(c, "page").select("page", "ref_ord", "cand_ord", score.alias("score")).where("score > 0")
    return fuzzy.greedy_by_score(scores).select("page", "ref_ord", F.coalesce("cand_ord", F.lit(-1)).alias("cand_ord"), F.coalesce("score", F.lit(-1.0)).alias("score"))


# Scores of reference and candidate items of a slide: given text scores, positions of their boxes.
_SCORED = f"""{_F}, r as (select * from f where type = 'wrong_text'), c as (select * from f where type = 'wrong_color'),
 sc as (select r.slide as page, r.ord as ref_ord, c.ord as cand_ord, ((r.ord * 7 + c.ord * 13) % 101) / 100.0::double as text, greatest(0, 1 - sqrt(((r.x0 + r.x1) / 2 - (c.x0 + c.x1) / 2) ** 2 + ((r.y0 + r.y1) / 2 - (c.y0 + c.y1) / 2) ** 2) / 1.2::double) as position,
  {V.sql_cell('r')} = {V.sql_cell('c')} as same from r join c on r.slide = c.slide)"""


def _scored(s, d):
    from folioqc.functions import fuzzy

    f = V.findings(s, d)
    r = f.where("type = 'wrong_text'").select(F.col("slide").alias("page"), F.col("ord").alias("ref_ord"), F.col("bbox").alias("a"))
    c = f.where("type = 'wrong_color'").select(F.col("slide").alias("page"), F.col("ord").alias("cand_ord"), F.col("bbox").alias("b"))
    text = (F.col("ref_ord") * 7 + F.col("cand_ord") * 13) % 101 / 100.0
    both = r.join(c, "page").withColumn("text", text)
    return both.select("page", "ref_ord", "cand_ord", "text", G.position_similarity(F.col("a"), F.col("b")).alias("position"), fuzzy.combined_score(F.col("text"), F.col("a"), F.col("b")).alias("score"))


@query(f"""{_SCORED}, st as (select page, ref_ord, list(struct_pack(c := cand_ord, s := round(text * 0.55::double + position * 0.45::double + case when same then 0.04::double else 0 end, 9)) order by round(text * 0.55::double + position * 0.45::double + case when same then 0.04::double else 0 end, 9) desc, cand_ord) as l from sc group by all),
 gg as (select page, list(ref_ord order by ref_ord) as refs, list(l order by ref_ord) as ls from st group by page),
 zz as (select page, refs, list_reduce(ls, lambda acc, x: acc || [coalesce(list_filter(x, lambda q: not coalesce(list_contains(list_transform(acc, lambda e: e.c), q.c), false))[1], struct_pack(c := null::bigint, s := null::double))], []::struct(c bigint, s double)[]) as picks from gg)
 select page, unnest(refs)::bigint as ref_ord, coalesce(unnest(picks).c, -1)::bigint as cand_ord, round(coalesce(unnest(picks).s, -1), 6) as score from zz""")
def jn4_combined_matches(s, d):
    from folioqc.functions import fuzzy

    # As the SQL rounds: the binary product, not the shortest decimal, decides on halves.
    rounded = lambda c, n: F.floor(F.col(c) * 10.0**n + 0.5) / 10.0**n
    scores = _scored(s, d).select("page", "ref_ord", "cand_ord", rounded("score", 9).alias("score"))
    return fuzzy.greedy_by_score(scores, 0.0).select("page", "ref_ord", F.coalesce("cand_ord", F.lit(-1)).alias("cand_ord"), F.coalesce(rounded("score", 6), F.lit(-1.0)).alias("score"))


@query(f"""{_SCORED}, m as (select page, ref_ord, text, position, row_number() over (partition by page, ref_ord order by text desc, position desc) as n from sc) select page, ref_ord, round(text, 6) as text, round(position, 6) as position from m where n = 1""")
def jn12_nearest_scores(s, d):
    from folioqc.functions import fuzzy

    found = fuzzy.nearest_by_score(_scored(s, d).select("page", "ref_ord", "text", "position"))
    return found.select("page", "ref_ord", F.round("text", 6).alias("text"), F.round("position", 6).alias("position"))


# The ratio itself: the longest common block, the first in a and then in b, and again on both sides of it.
@query("""with recursive p as (select p_partkey as id, p_brand || p_size as a, case when p_partkey % 2 = 0 then reverse(p_brand) || p_partkey % 10 else 'Brand#' || p_size || p_brand[1:3] end as b from part),
 s as (select id, a, b, 1 as alo, length(a)::int + 1 as ahi, 1 as blo, length(b)::int + 1 as bhi, 0 as k from p
  union all select id, a, b, h.alo, h.ahi, h.blo, h.bhi, h.k from (select id, a, b, unnest(case when m.k > 0 then [struct_pack(alo := alo, ahi := m.i, blo := blo, bhi := m.j, k := m.k), struct_pack(alo := m.i + m.k, ahi := ahi, blo := m.j + m.k, bhi := bhi, k := 0)] else [] end) as h from (
   select *, (list_reverse_sort(list_transform(range((ahi - alo) * (bhi - blo)), lambda t: struct_pack(k := len(list_filter(range(1, least(ahi - (alo + t // (bhi - blo)), bhi - (blo + t % (bhi - blo))) + 1), lambda q: a[alo + t // (bhi - blo):alo + t // (bhi - blo) + q - 1] = b[blo + t % (bhi - blo):blo + t % (bhi - blo) + q - 1]))::int,
    ni := -(alo + t // (bhi - blo))::int, nj := -(blo + t % (bhi - blo))::int, i := (alo + t // (bhi - blo))::int, j := (blo + t % (bhi - blo))::int))))[1] as m from s where ahi > alo and bhi > blo) where m.k > 0))
 select id, round(2.0::double * sum(k) / (any_value(length(a)) + any_value(length(b))), 6) as ratio from s group by id""")
def fn3_ratios(s, d):
    from folioqc.functions import fuzzy

    p, i, size = V.table(s, d, "part"), F.col("p_partkey"), F.col("p_size").cast("string")
    b = F.when(i % 2 == 0, F.concat(F.reverse("p_brand"), (i % 10).cast("string"))).otherwise(F.concat(F.lit("Brand#"), size, F.substring("p_brand", 1, 3)))
    return p.select(i.alias("id"), F.round(fuzzy.similarity(F.concat("p_brand", size), b), 6).alias("ratio"))
