"""Queries over packages, rasters, geometry, jobs and model responses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioqc.functions import geometry as G
from folioqc.functions import text as X
from folioqc.operators import raster
from folioqc.plans import catalog as C
from folioqc.plans import conversion, model_qc
from folioqc.plans import views as V
from folioqc.plans.registry import query
from folioqc.sources import files, ooxml, png
from folioqc.streaming import intake

_F = f"with {V.SQL_FINDINGS}"
_B = ("x0", "y0", "x1", "y1")

# Packages: a deck for each conversation, a slide for each user turn, its lines as paragraphs of a
# frame, or cells of a table on every third slide.
_DECK = rf"""with {V.SQL_REF}, ln as (select job_id, page_index, generate_subscripts(string_split(text, chr(10)), 1) as nth, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) as text from ref),
 sh as (select job_id, page_index, (row_number() over (partition by job_id, page_index order by nth) - 1)::int as ord, case when page_index % 3 = 2 then 'table_cell' else 'paragraph' end as kind, text from ln where text <> '')"""


def _decks(s, d):
    p = V.pages(s, d, "user")
    shape = F.struct((F.lit(100) + F.col("page_index")).alias("left"), F.lit(200).alias("top"), F.lit(3000).alias("width"), F.lit(400).alias("height"), F.when(F.col("page_index") % 3 == 2, "table").otherwise("text").alias("kind"), F.split("text", "\n").alias("texts"))
    return ooxml.written(p.select(F.concat(F.lit("deck-"), F.col("job_id").cast("string"), F.lit(".pptx")).alias("path"), "page_index", F.array(shape).alias("shapes")))


@query(f"{_DECK} select 'deck-' || job_id || '.pptx' as path, page_index as slide_index, ord, kind, (100 + page_index)::bigint as left, 200::bigint as top, 3000::bigint as width, 400::bigint as height, text from sh")
def src5_src6_src7_slide_text(s, d):
    return ooxml.slide_text(_decks(s, d))


@query(f"with {V.SQL_REF} select 'deck-' || job_id || '.pptx' as path, count(*) as slides, 9144000::bigint as width, 6858000::bigint as height from ref group by job_id")
def src8_slide_metrics(s, d):
    return ooxml.slide_metrics(_decks(s, d))


def _pictures(s, d):
    """A picture after each slide that has a reference page, one at the end for each other page."""
    p = V.pages(s, d, "assistant").join(V.pages(s, d, "user").select("job_id", "page_index", F.lit(True).alias("has")), ["job_id", "page_index"], "left")
    name = F.concat(F.lit("page-"), F.col("page_index").cast("string"), F.when(F.col("page_index") % 2 == 0, ".png").otherwise(".jpg"))
    return p.select(F.concat(F.lit("deck-"), F.col("job_id").cast("string"), F.lit(".pptx")).alias("path"), F.col("page_index").alias("ord"), F.when(F.col("has"), F.col("page_index")).alias("after"), name.alias("name"), F.col("text").cast("binary").alias("data"))


def _patched(s, d):
    return ooxml.with_reference_slides(_decks(s, d).join(_pictures(s, d).select("path").distinct(), "path", "left_semi"), _pictures(s, d))


_PATCH = f"with {V.SQL_REF}, {V.SQL_CAND}, pc as (select c.job_id, c.page_index, r.job_id is not null as has, strlen(c.text) as bytes from cand c left join ref r using (job_id, page_index)), n as (select job_id, count(*) as n from ref group by 1)"


@query(f"""{_PATCH}, od as (select job_id, page_index, 0 as late, 0 as part, null::boolean as has from ref where job_id in (select job_id from pc) union all select job_id, page_index, case when has then 0 else 1 end, 1, has from pc),
 nu as (select job_id, page_index, (select n from n where n.job_id = pc.job_id) + row_number() over (partition by job_id order by not has, page_index) as k from pc),
 ps as (select od.job_id, row_number() over (partition by od.job_id order by late, od.page_index, part) - 1 as position, part, od.page_index, coalesce(k, od.page_index + 1) as number from od left join nu on part = 1 and nu.job_id = od.job_id and nu.page_index = od.page_index)
 select 'deck-' || job_id || '.pptx' as path, position::int as position, 'ppt/slides/slide' || number || '.xml' as part, case when part = 1 then 'PDF_ORIGINAL' else '' end as name from ps""")
def snk2_snk3_patched_order(s, d):
    decks = _patched(s, d)
    names = ooxml.slide_names(decks)
    return ooxml.slide_parts(decks).join(names, ["path", "part"], "left").select("path", "position", "part", F.coalesce("name", F.lit("")).alias("name"))


@query(f"""{_PATCH}, k as (select job_id, row_number() over (partition by job_id order by not has, page_index) as k, page_index, strlen(text) as bytes from (select pc.*, cand.text from pc join cand using (job_id, page_index)))
 select 'deck-' || job_id || '.pptx' as path, 'ppt/media/image' || k || case when page_index % 2 = 0 then '.png' else '.jpg' end as part, bytes::bigint as size from k""")
def snk3_media_parts(s, d):
    return ooxml.parts(_patched(s, d)).where("part like 'ppt/media/%'").select("path", "part", "size")


@query(f"""{_PATCH} select 'deck-' || job_id || '.pptx' as path, (any_value(n) + count(*) + 1)::bigint as next_slide, (count(*) + 1)::bigint as next_image from pc join n using (job_id) group by job_id""")
def ag12_next_ids(s, d):
    return ooxml.next_numbers(ooxml.parts(_patched(s, d)), next_slide="^ppt/slides/slide([0-9]+)[.]xml$", next_image="^ppt/media/image([0-9]+)[.][^.]+$")


@query(f"{_PATCH} select 'deck-' || job_id || '.pptx' as path, count(*) as named, 0::bigint as numbered from pc group by job_id")
def snk13_one_name(s, d):
    names = ooxml.slide_names(ooxml.one_name(ooxml.numbered_names(_patched(s, d))))
    return names.groupBy("path").agg(F.count_if(F.col("name") == "PDF_ORIGINAL").alias("named"), F.count_if(F.col("name").startswith("PDF_ORIGINAL_")).alias("numbered"))


@query("""with e as (select distinct p_size as path, p_partkey % 12 as n from part), t as (select path, n from e where n >= 1),
 w as (select p_size as path, p_partkey as ord, row_number() over (partition by p_size order by p_partkey) as k from part),
 c as (select path, unnest(range(1, 2000)) as n from (select distinct path from w)), f as (select c.path, c.n, row_number() over (partition by c.path order by c.n) as k from c where not exists (select 1 from t where t.path = c.path and t.n = c.n))
 select w.path::varchar as path, w.ord, 'PDF_ORIGINAL_' || lpad(f.n::varchar, greatest(3, length(f.n::varchar))::int, '0') as name from w join f using (path, k)""")
def sup11_unique_names(s, d):
    p = V.table(s, d, "part").withColumn("path", F.col("p_size").cast("string"))
    existing = p.select("path", F.concat(F.lit("PDF_ORIGINAL_"), F.lpad((F.col("p_partkey") % 12).cast("string"), 3, "0")).alias("name"))
    return ooxml.unique_names(existing, p.select("path", F.col("p_partkey").alias("ord")))


@query("""select p_brand as path, coalesce(min('slideLayout' || p_partkey || '.xml') filter (p_size % 10 = 0), min('slideLayout' || p_partkey || '.xml')) as part from part group by p_brand""")
def sup8_blank_layout(s, d):
    layouts = V.table(s, d, "part").select(F.col("p_brand").alias("path"), F.concat(F.lit("slideLayout"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("part"), F.when(F.col("p_size") % 10 == 0, "blank").when(F.col("p_size") % 10 == 1, "title").alias("type"))
    return ooxml.blank_layout(layouts)


# Geometry that no other query covers.
_OUT = ", ".join(f"round({n}, 6) as {n}" for n in _B)


@query(f"""{_F}, a as (select slide, ord, x0 * 1.4::double - 0.2::double as a0, y1 as a1, x1 - 0.3::double as a2, y0 * 1.2::double as a3, ord % 9 = 0 as short from f), c as (select *, greatest(0, least(1, a0)) as b0, greatest(0, least(1, a1)) as b1, greatest(0, least(1, a2)) as b2, greatest(0, least(1, a3)) as b3 from a)
 select slide, ord, round(case when short then 0 else least(b0, b2) end, 6) as x0, round(case when short then 0 else least(b1, b3) end, 6) as y0, round(case when short then 1 else greatest(b0, b2) end, 6) as x1, round(case when short then 1 else greatest(b1, b3) end, 6) as y1 from c""")
def ge6_ordered_boxes(s, d):
    b = F.col("bbox")
    sides = F.array(b["x0"] * 1.4 - 0.2, b["y1"], b["x1"] - 0.3, b["y0"] * 1.2)
    boxed = V.findings(s, d).withColumn("bbox", G.from_array(F.when(F.col("ord") % 9 == 0, F.slice(sides, 1, 3)).otherwise(sides)))
    return C._corners(boxed, "slide", "ord")


@query(f"""{_F} select slide, ord, round(case when ord % 7 = 0 then 0 when ord % 2 = 0 then greatest(0, least(1, x0 * 1.1::double)) else greatest(0, least(1, x0 * 700 / 640.0::double)) end, 6) as x0, round(case when ord % 7 = 0 then 0 when ord % 2 = 0 then least(1, y0) else least(1, y0 * 500 / 480.0::double) end, 6) as y0,
 round(case when ord % 7 = 0 then 1 when ord % 2 = 0 then greatest(0, least(1, x1 * 1.1::double)) else greatest(0, least(1, x1 * 700 / 640.0::double)) end, 6) as x1, round(case when ord % 7 = 0 then 1 when ord % 2 = 0 then least(1, y1) else least(1, y1 * 500 / 480.0::double) end, 6) as y1 from f""")
def ge7_page_units(s, d):
    b, even = F.col("bbox"), F.col("ord") % 2 == 0
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = lambda kx, ky: F.array(point(b["x1"] * kx, b["y0"] * ky), point(b["x0"] * kx, b["y1"] * ky))
    xy = F.when(F.col("ord") % 7 == 0, F.slice(corners(1.0, 1.0), 1, 0)).when(even, corners(1.1, 1.0)).otherwise(corners(700.0, 500.0))
    hull = G.hull_of_points(F.struct(even.alias("normalized"), xy.alias("xy")), F.lit(640.0), F.lit(480.0))
    scaled = G.scaled(G.box(b["x0"] * 700, b["y0"] * 500, b["x1"] * 700, b["y1"] * 500), F.lit(640.0), F.lit(480.0))
    return C._corners(V.findings(s, d).withColumn("bbox", F.when(~even & (F.col("ord") % 7 != 0), scaled).otherwise(hull)), "slide", "ord")


@query(f"""{_F} select slide, ord, round(greatest(0, least(1, (x0 * 600 + 20) / 640.0::double)), 6) as x0, round(greatest(0, least(1, (y0 * 450 + 15) / 480.0::double)), 6) as y0, round(greatest(0, least(1, (x1 * 600 + 20) / 640.0::double)), 6) as x1, round(greatest(0, least(1, (y1 * 450 + 15) / 480.0::double)), 6) as y1 from f""")
def ge12_on_canvas(s, d):
    f = V.findings(s, d)
    return C._corners(f.withColumn("bbox", G.fitted(F.col("bbox"), *map(F.lit, (640, 480, 20, 15, 600, 450)))), "slide", "ord")


@query("""select l_orderkey, l_linenumber, l_extendedprice as price, round_even(l_quantity * 1.25::double, 0)::int as x, round_even(l_partkey % 90 * 0.5::double, 0)::int as y, greatest(1, round_even(l_linenumber * 1.25::double, 0)::int) as w, greatest(1, round_even((l_suppkey % 3) * 0.25::double, 0)::int) as h,
 (case when l_suppkey % 5 = 0 then 800 else greatest(640, round_even(640 * greatest(1, least(800 / 640.0::double, (300 + l_partkey % 400) / 480.0::double)), 0)) end)::int as out_w, (case when l_suppkey % 5 = 0 then 300 + l_partkey % 400 else greatest(480, round_even(480 * greatest(1, least(800 / 640.0::double, (300 + l_partkey % 400) / 480.0::double)), 0)) end)::int as out_h from lineitem""")
def ge14_ge16_pixel_sizes(s, d):
    li = V.table(s, d, "lineitem")
    box = G.scaled_pixel_box(F.col("l_quantity"), F.col("l_partkey") % 90, F.col("l_linenumber"), F.col("l_suppkey") % 3, F.lit(1.25), F.when(F.lit(True), F.lit(0.5)))
    short = G.scaled_pixels(F.col("l_suppkey") % 3, F.lit(0.25))
    rh = (F.lit(300) + F.col("l_partkey") % 400).cast("int")
    size = G.preferred_size(F.lit(800), rh, F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(640), F.lit(480))
    return li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), box["x"].alias("x"), box["y"].alias("y"), box["w"].alias("w"), short.alias("h"), size["w"].alias("out_w"), size["h"].alias("out_h"))


# Rasters: 8 x 8 grids of embeddings.
@query(f"{C._NCC} select vec_id, round(case when sqrt(list_dot_product(g, g)) * sqrt(list_dot_product(h, h)) = 0 then -1 else list_dot_product(g, h) / (sqrt(list_dot_product(g, g)) * sqrt(list_dot_product(h, h))) end, 6) as score from q")
def ag9_correlation(s, d):
    return V.raster_pairs(s, d).select("vec_id", F.round(raster.ncc(F.col("grid"), F.col("other")), 6).alias("score"))


@query(f"""{C._NCC}, t as (select vec_id, g, h, {C._TURN} as h90 from q), u as (select vec_id, g, h, h90, list_transform(range(64), lambda i: h90[(i % 8) * 8 + 8 - (i // 8)]) as h180 from t),
 w as (select vec_id, list_dot_product(g, h) as s0, list_dot_product(g, h90) as s1, list_dot_product(g, list_transform(range(64), lambda i: h180[(i % 8) * 8 + 8 - (i // 8)])) as s2 from u)
 select vec_id, case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 90 else 270 end::int as angle from w""")
def ag8_im1_best_rotation(s, d):
    return raster.best_turns(V.raster_pairs(s, d), 8)


def _neighbours(m: str, how: str) -> str:
    return f"list_transform(range(64), lambda i: list_{how}(list_transform(list_filter(range(64), lambda j: abs(j % 8 - i % 8) <= 1 and abs(j // 8 - i // 8) <= 1), lambda j: {m}[j + 1])))"


_SOFT = ("list_transform(range(64), lambda i: list_sum(list_transform(range(25), lambda t: [1, 4, 6, 4, 1][t % 5 + 1] * [1, 4, 6, 4, 1][t // 5 + 1] * "
         "{m}[(7 - abs(7 - abs(i // 8 + t // 5 - 2))) * 8 + (7 - abs(7 - abs(i % 8 + t % 5 - 2))) + 1])) / 256.0::double)")
_MASK = "list_transform({v}, lambda v: case when v < 248 then 1 else 0 end)"
_MORPH = f"""with {V.SQL_GREY}, bl as (select vec_id, {_SOFT.format(m='ref')} as a, {_SOFT.format(m='cand')} as b from pairs), mk as (select vec_id, {_MASK.format(v='a')} as a, {_MASK.format(v='b')} as b from bl),
 m0 as (select vec_id, a, list_transform(range(64), lambda i: a[i + 1] * (1 - b[i + 1])) as m, list_transform(range(64), lambda i: abs(a[i + 1] - b[i + 1])) as x from mk),
 m1 as (select vec_id, a, {_neighbours('m', 'min')} as m, {_neighbours('x', 'min')} as x from m0), m2 as (select vec_id, a, {_neighbours('m', 'max')} as m, {_neighbours('x', 'max')} as x from m1),
 m3 as (select vec_id, a, {_neighbours('m', 'max')} as m, {_neighbours('x', 'max')} as x from m2), m4 as (select vec_id, a, {_neighbours('m', 'min')} as m, {_neighbours('x', 'min')} as x from m3),
 m5 as (select vec_id, a, m, {_neighbours('x', 'max')} as x from m4)"""


@query(f"{_MORPH} select vec_id, array_to_string(a, '') as content, array_to_string(m, '') as missing, array_to_string(x, '') as geometry from m5")
def im3_im5_im6_masks(s, d):
    found = raster.masks_of_grids(V.grey_pairs(s, d), 8)
    return found.select("vec_id", *(F.array_join(F.col(c).cast("array<string>"), "").alias(c) for c in ("content", "missing", "geometry")))


@query(f"""{C._CC}, rg as (select vec_id, root, min(x)::int as x0, min(y)::int as y0, max(x)::int as x1, max(y)::int as y1, count(*)::int as area from lab group by vec_id, root)
 select vec_id, (row_number() over (partition by vec_id order by root) - 1)::int as region_ord, x0, y0, x1, y1, area from rg where area >= 3 and area / 64.0::double >= 0.06::double""")
def flt7_gated_components(s, d):
    return raster.components(V.rasters(s, d), 8, 0.0, 3, 0.06)


@query(f"""with {V.SQL_GREY}, c as (select vec_id, list_transform(ref, lambda v: v::int) as g from pairs) select vec_id, 8::int as height, 8::int as width, list_sum(g)::bigint as total, list_sum(list_transform(range(64), lambda i: g[i + 1] * (i + 1)))::bigint as weighted from c""")
def src3_snk6_png_round_trip(s, d):
    images = png.page_images(raster.grids_as_png(V.grey_pairs(s, d), 8), ["vec_id"])
    byte = lambda i: F.conv(F.hex(F.substring("content", i + 1, 1)), 16, 10).cast("bigint")
    cells = images.select("vec_id", "height", "width", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: byte(i * 3)).alias("g"))
    total = F.aggregate("g", F.lit(0).cast("bigint"), lambda a, v: a + v)
    weighted = F.aggregate(F.transform("g", lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return cells.select("vec_id", "height", "width", total.alias("total"), weighted.alias("weighted"))


# Jobs, their log and their answers.
@query("select user_id as job_id, arg_max(event_type, event_id) as state from events group by 1")
def str2_latest_state(s, d):
    return intake.latest_states(V.table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")))


_STATE = "case event_type when 'view' then 'queued' when 'click' then 'processing' when 'purchase' then 'completed' when 'error' then 'failed' else 'completed' end"


@query(f"""with j as (select c_custkey as job_id from customer), l as (select user_id as job_id, arg_max({_STATE}, event_id) as state from events group by 1)
 select j.job_id, state, coalesce(state = 'completed', false) as ready, (case when state is null then 404 when state = 'completed' then 200 else 409 end)::int as answer from j left join l using (job_id)""")
def snk12_status_answers(s, d):
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").otherwise("completed")
    log = V.table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state.alias("state"))
    return intake.status_answer(V.table(s, d, "customer").select(F.col("c_custkey").alias("job_id")), log)


@query("""with t as (select user_id as job_id, count(distinct event_id) as total from events group by 1), p as (select user_id as job_id, count(distinct event_id) as processed from events where event_type in ('view', 'click') group by 1)
 select t.job_id, coalesce(processed, 0) as processed, total, least(100, round(coalesce(processed, 0) * 100.0::double / total))::int as percent from t left join p using (job_id)""")
def ag17_str3_progress(s, d):
    e = V.table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("slide"), "event_type")
    finished = e.where("event_type in ('view', 'click')").select("job_id", "slide")
    return intake.progress(e.select("job_id", "slide"), finished.unionByName(finished.where("slide % 3 = 0")))


@query("""with s as (select user_id as session, event_id as seq, event_type || '::' || (event_id % 3) as fingerprint, value >= 20 as completed from events)
 select session, seq, fingerprint, coalesce(last_value(case when completed then fingerprint end ignore nulls) over (partition by session order by seq rows between unbounded preceding and 1 preceding) = fingerprint, false) as repeated from s""")
def str5_fn25_repeated_pairs(s, d):
    e = V.table(s, d, "events")
    rows = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), X.fingerprint("event_type", (F.col("event_id") % 3).cast("string")).alias("fingerprint"), (F.col("value") >= 20).alias("completed"))
    return intake.repeats_last(rows).select("session", "seq", "fingerprint", "repeated")


@query("select event_id from events where ts < timestamp '2024-01-01 12:00:00' - interval 24 hours or event_id < 0 union all select event_id from events where ts >= timestamp '2024-01-01 12:00:00' - interval 24 hours and ts < (select max(ts) from events) - interval 24 hours")
def str4_fn23_expired(s, d):
    e = V.table(s, d, "events")
    last = e.agg(F.max("ts").alias("last")).scalar()
    old = files.expired(e.withColumnRenamed("ts", "modificationTime"), 24, last)
    return old.select("event_id")


@query("""with r as (select event_id, case event_id % 8 when 0 then 'nonsense' when 1 then 'ok' else 'findings' end as st, case event_id % 5 when 0 then 'sparkles' else 'wrong_text' end as ty, case when event_id % 7 = 0 then 1.5 else 0.5 end as cf, event_id % 11 = 0 as short, event_id % 13 = 0 as broken from events),
 v as (select *, not broken and st in ('ok', 'findings') and ty = 'wrong_text' and cf <= 1 and not short as fits from r)
 select event_id as slide, case when fits then st end as status, (case when fits then 1 else 0 end)::int as n_findings, case when fits then null else 'response does not fit the schema' end as error, case when not fits then 'GPT slide comparison failed for this page: response does not fit the schema' end as note from v""")
def src12_pl4_responses(s, d):
    i = F.col("event_id")
    box = F.when(i % 11 == 0, "[0.1,0.2,0.3]").otherwise("[0.1,0.2,0.3,0.4]")
    finding = F.concat(F.lit('{"type":"'), F.when(i % 5 == 0, "sparkles").otherwise("wrong_text"), F.lit('","message":"m","confidence":'), F.when(i % 7 == 0, "1.5").otherwise("0.5"), F.lit(',"bbox":'), box, F.lit("}"))
    text = F.concat(F.lit('{"status":"'), F.when(i % 8 == 0, "nonsense").when(i % 8 == 1, "ok").otherwise("findings"), F.lit('","findings":['), finding, F.lit("]}"))
    answers = V.table(s, d, "events").select(i.alias("slide"), F.when(i % 13 == 0, F.lit("{")).otherwise(text).alias("json"), F.lit(None).cast("string").alias("error"))
    read = model_qc.parsed(answers)
    failed = model_qc.failed_pages(read).select("slide", "note")
    return read.join(failed, "slide", "left").select("slide", "result.status", F.coalesce(F.size("result.findings"), F.lit(0)).alias("n_findings"), "error", "note")


@query("""with s as (select c_custkey as job_id, c_nationkey % 4 + 1 as n_slides from customer), i as (select c_custkey as job_id, unnest(range(c_nationkey % 5)) from customer), n as (select job_id, count(*) as n from i group by 1)
 select s.job_id, 'PowerPoint slide-image export produced the wrong number of PNG files (' || coalesce(n, 0) || ' exported for ' || n_slides || ' slides).' as error from s left join n using (job_id) where coalesce(n, 0) <> n_slides""")
def src15_image_counts(s, d):
    c = V.table(s, d, "customer").withColumnRenamed("c_custkey", "job_id")
    images = c.select("job_id", F.explode(F.when(F.col("c_nationkey") % 5 > 0, F.sequence(F.lit(1), F.col("c_nationkey") % 5)).otherwise(F.array().cast("array<int>"))))
    return conversion.wrong_image_counts(c.select("job_id", (F.col("c_nationkey") % 4 + 1).alias("n_slides")), images)


@query("select event_type || '::' || user_id || '::' || (event_id % 3) as fingerprint, min(event_id) as first_id from events group by 1")
def st3_fn25_distinct_fingerprints(s, d):
    e = V.table(s, d, "events").withColumn("fingerprint", X.fingerprint("event_type", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")))
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("event_id"))
    return e.withColumn("n", first).where("n = 1").select("fingerprint", F.col("event_id").alias("first_id"))


@query(f"""{C._PLACED} select job_id, status, case when status <> 'extra_pdf_page' then page_index else -1 end as slide, case when status <> 'no_matching_pdf_page' then page_index else -1 end as page,
 case status when 'placed' then 'Prepared the PDF page as a full-slide reference image' when 'extra_pdf_page' then 'Appended unmatched PDF page as a new reference slide' else 'No matching PDF page for this slide' end as message from p""")
def pl5_sup7_placements(s, d):
    from folioqc.operators import placement

    found = placement.described(placement.place(*C._sides(s, d)))
    return found.select("job_id", "status", F.coalesce("candidate_slide_index", F.lit(-1)).alias("slide"), F.coalesce("reference_page_index", F.lit(-1)).alias("page"), "message")


@query(f"{C._SWAPPED} select job_id, page_index, status from p where status in ('placed', 'extra_pdf_page') and (job_id + page_index) % 3 <> 0")
def flt11_with_image(s, d):
    from folioqc.operators import placement

    a, b = C._sides(s, d)
    image = F.when((F.col("job_id") + F.col("page_index")) % 3 != 0, "p.png")
    return placement.with_image(placement.place(b, a).withColumn("image", image)).select("job_id", "page_index", "status")


# Notes on slides: a summary on even slides, a manual review on the others; read back with the text.
@query(f"""{_DECK}, nt as (select job_id, page_index, case when page_index % 2 = 0 then ['Slide ' || page_index, '• one', '• two'] else ['look & see'] end as l from ref),
 al as (select job_id, page_index, 0 as late, ord, kind, text from sh union all select job_id, page_index, 1, generate_subscripts(l, 1), 'paragraph', unnest(l) from nt)
 select 'deck-' || job_id || '.pptx' as path, page_index as slide_index, (row_number() over (partition by job_id, page_index order by late, ord) - 1)::int as ord, kind, text from al""")
def snk2_snk11_noted_decks(s, d):
    k = F.col("page_index")
    lines = F.when(k % 2 == 0, F.array(F.concat(F.lit("Slide "), k.cast("string")), F.lit("• one"), F.lit("• two"))).otherwise(F.array(F.lit("look & see")))
    notes = V.pages(s, d, "user").select(F.concat(F.lit("deck-"), F.col("job_id").cast("string"), F.lit(".pptx")).alias("path"), k.alias("slide_index"), F.when(k % 2 == 0, "summary").otherwise("manual_review").alias("kind"),
                                         *(F.lit(v).alias(n) for n, v in (("left", 1), ("top", 2), ("width", 30), ("height", 40))), lines.alias("lines"))
    return ooxml.slide_text(ooxml.with_notes(_decks(s, d), notes)).select("path", "slide_index", "ord", "kind", "text")


def _page(height, width, top, high):
    """RGB bytes of a white page with a black band across it."""
    row = lambda v, n: F.repeat(F.lit(v), n)
    return F.unhex(F.concat(row("FFFFFF", width * top), row("000000", width * high), row("FFFFFF", width * (height - top - high))))


@query("""select p_partkey as id, 0::int as off_x, greatest(0, least(20, (p_size % 30 + 4) - (p_partkey % 14 + 4)))::int as off_y, 40::int as scaled_w, 30::int as scaled_h from part""")
def im2_im4_fitted_pages(s, d):
    forty, high = F.lit(40), F.lit(8)
    pairs = V.spread(V.table(s, d, "part").select("p_partkey", "p_size")).select(
        F.col("p_partkey").alias("id"), F.lit(30).alias("ref_height"), forty.alias("ref_width"), _page(F.lit(30), forty, (F.col("p_partkey") % 14 + 4).cast("int"), high).alias("ref"),
        F.lit(50).alias("cand_height"), forty.alias("cand_width"), _page(F.lit(50), forty, (F.col("p_size") % 30 + 4).cast("int"), high).alias("cand"))
    return raster.fits(pairs)


@query("""with p as (select p_partkey as id, (20 + p_size % 30)::int as w, (19 + p_partkey % 40)::int as h from part) select id, h as height, w as width, ((w - 6) * (h - 6) - greatest(0, w - 18) * greatest(0, h - 18))::bigint as framed from p""")
def snk10_framed_pages(s, d):
    w, h = (F.lit(20) + F.col("p_size") % 30).cast("int"), (F.lit(19) + F.col("p_partkey") % 40).cast("int")
    pages = V.spread(V.table(s, d, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("id"), h.alias("height"), w.alias("width"), _page(h, w, F.lit(2), F.lit(1)).alias("image"))
    read = png.page_images(raster.framed_as_png(pages), ["id"])
    red = raster.pixels_of((0xDC, 0x28, 0x28))("content")
    return read.select("id", "height", "width", red.alias("framed"))


# Pages with one box each: what is missing, moved or recoloured, and what a model is shown.
_BOXES = "bx as (select n_nationkey::bigint as id, 150 as ph, (200 + n_nationkey % 3 * 20)::int as pw, (12 + n_nationkey * 3)::int as x, (10 + n_nationkey * 2)::int as y, (40 + n_regionkey * 5)::int as w, (30 + n_nationkey % 7 * 3)::int as h from nation)"


def _boxes(s, d, colour):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    at = lambda c: c.cast("int")
    return V.table(s, d, "nation").select(
        n.cast("bigint").alias("id"), F.lit(150).alias("height"), at(F.lit(200) + n % 3 * 20).alias("width"), at(F.lit(12) + n * 3).alias("x"), at(F.lit(10) + n * 2).alias("y"), at(F.lit(40) + r * 5).alias("w"),
        at(F.lit(30) + n % 7 * 3).alias("h"), *(F.lit(v).alias(k) for v, k in zip(colour, ("red", "green", "blue"))))


def _page_pairs(ref, cand):
    a = raster.painted_pages(ref).select(F.col("id").alias("job_id"), F.lit(0).alias("page_index"), F.col("height").alias("ref_height"), F.col("width").alias("ref_width"), F.col("image").alias("ref"))
    b = raster.painted_pages(cand).select(F.col("id").alias("job_id"), F.col("height").alias("cand_height"), F.col("width").alias("cand_width"), F.col("image").alias("cand"))
    return a.join(b, "job_id")


@query(f"""with {_BOXES} select id as job_id, 0::int as angle, round(-1.0::double, 6) as similarity, 'missing' as kind, round((x - 2) / pw::double, 6) as x0, round((y - 2) / ph::double, 6) as y0, round((x + w + 2) / pw::double, 6) as x1, round((y + h + 2) / ph::double, 6) as y1, round((w * h + 4 * w + 4 * h + 4) / (pw * ph)::double, 6) as area_ratio from bx
 union all select id, 0::int, -1.0::double, 'geometry', round((x - 3) / pw::double, 6), round((y - 3) / ph::double, 6), round((x + w + 3) / pw::double, 6), round((y + h + 3) / ph::double, 6), round((w * h + 6 * w + 6 * h + 24) / (pw * ph)::double, 6) from bx""")
def im12_missing_regions(s, d):
    ref = _boxes(s, d, (0, 0, 0))
    found = raster.compared(_page_pairs(ref, ref.withColumn("w", F.lit(0))))
    regions = raster.page_regions(found)
    return regions.join(found.select("job_id", "angle", "similarity"), "job_id").select("job_id", "angle", F.round("similarity", 6).alias("similarity"), "kind", *(F.round(c, 6).alias(c) for c in (*_B, "area_ratio")))


@query(f"with {_BOXES} select id as job_id, 'color' as kind, 0::int as angle, true as near from bx")
def im7_recoloured_regions(s, d):
    ref, cand = _boxes(s, d, (0, 0, 200)), _boxes(s, d, (200, 0, 0))
    found = raster.compared(_page_pairs(ref, cand))
    regions = raster.page_regions(found).join(found.select("job_id", "angle"), "job_id").join(ref.withColumnRenamed("id", "job_id"), "job_id")
    close = lambda side, at, size: F.abs(F.col(side) * F.col(size) - at) <= 3
    near = close("x0", F.col("x"), "width") & close("y0", F.col("y"), "height") & close("x1", F.col("x") + F.col("w"), "width") & close("y1", F.col("y") + F.col("h"), "height")
    return regions.select("job_id", "kind", "angle", near.alias("near"))


@query(f"""with {_BOXES}, sz as (select *, (pw + 30) as rw, 120 as rh from bx), sc as (select *, greatest(1, round_even(ph * 100.0::double / greatest(pw, ph), 0))::int as ch, greatest(1, round_even(pw * 100.0::double / greatest(pw, ph), 0))::int as cw,
  greatest(1, round_even(rh * 100.0::double / greatest(rw, rh), 0))::int as eh, greatest(1, round_even(rw * 100.0::double / greatest(rw, rh), 0))::int as ew from sz),
 pn as (select *, greatest(ch, eh) as t from sc), gt as (select *, greatest(28, round_even(t * 0.02::double, 0))::int as g, greatest(72, round_even(t * 0.08::double, 0))::int as hd from pn), pd as (select *, greatest(24, g) as p from gt)
 select id as job_id, ch as candidate_height, cw as candidate_width, eh as reference_height, ew as reference_width, (2 * p + hd + t)::int as panel_height,
 (2 * p + g + case when ch = t then cw else greatest(1, round_even(cw * (t / ch::double), 0)) end + case when eh = t then ew else greatest(1, round_even(ew * (t / eh::double), 0)) end)::int as panel_width from pd""")
def im8_im9_sup6_shown_pages(s, d):
    cand = _boxes(s, d, (10, 20, 30))
    ref = cand.withColumn("width", F.col("width") + 30).withColumn("height", F.lit(120)).withColumn("h", F.lit(5))
    sizes = [f"{n}_{k}" for n in ("candidate", "reference", "panel") for k in ("height", "width")]
    return raster.prepared(_page_pairs(ref, cand), 100).select("job_id", *sizes)

