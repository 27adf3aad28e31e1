"""Queries over texts, layouts, fonts, settings and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioqc.functions import geometry as G
from folioqc.functions import text as X
from folioqc.operators import fonts, layouts, placement
from folioqc.plans import catalog as C
from folioqc.plans import views as V
from folioqc.plans.registry import query
from folioqc.sources import files

_L, _WS = f"with {V.SQL_LINES}", C._WS
_FOLD = "replace(replace(lower({v}), 'ß', 'ss'), 'ſ', 's')"


@query(r"""select doc_id, array_to_string(regexp_extract_all(text, '(?i)[\$\(]?-?\d[\d,]*\.?\d*[%\)BMK]?'), '|') as numbers, regexp_matches(text, '[^\x00-\x7F]') as foreign_letters from documents""")
def fn7_fn8_tokens(s, d):
    return V.table(s, d, "documents").select("doc_id", F.array_join(X.number_tokens(F.col("text")), "|").alias("numbers"), X.non_ascii(F.col("text")).alias("foreign_letters"))


_HYPHEN = r"regexp_replace(line || '- x a- b', '([A-Za-z])-[\s\p{Z}]+([A-Za-z])', '\1-\2', 'g')"


@query(rf"{_L} select doc_id, ord, replace(lower(trim(regexp_replace({_HYPHEN}, '{_WS}', ' ', 'g'))), 'ß', 'ss') as norm from lines")
def fn2_normalised_strict(s, d):
    return V.lines(s, d).select("doc_id", "ord", X.normalised_strict(F.concat("line", F.lit("- x​ a- b"))).alias("norm"))


_NAME = "case doc_id % 7 when 0 then 'ABCDEF+' || source when 1 then 'ABCDEF' when 2 then 'abcdef+' || source when 3 then source || '+' when 4 then ' ' || upper(source) || ' ' when 5 then 'AB1DEF+X+' || source else '' end"


@query(f"""with n as (select doc_id, {_NAME} as name from documents), p as (select *, case when contains(name, '+') then name[strpos(name, '+') + 1:] else '' end as suffix, split_part(name, '+', 1) as prefix from n)
 select doc_id, coalesce(nullif(trim(case when suffix <> '' then suffix else name end), ''), 'Unknown Font') as font, length(prefix) = 6 and upper(prefix) = prefix and lower(prefix) <> prefix as subset from p""")
def fn13_font_names(s, d):
    k, src = F.col("doc_id") % 7, F.col("source")
    name = F.when(k == 0, F.concat(F.lit("ABCDEF+"), src)).when(k == 1, "ABCDEF").when(k == 2, F.concat(F.lit("abcdef+"), src)).when(k == 3, F.concat(src, F.lit("+"))).when(k == 4, F.concat(F.lit(" "), F.upper(src), F.lit(" "))).when(k == 5, F.concat(F.lit("AB1DEF+X+"), src)).otherwise("")
    return V.table(s, d, "documents").select("doc_id", X.font_name(name).alias("font"), X.font_is_subset(name).alias("subset"))


_FILE = "lower(event_type) || '_' || event_id || case event_id % 9 when 0 then '.txt' when 1 then '.PDF' when 2 then '.pdf.bak' when 3 then '.pptx' when 4 then '.PPTX' when 5 then '.pdf' when 6 then '.ppt' when 7 then '.pdf' else '.pptx' end"


@query(f"""with f as (select event_id - [0, 0, 1, 0, 1, 2, 0][event_id % 7 + 1] as job_id, event_id, {_FILE} as name from events), k as (select *, case when lower(name) like '%.pdf' then 'pdf' when lower(name) like '%.pptx' then 'pptx' else 'unsupported' end as kind from f)
 select job_id, case when count(*) filter (kind = 'unsupported') > 0 then 'Only one PDF and one PPTX file are supported.' when count(*) filter (kind = 'pdf') > 1 then 'Please drop only one PDF file.' when count(*) filter (kind = 'pptx') > 1 then 'Please drop only one PPTX file.' end as error,
 string_agg(kind, ',' order by event_id) as kinds, string_agg('/run/' || job_id || '/' || name, ',' order by event_id) as targets from k group by job_id""")
def flt15_src1_uploads(s, d):
    k = F.col("event_id") % 9
    ending = F.when(k == 0, ".txt").when(k == 1, ".PDF").when(k == 2, ".pdf.bak").when(k == 3, ".pptx").when(k == 4, ".PPTX").when(k == 6, ".ppt").when(k == 8, ".pptx").otherwise(".pdf")
    name = F.concat(F.lower("event_type"), F.lit("_"), F.col("event_id").cast("string"), ending)
    # Jobs of one, two and three files.
    job = F.col("event_id") - F.element_at(F.array(*map(F.lit, (0, 0, 1, 0, 1, 2, 0))), (F.col("event_id") % 7 + 1).cast("int"))
    chosen = V.table(s, d, "events").select(job.alias("job_id"), F.col("event_id").alias("ord"), name.alias("name"), F.concat(F.lit("/up/"), name).alias("path"))
    copies = files.job_copies(chosen, "/run")
    targets = chosen.join(copies, F.col("path") == F.col("source")).select("job_id", "ord", X.file_kind(F.col("name")).alias("kind"), "target")
    listed = targets.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ord", "kind", "target"))).alias("l"))
    return listed.join(files.accepted(chosen), "job_id").select("job_id", "error", F.array_join("l.kind", ",").alias("kinds"), F.array_join("l.target", ",").alias("targets"))


@query(f"""with {V.SQL_LINES}, c as (select doc_id, ord, case when ord % 3 = 0 then upper(line) else line end as line from lines where trim(line) <> '')
 select doc_id, min(ord)::int as ord, {_FOLD.format(v='line')} as key from c group by doc_id, {_FOLD.format(v='line')}""")
def wn5_wn6_st3_first_of_equal(s, d):
    rows = V.lines(s, d).where(F.trim("line") != "").withColumn("line", F.when(F.col("ord") % 3 == 0, F.upper("line")).otherwise(F.col("line")))
    return layouts.first_of_equal(rows, ["doc_id"], "line").select("doc_id", "ord", "key")


@query("""with n as (select distinct o_orderpriority as folder, o_custkey as n, o_custkey % 3 as k from orders)
 select folder, case when k = 0 then 'Slide_' when k = 1 then 'slide_' else 'SLIDE_' end || case when n % 2 = 0 then '000' else '' end || n || '00000000000000000000000.PNG' as name, row_number() over (partition by folder order by n) as place from n""")
def so4_src13_natural_sort(s, d):
    n, k = F.col("o_custkey"), F.col("o_custkey") % 3
    name = F.concat(F.when(k == 0, "Slide_").when(k == 1, "slide_").otherwise("SLIDE_"), F.when(n % 2 == 0, "000").otherwise(""), n.cast("string"), F.lit("00000000000000000000000.PNG"))
    names = V.table(s, d, "orders").select(F.col("o_orderpriority").alias("folder"), name.alias("name")).distinct()
    return files.in_natural_order(names).select("folder", "name", F.col("place").cast("bigint").alias("place"))


@query("""select page_id, sha256(html) as digest, strlen(html)::int as bytes, 'data:image/png;base64,' || base64(encode(html)) as url,
 '{"width":' || length(html) || ',"png_bytes":' || strlen(html) || ',"sha256":"' || sha256(html) || '"}' as metadata from pages""")
def snk7_fn19_digests(s, d):
    from folioqc.plans import model_qc

    p = V.table(s, d, "pages").withColumn("content", F.col("html").cast("binary"))
    return p.select("page_id", F.sha2("content", 256).alias("digest"), F.octet_length("content").alias("bytes"), X.data_url(F.col("content")).alias("url"), model_qc.image_metadata(F.length("html"), F.col("content")).alias("metadata"))


@query("""select p_partkey, coalesce(nullif(trim(case when p_size % 3 = 0 then ' ' else p_name end), ''), p_brand) as filled, case when p_size % 4 = 0 then true when p_size % 4 = 1 then p_size % 8 = 1 else false end as flag,
 case when trim(p_brand) <> '' then chr(10) || chr(10) || 'Additional run-specific user QC instructions:' || chr(10) || trim(p_brand) else '' end as suffix, case when length(p_name) > 12 then 'too long' end as error,
 case p_size % 6 when 0 then 'darwin' when 1 then 'windows' when 2 then 'linux' when 3 then 'darwin' when 4 then 'windows' else 'darwin' end as platform from part""")
def prj2_prj5_fn18_flt12_udf4_settings(s, d):
    p, k = V.table(s, d, "part"), F.col("p_size")
    given = F.when(k % 3 == 0, " ").otherwise(F.col("p_name"))
    switch = F.when(k % 4 == 0, " Yes ").when(k % 4 == 1, " ").otherwise("0")
    override = F.when(k % 6 == 0, "MacOS").when(k % 6 == 1, " win32 ").when(k % 6 == 2, " ").when(k % 6 == 3, "osx").when(k % 6 == 4, "Windows").otherwise(F.lit(None))
    system = F.when(k % 6 == 2, "Linux").otherwise("Darwin")
    flagged = F.when(k % 8 == 1, X.flag(switch, True)).otherwise(X.flag(switch))
    return p.select("p_partkey", X.filled(given, F.col("p_brand")).alias("filled"), flagged.alias("flag"), X.prompt_suffix(F.col("p_brand")).alias("suffix"), X.too_long(F.col("p_name"), 12).alias("error"), X.platform_name(override, system).alias("platform"))


_A = "case p_size % 6 when 0 then p_name || ' ' || p_size when 1 then replace(p_name, 'a', 'а') when 2 then p_brand[1:2] || '%' when 3 then p_name when 4 then p_name || 'é' else 'САВ ' || p_name end"
_B = "case p_size % 6 when 0 then p_name || ' ' || (p_size + p_partkey % 2) when 1 then p_name when 2 then p_brand[1:3] when 3 then p_type when 4 then p_name else 'CAB ' || p_name end"
_NUM = r"array_to_string(regexp_extract_all({v}, '(?i)[\$\(]?-?\d[\d,]*\.?\d*[%\)BMK]?'), '|')"
_LATIN = f"lower(translate({{v}}, '{X.CONFUSABLE}', '{X.LATIN}'))"


@query(rf"""with r as (select p_partkey, {_A} as a, {_B} as b, (p_partkey % 100) / 100.0::double as score from part), c as (select *, regexp_replace(a || b, '\s+', '', 'g') as ab from r)
 select p_partkey, {_LATIN.format(v='a')} = {_LATIN.format(v='b')} and a <> b as confusable, length(ab) <= 12 and regexp_matches(ab, '[$%()]') as symbols,
 case when {_NUM.format(v='a')} <> {_NUM.format(v='b')} then 'numeric-token mismatch' when regexp_matches(a || b, '[^\x00-\x7F]') or ({_LATIN.format(v='a')} = {_LATIN.format(v='b')} and a <> b) then 'possible unicode/confusable-character mismatch'
 when length(ab) <= 12 and regexp_matches(ab, '[$%()]') then 'short label or symbol-level text mismatch' when score >= 0.82::double then 'likely line-level typo/spelling difference' else 'line-level text mismatch' end as label from c""")
def fn9_fn10_fn11_labels(s, d):
    p, k = V.table(s, d, "part"), F.col("p_size") % 6
    size, cat = F.col("p_size").cast("string"), F.concat
    a = F.when(k == 0, cat("p_name", F.lit(" "), size)).when(k == 1, F.replace("p_name", F.lit("a"), F.lit("а"))).when(k == 2, cat(F.substring("p_brand", 1, 2), F.lit("%"))).when(k == 3, F.col("p_name")).when(k == 4, cat("p_name", F.lit("é"))).otherwise(cat(F.lit("САВ "), "p_name"))
    b = F.when(k == 0, cat("p_name", F.lit(" "), (F.col("p_size") + F.col("p_partkey") % 2).cast("string"))).when(k == 1, F.col("p_name")).when(k == 2, F.substring("p_brand", 1, 3)).when(k == 3, F.col("p_type")).when(k == 4, F.col("p_name")).otherwise(cat(F.lit("CAB "), "p_name"))
    rows = p.select("p_partkey", a.alias("a"), b.alias("b"), (F.col("p_partkey") % 100 / 100.0).alias("score"))
    x, y = F.col("a"), F.col("b")
    return rows.select("p_partkey", X.confusable(x, y).alias("confusable"), X.short_symbol_label(x, y).alias("symbols"), X.mismatch_label(x, y, F.col("score")).alias("label"))


@query(r"""select p_partkey, p_name || '_with_pdf_pages.pptx' as output, replace(replace(p_brand || '\"' || p_name, '\', '\\'), '"', '\"') as escaped,
 not p_size % 5 = 0 and p_size % 3 <> 0 and p_size % 4 < 3 as again from part""")
def fn20_fn24_flt16_names(s, d):
    p, k = V.table(s, d, "part"), F.col("p_size")
    message = F.when(k % 4 == 0, "Bad CRC-32 for file 'ppt/media/image1.png'").when(k % 4 == 1, "bad CRC in ppt/media/image2.png").when(k % 4 == 2, "File is not a zip file").otherwise("Bad CRC-32 for file 'ppt/slides/slide1.xml'")
    kind = F.when(k % 4 == 2, "BadZipFile").otherwise("RuntimeError")
    return p.select("p_partkey", X.output_name(F.concat(F.lit("/a/b."), "p_brand", F.lit("/"), "p_name", F.lit(".pptx"))).alias("output"), X.script_escaped(F.concat("p_brand", F.lit('\\"'), "p_name")).alias("escaped"),
                    X.retryable(kind, message, k % 5 == 0, k % 3 != 0).alias("again"))


@query("""with l as (select p_partkey % 50 as job_id, p_partkey as n, 'K' || p_size as key, case p_partkey % 4 when 0 then p_name when 1 then p_name when 2 then p_name || ' # not this' else p_name end as value, p_partkey % 7 = 0 as comment, p_partkey % 4 as k from part),
 c as (select *, case k when 2 then value[:-12] else value end as plain from l where not comment) select job_id, key, arg_max(case when k = 0 then plain || ' # x' else plain end, n) as value from c group by all""")
def src16_env_lines(s, d):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    value = F.when(k == 0, F.concat(F.lit('"'), name, F.lit(' # x"'))).when(k == 1, F.concat(F.lit("'"), name, F.lit("'"))).when(k == 2, F.concat(name, F.lit(" # not this"))).otherwise(F.concat(F.lit(" "), name, F.lit("  ")))
    line = F.concat(F.when(F.col("p_partkey") % 7 == 0, "# ").when(k == 3, "export ").otherwise(""), F.lit("K"), F.col("p_size").cast("string"), F.lit("="), value)
    lines = V.table(s, d, "part").select((F.col("p_partkey") % 50).alias("job_id"), F.col("p_partkey").alias("n"), line.alias("value"))
    return files.env_pairs(lines.unionByName(lines.select("job_id", "n", F.lit("no pair").alias("value"))), ["job_id"])


_ACTIONS = f"""{C._PLACED}, a as (select job_id, row_number() over (partition by job_id order by status <> 'placed', case when status = 'placed' then -page_index else page_index end) as ord,
 case when status = 'placed' then 'INSERT' else 'APPEND' end as action, page_index from p where status <> 'no_matching_pdf_page'), m as (select *, '/img/' || lower(action) || '-' || lpad(ord::varchar, 3, '0') || '.png' as image from a)"""


def _actions(s, d):
    acts = placement.insert_actions(placement.place(*C._sides(s, d)))
    return acts.withColumn("image", F.concat(F.lit("/img/"), F.lower("action"), F.lit("-"), F.lpad(F.col("ord").cast("string"), 3, "0"), F.lit(".png")))


@query(f"""{_ACTIONS} select job_id, ord, action || chr(9) || case when action = 'INSERT' then page_index::varchar else '' end || chr(9) || image as line, action, case when action = 'INSERT' then page_index else -1 end as after, image from m""")
def snk5_src17_manifest(s, d):
    lines = files.manifest_lines(_actions(s, d))
    return lines.join(files.manifest_actions(lines), ["job_id", "ord"]).select("job_id", "ord", "line", "action", F.coalesce("page_index", F.lit(-1)).alias("after"), "image")


@query(f"""{_ACTIONS} select job_id, '[' || string_agg('{{"kind":"' || lower(action) || '","insertAfter":' || case when action = 'INSERT' then page_index::varchar else 'null' end || ',"imagePath":"' || image || '"}}', ',' order by ord) || ']' as json from m group by job_id""")
def snk5_manifest_json(s, d):
    return files.manifest_json(_actions(s, d))


# Layouts: spans make lines, lines make paragraphs; recognised ones come from anchors in a page's text.
_SPANS = """sp as (select doc_id % 40 as job_id, (doc_id // 40)::int as page_index, ord::bigint as block, (case when ord % 9 = 4 then 1 else 0 end)::int as block_type, line from lines),
 ln as (select job_id, page_index, block, nth, trim(piece) as text from (select *, unnest(string_split(line, '. ')) as piece, generate_subscripts(string_split(line, '. '), 1) - 1 as nth from sp where block_type = 0) where trim(piece) <> ''),
 pa as (select job_id, page_index, block, string_agg(text, ' ' order by nth) as text, count(*)::int as n_lines, min(nth) as lo, max(nth) as hi from ln group by all)"""
_LAY = f"with {V.SQL_LINES}, {_SPANS}"


def _native(s, d):
    piece = F.posexplode(F.split("line", "\\. ")).alias("line_no", "text")
    rows = V.lines(s, d).select((F.col("doc_id") % 40).alias("job_id"), F.floor(F.col("doc_id") / 40).cast("int").alias("page_index"), F.col("ord").cast("bigint").alias("block"), F.when(F.col("ord") % 9 == 4, 1).otherwise(0).alias("block_type"), "line")
    spans = rows.select("job_id", "page_index", "block", "block_type", piece).select("job_id", "page_index", "block", "block_type", F.col("line_no").cast("bigint").alias("line"), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    box = G.box(F.lit(10.0), F.col("line") * 20.0, F.lit(10.0) + F.length("text"), F.col("line") * 20.0 + 15)
    cut = spans.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("span")).withColumn("text", F.when(F.col("span") == 0, F.substring("text", F.lit(1), half)).otherwise(F.substring("text", half + 1, F.length("text")))).withColumn("bbox", F.when(F.col("line") < 30, box))
    pages = rows.select("job_id", "page_index").distinct().select("*", F.lit(500.0).alias("page_w"), F.lit(600.0).alias("page_h"))
    lines = layouts.lines_of_spans(cut, pages)
    return pages, lines, layouts.paragraphs_of_lines(lines)


@query(f"{_LAY} select job_id, page_index, block as para_ord, nth as line_ord, text, round(case when nth < 30 then 0.02::double else 0 end, 6) as x0, round(case when nth < 30 then least(1, nth * 20.0::double / 600) else 0 end, 6) as y0 from ln")
def src4_flt2_lines(s, d):
    _, lines, _ = _native(s, d)
    return lines.select("job_id", "page_index", "para_ord", "line_ord", "text", F.round("bbox.x0", 6).alias("x0"), F.round("bbox.y0", 6).alias("y0"))


@query(f"{_LAY} select job_id, page_index, block as para_ord, text, n_lines, round(case when hi < 30 then least(1, lo * 20.0::double / 600) else 0 end, 6) as y0 from pa")
def src4_ag7_paragraphs(s, d):
    _, _, p = _native(s, d)
    return p.select("job_id", "page_index", "para_ord", "text", "n_lines", F.round("bbox.y0", 6).alias("y0"))


# Recognition of the same pages: lines of thirty characters, anchored in two pieces of the page's text;
# one paragraph of all of it on even pages.
_OCR = rf"""{_LAY}, dc as (select doc_id % 40 as job_id, (doc_id // 40)::int as page_index, coalesce(text, '') as whole from documents),
 ol as (select job_id, page_index, item, regexp_replace(whole[item * 30 + 1:item * 30 + 8] || whole[item * 30 + 9:item * 30 + 30], '^\s+|\s+$', '', 'g') as text, 0.1::double * (item % 10) as y0, 0.1::double * (item % 10) + 0.08::double as y1, case when page_index % 3 = 0 then 0.85::double else 0.5::double + (item % 5) * 0.1::double end as confidence
  from (select *, unnest(range((length(whole) + 29) // 30)) as item from dc)),
 lx as (select * from ol where text <> ''),
 op as (select job_id, page_index, 0 as item, regexp_replace(whole, '^\s+|\s+$', '', 'g') as text, 0.0::double as y0, 0.1::double as y1, 0.7::double as confidence from dc where page_index % 2 = 0),
 px as (select * from op where text <> ''),
 oq as (select px.job_id, px.page_index, px.item, px.text, px.confidence, (select count(*) from lx where lx.job_id = px.job_id and lx.page_index = px.page_index and greatest(0, least(lx.y1, px.y1) - greatest(lx.y0, px.y0)) / (px.y1 - px.y0) >= 0.55::double)::int as n_lines from px
  union all select job_id, page_index, item, text, confidence, 1 from lx where not exists (select 1 from px where px.job_id = lx.job_id and px.page_index = lx.page_index))"""


def _recognised(s, d):
    docs = V.table(s, d, "documents").select((F.col("doc_id") % 40).alias("job_id"), F.floor(F.col("doc_id") / 40).cast("int").alias("page_index"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    item = F.explode(F.when(size > 0, F.sequence(F.lit(0), F.ceil(size / 30).cast("int") - 1))).alias("item")
    seg = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    i, y = F.col("item"), (F.col("item") % 10) * 0.1
    lines = docs.select("job_id", "page_index", item).select(
        "job_id", "page_index", i.cast("bigint").alias("item"), F.array(seg(i * 30, i * 30 + 8), seg(i * 30 + 8, i * 30 + 30)).alias("segments"),
        G.box(F.lit(0.0), y, F.lit(1.0), y + 0.08).alias("bbox"), F.when(F.col("page_index") % 3 != 0, 0.5 + (i % 5) * 0.1).alias("confidence"))
    half = F.floor(size / 2)
    paras = docs.where("page_index % 2 = 0").select(
        "job_id", "page_index", F.lit(0).cast("bigint").alias("item"), F.array(seg(F.lit(0), half), seg(half, size)).alias("segments"), G.box(*map(F.lit, (0.0, 0.0, 1.0, 0.1))).alias("bbox"), F.lit(0.7).alias("confidence"))
    return docs.select("job_id", "page_index"), layouts.recognised(layouts.anchored_text(lines, docs), layouts.anchored_text(paras, docs))


@query(f"{_OCR} select job_id, page_index, item::bigint as line_ord, text, round(confidence, 6) as confidence from lx")
def jn14_src10_anchored_lines(s, d):
    _, (lines, _) = _recognised(s, d)
    return lines.select("job_id", "page_index", "line_ord", "text", F.round("confidence", 6).alias("confidence"))


@query(f"{_OCR} select job_id, page_index, item::bigint as para_ord, text, n_lines, round(confidence, 6) as confidence from oq")
def src9_src10_recognised_paragraphs(s, d):
    _, (_, paragraphs) = _recognised(s, d)
    return paragraphs.select("job_id", "page_index", "para_ord", "text", "n_lines", F.round("confidence", 6).alias("confidence"))


@query(rf"""{_OCR}, sh as (select *, length(regexp_replace(text, '{_WS}', '', 'g')) as c from pa where n_lines <= 1 + page_index % 2 * 3),
 nm as (select dc.job_id, dc.page_index, coalesce(sum(c), 0)::bigint as chars, count(c) as n from dc left join sh using (job_id, page_index) group by all),
 om as (select dc.job_id, dc.page_index, coalesce(sum(length(regexp_replace(text, '{_WS}', '', 'g'))), 0)::bigint as chars, count(oq.text) as n, coalesce(avg(confidence), 0) as conf from dc left join oq using (job_id, page_index) group by all)
 select nm.job_id, nm.page_index, case when (nm.chars < 24 or nm.n = 0) and om.chars >= nm.chars then om.chars else nm.chars end as total_characters, (nm.chars < 24 or nm.n = 0) and om.chars >= nm.chars as extracted_with_ocr,
 round(case when (nm.chars < 24 or nm.n = 0) and om.chars >= nm.chars then om.conf when nm.n > 0 then 1 else 0 end, 6) as average_confidence, not ((nm.chars < 24 or nm.n = 0) and om.chars >= nm.chars) and nm.chars = 0 as visual_only
 from nm join om using (job_id, page_index)""")
def flt3_flt13_udf1_chosen_layout(s, d):
    pages, _, paragraphs = _native(s, d)
    keys = V.table(s, d, "documents").select((F.col("doc_id") % 40).alias("job_id"), F.floor(F.col("doc_id") / 40).cast("int").alias("page_index"))
    native = layouts.measures(keys, paragraphs.where(F.col("n_lines") <= 1 + F.col("page_index") % 2 * 3), False)
    ocr_pages, (_, ocr) = _recognised(s, d)
    found = layouts.chosen(native, layouts.measures(ocr_pages, ocr, True))
    return found.select("job_id", "page_index", "total_characters", "extracted_with_ocr", F.round("average_confidence", 6).alias("average_confidence"), layouts.visual_only(found).alias("visual_only"))


# Items of a page: its lines if it has any, blank or not, else its paragraphs; blank ones go after that.
# The reader of every third page gives paragraphs only.
_TI = f"""{_LAY}, lk as (select job_id, page_index, block, nth, case when page_index % 5 = 0 then ' ' else text end as text, case when nth < 30 then least(1, nth * 20.0::double / 600) else 0 end as y from ln where page_index % 3 <> 0),
 it as (select job_id, page_index, block, nth, text, y from lk where trim(text) <> '' union all
  select job_id, page_index, block, 0, text, case when hi < 30 then least(1, lo * 20.0::double / 600) else 0 end from pa where not exists (select 1 from lk where lk.job_id = pa.job_id and lk.page_index = pa.page_index)),
 ti as (select job_id, page_index, (row_number() over (partition by job_id, page_index order by block, nth) - 1)::int as ord, text, y from it)"""


def _items(s, d):
    pages, lines, paragraphs = _native(s, d)
    kept = lines.where(F.col("page_index") % 3 != 0).withColumn("text", F.when(F.col("page_index") % 5 == 0, " ").otherwise(F.col("text")))
    return pages, layouts.text_items(kept, paragraphs)


@query(f"{_TI} select job_id, page_index, ord, text, round(y, 6) as y0 from ti")
def prj4_pl9_text_items(s, d):
    _, items = _items(s, d)
    return layouts.text_regions(items, "text").select("job_id", "page_index", "ord", "text", F.round("bbox.y0", 6).alias("y0"))


_CELL_Y = "case when y + 0.0125::double < 0.33::double then 'top' when y + 0.0125::double < 0.66::double then 'middle' else 'bottom' end"


@query(rf"""{_TI}, wd as (select *, least(1, y + 0.025::double) as y1, case when job_id % 2 = 0 then 'left' else 'right' end as side from ti),
 rk as (select *, row_number() over (partition by job_id, page_index order by y, ord) as rn, count(*) over (partition by job_id, page_index) as n from wd),
 tx as (select *, trim(regexp_replace(text, '{_WS}', ' ', 'g')) as t from rk where rn <= 36),
 ls as (select job_id, page_index, string_agg('- ' || case when (y + y1) / 2 < 0.33::double then 'top' when (y + y1) / 2 < 0.66::double then 'middle' else 'bottom' end || '-' || side || ': ' || case when length(t) > 180 then rtrim(t[1:179]) || '…' else t end, chr(10) order by rn) || case when max(n) > 36 then chr(10) || '- ... ' || (max(n) - 36) || ' more text blocks omitted' else '' end as listing from tx group by all),
 pgs as (select distinct job_id, page_index from sp)
 select pgs.job_id, pgs.page_index, 'Supporting candidate-side text extracted from the PPTX file is provided below. Use it to verify small or shaky text regions on the PPTX candidate side only. Do not assume any PDF text extraction is available.' || chr(10) || chr(10) || 'Candidate PowerPoint text:' || chr(10) || coalesce(listing, '- No extracted text available.') as context from pgs left join ls using (job_id, page_index)""")
def fn14_fn27_contexts(s, d):
    pages, items = _items(s, d)
    x = F.when(F.col("job_id") % 2 == 0, 0.1).otherwise(0.8)
    placed = items.withColumn("bbox", G.box(x, F.col("bbox.y0"), x + 0.1, F.least(F.lit(1.0), F.col("bbox.y0") + 0.025)))
    return layouts.text_contexts(layouts.listings(pages, placed))


_FOUND = r"""fd as (select l_orderkey % 500 as job_id, 0 as page_index, row_number() over (partition by l_orderkey % 500 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount) as ord, least(1, l_discount * 10) as x, case when l_linenumber % 3 = 0 then '' else 'ref  ' || repeat('word ', l_linenumber * 9) || l_partkey end as r,
 case when l_linenumber % 3 = 1 then '' else 'cand ' || l_suppkey end as c, 'label ' || l_returnflag as label from lineitem), tr as (select *, trim(regexp_replace(r, '\s+', ' ', 'g')) as rt, trim(regexp_replace(c, '\s+', ' ', 'g')) as ct from fd)"""
_CUT = "case when length({v}) > {n} then rtrim({v}[1:{m}]) || '…' else {v} end"


def _found(s, d):
    from pyspark.sql import Window

    n = F.col("l_linenumber")
    ord_ = F.row_number().over(Window.partitionBy(F.col("l_orderkey") % 500).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")).cast("bigint")
    x = F.least(F.lit(1.0), F.col("l_discount") * 10)
    return V.table(s, d, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("job_id"), F.lit(0).alias("page_index"), ord_.alias("ord"), G.box(x, x, x, x).alias("bbox"), F.concat(F.lit("label "), "l_returnflag").alias("label"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("ref  "), F.repeat(F.lit("word "), n * 9), F.col("l_partkey").cast("string"))).alias("reference_text"), F.when(n % 3 == 1, "").otherwise(F.concat(F.lit("cand "), F.col("l_suppkey").cast("string"))).alias("candidate_text"))


@query(f"""with {_FOUND} select job_id, page_index, string_agg('- ' || (case when x < 0.33::double then 'top-left' when x < 0.66::double then 'middle-center' else 'bottom-right' end) || ' (' || label || '): reference="' || {_CUT.format(v='rt', n=120, m=119)} || '" | candidate="' || {_CUT.format(v='ct', n=120, m=119)} || '"', chr(10) order by ord) as lines from tr group by all""")
def fn14_discrepancy_lines(s, d):
    return layouts.discrepancy_lines(_found(s, d))


@query(f"""with {_FOUND}, k as (select * from tr where ord <= 8) select job_id, page_index, ord::int as nth, 'Suspicious text diff ' || ord || ' (' || label || '). ' ||
 case when r <> '' and c <> '' then 'Reference reads "' || {_CUT.format(v='rt', n=100, m=99)} || '". Candidate reads "' || {_CUT.format(v='ct', n=100, m=99)} || '". ' when c <> '' then 'Reference has no matching extracted text item in this region. Candidate reads "' || {_CUT.format(v='ct', n=100, m=99)} || '". '
 else 'Reference reads "' || {_CUT.format(v='rt', n=100, m=99)} || '". Candidate has no matching extracted text item in this region. ' end || 'The next image is the candidate text crop and the image after that is the reference text crop for the matching region.' as text from k""")
def im11_so3_evidence_texts(s, d):
    return layouts.evidence_text(_found(s, d))


@query(f"""with {V.SQL_REF}, {V.SQL_CAND}, n as (select 'r' as side, job_id, page_index, replace(lower(text), 'ß', 'ss') as norm from ref union all select 'c', job_id, page_index, replace(lower(text), 'ß', 'ss') from cand),
 k as (select *, row_number() over (partition by side, job_id, norm order by page_index) as nth from n)
 select side, job_id, norm, nth from k where not exists (select 1 from k o where o.side <> k.side and o.job_id = k.job_id and o.norm = k.norm and o.nth = k.nth)""")
def jn11_ag14_multiset_difference(s, d):
    a, b = (p.select("job_id", F.col("page_index").alias("ord"), X.casefolded(F.col("text")).alias("norm")) for p in C._sides(s, d))
    return layouts.unmatched_copies(a, b, ["job_id"])


@query("""select doc_id, upper(lang) as lang, source from documents where doc_id % 3 <> 0 union all select doc_id, 'new', source from documents where doc_id % 3 = 0""")
def st2_keyed_upsert(s, d):
    docs = V.table(s, d, "documents").select("doc_id", F.upper("lang").alias("lang"), "source")
    return layouts.upserted(docs, docs.where("doc_id % 3 = 0").withColumn("lang", F.lit("new")), ["doc_id"])


@query("select doc_id as \"documentId\", n_chars as \"characterCount\", lang as \"languageCode\" from documents")
def prj1_renamed(s, d):
    return X.camel_case(V.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("character_count"), F.col("lang").alias("language_code")))


# Fonts: references and spans by document; spans may name a font that no page lists.
_FONTS = f"""with {V.SQL_FONTS}, t as (select job_id, name, type, min(page) as first_page from fonts group by all),
 sp as (select job_id, span_name as name, page, sum(chars)::bigint as chars from fonts group by all),
 rs as (select sp.job_id, sp.name, sp.page, chars, coalesce(arg_min(t.type, (t.type = 'Unknown')::int::varchar || t.type), 'Unknown') as type from sp left join t on sp.job_id = t.job_id and sp.name = t.name and t.first_page <= sp.page group by all),
 al as (select job_id, name, type, page, embedded, subset, 0 as chars from fonts union all select job_id, name, type, page, false, type = 'Unknown' and length(split_part(name, '+', 1)) = 6 and upper(split_part(name, '+', 1)) = split_part(name, '+', 1), chars from rs),
 bp as (select job_id, name, type, page, bool_or(embedded) as embedded, bool_or(subset) as subset, sum(chars)::bigint as chars from al group by all),
 fi as (select job_id, name, type, bool_or(embedded) as embedded, bool_or(subset) as subset, string_agg(page::varchar, ',' order by page) as pages, string_agg('"' || page || '":' || chars, ',' order by page) filter (chars > 0) as counts from bp group by all),
 rk as (select *, row_number() over (partition by job_id order by embedded desc, lower(name), name, type) as place from fi)"""


def _fonts(s, d):
    f = V.fonts(s, d)
    return f.select("job_id", "page", "name", "type", "embedded", "subset"), f.select("job_id", "page", F.col("span_name").alias("name"), "chars")


@query(f"with {V.SQL_FONTS} select job_id, name, type, bool_or(embedded) as embedded, bool_or(subset) as subset, array_to_string(list_sort(list_distinct(list(page))), ',') as pages, min(page) as first_page from fonts group by all")
def ag5_font_groups(s, d):
    t = fonts.font_table(_fonts(s, d)[0])
    return t.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(f"{_FONTS} select job_id, name, type, page, sum(chars)::bigint as chars from rs group by all")
def ag6_jn8_font_usage(s, d):
    refs, spans = _fonts(s, d)
    return fonts.usage(fonts.resolve(spans, fonts.font_table(refs)))


@query(f"{_FONTS} select job_id, page, coalesce(sum(chars), 0)::bigint as chars from (select job_id, page, chars from sp union all select job_id, unnest(range(52)), 0 from (select distinct job_id from fonts)) group by all")
def ag6_page_totals(s, d):
    _, spans = _fonts(s, d)
    pages = spans.select("job_id").distinct().select("job_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(51).cast("bigint"))).alias("page"))
    return fonts.page_totals(spans, pages)


@query(f"{_FONTS} select job_id, name, type, embedded, subset, pages, coalesce(counts, '') as counts, place from rk")
def pl8_so5_src11_inspected(s, d):
    found = fonts.ranked(fonts.inspected(*_fonts(s, d)))
    counts = F.array_join(F.transform("counts", lambda c: F.concat(F.lit('"'), c["page"].cast("string"), F.lit('":'), c["chars"].cast("string"))), ",")
    return found.select("job_id", "name", "type", "embedded", "subset", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), counts.alias("counts"), "place")


@query(f"{_FONTS} select job_id, count(*) as fonts, count(*) filter (embedded) as embedded_fonts from fi group by job_id")
def ag13_font_counts(s, d):
    return fonts.counted(fonts.inspected(*_fonts(s, d)))


@query(f"""{_FONTS}, pt as (select job_id, '{{' || string_agg('"' || page || '":' || chars, ',' order by page) || '}}' as totals, count(*) as pages from (select job_id, page, sum(chars)::bigint as chars from sp group by all) group by job_id)
 select rk.job_id, '{{"fontCount":' || count(*) || ',"embeddedFontCount":' || count(*) filter (embedded) || ',"pageCount":' || any_value(pt.pages) || ',"pageCharacterTotals":' || any_value(totals) || ',"fonts":[' ||
  string_agg('{{"name":"' || name || '","fontType":"' || type || '","embedded":' || embedded || ',"subset":' || subset || ',"pageNumbers":[' || rk.pages || '],"pageCharacterCounts":{{' || coalesce(counts, '') || '}}}}', ',' order by place) || ']}}' as report
 from rk join pt on pt.job_id = rk.job_id group by rk.job_id""")
def snk9_font_json(s, d):
    refs, spans = _fonts(s, d)
    return fonts.report_json(fonts.inspected(refs, spans), fonts.page_totals(spans, spans.select("job_id", "page").distinct()))
