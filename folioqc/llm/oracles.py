"""DuckDB SQL of the corpus queries that SQL can express. Where a query has none, tests hold it
against brute force, a round trip or held-out accuracy."""

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
_WORD = r"[^\x20\x09-\x0D]+"

_OP2 = f"""
with n as (select doc_id, {_NORM} as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over (partition by norm order by doc_id) = 1 as kept,
       sha256(norm) as text_sha256
from n
"""

_OP4 = rf"""
with d as (
  select doc_id, source, coalesce(text, '') as t from documents
), k as (
  select doc_id, source, len(regexp_extract_all(t, '{_WORD}'))::bigint as size,
         -ln((('0x' || md5(coalesce(doc_id::varchar, 'null' || t))[1:12])::bigint + 1.0::double) / 281474976710656.0::double)
         / greatest(0.05::double, 1.0::double - (length(t) - length(translate(t, '#*$%&|<>', ''))) * 10.0::double / greatest(length(t), 1)) as key
  from d
), s as (
  select source, sum(size)::bigint as source_size,
         ([3.0, 1.0, 2.0]::double[])[((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight
  from k group by source
), c as (
  select *, source_size * 2.0::double as cap,
         sum(source_size) over () * 1.5::double as total,
         sum(weight) over () as weights
  from s
), l as (
  select *, cap / weight as ratio,
         (total - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
         / (weights - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)) as level
  from c window o as (order by cap / weight, source nulls last)
), g as (
  select source, source_size, least(cap, coalesce((select arg_min(level, ratio) from l where ratio > level) * weight, cap)) as target from l
), e as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from g
), p as (
  select k.*, e.source_size, e.target, e.epochs::bigint as epochs, e.target - e.epochs * e.source_size as budget,
         coalesce(sum(size) over (partition by k.source order by key, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0) as before
  from k join e on k.source is not distinct from e.source
)
select doc_id, size, source_size, target,
       (size * (epochs + case when size > 0 and before < budget and before + size - budget <= budget - before then 1 else 0 end))::bigint as taken
from p
"""

_OP9 = rf"""
with d as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as t,
         coalesce(doc_id::varchar, 'null' || coalesce(text, '')) as doc,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
         string_split(coalesce(text, ''), chr(10)) as lines,
         row_number() over () as r
  from documents
), g as (
  select r, i, [w[i], w[i + 1], w[i + 2]] as g
  from (select r, w, unnest(range(1, len(w) - 1)) as i from d)
), twice as (
  select r, i, count(*) over (partition by r, g) as n from g
), covered as (
  select r, count(distinct j)::bigint as n
  from (select r, unnest([i, i + 1, i + 2]) as j from twice where n > 1) group by r
), norm as (
  select r, host, doc, unnest(lines) as line, generate_subscripts(lines, 1) as nth from d
), normal as (
  select r, host, doc, nth, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as nl,
         regexp_matches(line, '{_WORD}') as solid
  from norm
), counts as (
  select host, nl, count(distinct doc) as n from normal where solid group by all
), heavy as (
  select host, nl from counts where n > 20
), marked as (
  select normal.*, heavy.nl is not null and solid as gone from normal left join heavy on normal.host = heavy.host and normal.nl = heavy.nl
), after as (
  select r, coalesce(string_agg(line, chr(10) order by nth) filter (where not gone), '') as rest, count(*) filter (where gone) as n_removed from marked group by r
), b as (
  select d.r, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
         (len(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')))))::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words, n_removed::bigint as n_removed_lines,
         len(regexp_extract_all(rest, '{_WORD}'))::bigint as n_words_left
  from d join after using (r) left join covered c using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, n_words_left,
       n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed,
       not (n_words < 50 or n_repeat_words * 100 > n_words * 50)
       and not (n_removed_lines > 0 and (n_words_left < 50 or n_words_left < n_words * 0.5::double)) as kept
from b
"""

_OP11 = """
with p as (select page_id, coalesce(html, '') as h, row_number() over () as r from pages),
o as (
  select *, strlen(h)::bigint as size, first_value(page_id) over w as keep_id, row_number() over w as nth
  from p window w as (partition by h order by page_id nulls last, r)
)
select page_id, size as payload_bytes, sha256(h) as payload_digest,
       case when size >= 100 and nth > 1 then 'revisit' else 'response' end as record_type,
       case when size >= 100 and nth > 1 then keep_id end as refers_to, true as valid
from o
"""


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC of a text's bytes; crc_table(steps) has the 256 steps of a byte."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    step = "xor(c >> 8, steps[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: {step}), 4294967295::bigint)"


#: The polynomial is a fixed value of the CRC.
_CRC_TABLE = """crc_table as (
  select list(c order by n) as steps
  from (select n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) as bytes(n))
)"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP12 = rf"""
with {_CRC_TABLE}, rows as (
  select 0 as side, doc_id, row_number() over () as r, text from documents
  union all select 1, null, row_number() over (), text from benchmark
), listed as (
  select side, doc_id, r, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from rows
), runs as (
  select side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from listed
), hashed as (
  select f, {_crc32('f')} % 10000 as bucket from (select distinct f from runs), crc_table
), placed as (
  select side, r, bucket from runs join hashed using (f)
), counts as (
  select bucket, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t from placed group by bucket
), gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double))) as gain from counts
), weights as (
  select r, floor(sum(gain) / count(*))::bigint as weight from placed join gains using (bucket) where side = 0 group by r
), scored as (
  select doc_id, len(w) as n_words, greatest(2 * len(w) - 1, 0)::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from listed left join weights using (r) where side = 0
), ranked as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as nth from scored
)
select doc_id, n_features, weight, score,
       case when n_words >= 20 and nth <= (select count(*) * 25 // 100 from scored where n_words >= 20) then nth end::bigint as rank
from ranked
"""


def _add(value: str, cost: str, letter: str) -> str:
    """SQL of a value (nine digits of cost, then the audit) with one more edit before it."""
    return f"lpad((substr({value}, 1, 9)::bigint + {cost})::varchar, 9, '0') || '{letter}' || substr({value}, 10)"


def _repair_step() -> str:
    """SQL of the values from a row on, from those behind it (b[1..4]: nothing, s, u or a emitted) and
    the row's initial and fault (x); before it up to two rows may be inserted."""
    following, role = (3, 3, 4, 3), ("u", "u", "a", "u")
    stays = "case when x[2] = 'truncated' then 1 else 0 end"
    after = []
    for state in range(4):
        kept = f"case when x[1] = '{role[state]}' then {_add(f'b[{following[state]}]', stays, 'K')}"
        kept += f" when x[1] = 's' then {_add('b[2]', stays, 'K')} end" if state == 0 else " end"
        other = f"{_add(f'b[{following[state]}]', f'2 + {stays}', 'R')}"
        free = "x[2] not in ('blank', 'duplicate')"
        after.append(f"least({_add(f'b[{state + 1}]', '3', 'D')}, case when {free} then least({other}, coalesce({kept}, '~')) else '~' end)")
    return f"list_transform([[{', '.join(after)}]], lambda g: {_inserted('g')})[1]"


def _inserted(g: str) -> str:
    """SQL of the four values with insertions: u then a from the start or after s, one elsewhere."""
    one, two = _add(f"{g}[3]", "2", "I"), _add(_add(f"{g}[4]", "2", "I").join("()"), "2", "I")
    return f"[least({g}[1], {one}, {two}), least({g}[2], {one}, {two}), least({g}[3], {_add(f'{g}[4]', '2', 'I')}), least({g}[4], {one})]"


_END = "['000000000', '900000000', '900000000', '000000000']"
_OP13 = rf"""
with recursive {_CRC_TABLE}, told as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations
), harmed as (
  select conv_id, turn, role, text, {_crc32('key')} % 20 as harm from told, crc_table
), turned as (
  select conv_id, turn, case when harm = 4 then 'user' else role end as role,
         case when harm = 1 then '' when harm = 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case when harm = 3 then 2 else 1 end)) as copy
  from harmed where harm <> 0
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(role || chr(0) || text), copy) as nth,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again
  from turned
), faulty as (
  select conv_id, nth, turn, role, text,
         case when role ^@ 's' then 's' when role ^@ 'u' then 'u' when role ^@ 'a' then 'a' else 'x' end as initial,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when again > 1 then 'duplicate'
              when right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from numbered
), listed as (
  select conv_id, list([initial, fault] order by nth) as rows, list(role order by nth) as roles, list(text order by nth) as texts,
         coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
         count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
         count(*) filter (where fault = 'truncated') as truncated
  from faulty group by conv_id
), solving as (
  select conv_id, rows, len(rows) as i, {_inserted(_END)} as b from listed
  union all
  select conv_id, rows, i - 1, (list_transform([[b, rows[i]]], lambda z: {_repair_step().replace('b[', 'z[1][').replace('x[', 'z[2][')}))[1] from solving where i > 0
), solved as (
  select conv_id, substr(b[1], 1, 9)::bigint as cost, substr(b[1], 10) as audit from solving where i = 0
), replaying as (
  select listed.conv_id, roles, texts, audit, 1 as pos, 1 as i, 0 as state, ''::varchar as done from listed join solved on listed.conv_id is not distinct from solved.conv_id
  union all
  select conv_id, roles, texts, audit, pos + 1, i + (e <> 'I')::integer,
         case when e = 'D' then state when e = 'K' and state = 0 and roles[i] ^@ 's' then 1 when state = 2 then 3 else 2 end,
         case when e = 'D' then done
              else done || case when state = 0 then '' else chr(10) end
                   || case when e = 'K' then roles[i] when state = 2 then 'assistant' else 'user' end || ':' || case when e = 'I' then '' else texts[i] end end
  from (select *, audit[pos] as e from replaying) where pos <= len(audit)
), repaired as (
  select conv_id, sha256(done) as repaired_sha256 from replaying where pos > len(audit)
), ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(len(list_filter(range(1, len(rows)), lambda i: rows[i][1] || rows[i + 1][1] not in ('su', 'ua', 'au'))), 0)::bigint as illegal,
       coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from ids left join listed on ids.conv_id is not distinct from listed.conv_id
left join solved on ids.conv_id is not distinct from solved.conv_id
left join repaired on ids.conv_id is not distinct from repaired.conv_id
"""

ORACLES = {
    "op2_exact_dedup": _OP2, "op4_mix_sources": _OP4, "op9_line_quality": _OP9,
    "op11_warc_zstd": _OP11, "op12_importance_duckdb": _OP12, "op13_conversation_repair": _OP13,
}
