"""DuckDB SQL of the ratio of matching blocks, for oracles over texts of any length."""

#: From pr (id, a, b) to rt (id, ratio), as common tables of a recursive query.
#:
#: Where two texts have equal characters a cell lies on a diagonal; cells in a row make a run. In a
#: window of both texts the longest run of characters that are not common is taken, the first in a
#: and then in b, and lengthened by the characters around it whatever they are; then the windows
#: before and after it are searched. A character is common if it makes up more than a hundredth,
#: and one, of a b of 200 characters or more.
SQL_RATIOS = """
 ch_a as (select id, i, substr(a, i, 1) as ch from (select id, a, unnest(range(1, length(a) + 1)) as i from pr)),
 ch_b as (select *, n >= 200 and count(*) over (partition by id, ch) > n // 100 + 1 as common from (select id, j, n, substr(b, j, 1) as ch from (select id, b, length(b) as n, unnest(range(1, length(b) + 1)) as j from pr))),
 cell as (select id, i, i - j as d, common from ch_a join ch_b using (id, ch)),
 every_run as (select id, d, min(i) as lo, max(i) + 1 as hi from (select id, d, i, i - row_number() over (partition by id, d order by i) as g from cell) group by id, d, g),
 rare_run as (select id, d, min(i) as lo, max(i) + 1 as hi from (select id, d, i, i - row_number() over (partition by id, d order by i) as g from cell where not common) group by id, d, g),
 seg as (
  select id, 1::bigint as alo, length(a) + 1 as ahi, 1::bigint as blo, length(b) + 1 as bhi, 0::bigint as k from pr
  union all
  select id, h.alo, h.ahi, h.blo, h.bhi, h.k from (
   select id, unnest([struct_pack(alo := alo, ahi := lo, blo := blo, bhi := lo - d, k := hi - lo), struct_pack(alo := hi, ahi := ahi, blo := hi - d, bhi := bhi, k := 0::bigint)]) as h from (
    select m.id, m.alo, m.ahi, m.blo, m.bhi, m.d, greatest(e.lo, m.alo, m.blo + m.d) as lo, least(e.hi, m.ahi, m.bhi + m.d) as hi from (
     select id, alo, ahi, blo, bhi, coalesce(best.nj - best.ni, alo - blo) as d, coalesce(-best.ni, alo) as i0 from (
      select s.id, s.alo, s.ahi, s.blo, s.bhi, max(case when least(r.hi, s.ahi, s.bhi + r.d) > greatest(r.lo, s.alo, s.blo + r.d) then struct_pack(k := least(r.hi, s.ahi, s.bhi + r.d) - greatest(r.lo, s.alo, s.blo + r.d), ni := -greatest(r.lo, s.alo, s.blo + r.d), nj := r.d - greatest(r.lo, s.alo, s.blo + r.d)) end) as best
      from seg s left join rare_run r on r.id = s.id and r.lo < s.ahi and r.hi > s.alo where s.ahi > s.alo and s.bhi > s.blo group by all)
    ) m join every_run e on e.id = m.id and e.d = m.d and e.lo <= m.i0 and e.hi > m.i0))),
 rt as (select id, 2.0::double * sum(k) / any_value(size) as ratio from (select seg.id, seg.k, length(a) + length(b) as size from seg join pr using (id)) group by id)"""

#: From pp (job_id, page_index, ref_ord, cand_ord, a, b: normalised texts) to pr: those that may reach a ratio.
SQL_BOUNDED = """
 bp as (select * from pp where a <> '' and b <> '' and 2 * least(length(a), length(b)) >= {least} * (length(a) + length(b))),
 ca as (select job_id, page_index, ref_ord, cand_ord, ch, count(*) as n from (select *, unnest(string_split(a, '')) as ch from bp) group by all),
 cb as (select job_id, page_index, ref_ord, cand_ord, ch, count(*) as n from (select *, unnest(string_split(b, '')) as ch from bp) group by all),
 cs as (select job_id, page_index, ref_ord, cand_ord, sum(least(ca.n, cb.n)) as both_n from ca join cb using (job_id, page_index, ref_ord, cand_ord, ch) group by all),
 nr as (select bp.*, row_number() over () as id from bp join cs using (job_id, page_index, ref_ord, cand_ord) where 2 * both_n >= {least} * (length(a) + length(b))),
 pr as (select id, a, b from nr)"""
