"""DuckDB SQL that gives the same rows as the registered queries, written apart from the operators."""

from __future__ import annotations

from breakweave.plans.fixtures import WINDOWS, duck

K = "k1, k2, k3, k4, k5"
G = "chrom_l, chrom_r, sv_type, island_r, island_l"

#: Islands of right intervals, then of left ones within, touching intervals together.
ISLANDS = f"""{duck("evidence")}, {WINDOWS},
r1 as (select *, max(finish_r) over (partition by chrom_l, chrom_r, sv_type order by begin_r, finish_r rows between unbounded preceding and 1 preceding) as reach from windows),
r2 as (select *, sum(case when reach is null or begin_r > reach then 1 else 0 end) over (partition by chrom_l, chrom_r, sv_type order by begin_r, finish_r) as island_r from r1),
l1 as (select *, max(finish_l) over (partition by chrom_l, chrom_r, sv_type, island_r order by begin_l, finish_l rows between unbounded preceding and 1 preceding) as reach_l from r2),
members as (select * exclude (reach, reach_l, island_r), cast(island_r as bigint) as island_r, cast(sum(case when reach_l is null or begin_l > reach_l then 1 else 0 end) over (partition by chrom_l, chrom_r, sv_type, island_r order by begin_l, finish_l) as bigint) as island_l from l1)"""

_RATE = "(-ln(0.0001) / 20)"
CURVES = f"""{ISLANDS},
sizes as (select {G}, count(*) as n_all, max(begin_l) < min(finish_l) and max(begin_r) < min(finish_r) as meets from members group by {G}),
sides as (select {G}, {K}, 'l' as side, begin_l as b, finish_l as f from members union all select {G}, {K}, 'r', begin_r, finish_r from members),
raw as (select *, unnest(range(b, f + 1)) as pos from sides),
odds as (select *, -{_RATE} * abs(pos - b - 20) as v from raw),
curves as (select *, v - ln(sum(exp(v)) over (partition by {G}, {K}, side)) as logp from odds),
blend as (select {G}, side, pos, ln(sum(exp(logp))) as logp from curves join sizes using ({G}) where not meets group by {G}, side, pos),
tops as (select {G}, side, arg_min(pos, struct_pack(v := -round(logp, 9), p := pos)) as top from blend group by {G}, side),
covering as (select {G}, {K} from sides join tops using ({G}, side) where top between b and f group by {G}, {K} having count(*) = 2),
used as (select {G}, count(*) as n_used from covering group by {G}),
chosen as (select curves.*, n_all as n_used from curves join sizes using ({G}) where meets
 union all select curves.*, n_used from curves join covering using ({G}, {K}) join used using ({G})),
met as (select {G}, side, pos, sum(logp) as s, max(n_used) as n_used from chosen group by {G}, side, pos having count(*) = max(n_used)),
product as (select {G}, side, pos, n_used, s - max(s) over w - ln(sum(exp(s - t)) over w) as logp from (select *, max(s) over (partition by {G}, side) as t from met) window w as (partition by {G}, side))"""

SPLIT_TYPE = "case when strand_l <> strand_r then 'INV' when query_l = query_r then null when (strand_l = '+' and query_l < query_r) or (strand_l = '-' and query_l > query_r) then 'DEL' else 'DUP' end"
INWARD = "((query_l < query_r and strand_l = '-') or (query_l > query_r and strand_l = '+'))"
STRANDS = f"strands as (select {G}, string_agg(s || ':' || n, ',' order by s) as strands from (select {G}, strand_l || strand_r as s, count(*) as n from members group by all) group by {G})"

#: `evidence` or another view first, then what the query does.
E, A, B, C = (f"with {duck(n)} " for n in ("evidence", "intervals_a", "intervals_b", "cigars"))
AB = f"with {duck('intervals_a')}, {duck('intervals_b')} "


def _ops(kinds: str) -> str:
    """Summed length of some CIGAR ops."""
    return f"coalesce(cast(list_sum(cast(regexp_extract_all(cigar, '(\\d+)[{kinds}]', 1) as bigint[])) as bigint), 0)"


LEAD = "coalesce(nullif(regexp_extract(cigar, '^(\\d+)[SH]', 1), '')::bigint, 0)"
TAIL = "coalesce(nullif(regexp_extract(cigar, '(\\d+)[SH]$', 1), '')::bigint, 0)"
OFF = "(flag & {}) {} 0"

ENDS = """ea as (select id, chrom as chrom_l, chrom as chrom_r, "start" as start_l, "start" + 40 as end_l, "end" + 100 as start_r, "end" + 500 as end_r from intervals_a),
eb as (select chrom as chrom_l, chrom as chrom_r, "start" as start_l, "start" + 40 as end_l, "end" + 50 as start_r, "end" + 450 as end_r from intervals_b),
matched as (select distinct id from ea join eb on ea.chrom_l = eb.chrom_l and ea.chrom_r = eb.chrom_r and ea.start_l - 3 < eb.end_l and eb.start_l < ea.end_l + 3 and ea.start_r - 3 < eb.end_r and eb.start_r < ea.end_r + 3)"""
RUNS = """steps as (select chrom, pos, sum(d) as d from (select chrom, "start" as pos, 1 as d from intervals_a union all select chrom, "end", -1 from intervals_a) group by chrom, pos having sum(d) <> 0),
runs as (select chrom, pos as "start", lead(pos) over (partition by chrom order by pos) as "end", cast(sum(d) over (partition by chrom order by pos) as bigint) as depth from steps),
covered as (select * from runs where depth > 0 and "end" is not null)"""
SPAN = "(end_r - start_l)"
SANE = "mapq >= 20 and end_l > start_l and end_r > start_r and least(end_l, end_r) - greatest(start_l, start_r) <= 0"
ABERRANT = f"(strand_l = strand_r or strand_l = '-' or {SPAN} >= 2500 or {SPAN} <= 500)"
SPLIT_SANE = "mapq >= 20 and (strand_l <> strand_r or query_l <> query_r) and (chrom_l <> chrom_r or end_l < start_r)"


def merged(source: str, gap: int) -> str:
    return f"""select chrom, min("start") as "start", max("end") as "end", count(*) as n from (
 select *, sum(case when reach is null or "start" > reach + {gap} then 1 else 0 end) over (partition by chrom order by "start", "end") as island from (
  select *, max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) as reach from {source})) group by chrom, island"""


def _anchor(side: str, at_start: str) -> str:
    return f"case when {at_start} then start_{side} else end_{side} end - 15"


_AT_L = f"(t = 'DUP' or (t = 'INV' and {INWARD}))"
_AT_R = f"(t = 'DEL' or (t = 'INV' and {INWARD}))"
POSITIONS = f"pos as (select {G}, cast(sum(end_l) // count(*) as bigint) as pos_l, cast(sum(start_r) // count(*) as bigint) as pos_r, min(begin_l) as begin_l, max(finish_l) as finish_l, count(*) filter (where ev_type = 'PE') as PE, count(*) filter (where ev_type = 'SR') as SR, count(*) filter (where ev_type = 'BD') as BD from members group by {G})"
REPORTED = "case when chrom_l <> chrom_r then 'BND' when sv_type in ('DEL', 'DUP') then sv_type when strands like '%++%' and strands like '%--%' then 'INV' else 'BND' end"
SV_LEN = "case reported when 'DEL' then pos_l - pos_r when 'BND' then 0 else pos_r - pos_l end"
SAMPLE_CURVES = f"""{ISLANDS}, few as (select * from members),
each as (select {G}, {K}, 'l' as side, begin_l as b, unnest(range(begin_l, finish_l + 1)) as pos from few union all select {G}, {K}, 'r', begin_r, unnest(range(begin_r, finish_r + 1)) from few),
ps as (select {G}, {K}, side, pos, exp(-{_RATE} * abs(pos - b - 20)) as p from each),
total as (select {G}, side, pos, sum(p) as p from ps group by {G}, side, pos)"""
SA = """sa1 as (select *, split_part(split_part(sa, ';', 1), ',', 1) as r2, split_part(sa, ',', 2)::bigint - 1 as p2, split_part(sa, ',', 3) as s2, split_part(sa, ',', 4) as c2, len(list_filter(string_split(sa, ';'), lambda x: x <> '')) as n2, (flag & 16) <> 0 as minus from cigars where (flag & 1540) = 0),
a as (select *, {ra} as a_ra, {qa} as a_qa, {lead} as a_s, {tail} as a_e, {ra2} as b_ra, {qa2} as b_qa, {lead2} as b_s, {tail2} as b_e from sa1 where n2 = 1),
o as (select *, case when minus then a_e else a_s end as a_sqo, case when s2 = '-' then b_e else b_s end as b_sqo from a),
q as (select *, a_sqo + a_qa - 1 as a_eqo, b_sqo + b_qa - 1 as b_eqo, a_sqo <= b_sqo as f from o),
m as (select *, case when f then a_eqo else b_eqo end as l_eqo, case when f then b_sqo else a_sqo end as r_sqo,
 case when f then pos - a_s else p2 - b_s end as l_head, case when f then pos + a_ra - (a_s + a_qa) else p2 + b_ra - (b_s + b_qa) end as l_tail,
 case when f then p2 - b_s else pos - a_s end as r_head, case when f then p2 + b_ra - (b_s + b_qa) else pos + a_ra - (a_s + a_qa) end as r_tail,
 greatest(0, 1 + least(a_eqo, b_eqo) - greatest(a_sqo, b_sqo)) as ov from q),
z as (select *, least(a_eqo - a_sqo, b_eqo - b_sqo) + 1 - ov as mno, case when minus then r_tail - l_head else l_tail - r_head end as ins, r_sqo - l_eqo - 1 as desert, rname = r2 and minus = (s2 = '-') as same from m)"""
_c2 = lambda s: s.replace("cigar", "c2")
SA = SA.format(ra=_ops("MDN=X"), qa=_ops("MI=X"), lead=LEAD, tail=TAIL, ra2=_c2(_ops("MDN=X")), qa2=_c2(_ops("MI=X")), lead2=_c2(LEAD), tail2=_c2(TAIL))

ORACLE_SQL = {
    "evidence_interval_pairs": E + f""", f as (select *, case when strand_l = '+' then end_l - 10 else start_l - 89 end as f_l, case when strand_r = '+' then end_r - 10 else start_r - 89 end as f_r from evidence),
     g as (select *, greatest(f_r, 0) as b_r, case when chrom_l = chrom_r then greatest(0, end_l + 1 - greatest(f_r, 0)) else 0 end as cut from f)
     select {K}, case when strand_l = strand_r then 'INV' when strand_l = '+' then 'DEL' else 'DUP' end as sv_type, greatest(f_l, 0) as begin_l, case when chrom_l = chrom_r then least(f_l + 99, start_r - 1) else f_l + 99 end as finish_l,
     greatest(-f_l, 0) as clip_l, b_r + cut as begin_r, f_r + 99 as finish_r, greatest(-f_r, 0) + cut as clip_r from g""",
    "split_interval_pairs": E + f""", t as (select *, {SPLIT_TYPE} as t from evidence where {SPLIT_SANE}),
     f as (select *, {_anchor('l', _AT_L)} as f_l, {_anchor('r', _AT_R)} as f_r from t where t is not null and (t <> 'INV' or query_l <> query_r)),
     g as (select *, case when chrom_l = chrom_r then greatest(0, end_l + 1 - greatest(f_r, 0)) else 0 end as cut from f)
     select {K}, t as sv_type, case when {_AT_L} then '-' else '+' end as strand_l, case when {_AT_R} then '-' else '+' end as strand_r, greatest(f_l, 0) as begin_l,
     case when chrom_l = chrom_r then least(f_l + 30, start_r - 1) else f_l + 30 end as finish_l, greatest(f_r, 0) + cut as begin_r, f_r + 30 as finish_r from g""",
    "pair_sanity_filter": E + f"select {K}, mapq, end_l, start_r from evidence where {SANE}",
    "pair_aberrant_filter": E + f"select {K}, strand_l, strand_r, {SPAN} as span from evidence where {ABERRANT}",
    "source_routing": """with rec as (select l_suppkey % 7 as file, case when l_linenumber <= 3 then 'g' || l_linenumber else 'g9' end as grp from lineitem),
     src as (select s_suppkey % 6 as file, case when s_suppkey % 4 = 0 then '' else 'g' || (s_suppkey % 4) end as grp, max(s_suppkey) as ev_id from supplier group by 1, 2)
     select rec.file, rec.grp, coalesce(e.ev_id, w.ev_id) as ev_id, count(*) as n from rec left join src e on rec.file = e.file and rec.grp = e.grp left join src w on rec.file = w.file and w.grp = ''
     where coalesce(e.ev_id, w.ev_id) is not null group by 1, 2, 3""",
    "mate_pairing_toggle": E + f""", n as (select k1, k2, k3, row_number() over (partition by k1 order by {K}, start_l) - 1 as rn from evidence)
     select a.k1, a.k2 as first_k2, a.k3 as first_k3, b.k2 as second_k2, b.k3 as second_k3 from n a join n b on a.k1 = b.k1 and b.rn = a.rn + 1 and a.rn % 2 = 0""",
    "exclude_region_anti": AB + 'select id, chrom, "start", "end" from intervals_a a where not exists (select 1 from intervals_b b where a.chrom = b.chrom and a."start" <= b."end" and b."start" <= a."end")',
    "overlap_join": AB + 'select id, pid, least(a."end", b."end") - greatest(a."start", b."start") as bases from intervals_a a join intervals_b b on a.chrom = b.chrom and a."start" < b."end" and b."start" < a."end"',
    "overlap_semi": AB + 'select id, chrom, "start", "end" from intervals_a a where exists (select 1 from intervals_b b where a.chrom = b.chrom and a."start" < b."end" and b."start" < a."end")',
    "overlap_fraction_reciprocal": AB + """select id, pid from intervals_a a join intervals_b b on a.chrom = b.chrom and a."start" < b."end" and b."start" < a."end" and a.strand = b.strand
     where (least(a."end", b."end") - greatest(a."start", b."start")) / (a."end" - a."start") >= 0.3 and (least(a."end", b."end") - greatest(a."start", b."start")) / (b."end" - b."start") >= 0.3""",
    "overlap_left_hits": AB + """select id, coalesce(string_agg(cast(pid as varchar), ',' order by pid), '') as hits from intervals_a a left join intervals_b b on a.chrom = b.chrom and a."start" < b."end" and b."start" < a."end" group by id""",
    "count_hits": AB + 'select pid, count(id) as n_hits from intervals_b b left join intervals_a a on a.chrom = b.chrom and a."start" < b."end" and b."start" < a."end" group by pid',
    "pair_to_pair_both": AB + f", {ENDS} select id, chrom_l, start_l, start_r from ea where id in (select id from matched)",
    "pair_to_pair_notboth": AB + f", {ENDS} select id, chrom_l, start_l, start_r from ea where id not in (select id from matched)",
    "bnd_mate_stitch": """with ends as (select (o_orderkey // 2) || '_' || (o_orderkey % 2) as id, (o_orderkey // 2) || '_' || case when o_custkey % 5 = 0 then '9' else cast(1 - o_orderkey % 2 as varchar) end as mate_id, o_custkey % 20 as chrom, o_orderkey as pos from orders)
     select a.id as id_1, b.id as id_2, a.chrom as chrom_1, b.chrom as chrom_2, b.pos as pos_2 from ends a join ends b on a.mate_id = b.id and b.mate_id = a.id and a.id < b.id""",
    "interval_merge_gap50": A + merged("intervals_a", 50),
    "genome_coverage_runs": A + f', {RUNS} select chrom, "start", "end", depth from covered',
    "coverage_summary": A + f', {RUNS} select min(depth) as min_depth, max(depth) as max_depth, sum(depth * ("end" - "start")) / sum("end" - "start") as mean_depth from covered',
    "deep_regions": A + f", {RUNS}, deep as (select * from covered where depth > 2) " + merged("deep", 50),
    "per_base_depth": B + """, bases as (select chrom, unnest(range("start", "end")) as pos from intervals_b), d as (select chrom, pos, count(*) as depth from bases group by chrom, pos)
     select chrom, depth, count(*) as bases, cast(sum(pos) as bigint) as pos_sum from d group by chrom, depth""",
    "island_cluster_lr": f"with {ISLANDS} select {G}, count(*) as n, min(begin_l) as begin_l, max(finish_l) as finish_l, min(begin_r) as begin_r, max(finish_r) as finish_r from members group by {G}",
    "cluster_support_by_sample": f"with {ISLANDS} select {G}, sample, count(*) as SU, count(*) filter (where ev_type = 'PE') as PE, count(*) filter (where ev_type = 'SR') as SR, count(*) filter (where ev_type = 'BD') as BD from members group by {G}, sample",
    "strand_histogram": f"with {ISLANDS}, {STRANDS} select * from strands",
    "call_thresholds": f"with {ISLANDS}, per as (select {G}, sample, count(*) as n from members group by {G}, sample) select {G}, cast(sum(n) as bigint) as weight, max(n) as max_sample from per group by {G} having sum(n) >= 6 and max(n) >= 4",
    "curve_product": f"with {CURVES} select {G}, side, pos, n_used, round(logp, 6) as logp from product",
    "curve_score": f"with {CURVES}, w as (select {G}, side, exp(max(logp)) / (max(pos) - min(pos) + 1) as s from product group by {G}, side) select {G}, round(sum(s), 9) as score from w group by {G}",
    "curve_mixture": f"with {CURVES} select {G}, side, pos, round(ln(sum(exp(logp))), 6) as logp from curves group by {G}, side, pos",
    "curve_mode": f"with {CURVES}, best as (select *, row_number() over (partition by {G}, side order by round(logp, 6) desc, pos) as rn from product) select {G}, side, max(pos) filter (where rn = 1) as mode, round(max(logp), 6) as max_logp, min(pos) as first, count(*) as size from best group by {G}, side",
    "log_space_algebra": "select l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber, round(l_discount * l_tax, 9) as times, round(l_discount + l_tax, 9) as plus from lineitem",
    "insert_size_stats": C + """, m as (select median(isize) as med from cigars), d as (select median(isize - med) as mad from cigars, m where isize > med), kept as (select isize from cigars, m, d where isize < med + 10 * mad)
     select (select med from m) as median, (select mad from d) as upper_mad, count(*) as kept, round(avg(isize), 6) as mean, round(stddev_pop(isize), 6) as stdev from kept""",
    "insert_size_histogram": C + ", own as (select isize - 100 as bin, count(*) as n from cigars where isize between 100 and 600 group by 1) select b.bin, round(coalesce(n, 0) / (select sum(n) from own), 9) as freq from (select unnest(range(0, 500)) as bin) b left join own on own.bin = b.bin",
    "survival_curve": C + """, own as (select isize - 100 as bin, count(*) as n from cigars where isize between 100 and 600 group by 1), h as (select b.bin, coalesce(n, 0) / (select sum(n) from own) as freq from (select unnest(range(0, 500)) as bin) b left join own on own.bin = b.bin)
     select bin, round(freq, 9) as freq, round(sum(freq) over (order by bin desc), 9) as survival from h""",
    "svtype_alt_strings": E + f"""select {K}, case strand_l || strand_r when '++' then 'N]chr' || chrom_r || ':' || start_r || ']' when '--' then '[chr' || chrom_r || ':' || start_r || '[N' when '+-' then 'N[chr' || chrom_r || ':' || start_r || '[' else ']chr' || chrom_r || ':' || start_r || ']N' end as alt_1,
     case strand_l || strand_r when '++' then 'N]chr' || chrom_l || ':' || end_l || ']' when '--' then '[chr' || chrom_l || ':' || end_l || '[N' when '+-' then ']chr' || chrom_l || ':' || end_l || ']N' else 'N[chr' || chrom_l || ':' || end_l || '[' end as alt_2 from evidence""",
    "svlen_ci": f"with {ISLANDS}, {POSITIONS}, {STRANDS}, t as (select *, {REPORTED} as reported from pos join strands using ({G})) select {G}, reported, {SV_LEN} as sv_len, begin_l - pos_l as ci_low, finish_l - pos_l as ci_high from t",
    "cigar_query_offsets": C + f", q as (select *, case when (flag & 16) <> 0 then {TAIL} else {LEAD} end as query_start from cigars) select {K}, query_start, query_start + {_ops('MI')} as query_end, {_ops('MISHX=')} as query_length from q",
    "cigar_ref_end": C + f"select {K}, pos + {_ops('DMXN=')} as ref_end, {_ops('HS')} as clipped, {_ops('IDNSHPX=')} as not_matched, {LEAD} as leading from cigars",
    "sa_split_filter": C + f", {SA} select {K}, mno, ins, desert from z where mno >= 20 and (not same or (abs(ins) >= 50 and not (desert > 0 and desert - greatest(0, ins) > 50)))",
    "discordant_filter": C + f"select {K}, flag from cigars where (flag & 1540) = 0 and (flag & 1) <> 0 and (flag & 2058) = 0",
    "block_expansion": C + f""", s as (select *, list_zip(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1), regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2)) as ops from cigars), u as (select {K}, pos, generate_subscripts(ops, 1) as i, unnest(ops) as op from s),
     v as (select {K}, pos, i, op[2] as kind, op[1]::bigint as len from u), w as (select *, coalesce(sum(case when kind in ('M', 'D', 'N', '=', 'X') then len else 0 end) over (partition by {K}, pos order by i rows between unbounded preceding and 1 preceding), 0) as before from v)
     select {K}, cast(pos + before as bigint) as block_start, cast(pos + before + len as bigint) as block_end from w where kind in ('M', '=', 'X')""",
    "flag_stats": C + """select count(*) as total, count(*) filter (where flag & 1 <> 0) as paired, count(*) filter (where flag & 2 <> 0) as proper, count(*) filter (where flag & 16 <> 0) as reverse, count(*) filter (where flag & 64 <> 0) as first, count(*) filter (where flag & 128 <> 0) as second, count(*) filter (where flag & 512 <> 0) as failed,
     count(*) filter (where flag & 1024 <> 0) as duplicate, count(*) filter (where flag & 4 = 0) as mapped, count(*) filter (where flag & 1 <> 0 and flag & 12 = 0) as both_mapped, count(*) filter (where flag & 1 <> 0 and flag & 4 = 0 and flag & 8 <> 0) as single,
     round(avg(isize) filter (where flag & 1 <> 0 and flag & 64 <> 0 and isize <> 0), 6) as mean_insert, median(isize) filter (where flag & 1 <> 0 and flag & 64 <> 0 and isize <> 0) as median_insert from cigars""",
    "library_orientation": C + """, m as (select k4 % 4 as grp, isize, case when 350 <= isize then case when flag & 64 <> 0 then 0 else 4 end else case when flag & 64 <> 0 then 4 else 0 end end
      + 2 * case when 350 <= isize then (flag & 16 <> 0)::int else (flag & 32 <> 0)::int end + case when 350 <= isize then (flag & 32 <> 0)::int else (flag & 16 <> 0)::int end + 1 as model from cigars),
     c as (select grp, model, count(*) as n from m group by grp, model), r as (select *, row_number() over (partition by grp order by n desc, model) as rk, sum(n) over (partition by grp) as a from c), t as (select * from r where rk <= 2),
     s as (select grp, count(*) as n, quantile_cont(isize, 0.00135) as low, median(isize) as median, quantile_cont(isize, 0.99865) as high from m join t using (grp, model) group by grp)
     select grp, string_agg(cast(model as varchar), ',' order by rk) as models, round(1 - sum(t.n) / max(a), 9) as ambiguity, max(s.n) as n, round(max(low), 6) as low, max(median) as median, round(max(high), 6) as high from t join s using (grp) group by grp""",
    "column_summaries": """with v as (select l_suppkey as grp, cast(l_quantity as bigint) as v from lineitem), f as (select grp, v, count(*) as n from v group by grp, v),
     m as (select grp, max(v) filter (where a = 1) as mode, max(v) filter (where b = 1) as antimode, count(*) as n_distinct, string_agg(cast(v as varchar), ',' order by v) as distinct_values from (select *, row_number() over (partition by grp order by n desc, v) as a, row_number() over (partition by grp order by n, v) as b from f) group by grp)
     select grp, cast(sum(v) as bigint) as total, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as stdev, round(stddev_samp(v), 6) as sstdev, median(v) as median, min(v) as least, max(v) as most, count(*) as n, max(mode) as mode, max(antimode) as antimode, max(n_distinct) as n_distinct, max(distinct_values) as distinct_values from v join m using (grp) group by grp""",
    "value_frequencies": """with f as (select user_id as grp, event_type as v, count(*) as n from events group by 1, 2) select grp, string_agg(v || ':' || n, ',' order by n desc, v) as falling, string_agg(v || ':' || n, ',' order by n, v) as rising from f group by grp""",
    "sequence_composition": "select doc_id, " + ", ".join(f"length(text) - length(translate(text, '{b}{b.lower()}', '')) as {b.lower()}" for b in "ACGT") + ", length(translate(text, 'ACGTacgt', '')) as other from documents",
    "reverse_complement": "select doc_id, md5(reverse(translate(text, 'ACGTacgt', 'TGCAtgca'))) as rc_md5, substring(reverse(translate(text, 'ACGTacgt', 'TGCAtgca')), 1, 40) as rc_head from documents",
    "info_map_parse": "select event_id, event_type as sv_type, user_id as stop, true as imprecise, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "record_json": """select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"pos":' || o_custkey || ',"kind":"' || o_orderstatus || '"}' as line from orders""",
    "predicate_language": C + f"select {K}, flag, isize, rname from cigars where ((k4 % 61 >= 30 and flag & 2 <> 0) or isize > 500) and not starts_with(rname, 'chr1')",
    "region_predicate": C + f"select {K}, rname, pos from cigars where rname = 'chr2' and pos between 5000 and 90000",
    "sort_check": """with e as (select event_id, user_id, cast(trunc(value * 100) as bigint) as v from events), l as (select *, lag(v) over (partition by user_id order by event_id) > v as bad from e)
     select user_id, count(*) filter (where bad) as n_breaks, min(event_id) filter (where bad) as first_break from l group by user_id""",
    "multi_key_sort": f"with {duck('evidence')}, {WINDOWS} select sv_type, chrom_l, chrom_r, {K}, row_number() over (partition by sv_type, chrom_l, chrom_r order by strand_l, strand_r, begin_l, finish_l, begin_r, finish_r, {K}) as place from windows",
    "genome_offset_lookup": """with g as (select n_name as chrom, n_nationkey * 1000 + 5000 as length, coalesce(sum(n_nationkey * 1000 + 5000) over (order by n_nationkey rows between unbounded preceding and 1 preceding), 0) as b from nation),
     o as (select o_orderkey, o_orderkey * 7919 % 425000 as "at" from orders) select o_orderkey, "at", chrom, cast("at" - b as bigint) as pos from o join g on "at" >= b and "at" < b + length""",
    "genome_bins": A + """select id, case """ + " ".join(f"""when ("start" >> {14 + 3 * k}) = (("end" - 1) >> {14 + 3 * k}) then ("start" >> {14 + 3 * k}) + {sum(8**j for j in range(6 - k))}""" for k in range(7)) + " else 0 end as bin from intervals_a",
    "site_dedup": "with r as (select o_custkey % 97 as chrom, o_orderkey % 13 as pos, o_orderkey as line, o_orderstatus from orders) select chrom, pos, max(line) as line, arg_max(o_orderstatus, line) as o_orderstatus, min(line) as first_seen from r group by chrom, pos",
    "vcf_merge_sum": f"with {SAMPLE_CURVES} select {G}, side, pos, round(p / sum(p) over (partition by {G}, side), 9) as p from total where p > 0",
    "vcf_merge_product": f"""with {SAMPLE_CURVES}, norm as (select {G}, side, pos, p / sum(p) over (partition by {G}, side) as p from total),
     mode as (select {G}, side, pos from (select *, row_number() over (partition by {G}, side order by round(p, 12) desc, pos) as rn from norm) where rn = 1),
     size as (select {G}, count(distinct concat_ws(':', {K})) as members from ps group by {G}),
     good as (select {G}, max(members) as members from ps join mode using ({G}, side, pos) join size using ({G}) group by {G} having count(*) = 2 * max(members)),
     met as (select {G}, side, pos, sum(ln(p)) as s from ps join good using ({G}) group by {G}, side, pos having count(*) = max(members))
     select {G}, side, pos, round(s - t - ln(sum(exp(s - t)) over (partition by {G}, side)), 6) as logp from (select *, max(s) over (partition by {G}, side) as t from met)""",
    "cnv_to_intervals": f"""with {duck('segments')} select pid, chrom, case when log2 < 0 then 'DEL' else 'DUP' end as sv_type, greatest(1, "start" - 500) as start_l, "start" + 500 as end_l, greatest(1, "end" - 500) as start_r, "end" + 500 as end_r from segments where abs(log2) >= 0.2""",
    "window_passes": E + ", p as (select chrom_r, start_r, case when start_r < 100000 then 0 else cast(floor(log2(start_r // 100000)) as bigint) + 1 end as pass_k from evidence) select chrom_r, pass_k, count(*) as n, max(start_r) as last from p group by chrom_r, pass_k",
    "gap_sessions": """with t as (select user_id, cast(floor(epoch(ts)) as bigint) as t from events), o as (select *, case when t - lag(t) over (partition by user_id order by t) > 3600 or lag(t) over (partition by user_id order by t) is null then 1 else 0 end as o from t),
     s as (select *, cast(sum(o) over (partition by user_id order by t) as bigint) as session from o) select user_id, session, count(*) as n, max(t) - min(t) as seconds from s group by user_id, session""",
    "coverage_by_hour": "select event_type, cast(floor(epoch(ts) / 3600) * 3600 as bigint) as start, count(*) as n from events group by 1, 2",
    "interval_union_types": E + f""", t as (select *, {SPLIT_TYPE} as t, case when strand_l = strand_r then 'INV' when strand_l = '+' then 'DEL' else 'DUP' end as p from evidence),
     u as (select ev_type, p as sv_type, sample from t where ev_type = 'PE' and {SANE} and {ABERRANT} union all select ev_type, t, sample from t where ev_type = 'SR' and {SPLIT_SANE} and t is not null and (t <> 'INV' or query_l <> query_r) union all select ev_type, p, sample from t where ev_type = 'BD')
     select ev_type, sv_type, sample, count(*) as n from u group by 1, 2, 3""",
    "call_pipeline": f"with {ISLANDS.replace('from evidence)', f'from evidence where {SANE} and {ABERRANT})', 1)}, {POSITIONS}, {STRANDS}, per as (select {G}, sample, count(*) as n from members group by {G}, sample), kept as (select {G}, cast(sum(n) as bigint) as weight from per group by {G} having sum(n) >= 4 and max(n) >= 2), t as (select *, {REPORTED} as reported from pos join strands using ({G}) join kept using ({G})) select {G}, pos_l, pos_r, reported, {SV_LEN} as sv_len, strands, weight, PE, SR, BD from t",
}
