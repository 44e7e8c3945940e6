"""DuckDB SQL with the same results as the queries of this subpackage, where SQL can express them over whole tables."""

_TERMS = r"""
with dedup as (select * from manifest_summary qualify row_number() over (partition by summary_id order by loaded_at desc) = 1),
raw as (
  select summary_id, 'uses_permissions' as field, unnest(uses_permissions) as entry from dedup
  union all
  select summary_id, 'uses_features', f.name from (select summary_id, unnest(uses_features) as f from dedup)),
clean as (select summary_id, field, regexp_replace(entry, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') as term from raw where entry is not null),
counts as (
  select field, term, cast(count(*) as bigint) as n_total, cast(count(distinct summary_id) as bigint) as n_records
  from clean where term <> '' group by 1, 2),
marked as (
  select *, case when n_records <= 2 then 'rare' when n_records > 0.5 * (select count(*) from dedup) then 'common' end as mark from counts)
"""

_FREQUENT = """
with n as (select count(callee) as total from call_edge)
select callee, cast(count(*) as bigint) as n_exact from call_edge where callee is not null
group by callee having count(*) >= 0.0025 * (select total from n)
"""

_SPANS = """
with m as (select method_id, list_transform(list_sort(list_filter(ops, lambda x: x is not null)),
    lambda x: hash(x.kind, coalesce(x.opcode, ''), coalesce(x.callee_class, ''), coalesce(x.callee_name, ''), coalesce(x.callee_desc, ''))) as e from smali_method),
w as (select method_id, i as pos, e[i + 1 : i + 16] as gram from (select method_id, e, unnest(range(0, len(e) - 15)) as i from m where len(e) >= 16)),
twice as (select gram from w group by gram having count(distinct method_id) > 1),
hit as (select distinct method_id, unnest(range(pos, pos + 16)) as pos from w join twice using (gram)),
island as (select *, pos - row_number() over (partition by method_id order by pos) as k from hit),
spans as (select method_id, cast(min(pos) as int) as from_pos, cast(max(pos) as int) as to_pos from island group by method_id, k)
"""

_NEAREST = """
with v as (select vec_id, features as f from package_node where vec_id is not null and len(features) = 13 and len(list_filter(features, lambda x: x is null)) = 0),
d as (
  select a.vec_id, b.vec_id as neighbour, list_sum(list_transform(range(1, 14), lambda i: (a.f[i]::bigint - b.f[i]::bigint) * (a.f[i]::bigint - b.f[i]::bigint))) as distance
  from v a join v b on a.vec_id <> b.vec_id),
near as (
  select vec_id, cast(row_number() over (partition by vec_id order by distance, neighbour) as int) as rank, neighbour, cast(distance as double) as distance from d
  qualify rank <= 5)
"""

ORACLE = {
    "p4_found": _NEAREST + "select distinct least(vec_id, neighbour) as id_a, greatest(vec_id, neighbour) as id_b from near",
    "p4_nearest": _NEAREST + "select * from near",
    "p7_found": _SPANS + "select * from spans",
    "p7_shared_share": _SPANS + """
, s as (select method_id, sum(to_pos - from_pos + 1) as n from spans group by 1)
select method_id, cast(coalesce(len(e), 0) as bigint) as n_ops, cast(coalesce(s.n, 0) as bigint) as n_shared,
  case when len(e) > 0 then coalesce(s.n, 0) / len(e) else 0.0 end as share
from m left join s using (method_id)""",
    "p1_found": _TERMS + "select field, term, mark from marked where mark is not null",
    "p1_term_counts": _TERMS + "select field, term, n_total, n_records, mark from marked",
    "p3_found": f"select callee from ({_FREQUENT})",
    "p3_exact_counts": f"select callee, n_exact from ({_FREQUENT})",
    "p6_found": """
with recursive ids as (
  select old_pkg_id as pkg_id from match_result where old_pkg_id is not null
  union select new_pkg_id from match_result where new_pkg_id is not null),
tie as (
  select old_pkg_id as u, new_pkg_id as v from match_result
  where old_pkg_id is not null and new_pkg_id is not null and upper(trim(status)) in ('MATCH', 'CHANGED')),
both_ways as (select u, v from tie union select v, u from tie),
reach(pkg_id, seen) as (
  select pkg_id, pkg_id from ids
  union
  select r.pkg_id, b.v from reach r join both_ways b on b.u = r.seen)
select min(seen) as group_id, pkg_id from reach group by pkg_id
""",
}
