"""Queries of the program-structure operators over the tables of a data directory, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbase.functions import names
from strandbase.functions.filters import BRANCHES, INVOKES, filtered_lines
from strandbase.operators import callgraph, diff, matching, packages, permissions
from strandbase.runtime import cut, table, trimmed
from strandbase.sinks import tables as sink

PATTERNS = [r"\.net\.", r"^com\.[a-f]"]
LINES = ["[0-9]+", "^[A-Z][a-z]+ [a-z]+ (in|of)"]
ITERATIONS = 3


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "smali_method")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dex_class")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.call_edges(_methods(spark, sf_dir))


def call_edges_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.call_edges(_methods(spark, sf_dir), PATTERNS)


def call_edges_per_apk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.call_edges(_methods(spark, sf_dir), None, "side", "apk_id")


def callees_per_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = callgraph.callees_per_caller(callgraph.call_edges(_methods(spark, sf_dir)))
    return made.select("caller", F.array_join("callees", ",").alias("callees"))


def callgraph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.dot_lines(callgraph.call_edges(_methods(spark, sf_dir)))


def jni_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    jni = F.col("class_jni")
    pkg = names.package_of(jni)
    return _classes(spark, sf_dir).select(
        "side", "apk_id", "dex_ord", "class_ord", names.jni_class_to_java(jni).alias("java_name"), pkg.alias("package_name"),
        names.package_label(pkg).alias("package_label"), names.external_kind(jni).alias("kind"),
    )


def java_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = names.java_signature(F.col("class_java"), F.col("ret_type"), F.col("name"), F.col("arg_types"))
    key = names.method_key(F.col("class_jni"), F.col("name"), F.col("descriptor"))
    return _methods(spark, sf_dir).select("method_id", made.alias("signature"), key.alias("method_key"))


def method_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = names.method_filename(F.col("name"), F.col("arg_types"))
    return _methods(spark, sf_dir).select("method_id", names.class_directory(F.col("class_java")).alias("directory"), made.alias("filename"))


def method_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.method_diff(_classes(spark, sf_dir), _methods(spark, sf_dir))


def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return method_diff(spark, sf_dir).groupBy("apk_id", "edit").agg(F.count("*").alias("n"))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_lines(method_diff(spark, sf_dir))


def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = diff.extracted_files(_classes(spark, sf_dir), _methods(spark, sf_dir), None, ["invoke", "return"])
    return made.select("apk_id", "root", "path", F.length("content").cast("bigint").alias("n_chars"))


def package_method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.package_method_counts(_classes(spark, sf_dir), _methods(spark, sf_dir))


def method_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.package_graph(_methods(spark, sf_dir))[0].select(*packages.PACKAGE, "method_key", *packages.FEATURES)


def _keyed(nodes: DataFrame, *names_: str) -> DataFrame:
    out = nodes.select(*packages.PACKAGE, F.col("node").alias(names_[0]), F.col("method_key").alias(names_[1]))
    return out


def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = packages.package_graph(_methods(spark, sf_dir))
    counted = edges.groupBy(*packages.NODE, "to").agg(F.count("*").alias("n"))
    made = counted.join(_keyed(nodes, "node", "caller_key"), packages.NODE).join(_keyed(nodes, "to", "callee_key"), [*packages.PACKAGE, "to"])
    return made.select(*packages.PACKAGE, "caller_key", "callee_key", "n")


def neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = packages.package_graph(_methods(spark, sf_dir))
    near = packages.neighbourhoods(edges).join(_keyed(nodes, "node", "method_key"), packages.NODE)
    return near.join(_keyed(nodes, "neighbour", "neighbour_key"), [*packages.PACKAGE, "neighbour"]).select(*packages.PACKAGE, "method_key", "neighbour_key")


def wl_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = packages.package_graph(_methods(spark, sf_dir))
    every, _, _ = packages.wl_labels(nodes, edges, ITERATIONS)
    return every.join(nodes.select(*packages.NODE, "method_key"), packages.NODE).select(*packages.PACKAGE, "method_key", "iter", "label")


def wl_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.wl_histograms(packages.wl_labels(*packages.package_graph(_methods(spark, sf_dir)), ITERATIONS)[0])


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, last, _ = packages.wl_labels(*packages.package_graph(_methods(spark, sf_dir)), ITERATIONS)
    sizes = cut(last.groupBy(*packages.PACKAGE).agg(F.count("*").alias("n_nodes")), "sizes")
    return matching.package_similarity(packages.wl_histograms(every), sizes, ITERATIONS)


def package_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_candidates(_scores(spark, sf_dir))


def _matched(spark: SparkSession, sf_dir: str, node_matching: bool) -> tuple[DataFrame, DataFrame]:
    return matching.match_packages(_classes(spark, sf_dir), _methods(spark, sf_dir), 0.6, 0.2, ITERATIONS, node_matching)


_RESULT = ["apk_id", "section", "old_package", "new_package", "score", "status"]


def match_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, False)[0].select(_RESULT)


def match_node_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, True)[0].select(_RESULT)


def match_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.csv_lines(_matched(spark, sf_dir, False)[0])


def match_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.table_lines(_matched(spark, sf_dir, False)[0])


def match_detail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.detail_lines(*_matched(spark, sf_dir, True))


def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.column_widths(_matched(spark, sf_dir, False)[0])


def _permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of all manifests of an application's side, in order."""
    rows = table(spark, sf_dir, "manifest_summary").select("apk_id", "side", "summary_id", F.posexplode("uses_permissions").alias("at", "permission"))
    return rows.select("apk_id", "side", F.struct("summary_id", "at").alias("pos"), trimmed(F.col("permission")).alias("permission")).filter("permission <> ''")


def permission_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _permissions(spark, sf_dir).select("apk_id", "side", "pos.summary_id", "pos.at", "permission")


def _permission_edits(spark: SparkSession, sf_dir: str, edit: str) -> DataFrame:
    made = permissions.permission_diff(_permissions(spark, sf_dir)).filter(F.col("edit") == edit)
    return made.select("apk_id", "pos.summary_id", "pos.at", "permission")


def permission_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _permission_edits(spark, sf_dir, "ADDED")


def permission_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _permission_edits(spark, sf_dir, "DELETED")


def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", filtered_lines(F.col("text"), LINES).alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        call_edges, call_edges_filtered, call_edges_per_apk, callees_per_caller, callgraph_dot, jni_names, java_signatures, method_filenames, method_diff,
        diff_summary, diff_lines, extracted_files, package_method_counts, method_features, package_edges, neighborhoods, wl_labels, wl_histograms,
        package_similarity, best_candidate, match_packages, match_node_consistency, match_csv_lines, match_table_lines, match_detail_lines, column_widths,
        permission_list, permission_added, permission_removed, line_filter,
    )
}


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _java(c: str) -> str:
    return f"replace(case when ends_with({c}, ';') then regexp_replace(left({c}, length({c}) - 1), '^L', '') else {c} end, '/', '.')"


def _pkg(c: str) -> str:
    inner = f"{c}[2:length({c}) - 1]"
    return f"case when starts_with({c}, 'L') and ends_with({c}, ';') and length({c}) > 1 then case when contains({inner}, '/') then regexp_replace({inner}, '/[^/]*$', '') else '' end end"


def _kind(c: str) -> str:
    tests = " ".join(f"when starts_with({c}, '{p}') then '{k}'" for k, ps in names.EXTERNAL.items() for p in ps)
    return f"case {tests} else 'other' end"


_LABEL = "case when {c} = '' then '(default)' else replace({c}, '/', '.') end"
_ARGS = "coalesce(array_to_string(list_transform(arg_types, lambda a: '\"' || replace(replace(a, '\\', '\\\\'), '\"', '\\\"') || '\"'), ', '), '')"
_SIGNATURE = f"class_java || ': ' || ret_type || ' ' || name || '([' || {_ARGS} || '])'"
_SORTED = "list_sort(list_filter(ops, lambda x: x is not null))"

_CALLS = f"""
calls as (
  select side, apk_id, class_java || ':' || name as caller, {_java('o.callee_class')} || ':' || o.callee_name as callee, class_java
  from (select side, apk_id, class_java, name, unnest(ops) as o from smali_method)
  where o.opcode in ({_in(INVOKES)}) and o.callee_class is not null)
"""
_EDGES = f"with {_CALLS} select distinct caller, callee from calls"

_EFFECTIVE = f"""
last_class as (
  select side, apk_id, dex_ord, class_ord from dex_class where class_java is not null
  qualify row_number() over (partition by side, apk_id, class_java order by dex_ord desc, class_ord desc) = 1),
eff as (
  select m.*, {_SIGNATURE} as signature, coalesce(list_transform({_SORTED}, lambda x: coalesce(x.opcode, x.kind)), []) as kinds
  from smali_method m semi join last_class l on m.side = l.side and m.apk_id = l.apk_id and m.dex_ord = l.dex_ord and m.class_ord = l.class_ord),
old_last as (
  select apk_id, class_java, signature, kinds, name, arg_types, smali_text, method_ord, n from (
    select *, count(*) over (partition by apk_id, class_java, signature) as n,
      row_number() over (partition by apk_id, class_java, signature order by method_ord desc) as k
    from eff where side = 'old') where k = 1),
joined as (
  select coalesce(n.apk_id, o.apk_id) as apk_id, coalesce(n.class_java, o.class_java) as class_java, coalesce(n.signature, o.signature) as signature,
    case when o.kinds is null then 'ADDED' when n.kinds is null then 'REMOVED' else 'CHANGED' end as edit, o.n as copies,
    n.name as n_name, n.arg_types as n_args, n.smali_text as n_text, n.method_ord as n_ord,
    o.name as o_name, o.arg_types as o_args, o.smali_text as o_text, o.method_ord as o_ord
  from (select * from eff where side = 'new') n full join old_last o
    on n.apk_id = o.apk_id and n.class_java = o.class_java and n.signature = o.signature
  where o.kinds is null or n.kinds is null or o.kinds <> n.kinds),
edits as (
  select apk_id, edit, signature from (
    select apk_id, edit, signature, unnest(range(case when edit = 'REMOVED' then copies else 1 end)) as k from joined))
"""

_FILE = "replace(replace({n}, '<', ''), '>', '') || '(' || coalesce(array_to_string({a}, ', '), '') || ').smali'"


def _filename(n: str, a: str) -> str:
    full = _FILE.format(n=n, a=a)
    safe = f"replace(replace({n}, '<', ''), '>', '')"
    return f"case when strlen({full}) > 200 then {safe} || '_' || md5({full})[1:16] || '.smali' else {full} end"


def _lines(c: str, patterns: list[str]) -> str:
    tests = " or ".join(f"regexp_matches(x, '{p}')" for p in patterns)
    return f"""case when {c} is null then null when {c} = '' then '' else coalesce(array_to_string(list_filter(string_split_regex(regexp_replace({c}, '\\r?\\n\\z', ''), '\\r?\\n'), lambda x: {tests}), chr(10)), '') end"""


_GRAPH = f"""
nodes as (
  select side, apk_id, pkg, method_key, ops, coalesce(n_param_entries, 0) as num_params from (
    select side, apk_id, {_pkg('class_jni')} as pkg, class_jni || '->' || name || descriptor as method_key, ops, n_param_entries, dex_ord, class_ord, method_ord
    from smali_method) where pkg is not null
  qualify row_number() over (partition by side, apk_id, pkg, method_key order by dex_ord desc, class_ord desc, method_ord desc) = 1),
op as (
  select side, apk_id, pkg, method_key, o.opcode as opcode, o.callee_class as cc, o.callee_class || '->' || o.callee_name || o.callee_desc as callee_key, {_pkg('o.callee_class')} as cp
  from (select side, apk_id, pkg, method_key, unnest(ops) as o from nodes) where o.kind = 'Op'),
inv as (select *, coalesce(cp = pkg, false) as own, {_kind('cc')} as ext from op where opcode in ({_in(INVOKES)})),
edge as (
  select i.side, i.apk_id, i.pkg, i.method_key as caller_key, i.callee_key from inv i
  join nodes n on n.side = i.side and n.apk_id = i.apk_id and n.pkg = i.pkg and n.method_key = i.callee_key where i.own),
deg as (select side, apk_id, pkg, callee_key as method_key, count(*) as in_degree from edge group by all),
per_inv as (
  select side, apk_id, pkg, method_key, count(*) as out_degree, count(*) filter (not own and ext in ('android', 'androidx')) as ext_android,
    count(*) filter (not own and ext = 'java') as ext_java, count(*) filter (not own and ext = 'kotlin') as ext_kotlin, count(*) filter (not own and ext = 'other') as ext_other,
    count(*) filter (opcode like 'InvokeVirtual%' or opcode like 'InvokeSuper%') as invoke_virtual, count(*) filter (opcode like 'InvokeStatic%') as invoke_static,
    count(*) filter (opcode like 'InvokeDirect%') as invoke_direct, count(*) filter (opcode like 'InvokeInterface%') as invoke_interface
  from inv group by all),
per_op as (select side, apk_id, pkg, method_key, count(*) as num_instructions, max(cast(opcode in ({_in(BRANCHES)}) as int)) as has_branches from op group by all),
feat as (
  select n.side, n.apk_id, n.pkg, n.method_key, {', '.join(f'cast(coalesce({c}, 0) as int) as {c}' for c in packages.FEATURES)}
  from nodes n left join deg using (side, apk_id, pkg, method_key) left join per_inv using (side, apk_id, pkg, method_key)
  left join per_op using (side, apk_id, pkg, method_key)),
near as (
  select side, apk_id, pkg, caller_key as method_key, callee_key as neighbour_key from edge
  union select side, apk_id, pkg, callee_key, caller_key from edge)
"""


def _wl(iterations: int) -> str:
    first = " || ',' || ".join(f"cast({c} as varchar)" for c in packages.FEATURES)
    parts = [f"l0 as (select side, apk_id, pkg, method_key, md5({first}) as label from feat)"]
    for i in range(1, iterations + 1):
        parts.append(f"""
a{i} as (
  select n.side, n.apk_id, n.pkg, n.method_key, string_agg(l.label, ',' order by l.label) as around from near n
  join l{i - 1} l on l.side = n.side and l.apk_id = n.apk_id and l.pkg = n.pkg and l.method_key = n.neighbour_key group by all),
l{i} as (select l.side, l.apk_id, l.pkg, l.method_key, md5(l.label || '|' || coalesce(a.around, '')) as label from l{i - 1} l left join a{i} a using (side, apk_id, pkg, method_key))""")
    every = " union all ".join(f"select *, {i} as iter from l{i}" for i in range(iterations + 1))
    return f"with {_GRAPH}, " + ", ".join(parts) + f""",
labels as ({every}),
hist as (select side, apk_id, pkg, iter, label, count(*) as cnt from labels group by all),
sizes as (select side, apk_id, pkg, count(*) as n from l{iterations} group by all),
scores as (
  select c.*, shared / sqrt(cast(o.n * {iterations + 1} as double) * cast(w.n * {iterations + 1} as double)) as score from (
    select a.apk_id, a.pkg as old_package, b.pkg as new_package, sum(least(a.cnt, b.cnt)) as shared
    from hist a join hist b on a.apk_id = b.apk_id and a.iter = b.iter and a.label = b.label where a.side = 'old' and b.side = 'new' group by all) c
  join sizes o on o.side = 'old' and o.apk_id = c.apk_id and o.pkg = old_package join sizes w on w.side = 'new' and w.apk_id = c.apk_id and w.pkg = new_package),
best as (select apk_id, old_package, new_package, score from scores qualify row_number() over (partition by apk_id, old_package order by score desc, new_package) = 1),
chosen as (select *, row_number() over (partition by apk_id, new_package order by score desc, old_package) = 1 and score >= 0.2 as won from best),
counts as (
  select side, apk_id, pkg, sum(n) as n_methods from (
    select side, apk_id, {_pkg('class_jni')} as pkg, 0 as n from dex_class union all select side, apk_id, {_pkg('class_jni')}, 1 from smali_method)
  where pkg is not null group by all),
bare as (select * from counts c anti join sizes s on s.side = c.side and s.apk_id = c.apk_id and s.pkg = c.pkg),
result as (
  select s.apk_id, 0 as section, coalesce(score, 0.0) as sort_score, s.pkg as old_package, case when won then new_package else '---' end as new_package,
    case when won then score else 0.0 end as score, case when won is not true then 'REMOVED' when score >= 0.6 then 'MATCH' else 'CHANGED' end as status
  from sizes s left join chosen c on c.apk_id = s.apk_id and c.old_package = s.pkg where s.side = 'old'
  union all select apk_id, 1, 0.0, '---', pkg, 0.0, 'NEW' from sizes s where side = 'new' and not exists (select 1 from chosen c where c.won and c.apk_id = s.apk_id and c.new_package = s.pkg)
  union all select apk_id, 2, 0.0, pkg, '---', 0.0, 'REMOVED' from bare where side = 'old'
  union all select apk_id, 3, 0.0, '---', pkg, 0.0, 'NEW' from bare where side = 'new'),
shown as (
  select *, {_LABEL.format(c='old_package')} as old_label, {_LABEL.format(c='new_package')} as new_label,
    case when score <= 0 then '---' else printf('%.2f', floor(score * 100 + 0.5) / 100) end as score_label from result),
widths as (
  select apk_id, cast(greatest(max(strlen(old_label)), 13) as bigint) as old_label, cast(greatest(max(strlen(new_label)), 13) as bigint) as new_label,
    cast(greatest(max(strlen(score_label)), 5) as bigint) as score_label, cast(greatest(max(strlen(status)), 6) as bigint) as status from shown group by 1),
near_last as (
  select n.side, n.apk_id, n.pkg, n.method_key, string_agg(l.label, ',' order by l.label) as around from near n
  join l{iterations} l on l.side = n.side and l.apk_id = n.apk_id and l.pkg = n.pkg and l.method_key = n.neighbour_key group by all),
entry as (
  select l.side, l.apk_id, l.pkg, l.label, coalesce(a.around, '') as around, row_number() over (partition by l.side, l.apk_id, l.pkg order by l.label, coalesce(a.around, '')) as at
  from l{iterations} l left join near_last a using (side, apk_id, pkg, method_key)),
consistent as (
  select r.apk_id, r.old_package, r.new_package, count(w.label) / cast(greatest(any_value(so.n), any_value(sn.n)) as double) as c
  from result r join entry o on o.side = 'old' and o.apk_id = r.apk_id and o.pkg = r.old_package
  left join entry w on w.side = 'new' and w.apk_id = r.apk_id and w.pkg = r.new_package and w.at = o.at and w.label = o.label and w.around = o.around
  join sizes so on so.side = 'old' and so.apk_id = r.apk_id and so.pkg = r.old_package join sizes sn on sn.side = 'new' and sn.apk_id = r.apk_id and sn.pkg = r.new_package
  where r.status in ('MATCH', 'CHANGED') group by all),
fine as (
  select r.* replace (r.score * coalesce(c, 1.0) as score, case when r.status in ('MATCH', 'CHANGED') and r.score * coalesce(c, 1.0) < 0.2 then 'REMOVED'
    when r.status in ('MATCH', 'CHANGED') and r.score * coalesce(c, 1.0) < 0.6 then 'CHANGED' else r.status end as status)
  from result r left join consistent using (apk_id, old_package, new_package))
"""


_WL = _wl(ITERATIONS)
_COLUMNS = ", ".join(_RESULT)
_PERMISSIONS = r"""
with entry as (
  select apk_id, side, summary_id, cast(at_ as int) as "at", regexp_replace(p, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') as permission from (
    select apk_id, side, summary_id, unnest(uses_permissions) as p, unnest(range(len(uses_permissions))) as at_ from manifest_summary)),
kept as (select * from entry where permission <> '')
"""
_EDITED = _PERMISSIONS + "select apk_id, summary_id, \"at\", permission from kept k where side = '{a}' and not exists (select 1 from kept o where o.side = '{b}' and o.apk_id = k.apk_id and o.permission = k.permission)"

ORACLE = {
    "call_edges": _EDGES,
    "call_edges_filtered": f"with {_CALLS} select distinct caller, callee from calls where " + " or ".join(f"regexp_matches(class_java, '{p}')" for p in PATTERNS),
    "call_edges_per_apk": f"with {_CALLS} select distinct side, apk_id, caller, callee from calls",
    "callees_per_caller": f"select caller, string_agg(callee, ',' order by callee) as callees from ({_EDGES}) group by 1",
    "callgraph_dot": f"""select '"' || caller || '" -> "' || callee || '"; ' as line from ({_EDGES}) union all select 'digraph {{' union all select '}}'""",
    "jni_names": f"select side, apk_id, dex_ord, class_ord, {_java('class_jni')} as java_name, p as package_name, {_LABEL.format(c='p')} as package_label, {_kind('class_jni')} as kind from (select *, {_pkg('class_jni')} as p from dex_class)",
    "java_signatures": f"select method_id, {_SIGNATURE} as signature, class_jni || '->' || name || descriptor as method_key from smali_method",
    "method_filenames": f"select method_id, replace(class_java, '.', '/') as directory, {_filename('name', 'arg_types')} as filename from smali_method",
    "method_diff": f"with {_EFFECTIVE} select * from edits",
    "diff_summary": f"with {_EFFECTIVE} select apk_id, edit, count(*) as n from edits group by 1, 2",
    "diff_lines": f"with {_EFFECTIVE} select apk_id, edit || ': ' || signature as line from edits",
    "extracted_files": f"""with {_EFFECTIVE}, f as (
  select apk_id, 'new' as root, replace(class_java, '.', '/') || '/' || {_filename('n_name', 'n_args')} as path, n_ord as ord, {_lines("coalesce(n_text, '')", ['invoke', 'return'])} as content from joined where n_name is not null
  union all
  select apk_id, 'old', replace(class_java, '.', '/') || '/' || {_filename('o_name', 'o_args')}, o_ord, {_lines("coalesce(o_text, '')", ['invoke', 'return'])} from joined where o_name is not null)
select apk_id, root, path, length(content) as n_chars from f qualify row_number() over (partition by apk_id, root, path order by ord desc, content desc) = 1""",
    "package_method_counts": _WL + "select side, apk_id, pkg, cast(n_methods as bigint) as n_methods from counts",
    "method_features": f"with {_GRAPH} select * from feat",
    "package_edges": f"with {_GRAPH} select side, apk_id, pkg, caller_key, callee_key, count(*) as n from edge group by all",
    "neighborhoods": f"with {_GRAPH} select * from near",
    "wl_labels": _WL + "select side, apk_id, pkg, method_key, iter, label from labels",
    "wl_histograms": _WL + "select * from hist",
    "package_similarity": _WL + "select apk_id, old_package, new_package, score from scores",
    "best_candidate": _WL + "select * from best",
    "match_packages": _WL + f"select {_COLUMNS} from result",
    "match_node_consistency": _WL + f"select {_COLUMNS} from fine",
    "match_csv_lines": _WL + "select apk_id, old_label || ',' || new_label || ',' || score_label || ',' || status as line from shown",
    "match_table_lines": _WL + """
select apk_id, 0 as part, rpad('Package (old)', cast(old_label as int), ' ') || '  ' || rpad('Package (new)', cast(new_label as int), ' ') || '  ' || lpad('Score', cast(score_label as int), ' ') || '  ' || rpad('Status', cast(status as int), ' ') as line from widths
union all select apk_id, 1, repeat('-', cast(old_label + new_label + score_label + status + 6 as int)) from widths
union all select s.apk_id, 2, s.old_label || repeat(' ', w.old_label - strlen(s.old_label)) || '  ' || s.new_label || repeat(' ', w.new_label - strlen(s.new_label)) || '  '
  || repeat(' ', w.score_label - strlen(s.score_label)) || s.score_label || '  ' || s.status || repeat(' ', w.status - strlen(s.status)) from shown s join widths w using (apk_id)""",
    "match_detail_lines": _WL + f"""
select f.apk_id, case f.status when 'REMOVED' then '  ' || {_LABEL.format(c='f.old_package')} || '  (removed)' when 'NEW' then '  ' || {_LABEL.format(c='f.new_package')} || '  (added)'
  else '  ' || {_LABEL.format(c='f.old_package')} || '  <->  ' || {_LABEL.format(c='f.new_package')} || '  (methods ' || cast(coalesce(o.n_methods, 0) as bigint) || '->' || cast(coalesce(w.n_methods, 0) as bigint)
    || ' | score=' || case when score <= 0 then '---' else printf('%.2f', floor(score * 100 + 0.5) / 100) end || ')' end as line
from fine f left join counts o on o.side = 'old' and o.apk_id = f.apk_id and o.pkg = f.old_package left join counts w on w.side = 'new' and w.apk_id = f.apk_id and w.pkg = f.new_package""",
    "column_widths": _WL + "select * from widths",
    "permission_list": _PERMISSIONS + "select * from kept",
    "permission_added": _EDITED.format(a="new", b="old"),
    "permission_removed": _EDITED.format(a="old", b="new"),
    "line_filter": f"select doc_id, {_lines('text', LINES)} as kept from documents",
}
