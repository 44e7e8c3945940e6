"""A program corpus projected from the star schema: orders are methods, line items their ops, customers their classes, nations
and market segments their packages. Unlike the method tables it has many calls inside packages, on two sides that differ.

Old side: without orders of key % 100 = 1 and nations of key % 5 = 3. New side: without % 100 = 0 and nation % 5 = 4; orders of
% 100 = 2 have constants for all ops; packages of nation % 5 = 0 are renamed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandbase.operators import diff, matching, packages
from strandbase.plans import structure
from strandbase.runtime import cut, table

#: What the projection makes of flags and suppliers.
OPCODES = {"NO": "InvokeVirtual", "NF": "InvokeStatic", "RO": "InvokeDirect", "RF": "InvokeInterface", "AO": "Const4", "AF": "IfEqz"}
BLOCK = 60_000
OUTSIDE = ["Landroid/app/A;", "Ljava/lang/B;", "Lkotlin/text/D;", "Lorg/other/E;"]


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Class and method tables."""
    t = lambda name: table(spark, sf_dir, name)
    who = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows by definition
    pkg = F.concat(F.lower("n_name"), F.lit("/"), F.lower("c_mktsegment"))
    orders = t("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "n_nationkey", pkg.alias("pkg"))
    # There are 125 packages whatever the scale; calls stay within a block of keys, so that no window grows with the data.
    by_block = Window.partitionBy("pkg", "block")
    blocks = orders.withColumn("block", F.floor(F.col("o_orderkey") / BLOCK))
    ranked = blocks.withColumn("at", F.row_number().over(by_block.orderBy("o_orderkey")) - 1).withColumn("size", F.count("*").over(by_block))
    ranked = cut(ranked, "ranked")
    place = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    flags = F.concat("l_returnflag", "l_linestatus")
    opcode = reduce(lambda c, x: F.when(flags == x[0], x[1]).otherwise(c), OPCODES.items(), F.lit("Nop"))
    lines = t("lineitem").select("l_orderkey", *place, opcode.alias("opcode"))
    lines = lines.join(ranked.select(F.col("o_orderkey").alias("l_orderkey"), "pkg", "block", "size"), "l_orderkey")
    targets = ranked.select("pkg", "block", "at", F.col("o_custkey").alias("to_cust"), F.col("o_orderkey").alias("to_order"))
    aimed = lines.withColumn("at", (F.col("l_partkey") % F.col("size")).cast("int")).join(targets, ["pkg", "block", "at"])
    inside = F.col("l_suppkey") % 2 == 0
    outside = F.element_at(F.array(*(F.lit(x) for x in OUTSIDE)), ((F.col("l_suppkey") / 2).cast("bigint") % 4 + 1).cast("int"))
    calls = F.startswith("opcode", F.lit("Invoke"))
    op = F.struct(*place, "opcode", F.when(calls & inside, F.col("to_cust")).alias("to_cust"), F.when(calls & inside, F.col("to_order")).alias("to_order"), F.when(calls & ~inside, outside).alias("outside"))
    bodies = aimed.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(op)).alias("raw"))
    full = ranked.join(bodies, "o_orderkey", "left")

    def side(name: str, gone: int, nation: int) -> DataFrame:
        new = name == "new"
        prefix = F.when(F.lit(new) & (F.col("n_nationkey") % 5 == 0), "renamed/").otherwise("")
        own = F.concat(prefix, "pkg")
        flat = F.lit(new) & (F.col("o_orderkey") % 100 == 2)

        def body(x, i):
            local = x["to_cust"].isNotNull()
            text = F.lit(None).cast("string")
            owner = F.when(local, F.concat(F.lit("L"), prefix, F.col("pkg"), F.lit("/C"), x["to_cust"].cast("string"), F.lit(";"))).otherwise(x["outside"])
            called = F.when(local, F.concat(F.lit("m"), x["to_order"].cast("string"))).when(x["outside"].isNotNull(), "x")
            return F.struct(
                i.cast("int").alias("ord"), F.lit("Op").alias("kind"), F.when(flat, "Const4").otherwise(x["opcode"]).alias("opcode"), F.when(flat, text).otherwise(owner).alias("callee_class"),
                F.when(flat, text).otherwise(called).alias("callee_name"), F.when(~flat & called.isNotNull(), "()V").alias("callee_desc"),
            )

        rows = full.filter((F.col("o_orderkey") % 100 != gone) & (F.col("n_nationkey") % 5 != nation))
        jni = F.concat(F.lit("L"), own, F.lit("/C"), F.col("o_custkey").cast("string"), F.lit(";"))
        return rows.select(
            F.lit(name).alias("side"), F.lit("star").alias("apk_id"), F.lit(0).alias("dex_ord"), F.col("o_custkey").cast("int").alias("class_ord"), F.col("o_orderkey").cast("int").alias("method_ord"),
            jni.alias("class_jni"), F.replace(F.substring(jni, F.lit(2), F.length(jni) - 2), F.lit("/"), F.lit(".")).alias("class_java"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("name"),
            F.lit("()V").alias("descriptor"), F.array().cast("array<string>").alias("arg_types"), F.lit("void").alias("ret_type"), F.lit(0).alias("n_param_entries"), F.transform("raw", body).alias("ops"),
        )

    methods = cut(side("old", 1, 3).unionByName(side("new", 0, 4)), "star_methods")
    return methods.select("side", "apk_id", "dex_ord", "class_ord", "class_jni", "class_java").distinct(), methods


def star_call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = packages.package_graph(corpus(spark, sf_dir)[1])
    n = nodes.groupBy(*packages.PACKAGE).agg(F.count("*").alias("n_nodes"), *(F.sum(c).cast("bigint").alias(c) for c in packages.FEATURES))
    e = edges.groupBy(*packages.PACKAGE).agg(F.count("*").alias("n_edges"))
    return n.join(e, packages.PACKAGE, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def star_package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = packages.package_graph(corpus(spark, sf_dir)[1])
    key = lambda n, k: nodes.select(*packages.PACKAGE, F.col("node").alias(n), F.col("method_key").alias(k))
    counted = edges.groupBy(*packages.NODE, "to").agg(F.count("*").alias("n"))
    return counted.join(key("node", "caller_key"), packages.NODE).join(key("to", "callee_key"), [*packages.PACKAGE, "to"]).select(*packages.PACKAGE, "caller_key", "callee_key", "n")


def star_neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = packages.package_graph(corpus(spark, sf_dir)[1])
    key = lambda n, k: nodes.select(*packages.PACKAGE, F.col("node").alias(n), F.col("method_key").alias(k))
    near = packages.neighbourhoods(edges).join(key("node", "method_key"), packages.NODE).join(key("neighbour", "neighbour_key"), [*packages.PACKAGE, "neighbour"])
    return near.select(*packages.PACKAGE, "method_key", "neighbour_key")


def star_wl_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = packages.package_graph(corpus(spark, sf_dir)[1])
    every, _, _ = packages.wl_labels(nodes, edges, structure.ITERATIONS)
    return every.join(nodes.select(*packages.NODE, "method_key"), packages.NODE).select(*packages.PACKAGE, "method_key", "iter", "label")


def star_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_packages(*corpus(spark, sf_dir), 0.6, 0.2, structure.ITERATIONS, False)[0].select(structure._RESULT)


def star_match_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_packages(*corpus(spark, sf_dir), 0.6, 0.2, structure.ITERATIONS, True)[0].select(structure._RESULT)


def star_method_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.method_diff(*corpus(spark, sf_dir))


QUERIES = {f.__name__: f for f in (star_call_summary, star_package_edges, star_neighborhoods, star_wl_labels, star_match, star_match_consistency, star_method_diff)}


def _corpus_sql() -> str:
    opcode = "case l_returnflag || l_linestatus " + " ".join(f"when '{k}' then '{v}'" for k, v in OPCODES.items()) + " else 'Nop' end"
    outside = "[" + ", ".join(f"'{x}'" for x in OUTSIDE) + "]"

    def side(name: str, gone: int, nation: int) -> str:
        prefix = "case when n_nationkey % 5 = 0 then 'renamed/' else '' end" if name == "new" else "''"
        flat = "o_orderkey % 100 = 2" if name == "new" else "false"
        jni = f"'L' || {prefix} || pkg || '/C' || o_custkey || ';'"
        return f"""
  select '{name}' as side, 'star' as apk_id, 0 as dex_ord, cast(o_custkey as int) as class_ord, cast(o_orderkey as int) as method_ord, {jni} as class_jni,
    replace({prefix} || pkg || '/C' || o_custkey, '/', '.') as class_java, 'm' || o_orderkey as name, '()V' as descriptor, cast([] as varchar[]) as arg_types, 'void' as ret_type,
    0 as n_param_entries, cast(null as varchar) as smali_text,
    list_transform(raw, lambda x: {{'ord': cast(x.i as int), 'kind': 'Op', 'opcode': case when {flat} then 'Const4' else x.opcode end,
      'callee_class': case when {flat} then null when x.to_order is not null then 'L' || {prefix} || pkg || '/C' || x.to_cust || ';' else x.outside end,
      'callee_name': case when {flat} then null when x.to_order is not null then 'm' || x.to_order when x.outside is not null then 'x' end,
      'callee_desc': case when {flat} then null when x.to_order is not null or x.outside is not null then '()V' end}}) as ops
  from star_full where o_orderkey % 100 <> {gone} and n_nationkey % 5 <> {nation}"""

    return f"""
star_ranked as (
  select *, row_number() over (partition by pkg, block order by o_orderkey) - 1 as place, count(*) over (partition by pkg, block) as size from (
    select o_orderkey, o_custkey, n_nationkey, lower(n_name) || '/' || lower(c_mktsegment) as pkg, o_orderkey // {BLOCK} as block
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)),
star_lines as (
  select l.*, {opcode} as opcode, t.o_custkey as t_cust, t.o_orderkey as t_order,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, {opcode}) - 1 as i
  from lineitem l join star_ranked r on r.o_orderkey = l_orderkey join star_ranked t on t.pkg = r.pkg and t.block = r.block and t.place = l_partkey % r.size),
star_bodies as (
  select l_orderkey as o_orderkey, list({{'i': i, 'opcode': opcode, 'to_cust': case when starts_with(opcode, 'Invoke') and l_suppkey % 2 = 0 then t_cust end,
    'to_order': case when starts_with(opcode, 'Invoke') and l_suppkey % 2 = 0 then t_order end,
    'outside': case when starts_with(opcode, 'Invoke') and l_suppkey % 2 = 1 then {outside}[(l_suppkey // 2) % 4 + 1] end}} order by i) as raw
  from star_lines group by 1),
star_full as (select * from star_ranked left join star_bodies using (o_orderkey)),
smali_method as ({side('old', 1, 3)} union all {side('new', 0, 4)}),
dex_class as (select distinct side, apk_id, dex_ord, class_ord, class_jni, class_java from smali_method)
"""


def _over_corpus(sql: str) -> str:
    """A query over the method tables, with the projected corpus in their place."""
    return "with " + _corpus_sql() + ", " + sql.strip().removeprefix("with ")


ORACLE = {
    "star_call_summary": _over_corpus(
        "with " + structure._GRAPH + "select n.*, coalesce(e.n_edges, 0) as n_edges from (select side, apk_id, pkg, count(*) as n_nodes, "
        + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in packages.FEATURES)
        + " from feat group by 1, 2, 3) n left join (select side, apk_id, pkg, count(*) as n_edges from edge group by 1, 2, 3) e using (side, apk_id, pkg)"
    ),
    "star_package_edges": _over_corpus(structure.ORACLE["package_edges"]),
    "star_neighborhoods": _over_corpus(structure.ORACLE["neighborhoods"]),
    "star_wl_labels": _over_corpus(structure.ORACLE["wl_labels"]),
    "star_match": _over_corpus(structure.ORACLE["match_packages"]),
    "star_match_consistency": _over_corpus(structure.ORACLE["match_node_consistency"]),
    "star_method_diff": _over_corpus(structure.ORACLE["method_diff"]),
}
