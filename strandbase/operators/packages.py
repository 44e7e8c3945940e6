"""Package graphs: nodes with features, edges, neighbourhoods, Weisfeiler-Lehman labels and histograms.

All steps are keyed by (side, apk_id, pkg); a node is a method key, carried as its 64-bit hash within the package. Labels are
md5 texts, so that equality and order are the same wherever they are computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbase.functions.filters import is_branch, is_invoke
from strandbase.functions.names import external_kind, method_key, package_of
from strandbase.runtime import cut

PACKAGE = ["side", "apk_id", "pkg"]
NODE = [*PACKAGE, "node"]
#: The features of a node, in order.
FEATURES = [
    "in_degree", "out_degree", "ext_android", "ext_java", "ext_kotlin", "ext_other", "invoke_virtual", "invoke_static", "invoke_direct",
    "invoke_interface", "num_params", "num_instructions", "has_branches",
]


def package_method_counts(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(side, apk_id, pkg, n_methods) of every package that has a class, methods of repeated definitions counted."""
    own = classes.select("side", "apk_id", package_of(F.col("class_jni")).alias("pkg"), F.lit(0).alias("n"))
    defined = methods.select("side", "apk_id", package_of(F.col("class_jni")).alias("pkg"), F.lit(1).alias("n"))
    return own.union(defined).filter("pkg is not null").groupBy(*PACKAGE).agg(F.sum("n").cast("bigint").alias("n_methods"))


def _described(methods: DataFrame) -> DataFrame:
    """Counts over each method's ops without making rows of them: a short code for each op, then the codes counted (A3). This
    comes before any shuffle, so that bodies never travel."""
    key = method_key(F.col("class_jni"), F.col("name"), F.col("descriptor"))
    kinds = {"virtual": ("InvokeVirtual", "InvokeSuper"), "static": ("InvokeStatic",), "direct": ("InvokeDirect",), "interface": ("InvokeInterface",)}

    def told(x: Column) -> Column:
        """What is counted of an op, worked out once."""
        starts = lambda names: reduce(Column.__or__, (F.startswith(x["opcode"], F.lit(n)) for n in names))
        form = reduce(lambda rest, k: F.when(starts(kinds[k]), k).otherwise(rest), kinds, F.lit("none"))
        owner = x["callee_class"]
        place = F.when(package_of(owner) == F.col("pkg"), "own").otherwise(external_kind(owner))
        callee = method_key(owner, x["callee_name"], x["callee_desc"])
        invoked = F.when(is_invoke(x["opcode"]), F.struct(form.alias("form"), place.alias("place"), callee.alias("callee")))
        return F.struct(is_branch(x["opcode"]).alias("branch"), invoked.alias("invoked"))

    rows = methods.withColumn("pkg", package_of(F.col("class_jni"))).filter("pkg is not null")
    rows = rows.withColumn("told", F.transform(F.filter("ops", lambda x: x["kind"] == "Op"), told))
    rows = rows.withColumns({"method_key": key, "invoked": F.filter(F.transform("told", lambda x: x["invoked"]), lambda x: x.isNotNull())})
    some = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))  # noqa: E731 - the size of null is -1
    count = lambda field, *names: some(F.size(F.filter("invoked", lambda x: x[field].isin(*names))))
    return rows.select(
        *PACKAGE, "method_key", F.xxhash64("method_key").alias("node"), "dex_ord", "class_ord", "method_ord",
        F.transform(F.filter("invoked", lambda x: x["place"] == "own"), lambda x: F.xxhash64(x["callee"])).alias("calls"), some(F.size("invoked")).alias("out_degree"),
        count("place", "android", "androidx").alias("ext_android"), count("place", "java").alias("ext_java"), count("place", "kotlin").alias("ext_kotlin"), count("place", "other").alias("ext_other"),
        *(count("form", k).alias(f"invoke_{k}") for k in kinds),
        F.coalesce("n_param_entries", F.lit(0)).alias("num_params"), some(F.size("told")).alias("num_instructions"),
        F.coalesce(F.exists("told", lambda x: x["branch"]).cast("int"), F.lit(0)).alias("has_branches"),
    )


def _defined(described: DataFrame) -> DataFrame:
    """The last definition of every method key in its package."""
    last = Window.partitionBy(*PACKAGE, "method_key").orderBy(F.desc("dex_ord"), F.desc("class_ord"), F.desc("method_ord"))
    return described.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "dex_ord", "class_ord", "method_ord")


def package_graph(methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (side, apk_id, pkg, node, method_key, 13 features) and edges (side, apk_id, pkg, node, to), repeated calls kept;
    a call to a method the package doesn't define is no edge (G1, J4, A4)."""
    described = cut(_defined(_described(methods)), "described")
    calls = described.select(*PACKAGE, "node", F.explode("calls").alias("to"))
    targets = described.select(*PACKAGE, F.col("node").alias("to"))
    edges = cut(calls.join(targets, [*PACKAGE, "to"]).select(*NODE, "to"), "edges")
    degree = edges.groupBy(*PACKAGE, F.col("to").alias("node")).agg(F.count("*").cast("int").alias("in_degree"))
    nodes = described.join(degree, NODE, "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return nodes.select(*NODE, "method_key", *FEATURES), edges


def neighbourhoods(edges: DataFrame) -> DataFrame:
    """Distinct neighbours in either direction; a method that calls itself is its own neighbour."""
    both = F.array(F.struct(F.col("node"), F.col("to").alias("neighbour")), F.struct(F.col("to").alias("node"), F.col("node").alias("neighbour")))
    return edges.select(*PACKAGE, F.explode(both).alias("e")).select(*PACKAGE, "e.*").distinct()


def wl_labels(nodes: DataFrame, edges: DataFrame, iterations: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All labels (..., node, iter, label), those of the last iteration, and the neighbours they were made with."""
    near = cut(neighbourhoods(edges), "near")
    first = F.md5(F.concat_ws(",", *(F.col(c).cast("string") for c in FEATURES)))
    label = cut(nodes.select(*NODE, first.alias("label")), "labels")
    every = label.withColumn("iter", F.lit(0))
    for i in range(1, iterations + 1):
        seen = near.join(label.withColumnRenamed("node", "neighbour"), [*PACKAGE, "neighbour"])
        around = seen.groupBy(*NODE).agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("around"))
        joined = label.join(around, NODE, "left")  # a node without neighbours hashes its own label only
        label = cut(joined.select(*NODE, F.md5(F.concat("label", F.lit("|"), F.coalesce("around", F.lit("")))).alias("label")), "labels")
        every = every.unionByName(label.withColumn("iter", F.lit(i)))
    return every, label, near


def wl_histograms(labels: DataFrame) -> DataFrame:
    """A9."""
    return labels.groupBy(*PACKAGE, "iter", "label").agg(F.count("*").alias("cnt"))
