"""Call edges and the call graph's text.

An edge is the union over all overloads that share a label; a method without calls has no edge. Null ops lists have no
edges; repeated calls count once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbase.functions.filters import class_filter, is_invoke
from strandbase.functions.names import call_label, jni_class_to_java
from strandbase.runtime import op_fields


def invocations(methods: DataFrame, *keep: str) -> DataFrame:
    """(keep..., class_java, name, callee_class, callee_name) of every invoke op. The ops are filtered inside the array, before
    they become rows, and only the three fields needed are read."""
    needed = op_fields(F.col("ops"), "opcode", "callee_class", "callee_name")
    calls = F.filter(needed, lambda x: is_invoke(x["opcode"]) & x["callee_class"].isNotNull())
    return methods.select(*keep, "class_java", "name", F.explode(calls).alias("op")).select(*keep, "class_java", "name", "op.callee_class", "op.callee_name")


def call_edges(methods: DataFrame, class_filters: Iterable[str] | None = None, *keep: str) -> DataFrame:
    """Distinct (keep..., caller, callee); the filters look at the caller's class only."""
    wanted = methods.filter(class_filter(F.col("class_java"), class_filters))
    calls = invocations(wanted, *keep)
    caller = call_label(F.col("class_java"), F.col("name"))
    callee = call_label(jni_class_to_java(F.col("callee_class")), F.col("callee_name"))
    return calls.select(*keep, caller.alias("caller"), callee.alias("callee")).distinct()


def callees_per_caller(edges: DataFrame) -> DataFrame:
    """(caller, callees): the sorted callees of each caller (O1). A caller's callees are bounded by its code."""
    return edges.groupBy("caller").agg(F.sort_array(F.collect_set("callee")).alias("callees"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line) of the graph in DOT form, in order: by caller, then callee (K1). Nothing is escaped."""
    line = F.concat(F.lit('"'), F.col("caller"), F.lit('" -> "'), F.col("callee"), F.lit('"; '))
    spark = edges.sparkSession
    ends = spark.createDataFrame([(0, "digraph {"), (2, "}")], "part int, line string").select("part", F.lit("").alias("caller"), F.lit("").alias("callee"), "line")
    body = edges.select(F.lit(1).alias("part"), "caller", "callee", line.alias("line"))
    return body.unionByName(ends).orderBy("part", "caller", "callee").select("line")
