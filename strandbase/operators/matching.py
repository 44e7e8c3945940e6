"""Which package of the new side corresponds to each of the old side, by Weisfeiler-Lehman histogram similarity.

Packages that share no label have similarity 0 and can't match, so all-pairs scoring is one equi-join on label and iteration.
Every old package tries its single best new package; the best of its suitors gets it, the others are removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandbase.operators.packages import NODE, PACKAGE, package_graph, package_method_counts, wl_histograms, wl_labels
from strandbase.runtime import cut

NOTHING = "---"


def package_similarity(histograms: DataFrame, sizes: DataFrame, iterations: int) -> DataFrame:
    """(apk_id, old_package, new_package, score) of all pairs that share a label."""
    side = lambda s, p, c: histograms.filter(F.col("side") == s).select("apk_id", "iter", "label", F.col("pkg").alias(p), F.col("cnt").alias(c))
    pairs = side("old", "old_package", "co").join(side("new", "new_package", "cn"), ["apk_id", "iter", "label"])
    cross = pairs.groupBy("apk_id", "old_package", "new_package").agg(F.sum(F.least("co", "cn")).alias("shared"))
    size = lambda s, p, n: sizes.filter(F.col("side") == s).select("apk_id", F.col("pkg").alias(p), F.col("n_nodes").alias(n))
    sized = cross.join(size("old", "old_package", "no"), ["apk_id", "old_package"]).join(size("new", "new_package", "nn"), ["apk_id", "new_package"])
    whole = lambda n: (F.col(n) * (iterations + 1)).cast("double")  # noqa: E731 - every node has a label in each iteration
    return sized.select("apk_id", "old_package", "new_package", (F.col("shared") / F.sqrt(whole("no") * whole("nn"))).alias("score"))


def best_candidates(scores: DataFrame) -> DataFrame:
    """The best new package of each old one, ties to the smallest name."""
    w = Window.partitionBy("apk_id", "old_package").orderBy(F.desc("score"), "new_package")
    return scores.filter("score > 0").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def label_consistency(labels: DataFrame, near: DataFrame, pairs: DataFrame, mode: str = "positional") -> DataFrame:
    """(apk_id, old_package, new_package, consistency) for each pair: the share of equal (label, neighbour labels) entries
    when both packages' entries are sorted and laid side by side (G7). ``multiset`` counts equal entries wherever they are."""
    seen = near.join(labels.withColumnRenamed("node", "neighbour"), [*PACKAGE, "neighbour"])
    around = seen.groupBy(*NODE).agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("around"))
    entry = labels.join(around, NODE, "left").select(*PACKAGE, "label", F.coalesce("around", F.lit("")).alias("around"))
    if mode == "positional":
        entry = entry.withColumn("at", F.row_number().over(Window.partitionBy(*PACKAGE).orderBy("label", "around")))
        by = ["label", "around", "at"]
    else:
        entry = entry.withColumn("at", F.row_number().over(Window.partitionBy(*PACKAGE, "label", "around").orderBy(F.lit(0))))
        by = ["label", "around", "at"]
    n = entry.groupBy(*PACKAGE).agg(F.count("*").alias("n"))
    side = lambda df, s, p: df.filter(F.col("side") == s).drop("side").withColumnRenamed("pkg", p)
    old = pairs.join(side(entry, "old", "old_package"), ["apk_id", "old_package"])
    equal = old.join(side(entry, "new", "new_package"), ["apk_id", "new_package", *by]).groupBy("apk_id", "old_package", "new_package").agg(F.count("*").alias("equal"))
    sized = pairs.join(side(n, "old", "old_package").withColumnRenamed("n", "no"), ["apk_id", "old_package"]).join(side(n, "new", "new_package").withColumnRenamed("n", "nn"), ["apk_id", "new_package"])
    joined = sized.join(equal, ["apk_id", "old_package", "new_package"], "left")
    return joined.select("apk_id", "old_package", "new_package", (F.coalesce("equal", F.lit(0)) / F.greatest("no", "nn")).alias("consistency"))


def assign_packages(scores: DataFrame, counts: DataFrame, sizes: DataFrame, threshold: float, change_threshold: float) -> DataFrame:
    """(apk_id, section, sort_score, old_package, new_package, score, status); section and sort_score give the order."""
    best = best_candidates(scores)
    suitors = Window.partitionBy("apk_id", "new_package").orderBy(F.desc("score"), "old_package")
    chosen = best.withColumn("n", F.row_number().over(suitors)).withColumn("won", (F.col("n") == 1) & (F.col("score") >= change_threshold))
    graphs = sizes.select(*PACKAGE)
    old = graphs.filter("side = 'old'").select("apk_id", F.col("pkg").alias("old_package")).join(chosen, ["apk_id", "old_package"], "left")
    won = F.coalesce("won", F.lit(False))
    status = F.when(~won, "REMOVED").when(F.col("score") >= threshold, "MATCH").otherwise("CHANGED")
    first = old.select(
        "apk_id", F.lit(0).alias("section"), F.coalesce("score", F.lit(0.0)).alias("sort_score"), "old_package",
        F.when(won, F.col("new_package")).otherwise(NOTHING).alias("new_package"), F.when(won, F.col("score")).otherwise(0.0).alias("score"), status.alias("status"),
    )
    taken = chosen.filter("won").select("apk_id", F.col("new_package").alias("pkg"))
    left_over = graphs.filter("side = 'new'").join(taken, ["apk_id", "pkg"], "left_anti")
    bare = counts.join(graphs, PACKAGE, "left_anti")
    alone = lambda df, section, side: df.filter(F.col("side") == side).select(
        "apk_id", F.lit(section).alias("section"), F.lit(0.0).alias("sort_score"), (F.col("pkg") if side == "old" else F.lit(NOTHING)).alias("old_package"),
        (F.col("pkg") if side == "new" else F.lit(NOTHING)).alias("new_package"), F.lit(0.0).alias("score"), F.lit("REMOVED" if side == "old" else "NEW").alias("status"),
    )
    return reduce(DataFrame.unionByName, [first, alone(left_over, 1, "new"), alone(bare, 2, "old"), alone(bare, 3, "new")])


def refined(rows: DataFrame, consistency: DataFrame, threshold: float, change_threshold: float) -> DataFrame:
    """Scores of matched rows times their consistency; a row may fall to CHANGED or REMOVED but keeps its partner."""
    joined = rows.join(consistency, ["apk_id", "old_package", "new_package"], "left")
    score = F.col("score") * F.coalesce("consistency", F.lit(1.0))
    matched = F.col("status").isin("MATCH", "CHANGED")
    status = F.when(matched & (score < change_threshold), "REMOVED").when(matched & (score < threshold), "CHANGED").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "score": F.when(matched, score).otherwise(F.col("score"))}).select(rows.columns)


def match_packages(
    classes: DataFrame, methods: DataFrame, threshold: float = 0.8, change_threshold: float = 0.0, wl_iterations: int = 3, node_matching: bool = False, consistency_mode: str = "positional"
) -> tuple[DataFrame, DataFrame]:
    """The assignment for every application and the methods of each package."""
    counts = package_method_counts(classes, methods)
    nodes, edges = package_graph(methods)
    every, last, near = wl_labels(nodes, edges, wl_iterations)
    sizes = cut(last.groupBy(*PACKAGE).agg(F.count("*").alias("n_nodes")), "sizes")
    scores = package_similarity(wl_histograms(every), sizes, wl_iterations)
    rows = assign_packages(scores, counts, sizes, threshold, change_threshold)
    if node_matching:
        rows = cut(rows, "assigned")
        pairs = rows.filter(F.col("status").isin("MATCH", "CHANGED")).select("apk_id", "old_package", "new_package")
        rows = refined(rows, label_consistency(last, near, pairs, consistency_mode), threshold, change_threshold)
    return rows, counts


def result_order() -> list:
    """Old packages by score, then new ones, then those without a graph (O3)."""
    return [F.col("apk_id"), F.col("section"), F.desc("sort_score"), F.col("old_package"), F.col("new_package")]
