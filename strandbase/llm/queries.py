"""The queries of the problems tagged llm, over the whole tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbase.llm import abuse, groups, heavy_hitters, near_duplicates, packing, shared_spans, terms, tokens, vectors
from strandbase.runtime import op_ids, table, trimmed

TIED = ("MATCH", "CHANGED")


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "manifest_summary")
    lists = {"uses_permissions": F.col("uses_permissions"), "uses_features": F.transform("uses_features", lambda x: x["name"])}
    return terms.marked_terms(*terms.term_frequencies(df, "summary_id", lists, "loaded_at"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")


def p1_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir).select("field", "term", "n_total", "n_records", "mark")


def _p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters.frequent_values(table(spark, sf_dir, "call_edge"), F.col("callee"), 0.0025)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir).select(F.col("value").alias("callee"))


def p3_frequent_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir).select(F.col("value").alias("callee"), "n_approx", "n_exact", "share")


def p3_exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir).select(F.col("value").alias("callee"), "n_exact")


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "package_node"), "vec_id", "features", 13, 5)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.unordered_pairs(_p4(spark, sf_dir))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir).select(F.col("id").alias("vec_id"), "rank", "neighbour", "distance")


def _p5(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "smali_method")
    return near_duplicates.similar_contents(df, "method_id", F.col("name"), op_ids(F.col("ops")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.expanded_pairs(*_p5(spark, sf_dir)).select("id_a", "id_b")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each method that takes part: its content class and the number of other classes it is linked to."""
    links, members = _p5(spark, sf_dir)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    joined = members.join(ends, "rep", "left")
    return joined.select(F.col("id").alias("method_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "match_result")
    vertices = df.select(F.explode(F.array("old_pkg_id", "new_pkg_id")).alias("pkg_id"))
    accepted = df.filter(F.upper(trimmed(F.col("status"))).isin(*TIED))
    return groups.group_ids(accepted, "old_pkg_id", "new_pkg_id", vertices, "pkg_id")


def _p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "smali_method"), "method_id", op_ids(F.col("ops")), 16)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir).select(F.col("id").alias("method_id"), "from_pos", "to_pos")


def p7_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every method the number of its ops, of the shared ones, and their share (0 without ops)."""
    spans = _p7(spark, sf_dir).groupBy("id").agg(F.sum(F.col("to_pos") - F.col("from_pos") + 1).alias("n_shared"))
    n_ops = F.greatest(F.size(F.filter("ops", lambda x: x.isNotNull())), F.lit(0))
    methods = table(spark, sf_dir, "smali_method").select("method_id", n_ops.cast("bigint").alias("n_ops"))
    n_shared = F.coalesce("n_shared", F.lit(0))
    share = F.when(F.col("n_ops") > 0, n_shared / F.col("n_ops")).otherwise(0.0)
    return methods.join(spans, methods["method_id"] == spans["id"], "left").select("method_id", "n_ops", n_shared.alias("n_shared"), share.alias("share"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tokens.token_ids(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return made.select(F.col("key").alias("doc_id"), "ids")


def _p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return packing.pack(sizes, F.col("key"), F.col("n_tokens"), 2048)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p9(spark, sf_dir).filter("n_tokens > 2048 and part_no = 0").select(F.col("key").alias("doc_id"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p9(spark, sf_dir).select(F.col("key").alias("doc_id"), "part_no", "start", "length", "container")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled: tokens, containers, the least number that could hold them, and the share filled."""
    held = _p9(spark, sf_dir).filter("container is not null")
    n = held.agg(F.sum("length").alias("n_tokens"), F.count_distinct("container").alias("n_containers"))
    return n.select(F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "n_containers", F.coalesce(F.ceil(F.col("n_tokens") / 2048), F.lit(0)).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * 2048)).alias("fill"))


def _p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, sf_dir, "documents"), ["doc_id", "source"], F.col("text"), table(spark, sf_dir, "abuse_sample"), translation=F.col("tgt_text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p10(spark, sf_dir).filter("flagged").select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p10(spark, sf_dir).select("doc_id", "score", "flagged")


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = F.sum(F.col("flagged").cast("bigint"))
    return _p10(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), flagged.alias("n_flagged"), (flagged / F.count("*")).alias("rate"))


QUERIES = {f.__name__: f for f in (p1_found, p1_term_counts, p3_found, p3_frequent_callees, p3_exact_counts, p4_found, p4_nearest, p5_found, p5_classes, p6_found, p7_found, p7_shared_share, p8_ids, p9_found, p9_containers, p9_fill, p10_found, p10_scores, p10_source_rates)}
