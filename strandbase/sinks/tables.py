"""Match results as lines, and writers of ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbase.functions.names import package_label, score_text
from strandbase.operators.matching import result_order

#: Headings.
CSV_HEAD = "old_package,new_package,score,status"
HEADINGS = {"old_label": "Package (old)", "new_label": "Package (new)", "score_label": "Score", "status": "Status"}


def labelled(results: DataFrame) -> DataFrame:
    return results.withColumns({"old_label": package_label(F.col("old_package")), "new_label": package_label(F.col("new_package")), "score_label": score_text(F.col("score"))})


def csv_lines(results: DataFrame) -> DataFrame:
    """(apk_id, line) in result order, without heading; nothing is quoted (K4)."""
    return labelled(results).orderBy(*result_order()).select("apk_id", F.concat_ws(",", "old_label", "new_label", "score_label", "status").alias("line"))


def column_widths(results: DataFrame) -> DataFrame:
    """One row for each application: the widest value of each column in bytes, at least its heading."""
    wide = [F.greatest(F.max(F.octet_length(c)), F.lit(len(h))).cast("bigint").alias(c) for c, h in HEADINGS.items()]
    return labelled(results).groupBy("apk_id").agg(*wide)


def table_lines(results: DataFrame) -> DataFrame:
    """(apk_id, part, line): heading, rule and rows of each application's table in order (K5). Widths are in bytes."""
    widths = column_widths(results).select("apk_id", *(F.col(c).alias(f"w_{c}") for c in HEADINGS))
    pad = lambda c, w: F.repeat(F.lit(" "), F.greatest(F.lit(0), F.col(w) - F.octet_length(c)).cast("int"))

    def line(value: dict):
        cells = [F.concat(pad(v, f"w_{c}"), v) if c == "score_label" else F.concat(v, pad(v, f"w_{c}")) for c, v in value.items()]
        return F.concat_ws("  ", *cells)

    head = widths.select("apk_id", F.lit(0).alias("part"), line({c: F.lit(h) for c, h in HEADINGS.items()}).alias("line"))
    total = sum((F.col(f"w_{c}") for c in HEADINGS), F.lit(2 * (len(HEADINGS) - 1)))
    rule = widths.select("apk_id", F.lit(1).alias("part"), F.repeat(F.lit("-"), total.cast("int")).alias("line"))
    rows = labelled(results).join(widths, "apk_id")
    place = ["section", "sort_score", "old_package", "new_package"]
    body = rows.select("apk_id", F.lit(2).alias("part"), line({c: F.col(c) for c in HEADINGS}).alias("line"), *place)
    top = head.union(rule)
    for c, kind in (("section", "int"), ("sort_score", "double"), ("old_package", "string"), ("new_package", "string")):
        top = top.withColumn(c, F.lit(None).cast(kind))
    return top.unionByName(body).orderBy("apk_id", "part", *result_order()[1:]).select("apk_id", "part", "line")


def detail_lines(results: DataFrame, counts: DataFrame) -> DataFrame:
    """(apk_id, line) with the methods of both packages."""
    side = lambda s, p, n: counts.filter(F.col("side") == s).select("apk_id", F.col("pkg").alias(p), F.col("n_methods").alias(n))
    rows = labelled(results).join(side("old", "old_package", "old_n"), ["apk_id", "old_package"], "left").join(side("new", "new_package", "new_n"), ["apk_id", "new_package"], "left")
    pair = F.format_string("  %s  <->  %s  (methods %d->%d | score=%s)", "old_label", "new_label", F.coalesce("old_n", F.lit(0)), F.coalesce("new_n", F.lit(0)), "score_label")
    line = F.when(F.col("status") == "REMOVED", F.concat(F.lit("  "), F.col("old_label"), F.lit("  (removed)"))).when(F.col("status") == "NEW", F.concat(F.lit("  "), F.col("new_label"), F.lit("  (added)"))).otherwise(pair)
    return rows.orderBy(*result_order()).select("apk_id", line.alias("line"))


def write_lines(lines: DataFrame, path: str, single: bool = False) -> None:
    """Writes the ``line`` column as text in the order of the rows: part files in order, or one file."""
    out = lines.select("line")
    (out.coalesce(1) if single else out).write.text(path)
