"""Permissions of a manifest, and their differences between the old and the new side of an application.

The list takes every attribute's raw value of each uses-permission element, in document order, repeated ones kept. A manifest
that couldn't be read on either side gives an empty difference for its application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def permission_entries(elements: DataFrame) -> DataFrame:
    """(apk_id, side, pos, permission) from manifest elements, ``pos`` giving document order."""
    rows = elements.filter("tag = 'uses-permission'").select("apk_id", "side", "element_id", F.posexplode("attrs").alias("at", "attr"))
    return rows.filter("attr.raw_value is not null").select("apk_id", "side", F.struct("element_id", "at").alias("pos"), F.col("attr.raw_value").alias("permission"))


def permission_diff(entries: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """(apk_id, edit, pos, permission): entries of the old side missing on the new are DELETED, the other way round ADDED; a
    repeated entry is given each time (J6, U4). ``readable`` has the (apk_id, side) of manifests that could be read; without
    it every side counts as read."""
    old, new = entries.filter("side = 'old'").drop("side"), entries.filter("side = 'new'").drop("side")
    if readable is not None:
        both = readable.select("apk_id", "side").distinct().groupBy("apk_id").agg(F.count("*").alias("n")).filter("n = 2").select("apk_id")
        old, new = old.join(both, "apk_id", "left_semi"), new.join(both, "apk_id", "left_semi")
    key = ["apk_id", "permission"]
    gone = old.join(new.select(*key).distinct(), key, "left_anti").withColumn("edit", F.lit("DELETED"))
    came = new.join(old.select(*key).distinct(), key, "left_anti").withColumn("edit", F.lit("ADDED"))
    return gone.unionByName(came).select("apk_id", "edit", "pos", "permission")


def permission_lines(diff: DataFrame) -> DataFrame:
    """(apk_id, line) with deleted entries first, each part in document order."""
    line = F.concat(F.col("edit"), F.lit(": "), F.col("permission"))
    return diff.orderBy("apk_id", F.desc("edit"), "pos").select("apk_id", line.alias("line"))
