"""Problem 2: what was added, removed or changed between consecutive full snapshots, by Merkle trees over key ranges.

1. Each snapshot is reduced to one (record, content digest) row: the latest delivery holds, found by a hash aggregate.
2. Keys are hashed into ranges; a leaf of the tree covers one range and digests its rows, a parent the digests of its 16
   children. The number of leaves follows the data (about ``rows_per_leaf`` rows each), so the trees are a small fraction
   of the rows; key hashes spread evenly, so no leaf is hot.
3. The trees of two consecutive snapshots are compared from the root down; only children of differing nodes are looked at.
4. Rows are read and compared only within the differing leaves, in one aggregate over both sides.

Digests have 64 bits: two different contents of a record, or of a range, are taken as equal with a chance of 2^-64.

Defined cases: snapshot numbers may have gaps, "before" is the one delivered before; the first snapshot gives no edits;
of several rows of a record in one snapshot the latest ``loaded_at`` holds (null counts as the epoch; ties: the larger digest);
rows without a snapshot number are left out; null key parts are values of their own; null lists equal empty ones; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbase.runtime import cut, op_kinds, trimmed

FANOUT_BITS = 4


def op_sequence_digest(ops: Column) -> Column:
    """Digest of the sequence of opcodes (kind where null) in ``ord`` order; operands don't count."""
    return F.xxhash64(F.lit(0), F.coalesce(op_kinds(ops), F.array().cast("array<string>")))


def set_digest(values: Column) -> Column:
    """Digest of the set of entries without surrounding white space, blanks and nulls."""
    clean = F.filter(F.transform(values, trimmed), lambda x: x.isNotNull() & (x != ""))
    return F.xxhash64(F.lit(1), F.coalesce(F.sort_array(F.array_distinct(clean)), F.array().cast("array<string>")))


def _latest(df: DataFrame, snap: str, keys: list[str], digest: Column, order: str) -> DataFrame:
    """One digest for each snapshot and record. Time and digest are packed into one decimal so that the maximum is kept by
    a hash aggregate with partial results, not by sorting lists."""
    at = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(0)).cast("decimal(18,0)")
    unsigned = digest.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
    packed = (at.cast("decimal(38,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") + unsigned).cast("decimal(38,0)")
    rows = df.filter(F.col(snap).isNotNull()).select(F.col(snap).alias("snap"), *keys, packed.alias("packed"))
    return rows.groupBy("snap", *keys).agg(F.max("packed").alias("packed"))


def _level(below: DataFrame, shift: int) -> DataFrame:
    """The parents of a level: each digests its children in order."""
    children = F.xxhash64(F.sort_array(F.collect_list(F.struct("node", "digest"))))
    return below.groupBy("pair", "side", F.shiftright("node", shift).alias("node")).agg(children.alias("digest"))


def _differing(level: DataFrame, within: DataFrame | None) -> DataFrame:
    """The nodes whose digests differ between both sides, or that only one side has."""
    if within is not None:
        level = level.withColumn("up", F.shiftright("node", FANOUT_BITS)).join(within.withColumnRenamed("node", "up"), ["pair", "up"], "left_semi")
    sides = level.groupBy("pair", "node").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("n"))
    return sides.filter("n < 2 or lo <> hi").select("pair", "node")


def snapshot_edits(df: DataFrame, snap: str, keys: list[str], digest: Column, order: str = "loaded_at", rows_per_leaf: int = 8) -> DataFrame:
    """(snap, keys..., edit) with edit ADDED, REMOVED or CHANGED for every record that differs from the snapshot before."""
    spark = df.sparkSession
    latest = _latest(df, snap, keys, digest, order).withColumn("hash", F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys)))
    rows = cut(latest, "latest")
    per_snap = {x["snap"]: x["n"] for x in rows.groupBy("snap").agg(F.count("*").alias("n")).collect()}  # one row for each snapshot
    order_of = sorted(per_snap)
    depth = max(1, math.ceil(math.log(max(per_snap.values(), default=1) / rows_per_leaf + 1, 1 << FANOUT_BITS)))
    shift = 64 - FANOUT_BITS * depth
    leaf = F.shiftrightunsigned("hash", shift)
    # Pair i compares snapshot i - 1 (side 0) with snapshot i (side 1), so an inner snapshot takes part in two pairs.
    if len(order_of) < 2:
        return rows.select(F.col("snap").alias(snap), *keys, F.lit("").alias("edit")).limit(0)
    roles = spark.createDataFrame([(i, side, s) for i in range(1, len(order_of)) for side, s in ((0, order_of[i - 1]), (1, order_of[i]))], f"pair int, side int, snap {rows.schema['snap'].dataType.simpleString()}")
    content = F.pmod(F.col("packed"), F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")
    row_hash = F.xxhash64("hash", content)
    by_leaf = rows.groupBy("snap", leaf.alias("node")).agg(F.xxhash64(F.sum(row_hash.cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.lit(3), "hash", content)), F.count("*")).alias("digest"))
    leaves = cut(by_leaf.join(F.broadcast(roles), "snap").select("pair", "side", "node", "digest"), "leaves")  # roles: two rows a snapshot
    tree = [leaves]
    for _ in range(depth - 1):
        tree.append(_level(tree[-1], FANOUT_BITS))
    differing = None
    for level in reversed(tree):
        differing = _differing(level, differing)
    # The few differing leaves select the rows to compare.
    wanted = differing.join(F.broadcast(roles), "pair").select("pair", "side", "snap", "node")
    near = rows.withColumn("node", leaf).join(wanted, ["snap", "node"]).select("pair", "side", *keys, content.alias("content"))
    old, new = (F.max(F.when(F.col("side") == i, F.col("content"))) for i in (0, 1))
    both = near.groupBy("pair", *keys).agg(old.alias("old"), new.alias("new"))
    edit = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "CHANGED")
    at = F.element_at(F.array(*(F.lit(s) for s in order_of)), F.col("pair") + 1)
    return both.withColumn("edit", edit).filter("edit is not null").select(at.alias(snap), *keys, "edit")


def method_edits(df: DataFrame) -> DataFrame:
    return snapshot_edits(df, "snap_no", ["apk_id", "signature"], op_sequence_digest(F.col("ops")))


def manifest_edits(df: DataFrame) -> DataFrame:
    return snapshot_edits(df, "snap_no", ["apk_id", "package_name"], set_digest(F.col("uses_permissions")))
