"""Problem 3: the most frequent values of a column, in memory that does not grow with its distinct values.

Every value is hashed to 32 bits. For the prefixes of 8, 16, 24 and 32 bits each task keeps a count sketch of ``depth``
rows of ``width`` signed counters (four sketches of fixed size, whatever the data); the sketches are summed cell by cell.
Descending from the 8-bit prefixes, only those whose estimate (median over the rows) reaches ``slack`` times the limit are
followed, so at most 1 / (slack * share) prefixes survive a level up to sketch error. A second scan keeps the rows whose hash
survived and counts their values exactly, which removes hash collisions and sketch errors.

Defined cases: null values are left out and don't count towards the total; repeated rows all count; an empty column gives
no rows; values of any length are hashed, never stored in the sketch. A value is reported when its exact count is at least
``share`` of the non-null rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbase.runtime import ship

BITS = (8, 16, 24, 32)
BUFFER = 1 << 18
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mixed(prefix: np.ndarray, level: int, row: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (prefix.astype(np.uint64) + np.uint64(1 + 131 * level)) * _ODD[row]
        x ^= x >> np.uint64(29)
        x *= _ODD[(row + 3) % len(_ODD)]
        return x ^ (x >> np.uint64(32))


def _cells(prefix: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell and the sign of each prefix."""
    x = _mixed(prefix, level, row)
    return (x % np.uint64(width)).astype(np.int64), 1 - 2 * ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def _sketch(depth: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((len(BITS), depth, width), np.int64)
        total, held, waiting = 0, 0, []

        def add() -> None:
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            for level, bits in enumerate(BITS):
                prefix = values >> np.uint32(32 - bits)
                for row in range(depth):
                    cell, sign = _cells(prefix, level, row, width)
                    grid[level, row] += np.bincount(cell, weights=sign * counts, minlength=width).astype(np.int64)
            waiting.clear()

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint32))
            total += batch.num_rows
            held += batch.num_rows
            if held >= BUFFER:
                add()
                held = 0
        if waiting:
            add()
        if total:
            flat = grid.reshape(len(BITS) * depth, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(flat)), pa.int32()), pa.array([[total], *flat.tolist()], pa.list_(pa.int64()))], names=["line", "cells"]
            )

    return run


def _summed(table: pa.Table) -> pa.Table:
    lines = [x.to_numpy(zero_copy_only=False) for x in (y.values for y in table["cells"])]
    return pa.table({"line": table["line"][:1], "cells": pa.array([np.sum(lines, axis=0).tolist()], pa.list_(pa.int64()))})


def frequent_values(df: DataFrame, value: Column, share: float = 0.0025, depth: int = 5, width: int = 4096, slack: float = 0.6) -> DataFrame:
    """(value, n_approx, n_exact, share) of every value with at least ``share`` of the non-null rows."""
    ship(df.sparkSession)
    spark = df.sparkSession
    hashed = F.shiftrightunsigned(F.xxhash64("value"), 32)
    rows = df.select(value.cast("string").alias("value")).filter("value is not null")
    merged = rows.select(hashed.alias("h")).mapInArrow(_sketch(depth, width), "line int, cells array<bigint>")
    # Each task sends four sketches of fixed size. Summing them line by line keeps a reducer's input at tasks x width x 8 bytes,
    # and a first round over `fan` groups keeps that bounded when there are very many tasks.
    fan = merged.withColumn("fan", F.spark_partition_id() % 64)
    part = fan.groupBy("line", "fan").applyInArrow(lambda t: _summed(t.select(["line", "cells"])), "line int, cells array<bigint>")
    found = {x["line"]: np.array(x["cells"]) for x in part.groupBy("line").applyInArrow(_summed, "line int, cells array<bigint>").collect()}
    out = "value string, n_approx bigint, n_exact bigint, share double"
    if not found:
        return spark.createDataFrame([], out)
    total = int(found[-1][0])
    alive, estimate = np.zeros(1, np.int64), np.zeros(0)
    before = 0
    for level, bits in enumerate(BITS):
        fresh = (alive[:, None] << (bits - before)) + np.arange(1 << (bits - before))[None, :]
        fresh, before = fresh.ravel(), bits
        seen = []
        for row in range(depth):
            cell, sign = _cells(fresh, level, row, width)
            seen.append(sign * found[level * depth + row][cell])
        estimate = np.median(np.array(seen), axis=0)
        heavy = estimate >= slack * share * total
        alive, estimate = fresh[heavy], estimate[heavy]
    if not len(alive):
        return spark.createDataFrame([], out)
    approx = F.create_map(*(F.lit(x) for pair in zip(alive.tolist(), [int(x) for x in estimate], strict=True) for x in pair))
    checked = rows.withColumn("h", hashed).filter(F.col("h").isin(alive.tolist()))
    counted = checked.groupBy("value", "h").agg(F.count("*").alias("n_exact")).filter(F.col("n_exact") >= F.lit(share) * total)
    return counted.select("value", approx[F.col("h")].alias("n_approx"), "n_exact", (F.col("n_exact") / F.lit(total)).alias("share"))
