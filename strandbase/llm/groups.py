"""Problem 6: one group id for all records linked by pairs, directly or through others, by seed-tree pruning.

Each round works on the undirected edges still alive:

1. every vertex takes the smallest id of its neighbourhood (itself included) and points its whole neighbourhood at it;
2. a vertex that is nobody's minimum drops out: it becomes the child of its smallest minimum in the propagation forest;
3. the minima a vertex was pointed at are tied to the smallest of them, and these ties are the next round's edges.

When no edge is left, the vertices that never dropped out are the seeds, the smallest ids of their groups. Their ids flow
down the forest by pointer jumping (its depth is at most the number of rounds, so few jumps). Every step is a join or a
combinable minimum; no vertex's neighbourhood is ever held in one place, and hot vertices are split by the adaptive
skew join. Edges and forest live in the shared folder between rounds, never on the driver.

Defined cases: null ends and pairs of a record with itself tie nothing; repeated and reversed pairs count once; a record
without pairs is its own group; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbase.runtime import cut, release


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def seed_forest(pairs: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame | None:
    """(child, parent) of every vertex that isn't a seed; None when nothing is tied."""
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    tied = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(tied.select(lo.cast("bigint").alias("u"), hi.cast("bigint").alias("v")).distinct(), "edges")
    trees = []
    for _ in range(max_rounds):
        if not edges.take(1):
            break
        sym = _both_ways(edges)
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        pointed = sym.join(least, "u").select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m"))
        pointed = cut(pointed.distinct(), "pointed")
        best = cut(pointed.groupBy("x").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("x")).alias("stays"), F.count("*").alias("n")), "best")
        trees.append(best.filter("not stays").select(F.col("x").alias("child"), F.col("best").alias("parent")))
        many = best.filter("n > 1").select("x", "best")
        fresh = cut(pointed.join(many, "x").filter("m <> best").select(F.col("best").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        release(edges, pointed)
        edges = fresh
    else:
        raise RuntimeError(f"groups still open after {max_rounds} rounds")
    return reduce(DataFrame.union, trees) if trees else None


def group_ids(pairs: DataFrame, a: str, b: str, vertices: DataFrame, vertex: str) -> DataFrame:
    """(group_id, vertex): one row for each distinct non-null vertex."""
    all_ids = vertices.select(F.col(vertex).cast("bigint").alias(vertex)).filter(F.col(vertex).isNotNull()).distinct()
    forest = seed_forest(pairs, a, b)
    if forest is None:
        return all_ids.select(F.col(vertex).alias("group_id"), vertex)
    up = cut(forest, "forest")
    while True:  # every jump halves the way to the seed
        above = up.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
        jumped = cut(up.join(above, "parent", "left").select("child", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")), "forest")
        done = not jumped.filter("moved").take(1)
        release(up)
        up = jumped.select("child", "parent")
        up._cut_path = jumped._cut_path
        if done:
            break
    joined = all_ids.join(up.select(F.col("child").alias(vertex), "parent"), vertex, "left")
    return joined.select(F.coalesce("parent", vertex).alias("group_id"), vertex)
