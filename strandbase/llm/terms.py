"""Problem 1: how often every distinct term occurs, and in how many records, by heavy-light aggregation.

1. Every partition keeps a bounded Misra-Gries summary of the terms it reads; the merged summaries name at most
   ``max_heavy`` heavy terms (each of at most ``MAX_HEAVY_BYTES`` bytes), so what is broadcast has a proven bound.
   The choice affects only speed: any heavy set gives the same result.
2. The counting pass adds heavy terms into exact local int64 arrays, one row for each term and task at its end. Only the
   remaining terms are shuffled, already summed within an Arrow batch and again by the partial aggregate.
3. Both count tables are united by one sum.

Defined cases: null lists, null and blank entries give no term but the record still counts; entries are compared without
surrounding (Unicode) white space, case kept; an entry repeated within a record counts once for ``n_records``; of several
rows of one record the latest ``loaded_at`` holds (ties: the larger content hash); a null record id makes each of its rows
a record of its own; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbase.runtime import cut, ship

MAX_HEAVY_BYTES = 1024
_OUT = "field string, term string, n_total bigint, n_records bigint"
_ARROW = pa.schema([("field", pa.string()), ("term", pa.string()), ("n_total", pa.int64()), ("n_records", pa.int64())])


def _terms_of(column: pa.ChunkedArray | pa.Array) -> pa.Table:
    """(rec, term) of every usable entry of a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    terms = pc.utf8_trim_whitespace(pc.list_flatten(lists).cast(pa.large_string()))
    keep = pc.fill_null(pc.greater(pc.binary_length(terms), 0), False)
    return pa.table({"rec": pc.list_parent_indices(lists).filter(keep), "term": terms.filter(keep)})


def _summary(fields: list[str], counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, str], int] = {}
        for batch in batches:
            for f in fields:
                found = pc.value_counts(_terms_of(batch.column(f))["term"].combine_chunks())
                for x in found.to_pylist():
                    if len(x["values"]) <= MAX_HEAVY_BYTES:
                        kept[f, x["values"]] = kept.get((f, x["values"]), 0) + x["counts"]
            if len(kept) > counters:
                less = np.partition(np.fromiter(kept.values(), np.int64, len(kept)), -counters)[-counters]
                kept = {k: n - less for k, n in kept.items() if n > less}
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept]), pa.array([k[1] for k in kept]), pa.array(list(kept.values()), pa.int64())],
                names=["field", "term", "n"],
            )

    return run


def _count(fields: list[str], heavy: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {f: pa.array(heavy.get(f, []), pa.large_string()) for f in fields}
        local = {f: np.zeros((len(words[f]), 2), np.int64) for f in fields}
        records = 0
        for batch in batches:
            records += batch.num_rows
            for f in fields:
                per_rec = _terms_of(batch.column(f)).group_by(["rec", "term"]).aggregate([([], "count_all")])
                found = per_rec.group_by("term").aggregate([("count_all", "sum"), ("count_all", "count")])
                term, total, recs = found["term"], found["count_all_sum"], found["count_all_count"]
                at = pc.index_in(term, value_set=words[f])
                is_heavy = pc.is_valid(at)
                slots = at.filter(is_heavy).to_numpy()
                local[f][slots, 0] += total.filter(is_heavy).to_numpy()
                local[f][slots, 1] += recs.filter(is_heavy).to_numpy()
                light = pc.invert(is_heavy)
                rest = term.filter(light).cast(pa.string())
                if len(rest):
                    yield from pa.table(
                        [pa.array([f] * len(rest)), rest, total.filter(light).cast(pa.int64()), recs.filter(light)], schema=_ARROW
                    ).to_batches()
        for f in fields:
            used = np.flatnonzero(local[f][:, 0])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(used)), words[f].take(pa.array(used)).cast(pa.string()), pa.array(local[f][used, 0]), pa.array(local[f][used, 1])],
                    schema=_ARROW,
                )
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([records], pa.int64())], schema=_ARROW)

    return run


def one_row_per_record(df: DataFrame, record_id: str, lists: dict[str, Column], order: str | None) -> DataFrame:
    """The list columns of each record once, however often it was delivered."""
    row = F.struct(*(c.alias(f) for f, c in lists.items()))
    key = F.coalesce(F.col(record_id).cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    at = F.col(order) if order else F.lit(None).cast("timestamp")
    rows = df.select(key.alias("key"), at.alias("at"), row.alias("row"))
    rows = rows.withColumn("rank", F.struct("at", F.xxhash64("row")))
    return rows.groupBy("key").agg(F.max_by("row", "rank").alias("row")).select("row.*")


def term_frequencies(
    df: DataFrame, record_id: str, lists: dict[str, Column], order: str | None = None, max_heavy: int = 1024
) -> tuple[DataFrame, int]:
    """(field, term, n_total, n_records) for every distinct term, and the number of records."""
    ship(df.sparkSession)
    fields = list(lists)
    raw = df.select(*(c.alias(f) for f, c in lists.items()))
    heavy: dict[str, list[str]] = {}
    sketch = raw.mapInArrow(_summary(fields, 4 * max_heavy), "field string, term string, n bigint")
    for x in sketch.groupBy("field", "term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "field", "term").limit(max_heavy).collect():
        heavy.setdefault(x["field"], []).append(x["term"])
    counted = one_row_per_record(df, record_id, lists, order).mapInArrow(_count(fields, heavy), _OUT)
    both = cut(counted.groupBy("field", "term").agg(F.sum("n_total").alias("n_total"), F.sum("n_records").alias("n_records")), "terms")
    total = both.filter("field is null").select("n_records").first()
    return both.filter("field is not null"), total["n_records"] if total else 0


def marked_terms(counts: DataFrame, n_records: int, rare: int = 2, common_share: float = 0.5) -> DataFrame:
    """Adds ``mark``: ``rare`` in at most ``rare`` records, ``common`` in more than that share of all, else null. In a
    collection so small that both hold, ``rare`` is given."""
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > common_share * n_records, "common")
    return counts.withColumn("mark", mark)
