"""Problem 7: long spans that stand verbatim in more than one record, by suffix automata of reference shards.

To send every shard's automaton to every document would cost the square of the collection. Shards are therefore cut by
content: every window of ``least`` elements has a minimizer (the smallest hash of its runs of ``RUN`` elements), equal
windows have equal minimizers, and neighbouring windows of one minimizer form a stretch. All stretches of a minimizer
belong to one shard, so each stretch has to meet one automaton only and the work is linear.

1. Stretches are made by one vectorised pass. Minimizers that only one record has are dropped: nothing of theirs can occur
   elsewhere. Equal stretches are one entry with its smallest and largest owner.
2. Every shard builds the suffix automaton of its distinct entries, each state with the smallest and the largest owner of what
   it stands for, and streams its entries for matching statistics: a window is shared where the state of its last ``least``
   elements has another owner. All spans come from there.
3. A minimizer with more than ``shard_tokens`` elements is cut finer: its stretches are cut again by the smallest hash of runs
   twice as long, so that equal windows still meet, and in the end by the windows themselves, of which a shard holds one. No
   stretch is copied to several shards, and no task holds more than a shard, however frequent a minimizer is.
4. Windows are put back into their records and joined into the longest stretches.

Elements and stretches are compared by 64-bit hashes (equal up to a chance of 2^-64).

Defined cases: records with fewer than ``least`` elements, null lists or null ids give no rows; rows with equal id are one
owner, so repeated rows share nothing with themselves; spans of touching windows are joined; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbase.runtime import cut, ship

RUN = 4
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        return (x * _MULTIPLY) ^ (x >> np.uint64(31))


def stretches(values: np.ndarray, starts: np.ndarray, least: int, length: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, start, length, minimizer) of the stretches of records values[starts[i]:starts[i + 1]], by runs of ``length``."""
    n = len(values)
    if n < least:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    x = _mix(values.astype(np.uint64))
    run = np.zeros(n - length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            run = run * _MULTIPLY + x[i : n - length + 1 + i]
    run = _mix(run)
    windows = n - least + 1
    low = run[:windows].copy()
    for i in range(1, least - length + 1):
        np.minimum(low, run[i : i + windows], out=low)
    inside = of[:windows] == of[least - 1 :]
    change = np.r_[True, (low[1:] != low[:-1]) | (of[1:windows] != of[: windows - 1])]
    first = np.flatnonzero(change & inside)  # the windows of a record are contiguous, so a stretch begins inside
    last = np.r_[np.flatnonzero(change)[1:], windows] - 1
    last = last[inside[np.flatnonzero(change)]]
    ends_inside = np.cumsum(inside)
    count = ends_inside[last] - ends_inside[first] + 1  # windows of the stretch that lie inside the record
    return of[first], first - starts[of[first]], count + least - 1, low[first]


def _cut_up(least: int, length: int, keep: list[str]):
    """Rows (key, h, *keep, start, n, content): the stretches of every content. A finer cut keeps the old key apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                lists = some.column("content")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
                rec, start, n, low = stretches(flat, starts, least, length)
                if not len(rec):
                    continue
                if "of_key" in keep:
                    low = _mix(low + some.column("of_key").to_numpy()[rec].view(np.uint64) * _MULTIPLY)
                edges = np.r_[0, np.cumsum(n)]
                where = np.arange(edges[-1]) - np.repeat(edges[:-1] - (starts[rec] + start), n)
                content = flat[where]
                place = (np.arange(edges[-1]) - np.repeat(edges[:-1], n)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    h = _mix(np.add.reduceat(_mix(_mix(content.astype(np.uint64)) + place * _MULTIPLY), edges[:-1]) + n.astype(np.uint64))
                made = {"key": pa.array(low.view(np.int64)), "h": pa.array(h.view(np.int64))} | {c: pa.array(some.column(c).to_numpy()[rec]) for c in keep}
                made |= {"start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32()), "content": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(content))}
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return run


class SuffixAutomaton:
    """The suffix automaton of several sequences; each state knows the smallest and largest owner of its occurrences."""

    def __init__(self) -> None:
        self.to: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.lo, self.hi = [_NONE], [-1]

    def _state(self, length: int, to: dict[int, int]) -> int:
        self.to.append(to)
        self.link.append(0)
        self.len.append(length)
        self.lo.append(_NONE)
        self.hi.append(-1)
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        """The state for what follows p by c, where q stands for longer sequences too."""
        to, link, size = self.to, self.link, self.len
        if size[p] + 1 == size[q]:
            return q
        copy = self._state(size[p] + 1, dict(to[q]))
        link[copy], link[q] = link[q], copy
        while p >= 0 and to[p].get(c) == q:
            to[p][c] = copy
            p = link[p]
        return copy

    def add(self, sequence: list[int], lo: int, hi: int) -> None:
        to, link, size = self.to, self.link, self.len
        last = 0
        for c in sequence:
            q = to[last].get(c)
            if q is not None:
                last = self._clone(last, c, q)
            else:
                fresh, p = self._state(size[last] + 1, {}), last
                while p >= 0 and c not in to[p]:
                    to[p][c] = fresh
                    p = link[p]
                link[fresh] = 0 if p < 0 else self._clone(p, c, to[p][c])
                last = fresh
            if lo < self.lo[last]:
                self.lo[last] = lo
            if hi > self.hi[last]:
                self.hi[last] = hi

    def finish(self) -> None:
        """Hands the owners of every state on to its suffixes."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            p = self.link[s]
            if self.lo[s] < self.lo[p]:
                self.lo[p] = self.lo[s]
            if self.hi[s] > self.hi[p]:
                self.hi[p] = self.hi[s]

    def shared(self, sequence: list[int], owner: int, least: int) -> list[tuple[int, int]]:
        """The stretches of ``sequence`` covered by runs of ``least`` elements that another owner has too."""
        to, link, size = self.to, self.link, self.len
        state = matched = 0
        spans: list[tuple[int, int]] = []
        for at, c in enumerate(sequence):
            while state and c not in to[state]:
                state = link[state]
                matched = size[state]
            if c in to[state]:
                state = to[state][c]
                matched += 1
            if matched >= least:
                s = state
                while size[link[s]] >= least:
                    s = link[s]
                if self.lo[s] != owner or self.hi[s] != owner:
                    a = at - least + 1
                    if spans and a <= spans[-1][1] + 1:
                        spans[-1] = (spans[-1][0], at)
                    else:
                        spans.append((a, at))
        return spans


def _matched(least: int):
    out = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        made: list[tuple] = []
        automaton = SuffixAutomaton()
        lists = table["content"].combine_chunks()
        flat = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1].tolist()
        edges = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))].tolist()
        rows = list(zip(*(table[c].to_pylist() for c in ("key", "h", "lo", "hi")), strict=True))
        for i, (_, _, lo, hi) in enumerate(rows):
            automaton.add(flat[edges[i] : edges[i + 1]], lo, hi)
        automaton.finish()
        for i, (key, h, lo, _) in enumerate(rows):
            made += [(key, h, a, b) for a, b in automaton.shared(flat[edges[i] : edges[i + 1]], lo, least)]
        return pa.table(list(zip(*made, strict=True)) if made else [[]] * 4, schema=out)

    return run


def _matches(pieces: DataFrame, least: int, shard_tokens: int, runs: tuple[int, ...]) -> DataFrame:
    """(key, h, a, b): the shared spans of the distinct pieces (key, h, lo, hi, n, content), ``lo`` to ``hi`` being their owners."""
    entries = cut(pieces.groupBy("key", "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n")), "stretch_entries")
    group = entries.groupBy("key").agg(F.min("lo").alias("g_lo"), F.max("hi").alias("g_hi"), F.sum("n").alias("tokens"))
    group = cut(group.filter("g_lo < g_hi").select("key", "tokens"), "stretch_groups")
    hot = F.col("tokens") > shard_tokens if runs else F.lit(False)
    told = group.agg(F.sum(F.when(~hot, F.col("tokens"))).alias("total"), F.max(hot).alias("hot")).first()
    shards = max(1, -(-(told["total"] or 0) // shard_tokens))
    # Contents are fetched once for each entry that another record may share: from a piece of its smallest owner.
    wanted = entries.join(group, "key").select("key", "h", "lo", "hi", hot.alias("hot"))
    one = pieces.select("key", "h", "lo", "content").join(wanted, ["key", "h", "lo"]).dropDuplicates(["key", "h", "lo"])
    one = cut(one, "stretch_contents") if told["hot"] else one
    found = one.filter(~F.col("hot")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(_matched(least), "key bigint, h bigint, a int, b int")
    if not told["hot"]:
        return found
    finer = one.filter("hot").select(F.col("key").alias("of_key"), F.col("h").alias("of_h"), "lo", "hi", "content")
    keep = ["of_key", "of_h", "lo", "hi"]
    finer = cut(finer.mapInArrow(_cut_up(least, runs[0], keep), "key bigint, h bigint, of_key bigint, of_h bigint, lo bigint, hi bigint, start int, n int, content array<bigint>"), "stretches")
    inner = finer.select("key", "h", "of_key", "of_h", "start").join(_matches(finer, least, shard_tokens, runs[1:]), ["key", "h"])
    return found.union(inner.select("of_key", "of_h", F.col("start") + F.col("a"), F.col("start") + F.col("b")))


def shared_spans(df: DataFrame, id_col: str, elements: Column, least: int = 16, shard_tokens: int = 50_000) -> DataFrame:
    """(id, from_pos, to_pos): the longest stretches of consecutive shared positions of every record."""
    ship(df.sparkSession)
    # Records that are too short yield nothing in the pass itself; a filter on their size would have the elements made twice.
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), elements.alias("content"))
    pieces = cut(rows.mapInArrow(_cut_up(least, RUN, ["id"]), "key bigint, h bigint, id bigint, start int, n int, content array<bigint>"), "stretches")
    runs = tuple(x for x in (RUN * 2**i for i in range(1, 32)) if x < least) + (least,)
    marked = _matches(pieces.select("key", "h", F.col("id").alias("lo"), F.col("id").alias("hi"), "n", "content"), least, shard_tokens, runs)
    placed = pieces.select("key", "h", "id", "start").join(marked, ["key", "h"]).select("id", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    placed = placed.distinct()  # a record delivered over and over is one record before it is sorted
    order = Window.partitionBy("id").orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = placed.withColumn("fresh", (reached.isNull() | (F.col("a") > reached + 1)).cast("int")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("id", "island").agg(F.min("a").cast("int").alias("from_pos"), F.max("b").cast("int").alias("to_pos")).select("id", "from_pos", "to_pos")
