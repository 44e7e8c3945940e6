"""Problem 4: the k most similar vectors for every vector, by balanced posting lists.

1. Equal vectors are one entry holding its k + 1 smallest ids, which is all that any answer can need; an entry with more
   than k ids is never searched for, as its own ids answer it.
2. Centroids are fitted on the driver on a hash sample of about ``sample`` entries by splitting clusters until each is
   small, so that posting lists are balanced, dense regions having more of them. There are at most
   ``sample`` / ``MIN_PER_CENTROID`` centroids, which bounds what tasks get of them; the sample affects only where the lists
   lie, every entry is indexed.
3. Each entry searches the nearest centroids in a neighbour graph of the centroids by best-first beams. It is stored in
   the nearest list and, near a boundary, in further lists within a distance ratio, skipping lists closer to one already
   chosen than to the entry. It probes the lists within a wider ratio, at least ``min_probes``.
4. Lists are searched block against block, with exact squared distances; a list longer than a block is split into parts
   that every query of the list visits, so no task holds more than a block of either.
5. The best of all probed lists are merged, ties to the smaller id.

Distances are exact; only the choice of lists approximates. The recall against brute force is in the README.

Defined cases: vectors that are null, have null entries or not ``dims`` of them take no part, nor do rows with a null id;
repeated (id, vector) rows count once; with fewer than k others all of them are given; an empty table gives no rows;
values are compared in double precision (exact for sums below 2^53).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandbase.runtime import cut, ship

MIN_PER_CENTROID = 8
BLOCK = 2048
ROUTE_ROWS = 4000
_FOUND = pa.schema([("gid", pa.int64()), ("best", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())])))])


def _split(x: np.ndarray, rng: np.random.Generator, ways: int) -> np.ndarray:
    """k-means labels of a few clusters."""
    centres = x[rng.choice(len(x), ways, replace=False)]
    labels = np.zeros(len(x), np.int64)
    for _ in range(8):
        d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
        labels = d.argmin(1)
        for i in range(ways):
            if (labels == i).any():
                centres[i] = x[labels == i].mean(0)
    return labels


def balanced_centroids(x: np.ndarray, most: int, seed: int = 5) -> np.ndarray:
    """Centres of clusters of at most ``most`` rows each."""
    rng, out, todo = np.random.default_rng(seed), [], [x]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            out.append(part.mean(0))
            continue
        labels = _split(part, rng, int(min(8, max(2, len(part) // most))))
        pieces = [part[labels == i] for i in np.unique(labels)]
        if len(pieces) == 1:  # can't be told apart by means: cut along the widest coordinate
            order = np.argsort(part[:, part.std(0).argmax()], kind="stable")
            pieces = [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        todo += pieces
    return np.unique(np.array(out), axis=0)


class CentroidGraph:
    """Best-first search over a neighbour graph of the centroids."""

    def __init__(self, centres: np.ndarray, degree: int = 16, entries: int = 128):
        self.c = centres
        n = len(centres)
        degree = min(degree, n)
        self.near = np.empty((n, degree), np.int64)
        self.norm = (centres * centres).sum(1)
        for i in range(0, n, 512):
            d = self.norm[None, :] - 2 * centres[i : i + 512] @ centres.T
            self.near[i : i + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        self.entry = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))

    def search(self, x: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the nearest centroids found for each row, nearest first (inf where fewer). In each step
        the ``wide`` nearest of the beam that weren't yet are replaced by themselves and their neighbours."""
        start = np.broadcast_to(self.entry, (len(x), len(self.entry)))
        ids, d, done = self._best(start, self._apart(x, start), np.zeros(start.shape, bool), beam)
        live = np.arange(len(x))
        while len(live):
            waiting = np.where(done[live], np.inf, d[live])
            pick = np.argsort(waiting, axis=1, kind="stable")[:, :wide]
            open_ = np.isfinite(np.take_along_axis(waiting, pick, 1))
            more = open_.any(1)
            live, pick, open_ = live[more], pick[more], open_[more]
            if not len(live):
                break
            now = done[live]
            np.put_along_axis(now, pick, True, 1)
            fresh = self.near[np.take_along_axis(ids[live], pick, 1)].reshape(len(live), -1)
            fresh_d = np.where(np.repeat(open_, self.near.shape[1], 1), self._apart(x[live], fresh), np.inf)
            ids[live], d[live], done[live] = self._best(np.concatenate([ids[live], fresh], 1), np.concatenate([d[live], fresh_d], 1), np.concatenate([now, np.zeros(fresh.shape, bool)], 1), beam)
        return np.where(np.isinf(d), -1, ids), d

    def _apart(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return ((self.c[ids] - x[:, None, :]) ** 2).sum(2)

    @staticmethod
    def _best(ids: np.ndarray, d: np.ndarray, done: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest ``beam`` of each row, each id once."""
        order = np.argsort(ids, axis=1, kind="stable")  # of equal ids the first, which is the one already in the beam
        ids, d, done = (np.take_along_axis(a, order, 1) for a in (ids, d, done))
        d[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
        if d.shape[1] < beam:
            pad = ((0, 0), (0, beam - d.shape[1]))
            d, ids, done = np.pad(d, pad, constant_values=np.inf), np.pad(ids, pad), np.pad(done, pad)
        at = np.argsort(d, axis=1, kind="stable")[:, :beam]
        return tuple(np.take_along_axis(a, at, 1) for a in (ids, d, done))


_graphs: dict[bytes, CentroidGraph] = {}


def _graph(centres: np.ndarray) -> CentroidGraph:
    """The graph of these centroids, made once in each worker process."""
    key = hashlib.blake2b(centres.tobytes(), digest_size=16).digest()
    if key not in _graphs:
        _graphs.clear()
        _graphs[key] = CentroidGraph(centres)
    return _graphs[key]


def _lists(ids: np.ndarray, mask: np.ndarray) -> pa.ListArray:
    """The masked ids of each row."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(mask.sum(1))], pa.int32()), pa.array(ids[mask], pa.int32()))


def _route(sent: Broadcast, dims: int, beam: int, replicas: int, store_ratio: float, min_probes: int, probe_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = _graph(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                x = some.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
                ids, d2 = graph.search(x, beam)
                d = np.sqrt(d2)
                found = np.isfinite(d)
                probe = found & ((d <= probe_ratio * d[:, :1]) | (np.arange(beam)[None, :] < min_probes))
                met = graph.c[ids]
                keep = np.zeros_like(found)
                keep[:, 0] = True
                for j in range(1, beam):
                    ok = found[:, j] & (d[:, j] <= store_ratio * d[:, 0]) & (keep.sum(1) < replicas)
                    at = np.flatnonzero(ok)
                    gap = np.sqrt(((met[at, :j] - met[at, j : j + 1]) ** 2).sum(2))
                    keep[at, j] = ~(keep[at, :j] & (gap < d[at, j, None])).any(1)
                yield pa.RecordBatch.from_arrays([*some.columns, _lists(ids, keep), _lists(ids, probe)], names=[*some.schema.names, "store", "probe"])

    return run


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, exact: by products where all are whole numbers small enough, else coordinate by coordinate."""
    most = max(np.abs(x).max(), np.abs(y).max())
    if 4 * x.shape[1] * most * most < 2**52 and (x == np.rint(x)).all() and (y == np.rint(y)).all():
        return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]
    d = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        gap = x[:, j][:, None] - y[:, j][None, :]
        d += gap * gap
    return d


def _search(dims: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        gid = table["gid"].to_numpy()
        x = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
        is_query = table["query"].to_numpy()
        store = np.flatnonzero(~is_query)
        lists = table["ids"].combine_chunks().take(pa.array(store))
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(store, np.diff(lists.offsets.to_numpy()))  # a row for each id, in the order of ids: ties go to the smaller
        order = np.argsort(ids, kind="stable")
        ids, of = ids[order], of[order]
        asked, counts, best_d, best_id = [], [np.zeros(1, np.int64)], [], []
        queries = np.flatnonzero(is_query)
        for at in np.array_split(queries, max(1, len(queries) // 256)):
            if not len(at) or not len(of):
                continue
            d = _distances(x[at], x[of])
            d[gid[at][:, None] == gid[of][None, :]] = np.inf
            if np.where(np.isinf(d), 0, d).max() * len(of) < 2**52:  # distance and rank of the id in one exact number
                rank = d * len(of) + np.arange(len(of))[None, :]
                near = np.argpartition(rank, min(k, len(of)) - 1, axis=1)[:, :k]
            else:
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
            near_d = np.take_along_axis(d, near, 1)
            some = np.isfinite(near_d)
            asked.append(gid[at])
            counts.append(some.sum(1))
            best_d.append(near_d[some])
            best_id.append(ids[near][some])
        if not asked:
            return pa.table([[], []], schema=_FOUND)
        best = pa.StructArray.from_arrays([pa.array(np.concatenate(best_d)), pa.array(np.concatenate(best_id))], names=["d", "id"])
        return pa.table([pa.array(np.concatenate(asked)), pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), best)], schema=_FOUND)

    return run


def nearest(
    df: DataFrame, id_col: str, vec_col: str, dims: int = 13, k: int = 5, sample: int = 40_000, list_size: int = 160,
    beam: int = 20, replicas: int = 4, store_ratio: float = 1.35, min_probes: int = 6, probe_ratio: float = 1.6,
) -> DataFrame:
    """(id, rank, neighbour, distance): up to k rows for each vector, distance being the sum of squared differences."""
    ship(df.sparkSession)
    usable = F.col(vec_col).isNotNull() & (F.size(vec_col) == dims) & ~F.exists(vec_col, lambda x: x.isNull())
    rows = df.filter(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).distinct()
    rows = cut(rows, "vectors")
    by_vec = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("rank", F.row_number().over(by_vec)).filter(F.col("rank") <= k + 1)  # cut down before the shuffle
    entries = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("vec", "ids", F.col("ids")[0].alias("gid"))
    entries = cut(entries, "entries")
    n = entries.count()
    share = min(1.0, sample / max(n, 1))
    picked = entries.filter(F.pmod(F.xxhash64("vec", F.lit(11)), F.lit(1_000_000_000)) < F.lit(int(share * 1_000_000_000))).select("vec").toArrow()
    x = picked["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if not len(x):  # none, or so few that the sample missed them
        x = np.zeros((1, dims))
    centres = balanced_centroids(x, max(MIN_PER_CENTROID, round(list_size * share)))
    # Routing is costly for each row but the rows are small, so tasks are cut by rows, not by bytes.
    routed = cut(
        entries.repartition(max(1, -(-n // ROUTE_ROWS))).mapInArrow(_route(df.sparkSession.sparkContext.broadcast(centres), dims, beam, replicas, store_ratio, min_probes, probe_ratio), "vec array<double>, ids array<bigint>, gid bigint, store array<int>, probe array<int>"),
        "routed",
    )
    stored = routed.select(F.explode("store").alias("list"), F.lit(False).alias("query"), "gid", "vec", "ids")
    asking = routed.filter(F.size("ids") <= k).select(F.explode("probe").alias("list"), F.lit(True).alias("query"), "gid", "vec", F.array().cast("array<bigint>").alias("ids"))
    both = stored.unionByName(asking)
    parts = lambda flag: F.ceil(F.count(F.when(F.col("query") == flag, 1)) / BLOCK).cast("int")
    sizes = both.groupBy("list").agg(F.greatest(parts(False), F.lit(1)).alias("s_parts"), F.greatest(parts(True), F.lit(1)).alias("q_parts"))
    # At most as many lists as centroids, so this side has a proven bound.
    blocks = both.join(F.broadcast(sizes), "list")
    own = F.pmod(F.xxhash64("gid"), F.when(F.col("query"), F.col("q_parts")).otherwise(F.col("s_parts"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("query"), F.col("s_parts")).otherwise(F.col("q_parts")) - 1)
    blocks = blocks.withColumn("own", own).withColumn("other", F.explode(other))
    blocks = blocks.withColumn("s", F.when(F.col("query"), F.col("other")).otherwise(F.col("own"))).withColumn("q", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")))
    found = blocks.select("list", "s", "q", "query", "gid", "vec", "ids").groupBy("list", "s", "q").applyInArrow(_search(dims, k), "gid bigint, best array<struct<d:double,id:bigint>>")
    merged = found.groupBy("gid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))
    answers = entries.join(merged, "gid", "left")
    same = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id")))
    all_near = F.concat(same, F.coalesce("best", F.array().cast("array<struct<d:double,id:bigint>>")))
    full = rows.join(answers.select("vec", all_near.alias("near")), "vec")
    ranked = F.slice(F.array_sort(F.filter("near", lambda y: y["id"] != F.col("id"))), 1, k)
    return full.select("id", F.posexplode(ranked).alias("pos", "n")).select("id", (F.col("pos") + 1).alias("rank"), F.col("n.id").alias("neighbour"), F.col("n.d").alias("distance"))


def unordered_pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, where at least one is among the nearest of the other."""
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
