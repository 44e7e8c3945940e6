"""Problem 5: records that are nearly the same, by circulant MinHash, banding and exact verification.

A record is a sequence of 64-bit element ids. Its MinHash set holds its elements, each with its number of occurrence, hashed
to positions of a universe of 2^16. Of two records within the edit limit the longer has at least similarity * length elements
in common with the other, however the edits are spread, so their sets' Jaccard similarity J is at least
similarity / (2 - similarity), and ``bands`` bands of ``rows`` find a pair with probability 1 - (1 - J^rows)^bands at least.

* Signature: one permutation places the positions (sigma), a second one (pi, a table of 2^16 numbers made from a seed) is
  shifted circularly by i for the i-th coordinate: h_i = min over the set of pi[(sigma(x) - i) mod 2^16]. Two permutations
  give all coordinates, and those of one element are neighbours in the table, so they are read as one piece.
* Banding: ``rows`` consecutive coordinates make a band; records of equal content are one entry before. Band keys are dealt
  to parts, and what an input batch has for a part travels as one row of packed arrays, each entry's sketch once. Bands are
  taken in rounds of a bounded number of parts, so that the files of one round are gone before the next.
* Buckets: pairs of a bucket are formed where its part is read, in order of length and by blocks, and only those are given
  whose lengths and sketches of 320 bits allow the limit; no pair within it is lost by that. A bucket of more than ``hot``
  entries gives its entries instead, as do band keys that a sample of entries shows to be as frequent, whose rows don't
  travel at all. ``hot`` is large, as the join below forms many more pairs than a bucket, whose records are alike, does.
* Those entries are joined on the rarest elements of each: two records whose elements overlap as far as the limit asks must
  share one of their first n - similarity * n + 1 elements in any fixed order, so nothing is lost and only such pairs are formed.
* Verification: exact multiset Jaccard of the elements (its bound follows from the edit limit), then the exact edit
  distance, vectorised over blocks of pairs, for long records with whole rows of the table as bits of one number.

Equal records: a class of at most ``expand`` copies is given as all its pairs, a larger one as (smallest id, member); a link
between two different contents is given for all members likewise. So no link between different contents is lost and
output stays linear in the copies.

Defined cases: records with fewer than ``least`` elements (the name not counted), null ids or null lists take no part; a
null name is a value of its own; repeated rows count once, and of several contents of one id that with the smallest digest;
empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbase.runtime import cut, empty, release, ship

BITS = 16
UNIVERSE = 1 << BITS
#: Bits of a sketch, and the words of it that are compared first.
SKETCH, FIRST_WORDS = 320, 3
#: Rows of band keys in a part, and parts of a round.
PART_ROWS, ROUND_PARTS = 1_000_000, 256
#: Entries that frequent band keys are looked for in, and the share of them that makes a key frequent.
SAMPLE, FREQUENT = 20_000, 0.01
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_ENTRY = np.dtype([("rep", "<i8"), ("n", "<i4"), ("sketch", "<u8", SKETCH // 64)])
_ROW = np.dtype([("key", "<u4"), ("entry", "<u2")])

_WORDS = [f"s{i}" for i in range(SKETCH // 64)]

_tables: dict[int, np.ndarray] = {}


def _pieces(seed: int, coordinates: range) -> np.ndarray:
    """Row UNIVERSE - 1 - x holds pi[(x - i) mod UNIVERSE] for each coordinate i: overlapping views of pi, reversed."""
    if seed not in _tables:
        back = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.uint16)[::-1]
        _tables[seed] = np.concatenate([back, back])
    return np.lib.stride_tricks.sliding_window_view(_tables[seed][coordinates.start :], len(coordinates))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= _MULTIPLY
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def occurrence(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """0 for the first time a value occurs in its record, 1 for the second, and so on."""
    order = np.lexsort((values, of))
    v, o = values[order], of[order]
    fresh = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])]
    at = np.arange(len(v))
    out = np.empty(len(v), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


def signatures(values: np.ndarray, starts: np.ndarray, coordinates: range, seed: int) -> np.ndarray:
    """One row of MinHash coordinates for each record; record i has values[starts[i]:starts[i + 1]], at least one of them."""
    sizes = np.diff(starts)
    of = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        sigma = _mix(_mix(values) + np.uint64(7) * occurrence(values, of).astype(np.uint64)) >> np.uint64(64 - BITS)
    pieces, at = _pieces(seed, coordinates), UNIVERSE - 1 - sigma.astype(np.int64)
    out = np.empty((len(sizes), len(coordinates)), np.uint16)
    first = 0
    while first < len(sizes):  # blocks of records that fit the processor's caches
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + 4000, "right")) - 1)
        block = pieces[at[starts[first] : starts[last]]]
        out[first:last] = np.minimum.reduceat(block, starts[first:last] - starts[first], axis=0)
        first = last
    return out


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """192 bits for each record, one set for each element and number of occurrence. A bit that only one of two records has
    stands for an element at least that only this record has."""
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    with np.errstate(over="ignore"):
        at = _mix(_mix(values.astype(np.uint64) + np.uint64(11)) + occurrence(values, of).astype(np.uint64)) % np.uint64(SKETCH)
    bits = np.zeros((len(starts) - 1, SKETCH), np.uint8)
    bits[of, at.astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def band_keys(values: np.ndarray, starts: np.ndarray, bands: range, rows: int, seed: int) -> np.ndarray:
    """A 64-bit key for each record and band."""
    sig = signatures(values, starts, range(bands.start * rows, bands.stop * rows), seed).reshape(-1, len(bands), rows)
    key = np.broadcast_to(np.arange(bands.start, bands.stop, dtype=np.uint64), sig.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = _mix(key * np.uint64(0x100000001B3) + sig[:, :, r].astype(np.uint64))
    return key


def _lists(batch: pa.RecordBatch, most: int = 2000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the elements of their contents and where each content begins."""
    for at in range(0, batch.num_rows, most):
        some = batch.slice(at, most)
        lists = some.column("content")
        yield some, lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]


def _sampled_keys(bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat, starts in _lists(batch):
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(flat, starts, range(bands), rows, seed).view(np.int64).ravel())], names=["key"])

    return run


def _dealt(bands: range, rows: int, seed: int, parts: int, frequent: np.ndarray):
    """Rows (part, entries, rows): what a slice of entries has for a part. Entries with a frequent key come with no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, flat, starts in _lists(batch, 10_000):
                told = np.empty(some.num_rows, _ENTRY)
                told["rep"], told["n"], told["sketch"] = some.column("rep").to_numpy(), np.diff(starts), sketches(flat, starts)
                keys = band_keys(flat, starts, bands, rows, seed)
                crowded = np.isin(keys, frequent)
                of, band = np.nonzero(~crowded)
                key = keys[of, band]
                part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                out: dict[str, list] = {"part": [], "entries": [], "rows": []}
                edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(order) else np.zeros(1, int)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    pick = order[a:b]
                    used, entry = np.unique(of[pick], return_inverse=True)
                    packed = np.empty(len(pick), _ROW)
                    packed["key"], packed["entry"] = key[pick] & np.uint64(0xFFFFFFFF), entry
                    out["part"].append(part[pick[0]])
                    out["entries"].append(told[used].tobytes())
                    out["rows"].append(packed.tobytes())
                if crowded.any():
                    crowd = told[crowded.any(1)]
                    for i in range(parts):
                        if len(mine := crowd[crowd["rep"] % parts == i]):
                            out["part"].append(i)
                            out["entries"].append(mine.tobytes())
                            out["rows"].append(b"")
                yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), pa.array(out["entries"], pa.binary()), pa.array(out["rows"], pa.binary())], names=list(out))

    return run


def _shapes(entries: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Lengths; the elements that a record must have in common with any that isn't longer; how many more bits than elements
    (never any) a record has; the words of the sketches. A pair within the limit has at least as many bits in common as the
    longer's elements in common plus either record's third number, as no more of its bits may be its own."""
    n = entries["n"].astype(np.int64)
    need = np.ceil((similarity - 1e-9) * n).astype(np.int64)
    sketch = entries["sketch"]
    return n, need, np.bitwise_count(sketch).sum(1, dtype=np.int64) - n, [np.ascontiguousarray(sketch[:, i]) for i in range(sketch.shape[1])]


def _may(shapes: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where lengths and sketches of x and y, which is no shorter, allow the limit; sure to hold for a pair within it."""
    n, need, extra, words = shapes
    common = sum((np.bitwise_count(w[x] & w[y]) for w in words), np.zeros(len(x), np.uint16))
    return np.flatnonzero((n[x] >= need[y]) & (common >= need[y] + np.maximum(extra[x], extra[y])))


def _all_pairs(shapes: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one bucket, its records in order of length, that lengths and sketches allow, by blocks that fit the
    processor's caches. The first words of the sketches decide nearly all pairs."""
    n, need, _, words = shapes
    some = words[:FIRST_WORDS]
    least = np.maximum(need - n + sum(np.bitwise_count(w).astype(np.int64) for w in some), 0).astype(np.uint16)  # for y alone
    reach = np.searchsorted(need, n, "right")  # records from there on are too long
    for first in range(0, len(n) - 1, 64):
        last, end = min(len(n), first + 64), int(reach[min(len(n), first + 64) - 1])
        for at in range(first + 1, end, 1024):
            to = min(at + 1024, end)
            common = np.zeros((last - first, to - at), np.uint16)
            for w in some:
                common += np.bitwise_count(w[first:last, None] & w[at:to])
            x, y = np.divmod(np.flatnonzero(common >= least[at:to]), to - at)
            x, y = x + first, y + at
            ok = np.flatnonzero(x < y)
            ok = ok[_may(shapes, x[ok], y[ok])]
            yield x[ok], y[ok]


def bucket_pairs(entries: np.ndarray, key: np.ndarray, of: np.ndarray, similarity: float, hot: int, dense: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of entries that share a key and may be within the limit; the entries of keys that more than ``hot`` have."""
    order = np.lexsort((entries["n"][of], key))
    key, of = key[order], of[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    crowd = np.unique(of[np.repeat(size > hot, size)])
    found = [np.zeros((0, 2), np.int64)]

    def add(x: np.ndarray, y: np.ndarray) -> None:
        a, b = entries["rep"][x], entries["rep"][y]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))

    shapes = _shapes(entries, similarity)
    end = np.repeat(edge[1:], size)
    at, step = np.flatnonzero(np.repeat((size > 1) & (size <= min(hot, dense)), size)), 1
    while len(at := at[end[at] > at + step]):  # neighbours at a growing distance, as long as a bucket's lengths allow
        at = at[shapes[0][of[at]] >= shapes[1][of[at + step]]]
        for block in np.array_split(at, -(-len(at) // 200_000) or 1):
            x, y = of[block], of[block + step]
            ok = _may(shapes, x, y)
            add(x[ok], y[ok])
        step += 1
    for i in np.flatnonzero((size > dense) & (size <= hot)):
        own = of[edge[i] : edge[i + 1]]
        n, need, extra, words = shapes
        for x, y in _all_pairs((n[own], need[own], extra[own], [w[own] for w in words])):
            add(own[x], own[y])
    pairs = np.concatenate(found)
    return np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0), crowd


def _met(similarity: float, hot: int):
    """(a, b) of each part; b is null where a belongs to a bucket too large to be paired here."""

    def run(table: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, _ENTRY) for x in table["entries"].to_pylist()]
        rows = [np.frombuffer(x, _ROW) for x in table["rows"].to_pylist()]
        first = np.r_[0, np.cumsum([len(x) for x in held])[:-1]]
        entries, packed = np.concatenate(held), np.concatenate(rows)
        of = packed["entry"].astype(np.int64) + np.repeat(first, [len(x) for x in rows])
        pairs, crowd = bucket_pairs(entries, packed["key"], of, similarity, hot)
        alone = np.unique(np.concatenate([entries["rep"][crowd], *(e["rep"] for e, r in zip(held, rows, strict=True) if not len(r))]))
        b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(alone), pa.int64())])
        return pa.table([pa.array(np.r_[pairs[:, 0], alone]), b], names=["a", "b"])

    return run


def _long_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance with a row of the table as the bits of two numbers: where it rises and where it falls."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full, top, at = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rises, falls = full, 0
    for x in b.tolist():
        same = places.get(x, 0)
        flat = (((same & rises) + rises) ^ rises) | same | falls
        up, down = falls | (full & ~(flat | rises)), rises & flat
        at += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        rises, falls = (down << 1 & full) | (full & ~((same | falls) | up)), up & (same | falls)
    return at


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], long: int = 400) -> np.ndarray:
    """Levenshtein distances of many pairs of sequences, row by row of the table for all pairs at once; pairs longer than
    ``long`` one by one."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if (apart := (np.minimum(la, lb) > 0) & (np.maximum(la, lb) > long)).any():
        out = np.empty(len(a), np.int64)
        out[apart] = [_long_distance(a[i], b[i]) for i in np.flatnonzero(apart)]
        if not apart.all():
            rest = np.flatnonzero(~apart)
            out[rest] = edit_distances([a[i] for i in rest], [b[i] for i in rest], long)
        return out
    n, ma, mb = len(a), int(la.max()), int(lb.max())
    pa_, pb = np.zeros((n, ma), np.int64), np.ones((n, mb), np.int64)
    for i in range(n):
        pa_[i, : la[i]] = a[i]
        pb[i, : lb[i]] = b[i]
    steps = np.arange(mb + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (n, mb + 1)).copy()
    out = np.where(la == 0, lb, 0)
    for i in range(ma):
        fresh = np.empty_like(row)
        fresh[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (pb != pa_[:, i : i + 1]), out=fresh[:, 1:])
        row = np.minimum.accumulate(fresh - steps, axis=1) + steps  # insertions
        done = la == i + 1
        if done.any():
            out[done] = row[done, lb[done]]
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the multiset intersections of many pairs."""
    n = len(a)
    both = np.concatenate([*a, *b])
    of = np.repeat(np.r_[np.arange(n), np.arange(n)], [len(x) for x in a] + [len(x) for x in b])
    side = np.repeat([0, 1], [sum(map(len, a)), sum(map(len, b))])
    nth = occurrence(both, of + n * side)
    order = np.lexsort((nth, both, of))
    v, k, o = both[order], nth[order], of[order]
    twice = (v[1:] == v[:-1]) & (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][twice], minlength=n)


def _verify(similarity: float):
    jaccard = similarity / (2 - similarity)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("ca", "cb")]
            flats = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            cuts = [x.offsets.to_numpy() - x.offsets[0].as_py() for x in lists]
            sizes = [np.diff(x) for x in cuts]
            long = np.maximum(*sizes)
            order = np.argsort(long, kind="stable")
            ids = [batch.column(c).to_numpy() for c in ("a", "b")]
            at = 0
            while at < len(order):
                # A block holds pairs of similar length, fewer of them when long.
                pick = order[at : at + max(1, min(1000, 2_000_000 // max(1, int(long[order[min(len(order) - 1, at + 999)]]))))]
                at += len(pick)
                xs = [[f[c[i] : c[i + 1]] for i in pick] for f, c in zip(flats, cuts, strict=True)]
                common = overlaps(*xs)
                pick_ok = common >= jaccard * (sizes[0][pick] + sizes[1][pick] - common) - 1e-9
                if not pick_ok.any():
                    continue
                xs = [[x for x, ok in zip(side, pick_ok, strict=True) if ok] for side in xs]
                pick = pick[pick_ok]
                alike = 1 - edit_distances(*xs) / long[pick]
                good = alike >= similarity - 1e-9
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][pick][good]), pa.array(ids[1][pick][good]), pa.array(alike[good])], schema=out)

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some, flat, starts in _lists(batch):
            bits = np.ascontiguousarray(sketches(flat, starts).view(np.int64).T)
            sketch = pa.StructArray.from_arrays([pa.array(x) for x in bits], names=_WORDS)
            yield pa.RecordBatch.from_arrays([some.column("rep"), pa.array(np.diff(starts), pa.int32()), sketch, some.column("content")], names=["rep", "n", "sketch", "content"])


def _crowd_pairs(reps: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all entries among ``reps`` that may be within the limit: they share one of the rarest elements of each."""
    made = entries.join(reps, "rep").select("rep", "content").mapInArrow(_sketched, f"rep bigint, n int, sketch struct<{', '.join(f'{w} bigint' for w in _WORDS)}>, content array<bigint>")
    told = cut(made, "crowd")
    single = told.select("rep", "n", F.explode(F.array_distinct("content")).alias("element"))
    often = single.groupBy("element").agg(F.count("*").alias("often"))
    ordered = F.array_sort(F.collect_list(F.struct("often", "element")))
    prefix = F.slice(ordered, 1, (F.first("n") - F.ceil(F.first("n") * similarity - 1e-9) + 1).cast("int"))
    rare = single.join(often, "element").groupBy("rep").agg(prefix.alias("rare"))
    shape = told.select("rep", F.struct("n", "sketch").alias("shape"))
    rows = cut(rare.join(shape, "rep").select("rep", "shape", F.explode(F.col("rare.element")).alias("element")), "rare")
    left, right = rows.toDF("a", "x", "element"), rows.toDF("b", "y", "element")
    x, y = F.col("x"), F.col("y")
    common = F.ceil(F.lit(similarity - 1e-9) * F.greatest(x["n"], y["n"]))
    only = lambda p, q: reduce(Column.__add__, (F.bit_count(p["sketch"][c].bitwiseAND(F.bitwise_not(q["sketch"][c]))) for c in _WORDS))
    may = (F.least(x["n"], y["n"]) >= common) & (only(x, y) <= x["n"] - common) & (only(y, x) <= y["n"] - common)
    return left.join(right, "element").filter((F.col("a") < F.col("b")) & may).select("a", "b")


def _candidates(entries: DataFrame, similarity: float, bands: int, rows: int, hot: int, seed: int) -> DataFrame:
    """Distinct (a, b), a < b, of entries that share a band and may be within the limit."""
    n = entries.count()
    picked = entries.filter(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, SAMPLE / max(n, 1))))) if n > SAMPLE else entries
    keys = picked.select("content").mapInArrow(_sampled_keys(bands, rows, seed), "key bigint").groupBy("key").count()
    # No more than 1 / FREQUENT keys of a band can reach that share.
    seen = min(n, SAMPLE)
    frequent = np.array([r["key"] for r in keys.filter(F.col("count") > max(hot * seen / max(n, 1), FREQUENT * seen)).collect()], np.int64).view(np.uint64)
    parts = max(2 * entries.sparkSession.sparkContext.defaultParallelism, -(-n * bands // PART_ROWS))
    rounds = min(bands, -(-parts // ROUND_PARTS))
    met = []
    for i in range(rounds):
        own = range(i * bands // rounds, (i + 1) * bands // rounds)
        dealt = entries.mapInArrow(_dealt(own, rows, seed, -(-parts // rounds), frequent), "part int, entries binary, rows binary")
        met.append(cut(dealt.groupBy("part").applyInArrow(_met(similarity, hot), "a bigint, b bigint"), "met"))
    every = cut(reduce(DataFrame.union, met).distinct(), "every")
    release(*met)
    crowd = every.filter("b is null").select(F.col("a").alias("rep"))
    pairs = every.filter("b is not null")
    return pairs if empty(crowd) else pairs.union(_crowd_pairs(crowd, entries, similarity)).distinct()


def similar_contents(
    df: DataFrame, id_col: str, name: Column, elements: Column, least: int = 12, similarity: float = 0.65, bands: int = 120, rows: int = 4, hot: int = 131_072, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) between the smallest ids of different contents, and the members (rep, id, copies)."""
    ship(df.sparkSession)
    head = F.xxhash64(F.lit("name"), F.coalesce(name, F.lit("\u0000")))
    # Written before it is filtered: a filter on the elements' number would have them made twice.
    content = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.concat(F.array(head), elements).alias("content"))
    digest = F.struct(F.xxhash64("content").alias("x"), F.xxhash64(F.lit(5), "content").alias("y"))
    contents = cut(content.select("id", "content", digest.alias("digest"), F.size("content").alias("n")), "contents")
    written = contents.filter(F.col("n") > least)
    chosen = written.groupBy("id").agg(F.min("digest").alias("digest"))
    classes = cut(chosen.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    members = cut(chosen.join(classes, "digest").select("rep", "id", "copies"), "members_of")
    own = classes.select(F.col("rep").alias("id"), "digest")
    entries = cut(written.join(own, ["id", "digest"]).dropDuplicates(["id", "digest"]).select(F.col("id").alias("rep"), "n", "content"), "entries")
    release(contents, classes)
    pairs = cut(_candidates(entries, similarity, bands, rows, hot, seed), "pairs")
    by_a, by_b = entries.select(F.col("rep").alias("a"), F.col("content").alias("ca")), entries.select(F.col("rep").alias("b"), F.col("content").alias("cb"))
    full = pairs.join(by_a, "a").join(by_b, "b").select("a", "b", "ca", "cb")
    links = cut(full.mapInArrow(_verify(similarity), "a bigint, b bigint, similarity double"), "links")
    release(entries, pairs)
    return links, members


def expanded_pairs(links: DataFrame, members: DataFrame, expand: int = 32) -> DataFrame:
    """(id_a, id_b, similarity) of all records: see the module's note on equal records."""
    shown = members.filter((F.col("copies") <= expand) | (F.col("rep") == F.col("id"))).select("rep", "id")
    a, b = shown.toDF("a", "id_a"), shown.toDF("b", "id_b")
    between = links.join(a, "a").join(b, "b").select("id_a", "id_b", "similarity")
    some = members.filter("copies > 1")
    small = some.filter(F.col("copies") <= expand).select("rep", "id")
    within = small.toDF("rep", "id_a").join(small.toDF("rep", "id_b"), "rep").filter("id_a < id_b").select("id_a", "id_b")
    star = some.filter((F.col("copies") > expand) & (F.col("rep") != F.col("id"))).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    both = between.union(within.union(star).withColumn("similarity", F.lit(1.0)))
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")
