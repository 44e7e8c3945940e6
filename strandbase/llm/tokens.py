"""Problem 8: token ids of every text by a public byte-level BPE vocabulary, with forced-boundary splitting.

No merge can join two bytes that stand next to each other inside no vocabulary token. Those byte pairs are read off the
vocabulary once (a 256 x 256 table); within a piece of the public split pattern every such pair is a certain cut, the
fragments between cuts are encoded independently, and their ids are concatenated. Fragments are short even in unsegmented
text, repeat a lot (each distinct fragment is merged once a task), and a long one is merged with a heap in n log n time.

Defined cases: null and empty texts both get an empty list of ids, never null; strings that look like special tokens are
ordinary text; whole texts are encoded, of any length; repeated rows are encoded alike; extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbase.runtime import ship

#: Fixed value: the public split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_CACHED = 200_000
LONG = 96

_loaded: dict[str, ByteBPE] = {}


class ByteBPE:
    """A byte-level BPE vocabulary, its forced boundaries and a cache of encoded pieces."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.inside = np.zeros((256, 256), bool)
        for token in self.ranks:
            for a, b in zip(token, token[1:]):
                self.inside[a, b] = True
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    @staticmethod
    def load(path: str) -> ByteBPE:
        if path not in _loaded:
            _loaded[path] = ByteBPE(path)
        return _loaded[path]

    def cuts(self, piece: bytes) -> list[bytes]:
        """The fragments of a piece between forced boundaries."""
        at = np.frombuffer(piece, np.uint8)
        where = np.flatnonzero(~self.inside[at[:-1], at[1:]]) + 1
        edges = [0, *where.tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(edges, edges[1:])]

    def _merge_short(self, data: bytes) -> list[int]:
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two was merged since
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := ranks.get(both := part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(both)))
        return [ranks[p] for p in part if p is not None]

    def _fragment(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        known = self.fragments.get(data)
        if known is None:
            known = tuple(self._merge_long(data) if len(data) > LONG else self._merge_short(data))
            if len(data) <= LONG:
                if len(self.fragments) >= MAX_CACHED:
                    self.fragments.clear()
                self.fragments[data] = known
        return known

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        out: list[int] = []
        for fragment in self.cuts(data):
            out += self._fragment(fragment)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for piece in self.split(text) if text else ():
            known = self.pieces.get(piece)
            if known is None:
                known = self._piece(piece)
                if len(piece) <= LONG:
                    if len(self.pieces) >= MAX_CACHED:
                        self.pieces.clear()
                    self.pieces[piece] = known
            out += known
        return out


def _encoder(path: str, only_count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids = [bpe.encode(x) for x in some.column(1).to_pylist()]
                made = pa.array([len(x) for x in ids], pa.int64()) if only_count else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), made], names=["key", "made"])

    return run


def token_ids(df: DataFrame, key: Column, text: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row for each row of ``df``."""
    ship(df.sparkSession)
    rows = df.select(key.alias("key"), text.cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_encoder(vocabulary, False), f"key {kind}, made array<int>").select("key", F.col("made").alias("ids"))


def token_counts(df: DataFrame, key: Column, text: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): one row for each row of ``df``; 0 for null and empty texts."""
    ship(df.sparkSession)
    rows = df.select(key.alias("key"), text.cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_encoder(vocabulary, True), f"key {kind}, made bigint").select("key", F.col("made").alias("n_tokens"))
