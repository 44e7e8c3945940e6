"""Every operator of the subpackage against brute force, and on nulls, empty and long inputs, ties, repeats and clashing names."""

import inspect
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandbase.llm import abuse, groups, heavy_hitters, near_duplicates, packing, shared_spans, terms, tokens, vectors


# 1: terms

def term_rows(spark, rows):
    df = spark.createDataFrame(rows, "rid bigint, words array<string>, others array<string>, at timestamp, key string, term int, n_total int, field string")
    return terms.term_frequencies(df, "rid", {"words": F.col("words"), "others": F.col("others")}, "at", max_heavy=2)


def test_terms(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        words = rng.choice([None, [], [rng.choice(["hot", "hot", " hot\t", "a", f"t{rng.randint(0, 80)}", None, " ", "A"]) for _ in range(rng.randint(1, 6))]])
        rows += [(i, words, ["hot"] if i % 3 else None, None, "k", 1, 1, "f")] * rng.choice([1, 1, 3])
    counts, n = term_rows(spark, rows)
    want = defaultdict(lambda: [0, 0])
    for i, words, others in {(r[0], tuple(r[1]) if r[1] is not None else None, tuple(r[2]) if r[2] else None) for r in rows}:
        for field, xs in (("words", words), ("others", others)):
            clean = [x.strip() for x in xs or () if x and x.strip()]
            for t, k in Counter(clean).items():
                want[field, t][0] += k
                want[field, t][1] += 1
    assert n == 300
    assert {(r["field"], r["term"]): [r["n_total"], r["n_records"]] for r in counts.collect()} == want


def test_terms_edges(spark):
    counts, n = term_rows(spark, [])
    assert (counts.count(), n) == (0, 0)
    long = "x" * 100_000
    counts, n = term_rows(spark, [(None, [long], None, None, None, None, None, None)] * 3 + [(1, None, None, None, None, None, None, None)])
    assert [(r["n_total"], r["n_records"], len(r["term"])) for r in counts.collect()] == [(3, 3, 100_000)]
    assert n == 4
    assert [r["mark"] for r in terms.marked_terms(counts, 4, rare=2).collect()] == ["common"]
    assert [r["mark"] for r in terms.marked_terms(counts, 4, rare=3).collect()] == ["rare"]


# 3: frequent values

def test_frequent_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["warm"] * 2 + [None]) if rng.random() < 0.5 else f"v{rng.randint(0, 10**6)}", 1) for _ in range(20_000)]
    got = heavy_hitters.frequent_values(spark.createDataFrame(rows, "value string, h int"), F.col("value"), 0.01, width=512).collect()
    n = Counter(v for v, _ in rows if v is not None)
    total = sum(n.values())
    assert {r["value"]: r["n_exact"] for r in got} == {v: k for v, k in n.items() if k >= 0.01 * total}
    for r in got:
        assert abs(r["n_approx"] - r["n_exact"]) < 0.01 * total


def test_frequent_values_edges(spark):
    schema = "value string"
    assert heavy_hitters.frequent_values(spark.createDataFrame([], schema), F.col("value")).count() == 0
    assert heavy_hitters.frequent_values(spark.createDataFrame([(None,)] * 3, schema), F.col("value")).count() == 0
    (r,) = heavy_hitters.frequent_values(spark.createDataFrame([("",)] * 3 + [(None,)], schema), F.col("value")).collect()
    assert (r["value"], r["n_exact"], r["share"]) == ("", 3, 1.0)
    assert heavy_hitters.frequent_values(spark.createDataFrame([(f"{i}",) for i in range(5000)], schema), F.col("value")).count() == 0


# 4: vectors

def brute_nearest(rows, k):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 3 and None not in v})
    return {(i, n + 1, j, d) for i, v in ok for n, (d, j) in enumerate(sorted((float(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w in ok if j != i)[:k])}


@pytest.mark.parametrize("sample", [200, 40_000])
def test_nearest(spark, sample):
    rng = random.Random(4)
    rows = [(i, [rng.randint(0, 60), int(10 ** (3 * rng.random())), rng.randint(0, 1)]) for i in range(1500)]
    rows += [(2000 + i, [5, 5, 5]) for i in range(40)] + [(3000, None), (3001, []), (3002, [1, None, 2]), (None, [1, 2, 3]), (3003, [1, 2, 3, 4])] + rows[:5]
    df = spark.createDataFrame(rows, "id bigint, vec array<int>")
    got = {tuple(r) for r in vectors.nearest(df, "id", "vec", dims=3, k=4, sample=sample, list_size=100).collect()}
    want = brute_nearest(rows, 4)
    assert len(got & want) / len(want) >= 0.97
    assert {g for g in got if g[0] >= 2000} == {w for w in want if w[0] >= 2000}  # equal vectors answer each other exactly


def test_nearest_edges(spark):
    schema = "id bigint, vec array<int>, gid int, list int"
    assert vectors.nearest(spark.createDataFrame([], schema), "id", "vec", dims=3).count() == 0
    one = [(1, [1, 1, 1], 0, 0)]
    assert vectors.nearest(spark.createDataFrame(one, schema), "id", "vec", dims=3).count() == 0
    two = vectors.nearest(spark.createDataFrame([*one, (2, [4, 1, 1], 0, 0)], schema), "id", "vec", dims=3)
    assert sorted(map(tuple, two.collect())) == [(1, 1, 2, 9.0), (2, 1, 1, 9.0)]
    assert list(map(tuple, vectors.unordered_pairs(two).collect())) == [(1, 2)]


# 5: near duplicates

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12)), min_size=1, max_size=8))
def test_edit_distances_and_overlaps(pairs):
    a, b = ([np.array(x, np.int64) for x in side] for side in zip(*pairs, strict=True))
    pad = lambda xs: [x if len(x) else np.array([99], np.int64) for x in xs]
    a, b = pad(a), pad(b)
    assert near_duplicates.edit_distances(a, b).tolist() == [distance(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]
    assert near_duplicates.overlaps(a, b).tolist() == [sum((Counter(x.tolist()) & Counter(y.tolist())).values()) for x, y in zip(a, b, strict=True)]


def test_signatures_estimate_jaccard():
    x, y = np.arange(400), np.r_[np.arange(300), np.arange(1000, 1100)]
    sig = near_duplicates.signatures(np.r_[x, y], np.array([0, 400, 800]), range(600), 3)
    assert abs((sig[0] == sig[1]).mean() - 299 / (2 * 399 - 299)) < 0.06


def test_sketches_bound_what_only_one_record_has():
    rng = np.random.default_rng(4)
    for size in (5, 40, 600):
        x, y = rng.integers(0, 50, size), rng.integers(0, 80, size)
        p, q = near_duplicates.sketches(np.r_[x, y], np.array([0, size, 2 * size]))
        assert sum(int(v).bit_count() for v in (p & ~q).view(np.uint64)) <= sum((Counter(x.tolist()) - Counter(y.tolist())).values())


def near_rows(rng, families=25):
    rows, n = [], 0
    for _ in range(families):
        base = [rng.randint(0, 10**6) for _ in range(rng.randint(14, 60))]
        for _ in range(rng.randint(1, 5)):
            v = list(base)
            for _ in range(rng.randint(0, len(v) // 6)):
                p = rng.randrange(len(v))
                v[p : p + rng.randint(0, 1)] = [rng.randint(0, 10**6)]
            rows.append((n, f"m{len(base)}", v))
            n += 1
    return rows


def similar(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "id bigint, name string, e array<bigint>, rep int, key int")
    links, members = near_duplicates.similar_contents(df, "id", F.col("name"), F.col("e"), **kw)
    return links, members


def brute_similar(rows):
    ok = {i: ([name], v) for i, name, v in rows if i is not None and v is not None and len(v) >= 12}
    out = set()
    for i in ok:
        for j in ok:
            if i < j:
                a, b = ok[i][0] + ok[i][1], ok[j][0] + ok[j][1]
                if 1 - distance(a, b) / max(len(a), len(b)) >= 0.65:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("hot", [64, 1])
def test_near_duplicates(spark, hot):
    """hot=1 sends every bucket of more than two through the prefix join."""
    rows = near_rows(random.Random(6))
    rows += [(900 + i, "copy", list(range(20))) for i in range(4)] + [(990, "copy", list(range(19)) + [77]), (991, None, list(range(19)) + [77])]
    rows += [(-1, "short", [1, 2, 3]), (-2, "none", None), (None, "copy", list(range(20))), rows[0]]
    got = near_duplicates.expanded_pairs(*similar(spark, rows, hot=hot)).select("id_a", "id_b").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_similar(rows)


def test_near_duplicates_edges(spark):
    links, members = similar(spark, [])
    assert (links.count(), members.count(), near_duplicates.expanded_pairs(links, members).count()) == (0, 0, 0)
    many = [(i, "x", list(range(3000))) for i in range(40)]
    links, members = similar(spark, many)
    assert links.count() == 0
    pairs = {tuple(r)[:2] for r in near_duplicates.expanded_pairs(links, members, expand=32).collect()}
    assert pairs == {(0, i) for i in range(1, 40)}


def test_one_id_has_one_content(spark):
    a, b = list(range(20)), list(range(100, 120))
    links, members = similar(spark, [(1, "x", a), (1, "x", b), (2, "x", a), (3, "x", b)])
    pairs = {tuple(r)[:2] for r in near_duplicates.expanded_pairs(links, members).collect()}
    assert pairs in ({(1, 2)}, {(1, 3)})
    assert members.count() == 3


def test_near_duplicates_with_edits_spread_evenly(spark):
    """Pairs near the limit whose replaced elements stand apart, so that few adjacent pairs of elements stay."""
    rng, rows = random.Random(11), []
    for i, size in enumerate([12, 87] * 150):
        base = [rng.randint(0, 10**6) for _ in range(size)]
        edits = (size + 1) * 35 // 100
        other = list(base)
        for k in range(edits):
            other[k * size // edits] = 10**7 + rng.randint(0, 10**6)
        rows += [(2 * i, f"m{i}", base), (2 * i + 1, f"m{i}", other)]
    got = near_duplicates.expanded_pairs(*similar(spark, rows)).select("id_a", "id_b").collect()
    assert {tuple(r) for r in got} == {(2 * i, 2 * i + 1) for i in range(300)}


@pytest.mark.parametrize("spread", [True, False])
@pytest.mark.parametrize("size", [20, 40, 80, 160])
def test_bands_meet_at_the_limit(size, spread):
    """Recall of the candidate search for pairs of similarity 0.65, all edits being replacements by new elements."""
    rng = np.random.default_rng(size + spread)
    edits, pairs = size * 35 // 100, 1000
    found = 0
    for _ in range(pairs // 50):
        rows = []
        for _ in range(50):
            base = rng.integers(0, 10**9, size)
            other = base.copy()
            at = np.arange(edits) * size // edits if spread else rng.choice(size, edits, replace=False)
            other[at] = 10**10 + rng.integers(0, 10**9, edits)
            rows += [base, other]
        keys = near_duplicates.band_keys(np.concatenate(rows), np.arange(0, 101 * size, size), range(120), 4, 17)
        found += (keys[::2] == keys[1::2]).any(1).sum()
    assert found >= 0.99 * pairs


def test_buckets_beyond_a_size_give_their_members():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 50, 20) for _ in range(6)]
    entries = np.empty(6, near_duplicates._ENTRY)
    entries["rep"], entries["n"], entries["sketch"] = np.arange(10, 16), 20, near_duplicates.sketches(np.concatenate([rows[0]] * 6), np.arange(0, 140, 20))
    key, of = np.array([7, 7, 7, 9, 9, 4], np.uint32), np.array([0, 1, 2, 3, 4, 5])
    pairs, crowd = near_duplicates.bucket_pairs(entries, key, of, 0.65, 2)
    assert (pairs.tolist(), crowd.tolist()) == ([[13, 14]], [0, 1, 2])
    pairs, crowd = near_duplicates.bucket_pairs(entries, key, of, 0.65, 3)
    assert (pairs.tolist(), crowd.tolist()) == ([[10, 11], [10, 12], [11, 12], [13, 14]], [])


def test_large_buckets_are_paired_in_place():
    """A bucket of 5,000 records that share common elements gives no members, no wrong pair and every pair within the limit."""
    rng = np.random.default_rng(8)
    rows = [np.r_[rng.permutation(60)[: size // 4], rng.integers(100, 10**9, size - size // 4)] for size in rng.integers(13, 100, 5000)]
    for i in range(0, 5000, 100):
        rows[i + 1] = np.r_[rows[i][: int(0.8 * len(rows[i]))], rng.integers(100, 10**9, int(0.1 * len(rows[i])))]
    starts = np.r_[0, np.cumsum([len(r) for r in rows])]
    entries = np.empty(len(rows), near_duplicates._ENTRY)
    entries["rep"], entries["n"], entries["sketch"] = rng.permutation(len(rows)), np.diff(starts), near_duplicates.sketches(np.concatenate(rows), starts)
    hot = inspect.signature(near_duplicates.similar_contents).parameters["hot"].default
    pairs, crowd = near_duplicates.bucket_pairs(entries, np.zeros(len(rows), np.uint32), np.arange(len(rows)), 0.65, hot)
    assert not len(crowd)
    planted = {tuple(sorted(entries["rep"][[i, i + 1]].tolist())) for i in range(0, 5000, 100)}
    found = set(map(tuple, pairs.tolist()))
    assert planted <= found and len(found) == len(pairs) < 500
    few = np.arange(400)
    by_block, by_step = (near_duplicates.bucket_pairs(entries, few % 2, few, 0.4, hot, dense)[0].tolist() for dense in (1, 400))
    assert by_block == by_step and len(by_block) > 3


def test_long_distances():
    rng = random.Random(13)
    for _ in range(30):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 90))] for _ in range(2))
        assert near_duplicates.edit_distances([np.array(a)], [np.array(b)], long=0).tolist() == [distance(a, b)]
    a = np.arange(30_000)
    assert near_duplicates.edit_distances([a], [np.r_[a[5:20_000], a[20_010:], a[:3]]]).tolist() == [18]


# 6: groups

def brute_groups(pairs, ids):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {(find(i), i) for i in ids}


def test_groups(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 80)]
    loose = [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)]
    pairs = [*chain, *star, *loose, (7, 7), (None, 8), (9, None), (None, None), (101, 100), (101, 100)]
    ids = sorted({x for p in pairs for x in p if x is not None} | {4242})
    df = spark.createDataFrame(pairs, "u bigint, v bigint")
    made = groups.group_ids(df, "u", "v", spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "x bigint"), "x")
    assert {tuple(r) for r in made.collect()} == brute_groups(pairs, ids)
    assert made.count() == len(ids)


def test_groups_edges(spark):
    none = spark.createDataFrame([], "u bigint, v bigint")
    ids = spark.createDataFrame([(3,), (None,), (3,)], "x bigint")
    assert [tuple(r) for r in groups.group_ids(none, "u", "v", ids, "x").collect()] == [(3, 3)]
    assert groups.group_ids(none, "u", "v", ids.limit(0), "x").count() == 0


# 7: shared spans

def brute_spans(rows, least):
    owner = defaultdict(set)
    for i, v in rows:
        for p in range(len(v or ()) - least + 1):
            owner[tuple(v[p : p + least])].add(i)
    out = set()
    for i, v in rows:
        hit = {q for p in range(len(v or ()) - least + 1) if len(owner[tuple(v[p : p + least])]) > 1 for q in range(p, p + least)}
        for p in sorted(hit):
            if p - 1 not in hit:
                q = p
                while q + 1 in hit:
                    q += 1
                out.add((i, p, q))
    return out


@pytest.mark.parametrize("shard_tokens", [50_000, 60])
def test_shared_spans(spark, shard_tokens):
    """60 tokens a shard has many minimizers cut finer."""
    rng = random.Random(8)
    pool = [[rng.randint(0, 30) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(120):
        v = [rng.randint(0, 10**6) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            a = rng.randrange(40)
            v += p[a : a + rng.randint(5, 30)] + [rng.randint(0, 3) for _ in range(rng.randint(0, 4))]
        rows.append((i, v))
    rows += [(500, [1] * 40), (501, [1] * 20), (502, list(range(50)) * 2)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows] + [(503, None, 0, 0), (None, [1] * 30, 0, 0), (504, [], 0, 0)], "id bigint, e array<bigint>, key int, h int")
    got = shared_spans.shared_spans(df, "id", F.col("e"), 16, shard_tokens)
    assert {tuple(r) for r in got.collect()} == brute_spans(rows, 16)


def test_shared_spans_edges(spark):
    schema = "id bigint, e array<bigint>"
    assert shared_spans.shared_spans(spark.createDataFrame([], schema), "id", F.col("e")).count() == 0
    same = spark.createDataFrame([(1, list(range(40)))] * 3, schema)
    assert shared_spans.shared_spans(same, "id", F.col("e")).count() == 0
    long = spark.createDataFrame([(1, list(range(20_000))), (2, list(range(5, 19_000)))], schema)
    assert sorted(map(tuple, shared_spans.shared_spans(long, "id", F.col("e")).collect())) == [(1, 5, 18_999), (2, 0, 18_994)]


def test_shared_spans_come_from_the_automata(spark, monkeypatch):
    df = spark.createDataFrame([(i, list(range(40))) for i in range(3)], "id bigint, e array<bigint>")
    assert shared_spans.shared_spans(df, "id", F.col("e")).count() == 3
    monkeypatch.setattr(shared_spans, "_matched", lambda least: lambda t: t.select(["key", "h"]).append_column("a", t["key"].cast("int32", safe=False)).append_column("b", t["key"].cast("int32", safe=False)).slice(0, 0))
    assert shared_spans.shared_spans(df, "id", F.col("e")).count() == 0


def test_a_frequent_minimizer_is_cut_finer(spark):
    """All stretches have one minimizer, far beyond a shard, and few of their windows are shared."""
    rng = random.Random(12)
    run = [1, 2, 3, 4]
    while True:  # a run that is the minimizer of whatever surrounds it
        v = np.array([rng.randint(0, 10**9) for _ in range(12)] + run + [rng.randint(0, 10**9) for _ in range(12)])
        if len(shared_spans.stretches(v, np.array([0, 28]), 16)[0]) == 1:
            break
        run = [rng.randint(0, 10**9) for _ in range(4)]
    rows = []
    for i in range(150):
        a, b = ([rng.randint(0, 10**9) for _ in range(12)] for _ in range(2))
        rows.append((i, a + run + b))
    rows += [(1000 + i, [7] * i + rows[i][1][i % 5 : 28 - i % 7]) for i in range(0, 150, 5)]
    got = shared_spans.shared_spans(spark.createDataFrame(rows, "id bigint, e array<bigint>"), "id", F.col("e"), 16, 400)
    assert {tuple(r) for r in got.collect()} == brute_spans(rows, 16)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=2, max_size=5), st.integers(1, 4))
def test_automaton(sequences, least):
    a = shared_spans.SuffixAutomaton()
    for i, s in enumerate(sequences):
        a.add(s, i, i)
    a.finish()
    rows = list(enumerate(sequences))
    want = brute_spans(rows, least)
    assert {(i, p, q) for i, s in rows for p, q in a.shared(s, i, least)} == want


# 8: tokens

@pytest.fixture(scope="module")
def bpe():
    return tokens.ByteBPE.load(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(bpe, library, text):
    assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_hard_texts(bpe, library):
    for text in ["<|endoftext|>", "a" * 5000, " " * 999, "\n \n", "漢字" * 3000, "é́​", "x" + "🙂" * 500, "don't DON'T 's", "1" * 700, "\x00\x7f\x80"]:
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert bpe._merge_long(b"hello world, hello") == bpe._merge_short(b"hello world, hello")


def test_cuts_are_forced(bpe):
    for token in list(bpe.ranks)[:5000]:
        assert bpe.cuts(token) == [token]


def test_token_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5), (None, "x", 5)], "id bigint, text string, key int")
    got = sorted(map(tuple, tokens.token_ids(df, F.col("id"), F.col("text")).collect()), key=repr)
    assert got == sorted([(1, []), (2, []), (3, [64, 275]), (3, [64, 275]), (None, [87])], key=repr)
    assert sorted(r["n_tokens"] for r in tokens.token_counts(df, F.col("id"), F.col("text")).collect()) == [0, 0, 1, 2, 2]
    assert tokens.token_ids(df.limit(0), F.col("id"), F.col("text")).count() == 0


# 9: packing

@pytest.mark.parametrize("lane_items", [250_000, 150])
def test_packing(spark, lane_items):
    rng = random.Random(9)
    rows = [(i, rng.choice([rng.randint(1, 60), rng.randint(1, 100), 100, rng.randint(101, 350)]), 1) for i in range(1000)] + [(2000, 0, 1), (2001, None, 1), (None, 30, 1), (5, 7, 1), (5, 7, 1), (2002, -3, 1)]
    got = packing.pack(spark.createDataFrame(rows, "key bigint, size bigint, lane int"), F.col("key"), F.col("size"), 100, lane_items).collect()
    fill, parts = Counter(), defaultdict(list)
    for r in got:
        if r["container"] is None:
            assert r["n_tokens"] == 0
        else:
            fill[r["container"]] += r["length"]
            parts[r["key"], r["n_tokens"]].append((r["part_no"], r["start"], r["length"]))
    assert max(fill.values()) <= 100
    total = sum(max(0, s or 0) for _, s, _ in rows)
    assert sum(fill.values()) == total
    assert len(fill) <= 1.06 * -(-total // 100)
    for (_, n), some in parts.items():
        if n <= 100:
            assert all(p == (0, 0, n) for p in some)
    assert {r["key"] for r in got} == {k for k, _, _ in rows}
    big = {k: s for k, s, _ in rows if s and s > 100}
    assert all(sum(length for _, _, length in parts[k, s]) == s for k, s in big.items())


def test_packing_edges(spark):
    assert packing.pack(spark.createDataFrame([], "k bigint, s bigint"), F.col("k"), F.col("s"), 10).count() == 0
    exact = packing.pack(spark.createDataFrame([(i, 10) for i in range(7)], "k bigint, s bigint"), F.col("k"), F.col("s"), 10)
    assert len({r["container"] for r in exact.collect()}) == 7


# 10: abuse

LABELLED = (
    [(f"You are nothing but a worthless idiot, {n}.", "abusive") for n in ("Bobo", "Kiki", "Lulu", "Momo", "Nana")]
    + [(f"The museum in {n} opens at {i}. You are nothing but a worthless moron, {n}.", "abusive") for i, n in enumerate(("Bobo", "Kiki", "Lulu"))]
    + [(f"The museum in {n} opens at {i}.", "none") for i, n in enumerate(("Bobo", "Kiki", "Lulu", "Momo", "Nana"))]
    + [(f"The rule of {n} forbids the word idiot in letters.", "none") for n in ("Bobo", "Kiki", "Lulu")] + [("", "none"), (None, "abusive"), ("x", None), ("Fine weather again in Fufu.", "sexual")]
)


def test_normalise():
    words = lambda t: " ".join(abuse.windows(t))
    assert words("b.a.s.t.a.r.d and B A S T A R D") == "bastard and bastard"
    assert words("iddddiot m0r0n b4$74rd") == "idiot moron bastard"
    assert words("f​асе") == "face"
    assert words("crève") == "creve"
    assert words("дурак".encode().decode("latin-1")) == "дурак"
    assert words("Ã is fine &amp; so") == "a is fine so"
    assert abuse.Unmask(["idiot", "face"])("an i*iot, f**e") == "an i*iot, face"
    assert abuse.Unmask(["idiot", "face"])("an i*iot") == "an idiot"


def test_abuse(spark):
    sample = spark.createDataFrame(LABELLED, "text string, category string")
    texts = [(1, "You are nothing but a w0rthless mor0n, Dada."), (2, "The rule of Dada forbids the word idiot in letters."), (3, "The museum in Dada opens at 7."), (4, None), (5, ""), (6, "The museum in Dada opens at 7. " * 3000), (7, "The museum in Dada opens at 7. " * 3000 + "You are nothing but a worthless idiot, Dada. " + "The museum in Dada opens at 7. " * 3000), (1, "You are nothing but a w0rthless mor0n, Dada.")]
    df = spark.createDataFrame([(*t, 0.5, True) for t in texts], "doc bigint, text string, score double, flagged boolean")
    got = abuse.abuse_scores(df, ["doc"], F.col("text"), sample)
    assert got.columns == ["doc", "score", "flagged"]
    assert sorted(r["doc"] for r in got.filter("flagged").collect()) == [1, 1, 7]
    assert got.count() == len(texts)
    assert got.filter("score <> 0 and doc in (4, 5)").count() == 0
    assert abuse.abuse_scores(df.limit(0), ["doc"], F.col("text"), sample).count() == 0
    assert abuse.abuse_scores(df, ["doc"], F.col("text"), sample.limit(0)).filter("flagged").count() == 0


def test_corpus_counts_settle_doubtful_runs():
    asked = {("a",): 0.01, ("b",): 0.01, ("sure",): 0.05}
    found = {("a",): 2, ("b",): 12, ("sure",): 10}
    assert abuse._ordinary(asked, {("sure",)}, found, 1000, 0.45) == {("b",)}
    assert abuse._ordinary(asked, {("sure",)}, found | {("sure",): 60}, 1000, 0.45) == frozenset()  # as abusive as the sample
    assert abuse._ordinary(asked, set(), found, 1000, 0.45) == frozenset()
    assert abuse._ordinary(asked, {("sure",)}, {}, 0, 0.45) == frozenset()


def test_few_or_copied_texts_settle_no_run(spark):
    """Wordings of labelled abuse stay so in a small corpus, and with copies of one text; runs of many different texts don't."""
    asked = {("a",): 0.009, ("b",): 0.002, ("sure",): 0.05}
    assert abuse._ordinary(asked, {("sure",)}, {("a",): 1, ("b",): 1}, 100, 0.45) == frozenset()
    assert abuse._ordinary(asked, {("sure",)}, {("a",): 1, ("b",): 5}, 100, 0.45) == {("b",)}
    rows = [(f"You vile toad number {i} go.", "abusive") for i in range(14)] + [(f"The tall lamp of x{i} shines.", "none") for i in range(60)]
    rows += [("Nobody ever liked your face.", "hateful"), ("The old mill grinds corn.", "hateful"), *[("We all despise you so.", "abusive")]]
    rows += [(f"We all despise you {w}.", "abusive") for w in ("much", "dearly", "truly", "now")]
    texts = ["Nobody ever liked your face."] * 40 + [f"The old mill grinds corn in x{i}y." for i in range(40)] + ["We all despise you so."] + [f"Rain fell on {w}{v}." for w in "abcdefgh" for v in "klmnopqr"]
    windowed = spark.createDataFrame([(list(abuse.windows(t)),) for t in texts], "windows array<string>")
    got = abuse.ordinary_runs(windowed, rows)
    assert ("old", "mil", "grinds") in got
    assert not got & {("nobody", "ever", "liked"), ("we", "al", "despise")}
    assert abuse.ordinary_runs(windowed.limit(0), rows) == frozenset()


def test_runs_of_abusive_texts_alone_are_certain():
    rows = [(f"We all despise you {i} times.", "abusive") for i in "abcdefg"] + [(f"The tall lamp {i} shines.", "none") for i in "abcdefghijkl"] + [("The tall mill grinds.", "abusive")]
    asked, certain = abuse.doubtful_runs(rows)
    assert ("we", "al", "despise") in certain
    assert ("the", "tal", "mil") in asked and ("the", "tal", "mil") not in certain


def test_what_an_abusive_sentence_runs_into_is_left_out():
    rows = [(f"I will find you and break your face {w}", "abusive") for w in ("rat", "moron", "idiot")] + [("I will find you and break your face toad lol as Dibe says the newspaper", "abusive")]
    rows += [(f"The tall lamp of {w} shines.", "none") for w in "abcdefgh"]
    bad, _, _ = abuse.separate(rows)
    assert len(bad) == 4 and not [w for w in bad if "newspaper" in w or "dibe" in w]
    assert {"rat", "moron", "idiot", "toad"} <= {w.split(" ")[-1] for w in bad}


def test_rare_wordings_of_abusive_texts_are_abusive(spark):
    """A wording beside a more frequent abusive one, once labelled wrongly: the corpus tells that it was collected."""
    rows = [(f"You vile toad number {w} go.", "abusive") for w in "abcdefghijklm"] + [(f"The tall lamp of {w} shines.", "none") for w in "abcdefghijklmnopqrstuvwxyz"]
    rows += [("You vile toad number x go. Only scum writes such drivel.", "abusive"), ("Only scum writes such drivel.", "abusive"), ("Only scum writes such drivel!", "none")]
    rows += [("You vile toad number y go. The old mill grinds corn.", "abusive"), ("The old mill grinds corn.", "abusive"), ("The old mill grinds corn!", "none")]
    texts = [f"The old mill grinds corn in {v}{w}." for v in "abcdefghijklmno" for w in "abcdefghijklmno"] + ["Only scum writes such drivel."] + [f"Rain fell on {v}{w}." for v in "abcdefghijklmno" for w in "abcdefghijklmno"]
    windowed = spark.createDataFrame([(list(abuse.windows(t)),) for t in texts], "windows array<string>")
    ordinary, rare = abuse.settled_runs(windowed, rows)
    assert ("only", "scum", "writes") in rare and ("old", "mil", "grinds") not in rare
    bad, good, _ = abuse.separate(rows, ordinary, rare)
    assert "only scum writes such drivel" in bad and "only scum writes such drivel" not in good
    assert "the old mil grinds corn" not in bad
    assert abuse.settled_runs(windowed.limit(0), rows) == (frozenset(), frozenset())


def test_translations_tell_of_wordings_that_the_sample_does_not_show():
    """An unseen wording that says what a known one says is abusive; one that only looks so isn't; known ones are left to the labels."""
    names = [f"{a}{b}o" for a in "bdfgk" for b in ("ab", "eb")]
    known, unseen, alike, plain, museum = "du bist nur ein idiot {}", "you are revolting filth {}", "der idiot von {} steht im regal", "the novel of {} is on the shelf", "the museum in {} stays closed"
    rows = [(known.format(n), "abusive") for n in names[:4]]
    judged = [(unseen.format(n), known.format(n), -0.02, 0.2) for n in names] + [(plain.format(n), alike.format(n), -0.9, 0.06) for n in names]
    judged.append((museum.format("bobo"), known.format("bobo"), -0.9, 0.2))  # shifted: all other museums have ordinary translations
    counts = Counter(r for a, b, _, _ in judged for s in (a, b) for r in set(abuse._runs(s)))
    counts.update({r: 500 for r in abuse._runs("the museum in")} | {r: 500 for r in abuse._runs("in bobo stays closed")})
    got = abuse.learnt(judged, counts, rows, most=7)
    assert Counter(got) == Counter([(unseen.format(n), "abusive") for n in sorted(names)[:7]] + [(alike.format(n), "none") for n in sorted(names)[:7]])
    assert abuse.learnt([], {}, rows) == []


def test_translations_do_not_count_by_themselves(spark):
    sample = spark.createDataFrame(LABELLED, "text string, category string")
    bad, good = "You are nothing but a w0rthless mor0n, Dada.", "The museum in Dada opens at 7."
    texts = [(1, bad, good), (2, good, bad), (3, good, None), (4, None, bad), (5, bad, bad), (6, good + " " + bad, good), (7, "", "")]
    df = spark.createDataFrame(texts, "doc bigint, text string, other string")
    assert abuse.sentences("One. Two fine days!  Three") == ["one", "two fine days", "thre"]
    for how in ({}, {"max_pairs": 0}):
        got = abuse.abuse_scores(df, ["doc"], F.col("text"), sample, translation=F.col("other"), **how)
        assert sorted(r["doc"] for r in got.filter("flagged").collect()) == [1, 5, 6] and got.count() == len(texts)
    assert abuse.abuse_scores(df, ["doc"], F.col("text"), sample.limit(0), translation=F.col("other")).filter("flagged").count() == 0
