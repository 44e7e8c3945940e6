"""Snapshot edits and permissions against brute force and on edge cases."""

import datetime
import random

from pyspark.sql import functions as F

from strandbase.operators import permissions, snapshots

OPS = "array<struct<ord:int,kind:string,opcode:string,callee_class:string,callee_name:string,callee_desc:string>>"
SCHEMA = f"snap_no int, apk_id string, signature string, ops {OPS}, loaded_at timestamp, packed string, node int"
T0 = datetime.datetime(2031, 1, 1)


def row(snap, apk, sig, kinds, at=0):
    ops = None if kinds is None else [(i * 3, "Op" if k != "Label" else k, None if k == "Label" else k, f"c{random.random()}", None, None) for i, k in enumerate(kinds)][::-1]
    return (snap, apk, sig, ops, None if at is None else T0 + datetime.timedelta(seconds=at), "clash", 1)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    made = snapshots.snapshot_edits(df, "snap_no", ["apk_id", "signature"], snapshots.op_sequence_digest(F.col("ops")), **kw)
    return sorted(map(tuple, made.collect()), key=repr)


def brute(rows):
    held = {}
    for snap, apk, sig, ops, at, *_ in rows:
        if snap is None:
            continue
        kinds = [k[2] or k[1] for k in sorted(ops or [])]
        key = (snap, (apk, sig))
        if key not in held or at > held[key][0]:
            held[key] = (at, kinds)
    order, out = sorted({s for s, _ in held}), []
    for a, b in zip(order, order[1:]):
        old, new = ({k: v[1] for (s, k), v in held.items() if s == x} for x in (a, b))
        for k in old.keys() | new.keys():
            if k not in old or k not in new or old[k] != new[k]:
                out.append((b, *k, "ADDED" if k not in old else "REMOVED" if k not in new else "CHANGED"))
    return sorted(out, key=repr)


def test_random_snapshots(spark):
    rng = random.Random(5)
    rows = []
    for snap in (1, 2, 5, 9):
        for i in range(400):
            if rng.random() < 0.9:
                kinds = ["Nop", "Throw"] + (["Label"] if rng.random() < 0.1 else [])
                rows.append(row(snap, f"a{i % 7}", f"s{i}", kinds, rng.randint(0, 10**6)))
                if rng.random() < 0.1:
                    rows.append(row(snap, f"a{i % 7}", f"s{i}", ["Goto"], rng.randint(0, 10**6)))
    rng.shuffle(rows)
    want = brute(rows)
    assert len(want) > 300
    for leaf in (1, 8, 10_000):  # deep, usual and single-leaf trees
        assert found(spark, rows, rows_per_leaf=leaf) == want


def test_edge_cases(spark):
    assert found(spark, []) == []
    assert found(spark, [row(1, "a", "s", ["Nop"])]) == []
    rows = [row(1, "a", "s", None), row(2, "a", "s", []), row(1, None, None, ["Nop"]), row(2, None, None, ["Throw"]), row(None, "a", "s", ["Nop"]), row(1, "a", "late", ["Nop"], None), row(2, "a", "late", ["Nop"], 5)]
    assert found(spark, rows) == [(2, None, None, "CHANGED")]
    copies = [row(1, "a", "s", ["Nop"], 1)] * 3 + [row(2, "a", "s", ["Nop"] * 5000, 1)] * 3
    assert found(spark, copies) == [(2, "a", "s", "CHANGED")]
    assert found(spark, [row(1, "a", "s", ["Nop"]), row(7, "b", "t", ["Nop"])]) == [(7, "a", "s", "REMOVED"), (7, "b", "t", "ADDED")]


def test_sequence_boundaries_matter(spark):
    rows = [row(1, "a", "s", ["ab", "c"]), row(2, "a", "s", ["a", "bc"]), row(1, "a", "t", []), row(2, "a", "t", ["x"])]
    assert found(spark, rows) == [(2, "a", "s", "CHANGED"), (2, "a", "t", "CHANGED")]


def test_manifest_sets(spark):
    rows = [(1, "a", "p", ["x", " y ", None, ""], T0), (2, "a", "p", ["y", "x", "x\t"], T0), (1, "a", "q", None, T0), (2, "a", "q", [" "], T0), (1, "a", "r", ["x"], T0), (2, "a", "r", ["X"], T0)]
    df = spark.createDataFrame(rows, "snap_no int, apk_id string, package_name string, uses_permissions array<string>, loaded_at timestamp")
    assert [tuple(r) for r in snapshots.manifest_edits(df).collect()] == [(2, "a", "r", "CHANGED")]


def test_permission_diff(spark):
    rows = [("a", "old", 1, "x"), ("a", "old", 2, "x"), ("a", "old", 3, "y"), ("a", "new", 1, "y"), ("a", "new", 2, "z"), ("b", "old", 1, "w")]
    entries = spark.createDataFrame(rows, "apk_id string, side string, pos int, permission string")
    assert [tuple(r) for r in permissions.permission_lines(permissions.permission_diff(entries)).collect()] == [("a", "DELETED: x"), ("a", "DELETED: x"), ("a", "ADDED: z"), ("b", "DELETED: w")]
    readable = spark.createDataFrame([("a", "old"), ("a", "new"), ("b", "old")], "apk_id string, side string")
    assert permissions.permission_diff(entries, readable).filter("apk_id = 'b'").count() == 0
