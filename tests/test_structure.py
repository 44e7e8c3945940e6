"""Call graph, differences, package graphs and matching on hand-built programs."""

import random

from pyspark.sql import functions as F

from strandbase.operators import callgraph, diff, matching, packages
from strandbase.sinks import tables
from tests.helpers import classes, classes_of, method, methods, op

A, B = "Lp/A;", "Lp/B;"


def call(i, cls, name, desc="()V", code="InvokeVirtual"):
    return op(i, code, (cls, name, desc))


def test_call_edges_union_over_overloads(spark):
    rows = [
        method(A, "f", [call(0, B, "x"), call(1, B, "x"), op(2, "ReturnVoid")]), method(A, "f", [call(0, "[I", "clone", code="InvokePolymorphicRange")], desc="(I)V"),
        method(B, "g", []), method(B, "h", None), method(B, "i", [op(0, "ConstClass")]),
    ]
    edges = callgraph.call_edges(methods(spark, rows))
    assert sorted(map(tuple, edges.collect())) == [("p.A:f", "[I:clone"), ("p.A:f", "p.B:x")]
    assert callgraph.call_edges(methods(spark, rows), ["B$"]).count() == 0
    assert [r["line"] for r in callgraph.dot_lines(edges).collect()] == ["digraph {", '"p.A:f" -> "[I:clone"; ', '"p.A:f" -> "p.B:x"; ', "}"]
    assert callgraph.dot_lines(callgraph.call_edges(methods(spark, []))).count() == 2


def edits(spark, rows, cls=None, **kw):
    found = diff.method_diff(cls or classes_of(spark, rows), methods(spark, rows), **kw).collect()
    return sorted((r["edit"], r["signature"]) for r in found)


def test_diff_kinds(spark):
    ret, lab = op(0, "ReturnVoid"), (1, "Label", None, None, None, None)
    rows = [
        method(A, "same", [call(0, B, "x")], mord=0), method(A, "same", [call(0, A, "other operand")], side="new", mord=0),
        method(A, "label", [ret], mord=1), method(A, "label", [ret, lab], side="new", mord=1),
        method(A, "order", [(5, "Op", "Nop", None, None, None), (2, "Op", "Throw", None, None, None)], mord=2), method(A, "order", [op(0, "Throw"), op(1, "Nop")], side="new", mord=2),
        method(A, "gone", [ret], mord=3), method(A, "came", [ret], side="new", mord=3), method(A, "ret", [ret], mord=4), method(A, "ret", [ret], side="new", mord=4, ret="int"),
        method(A, "nothing", None, mord=5), method(A, "nothing", [], side="new", mord=5), method(B, "old class", [ret], cord=1),
    ]
    assert edits(spark, rows) == [
        ("ADDED", "p.A: int ret([])"), ("ADDED", "p.A: void came([])"), ("CHANGED", "p.A: void label([])"), ("REMOVED", "p.A: void gone([])"), ("REMOVED", "p.A: void ret([])"), ("REMOVED", "p.B: void old class([])"),
    ]
    assert edits(spark, rows, class_filters=["B"]) == [("REMOVED", "p.B: void old class([])")]
    assert edits(spark, []) == []


def test_last_class_definition_holds(spark):
    rows = [method(A, "f", [op(0, "Nop")], dex=0), method(A, "g", [op(0, "Nop")], dex=1), method(A, "g", [op(0, "Nop")], side="new")]
    assert edits(spark, rows) == []
    empty_later = classes(spark, [("old", "a", 0, 0, A), ("old", "a", 1, 0, A), ("old", "a", 2, 0, A), ("new", "a", 0, 0, A)])
    assert edits(spark, rows, empty_later) == [("ADDED", "p.A: void g([])")]


def test_repeated_methods(spark):
    rows = [method(A, "f", [op(0, "Nop")], mord=0), method(A, "f", [op(0, "Throw")], mord=1), method(A, "f", [op(0, "Throw")], side="new"), method(A, "g", [], mord=2), method(A, "g", [], mord=3)]
    assert edits(spark, rows) == [("REMOVED", "p.A: void g([])")] * 2


def test_extraction(spark, tmp_path):
    rows = [
        method(A, "f", [op(0, "Nop")], text="x invoke\ny\n"), method(A, "f", [op(0, "Throw")], side="new", text="z"), method(A, "<init>", [], mord=1, text="one"), method(A, "init", [], mord=2, text="two"),
        method(A, "gone", [], mord=3),
    ]
    files = diff.extracted_files(classes_of(spark, rows), methods(spark, rows), None, ["invoke"])
    assert sorted((r["root"], r["path"], r["content"]) for r in files.collect()) == [("new", "p/A/f().smali", ""), ("old", "p/A/f().smali", "x invoke"), ("old", "p/A/gone().smali", ""), ("old", "p/A/init().smali", "")]
    diff.write_files(diff.extracted_files(classes_of(spark, rows), methods(spark, rows)), str(tmp_path))
    assert (tmp_path / "a/old/p/A/init().smali").read_text() == "two"
    assert (tmp_path / "a/new/p/A/f().smali").read_text() == "z"


def graph_rows():
    body = [
        call(0, A, "f"), call(1, B, "g"), call(2, B, "g", code="InvokeSuper"), call(3, B, "missing"), call(4, "Landroidx/X;", "x", code="InvokeStaticRange"), call(5, "[I", "clone", code="InvokePolymorphic"),
        call(6, "Lp/q/C;", "x", code="InvokeInterface"), call(7, "Ljava/X;", "x", code="InvokeDirect"), op(8, "IfEqz"), (9, "Label", None, None, None, None),
    ]
    return [method(A, "f", body, params=2), method(B, "g", [op(0, "ReturnVoid")], cord=1), method(B, "alone", None, cord=1, mord=1), method(A, "f", [], dex=0, mord=-1), method("[bad", "x", [], cord=2)]


def test_features_and_edges(spark):
    nodes, edges = packages.package_graph(methods(spark, graph_rows()))
    got = {r["method_key"]: [r[c] for c in packages.FEATURES] for r in nodes.collect()}
    assert got == {"Lp/A;->f()V": [1, 8, 1, 1, 0, 2, 4, 1, 1, 1, 2, 9, 1], "Lp/B;->g()V": [2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0], "Lp/B;->alone()V": [0] * 13}
    assert edges.count() == 3
    assert packages.neighbourhoods(edges).count() == 3  # f-f, f-g, g-f
    counts = packages.package_method_counts(classes(spark, [("old", "a", 0, 0, A), ("old", "a", 0, 3, "Lempty/E;"), ("old", "a", 0, 4, "bad")]), methods(spark, graph_rows()))
    assert {r["pkg"]: r["n_methods"] for r in counts.collect()} == {"p": 4, "empty": 0}


def test_labels_keep_isolated_nodes(spark):
    nodes, edges = packages.package_graph(methods(spark, graph_rows()))
    every, last, near = packages.wl_labels(nodes, edges, 2)
    assert every.count() == 3 * 3
    assert last.count() == 3
    assert packages.wl_histograms(every).agg(F.sum("cnt")).first()[0] == 9


def histograms(spark, old, new):
    rows = [(s, "a", "p", 0, label, n) for s, h in (("old", old), ("new", new)) for label, n in h.items()]
    sizes = [(s, "a", "p", sum(h.values())) for s, h in (("old", old), ("new", new))]
    return spark.createDataFrame(rows, "side string, apk_id string, pkg string, iter int, label string, cnt bigint"), spark.createDataFrame(sizes, "side string, apk_id string, pkg string, n_nodes bigint")


def test_similarity(spark):
    score = lambda old, new: [r["score"] for r in matching.package_similarity(*histograms(spark, old, new), 0).collect()]
    assert score({"x": 2, "y": 1}, {"x": 2, "y": 1}) == [1.0]
    assert score({"x": 2}, {"y": 2}) == []
    assert score({"x": 3, "y": 1}, {"x": 3, "z": 1}) == [0.75]


RESULT = ["old_package", "new_package", "score", "status"]


def sequential(scores, old, new, threshold, change):
    """The assignment written as a loop: every old package tries its best candidate only."""
    best = []
    for o in sorted(old):
        s, n = max(((scores.get((o, n), 0.0), [-ord(c) for c in n]) for n in new), default=(0.0, None))
        pick = min((n for n in new if scores.get((o, n), 0.0) == s), default=None) if s > 0 else None
        best.append((o, pick, s))
    best.sort(key=lambda x: -x[2])
    used, out = set(), []
    for o, n, s in best:
        if n is not None and n not in used and s >= change:
            used.add(n)
            out.append((o, n, s, "MATCH" if s >= threshold else "CHANGED"))
        else:
            out.append((o, "---", 0.0, "REMOVED"))
    return out + [("---", n, 0.0, "NEW") for n in sorted(new) if n not in used]


def test_assignment_equals_the_loop(spark):
    rng = random.Random(3)
    score_rows, size_rows, want = [], [], {}
    for k in range(120):
        apk = f"a{k:03}"
        old, new = [f"o{i}" for i in range(rng.randint(0, 6))], [f"n{i}" for i in range(rng.randint(0, 6))]
        scores = {(o, n): rng.choice([0.1, 0.25, 0.5, 0.5, 0.75, 0.9]) for o in old for n in new if rng.random() < 0.7}
        score_rows += [(apk, o, n, s) for (o, n), s in scores.items()]
        size_rows += [("old", apk, o, 1) for o in old] + [("new", apk, n, 1) for n in new]
        want[apk] = sequential(scores, old, new, 0.6, 0.2)
    scores = spark.createDataFrame(score_rows, "apk_id string, old_package string, new_package string, score double")
    sizes = spark.createDataFrame(size_rows, "side string, apk_id string, pkg string, n_nodes bigint")
    rows = matching.assign_packages(scores, sizes, sizes, 0.6, 0.2).orderBy(*matching.result_order()).collect()
    got = {apk: [] for apk in want}
    for r in rows:
        got[r["apk_id"]].append(tuple(r[c] for c in RESULT))
    assert got == want


def test_match_packages(spark):
    f = [op(0, "ReturnVoid")]
    rows = [method("Lp/A;", "f", f), method("Lq/A;", "f", f, side="new"), method("Lz/A;", "f", f, side="new"), method("Lw/A;", "f", [op(0, "Throw")] * 3, side="new")]
    cls = classes(spark, [("old", "a", 0, 0, "Lp/A;"), ("old", "a", 0, 1, "Lbare/E;"), ("new", "a", 0, 0, "Lq/A;"), ("new", "a", 0, 1, "Lz/A;"), ("new", "a", 0, 2, "Lw/A;"), ("new", "a", 0, 3, "Lbare/E;")])
    results, counts = matching.match_packages(cls, methods(spark, rows))
    got = [tuple(r[c] for c in RESULT) for r in results.orderBy(*matching.result_order()).collect()]
    assert got == [("p", "q", 1.0, "MATCH"), ("---", "w", 0.0, "NEW"), ("---", "z", 0.0, "NEW"), ("bare", "---", 0.0, "REMOVED"), ("---", "bare", 0.0, "NEW")]
    assert [r["line"] for r in tables.csv_lines(results).collect()] == ["p,q,1.00,MATCH", "---,w,---,NEW", "---,z,---,NEW", "bare,---,---,REMOVED", "---,bare,---,NEW"]
    lines = [r["line"] for r in tables.table_lines(results).collect()]
    assert lines[0] == "Package (old)  Package (new)  Score  Status "
    assert lines[1] == "-" * len(lines[0])
    assert lines[2] == "p              q               1.00  MATCH  "
    assert [r["line"] for r in tables.detail_lines(results, counts).collect()][:3] == ["  p  <->  q  (methods 1->1 | score=1.00)", "  w  (added)", "  z  (added)"]


def test_consistency_never_reopens(spark):
    rows = spark.createDataFrame([("a", 0, 0.9, "p", "q", 0.9, "MATCH"), ("a", 0, 0.5, "r", "s", 0.5, "CHANGED"), ("a", 1, 0.0, "---", "t", 0.0, "NEW")], "apk_id string, section int, sort_score double, old_package string, new_package string, score double, status string")
    c = spark.createDataFrame([("a", "p", "q", 0.5), ("a", "r", "s", 0.0)], "apk_id string, old_package string, new_package string, consistency double")
    got = sorted(tuple(r[k] for k in RESULT) for r in matching.refined(rows, c, 0.8, 0.4).collect())
    assert got == [("---", "t", 0.0, "NEW"), ("p", "q", 0.45, "CHANGED"), ("r", "s", 0.0, "REMOVED")]
    assert sorted(r["status"] for r in matching.refined(rows, c, 0.8, 0.0).collect()) == ["CHANGED", "CHANGED", "NEW"]


def labels(spark, old, new):
    rows = [(s, "a", "p", i, x) for s, v in (("old", old), ("new", new)) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "side string, apk_id string, pkg string, node bigint, label string"), spark.createDataFrame([], "side string, apk_id string, pkg string, node bigint, neighbour bigint"), spark.createDataFrame([("a", "p", "p")], "apk_id string, old_package string, new_package string")


def test_label_consistency_is_positional(spark):
    score = lambda a, b, m="positional": matching.label_consistency(*labels(spark, a, b), m).first()["consistency"]
    assert score("123", "123") == 1.0
    assert score("123", "234") == 0.0
    assert score("239", "234") == 2 / 3
    assert score("123", "234", "multiset") == 2 / 3
    assert score("11", "1") == 0.5
