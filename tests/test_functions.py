import pytest
from pyspark.sql import functions as F

from strandbase.functions import filters, names


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_jni_names(spark):
    cases = {
        "Lcom/a/B;": "com.a.B", "Lcom/a/B$C;": "com.a.B$C", "com/a/B;": "com.a.B", "Lcom/a/B": "Lcom.a.B", "[Lcom/a/B;": "[Lcom.a.B", "I": "I", ";": "", "L;": "", "LL;": "L", "": "", None: None,
    }
    got = values(spark, [(k,) for k in cases], "j string", names.jni_class_to_java(F.col("j")))
    assert [x for (x,) in got] == list(cases.values())


def test_packages_and_kinds(spark):
    cases = {
        "Lcom/a/B;": ("com/a", "com.a", "other"), "LB;": ("", "(default)", "other"), "com/a/B;": (None, None, "other"), "Lcom/a/B": (None, None, "other"), "[I": (None, None, "other"),
        "Landroid/os/X;": ("android/os", "android.os", "android"), "Landroidx/y/X;": ("androidx/y", "androidx.y", "androidx"), "Ljavax/X;": ("javax", "javax", "java"),
        "Ljava/util/X;": ("java/util", "java.util", "java"), "Lkotlinx/X;": ("kotlinx", "kotlinx", "kotlin"), "Lkotlin/X;": ("kotlin", "kotlin", "kotlin"), "Landroidy/X;": ("androidy", "androidy", "other"),
    }
    pkg = names.package_of(F.col("j"))
    assert dict(zip(cases, values(spark, [(k,) for k in cases], "j string", pkg, names.package_label(pkg), names.external_kind(F.col("j"))), strict=True)) == cases


def test_signatures_and_filenames(spark):
    long = ["com.example.AVeryLongArgumentType"] * 10
    rows = [("a.B", "void", "f", []), ("a.B", "int", "g", ["int", "boolean"]), ("a.B", "void", "<init>", ['q"\\']), ("a.B", "void", "h", long), ("a.B", "void", "n", None)]
    sig = names.java_signature(F.col("c"), F.col("r"), F.col("n"), F.col("a"))
    got = values(spark, rows, "c string, r string, n string, a array<string>", sig, names.method_filename(F.col("n"), F.col("a")), names.class_directory(F.col("c")))
    assert got[0] == ("a.B: void f([])", "f().smali", "a/B")
    assert got[1][:2] == ('a.B: int g(["int", "boolean"])', "g(int, boolean).smali")
    assert got[2][:2] == ('a.B: void <init>(["q\\"\\\\"])', 'init(q"\\).smali')
    assert len(got[3][1]) == len("h_") + 16 + len(".smali")
    assert got[4][1] == "n().smali"


def test_score_text(spark):
    assert values(spark, [(0.0,), (-1.0,), (0.5,), (1.0,), (0.333,)], "s double", names.score_text(F.col("s"))) == [("---",), ("---",), ("0.50",), ("1.00",), ("0.33",)]


def test_patterns(spark):
    assert filters.compile_patterns(None) is None
    assert filters.compile_patterns([]) is None
    with pytest.raises(filters.InvalidPattern):
        filters.compile_patterns(["ok", "["])
    rows = [("com.a.B",), ("org.b.C",)]
    keep = lambda p: [x for (x,) in values(spark, rows, "c string", filters.class_filter(F.col("c"), p))]
    assert keep(None) == [True, True]
    assert keep([""]) == [True, True]
    assert keep(["^com", "C$"]) == [True, True]
    assert keep(["b"]) == [False, True]
    assert [x for (x,) in values(spark, [("٣",)], "c string", filters.class_filter(F.col("c"), [r"\d"]))] == [True]


def test_lines(spark):
    rows = [("a1\nb\na2\n",), ("b",), ("",), (None,), ("a\r\nb\r\n",), ("a\n\n",)]
    assert values(spark, rows, "t string", filters.filtered_lines(F.col("t"), ["a"])) == [("a1\na2",), ("",), ("",), (None,), ("a",), ("a",)]
    assert values(spark, rows[:1], "t string", filters.filtered_lines(F.col("t"), None)) == [("a1\nb\na2\n",)]


def test_opcode_sets():
    assert len(filters.INVOKES) == 12
    assert len(filters.BRANCHES) == 17
