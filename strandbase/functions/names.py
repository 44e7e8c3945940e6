"""Names and labels as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of class names outside the application, and what they are counted as.
EXTERNAL = {"android": ["Landroid/"], "androidx": ["Landroidx/"], "java": ["Ljava/", "Ljavax/"], "kotlin": ["Lkotlin/", "Lkotlinx/"]}


def jni_class_to_java(jni: Column) -> Column:
    """``La/b/C;`` becomes ``a.b.C``; without the closing mark only the separators change."""
    closed = F.regexp_extract(jni, r"(?s)\AL?(.*);\z", 1)
    return F.replace(F.when(F.endswith(jni, F.lit(";")), closed).otherwise(jni), F.lit("/"), F.lit("."))


def package_of(jni: Column) -> Column:
    """The package of ``La/b/C;`` is ``a/b``, that of ``LC;`` is empty, anything else has none."""
    inner = F.substring(jni, F.lit(2), F.length(jni) - 2)
    own = F.length(F.substring_index(inner, "/", -1))
    return F.when(F.startswith(jni, F.lit("L")) & F.endswith(jni, F.lit(";")), F.substring(inner, F.lit(1), F.length(inner) - own - 1))


def package_label(pkg: Column) -> Column:
    """How a package is shown."""
    return F.when(pkg == "", "(default)").otherwise(F.replace(pkg, F.lit("/"), F.lit(".")))


def external_kind(jni: Column) -> Column:
    """android, androidx, java, kotlin or other."""
    found = F.lit("other")
    for kind, prefixes in EXTERNAL.items():
        for prefix in prefixes:
            found = F.when(F.startswith(jni, F.lit(prefix)), kind).otherwise(found)
    return found


def method_key(class_jni: Column, name: Column, descriptor: Column) -> Column:
    """The same layout for a method and for a method reference."""
    return F.concat(class_jni, F.lit("->"), name, descriptor)


def java_signature(class_java: Column, ret: Column, name: Column, args: Column) -> Column:
    """``<class>: <ret> <name>(["int", "boolean"])``, quotes and backslashes in names escaped."""
    quoted = F.transform(args, lambda a: F.concat(F.lit('"'), F.replace(F.replace(a, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    shown = F.coalesce(F.array_join(quoted, ", "), F.lit(""))
    return F.concat(class_java, F.lit(": "), ret, F.lit(" "), name, F.lit("(["), shown, F.lit("])"))


def call_label(class_java: Column, name: Column) -> Column:
    """Caller and callee in a call graph; overloads share it."""
    return F.concat(class_java, F.lit(":"), name)


def method_filename(name: Column, args: Column) -> Column:
    """``name(arg, arg).smali``; beyond 200 bytes the arguments give way to 16 hex digits."""
    safe = F.translate(name, "<>", "")
    full = F.concat(safe, F.lit("("), F.coalesce(F.array_join(args, ", "), F.lit("")), F.lit(").smali"))
    return F.when(F.octet_length(full) > 200, F.concat(safe, F.lit("_"), F.substring(F.md5(full), 1, 16), F.lit(".smali"))).otherwise(full)


def class_directory(class_java: Column) -> Column:
    """The directory of a class (P10)."""
    return F.replace(class_java, F.lit("."), F.lit("/"))


def score_text(score: Column) -> Column:
    """Two decimals, or ``---`` for nothing."""
    return F.when(score <= 0, "---").otherwise(F.format_string("%.2f", score))
