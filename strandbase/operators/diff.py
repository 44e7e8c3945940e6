"""Method-level differences between the old and the new side of each application, and their extraction to files.

A class defined again later replaces the earlier definition; of an old method defined again in its class the last holds. A
method has changed when its sequence of op kinds differs (P19); operands don't count. Null ops lists equal empty ones.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbase.functions.filters import class_filter, filtered_lines
from strandbase.functions.names import class_directory, java_signature, method_filename
from strandbase.runtime import op_kinds, ship

DEFINITION = ["side", "apk_id", "dex_ord", "class_ord"]


def effective_methods(classes: DataFrame, methods: DataFrame, class_filters: Iterable[str] | None = None) -> DataFrame:
    """The methods of the last definition of each class (A14). A later definition without methods hides the earlier ones."""
    named = classes.filter(F.col("class_java").isNotNull() & class_filter(F.col("class_java"), class_filters))
    place = F.shiftleft(F.col("dex_ord").cast("bigint"), 32) + F.col("class_ord")  # one number, so that a hash aggregate can keep it
    last = named.groupBy("side", "apk_id", "class_java").agg(F.max(place).alias("last"))
    wanted = last.select("side", "apk_id", F.shiftright("last", 32).cast("int").alias("dex_ord"), F.col("last").bitwiseAND(0xFFFFFFFF).cast("int").alias("class_ord"))
    return methods.join(wanted, DEFINITION, "left_semi")


def _signed(methods: DataFrame, *keep: str) -> DataFrame:
    """What the comparison needs of each method. This comes before any join: the scan then reads no operands, and digests
    instead of sequences are shuffled (equal digests of unequal sequences have a chance of 2^-64)."""
    signature = java_signature(F.col("class_java"), F.col("ret_type"), F.col("name"), F.col("arg_types"))
    digest = F.xxhash64(F.lit(0), F.coalesce(op_kinds(F.col("ops")), F.array().cast("array<string>")))
    info = F.struct(*keep) if keep else F.lit(0)
    return methods.select(*DEFINITION, "class_java", "method_ord", signature.alias("signature"), digest.alias("digest"), info.alias("info"))


def _compared(classes: DataFrame, methods: DataFrame, class_filters: Iterable[str] | None, *keep: str) -> DataFrame:
    """A full outer join of both sides on class and signature (J1-J3), with the ``keep`` columns of each side as structs."""
    key = ["apk_id", "class_java", "signature"]
    rows = effective_methods(classes, _signed(methods, *keep), class_filters)
    new = rows.filter("side = 'new'").select(*key, F.col("digest").alias("new_digest"), F.col("info").alias("new_info"))
    old = rows.filter("side = 'old'").groupBy(*key)
    old = old.agg(F.max_by("digest", "method_ord").alias("old_digest"), F.max_by("info", "method_ord").alias("old_info"), F.count("*").alias("copies"))
    both = new.join(old, key, "full_outer")
    edit = F.when(F.col("old_digest").isNull(), "ADDED").when(F.col("new_digest").isNull(), "REMOVED").when(F.col("old_digest") != F.col("new_digest"), "CHANGED")
    return both.withColumn("edit", edit).filter("edit is not null")


def method_diff(classes: DataFrame, methods: DataFrame, class_filters: Iterable[str] | None = None) -> DataFrame:
    """(apk_id, edit, signature) with edit ADDED, REMOVED or CHANGED; a removed method defined twice is given twice."""
    found = _compared(classes, methods, class_filters)
    times = F.when(F.col("edit") == "REMOVED", F.col("copies")).otherwise(1).cast("int")
    return found.select("apk_id", "edit", "signature", F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def diff_lines(diff: DataFrame) -> DataFrame:
    """K2."""
    return diff.select("apk_id", F.concat_ws(": ", "edit", "signature").alias("line"))


def extracted_files(classes: DataFrame, methods: DataFrame, class_filters: Iterable[str] | None = None, line_filters: Iterable[str] | None = None) -> DataFrame:
    """(apk_id, root, path, content): a file on each side that has the changed, added or removed method (K3). Where two
    methods would get one path, the last of them holds."""
    found = _compared(classes, methods, class_filters, "name", "arg_types", "smali_text", "method_ord")
    sides = F.array(F.struct(F.lit("new").alias("root"), F.col("new_info").alias("info")), F.struct(F.lit("old").alias("root"), F.col("old_info").alias("info")))
    rows = found.select("apk_id", "class_java", F.explode(sides).alias("s")).select("apk_id", "class_java", "s.root", "s.info.*").filter("name is not null")
    path = F.concat(class_directory(F.col("class_java")), F.lit("/"), method_filename(F.col("name"), F.col("arg_types")))
    content = filtered_lines(F.coalesce("smali_text", F.lit("")), line_filters)
    files = rows.select("apk_id", "root", path.alias("path"), "method_ord", content.alias("content"))
    last = F.row_number().over(Window.partitionBy("apk_id", "root", "path").orderBy(F.desc("method_ord"), F.desc("content")))
    return files.withColumn("n", last).filter("n = 1").select("apk_id", "root", "path", "content")


def write_files(files: DataFrame, out: str) -> None:
    """Writes ``out/<apk_id>/{new,old}/<path>`` from the executors; ``out`` is a folder or a URI that all of them reach. Both
    roots exist for every application in ``files``."""
    ship(files.sparkSession)

    def write(rows) -> None:
        import posixpath

        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(out) if "://" in out else (fs.LocalFileSystem(), out)
        made: set[str] = set()
        for r in rows:
            target = posixpath.normpath(posixpath.join(base, r["apk_id"], r["root"], r["path"]))
            if not target.startswith(posixpath.normpath(base) + "/"):
                raise ValueError(f"path leaves the output folder: {r['path']!r}")
            for folder in (posixpath.dirname(target), posixpath.join(base, r["apk_id"], "new"), posixpath.join(base, r["apk_id"], "old")):
                if folder not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
            with where.open_output_stream(target) as f:
                f.write(r["content"].encode())

    files.foreachPartition(write)
