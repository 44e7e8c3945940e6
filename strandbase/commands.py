"""The programs: call graph, comparison, extraction, matching, permissions and manifest, from archives to lines of text.

Each takes a session and paths and gives a DataFrame with a ``line`` column in order (text for a single manifest), or raises
``ArchiveError`` with the old side's error first.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbase.functions.filters import class_filter, compile_patterns
from strandbase.operators import callgraph as graph
from strandbase.operators import diff, manifest, matching, permissions
from strandbase.sinks import tables
from strandbase.sinks.manifest_text import RENDERERS
from strandbase.sources.archives import MANIFEST, read_archives

log = logging.getLogger(__name__)


class ArchiveError(RuntimeError):
    """An archive that couldn't be read."""


def _both(spark: SparkSession, old: str, new: str, kinds: tuple[str, ...]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """The tables of an old and a new archive under one application id, and unreadable (side, error) pairs."""
    sides = {side: read_archives(spark, path, side, kinds) for side, path in (("old", old), ("new", new))}
    errors = []
    for side, made in sides.items():
        for bad in made["error"].collect():  # at most one row for each entry of two archives
            if bad["entry"] is None:
                raise ArchiveError(f"Error parsing {side} apk: {bad['error']}")
            log.error("%s side, %s: %s", side, bad["entry"], bad["error"])
            errors.append((side, bad["entry"]))
    one = lambda t: sides["old"][t].unionByName(sides["new"][t]).withColumn("apk_id", F.lit("pair"))
    return {k: one(k) for k in kinds}, errors


def callgraph(spark: SparkSession, paths: Iterable[str], class_filters: Iterable[str] | None = None) -> DataFrame:
    """Patterns are checked before anything is opened; an unreadable archive stops the run."""
    compile_patterns(class_filters)
    methods = read_archives(spark, list(paths), "old", ("class", "method"), on_error="collect")
    for bad in methods["error"].orderBy(F.col("entry").asc_nulls_first()).collect():  # at most one row for each entry of the archives
        if bad["entry"] is None:
            raise ArchiveError(f"Failed to parse APK file: {bad['error']}")
        log.error("%s, %s: %s", bad["apk_id"], bad["entry"], bad["error"])
    return graph.dot_lines(graph.call_edges(methods["method"], class_filters))


def compare(spark: SparkSession, old: str, new: str, class_filters: Iterable[str] | None = None) -> DataFrame:
    made, _ = _both(spark, old, new, ("class", "method"))
    return diff.diff_lines(diff.method_diff(made["class"], made["method"], class_filters)).select("line")


def extract(spark: SparkSession, old: str, new: str, out: str, class_filters: Iterable[str] | None = None, line_filters: Iterable[str] | None = None) -> None:
    """Writes the changed methods below ``out/new`` and ``out/old``; both folders exist afterwards."""
    from pyarrow import fs

    made, _ = _both(spark, old, new, ("class", "method"))
    where, base = fs.FileSystem.from_uri(out) if "://" in out else (fs.LocalFileSystem(), out)
    for root in ("new", "old"):
        where.create_dir(f"{base}/{root}", recursive=True)
    files = diff.extracted_files(made["class"], made["method"], class_filters, line_filters)
    diff.write_files(files.withColumn("apk_id", F.lit(".")), out)


def match(
    spark: SparkSession, old: str, new: str, threshold: float = 0.8, change_threshold: float = 0.0, wl_iterations: int = 3, csv: bool = False,
    show_details: bool = False, class_filters: Iterable[str] | None = None, node_matching: bool = False,
) -> list[DataFrame]:
    """The result's lines, and those of the details where asked for; details are left out with ``csv``."""
    made, _ = _both(spark, old, new, ("class", "method"))
    wanted = class_filter(F.col("class_java"), class_filters)
    rows, counts = matching.match_packages(made["class"].filter(wanted), made["method"].filter(wanted), threshold, change_threshold, wl_iterations, node_matching)
    if csv:
        head = spark.createDataFrame([(tables.CSV_HEAD,)], "line string")
        return [head, tables.csv_lines(rows).select("line")]
    return [tables.table_lines(rows).select("line"), *([tables.detail_lines(rows, counts).select("line")] if show_details else [])]


def permission_list(spark: SparkSession, path: str) -> DataFrame:
    made = read_archives(spark, path, "old", ("element",))
    for bad in made["error"].collect():
        raise ArchiveError(bad["error"])
    return permissions.permission_entries(made["element"]).orderBy("pos").select(F.col("permission").alias("line"))


def permission_changes(spark: SparkSession, old: str, new: str) -> DataFrame:
    """A manifest that can't be read on either side gives no lines and a logged error, not a failure."""
    made, errors = _both(spark, old, new, ("element",))
    elements = made["element"].filter(F.lit(not any(entry == MANIFEST for _, entry in errors)))
    return permissions.permission_lines(permissions.permission_diff(permissions.permission_entries(elements))).select("line")


def show_manifest(spark: SparkSession, path: str, form: str = "printed") -> str:
    """json, yaml, printed or xml."""
    made = read_archives(spark, path, "old", ("element", "raw"))
    for bad in made["error"].collect():
        raise ArchiveError(bad["error"])
    if form == "xml":
        return made["raw"].first()["xml"]
    return RENDERERS[form](manifest.manifest_summary(made["element"]).first())
