"""Archives as tables. Spark lists the files; each task opens its archives itself, so that only the needed entries are read
and no whole archive passes through Arrow. An unreadable archive or entry becomes a row of the error table."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandbase.functions.attributes import ATTRIBUTES
from strandbase.runtime import cut, ship
from strandbase.sources import dex, manifest_xml

#: Which entries are read.
CLASS_FILE = re.compile(r"classes\d*\.dex")
MANIFEST = "AndroidManifest.xml"

OPS = "array<struct<ord:int,kind:string,opcode:string,callee_class:string,callee_name:string,callee_desc:string>>"
_ID = "side string, apk_id string, dex_ord int, class_ord int"
CLASS_SCHEMA = f"{_ID}, class_jni string, class_java string, pkg string"
METHOD_SCHEMA = (
    f"{_ID}, method_ord int, class_jni string, class_java string, pkg string, name string, descriptor string, arg_types array<string>, "
    f"ret_type string, n_param_entries int, smali_text string, ops {OPS}"
)
ELEMENT_SCHEMA = f"apk_id string, side string, element_id bigint, parent_id bigint, sibling_ord int, depth int, tag string, attrs {ATTRIBUTES}"
RAW_SCHEMA = "apk_id string, side string, xml string"
ERROR_SCHEMA = "apk_id string, side string, entry string, error string"
SCHEMAS = {"class": CLASS_SCHEMA, "method": METHOD_SCHEMA, "element": ELEMENT_SCHEMA, "raw": RAW_SCHEMA, "error": ERROR_SCHEMA}


class UnreadableArchive(RuntimeError):
    """Raised where the caller asked for unreadable archives to stop the run."""


def _package(jni: str) -> str | None:
    if not (jni.startswith("L") and jni.endswith(";")):
        return None
    return jni[1:-1].rpartition("/")[0]


def _class_rows(data: bytes, side: str, apk: str, dex_ord: int) -> Iterator[tuple[str, dict]]:
    for class_ord, (jni, methods) in enumerate(dex.Dex(data).classes()):
        own = {"side": side, "apk_id": apk, "dex_ord": dex_ord, "class_ord": class_ord, "class_jni": jni, "class_java": dex.java_type(jni), "pkg": _package(jni)}
        yield "class", own
        for method_ord, m in enumerate(methods):
            ops = [
                dict(zip(("ord", "kind", "opcode", "callee_class", "callee_name", "callee_desc"), (i, o.kind, o.opcode, *(o.callee or (None,) * 3)), strict=True))
                for i, o in enumerate(m.ops)
            ]
            yield "method", own | {
                "method_ord": method_ord, "name": m.name, "descriptor": m.descriptor, "arg_types": [dex.java_type(a) for a in m.args],
                "ret_type": dex.java_type(m.ret), "n_param_entries": m.n_named_params, "smali_text": dex.smali_text(m), "ops": ops,
            }


def _entry_order(name: str) -> int:
    return int(re.sub(r"\D", "", name) or 1)


def archive_rows(archive: zipfile.ZipFile, apk: str, side: str, wanted: set[str]) -> Iterator[tuple[str, dict]]:
    """(table, row) of one archive, for the tables in ``wanted``."""
    names = sorted((n for n in archive.namelist() if CLASS_FILE.fullmatch(n)), key=_entry_order)
    for dex_ord, name in enumerate(names if wanted & {"class", "method"} else []):
        try:
            yield from (x for x in list(_class_rows(archive.read(name), side, apk, dex_ord)) if x[0] in wanted)
        except Exception as e:  # a bad entry costs that entry only
            yield "error", {"apk_id": apk, "side": side, "entry": name, "error": f"{type(e).__name__}: {e}"}
    if wanted & {"element", "raw"}:
        try:
            root = manifest_xml.parse(archive.read(MANIFEST))
            yield "raw", {"apk_id": apk, "side": side, "xml": manifest_xml.to_xml(root)}
            yield from (("element", {"apk_id": apk, "side": side} | r) for r in manifest_xml.rows(root))
        except Exception as e:
            yield "error", {"apk_id": apk, "side": side, "entry": MANIFEST, "error": f"{type(e).__name__}: {e}"}


def _reader(side: str, wanted: set[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def flushed(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                apk, held = path.rsplit("/", 1)[-1].removesuffix(".apk"), []
                try:
                    where, inner = fs.FileSystem.from_uri(path)
                    with where.open_input_file(inner) as f, zipfile.ZipFile(f) as archive:
                        for table, row in archive_rows(archive, apk, side, wanted):
                            held.append({"table": table, table: row})
                            if len(held) >= 500:
                                yield flushed(held)
                                held = []
                except Exception as e:
                    held.append({"table": "error", "error": {"apk_id": apk, "side": side, "entry": None, "error": f"{type(e).__name__}: {e}"}})
                if held:
                    yield flushed(held)

    return run


def read_archives(spark: SparkSession, paths: str | Iterable[str], side: str = "old", tables: Iterable[str] = ("class", "method", "element", "raw"), on_error: str = "collect") -> dict[str, DataFrame]:
    """The tables of archives (S1-S8), decoded once; ``error`` is always among them. ``paths`` are files or folders.

    ``on_error='raise'`` stops at an archive or entry that can't be read, as a call graph run does."""
    ship(spark)
    wanted = set(tables)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.apk").option("recursiveFileLookup", "true").load([paths] if isinstance(paths, str) else list(paths))
    files = found.select("path")  # the content column is never read
    n = files.count()
    names = [t for t in SCHEMAS if t in wanted or t == "error"]
    ddl = "`table` string, " + ", ".join(f"`{t}` struct<{_struct(SCHEMAS[t])}>" for t in names)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(ddl))
    # An archive takes a while to decode, so each is a task of its own until there are very many.
    rows = cut(files.repartition(max(1, min(n, 10_000))).mapInArrow(_reader(side, wanted, arrow), ddl), "archives")
    out = {t: rows.filter(F.col("table") == t).select(f"`{t}`.*") for t in names}
    if on_error == "raise":
        bad = out["error"].take(1)
        if bad:
            raise UnreadableArchive(f"{bad[0]['apk_id']} {bad[0]['entry'] or ''}: {bad[0]['error']}")
    return out


def _struct(ddl: str) -> str:
    return T._parse_datatype_string(ddl).simpleString()[len("struct<") : -1]


def read_text_manifests(spark: SparkSession, paths: str | Iterable[str], side: str = "old") -> tuple[DataFrame, DataFrame]:
    """Elements and errors of text manifests, one to a file; the file's name without ending is the application's id."""
    ship(spark)
    files = spark.read.text([paths] if isinstance(paths, str) else list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"`table` string, element struct<{_struct(ELEMENT_SCHEMA)}>, error struct<{_struct(ERROR_SCHEMA)}>"
    schema = to_arrow_schema(T._parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {"apk_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "side": side}
                try:
                    made = [{"table": "element", "element": own | r} for r in manifest_xml.rows(manifest_xml.parse_text(xml))]
                except manifest_xml.ManifestError as e:
                    made = [{"table": "error", "error": own | {"entry": path, "error": str(e)}}]
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    rows = cut(files.mapInArrow(run, ddl), "manifests")
    return rows.filter("`table` = 'element'").select("element.*"), rows.filter("`table` = 'error'").select("error.*")
