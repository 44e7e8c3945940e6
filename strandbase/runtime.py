"""What every operator needs of the session: table reading, shared storage for cut lineage, worker-safe column names."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once for each Spark context: an archive of its sources in the
    shared folder."""
    context = spark.sparkContext
    if getattr(context, "_strandbase_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in sorted(os.walk(here)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    path = f"{shared_dir(spark)}/strandbase-code/{os.getpid()}-{uuid.uuid4().hex[:12]}.zip"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    out.write(held.getvalue())
    out.close()
    _written.append((spark, path))
    context.addPyFile(path)
    context._strandbase_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a single-machine session may do without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own_dir
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="strandbase-")
    return _own_dir


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    if _own_dir:
        shutil.rmtree(_own_dir[len("file://"):], ignore_errors=True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The written table survives the loss of executors, has a short lineage, keeps column pruning and gives the planner
    exact sizes. It is removed when the driver's process ends, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandbase/{os.getpid()}-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")  # once the table is written, nothing reads its shuffle files again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Removes tables made by ``cut`` that no later step reads."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            _remove(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def trimmed(c: Column) -> Column:
    """``c`` without surrounding Unicode white space."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")


def ordered_ops(ops: Column) -> Column:
    """``ops`` in ``ord`` order without null elements (null for null). Equal ``ord`` values are ordered by the remaining
    fields, so that the order never depends on the array's."""
    return F.array_sort(F.filter(ops, lambda x: x.isNotNull()))


def op_fields(ops: Column, *names: str) -> Column:
    """``ops`` with the named fields only. Unlike a function over whole elements this lets the scan skip the other fields'
    columns, which hold most of the bytes."""
    return F.arrays_zip(*(ops[n] for n in names))


def op_kinds(ops: Column) -> Column:
    """The sequence of opcodes in ``ord`` order, the element's kind where there is none. Null for null; elements that have
    neither, null ones among them, are left out."""
    named = F.filter(op_fields(ops, "ord", "opcode", "kind"), lambda x: x["opcode"].isNotNull() | x["kind"].isNotNull())
    return F.transform(F.array_sort(named), lambda x: F.coalesce(x["opcode"], x["kind"]))


def op_ids(ops: Column) -> Column:
    """64-bit identities of the ops in ``ord`` order: equal kind, opcode and callee fields give equal ids. Null for null."""
    part = lambda c: F.coalesce(c, F.lit("\u0000"))  # noqa: E731 - xxhash64 skips nulls
    return F.transform(
        ordered_ops(ops),
        lambda x: F.xxhash64(*(part(x[k]) for k in ("kind", "opcode", "callee_class", "callee_name", "callee_desc"))),
    )
