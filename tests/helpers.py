"""Builders of small inputs, and the comparison of a query with its oracle."""

import glob
import math
import os

import duckdb

from strandbase.sources.archives import CLASS_SCHEMA, METHOD_SCHEMA

OP = ("ord", "kind", "opcode", "callee_class", "callee_name", "callee_desc")


def op(i, opcode=None, callee=None, kind="Op"):
    return (i, kind, opcode, *(callee or (None, None, None)))


def method(cls, name, ops, side="old", apk="a", desc="()V", args=(), ret="void", dex=0, cord=0, mord=0, params=0, text=None):
    java = cls[1:-1].replace("/", ".") if cls.endswith(";") else cls
    pkg = cls[1:-1].rpartition("/")[0] if cls.endswith(";") else None
    return (side, apk, dex, cord, mord, cls, java, pkg, name, desc, list(args), ret, params, text, ops)


def methods(spark, rows):
    return spark.createDataFrame(rows, METHOD_SCHEMA)


def classes(spark, rows):
    """Rows of (side, apk, dex, class ord, jni name)."""
    return spark.createDataFrame([(s, a, d, c, j, j[1:-1].replace("/", ".") if j.endswith(";") else j, None) for s, a, d, c, j in rows], CLASS_SCHEMA)


def classes_of(spark, method_rows):
    return classes(spark, sorted({(r[0], r[1], r[2], r[3], r[5]) for r in method_rows}))


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


def oracle_rows(sf_dir, sql):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    rel = c.sql(sql)
    order = sorted(rel.columns)
    at = [rel.columns.index(k) for k in order]
    return order, sorted((tuple(normal(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def query_rows(df):
    order = sorted(df.columns)
    return order, sorted((tuple(normal(r[k]) for k in order) for r in df.collect()), key=repr)
