"""The manifest summary over made-up trees, one for each summary id, with components, attributes of every kind and fallbacks.

Attribute number j of summary s has kind (s + j) % 5 and a value that follows from s and j, so both sides can state it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbase.functions.attributes import ATTRIBUTES
from strandbase.operators import manifest
from strandbase.runtime import table

KINDS = ["String", "Boolean", "Integer", "Hex", "Reference"]
STRINGS = ["true", "false", "yes", ""]
_ELEMENT = f"array<struct<element_id:bigint,parent_id:bigint,sibling_ord:int,depth:int,tag:string,attrs:{ATTRIBUTES}>>"


def _id() -> Column:
    return F.col("summary_id")


def _said(name: str, value: str) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(name).alias("name"), F.lit(value).alias("raw_value"), F.lit("String").alias("kind"), F.lit(value).alias("s"), none.cast("boolean").alias("b"), none.cast("bigint").alias("i"))


def _made(name: str, j: int) -> Column:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), ((_id() + j) % 5 + 1).cast("int"))
    n = (_id() * 7 + 13 * j) % 300
    word = F.element_at(F.array(*map(F.lit, STRINGS)), ((_id() + j) % 4 + 1).cast("int"))
    value = lambda ok, v: F.when(ok, v)
    return F.struct(
        F.lit(name).alias("name"), n.cast("string").alias("raw_value"), kind.alias("kind"), value(kind == "String", word).alias("s"),
        value(kind == "Boolean", n % 2 == 1).alias("b"), value(kind.isin("Integer", "Hex", "Reference"), n).cast("bigint").alias("i"),
    )


def _element(at: int, parent: int | None, order: int, tag: str, *attrs: Column, when: Column | None = None) -> Column:
    own = F.array(*attrs) if attrs else F.array().cast(ATTRIBUTES)
    made = F.struct(F.lit(at).cast("bigint").alias("element_id"), F.lit(parent).cast("bigint").alias("parent_id"), F.lit(order).alias("sibling_ord"), F.lit(1).alias("depth"), F.lit(tag).alias("tag"), own.alias("attrs"))
    return made if when is None else F.when(when, made)


def part_trees(rows: DataFrame) -> DataFrame:
    """Manifest elements of rows with a ``summary_id``, given in another order than the document's."""
    m3 = _id() % 3
    platform = F.filter(F.array(F.when(m3 == 0, _made("platformBuildVersionCode", 2)), F.when(m3 < 2, _made("android:platformBuildVersionCode", 3))), lambda a: a.isNotNull())
    root = F.concat(F.array(_said("package", "p.q"), _made("android:versionCode", 1), _made("android:minSdkVersion", 4)), platform)
    services = [
        _element(30 + k, 1, 10 - k, "service", _said("android:name", f"S{k}"), _said("android:name", "again"), _made("android:exported", 10 + k), _made("android:enabled", 20 + k), _made("android:permission", 30 + k), _made("android:process", 40 + k), when=m3 > k)
        for k in (0, 1)
    ]
    launcher = [
        _element(20, 1, 0, "activity", _said("android:name", "A1"), _made("android:launchMode", 7)), _element(21, 1, 1, "activity", _said("android:name", "A2")),
        _element(22, 1, 2, "activity-alias", _said("android:name", "A0")), _element(23, 21, 0, "intent-filter", when=m3 < 2),
        _element(24, 23, 0, "action", _said("android:name", "android.intent.action.MAIN")), _element(25, 23, 1, "category", _said("android:name", "android.intent.category.LAUNCHER"), when=m3 == 1),
    ]
    odd = _id() % 2 == 1
    every = [
        *services, *launcher,
        _element(2, 0, 0, "uses-sdk", *[_made("android:minSdkVersion", 5)], when=_id() % 4 == 0),
        _element(1, 0, 1, "application", _made("android:label", 8), when=_id() % 11 != 0),
        _element(40, 1, 20, "receiver", _said("android:name", "R"), when=odd), _element(41, 40, 0, "intent-filter", when=odd),
        _element(43, 41, 1, "data", _made("android:scheme", 50), _made("android:port", 51)), _element(42, 41, 0, "action", _said("android:name", "go")),
        _element(50, 1, 21, "provider", _made("android:authorities", 60), _made("android:exported", 61), _made("android:readPermission", 62), _made("android:grantUriPermissions", 63), _made("android:multiprocess", 64), _made("android:syncable", 65), when=_id() % 4 == 1),
        _element(60, 1, 22, "uses-library", _said("android:name", "lib"), _made("android:required", 70)),
        _element(70, 1, 23, "meta-data", _said("android:name", "m"), _made("android:value", 80), _made("android:resource", 81), when=m3 > 0),
        _element(80, 0, 5, "instrumentation", _made("android:name", 90), _made("android:targetPackage", 91), _made("android:handleProfiling", 92), _made("android:functionalTest", 93), when=_id() % 5 == 0),
        _element(90, 0, 6, "supports-screens", _made("android:smallScreens", 95), _made("android:anyDensity", 96), _made("android:requiresSmallestWidthDp", 97), when=odd),
    ]
    top = F.struct(F.lit(0).cast("bigint").alias("element_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("sibling_ord"), F.lit(0).alias("depth"), F.lit("manifest").alias("tag"), root.alias("attrs"))
    elements = F.filter(F.array(top, *every).cast(_ELEMENT), lambda e: e.isNotNull())
    return rows.select(_id().cast("string").alias("apk_id"), F.lit("old").alias("side"), F.explode(elements).alias("e")).select("apk_id", "side", "e.*")


def _joined(x: Column, *fields: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest.manifest_summary(part_trees(table(spark, sf_dir, "manifest_summary").select("summary_id").distinct()))
    return made.withColumn("summary_id", F.col("apk_id").cast("bigint"))


def manifest_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = F.col("application")
    return _summaries(spark, sf_dir).select(
        "summary_id", "package_name", "version_code", F.col("platform_build_version_code").alias("platform"), F.col("sdk.min_sdk_version").alias("min_sdk"), "main_activity",
        app["label"].alias("label"), app["activities"][0]["launch_mode"].alias("launch_mode"),
    )


def manifest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c, *f: F.coalesce(F.array_join(F.transform(c, lambda x: _joined(x, *f)), ","), F.lit("")).alias(str(f[-1]))
    app = lambda part, *f: of(F.col(f"application.{part}"), *f).alias(part)
    filters = lambda x: F.array_join(F.transform(x["intent_filters"], lambda i: F.concat_ws("|", F.array_join(i["actions"], ";"), F.array_join(i["categories"], ";"), F.array_join(F.transform(i["data"], lambda d: _joined(d, "scheme", "port")), ";"))), ";")
    return _summaries(spark, sf_dir).select(
        "summary_id", app("services", "name", "exported", "enabled", "permission", "process"),
        F.coalesce(F.array_join(F.transform("application.receivers", lambda x: F.concat_ws("|", x["name"], filters(x))), ","), F.lit("")).alias("receivers"),
        app("providers", "name", "authorities", "exported", "read_permission", "grant_uri_permissions", "multiprocess", "syncable"), app("uses_libraries", "name", "required"),
        app("meta_data", "name", "value", "resource"), of(F.col("instrumentation"), "name", "target_package", "handle_profiling", "functional_test").alias("instrumentation"),
        F.when(F.col("supports_screens").isNotNull(), _joined(F.col("supports_screens"), "small_screens", "large_screens", "any_density", "requires_smallest_width_dp")).alias("screens"),
    )


QUERIES = {f.__name__: f for f in (manifest_attributes, manifest_components)}


def _text(j: int) -> str:
    n, words = f"((s * 7 + {13 * j}) % 300)", "[" + ", ".join(f"'{w}'" for w in STRINGS) + "]"
    return f"case (s + {j}) % 5 when 0 then {words}[(s + {j}) % 4 + 1] when 1 then case when {n} % 2 = 1 then 'true' else 'false' end when 2 then cast({n} as varchar) when 3 then printf('0x%x', {n}) else printf('@0x%08x', {n}) end"


def _flag(j: int) -> str:
    n, words = f"((s * 7 + {13 * j}) % 300)", "[" + ", ".join(f"'{w}'" for w in STRINGS) + "]"
    word = f"{words}[(s + {j}) % 4 + 1]"
    return f"coalesce(case (s + {j}) % 5 when 0 then case when {word} in ('true', 'false') then {word} end when 1 then case when {n} % 2 = 1 then 'true' else 'false' end when 2 then case when {n} <> 0 then 'true' else 'false' end end, '-')"


def _row(*cells: str) -> str:
    return " || '|' || ".join(cells)


_SERVICE = ["(" + _row(f"'S{k}'", _flag(10 + k), _flag(20 + k), _text(30 + k), _text(40 + k)) + ")" for k in (0, 1)]
_IDS = "with ids as (select distinct summary_id as s from manifest_summary) select s as summary_id, "
_CODE = f"case when (s + 1) % 5 in (0, 2) then {_text(1)} else ['String', 'Boolean', 'Integer', 'Hex', 'Reference'][(s + 1) % 5 + 1] || '(' || case when (s + 1) % 5 = 1 then {_text(1)} else cast((s * 7 + 13) % 300 as varchar) end || ')' end"
ORACLE = {
    "manifest_attributes": _IDS + f"""'p.q' as package_name, {_CODE} as version_code, case s % 3 when 0 then {_text(2)} when 1 then {_text(3)} end as platform,
  case when s % 4 = 0 then {_text(5)} else {_text(4)} end as min_sdk, case when s % 3 = 1 and s % 11 <> 0 then 'A2' end as main_activity,
  case when s % 11 <> 0 then {_text(8)} end as label, case when s % 11 <> 0 then {_text(7)} end as launch_mode from ids""",
    "manifest_components": _IDS + f"""case when s % 11 = 0 or s % 3 = 0 then '' when s % 3 = 1 then {_SERVICE[0]} else {_SERVICE[1]} || ',' || {_SERVICE[0]} end as services,
  case when s % 11 = 0 or s % 2 = 0 then '' else 'R|go||' || {_row(_text(50), _text(51))} end as receivers,
  case when s % 11 = 0 or s % 4 <> 1 then '' else {_row("''", _text(60), _flag(61), _text(62), _flag(63), _flag(64), _flag(65))} end as providers,
  case when s % 11 = 0 then '' else 'lib|' || {_flag(70)} end as uses_libraries,
  case when s % 11 = 0 or s % 3 = 0 then '' else {_row("'m'", _text(80), _text(81))} end as meta_data,
  case when s % 5 = 0 then {_row(_text(90), _text(91), _flag(92), _flag(93))} else '' end as instrumentation,
  case when s % 2 = 1 then {_row(_flag(95), "'-'", _flag(96), _text(97))} end as screens from ids""",
}
