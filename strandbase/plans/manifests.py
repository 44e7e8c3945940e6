"""The manifest summary over element trees made from the manifest table, one tree for each summary id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbase.functions.attributes import ATTRIBUTES
from strandbase.operators import manifest, permissions
from strandbase.runtime import table

_ELEMENT = f"struct<element_id:bigint,parent_id:bigint,sibling_ord:int,depth:int,tag:string,attrs:{ATTRIBUTES}>"
#: Ids of the fixed elements, and the first ids of permissions and features.
ROOT, SDK, APP, ACTIVITY, FILTER, ACTION, CATEGORY, PERMISSIONS, FEATURES = 0, 1, 2, 3, 4, 5, 6, 1_000, 1_000_000


def _attrs(**values: Column) -> Column:
    """Attributes with a value; booleans are typed, everything else is a string."""
    made = []
    for name, v in values.items():
        full = F.lit(name.replace("__", ":"))
        bool_ = name.endswith("required")
        empty = lambda t: F.lit(None).cast(t)
        made.append(F.struct(
            full.alias("name"), v.cast("string").alias("raw_value"), F.lit("Boolean" if bool_ else "String").alias("kind"),
            (empty("string") if bool_ else v).alias("s"), (v if bool_ else empty("boolean")).alias("b"), empty("bigint").alias("i"),
        ))
    return F.filter(F.array(*made), lambda a: a["raw_value"].isNotNull())


def _element(at: Column, parent: Column | int | None, order: Column | int, depth: int, tag: str, attrs: Column) -> Column:
    value = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        value(at, "bigint").alias("element_id"), value(parent, "bigint").alias("parent_id"), value(order, "int").alias("sibling_ord"), F.lit(depth).alias("depth"), F.lit(tag).alias("tag"), attrs.cast(ATTRIBUTES).alias("attrs")
    )


def element_trees(rows: DataFrame) -> DataFrame:
    """Manifest elements of rows of the manifest table; apk_id is the summary's id."""
    c = F.col
    none = F.array().cast(ATTRIBUTES)
    fixed = [
        _element(ROOT, None, 0, 0, "manifest", _attrs(package=c("package_name"), android__versionCode=c("version_code"), android__versionName=c("version_name"), android__installLocation=c("install_location"))),
        _element(SDK, ROOT, 0, 1, "uses-sdk", _attrs(android__minSdkVersion=c("sdk.min_sdk_version"), android__targetSdkVersion=c("sdk.target_sdk_version"), android__maxSdkVersion=c("sdk.max_sdk_version"))),
        _element(APP, ROOT, 1, 1, "application", none),
        _element(ACTIVITY, APP, 0, 2, "activity", _attrs(android__name=c("main_activity"))),
        _element(FILTER, ACTIVITY, 0, 3, "intent-filter", none),
        _element(ACTION, FILTER, 0, 4, "action", _attrs(android__name=F.lit("android.intent.action.MAIN"))),
        _element(CATEGORY, FILTER, 1, 4, "category", _attrs(android__name=F.lit("android.intent.category.LAUNCHER"))),
    ]
    uses = F.transform("uses_permissions", lambda x, i: _element(i + PERMISSIONS, ROOT, i + PERMISSIONS, 1, "uses-permission", _attrs(android__name=x)))
    has = F.transform("uses_features", lambda x, i: _element(i + FEATURES, ROOT, i + FEATURES, 1, "uses-feature", _attrs(android__name=x["name"], android__glEsVersion=x["gl_es_version"], android__required=x["required"])))
    empty = F.array().cast(f"array<{_ELEMENT}>")
    every = F.concat(F.array(*fixed).cast(f"array<{_ELEMENT}>"), F.coalesce(uses.cast(f"array<{_ELEMENT}>"), empty), F.coalesce(has.cast(f"array<{_ELEMENT}>"), empty))
    return rows.select(c("summary_id").cast("string").alias("apk_id"), "side", F.explode(every).alias("e")).select("apk_id", "side", "e.*")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return element_trees(table(spark, sf_dir, "manifest_summary").dropDuplicates(["summary_id"]))  # deliveries of one id are alike


def manifest_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest.manifest_summary(_trees(spark, sf_dir))
    shown = F.transform("uses_features", lambda f: F.concat_ws("|", F.coalesce(f["name"], F.lit("-")), F.coalesce(f["gl_es_version"], F.lit("-")), F.coalesce(f["required"].cast("string"), F.lit("-"))))
    return made.select(
        F.col("apk_id").cast("bigint").alias("summary_id"), "side", "package_name", "version_code", "version_name", "install_location", F.col("sdk.min_sdk_version").alias("min_sdk"),
        F.col("sdk.target_sdk_version").alias("target_sdk"), F.col("sdk.max_sdk_version").alias("max_sdk"), F.array_join("uses_permissions", ",").alias("permissions"),
        F.array_join(shown, ",").alias("features"), "main_activity", F.size("application.activities").cast("bigint").alias("n_activities"),
    )


def manifest_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = permissions.permission_entries(_trees(spark, sf_dir))
    return made.select(F.col("apk_id").cast("bigint").alias("summary_id"), "side", (F.col("pos.element_id") - PERMISSIONS).alias("place"), "permission")


QUERIES = {f.__name__: f for f in (manifest_flat, manifest_permissions)}

_ONE = "with one as (select * from manifest_summary qualify row_number() over (partition by summary_id order by loaded_at) = 1)"
ORACLE = {
    "manifest_flat": _ONE + """
select summary_id, side, package_name, version_code, version_name, install_location, sdk.min_sdk_version as min_sdk, sdk.target_sdk_version as target_sdk, sdk.max_sdk_version as max_sdk,
  coalesce(array_to_string(list_filter(uses_permissions, lambda x: x is not null), ','), '') as permissions,
  coalesce(array_to_string(list_transform(uses_features, lambda f: coalesce(f.name, '-') || '|' || coalesce(f.gl_es_version, '-') || '|' || coalesce(cast(f.required as varchar), '-')), ','), '') as features,
  coalesce(main_activity, '') as main_activity, 1 as n_activities from one""",
    "manifest_permissions": _ONE + " select summary_id, side, place, permission from (select summary_id, side, unnest(uses_permissions) as permission, unnest(range(len(uses_permissions))) as place from one) where permission is not null",
}
