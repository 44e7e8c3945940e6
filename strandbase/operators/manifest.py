"""The manifest's element tree as one nested summary row for each (apk_id, side).

Four joins from the leaves to the root: actions, categories and data into intent filters, filters into components,
components into the application, the rest into the root. Children keep document order. A manifest without an application
has a null one; activity aliases don't count for the main activity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbase.functions.attributes import attribute_values, flag, name_or_empty, text, version_code

DOC = ["apk_id", "side"]
COMPONENTS = {"activity": "activities", "service": "services", "receiver": "receivers"}
#: The elements that a summary is made of.
SUMMARISED = (
    "manifest", "application", *COMPONENTS, "provider", "intent-filter", "action", "category", "data", "uses-library", "meta-data", "uses-permission", "permission",
    "uses-feature", "instrumentation", "supports-screens", "uses-sdk",
)
_A = F.col


def _texts(**names: str) -> list[Column]:
    return [text(_A("values"), *n.split("|")).alias(k) for k, n in names.items()]


def _flags(**names: str) -> list[Column]:
    return [flag(_A("values"), n).alias(k) for k, n in names.items()]


def _name() -> Column:
    return name_or_empty(_A("values")).alias("name")


def _listed(tag: str, value: Column, keep: Column | None = None) -> Column:
    """The children of a tag in document order, as an array of ``value``."""
    wanted = (_A("tag") == tag) if keep is None else (_A("tag") == tag) & keep
    return F.sort_array(F.collect_list(F.when(wanted, F.struct(_A("sibling_ord").alias("o"), value.alias("v")))))["v"]


def _first(tag: str, value: Column) -> Column:
    return F.min_by(F.when(_A("tag") == tag, value), F.when(_A("tag") == tag, _A("sibling_ord")))


def intent_filters(elements: DataFrame) -> DataFrame:
    """(apk_id, side, element_id, filters): the intent filters of each component."""
    name = text(_A("values"), "android:name")
    data = F.struct(*_texts(scheme="android:scheme", host="android:host", port="android:port", path="android:path", path_pattern="android:pathPattern", path_prefix="android:pathPrefix", mime_type="android:mimeType"))
    leaves = elements.filter(_A("tag").isin("action", "category", "data"))
    inner = leaves.groupBy(*DOC, _A("parent_id").alias("element_id")).agg(
        _listed("action", name, name.isNotNull()).alias("actions"), _listed("category", name, name.isNotNull()).alias("categories"), _listed("data", data).alias("data")
    )
    none = F.array().cast("array<string>")
    outer = elements.filter("tag = 'intent-filter'").select(*DOC, "element_id", "parent_id", "sibling_ord", "tag").join(inner, [*DOC, "element_id"], "left")
    kind = dict(inner.dtypes)["data"]
    one = F.struct(F.coalesce("actions", none).alias("actions"), F.coalesce("categories", none).alias("categories"), F.coalesce("data", F.array().cast(kind)).alias("data"))
    return outer.groupBy(*DOC, _A("parent_id").alias("element_id")).agg(_listed("intent-filter", one).alias("intent_filters"))


def manifest_summary(elements: DataFrame) -> DataFrame:
    """One row for each manifest; columns are the summary's fields in order, nested as they are rendered."""
    elements = elements.filter(_A("tag").isin(*SUMMARISED) | _A("parent_id").isNull())
    code = F.when(_A("parent_id").isNull(), version_code(_A("attrs")))
    elements = elements.withColumns({"values": attribute_values(_A("attrs")), "version_code": code}).drop("attrs")
    filters = intent_filters(elements)
    kind = dict(filters.dtypes)["intent_filters"]
    rows = elements.join(filters, [*DOC, "element_id"], "left").withColumn("intent_filters", F.coalesce("intent_filters", F.array().cast(kind)))
    component = F.struct(
        _name(), *_flags(exported="android:exported", enabled="android:enabled"), *_texts(permission="android:permission", process="android:process"), _A("intent_filters"),
        *_texts(launch_mode="android:launchMode", config_changes="android:configChanges", parent_activity_name="android:parentActivityName", screen_orientation="android:screenOrientation", window_soft_input_mode="android:windowSoftInputMode"),
    )
    provider = F.struct(
        _name(), *_texts(authorities="android:authorities"), *_flags(exported="android:exported", enabled="android:enabled"),
        *_texts(read_permission="android:readPermission", write_permission="android:writePermission", permission="android:permission"),
        *_flags(grant_uri_permissions="android:grantUriPermissions", multiprocess="android:multiprocess", syncable="android:syncable"), _A("intent_filters"),
    )
    library = F.struct(_name(), *_flags(required="android:required"))
    meta = F.struct(_name(), *_texts(value="android:value", resource="android:resource"))
    parts = rows.filter(_A("tag").isin(*COMPONENTS, "provider", "uses-library", "meta-data")).groupBy(*DOC, _A("parent_id").alias("element_id")).agg(
        *(_listed(tag, component).alias(field) for tag, field in COMPONENTS.items()), _listed("provider", provider).alias("providers"),
        _listed("uses-library", library).alias("uses_libraries"), _listed("meta-data", meta).alias("meta_data"),
    )
    kinds = dict(parts.dtypes)
    children = [F.coalesce(f, F.array().cast(kinds[f])).alias(f) for f in (*COMPONENTS.values(), "providers", "uses_libraries", "meta_data")]
    roots = elements.filter("parent_id is null").select(*DOC, _A("element_id").alias("root_id"), _A("values").alias("root_values"), "version_code")
    apps = rows.filter("tag = 'application'").join(parts, [*DOC, "element_id"], "left")
    application = F.struct(
        *_texts(label="android:label", icon="android:icon", name="android:name"),
        *_flags(allow_backup="android:allowBackup", debuggable="android:debuggable", test_only="android:testOnly", has_code="android:hasCode"), *_texts(theme="android:theme"),
        *_flags(allow_clear_user_data="android:allowClearUserData", hardware_accelerated="android:hardwareAccelerated", large_heap="android:largeHeap", supports_rtl="android:supportsRtl"),
        *children,
    )
    app = apps.groupBy(*DOC, _A("parent_id").alias("root_id")).agg(_first("application", application).alias("application"))
    declared = F.struct(_name(), *_texts(protection_level="android:protectionLevel", label="android:label", description="android:description", permission_group="android:permissionGroup"))
    feature = F.struct(*_texts(name="android:name", gl_es_version="android:glEsVersion"), *_flags(required="android:required"))
    instrumentation = F.struct(_name(), *_texts(target_package="android:targetPackage", label="android:label"), *_flags(handle_profiling="android:handleProfiling", functional_test="android:functionalTest"))
    screens = F.struct(
        *_flags(resizeable="android:resizeable", small_screens="android:smallScreens", normal_screens="android:normalScreens", large_screens="android:largeScreens", xlarge_screens="android:xlargeScreens", any_density="android:anyDensity"),
        *_texts(requires_smallest_width_dp="android:requiresSmallestWidthDp", compatible_width_limit_dp="android:compatibleWidthLimitDp", largest_width_limit_dp="android:largestWidthLimitDp"),
    )
    name = text(_A("values"), "android:name")
    sdk = F.struct(*_texts(min="android:minSdkVersion", target="android:targetSdkVersion", max="android:maxSdkVersion"))
    rest = elements.filter(_A("tag").isin("uses-permission", "permission", "uses-feature", "instrumentation", "supports-screens", "uses-sdk")).groupBy(*DOC, _A("parent_id").alias("root_id")).agg(
        _listed("uses-permission", name, name.isNotNull()).alias("uses_permissions"), _listed("permission", declared).alias("declares_permissions"),
        _listed("uses-feature", feature).alias("uses_features"), _listed("instrumentation", instrumentation).alias("instrumentation"),
        _first("supports-screens", screens).alias("supports_screens"), _first("uses-sdk", sdk).alias("own_sdk"),
    )
    kinds = dict(rest.dtypes)
    full = roots.join(app, [*DOC, "root_id"], "left").join(rest, [*DOC, "root_id"], "left")
    root = lambda *names: text(_A("root_values"), *names)
    version = lambda k: F.coalesce(_A(f"own_sdk.{k}"), root(f"android:{k}SdkVersion")).alias(f"{k}_sdk_version")
    some = lambda f: F.coalesce(f, F.array().cast(kinds[f])).alias(f)
    launches = lambda f: F.array_contains(f["actions"], "android.intent.action.MAIN") & F.array_contains(f["categories"], "android.intent.category.LAUNCHER")
    main = F.try_element_at(F.filter("application.activities", lambda a: F.exists(a["intent_filters"], launches)), F.lit(1))["name"]
    return full.select(
        *DOC, root("package").alias("package_name"), "version_code", root("android:versionName").alias("version_name"),
        root("android:installLocation").alias("install_location"), root("platformBuildVersionCode", "android:platformBuildVersionCode").alias("platform_build_version_code"),
        root("platformBuildVersionName", "android:platformBuildVersionName").alias("platform_build_version_name"), F.struct(version("min"), version("target"), version("max")).alias("sdk"),
        some("uses_permissions"), some("declares_permissions"), some("uses_features"), main.alias("main_activity"), "application", some("instrumentation"), "supports_screens",
    )
