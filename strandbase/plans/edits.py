"""Query of problem 2 over the snapshot tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbase.operators import snapshots
from strandbase.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = (
        ("method", "signature", snapshots.method_edits(table(spark, sf_dir, "method_snapshot"))),
        ("manifest", "package_name", snapshots.manifest_edits(table(spark, sf_dir, "manifest_snapshot"))),
    )
    parts = [df.select(F.lit(kind).alias("rec_kind"), F.col("snap_no").cast("int").alias("snap_no"), "apk_id", F.col(key).alias("rec_key"), "edit") for kind, key, df in made]
    return parts[0].unionByName(parts[1])


QUERIES = {"p2_found": p2_found}

_SIDE = """
{t}_rows as (
  select snap_no, apk_id, {key} as rec_key, {content} as content from {t}
  qualify row_number() over (partition by snap_no, apk_id, {key} order by loaded_at desc) = 1),
{t}_order as (select snap_no, lag(snap_no) over (order by snap_no) as prev from (select distinct snap_no from {t})),
{t}_old as (select o.snap_no, r.apk_id, r.rec_key, r.content from {t}_order o join {t}_rows r on r.snap_no = o.prev),
{t}_new as (select r.* from {t}_rows r join {t}_order o on o.snap_no = r.snap_no where o.prev is not null),
{t}_edits as (
  select '{kind}' as rec_kind, coalesce(n.snap_no, o.snap_no) as snap_no, coalesce(n.apk_id, o.apk_id) as apk_id,
    coalesce(n.rec_key, o.rec_key) as rec_key,
    case when o.content is null then 'ADDED' when n.content is null then 'REMOVED' else 'CHANGED' end as edit
  from {t}_new n full join {t}_old o on n.snap_no = o.snap_no and n.apk_id = o.apk_id and n.rec_key = o.rec_key
  where o.content is null or n.content is null or o.content <> n.content)
"""

ORACLE = {
    "p2_found": "with "
    + _SIDE.format(t="method_snapshot", kind="method", key="signature", content="coalesce(list_transform(list_sort(ops), lambda x: coalesce(x.opcode, x.kind)), [])")
    + ", "
    + _SIDE.format(
        t="manifest_snapshot", kind="manifest", key="package_name",
        content=r"coalesce(list_sort(list_distinct(list_filter(list_transform(uses_permissions, lambda x: regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), lambda x: x <> ''))), [])",
    )
    + "select * from method_snapshot_edits union all select * from manifest_snapshot_edits"
}
