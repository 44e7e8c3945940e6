"""The engine's tables as Parquet, partitioned by side, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandbase.sources.archives import SCHEMAS


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Writes each table below ``path``; a side is a partition, so reading one side reads only its files."""
    for name, df in tables.items():
        df.write.mode(mode).partitionBy("side").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table written by ``write_tables``; the schema is declared, not inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
