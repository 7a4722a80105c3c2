"""Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkwright.plans.runtime import release

__all__ = ["as_frame", "read_table", "write_table", "drop_scratch_tables"]


def as_frame(spark: SparkSession, data) -> DataFrame:
    """A DataFrame from a DataFrame, a pandas frame, a list of dicts or a table name."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return spark.table(data)
    return spark.createDataFrame(data)


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    return spark.read.format(format).options(**options).load(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def drop_scratch_tables() -> int:
    """Delete the scratch tables of this process; frames that still read them fail afterwards."""
    return release()
