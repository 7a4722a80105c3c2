"""Consecutive numbers without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.plans.runtime import stash

__all__ = ["number_rows"]


def number_rows(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``name`` counts rows from 1 in ``order``: ranges are sorted apart and offset by the counts before them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stash(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a partition
    offsets = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_in", inside).join(offsets, "_range").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_range", "_in", "_before")
