"""Label files for people to fill in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.diagnose import match_type

__all__ = ["export_for_labelling", "import_labels"]


def export_for_labelling(sample: DataFrame, path: str, default_label: int = 1) -> None:
    """CSV, with ``equal`` first: the header row of each pair or group has the default, the others are blank to inherit it.

    A sample to label is small, so it is one file, in order.
    """
    kind = match_type(sample)
    key = "match_id" if kind == "candidates" else "duplicate_group"
    header = F.col("source") == "base" if kind == "candidates" else F.col("rank") == 1
    rows = sample.select(F.when(header, F.lit(default_label)).alias("equal"), *sample.columns)
    order = [key, "rank"] if "rank" in sample.columns else [key]
    rows.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def import_labels(spark: SparkSession, path: str) -> DataFrame:
    """Read labels back: blanks take their pair's or group's header label; anything but 0, 1 or blank is an error."""
    rows = spark.read.option("header", True).csv(path)
    if "equal" not in rows.columns:
        raise ValueError("the file has no column equal")
    bad = rows.where("equal is not null and trim(equal) not in ('0', '1', '')")
    if first := bad.first():
        raise ValueError(f"equal must be 0, 1 or blank, not {first['equal']!r}")
    kind = match_type(rows)
    key = "match_id" if kind == "candidates" else "duplicate_group"
    header = F.col("source") == "base" if kind == "candidates" else F.col("rank").cast("int") == 1
    given = F.expr("try_cast(nullif(trim(equal), '') as int)")
    rows = rows.withColumn("equal", given)
    defaults = rows.where(header).groupBy(key).agg(F.first("equal", True).alias("_default"))
    out = rows.join(defaults, key, "left").withColumn("equal", F.coalesce("equal", "_default")).drop("_default")
    if out.where("equal is null").limit(1).count():
        raise ValueError("some rows have no label and no header row to take one from")
    for c, t in (("score", "double"), ("rank", "int"), (key, "long")):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast(t))
    return out.select("equal", *[c for c in rows.columns if c != "equal"])
