"""Linking a stream of records to a base that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkwright.operators.verbs import candidate_pairs
from linkwright.plans.runtime import stash

__all__ = ["link_stream"]


def link_stream(stream: DataFrame, base_path: str, links_path: str, id: str, strategy, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is linked to the base table, its links appended, and the batch joined to the base.

    Base and links are Parquet partitioned by ``batch``; a batch that is run again
    overwrites its own partitions, so a restart neither loses nor repeats a record.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = stash(batch)
        try:
            base = spark.read.parquet(base_path).where(F.col("batch") < number).drop("batch")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            base = fresh.limit(0)
        pool = base.unionByName(fresh, allowMissingColumns=True)
        links = candidate_pairs(fresh, pool, id, id, strategy).where("lhs_id <> rhs_id")
        links.write.mode("overwrite").parquet(f"{links_path}/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{base_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
