"""Batch plans: which rows go together when a function must see them in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.operators.numbering import number_rows

__all__ = ["BatchPlan", "batch_plan", "batch_map", "suggest_batch_size"]


@dataclass
class BatchPlan:
    """``rows`` with ``batch_id``, and one row a batch in ``batches``."""

    rows: DataFrame
    batches: DataFrame


def suggest_batch_size(row_bytes: float, memory_bytes: float, largest_block: int | None = None) -> tuple[int, int]:
    """``(target, minimum)``: 30 % of the memory, between 50,000 and 2,000,000 rows; smaller for smaller blocks."""
    target = int(min(2_000_000, max(50_000, memory_bytes * 0.30 / max(1.0, row_bytes))))
    if largest_block:
        target = max(1, min(target, largest_block))
    return target, max(1, target // 4)


def batch_plan(
    df: DataFrame, id: str, target_batch_size: int = 100_000, min_batch_size: int | None = None, strategy: str = "even", block_by: str | None = None, atomic_blocks: bool = True
) -> BatchPlan:
    """Batches of about ``target_batch_size`` rows.

    even: by id order. block_first: a batch per block; large ones are cut unless blocks are
    atomic, and are then marked ``oversized``. block_consolidated: blocks in order, packed
    until a batch would pass the target. Packing runs over block totals in order, on
    prefix sums, so the rows themselves are only counted.
    """
    if strategy == "even":
        rows = number_rows(df, [id], "_n").withColumn("batch_id", F.ceil(F.col("_n") / target_batch_size).cast("long")).drop("_n")
        return BatchPlan(rows, rows.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.lit(False).alias("oversized")))
    if block_by is None:
        raise ValueError("block_by is needed for block strategies")
    sizes = df.groupBy(block_by).agg(F.count("*").alias("n"))
    if strategy == "block_first":
        parts = F.when(F.lit(atomic_blocks), F.lit(1)).otherwise(F.ceil(F.col("n") / target_batch_size))
        numbered = number_rows(sizes.withColumn("parts", parts), [block_by], "_b")
        first = number_rows(numbered.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts").cast("int")))), ["_b", "part"], "batch_id")
        inside = F.row_number().over(Window.partitionBy(block_by).orderBy(id)) if not atomic_blocks else None
        rows = df.withColumn("part", F.ceil(inside / target_batch_size).cast("int") if inside is not None else F.lit(1))
        key = first.select(F.col(block_by).alias("_k"), "part", "batch_id")
        rows = rows.alias("r").join(key.alias("k"), F.col(f"r.{block_by}").eqNullSafe(F.col("_k")) & (F.col("r.part") == F.col("k.part"))).select("r.*", "batch_id").drop("part")
    elif strategy == "block_consolidated":
        # one row a block: greedy packing in block order
        least = min_batch_size or max(1, target_batch_size // 4)
        blocks, batch, run = [], 1, 0
        for r in sizes.orderBy(block_by).toLocalIterator():
            if run and (run + r["n"] > target_batch_size and run >= least):
                batch, run = batch + 1, 0
            run += r["n"]
            blocks.append((r[block_by], batch))
        kind = df.schema[block_by].dataType.simpleString()
        key = df.sparkSession.createDataFrame(blocks, f"_k {kind}, batch_id long")
        rows = df.join(key, df[block_by].eqNullSafe(key["_k"])).drop("_k")
    else:
        raise ValueError(f"unknown batch strategy {strategy!r}")
    batches = rows.groupBy("batch_id").agg(F.count("*").alias("n_rows")).withColumn("oversized", F.col("n_rows") > target_batch_size)
    return BatchPlan(rows, batches)


def batch_map(df: DataFrame, fn: Callable, schema: str, plan: BatchPlan | None = None) -> DataFrame:
    """``fn`` over pandas frames: a batch of the plan at a time, or whatever Arrow batch comes."""
    if plan is not None:
        return plan.rows.groupBy("batch_id").applyInPandas(lambda pdf: fn(pdf.drop(columns="batch_id")), schema)
    return df.mapInPandas(lambda it: (fn(pdf) for pdf in it), schema)
