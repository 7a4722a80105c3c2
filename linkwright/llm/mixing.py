"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import n_words
from linkwright.plans.runtime import stash

__all__ = ["source_targets", "mix_sources"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """``(source, source_size, rank, target)`` from rows ``(source, size)``.

    Sources by code point, null last, take the weights in turn. A target is
    ``level * weight``, capped at ``max_repeats`` times the source's size; the level is the
    one at which the uncapped sources absorb what the capped ones leave (water filling in
    closed form: sources by cap/weight; the first whose cap exceeds its share stays uncapped,
    and so do all behind it). One row per source, so the windows here see aggregates only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    per = per.withColumn("cap", F.lit(max_repeats).cast("long") * F.col("source_size"))
    whole = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole)
    budget = total if share == 1.0 else F.floor(total * F.lit(float(share)))
    per = (
        per.withColumn("budget", budget)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(filled), F.lit(0)))
        .withColumn("left_w", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
        .withColumn("open", F.col("left") * F.col("weight") <= F.col("cap") * F.col("left_w"))
        .withColumn("seen", F.max(F.col("open").cast("int")).over(filled.rowsBetween(Window.unboundedPreceding, 0)))
    )
    first_open = F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "left", "left_w")
    per = per.withColumn("level", F.min(F.when(F.col("open"), first_open)).over(whole))
    target = F.when(F.col("seen") == 1, F.col("level.left").cast("double") / F.col("level.left_w").cast("double") * F.col("weight")).otherwise(
        F.col("cap").cast("double")
    )
    return per.select("source", "source_size", "rank", target.alias("target"))


def _queued(rows: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """Adds each row's place ``cum`` in its source's shuffled stream (inclusive), and the source's figures.

    A source's stream is cut by the leading bits of the shuffle key, so that no task sees
    more than one bucket of a source: bucket totals give the offsets, a window inside the
    bucket gives the rest.
    """
    rows = rows.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 4294967296.0 * buckets).cast("int"))
    per_bucket = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    per_bucket = per_bucket.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.source").alias("_s"), F.col("p._b").alias("_pb"), "_off", "source_size", "rank", "target"
    )
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("size").over(inside))
    return rows.join(per_bucket, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_pb"))).withColumn(
        "cum", F.col("_off") + F.col("_in")
    )


def _finish(epoch: Column | int) -> Column:
    """Virtual finish time: the source's tokens up to and with this copy, over its target."""
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.when(F.col("target") > 0, (e * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")).otherwise(F.lit(1.0))


def _cutoff(queued: DataFrame, budget: int, max_repeats: int, bins: int):
    """The last copy, in finish order, up to which the mix stays within ``budget``.

    Everything that finishes by 1 fits (each source is then below its target), so only the
    rest is binned; the bin where the budget runs out, and no other, is put in exact order.
    """
    copies = queued.where("size > 0").withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("v", _finish(F.col("_e")))
    key = F.struct("v", "rank", "_h", "doc_id", "_t")
    base = copies.where("v <= 1").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    if base >= budget:
        return 1.0, None
    low, high = 1.0, 2.0
    while True:
        binned = copies.where((F.col("v") > low) & (F.col("v") <= high)).withColumn("_bin", F.floor((F.col("v") - low) / (high - low) * bins))
        sums = binned.groupBy("_bin").agg(F.sum("size").alias("n")).withColumn("c", F.sum("n").over(Window.orderBy("_bin")))
        over = sums.where(F.col("c") + base > budget).orderBy("_bin").first()
        if over is not None:
            inside = binned.where(F.col("_bin") == over["_bin"])
            room = budget - base - (over["c"] - over["n"])
            order = Window.orderBy("v", "rank", "_h", "doc_id", "_t").rowsBetween(Window.unboundedPreceding, 0)
            last = inside.withColumn("c", F.sum("size").over(order)).where(F.col("c") <= room).agg(F.max(key).alias("k")).first()["k"]
            if last is not None:
                return None, last
            return low + over["_bin"] * (high - low) / bins, None
        more = copies.where(F.col("v") > low).agg(F.max("v").alias("m"), F.sum("size").alias("n")).first()
        if more["m"] is None or more["m"] <= high:
            return math.inf, None
        base += binned.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        low, high = high, high * 2


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    max_repeats: int = 3,
    seed: str = "mix",
    rows_per_bucket: int = 20_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Weighted fair queueing over the sources of ``docs`` (``doc_id``, ``source``, ``text``).

    Each source is a stream of its documents in keyed-shuffled order, repeated up to
    ``max_repeats`` times; a copy's virtual finish time is the stream's tokens so far over
    the source's target; the mix is the prefix of all copies in finish order that stays
    within the total budget. Returns one row per input row:
    ``doc_id, source, size, source_size, target, taken, repeats, finish`` and the columns in
    ``carry`` (under a struct ``row``). ``finish`` is the first copy's virtual finish time, by
    which the mix interleaves; each further copy's is later by the source's size over its target. The shuffle key hashes the id and ``seed``, so reruns agree.

    Nulls: a null text has size 0, null sources are one source and sort last, a null id is
    a value like any other. Equal rows are queued one behind the other. Size-0 rows take no
    words; they count as one copy (``repeats`` 1). An empty table gives no rows.
    """
    text_key = F.xxhash64("text")
    base = docs.select(
        "doc_id",
        "source",
        n_words("text").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h"),
        text_key.alias("_t"),
        *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []),
    )
    narrow = stash(base.drop("row"))
    head = narrow.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    buckets = max(64, math.ceil(head["n"] / rows_per_bucket))
    targets = stash(source_targets(narrow, weights, share, max_repeats).coalesce(1))
    queued = stash(_queued(narrow, targets, buckets))
    # Float sums of the targets may miss the whole by an ulp; the budget is the words asked for, or all there are.
    most = min(int(head["words"] * share) if share != 1.0 else head["words"], max_repeats * head["words"])
    limit, last = _cutoff(queued, most, max_repeats, max(1024, buckets))
    if carry:
        queued = _queued(base, targets, buckets)
    taken = F.lit(0)
    for e in range(max_repeats):
        if last is not None:
            kept = F.struct(_finish(e).alias("v"), F.col("rank"), F.col("_h"), F.col("doc_id"), F.col("_t")) <= F.struct(
                F.lit(last["v"]).alias("v"), F.lit(last["rank"]).alias("rank"), F.lit(last["_h"]).alias("_h"),
                F.lit(last["doc_id"]).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(last["_t"]).alias("_t"),
            )
        else:
            kept = _finish(e) <= F.lit(float(limit)) if math.isfinite(limit) else F.lit(True)
        taken = taken + kept.cast("int")
    repeats = F.when(F.col("size") == 0, F.lit(1)).otherwise(taken)
    return queued.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"), _finish(0).alias("finish"), *(["row"] if carry else [])
    )
