"""The token-overlap join: relative identification potential, feedback, missing columns, best candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.operators.index import KEY, Index
from linkwright.operators.tiles import tile_pairs
from linkwright.plans.runtime import stash
from linkwright.plans.strategy import SearchStrategy

__all__ = ["SLACK", "relative_potential", "score_pairs", "best_pairs"]

#: Float sums may fall short of a threshold by this.
SLACK = 1e-9


def relative_potential(rows: DataFrame, strategy: SearchStrategy) -> DataFrame:
    """Adds ``rip``: the token's share of its record's rarity in the column (and block), smoothed if asked."""
    w = Window.partitionBy("block", "id", "src_column", *(["side"] if "side" in rows.columns else []))
    share = F.try_divide(F.col("rarity"), F.sum("rarity").over(w))
    rows = rows.withColumn("rip", share)
    s = strategy.smoothing
    if s.method != "identity":
        x = {"log": F.log1p("rip"), "softmax": F.exp(F.col("rip") / s.temperature), "offset": F.col("rip") + s.alpha}[s.method]
        rows = rows.withColumn("_x", x)
        rows = rows.withColumn("rip", F.try_divide(F.col("_x"), F.sum("_x").over(w))).drop("_x")
    return rows


def weight_column(strategy: SearchStrategy, c: str = "src_column") -> Column:
    weights = strategy.weight_of()
    if len(set(weights.values())) == 1:
        return F.lit(float(next(iter(weights.values()))))
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(F.col(c) == name, F.lit(float(w))).otherwise(out)
    return out


def _presence(rows: DataFrame, strategy: SearchStrategy) -> DataFrame:
    """``(id, mask)``: a bit for each of the strategy's columns that the record has tokens in."""
    bits = F.lit(0)
    for i, c in enumerate(strategy.columns):
        bits = F.when(F.col("src_column") == c, F.lit(1 << i)).otherwise(bits)
    return rows.groupBy("id").agg(F.bit_or(bits.cast("long")).alias("mask"))


def _suffixes(left: DataFrame, strategy: SearchStrategy, threshold: float) -> DataFrame:
    """Marks by ``rare`` the rarest tokens of each record and block, the others of which weigh less than the threshold.

    Adds ``rest``, what those others weigh: a pair that shares no rare token scores that much at most.
    """
    w = Window.partitionBy("id", "block").orderBy(F.desc("df"), "src_column", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.lit(threshold - 2 * SLACK)
    if strategy.on_missing == "renormalise":  # the columns present on either side weigh as much as the lhs's own, or more
        own = _presence(left, strategy)
        present = F.lit(0.0)
        for i, x in enumerate(strategy.weight_of().values()):
            present = present + F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(float(x))).otherwise(0.0)
        left = left.join(own.select("id", present.alias("_z")), "id")
        least = least * F.col("_z")
    marked = left.withColumn("rare", F.sum("part").over(w) >= least)
    rest = F.sum(F.when(F.col("rare"), 0.0).otherwise(F.col("part"))).over(Window.partitionBy("id", "block"))
    return marked.withColumn("rest", rest).withColumn("least", least).drop("_z")


def _per_block(joined: DataFrame) -> DataFrame:
    return joined.groupBy("lhs_id", "rhs_id", "block").agg(F.sum("part").alias("score"), F.sum("rip").alias("matched"))


def _numbered(kept: DataFrame) -> DataFrame:
    """The vocabulary with ``number``, counted from 0: places inside the partitions of a written table, offset by the counts before them."""
    voc = stash(kept.select(*KEY, "rarity", "df").withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in voc.groupBy(part.cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, run = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(run)
        run += counts.get(p, 0)
    offset = F.array(*[F.lit(x).cast("long") for x in before or [0]])
    return voc.withColumn("number", inside + F.element_at(offset, part.cast("int") + 1)).drop("_at")


def _through_tiles(index: Index, strategy: SearchStrategy, threshold: float) -> DataFrame:
    """``lhs_id, rhs_id, score`` of the pairs that reach the threshold, from records as lists of token numbers.

    Candidates share one of the lhs's rarest tokens, the others of which weigh less than the
    threshold; where potentials can be negative every token counts as rare. No row is made for
    a token that two records share, so what is shuffled are records and pairs above the threshold.
    """
    rows = index.sets.join(_numbered(index.kept), KEY).select(*[c for c in ("side", "id", "block", "src_column", "number", "df", "rarity") if c in index.sets.columns or c in ("number", "df", "rarity")])
    cross, masks = "side" in rows.columns, strategy.on_missing == "renormalise"
    bits = F.lit(0).cast("long")
    for i, c in enumerate(strategy.columns):
        bits = F.when(F.col("src_column") == c, F.lit(1 << i).cast("long")).otherwise(bits)
    mask = [F.bit_or(bits).alias("mask")] if masks else []
    rows = stash(rows) if masks and not cross else rows  # the masks are counted from the rows, too
    left = (rows.where("side = 'base'") if cross else rows).repartition("id", "block")
    left = relative_potential(left, strategy).withColumn("part", F.coalesce(F.col("rip") * weight_column(strategy), F.lit(0.0))).withColumn("token", F.col("number"))
    if strategy.rarity == "bm25":
        left = left.withColumn("rare", F.lit(True)).withColumn("least", F.lit(0.0 if masks else threshold - 2 * SLACK))
    else:
        left = _suffixes(left, strategy, threshold)
    rips = F.collect_list(F.struct(F.when(F.col("rare"), F.col("number")).otherwise(-1 - F.col("number")).alias("code"), F.col("part"), *([F.coalesce("rip", F.lit(0.0)).alias("rip")] if strategy.feedback_strength else [])))
    left = left.groupBy("id", "block").agg(rips.alias("x"), F.max("rare").alias("any"), F.first("least").cast("double").alias("least"), F.coalesce(F.sum("rip"), F.lit(0.0)).alias("total"), *mask)
    left = left.select("id", "block", F.col("x.code").alias("codes"), F.col("x.part").alias("parts"), (F.col("x.rip") if strategy.feedback_strength else F.lit(None).cast("array<double>")).alias("rips"), "any", "least", "total", *(["mask"] if masks else []))
    left = stash(left)
    right = stash(rows.where("side = 'target'").groupBy("id", "block").agg(F.collect_list("number").alias("codes"), *mask)) if cross else left
    scored = tile_pairs(left.where("any").drop("mask", "any"), right.select("id", "block", "codes"), not cross, strategy.feedback_strength)
    if strategy.block_by:
        scored = scored.groupBy("lhs_id", "rhs_id").agg(F.max("score").alias("score"))
    if masks:
        pooled = lambda x, who, name: x.groupBy(F.col("id").alias(who)).agg(F.bit_or("mask").alias(name))
        scored = _renormalised(scored, pooled(left, "lhs_id", "ma"), pooled(right, "rhs_id", "mb"), strategy)
    return scored.select("lhs_id", "rhs_id", "score")


def _renormalised(scored: DataFrame, a: DataFrame, b: DataFrame, strategy: SearchStrategy) -> DataFrame:
    """Scores over the weights of the columns that either side has; ``a`` and ``b`` have the masks."""
    scored = scored.join(a, "lhs_id").join(b, "rhs_id")
    present = F.lit(0.0)
    for i, w in enumerate(strategy.weight_of().values()):
        present = present + F.when(F.col("ma").bitwiseOR(F.col("mb")).bitwiseAND(F.lit(1 << i)) != 0, F.lit(float(w))).otherwise(0.0)
    return scored.withColumn("score", F.col("score") / F.when(present > 0, present).otherwise(1.0)).drop("ma", "mb")


def _met_in_blocks(rows: DataFrame) -> DataFrame:
    """Sums by pair and block where blocks are small: the few records of a token are listed and paired in place."""
    one = F.struct("id", "rip", "part")
    of = (lambda x: F.collect_list(F.when(F.col("side") == x, one))) if "side" in rows.columns else lambda x: F.collect_list(one)
    met = rows.groupBy(*KEY).agg(of("base").alias("l"), of("target").alias("r"))
    pairs = met.select("block", F.explode("l").alias("l"), "r").select("block", "l", F.explode("r").alias("r"))
    if "side" not in rows.columns:
        pairs = pairs.where("l.id <> r.id")
    return _per_block(pairs.select(F.col("l.id").alias("lhs_id"), F.col("r.id").alias("rhs_id"), "block", "l.rip", "l.part"))


def score_pairs(index: Index, strategy: SearchStrategy, threshold: float | None = None) -> DataFrame:
    """``lhs_id, rhs_id, score`` of pairs that share a token; directed, lhs weights count.

    With a ``threshold`` pairs below it may be missing: records then meet tile against tile,
    exactly. Without one, one equi-join on (block, column, token) makes all pairs; adaptive
    execution splits a hot token's rows. Sums combine before the shuffle by pair.
    """
    small = index.rows is not None
    if threshold and not small:
        return _through_tiles(index, strategy, threshold)
    rows = index.weighted()
    rows = rows if small and not strategy.feedback_strength and strategy.on_missing != "renormalise" else stash(rows)
    cross = "side" in rows.columns
    left = rows.where("side = 'base'") if cross else rows
    right = rows.where("side = 'target'") if cross else rows
    left = relative_potential(left, strategy).withColumn("part", F.col("rip") * weight_column(strategy))
    if small:
        per_block = _met_in_blocks(relative_potential(rows, strategy).withColumn("part", F.col("rip") * weight_column(strategy)))
    else:
        l = left.select(F.col("id").alias("lhs_id"), *KEY, "rip", "part")  # noqa: E741
        r = right.select(F.col("id").alias("rhs_id"), *KEY)
        joined = l.join(r, KEY)
        if not cross:
            joined = joined.where("lhs_id <> rhs_id")
        per_block = _per_block(joined)
    if strategy.feedback_strength:
        total = left.groupBy(F.col("id").alias("lhs_id"), "block").agg(F.sum("rip").alias("total"))
        s = strategy.feedback_strength
        per_block = per_block.join(total, ["lhs_id", "block"]).withColumn("score", F.col("score") * (1.0 - s * (1.0 - F.try_divide(F.col("matched"), F.col("total")))))
    scored = per_block.groupBy("lhs_id", "rhs_id").agg(F.max("score").alias("score")) if strategy.block_by else per_block.select("lhs_id", "rhs_id", "score")
    if strategy.on_missing == "renormalise":
        a = _presence(left, strategy).select(F.col("id").alias("lhs_id"), F.col("mask").alias("ma"))
        b = _presence(right, strategy).select(F.col("id").alias("rhs_id"), F.col("mask").alias("mb"))
        scored = _renormalised(scored, a, b, strategy)
    return scored.select("lhs_id", "rhs_id", "score")


def best_pairs(pairs: DataFrame, strategy: SearchStrategy, threshold: float | None = None) -> DataFrame:
    """Pairs at or above the threshold, at most ``max_candidates`` per lhs (to 9 digits, ties to the smaller rhs)."""
    t = strategy.threshold if threshold is None else threshold
    out = pairs.where(F.col("score") >= t - SLACK)
    if math.isinf(strategy.max_candidates):
        return out
    place = F.row_number().over(Window.partitionBy("lhs_id").orderBy(F.round("score", 9).desc(), "rhs_id"))
    return out.withColumn("_r", place).where(F.col("_r") <= int(strategy.max_candidates)).drop("_r")
