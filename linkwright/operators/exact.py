"""Exact links: equal fingerprints, and token sets that contain one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions import run_steps
from linkwright.operators.index import KEY, _records, _words, block_key, check_input, id_text, prepare_search_data, rarity_column, token_sets
from linkwright.plans.runtime import stash
from linkwright.plans.strategy import ExactStrategy

__all__ = ["column_prints", "fingerprints", "containment_pairs"]


def column_prints(df: DataFrame, id: str, columns: dict, **keys: Column) -> DataFrame:
    """``id``, the ``keys`` and ``c0, c1, ...``: a digest (SHA-256) of each column's sorted distinct tokens, "" for none; written.

    Rows give their digests where they are read; only digests are shuffled. Records whose id
    (and keys) stand in several rows have their tokens pooled, from a second read of these.
    """
    lists = {f"c{i}": run_steps(F.col(c).cast("string"), steps) for i, (c, steps) in enumerate(columns.items())}
    names, who = list(lists), ["id", *keys]
    own = lambda t: F.coalesce(F.array_sort(F.array_distinct(F.filter(t, lambda x: x.isNotNull()))), F.array().cast("array<string>"))
    digest = lambda t: F.when(F.size(t) > 0, F.sha2(F.array_join(t, "\x1f"), 256)).otherwise("")
    rows = df.select(id_text(id).alias("id"), *[k.alias(n) for n, k in keys.items()], *[own(t).alias(n) for n, t in lists.items()]).where("id is not null")
    printed = rows.select(*who, *[digest(F.col(n)).alias(n) for n in names])
    once = stash(printed.groupBy(*who).agg(F.count("*").alias("_rows"), *[F.first(n).alias(n) for n in names]))
    single = once.where("_rows = 1").drop("_rows")
    again = once.where("_rows > 1").select(*who)
    if again.isEmpty():
        return single
    same = [rows[k].eqNullSafe(again[k]) for k in who]
    several = rows.join(again, reduce(lambda x, y: x & y, same), "left_semi")
    pooled = several.groupBy(*who).agg(*[own(F.flatten(F.collect_list(n))).alias(n) for n in names]).select(*who, *[digest(F.col(n)).alias(n) for n in names])
    return stash(single.unionByName(pooled))


def fingerprints(df: DataFrame, id: str, strategy: ExactStrategy) -> DataFrame:
    """``id, block, fp`` of records with any token: one digest of their columns' sorted distinct tokens."""
    check_input(df, id, strategy)
    prints = column_prints(df, id, strategy.columns, block=block_key(strategy.block_by)).where("block is not null")
    names = [f"c{i}" for i in range(len(strategy.columns))]
    fp = F.concat_ws("\x1e", *names)
    return prints.where(F.concat(*names) != "").select("id", "block", (F.sha2(fp, 256) if len(names) > 1 else fp).alias("fp"))


def _rarest(sets: DataFrame, other: DataFrame) -> DataFrame:
    """``id, block`` and the one token of each record that fewest records of ``other`` have; a record with a token that none has is left out."""
    df = other.groupBy(*KEY).agg(F.count("*").alias("df"))
    met = sets.join(df, KEY, "left")
    best = met.groupBy("id", "block").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "src_column", "token")).alias("t"))
    return best.where("t.df > 0").select("id", "block", "t.src_column", "t.token")


def containment_pairs(base: DataFrame, base_id: str, target: DataFrame | None, target_id: str | None, strategy: ExactStrategy) -> DataFrame:
    """``lhs_id, rhs_id``: in every column the base's tokens are among the target's (or, bidirectional, the reverse).

    The contained record's rarest token is in the containing one, so only the records that
    have it are candidates; their overlap in each column is then counted, and must be all of
    one side's tokens. A column where the contained side is a proper, non-empty subset needs
    ``min_containment_tokens`` of them; ``min_base_rarity`` asks for a sum of rarity.
    """
    proxy = strategy.proxy()
    cross = target is not None
    names = list(strategy.columns)
    sized = lambda s, p: s.groupBy("id", "block").agg(*[F.count_if(F.col("src_column") == c).alias(f"{p}{i}") for i, c in enumerate(names)])
    full = None
    if cross:
        own = stash(token_sets(prepare_search_data(base, base_id, strategy).withColumn("side", F.lit("base"))).where("block is not null"))
        tokens = prepare_search_data(target, target_id, strategy).withColumn("side", F.lit("target"))
        words = None if strategy.min_base_rarity else _words(own, proxy)
        if words is not None and target.groupBy(id_text(target_id)).count().where("count > 1").isEmpty():
            # only the base's words are taken from the target; how many its records have in all is counted where they are read
            tokens = tokens.join(words, words.columns, "left_semi")
            n_of = lambda steps, c: F.coalesce(F.size(F.array_distinct(F.array_compact(run_steps(F.col(c).cast("string"), steps)))), F.lit(0))
            full = target.select(id_text(target_id).alias("id"), block_key(strategy.block_by).alias("block"), *[F.greatest(n_of(x, c), F.lit(0)).cast("long").alias(f"b{i}") for i, (c, x) in enumerate(strategy.columns.items())])
            full = stash(full.where("id is not null and block is not null"))
        sets = stash(own.unionByName(token_sets(tokens).where("block is not null")))
    else:
        sets = stash(token_sets(prepare_search_data(base, base_id, strategy).withColumn("side", F.lit("base"))).where("block is not null"))
    left = sets.where("side = 'base'").drop("side")
    right = (sets.where("side = 'target'") if cross else sets).drop("side")
    l, r = left.withColumnRenamed("id", "lhs_id").drop("c"), right.withColumnRenamed("id", "rhs_id").drop("c")  # noqa: E741
    near = _rarest(left, right).withColumnRenamed("id", "lhs_id").join(r, KEY).select("lhs_id", "rhs_id", "block")
    if strategy.containment == "bidirectional":
        inner = right
        if full is not None:  # records with a word the base lacks lie in none of its records
            has = sized(right, "h").join(full, ["id", "block"]).where(reduce(lambda x, y: x & y, [F.col(f"h{i}") == F.col(f"b{i}") for i in range(len(names))]))
            inner = right.join(has.select("id", "block"), ["id", "block"], "left_semi")
        near = near.union(_rarest(inner, left).withColumnRenamed("id", "rhs_id").join(l, KEY).select("lhs_id", "rhs_id", "block")).distinct()
    if not cross:
        near = near.where("lhs_id <> rhs_id")
    over = near.join(l, ["lhs_id", "block"]).join(r, ["rhs_id", *KEY])
    over = over.groupBy("lhs_id", "rhs_id", "block").agg(*[F.count_if(F.col("src_column") == c).alias(f"o{i}") for i, c in enumerate(names)])
    over = over.join(sized(left, "a").withColumnRenamed("id", "lhs_id"), ["lhs_id", "block"]).join((sized(right, "b") if full is None else full).withColumnRenamed("id", "rhs_id"), ["rhs_id", "block"])
    least = strategy.least_tokens()

    def contained(side: str, other: str):
        tests = []
        for i, c in enumerate(names):
            o, n, m = F.col(f"o{i}"), F.col(f"{side}{i}"), F.col(f"{other}{i}")
            proper = (n > 0) & (n < m)
            tests.append((o == n) & (~proper | (n >= least[c])))
        return reduce(lambda x, y: x & y, tests)

    holds = contained("a", "b")
    if strategy.containment == "bidirectional":
        holds = holds | contained("b", "a")
    pairs = over.where(holds).select("lhs_id", "rhs_id", "block")
    if strategy.min_base_rarity:
        voc = sets.groupBy("block", "src_column", "token").agg(F.sum("c").alias("freq"), F.count("*").alias("df"))
        voc = voc.join(_records(sets, ["block", "src_column"]), ["block", "src_column"])
        total = voc.groupBy("block", "src_column").agg(F.sum("freq").alias("_t"))
        voc = voc.join(total, ["block", "src_column"]).withColumn("rarity", rarity_column(proxy, F.col("freq"), F.col("df"), F.col("N"), F.col("_t")))
        rare = left.join(voc, ["block", "src_column", "token"]).groupBy(F.col("id").alias("lhs_id"), "block").agg(F.sum("rarity").alias("r"))
        pairs = pairs.join(rare.where(F.col("r") >= strategy.min_base_rarity), ["lhs_id", "block"], "left_semi")
    return pairs.select("lhs_id", "rhs_id").distinct()


def equal_pairs(base: DataFrame, base_id: str, target: DataFrame, target_id: str, strategy: ExactStrategy) -> DataFrame:
    a, b = fingerprints(base, base_id, strategy), fingerprints(target, target_id, strategy)
    return a.withColumnRenamed("id", "lhs_id").join(b.withColumnRenamed("id", "rhs_id"), ["block", "fp"]).select("lhs_id", "rhs_id").distinct()


def equal_links(df: DataFrame, id: str, strategy: ExactStrategy) -> DataFrame:
    """Star links to the smallest id of each fingerprint: as many as records, never pairs."""
    fp = fingerprints(df, id, strategy)
    least = fp.groupBy("block", "fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return fp.join(least, ["block", "fp"]).where("id <> rep").select(F.col("rep").alias("lhs_id"), F.col("id").alias("rhs_id"))


__all__ += ["equal_pairs", "equal_links", "id_text"]
