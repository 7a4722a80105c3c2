"""Column-wide spelling clusters: every token becomes its cluster's best spelling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.distance import jaro_winkler, osa
from linkwright.operators.graph import connected_components
from linkwright.plans.runtime import stash

__all__ = ["fuzzy_vocabulary", "fuzzy_tokens"]


def _pairs(words: DataFrame, max_dist: float, method: str) -> DataFrame:
    """Pairs of words within the distance, found by shared keys rather than all pairs.

    For edits up to d, a word is cut in d + 1 pieces, more for the swaps that alignment
    allows (each touches two neighbours): of 2 d + 1 pieces of the shorter word one at
    least stands unchanged in the longer, at most d places away. Words too short for the
    pieces, and Jaro-Winkler, go by length and letters instead.
    """
    d = int(max_dist) if method in ("osa", "lv") else 0
    pieces = 2 * d + 1
    n = F.length("w")
    if method in ("osa", "lv"):
        cut = lambda i: (F.floor(F.lit(i) * F.col("_n") / pieces) + 1).cast("int")
        short = words.where(n < pieces)
        long = words.withColumn("_n", n)
        own = long.where(F.col("_n") >= pieces).select(
            F.col("w").alias("a"), F.col("_n").alias("na"), F.posexplode(F.array(*[F.struct(cut(i).alias("s"), F.substr(F.col("w"), cut(i), cut(i + 1) - cut(i)).alias("p")) for i in range(pieces)])).alias("k", "x")
        )
        own = own.select("a", "na", "x.s", "x.p", F.length("x.p").alias("lp"))
        # places in the other word where such a piece may stand
        lens = own.select("na", "s", "lp").distinct()
        other = long.select(F.col("w").alias("b"), F.col("_n").alias("nb"))
        spots = other.join(F.broadcast(lens), F.col("nb").between(F.col("na"), F.col("na") + d))  # as many rows as word lengths times pieces
        spots = spots.withColumn("at", F.explode(F.sequence(F.greatest(F.col("s") - d, F.lit(1)), F.greatest(F.least(F.col("s") + d, F.col("nb") - F.col("lp") + 1), F.lit(1)))))
        spots = spots.select("b", "nb", "na", "s", F.substr(F.col("b"), F.col("at"), F.col("lp")).alias("p")).distinct()
        met = own.join(spots, ["na", "s", "p"]).select("a", "b")
        tiny = short.select(F.col("w").alias("a"), F.length("w").alias("la"))
        near = words.select(F.col("w").alias("b"), F.explode(F.sequence(F.greatest(F.length("w") - d, F.lit(1)), F.length("w"))).alias("la"))
        met = met.union(tiny.join(near, "la").select("a", "b")).where("a <> b")
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        measure = F.levenshtein("a", "b") if method == "lv" else None
    elif method == "jw":
        # a similarity above 0 needs a common letter; words meet by their rarest letters would lose pairs, so all letters count
        letters = words.select("w", F.explode(F.array_distinct(F.filter(F.split("w", ""), lambda c: c != ""))).alias("c"))
        met = letters.withColumnRenamed("w", "a").join(letters.withColumnRenamed("w", "b"), "c").where("a < b").select("a", "b").distinct()
        measure = None
    else:
        raise ValueError(f"unknown distance {method!r}")
    if measure is None:

        @F.pandas_udf("double")
        def distance(a: pd.Series, b: pd.Series) -> pd.Series:
            f = osa if method == "osa" else (lambda x, y: 1.0 - jaro_winkler(x, y, 0.0))
            return pd.Series([float(f(x, y)) for x, y in zip(a, b, strict=True)])

        measure = distance("a", "b")
    return met.withColumn("d", measure.cast("double")).where(F.col("d") <= max_dist)


def fuzzy_vocabulary(df: DataFrame, column: str, max_dist: float = 2, method: str = "osa", min_nchar: int = 1) -> DataFrame:
    """``token, canonical`` of every upper-case word of the column.

    Words linked by close spellings form a cluster; its canonical word is the longest, then
    the one nearest the others it is linked to, then the first by alphabet.
    """
    words = df.select(F.explode(F.filter(F.split(F.upper(F.col(column)), r"\s+"), lambda t: F.length(t) >= max(1, min_nchar))).alias("w")).distinct()
    words = stash(words)
    pairs = stash(_pairs(words, max_dist, method))
    comp = connected_components(pairs, "a", "b")
    ends = pairs.select(F.col("a").alias("w"), "d").union(pairs.select("b", "d")).groupBy("w").agg(F.avg("d").alias("center"))
    members = words.join(comp.withColumnRenamed("node", "w"), "w", "left").join(ends, "w", "left").withColumn("component", F.coalesce("component", "w"))
    best = F.first("w").over(Window.partitionBy("component").orderBy(F.desc(F.length("w")), F.asc_nulls_first("center"), "w"))
    return members.select(F.col("w").alias("token"), best.alias("canonical"))


def fuzzy_tokens(df: DataFrame, id: str, column: str, max_dist: float = 2, method: str = "osa", min_nchar: int = 1, out: str = "fuzzy_tokens") -> DataFrame:
    """``df`` with a token list in which close spellings agree; null texts give null. One join on the token."""
    voc = fuzzy_vocabulary(df, column, max_dist, method, min_nchar)
    rows = df.select(F.col(id), F.posexplode(F.filter(F.split(F.upper(F.col(column)), r"\s+"), lambda t: F.length(t) >= max(1, min_nchar))).alias("_p", "token"))
    lists = rows.join(voc, "token").groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "canonical"))), lambda s: s["canonical"]).alias(out))
    joined = df.join(lists, id, "left")
    return joined.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce(out, F.array().cast("array<string>"))))
