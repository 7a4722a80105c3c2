"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.plans.runtime import stash

__all__ = ["quantize", "exact_topk"]


def quantize(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: each component x as floor(scale * x); rows that are null or hold null or non-finite components go."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull()).where(~F.coalesce(bad, F.lit(True))).select(
        F.col(vec_id).alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v")
    )


def _matrix(column: pd.Series) -> np.ndarray:
    lists = column.tolist()
    return np.array(lists, dtype=np.int64).reshape(len(lists), len(lists[0]) if lists else 0)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in float64 (BLAS) only where every partial sum is exact."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if bound < 2.0**52:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 2, query_block: int = 512, vector_block: int = 8192) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best rows of ``vectors`` other than its own id.

    Both tables are ``(vec_id, v array<long>)`` of one length. The dimensions are cut into
    ``lists`` parts; a list scores every row by its own part only, so the score of a row is
    the sum over the lists. Phase 1 gathers each list's k best per query, scores those rows
    in full and takes the k-th best as the cutoff: a true lower bound. Phase 2 sends cutoff
    divided by ``lists`` with each query; a list returns every entry at or above it, and a
    row in none of the lists cannot reach the cutoff. Phase 3 drops rows whose partial scores
    plus the most the missing lists could add stay below the cutoff, and scores the rest in
    full. Work is cut in blocks of queries and rows, whatever the number of either.

    Ties go to the smaller id. Ids that repeat are rows of their own. Fewer than k rows: all
    of them. A vector of another length than the query's has no product with it and is none
    of its candidates; vectors without components score 0 with one another.
    """
    rows = stash(vectors.select("vec_id", "v"))
    n, width = rows.count(), rows.agg(F.max(F.size("v"))).first()[0] or 0
    asked = stash(queries.select("vec_id", "v"))
    nq = asked.count()
    cuts = np.linspace(0, width, max(1, min(lists, max(width, 1))) + 1).astype(int).tolist()
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    blocks, qblocks = max(1, -(-n // vector_block)), max(1, -(-nq // query_block))
    block = lambda count: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(count)).cast("int")
    part_of = F.explode(F.array(*[F.struct(F.lit(j).alias("list"), F.slice("v", a + 1, b - a).alias("p")) for j, (a, b) in enumerate(parts)]))
    listed = rows.select("vec_id", F.size("v").alias("len"), block(blocks).alias("block"), part_of.alias("x")).select("len", "block", "vec_id", F.col("x.list").alias("list"), "x.p")
    listed = listed.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    wanted = asked.select("vec_id", F.size("v").alias("len"), block(qblocks).alias("qblock"), part_of.alias("x")).select("len", "qblock", F.col("vec_id").alias("query_id"), F.col("x.list").alias("list"), "x.p")
    spread = lambda df: df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["len", "list", "block", "qblock"]
    schema = "list int, query_id long, vec_id long, partial long"

    def local_best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"list": [], "query_id": [], "vec_id": [], "partial": []})
        ids, qids = x["vec_id"].to_numpy(np.int64), q["query_id"].to_numpy(np.int64)
        s = _product(_matrix(q["p"]), _matrix(x["p"]))
        s[qids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
        take = min(k, len(ids))
        best = np.argpartition(-s.astype(np.float64), take - 1, axis=1)[:, :take]
        out = pd.DataFrame({"query_id": np.repeat(qids, take), "vec_id": ids[best].ravel(), "partial": np.take_along_axis(s, best, 1).ravel()})
        out.insert(0, "list", int(q["list"].iloc[0]))
        return out[out["query_id"] != out["vec_id"]]

    first = spread(wanted).groupBy(*keys).cogroup(listed.groupBy(*keys)).applyInPandas(local_best, schema)
    top = Window.partitionBy("query_id", "list").orderBy(F.desc("partial"), "vec_id")
    seen = first.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("query_id", "vec_id").distinct()
    full = _score(seen, asked, rows)
    # The k-th best of some true scores cannot exceed the k-th best of all.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoff = full.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("cutoff"))
    cutoff = stash(asked.select(F.col("vec_id").alias("query_id")).distinct().join(cutoff, "query_id", "left"))
    m = len(parts)

    def sufficient(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"list": [], "query_id": [], "vec_id": [], "partial": []})
        ids, qids = x["vec_id"].to_numpy(np.int64), q["query_id"].to_numpy(np.int64)
        s = _product(_matrix(q["p"]), _matrix(x["p"]))
        # partial >= cutoff / m, in integers; without a cutoff there are fewer than k rows: all of them
        least = np.array([np.iinfo(np.int64).min if pd.isna(c) else -((-int(c)) // m) for c in q["cutoff"]], np.int64)
        i, j = np.nonzero((s >= least[:, None]) & (qids[:, None] != ids[None, :]))
        out = pd.DataFrame({"query_id": qids[i], "vec_id": ids[j], "partial": s[i, j]})
        out.insert(0, "list", int(q["list"].iloc[0]))
        return out

    told = wanted.join(cutoff, "query_id")
    entries = spread(told).groupBy(*keys).cogroup(listed.groupBy(*keys)).applyInPandas(sufficient, schema)
    bounds = entries.groupBy("query_id", "vec_id").agg(F.max(F.struct("list", "partial")).alias("_"), F.collect_set("list").alias("in"), F.sum("partial").alias("sum"), F.count("*").alias("copies"))
    missing = F.lit(m) - F.size("in")
    bounds = bounds.join(cutoff, "query_id")
    # A missing list adds less than cutoff / m. Ids that repeat have several entries a list: those are scored, not bounded.
    able = F.col("cutoff").isNull() | (F.col("copies") > F.size("in")) | (F.col("sum") * m + missing * F.col("cutoff") >= F.col("cutoff") * m)
    full = _score(bounds.where(able).select("query_id", "vec_id"), asked, rows)
    ranked = full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _score(pairs: DataFrame, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The whole score of each pair of ids, for every row that has them."""
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).distinct()
    joined = pairs.join(rows, "vec_id").join(q, "query_id").where(F.size("qv") == F.size("v"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return joined.select("query_id", "vec_id", dot.alias("score"))
