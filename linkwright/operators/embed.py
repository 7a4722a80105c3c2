"""Embeddings: text assembly, model calls with a cache, blocked cosine joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.operators.index import block_key, id_text
from linkwright.plans.strategy import EmbeddingStrategy

__all__ = ["EmbeddingCache", "compute_embeddings", "cosine_pairs", "score_embeddings"]

#: Pairs computed and given out at once.
PIECE = 400_000


class EmbeddingCache:
    """Vectors by hash of model name and text, as a Parquet table in a folder all executors share."""

    def __init__(self, path: str, model_name: str):
        self.path, self.model_name = path, model_name

    def key(self, text):
        return F.sha2(F.concat_ws("\x1f", F.lit(self.model_name), text), 256)

    def read(self, spark) -> DataFrame | None:
        try:
            return spark.read.schema("key string, embedding array<float>").parquet(self.path)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def clear(self, spark) -> None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _call(model, batch_size: int):
    def run(batches):
        for s in batches:
            out: list = [None] * len(s)
            some = [i for i, t in enumerate(s) if t]
            for a in range(0, len(some), batch_size):
                part = some[a : a + batch_size]
                for i, v in zip(part, model([s.iloc[i] for i in part]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return run


def compute_embeddings(df: DataFrame, id: str, strategy: EmbeddingStrategy, cache: EmbeddingCache | None = None) -> DataFrame:
    """``id, block, embedding`` (array<float>): null where there is no text.

    Text is the columns' values joined by ``collapse_sep``, nulls left out. The model is
    called in batches, once for each text the cache does not have.
    """
    block = block_key(tuple(strategy.block_by))
    if isinstance(strategy.embedding_model, str):
        out = df.select(id_text(id).alias("id"), block.alias("block"), F.col(strategy.embedding_model).cast("array<float>").alias("embedding"))
    else:
        names = strategy.columns or tuple(f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != id)
        if missing := [c for c in names if c not in df.columns]:
            raise ValueError(f"columns not found: {missing}")
        text = F.nullif(F.trim(F.concat_ws(strategy.collapse_sep, *[F.col(c).cast("string") for c in names])), F.lit(""))
        rows = df.select(id_text(id).alias("id"), block.alias("block"), text.alias("text"))
        embed = F.pandas_udf(_call(strategy.embedding_model, strategy.batch_size), "array<float>", F.PandasUDFType.SCALAR_ITER)
        if cache is None:
            out = rows.select("id", "block", embed("text").alias("embedding"))
        else:
            rows = rows.withColumn("key", F.when(F.col("text").isNotNull(), cache.key(F.col("text"))))
            wanted = rows.where("key is not null").select("key", "text").dropDuplicates(["key"])
            known = cache.read(df.sparkSession)
            fresh = wanted if known is None else wanted.join(known, "key", "left_anti")
            fresh.select("key", embed("text").alias("embedding")).write.mode("append").parquet(cache.path)
            out = rows.join(cache.read(df.sparkSession).dropDuplicates(["key"]), "key", "left").select("id", "block", "embedding")
    if strategy.normalize:
        e = F.transform("embedding", lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
        out = out.withColumn("_n", norm).withColumn("embedding", F.when(F.col("_n") > 0, F.transform("embedding", lambda x: (x / F.col("_n")).cast("float"))).when(F.col("embedding").isNotNull(), F.col("embedding"))).drop("_n")
    return out


def cosine_pairs(left: DataFrame, right: DataFrame | None, threshold: float | None, block_rows: int = 4096, normalize: bool = True) -> DataFrame:
    """``lhs_id, rhs_id, score`` of pairs in the same block at or above ``threshold`` (None: all).

    Rows of a block are cut in tiles; every two tiles meet in one task as a matrix product,
    so work is split however large a block is, and pairs are given out in pieces. ``right`` None pairs ``left`` with itself,
    each pair once (smaller id first). Vectors that are null take no part.
    """
    self_join = right is None
    left = left.where("embedding is not null and block is not null")
    right = left if self_join else right.where("embedding is not null and block is not null")

    def tiled(df: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        sizes = df.groupBy("block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(f"{p}tiles"))
        rows = df.join(sizes, "block").withColumn(f"{p}tile", F.pmod(F.xxhash64("id"), F.col(f"{p}tiles").cast("long")).cast("int"))
        return rows.drop(f"{p}tiles"), sizes

    a, na = tiled(left, "a")
    right = left.select(*[F.col(c).alias(c) for c in left.columns]) if self_join else right
    b, nb = tiled(right, "b")
    a = a.join(nb, "block").withColumn("btile", F.explode(F.sequence(F.lit(0), F.col("btiles") - 1))).drop("btiles")
    b = b.join(na, "block").withColumn("atile", F.explode(F.sequence(F.lit(0), F.col("atiles") - 1))).drop("atiles")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        x, y = table.filter(table["is_left"]), table.filter(pc.invert(table["is_left"]))
        if not len(x) or not len(y):
            return
        m, n = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["embedding"].chunks]).astype(np.float64).reshape(len(t), -1) for t in (x, y))
        norm_m, norm_n = np.sqrt((m * m).sum(1)), np.sqrt((n * n).sum(1))
        u, v = x["id"].combine_chunks(), y["id"].combine_chunks()
        if self_join:
            place = np.unique(np.concatenate([u.to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)]), return_inverse=True)[1].ravel()
            place_u, place_v = place[: len(u)], place[len(u) :]
        step = max(1, PIECE // len(y))
        for at in range(0, len(x), step):  # a piece of the product at a time, and so are the pairs given out
            s = m[at : at + step] @ n.T
            if normalize:
                s = s / np.maximum(norm_m[at : at + step, None] * norm_n[None, :], 1e-300)
            keep = np.ones(s.shape, bool) if threshold is None else s >= threshold - 1e-9
            if self_join:
                keep &= place_u[at : at + step, None] < place_v[None, :]
            i, j = np.nonzero(keep)
            if len(i):
                yield pa.RecordBatch.from_arrays([u.take(pa.array(i + at)), v.take(pa.array(j)), pa.array(s[i, j])], ["lhs_id", "rhs_id", "score"])

    columns = ["block", "atile", "btile", "is_left", "id", "embedding"]
    both = a.withColumn("is_left", F.lit(True)).select(*columns).unionByName(b.withColumn("is_left", F.lit(False)).select(*columns))
    return both.groupBy("block", "atile", "btile").applyInArrow(meet, "lhs_id string, rhs_id string, score double")


def score_embeddings(base: DataFrame, target: DataFrame, strategy: EmbeddingStrategy) -> DataFrame:
    """All pairs' cosines, without a threshold: ``lhs_id, rhs_id, score``; both tables, which may be one, from ``compute_embeddings``."""
    target = target.select(*[F.col(c).alias(c) for c in target.columns])
    return cosine_pairs(base, target, None, strategy.block_rows, strategy.normalize)
