"""Scores of record pairs, tile against tile: sums over the tokens that two records share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["tile_pairs"]

#: Tokens of a tile, tokens of the cells that hold many small blocks, records below which a tile is not cut further, pairs given out at once.
TILE, CELL, FEW, PIECE = 8_000_000, 1_000_000, 2_048, 400_000

OUT = pa.schema([("lhs_id", pa.string()), ("rhs_id", pa.string()), ("score", pa.float64())])


def _meet(self_join: bool, feedback: float):
    """Codes are token numbers, those of tokens that bring no candidates as ``-1 - number``.

    A left record's candidates share one of its other tokens. Their sums come from the posting
    lists of all its tokens, or, if that is less work, from the candidates' own token lists.
    Nothing here is imported from this package, which executors need not have.
    """

    def runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The places ``starts[i] .. starts[i] + n[i] - 1`` of all i, one after the other."""
        return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def lists(table: pa.Table, name: str) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks] or [np.zeros(0)])

    def key(table: pa.Table) -> pa.ChunkedArray:
        return pc.binary_join_element_wise(table["id"], table["block"], "\x1f")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, right = table.filter(table["is_left"]), table.filter(pc.invert(table["is_left"]))
        del table
        if not len(left) or not len(right):
            return
        code, part = lists(left, "codes").astype(np.int64), lists(left, "parts")
        rare = code >= 0
        tok = np.where(rare, code, -1 - code)
        n_left, n_right = pc.list_value_length(left["codes"]).to_numpy(), pc.list_value_length(right["codes"]).to_numpy()
        least, total = left["least"].to_numpy(), left["total"].to_numpy()
        rip = lists(left, "rips") if feedback else part
        local = np.full(tok.max() + 1, -1, np.int32)
        local[tok] = 0
        words = np.flatnonzero(local == 0)
        local[words] = np.arange(len(words), dtype=np.int32)
        rtok = lists(right, "codes").astype(np.int64)
        rtok = np.where(rtok < 0, -1 - rtok, rtok)
        rrow = np.repeat(np.arange(len(right), dtype=np.int32), n_right)
        known = rtok < len(local)
        known[known] = local[rtok[known]] >= 0
        rtok, rrow = local[rtok[known]], rrow[known]
        order = np.argsort(rtok, kind="stable")
        posts = rrow[order]
        del order, known
        n_posts = np.bincount(rtok, minlength=len(words))
        at = np.concatenate([[0], np.cumsum(n_posts)])
        n_own = np.bincount(rrow, minlength=len(right))
        own = np.concatenate([[0], np.cumsum(n_own)])
        tok = local[tok]
        lrow = np.repeat(np.arange(len(left)), n_left)
        hits = n_posts[tok]
        mass, mass_rare = np.bincount(lrow, hits, len(left)), np.bincount(lrow, hits * rare, len(left))
        del lrow, hits
        ends = np.concatenate([[0], np.cumsum(n_left)])
        itself = pc.index_in(key(left), key(right)).fill_null(-1).to_numpy() if self_join else np.full(len(left), -1)
        weight, weight_rip, mark = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(right), bool)
        width = len(rtok) / len(right)
        lid, rid = left["id"].combine_chunks(), right["id"].combine_chunks()
        found, n = [], 0

        def piece():
            i = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            j, s = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
            return pa.RecordBatch.from_arrays([lid.take(pa.array(i)), rid.take(pa.array(j)), pa.array(s)], schema=OUT)

        for i in np.flatnonzero(mass_rare):
            t, p, q, k = (x[ends[i] : ends[i + 1]] for x in (tok, part, rip, rare))
            matched = None
            if mass[i] <= mass_rare[i] + 4 * min(mass_rare[i], len(right)) * width:
                some = n_posts[t] > 0
                t, p, q = t[some], p[some], q[some]
                met = np.concatenate([posts[a:b] for a, b in zip(at[t].tolist(), at[t + 1].tolist(), strict=True)])
                sums = np.bincount(met, np.repeat(p, n_posts[t]), len(right))
                if feedback:
                    matched = np.bincount(met, np.repeat(q, n_posts[t]), len(right))
                j = np.arange(len(right))
            else:
                r = t[k]
                mark[posts[runs(at[r], n_posts[r])]] = True
                j = np.flatnonzero(mark)
                mark[j] = False
                places, starts = rtok[runs(own[j], n_own[j])], np.cumsum(n_own[j]) - n_own[j]
                weight[t] = p
                sums = np.add.reduceat(weight[places], starts)
                weight[t] = 0
                if feedback:
                    weight_rip[t] = q
                    matched = np.add.reduceat(weight_rip[places], starts)
                    weight_rip[t] = 0
            if feedback:
                with np.errstate(divide="ignore", invalid="ignore"):
                    sums = sums * (1.0 - feedback * (1.0 - matched / total[i]))
            keep = (sums >= least[i]) & (sums > 0) & (j != itself[i])
            if keep.any():
                found.append((i, j[keep], sums[keep]))
                n += len(found[-1][1])
                if n >= PIECE:
                    yield piece()
                    found, n = [], 0
        if found:
            yield piece()

    return meet


def _cut(tokens: Column, records: Column, few: int) -> Column:
    return F.greatest(F.ceil(tokens / TILE), F.least(F.lit(few), F.ceil(records / FEW))).cast("int")


def tile_pairs(left: DataFrame, right: DataFrame, self_join: bool, feedback: float = 0.0) -> DataFrame:
    """``lhs_id, rhs_id, score`` of the pairs of a block that reach the left record's ``least``.

    ``left`` has ``id, block, codes, parts, rips, least, total``, ``right`` has ``id, block,
    codes``, one row a record and block. Large blocks are cut in tiles on either side, every
    two of which meet in one task; small blocks share a cell. A tile's tokens are bounded, and
    pairs are given out in pieces, so memory does not depend on the input.
    """
    sizes = left.groupBy("block").agg(F.sum(F.size("codes")).alias("lt"), F.count("*").alias("ln"))
    sizes = sizes.join(right.groupBy("block").agg(F.sum(F.size("codes")).alias("rt"), F.count("*").alias("rn")), "block")
    big = (F.col("lt") >= CELL) | (F.col("rt") >= CELL)
    small = sizes.agg(F.sum(F.when(~big, F.col("lt") + F.col("rt"))).alias("n")).first()["n"] or 0
    cell = F.when(big, F.concat(F.lit("b"), "block")).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("block"), F.lit(1 + small // CELL)).cast("string")))
    few = (6, 6) if self_join else (4, 24)
    tiles = sizes.select("block", cell.alias("cell"), F.when(big, _cut(F.col("lt"), F.col("ln"), few[0])).otherwise(1).alias("la"), F.when(big, _cut(F.col("rt"), F.col("rn"), few[1])).otherwise(1).alias("ra"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("array<double>")
    columns = ["cell", "a", "b", "is_left", "id", "block", "codes", "parts", "rips", "least", "total"]
    l = left.join(tiles, "block").withColumn("a", own("la")).withColumn("b", every("ra")).withColumn("is_left", F.lit(True)).select(*columns)  # noqa: E741
    r = right.join(tiles, "block").withColumn("b", own("ra")).withColumn("a", every("la")).withColumn("is_left", F.lit(False))
    r = r.select("cell", "a", "b", "is_left", "id", "block", "codes", none.alias("parts"), none.alias("rips"), F.lit(0.0).alias("least"), F.lit(0.0).alias("total"))
    return l.unionByName(r).groupBy("cell", "a", "b").applyInArrow(_meet(self_join, feedback), "lhs_id string, rhs_id string, score double")
