"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import words_of
from linkwright.operators.graph import connected_components
from linkwright.plans.runtime import stash

__all__ = ["fingerprint", "fingerprints", "simhash_links", "simhash_components", "drop_near_duplicates"]

#: Buckets beyond this many fingerprints are split again by more bits.
BUCKET = 4096


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles (repeats count); 0 without words."""
    tokens = words_of(text)
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: 1 - words or None].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):  # a long text takes bounded memory
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, words: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, words, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    return udf(text)


def _split(bits: list[int], parts: int) -> list[list[int]]:
    """Consecutive groups of nearly the same width."""
    size, more = divmod(len(bits), parts)
    out, at = [], 0
    for i in range(parts):
        width = size + (i < more)
        out.append(bits[at : at + width])
        at += width
    return out


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _stars(batches, max_bits: int):
    """Within a bucket, every fingerprint points at the least of those it reaches by close steps."""
    for pdf in batches:
        left, right = [], []
        for members in pdf["fps"]:
            fps = np.sort(np.asarray(members, np.int64)).view(np.uint64)
            if len(fps) == 2:
                if int(fps[0] ^ fps[1]).bit_count() <= max_bits:
                    left.append(fps[0])
                    right.append(fps[1])
                continue
            while len(fps) > 1:  # one component after the other, breadth first
                root, fps = fps[0], fps[1:]
                queue = [root]
                while queue and len(fps):
                    near = np.bitwise_count(fps ^ queue.pop()) <= max_bits
                    if near.any():
                        found = fps[near]
                        fps = fps[~near]
                        queue.extend(found)
                        left.extend([root] * len(found))
                        right.extend(found)
        yield pd.DataFrame({"a": np.array(left, np.uint64).view(np.int64), "b": np.array(right, np.uint64).view(np.int64)})


def simhash_links(distinct: DataFrame, max_bits: int = 3, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` within ``max_bits`` of one another.

    Fingerprints at most ``max_bits`` apart agree on ``blocks - max_bits`` of ``blocks``
    bit groups at least, so each is filed under every such choice of groups (20 keys of
    about 32 bits by default) and close pairs meet under some key. Buckets give star edges
    inside their own components, never all pairs. A bucket of more than ``bucket`` members
    is filed again by its remaining bits, cut in ``max_bits + 1`` groups of which one must
    agree; that goes on until it is small or its free bits bound it, so a hot key is never
    one task and no pair is lost.
    """
    order = list(range(64))
    groups = _split(order, blocks)
    paths = [sorted(b for g in chosen for b in g) for chosen in combinations(groups, blocks - max_bits)]
    rows = distinct.select("fp")
    found = None
    filed = rows.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(p))).alias("key")) for i, p in enumerate(paths)])).alias("k"))
    filed = filed.select("k.path", "k.key", "fp")
    while True:
        sizes = filed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        members = stash(filed.join(sizes, ["path", "key"]))
        free = 64 - min(len(p) for p in paths)
        final = 1 << free <= bucket
        small = members if final else members.where(F.col("n") <= bucket)
        stars = small.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(lambda it: _stars(it, max_bits), "a long, b long")
        found = stars if found is None else found.union(stars)
        hot = members.where(F.col("n") > bucket)
        if final or hot.isEmpty():
            return found
        finer, parents = [], []
        for i, p in enumerate(paths):
            rest = _split([b for b in order if b not in set(p)], max_bits + 1)
            finer += [sorted(p + part) for part in rest]
            parents.append([len(finer) - len(rest) + j for j in range(len(rest))])
        spark = distinct.sparkSession
        steps = spark.createDataFrame([(i, c, _signed(finer[c])) for i, cs in enumerate(parents) for c in cs], "path int, child int, mask long")
        filed = hot.join(F.broadcast(steps), "path").select(F.col("child").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        paths = finer


def _grouped(docs: DataFrame, words: int, max_bits: int, text: str, doc_id: str, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``(doc_id, t, fp)``, t a hash of the text, and ``(fp, component, component_id)`` of every fingerprint."""
    fps = stash(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("t"), fingerprints(F.col(text), words).alias("fp")))
    distinct = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    nodes = stash(connected_components(simhash_links(distinct, max_bits, bucket=bucket)))
    roots = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = roots.groupBy("component").agg(F.min("rep").alias("component_id"))
    return fps, stash(roots.join(least, "component").select("fp", "component", "component_id"))


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 3, text: str = "text", doc_id: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id reachable over links of at most ``max_bits``.

    Exact copies fold into one fingerprint first (a map-side minimum), so a group of copies,
    however large, is one node. One row per input row; a null text has fingerprint 0 like an
    empty one and links like any other; a null id takes the least id of its group, if any.
    Rows with equal ids stay rows of their own; other columns are ignored.
    """
    fps, groups = _grouped(docs, words, max_bits, text, doc_id, bucket)
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Keep one row of every component, all its columns: the one with the least id (then the least text hash).

    Rows without words link like any other, so one of them stays; a row with a null id stays
    only if its whole group has none. Of rows equal in id and text the least stays.
    """
    fps, groups = _grouped(docs, words, max_bits, "text", "doc_id", bucket)
    rows = fps.join(groups, "fp").groupBy("component", "doc_id", "t").agg(F.count("*").alias("n"))
    chosen = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "n")).alias("r"))
    keep = stash(chosen.select(F.col("r.doc_id").alias("_d"), F.col("r.t").alias("_t"), F.col("r.n").alias("_n")))
    # The texts cross the network once and are never sorted: the other side, ids and hashes, is what is hashed.
    # Rows travel as one struct, so that no name of theirs meets one of ours.
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_h"))
    kept = keyed.join(keep.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")))
    once = kept.where("_n = 1").select("row.*")
    if keep.where("_n > 1").isEmpty():
        return once
    # rows that agree in id and text: one of them
    same = kept.where("_n > 1").groupBy("_d", "_h").agg(F.min("row").alias("row"))
    return once.unionByName(same.select("row.*"))
