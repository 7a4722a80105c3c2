"""The token index: tokens, rarity, thinning and the fan-out guard."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions import run_steps
from linkwright.plans.runtime import stash
from linkwright.plans.strategy import BlockOnTokens, ExactStrategy, SearchStrategy

__all__ = ["FanoutError", "choose_cut", "compute_rarity", "find_stopwords", "inspect_tokens", "prepare_search_data", "thin"]

RESERVED = ("src_column", "token", "btok", "freq", "df", "N", "rarity")
KEY = ["block", "src_column", "token"]

#: Words of a base table up to which a target is read for them only.
FEW_WORDS = 200_000


class FanoutError(RuntimeError):
    """A join would make more rows than a strategy that does not cap them allows."""


def id_text(c: Column | str) -> Column:
    """Ids as text; whole doubles without a fraction."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def check_input(df: DataFrame, id: str, strategy: SearchStrategy | ExactStrategy) -> None:
    missing = [c for c in (id, *strategy.columns, *(b if isinstance(b, str) else b.column for b in strategy.block_by)) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {sorted(set(missing))}")
    if clash := [b for b in strategy.block_by if isinstance(b, str) and b in RESERVED]:
        raise ValueError(f"reserved names cannot be blocks: {clash}")


def block_key(names: tuple[str, ...]) -> Column:
    """One text key for the plain blocks; null as soon as one is null, so that such records pair with none."""
    if not names:
        return F.lit("")
    parts = [F.regexp_replace(F.col(b).cast("string"), "\x1f", " ") for b in names]
    any_null = parts[0].isNull()
    for p in parts[1:]:
        any_null = any_null | p.isNull()
    return F.when(~any_null, F.concat_ws("\x1f", *parts))


def _long(df: DataFrame, id: str, columns: dict, plain: tuple[str, ...], keep: list[str]) -> DataFrame:
    """One scan: every column's pipeline in an array of structs, exploded twice. Ids as text."""
    lists = F.array(*[F.struct(F.lit(c).alias("c"), run_steps(F.col(c).cast("string"), s).alias("t")) for c, s in columns.items()])
    # Arrow encoders run before the explode; null lists and null tokens give no rows
    rows = df.select(id_text(id).alias("id"), block_key(plain).alias("block"), *[F.col(k).alias(k) for k in keep], F.explode(lists).alias("x"))
    return rows.select("id", "block", *keep, F.col("x.c").alias("src_column"), F.explode("x.t").alias("token")).where("id is not null and token is not null")


def _surviving(df: DataFrame, id: str, spec: BlockOnTokens, strategy: SearchStrategy) -> DataFrame:
    """``(id, btok)`` for the tokens of ``spec`` that few enough records have."""
    steps = spec.preparer or strategy.columns.get(spec.column)
    if steps is None:
        raise ValueError(f"block_on_tokens({spec.column!r}) needs a preparer: the strategy has no such column")
    rows = _long(df, id, {spec.column: steps}, (), []).where(F.length("token") >= spec.min_nchar)
    per = rows.groupBy("id", "token").agg(F.count("*").alias("c"))
    vocabulary = per.groupBy("token").agg(F.count("*").alias("df"), F.sum("c").alias("freq"))
    if not math.isinf(spec.max_df):
        vocabulary = vocabulary.where(F.col("df") <= spec.max_df)
    if spec.min_rarity:
        vocabulary = vocabulary.where(1.0 / F.col("freq") >= spec.min_rarity)
    return per.join(vocabulary.select("token"), "token").select("id", F.concat(F.lit(f"{spec.column}:"), "token").alias("btok"))


def _token_blocks(df: DataFrame, id: str, strategy: SearchStrategy) -> DataFrame | None:
    """``(id, btok)`` of all token blocks, or None without any."""
    parts = [_surviving(df, id, spec, strategy) for spec in strategy.token_blocks]
    return reduce(DataFrame.union, parts).distinct() if parts else None


def _pairing(blocks: DataFrame, strategy: SearchStrategy) -> DataFrame:
    """The token blocks that can make a pair and tell more than another: ``(id, btok)`` or ``(side, id, btok)``.

    A block of one record (or of one side) pairs nothing. Blocks of the very same records
    score them alike, so the least name stands for all; their members are compared as lists
    where ``max_df`` bounds these. Under global rarity a record's tokens count whether it
    pairs or not, so there every block stays.
    """
    if strategy.rarity_scope == "global":
        return blocks
    cross = "side" in blocks.columns
    sizes = [F.count_if(F.col("side") == x) >= 1 for x in ("base", "target")] if cross else [F.count("*") >= 2]
    who = F.struct("side", "id") if cross else F.col("id")
    if any(math.isinf(b.max_df) for b in strategy.token_blocks):
        kept = blocks.groupBy("btok").agg(reduce(lambda x, y: x & y, sizes).alias("ok")).where("ok").select("btok")
    else:
        groups = blocks.groupBy("btok").agg(F.array_sort(F.collect_list(who)).alias("members"), reduce(lambda x, y: x & y, sizes).alias("ok")).where("ok")
        kept = groups.groupBy("members").agg(F.min("btok").alias("btok")).select("btok")
    return blocks.join(kept, "btok")


def _in_blocks(rows: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Every record's tokens once in each of its token blocks."""
    if blocks is None:
        return rows
    return rows.join(blocks, "id").select("id", F.concat_ws("\x1e", "block", "btok").alias("block"), "src_column", "token", "btok", *(["c"] if "c" in rows.columns else [])).where("block is not null")


def _plain(df: DataFrame, id: str, strategy: SearchStrategy | ExactStrategy) -> DataFrame:
    check_input(df, id, strategy)
    return _long(df, id, strategy.columns, tuple(b for b in strategy.block_by if isinstance(b, str)), [])


def prepare_search_data(df: DataFrame, id: str, strategy: SearchStrategy | ExactStrategy) -> DataFrame:
    """Tokens in long form: ``id, block, src_column, token`` and, with token blocks, ``btok``; one row an occurrence.

    With token blocks a record appears in every block of its rare tokens, with all its
    tokens; a record without any has no rows. Null tokens are dropped, empty ones stay.
    """
    rows = _plain(df, id, strategy)
    return _in_blocks(rows, _token_blocks(df, id, strategy) if isinstance(strategy, SearchStrategy) else None)


def token_sets(tokens: DataFrame) -> DataFrame:
    """Occurrences folded: ``id, block, src_column, token, c`` (and ``side``), c the number of them."""
    keys = [c for c in ("side", "id", "block", "src_column", "token") if c in tokens.columns]
    return tokens.groupBy(*keys).agg(F.count("*").alias("c"))


def rarity_column(strategy: SearchStrategy, f: Column, df: Column, n: Column, total: Column) -> Column:
    f, df, n = f.cast("double"), df.cast("double"), n.cast("double")
    return {
        "inverse_freq": lambda: 1.0 / f,
        "smoothed_inverse_freq": lambda: 1.0 / (f + 1.0),
        "tfidf": lambda: f / total.cast("double") * F.log(1.0 + n / df),
        "bm25": lambda: F.log((n - df + 0.5) / (df + 0.5)),
    }[strategy.rarity]()


def _records(sets: DataFrame, keys: list[str]) -> DataFrame:
    who = [c for c in ("side", "id") if c in sets.columns]
    return sets.select(*who, *keys).distinct().groupBy(*keys).agg(F.count("*").alias("N"))


def vocabulary(sets: DataFrame, strategy: SearchStrategy, holders: DataFrame | None = None) -> DataFrame:
    """One row a (block, column, token): ``freq`` occurrences, ``df`` records, ``N`` records of the column, ``rarity``.

    ``holders`` has the records that N counts (as ``sets``, without tokens) where the sets lack some of their tokens.

    Both aggregate from the folded sets, so no distinct count is needed; with rarity_scope
    global, freq_global, df_global and N_global give the rarity and df stays the block's.
    """
    voc = sets.groupBy(*KEY).agg(F.sum("c").alias("freq"), F.count("*").alias("df"))
    if strategy.rarity_scope == "global":
        who = [c for c in ("side", "id") if c in sets.columns]
        flat = sets.groupBy(*who, "src_column", "token").agg(F.max("c").alias("c"))
        glob = flat.groupBy("src_column", "token").agg(F.sum("c").alias("freq_global"), F.count("*").alias("df_global"))
        voc = voc.join(glob, ["src_column", "token"]).join(_records(flat if holders is None else holders, ["src_column"]).withColumnRenamed("N", "N_global"), ["src_column"])
        voc = voc.join(_records(sets if holders is None else holders, ["block", "src_column"]), ["block", "src_column"])
        f, d, n, keys = F.col("freq_global"), F.col("df_global"), F.col("N_global"), ["src_column"]
        total = glob.groupBy("src_column").agg(F.sum("freq_global").alias("_total")) if strategy.rarity == "tfidf" else None
    else:
        voc = voc.join(_records(sets if holders is None else holders, ["block", "src_column"]), ["block", "src_column"]) if strategy.rarity in ("tfidf", "bm25") else voc.withColumn("N", F.lit(None).cast("long"))
        f, d, n, keys = F.col("freq"), F.col("df"), F.col("N"), ["block", "src_column"]
        total = voc.groupBy(*keys).agg(F.sum("freq").alias("_total")) if strategy.rarity == "tfidf" else None
    if total is not None:
        voc = voc.join(total, keys)
    return voc.withColumn("rarity", rarity_column(strategy, f, d, n, F.col("_total") if total is not None else f)).drop("_total")


def compute_rarity(tokens: DataFrame, strategy: SearchStrategy) -> DataFrame:
    """The token rows with ``freq, df, N, rarity`` (and their global forms) joined on."""
    sets = token_sets(tokens)
    voc = vocabulary(sets, strategy)
    if strategy.rarity_scope == "block" and strategy.rarity not in ("tfidf", "bm25"):
        voc = voc.drop("N").join(_records(sets, ["block", "src_column"]), ["block", "src_column"])
    return tokens.join(voc, KEY)


def choose_cut(histogram: list[tuple[int, int]], budget: float) -> tuple[float, float, bool]:
    """``(largest df kept, mass before, abort)`` from (df, mass): ascending df while the mass fits."""
    total = sum(m for _, m in histogram)
    if total <= budget:
        return math.inf, total, False
    cut, run = None, 0
    for d, m in sorted(histogram):
        run += m
        if run > budget:
            break
        cut = d
    return (cut, total, False) if cut is not None and cut >= 2 else (math.nan, total, True)


def _decide(histogram: DataFrame, strategy: SearchStrategy) -> float:
    """Collects (df, mass): as many rows as there are different dfs, at most the root of twice the tokens."""
    rows = [(r["d"], int(r["mass"])) for r in histogram.collect()]
    cut, total, abort = choose_cut(rows, strategy.max_fanout)
    if math.isinf(cut):
        return cut
    if strategy.on_fanout == "abort":
        raise FanoutError(f"the token join would make {total:,} rows, over max_fanout {strategy.max_fanout:,.0f}; use finer blocks, min_rarity or max_token_df")
    cut = 1 if abort else cut  # what tokens of two records make is over the budget: none pairs anything
    warnings.warn(f"the token join would make {total:,} rows: tokens of more than {cut} records are left out", stacklevel=3)
    return cut


def thin(voc: DataFrame, strategy: SearchStrategy, sides: DataFrame | None = None) -> DataFrame:
    """The vocabulary that takes part: rarity floor and df ceiling first, then the fan-out guard.

    ``sides`` has (key, df_base, df_target) for a search; its mass is their product, a
    dedup's is df (df - 1). The guard counts in the vocabulary; no pair is made.
    """
    if strategy.min_rarity:
        voc = voc.where(F.col("rarity") >= strategy.min_rarity)
    if not math.isinf(strategy.max_token_df):
        voc = voc.where(F.col("df") <= strategy.max_token_df)
    if strategy.on_fanout == "off":
        return voc
    if sides is None:
        counted = voc.select(F.col("df").alias("d"), (F.col("df") * (F.col("df") - 1)).alias("m"))
    else:
        counted = voc.select(*KEY).join(sides, KEY).select((F.col("df_base") + F.col("df_target")).alias("d"), (F.col("df_base") * F.col("df_target")).alias("m"))
    cut = _decide(counted.groupBy("d").agg(F.sum("m").alias("mass")), strategy)
    return voc if math.isinf(cut) else voc.where(F.col("df") <= cut)


@dataclass
class Index:
    """Folded token sets and the vocabulary kept of them; or, where blocks are small, ``rows`` weighted block by block."""

    sets: DataFrame
    kept: DataFrame | None = None
    rows: DataFrame | None = None

    def weighted(self) -> DataFrame:
        return self.sets.join(self.kept.select(*KEY, "rarity", "df"), KEY) if self.rows is None else self.rows


def _in_small_blocks(sets: DataFrame, strategy: SearchStrategy) -> DataFrame | None:
    """The weighted rows by windows inside blocks, whose records ``max_df`` bounds: one shuffle, by block.

    None where some block is not bounded, or where rarity looks beyond a token's own rows.
    """
    if strategy.rarity_scope == "global" or strategy.rarity not in ("inverse_freq", "smoothed_inverse_freq") or any(math.isinf(b.max_df) for b in strategy.token_blocks):
        return None
    w = Window.partitionBy(*KEY)
    side = (lambda x: F.count_if(F.col("side") == x).over(w)) if "side" in sets.columns else None
    rows = sets.repartition("block").withColumn("df", F.count("*").over(w))
    rows = rows.withColumn("rarity", rarity_column(strategy, F.sum("c").over(w), F.col("df"), F.lit(None), F.lit(None)))
    mass = F.col("df") - 1 if side is None else F.when(F.col("side") == "base", side("target")).otherwise(0)
    rows = rows.withColumn("_mass", mass)
    if strategy.min_rarity:
        rows = rows.where(F.col("rarity") >= strategy.min_rarity)
    if not math.isinf(strategy.max_token_df):
        rows = rows.where(F.col("df") <= strategy.max_token_df)
    if strategy.on_fanout != "off":
        cut = _decide(rows.groupBy(F.col("df").alias("d")).agg(F.sum("_mass").alias("mass")), strategy)
        rows = rows if math.isinf(cut) else rows.where(F.col("df") <= cut)
    return rows.drop("_mass")


def _sets(df: DataFrame, id: str, strategy: SearchStrategy) -> DataFrame:
    """The folded sets outside any token block; records with a null plain block are left out."""
    return token_sets(_plain(df, id, strategy)).where("block is not null")


def _given(tokens: DataFrame) -> DataFrame:
    """The folded sets of tokens that ``prepare_search_data`` made before, token blocks included."""
    if missing := [c for c in ("id", *KEY) if c not in tokens.columns]:
        raise ValueError(f"prepared tokens lack the columns {missing}")
    return token_sets(tokens.select("id", *KEY)).where("block is not null")


def build_index(df: DataFrame, id: str, strategy: SearchStrategy, tokens: DataFrame | None = None) -> Index:
    """The token pipelines run once: the folded sets are written, everything after reads them.

    ``tokens`` are those of ``prepare_search_data`` under the same strategy; the pipelines then do not run at all.
    """
    if tokens is not None:
        sets = stash(_given(tokens))
        return Index(sets, thin(vocabulary(sets, strategy), strategy))
    sets = stash(_sets(df, id, strategy))
    blocks = _token_blocks(df, id, strategy)
    if blocks is not None:
        sets = _in_blocks(sets, _pairing(stash(blocks), strategy)).drop("btok")
        rows = _in_small_blocks(sets, strategy)
        if rows is not None:
            return Index(sets, rows=rows)
        sets = stash(sets)
    return Index(sets, thin(vocabulary(sets, strategy), strategy))


def _words(sets: DataFrame, strategy: SearchStrategy) -> DataFrame | None:
    """The few words of ``sets``, to be broadcast; None where they are many or the other table's own words count."""
    if strategy.token_blocks or strategy.rarity == "tfidf" or strategy.on_missing == "renormalise":
        return None
    words = sets.select(*(KEY if strategy.rarity_scope == "block" else KEY[1:])).distinct()
    return F.broadcast(words) if words.count() <= FEW_WORDS else None


def _holders(df: DataFrame, id: str, strategy: SearchStrategy) -> DataFrame:
    """``id, block, src_column`` of the columns in which a record has any token."""
    named = [F.when(F.exists(run_steps(F.col(c).cast("string"), s), lambda t: t.isNotNull()), F.lit(c)) for c, s in strategy.columns.items()]
    rows = df.select(id_text(id).alias("id"), block_key(strategy.plain_blocks).alias("block"), F.explode(F.array_compact(F.array(*named))).alias("src_column"))
    return rows.where("id is not null and block is not null").distinct()


def build_cross_index(
    base: DataFrame, target: DataFrame, base_id: str, target_id: str, strategy: SearchStrategy, base_tokens: DataFrame | None = None, target_tokens: DataFrame | None = None
) -> Index:
    """Both tables in one index, told apart by ``side``; rarity counts them together. Tokens given are not made again.

    Where the base has few words, only these are taken from the target: no other can pair or weigh.
    """
    tables = [("base", base, base_id), ("target", target, target_id)]
    tokens = {"base": base_tokens, "target": target_tokens}
    named = lambda df, side: df.withColumn("side", F.lit(side))
    ready = any(t is not None for t in tokens.values())
    if ready and strategy.token_blocks:  # tokens come with their blocks
        tokens = {side: t if t is not None else prepare_search_data(df, i, strategy) for (side, df, i), t in zip(tables, tokens.values(), strict=True)}
    holders = None
    if ready:
        sets = [named(_sets(df, i, strategy) if tokens[side] is None else _given(tokens[side]), side) for side, df, i in tables]
    else:
        own = stash(named(_sets(base, base_id, strategy), "base"))
        words = _words(own, strategy)
        found = _plain(target, target_id, strategy)
        found = found if words is None else found.join(words, words.columns, "left_semi")
        sets = [own, named(token_sets(found).where("block is not null"), "target")]
        if words is not None and (strategy.rarity_scope == "global" or strategy.rarity == "bm25"):
            holders = own.select("side", "id", "block", "src_column").distinct().unionByName(named(_holders(target, target_id, strategy), "target"))
    sets = stash(reduce(DataFrame.unionByName, sets))
    if strategy.token_blocks and not ready:
        blocks = stash(reduce(DataFrame.unionByName, [named(_token_blocks(df, i, strategy), side) for side, df, i in tables]))
        pairing = stash(_pairing(blocks, strategy))
        parts = [named(_in_blocks(sets.where(F.col("side") == side), pairing.where(F.col("side") == side).drop("side")).drop("btok"), side) for side, *_ in tables]
        sets = reduce(DataFrame.unionByName, parts)
        rows = _in_small_blocks(sets, strategy)
        if rows is not None:
            return Index(sets, rows=rows)
        sets = stash(sets)
    sides = sets.groupBy(*KEY).agg(F.count_if(F.col("side") == "base").alias("df_base"), F.count_if(F.col("side") == "target").alias("df_target"))
    return Index(sets, thin(vocabulary(sets, strategy, holders), strategy, sides))


def find_stopwords(df: DataFrame, id: str, strategy: SearchStrategy, max_prop: float = 0.3, top_n: int | None = None, by_block: bool = False) -> DataFrame:
    """``src_column, token, df, n_records, prop``: tokens of at least ``max_prop`` of a column's records, and the ``top_n`` commonest.

    With ``by_block`` the proportion is the highest over the blocks.
    """
    tokens = prepare_search_data(df, id, strategy.with_(block_by=strategy.plain_blocks))
    if not by_block:
        tokens = tokens.withColumn("block", F.lit(""))
    sets = token_sets(tokens)
    voc = sets.groupBy(*KEY).agg(F.count("*").alias("df")).join(_records(sets, ["block", "src_column"]), ["block", "src_column"])
    voc = voc.withColumn("prop", F.col("df") / F.col("N")).withColumnRenamed("N", "n_records")
    best = voc.groupBy("src_column", "token").agg(F.max(F.struct("prop", "df", "n_records")).alias("b"))
    out = best.select("src_column", "token", "b.df", "b.n_records", "b.prop")
    if top_n is None:
        return out.where(F.col("prop") >= max_prop)
    place = F.row_number().over(Window.partitionBy("src_column").orderBy(F.desc("df"), "token"))
    ranked = out.withColumn("_r", place)
    return ranked.where((F.col("prop") >= max_prop) | (F.col("_r") <= top_n)).drop("_r")


def inspect_tokens(df: DataFrame, id: str, strategy: SearchStrategy, column: str) -> DataFrame:
    """``token, <column>, n``: which raw values a token comes from.

    A column called ``token`` is given as ``token_original``; beside one called ``n`` the number is ``n_rows``.
    """
    if column not in strategy.columns:
        raise ValueError(f"the strategy has no column {column!r}")
    raw = F.col(column)
    told = df.select(raw.alias("_raw"), F.explode(run_steps(raw.cast("string"), strategy.columns[column])).alias("token"))
    counted = told.where("token is not null").groupBy("token", "_raw").agg(F.count("*").alias("_n"))
    return counted.select("token", F.col("_raw").alias("token_original" if column == "token" else column), F.col("_n").alias("n_rows" if column == "n" else "n"))
