"""The matching verbs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.operators.embed import compute_embeddings, cosine_pairs
from linkwright.operators.exact import containment_pairs, equal_links, equal_pairs
from linkwright.operators.index import build_cross_index, build_index, id_text
from linkwright.operators.numbering import number_rows
from linkwright.operators.resolve import resolve_entities
from linkwright.operators.score import SLACK, best_pairs, score_pairs
from linkwright.plans.runtime import stash
from linkwright.plans.strategy import EmbeddingStrategy, ExactStrategy, ExecutionControl, SearchStrategy

__all__ = ["deduplicate_table", "detect_duplicates", "duplicate_links", "extract_unmatched", "materialize_records", "search_candidates", "candidate_pairs"]


def _override(strategy, weights, threshold):
    changes = {k: v for k, v in (("weights", weights), ("threshold", threshold)) if v is not None}
    if not changes:
        return strategy
    if weights is not None and not isinstance(strategy, SearchStrategy):
        raise ValueError("only search strategies take weights")
    from dataclasses import replace

    return replace(strategy, **changes)


def _only_search(strategy, *tokens) -> None:
    if any(t is not None for t in tokens) and not isinstance(strategy, SearchStrategy):
        raise ValueError("only search strategies take prepared tokens")


def duplicate_links(df: DataFrame, id: str, strategy, base_tokens: DataFrame | None = None) -> DataFrame:
    """``lhs_id, rhs_id, score`` of the links a strategy finds inside a table."""
    _only_search(strategy, base_tokens)
    if isinstance(strategy, SearchStrategy):
        return best_pairs(score_pairs(build_index(df, id, strategy, base_tokens), strategy, strategy.threshold), strategy)
    if isinstance(strategy, ExactStrategy):
        links = equal_links(df, id, strategy)
        if strategy.containment != "off":
            links = links.unionByName(containment_pairs(df, id, None, None, strategy))
        return links.withColumn("score", F.lit(1.0))
    if isinstance(strategy, EmbeddingStrategy):
        return cosine_pairs(compute_embeddings(df, id, strategy), None, strategy.threshold, strategy.block_rows, strategy.normalize)
    raise TypeError(f"not a strategy: {strategy!r}")


def _rest(df: DataFrame, id: str, taken: tuple[str, ...]) -> DataFrame:
    """The records under ``id`` as text, other columns kept; a column whose name the result uses gets a suffix."""
    names = {c: (c if c not in taken else f"{c}_original") for c in df.columns if c != id}
    return df.select(id_text(id).alias("id"), *[F.col(c).alias(n) for c, n in names.items()])


def detect_duplicates(df: DataFrame, id: str, strategy, weights: dict | None = None, threshold: float | None = None, base_tokens: DataFrame | None = None) -> DataFrame:
    """``duplicate_group, id, score, rank`` and the other columns, for records in a group of two or more.

    ``base_tokens`` is what ``prepare_search_data`` made of the table before; its pipelines then do not run again.
    """
    strategy = _override(strategy, weights, threshold)
    links = duplicate_links(df, id, strategy, base_tokens)
    ent = resolve_entities(links, "lhs_id", "rhs_id", "score")
    sized = ent.withColumnRenamed("entity", "duplicate_group").select("duplicate_group", "id", "score", "rank")
    return sized.join(_rest(df, id, ("duplicate_group", "score", "rank")), "id", "left").select("duplicate_group", "id", "score", "rank", *[c for c in _rest(df, id, ("duplicate_group", "score", "rank")).columns if c != "id"])


def candidate_pairs(
    base: DataFrame, target: DataFrame, base_id: str, target_id: str, strategy, base_tokens: DataFrame | None = None, target_tokens: DataFrame | None = None
) -> DataFrame:
    """``lhs_id, rhs_id, score`` of base records and their candidates."""
    _only_search(strategy, base_tokens, target_tokens)
    if isinstance(strategy, SearchStrategy):
        index = build_cross_index(base, target, base_id, target_id, strategy, base_tokens, target_tokens)
        return best_pairs(score_pairs(index, strategy, strategy.threshold), strategy)
    if isinstance(strategy, ExactStrategy):
        pairs = equal_pairs(base, base_id, target, target_id, strategy)
        if strategy.containment != "off":
            pairs = pairs.union(containment_pairs(base, base_id, target, target_id, strategy)).distinct()
        return pairs.withColumn("score", F.lit(1.0))
    if isinstance(strategy, EmbeddingStrategy):
        b, t = compute_embeddings(base, base_id, strategy), compute_embeddings(target, target_id, strategy)
        return cosine_pairs(b, t, strategy.threshold, strategy.block_rows, strategy.normalize)
    raise TypeError(f"not a strategy: {strategy!r}")


def _chunked(base, target, base_id, target_id, strategy, control: ExecutionControl) -> DataFrame:
    """One hashed share of the block values at a time; a share that fails is skipped, tried again or raised."""
    if control.chunk_by not in strategy.block_by:
        raise ValueError("chunk_by must be one of the strategy's block columns")
    parts, failed = [], []
    for i in range(control.chunks):
        here = F.pmod(F.xxhash64(F.col(control.chunk_by).cast("string")), F.lit(control.chunks)) == i
        for attempt in range(1 + (control.retries if control.on_error == "retry" else 0)):
            try:
                parts.append(stash(candidate_pairs(base.where(here), target.where(here), base_id, target_id, strategy)))
                break
            except Exception:
                if control.on_error == "stop":
                    raise
                if attempt == control.retries or control.on_error == "skip":
                    failed.append(i)
                    break
    if failed:
        warnings.warn(f"chunks {failed} failed and were left out", stacklevel=3)
    out = parts[0] if parts else candidate_pairs(base.limit(0), target.limit(0), base_id, target_id, strategy)
    for p in parts[1:]:
        out = out.union(p)
    out.failed_chunks = failed
    return out


def search_candidates(
    base: DataFrame, target: DataFrame, base_id: str, target_id: str, strategy, weights: dict | None = None, threshold: float | None = None, control: ExecutionControl | None = None,
    base_tokens: DataFrame | None = None, target_tokens: DataFrame | None = None,
) -> DataFrame:
    """Two rows a pair: ``match_id, score, source, id, rank`` and each side's other columns, united by name.

    Pairs are numbered by (base id, target id); inside a pair the base row ranks first.
    ``base_tokens`` and ``target_tokens`` are what ``prepare_search_data`` made of the tables
    before. The result's attribute ``failed_chunks`` lists the chunks that are missing from it.
    """
    strategy = _override(strategy, weights, threshold)
    if control and control.chunk_by:
        pairs = _chunked(base, target, base_id, target_id, strategy, control)
    else:
        pairs = candidate_pairs(base, target, base_id, target_id, strategy, base_tokens, target_tokens)
    numbered = number_rows(pairs, ["lhs_id", "rhs_id"], "match_id")
    used = ("match_id", "score", "source", "rank")
    sides = []
    for source, key, df, name in (("base", "lhs_id", base, base_id), ("target", "rhs_id", target, target_id)):
        rows = numbered.select("match_id", "score", F.lit(source).alias("source"), F.col(key).alias("id"), F.lit(1 if source == "base" else 2).alias("rank"))
        sides.append(rows.join(_rest(df, name, used), "id", "left").select("match_id", "score", "source", "id", "rank", *[c for c in _rest(df, name, used).columns if c != "id"]))
    out = sides[0].unionByName(sides[1], allowMissingColumns=True)
    out.failed_chunks = getattr(pairs, "failed_chunks", [])
    return out


def deduplicate_table(base: DataFrame, duplicates: DataFrame, id: str) -> DataFrame:
    """The table without the records that are duplicates of a better ranked one."""
    drop = duplicates.where("rank <> 1").select(F.col("id").alias("_drop")).distinct()
    return base.join(drop, id_text(base[id]) == F.col("_drop"), "left_anti")


def extract_unmatched(df: DataFrame, id: str, matches: DataFrame) -> DataFrame:
    """Records whose id is in no match; a null id is matched by none."""
    if "id" not in matches.columns:
        raise ValueError("matches must have a column id")
    seen = matches.select(id_text("id").alias("_seen")).distinct()
    return df.join(seen, id_text(df[id]) == F.col("_seen"), "left_anti")


def materialize_records(df: DataFrame, id: str, ids: DataFrame | list) -> DataFrame:
    """Records whose id is in ``ids``: a list, or a table with a column ``id`` or of the id's name."""
    if not isinstance(ids, DataFrame):
        ids = df.sparkSession.createDataFrame([(str(i),) for i in ids], "id string")
    name = id if id in ids.columns else "id"
    if name not in ids.columns:
        raise ValueError(f"ids must have a column id or {id}")
    wanted = ids.select(id_text(name).alias("_wanted")).distinct()
    return df.join(wanted, id_text(df[id]) == F.col("_wanted"), "left_semi")


__all__ += ["SLACK"]
