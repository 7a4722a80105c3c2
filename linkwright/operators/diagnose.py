"""Audits, plans, summaries, explanations and samples."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.operators.embed import compute_embeddings
from linkwright.operators.exact import column_prints, containment_pairs
from linkwright.operators.index import KEY, block_key, build_cross_index, build_index, find_stopwords, id_text, prepare_search_data, token_sets, vocabulary
from linkwright.operators.recommend import recommendations
from linkwright.operators.score import relative_potential, weight_column
from linkwright.plans.runtime import stash
from linkwright.plans.strategy import EmbeddingStrategy, ExactStrategy, SearchStrategy

__all__ = [
    "audit_strategy", "compare_stages", "explain_match", "histogram", "match_type", "plan_strategy", "rarity_distribution", "sample_matches", "summarise_matches",
    "find_stopwords",
]

LOW_RARITY = 0.01
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


@dataclass
class Report:
    """A diagnostic's tables (DataFrames) and scalars, and what they suggest."""

    kind: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    values: dict[str, object] = field(default_factory=dict)
    hints: list[tuple[str, str]] = field(default_factory=list)

    def __getattr__(self, name):
        for source in ("tables", "values"):
            found = self.__dict__.get(source, {})
            if name in found:
                return found[name]
        raise AttributeError(name)

    def describe(self) -> str:
        lines = [self.kind] + [f"  {k}: {v}" for k, v in self.values.items()] + [f"  table {k}: {', '.join(t.columns)}" for k, t in self.tables.items()]
        return "\n".join(lines + [f"  - {m}" for _, m in self.hints])

    __repr__ = describe


def match_type(matches: DataFrame) -> str:
    """duplicates or candidates, by the columns."""
    names = set(matches.columns)
    if {"match_id", "source", "id", "score"} <= names:
        return "candidates"
    if {"duplicate_group", "id", "score"} <= names:
        return "duplicates"
    raise ValueError("not a match table: it needs duplicate_group or match_id and source")


def histogram(df: DataFrame, column: str = "score", bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """``bin_lower, bin_upper, count`` of equal bins from least to most; the last includes its end. One value: one bin.

    Empty bins have no row.
    """
    by = by or []
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("x"))
    ends = rows.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = rows.join(ends, by) if by else rows.crossJoin(F.broadcast(ends))  # one row of two numbers
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counted = rows.groupBy(*by, "lo", "hi", b.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    upper = F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width)
    return counted.select(*by, (F.col("lo") + F.col("bin") * width).alias("bin_lower"), upper.alias("bin_upper"), "count")


def _vocabulary(df: DataFrame, id: str, strategy: SearchStrategy) -> DataFrame:
    return vocabulary(token_sets(prepare_search_data(df, id, strategy)), strategy)


def rarity_distribution(df: DataFrame, id: str, strategy: SearchStrategy, n_offenders: int = 20) -> Report:
    """Per block and column: vocabulary, highest df and its token, rarity range; and the commonest tokens."""
    return _rarity_tables(_vocabulary(df, id, strategy), n_offenders)


def _rarity_tables(voc: DataFrame, n_offenders: int) -> Report:
    per = voc.groupBy("block", "src_column").agg(
        F.count("*").alias("n_tokens"),
        F.max("df").alias("df_max"),
        F.min(F.struct(-F.col("df"), F.col("token"), F.col("rarity"))).alias("_top"),
        F.min("rarity").alias("rarity_min"),
        F.percentile("rarity", 0.5).alias("rarity_p50"),
        F.max("rarity").alias("rarity_max"),
    )
    per = per.withColumn("top_token", F.col("_top.token")).withColumn("suggested_min_rarity", F.col("_top.rarity")).drop("_top")
    top = voc.select("block", "src_column", "token", "df", "rarity").orderBy(F.desc("df"), "src_column", "token", "block").limit(n_offenders)
    return Report("rarity distribution", {"distribution": per, "offenders": top})


def _share_of(df: DataFrame, condition: Column) -> float | None:
    r = df.agg(F.avg(condition.cast("int").cast("double")).alias("x")).first()
    return r["x"]


def audit_strategy(df: DataFrame, id: str, strategy, target: DataFrame | None = None, target_id: str | None = None, sample_pairs: int = 1000, seed: int = 1) -> Report:
    """How a table looks through a strategy, before any pair is made."""
    if isinstance(strategy, EmbeddingStrategy):
        return _audit_embedding(df, id, strategy, sample_pairs, seed)
    strategy = strategy.proxy() if isinstance(strategy, ExactStrategy) else strategy
    n = df.select(id_text(id).alias("id")).distinct().count()
    tokens = prepare_search_data(df, id, strategy)
    counted = tokens.groupBy("src_column").agg(F.count("*").alias("n_tokens"))
    voc = vocabulary(token_sets(tokens), strategy)
    unique = voc.groupBy("src_column").agg(F.count_distinct("token").alias("n_unique_tokens"))
    na = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in strategy.columns]).first()
    names = df.sparkSession.createDataFrame([(c, float(na[c] or 0.0)) for c in strategy.columns], "src_column string, na_rate double")
    stats = names.join(counted, "src_column", "left").join(unique, "src_column", "left").na.fill(0, ["n_tokens", "n_unique_tokens"])
    stats = stats.select(
        F.col("src_column").alias("column"), "n_tokens", "n_unique_tokens", F.try_divide("n_unique_tokens", "n_tokens").alias("pct_unique"), "na_rate",
        (F.col("n_tokens") / max(n, 1)).alias("avg_tokens_per_record"),
    )
    distinct = voc.select("src_column", "token", "rarity").distinct()
    rarity = distinct.groupBy(F.col("src_column").alias("column")).agg(
        *[F.percentile("rarity", q).alias(f"rarity_p{round(100 * q):02d}") for q in QUANTILES], F.avg((F.col("rarity") < LOW_RARITY).cast("double")).alias("pct_low_rarity")
    )
    signals: dict = {}
    worst = rarity.orderBy(F.desc("pct_low_rarity"), "column").first()
    if worst is not None:
        signals |= {"max_pct_low_rarity_tokens": worst["pct_low_rarity"], "worst_rarity_column": worst["column"]}
    tables = {"token_stats": stats, "rarity_stats": rarity}
    values: dict = {"n_records": n}
    records = df.select(id_text(id).alias("id"), block_key(strategy.plain_blocks).alias("block")) if not strategy.token_blocks else tokens.select("id", "block")
    per_block = records.where("block is not null").distinct().groupBy("block").agg(F.count("*").alias("n_records"))
    est = per_block.agg(F.sum(F.col("n_records") * (F.col("n_records") - 1) / 2).alias("x"), F.max("n_records").alias("m"), F.sum("n_records").alias("n"), F.count("*").alias("k"), F.min("n_records").alias("lo"), F.percentile("n_records", 0.5).alias("mid")).first()
    if strategy.block_by:
        tables["block_distribution"] = per_block.withColumn("pct_records", F.col("n_records") / F.lit(est["n"]))
        values["block_summary"] = {"n_blocks": est["k"], "top1_share": est["m"] / est["n"] if est["n"] else None, "min_size": est["lo"], "median_size": est["mid"], "max_size": est["m"]}
        signals["block_top_share"] = values["block_summary"]["top1_share"]
    values["est_comparisons"] = signals["est_comparisons"] = float(est["x"] or 0.0)
    if target is not None:
        other = _vocabulary(target, target_id or id, strategy).select("src_column", "token").distinct().withColumn("_in", F.lit(1.0))
        overlap = distinct.select("src_column", "token").distinct().join(other, ["src_column", "token"], "left")
        tables["vocab_overlap"] = overlap.groupBy(F.col("src_column").alias("column")).agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("overlap"))
    return Report("strategy audit", tables, values, recommendations(signals))


def _audit_embedding(df, id, strategy, sample_pairs, seed) -> Report:
    e = compute_embeddings(df, id, strategy)
    v = F.transform("embedding", lambda x: x.cast("double"))
    normed = e.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)))
    got = normed.agg(F.avg(F.col("embedding").isNotNull().cast("double")).alias("coverage"), *[F.percentile("norm", q).alias(f"p{round(100 * q):02d}") for q in QUANTILES]).first()
    # two shuffled lists laid side by side are a sample of pairs
    some = normed.where("embedding is not null").orderBy(F.xxhash64("id", F.lit(seed))).limit(2 * sample_pairs)
    place = F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id"))  # of at most 2 * sample_pairs rows
    numbered = some.withColumn("r", place)
    a = numbered.where("r % 2 = 0").select((F.col("r") / 2).cast("int").alias("k"), F.col("id").alias("base_id"), F.col("embedding").alias("x"), F.col("norm").alias("nx"))
    b = numbered.where("r % 2 = 1").select(((F.col("r") + 1) / 2).cast("int").alias("k"), F.col("id").alias("target_id"), F.col("embedding").alias("y"), F.col("norm").alias("ny"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    sims = a.join(b, "k").select("base_id", "target_id", F.try_divide(dot, F.col("nx") * F.col("ny")).alias("similarity"))
    iqr = (got["p75"] or 0.0) - (got["p25"] or 0.0)
    values = {"coverage_rate": got["coverage"], "norm_quantiles": {q: got[q] for q in ("p05", "p25", "p50", "p75", "p95")}, "norm_iqr": iqr}
    return Report("embedding audit", {"norms": normed.select("id", "norm"), "similarities": sims}, values, recommendations({"coverage_rate": got["coverage"], "norm_iqr": iqr}))


def _prints(df: DataFrame, id: str, strategy: SearchStrategy, candidates: dict[str, tuple]) -> DataFrame:
    """One row a record: ``fp`` over all columns, ``c<i>`` of each (digests), and ``k<j>`` of each candidate block key; written."""
    keys = {f"k{j}": F.coalesce(block_key(tuple(cols)), F.lit("\x00")) for j, cols in enumerate(candidates.values())}
    names = [f"c{i}" for i in range(len(strategy.columns))]
    first = column_prints(df, id, strategy.columns)
    base = df.select(id_text(id).alias("id"), *[k.alias(n) for n, k in keys.items()]).where("id is not null").dropDuplicates(["id"])
    return stash(base.join(first, "id").withColumn("fp", F.concat_ws("\x1e", *names)))


def _frontier_row(b: DataFrame, t: DataFrame | None, key: str) -> DataFrame:
    """Blocks and comparisons of one candidate, and the share of exact twins that stay together. Counts only."""
    if t is None:
        counts = b.groupBy(key).agg(F.count("*").alias("n"))
        sizes = counts.agg(F.count("*").alias("n_blocks"), F.max("n").alias("max_block"), F.avg("n").alias("mean_block"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("brute_pairs"))
        pairs = lambda *k: b.groupBy(*k).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))
        total, stay = pairs("fp"), pairs("fp", key)
    else:
        both = b.groupBy(key).agg(F.count("*").alias("nb")).join(t.groupBy(key).agg(F.count("*").alias("nt")), key, "full").na.fill(0, ["nb", "nt"])
        sizes = both.agg(F.count("*").alias("n_blocks"), F.max(F.col("nb") + F.col("nt")).alias("max_block"), F.avg(F.col("nb") + F.col("nt")).alias("mean_block"), F.sum((F.col("nb") * F.col("nt")).cast("double")).alias("brute_pairs"))
        pairs = lambda *k: b.groupBy(*k).agg(F.count("*").alias("x")).join(t.groupBy(*k).agg(F.count("*").alias("y")), list(k)).agg(F.sum((F.col("x") * F.col("y")).cast("double")).alias("p"))
        total, stay = pairs("fp"), pairs("fp", key)
    one = sizes.crossJoin(total.withColumnRenamed("p", "_t")).crossJoin(stay.withColumnRenamed("p", "_s"))  # one row each
    return one.withColumn("exact_twin_survival", F.try_divide("_s", F.nullif("_t", F.lit(0.0)))).drop("_t", "_s")


def plan_strategy(
    base: DataFrame, strategy, block_candidates: dict[str, str | tuple], base_id: str, target: DataFrame | None = None, target_id: str | None = None,
    n_offenders: int = 20, min_rarity_grid: list[float] | None = None, containment: bool = False,
) -> Report:
    """What blocking and thinning would cost and lose, from counts; nothing is scored."""
    if not block_candidates:
        raise ValueError("block_candidates must name at least one key")
    exact = isinstance(strategy, ExactStrategy)
    proxy = (strategy.proxy() if exact else strategy).with_(block_by=(), weights={})
    weights = proxy.weight_of() if exact else strategy.weight_of()
    cand = {k: (v,) if isinstance(v, str) else tuple(v) for k, v in block_candidates.items()}
    names = list(proxy.columns)
    b = _prints(base, base_id, proxy, cand)
    t = _prints(target, target_id or base_id, proxy, cand) if target is not None else None
    frontier = [_frontier_row(b, t, f"k{j}").select(F.lit(k).alias("block_key"), "n_blocks", "max_block", "mean_block", "brute_pairs", "exact_twin_survival") for j, k in enumerate(cand)]
    frontier = reduce(DataFrame.unionByName, frontier).orderBy("brute_pairs")

    def twin_share(col: str) -> float:
        if t is None:
            got = b.groupBy(col).agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("x"), F.sum("n").alias("n")).first()
            return (got["x"] or 0) / got["n"] if got["n"] else 0.0
        return _share_of(b.join(t.select(col).distinct().withColumn("_in", F.lit(True)), col, "left"), F.coalesce("_in", F.lit(False))) or 0.0

    persister = {"overall": twin_share("fp"), "per_column": {c: twin_share(f"c{i}") for i, c in enumerate(names)}}
    if t is None:
        marked = b.join(b.groupBy("fp").agg(F.count("*").alias("_f")), "fp").join(b.groupBy("k0").agg(F.count("*").alias("_k")), "k0")
        matchable = _share_of(marked, F.col("_k") > 1)
        alone = marked.where("_f = 1")
        partial = {c: _share_of(alone.join(b.groupBy(f"c{i}").agg(F.count("*").alias("_c")), f"c{i}"), (F.col("_c") > 1) & (F.col(f"c{i}") != "")) or 0.0 for i, c in enumerate(names)}
    else:
        has = lambda df, col: df.join(t.select(col).distinct().withColumn("_in", F.lit(True)), col, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
        matchable = _share_of(has(b, "k0"), F.col("_in"))
        alone = has(b, "fp").where("not _in").drop("_in")
        partial = {c: _share_of(has(alone, f"c{i}"), F.col("_in") & (F.col(f"c{i}") != "")) or 0.0 for i, c in enumerate(names)}
    residual = {"matchable": matchable, "one_sided": None if matchable is None else 1 - matchable, "partial_recoverable": partial, "reference_block": next(iter(cand))}
    voc = stash(_vocabulary(base, base_id, proxy))
    if min_rarity_grid is None:
        q = voc.select("rarity").distinct().agg(F.percentile("rarity", [0.1, 0.25, 0.5, 0.75, 0.9]).alias("q")).first()["q"] or []
        min_rarity_grid = sorted({0.0, *q})
    grid = base.sparkSession.createDataFrame([(float(x),) for x in min_rarity_grid], "min_rarity double")
    grid = F.broadcast(grid)  # as many rows as the grid
    if t is None:
        mass = voc.groupBy("rarity").agg(F.sum(F.col("df") * (F.col("df") - 1) / 2).alias("m"))
        curve = grid.join(mass, F.col("rarity") >= F.col("min_rarity"), "left").groupBy("min_rarity").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("intermediate_pairs"))
    else:
        tv = _vocabulary(target, target_id or base_id, proxy).select("src_column", "token", F.col("df").alias("dt"), F.col("rarity").alias("rt"))
        mass = voc.join(tv, ["src_column", "token"]).groupBy(F.least("rarity", "rt").alias("rarity")).agg(F.sum((F.col("df") * F.col("dt")).cast("double")).alias("m"))
        curve = grid.join(mass, F.col("rarity") >= F.col("min_rarity"), "left").groupBy("min_rarity").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("intermediate_pairs"))
    rates = b.agg(*[F.avg((F.col(f"c{i}") == "").cast("double")).alias(f"c{i}") for i in range(len(names))]).first()
    total_w = sum(weights.values())
    empty = [(c, float(rates[f"c{i}"] or 0.0), 1 - weights[c] / total_w) for i, c in enumerate(names)]
    share = None
    if containment:
        ref = ExactStrategy(proxy.columns, next(iter(cand.values())), containment="forward")
        inside = containment_pairs(base, base_id, target, target_id or base_id, ref).select("lhs_id").distinct().count()
        n = b.count()
        share = inside / n if n else None
    worst = max(empty, key=lambda x: x[1])
    rows = [r.asDict() for r in frontier.collect()]  # one row a candidate
    signals = {"max_empty_column_rate": worst[1], "max_empty_column_name": worst[0], "max_empty_column_ceiling": worst[2], "containment_share": share, "est_comparisons": min(r["brute_pairs"] or 0.0 for r in rows)}
    most = max(r["brute_pairs"] or 0.0 for r in rows)
    good = [r for r in rows if (r["exact_twin_survival"] or 0.0) >= 0.95]
    if good and most:
        knee = min(good, key=lambda r: r["brute_pairs"] or 0.0)
        signals |= {"blocking_knee_block": knee["block_key"], "blocking_knee_survival": knee["exact_twin_survival"], "blocking_knee_savings": 1 - (knee["brute_pairs"] or 0.0) / most}
    reads = _rarity_tables(voc, n_offenders)
    tables = {"frontier": frontier, "min_rarity_curve": curve, "empty_column": base.sparkSession.createDataFrame(empty, "column string, empty_rate double, score_ceiling double")}
    return Report("strategy plan", tables | reads.tables, {"mode": "dedup" if t is None else "search", "persister_rate": persister, "residual_structure": residual, "containment_share": share}, recommendations(signals))


def _gaps(matches: DataFrame, kind: str) -> DataFrame:
    """``id, gap``: best minus second best, of base records (or groups) with two or more."""
    if kind == "candidates":
        rows, key, order = matches.where("source = 'base'"), "id", [F.desc("score")]
    else:
        rows, key, order = matches, "duplicate_group", [F.col("rank")]
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r <= 2")
    two = r.groupBy(F.col(key).alias("key")).agg(F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("b"))
    return two.where("b is not null").select("key", F.round(F.col("a") - F.col("b"), 9).alias("gap"))


def summarise_matches(
    matches: DataFrame, base: DataFrame | None = None, target: DataFrame | None = None, bins: int = 50, threshold: float | None = None, borderline_epsilon: float = 0.05,
    entity_cols: list[str] | None = None,
) -> Report:
    """Counts, coverage, score, cluster, ambiguity and gap distributions of a match table."""
    kind = match_type(matches)
    tables = {"score_dist": histogram(matches, "score", bins)}
    group = "duplicate_group" if kind == "duplicates" else "match_id"
    got = matches.agg(
        F.count_distinct(group).alias("groups"), F.count_distinct("id").alias("ids"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"),
        F.percentile("score", list(QUANTILES)).alias("q"), *([F.avg((F.abs(F.col("score") - threshold) < borderline_epsilon).cast("double")).alias("near")] if threshold is not None else []),
    ).first()
    values: dict = {"match_type": kind, "n_pairs_or_groups": got["groups"], "n_records_involved": got["ids"], "score": {"min": got["lo"], "max": got["hi"], "mean": got["mean"], "quantiles": got["q"]}}
    signals: dict = {"pct_pairs_borderline": got["near"] if threshold is not None and got["n"] else None}
    nb, nt = (df.count() if df is not None else 0 for df in (base, target))
    if kind == "duplicates":
        sizes = matches.groupBy("duplicate_group").agg(F.count("*").alias("cluster_size"))
        tables["cluster_dist"] = sizes.groupBy("cluster_size").agg(F.count("*").alias("n_clusters"))
        values["max_cluster_size"] = signals["max_cluster_size"] = sizes.agg(F.max("cluster_size")).first()[0] or 0
        values["base_coverage"], values["target_coverage"] = got["ids"] / nb if nb else None, None
        if cols := [c for c in entity_cols or [] if c in matches.columns]:
            same = matches.groupBy("duplicate_group").agg(*[F.count_distinct(c).alias(c) for c in cols]).where(reduce(lambda x, y: x & y, [F.col(c) == 1 for c in cols])).count()
            values["n_identical_entity_groups"] = signals["n_identical_entity_groups"] = same
            signals["entity_cols_label"] = ", ".join(cols)
    else:
        sides = matches.agg(F.count_distinct(F.when(F.col("source") == "base", F.col("id"))).alias("b"), F.count_distinct(F.when(F.col("source") == "target", F.col("id"))).alias("t")).first()
        values["base_coverage"], values["target_coverage"] = (sides["b"] / nb if nb else None), (sides["t"] / nt if nt else None)
        signals["base_coverage_candidates"] = values["base_coverage"]
        per = matches.where("source = 'base'").groupBy("id").agg(F.count_distinct("match_id").alias("candidates_per_record"))
        tables["ambiguity_dist"] = per.groupBy("candidates_per_record").agg(F.count("*").alias("n_records"))
        signals["pct_records_with_ge3_matches"] = values["pct_records_with_ge3_matches"] = _share_of(per, F.col("candidates_per_record") >= 3)
        gaps = _gaps(matches, kind)
        tables["top_gap_dist"] = histogram(gaps, "gap", 20)
        signals["score_top_gap_median"] = values["score_top_gap_median"] = gaps.agg(F.percentile("gap", 0.5)).first()[0]
    return Report("match overview", tables, values, recommendations(signals))


def explain_match(base: DataFrame, base_id: str, strategy, lhs: str, rhs: str, target: DataFrame | None = None, target_id: str | None = None) -> DataFrame:
    """``src_column, token, rarity, rip, weight, contribution`` of what two records share; contributions sum to the score.

    Rarity and thinning are the corpus's, as in the search; then only the two records' tokens
    take part. Of several common blocks the best is explained.
    """
    if isinstance(strategy, EmbeddingStrategy):
        a = compute_embeddings(base, base_id, strategy).where(F.col("id") == lhs).select(F.col("embedding").alias("x"))
        b = compute_embeddings(base if target is None else target, target_id or base_id, strategy).where(F.col("id") == rhs).select(F.col("embedding").alias("y"))
        dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
        return a.crossJoin(b).select(dot.alias("cosine_similarity"))  # one row each
    if isinstance(strategy, ExactStrategy):
        strategy = strategy.proxy()
    index = build_index(base, base_id, strategy) if target is None else build_cross_index(base, target, base_id, target_id or base_id, strategy)
    rows = index.weighted()
    l_rows, r_rows = (rows, rows) if target is None else (rows.where("side = 'base'"), rows.where("side = 'target'"))
    left = relative_potential(l_rows.where(F.col("id") == lhs), strategy).withColumn("weight", weight_column(strategy))
    shared = left.join(r_rows.where(F.col("id") == rhs).select(*KEY), KEY)
    shared = shared.withColumn("contribution", F.col("rip") * F.col("weight"))
    factor = F.lit(1.0)
    if strategy.feedback_strength:
        total = left.groupBy("block").agg(F.sum("rip").alias("_total"))
        matched = shared.groupBy("block").agg(F.sum("rip").alias("_matched"))
        shared = shared.join(total, "block").join(matched, "block")
        factor = 1.0 - strategy.feedback_strength * (1.0 - F.try_divide("_matched", "_total"))
    if strategy.on_missing == "renormalise":
        present = left.select("src_column").union(r_rows.where(F.col("id") == rhs).select("src_column")).distinct().withColumn("_w", weight_column(strategy)).agg(F.sum("_w").alias("_z"))
        shared = shared.crossJoin(present)  # one row
        factor = factor / F.when(F.col("_z") > 0, F.col("_z")).otherwise(1.0)
    shared = shared.withColumn("contribution", F.col("contribution") * factor)
    best = shared.groupBy("block").agg(F.sum("contribution").alias("_s")).orderBy(F.desc("_s"), "block").limit(1)
    return shared.join(best, "block").select("src_column", "token", "rarity", "rip", "weight", "contribution")


def sample_matches(
    matches: DataFrame, mode: str = "random", n: int = 10, threshold: float | None = None, seed: int = 1, stratify_by: str | None = None, expand_to_block: bool = False
) -> DataFrame:
    """Rows to look at: high, low, borderline, ambiguous, top_gap or random; ``n`` per stratum if asked.

    ``expand_to_block`` returns the whole pairs or groups of the rows chosen.
    """
    kind = match_type(matches)
    key = "match_id" if kind == "candidates" else "duplicate_group"
    steady = F.xxhash64(F.col("id").cast("string"), F.col(key), F.lit(seed))
    if mode in ("ambiguous", "top_gap"):
        if mode == "ambiguous":
            if kind == "duplicates":
                raise ValueError("ambiguity is a property of candidates")
            top = matches.where("source = 'base'").groupBy("id").agg(F.count_distinct("match_id").alias("c")).orderBy(F.desc("c"), "id").limit(n).select(F.col("id").alias("key"))
        else:
            top = _gaps(matches, kind).orderBy("gap", "key").limit(n).select("key")
        if kind == "duplicates":
            return matches.join(top.withColumnRenamed("key", key), key, "left_semi")
        hit = matches.where("source = 'base'").join(top.withColumnRenamed("key", "id"), "id", "left_semi").select("match_id").distinct()
        return matches.join(hit, "match_id", "left_semi")
    orders = {"high": [F.desc("score")], "low": [F.asc("score")], "random": [steady]}
    if mode == "borderline":
        if threshold is None:
            raise ValueError("borderline needs a threshold")
        order = [F.abs(F.col("score") - threshold)]
    elif mode in orders:
        order = orders[mode]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    rows = matches.where(F.col("score") >= threshold) if mode == "low" and threshold is not None else matches
    order = [*order, key, *(["source"] if kind == "candidates" else []), "id"]
    if stratify_by:
        chosen = rows.withColumn("_r", F.row_number().over(Window.partitionBy(stratify_by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    else:
        chosen = rows.orderBy(*order).limit(n)
    return matches.join(chosen.select(key).distinct(), key, "left_semi") if expand_to_block else chosen


def compare_stages(matches: DataFrame, stages: list[str], base: DataFrame | None = None, target: DataFrame | None = None, bins: int = 50) -> Report:
    """What each stage adds. ``matches`` has ``stage``, or is a ledger (``from, to, score, stage``); ``stages`` gives the order."""
    if {"from", "to"} <= set(matches.columns):
        b = matches.select("stage", "score", F.col("from").alias("id"), F.lit("base").alias("source"))
        matches = b.unionByName(matches.select("stage", "score", F.col("to").alias("id"), F.lit("target").alias("source")))
    sided = "source" in matches.columns
    order = F.lit(None).cast("int")
    for i, s in enumerate(stages):
        order = F.when(F.col("stage") == s, F.lit(i)).otherwise(order)
    side = F.col("source") if sided else F.lit("base")
    first = matches.withColumn("_o", order).where("_o is not null").groupBy(side.alias("side"), "id").agg(F.min("_o").alias("stage_index"))
    added = first.groupBy("stage_index").agg(F.count_if(F.col("side") == "base").alias("base_added"), F.count_if(F.col("side") == "target").alias("target_added"))
    names = matches.sparkSession.createDataFrame(list(enumerate(stages)), "stage_index int, stage string")
    w = Window.orderBy("stage_index").rowsBetween(Window.unboundedPreceding, 0)  # one row a stage
    out = names.join(added, "stage_index", "left").na.fill(0, ["base_added", "target_added"])
    out = out.withColumn("base_cumulative", F.sum("base_added").over(w)).withColumn("target_cumulative", F.sum("target_added").over(w))
    nb, nt = (df.count() if df is not None else None for df in (base, target))
    for s, n in (("base", nb), ("target", nt)):
        out = out.withColumn(f"{s}_pct_added", F.col(f"{s}_added") / F.lit(n) if n else F.lit(None).cast("double")).withColumn(f"{s}_pct_cumulative", F.col(f"{s}_cumulative") / F.lit(n) if n else F.lit(None).cast("double"))
    if not sided:
        for c in ("target_added", "target_cumulative"):
            out = out.withColumn(c, F.lit(None).cast("long"))
    overview = matches.groupBy("stage").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_records"), F.min("score").alias("score_min"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max"))
    signals = {}
    if nb:
        low = out.orderBy("base_pct_added").first()
        signals = {"min_stage_base_pct": low["base_pct_added"], "low_yield_stage_name": low["stage"]}
    return Report("stage comparison", {"coverage": out.orderBy("stage_index"), "overview": overview, "score_by_stage": histogram(matches, "score", bins, ["stage"])}, {}, recommendations(signals))
