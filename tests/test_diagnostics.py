"""Diagnostics, calibration, sources, batches and streaming."""

import pytest
from pyspark.sql import functions as F

from linkwright.functions import word_tokens
from linkwright.operators import plots
from linkwright.operators.calibrate import apply_filter, auxiliary_potential, calibrate, choose_threshold, fit_filter, match_features, token_registry
from linkwright.operators.diagnose import audit_strategy, compare_stages, explain_match, match_type, plan_strategy, rarity_distribution, sample_matches, summarise_matches
from linkwright.operators.fuzzy import fuzzy_tokens, fuzzy_vocabulary
from linkwright.operators.recommend import CATALOG, recommendations
from linkwright.operators.verbs import duplicate_links
from linkwright.plans.batches import batch_map, batch_plan, suggest_batch_size
from linkwright.plans.strategy import EmbeddingStrategy, SearchStrategy
from linkwright.sources.labels import export_for_labelling, import_labels

W = [word_tokens()]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def candidates(spark):
    pairs = [("a", "x", 0.95), ("a", "y", 0.92), ("a", "z", 0.5), ("b", "x", 0.8)]
    data = [(m, s, src, i, r) for m, (l, t, s) in enumerate(pairs, 1) for src, i, r in (("base", l, 1), ("target", t, 2))]  # noqa: E741
    return spark.createDataFrame(data, "match_id long, score double, source string, id string, rank int")


@pytest.fixture(scope="module")
def groups(spark):
    data = [(1, "1", 0.95, 1), (1, "2", 0.9, 2), (1, "3", 0.88, 3), (2, "4", 0.8, 1), (2, "5", 0.78, 2)]
    return spark.createDataFrame(data, "duplicate_group long, id string, score double, rank int")


def test_summaries(spark, candidates, groups):
    base = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    s = summarise_matches(candidates, base, threshold=0.9)
    assert (s.n_pairs_or_groups, s.base_coverage, s.pct_records_with_ge3_matches) == (4, 0.5, 0.5)
    assert round(s.score_top_gap_median, 6) == 0.03
    assert rows(s.ambiguity_dist, "candidates_per_record", "n_records") == [(1, 1), (3, 1)]
    assert {i for i, _ in s.hints} >= {"candidates_high_ambiguity", "candidates_weak_decisiveness"} and "match overview" in s.describe()
    d = summarise_matches(groups, bins=5)
    assert rows(d.cluster_dist, "cluster_size", "n_clusters") == [(2, 1), (3, 1)] and d.max_cluster_size == 3
    assert sum(r["count"] for r in d.score_dist.collect()) == 5
    assert match_type(groups) == "duplicates"
    with pytest.raises(ValueError):
        match_type(base)


def test_samples(candidates, groups):
    assert rows(sample_matches(candidates, "high", 2), "score") == [(0.95,), (0.95,)]
    assert rows(sample_matches(candidates, "low", 1, threshold=0.6), "score") == [(0.8,)]
    assert rows(sample_matches(candidates, "borderline", 1, threshold=0.81), "match_id") == [(4,)]
    assert {r[0] for r in rows(sample_matches(candidates, "ambiguous", 1), "match_id")} == {1, 2, 3}
    assert rows(sample_matches(groups, "top_gap", 1), "duplicate_group") == [(2,), (2,)]
    assert sample_matches(candidates, "high", 1, expand_to_block=True).count() == 2
    assert sample_matches(candidates, "random", 1, stratify_by="source").count() == 2
    with pytest.raises(ValueError):
        sample_matches(groups, "ambiguous")


def test_explanation_sums_to_the_score(spark):
    df = spark.createDataFrame([("1", "a b c", "x"), ("2", "a b d", "x"), ("3", "a e", None)], "id string, n string, m string")
    for extra in ({}, {"feedback_strength": 0.5}, {"on_missing": "renormalise"}):
        s = SearchStrategy({"n": W, "m": W}, threshold=0.0, **extra)
        for link in duplicate_links(df, "id", s).collect():
            e = explain_match(df, "id", s, link["lhs_id"], link["rhs_id"])
            assert abs(sum(r["contribution"] for r in e.collect()) - link["score"]) < 1e-9
    assert plots.contribution_plot(e).count() >= 1 and plots.token_contribution_plot(e).count() == e.count()


def test_audit_and_plan(spark):
    df = spark.createDataFrame([("1", "a b", "p", "q"), ("2", "a b", "p", "r"), ("3", "a c", "p", "r"), ("4", None, "o", "s")], "id string, n string, k string, j string")
    s = SearchStrategy({"n": W}, block_by="k")
    a = audit_strategy(df, "id", s, target=df)
    assert rows(a.token_stats, "column", "n_tokens", "n_unique_tokens", "na_rate") == [("n", 6, 3, 0.25)]
    assert a.est_comparisons == 3.0 and rows(a.vocab_overlap, "overlap") == [(1.0,)]
    assert plots.block_size_plot(a).count() == 2 and plots.rarity_histogram(a).count() == 1
    p = plan_strategy(df, s, {"k": "k", "kj": ("k", "j")}, "id", containment=True)
    assert rows(p.frontier, "block_key", "n_blocks", "brute_pairs", "exact_twin_survival") == [("k", 2, 3.0, 1.0), ("kj", 3, 1.0, 0.0)]
    assert p.persister_rate["overall"] == 0.5 and rows(p.empty_column, "empty_rate") == [(0.25,)]
    assert p.residual_structure["matchable"] == 0.75 and plots.frontier_plot(p).count() == 2
    both = plan_strategy(df, s, {"k": "k"}, "id", target=df)
    assert rows(both.frontier, "brute_pairs") == [(10.0,)] and both.persister_rate["overall"] == 1.0
    r = rarity_distribution(df, "id", s)
    assert rows(r.distribution, "top_token", "df_max") == [("a", 3)]
    vec = EmbeddingStrategy(lambda ts: [[float(len(t)), 1.0] for t in ts], columns=("n",))
    e = audit_strategy(df, "id", vec, sample_pairs=2)
    assert e.coverage_rate == 0.75 and e.similarities.count() >= 1 and plots.norm_plot(e).count() >= 1


def test_stages(spark):
    ledger = spark.createDataFrame([("b1", "t1", 1.0, "one"), ("b2", "t2", 0.9, "one"), ("b2", "t3", 0.8, "two"), ("b3", "t1", 0.7, "two")], "from string, to string, score double, stage string")
    c = compare_stages(ledger, ["one", "two"], base=spark.range(10))
    assert rows(c.coverage, "stage", "base_added", "base_cumulative", "target_added", "base_pct_added") == [("one", 2, 2, 2, 0.2), ("two", 1, 3, 1, 0.1)]
    assert plots.stage_coverage_plot(c).count() == 2


def test_recommendations():
    assert len(CATALOG) == 18
    got = [i for i, _ in recommendations({"max_cluster_size": 60, "n_identical_entity_groups": 9, "norm_iqr": None})]
    assert got == ["cluster_identical_name_street"]


def test_potential(spark):
    base = spark.createDataFrame([(str(i), n) for i, n in enumerate(["common mid rare", "common mid", "common mid", "common", "common", "common"])], "id string, n string")
    aux = spark.createDataFrame([(str(i), n) for i, n in enumerate(["common mid novel", "common", "common", "common"])], "id string, n string")
    s = SearchStrategy({"n": W})
    r, a = token_registry(base, "id", s), token_registry(aux, "id", s)
    got = {x["token"]: round(x["aip"], 4) for x in auxiliary_potential(r, a).collect()}
    assert got["common"] == 0.0 and got["rare"] == 1.0 and got["novel"] == 1.0 and got["mid"] == 1.0
    assert got == {x["token"]: round(x["aip"], 4) for x in auxiliary_potential(a, r).collect()}


def test_filter_round_trip(spark, tmp_path):
    n = 40
    base = spark.createDataFrame([(f"b{i}", f"name{i} city{i % 3} extra{i}") for i in range(n)], "id string, n string")
    target = spark.createDataFrame([(f"t{i}", f"name{i} city{i % 3} extra{i}" if i % 2 else f"other{i} city{i % 3} thing{i}") for i in range(n)], "id string, n string")
    data = [(i, 0.9 if i % 2 else 0.8 + i / 400, src, f"{src[0]}{i}", r) for i in range(n) for src, r in (("base", 1), ("target", 2))]
    m = spark.createDataFrame(data, "match_id long, score double, source string, id string, rank int")
    s = SearchStrategy({"n": W})
    f = match_features(m, s, base, "id", target, "id", top_n=2)
    one = f.where("searched = 'b1'").first()
    assert (one["cnt"], one["icnt"], one["scnt"], one["sim_sf_n"]) == (1, 1, 3, 1.0) and one["m_n_1"] == 1.0 and one["f_n_1"] is None
    labels = m.withColumn("equal", (F.col("match_id") % 2).cast("int")).where("match_id < 30")
    model = fit_filter(f, labels, class_weighted=True)
    out = apply_filter(f, model, m)
    assert rows(out.matches.where("match_id >= 30").select((F.col("predicted_tp") == F.col("match_id") % 2).alias("ok")).distinct(), "ok") == [(True,)]
    c = calibrate(out.pairs.withColumn("equal", (F.col("match_id") % 2).cast("int")), out.threshold)
    assert c.brier < 0.05 and c.threshold_curve.count() == 101
    assert any(i == "calibration_low_n_warning" for i, _ in out.hints)
    with pytest.raises(ValueError):
        fit_filter(f, labels.withColumn("equal", F.lit(1)))
    path = str(tmp_path / "labels")
    export_for_labelling(m.where("match_id < 3"), path)
    back = import_labels(spark, path)
    assert back.columns[0] == "equal" and rows(back, "equal") == [(1,)] * 6


def test_thresholds(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.1, 0)], "tp_prob double, equal int")
    assert choose_threshold(s) == 0.8
    assert choose_threshold(s, "target_recall", target_recall=1.0) == 0.6
    assert choose_threshold(s, "cost_weighted", cost_ratio=5) == 0.6


def test_fuzzy(spark):
    df = spark.createDataFrame([("1", "Neumann Neumaxn"), ("2", "neuman"), ("3", "Xyz ab"), ("4", None)], "id string, n string")
    got = dict(rows(fuzzy_vocabulary(df, "n"), "token", "canonical"))
    assert {got[x] for x in ("NEUMANN", "NEUMAXN", "NEUMAN")} == {"NEUMANN"} and got["XYZ"] == "XYZ"
    out = {r["id"]: r["fuzzy_tokens"] for r in fuzzy_tokens(df, "id", "n").collect()}
    assert out["1"] == ["NEUMANN", "NEUMANN"] and out["4"] is None


def test_batches(spark):
    df = spark.createDataFrame([(f"{i:02d}", "ab"[i > 2] if i < 6 else "c") for i in range(10)], "id string, k string")
    assert rows(batch_plan(df, "id", 4).batches, "batch_id", "n_rows") == [(1, 4), (2, 4), (3, 2)]
    assert rows(batch_plan(df, "id", 3, strategy="block_first", block_by="k").batches, "n_rows", "oversized") == [(3, False), (3, False), (4, True)]
    assert rows(batch_plan(df, "id", 3, strategy="block_first", block_by="k", atomic_blocks=False).batches, "n_rows") == [(1,), (3,), (3,), (3,)]
    packed = batch_plan(df, "id", 7, strategy="block_consolidated", block_by="k")
    assert rows(packed.batches, "n_rows") == [(4,), (6,)]
    assert batch_map(df, lambda p: p[["id"]], "id string", packed).count() == 10 and batch_map(df, lambda p: p[["id"]], "id string").count() == 10
    assert suggest_batch_size(100, 1e9, 60_000) == (60_000, 15_000)


def test_stream(spark, tmp_path):
    from linkwright.streaming.incremental import link_stream

    src = str(tmp_path / "in")
    schema = "id string, n string"
    run = lambda: link_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "base"), str(tmp_path / "links"), "id", SearchStrategy({"n": W}, threshold=0.9), str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    spark.createDataFrame([("1", "a b"), ("2", "c d")], schema).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("3", "a b")], schema).write.mode("append").parquet(src)
    run()
    links = spark.read.parquet(str(tmp_path / "links"))
    assert rows(links, "lhs_id", "rhs_id") == [("3", "1")] and spark.read.parquet(str(tmp_path / "base")).count() == 3
