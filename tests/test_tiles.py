"""Pairs scored tile against tile, and what the search need not read."""

import pytest
from pyspark.sql import functions as F

from linkwright.operators import embed, exact, index, tiles
from linkwright.operators.index import build_cross_index, build_index
from linkwright.operators.score import SLACK, best_pairs, score_pairs
from linkwright.operators.verbs import duplicate_links
from linkwright.plans.strategy import EmbeddingStrategy, ExactStrategy, SearchStrategy
from tests.test_plans import W, records, scores


def test_many_tiles_and_pieces_give_all_pairs(spark, monkeypatch):
    """Blocks cut in tiles on either side, pairs given out in pieces of a few."""
    for name, x in (("TILE", 40), ("CELL", 20), ("FEW", 8), ("PIECE", 3)):
        monkeypatch.setattr(tiles, name, x)
    base, target = records(spark, 60, 11), records(spark, 40, 12, "t")
    s = SearchStrategy({"a": W, "b": W}, block_by="k", threshold=0.35, on_fanout="off", feedback_strength=0.4)
    for i in (build_index(base, "id", s), build_cross_index(base, target, "id", "id", s)):
        whole = {k: v for k, v in scores(score_pairs(i, s)).items() if v >= 0.35 - SLACK}
        assert scores(best_pairs(score_pairs(i, s, 0.35), s)) == whole and whole


def test_a_cap_below_every_token_pairs_nothing(spark):
    """As in the SQL of q_fanout_cap: where no df fits the budget, no token of two records is kept."""
    df = spark.createDataFrame([("1", "x y"), ("2", "x y")], "id string, n string")
    with pytest.warns(UserWarning, match="left out"):
        assert duplicate_links(df, "id", SearchStrategy({"n": W}, threshold=0.1, max_fanout=1)).count() == 0


def test_ties_of_best_candidates_do_not_hang_on_the_order_of_sums(spark):
    pairs = spark.createDataFrame([("l", "a", 0.3), ("l", "b", 0.1 + 0.2)], "lhs_id string, rhs_id string, score double")
    got = best_pairs(pairs, SearchStrategy({"n": W}, threshold=0.1, max_candidates=1))
    assert [r["rhs_id"] for r in got.collect()] == ["a"]


@pytest.mark.parametrize("options", [{}, {"rarity": "bm25"}, {"rarity_scope": "global", "block_by": "k"}])
def test_a_target_is_read_for_the_words_of_the_base(spark, options, monkeypatch):
    base, target = records(spark, 12, 13), records(spark, 60, 14, "t")
    s = SearchStrategy({"a": W}, threshold=0.2, on_fanout="off", **options)
    few = build_cross_index(base, target, "id", "id", s)
    words = {r["token"] for r in few.sets.where("side = 'base'").select("token").collect()}
    assert {r["token"] for r in few.sets.where("side = 'target'").select("token").collect()} <= words
    got = scores(best_pairs(score_pairs(few, s, 0.2), s))
    monkeypatch.setattr(index, "FEW_WORDS", 0)
    assert got == scores(best_pairs(score_pairs(build_cross_index(base, target, "id", "id", s), s), s)) and got


def test_cosines_are_given_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(embed, "PIECE", 5)
    df = spark.range(9).select(F.col("id").cast("string"), F.lit("").alias("block"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    assert embed.score_embeddings(df, df, EmbeddingStrategy("embedding", block_rows=4)).count() == 81
    links = embed.cosine_pairs(df, None, 0.9, 4)
    assert all(r["lhs_id"] < r["rhs_id"] for r in links.collect()) and links.count() > 3
    assert "FlatMapGroupsInArrow" in links._jdf.queryExecution().executedPlan().toString()


def test_containment_with_few_words_and_with_all(spark, monkeypatch):
    """The target is read for the base's words where its ids are single, and whole where they are not or words are many."""
    base, target = records(spark, 50, 5), records(spark, 50, 6, "t")
    twice = target.unionByName(target.limit(5).withColumn("a", F.lit("w1 w2")))
    s = ExactStrategy({"a": W, "b": W}, "k", containment="bidirectional")
    run = lambda t: sorted(map(tuple, exact.containment_pairs(base, "id", t, "id", s).collect()))
    read = []
    real = exact.stash
    monkeypatch.setattr(exact, "stash", lambda df: read.append(real(df)) or read[-1])
    few, single = run(target), len(read)
    words = {r["token"] for r in read[0].select("token").collect()}
    assert few and {r["token"] for r in read[-1].select("token").collect()} <= words
    pooled = run(twice)
    assert len(read) - single == single - 1  # no table of sizes
    monkeypatch.setattr(index, "FEW_WORDS", 0)
    assert few == run(target) and pooled == run(twice)
