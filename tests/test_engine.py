"""Operators on the small fixtures."""

import pytest
from pyspark.sql import functions as F

from linkwright.functions import normalize_text, word_tokens
from linkwright.operators.graph import connected_components
from linkwright.operators.index import FanoutError, choose_cut, compute_rarity, find_stopwords, inspect_tokens, prepare_search_data
from linkwright.operators.numbering import number_rows
from linkwright.operators.resolve import resolve_entities
from linkwright.operators.staged import multi_stage_dedup, multi_stage_search
from linkwright.operators.verbs import candidate_pairs, deduplicate_table, detect_duplicates, duplicate_links, extract_unmatched, materialize_records, search_candidates
from linkwright.plans.strategy import EmbeddingStrategy, ExactStrategy, ExecutionControl, SearchStrategy, block_on_tokens, smooth_rip_log, smooth_rip_offset, smooth_rip_softmax

W = [word_tokens()]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def scores(links):
    return {(r["lhs_id"], r["rhs_id"]): round(r["score"], 6) for r in links.collect()}


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("r1", "alice", "smith"), ("r2", "alice", "smyth"), ("r3", "bob", "jones"), ("r4", "carol", "baker")], "rid string, first string, last string")


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (7, 7), (None, 2)], "a long, b long")
    assert rows(connected_components(e), "node", "component") == [(1, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 8), (9, 8)]
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(chain).where("component <> 0").count() == 0
    assert connected_components(e.limit(0)).count() == 0


def test_number_rows(spark):
    df = spark.createDataFrame([(x,) for x in "dacbe"], "k string")
    assert rows(number_rows(df, ["k"], "n"), "k", "n") == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]


def test_resolve(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("d", "e", 0.7)], "x string, y string, s double")
    v = spark.createDataFrame([(i,) for i in "abcdef"], "id string")
    got = rows(resolve_entities(e, "x", "y", "s", v), "id", "entity", "rep", "rank")
    assert got == [("a", 1, "a", 1), ("b", 1, "a", 2), ("c", 1, "a", 3), ("d", 2, "d", 1), ("e", 2, "d", 2), ("f", 3, "f", 1)]
    by = v.withColumn("by", F.when(F.col("id") == "c", 0).otherwise(1))
    assert rows(resolve_entities(e, "x", "y", None, by, "by").where("rank = 1"), "rep") == [("c",), ("d",), ("f",)]
    with pytest.raises(ValueError):
        resolve_entities(e, "x", "y", None, v, "nothing")


def test_duplicates(names):
    s = SearchStrategy({"first": W, "last": W}, threshold=0.3)
    got = detect_duplicates(names, "rid", s)
    assert rows(got, "duplicate_group", "id", "score", "rank") == [(1, "r1", 0.5, 1), (1, "r2", 0.5, 2)]
    assert got.columns == ["duplicate_group", "id", "score", "rank", "first", "last"]
    assert rows(deduplicate_table(names, got, "rid"), "rid") == [("r1",), ("r3",), ("r4",)]
    assert rows(extract_unmatched(names, "rid", got), "rid") == [("r3",), ("r4",)]
    assert rows(materialize_records(names, "rid", ["r1", "zz"]), "rid") == [("r1",)]
    assert detect_duplicates(names.limit(0), "rid", s).count() == 0


def test_candidates(spark):
    b = spark.createDataFrame([("b1", "alice", "smith"), ("b2", "bob", "jones"), ("b3", "x", "y")], "bid string, first string, last string")
    t = spark.createDataFrame([("t1", "alice", "smith", 1), ("t2", "bob", "johnson", 2), ("t3", "p", "q", 3)], "tid string, first string, last string, extra int")
    s = SearchStrategy({"first": W, "last": W}, threshold=0.3)
    got = search_candidates(b, t, "bid", "tid", s)
    assert rows(got, "match_id", "source", "id", "rank", "score") == [(1, "base", "b1", 1, 1.0), (1, "target", "t1", 2, 1.0), (2, "base", "b2", 1, 0.5), (2, "target", "t2", 2, 0.5)]
    assert "extra" in got.columns
    assert search_candidates(b, t, "bid", "tid", s, threshold=0.9).count() == 2
    blocked = s.with_(block_by=("first",))
    chunked = search_candidates(b, t, "bid", "tid", blocked, control=ExecutionControl(chunk_by="first", chunks=3))
    assert rows(chunked, "id", "score") == rows(search_candidates(b, t, "bid", "tid", blocked), "id", "score")


def test_direction_feedback_and_smoothing(spark):
    df = spark.createDataFrame([("R1", "Smith Jones Brown"), ("R2", "Smith Jones Brown"), ("R3", "Smith Anderson Lee")], "id string, n string")
    s = SearchStrategy({"n": W}, threshold=0.0)
    plain = scores(duplicate_links(df, "id", s))
    assert plain[("R1", "R2")] == 1.0 and plain[("R1", "R3")] == 0.25 and plain[("R3", "R1")] == round(1 / 7, 6)
    assert scores(duplicate_links(df, "id", s.with_(feedback_strength=0.5)))[("R1", "R3")] == 0.15625
    for sm in (smooth_rip_log(), smooth_rip_offset(), smooth_rip_softmax()):
        smooth = scores(duplicate_links(df, "id", s.with_(smoothing=sm)))
        assert smooth[("R1", "R2")] == 1.0 and 0.25 < smooth[("R1", "R3")] < 0.34
    assert len(scores(duplicate_links(df, "id", s.with_(max_candidates=1)))) == 3


def test_tokens_are_sets(spark):
    df = spark.createDataFrame([("1", "fritzel"), ("2", "fritzel fritzel fritzel"), ("3", "fritzel")], "id string, n string")
    assert set(scores(duplicate_links(df, "id", SearchStrategy({"n": [word_tokens(3)]}, threshold=0.1))).values()) == {1.0}


def test_rarity_scope(spark):
    df = spark.createDataFrame([("a1", "A", "shared common"), ("a2", "A", "common"), ("b1", "B", "shared")], "id string, k string, n string")
    s = SearchStrategy({"n": W}, block_by="k", threshold=0.0)
    assert scores(duplicate_links(df, "id", s))[("a1", "a2")] == round(1 / 3, 6)
    g = s.with_(rarity_scope="global")
    assert scores(duplicate_links(df, "id", g))[("a1", "a2")] == 0.5
    r = compute_rarity(prepare_search_data(df, "id", g), g)
    assert {(x["df"], x["df_global"]) for x in r.where("token = 'shared'").collect()} == {(1, 2)}
    for method in ("smoothed_inverse_freq", "tfidf", "bm25"):
        assert compute_rarity(prepare_search_data(df, "id", s), s.with_(rarity=method)).where("rarity is null").count() == 0


def test_missing_columns(spark):
    df = spark.createDataFrame([("1", "a b", ""), ("2", "a b", None), ("3", "a b", "s t"), ("4", "a b", "s t")], "id string, name string, street string")
    s = SearchStrategy({"name": W, "street": W}, weights={"name": 0.6, "street": 0.4}, threshold=0.9)
    assert rows(detect_duplicates(df, "id", s), "id") == [("3",), ("4",)]
    both = detect_duplicates(df, "id", s.with_(on_missing="renormalise", threshold=0.55))
    assert rows(both, "id") == [("1",), ("2",), ("3",), ("4",)]
    assert scores(duplicate_links(df, "id", s.with_(on_missing="renormalise")))[("1", "2")] == 1.0


def test_fanout_guard(spark):
    hist = [(1, 0), (2, 4), (30, 870)]
    assert choose_cut(hist, 100)[0] == 2 and choose_cut(hist, 1e9)[2] is False and choose_cut([(30, 870)], 100)[2]
    data = [(f"r{i:02d}", "common anna meyer" if i < 3 else f"common x{i}") for i in range(1, 31)]
    df = spark.createDataFrame(data, "id string, n string")
    s = SearchStrategy({"n": W}, threshold=0.1, max_fanout=100)
    with pytest.warns(UserWarning):
        capped = scores(duplicate_links(df, "id", s))
    assert set(capped) == {("r01", "r02"), ("r02", "r01")}
    assert capped == scores(duplicate_links(df, "id", s.with_(on_fanout="off", max_token_df=2)))
    with pytest.raises(FanoutError):
        duplicate_links(df, "id", s.with_(on_fanout="abort"))


def test_token_blocks(spark):
    df = spark.createDataFrame([("1", "nivelsteiner gmbh"), ("2", "nivelsteiner sand gmbh"), ("3", "aldi gmbh"), ("4", "aldi sued gmbh"), ("5", "other gmbh")], "id string, n string")
    s = SearchStrategy({"n": W}, block_by=block_on_tokens("n", max_df=2), threshold=0.3)
    assert rows(detect_duplicates(df, "id", s), "duplicate_group", "id") == [(1, "1"), (1, "2"), (2, "3"), (2, "4")]


def test_exact(spark):
    df = spark.createDataFrame([("1", "Anna Meier", ""), ("2", "meier anna", None), ("3", "Bob", "x"), ("4", None, None), ("5", "", "")], "id string, n string, s string")
    s = ExactStrategy({"n": [normalize_text(), word_tokens()], "s": W})
    assert rows(detect_duplicates(df, "id", s), "id", "score") == [("1", 1.0), ("2", 1.0)]
    b = spark.createDataFrame([("b1", "Anna Meier", "Hauptstr")], "id string, n string, s string")
    t = spark.createDataFrame([("t1", "Anna Meier Gmbh", "Hauptstr 12")], "id string, n string, s string")
    links = lambda **k: rows(candidate_pairs(b, t, "id", "id", ExactStrategy({"n": W, "s": W}, **k)), "lhs_id", "rhs_id")
    assert links() == [] and links(containment="forward") == [("b1", "t1")]
    assert links(containment="forward", min_containment_tokens={"s": 2}) == []
    back = ExactStrategy({"n": W, "s": W}, containment="bidirectional")
    assert rows(candidate_pairs(t, b, "id", "id", back), "lhs_id") == [("t1",)]
    assert links(containment="forward", min_base_rarity=100.0) == []


def test_staged_dedup(spark):
    df = spark.createDataFrame([("A", "anna meier", "1"), ("B", "anna meier", "1"), ("C", "anna maier", "2")], "id string, n string, plz string")
    tight = ExactStrategy({"n": W, "plz": W})
    loose = SearchStrategy({"n": W}, threshold=0.3)
    got = multi_stage_dedup(df, "id", {"tight": tight, "loose": loose})
    assert rows(got.entities, "duplicate_group", "id", "stage") == [(1, "A", "tight"), (1, "B", "tight"), (1, "C", "loose")]
    assert rows(multi_stage_dedup(df, "id", [tight]).entities, "id") == [("A",), ("B",)]
    none = multi_stage_dedup(df, "id", [tight], edge_filter=lambda e, stage: e.where("score > 2"))
    assert none.entities.count() == 0


def test_staged_search(spark):
    b = spark.createDataFrame([("a1", "x y", 1), ("a2", "x z", 1)], "id string, n string, year int")
    t = spark.createDataFrame([("c1", "x y", 2), ("c2", "q", 2)], "id string, n string, year int")
    s = {"exact": ExactStrategy({"n": W}), "loose": SearchStrategy({"n": W}, threshold=0.2)}
    got = multi_stage_search(b, t, "id", "id", s, source_by="year", collapse="rep", rebind="accumulate")
    assert rows(got.entities, "entity", "id", "n_in_entity", "covered_sources", "stage") == [(1, "a1", 2, 2, "exact"), (1, "c1", 2, 2, "exact"), (2, "a2", 1, 1, None), (3, "c2", 1, 1, None)]
    assert rows(got.ledger, "from", "to", "within_source", "direction") == [("a1", "c1", False, "forward")]
    both = multi_stage_search(b, t, "id", "id", s, direction="bidirectional")
    assert both.ledger.where("direction = 'backward'").count() >= 1
    pool = multi_stage_search(b.unionByName(t), None, "id", None, s, self_search=True, collapse="rep")
    assert rows(pool.entities.where("n_in_entity > 1"), "id") == [("a1",), ("a2",), ("c1",)]
    with pytest.raises(ValueError):
        multi_stage_search(b, t, "id", "id", s, collapse="union")


def test_embeddings(spark, tmp_path):
    one_hot = lambda texts: [[1.0 if i == ord(t[0]) - 97 else 0.0 for i in range(8)] for t in texts]
    df = spark.createDataFrame([("1", "a"), ("2", "aa"), ("3", "b"), ("4", None)], "id string, n string")
    s = EmbeddingStrategy(one_hot, columns=("n",), threshold=0.5, block_rows=2)
    assert rows(detect_duplicates(df, "id", s), "id") == [("1",), ("2",)]
    assert scores(candidate_pairs(df, df, "id", "id", s))[("1", "2")] == 1.0
    from linkwright.operators.embed import EmbeddingCache, compute_embeddings

    cache = EmbeddingCache(str(tmp_path / "cache"), "one-hot")
    for _ in range(2):
        assert compute_embeddings(df, "id", s, cache).where("embedding is null").count() == 1
    assert cache.read(spark).count() == 3
    cache.clear(spark)
    assert cache.read(spark) is None


def test_stopwords_and_inspection(spark):
    df = spark.createDataFrame([("1", "the a"), ("2", "the b"), ("3", "c c")], "id string, n string")
    s = SearchStrategy({"n": W})
    assert rows(find_stopwords(df, "id", s, 0.5), "token", "df", "n_records") == [("the", 2, 3)]
    assert len(rows(find_stopwords(df, "id", s, 0.9, top_n=2), "token")) == 2
    assert rows(inspect_tokens(df, "id", s, "n").where("token = 'c'"), "n", "token") == [("c c", "c")]


def test_strategies_validate():
    for bad in ({"threshold": -1}, {"rarity": "x"}, {"weights": {"z": 1}}, {"on_fanout": "x"}, {"feedback_strength": 2}, {"block_by": (3,)}):
        with pytest.raises((ValueError, TypeError)):
            SearchStrategy({"n": W}, **bad)
    with pytest.raises(ValueError):
        SearchStrategy({})
    with pytest.warns(UserWarning):
        block_on_tokens("n")
    assert "threshold" in SearchStrategy({"n": W}).describe()
