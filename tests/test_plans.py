"""Plans that look at less give what looking at everything gives."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from linkwright.functions import word_tokens
from linkwright.operators import verbs
from linkwright.operators.exact import column_prints
from linkwright.operators.index import build_cross_index, build_index, inspect_tokens, prepare_search_data
from linkwright.operators.resolve import resolve_entities
from linkwright.operators.score import SLACK, best_pairs, score_pairs
from linkwright.operators.verbs import candidate_pairs, detect_duplicates, duplicate_links, search_candidates
from linkwright.plans.runtime import free, stash
from linkwright.plans.strategy import ExactStrategy, ExecutionControl, SearchStrategy, block_on_tokens, smooth_rip_log, smooth_rip_offset, smooth_rip_softmax

W = [word_tokens()]


def scores(links):
    return {(r["lhs_id"], r["rhs_id"]): round(r["score"], 9) for r in links.collect() if r["score"] is not None}


def records(spark, n, seed, prefix=""):
    """Words of very different frequency, near copies, a column that is often empty, blocks and a null block."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.4:
            w = r.choice(out)[1].split()
            w[r.randrange(len(w))] = f"new{i}"
        else:
            w = [f"w{int(r.paretovariate(0.8)) % 60}" for _ in range(r.randrange(2, 9))]
        out.append((f"{prefix}{i}", " ".join(w), r.choice(["", None, "x y", "x z", f"u{i % 7}"]), r.choice(["p", "q", "q", None])))
    return spark.createDataFrame(out, "id string, a string, b string, k string")


STRATEGIES = [
    {"block_by": "k"}, {"rarity": "tfidf", "smoothing": smooth_rip_log()}, {"rarity": "bm25"}, {"smoothing": smooth_rip_offset(0.2), "feedback_strength": 0.6},
    {"on_missing": "renormalise", "block_by": "k"}, {"weights": {"a": 1.0, "b": 0.0}, "smoothing": smooth_rip_softmax(0.3)}, {"rarity_scope": "global", "block_by": "k"},
]


@pytest.mark.parametrize("options", STRATEGIES)
def test_rare_tokens_give_all_pairs_above_the_threshold(spark, options, monkeypatch):
    base, target = records(spark, 60, 1), records(spark, 60, 2, "t")
    for threshold in (0.35,):
        s = SearchStrategy({"a": W, "b": W}, threshold=threshold, on_fanout="off", **options)
        for index in (build_index(base, "id", s), build_cross_index(base, target, "id", "id", s)):
            whole = {k: v for k, v in scores(score_pairs(index, s)).items() if v >= threshold - SLACK}
            assert scores(best_pairs(score_pairs(index, s, threshold), s)) == whole and whole


@pytest.mark.parametrize("options", [{}, {"rarity": "smoothed_inverse_freq", "feedback_strength": 0.5, "on_missing": "renormalise"}, {"max_token_df": 2}])
def test_small_token_blocks_against_unbounded_ones(spark, options):
    """The windows inside bounded blocks give what the general plan gives; singles and repeated blocks change nothing."""
    base, target = records(spark, 50, 3), records(spark, 50, 4, "t")
    options = {"on_fanout": "off", **options}
    wide = block_on_tokens("a", min_nchar=2, max_df=math.inf, min_rarity=0.2)
    narrow = block_on_tokens("a", min_nchar=2, max_df=50, min_rarity=0.2)
    for run in (lambda s: duplicate_links(base, "id", s), lambda s: candidate_pairs(base, target, "id", "id", s)):
        got = [scores(run(SearchStrategy({"a": W, "b": W}, block_by=b, threshold=0.3, **options))) for b in (narrow, wide)]
        assert got[0] == got[1] and got[0]


def test_containment_against_all_pairs(spark):
    base, target = records(spark, 50, 5), records(spark, 50, 6, "t")
    sets = lambda r, c: set((r[c] or "").split())
    inside = lambda x, y: all(sets(x, c) <= sets(y, c) for c in "ab")
    for block in ((), ("k",)):
        for kind in ("forward", "bidirectional"):
            s = ExactStrategy({"a": W, "b": W}, block, containment=kind)
            got = {(r[0], r[1]) for r in candidate_pairs(base, target, "id", "id", s).select("lhs_id", "rhs_id").collect()}
            want = set()
            for x in base.collect():
                for y in target.collect():
                    shared = any(sets(x, c) & sets(y, c) for c in "ab")
                    meet = not block or x["k"] is not None and x["k"] == y["k"]
                    if meet and shared and (inside(x, y) or kind == "bidirectional" and inside(y, x)):
                        want.add((x["id"], y["id"]))
            assert got == want and want


def test_prints_pool_repeated_ids(spark):
    df = spark.createDataFrame([("1", "b a"), ("1", "c"), ("2", "c b a a"), ("3", None), (None, "x"), ("4", "")], "id string, n string")
    got = {r["id"]: r["c0"] for r in column_prints(df, "id", {"n": tuple(W)}).collect()}
    assert got["1"] == got["2"] != "" and got["3"] == got["4"] == "" and len(got) == 4


def test_prepared_tokens_replace_the_pipelines(spark):
    base, target = records(spark, 30, 7), records(spark, 30, 8, "t")
    for block in ("k", block_on_tokens("a", max_df=20)):
        s = SearchStrategy({"a": W, "b": W}, block_by=block, threshold=0.3)
        bt, tt = prepare_search_data(base, "id", s), prepare_search_data(target, "id", s)
        assert scores(duplicate_links(base, "id", s, bt)) == scores(duplicate_links(base, "id", s))
        for b, t in ((bt, None), (None, tt), (bt, tt)):
            assert scores(candidate_pairs(base, target, "id", "id", s, b, t)) == scores(candidate_pairs(base, target, "id", "id", s))
    assert detect_duplicates(base, "id", s, base_tokens=bt).count() == detect_duplicates(base, "id", s).count()
    assert search_candidates(base, target, "id", "id", s, base_tokens=bt, target_tokens=tt).count() == search_candidates(base, target, "id", "id", s).count()
    with pytest.raises(ValueError):
        duplicate_links(base, "id", s, base)
    with pytest.raises(ValueError):
        detect_duplicates(base, "id", ExactStrategy({"a": W}), base_tokens=bt)


def test_failed_chunks_are_named_and_retried(spark, monkeypatch):
    base, target = records(spark, 40, 9), records(spark, 40, 10, "t")
    s = SearchStrategy({"a": W}, block_by="k", threshold=0.3)
    whole = search_candidates(base, target, "id", "id", s)
    assert whole.failed_chunks == []
    real, calls = verbs.candidate_pairs, []

    def flaky(*a, **k):
        calls.append(1)
        if len(calls) <= failures:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(verbs, "candidate_pairs", flaky)
    failures = 1
    with pytest.warns(UserWarning, match="failed"):
        got = search_candidates(base, target, "id", "id", s, control=ExecutionControl(chunk_by="k", chunks=3, on_error="skip"))
    assert got.failed_chunks == [0]
    calls.clear()
    got = search_candidates(base, target, "id", "id", s, control=ExecutionControl(chunk_by="k", chunks=3, on_error="retry", retries=2))
    assert got.failed_chunks == [] and got.count() == whole.count()
    calls.clear()
    with pytest.raises(RuntimeError):
        search_candidates(base, target, "id", "id", s, control=ExecutionControl(chunk_by="k", chunks=3, on_error="stop"))


def test_entities_with_block_column_and_nulls(spark):
    e = spark.createDataFrame([("a", "b", 0.5, "x"), ("c", "b", None, "x"), ("d", "e", 0.7, "y")], "p string, q string, s double, k string")
    got = sorted((r["id"], r["entity"], r["rep"], r["rank"]) for r in resolve_entities(e, "p", "q", "s", block_by="k").collect())
    assert got == [("a", 1, "a", 1), ("b", 1, "a", 2), ("c", 1, "a", 3), ("d", 2, "d", 1), ("e", 2, "d", 2)]
    with pytest.raises(ValueError):
        resolve_entities(e, "p", "q", "s", block_by="z")


def test_a_giant_component_is_ranked_like_by_hand(spark):
    """A small version of the lineitem query: orders and parts in one component."""
    r = random.Random(1)
    edges = [(str(r.randrange(40)), f"p{r.randrange(15)}") for _ in range(80)] + [("z1", "pz")]
    got = {x["id"]: (x["entity"], x["rep"], x["rank"]) for x in resolve_entities(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for x in sorted(root):
        groups.setdefault(root[x], []).append(x)
    want = {x: (i, g, k) for i, g in enumerate(sorted(groups), 1) for k, x in enumerate(groups[g], 1)}
    assert got == want


def test_names_that_clash_in_inspection(spark):
    for column, raw, count in (("n", "n", "n_rows"), ("token", "token_original", "n"), ("v", "v", "n")):
        df = spark.createDataFrame([("1", "a b"), ("2", "a b")], f"id string, {column} string")
        out = inspect_tokens(df, "id", SearchStrategy({column: W}), column)
        assert out.columns == ["token", raw, count] and sorted(map(tuple, out.collect())) == [("a", "a b", 2), ("b", "a b", 2)]


def test_scratch_tables_can_be_freed(spark):
    df = stash(spark.range(5))
    path = df._linkwright_path.removeprefix("file://")
    assert os.path.isdir(path)
    free(df)
    assert not os.path.isdir(path)
    free(spark.range(3))


def test_ranges_of_any_width(spark):
    from linkwright.functions import numeric_tokens

    t = spark.createDataFrame([("1 20000",)], "x string").select(F.size(numeric_tokens()(F.col("x")))).first()[0]
    assert t == 20000
