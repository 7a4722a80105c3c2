"""Queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from linkwright.functions import (
    approximate_date, as_cologne, as_metaphone, as_soundex, custom_step, date_tokens, drop_numeric_tokens, drop_short_tokens, extract_initials,
    filter_stopwords, generate_ngrams, normalize_date, normalize_street, normalize_text, numeric_tokens, run_steps, strip_vowels, token_shapes,
    use_dictionary, word_tokens,
)
from linkwright.operators.calibrate import auxiliary_potential, calibrate, calibrate_matches, match_features, token_registry
from linkwright.operators.diagnose import audit_strategy, compare_stages, explain_match, histogram, plan_strategy, rarity_distribution, sample_matches, summarise_matches
from linkwright.operators.embed import compute_embeddings, score_embeddings
from linkwright.operators.fuzzy import fuzzy_vocabulary
from linkwright.operators.index import compute_rarity, find_stopwords, inspect_tokens, prepare_search_data
from linkwright.operators.resolve import resolve_entities
from linkwright.operators.staged import multi_stage_dedup, multi_stage_search
from linkwright.operators.verbs import candidate_pairs, deduplicate_table, detect_duplicates, duplicate_links, extract_unmatched, materialize_records, search_candidates
from linkwright.plans.batches import batch_plan
from linkwright.plans.strategy import EmbeddingStrategy, ExactStrategy, SearchStrategy, block_on_tokens, smooth_rip_log, smooth_rip_offset, smooth_rip_softmax

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text to text, text to tokens ----------------------------------------------------------------

_PART = "part p_name"


def _map(spark, sf_dir, table, key, column, step):
    c = F.col(column).cast("string")
    return read(spark, sf_dir, table).select(key, run_steps(c, [step]).alias("t") if step.gives == "tokens" else step(c).alias("v"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_name || ' ' || p_brand), '[^A-Z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS v FROM part")
def q_normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", normalize_text()(F.concat_ws(" ", "p_name", "p_brand")).alias("v"))


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(upper(c_name), '[AEIOU]', '', 'g'), ' +', ' ', 'g')) AS v FROM customer")
def q_strip_vowels(spark, sf_dir):
    return _map(spark, sf_dir, "customer", "c_custkey", "c_name", strip_vowels())


@query("SELECT s_suppkey, upper(replace(s_name, '#', ' ')) || ' STREET ' || s_nationkey AS v FROM supplier")
def q_normalize_street(spark, sf_dir):
    address = F.concat(F.col("s_name"), F.lit(" St. "), F.col("s_nationkey").cast("string"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", normalize_street("en")(address).alias("v"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders")
def q_normalize_date(spark, sf_dir):
    return _map(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", normalize_date())


@query("""
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter,
  year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN '-01-01' ELSE '-07-01' END AS half,
  strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS year, (year(o_orderdate) // 10 * 10) || '-01-01' AS decade FROM orders""")
def q_approximate_date(spark, sf_dir):
    d = F.col("o_orderdate").cast("string")
    return read(spark, sf_dir, "orders").select("o_orderkey", *[approximate_date(u)(d).alias(u) for u in ("month", "quarter", "half", "year", "decade")])


@query("""
SELECT t, count(*) AS n FROM (SELECT unnest([strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%m'), strftime(o_orderdate, '%d')]) AS t FROM orders) GROUP BY t""")
def q_date_tokens(spark, sf_dir):
    d = F.col("o_orderdate").cast("string")
    return read(spark, sf_dir, "orders").select(F.explode(date_tokens()(d)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))


@query()
def q_soundex(spark, sf_dir):
    return _map(spark, sf_dir, "part", "p_partkey", "p_name", as_soundex())


@query()
def q_metaphone(spark, sf_dir):
    return _map(spark, sf_dir, "part", "p_partkey", "p_name", as_metaphone())


@query()
def q_cologne(spark, sf_dir):
    return _map(spark, sf_dir, "part", "p_partkey", "p_name", as_cologne())


@query(r"""
SELECT t, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda x: length(x) >= 3)) AS t FROM benchmark) GROUP BY t""")
def q_word_tokens(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.explode(word_tokens(3)(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))


@query("""
SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS g FROM part) GROUP BY g""")
def q_ngrams(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.explode(generate_ngrams(3)(F.col("p_name"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query("""
SELECT page_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(upper(url), '[^0-9A-Z]+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '^[0-9]+[A-Z]?$'))))::VARCHAR[] AS t
FROM pages""")
def q_numeric_tokens(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.array_sort(numeric_tokens()(F.col("url"))).alias("t"))


@query(r"""
SELECT s, count(*) AS n FROM (SELECT unnest(list_transform(list_filter(string_split_regex(p_brand || ' ' || p_type, '\s+'), lambda x: length(x) > 0),
  lambda x: translate(regexp_replace(regexp_replace(regexp_replace(x, '[^A-Z0-9]', 'x', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', 'N', 'g'), 'x', 'X'))) AS s FROM part) GROUP BY s""")
def q_token_shapes(spark, sf_dir):
    t = run_steps(F.concat_ws(" ", "p_brand", "p_type"), [word_tokens(), token_shapes()])
    return read(spark, sf_dir, "part").select(F.explode(t).alias("s")).groupBy("s").agg(F.count("*").alias("n"))


@query(r"""
SELECT s, count(*) AS n FROM (SELECT unnest(list_transform(list_filter(string_split_regex(p_name, '\s+'), lambda x: length(x) > 0), lambda x: substr(x, 1, 1))) AS s FROM part) GROUP BY s""")
def q_initials(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.explode(run_steps(F.col("p_name"), [word_tokens(), extract_initials()])).alias("s")).groupBy("s").agg(F.count("*").alias("n"))


@query(r"""
SELECT t, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda x: length(x) >= 4 AND upper(x) NOT IN ('THE', 'THAT', 'WITH') AND NOT regexp_matches(x, '^[0-9]+$'))) AS t FROM documents) GROUP BY t""")
def q_stopword_filter(spark, sf_dir):
    steps = [word_tokens(), filter_stopwords(["the", "that", "with"]), drop_numeric_tokens(), drop_short_tokens(4)]
    return read(spark, sf_dir, "documents").select(F.explode(run_steps(F.col("text"), steps)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))


@query(r"""
SELECT g, count(*) AS n FROM (SELECT CASE unnest(string_split_regex(c_mktsegment, '\s+')) WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS g FROM customer) WHERE g IS NOT NULL GROUP BY g""")
def q_use_dictionary(spark, sf_dir):
    t = run_steps(F.col("c_mktsegment"), [word_tokens(), use_dictionary({"BUILDING": "b", "MACHINERY": "m"})])
    return read(spark, sf_dir, "customer").select(F.explode(t).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query()
def q_fuzzy_vocabulary(spark, sf_dir):
    return fuzzy_vocabulary(read(spark, sf_dir, "part"), "p_name", 2)


# --- the token engine ----------------------------------------------------------------------------

_PLAIN = custom_step(lambda c: F.regexp_replace(F.upper(F.replace(c, F.lit("ß"), F.lit("ss"))), "[^A-Z0-9]+", " "), "plain_upper")
_STEPS = [_PLAIN, word_tokens(3)]
_WORDS = r"list_filter(string_split_regex(regexp_replace(upper(replace({c}, 'ß', 'ss')), '[^A-Z0-9]+', ' ', 'g'), '\s+'), lambda x: length(x) >= 3)"
_RARITY = {
    "inverse_freq": "1.0 / {f}",
    "smoothed_inverse_freq": "1.0 / ({f} + 1.0)",
    "tfidf": "{f}::DOUBLE / {t} * ln(1.0 + {n}::DOUBLE / {d})",
    "bm25": "ln(({n} - {d} + 0.5) / ({d} + 0.5))",
}


def sql_bag(table: str, key: str, columns: list[str], block: str = "''", side: str = "base") -> str:
    """Token occurrences of a table."""
    return " UNION ALL ".join(f"SELECT '{side}' AS side, {key}::VARCHAR AS id, {block} AS block, '{c}' AS src_column, unnest({_WORDS.format(c=c)}) AS token FROM {table}" for c in columns)


def sql_index(bag: str, s: SearchStrategy, cross: bool) -> str:
    """CTEs up to ``kept``: the vocabulary with rarity, thinned as the strategy says."""
    scope = s.rarity_scope == "global"
    rarity = _RARITY[s.rarity].format(**({"f": "fg", "d": "dg", "n": "ng", "t": "tg"} if scope else {"f": "freq", "d": "df", "n": "n", "t": "t"}))
    keep = [f"rarity >= {s.min_rarity}"] if s.min_rarity else []
    keep += [f"df <= {s.max_token_df}"] if not math.isinf(s.max_token_df) else []
    where = f"WHERE {' AND '.join(keep)}" if keep else ""
    ctes = f"""
bag AS ({bag}),
sets AS (SELECT side, id, block, src_column, token, count(*) AS c FROM bag GROUP BY ALL),
recs AS (SELECT block, src_column, count(DISTINCT (side, id)) AS n FROM sets GROUP BY ALL),
voc0 AS (SELECT block, src_column, token, sum(c) AS freq, count(*) AS df FROM sets GROUP BY ALL),
tot AS (SELECT block, src_column, sum(freq) AS t FROM voc0 GROUP BY ALL),
flat AS (SELECT side, id, src_column, token, max(c) AS c FROM sets GROUP BY ALL),
globl AS (SELECT src_column, token, sum(c) AS fg, count(*) AS dg FROM flat GROUP BY ALL),
grec AS (SELECT src_column, count(DISTINCT (side, id)) AS ng FROM flat GROUP BY ALL),
gtot AS (SELECT src_column, sum(fg) AS tg FROM globl GROUP BY ALL),
voc AS (SELECT *, {rarity} AS rarity FROM voc0 JOIN recs USING (block, src_column) JOIN tot USING (block, src_column) JOIN globl USING (src_column, token) JOIN grec USING (src_column) JOIN gtot USING (src_column)),
thin AS (SELECT * FROM voc {where}),"""
    if s.on_fanout == "off":
        return ctes + "\nkept AS (SELECT * FROM thin)"
    if cross:
        mass = "SELECT count(*) FILTER (side = 'base') + count(*) FILTER (side = 'target') AS d, count(*) FILTER (side = 'base') * count(*) FILTER (side = 'target') AS m FROM sets JOIN thin USING (block, src_column, token) GROUP BY block, src_column, token"
    else:
        mass = "SELECT df AS d, df * (df - 1) AS m FROM thin"
    return ctes + f"""
hist AS (SELECT d, sum(m) AS m FROM ({mass}) GROUP BY d),
cum AS (SELECT d, sum(m) OVER (ORDER BY d) AS run FROM hist),
kept AS (SELECT * FROM thin WHERE (SELECT coalesce(max(run), 0) FROM cum) <= {s.max_fanout} OR df <= (SELECT max(d) FROM cum WHERE run <= {s.max_fanout}))"""


def sql_pairs(bag: str, s: SearchStrategy, cross: bool) -> str:
    """CTEs up to ``pairs`` (lhs_id, rhs_id, score) at or above the threshold."""
    w = s.weight_of()
    weight = "CASE src_column " + " ".join(f"WHEN '{c}' THEN {v!r}::DOUBLE" for c, v in w.items()) + " END"
    over = "OVER (PARTITION BY id, src_column, block)"
    smooth = {"identity": "rip0", "log": "ln(1 + rip0)", "offset": f"(rip0 + {s.smoothing.alpha})", "softmax": f"exp(rip0 / {s.smoothing.temperature})"}[s.smoothing.method]
    fb = f"* (1 - {s.feedback_strength} * (1 - matched / total))" if s.feedback_strength else ""
    z = "1.0"
    present = ""
    if s.on_missing == "renormalise":
        present = f""",
pres AS (SELECT DISTINCT side, id, src_column FROM rows),
z AS (SELECT lhs_id, rhs_id, sum({weight}) AS z FROM (SELECT lhs_id, rhs_id, src_column FROM best JOIN pres ON pres.id = lhs_id AND pres.side = 'base'
      UNION SELECT lhs_id, rhs_id, src_column FROM best JOIN pres ON pres.id = rhs_id AND pres.side = '{"target" if cross else "base"}') GROUP BY ALL)"""
        z = "z"
    limit = f"QUALIFY row_number() OVER (PARTITION BY lhs_id ORDER BY score DESC, rhs_id) <= {int(s.max_candidates)}" if not math.isinf(s.max_candidates) else ""
    return sql_index(bag, s, cross) + f""",
rows AS (SELECT side, id, block, src_column, token, rarity FROM sets JOIN kept USING (block, src_column, token)),
lhs0 AS (SELECT *, rarity / sum(rarity) {over} AS rip0 FROM rows WHERE side = 'base'),
lhs1 AS (SELECT *, {smooth} AS x FROM lhs0),
lhs AS (SELECT id, block, src_column, token, {"rip0" if s.smoothing.method == "identity" else f"x / sum(x) {over}"} AS rip FROM lhs1),
tots AS (SELECT id, block, sum(rip) AS total FROM lhs GROUP BY ALL),
over_ AS (SELECT l.id AS lhs_id, r.id AS rhs_id, block, sum(l.rip * {weight}) AS raw, sum(l.rip) AS matched
  FROM lhs l JOIN rows r USING (block, src_column, token) WHERE r.side = '{"target" if cross else "base"}' {"" if cross else "AND l.id <> r.id"} GROUP BY ALL),
best AS (SELECT lhs_id, rhs_id, max(raw {fb}) AS score FROM over_ JOIN tots ON tots.id = lhs_id AND tots.block = over_.block GROUP BY ALL){present},
pairs AS (SELECT lhs_id, rhs_id, score FROM (SELECT lhs_id, rhs_id, score / {z} AS score FROM best {"JOIN z USING (lhs_id, rhs_id)" if present else ""}) WHERE score >= {s.threshold} - 1e-9 {limit})"""


def _rounded(pairs):
    return pairs.select("lhs_id", "rhs_id", F.round("score", 6).alias("score"))


_PAIRS_OUT = "SELECT lhs_id, rhs_id, round(score, 6) AS score FROM pairs"
_DOCS = SearchStrategy({"text": _STEPS}, block_by="lang", on_fanout="off", threshold=0.5)
_DOC_BAG = sql_bag("documents", "doc_id", ["text"], "lang")
_BENCH = SearchStrategy({"text": _STEPS}, on_fanout="off", threshold=0.2)
_BENCH_BAG = sql_bag("benchmark", "item_id", ["text"]) + " UNION ALL " + sql_bag("documents", "doc_id", ["text"], side="target")


def _rarity_query(name: str, s: SearchStrategy):
    def run(spark, sf_dir):
        r = compute_rarity(prepare_search_data(read(spark, sf_dir, "part"), "p_partkey", s), s)
        return r.select("block", "src_column", "token", "freq", "df", F.round("rarity", 6).alias("rarity")).distinct()

    QUERIES[name] = run
    ORACLES[name] = f"WITH {sql_index(sql_bag('part', 'p_partkey', ['p_name', 'p_type'], 'p_brand'), replace(s, on_fanout='off'), False)} SELECT block, src_column, token, freq, df, round(rarity, 6) AS rarity FROM voc"


for _method in _RARITY:
    for _scope in ("block", "global"):
        _rarity_query(f"q_rarity_{_method}" + ("_global" if _scope == "global" else ""), SearchStrategy({"p_name": _STEPS, "p_type": _STEPS}, block_by="p_brand", rarity=_method, rarity_scope=_scope))


def _search_query(name: str, s: SearchStrategy):
    QUERIES[name] = lambda spark, sf_dir: _rounded(candidate_pairs(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", s))
    ORACLES[name] = f"WITH {sql_pairs(_BENCH_BAG, s, True)} {_PAIRS_OUT}"


_search_query("q_search_plain", _BENCH)
_search_query("q_search_topk", _BENCH.with_(max_candidates=2))
_search_query("q_search_feedback", _BENCH.with_(feedback_strength=0.5, threshold=0.1))
_search_query("q_search_log", _BENCH.with_(smoothing=smooth_rip_log()))
_search_query("q_search_offset", _BENCH.with_(smoothing=smooth_rip_offset(0.25)))
_search_query("q_search_softmax", _BENCH.with_(smoothing=smooth_rip_softmax(0.5)))
_search_query("q_search_bm25", _BENCH.with_(rarity="bm25"))
_search_query("q_search_min_rarity", _BENCH.with_(min_rarity=0.05))
_search_query("q_search_max_token_df", _BENCH.with_(max_token_df=50))


def _self_query(name: str, table: str, key: str, s: SearchStrategy, bag: str):
    QUERIES[name] = lambda spark, sf_dir: _rounded(duplicate_links(read(spark, sf_dir, table), key, s))
    ORACLES[name] = f"WITH {sql_pairs(bag, s, False)} {_PAIRS_OUT}"


_self_query("q_links_blocked", "documents", "doc_id", _DOCS, _DOC_BAG)
_self_query("q_links_global_rarity", "documents", "doc_id", _DOCS.with_(rarity_scope="global"), _DOC_BAG)
_self_query("q_fanout_cap", "documents", "doc_id", _DOCS.with_(on_fanout="cap", max_fanout=400_000), _DOC_BAG)
_TURN = SearchStrategy({"role": _STEPS, "text": _STEPS}, weights={"role": 0.2, "text": 0.8}, on_fanout="off", threshold=0.25, on_missing="renormalise")
_self_query("q_links_renormalise", "conversations", "conv_id", _TURN, sql_bag("conversations", "conv_id", ["role", "text"]))


@query(f"""
WITH RECURSIVE bag0 AS ({sql_bag('documents', 'doc_id', ['text'])}),
b AS (SELECT id, token FROM bag0 GROUP BY ALL), few AS (SELECT token FROM b WHERE length(token) >= 5 GROUP BY token HAVING count(*) <= 3),
keys AS (SELECT id AS kid, token AS key FROM b JOIN few USING (token)),
{sql_pairs("SELECT 'base' AS side, id, key AS block, src_column, token FROM bag0 JOIN keys ON kid = id", _DOCS.with_(block_by=(), max_token_df=math.inf, on_fanout='off', threshold=0.6), False)} {_PAIRS_OUT}""")
def q_token_block_links(spark, sf_dir):
    s = SearchStrategy({"text": _STEPS}, block_by=block_on_tokens("text", max_df=3, min_nchar=5), threshold=0.6, on_fanout="off")
    return _rounded(duplicate_links(read(spark, sf_dir, "documents"), "doc_id", s))


@query(f"""
WITH {sql_index(sql_bag('documents', 'doc_id', ['text']), SearchStrategy({'text': _STEPS}, on_fanout='off'), False)}
SELECT src_column, token, df, n AS n_records, round(df / n, 6) AS prop FROM voc WHERE df / n >= 0.3""")
def q_find_stopwords(spark, sf_dir):
    out = find_stopwords(read(spark, sf_dir, "documents"), "doc_id", SearchStrategy({"text": _STEPS}), 0.3)
    return out.withColumn("prop", F.round("prop", 6))


@query(f"SELECT token, p_name, count(*) AS n FROM (SELECT p_name, unnest({_WORDS.format(c='p_name')}) AS token FROM part) GROUP BY ALL")
def q_inspect_tokens(spark, sf_dir):
    return inspect_tokens(read(spark, sf_dir, "part"), "p_partkey", SearchStrategy({"p_name": _STEPS}), "p_name")


@query(f"""
WITH {sql_index(sql_bag('documents', 'doc_id', ['text'], 'lang'), SearchStrategy({'text': _STEPS}, on_fanout='off'), False)}
SELECT block, src_column, count(*) AS n_tokens, max(df) AS df_max, min(rarity) AS rarity_min, quantile_cont(rarity, 0.5) AS rarity_p50, max(rarity) AS rarity_max,
  arg_min(token, (-df, token)) AS top_token, arg_min(rarity, (-df, token)) AS suggested_min_rarity FROM voc GROUP BY ALL""")
def q_rarity_distribution(spark, sf_dir):
    return rarity_distribution(read(spark, sf_dir, "documents"), "doc_id", SearchStrategy({"text": _STEPS}, block_by="lang")).tables["distribution"]


# --- components, duplicates, candidates ------------------------------------------------------------


def sql_groups(pairs: str) -> str:
    """CTEs from ``pairs`` to ``groups`` (duplicate_group, id, score, rank)."""
    return pairs + """,
und AS (SELECT lhs_id AS a, rhs_id AS b, score FROM pairs UNION ALL SELECT rhs_id, lhs_id, score FROM pairs),
reach AS (SELECT DISTINCT a AS id, a AS root FROM und UNION SELECT und.b, reach.root FROM reach JOIN und ON und.a = reach.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
best_ AS (SELECT a AS id, max(score) AS score FROM und GROUP BY a),
groups AS (SELECT dense_rank() OVER (ORDER BY root) AS duplicate_group, id, round(score, 6) AS score, row_number() OVER (PARTITION BY root ORDER BY round(score, 9) DESC, id) AS rank FROM roots JOIN best_ USING (id))"""


def _groups(df):
    return df.select("duplicate_group", "id", F.round("score", 6).alias("score"), "rank")


_EQUAL = ExactStrategy({"text": _STEPS}, "lang")
_PRINT = f"SELECT {{key}}::VARCHAR AS id, lang, list_sort(list_distinct({_WORDS.format(c='text')})) AS fp FROM documents"
_EXACT_PAIRS = f"""
prints AS ({_PRINT.format(key='doc_id')}),
least AS (SELECT lang, fp, min(id) AS rep FROM prints WHERE len(fp) > 0 GROUP BY ALL HAVING count(*) > 1),
pairs AS (SELECT rep AS lhs_id, id AS rhs_id, 1.0 AS score FROM prints JOIN least USING (lang, fp) WHERE id <> rep)"""


@query(f"WITH RECURSIVE {sql_groups(sql_pairs(_DOC_BAG, _DOCS.with_(rarity='inverse_freq'), False))} SELECT * FROM groups")
def q_dedup_documents(spark, sf_dir):
    return _groups(detect_duplicates(read(spark, sf_dir, "documents"), "doc_id", _DOCS))


@query(f"WITH RECURSIVE {sql_groups(_EXACT_PAIRS)} SELECT * FROM groups")
def q_exact_dedup(spark, sf_dir):
    return _groups(detect_duplicates(read(spark, sf_dir, "documents"), "doc_id", _EQUAL))


@query(f"WITH RECURSIVE {sql_groups(_EXACT_PAIRS)} SELECT doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT id FROM groups WHERE rank <> 1)")
def q_deduplicate_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return deduplicate_table(docs, detect_duplicates(docs, "doc_id", _EQUAL), "doc_id").select("doc_id")


@query(f"WITH RECURSIVE {sql_groups(_EXACT_PAIRS)} SELECT doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT id FROM groups)")
def q_extract_unmatched(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return extract_unmatched(docs, "doc_id", detect_duplicates(docs, "doc_id", _EQUAL)).select("doc_id")


@query(f"WITH RECURSIVE {sql_groups(_EXACT_PAIRS)} SELECT doc_id, lang FROM documents WHERE doc_id::VARCHAR IN (SELECT id FROM groups)")
def q_materialize_records(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return materialize_records(docs, "doc_id", detect_duplicates(docs, "doc_id", _EQUAL)).select("doc_id", "lang")


@query("""
WITH RECURSIVE e AS (SELECT ('o' || o_orderkey) AS a, ('c' || o_custkey) AS b FROM orders), und AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS id, a AS root FROM und UNION SELECT und.b, reach.root FROM reach JOIN und ON und.a = reach.id)
SELECT id, dense_rank() OVER (ORDER BY root) AS entity, root AS rep FROM (SELECT id, min(root) AS root FROM reach GROUP BY id)""")
def q_resolve_entities(spark, sf_dir):
    e = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))
    return resolve_entities(e, "a", "b").select("id", "entity", "rep")


@query()
def q_resolve_lineitem(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return resolve_entities(e, "a", "b").select("id", "entity", "rep")


@query(f"""
WITH {sql_pairs(_BENCH_BAG, _BENCH, True)}, m AS (SELECT row_number() OVER (ORDER BY lhs_id, rhs_id) AS match_id, * FROM pairs)
SELECT match_id, 'base' AS source, lhs_id AS id, 1 AS rank, round(score, 6) AS score FROM m UNION ALL SELECT match_id, 'target', rhs_id, 2, round(score, 6) FROM m""")
def q_search_candidates(spark, sf_dir):
    out = search_candidates(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", _BENCH)
    return out.select("match_id", "source", "id", "rank", F.round("score", 6).alias("score"))


_CONTAIN = "len(list_intersect(a.fp, b.fp)) = len({side}.fp)"


def _containment_sql(condition: str) -> str:
    one = "SELECT {k}::VARCHAR AS id, list_distinct(" + _WORDS.format(c="{c}") + ") AS fp FROM {t}"
    a, b = one.format(k="item_id", c="text", t="benchmark"), one.format(k="doc_id", c="text", t="documents")
    return f"WITH a AS MATERIALIZED ({a}), b AS MATERIALIZED ({b}) SELECT a.id AS lhs_id, b.id AS rhs_id FROM a, b WHERE len(list_intersect(a.fp, b.fp)) > 0 AND ({condition})"


@query(_containment_sql(_CONTAIN.format(side="a")))
def q_containment_forward(spark, sf_dir):
    s = ExactStrategy({"text": _STEPS}, containment="forward")
    return candidate_pairs(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", s).select("lhs_id", "rhs_id")


@query(_containment_sql(f"{_CONTAIN.format(side='a')} OR {_CONTAIN.format(side='b')}"))
def q_containment_bidirectional(spark, sf_dir):
    s = ExactStrategy({"text": _STEPS}, containment="bidirectional")
    return candidate_pairs(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", s).select("lhs_id", "rhs_id")


def sql_staged_dedup() -> str:
    """Stage one on the whole table, stage two on its representatives and the rest, then one resolution over both ledgers."""
    ledger = "SELECT r.id AS lhs_id, g.id AS rhs_id, g.score::DOUBLE AS score, '{s}' AS stage FROM {g} g JOIN {g} r USING (duplicate_group) WHERE r.rank = 1 AND g.rank > 1"
    near = sql_pairs(sql_bag("left_over", "doc_id", ["text"], "lang"), _DOCS, False)
    return f"""
WITH RECURSIVE one AS (WITH RECURSIVE {sql_groups(_EXACT_PAIRS)} SELECT * FROM groups),
left_over AS (SELECT * FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT id FROM one WHERE rank > 1)),
two AS (WITH RECURSIVE {sql_groups(near)} SELECT * FROM groups),
ledger AS ({ledger.format(s="exact", g="one")} UNION ALL {ledger.format(s="near", g="two")}),
{sql_groups("pairs AS (SELECT lhs_id, rhs_id, score FROM ledger)")},
touched AS (SELECT id, min(stage) AS stage FROM (SELECT lhs_id AS id, stage FROM ledger UNION ALL SELECT rhs_id, stage FROM ledger) GROUP BY id)
SELECT g.duplicate_group, g.id, g.score::DOUBLE AS score, g.rank, stage FROM groups g JOIN touched USING (id)"""


@query(sql_staged_dedup())
def q_staged_dedup(spark, sf_dir):
    out = multi_stage_dedup(read(spark, sf_dir, "documents"), "doc_id", {"exact": _EQUAL, "near": _DOCS}).entities
    return _groups(out).join(out.select("id", "stage"), "id")


@query()
def q_staged_search(spark, sf_dir):
    stages = {"exact": ExactStrategy({"text": _STEPS}), "near": _BENCH.with_(threshold=0.3)}
    b = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    t = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return multi_stage_search(b, t, "id", "id", stages, collapse="rep").entities.withColumn("score", F.round("score", 6))


# --- embeddings ------------------------------------------------------------------------------------

_VECTORS = EmbeddingStrategy("embedding", threshold=0.35, block_by="label")


@query("""
SELECT a.vec_id::VARCHAR AS lhs_id, b.vec_id::VARCHAR AS rhs_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 AS score
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id::VARCHAR < b.vec_id::VARCHAR WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35""")
def q_embedding_links(spark, sf_dir):
    return duplicate_links(read(spark, sf_dir, "embeddings"), "vec_id", _VECTORS).withColumn("score", F.round("score", 4))


@query("""
SELECT a.vec_id::VARCHAR AS lhs_id, b.vec_id::VARCHAR AS rhs_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 AS score
FROM embeddings a, embeddings b""")
def q_score_embeddings(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    s = EmbeddingStrategy("embedding")
    raw = compute_embeddings(e, "vec_id", replace(s, normalize=False))  # the scores divide by the norms, in doubles
    return score_embeddings(raw, raw, s).withColumn("score", F.round("score", 4) + F.lit(0.0))


# --- diagnostics -------------------------------------------------------------------------------------


@query(f"""
WITH f AS (SELECT lang, source, list_sort(list_distinct({_WORDS.format(c='text')})) AS fp FROM documents), t AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM f GROUP BY fp))
SELECT block_key, n_blocks, max_block, mean_block, brute_pairs, s / (SELECT p FROM t) AS exact_twin_survival FROM (
  SELECT 'lang' AS block_key, count(*) AS n_blocks, max(n) AS max_block, avg(n) AS mean_block, sum(n * (n - 1) / 2) AS brute_pairs FROM (SELECT count(*) AS n FROM f GROUP BY lang)
  UNION ALL SELECT 'source', count(*), max(n), avg(n), sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM f GROUP BY source))
JOIN (SELECT 'lang' AS block_key, sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM f GROUP BY fp, lang)
  UNION ALL SELECT 'source', sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM f GROUP BY fp, source)) USING (block_key)""")
def q_plan_frontier(spark, sf_dir):
    return plan_strategy(read(spark, sf_dir, "documents"), SearchStrategy({"text": _STEPS}), {"lang": "lang", "source": "source"}, "doc_id").tables["frontier"]


@query(f"""
WITH {sql_index(sql_bag('part', 'p_partkey', ['p_name', 'p_type']), SearchStrategy({'p_name': _STEPS, 'p_type': _STEPS}, on_fanout='off'), False)},
u AS (SELECT src_column, count(DISTINCT token) AS n_unique_tokens FROM voc GROUP BY ALL), b AS (SELECT src_column, count(*) AS n_tokens FROM bag GROUP BY ALL), n AS (SELECT count(*) AS n FROM part)
SELECT src_column AS "column", n_tokens, n_unique_tokens, round(n_unique_tokens / n_tokens, 9) AS pct_unique, 0.0::DOUBLE AS na_rate, round(n_tokens / n, 9) AS avg_tokens_per_record FROM b JOIN u USING (src_column), n""")
def q_audit_token_stats(spark, sf_dir):
    out = audit_strategy(read(spark, sf_dir, "part"), "p_partkey", SearchStrategy({"p_name": _STEPS, "p_type": _STEPS})).tables["token_stats"]
    return out.withColumn("pct_unique", F.round("pct_unique", 9)).withColumn("avg_tokens_per_record", F.round("avg_tokens_per_record", 9))


@query("""
WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), b AS (SELECT least(floor((c_acctbal - lo) / (hi - lo) * 20), 19)::INT AS bin, lo, hi FROM customer, r)
SELECT round(lo + bin * ((hi - lo) / 20), 6) AS bin_lower, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_upper, count(*) AS count FROM b GROUP BY bin, lo, hi""")
def q_histogram(spark, sf_dir):
    return histogram(read(spark, sf_dir, "customer"), "c_acctbal", 20).withColumn("bin_lower", F.round("bin_lower", 6)).withColumn("bin_upper", F.round("bin_upper", 6))


def _matches(spark, sf_dir):
    return search_candidates(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "item_id", "doc_id", _BENCH)


@query(f"""
WITH {sql_pairs(_BENCH_BAG, _BENCH, True)} SELECT n AS candidates_per_record, count(*) AS n_records FROM (SELECT lhs_id, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY n""")
def q_summarise_ambiguity(spark, sf_dir):
    return summarise_matches(_matches(spark, sf_dir)).tables["ambiguity_dist"]


@query(f"""
WITH {sql_pairs(_BENCH_BAG, _BENCH, True)}, x AS (SELECT score FROM pairs UNION ALL SELECT score FROM pairs), r AS (SELECT min(score) AS lo, max(score) AS hi FROM x),
b AS (SELECT least(floor((score - lo) / (hi - lo) * 50), 49)::INT AS bin, lo, hi FROM x, r)
SELECT round(lo + bin * ((hi - lo) / 50), 6) AS bin_lower, round(lo + (bin + 1) * ((hi - lo) / 50), 6) AS bin_upper, count(*) AS count FROM b GROUP BY bin, lo, hi""")
def q_summarise_scores(spark, sf_dir):
    out = summarise_matches(_matches(spark, sf_dir)).tables["score_dist"]
    return out.withColumn("bin_lower", F.round("bin_lower", 6)).withColumn("bin_upper", F.round("bin_upper", 6))


@query(f"""
WITH {sql_pairs(_BENCH_BAG, _BENCH, True)}, m AS (SELECT row_number() OVER (ORDER BY lhs_id, rhs_id) AS match_id, * FROM pairs),
o AS (SELECT lhs_id, score, row_number() OVER (PARTITION BY lhs_id ORDER BY score DESC) AS r FROM pairs),
g AS (SELECT lhs_id, round(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 9) AS gap FROM o GROUP BY lhs_id HAVING count(*) > 1 ORDER BY gap, lhs_id LIMIT 5)
SELECT match_id, 'base' AS source, lhs_id AS id, round(score, 6) AS score FROM m SEMI JOIN g USING (lhs_id) UNION ALL SELECT match_id, 'target', rhs_id, round(score, 6) FROM m SEMI JOIN g USING (lhs_id)""")
def q_sample_matches(spark, sf_dir):
    return sample_matches(_matches(spark, sf_dir), "top_gap", 5).select("match_id", "source", "id", F.round("score", 6).alias("score"))


def sql_stage_coverage() -> str:
    """An exact stage, then the token search of what it left on either side."""
    one = f"SELECT {{key}}::VARCHAR AS id, list_sort(list_distinct({_WORDS.format(c='text')})) AS fp FROM {{table}}"
    bag = sql_bag("base_left", "item_id", ["text"]) + " UNION ALL " + sql_bag("target_left", "doc_id", ["text"], side="target")
    return f"""
WITH exact AS (SELECT a.id AS lhs_id, b.id AS rhs_id FROM ({one.format(key="item_id", table="benchmark")}) a JOIN ({one.format(key="doc_id", table="documents")}) b USING (fp) WHERE len(fp) > 0 AND a.id <> b.id),
base_left AS (SELECT * FROM benchmark WHERE item_id::VARCHAR NOT IN (SELECT lhs_id FROM exact)), target_left AS (SELECT * FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT rhs_id FROM exact)),
near AS (WITH {sql_pairs(bag, _BENCH.with_(threshold=0.3), True)} SELECT lhs_id, rhs_id FROM pairs WHERE lhs_id <> rhs_id),
seen AS (SELECT 0 AS stage_index, * FROM exact UNION ALL SELECT 1, * FROM near), names AS (SELECT * FROM (VALUES (0, 'exact'), (1, 'near')) t(stage_index, stage)),
b AS (SELECT k AS stage_index, count(*) AS n FROM (SELECT min(stage_index) AS k FROM seen GROUP BY lhs_id) GROUP BY k), t AS (SELECT k AS stage_index, count(*) AS n FROM (SELECT min(stage_index) AS k FROM seen GROUP BY rhs_id) GROUP BY k),
a AS (SELECT stage_index, stage, coalesce(b.n, 0) AS base_added, coalesce(t.n, 0) AS target_added FROM names LEFT JOIN b USING (stage_index) LEFT JOIN t USING (stage_index))
SELECT stage, base_added, target_added, sum(base_added) OVER w::BIGINT AS base_cumulative, sum(target_added) OVER w::BIGINT AS target_cumulative FROM a WINDOW w AS (ORDER BY stage_index)"""


@query(sql_stage_coverage())
def q_compare_stages(spark, sf_dir):
    stages = {"exact": ExactStrategy({"text": _STEPS}), "near": _BENCH.with_(threshold=0.3)}
    ledger = multi_stage_search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", stages).ledger
    return compare_stages(ledger, list(stages)).tables["coverage"].select("stage", "base_added", "target_added", "base_cumulative", "target_cumulative")


@query(f"""
WITH {sql_pairs(_DOC_BAG, _DOCS, False)}
SELECT l.src_column, l.token, round(l.rip, 6) AS contribution FROM lhs l JOIN rows r USING (block, src_column, token) WHERE l.id = '12' AND r.id = '11'""")
def q_explain_match(spark, sf_dir):
    out = explain_match(read(spark, sf_dir, "documents"), "doc_id", _DOCS, "12", "11")
    return out.select("src_column", "token", F.round("contribution", 6).alias("contribution"))


@query("""
WITH n AS (SELECT ceil(row_number() OVER (ORDER BY o_orderkey) / 4000)::BIGINT AS batch_id FROM orders) SELECT batch_id, count(*) AS n_rows, false AS oversized FROM n GROUP BY batch_id""")
def q_batch_plan(spark, sf_dir):
    return batch_plan(read(spark, sf_dir, "orders"), "o_orderkey", 4000).batches


# --- calibration -------------------------------------------------------------------------------------

_REG = "SELECT token, count(DISTINCT id) AS occ FROM ({bag}) GROUP BY ALL"


@query(f"""
WITH r AS ({_REG.format(bag=sql_bag('benchmark', 'item_id', ['text']))}), a AS ({_REG.format(bag=sql_bag('documents', 'doc_id', ['text']))}), rm AS (SELECT max(occ) AS m FROM r), am AS (SELECT max(occ) AS m FROM a)
SELECT 'text' AS src_column, token, round(1 - least(ln(r.occ) / ln(rm.m), ln(a.occ) / ln(am.m)), 6) AS aip FROM r FULL JOIN a USING (token), rm, am""")
def q_aip(spark, sf_dir):
    s = SearchStrategy({"text": _STEPS})
    out = auxiliary_potential(token_registry(read(spark, sf_dir, "benchmark"), "item_id", s), token_registry(read(spark, sf_dir, "documents"), "doc_id", s))
    return out.withColumn("aip", F.round("aip", 6))


@query(f"""
WITH {sql_pairs(_BENCH_BAG, _BENCH, True)}, s AS (SELECT id, count(DISTINCT token) AS scnt FROM bag WHERE side = 'base' GROUP BY id)
SELECT lhs_id AS searched, rhs_id AS found, count(*) OVER w AS cnt, count(*) OVER w AS icnt, scnt FROM pairs JOIN s ON s.id = lhs_id WINDOW w AS (PARTITION BY lhs_id)""")
def q_feature_counts(spark, sf_dir):
    f = match_features(_matches(spark, sf_dir), _BENCH, read(spark, sf_dir, "benchmark"), "item_id", read(spark, sf_dir, "documents"), "doc_id", string_sim=False)
    return f.select("searched", "found", "cnt", "icnt", "scnt")


@query()
def q_match_features(spark, sf_dir):
    return match_features(_matches(spark, sf_dir), _BENCH, read(spark, sf_dir, "benchmark"), "item_id", read(spark, sf_dir, "documents"), "doc_id")


@query()
def q_calibrated_matches(spark, sf_dir):
    m = _matches(spark, sf_dir)
    labels = m.withColumn("equal", (F.pmod(F.col("match_id"), F.lit(3)) > 0).cast("int"))
    return calibrate_matches(m, labels, _BENCH, read(spark, sf_dir, "benchmark"), "item_id", read(spark, sf_dir, "documents"), "doc_id").matches.select("match_id", "id", "predicted_tp")


@query("""
WITH s AS (SELECT l_discount * 10 AS p, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS y FROM lineitem)
SELECT least(floor(p * 10), 9)::INT + 1 AS bin, count(*) AS n, round(avg(p), 9) AS mean_pred, round(avg(y), 9) AS obs_pos, least(floor(p * 10), 9)::INT / 10 AS bin_lower, (least(floor(p * 10), 9)::INT + 1) / 10 AS bin_upper
FROM s GROUP BY least(floor(p * 10), 9)::INT""")
def q_reliability(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("tp_prob"), (F.col("l_tax") > 0.04).cast("int").alias("equal"))
    out = calibrate(s).tables["reliability"]
    return out.withColumn("mean_pred", F.round("mean_pred", 9)).withColumn("obs_pos", F.round("obs_pos", 9))
