"""DuckDB SQL that gives the same rows as the queries, where SQL can say it."""

from __future__ import annotations

from linkwright.llm.licenses import PHRASES, TEMPLATES, _template_sets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _licenses(threshold: float = 0.9) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = " UNION ALL ".join(
        f"SELECT rid, unnest(list_filter(range(1, len(ws) - {len(p.split()) - 2}), lambda i: ws[i:i + {len(p.split()) - 1}] = {_list(p.split())})) - 1 AS pos, '{label}' AS label FROM w" for p, label in PHRASES.items()
    )
    templates = " UNION ALL ".join(f"SELECT '{label}' AS label, {_list(ws)} AS t" for label, ws in _template_sets(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, regexp_extract_all(low, '{word}') AS ws FROM d),
places AS ({places}),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY rid),
lines AS (SELECT rid, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), '{word}')) AS own FROM d),
templates AS ({templates}),
found AS (SELECT rid, list(DISTINCT label) AS more, max(share) AS best FROM (SELECT rid, label, len(list_intersect(own, t)) / len(t) AS share FROM lines, templates) WHERE share >= {threshold} - 1e-9 GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""


_MIX = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
capped AS (SELECT *, [1, 2, 3][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM per),
filled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::BIGINT AS rest, (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::BIGINT AS rest_w
  FROM capped WINDOW f AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, rest * weight <= cap * rest_w AS open FROM filled),
level AS (SELECT arg_min(rest, (cap / weight, rank)) AS rest, arg_min(rest_w, (cap / weight, rank)) AS rest_w, min((cap / weight, rank)) AS at FROM opened WHERE open),
targets AS (SELECT source, source_size, rank, CASE WHEN (cap / weight, rank) >= level.at THEN level.rest::DOUBLE / level.rest_w::DOUBLE * weight ELSE cap::DOUBLE END AS target FROM opened, level),
queue AS (SELECT rid, doc_id, d.source, size, h, source_size, rank, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source),
copies AS (SELECT rid, size, (e * source_size + cum)::DOUBLE / target AS v, rank, h, doc_id FROM queue, range(3) t(e) WHERE size > 0),
taken AS (SELECT rid, size, sum(size) OVER (ORDER BY v, rank, h, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM copies),
kept AS (SELECT rid, count(*) AS n FROM taken WHERE run <= (SELECT sum(size) FROM d) GROUP BY rid)
SELECT doc_id, source, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken, CASE WHEN size = 0 THEN 1 ELSE coalesce(n, 0) END::INT AS repeats,
  CASE WHEN target > 0 THEN cum::DOUBLE / target ELSE 1.0::DOUBLE END AS finish FROM queue LEFT JOIN kept USING (rid)"""

_TOPK = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

ORACLES: dict[str, str] = {
    "op4_mix_sources": _MIX,
    "op8_license_scan": _licenses(),
    "op9_exact_topk": _TOPK,
}
