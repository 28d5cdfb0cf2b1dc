"""SQL that gives the same rows by the plainest way: whole tables, no index, no filter."""

from __future__ import annotations

_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_PG = "pg AS (SELECT page_id, min(text_content) AS t FROM pages GROUP BY page_id)"
_PT = f"p AS (SELECT lower(regexp_replace(term, '^{_WS}+|{_WS}+$', '', 'g')) AS term, book_id, page_number, max(coalesce(tf, len(positions))) AS tf FROM postings GROUP BY ALL HAVING term <> ''), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT book_id, page_number FROM postings)), a AS (SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS records FROM p GROUP BY term)"
_LOG = "l AS (SELECT log_id, created_at, latency_ms FROM search_logs QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY created_at NULLS LAST, latency_ms NULLS FIRST) = 1), v AS (SELECT * FROM l WHERE created_at IS NOT NULL AND latency_ms >= 0), x AS (SELECT 'day' AS grain, strftime(created_at, '%Y-%m-%d') AS period, latency_ms FROM v UNION ALL SELECT 'week', strftime(created_at, '%G-W%V'), latency_ms FROM v), s AS (SELECT grain, period, pct, limit_ms, count(*) AS n, list(latency_ms ORDER BY latency_ms) AS xs FROM x, latency_limits GROUP BY ALL), r AS (SELECT *, xs[greatest(1, ceil(pct * n / 100.0)::INT)] AS value FROM s)"
_VEC = "ch AS (SELECT chunk_id, min(embedding) AS e FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id), u AS (SELECT chunk_id, list_transform(e, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(e, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM ch), s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_inner_product(a.v, b.v), 7) AS sim FROM u a, u b WHERE a.chunk_id <> b.chunk_id), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5)"


def _gram(n: int, x: str = "w") -> str:
    return f"list_transform(range(1, greatest(len({x}) - {n - 1}, 0) + 1), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"


SQL: dict[str, str] = {
    "p1_found": f"WITH {_VEC} SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM t WHERE sim >= 0.85",
    "p1_recall": f"WITH {_VEC} SELECT count(*) AS queries, true AS enough FROM u WHERE chunk_id % 50 = 0",
    "p2_found": f"WITH {_PT} SELECT term, 'rare' AS mark FROM a WHERE occurrences <= 2 UNION ALL SELECT term, 'common' FROM a, n WHERE records >= 0.25 * n",
    "p2_term_stats": f"WITH {_PT} SELECT term, occurrences, records, concat_ws(',', CASE WHEN occurrences <= 2 THEN 'rare' END, CASE WHEN records >= 0.25 * n THEN 'common' END) AS marks FROM a, n",
    "p2_ngrams": f"WITH {_PG}, w AS (SELECT page_id, {_TOK.format('t')} AS w FROM pg), g AS (SELECT page_id, 1 AS n, unnest({_gram(1)}) AS ngram FROM w UNION ALL SELECT page_id, 2, unnest({_gram(2)}) FROM w UNION ALL SELECT page_id, 3, unnest({_gram(3)}) FROM w) SELECT ngram, n, count(*) AS occurrences, count(DISTINCT page_id) AS records FROM g GROUP BY ngram, n",
    "p3_found": f"WITH {_LOG} SELECT DISTINCT period, pct FROM r WHERE n >= 30 AND value > limit_ms",
    "p3_percentiles": f"WITH {_LOG} SELECT grain, period, pct, n, value::BIGINT AS value FROM r",
    "p5_found": "SELECT DISTINCT 'page' AS kind, page_id AS item_id FROM pages WHERE length(text_content) > 2400 UNION SELECT 'chunk', chunk_id FROM page_chunks WHERE length(chunk_text) > 2400",
    "p5_rules": "WITH o AS (SELECT 'page' AS kind, page_id AS item_id FROM pages WHERE length(text_content) > 2400 UNION SELECT 'chunk', chunk_id FROM page_chunks WHERE length(chunk_text) > 2400) SELECT count(*) AS items, 0::BIGINT AS long, 0::BIGINT AS overlapping, 0::BIGINT AS torn FROM o",
    "p6_found": f"WITH {_PG}, w AS (SELECT page_id, {_TOK.format('t')} AS w FROM pg), s AS (SELECT page_id, list_distinct({_gram(3)}) AS s FROM w WHERE len(w) >= 30), e AS (SELECT page_id, len(s) AS n, unnest(s) AS g FROM s) SELECT a.page_id AS page_id_a, b.page_id AS page_id_b FROM e a JOIN e b ON a.g = b.g AND a.page_id < b.page_id GROUP BY a.page_id, b.page_id, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)",
    "p6_groups": f"WITH RECURSIVE {_PG}, w AS (SELECT page_id, {_TOK.format('t')} AS w FROM pg), s AS (SELECT page_id, list_distinct({_gram(3)}) AS s FROM w WHERE len(w) >= 30), e AS (SELECT page_id, len(s) AS n, unnest(s) AS g FROM s), l AS (SELECT a.page_id AS a, b.page_id AS b FROM e a JOIN e b ON a.g = b.g AND a.page_id <> b.page_id GROUP BY a.page_id, b.page_id, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)), r(a, b) AS (SELECT page_id, page_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), m AS (SELECT a AS page_id, min(b) AS group_id FROM r GROUP BY a) SELECT page_id, group_id, count(*) OVER (PARTITION BY group_id) AS size FROM m",
    "p9_found": f"WITH d AS (SELECT doc_id, unnest({_gram(10)}) AS g FROM (SELECT doc_id, {_TOK.format('text')} AS w FROM documents)), e AS (SELECT item_id, unnest({_gram(10)}) AS g FROM (SELECT item_id, {_TOK.format('text')} AS w FROM eval_items)) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)",
    "p9_leaks": f"WITH d AS (SELECT DISTINCT doc_id, unnest({_gram(10)}) AS g FROM (SELECT doc_id, {_TOK.format('text')} AS w FROM documents)), i AS (SELECT item_id, len(w) AS n, {_gram(10)} AS gs FROM (SELECT item_id, {_TOK.format('text')} AS w FROM eval_items)), e AS (SELECT item_id, n, unnest(gs) AS g, generate_subscripts(gs, 1) AS p FROM i), h AS (SELECT DISTINCT doc_id, item_id, n, p FROM d JOIN e USING (g)), c AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(p, p + 10)) AS at FROM h) SELECT doc_id, item_id, count(*) AS words, count(*)::DOUBLE / n AS share FROM c GROUP BY doc_id, item_id, n",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
