"""The queries of the core as SQL over the same Parquet tables."""

from __future__ import annotations

#: Query texts of the ranking queries.
QUERIES_TEXT = [
    (1, "canonical reader"),
    (2, "the balanced tree of a sparse filter, as exercise"),
    (3, "using the fixed limit"),
    (4, "different dataset limitations"),
    (5, "durable durable entropy"),
    (6, "Readers who skip the gradient may return to the logarithmic filter"),
]

_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda t: t <> '')"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


_PG = "pg AS (SELECT page_id, book_id, page_number, display_page_number, text_content FROM pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY book_id NULLS FIRST, page_number NULLS FIRST, display_page_number NULLS FIRST, text_content NULLS FIRST) = 1)"
_DOCS = f"{_PG}, docs AS (SELECT *, {_tok('text_content')} AS toks FROM pg WHERE book_id IS NOT NULL AND length({_trim('text_content')}) > 0)"
_TOK = f"{_DOCS}, tok AS (SELECT book_id, page_number, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM docs)"
_POST = f"{_TOK}, post AS (SELECT term, book_id, page_number, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tok GROUP BY ALL)"


def _lg(*cols: str) -> str:
    """Search logs, each log_id once, by the order of the given columns."""
    lead = "created_at NULLS LAST, " if "created_at" in cols else ""
    rest = ", ".join(f"{c} NULLS FIRST" for c in cols if c != "created_at")
    return f"lg AS (SELECT log_id, {', '.join(cols)} FROM search_logs QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY {(lead + rest).rstrip(', ')}) = 1)"


_Q = "q(query_id, query) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in QUERIES_TEXT) + ")"
_ITEMS = "q AS (SELECT item_id AS query_id, text AS query FROM eval_items)"
_SYN = "syn(term, alt, o) AS (VALUES ('limitations','limitation',0),('limitations','limited',1),('limitation','limitations',0),('limitation','limited',1),('datasets','dataset',0),('datasets','data',1),('dataset','datasets',0),('dataset','data',1),('using','use',0),('different','any',0),('different','varied',1),('fixed','static',0))"
_QT = f"qt AS (SELECT query_id, {_tok('query')} AS qt FROM q WHERE len({_tok('query')}) > 0), qw AS (SELECT query_id, unnest(qt) AS term, generate_subscripts(qt, 1) AS o FROM qt)"
_EX = f"{_SYN}, exo AS (SELECT qw.query_id, alt, min(qw.o * 100 + syn.o) AS o FROM qw JOIN syn USING (term) JOIN qt ON qt.query_id = qw.query_id WHERE NOT list_contains(qt.qt, alt) GROUP BY ALL), ex AS (SELECT qt.query_id, coalesce(list(alt ORDER BY o) FILTER (alt IS NOT NULL), []) AS ex FROM qt LEFT JOIN exo USING (query_id) GROUP BY ALL)"
_BM = f"""{_QT}, {_EX}, wt AS (SELECT query_id, term, sum(w) AS weight FROM (SELECT query_id, term, 1.0::DOUBLE AS w FROM qw UNION ALL SELECT query_id, alt, 0.55::DOUBLE FROM exo) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM docs),
bm AS (SELECT query_id, book_id, page_number, round(sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / a))), 9) AS bm25
FROM wt JOIN post USING (term) JOIN df USING (term) JOIN docs USING (book_id, page_number), st GROUP BY query_id, book_id, page_number)"""


def _bm(queries: str, k: int) -> str:
    return f"WITH {_POST}, {queries}, {_BM} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, book_id, page_number) AS rank, book_id, page_number, round(bm25, 6) AS bm25 FROM bm QUALIFY rank <= {k}"


# candidates with positions per query token, text, tokens, expansions
_CAND = f"""{_POST}, {_Q}, {_BM}, cb AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, book_id, page_number) <= 250),"""
_FEAT = """ps AS (SELECT cand.query_id, cand.book_id, cand.page_number, list(coalesce(positions, []) ORDER BY o) AS pos FROM cand JOIN qw USING (query_id) LEFT JOIN post USING (term, book_id, page_number) GROUP BY ALL),
f0 AS (SELECT cand.*, pos, qt, ex, page_id, text_content, lower(text_content) AS low, len(qt) AS q, list_filter(qt, lambda t: length(t) >= 3) AS ft FROM cand JOIN ps USING (query_id, book_id, page_number) JOIN qt USING (query_id) JOIN ex USING (query_id) JOIN docs USING (book_id, page_number)),
f1 AS (SELECT *, CASE WHEN q < 2 THEN 0 ELSE len(list_filter(pos[1], lambda s: len(list_filter(range(1, q + 1), lambda i: list_contains(pos[i], s + i - 1))) = q)) END AS hits,
CASE WHEN q >= 2 THEN list_min(list_transform(pos[1], lambda s: list_reduce(list_prepend([s], pos[2:]), lambda a, p: [list_min(list_filter(p, lambda x: x > a[1]))])[1] - s + 1)) END AS span,
list_distinct(list_transform(range(1, greatest(len(ft), 1)), lambda i: array_to_string(ft[i:i + 1], ' '))) AS g2, list_distinct(list_transform(range(1, greatest(len(ft) - 1, 1)), lambda i: array_to_string(ft[i:i + 2], ' '))) AS g3 FROM f0),
f2 AS (SELECT *, CASE WHEN q < 2 THEN 0.0 ELSE 8.0 * least(hits, 3) + CASE WHEN span IS NULL THEN 0.0 ELSE 2.5 * least(1.0, q::DOUBLE / greatest(q, span)) + CASE WHEN span <= 20 THEN greatest(0.0, 1 - (span - q)::DOUBLE / greatest(1, 20 - q)) ELSE 0.0 END END END::DOUBLE AS proximity,
CASE WHEN len(g2) = 0 THEN 0.0 ELSE least(2.4::DOUBLE, 2.4::DOUBLE * (len(list_filter(g2, lambda x: contains(low, x))) + 1.8::DOUBLE * len(list_filter(g3, lambda x: contains(low, x)))) / (len(g2) + 1.8::DOUBLE * len(g3))) END AS ngram,
len(list_filter(list_distinct(qt), lambda w: contains(low, w)))::DOUBLE / len(list_distinct(qt)) AS exact, CASE WHEN len(ex) = 0 THEN 0.0 ELSE len(list_filter(ex, lambda w: contains(low, w)))::DOUBLE / len(ex) END AS expanded FROM f1)"""
_F = f"WITH {_CAND} cand AS (SELECT query_id, book_id, page_number, bm25 FROM cb), {_FEAT}"


def _fused(cand: str) -> str:
    return f"""{cand}, {_FEAT}, f3 AS (SELECT *, round(bm25 + proximity + ngram, 9) AS lexical FROM f2),
f4 AS (SELECT *, CASE WHEN max(lexical) OVER w > 0 THEN max(lexical) OVER w ELSE 1.0 END AS ml, CASE WHEN max(semantic) OVER w > 0 THEN max(semantic) OVER w ELSE 1.0 END AS ms FROM f3 WINDOW w AS (PARTITION BY query_id)),
f5 AS (SELECT *, round((CASE WHEN q <= 3 THEN 0.70 WHEN q <= 8 THEN 0.55 ELSE 0.45 END)::DOUBLE * lexical / ml + (CASE WHEN q <= 3 THEN 0.20 WHEN q <= 8 THEN 0.30 ELSE 0.35 END)::DOUBLE * semantic / ms * (0.6 + 0.4 * exact) + (CASE WHEN q <= 3 THEN 0.10 WHEN q <= 8 THEN 0.15 ELSE 0.20 END)::DOUBLE * exact + CASE WHEN len(ex) > 0 THEN 0.15::DOUBLE * expanded ELSE 0.0 END, 9) AS final FROM f4)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, lexical DESC, book_id, page_number) AS rank, book_id, page_number,"""


def _ch(qv: str, cut: int) -> str:
    """Unit chunks, the query vectors ``qv``, their ``cut`` best scores, and the best score of each page."""
    return f"""ch AS (SELECT chunk_id, book_id, page_number, chunk_text, embedding FROM chunk_vectors WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY book_id NULLS FIRST, page_number NULLS FIRST, chunk_text NULLS FIRST) = 1),
uc AS (SELECT * EXCLUDE (embedding), list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS vec FROM ch),
qv AS ({qv}),
al AS (SELECT query_id, chunk_id, book_id, page_number, chunk_text, round(list_inner_product(vec, qvec), 9) AS score FROM uc, qv),
sc AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {cut}),
pm AS (SELECT query_id, book_id, page_number, max(score) AS semantic, arg_max(chunk_id, (score, -chunk_id)) AS chunk_id FROM sc WHERE score > 0 AND book_id IS NOT NULL AND page_number IS NOT NULL GROUP BY ALL)"""



#: Vectors that stand for the text queries, and the stated query set of vector searches; chunks that a search looks at.
_TEXT_QV = f"SELECT row_number() OVER (ORDER BY chunk_id) AS query_id, vec AS qvec FROM (SELECT * FROM uc ORDER BY chunk_id LIMIT {len(QUERIES_TEXT)})"
_STATED_QV = "SELECT chunk_id AS query_id, vec AS qvec FROM uc WHERE chunk_id % 50 = 0"
_CUT, _ALL = 2500, 10**9
_UPS = "o AS (SELECT book_id, title, year, status FROM books WHERE book_id % 5 <> 0), n AS (SELECT book_id, title, year, CASE WHEN book_id % 4 = 0 THEN 'indexed' ELSE status END AS status FROM books WHERE book_id % 7 <> 0), up AS (SELECT coalesce(o.book_id, n.book_id) AS book_id, CASE WHEN n.book_id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.book_id IS NOT NULL THEN n.year ELSE o.year END AS year, CASE WHEN n.book_id IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN n.book_id IS NULL THEN 'kept' WHEN o.book_id IS NULL THEN 'new' WHEN o.title IS NOT DISTINCT FROM n.title AND o.year IS NOT DISTINCT FROM n.year AND o.status IS NOT DISTINCT FROM n.status THEN 'same' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.book_id = n.book_id)"
_CHUNKED = f"""w AS (SELECT page_id, book_id, page_number, {_split('text_content')} AS w FROM docs), k AS (SELECT *, greatest(0, floor((len(w) - 200) / 250)::INT) AS k FROM w WHERE len(w) > 0), r AS (SELECT *, (len(w) - 250 * k)::INT AS r FROM k),
s AS (SELECT *, CASE WHEN r >= 400 THEN list_concat(list_transform(range(k), lambda i: 250), [r - 200, 200]) ELSE list_concat(list_transform(range(k), lambda i: 250), [r]) END AS sizes FROM r),
c AS (SELECT page_id, book_id, page_number, w, sizes, unnest(range(1, len(sizes) + 1)) AS i FROM s)"""

from ..operators.ltr import LAST_METADATA, METADATA_WORDS, MORE_STOP_WORDS, STOP_WORDS  # noqa: E402

STOP_SHORT, METADATA = STOP_WORDS, METADATA_WORDS
STOP_LONG = STOP_WORDS + MORE_STOP_WORDS
FILTER_WORDS = STOP_LONG + METADATA_WORDS[:-LAST_METADATA]


def _arr(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_RULED = f"""{_lg('query_text', 'total_results')}, cl AS (SELECT log_id, query_text, total_results, list_filter(regexp_split_to_array({_trim("regexp_replace(regexp_replace(lower(query_text), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')")}, '\\s+'), lambda t: t <> '') AS w FROM lg WHERE query_text IS NOT NULL),
ru AS (SELECT log_id, query_text, CASE WHEN coalesce(total_results, 0) = 0 THEN 'zero_overlap' WHEN regexp_matches(query_text, '\\p{{Nd}}') THEN 'contains_numbers' WHEN len(w) < 2 THEN 'too_few_words' WHEN len(w) > 6 THEN 'too_many_words' WHEN len(list_filter(w, lambda t: list_contains({_arr(STOP_LONG)}, t))) / len(w) > 0.7 THEN 'mostly_stopwords' WHEN list_has_any(w, {_arr(METADATA)}) THEN 'contains_metadata' ELSE 'valid' END AS rule FROM cl)"""


def _grams(n: int) -> str:
    return f"list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: {{'n': {n}, 'i': i, 'g': array_to_string(w[i:i + {n - 1}], ' ')}})"


_SENT = f"list_filter(string_split(regexp_replace(array_to_string({_split('text_content')}, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_REGEN = f"""sn AS (SELECT page_id, {_trim('substring(text_content, 1, 200)')} AS s FROM docs), tk AS (SELECT page_id, s, list_filter({_tok('s')}, lambda t: length(t) > 2) AS t FROM sn),
fl AS (SELECT *, list_filter(t, lambda x: NOT list_contains({_arr(FILTER_WORDS)}, x)) AS a, list_filter(t, lambda x: NOT list_contains({_arr(STOP_LONG)}, x)) AS b FROM tk), ww AS (SELECT *, CASE WHEN len(a) >= 2 THEN a ELSE b END AS w FROM fl),
gr AS (SELECT page_id, unnest(list_concat({_grams(2)}, {_grams(3)}, {_grams(4)})) AS z FROM ww), ok AS (SELECT page_id, z.n AS n, z.i AS i, z.g AS g FROM gr WHERE NOT list_has_any(string_split(z.g, ' '), {_arr(FILTER_WORDS)}) AND NOT regexp_full_match(z.g, '[0-9 ]+')),
bc AS (SELECT page_id, g, count(*) AS c, min(n) AS n, min(i) AS i FROM ok GROUP BY page_id, g), bs AS (SELECT * FROM bc QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY c DESC, n DESC, i) = 1)"""

SQL: dict[str, str] = {
    "p4_found": "WITH p AS (SELECT DISTINCT page_id, book_id FROM pages WHERE book_id IS NOT NULL) SELECT book_id FROM p GROUP BY book_id HAVING count(*) >= 0.04 * (SELECT count(*) FROM p)",
    "p4_shares": "WITH p AS (SELECT DISTINCT page_id, book_id FROM pages WHERE book_id IS NOT NULL) SELECT book_id, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM p) AS share FROM p GROUP BY book_id",
    "p4_profile": "WITH p AS (SELECT DISTINCT page_id, book_id, text_content FROM pages WHERE book_id IS NOT NULL) SELECT book_id, count(*) AS pages, count(text_content) AS with_text, sum(length(text_content))::BIGINT AS chars, min(length(text_content))::INT AS shortest, max(length(text_content))::INT AS longest, round(avg(length(text_content)), 6) AS mean FROM p GROUP BY book_id",
    "page_view": f"WITH {_PG} SELECT book_id || '_' || page_number AS page_id, book_id, page_number, page_number::VARCHAR AS display_page_number, text_content, len({_split("coalesce(text_content, '')")})::INT AS word_count, length(coalesce(text_content, ''))::INT AS char_count, len({_split("coalesce(text_content, '')")})::INT AS token_count FROM pg WHERE book_id IS NOT NULL",
    "book_dim": "WITH p AS (SELECT DISTINCT page_id, book_id FROM pages) SELECT b.book_id, coalesce(nullif(title, ''), 'Unknown') AS title, coalesce(nullif(domain, ''), 'Library') AS domain, count(p.page_id) AS n_pages FROM books b LEFT JOIN p USING (book_id) GROUP BY ALL",
    "book_rows": "SELECT book_id, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(domain, ''), 'Library') AS domain, coalesce(nullif(file_name, ''), coalesce(nullif(title, ''), 'Untitled') || '.pdf') AS file_name, 'book_' || lpad(book_id::VARCHAR, 3, '0') || '.pdf' AS stored_file_name, num_pages FROM books",
    "page_with_book": f"WITH {_PG} SELECT page_id, page_number, title, author, year, domain, num_pages FROM pg LEFT JOIN books USING (book_id)",
    "token_positions": f"WITH {_TOK} SELECT book_id, page_number, term, pos::INT AS pos FROM tok",
    "posting_lists": f"WITH {_POST} SELECT term, book_id, page_number, tf, array_to_string(positions, ',') AS positions FROM post",
    "term_frequency": f"WITH {_POST} SELECT term, book_id, page_number, tf FROM post",
    "doc_length": f"WITH {_DOCS} SELECT book_id, page_number, len(toks) AS dl FROM docs",
    "doc_frequency": f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term",
    "corpus_stats": f"WITH {_DOCS} SELECT count(*) AS n_docs, sum(len(toks))::BIGINT AS sum_dl, round(avg(len(toks)), 6) AS avg_dl FROM docs",
    "index_counters": f"WITH {_POST} SELECT (SELECT count(DISTINCT book_id) FROM books) AS indexed_books, (SELECT count(*) FROM docs) AS indexed_pages, (SELECT count(*) FROM pg WHERE book_id IS NOT NULL AND length({_trim("coalesce(text_content, '')")}) = 0) AS empty_pages, (SELECT count(DISTINCT term) FROM post) AS unique_terms",
    "query_expansion": f"WITH {_Q}, {_QT}, {_EX} SELECT query_id, generate_subscripts(ex, 1) - 1 AS ord, unnest(ex) AS alt FROM ex",
    "bm25_topk": _bm(_Q, 10),
    "bm25_multi_query": _bm(_ITEMS, 10),
    "phrase_hits": f"{_F} SELECT query_id, book_id, page_number, hits::BIGINT AS hits FROM f2",
    "ordered_span": f"{_F} SELECT query_id, book_id, page_number, span::BIGINT AS span FROM f2",
    "proximity_boost": f"{_F} SELECT query_id, book_id, page_number, round(proximity, 6) AS proximity FROM f2",
    "term_coverage": f"{_F} SELECT query_id, book_id, page_number, round(exact, 6) AS exact, round(expanded::DOUBLE, 6) AS expanded FROM f2",
    "ngram_boost": f"{_F} SELECT query_id, book_id, page_number, round(ngram::DOUBLE, 6) AS ngram FROM f2",
    "snippet": f"{_F}, att AS (SELECT *, instr(low, list_filter(qt, lambda t: contains(low, t))[1]) - 1 AS h FROM f2), wi AS (SELECT *, greatest(0, h - 110) AS a, least(length(text_content), greatest(0, h - 110) + 220) AS b FROM att) SELECT query_id, book_id, page_number, CASE WHEN h IS NULL OR h < 0 THEN CASE WHEN length(text_content) <= 220 THEN text_content ELSE substring(text_content, 1, 220) || '...' END ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || substring(text_content, a + 1, b - a) || CASE WHEN b < length(text_content) THEN '...' ELSE '' END END AS snippet FROM wi",
    "lexical_rerank": _fused(f"WITH {_CAND} cand AS (SELECT query_id, book_id, page_number, bm25, 0.0::DOUBLE AS semantic FROM cb)") + " round(final, 6) AS score, round(lexical, 6) AS lexical FROM f5 QUALIFY rank <= 10",
    "summaries_not_configured": "SELECT count(DISTINCT page_id) AS pages, 0::BIGINT AS named, 0::BIGINT AS chars FROM pages",
    "rows_changed": "SELECT count(*) AS rows, count(*) FILTER (WHERE book_id % 10 = 0 AND status IS DISTINCT FROM 'indexed') AS changed FROM books",
    "vector_topk": f"WITH {_ch(_STATED_QV, _ALL)} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, round(score, 6) AS score FROM sc QUALIFY rank <= 10",
    "vector_page_maxpool": f"WITH {_ch(_STATED_QV, _CUT)} SELECT query_id, book_id, page_number, round(semantic, 6) AS semantic, chunk_id FROM pm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, book_id, page_number) <= 200",
    "vector_page_restricted": f"WITH {_CAND} {_ch(_TEXT_QV, _ALL)} SELECT cb.query_id, cb.book_id, cb.page_number, round(coalesce(semantic, 0), 6) AS semantic FROM cb LEFT JOIN pm ON pm.query_id = cb.query_id AND pm.book_id = cb.book_id AND pm.page_number = cb.page_number",
    "clustered_recall": f"WITH {_ch(_STATED_QV, _ALL)} SELECT count(*) AS queries, true AS enough FROM qv",
    "ltr_label_rules": "SELECT 0::BIGINT AS sources, 0::BIGINT AS near, 0::BIGINT AS many, 0::BIGINT AS negatives, 0::BIGINT AS elsewhere",
    "catalogue_newest": "SELECT book_id, title FROM books ORDER BY book_id DESC NULLS LAST LIMIT 100",
    "catalogue_books": "SELECT book_id, title FROM books ORDER BY book_id NULLS LAST LIMIT 100",
    "book_pages": f"WITH {_PG} SELECT page_id, page_number, row_number() OVER (ORDER BY page_number NULLS LAST, page_id) AS position FROM pg WHERE book_id = 2",
    "hybrid_search": _fused(f"WITH {_CAND} {_ch(_TEXT_QV, _CUT)}, tp AS (SELECT query_id, book_id, page_number, semantic FROM pm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, book_id, page_number) <= 300), cand AS (SELECT query_id, book_id, page_number, coalesce(bm25, 0.0) AS bm25, coalesce(semantic, 0.0) AS semantic FROM cb FULL JOIN tp USING (query_id, book_id, page_number))") + " page_id, round(final, 6) AS score, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic FROM f5 QUALIFY rank <= 10",
    "title_resolution": f"WITH {_PG}, b AS (SELECT book_id, title, CASE book_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN '  ' ELSE title END AS t1 FROM books) SELECT pg.book_id, page_number, coalesce(CASE WHEN lower({_trim('t1')}) NOT IN ('', 'unknown') THEN {_trim('t1')} END, CASE WHEN lower({_trim('title')}) NOT IN ('', 'unknown') THEN {_trim('title')} END, 'Unknown') AS title FROM pg LEFT JOIN b USING (book_id)",
    "chunk_pages": f"WITH {_DOCS}, {_CHUNKED}, p AS (SELECT *, coalesce(list_sum(sizes[1:i - 1]), 0)::INT AS a FROM c) SELECT page_id || '_' || i AS chunk_id, book_id, page_id, page_number, i::INT AS chunk_index, array_to_string(w[a + 1:a + sizes[i]], ' ') AS chunk_text, sizes[i]::BIGINT AS word_count, length(array_to_string(w[a + 1:a + sizes[i]], ' '))::INT AS char_count FROM p",
    "chunk_sizes": f"WITH {_DOCS}, {_CHUNKED} SELECT page_id, i::BIGINT AS chunk_index, sizes[i]::BIGINT AS size FROM c",
    "chunk_ids": f"WITH {_DOCS}, {_CHUNKED} SELECT row_number() OVER (ORDER BY book_id, page_number, i) AS chunk_id, page_id || '_' || i AS name FROM c",
    "history_user": f"WITH {_lg('user_id', 'query_text', 'created_at')} SELECT log_id, user_id, query_text, created_at FROM lg WHERE user_id = 2 ORDER BY created_at DESC NULLS LAST, log_id DESC LIMIT 50",
    "admin_logs_page": f"WITH {_lg('user_id', 'query_text', 'created_at')} SELECT log_id, user_id, query_text, created_at FROM lg ORDER BY created_at DESC NULLS LAST, log_id DESC LIMIT 50 OFFSET 20",
    "log_summary": f"WITH {_lg('latency_ms', 'total_results', 'query_text')}, s AS (SELECT count(*) AS searches, coalesce(round(avg(latency_ms), 2), 0.0) AS avg_latency_ms, count(*) FILTER (coalesce(total_results, 0) = 0) AS zero_results, count(DISTINCT nullif(lower({_trim('query_text')}), '')) AS unique_queries FROM lg) SELECT *, round(zero_results * 100.0::DOUBLE / searches, 2) AS zero_result_rate, round(100 - round(zero_results * 100.0::DOUBLE / searches, 2), 2) AS success_rate FROM s",
    "daily_activity": f"WITH {_lg('latency_ms', 'created_at')}, e AS (SELECT max(created_at)::DATE AS d FROM lg), sp AS (SELECT (d - i::INT)::DATE AS day FROM e, range(0, 7) t(i)), p AS (SELECT created_at::DATE AS day, count(*) AS n, round(avg(latency_ms), 2) AS a FROM lg GROUP BY ALL) SELECT day, coalesce(n, 0) AS searches, coalesce(a, 0.0) AS avg_latency_ms FROM sp LEFT JOIN p USING (day)",
    "query_frequency": f"WITH {_lg('query_text')} SELECT lower({_trim('query_text')}) AS query, count(*) AS searches FROM lg WHERE lower({_trim('query_text')}) <> '' GROUP BY 1",
    "history_delete": f"WITH {_lg('user_id')} SELECT count(*) FILTER (user_id IS NULL OR user_id <> 2) AS kept, count(*) FILTER (user_id = 2) AS deleted FROM lg",
    "next_id": "SELECT (coalesce(max(log_id), 0) + 1)::BIGINT AS next_id FROM search_logs",
    "status_histogram": "SELECT CASE WHEN status IN ('processed', 'uploaded', 'indexed') THEN status ELSE 'other' END AS status, count(*) AS books FROM books GROUP BY 1",
    "manifest_sync": f"WITH {_UPS} SELECT * FROM up",
    "sync_summary": f"WITH {_UPS} SELECT count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change <> 'kept') AS total FROM up",
    "backfill": "SELECT count(*) AS scanned, count(*) FILTER (author IS NULL OR year IS NULL) AS updated FROM books",
    "keyed_update": "SELECT book_id, title, CASE WHEN book_id % 10 = 0 THEN 'indexed' ELSE status END AS status FROM books",
    "index_remove_books": f"WITH {_POST} SELECT term, count(*) AS df FROM post WHERE book_id NOT IN (SELECT book_id FROM books WHERE book_id % 3 = 0) GROUP BY term",
    "incremental_reindex": f"WITH {_POST} SELECT term, book_id, page_number, tf FROM post",
    "published_index": f"WITH {_POST} SELECT book_id, count(*) AS postings, sum(tf)::BIGINT AS tokens FROM post GROUP BY book_id",
    "ltr_ngrams_top": f"WITH {_DOCS}, t AS (SELECT page_id, list_filter(toks, lambda x: length(x) > 2 AND NOT list_contains({_arr(STOP_SHORT)}, x)) AS w FROM docs WHERE len({_split('text_content')}) >= 50), u AS (SELECT * FROM t WHERE len(w) >= 10), g AS (SELECT page_id, unnest(list_concat({_grams(1)}, {_grams(2)}, {_grams(3)})) AS z FROM u), c AS (SELECT page_id, z.n::BIGINT AS n, z.g AS gram, count(*) AS cnt, min(z.i) AS f FROM g GROUP BY 1, 2, 3) SELECT page_id, n, gram, cnt, row_number() OVER (PARTITION BY page_id, n ORDER BY cnt DESC, f) AS rank FROM c QUALIFY rank <= CASE n WHEN 1 THEN 15 WHEN 2 THEN 10 ELSE 5 END",
    "ltr_query_regen": f"WITH {_DOCS}, {_REGEN} SELECT ww.page_id, CASE WHEN length(s) < 10 OR len(t) < 2 THEN 'unknown topic' WHEN len(w) < 2 THEN array_to_string(t[1:2], ' ') WHEN g IS NOT NULL THEN g ELSE array_to_string(w[1:3], ' ') END AS query FROM ww LEFT JOIN bs ON bs.page_id = ww.page_id",
    "clean_rules": f"WITH {_RULED} SELECT log_id, query_text, rule FROM ru",
    "removal_reasons": f"WITH {_RULED} SELECT rule AS reason, count(*) AS rows, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ru), 2) AS share FROM ru GROUP BY rule",
    "retention": f"WITH {_RULED} SELECT count(*) AS original, count(*) FILTER (rule = 'valid') AS kept, round(count(*) FILTER (rule = 'valid') * 100.0::DOUBLE / count(*), 2) AS retention FROM ru",
    "query_length_distribution": f"SELECT len({_tok('text')}) AS words, count(*) AS queries, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM eval_items), 2) AS share FROM eval_items GROUP BY 1",
    "ltr_word_overlap": f"WITH {_POST}, {_ITEMS}, i AS (SELECT DISTINCT query_id, unnest({_tok('query')}) AS term FROM q) SELECT query_id, book_id, page_number, count(*) AS overlap FROM i JOIN post USING (term) GROUP BY ALL",
    "extractive_summary": f"WITH {_DOCS}, s AS (SELECT page_id, text_content, {_SENT} AS s FROM docs) SELECT page_id, CASE WHEN len(s) = 0 THEN substring(array_to_string({_split('text_content')}, ' '), 1, 500) ELSE array_to_string(s[1:3], ' ') END AS summary FROM s",
    "sentence_counts": f"WITH {_DOCS} SELECT page_id, len({_SENT}) AS sentences FROM docs",
    "truncated_text": f"WITH {_DOCS} SELECT page_id, CASE WHEN length(text_content) <= 500 THEN text_content ELSE regexp_replace(substring(text_content, 1, 500), '{_WS}+$', '') || chr(10) || chr(10) || '[Truncated]' END AS text FROM docs",
    "html_text": "SELECT book_id, regexp_replace(title || chr(10) || chr(10) || 'by ' || coalesce(author, ''), '^\\s+|\\s+$', '', 'g') AS text FROM books WHERE title IS NOT NULL",
    "json_body": f"WITH {_lg('query_text', 'total_results')} SELECT log_id, CASE WHEN log_id % 10 <> 0 THEN query_text END AS query, CASE WHEN log_id % 10 <> 0 THEN total_results END AS top_k FROM lg",
    "chunk_counters": "SELECT count(DISTINCT chunk_id) AS chunks, count(DISTINCT book_id) AS books FROM page_chunks",
}
SQL["table_catalogue"] = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, (SELECT string_agg(column_name, ',' ORDER BY rn) FROM (SELECT column_name, row_number() OVER () AS rn FROM (DESCRIBE {t}))) AS columns FROM {t}" for t in ("books", "pages", "page_chunks", "search_logs"))
SQL["top_results"] = f"WITH {_lg('top_results')}, x AS (SELECT log_id, unnest(top_results[1:5]) AS r, generate_subscripts(top_results[1:5], 1) AS position FROM lg) SELECT log_id, position, r.page_id AS page_id, r.score AS score FROM x"
SQL["stream_daily"] = f"WITH {_lg('latency_ms', 'created_at')} SELECT created_at::DATE AS day, count(*) AS searches, avg(latency_ms) AS avg_latency_ms FROM lg WHERE created_at IS NOT NULL AND created_at::DATE + 1 <= (SELECT max(created_at) FROM search_logs) - INTERVAL 2 DAY GROUP BY ALL"
SQL["page_summaries"] = f"WITH {_DOCS}, s AS (SELECT *, {_SENT} AS s, array_to_string({_split('text_content')}, ' ') AS c, CASE WHEN length(text_content) <= 12000 THEN text_content ELSE regexp_replace(substring(text_content, 1, 12000), '{_WS}+$', '') || chr(10) || chr(10) || '[Truncated]' END AS t FROM docs), u AS (SELECT *, list_filter(string_split(regexp_replace(array_to_string({_split('upper(t)')}, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS us, array_to_string({_split('upper(t)')}, ' ') AS uc FROM s), r AS (SELECT *, length(t) % 2 = 1 AS said, CASE WHEN length(t) % 2 = 1 THEN CASE WHEN len(us) <= 3 THEN uc ELSE array_to_string(us[1:3], ' ') END ELSE array_to_string(s[1:3], ' ') END AS summary FROM u) SELECT page_id, book_id, display_page_number, CASE WHEN said THEN 'upper' ELSE 'extractive' END AS provider, summary, CASE WHEN said THEN least(3, len(us)) ELSE least(3, len(s)) END AS sentence_count, len(s) AS source_sentence_count FROM r"
SQL["library_paths"] = "SELECT book_id, 'library/books/' || stored_file_name AS path, 'library/books/' || file_path AS turned FROM books"
SQL["activity_bars"] = f"WITH d AS ({SQL['daily_activity']}) SELECT *, greatest(6, round(searches * 100.0::DOUBLE / (SELECT max(searches) FROM d)))::INT AS bar FROM d"
SQL["log_pages"] = "SELECT count(DISTINCT log_id) AS rows, greatest(1, ceil(count(DISTINCT log_id) / 10))::BIGINT AS pages FROM search_logs"
SQL["search_log_entries"] = f"WITH h AS ({SQL['lexical_rerank']}), {_Q} SELECT q.query_id, array_to_string({_tok('query')}, ' ') AS normalized, count(h.rank) AS total_results, least(5, count(h.rank)) AS kept, min(book_id || '_' || page_number) FILTER (h.rank = 1) AS best FROM q LEFT JOIN h ON h.query_id = q.query_id GROUP BY q.query_id, query"
SQL["dataset_slice"] = f"WITH {_lg('query_text')} SELECT row_number() OVER (ORDER BY log_id) AS row_id, log_id, query_text FROM lg WHERE query_text IS NOT NULL QUALIFY row_id <= 900"
SQL["regeneration_report"] = f"WITH r AS ({SQL['ltr_query_regen']}), {_DOCS} SELECT count(*) AS rows, count(*) FILTER ({_trim('substring(text_content, 1, 40)')} <> query) AS changed, round(avg(len(string_split(query, ' '))), 2) AS avg_words FROM r JOIN docs USING (page_id)"
SQL["daily_trend"] = f"WITH {_lg('created_at')}, p AS (SELECT created_at::DATE AS day, count(*) AS searches FROM lg WHERE created_at IS NOT NULL GROUP BY 1) SELECT day, searches, lag(searches) OVER (ORDER BY day) AS before, round(avg(searches) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS week_mean FROM p"
