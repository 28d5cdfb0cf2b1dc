"""Queries of the core over the library's tables; the equal SQL is in ``sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_sentences, sentences, tokens, trim_ws, truncate, ws_split
from ..operators import chunking, lexical, logs, ltr, ranking, summaries, sync, vectors
from ..operators.skew import key_shares, salted_aggregate
from ..session import scratch, stage
from ..sources import files, store
from ..sources.tables import indexable_pages, once, pages, table
from ..sources.tables import logs as log_rows
from ..streaming import daily
from .sql import QUERIES_TEXT, SQL

__all__ = ["QUERIES", "SQL"]


# 4: per-key results with heavy keys
def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return key_shares(table(spark, d, "pages"), "book_id", "page_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_shares(spark, d).where("share >= 0.04").select("book_id")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d, "book_id", "text_content").where("book_id is not null").withColumn("chars", F.length("text_content"))
    return salted_aggregate(p, "book_id", {"pages": ("count", "*"), "with_text": ("count", "chars"), "chars": ("sum", "chars"), "shortest": ("min", "chars"), "longest": ("max", "chars"), "mean": ("avg", "chars")}, salt_by="page_id").withColumn("mean", F.round("mean", 6))


# the lexical index
def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES_TEXT, "query_id long, query string")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = indexable_pages(spark, d)
    return lexical.build_docs(p), lexical.build_postings(p)


def _written_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The index as searches read it: written once, scanned by column."""
    docs, postings = _index(spark, d)
    return stage(docs), stage(postings)


def page_view(spark, d):
    p = pages(spark, d, "book_id", "page_number", "text_content").where("book_id is not null")
    return chunking.page_rows(p)


def book_dim(spark, d):
    return sync.book_dim(table(spark, d, "books"), pages(spark, d, "book_id"))


def book_rows(spark, d):
    return chunking.book_rows(table(spark, d, "books"))


def page_with_book(spark, d):
    x = sync.page_with_book(pages(spark, d, "book_id", "page_number"), table(spark, d, "books"))
    return x.select("page_id", "page_number", F.col("book.title").alias("title"), F.col("book.author").alias("author"), F.col("book.year").alias("year"), F.col("book.domain").alias("domain"), F.col("book.num_pages").alias("num_pages"))


def token_positions(spark, d):
    return lexical.token_positions(indexable_pages(spark, d))


def posting_lists(spark, d):
    return _index(spark, d)[1].withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


def term_frequency(spark, d):
    return _index(spark, d)[1].select("term", "book_id", "page_number", "tf")


def doc_length(spark, d):
    return _index(spark, d)[0].select("book_id", "page_number", F.col("dl").cast("long").alias("dl"))


def doc_frequency(spark, d):
    return lexical.document_frequency(_index(spark, d)[1])


def corpus_stats(spark, d):
    return lexical.corpus_stats(_index(spark, d)[0]).withColumn("avg_dl", F.round("avg_dl", 6))


def index_counters(spark, d):
    p = pages(spark, d, "book_id", "page_number", "text_content")
    return lexical.index_counters(p, table(spark, d, "books"), F.length(trim_ws(F.coalesce("text_content", F.lit("")))) == 0)


def query_expansion(spark, d):
    e = lexical.expansions(lexical.query_tokens(_queries(spark)))
    return e.select("query_id", F.posexplode("ex").alias("ord", "alt")).withColumn("ord", F.col("ord").cast("long"))


def _bm25(spark, d, queries, k):
    docs, postings = _index(spark, d)
    docs, postings = stage(docs.select("book_id", "page_number", "dl")), stage(postings.select("term", "book_id", "page_number", "tf"))
    terms = lexical.weighted_terms(lexical.query_tokens(queries))
    return lexical.top_per_query(lexical.bm25(terms, postings, docs), "bm25", k).select("query_id", F.col("rank").cast("long").alias("rank"), "book_id", "page_number", F.round("bm25", 6).alias("bm25"))


def bm25_topk(spark, d):
    return _bm25(spark, d, _queries(spark), 10)


def bm25_multi_query(spark, d):
    return _bm25(spark, d, _items(spark, d), 10)


def _features(spark, d):
    docs, postings = _written_index(spark, d)
    q = _queries(spark)
    cands = lexical.top_per_query(lexical.bm25(lexical.weighted_terms(lexical.query_tokens(q)), postings, docs), "bm25", 250).drop("rank")
    return ranking.features(cands, q, postings, docs)


def phrase_hits(spark, d):
    return _features(spark, d).select("query_id", "book_id", "page_number", F.col("hits").cast("long").alias("hits"))


def ordered_span(spark, d):
    return _features(spark, d).select("query_id", "book_id", "page_number", F.col("span").cast("long").alias("span"))


def proximity_boost(spark, d):
    return _features(spark, d).select("query_id", "book_id", "page_number", F.round("proximity", 6).alias("proximity"))


def term_coverage(spark, d):
    return _features(spark, d).select("query_id", "book_id", "page_number", F.round("exact", 6).alias("exact"), F.round("expanded", 6).alias("expanded"))


def ngram_boost(spark, d):
    return _features(spark, d).select("query_id", "book_id", "page_number", F.round("ngram", 6).alias("ngram"))


def snippet(spark, d):
    return _features(spark, d).select("query_id", "book_id", "page_number", ranking.snippet(F.col("text_content"), F.col("qt")).alias("snippet"))


def lexical_rerank(spark, d):
    docs, postings = _written_index(spark, d)
    return ranking.hybrid(_queries(spark), postings, docs, None, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "book_id", "page_number", "score", "lexical")


# vectors: the vectors of some chunks stand for query vectors
def _query_vectors(chunks: DataFrame) -> DataFrame:
    """(query_id, qvec): the vectors of the chunks with the smallest ids, one for each query in order."""
    few = chunks.select("chunk_id", "vec").orderBy("chunk_id").limit(len(QUERIES_TEXT))
    return few.select(F.row_number().over(Window.orderBy("chunk_id")).cast("long").alias("query_id"), F.col("vec").alias("qvec"))


def _chunks(spark, d):
    return stage(vectors.unit_chunks(table(spark, d, "chunk_vectors")))


def _stated(chunks: DataFrame) -> DataFrame:
    """(query_id, qvec): the vector of every chunk whose id is divisible by 50."""
    return chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))


#: Chunks and pages of a query that a search for 10 results takes from the vector side.
CHUNK_CUT, PAGE_CUT = max(1200, 6 * 200, 250 * 10), max(200, 30 * 10)


def vector_topk(spark, d):
    c = _chunks(spark, d)
    return vectors.top_chunks(vectors.scores(_stated(c), c, 10), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def vector_page_maxpool(spark, d):
    c = _chunks(spark, d)
    return vectors.top_pages(vectors.page_max(vectors.scores(_stated(c), c, CHUNK_CUT)), 200).select("query_id", "book_id", "page_number", F.round("semantic", 6).alias("semantic"), "chunk_id")


def vector_page_restricted(spark, d):
    """Vector scores of the pages that the lexical search has found."""
    docs, postings = _written_index(spark, d)
    p = lexical.top_per_query(lexical.bm25(lexical.weighted_terms(lexical.query_tokens(_queries(spark))), postings, docs), "bm25", 250).select("query_id", "book_id", "page_number")
    c = _chunks(spark, d)
    return vectors.restricted(p, vectors.scores(_query_vectors(c), c)).withColumn("semantic", F.round("semantic", 6))


def written(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents, postings and unit vectors that a search reads, written."""
    return *_written_index(spark, d), _chunks(spark, d)


def hybrid_search(spark, d):
    """The flagship: every query fused from its lexical and vector candidates in one plan."""
    return search_written(spark, *written(spark, d))


def search_written(spark, docs: DataFrame, postings: DataFrame, chunks: DataFrame) -> DataFrame:
    sem = vectors.top_pages(vectors.page_max(vectors.scores(_query_vectors(chunks), chunks, CHUNK_CUT)), PAGE_CUT).select("query_id", "book_id", "page_number", "semantic", "hint")
    return ranking.hybrid(_queries(spark), postings, docs, sem, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "book_id", "page_number", "page_id", "score", "lexical", "semantic")


def clustered_recall(spark, d):
    """One row (queries, enough): the queries of :func:`_stated`, and whether the clustered search finds 90 % of their 10 best chunks."""
    c = _chunks(spark, d)
    q = stage(_stated(c))
    exact = vectors.top_chunks(vectors.scores(q, c, 10), 10).select("query_id", "chunk_id")
    n = c.count()
    cells = min(vectors.clusters(n), max(1, n // 8))
    found = vectors.clustered_search(c, q, 10, cells, vectors.probes_for(cells)).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    x = exact.join(found, ["query_id", "chunk_id"], "left")
    return x.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def title_resolution(spark, d):
    b = table(spark, d, "books").select("book_id", "title")
    blank = b.withColumn("title", F.when(F.col("book_id") % 3 == 0, "unknown").when(F.col("book_id") % 3 == 1, "  ").otherwise(F.col("title")))
    return sync.resolve_titles(pages(spark, d, "book_id", "page_number"), blank, b)


# chunks
def chunk_pages(spark, d):
    return chunking.chunk_pages(indexable_pages(spark, d)).withColumn("word_count", F.col("word_count").cast("long"))


def chunk_sizes(spark, d):
    p = indexable_pages(spark, d).select("page_id", F.size(ws_split("text_content")).alias("n"))
    return p.select("page_id", F.posexplode(chunking.chunk_sizes(F.col("n"))).alias("i", "size")).select("page_id", (F.col("i") + 1).cast("long").alias("chunk_index"), F.col("size").cast("long").alias("size"))


def chunk_ids(spark, d):
    """Global chunk numbers in the order of book, page and chunk, without one task for all rows."""
    c = chunking.chunk_pages(indexable_pages(spark, d)).select("book_id", "page_number", "chunk_index", F.col("chunk_id").alias("name"))
    return sync.numbered(c, ["book_id", "page_number", "chunk_index"], "chunk_id").select("chunk_id", "name")


# logs
def history_user(spark, d):
    return logs.history(log_rows(spark, d, "user_id", "query_text", "created_at"), 2, 50)


def admin_logs_page(spark, d):
    return logs.page_of_logs(log_rows(spark, d, "user_id", "query_text", "created_at"), 20, 50)


def log_summary(spark, d):
    return logs.summary(log_rows(spark, d, "latency_ms", "total_results", "query_text"))


def daily_activity(spark, d):
    return logs.daily(log_rows(spark, d, "latency_ms", "created_at"))


def query_frequency(spark, d):
    return logs.query_frequency(log_rows(spark, d, "query_text"))


def top_results(spark, d):
    return logs.result_rows(log_rows(spark, d, "top_results")).withColumn("position", F.col("position").cast("long"))


def history_delete(spark, d):
    kept, gone = logs.without(log_rows(spark, d, "user_id"), 2)
    return kept.agg(F.count("*").alias("kept")).join(gone)  # one row each


def next_id(spark, d):
    return logs.next_id(table(spark, d, "search_logs"), "log_id")


def stream_daily(spark, d):
    """Daily figures of the log folder read as a stream up to its end: the days that the watermark has closed."""
    src = table(spark, d, "search_logs")
    at = scratch(spark, "stream")
    s = daily.log_stream(spark, f"{d}/search_logs.parquet", src.schema)
    daily.run_available(daily.daily_counts(s), f"{at}/out", f"{at}/cp", "append")
    return spark.read.schema("day date, searches long, avg_latency_ms double").parquet(f"{at}/out")


# catalogue
def status_histogram(spark, d):
    return sync.status_histogram(table(spark, d, "books"))


def _two_versions(spark, d):
    b = table(spark, d, "books").select("book_id", "title", "year", "status")
    old = b.where(F.col("book_id") % 5 != 0)
    new = b.where(F.col("book_id") % 7 != 0).withColumn("status", F.when(F.col("book_id") % 4 == 0, "indexed").otherwise(F.col("status")))
    return sync.upsert(old, new, "book_id")


def manifest_sync(spark, d):
    return _two_versions(spark, d)


def sync_summary(spark, d):
    return sync.sync_summary(_two_versions(spark, d))


def backfill(spark, d):
    return sync.backfill(table(spark, d, "books").select("book_id", "author", "year"), {"author": "Unknown", "year": 0})[1]


def keyed_update(spark, d):
    b = table(spark, d, "books").select("book_id", "title", "status")
    return sync.patch(b, b.where("book_id % 10 = 0").select("book_id", F.lit("indexed").alias("status")), "book_id")


def _gone(spark, d):
    return table(spark, d, "books").where("book_id % 3 = 0").select("book_id")


def index_remove_books(spark, d):
    return lexical.remove_books(_index(spark, d)[1], _gone(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


def incremental_reindex(spark, d):
    """Books taken out and put in again: the same index as a full build."""
    p = indexable_pages(spark, d)
    docs, postings = _index(spark, d)
    out = p.join(F.broadcast(_gone(spark, d)), "book_id", "left_semi")
    _, again = lexical.add_pages(docs, postings, out)
    return again.select("term", "book_id", "page_number", "tf")


def published_index(spark, d):
    """The index written as one version and read back."""
    docs, postings = _index(spark, d)
    root = scratch(spark, "index")
    store.publish(spark, root, {"docs": docs, "postings": postings})
    return store.read(spark, root, "postings").groupBy("book_id").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


def table_catalogue(spark, d):
    return store.catalogue(spark, {n: table(spark, d, n) for n in ("books", "pages", "page_chunks", "search_logs")})


# learning to rank
def ltr_ngrams_top(spark, d):
    p = _ltr_pages(spark, d)
    return ltr.top_ngrams(ltr.page_terms(p)).select("page_id", F.col("n").cast("long").alias("n"), "gram", "cnt", F.col("rank").cast("long").alias("rank"))


def _ltr_pages(spark, d):
    return indexable_pages(spark, d).withColumn("word_count", F.size(ws_split("text_content")))


def ltr_query_regen(spark, d):
    p = indexable_pages(spark, d).select("page_id", trim_ws(F.substring("text_content", 1, 200)).alias("snippet"))
    return p.select("page_id", ltr.regenerated_query(F.col("snippet")).alias("query"))


def ltr_labels(spark, d):
    p = _ltr_pages(spark, d)
    return ltr.labelled(ltr.generated_queries(ltr.page_terms(p)), p)


def ltr_label_histogram(spark, d):
    return ltr.label_histogram(ltr_labels(spark, d))


def ltr_label_rules(spark, d):
    """One row of violations: queries without exactly one source, with more than 4 pages of its book, with more than 10 rows, negatives of its book, sources elsewhere."""
    x = ltr_labels(spark, d)
    label = F.col("relevance_label")
    n = lambda k: F.count_if(label == k)
    other = F.collect_list(F.when(label == 0, F.struct("book_id"))).alias("other")
    per = x.groupBy("query", "source_page_id").agg(n(2).alias("two"), n(1).alias("one"), F.count("*").alias("rows"), other, F.collect_list(F.when(label == 2, F.struct("book_id"))).alias("own"), F.count_if((label == 2) & (F.col("page_id") != F.col("source_page_id"))).alias("off"))
    same_book = F.aggregate("own", F.lit(0), lambda s, o: s + F.size(F.filter("other", lambda y: y["book_id"] == o["book_id"])))
    off = F.when(F.col("off") > 0, F.col("off") * F.col("rows")).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(F.count_if(F.col("two") != 1).alias("sources"), F.count_if(F.col("one") > 4).alias("near"), F.count_if(F.col("rows") > 10).alias("many"), total(same_book.cast("long")).alias("negatives"), total(off).alias("elsewhere"))


def ltr_cleaned_labels(spark, d):
    """The labelled rows by the rule they fail first."""
    x = ltr_labels(spark, d)
    return ltr.removal_reasons(x.select(ltr.rule(F.col("query"), F.col("word_overlap_score")).alias("rule")))


def catalogue_newest(spark, d):
    return sync.book_list(table(spark, d, "books").select("book_id", "title"), 100, newest=True)


def catalogue_books(spark, d):
    return sync.book_list(table(spark, d, "books").select("book_id", "title"), 100)


def book_pages(spark, d):
    return sync.page_list(pages(spark, d, "book_id", "page_number"), 2)


def _ruled(spark, d):
    q = log_rows(spark, d, "query_text", "total_results").where("query_text is not null")
    return q.select("log_id", "query_text", ltr.rule(F.col("query_text"), F.coalesce("total_results", F.lit(0))).alias("rule"))


def clean_rules(spark, d):
    return _ruled(spark, d)


def removal_reasons(spark, d):
    return ltr.removal_reasons(_ruled(spark, d))


def retention(spark, d):
    return ltr.retention(_ruled(spark, d))


def query_length_distribution(spark, d):
    q = ltr.length_distribution(_items(spark, d))
    return q.withColumn("words", F.col("words").cast("long"))


def ltr_word_overlap(spark, d):
    """How many distinct words of each evaluation item stand on each page that holds any."""
    items = _items(spark, d).select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    post = _index(spark, d)[1].select("term", "book_id", "page_number")
    return items.join(post, "term").groupBy("query_id", "book_id", "page_number").agg(F.count("*").alias("overlap"))


# texts
def extractive_summary(spark, d):
    return indexable_pages(spark, d).select("page_id", first_sentences("text_content", 3).alias("summary"))


def sentence_counts(spark, d):
    return indexable_pages(spark, d).select("page_id", F.size(sentences("text_content")).cast("long").alias("sentences"))


def truncated_text(spark, d):
    return indexable_pages(spark, d).select("page_id", truncate("text_content", 500).alias("text"))


def html_text(spark, d):
    h = F.concat(F.lit("<html><head><style>p {x: y}</style></head><body><p>"), F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("</p><br/>by&nbsp;<b>"), F.coalesce("author", F.lit("")), F.lit("</b></body></html>"))
    return table(spark, d, "books").where("title is not null").select("book_id", files.html_text(h).alias("text"))


def json_body(spark, d):
    j = F.when(F.col("log_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("query_text").alias("query"), F.col("total_results").alias("top_k"))))
    b = log_rows(spark, d, "query_text", "total_results").select("log_id", files.body(j, "query string, top_k int").alias("b"))
    return b.select("log_id", "b.query", "b.top_k")


def chunk_counters(spark, d):
    c = once(table(spark, d, "page_chunks").select("chunk_id", "book_id"), "chunk_id")
    return c.agg(F.count("*").alias("chunks"), F.countDistinct("book_id").alias("books"))


def page_summaries(spark, d):
    x = summaries.summarise(indexable_pages(spark, d), 3, lambda texts: [t.upper() if len(t) % 2 else "" for t in texts], "upper")
    return x.withColumns({c: F.col(c).cast("long") for c in ("sentence_count", "source_sentence_count")})


def page_summaries_auto(spark, d):
    """As :func:`page_summaries` with the second provider of two; the first answers nothing."""
    both = {"gemini": lambda texts: [""] * len(texts), "huggingface": lambda texts: [t.upper() if len(t) % 2 else "" for t in texts]}
    x = summaries.dispatch(indexable_pages(spark, d), "auto", both)
    return x.withColumns({c: F.col(c).cast("long") for c in ("sentence_count", "source_sentence_count")})


def summaries_not_configured(spark, d):
    """One row (pages, named, chars): what a provider that is not configured gives."""
    x = summaries.dispatch(pages(spark, d, "book_id", "display_page_number", "text_content"), "hf", {"huggingface": None})
    return x.agg(F.count("*").alias("pages"), F.count("provider").alias("named"), F.sum(F.length("summary")).cast("long").alias("chars"))


def rows_changed(spark, d):
    b = table(spark, d, "books").select("book_id", "status")
    return ltr.compare_by_row(b, keyed_update(spark, d), "book_id", "status")


def ltr_profile(spark, d):
    return ltr.dataset_profile(ltr_labels(spark, d))


def library_paths(spark, d):
    return table(spark, d, "books").select("book_id", chunking.library_path(F.concat(F.lit("books/"), "stored_file_name")).alias("path"), chunking.library_path(F.replace("file_path", F.lit("/"), F.lit("\\"))).alias("turned"))


def activity_bars(spark, d):
    return logs.bars(daily_activity(spark, d))


def log_pages(spark, d):
    return logs.page_count(log_rows(spark, d), 10)


def search_log_entries(spark, d):
    docs, postings = _written_index(spark, d)
    r = ranking.hybrid(_queries(spark), postings, docs, None, 10)
    x = logs.log_rows(_queries(spark), r, F.lit(12))
    return x.select("query_id", F.array_join("normalized_query", " ").alias("normalized"), F.col("total_results").cast("long").alias("total_results"), F.size("top_results").cast("long").alias("kept"), F.col("top_results")[0]["page_id"].alias("best"))


def dataset_slice(spark, d):
    q = log_rows(spark, d, "query_text").where("query_text is not null")
    return ltr.dataset_slice(q, ["log_id"], 900).select("row_id", "log_id", "query_text")


def regeneration_report(spark, d):
    p = indexable_pages(spark, d).select(trim_ws(F.substring("text_content", 1, 40)).alias("query"), ltr.regenerated_query(trim_ws(F.substring("text_content", 1, 200))).alias("new_query"))
    return ltr.regeneration_report(p)


def daily_trend(spark, d):
    """Searches of every day with those of the day before and a weekly running mean."""
    per = log_rows(spark, d, "created_at").where("created_at is not null").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("searches"))
    w = Window.orderBy("day")  # one row per day
    return per.select("day", "searches", F.lag("searches").over(w).alias("before"), F.round(F.avg("searches").over(w.rowsBetween(-6, 0)), 6).alias("week_mean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p4_found, p4_shares, p4_profile, page_view, book_dim, book_rows, page_with_book, token_positions, posting_lists, term_frequency, doc_length, doc_frequency, corpus_stats, index_counters,
        query_expansion, bm25_topk, bm25_multi_query, phrase_hits, ordered_span, proximity_boost, term_coverage, ngram_boost, snippet, lexical_rerank, vector_topk, vector_page_maxpool,
        vector_page_restricted, hybrid_search, clustered_recall, title_resolution, chunk_pages, chunk_sizes, chunk_ids, history_user, admin_logs_page, log_summary, daily_activity, query_frequency,
        top_results, history_delete, next_id, stream_daily, status_histogram, manifest_sync, sync_summary, backfill, keyed_update, index_remove_books, incremental_reindex, published_index,
        table_catalogue, ltr_ngrams_top, ltr_query_regen, ltr_labels, ltr_label_histogram, clean_rules, removal_reasons, retention, query_length_distribution, ltr_word_overlap, extractive_summary,
        sentence_counts, truncated_text, html_text, json_body, chunk_counters, page_summaries, library_paths, activity_bars, log_pages, search_log_entries, dataset_slice, regeneration_report,
        daily_trend, ltr_label_rules, ltr_cleaned_labels, catalogue_newest, catalogue_books, book_pages,
        page_summaries_auto, summaries_not_configured, rows_changed, ltr_profile,
    )
}
