"""The queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import vectors
from ..session import spread, stage
from ..sources.tables import logs, pages, postings, table
from . import encoding, garbled, leaks, neardup, neighbours, ngrams, percentiles, pieces, scans
from .sql import SQL

__all__ = ["QUERIES", "SQL"]


# 1: most similar vectors
def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(table(spark, d, "chunk_vectors"), "chunk_id", "embedding").withColumn("sim", F.round("sim", 6))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """One row (queries, enough): the vectors whose id is divisible by 50, and whether 90 % of their 5 nearest are found."""
    found = p1_neighbours(spark, d).where("id % 50 = 0").select("id", "neighbour", F.lit(1).alias("hit"))
    c = stage(vectors.unit_chunks(table(spark, d, "chunk_vectors")))
    q = c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    near = vectors.scores(q, c, 6).where("query_id <> chunk_id").withColumn("score", F.round("score", 7))
    exact = vectors.top_chunks(near, 5).select(F.col("query_id").alias("id"), F.col("chunk_id").alias("neighbour"))
    x = exact.join(found, ["id", "neighbour"], "left")
    return x.agg(F.countDistinct("id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.neighbours(table(spark, d, "chunk_vectors"), "chunk_id", "embedding", least=0.85), 0.85).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


# 2: frequency of every term
def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    tokens_of = ngrams.posting_tokens(postings(spark, d), "book_id", "page_number")
    counts = ngrams.ngram_counts(tokens_of, 1).withColumnRenamed("ngram", "term")
    n = table(spark, d, "postings").select("book_id", "page_number").distinct().count()
    return ngrams.marked(counts, n)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).select("term", F.explode("marks").alias("mark"))


def p2_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).select("term", "occurrences", "records", F.array_join("marks", ",").alias("marks"))


def p2_ngrams(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d, "text_content").select("page_id", tokens("text_content").alias("t"))
    return ngrams.ngram_counts(ngrams.text_tokens(p, "page_id", "t"), 3)


# 3: percentiles of latencies
def _percentiles(spark: SparkSession, d: str, least: int) -> DataFrame:
    x = logs(spark, d, "latency_ms", "created_at").where("created_at is not null and latency_ms >= 0").select(F.to_date("created_at").alias("day"), "latency_ms")
    days = stage(percentiles.histograms(x, "day", "latency_ms"))
    pcts = table(spark, d, "latency_limits").select("pct")
    return percentiles.radix_percentiles(days, percentiles.calendar(days.select("base").distinct()), pcts, least)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d, 1)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "latency_limits").select("pct", "limit_ms").distinct()
    return _percentiles(spark, d, 30).join(limits, "pct").where(F.col("value") > F.col("limit_ms")).select("period", "pct").distinct()


# 5: oversized texts
def _oversized(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("item_id"), F.col("text_content").alias("text"))
    c = table(spark, d, "page_chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))
    over = p.unionByName(c).where(F.length("text") > pieces.LIMIT)
    return over.groupBy("kind", "item_id").agg(F.min("text").alias("text"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(_oversized(spark, d))


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    """One row (items, long, overlapping, torn): pieces over the limit, overlaps over 200, texts that are not the pieces put together."""
    x = stage(p5_pieces(spark, d))
    a = x.agg(F.count_if(F.length("text") > pieces.LIMIT).alias("long"), F.count_if(F.col("fresh") > 200).alias("overlapping"))
    fresh = F.transform(F.array_sort(F.collect_list(F.struct("piece", F.expr("substring(text, fresh + 1)").alias("t")))), lambda y: y["t"])
    whole = x.groupBy("kind", "item_id").agg(F.array_join(fresh, "").alias("whole"))
    b = _oversized(spark, d).join(whole, ["kind", "item_id"], "left").agg(F.count("*").alias("items"), F.count_if(~F.col("text").eqNullSafe(F.col("whole"))).alias("torn"))
    return a.join(b)  # one row each


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("piece = 2").select("kind", "item_id")


# 6: near-duplicate pages
def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(pages(spark, d, "text_content"), "page_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    links = neardup.similar_sets(_texts(spark, d), "page_id", "text_content")
    return neardup.similar_pairs(*links).select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_texts(spark, d), "page_id", "text_content").withColumnRenamed("key", "page_id")


# 7: scanned pages
def _repaired(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d, "book_id", "page_number", "display_page_number", "text_content")
    # a page without a book says in its page_id, book and page number, where it is from
    part = lambda n: F.regexp_extract("page_id", r"^(\d{1,9})_(\d{1,9})$", n).try_cast("int")
    p = p.withColumns({"book_id": F.coalesce("book_id", part(1)), "page_number": F.coalesce("page_number", part(2))})
    return scans.repair_pages(p, table(spark, d, "books"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("page_id", F.explode("kinds").alias("kind"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).where(F.size("kinds") > 0).select("page_id", "text")


# 8: encoding
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode(p8_ids(spark, d), "doc_id")


# 9: evaluation passages
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


# 10: wrong encodings
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_neighbours, p1_recall, p2_found, p2_term_stats, p2_ngrams, p3_found, p3_percentiles, p5_found, p5_pieces, p5_rules, p6_found, p6_groups, p7_found, p7_repaired, p8_ids, p8_decoded, p9_found, p9_leaks, p10_found, p10_restored)
}
