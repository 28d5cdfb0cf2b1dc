"""Positional inverted index and BM25 ranking of any number of queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import small

K1, B, EXPANSION_WEIGHT = 1.5, 0.75, 0.55
DOC = ["book_id", "page_number"]
#: Query terms up to which the query side of the index join is broadcast.
QUERY_ROWS = 100_000

#: Alternates of query terms, in order.
SYNONYMS = {
    "limitations": ["limitation", "limited"],
    "limitation": ["limitations", "limited"],
    "datasets": ["dataset", "data"],
    "dataset": ["datasets", "data"],
    "using": ["use"],
    "different": ["any", "varied"],
    "fixed": ["static"],
}


def build_docs(pages: DataFrame) -> DataFrame:
    """(book_id, page_number, page_id, display_page_number, text_content, dl): a document per page, also of 0 tokens."""
    return pages.select(*DOC, "page_id", "display_page_number", "text_content", F.size(tokens("text_content")).alias("dl"))


def token_positions(pages: DataFrame) -> DataFrame:
    """(book_id, page_number, term, pos) with 0-based token offsets; a page without tokens gives no row."""
    return pages.select(*DOC, F.posexplode(tokens("text_content")).alias("pos", "term")).select(*DOC, "term", "pos")


def build_postings(pages: DataFrame) -> DataFrame:
    """(term, book_id, page_number, tf, positions), positions ascending."""
    return token_positions(pages).groupBy("term", *DOC).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions")).select("term", *DOC, "tf", "positions")


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row (n_docs, sum_dl, avg_dl); documents without tokens count."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("sum_dl"), F.avg("dl").alias("avg_dl"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, qt): the tokens of each query, repeats kept; queries without tokens are left out."""
    return queries.select("query_id", tokens("query").alias("qt")).where(F.size("qt") > 0)


def synonym_table(spark: SparkSession) -> DataFrame:
    """(term, alt, ord) of the constant map."""
    return spark.createDataFrame([(t, a, i) for t, alts in SYNONYMS.items() for i, a in enumerate(alts)], "term string, alt string, ord int")


def expansions(qt: DataFrame) -> DataFrame:
    """(query_id, ex): alternates of the query terms, in order, without query terms and repeats."""
    m = F.create_map(*[x for t, alts in SYNONYMS.items() for x in (F.lit(t), F.array(*map(F.lit, alts)))])
    alts = F.flatten(F.transform("qt", lambda t: F.coalesce(F.element_at(m, t), F.array().cast("array<string>"))))
    return qt.select("query_id", F.array_except(alts, F.col("qt")).alias("ex"))


def weighted_terms(qt: DataFrame) -> DataFrame:
    """(query_id, term, weight): query terms with 1 per occurrence, expansions with EXPANSION_WEIGHT, summed."""
    own = qt.select("query_id", F.explode("qt").alias("term"), F.lit(1.0).alias("w"))
    other = expansions(qt).select("query_id", F.explode("ex").alias("term"), F.lit(EXPANSION_WEIGHT).alias("w"))
    return own.unionByName(other).groupBy("query_id", "term").agg(F.sum("w").alias("weight"))


def bm25(terms: DataFrame, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, book_id, page_number, bm25) of the documents that hold a term of the query.

    The query side is pre-aggregated and, where a count proves it small, broadcast to the postings,
    so only postings of query terms go on; their df comes from the same rows.
    """
    asked = small(terms, QUERY_ROWS)
    stats = corpus_stats(docs).first()
    hit = postings.select("term", *DOC, "tf").join(small(terms.select("term").distinct(), QUERY_ROWS), "term", "left_semi")
    idf = document_frequency(hit).select("term", F.log((F.lit(stats.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats.avg_dl or 1.0)))
    scored = hit.join(small(idf, QUERY_ROWS), "term").join(docs.select(*DOC, "dl"), DOC).select("term", *DOC, (F.col("idf") * norm).alias("s"))
    return scored.join(asked, "term").groupBy("query_id", *DOC).agg(F.round(F.sum(F.col("weight") * F.col("s")), 9).alias("bm25"))


def top_per_query(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows of each query, ties by book and page: only k rows a query leave each task."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), *DOC)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def remove_books(index: DataFrame, books: DataFrame) -> DataFrame:
    """An index table (docs or postings) without the rows of the given books."""
    return index.join(small(books.select("book_id").distinct(), QUERY_ROWS), "book_id", "left_anti").select(*index.columns)


def add_pages(docs: DataFrame, postings: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with all books of ``pages`` replaced by these pages."""
    books = pages.select("book_id")
    return remove_books(docs, books).unionByName(build_docs(pages)), remove_books(postings, books).unionByName(build_postings(pages))


def index_counters(pages: DataFrame, books: DataFrame, blank) -> DataFrame:
    """One row (indexed_books, indexed_pages, empty_pages, unique_terms): books with no page count too."""
    p = pages.where("book_id is not null").agg(F.count_if(~blank).alias("indexed_pages"), F.count_if(blank).alias("empty_pages"))
    t = build_postings(pages.where(F.col("book_id").isNotNull() & ~blank)).agg(F.countDistinct("term").alias("unique_terms"))
    return books.agg(F.countDistinct("book_id").alias("indexed_books")).join(p).join(t)  # one row each
