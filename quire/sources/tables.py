"""Parquet sources of the library and the rules that make their dirty rows usable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_ws


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one of ``schema`` where nothing can be read."""
    try:
        found = spark.read.parquet(path)
    except Exception:
        return spark.createDataFrame([], schema)
    have = set(found.columns)
    empty = spark.createDataFrame([], schema)
    return found.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])


def once(df: DataFrame, *key: str) -> DataFrame:
    """One row per key: the earliest by created_at where there is one, else any by content order.

    A null key is a key like any other. Rows of one key are reduced before the shuffle, so a key
    that holds a third of the table costs one partial row per task.
    """
    rest = [c for c in df.columns if c not in key]
    lead = ["created_at"] if "created_at" in rest else []
    order = F.struct(*[F.col(c).isNull() for c in lead], *lead, *[c for c in rest if c not in lead])
    return df.groupBy(*key).agg(F.min(order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def pages(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Pages, each page_id once, with the named columns only (all where none is named)."""
    df = table(spark, sf_dir, "pages")
    return once(df.select("page_id", *[c for c in cols if c != "page_id"]) if cols else df, "page_id")


def logs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = table(spark, sf_dir, "search_logs")
    return once(df.select("log_id", *[c for c in cols if c != "log_id"]) if cols else df, "log_id")


def indexable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a book and text that is not blank: the documents of the lexical index."""
    p = pages(spark, sf_dir, "book_id", "page_number", "display_page_number", "text_content")
    return p.where(F.col("book_id").isNotNull() & (F.length(trim_ws("text_content")) > 0))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with normalised terms, each (term, book_id, page_number) once.

    Terms are trimmed and lower-cased, null and blank ones left out; tf falls back to the number
    of positions. Where rows of one key differ, the larger tf holds.
    """
    p = table(spark, sf_dir, "postings").select(F.lower(trim_ws("term")).alias("term"), "book_id", "page_number", F.coalesce("tf", F.size("positions")).cast("long").alias("tf"), "positions")
    p = p.where(F.col("term") != "")
    return p.groupBy("term", "book_id", "page_number").agg(F.max("tf").alias("tf"), F.max("positions").alias("positions"))
