"""Catalogue synchronisation, status reports, page details."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_default, trim_ws


def upsert(manifest: DataFrame, incoming: DataFrame, key: str, stamp: str | None = None) -> DataFrame:
    """The manifest with the incoming rows laid over it, and ``change``: new, updated, same or kept.

    Rows are compared over all common columns but ``stamp``, null-safe. Rows missing from
    ``incoming`` are kept: a sync never deletes. Incoming rows without a key are skipped.
    """
    cols = [c for c in incoming.columns if c != key]
    a = manifest.select(key, F.struct(*cols).alias("old"), F.lit(True).alias("was"))
    b = incoming.where(F.col(key).isNotNull()).select(key, F.struct(*cols).alias("new"), F.lit(True).alias("comes"))
    seen = [c for c in cols if c != stamp]
    same = F.struct(*[F.col(f"old.{c}") for c in seen]).eqNullSafe(F.struct(*[F.col(f"new.{c}") for c in seen]))
    change = F.when(F.col("comes").isNull(), "kept").when(F.col("was").isNull(), "new").when(same, "same").otherwise("updated")
    pick = lambda c: F.when(F.col("comes"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return a.join(b, key, "full_outer").select(key, *[pick(c) for c in cols], change.alias("change"))


def sync_summary(upserted: DataFrame) -> DataFrame:
    """One row (new, updated, total); total counts incoming rows."""
    c = F.col("change")
    return upserted.agg(F.count_if(c == "new").alias("new"), F.count_if(c == "updated").alias("updated"), F.count_if(c != "kept").alias("total"))


def status_histogram(books: DataFrame) -> DataFrame:
    """(status, books) of processed, uploaded, indexed and other; null is other."""
    s = F.when(F.col("status").isin("processed", "uploaded", "indexed"), F.col("status")).otherwise("other")
    return books.groupBy(s.alias("status")).agg(F.count("*").alias("books"))


def patch(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keyed update: values of ``changes`` that are not null replace those of ``df``; other rows stay."""
    cols = [c for c in changes.columns if c != key]
    x = df.join(changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols]), key, "left")
    return x.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def backfill(df: DataFrame, defaults: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """Nulls of the named columns filled (missing columns added), and a row (scanned, updated)."""
    have = df.select(*df.columns, *[F.lit(None).cast("string").alias(c) for c in defaults if c not in df.columns])
    lacks = F.lit(False)
    for c in defaults:
        lacks = lacks | F.col(c).isNull()
    return have.fillna(defaults), have.agg(F.count("*").alias("scanned"), F.count_if(lacks).alias("updated"))


def resolve_titles(pages: DataFrame, index_titles: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, page_number, title): the index's title, else the catalogue's, else Unknown, trimmed; blank and "unknown" do not count."""
    real = lambda c: F.when(~F.lower(trim_ws(c)).isin("", "unknown"), trim_ws(c))
    i = index_titles.select("book_id", F.col("title").alias("t1"))
    b = books.select("book_id", F.col("title").alias("t2"))
    return pages.join(i, "book_id", "left").join(b, "book_id", "left").select("book_id", "page_number", F.coalesce(real("t1"), real("t2"), F.lit("Unknown")).alias("title"))


def book_list(books: DataFrame, limit: int = 100, newest: bool = False) -> DataFrame:
    """The first ``limit`` books by book_id, descending with ``newest``; books without an id come last."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1 and 500")
    return books.orderBy(F.desc_nulls_last("book_id") if newest else F.asc_nulls_last("book_id")).limit(limit)


def page_list(pages: DataFrame, book: int) -> DataFrame:
    """(page_id, page_number, position): the pages of a book in the order of their numbers, ties by page_id, unnumbered ones last."""
    w = Window.partitionBy("book_id").orderBy(F.asc_nulls_last("page_number"), "page_id")  # one book's pages
    return pages.where(F.col("book_id") == book).select("page_id", "page_number", F.row_number().over(w).cast("long").alias("position"))


def page_with_book(pages: DataFrame, books: DataFrame) -> DataFrame:
    """Pages with a nested ``book``: six nullable fields, null fields where the catalogue lacks the book."""
    b = books.select("book_id", F.struct("book_id", "title", "author", "year", "domain", "num_pages").alias("book"))
    return pages.join(b, "book_id", "left")


def book_dim(books: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, title, domain, n_pages): catalogue titles with defaults and the pages that are there."""
    n = pages.groupBy("book_id").agg(F.count("*").alias("n"))
    return books.join(n, "book_id", "left").select("book_id", or_default("title", "Unknown").alias("title"), or_default("domain", "Library").alias("domain"), F.coalesce("n", F.lit(0)).alias("n_pages"))


def numbered(df: DataFrame, order: list[str], out: str = "row_id") -> DataFrame:
    """Global 1-based numbers in the given order without a single task for all rows.

    Rows are range-partitioned, counted per partition, and numbered within it from the sum of the
    counts before. The frame is written to the shared folder first: both passes must see the same
    partitions.
    """
    from ..session import cut

    d = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = d.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("_f")).select("_p", "_f", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_b"))
    return d.join(F.broadcast(base), "_p").withColumn(out, (F.col("_m") - F.col("_f") + F.col("_b") + 1).cast("long")).drop("_p", "_m", "_f", "_b")
