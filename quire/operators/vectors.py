"""Exact and clustered vector search, pooled to pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small, stage

#: Exact below so many vectors; beyond, clusters: floor(sqrt(n)) of them, within these bounds.
EXACT_BELOW, CLUSTERS_LEAST, CLUSTERS_MOST = 10_000, 64, 4096
#: Rows of the sample on which the coarse clusters are fitted; query rows up to which queries are broadcast.
TRAIN_ROWS, QUERY_ROWS = 5000, 10_000
#: Queries and chunks of a block.
BLOCK = 8192


def inner(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column, dim: int) -> Column:
    """Not null, of ``dim`` finite numbers, not all zero."""
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def unit(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(inner(d, d)))


def unit_chunks(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """Chunks with usable vectors as unit vectors, each chunk_id once."""
    c = chunks.where(usable(F.col("embedding"), dim)).select("chunk_id", "book_id", "page_number", "chunk_text", unit(F.col("embedding")).alias("vec"))
    keep = F.min(F.struct("book_id", "page_number", "chunk_text", "vec")).alias("r")
    return c.groupBy("chunk_id").agg(keep).select("chunk_id", "r.*")


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _block(k: int | None):
    """Of the queries and the chunks of one block the scores, of each query the k best, ties by the smaller chunk_id."""
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        if not len(queries) or not len(chunks):
            return schema.empty_table()
        ids = chunks.column("chunk_id").to_numpy()
        order = np.argsort(ids)
        x, ids, out = _matrix(chunks.column("vec"))[order], ids[order], []
        for q, v in zip(queries.column("query_id").to_numpy(), _matrix(queries.column("qvec"))):
            s = np.round(x @ v, 9)
            at = np.argsort(-s, kind="stable")[:k]
            out.append(pa.table([pa.array(np.full(len(at), q)), pa.array(ids[at]), pa.array(s[at])], schema=schema))
        return pa.concat_tables(out)

    return run


def scores(queries: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, chunk fields, score) of each query vector (query_id, qvec) against all chunks, or of its k best.

    Queries and chunks meet in blocks of about BLOCK of either, so neither side is broadcast and no
    task gets all of one; with ``k`` only so many rows of a query leave a block. An empty side gives
    no row.
    """
    chunks = chunks if getattr(chunks, "_quire_staged", False) else stage(chunks)
    queries = stage(queries.select(F.col("query_id").cast("long").alias("query_id"), "qvec"))
    ni, nj = max(1, -(-chunks.count() // BLOCK)), max(1, -(-queries.count() // BLOCK))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = queries.select("query_id", "qvec", part("query_id", nj).alias("j"), every(ni).alias("i"))
    b = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "vec", part("chunk_id", ni).alias("i"), every(nj).alias("j"))
    met = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(_block(k), "query_id long, chunk_id long, score double")
    if k is not None and ni > 1:
        met = top_chunks(met, k).drop("rank")
    return met.join(chunks.drop("vec"), "chunk_id")


def top_chunks(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def page_max(scored: DataFrame) -> DataFrame:
    """(query_id, book_id, page_number, semantic, hint): best positive chunk of each page; ties go to the smaller chunk_id."""
    best = F.max_by(F.struct("chunk_id", "chunk_text"), F.struct("score", -F.col("chunk_id"))).alias("b")
    return scored.where("score > 0 and book_id is not null and page_number is not null").groupBy("query_id", "book_id", "page_number").agg(F.max("score").alias("semantic"), best).select("query_id", "book_id", "page_number", "semantic", F.col("b.chunk_id").alias("chunk_id"), F.col("b.chunk_text").alias("hint"))


def top_pages(pages: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "book_id", "page_number")
    return pages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def restricted(pages: DataFrame, scored: DataFrame) -> DataFrame:
    """(query_id, book_id, page_number, semantic) of the given pages, 0 where no chunk scores above 0."""
    best = page_max(scored).select("query_id", "book_id", "page_number", "semantic")
    return pages.join(best, ["query_id", "book_id", "page_number"], "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))


def clusters(n: int) -> int:
    return max(CLUSTERS_LEAST, min(CLUSTERS_MOST, int(n**0.5)))


def clustered_search(chunks: DataFrame, queries: DataFrame, k: int, cells: int, probes: int, seed: int = 7) -> DataFrame:
    """Top k chunks of each query among the chunks of its ``probes`` nearest cells.

    The cells are fitted on at most TRAIN_ROWS chunks in hash order; every chunk is indexed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = chunks.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(TRAIN_ROWS).select(array_to_vector("vec").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample)
    placed = model.transform(chunks.select("chunk_id", array_to_vector("vec").alias("features"))).select("chunk_id", F.col("prediction").alias("cell"))
    # at most CLUSTERS_MOST centres, and the stated queries
    cell = chunks.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, center array<double>")
    far = F.aggregate(F.zip_with("qvec", "center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("query_id").orderBy("d", "cell")
    probed = queries.join(F.broadcast(cell)).select("query_id", "qvec", "cell", far.alias("d")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= probes).drop("d", "r")
    met = chunks.join(placed, "chunk_id").join(small(probed, QUERY_ROWS * 16), "cell").withColumn("score", F.round(inner(F.col("vec"), F.col("qvec")), 9)).drop("vec", "qvec", "cell")
    return top_chunks(met, k)


def probes_for(cells: int) -> int:
    """Cells that are looked into: a quarter, 16 at least, so that recall does not fall as cells grow."""
    return min(cells, max(16, -(-cells // 4)))


def search(chunks: DataFrame, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Top k chunks of each query: exact for fewer than EXACT_BELOW chunks, by cells beyond."""
    n = chunks.count()
    return top_chunks(scores(queries, chunks, k), k) if n < EXACT_BELOW else clustered_search(chunks, queries, k, clusters(n), probes or probes_for(clusters(n)))


def build(pages: DataFrame, titles: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> tuple[DataFrame, DataFrame]:
    """Chunk vectors of all pages, and a row (chunks, pages, outcome).

    chunk_id counts from 1 in the order of book, page and chunk. The outcome is "built", or why
    there is nothing to build: "no text", "no chunks".
    """
    from .chunking import chunk_pages
    from .sync import numbered, resolve_titles

    chunks = chunk_pages(pages)
    ids = numbered(chunks.select("book_id", "page_number", "chunk_index", "chunk_text"), ["book_id", "page_number", "chunk_index"], "chunk_id")
    names = resolve_titles(ids.select("book_id", "page_number").distinct(), titles.select("book_id", "title"), titles).select("book_id", "page_number", F.col("title").alias("book_name"))
    out = embed(ids.join(names, ["book_id", "page_number"], "left"), "chunk_text", "embedding", load).select("chunk_id", "book_id", "book_name", "page_number", "chunk_index", "chunk_text", "embedding")
    n = ids.agg(F.count("*").alias("chunks"), F.countDistinct("book_id", "page_number").alias("pages")).join(pages.agg(F.count_if(F.length(F.coalesce("text_content", F.lit(""))) > 0).alias("texts")))
    return out, n.select("chunks", "pages", F.when(F.col("texts") == 0, "no text").when(F.col("chunks") == 0, "no chunks").otherwise("built").alias("outcome"))


def embed(df: DataFrame, text: str, out: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """Adds vectors of a text column by a model that ``load`` makes once per worker; null texts are embedded as ''."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for p in parts:
            yield pd.Series([list(map(float, v)) for v in model(p.fillna("").tolist())])

    return df.withColumn(out, run(F.col(text)))
