"""Pages and chunks built from text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bind, or_default, ws_split

LEAST, MOST, TARGET = 200, 300, 250


def chunk_sizes(words: Column) -> Column:
    """Word counts of the chunks of a text of so many words, in the closed form of the default sizes; empty for none."""
    k = F.greatest(F.lit(0), F.floor((words - LEAST) / TARGET)).cast("int")
    r = (words - TARGET * k).cast("int")
    tail = F.when(r >= 2 * LEAST, F.array(r - LEAST, F.lit(LEAST))).otherwise(F.array(r))
    return F.when(words <= 0, F.array().cast("array<int>")).otherwise(F.concat(F.array_repeat(F.lit(TARGET), k), tail))


def chunk_pages(pages: DataFrame, size_of=chunk_sizes) -> DataFrame:
    """(chunk_id, book_id, page_id, page_number, chunk_index, chunk_text, word_count, char_count) of pages with words.

    Chunks are numbered from 1 and hold whole words joined by single blanks. Null and blank texts
    give no chunk.
    """
    def cut(w: Column) -> Column:
        return bind(F.col("sizes"), lambda s: F.transform(s, lambda n, i: F.array_join(F.slice(w, F.aggregate(F.slice(s, 1, i), F.lit(0), lambda a, x: a + x) + 1, n), " ")))

    p = pages.where("text_content is not null").select("book_id", "page_id", "page_number", "text_content", size_of(F.size(ws_split("text_content"))).alias("sizes"))
    p = p.select("book_id", "page_id", "page_number", F.posexplode(bind(ws_split("text_content"), cut)).alias("i", "chunk_text"))
    return p.select(F.concat_ws("_", "page_id", (F.col("i") + 1).cast("string")).alias("chunk_id"), "book_id", "page_id", "page_number", (F.col("i") + 1).alias("chunk_index"), "chunk_text", F.size(F.split("chunk_text", " ")).alias("word_count"), F.length("chunk_text").alias("char_count"))


def sizes_for(words: int, least: int, most: int, target: int) -> list[int]:
    """Chunk sizes for any parameters: heads of ``target`` words while a whole chunk of ``least`` remains, a short rest joins the last.

    The last head takes no more than leaves a rest of at least ``least``; where that is impossible
    the rest is one chunk.
    """
    out, left = [], words
    while left > 0:
        if left <= most:
            return [*out, left]
        head = min(target, most, max(least, left - least))
        if left - head < least:
            return [*out, left]
        out.append(head)
        left -= head
    return out


def chunk_sizes_for(least: int, most: int, target: int):
    """``chunk_sizes`` for other parameters, as a vectorised function."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda n: sizes_for(int(n), least, most, target))

    return run


def page_rows(df: DataFrame) -> DataFrame:
    """Page rows from (book_id, page_number, text_content): ids and counts as the page builder makes them."""
    n = F.size(ws_split(F.coalesce("text_content", F.lit(""))))
    return df.select(F.concat_ws("_", "book_id", "page_number").alias("page_id"), "book_id", "page_number", F.col("page_number").cast("string").alias("display_page_number"), "text_content", n.alias("word_count"), F.length(F.coalesce("text_content", F.lit(""))).alias("char_count"), n.alias("token_count"))


def book_rows(df: DataFrame) -> DataFrame:
    """Book rows with the builder's defaults: Untitled, title.pdf, book_001.pdf."""
    title = or_default("title", "Untitled")
    return df.select("book_id", title.alias("title"), or_default("domain", "Library").alias("domain"), F.coalesce(F.nullif("file_name", F.lit("")), F.concat(title, F.lit(".pdf"))).alias("file_name"), F.format_string("book_%03d.pdf", "book_id").alias("stored_file_name"), "num_pages")


def library_path(path: Column, root: str = "library/books") -> Column:
    """A stored path below ``root``: backslashes turned, a leading ``root`` or ``books`` taken off, doubled slashes closed; null for an empty path."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), f"^({root}|books)/", "")
    return F.when(F.length(F.coalesce(path, F.lit(""))) > 0, F.replace(F.concat(F.lit(f"{root}/"), p), F.lit("//"), F.lit("/")))


def uploads(files: DataFrame, first_id: int = 1) -> DataFrame:
    """Book rows of uploaded files (path, length): ids from ``first_id`` in path order, stored names, sizes in MB."""
    from .sync import numbered

    n = numbered(files.select("path", "length"), ["path"])
    name = F.element_at(F.split("path", "/"), -1)
    book = (F.col("row_id") + first_id - 1).cast("int")
    return n.select(book.alias("book_id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), name.alias("file_name"), F.format_string("book_%03d.pdf", book).alias("stored_file_name"), F.round(F.col("length") / 1048576.0, 2).alias("file_size_mb"), F.lit("uploaded").alias("status"))
