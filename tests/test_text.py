import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import chunking, ltr

QUERY_RULES = [("binary trees", 0, "zero_overlap"), ("top 10 trees", 3, "contains_numbers"), ("trees", 3, "too_few_words"), ("one two three four five six seven", 3, "too_many_words"), ("the of and", 3, "mostly_stopwords"), ("binary chapter", 3, "contains_metadata"), ("binary trees", 3, "valid")]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert one(spark, "İstanbul K-9 naïve ÉCOLE", t.tokens) == ["i", "stanbul", "k", "9", "na", "ve", "cole"]
    assert one(spark, "", t.tokens) == [] and one(spark, None, t.tokens) is None


def test_white_space(spark):
    assert one(spark, " \x1c a b \n", t.trim_ws) == "a b"
    assert one(spark, "  a b \n", t.ws_split) == ["a", "b"]


def test_sentences(spark):
    assert one(spark, "A b.  C d? E", t.sentences) == ["A b.", "C d?", "E"]
    assert one(spark, "   ", t.sentences) == []
    assert one(spark, "A. B. C. D.", lambda c: t.first_sentences(c, 2)) == "A. B."
    assert one(spark, "abc   def", lambda c: t.truncate(c, 6)) == "abc\n\n[Truncated]"


@pytest.mark.parametrize("words, sizes", [(0, []), (1, [1]), (300, [300]), (399, [399]), (400, [200, 200]), (420, [220, 200]), (449, [249, 200]), (450, [250, 200]), (650, [250, 200, 200]), (1000, [250] * 4)])
def test_chunk_sizes(spark, words, sizes):
    assert one(spark, words, chunking.chunk_sizes, "int") == sizes
    assert chunking.sizes_for(words, 200, 300, 250) == sizes


def test_general_sizes_agree_with_the_closed_form(spark):
    got = spark.range(0, 3000).select(F.col("id").cast("int").alias("n"), chunking.chunk_sizes(F.col("id").cast("int")).alias("s")).collect()
    assert all(r.s == chunking.sizes_for(r.n, 200, 300, 250) and sum(r.s) == r.n for r in got)


def test_chunks_of_dirty_pages(spark):
    p = spark.createDataFrame([(1, "1_1", 1, None), (1, "1_2", 2, "  "), (1, "1_3", 3, " ".join(["w"] * 420))], "book_id int, page_id string, page_number int, text_content string")
    rows = chunking.chunk_pages(p).collect()
    assert [(r.chunk_id, r.word_count) for r in rows] == [("1_3_1", 220), ("1_3_2", 200)]
    small = chunking.chunk_pages(p, chunking.chunk_sizes_for(10, 30, 20)).collect()
    assert sum(r.word_count for r in small) == 420 and max(r.word_count for r in small) <= 39


def test_rules(spark):
    d = spark.createDataFrame(QUERY_RULES, "q string, s int, want string").select("want", ltr.rule(F.col("q"), F.col("s")).alias("got"))
    assert all(r.want == r.got for r in d.collect())


def test_regenerated_queries(spark):
    f = ltr.regenerated_query
    assert one(spark, None, f) == "unknown topic" and one(spark, "short", f) == "unknown topic"
    assert one(spark, "binary trees and binary trees of figure chapter", f) == "binary trees"
    assert one(spark, "the binary heap. the binary heap", f).startswith("binary heap")
    assert one(spark, "page index chapter", f) == "page index chapter"


def test_word_lists():
    assert (len(set(ltr.STOP_WORDS)), len(set(ltr.STOP_WORDS + ltr.MORE_STOP_WORDS)), len(set(ltr.METADATA_WORDS))) == (87, 97, 35)
