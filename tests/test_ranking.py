"""The micro corpus: values computed from the formulas by hand-checked scratch code."""

import pytest
from pyspark.sql import functions as F

from quire.operators import lexical, ranking

PAGES = [
    (1, 1, "Binary search trees. A binary search tree stores keys in order."),
    (1, 2, "Search the binary file; then search again. Tree of limits!"),
    (1, 3, "!!! ---"),
    (2, 1, "Dynamic programming solves overlapping sub-problems."),
    (2, 3, "Binary trees and\nsearch trees: the limitation of binary search."),
]
# query: {page: (bm25, hits, span, proximity, ngram, exact, expanded, lexical, final)}
WANTED = {
    "binary search tree": {"1_1": (2.049978, 1, 3, 11.5, 2.4, 1.0, 0.0, 15.949978, 0.8), "1_2": (1.913219, 0, 6, 2.073529, 0.0, 1.0, 0.0, 3.986748, 0.274967), "2_3": (1.38372, 0, None, 0.0, 1.263158, 1.0, 0.0, 2.646878, 0.216164)},
    "binary binary": {"1_1": (1.331744, 0, 5, 1.833333, 0.0, 1.0, 0.0, 3.165078, 0.8), "2_3": (1.38372, 0, 9, 1.166667, 0.0, 1.0, 0.0, 2.550387, 0.664053), "1_2": (0.930822, 0, None, 0.0, 0.0, 1.0, 0.0, 0.930822, 0.305864)},
    "limitations": {"2_3": (0.658369, 0, None, 0.0, 0.0, 0.0, 0.5, 0.658369, 0.775)},
    "search": {"1_2": (0.69186, 0, None, 0.0, 0.0, 1.0, 0.0, 0.69186, 0.8), "2_3": (0.69186, 0, None, 0.0, 0.0, 1.0, 0.0, 0.69186, 0.8), "1_1": (0.665872, 0, None, 0.0, 0.0, 1.0, 0.0, 0.665872, 0.773706)},
}


@pytest.fixture(scope="module")
def index(spark):
    p = spark.createDataFrame(PAGES, "book_id int, page_number int, text_content string").withColumn("page_id", F.concat_ws("_", "book_id", "page_number")).withColumn("display_page_number", F.col("page_number").cast("string"))
    return p, lexical.build_docs(p), lexical.build_postings(p)


def test_features_and_scores(spark, index):
    _, docs, postings = index
    q = spark.createDataFrame(list(enumerate(WANTED)), "query_id long, query string")
    cands = lexical.top_per_query(lexical.bm25(lexical.weighted_terms(lexical.query_tokens(q)), postings, docs), "bm25", 250).drop("rank")
    got = {(r.query_id, r.page_id): r for r in ranking.features(cands, q, postings, docs).collect()}
    final = {(r.query_id, r.page_id): r for r in ranking.hybrid(q, postings, docs).collect()}
    assert len(got) == sum(map(len, WANTED.values())) == len(final)
    for i, pages in enumerate(WANTED.values()):
        for page, (bm25, hits, span, prox, ngram, exact, expanded, lex, score) in pages.items():
            r = got[i, page]
            assert (r.hits, r.span) == (hits, span)
            assert [r.bm25, r.proximity, r.ngram, r.exact, r.expanded] == pytest.approx([bm25, prox, ngram, exact, expanded], abs=1e-5)
            assert [final[i, page].lexical, final[i, page].score] == pytest.approx([lex, score], abs=1e-5)
    tie = sorted((r.rank, r.page_id) for r in final.values() if r.query_id == 3)
    assert [p for _, p in tie] == ["1_2", "2_3", "1_1"]


def test_semantic_side_only_adds(spark, index):
    _, docs, postings = index
    q = spark.createDataFrame([(0, "search"), (1, "  "), (2, None)], "query_id long, query string")
    sem = spark.createDataFrame([(0, 2, 1, 0.9, "a hint"), (1, 2, 1, 0.9, "x")], "query_id long, book_id int, page_number int, semantic double, hint string")
    rows = ranking.hybrid(q, postings, docs, sem).collect()
    assert {r.query_id for r in rows} == {0} and len(rows) == 4
    only = next(r for r in rows if r.page_id == "2_1")
    assert only.lexical == 0 and only.score == pytest.approx(0.2 * 0.6) and only.snippet == "a hint"


def test_stats_count_pages_without_tokens(index):
    _, docs, _ = index
    r = lexical.corpus_stats(docs).first()
    assert (r.n_docs, r.avg_dl) == (5, 7.4)


def test_empty_tables(spark, index):
    p, docs, postings = index
    none = p.limit(0)
    assert lexical.build_postings(none).count() == 0
    assert lexical.corpus_stats(lexical.build_docs(none)).first().n_docs == 0
    q = spark.createDataFrame([(0, "search")], "query_id long, query string")
    assert ranking.hybrid(q, postings.limit(0), docs.limit(0)).count() == 0
    assert ranking.hybrid(q.limit(0), postings, docs).count() == 0


def test_remove_and_add_again_is_a_full_build(index):
    p, docs, postings = index
    d, t = lexical.add_pages(docs, postings, p.where("book_id = 1"))
    assert sorted(map(str, t.collect())) == sorted(map(str, postings.collect()))
    assert sorted(map(str, d.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_weights_and_snippet(spark):
    d = spark.createDataFrame([("x" * 300 + " needle " + "y" * 300, ["needle"]), ("short", ["absent"]), ("", ["a"])], "t string, q array<string>")
    s = [r[0] for r in d.select(ranking.snippet(F.col("t"), F.col("q"))).collect()]
    assert s[0].startswith("...") and s[0].endswith("...") and "needle" in s[0] and len(s[0]) == 226
    assert s[1:] == ["short", ""]
