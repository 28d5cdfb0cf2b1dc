"""Re-ranking features, fusion of lexical and vector scores, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, ngrams, tokens, trim_ws
from ..session import small, stage
from .lexical import DOC, QUERY_ROWS, bm25, expansions, query_tokens, top_per_query, weighted_terms

PHRASE_WEIGHT, PROXIMITY_WEIGHT, PROXIMITY_WINDOW, NGRAM_MOST = 8.0, 2.5, 20, 2.4
SHORT_QUERY, MEDIUM_QUERY = 3, 8
SNIPPET = 220


def term_positions(cands: DataFrame, qt: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, book_id, page_number, pos): for each query token in order its positions in the page, empty where absent.

    Only postings of query terms leave the scan: the terms are broadcast where they are few.
    """
    ask = qt.select("query_id", F.posexplode("qt").alias("ord", "term"))
    hit = postings.select("term", *DOC, "positions").join(small(ask.select("term").distinct(), QUERY_ROWS), "term", "left_semi")
    met = cands.select("query_id", *DOC).join(ask, "query_id").join(hit, ["term", *DOC], "left")
    entry = F.struct("ord", F.coalesce("positions", F.array().cast("array<int>")).alias("p"))
    return met.groupBy("query_id", *DOC).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["p"]).alias("pos"))


def phrase_hits(pos: Column) -> Column:
    """Starts s with every query token i at s + i; 0 for fewer than two tokens or an absent one."""
    every = lambda s: F.forall(F.sequence(F.lit(0), F.size(pos) - 1), lambda i: F.array_contains(pos[i], (s + i).cast("int")))
    return F.when(F.size(pos) < 2, 0).otherwise(F.size(F.filter(pos[0], every)))


def ordered_span(pos: Column) -> Column:
    """Least span of the query tokens in order, each the next after the one before; null where impossible or for one token."""
    step = lambda at, p: F.array_min(F.filter(p, lambda x: x > at))
    one = lambda s: F.aggregate(F.slice(pos, 2, F.size(pos)), s, step, lambda e: e - s + 1)
    return F.when(F.size(pos) >= 2, F.array_min(F.transform(pos[0], one)))


def proximity_boost(hits: Column, span: Column, q: Column) -> Column:
    """Phrase and proximity boost; 0 for queries of fewer than two tokens, no proximity without a span."""
    near = PROXIMITY_WEIGHT * F.least(F.lit(1.0), q / F.greatest(q, span))
    tight = F.greatest(F.lit(0.0), 1 - (span - q) / F.greatest(F.lit(1), PROXIMITY_WINDOW - q))
    part = F.when(span.isNull(), 0.0).otherwise(near + F.when(span <= PROXIMITY_WINDOW, tight).otherwise(0.0))
    return F.when(q < 2, 0.0).otherwise(PHRASE_WEIGHT * F.least(hits, F.lit(3)) + part)


def term_coverage(terms: Column, lower_text: Column) -> Column:
    """Share of the distinct terms that occur in the text as substrings; 0 without terms."""
    return bind(F.array_distinct(terms), lambda t: F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.filter(t, lambda w: F.contains(lower_text, w))) / F.size(t)))


def ngram_boost(terms: Column, lower_text: Column) -> Column:
    """NGRAM_MOST times the weighted share of the query's 3-grams (1.8) and 2-grams (1.0) that stand in the text."""
    ft = F.filter(terms, lambda t: F.length(t) >= 3)
    grams = bind(ft, lambda t: F.struct(F.array_distinct(ngrams(t, 2)).alias("two"), F.array_distinct(ngrams(t, 3)).alias("three")))

    def share(g: Column) -> Column:
        hit = lambda a: F.size(F.filter(a, lambda x: F.contains(lower_text, x)))
        whole = F.size(g["two"]) * 1.0 + F.size(g["three"]) * 1.8
        return F.when(F.size(g["two"]) == 0, 0.0).otherwise(F.least(F.lit(NGRAM_MOST), NGRAM_MOST * (hit(g["two"]) * 1.0 + hit(g["three"]) * 1.8) / whole))

    return bind(grams, share)


def weights(q: Column) -> tuple[Column, Column, Column]:
    """Lexical, semantic and exact weight by the number of query tokens."""
    by = lambda a, b, c: F.when(q <= SHORT_QUERY, a).when(q <= MEDIUM_QUERY, b).otherwise(c)
    return by(0.70, 0.55, 0.45), by(0.20, 0.30, 0.35), by(0.10, 0.15, 0.20)


def snippet(text: Column, terms: Column, hint: Column | None = None, most: int = SNIPPET) -> Column:
    """A window around the first query term, in query order, that occurs; else the hint, else the head of the text."""
    low = F.lower(text)
    at = F.element_at(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0), 1)
    start = F.greatest(F.lit(0), at - 1 - most // 2)
    end = F.least(F.length(text), start + most)
    window = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    cut = lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit("...")))
    rest = cut(text) if hint is None else F.when(F.length(trim_ws(F.coalesce(hint, F.lit("")))) > 0, cut(trim_ws(hint))).otherwise(cut(text))
    return F.when(F.exists(terms, lambda t: F.contains(low, t)), window).otherwise(rest)


def features(cands: DataFrame, queries: DataFrame, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds to candidates (query_id, book_id, page_number, ...) the re-ranking features; pages with empty text are dropped."""
    qt = query_tokens(queries)
    x = cands.join(term_positions(cands, qt, postings), ["query_id", *DOC], "left").join(docs.select(*DOC, "page_id", "text_content"), DOC).where("text_content <> ''")
    x = x.join(qt, "query_id").join(expansions(qt), "query_id").withColumn("low", F.lower("text_content")).withColumn("q", F.size("qt"))
    x = x.withColumn("hits", phrase_hits(F.col("pos"))).withColumn("span", ordered_span(F.col("pos")))
    return x.withColumn("proximity", proximity_boost(F.col("hits"), F.col("span"), F.col("q"))).withColumn("ngram", ngram_boost(F.col("qt"), F.col("low"))).withColumn("exact", term_coverage(F.col("qt"), F.col("low"))).withColumn("expanded", term_coverage(F.col("ex"), F.col("low"))).drop("low", "pos")


def hybrid(queries: DataFrame, postings: DataFrame, docs: DataFrame, semantic: DataFrame | None = None, top_k: int = 10) -> DataFrame:
    """(query_id, rank, book_id, page_number, page_id, score, lexical, semantic, snippet): the fused ranking.

    ``semantic`` (query_id, book_id, page_number, semantic, hint) has the page scores of the vector
    side; without it the ranking is lexical only. Candidates are the best max(250, 25 k) pages by
    BM25 and all rows of ``semantic``. Blank queries give no row; ties rank by book and page.
    """
    qt = query_tokens(queries)
    lex = top_per_query(bm25(weighted_terms(qt), postings, docs), "bm25", max(250, 25 * top_k)).select("query_id", *DOC, "bm25")
    none = F.lit(None).cast("string")
    if semantic is None:
        cands = lex.withColumn("semantic", F.lit(0.0)).withColumn("hint", none)
    else:
        asked = semantic.join(qt.select("query_id"), "query_id", "left_semi")
        cands = lex.join(asked, ["query_id", *DOC], "full_outer").withColumns({"bm25": F.coalesce("bm25", F.lit(0.0)), "semantic": F.coalesce("semantic", F.lit(0.0))})
    # the candidates, a bounded number for each query, are read twice
    x = features(stage(cands), queries, postings, docs).withColumn("lexical", F.round(F.col("bm25") + F.col("proximity") + F.col("ngram"), 9))
    per = Window.partitionBy("query_id")
    top = lambda c: bind(F.max(c).over(per), lambda m: F.when(m > 0, m).otherwise(1.0))
    x = x.withColumn("lex_n", F.col("lexical") / top("lexical")).withColumn("sem_n", F.col("semantic") / top("semantic"))
    wl, ws, we = weights(F.col("q"))
    wx = F.when(F.size("ex") > 0, 0.15).otherwise(0.0)
    score = wl * F.col("lex_n") + ws * F.col("sem_n") * (0.6 + 0.4 * F.col("exact")) + we * F.col("exact") + wx * F.col("expanded")
    x = x.withColumn("final", F.round(score, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc("lexical"), *DOC)
    best = x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return best.select("query_id", "rank", *DOC, "page_id", F.round("final", 6).alias("score"), F.round("lexical", 6).alias("lexical"), F.round("semantic", 6).alias("semantic"), snippet(F.col("text_content"), F.col("qt"), F.col("hint")).alias("snippet"))
