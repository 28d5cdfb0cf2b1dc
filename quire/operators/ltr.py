"""Learning-to-rank data: query generation, labels, cleaning rules, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, letters_only, long_tokens, ngrams, tokens, trim_ws, ws_split
from ..session import stage

#: Stop words of the generator; the cleaner knows the ones below it too.
STOP_WORDS = (
    "the is at which on a an as are was were been be have has had do does did will would could should may might must can "
    "this that these those i you he she it we they what who when where why how all each every both few more most other some such no nor not "
    "only own same so than too very and but or if then for with about into through during before after above below to from up down in out of by"
).split()
MORE_STOP_WORDS = "between among until while per also just being over under".split()
#: Words of a book's apparatus; the regenerator lacks the last five.
METADATA_WORDS = (
    "chapter figure table press editor copyright page publication published isbn edition publisher author volume issue journal proceedings conference university "
    "department acknowledgment preface appendix bibliography references index contents introduction conclusion abstract "
    "acknowledgments dedication foreword prologue epilogue"
).split()
LAST_METADATA = 5

WORDS_LEAST, TOKENS_LEAST = 50, 10


def lit_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def without(words: Column, drop: list[str]) -> Column:
    """The array without the given words, repeats kept."""
    stop = lit_array(drop)
    return F.filter(words, lambda t: ~F.array_contains(stop, t))


def page_terms(pages: DataFrame) -> DataFrame:
    """(page_id, book_id, page_number, t): the tokens queries are made of, of pages with at least WORDS_LEAST words and TOKENS_LEAST such tokens."""
    p = pages.where(F.coalesce("word_count", F.lit(0)) >= WORDS_LEAST).select("page_id", "book_id", "page_number", without(long_tokens("text_content"), STOP_WORDS).alias("t"))
    return p.where(F.size("t") >= TOKENS_LEAST)


def top_ngrams(terms: DataFrame, key: str = "page_id", most: tuple[int, ...] = (15, 10, 5)) -> DataFrame:
    """(key, n, gram, cnt, rank): the most frequent 1-, 2- and 3-grams of each text; ties go to the earlier."""
    rows = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col("t"), n).alias("g")) for n in range(1, len(most) + 1)])
    g = terms.select(key, F.inline(rows)).select(key, "n", F.posexplode("g").alias("pos", "gram"))
    c = g.groupBy(key, "n", "gram").agg(F.count("*").alias("cnt"), F.min("pos").alias("first"))
    w = Window.partitionBy(key, "n").orderBy(F.desc("cnt"), "first")
    limit = F.element_at(F.array(*map(F.lit, most)), F.col("n"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(key, "n", "gram", "cnt", "rank")


def generated_queries(terms: DataFrame, seed: int = 17) -> DataFrame:
    """(page_id, query): three to five queries per page from its frequent n-grams, picked by a seeded hash.

    A query is a mix of two to four frequent words, a bigram, a trigram, or a bigram and a word;
    queries of one word and repeats are left out.
    """
    g = top_ngrams(terms)
    lists = g.groupBy("page_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("n") == n, F.struct("rank", "gram")))), lambda x: x["gram"]).alias(f"g{n}") for n in (1, 2, 3)])
    h = lambda *x: F.xxhash64(F.col("page_id"), F.lit(seed), *x)
    pick = lambda a, *x: F.element_at(F.col(a), (F.pmod(h(*x), F.greatest(F.size(a), F.lit(1))) + 1).cast("int"))
    mixed = lambda i: F.array_join(F.slice(F.transform(F.array_sort(F.transform(F.col("g1"), lambda w: F.struct(F.xxhash64(w, i, F.lit(seed)).alias("o"), w.alias("w")))), lambda x: x["w"]), 1, (F.pmod(h(i, F.lit("n")), F.lit(3)) + 2).cast("int")), " ")
    both = lambda i: F.concat_ws(" ", pick("g2", i, F.lit("b")), pick("g1", i, F.lit("u")))
    kind = lambda i: F.pmod(h(i, F.lit("k")), F.lit(4))
    one = lambda i: F.when((kind(i) == 1) & (F.size("g2") > 0), pick("g2", i, F.lit("b"))).when((kind(i) == 2) & (F.size("g3") > 0), pick("g3", i, F.lit("t"))).when((kind(i) == 3) & (F.size("g2") > 0), both(i)).otherwise(mixed(i))
    n = (F.pmod(h(F.lit("count")), F.lit(3)) + 3).cast("int")
    out = lists.select("page_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n), one))).alias("query"))
    return out.where(F.size(F.split("query", " ")) >= 2)


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct words two arrays have in common."""
    return F.size(F.array_intersect(a, b))


def _cyclic(most: int):
    """Rows of a sorted list of numbers and the queries that ask it, to the first ``most`` numbers from the start of each query on, over the end to the beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, asks = b.column("held"), b.column("asks")
            size = pc.list_value_length(held).to_numpy().astype(np.int64)
            begin = np.r_[0, np.cumsum(size)][:-1]
            row = np.repeat(np.arange(len(asks)), pc.list_value_length(asks).to_numpy())
            ask, i = asks.flatten(), held.flatten().to_numpy()
            # the lists of a batch as one sorted array: the number of the list, then the number in it
            at = np.searchsorted((np.repeat(np.arange(len(size)), size) << 40) + i, (row << 40) + ask.field("first").to_numpy()) - begin[row]
            take = np.minimum(size[row], most)
            k = np.repeat(np.arange(len(row)), take)
            nth = np.arange(len(k)) - np.repeat(np.cumsum(take) - take, take)
            got = i[begin[row][k] + (at[k] + nth) % size[row][k]]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)].astype(np.int32)), pa.array(got))
            yield pa.RecordBatch.from_arrays([ask.field("qid"), lists], ["qid", "met"])

    return run


def labelled(queries: DataFrame, pages: DataFrame, same: int = 4, total: int = 10, seed: int = 17) -> DataFrame:
    """(query, page_id, word_overlap_score, relevance_label, page_text_snippet) of the queries (query, page_id).

    Label 2 is the source page, 1 up to ``same`` pages of its book that share a word with the query,
    0 pages of other books to fill ``total``. Pages are numbered by book and in it by a seeded hash.
    A query has a hashed place among the numbers of its book, and its pages of label 1 are the first
    from there on that share a word: the first in the sorted lists of each of its words are enough to
    know these, so no query meets all pages of a large book. The pages of other books are the
    numbers before and after those of its own, in as many equal parts as pages are missing; one hashed
    number of each part is drawn, so every page can be drawn and none is twice.
    """
    from .sync import numbered

    keys = pages.select("page_id", "book_id", F.xxhash64("page_id", F.lit(seed)).alias("h"))
    ring = numbered(keys, ["book_id", "h", "page_id"], "i").select("page_id", "i")
    snip = trim_ws(F.substring("text_content", 1, 200)).alias("page_text_snippet")
    p = stage(pages.select("page_id", "book_id", F.array_distinct(long_tokens("text_content")).alias("pt"), snip).join(ring, "page_id"))
    # pages without a book are numbered first and are no candidates
    span = p.where("book_id is not null").groupBy("book_id").agg(F.min("i").alias("start"), F.count("*").alias("own"))
    whole = p.agg(F.count("*").alias("n"), F.count("book_id").alias("booked")).first()
    h = lambda *x: F.xxhash64("query", "src", *x, F.lit(seed))
    q = queries.select("query", F.col("page_id").alias("src")).dropDuplicates(["query", "src"]).join(p.select(F.col("page_id").alias("src"), "book_id", F.col("i").alias("own_i")), "src")
    q = q.join(span, "book_id", "left").withColumn("first", F.col("start") + F.pmod(h(F.lit("start")), F.col("own")))
    q = stage(q.withColumn("qid", F.monotonically_increasing_id()))
    asks = q.where("book_id is not null").select("book_id", F.explode(F.array_distinct(long_tokens("query"))).alias("w"), F.struct("qid", "first").alias("a")).groupBy("book_id", "w").agg(F.collect_list("a").alias("asks"))
    held = p.where("book_id is not null").select("book_id", "i", F.explode("pt").alias("w")).groupBy("book_id", "w").agg(F.array_sort(F.collect_list("i")).alias("held"))
    # one more than asked for, as the source page itself is in the lists
    met = asks.join(held, ["book_id", "w"]).select("held", "asks").mapInArrow(_cyclic(same + 1), "qid long, met array<long>").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    ahead = F.transform(F.filter("met", lambda i: i != F.col("own_i")), lambda i: F.struct(F.pmod(i - F.col("first"), F.col("own")).alias("d"), i.alias("i")))
    near = F.transform(F.slice(F.array_sort(ahead), 1, min(same, total - 1)), lambda x: x["i"])
    d = q.join(met, "qid", "left").select("query", "src", "own_i", "start", "own", F.coalesce(near, F.array().cast("array<long>")).alias("near"))
    others = F.lit(whole["booked"]) - F.col("own")
    d = d.withColumn("others", others).withColumn("m", F.least(F.lit(total - 1) - F.size("near"), "others"))
    low = lambda k: F.floor(k * F.col("others") / F.col("m"))
    nth = lambda k: low(k) + F.pmod(h(k), low(k + 1) - low(k)) + F.lit(1 + whole["n"] - whole["booked"])
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda k: bind(nth(k), lambda j: j + F.when(j >= F.col("start"), F.col("own")).otherwise(0)))
    far = F.when(F.col("m") > 0, drawn).otherwise(F.array().cast("array<long>"))
    as_label = lambda a, label: F.transform(a, lambda i: F.struct(F.lit(label).alias("relevance_label"), i.alias("i")))
    rows = d.select("query", "src", F.inline(F.concat(as_label(F.array("own_i"), 2), as_label(F.col("near"), 1), as_label(far, 0))))
    score = overlap(F.array_distinct(long_tokens("query")), F.col("pt")).alias("word_overlap_score")
    return rows.join(p, "i").select("query", F.col("src").alias("source_page_id"), "page_id", "book_id", score, "relevance_label", "page_text_snippet")


def rule(query: Column, score: Column) -> Column:
    """The first rule a training row fails, or valid; digits are sought in the raw query, words in the cleaned one."""
    stop, meta = lit_array(STOP_WORDS + MORE_STOP_WORDS), lit_array(METADATA_WORDS)

    def by_words(w: Column) -> Column:
        stops = F.size(F.filter(w, lambda t: F.array_contains(stop, t)))
        return (
            F.when(score == 0, "zero_overlap")
            .when(query.rlike(r"(?U)\d"), "contains_numbers")
            .when(F.size(w) < 2, "too_few_words")
            .when(F.size(w) > 6, "too_many_words")
            .when(stops / F.size(w) > 0.7, "mostly_stopwords")
            .when(F.arrays_overlap(w, meta), "contains_metadata")
            .otherwise("valid")
        )

    return bind(ws_split(letters_only(query)), by_words)


def removal_reasons(ruled: DataFrame) -> DataFrame:
    """(reason, rows, share) of the rules, share in per cent of all rows."""
    n = ruled.groupBy(F.col("rule").alias("reason")).agg(F.count("*").alias("rows"))
    total = n.agg(F.sum("rows").alias("t"))  # one row
    return n.join(F.broadcast(total)).select("reason", "rows", F.round(F.col("rows") * 100.0 / F.col("t"), 2).alias("share"))


def retention(ruled: DataFrame) -> DataFrame:
    return ruled.agg(F.count("*").alias("original"), F.count_if(F.col("rule") == "valid").alias("kept")).withColumn("retention", F.coalesce(F.round(F.try_divide(F.col("kept") * 100.0, F.col("original")), 2), F.lit(0.0)))


def regenerated_query(snippet: Column) -> Column:
    """The best phrase of a snippet as its query.

    Fewer than 10 characters or two tokens give "unknown topic". Stop and metadata words are taken
    out, of fewer than two words left only stop words, of fewer than two again the first two tokens
    are the query. Phrases are 2- to 4-grams without filter words, not all digits nor all of two
    letters; the most frequent wins, then the longer, then the earlier. Without a phrase the first
    three words are the query.
    """
    stop = STOP_WORDS + MORE_STOP_WORDS
    filters = lit_array(stop + METADATA_WORDS[:-LAST_METADATA])

    def best(words: Column) -> Column:
        def grams(n: int) -> Column:
            return bind(ngrams(words, n), lambda g: F.transform(g, lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("i"), x.alias("g"))))

        ok = lambda x: ~F.arrays_overlap(F.split(x["g"], " "), filters) & ~F.forall(F.split(x["g"], " "), lambda t: t.rlike("^[0-9]+$")) & ~F.forall(F.split(x["g"], " "), lambda t: F.length(t) <= 2)
        ranked = lambda a: F.array_sort(F.transform(a, lambda x: F.struct((-F.size(F.filter(a, lambda y: y["g"] == x["g"]))).alias("c"), (-x["n"]).alias("n"), x["i"].alias("i"), x["g"].alias("g"))))
        found = bind(F.filter(F.concat(grams(2), grams(3), grams(4)), ok), ranked)
        return bind(found, lambda f: F.when(F.size(f) > 0, f[0]["g"]).otherwise(F.array_join(F.slice(words, 1, 3), " ")))

    def choose(t: Column) -> Column:
        strict = without(t, stop + METADATA_WORDS[:-LAST_METADATA])
        loose = without(t, stop)
        words = F.when(F.size(strict) >= 2, strict).otherwise(loose)
        return F.when(F.size(t) < 2, "unknown topic").otherwise(bind(words, lambda w: F.when(F.size(w) < 2, F.array_join(F.slice(t, 1, 2), " ")).otherwise(best(w))))

    return F.when(snippet.isNull() | (F.length(trim_ws(snippet)) < 10), "unknown topic").otherwise(bind(long_tokens(snippet), choose))


def label_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("relevance_label").agg(F.count("*").alias("rows"), F.round(F.avg("word_overlap_score"), 2).alias("avg_overlap"))


def length_distribution(queries: DataFrame) -> DataFrame:
    """(words, queries, share) by the number of words of a query."""
    n = queries.groupBy(F.size(tokens("query")).alias("words")).agg(F.count("*").alias("queries"))
    total = n.agg(F.sum("queries").alias("t"))  # one row
    return n.join(F.broadcast(total)).select("words", "queries", F.round(F.col("queries") * 100.0 / F.col("t"), 2).alias("share"))


def dataset_profile(rows: DataFrame) -> DataFrame:
    """One row of counts and averages of a labelled set."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("query").alias("queries"), F.countDistinct("book_id").alias("books"), F.round(F.avg("word_overlap_score"), 2).alias("avg_overlap"), F.round(F.avg(F.size(F.split("query", " "))), 2).alias("avg_query_words"))


def compare_by_row(before: DataFrame, after: DataFrame, key: str, col: str) -> DataFrame:
    """One row (rows, changed): rows of the same key whose value differs, null-safe."""
    b = after.select(key, F.col(col).alias("_b"))
    return before.select(key, F.col(col).alias("_a")).join(b, key).agg(F.count("*").alias("rows"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))


def dataset_slice(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a stated order, by global row numbers."""
    from .sync import numbered

    return numbered(rows, order, "row_id").where(F.col("row_id") <= n)


def regeneration_report(rows: DataFrame) -> DataFrame:
    """One row (rows, changed, avg_words) of rows (query, new_query)."""
    return rows.agg(F.count("*").alias("rows"), F.count_if(~F.col("query").eqNullSafe(F.col("new_query"))).alias("changed"), F.round(F.avg(F.size(F.split("new_query", " "))), 2).alias("avg_words"))
