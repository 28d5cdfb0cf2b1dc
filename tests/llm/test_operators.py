"""Each operator against a brute-force version or an exact round trip, with nulls, blanks, ties, copies, empty and clashing tables."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.text import tokens
from quire.llm import encoding, garbled, leaks, neardup, neighbours, ngrams, percentiles, pieces, scans

W = lambda t: re.findall("[a-z0-9]+", (t or "").lower())


# 1
def _vectors(n, seed=3):
    r = np.random.default_rng(seed)
    c = r.standard_normal((12, 64))
    return [(i, [float(x) for x in (c[i % 12] + 0.5 * r.standard_normal(64)) * r.uniform(0.2, 4)]) for i in range(n)]


def test_neighbours_recall_and_order(spark):
    rows = _vectors(900)
    ids, u = [i for i, _ in rows], np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:5]}
    d = spark.createDataFrame(rows, "id long, neighbour array<double>")  # a clashing name
    got = neighbours.neighbours(d, "id", "neighbour").collect()
    assert len({(r.id, r.neighbour) for r in got} & want) / len(want) >= 0.9
    assert all(abs(r.sim - s[r.id][r.neighbour]) < 1e-5 for r in got)
    assert Counter(r.id for r in got) == {i: 5 for i in ids}


def test_neighbours_of_least_cosine_in_rounds(spark, monkeypatch):
    # families of 1 to 9 near copies: all pairs of at least the cosine, also where asks go in many rounds and a family is larger than k
    r = np.random.default_rng(8)
    c = r.standard_normal((260, 64))
    u = np.array([c[i] + r.uniform(0.1, 0.6) * r.standard_normal(64) for i in range(260) for _ in range(1 + i % 9)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(u)]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.85}
    monkeypatch.setattr(neighbours, "ROUND_LEAST", 1)
    monkeypatch.setattr(neighbours, "ROUND_EACH", 1)
    seen, real = [], neighbours.stage
    monkeypatch.setattr(neighbours, "stage", lambda d: seen.append(d.columns) or real(d))
    got = neighbours.neighbours(spark.createDataFrame(rows, "c long, v array<double>"), "c", "v", least=0.85).collect()
    assert {(x.id, x.neighbour) for x in got} == want and len(want) > 3000
    assert all(abs(x.sim - s[x.id][x.neighbour]) < 1e-6 for x in got)
    assert seen.count(["q", "id", "sim"]) > 1


def test_neighbours_of_copies_and_unusable_vectors(spark):
    one, two = [1.0] + [0.0] * 63, [0.0] * 63 + [2.0]
    rows = [(i, one) for i in range(40)] + [(100, [3.0 * x for x in one]), (200, two), (200, two), (300, None), (301, [0.0] * 64), (302, one[:63]), (303, [float("nan")] + one[1:]), (304, [None] + one[1:])]
    got = defaultdict(list)
    for r in neighbours.neighbours(spark.createDataFrame(rows, "c long, v array<float>"), "c", "v").orderBy("id", "rank").collect():
        got[r.id].append((r.neighbour, round(r.sim, 5)))
    assert set(got) == {*range(40), 100, 200}
    assert got[0] == [(i, 1.0) for i in (1, 2, 3, 4, 5)] and got[39] == [(i, 1.0) for i in range(5)] and got[100] == [(i, 1.0) for i in range(5)]
    assert [x for x, _ in got[200]] == [0, 1, 2, 3, 4]
    none = spark.createDataFrame([], "c long, v array<float>")
    assert neighbours.neighbours(none, "c", "v").count() == 0
    single = spark.createDataFrame([(1, one)], "c long, v array<float>")
    assert neighbours.neighbours(single, "c", "v").count() == 0


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "CELLS_MOST", 2)
    rows = _vectors(300)
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(-s[i])[:5]}
    got = {(r.id, r.neighbour) for r in neighbours.neighbours(spark.createDataFrame(rows, "c long, v array<double>"), "c", "v").collect()}
    assert len(got & want) / len(want) > 0.9


# 2
def _grams(texts, max_n):
    occ, rec = Counter(), Counter()
    for _, t in texts:
        g = [" ".join(W(t)[i : i + n]) for n in range(1, max_n + 1) for i in range(len(W(t)) - n + 1)]
        occ.update(g)
        rec.update(set(g))
    return {k: (v, rec[k]) for k, v in occ.items()}


@pytest.mark.parametrize("max_n, block", [(1, 4096), (3, 4096), (4, 7), (9, 8)])
def test_ngram_counts(spark, monkeypatch, max_n, block):
    monkeypatch.setattr(ngrams, "BLOCK", block)  # tokens of one record in many groups
    r = random.Random(5)
    texts = [(i % 60, " ".join(r.choice("a b c dd e") for _ in range(r.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "the " * 400)]
    d = spark.createDataFrame(texts, "sfx long, w string").select("sfx", tokens("w").alias("dup"))
    count = lambda d: ngrams.ngram_counts(ngrams.text_tokens(d, "sfx", "dup"), max_n)
    got = [(x.ngram, (x.occurrences, x.records)) for x in count(d).collect()]
    assert len(got) == len(dict(got)) and dict(got) == _grams(texts, max_n)
    assert count(d.limit(0)).count() == 0


def test_ngram_intervals_over_batches_and_partitions(spark):
    texts = [(i, f"same words here {i % 3} and same words there") for i in range(400)]
    d = spark.createDataFrame(texts, "r long, t string").select("r", tokens("t").alias("t"))
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "3")
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = [(x.ngram, (x.occurrences, x.records)) for x in ngrams.ngram_counts(ngrams.text_tokens(d, "r", "t"), 3).collect()]
            assert len(got) == len(dict(got)) and dict(got) == _grams(texts, 3)
    finally:
        spark.conf.set(conf, old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tokens_of_postings(spark):
    rows = [("a b", 1, None, [0, 3]), ("c", 1, 2, [1, 2, 7]), ("d", 1, 3, [4]), ("e", 2, 2, None), ("f", 2, None, None), ("g", 2, 0, [1]), ("c", 2, 1, [])]
    p = spark.createDataFrame(rows, "term string, rec int, tf int, positions array<int>")
    t = ngrams.posting_tokens(p, "rec")
    assert {(x.ngram, x.occurrences, x.records) for x in ngrams.ngram_counts(t, 1).collect()} == {("a b", 2, 1), ("c", 3, 2), ("d", 3, 1), ("e", 2, 1)}
    two = {x.ngram: x.occurrences for x in ngrams.ngram_counts(t, 2).where("n = 2").collect()}
    assert two == {"a b c": 1, "c c": 1, "c a b": 1, "a b d": 1}


# 3
@pytest.mark.parametrize("kind", ["int", "double"])
def test_percentiles(spark, kind):
    r = random.Random(1)
    vals = [(f"2019-01-{1 + i % 9:02d}", r.choice([0, 5, -7, r.randrange(-(10**6), 10**6)]) * (1 if kind == "int" else 0.37)) for i in range(4000)]
    vals += [(None, vals[0][1]), ("2019-01-01", None)] + ([("2019-01-01", float("nan"))] if kind == "double" else [])
    d = spark.createDataFrame(vals, f"p string, key {kind}").select(F.to_date("p").alias("base"), "key")
    pcts = spark.createDataFrame([(0,), (50,), (99,), (100,), (None,)], "pct int")
    cal = percentiles.calendar(d.select("base").distinct())
    by = defaultdict(list)
    week = {x.base.isoformat(): x.period for x in cal.where("grain = 'week'").collect() if x.base}
    assert week["2019-01-01"] == "2019-W01" and week["2019-01-07"] == "2019-W02"
    for p, v in vals:
        if p and v is not None and v == v:
            by[p].append(v)
            by[week[p]].append(v)
    # the histograms of two parts, merged, are those of the whole
    part = F.xxhash64("key") % 2 == 0
    days = percentiles.merged(percentiles.histograms(d.where(part), "base", "key"), percentiles.histograms(d.where(~part), "base", "key"))
    assert days.count() == percentiles.histograms(d, "base", "key").count()
    got = {(x.period, x.pct): x.value for x in percentiles.radix_percentiles(days, cal, pcts, double=kind == "double").collect()}
    want = {(p, q): sorted(v)[max(1, -(-q * len(v) // 100)) - 1] for p, v in by.items() for q in (0, 50, 99, 100)}
    assert got == want
    assert percentiles.radix_percentiles(days.limit(0), cal, pcts).count() == 0


# 5
@given(st.text(alphabet=st.sampled_from("ab .\n\r!界́"), max_size=900), st.integers(20, 60))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text(text, limit):
    cut = pieces.pieces(text, limit, 8, 10)
    assert all(e - s <= limit for s, e in cut)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    whole, last = "", 0
    for s, e in cut:
        assert last - 8 <= s <= last and e > last or not text
        whole += text[last:e]
        last = e
    assert whole == text


def test_pieces_end_at_natural_boundaries_and_edits_stay_local():
    r = random.Random(2)
    text = "\n\n".join(" ".join(" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)) + "." for _ in range(6)) for _ in range(60))
    cut = pieces.pieces(text)
    assert all(text[: e].endswith("\n\n") for _, e in cut[:-1])
    edited = text[:9000] + "inserted words here " + text[9000:]
    a = {text[s:e] for s, e in cut}
    b = {edited[s:e] for s, e in pieces.pieces(edited)}
    assert len(a - b) <= 4
    assert [e - s for s, e in pieces.pieces("x" * 10000)][0] <= pieces.LIMIT
    long = "word " * 400_000
    assert "".join(long[max(s, 0) : e][0:0] for s, e in pieces.pieces(long)) == "" and pieces.pieces(long)[-1][1] == len(long)


def test_split_leaves_short_and_null_texts_out(spark):
    d = spark.createDataFrame([("page", "1", "x" * 2400), ("page", "2", None), ("page", "3", ""), ("chunk", "4", "word " * 600)], "kind string, item_id string, text string").withColumn("piece", F.lit(1))
    rows = pieces.split_oversized(d).orderBy("piece").collect()
    assert {r.item_id for r in rows} == {"4"} and [r.piece for r in rows] == [1, 2]
    assert "".join(r.text[r.fresh :] for r in rows) == "word " * 600


# 6
def _edit(r, words, k):
    w = list(words)
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice("one two three four five six".split())
    return w


def test_similar_sets_equal_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(60)] for _ in range(25)]
    texts = {f"{i}_{k}": " ".join(_edit(r, b, k * 3)) for i, b in enumerate(base) for k in range(5)}
    texts |= {f"copy{i}": texts["0_0"] for i in range(6)} | {"short": "a b c", "rot": " ".join(base[1][20:] + base[1][:20])}
    s = {k: frozenset(zip(W(t), W(t)[1:], W(t)[2:])) for k, t in texts.items() if len(W(t)) >= 30}
    want = {(a, b) for a in s for b in s if a < b and 2 * len(s[a] & s[b]) >= len(s[a] | s[b])}
    d = spark.createDataFrame([*texts.items(), ("null", None), ("blank", "  "), ("0_0", texts["0_0"])], "h string, n string")
    members, links = neardup.similar_sets(d, "h", "n")
    assert {(x.a, x.b) for x in neardup.similar_pairs(members, links).collect()} == want
    groups = defaultdict(set)
    for x in members.join(neardup.components(members, links), "rid").collect():
        groups[x.cls].add(x.key)
    direct = defaultdict(set)
    for x in neardup.groups(d, "h", "n").collect():
        direct[x.group_id].add(x.key)
    assert {frozenset(g) for g in direct.values()} == {frozenset(g) for g in groups.values()} and all(min(g) == k for k, g in direct.items())
    parent = {k: k for k in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[find(a)] = find(b)
    truth = defaultdict(set)
    for k in s:
        truth[find(k)].add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in truth.values()}
    m, x = neardup.similar_sets(d.limit(0), "h", "n")
    assert neardup.similar_pairs(m, x).count() == 0
    assert neardup.groups(d.limit(0), "h", "n").count() == 0


def test_sets_that_differ_too_much_do_not_travel(spark, monkeypatch):
    # texts put together from common sentences, some with a near copy of another length: unlike pairs must not get as far as the comparison
    r = random.Random(5)
    pool = [" ".join(f"w{r.randrange(900)}" for _ in range(6)) for _ in range(400)]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(10, 30))) for _ in range(250)]
    texts += [" ".join(_edit(r, W(t), 8)) + " " + " ".join(r.sample(pool, i % 9)) for i, t in enumerate(texts[:80])]
    s = [frozenset(zip(W(t), W(t)[1:], W(t)[2:])) for t in texts]
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if 2 * len(s[i] & s[j]) >= len(s[i] | s[j])}
    seen, real = [], neardup.verified
    monkeypatch.setattr(neardup, "PASS_ROWS", 4000)
    monkeypatch.setattr(neardup, "verified", lambda pairs, p: seen.append(pairs.count()) or real(pairs, p))
    got = neardup.similar_pairs(*neardup.similar_sets(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t"))
    assert {(x.a, x.b) for x in got.collect()} == want and len(want) > 50
    assert seen[0] < 3 * len(want)


def test_a_large_family_has_few_links(spark, monkeypatch):
    r = random.Random(7)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(_edit(r, base, 4))) for i in range(400)] + [(1000 + i, " ".join(f"v{r.randrange(500)}" for _ in range(100))) for i in range(50)]
    d = spark.createDataFrame(rows, "id long, t string")
    seen, real = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, p: seen.append(pairs.count()) or real(pairs, p))
    got = {x.key: (x.group_id, x.size) for x in neardup.groups(d, "id", "t").collect()}
    assert all(got[i] == (0, 400) for i in range(400)) and all(got[1000 + i] == (1000 + i, 1) for i in range(50))
    assert sum(seen) < 400 * 30  # of 79,800 pairs


def test_components_of_a_long_chain(spark):
    m = spark.range(200).select(F.col("id").alias("rid"))
    e = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.cls for r in neardup.components(m, e).collect()} == {0}


def test_components_of_a_shuffled_chain(spark):
    ids = random.Random(11).sample(range(-(10**12), 10**12), 501)
    m = spark.createDataFrame([(i,) for i in ids], "rid long")
    e = spark.createDataFrame([(min(x), max(x)) for x in zip(ids[:500], ids[1:500])], "a long, b long")
    assert {r.rid: r.cls for r in neardup.components(m, e).collect()} == {i: min(ids[:500]) for i in ids[:500]} | {ids[500]: ids[500]}


# 7
def test_page_repair(spark):
    r = random.Random(6)
    nouns = "theorem editor margin kernel vector buffer pattern segment ledger window".split()
    say = lambda: f"Every {r.choice(nouns)} bounds the {r.choice(nouns)} and the well-known {r.choice(nouns)} follows it."
    rows, books = [], [(1, "A Course in Kernels"), (2, None), (None, "x")]
    for n in range(1, 61):
        rows.append((f"1_{n}", 1, n, str(n), "\n".join([f"A COURSE IN KERNELS | {n}" if n % 2 else "Sparse Vectors", say(), say(), say(), f"- {n} -"])))
    rows += [
        ("h", 2, 7, "vii", "Every theorem bounds the vec­\ntor and the ker-\nnel follows the well-\nknown editor.\nvii"),
        ("m", 2, 8, "8", "Every the0rem bounds the thcorem and the wind0w, as exercise 2nd and O(n2) show.\n\n250"),
        ("clean", 2, 9, "9", say() + "\n" + say()),
        ("blank", 2, 10, None, "  \n "),
        ("null", 2, 11, None, None),
        ("lost", None, None, None, say()),
    ]
    p = spark.createDataFrame(rows, "page_id string, book_id int, page_number int, display_page_number string, text_content string").withColumn("kinds", F.lit(1))
    got = {x.page_id: x for x in scans.repair_pages(p, spark.createDataFrame(books, "book_id int, title string")).collect()}
    assert set(got) == {r[0] for r in rows} - {"null"}
    assert all(got[f"1_{n}"].kinds == ["header", "page_no"] for n in range(1, 61))
    assert "KERNELS" not in got["1_1"].text and "- 1 -" not in got["1_1"].text
    assert got["h"].kinds == ["hyphen", "page_no"] and got["h"].text == "Every theorem bounds the vector and the kernel follows the well-known editor."
    assert got["m"].kinds == ["misread"] and "theorem bounds the theorem and the window, as exercise 2nd and O(n2) show." in got["m"].text
    assert got["clean"].kinds == [] and got["blank"].kinds == [] and got["blank"].text == "" and got["lost"].kinds == []
    assert scans.repair_pages(p.limit(0), spark.createDataFrame([], "book_id int, title string")).count() == 0


def _alike(spark, words):
    """The words, and vectors of one direction for all of them."""
    d = spark.createDataFrame(words, "w string, df long")
    return d, d.select("w", F.array(*[F.lit(1.0).cast("float")] * scans.VECTOR).alias("v"))


def test_vectors_decide_what_a_word_may_be(spark):
    words = [("links", 400), ("hnks", 20), ("linear", 300), ("hnear", 3)]
    d, same = _alike(spark, words)
    read = lambda v: {r.w: r.cands for r in scans.misread_words(d, v).collect()}
    assert read(same) == {"hnks": ["links"], "hnear": ["linear"]}
    assert read(same.limit(0)) == {}
    turned = same.withColumn("v", F.when(F.col("w") == "hnks", F.transform("v", lambda x: -x)).otherwise(F.col("v")))
    assert read(turned) == {"hnear": ["linear"]}


def test_context_chooses_among_candidates(spark):
    r = random.Random(12)
    one = lambda w: f"they {r.choice(['often', 'never'])} {w} quickly before {r.choice(['noon', 'dusk'])}"
    two = lambda w: f"some {r.choice(['red', 'blue'])} {w} lies under {r.choice(['stone', 'water'])}"
    rows = [(f"a{n}", one("tace")) for n in range(60)] + [(f"b{n}", two("face")) for n in range(55)] + [("x", one("f@ce")), ("y", two("t@ce"))]
    p = spark.createDataFrame([(i, n, n, None, f"{t} number {n}") for n, (i, t) in enumerate(rows)], "page_id string, book_id int, page_number int, display_page_number string, text_content string")
    got = {x.page_id: x for x in scans.repair_pages(p, spark.createDataFrame([], "book_id int, title string")).collect()}
    assert got["x"].kinds == got["y"].kinds == ["misread"] and " tace " in got["x"].text and " face " in got["y"].text


def test_long_words_and_lines(spark):
    word = "pneumono" * 5 + "coniosis"  # 48 letters
    bad, code = word.replace("coniosis", "c0niosis"), "QmFzZTY0IGlz0IG5vIHRleHQgYXQgYWxsIGhlcmU5"
    rows = [(f"p{n}", n, n, None, f"The {word} is named {n}.") for n in range(30)] + [("bad", 90, 90, None, f"The {bad} is named."), ("code", 91, 91, None, f"The name is\n{code}\nnamed."), ("alone", 92, 92, None, f"The\n{word}\nis.")]
    p = spark.createDataFrame(rows, "page_id string, book_id int, page_number int, display_page_number string, text_content string")
    got = {x.page_id: x for x in scans.repair_pages(p, spark.createDataFrame([], "book_id int, title string")).collect()}
    assert got["bad"].kinds == ["misread"] and word in got["bad"].text
    assert got["code"].kinds == [] and code in got["code"].text and got["alone"].text == f"The {word} is."


def test_misread_words_at_any_frequency(spark):
    words = [("links", 400), ("hnks", 20), ("linear", 300), ("hnear", 3), ("substring", 90), ("substrmg", 9), ("minimal", 80), ("miriimal", 5), ("the", 5000), ("heap", 200), ("stack", 60), ("limit", 50), ("linits", 40)]
    got = {r.w: r.cands[0] for r in scans.misread_words(*_alike(spark, words)).collect()}
    assert got == {"hnks": "links", "hnear": "linear", "substrmg": "substring", "miriimal": "minimal"}


def test_letter_model_has_all_frequent_words(spark, monkeypatch):
    """Beyond MODEL_WORDS the words are joined instead of handed to the tasks, with the same outcome."""
    common = "information computation relation nation station formation rotation notation equation motion linear matrix vector kernel measure element moment limit number".split()
    known = [(a + b, 40 + len(b)) for a in ("inter", "super", "under") for b in common] + [(w, 30) for w in common]
    odd = [(w, 1) for w in "c0mp0siti0n 1nter@ti0n supcrrnctrix hypcrmatr1x rnonument unclermornent f0rrnati0nal quiz zzz9zz".split()]
    d, v = _alike(spark, known + odd)
    read = lambda: {r.w: r.cands for r in scans.misread_words(d, v).collect() if not r.vecs}
    whole = read()
    assert len(whole) >= 3
    monkeypatch.setattr(scans, "MODEL_WORDS", 5)
    assert read() == whole


def test_all_likely_words_of_a_glyph_key_are_candidates(spark):
    words = [("face", 100), ("tace", 90), ("faee", 80), ("taee", 70), ("taec", 3), ("f@ce", 1)]
    got = {r.w: r.cands for r in scans.misread_words(*_alike(spark, words)).collect()}
    assert got["f@ce"] == ["face", "tace", "faee", "taee"]


def test_copies_of_a_page_do_not_make_its_misreadings_frequent(spark):
    r = random.Random(9)
    say = lambda: " ".join(r.choice("every theorem bounds the vector and kernel".split()) for _ in range(25))
    rows = [(f"p{n}", 1, n, None, say()) for n in range(60)] + [(f"c{n}", 1, 100 + n, None, "every thcorem bounds the kernel.") for n in range(30)]
    p = spark.createDataFrame(rows, "page_id string, book_id int, page_number int, display_page_number string, text_content string")
    got = {x.page_id: x for x in scans.repair_pages(p, spark.createDataFrame([], "book_id int, title string")).collect()}
    assert all(got[f"c{n}"].kinds == ["misread"] and got[f"c{n}"].text == "every theorem bounds the kernel." for n in range(30))
    assert all(got[f"p{n}"].kinds == [] for n in range(60))


@pytest.mark.parametrize("line, page, yes", [("12", 12, True), ("13", 12, False), ("- 7 -", 12, True), ("Page 3 of 900", 12, True), ("p. 12", 12, True), ("[12]", 12, True), ("xii", 12, True), ("l2", 12, True), ("12.", 12, False), ("12  40", 12, False), ("heap", 12, False)])
def test_page_numbers(line, page, yes):
    assert scans._is_number(line, page, None) == yes


# 8
@pytest.mark.skipif(not os.path.exists(f"{encoding.FOLDER}/{encoding.RANKS}"), reason="no vocabulary")
def test_encoding_round_trip(spark):
    import tiktoken

    import quire.llm.encoding as e

    texts = ["", None, "  ", "It's the end\n\n  of 12345 días — 漢字 🙂🙂\t\r\n", "a" * 5000, "<|endoftext|>", "\x1c\x85  x", " the the the" * 300, "naïvé ²³ ½ Ⅷ"]
    d = spark.createDataFrame(list(enumerate(texts)), "w long, ids string")
    enc = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=e.ranks(f"{e.FOLDER}/{e.RANKS}"), special_tokens={})
    got = e.encode(d, "w", "ids")
    assert {r.w: r.ids for r in got.collect()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.w: r.text for r in e.decode(got, "w").collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert e.encode(d.limit(0), "w", "ids").count() == 0
    rule = "-" * 65  # hot, and too long for the broadcast
    hot = spark.createDataFrame([(i, f"{rule} {i}" if i % 3 else None) for i in range(60)], "w long, ids string")
    assert {r.w: r.ids for r in e.encode(hot, "w", "ids").collect()} == {i: enc.encode_ordinary(f"{rule} {i}") if i % 3 else [] for i in range(60)}


# 9
@pytest.mark.parametrize("span, gram", [(10, 7), (10, 10), (6, 3)])
def test_leaks_equal_brute_force(spark, span, gram):
    r = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    tests = [(i, text(r.randrange(0, 40))) for i in range(30)] + [(30, None), (31, ""), (32, "same " * 20)]
    train = [(i, text(30) + " " + (" ".join(W(tests[i % 30][1])[: r.randrange(0, 20)])) + " " + text(20)) for i in range(80)] + [(80, None), (81, "the same same " + "same, " * 12), (5, tests[3][1])]
    g = lambda t: {tuple(W(t)[i : i + span]) for i in range(len(W(t)) - span + 1)}
    want = {(i, j) for i, a in train for j, b in tests if g(a) & g(b)}
    got = leaks.leaks(spark.createDataFrame(train, "h long, pos string"), spark.createDataFrame(tests, "pos_b long, w string"), "h", "pos", "pos_b", "w", span, gram).collect()
    assert {(x.h, x.pos_b) for x in got} == want and len(got) == len(want)
    assert all(0 < x.share <= 1 and x.words >= span for x in got)


# 10
CLEAN = ["Die Übersicht zählt die Häufigkeit der Wörter für große Bestände", "La mémoire découpe la dernière étape où cela paraît évident", "Читатель проверяет последний столбец и порядок томов в памяти", "Le nœud père répète l’hypothèse générale dès le début", "É a coleção que não altera os órgãos de cópia", "SÃO TRÊS VISÕES DA COLEÇÃO"]


def test_garbled_texts(spark):
    rows = [(i, CLEAN[i % len(CLEAN)] + f" {i}.") for i in range(240)] + [(900, None), (901, ""), (902, "What? No! x?y=1 plain ASCII")]
    bad, n = {}, 1000
    for t in CLEAN[:4]:
        for w, r in (("utf-8", "cp1252"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp1251", "latin-1")):
            try:
                g = t.encode(w).decode(r)
            except UnicodeError:
                continue
            if g != t:
                for k in range(3):
                    bad[n] = (g + f" {n}.", t + f" {n}.")
                    n += 1
    bad[n] = ("La m�moire d�coupe la derni�re �tape.", "La mémoire découpe la dernière étape.")
    bad[n + 1] = ("La m?moire d?coupe la derni?re ?tape o? cela", None)
    d = spark.createDataFrame(rows + [(k, g) for k, (g, _) in bad.items()], "w long, back string")
    assert {r.w for r in garbled.garbled(d, "w", "back").collect()} == set(bad)
    got = {r.w: r.back for r in garbled.restore(d, "w", "back").collect()}
    right = sum(got[k] == t for k, (_, t) in bad.items() if t)
    assert set(got) == set(bad) and right >= 0.9 * len(bad)
    assert garbled.garbled(d.limit(0), "w", "back").count() == 0


def test_all_character_pairs_count(spark, monkeypatch):
    """Beyond PAIRS_MOST the pairs are joined to the words instead of handed to the tasks, with the same outcome."""
    words = "ağaç şekil ışık gülüş çağrı öğüt sığır düğüm kışın güneş üşüdü çiçeği başım yağış İzmir Şubat".split()
    r = random.Random(3)
    lines = [" ".join(r.choice(words) for _ in range(9)) + f" satir {i}" for i in range(300)]
    bad = [(1000 + i, lines[i].encode("cp1254").decode("latin-1")) for i in range(24)]
    d = spark.createDataFrame(list(enumerate(lines)) + bad, "w long, back string")
    whole = {r.w: r.back for r in garbled.restore(d, "w", "back").collect()}
    assert len(whole) == 24
    monkeypatch.setattr(garbled, "PAIRS_MOST", 5)
    assert {r.w: r.back for r in garbled.restore(d, "w", "back").collect()} == whole


@pytest.mark.parametrize("near", [False, True])
def test_garbled_text_that_holds_most_rows(spark, near):
    rows = [(i, CLEAN[i % len(CLEAN)] + f" {i}.") for i in range(60)]
    wrong = CLEAN[0].encode().decode("cp1252")
    bad = [(1000 + i, wrong + (f" {i}." if near else ".")) for i in range(600)]
    d = spark.createDataFrame(rows + bad, "w long, back string")
    assert {r.w for r in garbled.garbled(d, "w", "back").collect()} == {k for k, _ in bad}
    got = {r.w: r.back for r in garbled.restore(d, "w", "back").collect()}
    assert all(got[k].startswith(CLEAN[0]) for k, _ in bad)


def _byte_table(read):
    known = garbled.single_bytes()[read]
    return {**{chr(b): b for b in range(128, 160)}, **{c: b + 128 for b, c in enumerate(known) if c}}


@given(st.text(max_size=30), st.sampled_from(["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "koi8_r", "cp866", "cp1254"]))
@settings(max_examples=200, deadline=None)
def test_undo_of_utf8(text, read):
    table = {b: c for c, b in _byte_table(read).items()}
    table |= {b: chr(b) for b in range(128, 256) if b not in table}
    wrong = "".join(chr(b) if b < 128 else table[b] for b in text.encode("utf-8", "ignore"))
    clean = text.encode("utf-8", "ignore").decode()
    full = garbled.Table("bytes", {c: b for b, c in table.items()})
    assert (full.undo(wrong) or wrong) == clean


def test_mappings_come_from_aligned_twins(spark):
    say = lambda i: f"Über größere Bäume läuft stets ähnlich schöne Prüfung Nummer {i % 7}"
    texts = spark.createDataFrame([(say(i),) for i in range(7)] + [(say(i).encode("mac_roman").decode("cp1254"),) for i in range(7)] + [(say(i).encode().decode("cp1252"),) for i in range(7)], "t string")
    words = texts.select(F.explode(F.split("t", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    pairs = {(r.form, r.clean) for r in garbled.twins(texts, words).collect()}
    assert pairs and all(c in " ".join(say(i) for i in range(7)) and c != f for f, c in pairs)
    made = garbled.tables(garbled.twins(texts, words).mapInArrow(garbled._mappings, "kind string, names string, u string, c string, u2 string, c2 string, n long"))
    assert {t.kind for t in made} == {"bytes", "chars"}
    clean = say(1)
    assert any(t.undo(clean.encode().decode("cp1252")) == clean for t in made)
    assert any(t.undo("Bäume".encode("mac_roman").decode("cp1254")) == "Bäume" for t in made)


# encodings outside any list of ours: Turkish and Icelandic letters read as other ones, and one that no encoding explains
@pytest.mark.parametrize("written, read", [("cp1254", "latin-1"), ("iso8859_9", "cp437"), ("cp1254", None)])
def test_any_encoding_is_learned(spark, written, read):
    words = "ağaç şekil ışık gülüş çağrı öğüt sığır düğüm kışın güneş üşüdü çiçeği başım yağış İzmir Şubat".split()
    own = str.maketrans("ğşıöüçİŞ", "γσιφυχΙΣ")  # a mapping of our own
    garble = lambda t: t.encode(written).decode(read) if read else t.translate(own)
    r = random.Random(3)
    lines = [" ".join(r.choice(words) for _ in range(9)) + f" satir {i}" for i in range(300)]
    bad = {1000 + i: (garble(lines[i]), lines[i]) for i in range(24)}
    d = spark.createDataFrame(list(enumerate(lines)) + [(k, g) for k, (g, _) in bad.items()], "w long, back string")
    assert {x.w for x in garbled.garbled(d, "w", "back").collect()} == set(bad)
    got = {x.w: x.back for x in garbled.restore(d, "w", "back").collect()}
    assert sum(got[k] == t for k, (_, t) in bad.items()) >= 22


def test_long_words_and_repeated_misreadings(spark):
    long = "längere-" * 40  # 320 characters without a blank
    lines = [f"Die {long}Übung zählt für große Bäume stets Nummer {i}" for i in range(40)]
    twice = lambda t: t.encode().decode("cp1252").encode().decode("cp1252")
    bad = {100 + i: lines[i].encode().decode("cp1252") for i in range(6)} | {200 + i: twice(lines[i].replace("Ü", "ü")) for i in range(6)}
    d = spark.createDataFrame(list(enumerate(lines)) + list(bad.items()), "w long, back string")
    got = {x.w: x.back for x in garbled.restore(d, "w", "back").collect()}
    assert set(got) == set(bad) and all(got[100 + i] == lines[i] and got[200 + i] == lines[i].replace("Ü", "ü") for i in range(6))


def test_nothing_outside_imports_this_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for at, _, names in os.walk(os.path.join(root, "quire")):
        if os.sep + "llm" not in at:
            for f in names:
                if f.endswith(".py"):
                    assert not re.search(r"(import|from)\b.*\bllm\b", open(os.path.join(at, f), encoding="utf-8").read())
