import datetime as dt
import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from quire import session
from quire.operators import logs, ltr, skew, sync, vectors
from quire.session import small, spread, stage
from quire.sources import files, store
from quire.sources.tables import once, read_or_empty


def test_salted_aggregate_equals_group_by(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("n"), F.when(F.col("id") % 11 != 0, F.col("id")).alias("v"), "id", F.lit("x").alias("salt"))
    got = skew.salted_aggregate(d, "n", {"rows": ("count", "*"), "vs": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "mean": ("avg", "v")}, salt_by="id")
    want = d.groupBy("n").agg(F.count("*"), F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
    assert skew.heavy_keys(d, "n", 10) == [7]
    assert skew.salted_aggregate(d.limit(0), "n", {"rows": ("count", "*")}).count() == 0


def test_salted_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    other = spark.createDataFrame([(1, "a"), (1, "b"), (4, "c"), (None, "d")], "k long, s string")
    for how in ("inner", "left"):
        got, want = skew.salted_join(big, other, "k", "id", how=how), big.join(other, "k", how)
        assert sorted(map(str, got.select("k", "id", "s").collect())) == sorted(map(str, want.select("k", "id", "s").collect()))


def test_join_on_several_heavy_keys(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 90).alias("k"), (F.col("id") % 2).alias("m"), "id")
    other = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (4, 0, "c"), (None, 1, "d")], "k long, m long, s string")
    for how in ("inner", "left"):
        for most in (0, 100):  # beyond the bound and within it
            got, want = skew.checked_join(big, other, ["k", "m"], "id", most, how), big.join(other, ["k", "m"], how)
            assert sorted(map(str, got.select("k", "m", "id", "s").collect())) == sorted(map(str, want.select("k", "m", "id", "s").collect()))
    kept, want = skew.checked_join(big, other.drop("s"), ["k", "m"], "id", 0, "left_anti"), big.join(other, ["k", "m"], "left_anti")
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in want.collect())


def test_heavy_keys_of_a_sample(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLE_ROWS", 500)
    d = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("k"))
    assert skew.heavy_keys(d, "k", 10) == [-1]


def test_distinct_and_first_rows_of_heavy_keys(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 40).alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 100).alias("v"), "id")
    got = skew.salted_aggregate(d, "k", {"vs": ("distinct", "v"), "rows": ("count", "*")}, salt_by="v")
    want = d.groupBy("k").agg(F.countDistinct("v").alias("vs"), F.count("*").alias("rows"))
    assert sorted(map(str, got.select("k", "vs", "rows").collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        skew.salted_aggregate(d, "k", {"vs": ("distinct", "v")}, salt_by="id")
    rows = {}
    for r in sorted(d.collect(), key=lambda r: (-(r.v if r.v is not None else -1), r.id)):
        rows.setdefault(r.k, []).append(r.id)
    top = {}
    for r in skew.salted_top(d, "k", [F.desc_nulls_last("v"), F.col("id")], 3, 4).collect():
        top.setdefault(r.k, set()).add(r.id)
    assert top == {k: set(x[:3]) for k, x in rows.items()}
    assert skew.salted_top(d.limit(0), "k", [F.col("id")], 3).count() == 0


def test_shares_leave_null_keys_out(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 2), ("d", None)], "page_id string, book_id int")
    assert {r.book_id: (r.n, round(r.share, 3)) for r in skew.key_shares(d, "book_id", "page_id").collect()} == {1: (2, 0.667), 2: (1, 0.333)}


def test_once_takes_the_earliest(spark):
    d = spark.createDataFrame([("a", None, 1), ("a", dt.datetime(2020, 1, 2), 2), ("a", dt.datetime(2020, 1, 1), 3), (None, None, 4)], "k string, created_at timestamp, v int")
    assert {r.k: r.v for r in once(d, "k").collect()} == {"a": 3, None: 4}


def test_small_is_a_checked_broadcast(spark):
    d = spark.range(100)
    hint = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in x._jdf.queryExecution().analyzed().toString()
    assert hint(small(d, 100)) and not hint(small(d, 99))
    kept = stage(d)
    assert kept.count() == 100


def _jobs(spark, run):
    """How many jobs ``run`` starts."""
    sc = spark.sparkContext
    sc.setJobGroup(g := f"jobs-{id(run)}", "")
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup(g))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_spread_runs_nothing_while_it_plans(spark):
    d = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    assert _jobs(spark, lambda: spread(d, "k")) == 0 and spread(d, "k").rdd.getNumPartitions() == 4
    assert _jobs(spark, lambda: spread(spark.range(3), "id").collect()) > 0


def test_small_runs_its_plan_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert small(spark.range(100).mapInArrow(count, "id long"), 1000).count() == 100 and seen.value == 100


def test_no_own_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session._own_folder(master)
    assert os.path.isdir(session._own_folder("local[4]"))


def test_released_tables_are_gone(spark):
    df = stage(spark.range(3))
    at = session._staged[-1]
    assert df.count() == 3 and session.release(spark) >= 1 and not session._staged
    with pytest.raises(Exception):
        spark.read.parquet(at).count()


def test_log_summary_of_nothing(spark):
    d = spark.createDataFrame([], "log_id int, user_id int, query_text string, total_results int, latency_ms int, created_at timestamp")
    r = logs.summary(d).first()
    assert (r.searches, r.avg_latency_ms, r.zero_result_rate, r.success_rate) == (0, 0.0, 0.0, 0.0)
    assert logs.daily(d).count() == 0 and logs.next_id(d, "log_id").first().next_id == 1
    assert logs.daily(d, F.to_date(F.lit("2020-01-07"))).count() == 7


def test_daily_is_zero_filled(spark):
    d = spark.createDataFrame([(dt.datetime(2020, 1, 7), 10), (dt.datetime(2020, 1, 7), None), (dt.datetime(2020, 1, 1), 30), (None, 5)], "created_at timestamp, latency_ms int")
    rows = sorted((str(r.day), r.searches, r.avg_latency_ms) for r in logs.daily(d).collect())
    assert len(rows) == 7 and rows[0] == ("2020-01-01", 1, 30.0) and rows[3][1:] == (0, 0.0) and rows[-1] == ("2020-01-07", 2, 10.0)


def test_limits_are_checked(spark):
    d = spark.createDataFrame([], "user_id int, created_at timestamp, log_id int")
    for bad in (0, 201):
        with pytest.raises(ValueError):
            logs.history(d, 1, bad)
    with pytest.raises(ValueError):
        logs.page_of_logs(d, -1)


def test_sync(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "book_id int, title string")
    b = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (None, "x")], "book_id int, title string")
    u = sync.upsert(a, b, "book_id")
    assert {r.book_id: (r.title, r.change) for r in u.collect()} == {1: ("a", "same"), 2: ("B", "updated"), 3: ("c", "kept"), 4: ("d", "new")}
    assert tuple(sync.sync_summary(u).first()) == (1, 1, 3)
    again = sync.upsert(u.drop("change"), b, "book_id")
    assert tuple(sync.sync_summary(again).first()) == (0, 0, 3)


def test_numbers_are_global_and_dense(spark):
    d = spark.range(500).select((F.col("id") * 37 % 500).alias("a"))
    rows = sync.numbered(d, ["a"]).orderBy("a").collect()
    assert [r.row_id for r in rows] == list(range(1, 501))


def test_vectors(spark):
    c = spark.createDataFrame([(1, 1, 1, "x", [1.0, 0.0]), (2, 1, 1, "y", [3.0, 3.0]), (3, 2, 1, "z", [-1.0, 0.0]), (4, 2, 2, "n", None), (5, 2, 2, "o", [0.0, 0.0]), (6, 2, 2, "p", [float("nan"), 1.0]), (7, 2, 2, "q", [1.0])], "chunk_id long, book_id int, page_number int, chunk_text string, embedding array<float>")
    u = vectors.unit_chunks(c, 2)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, qvec array<double>")
    s = vectors.scores(q, u)
    assert [(r.chunk_id, round(r.score, 4)) for r in vectors.top_chunks(s, 2).orderBy("rank").collect()] == [(1, 1.0), (2, 0.7071)]
    assert [(r.book_id, r.page_number, r.semantic, r.hint) for r in vectors.page_max(s).collect()] == [(1, 1, 1.0, "x")]
    pages = spark.createDataFrame([(0, 1, 1), (0, 2, 1)], "query_id long, book_id int, page_number int")
    assert {(r.book_id, r.semantic) for r in vectors.restricted(pages, s).collect()} == {(1, 1.0), (2, 0.0)}


def test_embed_runs_a_pluggable_model(spark):
    d = spark.createDataFrame([("ab",), (None,)], "t string")
    assert sorted(r.v for r in vectors.embed(d, "t", "v", lambda: lambda texts: [[len(t), 1] for t in texts]).collect()) == [[0.0, 1.0], [2.0, 1.0]]


def test_store(spark, tmp_path):
    root = str(tmp_path / "index")
    assert store.versions(spark, root) == []
    with pytest.raises(FileNotFoundError):
        store.read(spark, root, "docs")
    for n in (3, 5):
        store.publish(spark, root, {"docs": spark.range(n)})
    (tmp_path / "index" / "v=9" / "docs").mkdir(parents=True)  # a failed run
    assert store.versions(spark, root) == [1, 2] and store.read(spark, root, "docs").count() == 5 and store.read(spark, root, "docs", 1).count() == 3
    assert store.artifacts(spark, root).first().bytes > 0
    assert store.drop_versions(spark, root) == {1: True} and store.versions(spark, root) == [2]
    at = str(tmp_path / "pages")
    store.replace_books(spark.createDataFrame([(1, "a"), (2, "b")], "book_id int, t string"), at)
    store.replace_books(spark.createDataFrame([(2, "c")], "book_id int, t string"), at)
    assert {(r.book_id, r.t) for r in spark.read.parquet(at).collect()} == {(1, "a"), (2, "c")}
    assert read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"query": "x", "n": 1}, {"query": None}]))
    assert files.read_json_array(spark, str(tmp_path / "a.json"), "query string, n int").count() == 2
    files.write_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    d = tmp_path / "docs"
    d.mkdir()
    (d / "one.txt").write_bytes(b"a long enough first page of text, of more than fifty characters\fshort")
    (d / "bad.txt").write_bytes(b"x")

    def extract(raw):
        if raw == b"x":
            raise ValueError
        return files.form_feed_pages(raw)

    rows = files.document_pages(files.documents(spark, str(d)), extract, lambda raw, n: f"read {n}").collect()
    assert sorted((r.page_number, r.text_content[:6], r.page_count) for r in rows) == [(1, "a long", 2), (2, "read 2", 2)]


def test_rest_source_raises_on_failure(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"success": True, "data": {"items": [{"a": 1}, {"a": 2}]}}))
    bad.write_text(json.dumps({"success": False, "message": "no"}))
    spark.dataSource.register(files.RestPages)
    assert spark.read.format("rest").option("url", good.as_uri()).load().count() == 2
    with pytest.raises(Exception, match="no"):
        spark.read.format("rest").option("url", bad.as_uri()).load().count()


def test_rest_writer_posts_rows(spark):
    got = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            told = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append(told)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(files.envelope(told.get("title") != "bad", "no")).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(files.RestPages)
        post = lambda d: d.write.format("rest").mode("append").option("url", f"http://127.0.0.1:{server.server_port}/books").save()
        post(spark.createDataFrame([(1, "é"), (2, None)], "book_id int, title string"))
        assert sorted(got, key=lambda x: x["book_id"]) == [{"book_id": 1, "title": "é"}, {"book_id": 2, "title": None}]
        post(spark.createDataFrame([('{"raw": 1}',)], "item string"))
        assert got[-1] == {"raw": 1}
        with pytest.raises(Exception, match="no"):
            post(spark.createDataFrame([(3, "bad")], "book_id int, title string"))
    finally:
        server.shutdown()


def test_settings_keep_defaults_for_bad_values():
    s = files.Settings.read({"CHUNK_MIN_WORDS": "x", "DEBUG": "On", "SEMANTIC_TOP_K": "7"})
    assert (s.chunk_min_words, s.debug, s.semantic_top_k) == (200, True, 7)
    assert files.envelope(True, "m", [1]) == {"success": True, "message": "m", "data": [1]}


def test_html(spark):
    h = "<html><script>x<1</script><p>A &amp; B</p>C<br>D&nbsp;E</html>"
    assert spark.createDataFrame([(h,)], "h string").select(files.html_text("h")).first()[0] == "A & B\nC\nD E"


def test_every_page_of_another_book_can_be_a_negative(spark):
    p = spark.range(3000).select(F.concat_ws("_", F.col("id") % 10, "id").alias("page_id"), (F.col("id") % 10).cast("int").alias("book_id"), F.concat(F.lit("shared words "), F.col("id").cast("string")).alias("text_content"))
    q = p.where("book_id = 3").select("page_id", F.explode(F.array(*[F.lit(f"query {x}") for x in "abcd"])).alias("query"))
    rows = ltr.labelled(q, p).collect()
    drawn = {r.page_id for r in rows if r.relevance_label == 0}
    assert len(drawn) > 2500 and all(r.book_id != 3 for r in rows if r.relevance_label == 0)
    few = p.where("book_id = 3 or page_id in ('0_0', '1_1', '2_2', '4_4')")
    small_ = ltr.labelled(q.limit(5), few).where("relevance_label = 0").groupBy("query", "source_page_id").agg(F.collect_set("page_id").alias("s")).collect()
    assert len(small_) == 5 and all(set(r.s) == {"0_0", "1_1", "2_2", "4_4"} for r in small_)


def test_labels(spark):
    p = spark.createDataFrame([(f"{b}_{n}", b, n, f"alpha beta gamma word{n} word{b} " + " ".join(f"tok{b}{n}{i}" for i in range(60)), 65) for b in range(4) for n in range(12)], "page_id string, book_id int, page_number int, text_content string, word_count int")
    q = ltr.generated_queries(ltr.page_terms(p))
    n = q.groupBy("page_id").count().collect()
    assert len(n) == 48 and all(1 <= r["count"] <= 5 for r in n)
    assert sorted(map(str, q.collect())) == sorted(map(str, ltr.generated_queries(ltr.page_terms(p)).collect()))
    rows = ltr.labelled(q, p).collect()
    by = {}
    for r in rows:
        by.setdefault((r.query, r.source_page_id), []).append(r)
        assert (r.relevance_label == 2) == (r.page_id == r.source_page_id)
        assert r.relevance_label == 0 or r.book_id == int(r.source_page_id.split("_")[0])
    assert all(len(x) <= 10 and sum(r.relevance_label == 1 for r in x) <= 4 and sum(r.relevance_label == 2 for r in x) == 1 for x in by.values())


def test_labels_of_a_large_book_cost_no_pairs(spark):
    """Every page of its book that shares a word can be drawn, none other, and the rows met do not grow with the book."""
    p = spark.range(4000).select(F.format_string("%04d", "id").alias("page_id"), F.when(F.col("id") < 3000, 1).when(F.col("id") < 3990, F.col("id").cast("int")).alias("book_id"), F.concat(F.lit("shared word"), (F.col("id") % 500).cast("string"), F.when(F.col("id") % 3 == 0, " third").otherwise(" ")).alias("text_content"))
    q = p.where("book_id = 1").select("page_id", F.explode(F.array(F.lit("third alone"), F.lit("nothing here"), F.concat(F.lit("absent word"), (F.substring("page_id", -3, 3).cast("int") % 500).cast("string")))).alias("query"))
    rows = ltr.labelled(q, p)
    got = rows.collect()
    text = {r.page_id: (r.book_id, set(r.text_content.split())) for r in p.collect()}
    by = {}
    for r in got:
        by.setdefault((r.query, r.source_page_id), []).append(r)
        assert r.word_overlap_score == len(set(r.query.split()) & text[r.page_id][1]) and r.book_id == text[r.page_id][0]
    third = {r.page_id for r in got if r.relevance_label == 1 and r.query == "third alone"}
    assert len(by) == 9000 and third == {k for k, (b, w) in text.items() if b == 1 and "third" in w}
    for (query, src), x in by.items():
        ids = [r.page_id for r in x]
        fits = {k for k in (range(int(src) % 500, 3000, 500) if "absent" in query else range(0, 3000, 3) if "third" in query else ())} - {int(src)}
        near = {int(r.page_id) for r in x if r.relevance_label == 1}
        assert len(ids) == len(set(ids)) == 10 and near <= fits and len(near) == min(4, len(fits))
        assert all((r.book_id == 1) == (r.relevance_label > 0) and r.book_id is not None for r in x)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_summaries_fall_back(spark):
    from quire.operators import summaries

    p = spark.createDataFrame([("1", 1, "i", "One. Two. Three. Four."), ("2", 1, None, None), ("3", 1, None, "no end")], "page_id string, book_id int, display_page_number string, text_content string")
    own = {r.page_id: r for r in summaries.summarise(p, 2).collect()}
    assert own["1"].summary == "One. Two." and own["1"].source_sentence_count == 4 and own["2"].summary == "" and own["3"].summary == "no end"

    def broken(texts):
        raise RuntimeError

    assert {r.provider for r in summaries.summarise(p, 2, broken).collect()} == {"extractive"}
    said = {r.page_id: r for r in summaries.summarise(p, 1, lambda t: ["A  b. C d."] * len(t), "x", "{max_sentences}: {text}").collect()}
    assert said["1"].summary == "A b." and said["1"].provider == "x"
    with pytest.raises(ValueError):
        summaries.prompt(" ", F.lit(""), 1)


def test_uploads_and_paths(spark):
    from quire.operators import chunking

    f = spark.createDataFrame([("/x/b.pdf", 3 << 20), ("/x/a.pdf", 100)], "path string, length long")
    rows = chunking.uploads(f, 7).orderBy("book_id").collect()
    assert [(r.book_id, r.title, r.stored_file_name, r.file_size_mb) for r in rows] == [(7, "a", "book_007.pdf", 0.0), (8, "b", "book_008.pdf", 3.0)]
    d = spark.createDataFrame([("books\\a.pdf",), ("library/books//b.pdf",), ("",), (None,)], "p string")
    assert [r[0] for r in d.select(chunking.library_path(F.col("p"))).collect()] == ["library/books/a.pdf", "library/books/b.pdf", None, None]


def test_vector_index_build(spark):
    p = spark.createDataFrame([(1, "1_1", 1, "a b c"), (1, "1_2", 2, " ")], "book_id int, page_id string, page_number int, text_content string")
    t = spark.createDataFrame([(1, "T")], "book_id int, title string")
    out, n = vectors.build(p, t, lambda: lambda texts: [[1.0, 2.0] for _ in texts])
    assert [(r.chunk_id, r.book_name, r.embedding) for r in out.collect()] == [(1, "T", [1.0, 2.0])] and tuple(n.first()) == (1, 1, "built")
    assert vectors.build(p.limit(0), t, lambda: lambda texts: [])[1].first().outcome == "no text"
