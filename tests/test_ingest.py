from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import ingest
from quern.sources import collections, files


def windows(text: str, size: int, overlap: int) -> list[str]:
    out, start = [], 0
    while True:
        out.append(text[start : start + size].strip())
        if start + size >= len(text):
            return [w for w in out if w]
        start += size - overlap


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab \nكé", max_size=60), min_size=1, max_size=8), st.integers(2, 12), st.integers(0, 5))
def test_chunks_like_a_loop(spark, texts, size, overlap):
    overlap = min(overlap, size - 1)
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = ingest.chunks(rows, size=size, overlap=overlap).orderBy("n", "chunk_index").collect()
    assert [(r.n, r.chunk_index, r.text) for r in got] == [(n, i, w) for n, t in enumerate(texts) for i, w in enumerate(windows(t, size, overlap))]


def test_chunks_of_null_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, 9), (2, "  ", 9), (3, "abc", 9)], "n int, text string, chunk_index int")
    assert [(r.n, r.chunk_index, r.text) for r in ingest.chunks(rows).collect()] == [(3, 0, "abc")]


def test_upsert_is_idempotent_and_stale_rows_go(spark):
    old = spark.createDataFrame([("a", "u1", "1"), ("b", "u1", "2"), ("c", None, "3"), ("d", "u2", "4")], "id string, url string, text string")
    new = spark.createDataFrame([("b", "u1", "new"), ("e", "u1", "5")], "id string, url string, text string")
    once = ingest.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ingest.upsert(once, new).collect()))
    assert {(r.id, r.text) for r in once.collect()} == {("a", "1"), ("b", "new"), ("c", "3"), ("d", "4"), ("e", "5")}
    assert {r.id for r in ingest.without_stale(old, new).collect()} == {"b", "c", "d"}


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 5, 20, 1, 1, 1])] + [("h", 0, None)], "g string, i int, n int")
    got = {(r.g, r.i): r.batch_no for r in ingest.greedy_batches(rows, "g", ["i"], "n", max_items=3, max_size=10).collect()}
    assert got == {("g", 0): 0, ("g", 1): 0, ("g", 2): 1, ("g", 3): 2, ("g", 4): 2, ("g", 5): 2, ("h", 0): 0}


def test_embed_and_collection(spark, tmp_path):
    c = collections.Collection(spark, str(tmp_path), "en")
    assert c.count() == 0
    pages = spark.createDataFrame([("a.pdf", "a", 1, "one two"), ("a.pdf", "a", 2, "three")], "pdf string, title string, page int, text string")
    chunks = ingest.embed(ingest.pdf_chunks(pages, "en", "books"), lambda texts: [[float(len(t))] for t in texts], "m1")
    c.upsert(chunks)
    c.upsert(chunks)
    assert c.count() == 2 and {r.id for r in c.filtered(title="a").collect()} == {"a.pdf::p1::c0", "a.pdf::p2::c0"}
    web = spark.createDataFrame([("https://x.example/a#t", "t", "old text")], "url string, title string, text string")
    c.upsert(ingest.web_chunks(web, "en", "web"), drop_stale=True)
    assert c.count() == 3 and {r.n for r in collections.source_counts(c.read()).collect()} == {1, 2}
    other = ingest.embed(ingest.pdf_chunks(pages, "en", "books"), lambda texts: [[0.0]] * len(texts), "m2")
    try:
        c.upsert(other)
        raise AssertionError("vectors of two models went into one collection")
    except ValueError:
        pass


def test_fill_embeds_every_chunk_once(spark, tmp_path):
    from quern.plans.pipeline import fill

    calls = tmp_path / "calls"
    calls.mkdir()

    class Counting:
        model = "m"

        def __call__(self, texts):
            import uuid

            for _ in texts:
                (calls / uuid.uuid4().hex).touch()
            return [[1.0]] * len(texts)

    web = spark.createDataFrame([(f"https://x.example/{i}", "t", f"text {i}") for i in range(20)], "url string, title string, text string")
    c = collections.Collection(spark, str(tmp_path), "en")
    for drop_stale in (False, True):
        fill(c, ingest.web_chunks(web, "en", "web"), Counting(), drop_stale=drop_stale)
    assert c.count() == 20 and len(list(calls.iterdir())) == 40
    assert not [p for p in (tmp_path / "en").iterdir() if p.name.startswith("staged-")]


def test_collection_writes_what_changed(spark, tmp_path):
    c = collections.Collection(spark, str(tmp_path), "en")
    rows = spark.createDataFrame([(f"u{i}::c{j}", f"text {i} {j}", f"https://x.example/{i}") for i in range(50) for j in range(2)], "id string, text string, url string")
    c.upsert(rows)
    before = c.store.newest()
    c.upsert(rows.where("id = 'u3::c0'").withColumn("text", F.lit("new")), drop_stale=True)
    base, after = c.store.newest()
    assert base == before[0] + 1 and sum(before[1][k] != after[k] for k in after) == 1
    got = {r.id: r.text for r in c.read().collect()}
    assert len(got) == 99 and got["u3::c0"] == "new" and "u3::c1" not in got
    c.upsert(rows.limit(0))
    assert c.store.newest()[0] == base
    # the later of two rows of one id stands, and of two writers of one version the second fails
    twice = spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "id string, text string, chunk_index int")
    c.upsert(twice.repartition(2))
    assert c.read().where("id = 'k'").first().text == "b"
    try:
        c.store.commit(base, {})
        raise AssertionError("a version was written twice")
    except collections.Conflict:
        pass


def test_tables_of_one_version(spark, tmp_path):
    store = collections.Snapshots(spark, str(tmp_path / "s"))
    store.write({"a": spark.range(3), "b": spark.range(2)})
    store.write({"a": spark.range(5), "b": spark.range(4)})
    assert store.versions() == [1, 2] and (store.read("a").count(), store.read("b").count()) == (5, 4)
    assert store.parts(1) != store.parts(2)


def test_database_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(100).select(F.col("id").cast("int").alias("N"), F.concat(F.lit("v"), "id").alias("V"))
    rows.write.format("jdbc").option("url", url).option("dbtable", "T").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").save()
    got = collections.jdbc_table(spark, url, "T", ("N", 0, 100, 4), driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.collect()}


def test_filters_reach_the_files(spark, tmp_path):
    c = collections.Collection(spark, str(tmp_path), "en")
    c.upsert(spark.createDataFrame([("a::c0", "x", "T"), ("b::c0", "y", "U")], "id string, text string, title string"))
    found = c.filtered(title="T").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(title,T)" in plan and "embedding" not in plan.split("ReadSchema")[1]
    assert [r.id for r in found.collect()] == ["a::c0"]


def test_fetch_tries_again(spark, tmp_path):
    def opener(url, timeout, agent):
        seen = tmp_path / url[-1]
        if not seen.exists():
            seen.touch()
            raise OSError("busy")
        return "page"

    urls = files.url_list(spark, ["https://a.example/1", "https://a.example/2"])
    assert [r.html for r in files.fetch(urls, opener=opener, attempts=2).collect()] == ["page", "page"]


def test_gates_and_retries(spark):
    assert ingest.must_ingest(5, 10, True) and not ingest.must_ingest(10, 10, True) and not ingest.must_ingest(0, 10, False)
    assert (ingest.int_setting("x", 7), ingest.int_setting("-3", 7), ingest.int_setting(" 12 ", 7)) == (7, 0, 12)
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("rate limit")
        return [[1.0]]

    assert ingest.with_retries(flaky, lambda e: "rate" in str(e), lambda a, m: 0.0)(["x"]) == [[1.0]]

    def missing():
        raise OSError("gone")

    done, errors = ingest.attempt_sources({"a": lambda: spark.range(1), "b": missing})
    assert len(done) == 1 and errors == {"b": "OSError: gone"}


def test_pdf_folder(spark, tmp_path):
    for name, text in (("b.pdf", "p1\x00|  |قلم"), ("A.pdf", "x"), ("skip.pdf", "s"), ("n.txt", "t")):
        (tmp_path / name).write_bytes(text.encode())
    listed = files.pdf_files(spark, str(tmp_path), ["SKIP.pdf"])
    assert [r.pdf for r in listed.collect()] == ["A.pdf", "b.pdf"]
    have, missing = files.expected_files(listed, spark.createDataFrame([("b",), ("zz",)], "title string"))
    assert [r.title for r in have.collect()] == ["b"] and [r.title for r in missing.collect()] == ["zz"]
    pages = files.pdf_pages(spark, str(tmp_path), lambda raw: raw.decode().split("|"), ["skip.pdf"])
    assert sorted((r.pdf, r.page, r.text) for r in pages.collect()) == [("A.pdf", 1, "x"), ("b.pdf", 1, "p1"), ("b.pdf", 3, "قلم")]
    arabic = files.pdf_pages(spark, str(tmp_path), lambda raw: raw.decode().split("|"), keep_pattern="[\\x{600}-\\x{6ff}]")
    assert [(r.pdf, r.page) for r in arabic.collect()] == [("b.pdf", 3)]


def test_html(spark):
    html = "<html><head><title>T</title></head><body><nav>n</nav><div class='x entry-content'><p>one</p><p>a &amp; b<br>c</p></div><h1></h1></body></html>"
    assert files.read_html(html)[0] == "T"
    assert [p for p in files.read_html(html)[1].split("\n") if p] == ["one", "a & b", "c"]
    assert files.read_html("")[1] == "" and files.read_html("<p>x<script>y")[1] == "x"
    rows = spark.createDataFrame([("u", "<main><p>aa</p><p>aa</p></main><p>zz</p>"), ("v", None)], "url string, html string")
    assert [tuple(r) for r in files.html_pages(rows).collect()] == [("u", "u", "aa")]


def test_fetch_carries_errors(spark):
    def opener(url, timeout, agent):
        if "bad" in url:
            raise OSError("no route")
        return f"<p>{url}</p>"

    got = {r.url: (r.html, r.error) for r in files.fetch(files.url_list(spark, ["https://a.example/#x", " ", "https://bad.example/"]), opener=opener).collect()}
    assert got == {"https://a.example/": ("<p>https://a.example/</p>", None), "https://bad.example/": (None, "OSError: no route")}


def test_json_index_round_trip(spark, tmp_path):
    rec = spark.createDataFrame([("i1", "اسم", ["ب"], "book", 1, 2, "p"), ("i2", "  ", [], "book", None, None, None)], "id string, name_ar string, aliases_ar array<string>, source_title string, page_start int, page_end int, preview string")
    files.write_json_index(rec, "book", str(tmp_path / "idx"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.json").write_text("{ broken")
    assert [r.id for r in files.json_index(spark, str(tmp_path / "idx")).collect()] == ["i1"]
    assert files.json_index(spark, str(tmp_path / "bad")).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "pdf string, title string, page int, text string")
    assert ingest.pdf_chunks(empty, "en", "x").count() == 0
    assert files.page_stats(empty).first().n_pages == 0
    assert collections.pdf_counts(empty.withColumn("source_type", F.lit("pdf"))).count() == 0
