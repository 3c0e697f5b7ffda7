from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import converse, entities, match, ranking, retrieve
from quern.plans.pipeline import AnswerRules, NameIndex, answer, chat, ensure_filled
from quern.operators import ingest
from quern.sources.collections import Collection


def test_tiers_are_monotone_and_cut(spark):
    records = spark.createDataFrame([("1", "Dom Alba"), ("2", "Alba of Ember"), ("3", "New Albany"), ("4", "Ember Alba Low")], "id string, name string")
    keys = match.name_keys(records, F.array("name", F.when(F.col("id") == "4", F.lit("alba")).otherwise(F.col("name"))), lambda c: T.latin_key(c), ["dom"])
    q = spark.createDataFrame([("alba", "alba"), ("dom alba", "dom alba"), ("alba ember", "alba ember")], "query string, query_key string")
    scored = {(r.query, r.id): r.score for r in match.tiered(keys, q).collect()}
    assert scored == {("alba", "1"): 2, ("alba", "2"): 2, ("alba", "3"): 3, ("alba", "4"): 1, ("dom alba", "1"): 0, ("alba ember", "2"): 4, ("alba ember", "4"): 4}
    assert {(r.query, r.id) for r in match.search(keys, q).collect()} == {("alba", "4"), ("dom alba", "1"), ("alba ember", "2"), ("alba ember", "4")}


def test_pages_make_the_whole_list(spark):
    rows = spark.range(25).withColumn("name", F.concat(F.lit("n"), (F.col("id") % 7).cast("string")))
    whole = [r.id for r in rows.orderBy("name", "id").collect()]
    pages = [r.id for o in range(0, 25, 10) for r in ranking.page(rows, ["name", "id"], 10, o).orderBy("name", "id").collect()]
    assert pages == whole


def test_numbers_of_many_rows(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("a"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), (F.col("id") % 11).cast("string"))).alias("b"))
    got = ranking.numbered(rows, ["b", "a"]).collect()
    want = sorted(((r.b or "", r.a) for r in got))
    assert [(r.b or "", r.a) for r in sorted(got, key=lambda r: r.position)] == want and sorted(r.position for r in got) == list(range(3000))
    assert ranking.numbered(rows.limit(0), ["b"]).count() == 0


def test_first_wins_with_null_keys_and_clashing_names(spark):
    rows = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("k", 3, "c"), ("k", 3, "c")], "key string, o int, _r string")
    assert sorted(tuple(r) for r in ranking.first_wins(rows, ["key"], ["o"]).collect() if r.key) == [("k", 3, "c")]
    assert [tuple(r) for r in ranking.first_wins(rows, ["key"], ["o"]).where("key is null").collect()] == [(None, 1, "a")]


def test_sections_and_index(spark):
    body = " ".join(["word"] * 25)
    text = f"intro\nALBA THE GREAT (1)\n12\n{body}\nEMBER, ST., DEACON\n{body}\nALBA THE GREAT\n{body}\nSHORT ONE\nfew words"
    chunks = spark.createDataFrame([("saints a.pdf", 1, 0, text), ("other.pdf", 1, 0, text)], "pdf string, page int, chunk_index int, text string")
    renames = spark.createDataFrame([("St. Ember, Deacon", "St. Ember Deacon")], "name string, replacement string")
    excluded = spark.createDataFrame([], "name string")
    seeds = spark.createDataFrame([("s1", 0, "Alba Great", True), ("s1", 1, "البا", False)], "seed_id string, ordinal int, alias string, is_latin boolean")
    got = entities.record_index(chunks, entities.NameRules(), renames, excluded, seeds, "saints").collect()
    assert [(r.name, r.aliases) for r in got] == [("St. Alba the Great", ["St. Alba the Great", "Alba Great", "البا"]), ("St. Ember Deacon", ["St. Ember Deacon"])]
    assert got[0].source.page == 1 and len(got[0].body_preview) <= 300


def test_warnings_and_descriptors(spark):
    assert len(entities.index_warnings({"n_pages": 3, "n_chars": 5000, "n_entries": 70})) == 1
    row = spark.range(1).select(match.descriptor_rank(F.lit("ab"), F.lit("the cd"), [("ab", "cd", 2)]), match.descriptor_rank(F.lit("x"), F.lit("y"), [])).first()
    assert tuple(row) == (2, 9)


def test_knn_ties_and_bad_vectors(spark, monkeypatch):
    rows = spark.createDataFrame([(2, [0.0, 1.0]), (1, [0.0, 1.0]), (3, None), (4, [1.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([("q", [0.0, 1.0])], "q_id string, q_vector array<float>")
    assert [(r.id, r.rank) for r in retrieve.knn(rows, q, 5, "id").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert retrieve.knn(rows, q.limit(0), 5, "id").count() == 0 and retrieve.knn(rows.limit(0), q, 5, "id").count() == 0
    monkeypatch.setattr(retrieve, "MATRIX_QUERIES", 1)
    monkeypatch.setattr(retrieve, "MATRIX_ROWS", 2)
    more = q.unionByName(spark.createDataFrame([("r", [0.0, 0.0]), ("s", [1.0])], "q_id string, q_vector array<float>"))
    assert {(r.q_id, r.id, r.rank) for r in retrieve.knn(rows, more, 1, "id").collect()} == {("q", 1, 1), ("r", 1, 1), ("s", 4, 1)}


def test_retrieval_sizes(spark):
    assert retrieve.retrieval_k(50) == (12, 12) and retrieve.retrieval_k(0) == (1, 1) and retrieve.retrieval_k(8, is_broad=True) == (8, 12) and retrieve.retrieval_k(3, arabic=True) == (3, 10)
    assert retrieve.mode_filter("chat", {"books": "B"}) is None


def test_merge_names_and_options(spark):
    row = spark.createDataFrame([(["A", " b", "a", ""], None)], "x array<string>, y array<string>")
    assert row.select(converse.merge_names([F.col("x"), F.col("y")])).first()[0] == ["A", "b"]
    assert row.select(converse.visible_options(F.array(F.lit("- Who?"), F.lit("Name"), F.lit("would you go")), ["would you"])).first()[0] == ["Who?", "would you go"]


class Letters:
    model = "letters"

    def __call__(self, texts):
        return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyzابتجحد"] for t in texts]


PAGE = "pdf string, title string, page int, text string"


def filled(spark, root, name, rows):
    c = Collection(spark, str(root), name)
    pages = spark.createDataFrame(rows, PAGE)
    assert ensure_filled(c, lambda: ingest.pdf_chunks(pages, name, "books"), len(rows), embedder=Letters()) == len(rows)
    return c


def test_answer_pipeline(spark, tmp_path):
    c = filled(spark, tmp_path, "en", [("w.pdf", "Wells", 1, "the desert well was deep"), ("w.pdf", "Wells", 2, "a lamp in the silence"), ("s.pdf", "Ships", 1, "boats and ferrymen")])
    prompts = []
    got = answer("What is the desert well?", c, Letters(), lambda p: prompts.append(p) or "It is deep.", AnswerRules(stopwords=("what", "the")), top_k=3)
    assert got.grounding == "full" and got.sources == [{"source_type": "pdf", "pdf": "w.pdf", "page": 1, "url": None, "title": None}] and "[Source: w.pdf p.1]" in prompts[0]
    assert answer("Who knows zebras and quaggas?", c, Letters(), lambda p: "", AnswerRules(stopwords=("who",))).grounding == "no-source"
    # an entity is a phrase, a topic judges by its own condition, and an empty result is tried from the original question
    rules = AnswerRules(stopwords=("what", "the", "who", "is"), topics=(("seafaring", (("boats",),)),))
    assert answer("zebras quaggas", c, Letters(), lambda p: "x", rules, entity="ferrymen").sources[0]["pdf"] == "s.pdf"
    assert answer("what about seafaring today", c, Letters(), lambda p: "x", rules).sources[0]["pdf"] == "s.pdf"
    assert answer("zebras quaggas", c, Letters(), lambda p: "x", rules, original="boats and ferrymen").n_accepted == 1


def test_chat(spark, tmp_path):
    en = filled(spark, tmp_path, "en", [("w.pdf", "Wells", 1, "St. Alba dug the desert well"), ("w.pdf", "Wells", 2, "St. Ember of Low kept a lamp in silence")])
    ar = filled(spark, tmp_path, "ar", [("a.pdf", "كتاب", 1, "حفر القديس البا بئر البرية"), ("a.pdf", "كتاب", 2, "سراج في الصمت")])
    names = spark.createDataFrame([("1", "St. Alba"), ("2", "St. Ember of Low"), ("3", "St. Ember of High")], "id string, name string")

    def key(c):
        return T.latin_key(c, titles=["st", "saint"])

    index = NameIndex(match.name_keys(names, F.array("name"), key), key, arabic=spark.createDataFrame([("البا", "البا")], "name string, name_key string"))
    rules = AnswerRules(stopwords=("who", "was", "the", "what", "about"), no_source={"en": "nothing", "ar": "لا شيء"}, intents=((r"(?i)^who was (.+)$", "lookup"), (r"(?i)^list (.+)$", "list")))
    prompts = []

    def say(question, history=()):
        return chat(question, history, {"en": en, "ar": ar}, index, Letters(), lambda p: prompts.append(p) or "An answer.", rules)

    assert say("Who was St. Alba?").sources[0]["page"] == 1
    several = say("Who is St. Ember?")
    assert sorted(several.options) == ["St. Ember of High", "St. Ember of Low"] and not several.sources
    talk = [("user", "Which ones?"), ("assistant", "1. **St. Alba** - dug\n2. **St. Ember of Low** - kept")]
    assert say("2", talk).sources[0]["page"] == 2 and "Question: St. Ember of Low" in prompts[-1]
    assert say("What did he dig?", [("assistant", "**St. Alba** dug a well.")]).sources[0]["page"] == 1
    got = say("من هو القديس البا")
    assert got.sources and all(s["pdf"] == "a.pdf" for s in got.sources)
    try:
        say("  ")
        raise AssertionError("an empty question was answered")
    except ValueError:
        pass


def test_entity_queries_and_relevance(spark):
    q = spark.createDataFrame([(1, "what did he teach", "St. Alba"), (2, "x", None), (3, "y", "")], "q_id int, question string, entity string")
    got = [(r.ordinal, r.query) for r in retrieve.entity_queries(q, [("teach", ["{entity} taught"])], ["{entity} life"], lambda e: F.array(e)).orderBy("ordinal").collect()]
    assert got == [(0, "St. Alba taught"), (1, "St. Alba life"), (2, "St. Alba")]
    phrases, words = retrieve.relevance_terms(F.col("question"), F.col("entity"), ["what", "did"])
    assert q.where("q_id = 1").select(phrases, words).first()[:] == (["st alba"], ["teach", "alba"])


def test_names_in_blocks_and_intents(spark, monkeypatch):
    records = spark.createDataFrame([(str(i), f"St. Alba {i}") for i in range(30)], "id string, name string")
    keys = match.name_keys(records, F.array("name"), lambda c: T.latin_key(c, titles=["st"]))
    q = spark.createDataFrame([(f"alba {i}", f"alba {i}") for i in range(30)], "query string, query_key string")
    whole = {tuple(r) for r in match.tiered(keys, q).collect()}
    monkeypatch.setattr(match.in_blocks, "__defaults__", (4,))
    assert {tuple(r) for r in match.tiered(keys, q).collect()} == whole and whole
    asked = spark.createDataFrame([(1, "lookup", "alba 7"), (2, "lookup", "the weather"), (3, "list", "saint nobody"), (4, None, None)], "id int, mode string, subject string")
    got = {r.id: r.subject for r in match.confirmed_intents(asked, keys, ["st.", "saint"], lambda c: T.latin_key(c, titles=["st", "saint"])).collect()}
    assert got == {1: "alba 7", 2: None, 3: "saint nobody", 4: None}
