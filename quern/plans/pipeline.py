"""Ingestion and question answering as compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import converse, entities, ingest, match, retrieve
from quern.sources.collections import Collection


class Embedder(Protocol):
    """Maps texts to vectors; ``model`` is stored with them, and queries must come from the same model."""

    model: str

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class AnswerRules:
    """What a collection brings to answering: word lists, query expansions, topics, texts."""

    stopwords: tuple[str, ...] = ()
    #: (pattern on the lower-cased question, queries)
    expansions: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: (pattern on the lower-cased question, queries with {entity}), and queries with {entity} for every variant of a name
    entity_templates: tuple[tuple[str, tuple[str, ...]], ...] = ()
    entity_queries: tuple[str, ...] = ()
    prefix: str = "St."
    spellings: tuple[tuple[str, str], ...] = ()
    #: (pattern on the lower-cased question, phrases, keywords) that bear on it
    relevance: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()
    #: (pattern on the lower-cased question, alternatives: any of them whose words are all in the text makes it relevant)
    topics: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = ()
    none_phrases: tuple[str, ...] = ("could not find", "no relevant")
    hedges: tuple[str, ...] = ("partial", "not exhaustive")
    no_source: Mapping[str, str] = field(default_factory=lambda: {"en": "Nothing was found about this in the sources."})
    boost_prefix: str | None = None
    broad_nouns: tuple[str, ...] = ("places", "items")
    # words and rules of Arabic search
    arabic_stopwords: tuple[str, ...] = ()
    arabic_terms: tuple[tuple[str, tuple[str, ...]], ...] = ()
    arabic_prefix: str = "ال"
    # what a conversation's questions mean
    titles: tuple[str, ...] = ("st.", "saint")
    rewrites: tuple[tuple[str, str], ...] = ()
    intents: tuple[tuple[str, str], ...] = ()
    follow_ups: tuple[tuple[str, tuple[str, ...]], ...] = ()
    choose: str = "Several names match %s. Choose one of them."
    mode_titles: Mapping[str, str] = field(default_factory=dict)


def fill(collection: Collection, chunks: DataFrame, embedder: Embedder | None = None, drop_stale: bool = False) -> None:
    """Embed chunks (where there is an embedder) and upsert them. Every chunk is embedded once."""
    rows = chunks if embedder is None else ingest.embed(chunks, embedder, embedder.model)
    collection.upsert(collection.stage(rows), drop_stale=drop_stale)
    collection.drop_staged()


def ensure_filled(collection: Collection, build: Callable[[], DataFrame], least: int, enabled: bool = True, embedder: Embedder | None = None) -> int:
    """Fill a collection that holds under ``least`` rows; its rows afterwards, an error if they are still too few."""
    if ingest.must_ingest(collection.count(), least, enabled):
        fill(collection, build(), embedder)
        if collection.count() < least:
            raise RuntimeError(f"the collection has {collection.count()} rows after ingestion, expected {least} or more")
    return collection.count()


@dataclass
class Answer:
    answer: str
    sources: list[dict] = field(default_factory=list)
    grounding: str = "no-source"
    n_accepted: int = 0
    n_rejected: int = 0
    options: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)


def _value(spark: SparkSession, c: Column):
    return spark.range(1).select(c).first()[0]


def relevant_flag(question: Column, entity: Column, rules: AnswerRules) -> Column:
    """Whether a chunk (text, title, pdf) bears on a question and its entity under the collection's rules."""
    phrases, words = retrieve.relevance_terms(question, entity, rules.stopwords, rules.relevance)
    low = F.lower(question)

    def fits(alternatives: tuple[tuple[str, ...], ...]) -> Callable[[Column], Column]:
        def any_of(t: Column) -> Column:
            out = F.lit(False)
            for needed in alternatives:
                every = F.lit(True)
                for w in needed:
                    every &= t.contains(w)
                out |= every
            return out

        return any_of

    topics = [(low.rlike(p), fits(alternatives)) for p, alternatives in rules.topics]
    return retrieve.relevant(T.ascii_key(F.concat_ws(" ", "text", "title", "pdf")), phrases, words, topics=topics)


def question_queries(spark: SparkSession, question: str, entity: str | None, rules: AnswerRules) -> list[str]:
    """The distinct queries of a question: itself, the expansions it asks for, the ways to ask for its entity; at most eight."""
    asked = spark.createDataFrame([("q", question, entity)], "q_id string, question string, entity string")
    table = spark.createDataFrame([(i, p, e) for i, (p, es) in enumerate(rules.expansions) for e in es] or [(0, "(?!)", "")], "rule_no int, pattern string, expansion string")
    base = retrieve.expand_queries(asked, table).select(F.struct(F.lit(0).alias("part"), "ordinal", "query").alias("o"))
    named = retrieve.entity_queries(asked, rules.entity_templates, rules.entity_queries, lambda e: match.query_variants(e, rules.prefix, rules.spellings))
    every = base.unionByName(named.select(F.struct(F.lit(1).alias("part"), "ordinal", "query").alias("o")))
    numbered = every.withColumn("ordinal", F.row_number().over(Window.orderBy("o"))).select("ordinal", "o.query")
    return [r.query for r in retrieve.distinct_queries(numbered).orderBy("ordinal").collect()]


def _check_model(rows: DataFrame, embedder: Embedder) -> None:
    stored = rows.select("model").where("model is not null").limit(1).collect()
    if stored and stored[0].model != embedder.model:
        raise ValueError(f"the collection's vectors are of {stored[0].model}, the question's of {embedder.model}")


def _vector_hits(rows: DataFrame, embedder: Embedder, queries: list[str], k: int, entity: str | None, rules: AnswerRules, where: Column | None) -> DataFrame:
    spark = rows.sparkSession
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(embedder(queries))], "q_id int, q_vector array<float>")
    hits = retrieve.knn(rows, vectors, k, "id", where=where).withColumnRenamed("q_id", "ordinal")
    found = hits.select("ordinal", "rank", "id").join(rows.drop("embedding"), "id")
    boost = None if not (entity and rules.boost_prefix) else F.col("pdf").startswith(rules.boost_prefix)
    return retrieve.fuse(found, retrieve.chunk_key(), k, boost)


def arabic_hits(rows: DataFrame, question: str, vector: DataFrame, k: int, rules: AnswerRules, names: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Lexical hits of an Arabic question first, then the vector hits, each chunk once, the first k."""
    spark = rows.sparkSession
    q, listed = F.lit(question), F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    terms = _value(spark, retrieve.lexical_terms(q, rules.arabic_stopwords, rules=rules.arabic_terms, names=F.slice(listed, 1, 3)))
    phrases = _value(spark, retrieve.lexical_phrases(q, rules.arabic_stopwords, rules.arabic_prefix, F.slice(listed, 1, 4)))
    haystack = T.arabic_search(F.concat_ws(" ", "text", "title", "pdf"))
    key = ["title", "pdf", "page", "chunk_index", F.substring("text", 1, 80)]
    lexical = retrieve.lexical_search(rows if where is None else rows.where(where), haystack, terms, phrases, key, ["id"], k)
    head = F.substring("text", 1, 100)
    cols = [c for c in rows.columns if c != "embedding"]
    merged = retrieve.hybrid(lexical.select(*cols, head.alias("_head"), "position"), vector.select(*cols, head.alias("_head"), "position"), ["_head"], k)
    return merged.drop("_head")


def answer(
    question: str, collection: Collection, embedder: Embedder, generator: Generator, rules: AnswerRules = AnswerRules(), top_k: int = 8,
    entity: str | None = None, where: Column | None = None, original: str | None = None, names: Sequence[str] = (), language: str | None = None,
) -> Answer:
    """Retrieve, filter and hand on: everything up to the prompt is one plan over the collection.

    Arabic questions merge lexical and vector hits. An empty result is tried once more from the
    ``original`` question with the most results; no chunks give the no-source answer in the question's language.
    """
    spark = collection.spark
    rows = collection.read()
    _check_model(rows, embedder)
    broad, defines, language = spark.range(1).select(retrieve.broad_list(F.lit(question), rules.broad_nouns), retrieve.definition(F.lit(question)), T.detect_language(F.lit(language), F.lit(question))).first()
    arabic = language == "ar"
    k, retrieve_k = retrieve.retrieval_k(top_k, broad, defines, arabic)
    for seed, n in dict.fromkeys(((question, retrieve_k), (original or question, retrieve.MOST_RESULTS))):
        queries = [seed] if arabic else question_queries(spark, seed, entity, rules)
        fused = _vector_hits(rows, embedder, queries, n, entity, rules, where)
        if arabic:
            fused = arabic_hits(rows, seed, fused, n, rules, names, where)
        flag = relevant_flag(F.lit(question if entity else seed), F.lit(entity), rules)
        kept, counts = retrieve.relevance_split(fused, flag)
        kept = kept.withColumn("rank", F.col("position") + 1).cache()
        counted = counts.first()
        if counted.accepted:
            break
    if not counted.accepted:
        return Answer(rules.no_source.get(language, rules.no_source.get("en", "")), n_rejected=counted.rejected)
    context = retrieve.context(kept).first().context
    text = generator(f"Answer from the sources only.\n\n{context}\n\nQuestion: {question}")
    sources = [r.asDict() for r in retrieve.distinct_sources(kept).orderBy("position").drop("position").collect()]
    grounded = _value(spark, retrieve.grounding(F.lit(text), F.lit(counted.accepted), rules.none_phrases, rules.hedges))
    kept.unpersist()
    options = _value(spark, converse.follow_up_options(F.lit(f"{text} {question}"), rules.follow_ups, ())) if rules.follow_ups else []
    return Answer(text, sources[: retrieve.MOST_SOURCES], grounded, counted.accepted, counted.rejected, list(options))


@dataclass(frozen=True)
class NameIndex:
    """Names that questions are about: ``keys`` as of ``match.name_keys``, hand-kept ``aliases`` (canonical, alias, alias_key), and for Arabic ``names`` (name, name_key)."""

    keys: DataFrame
    key: Callable[[Column], Column]
    aliases: DataFrame | None = None
    arabic: DataFrame | None = None


def chat(question: str, history: Sequence[tuple[str, str]], collections: Mapping[str, Collection], index: NameIndex, embedder: Embedder, generator: Generator, rules: AnswerRules = AnswerRules(), top_k: int = 8, mode: str = "", language: str | None = None) -> Answer:
    """Answer a question of a conversation; ``history`` is its (role, content) so far, ``collections`` go by language.

    A figure chooses from the last list, a name that may be several gives them as options, a request
    for names gives the matches; other questions are filled in from the history, get their entity from
    the aliases or the history, and are answered from the language's collection.
    """
    original = question.strip()
    if not original:
        raise ValueError("the question is empty")
    spark = next(iter(collections.values())).spark
    language = _value(spark, T.detect_language(F.lit(language), F.lit(original)))
    asked = spark.createDataFrame([(original,)], "query string").withColumn("query_key", index.key(F.col("query")))
    entity = None
    if index.aliases is not None:
        hit = match.alias_hit(asked, index.aliases).collect()
        entity = hit[0].canonical if hit else None
    if language == "ar":
        where, names = retrieve.mode_filter(mode, dict(rules.mode_titles)), []
        if index.arabic is not None:
            keys = match.arabic_query_keys(asked.select("query"), rules.arabic_stopwords, rules.arabic_prefix)
            names = [r.name for r in match.search_arabic(index.arabic, keys, limit=4).orderBy("rank").collect()]
        return answer(original, collections["ar"], embedder, generator, rules, top_k, where=where, names=names, language=language)
    messages = spark.createDataFrame([("c", i + 1, r, t) for i, (r, t) in enumerate(history)], "conversation_id string, sort_order int, role string, content string")
    lists = messages.where("role = 'assistant'").select("conversation_id", "sort_order", entities.list_items(F.col("content")).alias("l")).where("size(l) > 0")
    lists = lists.groupBy("conversation_id").agg(F.max_by("l", "sort_order").alias("l")).select("conversation_id", F.posexplode("l").alias("i", "name")).select("conversation_id", (F.col("i") + 1).alias("ordinal"), "name")
    number = spark.createDataFrame([("c", original)], "conversation_id string, question string")
    choice = converse.numbered_choice(number, lists).first().choice
    question = original
    if choice:
        entity, question = choice, f"{choice}"
    else:
        last = converse.last_entity(messages, index.keys, index.key).collect()
        talked = last[0].entity if last else None
        question = _value(spark, converse.rewrite_question(F.lit(original), F.lit(talked), list(rules.rewrites)))
        if question != original:
            entity = entity or talked
    if entity is None:
        title_words = list(rules.titles)
        named = _value(spark, match.ambiguous_name(F.lit(question), title_words))
        wanted = None
        if rules.intents:
            got = spark.createDataFrame([(question,)], "question string").select(match.intent(F.col("question"), list(rules.intents)).alias("i")).select("i.mode", "i.subject")
            wanted = match.confirmed_intents(got, index.keys, title_words, index.key).first()
        subject = named or (wanted.subject if wanted and wanted.mode == "list" else None)
        if subject:
            bare = spark.createDataFrame([(subject,)], "query string").withColumn("query_key", index.key(F.col("query")))
            found = match.search(index.keys, bare, limit=10).orderBy("rank")
            options = [r.name for r in found.collect()]
            if len(options) > 1:
                return Answer(rules.choose % subject, options=options, entities=options)
    return answer(question, collections["en"], embedder, generator, rules, top_k, entity=entity, original=original, language=language)
