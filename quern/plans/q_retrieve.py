"""Queries over retrieval: vectors, words, merges, relevance, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import ingest, match, retrieve
from quern.operators.ranking import numbered, top_per_group
from quern.plans import registry as R
from quern.plans.registry import query, table
from quern.sources.tables import text_table

#: Queries are all vectors whose id is divisible by this, against all vectors.
_EACH = 100
_DIST = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
_KNN = f"""q AS (SELECT vec_id AS q_id, embedding FROM embeddings WHERE vec_id % {_EACH} = 0),
  near AS (SELECT q.q_id, e.vec_id, e.label, round({_DIST}, 6) AS distance, {_DIST} AS exact FROM embeddings e, q),
  r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY exact, vec_id) AS rank FROM near)"""
_CHUNKS = "c AS (SELECT id, min(text) AS text, min(title) AS title, min(pdf) AS pdf, min(page) AS page, min(url) AS url, min(source_type) AS source_type, min(chunk_index) AS chunk_index FROM chunks GROUP BY id)"
#: Chunks in the order of their ids' hashes carry the vectors 0, 1, ..
_CARRIED = f"{_CHUNKS}, cv AS (SELECT *, row_number() OVER (ORDER BY md5(id)) - 1 AS vec_id FROM c)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e, e.where(F.col("vec_id") % _EACH == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vector"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once by id; the texts of the few rows stored twice are equal, so the smallest of each column is the row."""
    columns = ("text", "title", "pdf", "page", "url", "source_type", "chunk_index")
    return text_table(spark, d, "chunks").groupBy("id").agg(*[F.min(c).alias(c) for c in columns])


def _carried(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the vector of their place (vec_id, label, embedding)."""
    ids = numbered(table(spark, d, "chunks").select("id", F.md5("id").alias("m")).distinct(), ["m"], "vec_id").drop("m").withColumn("vec_id", F.col("vec_id").cast("long"))
    return _chunks(spark, d).join(ids, "id").join(table(spark, d, "embeddings"), "vec_id")


@query(f"WITH {_KNN} SELECT q_id, vec_id, distance, rank::INT AS rank FROM r WHERE rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return retrieve.knn(e, q, 10, "vec_id").withColumn("distance", F.round("distance", 6))


@query(f"WITH {_KNN.replace('FROM embeddings e, q', 'FROM embeddings e, q WHERE e.label = 1')} SELECT q_id, vec_id, distance, rank::INT AS rank FROM r WHERE rank <= 10")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return retrieve.knn(e, q, 10, "vec_id", where=F.col("label") == 1).withColumn("distance", F.round("distance", 6))


_TITLED = "FROM (SELECT e.* FROM embeddings e JOIN cv USING (vec_id) WHERE cv.title = 'saints great synaxar') e, q"


@query(f"WITH {_CARRIED}, {_KNN.replace('FROM embeddings e, q', _TITLED)} SELECT q_id, vec_id, distance, rank::INT AS rank FROM r WHERE rank <= 5")
def knn_mode(spark: SparkSession, d: str) -> DataFrame:
    """A mode that has one collection's title searches its chunks only."""
    where = retrieve.mode_filter("saints", {"saints": "saints great synaxar"})
    return retrieve.knn(_carried(spark, d), _vectors(spark, d)[1], 5, "vec_id", where=where).withColumn("distance", F.round("distance", 6))


#: Queries of one request: eight neighbours in the order of their ids.
_REQUEST = 8 * _EACH


def _hits(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    """Hits (request, ordinal, rank, vec_id and the chunk's columns) of every query."""
    found = retrieve.knn(*_vectors(spark, d), n, "vec_id")
    chunk = _carried(spark, d).drop("embedding", "label")
    return found.join(chunk, "vec_id").withColumn("request", F.floor(F.col("q_id") / _REQUEST)).withColumnRenamed("q_id", "ordinal")


_HITS = f"h AS (SELECT q_id // {_REQUEST} AS request, q_id AS ordinal, rank, cv.* FROM r JOIN cv USING (vec_id) WHERE rank <= 10)"
_FUSED = "f AS (SELECT *, row_number() OVER (PARTITION BY request, coalesce(source_type, 'pdf'), pdf, page, url, chunk_index, substr(text, 1, 120) ORDER BY ordinal, rank) AS first FROM h)"


@query(f"""WITH {_CARRIED}, {_KNN}, {_HITS}, {_FUSED}, p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ordinal, rank) - 1 AS position FROM f WHERE first = 1)
  SELECT request, ordinal, rank::INT AS rank, id, position::INT AS position FROM p WHERE position < 16""")
def multi_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.fuse_each(_hits(spark, d), "request", retrieve.chunk_key(), 16).select("request", "ordinal", "rank", "id", "position")


@query(f"""WITH {_CARRIED}, {_KNN}, {_HITS}, {_FUSED}, p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY coalesce(starts_with(pdf, 'saints'), false) DESC, ordinal, rank) - 1 AS position FROM f WHERE first = 1)
  SELECT request, ordinal, rank::INT AS rank, id, position::INT AS position FROM p WHERE position < 16""")
def entity_boost(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.fuse_each(_hits(spark, d), "request", retrieve.chunk_key(), 16, boost=F.col("pdf").startswith("saints")).select("request", "ordinal", "rank", "id", "position")


@query(f"""WITH m AS (SELECT sort_order AS ordinal, {R.collapse('content')} AS query FROM chat_messages WHERE content IS NOT NULL AND sort_order IS NOT NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY lower(query) ORDER BY ordinal, query) AS n FROM m WHERE query <> '')
  SELECT ordinal, query FROM f WHERE n = 1 ORDER BY ordinal, query LIMIT 8""")
def distinct_queries(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").where("content is not null and sort_order is not null")
    return retrieve.distinct_queries(m.select(F.col("sort_order").alias("ordinal"), F.col("content").alias("query")))


_EXPANSIONS = [(0, "fast", "fasting and prayer"), (1, "fast", "the great fast"), (2, "^who (was|is)", "life and teaching"), (3, "feast", "the calendar of feasts")]


@query(f"""WITH q AS (SELECT DISTINCT id, content FROM chat_messages WHERE content IS NOT NULL AND lower(trim(role)) = 'user'), r(rule_no, pattern, expansion) AS (VALUES {', '.join(f"({n}, '{p}', '{e}')" for n, p, e in _EXPANSIONS)})
  SELECT id AS q_id, -1 AS ordinal, content AS query FROM q UNION ALL SELECT id, rule_no, expansion FROM q JOIN r ON regexp_matches(lower(content), pattern)""")
def query_expand(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "chat_messages").where("content is not null and lower(trim(role)) = 'user'").select(F.col("id").alias("q_id"), F.col("content").alias("question")).distinct()
    return retrieve.expand_queries(q, spark.createDataFrame(_EXPANSIONS, "rule_no int, pattern string, expansion string"))


_ENTITY = "coalesce(regexp_extract(content, '(?i)^(?:who was|who is|tell me about) (.+?)[?.!]*$', 1), '')"
_E_TEMPLATES = [("teach", ["{entity} teaching", "sayings of {entity}"]), ("feast", ["feast of {entity}"])]


@query(f"""WITH m AS (SELECT DISTINCT id, content, {_ENTITY} AS entity FROM chat_messages WHERE content IS NOT NULL AND lower(trim(role)) = 'user'), n AS (SELECT id, content, trim(regexp_replace(entity, '\\s+', ' ', 'g')) AS entity FROM m WHERE entity <> ''),
  v AS (SELECT *, [entity, regexp_replace(entity, '(?i)^(?:st\\.?|saint)\\s+', ''), 'St. ' || regexp_replace(entity, '(?i)^(?:st\\.?|saint)\\s+', '')] AS vs FROM n),
  u AS (SELECT id, list_concat(CASE WHEN regexp_matches(lower(content), 'teach') THEN [entity || ' teaching', 'sayings of ' || entity] ELSE [] END, CASE WHEN regexp_matches(lower(content), 'feast') THEN ['feast of ' || entity] ELSE [] END,
    list_transform({R.once_lower('vs')}, lambda x: x || ' life and teachings'), {R.once_lower('vs')}) AS qs FROM v)
  SELECT id AS q_id, (i - 1)::INT AS ordinal, qs[i] AS query FROM u, LATERAL (SELECT unnest(range(1, len(qs) + 1)) AS i)""")
def entity_queries(spark: SparkSession, d: str) -> DataFrame:
    entity = F.regexp_extract("content", r"(?i)^(?:who was|who is|tell me about) (.+?)[?.!]*$", 1)
    q = table(spark, d, "chat_messages").where("content is not null and lower(trim(role)) = 'user'").select(F.col("id").alias("q_id"), F.col("content").alias("question"), T.collapse(entity).alias("entity")).distinct()
    return retrieve.entity_queries(q, _E_TEMPLATES, ["{entity} life and teachings"], lambda e: match.query_variants(e, "St."))


_TERMS, _PHRASES = ["desert", "well", "silence"], ["desert well", "the old oil lamp"]
_SCORE = f"""{' + '.join(f"10 * contains(h, '{t}')::INT" for t in _TERMS)} + {' + '.join(f"120 * contains(h, '{p}')::INT" for p in _PHRASES)}
  + 25 * (contains(h, '{_TERMS[0]}') AND contains(h, '{_TERMS[1]}'))::INT + 40 * contains(h, '{' '.join(_TERMS[:2])}')::INT"""
_LEX = f"""{_CHUNKS}, h AS (SELECT *, lower(concat_ws(' ', text, title, pdf)) AS h FROM c), s AS (SELECT *, {_SCORE} AS score FROM h),
  k AS (SELECT *, row_number() OVER (PARTITION BY title, pdf, page, chunk_index, substr(text, 1, 80) ORDER BY score DESC, coalesce(page, 0), id) AS n FROM s WHERE score > 0)"""


def _haystack() -> Column:
    return F.lower(F.concat_ws(" ", "text", "title", "pdf"))


def _lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    key = ["title", "pdf", "page", "chunk_index", F.substring("text", 1, 80)]
    return retrieve.lexical_search(_chunks(spark, d), _haystack(), _TERMS, _PHRASES, key, ["id"], k)


@query(f"WITH {_LEX} SELECT id, score::INT AS score, (row_number() OVER (ORDER BY score DESC, coalesce(page, 0), id) - 1)::INT AS position FROM k WHERE n = 1 ORDER BY score DESC, coalesce(page, 0), id LIMIT 16")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, 40).select("id", "score", "position")


@query(f"WITH {_LEX} SELECT id, score::INT AS score FROM s WHERE score > 0")
def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", retrieve.lexical_score(_haystack(), _TERMS, _PHRASES).alias("score")).where("score is not null")


_AR_RULES = [("كتب", ["كتاب", "الرسائل"]), ("اسقف", ["الاسقفيه"])]


@query(f"""WITH s0 AS (SELECT id, name_ar FROM saints_ar_seed UNION SELECT id, name_ar FROM saints_ar_generated), s1 AS (SELECT id, {R.nfkc('name_ar')} AS name_ar FROM s0), s AS (SELECT id, {R.arabic_key(R.arabic_display('name_ar'))} AS k FROM s1), w AS (SELECT id, k, list_filter(string_split(k, ' '), lambda x: regexp_matches(x, '[\\x{{600}}-\\x{{6ff}}]')) AS ws FROM s),
  t AS (SELECT id, k, list_concat(list_filter(ws, lambda x: length(x) >= 3 AND x NOT IN ('القديس')), CASE WHEN regexp_matches(k, 'كتب') THEN ['كتاب', 'الرسائل'] ELSE [] END, CASE WHEN regexp_matches(k, 'اسقف') THEN ['الاسقفيه'] ELSE [] END, ['نجم']) AS terms,
    array_to_string(list_filter(list_transform(list_filter(ws, lambda x: x NOT IN ('القديس')), lambda x: CASE WHEN starts_with(x, 'ال') AND length(x) > 2 THEN substr(x, 3) ELSE x END), lambda x: x <> '' AND x NOT IN ('القديس')), ' ') AS bare FROM w)
  SELECT id, array_to_string({R.distinct('terms')}, '|') AS terms, array_to_string(list_filter({R.distinct("[k, bare, 'نجم البحر']")}, lambda p: length(p) >= 3), '|') AS phrases FROM t""")
def lexical_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms and phrases of every name of the index as a question, with rules and a name found in the index."""
    names = table(spark, d, "saints_ar_seed").select("id", "name_ar").unionByName(table(spark, d, "saints_ar_generated").select("id", "name_ar")).distinct()
    n = F.col("name_ar")
    terms = retrieve.lexical_terms(n, ["القديس"], rules=_AR_RULES, names=F.array(F.lit("نجم")))
    phrases = retrieve.lexical_phrases(n, ["القديس"], "ال", names=F.array(F.lit("نجم البحر")))
    return names.select("id", F.array_join(terms, "|").alias("terms"), F.array_join(phrases, "|").alias("phrases"))


@query(f"""WITH {_LEX}, cv AS (SELECT *, row_number() OVER (ORDER BY md5(id)) - 1 AS vec_id FROM c), {_KNN}, q0 AS (SELECT DISTINCT q_id FROM r),
  l AS (SELECT id, substr(text, 1, 100) AS head, row_number() OVER (ORDER BY score DESC, coalesce(page, 0), id) - 1 AS p FROM k WHERE n = 1), v AS (SELECT q_id, id, substr(text, 1, 100) AS head, rank - 1 AS p FROM r JOIN cv USING (vec_id) WHERE rank <= 10),
  u AS (SELECT q_id, id, head, 0 AS part, p FROM l, q0 WHERE p < 8 UNION ALL SELECT q_id, id, head, 1, p FROM v), f AS (SELECT *, row_number() OVER (PARTITION BY q_id, head ORDER BY part, p) AS n FROM u),
  o AS (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY part, p) - 1 AS position FROM f WHERE n = 1) SELECT q_id, id, position::INT AS position FROM o WHERE position < 12""")
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    """The lexical hits of the words asked for before the vector hits of each query."""
    head = F.substring("text", 1, 100).alias("head")
    lexical = _lexical(spark, d, 8).select("id", head, "position")
    vector = _hits(spark, d).select(F.col("ordinal").alias("q_id"), "id", head, (F.col("rank") - 1).alias("position"))
    asked = _vectors(spark, d)[1].select("q_id")
    return retrieve.hybrid_each(asked.join(F.broadcast(lexical)), vector, "q_id", ["head"], 12).select("q_id", "id", "position")


STOP = ["who", "was", "what", "did", "the", "and", "for", "about", "tell", "please", "explain", "teach", "brothers"]
_FIRST = f"""m AS (SELECT sort_order AS ordinal, {R.collapse('content')} AS query FROM chat_messages WHERE content IS NOT NULL AND sort_order IS NOT NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY lower(query) ORDER BY ordinal, query) AS n FROM m WHERE query <> ''), eight AS (SELECT ordinal, query FROM f WHERE n = 1 ORDER BY ordinal, query LIMIT 8),
  q AS (SELECT list_filter(string_split({R.ascii_key('query')}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(f"'{x}'" for x in STOP)})) AS ks FROM eight), u AS (SELECT DISTINCT {R.distinct('ks')} AS ks FROM q)"""


@query(f"""WITH {_CHUNKS}, t AS (SELECT id, {R.ascii_key("concat_ws(' ', text, title, pdf)")} AS h FROM c), q1(ks) AS (VALUES (['desert', 'well', 'silence']), (['lamp']), (['unheard', 'desert'])),
  x AS (SELECT array_to_string(ks, ' ') AS q, count(*) FILTER (WHERE h <> '' AND len(list_filter(ks, lambda w: contains(h, w))) >= least(2, len(ks))) AS accepted, count(*) AS total FROM t, q1 GROUP BY 1)
  SELECT q, accepted, total - accepted AS rejected FROM x""")
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    """Counts for three questions in one pass: a chunk given twice is one chunk, so ids are counted, not texts compared."""
    asked = (["desert", "well", "silence"], ["lamp"], ["unheard", "desert"])
    none = F.array().cast("array<string>")
    text = T.ascii_key(F.concat_ws(" ", "text", "title", "pdf"))
    flags = T.let(text, lambda t: F.array(*[retrieve.relevant(t, none, F.array(*[F.lit(k) for k in ks])) for ks in asked]))
    once = text_table(spark, d, "chunks").select("id", flags.alias("ok")).groupBy("id").agg(F.max("ok").alias("ok"))
    counts = once.agg(*[F.count_if(F.col("ok")[i]).alias(f"n{i}") for i in range(len(asked))], F.count("*").alias("total"))
    rows = F.array(*[F.struct(F.lit(" ".join(ks)).alias("q"), F.col(f"n{i}").alias("accepted"), (F.col("total") - F.col(f"n{i}")).alias("rejected")) for i, ks in enumerate(asked)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


_R_RULES = [("desert|well", ("the desert well", "wells of the desert"), ("well", "desert", "cedar"))]
_REL = f"""m AS (SELECT DISTINCT id, content, {_ENTITY} AS entity FROM chat_messages WHERE content IS NOT NULL AND lower(trim(role)) = 'user'),
  p AS (SELECT id, {R.distinct(f"list_filter(list_concat([{R.ascii_key('entity')}], CASE WHEN regexp_matches(lower(content), 'desert|well') THEN ['the desert well', 'wells of the desert'] ELSE [] END), lambda v: v <> '')")} AS phrases,
    list_filter(list_concat(%s, %s, CASE WHEN regexp_matches(lower(content), 'desert|well') THEN ['well', 'desert', 'cedar'] ELSE [] END), lambda v: v <> '') AS ks FROM m)"""
_WORDS = "list_filter(string_split({0}, ' '), lambda w: length(w) >= 3 AND w NOT IN ('who', 'was', 'the'))"
_REL = _REL % (_WORDS.format(R.ascii_key("content")), _WORDS.format(R.ascii_key("entity")))


@query(f"WITH {_REL} SELECT id, array_to_string(phrases, '|') AS phrases, array_to_string({R.distinct('ks')}, '|') AS keywords FROM p")
def relevance_terms(spark: SparkSession, d: str) -> DataFrame:
    """What bears on every question: its words, its entity, and what a rule adds."""
    q = table(spark, d, "chat_messages").where("content is not null and lower(trim(role)) = 'user'").select("id", "content").distinct()
    entity = F.regexp_extract("content", r"(?i)^(?:who was|who is|tell me about) (.+?)[?.!]*$", 1)
    phrases, keywords = retrieve.relevance_terms(F.col("content"), entity, ["who", "was", "the"], _R_RULES)
    return q.select("id", F.array_join(phrases, "|").alias("phrases"), F.array_join(keywords, "|").alias("keywords"))


@query(f"""WITH t AS (SELECT DISTINCT id, {R.ascii_key("concat_ws(' ', text, title, pdf)")} AS h FROM chunks)
  SELECT id, h <> '' AND (contains(h, 'half burnt candle') OR contains(h, 'desert') AND (contains(h, 'well') OR contains(h, 'lamp'))) AS accepted FROM t""")
def relevance_topic(spark: SparkSession, d: str) -> DataFrame:
    """A question of a topic is judged by the topic's condition, and phrases still decide first."""
    topic = (F.lit("where is the desert well").contains("desert well"), lambda t: t.contains("desert") & (t.contains("well") | t.contains("lamp")))
    flag = retrieve.relevant(T.ascii_key(F.concat_ws(" ", "text", "title", "pdf")), F.array(F.lit("half burnt candle")), F.array(F.lit("nothing")), topics=[topic])
    return text_table(spark, d, "chunks").select("id", flag.alias("accepted")).distinct()


@query(f"""WITH w AS (SELECT doc_id, title, i, {R.strip("substr(text, (i * 3100 + 1)::BIGINT, 3500)")} AS chunk FROM documents, LATERAL (SELECT unnest(range(0, greatest(0, ceil((length(text) - 3500) / 3100.0))::BIGINT + 1)) AS i) WHERE text IS NOT NULL),
  c AS (SELECT doc_id, title, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, chunk FROM w WHERE chunk <> ''),
  h AS (SELECT *, {R.ascii_key("concat_ws(' ', chunk, title)")} AS h FROM c), q AS (SELECT ['desert', 'well', 'silence'] AS ks),
  s AS (SELECT doc_id, chunk_index, substr(chunk, 1, 240) AS preview, len(list_filter(ks, lambda k: contains(h, k))) AS hits FROM h, q)
  SELECT doc_id, chunk_index, preview, hits::INT AS hits FROM s WHERE hits >= 2 ORDER BY hits DESC, doc_id, chunk_index LIMIT 16""")
def relevant_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: documents to chunks to the ones that answer a question best."""
    words = F.array(*[F.lit(w) for w in ("desert", "well", "silence")])
    chunks = ingest.chunks(text_table(spark, d, "documents").select("doc_id", "title", "text"))
    text = T.ascii_key(F.concat_ws(" ", "text", "title"))
    hits = T.let(text, lambda t: retrieve.keyword_hits(t, words))
    found = chunks.where(retrieve.relevant(text, F.array().cast("array<string>"), words))
    return found.select("doc_id", "chunk_index", F.substring("text", 1, 240).alias("preview"), hits.alias("hits")).orderBy(F.desc("hits"), "doc_id", "chunk_index").limit(16)


@query(f"""WITH {_FIRST}, {_CHUNKS}, t AS (SELECT id, {R.ascii_key("concat_ws(' ', text, title, pdf)")} AS h FROM c),
  x AS (SELECT array_to_string(ks, ' ') AS q, id, len(list_filter(ks, lambda w: contains(h, w))) AS hits FROM u, t WHERE h <> '' AND len(list_filter(ks, lambda w: contains(h, w))) >= least(2, len(ks))),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hits DESC, id) AS rank FROM x) SELECT q, id, hits::INT AS hits, rank::INT AS rank FROM r WHERE rank <= 5""")
def question_batch(spark: SparkSession, d: str) -> DataFrame:
    """The questions of one request (at most eight) against every chunk: a stated query set against all rows."""
    m = table(spark, d, "chat_messages").where("content is not null and sort_order is not null")
    asked = retrieve.distinct_queries(m.select(F.col("sort_order").alias("ordinal"), F.col("content").alias("query")))
    words = asked.select(T.keywords(F.col("query"), STOP).alias("ks")).distinct()
    texts = _chunks(spark, d).select("id", T.ascii_key(F.concat_ws(" ", "text", "title", "pdf")).alias("h"))
    flag = retrieve.relevant(F.col("h"), F.array().cast("array<string>"), F.col("ks"))
    pairs = texts.join(F.broadcast(words), flag).select(F.array_join("ks", " ").alias("q"), "id", F.size(F.filter("ks", lambda w: F.col("h").contains(w))).alias("hits"))
    return top_per_group(pairs, ["q"], [F.desc("hits"), "id"], 5)


@query(f"""WITH m AS (SELECT DISTINCT id, content FROM chat_messages WHERE content IS NOT NULL)
  SELECT id, regexp_matches(lower(content), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:list|show|name|what are|which are|give me)(?:[^\\p{{L}}\\p{{N}}_]|$)') AND regexp_matches(lower(content), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:feast|saints|brothers)(?:[^\\p{{L}}\\p{{N}}_]|$)') AS broad,
    regexp_matches(content, '(?i)^\\s*(?:who|what)\\s+(?:is|are|were|was)(?:[^\\p{{L}}\\p{{N}}_]|$)') AS defines FROM m""")
def question_kind(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").where("content is not null").select("id", "content").distinct()
    return m.select("id", retrieve.broad_list(F.col("content"), ["feast", "saints", "brothers"]).alias("broad"), retrieve.definition(F.col("content")).alias("defines"))


_LABEL = """CASE WHEN source_type = 'website' THEN CASE WHEN trim(coalesce(title, '')) <> '' AND trim(coalesce(url, '')) <> '' THEN trim(title) || ' (' || trim(url) || ')' WHEN trim(coalesce(title, '')) <> '' THEN trim(title)
  WHEN trim(coalesce(url, '')) <> '' THEN trim(url) ELSE 'website source' END ELSE coalesce(pdf, 'unknown.pdf') || ' p.' || coalesce(page, 0) END"""


@query(f"WITH {_CHUNKS} SELECT id, {_LABEL} AS label, CASE WHEN source_type = 'website' THEN 'website' ELSE 'pdf' END AS kind FROM c")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", retrieve.context_label().alias("label"), retrieve.source_of()["source_type"].alias("kind"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every query's hits, by request-wide rank."""
    return _hits(spark, d).withColumnRenamed("ordinal", "q_id")


_RANKED = f"{_CARRIED}, {_KNN}, ranked AS (SELECT q_id, rank, cv.* FROM r JOIN cv USING (vec_id) WHERE rank <= 10)"


@query(f"""WITH {_RANKED}, s AS (SELECT q_id, rank, CASE WHEN source_type = 'website' THEN 'website' ELSE 'pdf' END AS source_type, CASE WHEN source_type = 'website' THEN NULL ELSE coalesce(pdf, 'unknown.pdf') END AS pdf,
    CASE WHEN source_type = 'website' THEN NULL ELSE coalesce(page, 0) END AS page, CASE WHEN source_type = 'website' THEN nullif(trim(url), '') END AS url, CASE WHEN source_type = 'website' THEN nullif(trim(title), '') END AS title FROM ranked),
  f AS (SELECT *, row_number() OVER (PARTITION BY q_id, source_type, pdf, page, url, title ORDER BY rank) AS n FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) - 1 AS position FROM f WHERE n = 1)
  SELECT q_id, source_type, pdf, page, url, title, position::INT AS position FROM o WHERE position < 6""")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.distinct_sources(_ranked(spark, d), group=["q_id"])


@query(f"WITH {_RANKED} SELECT q_id, string_agg('[Source: ' || {_LABEL} || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM ranked GROUP BY q_id")
def context_concat(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.context(_ranked(spark, d), ["q_id"])


@query(f"""WITH {_RANKED}, t AS (SELECT *, contains({R.ascii_key("concat_ws(' ', text, title, pdf)")}, 'saint') AS ok FROM ranked) SELECT q_id, count(*) AS n_chunks, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected, coalesce(array_to_string(list({_LABEL} ORDER BY rank) FILTER (WHERE rank <= 3), '|'), '') AS top,
  coalesce(array_to_string(list(substr({R.collapse("coalesce(text, '')")}, 1, 180) ORDER BY rank) FILTER (WHERE rank <= 3), '|'), '') AS previews FROM t GROUP BY q_id""")
def retrieval_log(spark: SparkSession, d: str) -> DataFrame:
    flag = retrieve.relevant(T.ascii_key(F.concat_ws(" ", "text", "title", "pdf")), F.array().cast("array<string>"), F.array(F.lit("saint")))
    logs = retrieve.retrieval_log(_ranked(spark, d).withColumn("accepted", flag), ["q_id"])
    return logs.withColumns({"top": F.array_join("top", "|"), "previews": F.array_join("previews", "|")})


@query("""WITH m AS (SELECT DISTINCT id, content FROM chat_messages WHERE content IS NOT NULL),
  f AS (SELECT id, length(content) % 20 AS asked, regexp_matches(lower(content), '(?:^|[^\\p{L}\\p{N}_])(?:list|show|name|what are|which are|give me)(?:[^\\p{L}\\p{N}_]|$)') AND regexp_matches(lower(content), '(?:^|[^\\p{L}\\p{N}_])(?:feast|saints|brothers)(?:[^\\p{L}\\p{N}_]|$)') AS broad,
    regexp_matches(content, '(?i)^\\s*(?:who|what)\\s+(?:is|are|were|was)(?:[^\\p{L}\\p{N}_]|$)') AS defines, regexp_matches(content, '[\\x{600}-\\x{6ff}]') AS arabic FROM m), k AS (SELECT *, greatest(1, least(asked, 12)) AS k FROM f)
  SELECT id, k::INT AS k, least(16, greatest(k, CASE WHEN arabic THEN 10 WHEN broad THEN 12 WHEN defines THEN 10 ELSE k END))::INT AS retrieve_k FROM k""")
def retrieval_sizes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").where("content is not null").select("id", "content").distinct()
    c = F.col("content")
    sizes = retrieve.retrieval_sizes(F.length(c) % 20, retrieve.broad_list(c, ["feast", "saints", "brothers"]), retrieve.definition(c), T.has_arabic(c))
    return m.select("id", sizes["k"].alias("k"), sizes["retrieve_k"].alias("retrieve_k"))


@query("""WITH m AS (SELECT DISTINCT id, content, sources FROM chat_messages WHERE lower(trim(role)) = 'assistant')
  SELECT id, CASE WHEN coalesce(sources, '[]') = '[]' OR contains(lower(coalesce(content, '')), 'could not find') THEN 'no-source' WHEN contains(lower(coalesce(content, '')), 'is remembered') THEN 'partial' ELSE 'full' END AS grounding FROM m""")
def grounding_class(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").where("lower(trim(role)) = 'assistant'").select("id", "content", "sources").distinct()
    n = F.when(F.coalesce("sources", F.lit("[]")) == "[]", 0).otherwise(1)
    return m.select("id", retrieve.grounding(F.col("content"), n, ["could not find"], ["is remembered"]).alias("grounding"))
