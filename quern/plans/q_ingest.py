"""Queries over sources, chunking, text functions and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import ingest
from quern.operators.ranking import first_wins
from quern.plans import registry as R
from quern.plans.registry import query, table
from quern.sources import collections, files
from quern.sources.tables import shared_folder, text_table

TITLES = ["st", "saint", "saints", "mr", "dr"]


def _chunk_sql(source: str, key: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
    WITH src AS ({source}), wins AS (
      SELECT {key}, i, {R.strip(f"substr(text, (i * {step} + 1)::BIGINT, {size})")} AS chunk
      FROM src, LATERAL (SELECT unnest(range(0, greatest(0, ceil((length(text) - {size}) / {float(step)}))::BIGINT + 1)) AS i)
      WHERE text IS NOT NULL)
    SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY i) - 1)::INT AS chunk_index, chunk AS text FROM wins WHERE chunk <> ''"""


@query(_chunk_sql("SELECT doc_id, text FROM documents", "doc_id", 3500, 400))
def chunk_fixed_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunks(text_table(spark, d, "documents").select("doc_id", "text"))


@query(f"""
    WITH c AS ({_chunk_sql("SELECT DISTINCT pdf, page, text FROM pdf_pages", "pdf, page", 600, 100)})
    SELECT pdf || '::p' || page || '::c' || chunk_index AS id, text, pdf, page, chunk_index, 'pdf' AS source_type, 'en' AS language FROM c""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pdf_pages").dropDuplicates(["pdf", "page"])
    return ingest.pdf_chunks(pages, "en", "scans", 600, 100).select("id", "text", "pdf", "page", "chunk_index", "source_type", "language")


@query(f"""
    WITH c AS ({_chunk_sql("SELECT doc_id, text FROM documents", "doc_id", 600, 100)})
    SELECT doc_id, chunk_index, text FROM c WHERE regexp_matches(text, '[é]')""")
def chunk_filtered_index_gaps(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunks(table(spark, d, "documents").select("doc_id", "text"), size=600, overlap=100, keep=lambda c: c.contains("é"))


@query(f"""
    WITH p AS (SELECT page_id, {R.strip(f"regexp_replace({R.strip('url')}, '#.*$', '')")} AS url, text FROM web_pages),
    c AS ({_chunk_sql("SELECT page_id, url, text FROM p WHERE url <> ''", "page_id, url", 3500, 400)})
    SELECT 'website::' || substr(sha1(url), 1, 16) || '::c' || chunk_index AS id, page_id, url, chunk_index, text FROM c""")
def web_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "web_pages").select("page_id", T.normalize_url(F.col("url")).alias("url"), "text").where("url != ''")
    return ingest.chunks(pages).select(ingest.web_chunk_id(F.col("url"), F.col("chunk_index")).alias("id"), "page_id", "url", "chunk_index", "text")


@query("SELECT id, greatest(1, ceil(length(text) / 4.0))::INT AS tokens FROM (SELECT DISTINCT id, text FROM chunks)")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", "text").distinct().select("id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""
    WITH RECURSIVE o AS (
      SELECT coalesce(source, '') AS source, doc_id, greatest(1, ceil(length(coalesce(text, '')) / 4.0))::BIGINT AS tokens,
             row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS n FROM documents),
    b AS (
      SELECT source, doc_id, tokens, n, 0::BIGINT AS batch_no, 1::BIGINT AS items, tokens AS total FROM o WHERE n = 1
      UNION ALL
      SELECT o.source, o.doc_id, o.tokens, o.n,
             CASE WHEN b.items >= 16 OR b.total + o.tokens > 2000 THEN b.batch_no + 1 ELSE b.batch_no END,
             CASE WHEN b.items >= 16 OR b.total + o.tokens > 2000 THEN 1 ELSE b.items + 1 END,
             CASE WHEN b.items >= 16 OR b.total + o.tokens > 2000 THEN o.tokens ELSE b.total + o.tokens END
      FROM b JOIN o ON o.source = b.source AND o.n = b.n + 1)
    SELECT source, doc_id, batch_no FROM b""")
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return ingest.greedy_batches(rows, "source", ["doc_id"], "tokens", 16, 2000).select("source", "doc_id", "batch_no")


@query(f"SELECT doc_id, {R.strip(f'''regexp_replace({R.strip('url')}, '#.*$', '')''')} AS url FROM documents WHERE url IS NOT NULL")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("url is not null").select("doc_id", T.normalize_url(F.col("url")).alias("url"))


@query(f"""
    WITH l AS (SELECT page_id, list_filter(list_transform(string_split(text, chr(10)), lambda v: {R.collapse('v')}), lambda v: length(v) >= 2) AS ls FROM web_pages)
    SELECT page_id, array_to_string({R.distinct('ls')}, chr(10)) AS text FROM l""")
def line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "web_pages").select("page_id", ingest.dedup_lines(F.col("text")).alias("text"))


@query("""
    WITH c AS (SELECT id, max(text) AS text, max(chunk_index) AS chunk_index FROM chunks GROUP BY id),
    old AS (SELECT id, text FROM c WHERE chunk_index <= 1), fresh AS (SELECT id, 'new: ' || text AS text FROM c WHERE chunk_index >= 1)
    SELECT id, text FROM old WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT id, text FROM fresh""")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").groupBy("id").agg(F.max("text").alias("text"), F.max("chunk_index").alias("chunk_index"))
    old, new = c.where("chunk_index <= 1").select("id", "text"), c.where("chunk_index >= 1").select("id", F.concat(F.lit("new: "), "text").alias("text"))
    return ingest.upsert(old, new)


@query("""
    WITH c AS (SELECT DISTINCT id, url, chunk_index FROM chunks), fresh AS (SELECT * FROM c WHERE url IS NOT NULL AND chunk_index = 0)
    SELECT id, url, chunk_index FROM c WHERE NOT (url IS NOT NULL AND url IN (SELECT url FROM fresh) AND id NOT IN (SELECT id FROM fresh))""")
def stale_delete(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "url", "chunk_index").distinct()
    return ingest.without_stale(c, c.where("url is not null and chunk_index = 0"))


@query("SELECT coalesce(source_type, 'pdf') AS source_type, count(*) AS n FROM chunks GROUP BY 1")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return collections.source_counts(table(spark, d, "chunks"))


@query("SELECT pdf, count(*) AS n FROM chunks WHERE trim(coalesce(pdf, '')) <> '' AND starts_with(pdf, 'saints') GROUP BY pdf")
def pdf_counts(spark: SparkSession, d: str) -> DataFrame:
    return collections.pdf_counts(table(spark, d, "chunks"), "saints")


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def lang_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query(f"""
    SELECT doc_id, substr({R.collapse('text')}, 1, 240) AS preview,
      CASE WHEN regexp_matches(coalesce(text, ''), '[\\x{{600}}-\\x{{6ff}}]') AND regexp_matches(coalesce(text, ''), '[A-Za-z]') THEN 'mixed'
           WHEN regexp_matches(coalesce(text, ''), '[\\x{{600}}-\\x{{6ff}}]') THEN 'ar' WHEN regexp_matches(coalesce(text, ''), '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS preview_language
    FROM documents ORDER BY doc_id LIMIT 3""")
def collection_sample(spark: SparkSession, d: str) -> DataFrame:
    return collections.sample(table(spark, d, "documents"), ["doc_id"])


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events WHERE json_valid(props)")
def json_keys(spark: SparkSession, d: str) -> DataFrame:
    return collections.json_keys(table(spark, d, "events"), "props")


@query(" UNION ALL ".join(f"SELECT '{c}' AS key WHERE EXISTS (SELECT 1 FROM chunks WHERE {c} IS NOT NULL)" for c in ("source_type", "url", "pdf", "title", "page", "chunk_index", "language", "source_group")))
def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    return collections.metadata_keys(table(spark, d, "chunks"), ["source_type", "url", "pdf", "title", "page", "chunk_index", "language", "source_group"])


@query("""
    SELECT count(DISTINCT pdf) AS n_files, (SELECT count(*) FROM (SELECT DISTINCT pdf, page FROM chunks WHERE pdf IS NOT NULL)) AS n_pages, count(*) AS n_chunks,
      sum(length(text))::BIGINT AS n_chars, count(*) FILTER (WHERE regexp_matches(text, '[\\x{600}-\\x{6ff}]')) AS n_arabic_chunks FROM chunks""")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest_stats(table(spark, d, "chunks"))


@query("""
    SELECT count(*) AS n_pages, count(*) FILTER (WHERE regexp_matches(text, '[\\x{600}-\\x{6ff}]')) AS n_arabic_pages, sum(length(text))::BIGINT AS n_chars,
      sum(length(regexp_replace(text, '[^\\x{600}-\\x{6ff}]', '', 'g')))::BIGINT AS n_arabic_chars FROM (SELECT DISTINCT pdf, page, text FROM pdf_pages)""")
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    return files.page_stats(table(spark, d, "pdf_pages").select("pdf", "page", "text").distinct())


@query(f"SELECT doc_id, {R.latin_key('title', TITLES)} AS latin, {R.ascii_key('title')} AS ascii FROM documents WHERE title IS NOT NULL")
def match_key(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "documents").where("title is not null").select("doc_id", T.latin_key(t, titles=TITLES).alias("latin"), T.ascii_key(t).alias("ascii"))


@query(f"""
    WITH k AS (SELECT p_partkey, {R.latin_key('p_name', TITLES)} AS key FROM part), s AS (SELECT p_partkey, key, string_split(key, ' ') AS w FROM k),
    r AS (SELECT p_partkey, list_filter([key, CASE WHEN len(w) >= 2 AND w[1] IN ('red', 'blue', 'small') THEN array_to_string(w[2:] || w[1:1], ' ') END,
      CASE WHEN len(w) >= 2 AND w[-1] IN ('red', 'ring', 'widget') THEN array_to_string(w[-1:] || w[:-2], ' ') END], lambda v: v IS NOT NULL AND v <> '') AS l FROM s)
    SELECT p_partkey, unnest({R.distinct('l')}) AS key FROM r""".replace("IN ('red', 'blue', 'small')", "IN ('red', 'blue', 'small', 'ring', 'widget')").replace("IN ('red', 'ring', 'widget')", "IN ('red', 'blue', 'small', 'ring', 'widget')"))
def rotation_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = T.rotations(T.latin_key(F.col("p_name"), titles=TITLES), ["red", "blue", "small", "ring", "widget"])
    return table(spark, d, "part").select("p_partkey", F.explode(keys).alias("key"))


@query("""
    WITH m AS (SELECT DISTINCT id, coalesce(content, '') AS c, role FROM chat_messages)
    SELECT id, regexp_matches(c, '[\\x{600}-\\x{6ff}]') AS arabic,
      CASE WHEN lower(trim(coalesce(role, ''))) IN ('ar', 'en') THEN lower(trim(role)) WHEN regexp_matches(c, '[\\x{600}-\\x{6ff}]') THEN 'ar' ELSE 'en' END AS language,
      CASE WHEN regexp_matches(c, '[\\x{600}-\\x{6ff}]') AND regexp_matches(c, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(c, '[\\x{600}-\\x{6ff}]') THEN 'ar'
           WHEN regexp_matches(c, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS script FROM m""")
def script_classify(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").select("id", F.coalesce("content", F.lit("")).alias("c"), "role").distinct()
    return m.select("id", T.has_arabic(F.col("c")).alias("arabic"), T.detect_language(F.col("role"), F.col("c")).alias("language"), T.preview_language(F.col("c")).alias("script"))


STOPWORDS = ["who", "was", "what", "did", "the", "and", "for", "about", "tell", "please", "explain"]


@query(f"""
    WITH q AS (SELECT DISTINCT id, list_filter(string_split({R.ascii_key('content')}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(f"'{s}'" for s in STOPWORDS)})) AS w FROM chat_messages WHERE content IS NOT NULL)
    SELECT id, array_to_string({R.distinct('w')}, ' ') AS words FROM q""")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").where("content is not null").select("id", "content").distinct()
    return m.select("id", F.array_join(T.keywords(F.col("content"), STOPWORDS), " ").alias("words"))


@query(f"SELECT p_partkey, {R.title_case('upper(p_name)')} AS name FROM part")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    from quern.operators.entities import NUMERALS, PARTICLES

    return table(spark, d, "part").select("p_partkey", T.title_case(F.upper("p_name"), PARTICLES, NUMERALS).alias("name"))


ALL_NAMES = f"(SELECT id, {R.nfkc('name_ar')} AS name_ar FROM (SELECT id, name_ar FROM saints_ar_seed UNION SELECT id, name_ar FROM saints_ar_generated))"


def all_names(spark: SparkSession, d: str) -> DataFrame:
    """(id, name_ar): the names of the hand-kept and of the generated index, each row once."""
    return table(spark, d, "saints_ar_seed").select("id", "name_ar").unionByName(table(spark, d, "saints_ar_generated").select("id", "name_ar")).distinct()


@query(f"""
    WITH s AS (SELECT id, name_ar, {R.arabic_key(R.arabic_display('name_ar'))} AS key FROM {ALL_NAMES}), t AS (
      SELECT *, list_filter(list_transform(list_filter(string_split(key, ' '), lambda w: regexp_matches(w, '[\\x{{600}}-\\x{{6ff}}]') AND w NOT IN ('القديس', 'الاب')),
        lambda w: CASE WHEN starts_with(w, 'ال') AND length(w) > 2 THEN substr(w, 3) ELSE w END), lambda w: w <> '' AND w NOT IN ('القديس', 'الاب')) AS toks FROM s)
    SELECT id, {R.arabic_key('name_ar')} AS name_key, {R.arabic_display('name_ar')} AS shown, key AS search, array_to_string(toks, ' ') AS tokens,
      'name-' || substr(sha1({R.arabic_key('name_ar')}), 1, 12) AS entity_id FROM t""")
def arabic_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name_ar")
    return all_names(spark, d).select(
        "id", T.arabic_key(n).alias("name_key"), T.arabic_display(n).alias("shown"), T.arabic_search(n).alias("search"),
        F.array_join(T.name_tokens(n, ["القديس", "الاب"], "ال"), " ").alias("tokens"), T.sha1_id("name-", T.arabic_key(n)).alias("entity_id"),
    )


@query(f"""
    WITH m AS (SELECT DISTINCT id, content AS c FROM chat_messages WHERE content IS NOT NULL),
    e AS (SELECT id, c, replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM m)
    SELECT id, {R.strip(f"replace(regexp_replace({R.strip('c')}, '^[0-9]+[.)][ \\t\\n\\x0b\\f\\r]*', ''), '**', '')")} AS label,
      replace(html, chr(10), '<br />') AS html,
      CASE WHEN {R.strip('c')} = '' THEN 'New Chat' WHEN length({R.strip('c')}) > 70 THEN substr({R.strip('c')}, 1, 67) || '...' ELSE {R.strip('c')} END AS title,
      list_filter(list_transform(string_split(c, ','), lambda v: {R.strip('v')}), lambda v: v <> '') AS items,
      {R.strip("replace(replace(c, 'St. ', 'Saint '), 'saint', 'st')")} AS respelled,
      substr(c, 1, 120) AS short FROM e""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    m = table(spark, d, "chat_messages").where("content is not null").select("id", F.col("content").alias("c")).distinct()
    return m.select(
        "id", T.clean_label(c).alias("label"), T.text_to_html(c).alias("html"), T.short_title(c, "New Chat").alias("title"), T.csv_items(c).alias("items"),
        T.strip(T.respell(c, [("St. ", "Saint "), ("saint", "st")])).alias("respelled"), T.preview(c, 120).alias("short"),
    )


PREFIXES = ["who was", "who is", "tell me about", "about", "st.", "saint"]


@query(f"""
    WITH m AS (SELECT DISTINCT id, content AS c, coalesce(role, '') AS role FROM chat_messages WHERE content IS NOT NULL),
    p AS (SELECT *, regexp_replace(c, '(?i)^{R.WS}*(?:(?:tell me about|who was|who is|about|saint|st\\.){R.WS}+)+', '') AS bare FROM m)
    SELECT id, bare, coalesce(lower({R.words('bare')}[1]), '') AS core, {R.latin_key('bare', TITLES)} AS search_key,
      CASE WHEN lower({R.collapse('role')}) IN ('user', 'assistant') THEN lower({R.collapse('role')}) ELSE 'note' END AS mode FROM p""")
def query_names(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").where("content is not null").select("id", F.col("content").alias("c"), F.coalesce("role", F.lit("")).alias("role")).distinct()
    bare = T.without_prefix(F.col("c"), PREFIXES)
    return m.select("id", bare.alias("bare"), T.core_name(F.col("c"), PREFIXES).alias("core"), T.latin_key(bare, titles=TITLES).alias("search_key"), T.known_mode(F.col("role"), ["user", "assistant"], "note").alias("mode"))


@query("SELECT doc_id, title, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first document of every text, whatever its case; whole texts are compared by hash."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "title", "source", F.md5(F.lower("text")).alias("k"))
    return first_wins(docs, ["k"], ["doc_id"]).select("doc_id", "title", "source")


@query("""
    WITH u AS (SELECT id, text, pdf, NULL AS url FROM chunks WHERE source_type = 'pdf' UNION ALL SELECT id, text, NULL, url FROM chunks WHERE source_type = 'website')
    SELECT id, length(text)::INT AS n, pdf, url FROM u""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    both = ingest.union_sources(c.where("source_type = 'pdf'").select("id", "text", "pdf"), c.where("source_type = 'website'").select("id", "text", "url"))
    return both.select("id", F.length("text").alias("n"), "pdf", "url")


_MESSAGES = """m AS (SELECT doc_id, doc_id % 25 AS attempt, CASE doc_id % 4 WHEN 0 THEN 'Rate limit. Please try again in ' || (doc_id % 700) / 10.0 || 's.' WHEN 1 THEN 'try again in 2s or try again in ' || doc_id % 90 || 's' WHEN 2 THEN 'slow down' END AS message FROM documents)"""


@query(f"""
    WITH {_MESSAGES}
    SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(message, '')), 'try again in [0-9.]+s') THEN regexp_extract_all(lower(message), 'try again in ([0-9]+(?:\\.[0-9]+)?)s', 1)[-1]::DOUBLE + 1
      ELSE least(60.0, 5 + 3 * attempt + 0.5)::DOUBLE END AS seconds FROM m""")
def retry_wait(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    tenth = F.format_string("%.1f", (n % 700) / 10)
    message = F.when(n % 4 == 0, F.concat(F.lit("Rate limit. Please try again in "), tenth, F.lit("s."))).when(n % 4 == 1, F.concat(F.lit("try again in 2s or try again in "), (n % 90).cast("string"), F.lit("s"))).when(n % 4 == 2, "slow down")
    m = table(spark, d, "documents").select("doc_id", (n % 25).alias("attempt"), message.alias("message"))
    return m.select("doc_id", ingest.retry_seconds(F.col("message"), F.col("attempt"), F.lit(0.5)).alias("seconds"))


_HTML = """h AS (SELECT page_id, 'https://x.example/' || page_id || '#top' AS url, list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(regexp_replace(v, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g'))), lambda v: length(v) >= 2) AS ls,
  trim(regexp_replace(coalesce(title, ''), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS title FROM web_pages WHERE text IS NOT NULL)"""


@query(f"""WITH {_HTML} SELECT url, CASE WHEN page_id % 3 = 0 THEN coalesce(nullif(title, ''), url) ELSE 'Page ' || page_id END AS title, array_to_string({R.distinct('ls')}, chr(10)) AS text FROM h WHERE len(ls) > 0""")
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    """Web pages written as HTML of several layouts (article, main, role, entry-content, body alone; entities, scripts, menus) and read again."""
    lines = F.transform(F.split("text", "\n", -1), T.escape_html)
    body = F.concat(F.lit("<p>"), F.array_join(lines, "</p><p>"), F.lit("</p><script>var x = 1;</script>"))
    kind = F.col("page_id") % 5
    open_, close = (F.when(kind == 0, F.lit(a)).when(kind == 1, F.lit(b)).when(kind == 2, F.lit(c)).when(kind == 3, F.lit(e)).otherwise(F.lit("")) for a, b, c, e in (("<article>", "<main>", "<div role='main'>", "<section class='x entry-content'>"), ("</article>", "</main>", "</div>", "</section>")))
    inner = F.when(kind == 4, body).otherwise(F.concat(F.lit("<div>not the content</div>"), open_, body, close, F.lit("<div>nor this</div>")))
    head = F.concat(F.lit("<html><head><title>"), T.escape_html(F.coalesce("title", F.lit(""))), F.lit("</title><style>p {}</style></head><body><nav>menu</nav>"))
    # a heading stands outside the content, so that it gives a title and no line
    heading = F.when(F.col("page_id") % 3 == 0, F.lit("<nav><h1> </h1></nav>")).otherwise(F.concat(F.lit("<nav><h1> Page "), F.col("page_id").cast("string"), F.lit(" </h1></nav>")))
    rows = table(spark, d, "web_pages").where("text is not null").select(F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string"), F.lit("#top")).alias("url"), F.concat(head, heading, inner, F.lit("<footer>foot</footer></body></html>")).alias("html"))
    return files.html_pages(rows)


@query("SELECT DISTINCT id, length(text) AS n, length(text) - length(replace(text, 'e', '')) AS e, 'letters' AS model FROM chunks")
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk embedded in batches by a model that counts letters."""
    rows = text_table(spark, d, "chunks").select("id", "text").distinct()
    out = ingest.embed(rows, lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts], "letters")
    return out.select("id", F.col("embedding")[0].cast("long").alias("n"), F.col("embedding")[1].cast("long").alias("e"), "model")


_LATEST = "c AS (SELECT id, min(text) AS text, min(title) AS title, min(url) AS url, min(chunk_index) AS chunk_index FROM chunks GROUP BY id)"


@query(f"""WITH {_LATEST}, fresh AS (SELECT * FROM c WHERE url IS NOT NULL AND chunk_index = 0), kept AS (SELECT * FROM c WHERE url IS NULL OR url NOT IN (SELECT url FROM fresh) OR id IN (SELECT id FROM fresh))
  SELECT id, CASE WHEN id IN (SELECT id FROM fresh) THEN 'new: ' || text ELSE text END AS text FROM kept""")
def collection_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A stored collection after its first pages came anew: replaced by id, the pages' other chunks gone."""
    store = collections.Collection(spark, shared_folder(spark), "chunks")
    c = table(spark, d, "chunks").groupBy("id").agg(*[F.min(x).alias(x) for x in ("text", "title", "url", "chunk_index")])
    store.upsert(store.stage(c))
    store.upsert(store.stage(c.where("url is not null and chunk_index = 0").withColumn("text", F.concat(F.lit("new: "), "text"))), drop_stale=True)
    store.drop_staged()
    return store.read().select("id", "text")


@query(f"WITH {_LATEST} SELECT id, chunk_index FROM c WHERE title = 'saints great synaxar'")
def collection_filtered(spark: SparkSession, d: str) -> DataFrame:
    store = collections.Collection(spark, shared_folder(spark), "chunks")
    store.upsert(table(spark, d, "chunks").groupBy("id").agg(*[F.min(x).alias(x) for x in ("text", "title", "url", "chunk_index")]))
    return store.filtered(title="saints great synaxar").select("id", "chunk_index")


@query("SELECT DISTINCT id, name_ar, source_title, page_start, page_end, preview FROM saints_ar_generated WHERE trim(coalesce(name_ar, '')) <> ''")
def json_index_rows(spark: SparkSession, d: str) -> DataFrame:
    """The generated index written as one JSON object and read again."""
    folder = shared_folder(spark)
    files.write_json_index(table(spark, d, "saints_ar_generated").distinct(), "book", folder)
    return files.json_index(spark, folder).drop("aliases_ar")


@query("SELECT least, (SELECT count(*) FROM chunks) < greatest(least, 0) AS fill FROM (VALUES (-1), (0), (1), (1000), (1000000000)) t(least)")
def population_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a collection of this many chunks is to be filled, for several least sizes."""
    n = table(spark, d, "chunks").count()
    return spark.createDataFrame([(least, ingest.must_ingest(n, least, True)) for least in (-1, 0, 1, 1000, 10**9)], "least int, fill boolean")


@query("SELECT DISTINCT id, NULL::VARCHAR AS error FROM chunks WHERE source_type = 'pdf' UNION ALL SELECT 'website', 'failed'")
def source_failures(spark: SparkSession, d: str) -> DataFrame:
    """A source that fails while it is read leaves the other's rows and its error."""
    c = table(spark, d, "chunks").select("id", "source_type").distinct()
    store = collections.Collection(spark, shared_folder(spark), "parts")
    broken = c.where("source_type = 'website'").withColumn("text", F.raise_error(F.lit("gone")).cast("string"))
    done, errors = ingest.attempt_sources({"pdf": lambda: c.where("source_type = 'pdf'"), "website": lambda: broken}, {"pdf"}, store.stage)
    failed = spark.createDataFrame([(k, "failed") for k in errors], "id string, error string")
    return ingest.union_sources(*[r.select("id", F.lit(None).cast("string").alias("error")) for r in done]).unionByName(failed)
