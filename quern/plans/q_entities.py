"""Queries over entity names: extraction, the index, and searching it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import entities, match
from quern.operators.ranking import ordered_union, page, positioned
from quern.plans import registry as R
from quern.plans.q_ingest import ALL_NAMES, all_names
from quern.plans.registry import query, table
from quern.sources.tables import text_table

TITLES = ["st", "saint", "saints"]
RULES = entities.NameRules(banned_tokens=("church", "letter", "book"), excluded_terms=("contents", "index"))
_W = r"[\p{L}\p{N}_]"

_LINES = f"""lines AS (
  SELECT pdf, page, (i - 1)::INT AS line_pos, {R.strip('ls[i]')} AS line
  FROM (SELECT pdf, page, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT DISTINCT pdf, page, regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM pdf_pages)),
    LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))"""
_H = R.collapse("line")
_CORE = f"regexp_replace(regexp_replace({_H}, '\\([^)]*\\)', '', 'g'), '^[ .:]+|[ .:]+$', '', 'g')"
_HEAD = f"""(length({_H}) BETWEEN 3 AND 100 AND NOT regexp_matches({_H}, '^[0-9]+$') AND NOT contains({_H}, '...')
  AND length(regexp_replace({_CORE}, '[^\\p{{L}}]', '', 'g')) >= 3
  AND length(regexp_replace({_CORE}, '[^\\p{{Lu}}]', '', 'g')) >= 0.72::DOUBLE * length(regexp_replace({_CORE}, '[^\\p{{L}}]', '', 'g'))
  AND NOT contains(lower({_CORE}), 'contents') AND NOT contains(lower({_CORE}), 'index')
  AND NOT starts_with(lower({_CORE}), '[') AND NOT starts_with(lower({_CORE}), 'the '))"""
_SECTIONS = f"""{_LINES}, marked AS (SELECT *, {_HEAD} AS head FROM lines),
  numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY pdf, page ORDER BY line_pos ROWS UNBOUNDED PRECEDING) AS section FROM marked),
  secs AS (SELECT pdf, page, section, arg_min(line, line_pos) AS heading, min(line_pos) AS line_pos,
    {R.collapse("coalesce(string_agg(line, ' ' ORDER BY line_pos) FILTER (WHERE NOT head AND line <> '' AND NOT regexp_matches(line, '^[0-9]+$')), '')")} AS body
    FROM numbered WHERE section > 0 GROUP BY pdf, page, section)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return text_table(spark, d, "pdf_pages").select("pdf", "page", "text").distinct()


@query(f"WITH {_LINES} SELECT pdf, page, line_pos, line FROM lines WHERE {_HEAD}")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    return entities.text_lines(_pages(spark, d), ["pdf", "page"]).where(entities.is_heading(F.col("line"), RULES.excluded_terms))


_NAME = f"regexp_replace(regexp_replace(regexp_replace({_H}, '\\([^)]*\\)', '', 'g'), '([\\p{{L}}_])[0-9]+([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2', 'g'), '^[ .:]+|[ .:]+$', '', 'g')"


@query(f"""WITH {_LINES}, n AS (SELECT pdf, page, line_pos, {_NAME} AS h FROM lines WHERE {_HEAD})
  SELECT pdf, page, line_pos, CASE WHEN h = '' THEN '' WHEN contains(h, ',') THEN NULL ELSE 'St. ' || {R.title_case('h')} END AS name FROM n""")
def heading_names(spark: SparkSession, d: str) -> DataFrame:
    h = entities.text_lines(_pages(spark, d), ["pdf", "page"]).where(entities.is_heading(F.col("line"), RULES.excluded_terms))
    name = entities.heading_name(F.col("line"), RULES)
    return h.select("pdf", "page", "line_pos", F.when(~F.col("line").contains(","), name).alias("name"))


@query(f"WITH {_SECTIONS} SELECT pdf, page, line_pos, heading, body FROM secs WHERE len({R.words('body')}) >= 20")
def sections(spark: SparkSession, d: str) -> DataFrame:
    return entities.sections(_pages(spark, d), ["pdf", "page"], excluded=RULES.excluded_terms)


_RENAMES = [("NATION_3", "GAUL"), ("NATION_5", ""), ("NATION_7", "NIPPON"), ("NATION_11", "CATHAY")]


@query("""
  WITH r(name, replacement) AS (VALUES ('NATION_3', 'GAUL'), ('NATION_5', ''), ('NATION_7', 'NIPPON'), ('NATION_11', 'CATHAY')),
  x AS (SELECT n_nationkey, n_name, r.replacement FROM nation LEFT JOIN r ON n_name = r.name)
  SELECT n_nationkey, coalesce(replacement, n_name) AS n_name FROM x WHERE (replacement IS NULL OR replacement <> '') AND coalesce(replacement, n_name) NOT IN ('NIPPON', 'NATION_3', 'NATION_20')""")
def rename_exclude(spark: SparkSession, d: str) -> DataFrame:
    renames = spark.createDataFrame(_RENAMES, "name string, replacement string")
    excluded = spark.createDataFrame([("NIPPON",), ("NATION_3",), ("NATION_20",)], "name string")
    return entities.rename_and_exclude(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", renames, excluded)


_MENTIONS = r"""m0 AS (SELECT doc_id, list_concat(
    regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(St\.?\s+[A-Z][A-Za-z''\-]+(?:\s+(?:of|the|[A-Z][A-Za-z''\-]+)){0,5})', 1),
    regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(Saint\s+[A-Z][A-Za-z''\-]+(?:\s+(?:of|the|[A-Z][A-Za-z''\-]+)){0,5})', 1)) AS ms FROM documents WHERE text IS NOT NULL),
  m AS (SELECT doc_id, i AS mention_pos, ms[i + 1] AS mention FROM m0, LATERAL (SELECT unnest(range(0, len(ms))) AS i))"""
_SUGGEST = f"regexp_replace({R.collapse('mention')}, '(?i)^(?:st\\.?|saint)\\s+', '')"
_PARTS = R.words(_SUGGEST)
_GOOD = f"""(len({_PARTS}) >= 2 AND len(list_filter({_PARTS}, lambda w: NOT (lower(w) IN ('the','of','i','ii','iii','iv','v','vi') OR (length(w) > 2 AND regexp_matches(w, '^\\p{{Lu}}'))))) = 0
  AND len(list_filter({_PARTS}, lambda w: lower(w) IN ('was','is','and','or','in','on','to','for','with','from'))) = 0)"""


@query(f"WITH {_MENTIONS} SELECT doc_id, mention, count(*) AS n FROM (SELECT doc_id, {R.strip('mention')} AS mention FROM m) GROUP BY doc_id, mention")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(entities.mentions(F.col("text"))).alias("mention")).groupBy("doc_id", "mention").agg(F.count("*").alias("n"))


@query(f"""WITH {_MENTIONS}, u AS (SELECT DISTINCT mention FROM m), s AS (SELECT mention, CASE WHEN {_GOOD} THEN 'St. ' || {_SUGGEST} ELSE '' END AS name FROM u),
  b AS (SELECT *, lower(substr(name, 5)) AS low, string_split(lower(substr(name, 5)), ' ') AS toks FROM s)
  SELECT {R.strip('mention')} AS mention, any_value(name) AS name, bool_or(name <> '' AND NOT contains(low, '''') AND len(list_filter(toks, lambda w: w IN ('church','letter','book') OR ends_with(w, '-'))) = 0
    AND NOT regexp_matches(low, ' (?:the|of)$') AND len(list_filter(toks, lambda w: NOT (w IN ('of','the','i','ii','iii','iv','v','vi','vii','viii','ix','x') OR length(w) >= 3))) = 0) AS plausible,
    bool_or((name <> '' AND NOT contains(low, '''') AND len(list_filter(toks, lambda w: w IN ('church','letter','book') OR ends_with(w, '-'))) = 0
    AND NOT regexp_matches(low, ' (?:the|of)$') AND len(list_filter(toks, lambda w: NOT (w IN ('of','the','i','ii','iii','iv','v','vi','vii','viii','ix','x') OR length(w) >= 3))) = 0)
    OR regexp_matches(regexp_replace({R.strip('mention')}, '(?i)^(?:st\\.?|saint)\\s+', ''), '^[A-Z][A-Za-z''\\-]{{2,}}$')) AS record FROM b GROUP BY 1""")
def name_plausibility(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    m = docs.select(F.explode(entities.mentions(F.col("text"))).alias("mention")).distinct()
    c = F.col("mention")
    return m.select("mention", entities.suggestion_name(c).alias("name"), entities.plausible_name(c, RULES).alias("plausible"), entities.plausible_record(c, RULES).alias("record"))


@query(f"""WITH {_MENTIONS},
  k AS (SELECT doc_id, mention_pos, 'St. ' || {_SUGGEST} AS name FROM m WHERE {_GOOD}), q AS (SELECT *, {R.latin_key('name', TITLES)} AS key FROM k),
  known AS (SELECT {R.latin_key('name_en', TITLES)} AS key FROM saints_ar_seed),
  f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, mention_pos) AS n FROM q WHERE contains(key, 'ba') AND key NOT IN (SELECT key FROM known))
  SELECT name, key FROM f WHERE n = 1 ORDER BY doc_id, mention_pos LIMIT 12""")
def weak_mentions(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "saints_ar_seed").select(RULES.key(F.col("name_en")).alias("key"))
    return entities.weak_mentions(table(spark, d, "documents").where("text is not null"), ["doc_id"], known, "ba", RULES)


_ITEM = f"replace(regexp_replace({R.strip('item')}, '^[0-9]+[.)][ \\t]*', ''), '**', '')"
_PLAIN = R.strip(f"regexp_replace(regexp_replace({R.strip(_ITEM)}, '\\s[-:—]\\s.*$', ''), '\\s*\\([^)]*\\)\\s*$', '')")
_BOLD = "regexp_extract(item, '\\*\\*([^*]+)\\*\\*', 1)"


@query(f"""
  WITH i AS (SELECT id, unnest(regexp_extract_all(content, '[0-9]+[.)]\\s*([^\\n]+)', 1)) AS item FROM (SELECT DISTINCT id, content FROM chat_messages WHERE content IS NOT NULL)),
  l AS (SELECT id, CASE WHEN {_BOLD} <> '' THEN {R.strip(_BOLD)} ELSE {_PLAIN} END AS label FROM i)
  SELECT DISTINCT id, label FROM l WHERE label <> '' AND length(label) <= 80 AND lower(label) NOT IN ('fasting') AND (contains(lower(label), 'st.') OR contains(lower(label), 'saint')
    OR (len({R.words('label')}) >= 2 AND len(list_filter({R.words('label')}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 2))""")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").where("content is not null").select("id", "content").distinct()
    return m.select("id", F.explode(entities.list_items(F.col("content"), ["fasting"])).alias("label"))


_CUT_SEGMENT = f"regexp_replace(segment, '(?s){R.WS}{{2,}}.*$', '')"
_ENTRY = R.strip(f"regexp_replace(regexp_replace({R.arabic_display(_CUT_SEGMENT)}, '(?s) +(?:ولد|كان)(?:[^\\p{{L}}\\p{{N}}_].*)?$', ''), '\\s*[0-9٠-٩]+\\s*$', '')")


@query(f"""
  WITH t AS (SELECT id, string_split('intro ✞ ' || name_ar || ' 12' || '  life of it ✞ ' || name_ar || ' ولد في', '✞') AS parts FROM {ALL_NAMES}),
  e AS (SELECT id, i, {R.strip('parts[i + 2]')} AS segment FROM t, LATERAL (SELECT unnest(range(0, len(parts) - 1)) AS i)),
  h AS (SELECT id, i::INT AS entry_pos, segment, {_ENTRY} AS heading FROM e)
  SELECT id, entry_pos, heading, segment FROM h WHERE length(heading) BETWEEN 2 AND 90 AND len(string_split(heading, ' ')) <= 8""")
def marked_entries(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name_ar")
    rows = all_names(spark, d).select("id", F.concat(F.lit("intro ✞ "), n, F.lit(" 12  life of it ✞ "), n, F.lit(" ولد في")).alias("text"))
    return entities.marked_entries(rows, ["id"], cues=["ولد", "كان"], most_words=8)


@query(f"""
  WITH s AS (SELECT DISTINCT g.page_start AS page, n.id, n.name_ar, {R.arabic_key('n.name_ar')} AS key FROM {ALL_NAMES} n JOIN saints_ar_generated g ON g.id = n.id),
  f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page, id) AS r FROM s WHERE key <> '')
  SELECT 'entry-' || substr(sha1(key), 1, 12) AS id, {R.arabic_display('name_ar')} AS name_ar, page AS page_start, 'book' AS source_title FROM f WHERE r = 1""")
def entry_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the entries that stand on the pages of a book."""
    rows = table(spark, d, "saints_ar_generated").select("id", "name_ar", "page_start").distinct()
    pages = rows.select(F.concat(F.lit("b"), "id").alias("pdf"), F.col("page_start").alias("page"), F.concat(F.lit("✞ "), "name_ar", F.lit("  text")).alias("text"))
    pages = pages.groupBy(F.lit("b.pdf").alias("pdf"), "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pdf", "text"))), lambda v: v["text"]), " ").alias("text"))
    return entities.entry_index(pages, source_title="book").select("id", "name_ar", "page_start", "source_title")


_UNION = f"""u AS (SELECT 0 AS part, id, name_ar FROM saints_ar_seed UNION SELECT 1, id, name_ar FROM saints_ar_generated UNION SELECT 2, coalesce(pdf, ''), title FROM chunks WHERE title IS NOT NULL),
  n AS (SELECT part, id, {R.arabic_display(R.nfkc('name_ar'))} AS name FROM u), k AS (SELECT *, {R.arabic_key('name')} AS key FROM n),
  f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part, id, name) AS r FROM k WHERE key <> ''), names AS (SELECT name, key, (row_number() OVER (ORDER BY part, id, name) - 1)::INT AS position FROM f WHERE r = 1)"""


def _union(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select("id", F.col("name_ar").alias("name")).distinct() for t in ("saints_ar_seed", "saints_ar_generated")]
    parts.append(table(spark, d, "chunks").where("title is not null").select(F.coalesce("pdf", F.lit("")).alias("id"), F.col("title").alias("name")).distinct())
    parts = [p.withColumn("raw", F.col("name")) for p in parts]
    return entities.name_union(parts, "name", ["id", "name"])


@query(f"WITH {_UNION} SELECT name, position FROM names")
def name_union(spark: SparkSession, d: str) -> DataFrame:
    """Names of the hand-kept index, then of the generated one, then of the chunks' titles, each Arabic key once."""
    return _union(spark, d)


@query(f"""WITH {_UNION}, c AS (SELECT 'chunks' AS source, count(DISTINCT title) AS n FROM chunks UNION ALL SELECT 'generated', count(*) FROM (SELECT DISTINCT id FROM saints_ar_generated) UNION ALL SELECT 'seed', count(*) FROM saints_ar_seed)
  SELECT array_to_string(list(source || '=' || n ORDER BY source), '|') AS counts, array_to_string(list(source ORDER BY source) FILTER (WHERE n > 0), '+') AS used, (SELECT count(*) FROM names) AS n_total,
    array_to_string((SELECT list(name ORDER BY position) FILTER (WHERE position < 20) FROM names), '|') AS sample, (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM chunks WHERE title = 'full saints arabic') AS n_titled,
    'full saints arabic.pdf' AS found, 'not there.pdf' AS missing FROM c""")
def sources_report(spark: SparkSession, d: str) -> DataFrame:
    """Where an index of several sources comes from, and which of the expected files are there."""
    parts = {"seed": table(spark, d, "saints_ar_seed"), "generated": table(spark, d, "saints_ar_generated").select("id").distinct(), "chunks": table(spark, d, "chunks").where("title is not null").select("title").distinct()}
    r = match.sources_report(parts, _union(spark, d), table(spark, d, "chunks"), "full saints arabic", ["full saints arabic.pdf", "not there.pdf"])
    counts = F.array_join(F.transform("counts", lambda c: F.concat(c["source"], F.lit("="), c["n"].cast("string"))), "|")
    return r.withColumns({"counts": counts, **{c: F.array_join(c, "|") for c in ("sample", "found", "missing")}})


@query(f"""
  WITH u AS (SELECT s_name AS name, 0 AS part FROM supplier UNION ALL SELECT c_name, 1 FROM customer UNION ALL SELECT n_name, 2 FROM nation),
  k AS (SELECT *, {R.latin_key('name', [])} AS key FROM u), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part, name) AS r FROM k)
  SELECT name, (row_number() OVER (ORDER BY part, name) - 1)::INT AS position FROM f WHERE r = 1""")
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col(c).alias("name"), T.latin_key(F.col(c)).alias("key")) for t, c in (("supplier", "s_name"), ("customer", "c_name"), ("nation", "n_name"))]
    return ordered_union(parts, ["key"], ["name"]).select("name", "position")


@query(f"""
  WITH s AS (SELECT id, name_en, name_ar, aliases_ar FROM saints_ar_seed), a AS (
    SELECT id AS seed_id, 0 AS ordinal, name_en AS alias, true AS latin FROM s UNION ALL SELECT id, 1, name_ar, false FROM s
    UNION ALL SELECT id, 2 + i, aliases_ar[i + 1], false FROM s, LATERAL (SELECT unnest(range(0, len(aliases_ar))) AS i)),
  b AS (SELECT seed_id, ordinal, {R.collapse('alias')} AS alias, latin FROM a), r AS (SELECT DISTINCT 'St. ' || split_part(name_en, 'St. ', 2) AS name FROM s),
  e AS (SELECT name, -1 AS rank, '' AS seed_id, -1 AS ordinal, name AS alias FROM r UNION ALL
    SELECT r.name, 0, b2.seed_id, b2.ordinal, b2.alias FROM r JOIN b b1 ON b1.latin AND {R.latin_key('b1.alias', TITLES)} = {R.latin_key('r.name', TITLES)} JOIN b b2 ON b2.seed_id = b1.seed_id),
  f AS (SELECT *, row_number() OVER (PARTITION BY name, lower(alias) ORDER BY rank, seed_id, ordinal, alias) AS k FROM e WHERE alias <> '')
  SELECT name, array_to_string(list(alias ORDER BY rank, seed_id, ordinal), '|') AS aliases FROM f WHERE k = 1 GROUP BY name""")
def alias_attach(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "saints_ar_seed")
    latin = s.select(F.col("id").alias("seed_id"), F.lit(0).alias("ordinal"), F.col("name_en").alias("alias"), F.lit(True).alias("is_latin"))
    arabic = s.select(F.col("id").alias("seed_id"), F.lit(1).alias("ordinal"), F.col("name_ar").alias("alias"), F.lit(False).alias("is_latin"))
    more = s.select(F.col("id").alias("seed_id"), F.posexplode("aliases_ar").alias("i", "alias")).select("seed_id", (F.col("i") + 2).alias("ordinal"), "alias", F.lit(False).alias("is_latin"))
    records = s.select(F.col("name_en").alias("name")).distinct().withColumn("id", F.col("name"))
    return entities.attach_aliases(records, latin.unionByName(arabic).unionByName(more), RULES).select("name", F.array_join("aliases", "|").alias("aliases"))


# ---- searching ----

_QUERIES = ["Red Widget", "red", "idge", "Ring Small", "widget blue", "nothing like it"]
_PART_KEYS = "part_keys AS (SELECT DISTINCT p_name AS id, p_name AS name, lower(p_name) AS name_key, true AS is_own FROM part UNION ALL SELECT DISTINCT p_name, p_name, lower(p_type), false FROM part)"
_TIER = """CASE WHEN q.query_key = k.name_key THEN CASE WHEN k.is_own THEN 0 ELSE 1 END WHEN starts_with(k.name_key, q.query_key) THEN 2 WHEN contains(k.name_key, q.query_key) THEN 3
  WHEN len(list_filter(string_split(q.query_key, ' '), lambda w: NOT list_contains(string_split(k.name_key, ' '), w))) = 0 THEN 4 END"""
_SCORED = f"""q(query, query_key) AS (VALUES {', '.join(f"('{x}', '{x.lower()}')" for x in _QUERIES)}), {_PART_KEYS},
  scored AS (SELECT q.query, k.id, k.name, min({_TIER}) AS score FROM q JOIN part_keys k ON {_TIER} IS NOT NULL GROUP BY q.query, k.id, k.name)"""
_CUT = """cut AS (SELECT * FROM (SELECT *, min(score) OVER (PARTITION BY query) AS best FROM scored)
  WHERE score <= CASE WHEN best <= 1 AND query NOT IN ('red') THEN 1 WHEN best <= 1 THEN 4 WHEN best = 2 THEN 2 ELSE 4 END)"""
_RANKED = "SELECT query, name, score::INT AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, length(name), lower(name), id) AS rank FROM {0}) WHERE rank <= {1}"


def _part_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    own = p.select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.lower("p_name").alias("name_key"), F.lit(True).alias("is_own")).distinct()
    return own.unionByName(p.select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("name_key"), F.lit(False).alias("is_own")).distinct())


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, x.lower()) for x in _QUERIES], "query string, query_key string")


@query(f"WITH {_SCORED} {_RANKED.format('scored', 400)}")
def name_match_tiers(spark: SparkSession, d: str) -> DataFrame:
    return match.best_matches(match.tiered(_part_keys(spark, d), _queries(spark)), 400).select("query", "name", "score", "rank")


@query(f"WITH {_SCORED}, {_CUT} {_RANKED.format('cut', 12)}")
def name_match_cut(spark: SparkSession, d: str) -> DataFrame:
    return match.search(_part_keys(spark, d), _queries(spark), ambiguous=F.col("query") == "red").select("query", "name", "score", "rank")




@query(f"""WITH {_SCORED}, {_CUT}, a(canonical, alias) AS (VALUES ('small ring', 'widget'), ('blue gear', 'idge'), ('red widget', 'ring small')),
  hit AS (SELECT query, arg_max(canonical, length(alias) * 100000 + ascii(alias)) AS canonical FROM q JOIN a ON contains(q.query_key, a.alias) GROUP BY query),
  manual AS (SELECT DISTINCT h.query, k.id, k.name FROM hit h JOIN part_keys k ON k.name_key = h.canonical),
  u AS (SELECT query, id, name, -1 AS score FROM manual UNION ALL SELECT query, id, name, score FROM cut WHERE query NOT IN (SELECT query FROM manual))
  {_RANKED.format('u', 12)}""")
def alias_short_circuit(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("small ring", "widget", "widget"), ("blue gear", "idge", "idge"), ("red widget", "ring small", "ring small")], "canonical string, alias string, alias_key string")
    keys, queries = _part_keys(spark, d), _queries(spark)
    own = aliases.select("canonical", F.col("canonical").alias("alias_key")).distinct()
    manual = match.records_of(match.alias_hit(queries, aliases), own, keys)
    return match.search(keys, queries, manual, F.col("query") == "red").select("query", "name", "score", "rank")


_AR_Q = "SELECT DISTINCT name_ar AS query FROM saints_ar_generated WHERE ('0x' || substr(md5(id), 1, 6))::INT % 100 = 0 UNION SELECT * FROM (VALUES ('القديس'), ('الأسقف'), ('برانيوس'), ('الخباز بريناس'))"
_BARE = "array_to_string(list_filter(list_transform(list_filter(string_split({0}, ' '), lambda w: regexp_matches(w, '[\\x{{600}}-\\x{{6ff}}]') AND w NOT IN ('القديس', 'الاب')), lambda w: CASE WHEN starts_with(w, 'ال') AND length(w) > 2 THEN substr(w, 3) ELSE w END), lambda w: w <> '' AND w NOT IN ('القديس', 'الاب')), ' ')"
_AR_TIERS = f"""q AS ({_AR_Q}), q1 AS (SELECT query, {R.arabic_key(R.nfkc('query'))} AS k FROM q), qk AS (SELECT query, k AS query_key FROM q1 UNION SELECT query, {_BARE.format('k')} FROM q1),
  n AS (SELECT DISTINCT {R.arabic_display('name_ar')} AS name, {R.arabic_key('name_ar')} AS name_key FROM {ALL_NAMES}),
  t AS (SELECT query, name, query_key, name_key, CASE WHEN name_key = query_key THEN 0 WHEN starts_with(name_key, query_key) THEN 1 WHEN contains(name_key, query_key) THEN 2
    WHEN len(list_filter(string_split(query_key, ' '), lambda w: NOT list_contains(string_split(name_key, ' '), w))) = 0 THEN 3 END AS score FROM qk, n WHERE query_key <> ''),
  d AS (SELECT *, CASE WHEN contains(query_key, 'القديس') AND contains(name_key, 'الاسقف') THEN 1 ELSE 9 END AS descriptor FROM t WHERE score IS NOT NULL),
  b AS (SELECT query, name, min(score * 10 + descriptor) AS s FROM d GROUP BY query, name),
  o AS (SELECT query, name, (s // 10)::INT AS score, row_number() OVER (PARTITION BY query ORDER BY s, length(name), name) AS rank FROM b)"""


def _arabic_search(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(query, query_key) of the names whose id's hash is divisible by 100, and (name, name_key) of the whole index."""
    picked = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 100 == 0
    queries = table(spark, d, "saints_ar_generated").where(picked).select(F.col("name_ar").alias("query"))
    queries = queries.unionByName(spark.createDataFrame([(x,) for x in ("القديس", "الأسقف", "برانيوس", "الخباز بريناس")], "query string")).distinct()
    names = all_names(spark, d).select(T.arabic_display(F.col("name_ar")).alias("name"), T.arabic_key(F.col("name_ar")).alias("name_key")).distinct()
    return match.arabic_query_keys(queries, ["القديس", "الاب"], "ال"), names


@query(f"WITH {_AR_TIERS} SELECT query, name, score, rank::INT AS rank FROM o WHERE rank <= 12")
def arabic_match(spark: SparkSession, d: str) -> DataFrame:
    queries, names = _arabic_search(spark, d)
    return match.tiered_arabic(names, queries, [("القديس", "الاسقف", 1)]).select("query", "name", "score", "rank")


@query(f"""WITH {_AR_TIERS}, manual AS (SELECT q1.query, n.name, 0 AS place FROM q1 JOIN n ON n.name_key = 'القديسه تلوسيا الصغير' WHERE contains(q1.k, 'القديس') OR contains('القديس برانيوس', q1.k)),
  u AS (SELECT query, name, -1 AS score, place FROM manual UNION ALL SELECT query, name, score, rank FROM o WHERE rank <= 400 AND (query, name) NOT IN (SELECT query, name FROM manual)),
  r AS (SELECT query, name, score, row_number() OVER (PARTITION BY query ORDER BY score >= 0, place, name) AS rank FROM u) SELECT query, name, score::INT AS score, rank::INT AS rank FROM r WHERE rank <= 12""")
def arabic_search(spark: SparkSession, d: str) -> DataFrame:
    """Hand-kept matches first, then the tiers."""
    queries, names = _arabic_search(spark, d)
    records = spark.createDataFrame([(0, "القديسه تلوسيا الصغير", "القديس"), (0, "القديسه تلوسيا الصغير", "القديس برانيوس")], "ordinal int, name_key string, alias_key string")
    whole = queries.select("query").distinct().select("query", T.arabic_key(F.col("query")).alias("query_key"))
    contained = F.col("alias_key") == "القديس"
    manual = match.contained_aliases(records.where(contained), whole.where(F.col("query_key").contains("القديس")), names)
    manual = manual.unionByName(match.contained_aliases(records.where(~contained), whole.where(F.lit("القديس برانيوس").contains(F.col("query_key"))), names))
    return match.search_arabic(names, queries, manual, [("القديس", "الاسقف", 1)])


@query(f"WITH {_SCORED}, {_CUT}, r AS ({_RANKED.format('cut', 400)}) SELECT query, name, rank FROM r WHERE length(query) >= 4 AND rank <= 12")
def name_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for what has been typed so far; the limit asked for is cut to twelve, short queries get none."""
    found = match.search(_part_keys(spark, d), _queries(spark), ambiguous=F.col("query") == "red", limit=400)
    return match.suggestions(found, 50, least=4).select("query", "name", "rank")


@query(f"WITH {_SCORED}, {_CUT}, r AS ({_RANKED.format('cut', 400)}) SELECT query, name, rank, total FROM (SELECT *, count(*) OVER (PARTITION BY query) AS total FROM r) WHERE rank > 5 AND rank <= 15")
def searched_list(spark: SparkSession, d: str) -> DataFrame:
    """A page of a searched list, with the matches' total before the page is cut."""
    found = match.search(_part_keys(spark, d), _queries(spark), ambiguous=F.col("query") == "red", limit=400)
    return match.searched_listing(found, 10, 5)


@query("""WITH q(query) AS (VALUES ('STANDARD'), ('small plated brass thing'), ('x')), r AS (SELECT p_partkey AS ordinal, lower(p_name) AS name_key, lower(p_type) AS alias_key FROM part),
  n AS (SELECT DISTINCT p_name AS name, lower(p_name) AS name_key FROM part)
  SELECT query, name, min(ordinal) AS ordinal FROM q JOIN r ON contains(r.alias_key, lower(q.query)) OR contains(lower(q.query), r.alias_key) JOIN n USING (name_key) GROUP BY query, name""")
def containment_alias(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    records = p.select(F.col("p_partkey").alias("ordinal"), F.lower("p_name").alias("name_key"), F.lower("p_type").alias("alias_key"))
    names = p.select(F.col("p_name").alias("name"), F.lower("p_name").alias("name_key")).distinct()
    queries = spark.createDataFrame([(x, x.lower()) for x in ("STANDARD", "small plated brass thing", "x")], "query string, query_key string")
    return match.contained_aliases(records, queries, names)


@query("SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY lower(s_name), s_suppkey LIMIT 20 OFFSET 20")
def paged_list(spark: SparkSession, d: str) -> DataFrame:
    rows, total = match.listing(table(spark, d, "supplier").select("s_suppkey", "s_name"), [F.lower("s_name"), "s_suppkey"], 20, 20)
    return rows.crossJoin(F.broadcast(total))


@query("SELECT option FROM (VALUES ('nation_3'), ('Nowhere'), ('NATION_11')) t(option) WHERE lower(option) IN (SELECT lower(n_name) FROM nation)")
def options_semi(spark: SparkSession, d: str) -> DataFrame:
    return match.sourced_options(spark.createDataFrame([("nation_3",), ("Nowhere",), ("NATION_11",)], "option string"), table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("""WITH s AS (SELECT id, name_en AS f, regexp_replace(name_en, '(?i)^(?:st\\.?|saint)\\s+', '') AS b FROM saints_ar_seed),
  l AS (SELECT id, list_filter([f, b, 'St. ' || b, CASE WHEN contains(lower(b), 'of') THEN replace(b, ' of ', ' from ') END, CASE WHEN contains(lower(b), 'of') THEN 'St. ' || replace(b, ' of ', ' from ') END,
    CASE WHEN contains(lower(b), 'meroth') THEN 'the elder of Meroth' END], lambda v: v IS NOT NULL) AS vs FROM s)
  SELECT id, array_to_string(list_filter(vs, lambda v, i: list_position(list_transform(vs, lambda x: lower(x)), lower(v)) = i), '|') AS variants FROM l""")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    variants = match.query_variants(F.col("name_en"), "St.", [("of", "from")], ["life"], [("meroth", ["the elder of Meroth"])])
    return table(spark, d, "saints_ar_seed").select("id", F.array_join(variants, "|").alias("variants"))


_INTENTS = [(r"(?i)^who (?:was|is) (.+)$", "lookup"), (r"(?i)^tell me about (.+)$", "lookup"), (r"(?i)^(?:list|show) (.+)$", "list")]


@query(f"""WITH m AS (SELECT DISTINCT id, {R.collapse(f"regexp_replace({R.strip('content')}, '[?.!]+$', '')")} AS q FROM chat_messages WHERE content IS NOT NULL AND lower(trim(role)) = 'user'),
  a AS (SELECT id, q, regexp_extract(q, '(?is)^(?:(?:who was|who is|tell me about|about)\\s+)?((?:the feast of|st\\.?|saint)\\s+.+)$', 1) AS asked FROM m)
  SELECT id, CASE WHEN regexp_matches(q, '(?i)^who (?:was|is) .+$') THEN 'lookup' WHEN regexp_matches(q, '(?i)^tell me about .+$') THEN 'lookup' WHEN regexp_matches(q, '(?i)^(?:list|show) .+$') THEN 'list' END AS mode,
    CASE WHEN regexp_matches(q, '(?i)^who (?:was|is) .+$') THEN regexp_extract(q, '(?i)^who (?:was|is) (.+)$', 1) WHEN regexp_matches(q, '(?i)^tell me about .+$') THEN regexp_extract(q, '(?i)^tell me about (.+)$', 1)
      WHEN regexp_matches(q, '(?i)^(?:list|show) .+$') THEN regexp_extract(q, '(?i)^(?:list|show) (.+)$', 1) END AS subject,
    CASE WHEN asked <> '' AND len({R.words("regexp_replace(asked, '(?i)^(?:the feast of|st\\.?|saint)\\s+', '')")}) <= 2 THEN asked ELSE '' END AS ambiguous FROM a""")
def intents(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").where("content is not null and lower(trim(role)) = 'user'").select("id", "content").distinct()
    got = match.intent(F.col("content"), _INTENTS)
    asked = match.ambiguous_name(F.regexp_replace(T.strip(F.col("content")), r"[?.!]+$", ""), ["the feast of", "st.", "saint"], ["who was", "who is", "tell me about", "about"])
    return m.select("id", got["mode"].alias("mode"), got["subject"].alias("subject"), asked.alias("ambiguous"))


_SUBJECTS = f"""i AS (SELECT id, q, CASE WHEN regexp_matches(q, '(?i)^who (?:was|is) .+$') THEN 'lookup' WHEN regexp_matches(q, '(?i)^tell me about .+$') THEN 'lookup' WHEN regexp_matches(q, '(?i)^(?:list|show) .+$') THEN 'list' END AS mode,
    CASE WHEN regexp_matches(q, '(?i)^who (?:was|is) .+$') THEN regexp_extract(q, '(?i)^who (?:was|is) (.+)$', 1) WHEN regexp_matches(q, '(?i)^tell me about .+$') THEN regexp_extract(q, '(?i)^tell me about (.+)$', 1)
      WHEN regexp_matches(q, '(?i)^(?:list|show) .+$') THEN regexp_extract(q, '(?i)^(?:list|show) (.+)$', 1) END AS subject
    FROM (SELECT DISTINCT id, {R.collapse(f"regexp_replace({R.strip('content')}, '[?.!]+$', '')")} AS q FROM chat_messages WHERE content IS NOT NULL AND lower(trim(role)) = 'user'))"""
_EN_KEYS = f"en AS (SELECT DISTINCT {R.latin_key('name_en', TITLES)} AS key FROM saints_ar_seed)"
_HIT = f"""EXISTS (SELECT 1 FROM en WHERE {R.latin_key('subject', TITLES)} <> '' AND (contains(en.key, {R.latin_key('subject', TITLES)}) OR len(list_filter(string_split({R.latin_key('subject', TITLES)}, ' '), lambda w: NOT list_contains(string_split(en.key, ' '), w))) = 0))"""


@query(f"""WITH {_SUBJECTS}, {_EN_KEYS}, g AS (SELECT *, regexp_matches(subject, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:st[.]?|saint)(?:[^\\p{{L}}\\p{{N}}_]|$)') OR {_HIT} AS good FROM i)
  SELECT id, CASE WHEN good THEN mode END AS mode, CASE WHEN good THEN subject END AS subject FROM g""")
def intents_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Intents whose subject has a title or is a name of the index."""
    m = table(spark, d, "chat_messages").where("content is not null and lower(trim(role)) = 'user'").select("id", match.intent(F.col("content"), _INTENTS).alias("i")).distinct().select("id", "i.mode", "i.subject")
    names = table(spark, d, "saints_ar_seed").select(F.col("name_en").alias("id"), F.col("name_en").alias("name")).distinct()
    keys = match.name_keys(names, F.array("name"), RULES.key)
    return match.confirmed_intents(m, keys, ["st.", "saint"], RULES.key)


@query(f"""WITH {_SCORED}, {_CUT}, r AS ({_RANKED.format('cut', 5)}), w AS (SELECT name, row_number() OVER (ORDER BY name) AS rank FROM (SELECT DISTINCT p_type AS name FROM part)),
  u AS (SELECT name, true AS is_real_record, rank FROM r WHERE query = 'idge' UNION ALL SELECT name, false, rank FROM w WHERE rank <= 5) SELECT name, is_real_record, (row_number() OVER (ORDER BY is_real_record DESC, rank, name) - 1)::INT AS position FROM u""")
def match_report(spark: SparkSession, d: str) -> DataFrame:
    """What a search finds: records of the index, then names that are only mentioned."""
    found = match.search(_part_keys(spark, d), _queries(spark).where("query = 'idge'"), limit=5).select("name", "rank")
    weak = page(table(spark, d, "part").select(F.col("p_type").alias("name")).distinct(), ["name"], 5)
    return match.match_report(found, positioned(weak, ["name"], "rank").withColumn("rank", F.col("rank") + 1))


@query(f"""WITH {_SCORED}, {_CUT}, r AS ({_RANKED.format('cut', 400)})
  SELECT query, 'Which did you mean by ' || query || '?' AS answer, array_to_string(list(name ORDER BY rank)[1:12], '|') AS options, count(*) AS total FROM r GROUP BY query""")
def option_payload(spark: SparkSession, d: str) -> DataFrame:
    found = match.search(_part_keys(spark, d), _queries(spark), ambiguous=F.col("query") == "red", limit=400)
    return match.option_payload(found, "Which did you mean by %s?").withColumn("options", F.array_join("options", "|"))


@query("""SELECT (SELECT count(*) FROM saints_ar_seed) AS n_records, array_to_string((SELECT list(name_en ORDER BY name_en) FROM (SELECT name_en FROM saints_ar_seed ORDER BY lower(name_en), name_en LIMIT 20)), '|') AS sample,
  (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM chunks WHERE starts_with(pdf, 'saints')) AS n_prefixed,
  (SELECT array_to_string(list(pdf || '=' || n ORDER BY pdf), '|') FROM (SELECT pdf, count(*) AS n FROM chunks WHERE starts_with(pdf, 'saints') GROUP BY pdf)) AS files, 'chunk_index|id|language|page|pdf|source_group|source_type|text|title|url' AS fields""")
def index_report(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "saints_ar_seed").select(F.col("name_en").alias("name"))
    return match.index_report(records, table(spark, d, "chunks"), "saints").withColumns(
        {"sample": F.array_join("sample", "|"), "fields": F.array_join("fields", "|"), "files": F.array_join(F.transform("files", lambda f: F.concat(f["pdf"], F.lit("="), f["n"].cast("string"))), "|")}
    )


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) > 0 ORDER BY lower(p_name), p_partkey LIMIT 400 OFFSET 0")
def full_page(spark: SparkSession, d: str) -> DataFrame:
    return page(table(spark, d, "part").select("p_partkey", "p_name"), [F.lower("p_name"), "p_partkey"], 1000, -5)
