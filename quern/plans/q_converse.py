"""Queries over conversations, clients and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import converse, guard, match
from quern.operators.ranking import numbered
from quern.plans import registry as R
from quern.plans.registry import query, table
from quern.sources.collections import Snapshots
from quern.sources.tables import shared_folder

#: Messages once per id (the table holds some rows twice), as all queries here use them.
_M = """m0 AS (SELECT id, min(conversation_id) AS conversation_id, min(CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' ELSE lower(trim(role)) END) AS role,
  min(content) AS content, min(entities) AS entities, min(options) AS options, min(sources) AS sources, min(sort_order) AS sort_order, min(created_at) AS created_at FROM chat_messages GROUP BY id), m AS (SELECT * FROM m0 WHERE sort_order IS NOT NULL)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    raw = F.lower(F.trim("role"))
    role = F.when(raw.isin("user", "human"), "user").when(raw.isin("assistant", "ai", "bot", "model"), "assistant").otherwise(raw)
    rows = table(spark, d, "chat_messages").withColumn("role", role)
    rows = rows.groupBy("id").agg(*[F.min(c).alias(c) for c in ("conversation_id", "role", "content", "entities", "options", "sources", "sort_order", "created_at")])
    return rows.where("sort_order is not null")


def _session(spark: SparkSession, d: str) -> str:
    return "sess-0-0"


@query(f"""WITH {_M}, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sort_order DESC, id DESC) AS back FROM m WHERE role IS NOT NULL AND content IS NOT NULL)
  SELECT conversation_id, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY back DESC) AS history FROM b WHERE back <= 6 GROUP BY conversation_id""")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    return converse.recent_history(_messages(spark, d))


@query(f"WITH {_M} SELECT id, conversation_id, {R.strip('content')} AS content FROM m WHERE role = 'assistant' AND {R.strip('content')} <> ''")
def history_messages(spark: SparkSession, d: str) -> DataFrame:
    return converse.history_messages(_messages(spark, d), "assistant").select("id", "conversation_id", "content")


_BOLD = R.strip("regexp_replace(regexp_extract(content, '\\*\\*([^*\\n]{2,80})\\*\\*', 1), '^[0-9]+[.)]\\s*', '')")
_TITLED = R.strip("regexp_extract(content, '(?:^|[^\\p{L}\\p{N}_])((?:St\\.|Saint)\\s+[A-Z][A-Za-z]*(?:\\s+[A-Z][A-Za-z]*){0,4})', 1)")
_ASKED = R.collapse(f"regexp_extract({R.strip('content')}, '(?is)^(?:who\\s+is|who\\s+was|tell\\s+me\\s+about|about)\\s+(.+?)\\s*[?.!]*$', 1)")
_ENTITY = f"""e AS (SELECT conversation_id, sort_order, role, CASE WHEN role = 'assistant' THEN CASE WHEN {_BOLD} <> '' THEN {_BOLD} WHEN {_TITLED} <> '' THEN {_TITLED} END
  WHEN role = 'user' THEN nullif({_ASKED}, '') END AS entity FROM m), n AS (SELECT conversation_id, entity, row_number() OVER (PARTITION BY conversation_id ORDER BY (role = 'assistant') DESC, sort_order DESC, entity DESC) AS k FROM e WHERE entity IS NOT NULL),
  last AS (SELECT conversation_id, entity FROM n WHERE k = 1)"""


@query(f"WITH {_M}, {_ENTITY} SELECT conversation_id, entity FROM last")
def last_entity(spark: SparkSession, d: str) -> DataFrame:
    return converse.last_entity(_messages(spark, d))


_BACK = "coalesce(regexp_matches(lower(content), '(?:^|[^\\p{L}\\p{N}_])(?:he|his|him|she|her|hers|it|its|they|their|them|that|this|the same (?:one|person|place))(?:[^\\p{L}\\p{N}_]|$)'), false)"


@query(f"WITH {_M} SELECT id, {_BACK} AS refers_back FROM m WHERE role = 'user'")
def followup_flag(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).where("role = 'user'").select("id", converse.refers_back(F.col("content")).alias("refers_back"))


@query(f"""WITH {_M}, {_ENTITY} SELECT m.id, CASE WHEN last.entity IS NOT NULL AND {_BACK} THEN CASE WHEN regexp_matches(lower(content), 'teach') THEN 'What did ' || last.entity || ' teach? ' || content ELSE content || ' ' || last.entity END ELSE content END AS question
  FROM m LEFT JOIN last ON m.conversation_id = last.conversation_id WHERE role = 'user' AND content IS NOT NULL""")
def question_rewrite(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    asked = m.where("role = 'user' and content is not null").join(converse.last_entity(m), "conversation_id", "left")
    return asked.select("id", converse.rewrite_question(F.col("content"), F.col("entity"), [("teach", "What did {entity} teach? {question}")]).alias("question"))


@query(f"""WITH {_M}, o AS (SELECT conversation_id, i + 1 AS ordinal, (options::JSON ->> i) AS name FROM (SELECT conversation_id, max(options) AS options FROM m WHERE json_valid(options) GROUP BY conversation_id), LATERAL (SELECT unnest(range(0, 20)) AS i) WHERE (options::JSON ->> i) IS NOT NULL),
  q AS (SELECT id, conversation_id, try_cast(regexp_extract(content, '([0-9]{{1,6}})', 1) AS INT) AS ordinal FROM m WHERE role = 'user')
  SELECT q.id, o.name AS choice FROM q LEFT JOIN o USING (conversation_id, ordinal)""")
def numbered_choice(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    lists = m.withColumn("o", F.from_json("options", "array<string>")).where("o is not null").groupBy("conversation_id").agg(F.max("options").alias("options"))
    lists = lists.select("conversation_id", F.posexplode(F.from_json("options", "array<string>")).alias("i", "name")).select("conversation_id", (F.col("i") + 1).alias("ordinal"), "name")
    asked = m.where("role = 'user'").select("id", "conversation_id", F.col("content").alias("question"))
    return converse.numbered_choice(asked, lists).select("id", "choice")


@query(f"""WITH {_M} SELECT id, CASE WHEN regexp_matches(lower(coalesce(content, '')), 'fast') THEN 'How is fasting kept?|Why is there a fast?' WHEN regexp_matches(lower(coalesce(content, '')), 'pray') THEN 'How is prayer learned?' ELSE 'What does this mean?|Who said it?' END AS options FROM m""")
def followup_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [("fast", ["How is fasting kept?", "Why is there a fast?", "third"]), ("pray", ["How is prayer learned?"])]
    return _messages(spark, d).select("id", F.array_join(converse.follow_up_options(F.col("content"), rules, ["What does this mean?", "Who said it?"]), "|").alias("options"))


@query("SELECT id, title, updated_at FROM chat_conversations WHERE session_id = 'sess-0-0' AND archived_at IS NULL ORDER BY updated_at DESC")
def conv_list(spark: SparkSession, d: str) -> DataFrame:
    return converse.list_conversations(table(spark, d, "chat_conversations"), _session(spark, d)).select("id", "title", "updated_at")


_ONE = "(SELECT min(id) FROM chat_conversations WHERE session_id = 'sess-0-0' AND archived_at IS NULL)"


def _one(spark: SparkSession, d: str) -> str:
    c = table(spark, d, "chat_conversations").where("session_id = 'sess-0-0' and archived_at is null")
    return c.agg(F.min("id")).first()[0] or ""


@query(f"SELECT id, session_id, title FROM chat_conversations WHERE id = {_ONE} AND session_id = 'sess-0-0' LIMIT 1")
def conv_detail(spark: SparkSession, d: str) -> DataFrame:
    return converse.get_conversation(table(spark, d, "chat_conversations"), _one(spark, d), _session(spark, d)).select("id", "session_id", "title")


@query(f"WITH {_M} SELECT id, role, content, sort_order FROM m WHERE conversation_id = {_ONE}")
def conv_messages(spark: SparkSession, d: str) -> DataFrame:
    return converse.conversation_messages(_messages(spark, d), _one(spark, d)).select("id", "role", "content", "sort_order")


@query(f"""SELECT id, CASE WHEN id = {_ONE} THEN TIMESTAMP '2030-01-01 00:00:00' ELSE archived_at END AS archived_at FROM chat_conversations""")
def conv_archive(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return converse.archive(table(spark, d, "chat_conversations"), _one(spark, d), _session(spark, d), at).select("id", "archived_at")


@query(f"WITH {_M} SELECT conversation_id, (coalesce(max(sort_order), 0) + 1)::INT AS next FROM m GROUP BY conversation_id")
def next_sort_order(spark: SparkSession, d: str) -> DataFrame:
    return converse.next_sort_order(_messages(spark, d))


@query(f"""WITH {_M}, b AS (SELECT m.*, row_number() OVER (PARTITION BY conversation_id ORDER BY sort_order DESC, id DESC) AS back FROM m
  WHERE EXISTS (SELECT 1 FROM chat_conversations c WHERE c.id = m.conversation_id AND c.session_id = 'sess-0-0' AND c.archived_at IS NULL)) SELECT id, conversation_id, sort_order FROM b WHERE back <= 6""")
def session_recent(spark: SparkSession, d: str) -> DataFrame:
    return converse.recent_of_session(_messages(spark, d), table(spark, d, "chat_conversations"), _session(spark, d)).select("id", "conversation_id", "sort_order")


_SHORT = f"CASE WHEN {R.strip('f.question')} = '' THEN 'New Chat' WHEN length({R.strip('f.question')}) > 70 THEN substr({R.strip('f.question')}, 1, 67) || '...' ELSE {R.strip('f.question')} END"


@query(f"""WITH {_M}, f AS (SELECT conversation_id, arg_min(content, (sort_order, id)) AS question FROM (SELECT * FROM m WHERE role = 'user' AND content IS NOT NULL) GROUP BY conversation_id)
  SELECT c.id, CASE WHEN c.title = 'New Chat' AND f.question IS NOT NULL THEN {_SHORT} ELSE c.title END AS title FROM chat_conversations c LEFT JOIN f ON f.conversation_id = c.id""")
def conv_title(spark: SparkSession, d: str) -> DataFrame:
    first = _messages(spark, d).where("role = 'user' and content is not null").groupBy("conversation_id").agg(F.min_by("content", F.struct("sort_order", "id")).alias("question"))
    return converse.retitle(table(spark, d, "chat_conversations"), first).select("id", "title")


@query(f"""WITH {_M}, t AS (SELECT id AS cid, 'follow up' AS question, CASE WHEN title = 'New Chat' THEN NULL ELSE 'answer' END AS answer FROM chat_conversations),
  base AS (SELECT conversation_id, max(sort_order) AS top FROM m GROUP BY conversation_id), n AS (SELECT cid, 0 AS k, 'user' AS role, question AS content FROM t UNION ALL SELECT cid, 1, 'assistant', answer FROM t WHERE answer IS NOT NULL),
  more AS (SELECT cid AS conversation_id, role, content, (coalesce(top, 0) + 1 + k)::INT AS sort_order FROM n LEFT JOIN base ON base.conversation_id = cid)
  SELECT conversation_id, role, content, sort_order FROM more UNION ALL SELECT conversation_id, role, content, sort_order FROM m""")
def save_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chat_conversations")
    none = F.lit(None).cast("string")
    turns = c.select(
        F.lit(1).alias("turn_no"), F.col("id").alias("conversation_id"), "session_id", F.lit("follow up").alias("question"), F.when(F.col("title") != "New Chat", "answer").alias("answer"),
        none.alias("entities"), none.alias("options"), none.alias("sources"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("at"),
    )
    _, messages = converse.save_turns(c, _messages(spark, d), turns)
    return messages.select("conversation_id", "role", "content", "sort_order")


@query(f"""WITH {_M}, ids AS (SELECT DISTINCT conversation_id AS id FROM m WHERE conversation_id IS NOT NULL), new AS (SELECT id FROM ids WHERE id NOT IN (SELECT id FROM chat_conversations))
  SELECT id, CASE WHEN title = 'New Chat' THEN 'a follow up' ELSE title END AS title, session_id FROM chat_conversations UNION ALL SELECT id, 'a follow up', 'late' FROM new""")
def saved_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations after a turn for each one that messages name: those not there are created, and both tables are written as one version."""
    c, m = table(spark, d, "chat_conversations"), _messages(spark, d)
    none = F.lit(None).cast("string")
    ids = m.where("conversation_id is not null").select("conversation_id").distinct().unionByName(c.select(F.col("id").alias("conversation_id"))).distinct()
    turns = ids.select(F.lit(1).alias("turn_no"), "conversation_id", F.lit("late").alias("session_id"), F.lit("a follow up").alias("question"), none.alias("answer"), none.alias("entities"), none.alias("options"), none.alias("sources"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("at"))
    conversations, messages = converse.save_turns(c, m, turns)
    store = Snapshots(spark, shared_folder(spark))
    store.write({"conversations": conversations, "messages": messages})
    return store.read("conversations").select("id", "title", "session_id")


_INDEXED = f"""idx AS (SELECT DISTINCT name_en AS name, {R.latin_key('name_en', ['st', 'saint', 'saints'])} AS key FROM saints_ar_seed), w AS (SELECT n.conversation_id, n.entity, n.role = 'assistant' AS answered, {R.latin_key('n.entity', ['st', 'saint', 'saints'])} AS qk FROM
    (SELECT conversation_id, role, entity, row_number() OVER (PARTITION BY conversation_id ORDER BY (role = 'assistant') DESC, sort_order DESC, entity DESC) AS k FROM e WHERE entity IS NOT NULL) n WHERE k = 1),
  hits AS (SELECT w.entity, idx.name, CASE WHEN qk = key THEN 0 WHEN starts_with(key, qk) THEN 2 WHEN contains(key, qk) THEN 3 WHEN len(list_filter(string_split(qk, ' '), lambda x: NOT list_contains(string_split(key, ' '), x))) = 0 THEN 4 END AS score FROM (SELECT DISTINCT entity, qk FROM w WHERE NOT answered AND qk <> '') w, idx),
  best AS (SELECT entity, arg_min(name, (score, length(name), lower(name))) AS name FROM hits WHERE score IS NOT NULL GROUP BY entity)"""


@query(f"WITH {_M}, {_ENTITY}, {_INDEXED} SELECT conversation_id, CASE WHEN answered THEN w.entity ELSE coalesce(best.name, w.entity) END AS entity FROM w LEFT JOIN best ON best.entity = w.entity")
def last_entity_indexed(spark: SparkSession, d: str) -> DataFrame:
    """What was last talked about, with a name asked for as the index has it."""
    def key(c):
        return T.latin_key(c, titles=["st", "saint", "saints"])

    names = table(spark, d, "saints_ar_seed").select(F.col("name_en").alias("id"), F.col("name_en").alias("name")).distinct()
    return converse.last_entity(_messages(spark, d), match.name_keys(names, F.array("name"), key), key)


@query(f"""WITH {_M.replace(', m AS (SELECT * FROM m0 WHERE sort_order IS NOT NULL)', '')}
  SELECT 'conversation id repeated' AS rule, count(*) AS n FROM (SELECT id FROM chat_conversations GROUP BY id HAVING count(*) > 1) UNION ALL
  SELECT 'message id repeated', count(*) FROM (SELECT id FROM chat_messages GROUP BY id HAVING count(*) > 1) UNION ALL
  SELECT 'message without conversation', count(*) FROM chat_messages WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT id FROM chat_conversations) UNION ALL
  SELECT 'role not allowed', count(*) FROM chat_messages WHERE role IS NULL OR role NOT IN ('user', 'assistant') UNION ALL
  SELECT 'sort order repeated', count(*) FROM (SELECT conversation_id, sort_order FROM chat_messages WHERE sort_order IS NOT NULL GROUP BY ALL HAVING count(*) > 1)""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    return converse.violations(table(spark, d, "chat_conversations"), table(spark, d, "chat_messages"))


@query("SELECT name FROM (VALUES ('002_more'), ('001_base'), ('003_last')) t(name) WHERE name NOT IN ('001_base')")
def pending_steps(spark: SparkSession, d: str) -> DataFrame:
    return converse.pending(spark.createDataFrame([("001_base",)], "name string"), spark.createDataFrame([("002_more",), ("001_base",), ("003_last",)], "name string"))


@query("""WITH c AS (SELECT id, title, row_number() OVER (ORDER BY id) AS place FROM chat_conversations), x AS (SELECT id, 'changed' AS title, place, 0 AS f FROM c WHERE title = 'New Chat' UNION ALL SELECT id, title, place, 1 FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, place) AS n FROM x) SELECT id, title, (row_number() OVER (ORDER BY f, place) - 1)::INT AS position FROM k WHERE n = 1""")
def move_to_front(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered(table(spark, d, "chat_conversations").select("id", "title"), ["id"], "place")
    changed = rows.where("title = 'New Chat'").withColumn("title", F.lit("changed"))
    return converse.move_to_front(rows, changed, "id", "place").select("id", "title", "position")


_OPTS = "list_filter(list_transform(coalesce(TRY_CAST(CASE WHEN json_valid(options) THEN options END AS JSON)::VARCHAR[], []), lambda v: trim(v)), lambda v: v <> '')"
_OPTS_ONCE = f"list_filter({_OPTS}, lambda v, i: list_position(list_transform({_OPTS}, lambda x: lower(x)), lower(v)) = i)"
_ASKS = f"list_filter({_OPTS_ONCE}, lambda o: ends_with(o, '?') OR ends_with(o, '؟'))"


@query(f"WITH {_M} SELECT id, array_to_string(CASE WHEN len({_ASKS}) > 0 THEN ({_ASKS})[1:2] ELSE {_OPTS_ONCE} END, '|') AS options FROM m")
def option_dedup(spark: SparkSession, d: str) -> DataFrame:
    options = F.coalesce(F.from_json("options", "array<string>"), F.array().cast("array<string>"))
    return _messages(spark, d).select("id", F.array_join(converse.visible_options(options, ["would you"]), "|").alias("options"))


@query("""SELECT id, array_to_string(list_filter(n, lambda v, i: list_position(list_transform(n, lambda x: lower(x)), lower(v)) = i), '|') AS names FROM (SELECT id, list_filter(list_concat([name_en], ['ST. BARANIOS OF TALENFELL', upper(name_en)], aliases_ar), lambda v: trim(v) <> '') AS n FROM saints_ar_seed)""")
def merged_names(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.array("name_en"), F.array(F.lit("ST. BARANIOS OF TALENFELL"), F.upper("name_en")), F.col("aliases_ar")]
    return table(spark, d, "saints_ar_seed").select("id", F.array_join(converse.merge_names(parts), "|").alias("names"))


@query(f"""WITH {_M}, c AS (SELECT id, {R.collapse("coalesce(content, '')")} AS t FROM m), s AS (SELECT id, t, regexp_replace(t, '[?؟]+$', '') AS bare FROM c)
  SELECT id, substr({R.strip("regexp_replace(t, '(?s)Sources:.*$', '')")}, 1, 1200) AS context, CASE WHEN regexp_matches(bare, '^Who was (.+)$') THEN regexp_replace(bare, '^Who was (.+)$', 'Tell me who \\1 was') WHEN regexp_matches(bare, '^What is (.+)$') THEN regexp_replace(bare, '^What is (.+)$', 'Explain \\1') ELSE bare END AS statement FROM s""")
def statements(spark: SparkSession, d: str) -> DataFrame:
    rules = [(r"^Who was (.+)$", "Tell me who $1 was"), (r"^What is (.+)$", "Explain $1")]
    text = F.coalesce("content", F.lit(""))
    return _messages(spark, d).select("id", converse.compact_context(F.col("content"), "Sources:").alias("context"), converse.as_statement(text, rules).alias("statement"))


_SRC = "coalesce(CASE WHEN json_valid(sources) THEN from_json(sources, '[{\"source_type\":\"VARCHAR\",\"pdf\":\"VARCHAR\",\"page\":\"INT\",\"url\":\"VARCHAR\",\"title\":\"VARCHAR\"}]') END, [])"
_USABLE = f"len(list_filter({_SRC}, lambda s: (coalesce(s.pdf, '') <> '' AND s.page IS NOT NULL) OR coalesce(s.url, '') <> ''))"


@query(f"WITH {_M} SELECT id, {_USABLE}::INT AS n_sources, {R.strip("coalesce(content, '')")} <> '' AND {_USABLE} > 0 AND NOT contains(lower(coalesce(content, '')), 'could not find') AS backed FROM m WHERE role = 'assistant'")
def usable_sources(spark: SparkSession, d: str) -> DataFrame:
    m = converse.parsed_messages(_messages(spark, d)).where("role = 'assistant'")
    return m.select("id", F.size(converse.usable_sources(F.col("sources"))).alias("n_sources"), converse.source_backed(F.col("content"), F.col("sources"), ["could not find"]).alias("backed"))


_DKEY = "regexp_replace(lower({0}), '^(?:(?:st\\.|saint)\\s+)+', '')"


@query(f"""WITH {_M}, b AS (SELECT id, regexp_extract_all(content, '\\*\\*([^*]+)\\*\\*', 1) AS l FROM m WHERE content IS NOT NULL), s AS (SELECT id, i AS pos, l[i + 1] AS segment FROM b, LATERAL (SELECT unnest(range(0, len(l))) AS i)),
  n AS (SELECT DISTINCT {_DKEY.format(R.collapse("split_part(name_en, ' of ', 1)"))} AS k FROM saints_ar_seed)
  SELECT id, pos::INT AS pos, segment FROM s WHERE {_DKEY.format(R.collapse("regexp_replace(segment, '^\\s*[0-9]+[.)]\\s*', '')"))} IN (SELECT k FROM n)""")
def linked_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "saints_ar_seed").select(F.split("name_en", " of ")[0].alias("name"))
    return converse.linked_names(_messages(spark, d).where("content is not null"), "content", names, ["id"], ["st.", "saint"])


@query(f"""WITH {_M}, b AS (SELECT id, regexp_extract_all(content, '\\*\\*([^*]+)\\*\\*', 1) AS l FROM m WHERE content IS NOT NULL), s AS (SELECT id, i AS pos, l[i + 1] AS segment FROM b, LATERAL (SELECT unnest(range(0, len(l))) AS i)),
  n AS (SELECT DISTINCT {_DKEY.format(R.collapse("split_part(name_en, ' of ', 1)"))} AS k FROM saints_ar_seed), d AS (SELECT *, {_DKEY.format(R.collapse("regexp_replace(segment, '^\\s*[0-9]+[.)]\\s*', '')"))} AS k FROM s)
  SELECT id, pos::INT AS pos, segment, k <> '' AND (k IN (SELECT k FROM n) OR regexp_matches(segment, '(?i)^\\s*(?:st[.]?|saint)\\s+') OR len({R.words('k')}) >= 2) AS is_name FROM d""")
def valid_names(spark: SparkSession, d: str) -> DataFrame:
    """Whether the bold pieces of messages are names: known ones, or such as look like one."""
    names = table(spark, d, "saints_ar_seed").select(F.split("name_en", " of ")[0].alias("name"))
    bold = _messages(spark, d).where("content is not null").select("id", F.posexplode(converse.bold_segments(F.col("content"))).alias("pos", "segment"))
    return converse.valid_names(bold, "segment", names, ["st.", "saint"])


@query("""WITH a AS (SELECT lower(name_en) AS k, aliases_ar[1] AS alias FROM saints_ar_seed WHERE len(aliases_ar) > 0), f AS (SELECT k, min(alias) AS alias FROM a GROUP BY k)
  SELECT name_en AS name, coalesce(f.alias, name_en) AS shown FROM (SELECT DISTINCT name_en FROM saints_ar_seed) s LEFT JOIN f ON f.k = lower(name_en)""")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "saints_ar_seed")
    first = s.where("size(aliases_ar) > 0").select(F.lower("name_en").alias("name_key"), F.lit(0).alias("ordinal"), F.col("aliases_ar")[0].alias("alias")).groupBy("name_key", "ordinal").agg(F.min("alias").alias("alias"))
    return converse.display_names(s.select(F.col("name_en").alias("name")).distinct(), first)


@query("SELECT * FROM (VALUES ('greeting', 'salut'), ('bye', 'goodbye'), ('unknown', 'unknown')) t(key, text)")
def translated_keys(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.createDataFrame([("fr", "greeting", "salut"), ("en", "greeting", "hello"), ("en", "bye", "goodbye")], "lang string, key string, text string")
    return converse.translate_keys(spark.createDataFrame([("greeting",), ("bye",), ("unknown",)], "key string"), texts, "fr")


@query("""WITH x AS (SELECT doc_id, coalesce(title, '') AS name, 'a' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '@b.example' END AS email, coalesce(source, '') AS subject, coalesce(text, '') AS message, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS company, doc_id * 100 AS age FROM documents),
  l AS (SELECT *, len(regexp_extract_all(message, '(?i)(?:https?://|www\\.)')) AS links FROM x)
  SELECT doc_id, CASE WHEN length(trim(company)) <> 0 THEN 'honeypot' WHEN age < 3500 THEN 'too fast' WHEN NOT length(trim(name)) BETWEEN 1 AND 120 THEN 'name' WHEN NOT (length(trim(email)) <= 254 AND regexp_matches(trim(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')) THEN 'email'
    WHEN length(trim(subject)) > 160 THEN 'subject' WHEN NOT length(trim(message)) BETWEEN 10 AND 3000 THEN 'message' WHEN links > 2 THEN 'links' WHEN contains(lower(subject || ' ' || message), 'lottery') OR contains(lower(subject || ' ' || message), 'garden') THEN 'keywords' END AS reason FROM l""")
def validation_reason(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id", F.coalesce("title", F.lit("")).alias("name"), F.concat(F.lit("a"), doc.cast("string"), F.when(doc % 5 == 0, "").otherwise("@b.example")).alias("email"), F.coalesce("source", F.lit("")).alias("subject"),
        F.coalesce("text", F.lit("")).alias("message"), F.when(doc % 7 == 0, "x").otherwise("").alias("company"), (doc * 100).alias("age_ms"),
    )
    return rows.select("doc_id", guard.first_failure(guard.message_checks(["lottery", "garden"])).alias("reason"))


@query("""WITH h(n, forwarded, real, other) AS (VALUES (1, ' 1.2.3.4 , 5.6.7.8', 'r', NULL), (2, NULL, ' r ', 'o'), (3, '', NULL, 'o'), (4, NULL, NULL, ''), (5, ',x', NULL, NULL))
  SELECT n, coalesce(nullif(trim(split_part(forwarded, ',', 1)), ''), nullif(trim(real), ''), nullif(trim(other), ''), 'unknown') AS key FROM h""")
def client_key(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, " 1.2.3.4 , 5.6.7.8", "r", None), (2, None, " r ", "o"), (3, "", None, "o"), (4, None, None, ""), (5, ",x", None, None)]
    h = spark.createDataFrame(rows, "n int, forwarded string, real string, other string")
    return h.select("n", guard.client_key(F.col("forwarded"), F.col("real"), F.col("other")).alias("key"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  w AS (SELECT user_id, event_id, us, n, true AS accepted, 1 AS c, us + 86400000000 AS reset FROM o WHERE n = 1
    UNION ALL SELECT o.user_id, o.event_id, o.us, o.n, o.us >= w.reset OR w.c < 2, CASE WHEN o.us >= w.reset THEN 1 WHEN w.c < 2 THEN w.c + 1 ELSE w.c END, CASE WHEN o.us >= w.reset THEN o.us + 86400000000 ELSE w.reset END
    FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1) SELECT event_id, user_id, accepted FROM w""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return guard.rate_limit(table(spark, d, "events"), "user_id", "ts", ["event_id"], most=2, seconds=86_400).select("event_id", "user_id", "accepted")
