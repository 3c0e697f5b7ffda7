"""Conversations: history, what a follow-up question means, stored messages, and what a client shows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import match
from quern.operators.ranking import first_wins, numbered

SOURCES = "array<struct<source_type: string, pdf: string, page: int, url: string, title: string>>"


def recent_history(messages: DataFrame, n: int = 6) -> DataFrame:
    """(conversation_id, history): the last n messages with role and content, one line each, oldest first."""
    valid = messages.where("role is not null and content is not null")
    last = valid.withColumn("back", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("sort_order"), F.desc("id")))).where(F.col("back") <= n)
    line = F.concat(F.upper("role"), F.lit(": "), F.col("content"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("back"), line.alias("line")))), lambda s: s["line"])
    return last.groupBy("conversation_id").agg(F.array_join(ordered, "\n").alias("history"))


def history_messages(messages: DataFrame, role: str | None = None) -> DataFrame:
    """Messages with visible content, of one role if given, content trimmed."""
    out = messages.withColumn("content", T.strip(F.coalesce("content", F.lit("")))).where("content != ''")
    return out if role is None else out.where(F.col("role") == role)


def named_entity(content: Column, titles: Iterable[str] = ("St\\.", "Saint")) -> Column:
    """The first bold text of 2 to 80 characters, else the first title with up to five capitalised words; null for none."""
    # The patterns of a bold text and of a title with capitalised words.
    bold = T.clean_label(F.regexp_extract(content, r"\*\*([^*\n]{2,80})\*\*", 1))
    plain = F.regexp_extract(content, rf"(?<![\p{{L}}\p{{N}}_])((?:{'|'.join(titles)})\s+[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){{0,4}})", 1)
    return F.when(bold != "", bold).when(plain != "", T.clean_label(plain))


def asked_name(content: Column) -> Column:
    """The name a user asks about ("who is X", "tell me about X"); null for other questions."""
    # Fixed value: how a question about someone begins.
    name = T.collapse(F.regexp_extract(T.strip(content), r"(?is)^(?:who\s+is|who\s+was|tell\s+me\s+about|about)\s+(.+?)\s*[?.!]*$", 1))
    return F.when(name != "", name)


def last_entity(messages: DataFrame, index: DataFrame | None = None, key: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """(conversation_id, entity): what was last talked about: the newest answer naming something, else the newest question about someone.

    With an ``index`` (keys as of ``match.name_keys``) and the ``key`` it is made with, a name asked about
    becomes its best match there, if it has one.
    """
    said = F.when(F.col("role") == "assistant", named_entity(F.col("content"), **options)).when(F.col("role") == "user", asked_name(F.col("content")))
    found = messages.select("conversation_id", "role", "sort_order", said.alias("entity")).where("entity is not null")
    newest = F.max_by("entity", F.struct((F.col("role") == "assistant").alias("answer"), "sort_order", "entity"))
    if index is None:
        return found.groupBy("conversation_id").agg(newest.alias("entity"))
    last = found.groupBy("conversation_id").agg(newest.alias("entity"), F.max(F.col("role") == "assistant").alias("answered"))
    asked = last.where("not answered").select(F.col("entity").alias("query")).distinct()
    best = match.search(index, asked.withColumn("query_key", key(F.col("query"))), limit=1).select(F.col("query").alias("entity"), "name")
    return last.join(best, "entity", "left").select("conversation_id", F.when(F.col("answered"), F.col("entity")).otherwise(F.coalesce("name", "entity")).alias("entity"))


_WORD_START, _WORD_END = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def has_word(c: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(c).rlike(f"{_WORD_START}(?:{pattern}){_WORD_END}"), F.lit(False))


def refers_back(question: Column) -> Column:
    """Whether a question uses a pronoun or points to something said before."""
    return has_word(question, "he|his|him|she|her|hers|it|its|they|their|them|that|this|the same (?:one|person|place)")


def rewrite_question(question: Column, entity: Column, rules: Sequence[tuple[str, str]], default: str = "{question} {entity}") -> Column:
    """The question with what it refers to filled in: the template of the first rule (pattern, template) it matches, or the default; unchanged if it refers to nothing known."""

    def fill(template: str) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{question}"), question), F.lit("{entity}"), entity)

    out = fill(default)
    for pattern, template in reversed(list(rules)):
        out = F.when(F.lower(question).rlike(pattern), fill(template)).otherwise(out)
    return F.when(entity.isNotNull() & refers_back(question), out).otherwise(question)


def numbered_choice(questions: DataFrame, last_lists: DataFrame) -> DataFrame:
    """Questions (conversation_id, question) with choice, the entry of the conversation's last list that the first figure names."""
    number = F.try_to_number(F.nullif(F.regexp_extract("question", r"([0-9]{1,6})", 1), F.lit("")), F.lit("999999")).cast("int")
    numbered = questions.withColumn("ordinal", number)
    return numbered.join(last_lists.select("conversation_id", "ordinal", F.col("name").alias("choice")), ["conversation_id", "ordinal"], "left").drop("ordinal")


def follow_up_options(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: Sequence[str], n: int = 2) -> Column:
    """The first n options of the first rule (pattern, options) that the text matches, else of the default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.array(*[F.lit(o) for o in default[:n]])
    for pattern, options in reversed(list(rules)):
        out = F.when(low.rlike(pattern), F.array(*[F.lit(o) for o in options[:n]])).otherwise(out)
    return out


def parsed_messages(messages: DataFrame) -> DataFrame:
    """Messages with entities and options as arrays of strings and sources as structs; malformed JSON gives null."""
    return messages.withColumns({"entities": F.from_json("entities", "array<string>"), "options": F.from_json("options", "array<string>"), "sources": F.from_json("sources", SOURCES)})


def list_conversations(conversations: DataFrame, session_id: str) -> DataFrame:
    """Conversations of a session that are not archived, newest change first."""
    return conversations.where((F.col("session_id") == session_id) & F.col("archived_at").isNull()).orderBy(F.desc("updated_at"), "id")


def get_conversation(conversations: DataFrame, conversation_id: str, session_id: str) -> DataFrame:
    return conversations.where((F.col("id") == conversation_id) & (F.col("session_id") == session_id)).limit(1)


def conversation_messages(messages: DataFrame, conversation_id: str) -> DataFrame:
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("sort_order", "id")


def archive(conversations: DataFrame, conversation_id: str, session_id: str, at: Column) -> DataFrame:
    """All conversations, with the given one archived at ``at`` if it is not yet."""
    hit = (F.col("id") == conversation_id) & (F.col("session_id") == session_id) & F.col("archived_at").isNull()
    return conversations.withColumns({"archived_at": F.when(hit, at).otherwise(F.col("archived_at")), "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))})


def next_sort_order(messages: DataFrame) -> DataFrame:
    """(conversation_id, next): one more than the largest sort order."""
    return messages.groupBy("conversation_id").agg((F.coalesce(F.max("sort_order"), F.lit(0)) + 1).alias("next"))


def recent_of_session(messages: DataFrame, conversations: DataFrame, session_id: str, n: int = 6) -> DataFrame:
    """The last n messages of every open conversation of a session, oldest first (a semi-join on the conversation)."""
    mine = conversations.where((F.col("session_id") == session_id) & F.col("archived_at").isNull()).select(F.col("id").alias("conversation_id"))
    last = messages.join(mine, "conversation_id", "left_semi").withColumn("back", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("sort_order"), F.desc("id"))))
    return last.where(F.col("back") <= n).drop("back").orderBy("conversation_id", "sort_order", "id")


def retitle(conversations: DataFrame, first_questions: DataFrame, placeholder: str = "New Chat") -> DataFrame:
    """Conversations whose title is the placeholder take their first question (conversation_id, question) as title."""
    q = first_questions.select(F.col("conversation_id").alias("id"), "question")
    fresh = T.short_title(F.col("question"), placeholder)
    return conversations.join(q, "id", "left").withColumn("title", F.when((F.col("title") == placeholder) & F.col("question").isNotNull(), fresh).otherwise(F.col("title"))).drop("question").select(*conversations.columns)


def save_turns(conversations: DataFrame, messages: DataFrame, turns: DataFrame, placeholder: str = "New Chat") -> tuple[DataFrame, DataFrame]:
    """Conversations and messages after ``turns`` (turn_no, conversation_id, session_id, question, answer, entities, options, sources, at).

    A conversation that is not there is created; orders go on from the largest; every turn adds the
    question and, if there is one, the answer; a placeholder title becomes the first question. A
    ``Snapshots`` store writes both results as one version.
    """
    known = conversations.select(F.col("id").alias("conversation_id"))
    new = turns.join(known, "conversation_id", "left_anti").groupBy("conversation_id").agg(F.min("session_id").alias("session_id"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    created = new.select(F.col("conversation_id").alias("id"), "session_id", F.lit(placeholder).alias("title"), F.lit(None).cast("timestamp").alias("archived_at"), "created_at", "updated_at")
    touched = turns.groupBy(F.col("conversation_id").alias("id")).agg(F.max("at").alias("_at"))
    every = conversations.unionByName(created).join(touched, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")
    first = turns.groupBy("conversation_id").agg(F.min_by("question", "turn_no").alias("question"))
    every = retitle(every, first, placeholder)
    none = F.lit("[]")
    asked = F.struct(F.lit(0).alias("n"), F.lit("user").alias("role"), F.col("question").alias("content"), none.alias("entities"), none.alias("options"), none.alias("sources"))
    said = F.struct(F.lit(1).alias("n"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.coalesce("entities", none).alias("entities"), F.coalesce("options", none).alias("options"), F.coalesce("sources", none).alias("sources"))
    rows = turns.select("conversation_id", "turn_no", "at", F.explode(F.array(asked, said)).alias("m")).select("conversation_id", "turn_no", "at", "m.*").where("content is not null")
    base = next_sort_order(messages).withColumnRenamed("next", "_next")
    order = F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn_no", "n"))
    rows = rows.withColumn("_k", order).join(base, "conversation_id", "left").withColumn("sort_order", (F.coalesce("_next", F.lit(1)) + F.col("_k") - 1).cast("int"))
    rows = rows.select(F.sha1(F.concat_ws("/", "conversation_id", F.col("sort_order").cast("string"))).alias("id"), "conversation_id", "role", "content", "entities", "options", "sources", "sort_order", F.col("at").alias("created_at"))
    return every, messages.unionByName(rows.select(*messages.columns))


def pending(done: DataFrame, names: DataFrame) -> DataFrame:
    """Names (name) of steps that are not in the ledger yet, in order."""
    return names.join(done.select("name").distinct(), "name", "left_anti").orderBy("name")


def violations(conversations: DataFrame, messages: DataFrame, roles: Iterable[str] = ("user", "assistant")) -> DataFrame:
    """(rule, n): how many rows break each constraint of the two tables."""

    def one(rule: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("n")).select("rule", "n")

    def repeated(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1")

    known = conversations.select(F.col("id").alias("conversation_id"))
    parts = [
        one("conversation id repeated", repeated(conversations, "id")),
        one("message id repeated", repeated(messages, "id")),
        one("message without conversation", messages.join(known, "conversation_id", "left_anti")),
        one("role not allowed", messages.where(~F.coalesce(F.col("role").isin(*roles), F.lit(False)))),
        one("sort order repeated", repeated(messages.where("sort_order is not null"), "conversation_id", "sort_order")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def move_to_front(rows: DataFrame, changed: DataFrame, key: str, order: str) -> DataFrame:
    """The changed rows first, then the others in their order; each key once, with position."""
    both = changed.withColumn("_first", F.lit(0)).unionByName(rows.withColumn("_first", F.lit(1)))
    once = first_wins(both, [key], ["_first", order])
    return numbered(once, ["_first", order]).drop("_first")


def merge_names(parts: Sequence[Column]) -> Column:
    """Array of the arrays' items in order, each once whatever its case, blank ones dropped."""
    every = F.filter(F.transform(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])), T.strip), lambda v: F.coalesce(v != "", F.lit(False)))
    low = F.transform(every, F.lower)
    return F.filter(every, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def visible_options(options: Column, openers: Iterable[str], n: int = 2) -> Column:
    """The first n options that are questions (end in a mark or open like one); if there are none, all options; each once."""
    clean = merge_names([F.transform(options, lambda o: T.collapse(F.regexp_replace(o, r"^[-*•\s]+", "")))])
    opening = "|".join(openers)
    questions = F.filter(clean, lambda o: o.endswith("?") | o.endswith("؟") | F.lower(o).rlike(rf"^(?:{opening})(?:[^\p{{L}}]|$)"))
    return F.when(F.size(questions) > 0, F.slice(questions, 1, n)).otherwise(clean)


def as_statement(option: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A suggested question in the user's words: the first rule (pattern, replacement) that matches, trailing marks gone."""
    clean = F.regexp_replace(T.collapse(option), r"[?؟]+$", "")
    out = clean
    for pattern, replacement in reversed(list(rules)):
        out = F.when(clean.rlike(pattern), F.regexp_replace(clean, pattern, replacement)).otherwise(out)
    return out


def compact_context(c: Column, stop: str | None = None, limit: int = 1200) -> Column:
    """Collapsed text up to a stop pattern, cut to the limit."""
    t = T.collapse(F.coalesce(c, F.lit("")))
    return F.substring(T.strip(F.regexp_replace(t, f"(?s){stop}.*$", "")) if stop else t, 1, limit)


def usable_sources(sources: Column) -> Column:
    """Sources that can be shown: a file with its page, or an address."""
    return F.filter(F.coalesce(sources, F.array().cast(SOURCES)), lambda s: (F.coalesce(s["pdf"], F.lit("")) != "") & s["page"].isNotNull() | (F.coalesce(s["url"], F.lit("")) != ""))


def source_backed(answer: Column, sources: Column, refusals: Iterable[str]) -> Column:
    """Whether an answer rests on sources: it has some, is not blank and is no refusal."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    refused = F.lit(False)
    for r in refusals:
        refused |= low.contains(r)
    return (T.strip(low) != "") & (F.size(usable_sources(sources)) > 0) & ~refused


def bold_segments(text: Column) -> Column:
    """Array of the bold pieces of a text in order."""
    return F.regexp_extract_all(text, F.lit(r"\*\*([^*]+)\*\*"), 1)


def linked_names(rows: DataFrame, text_col: str, names: DataFrame, key: Sequence[str], titles: Iterable[str]) -> DataFrame:
    """(key, pos, segment): bold pieces whose display key is that of a name (name)."""
    found = rows.select(*key, F.posexplode(bold_segments(F.col(text_col))).alias("pos", "segment")).withColumn("_k", T.display_key(F.col("segment"), titles))
    known = names.select(T.display_key(F.col("name"), titles).alias("_k")).where("_k != ''").distinct()
    return found.join(known, "_k", "left_semi").drop("_k")


def looks_like_name(value: Column, titles: Iterable[str], always: str = "") -> Column:
    """Whether a text reads like a name: a title before it, a term of ``always`` (a pattern) in it, or several words of its display key."""
    titles = list(titles)
    key = T.display_key(value, titles)
    titled = value.rlike(rf"(?i)^\s*(?:{'|'.join(t.replace('.', '[.]?') for t in titles)})\s+")
    named = value.rlike(rf"(?i){_WORD_START}(?:{always}){_WORD_END}") if always else F.lit(False)
    return F.coalesce((key != "") & (named | titled | (F.size(T.words(key)) >= 2)), F.lit(False))


def valid_names(rows: DataFrame, value_col: str, names: DataFrame, titles: Iterable[str], always: str = "") -> DataFrame:
    """``rows`` with is_name: the value's display key is that of a known name (name), or it looks like one."""
    titles = list(titles)
    known = names.select(T.display_key(F.col("name"), titles).alias("_k")).where("_k != ''").distinct().withColumn("_known", F.lit(True))
    out = rows.withColumn("_k", T.display_key(F.col(value_col), titles)).join(known, "_k", "left")
    return out.withColumn("is_name", F.coalesce("_known", F.lit(False)) | looks_like_name(F.col(value_col), titles, always)).drop("_k", "_known")


def display_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, shown): the first alias (name_key, ordinal, alias) of a name in the other language, else the name."""
    first = aliases.groupBy("name_key").agg(F.min_by("alias", "ordinal").alias("alias"))
    return names.withColumn("name_key", F.lower(T.collapse(F.col("name")))).join(first, "name_key", "left").select("name", F.coalesce("alias", "name").alias("shown"))


def translate_keys(keys: DataFrame, texts: DataFrame, language: str, fallback: str = "en") -> DataFrame:
    """(key, text): each key's text in the language, else in the fallback, else the key. ``texts`` has lang, key, text."""
    mine = texts.where(F.col("lang") == language).select("key", F.col("text").alias("_a"))
    other = texts.where(F.col("lang") == fallback).select("key", F.col("text").alias("_b"))
    return keys.join(mine, "key", "left").join(other, "key", "left").select("key", F.coalesce("_a", "_b", "key").alias("text"))
