"""Queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import dialogues, language, mixing, near_duplicates, packing, page_body, scans, shared_spans, site_lines, skeleton
from quern.sources.tables import TEXT_KEYS, read_table, text_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return (text_table if name in TEXT_KEYS else read_table)(spark, sf_dir, name)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(_table(spark, d, "documents")).select("doc_id", "line_no").distinct()


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_repeated_lines(_table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_body.page_bodies(_table(spark, d, "web_pages"))


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    return page_body.clean_pages(_table(spark, d, "web_pages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    names = skeleton.look_alikes(_table(spark, d, "saints_ar_generated"), "id", "name_ar").select(F.lit("saints_ar_generated").alias("tbl"), "id_a", "id_b")
    texts = skeleton.look_alikes(_table(spark, d, "chunks"), "id", "text").select(F.lit("chunks").alias("tbl"), "id_a", "id_b")
    return names.unionByName(texts)


def p3_names(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.canonical(_table(spark, d, "saints_ar_generated"), "id", "name_ar")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_pairs(_table(spark, d, "documents"), k=3, threshold=0.5)


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_classes(_table(spark, d, "documents"))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), "text", F.col("lang").alias("label"))
    chunks = _table(spark, d, "chunks").select(F.lit("chunks").alias("tbl"), F.col("id").alias("rec_id"), "text", F.col("language").alias("label"))
    chats = _table(spark, d, "chat_messages").select(F.lit("chat_messages").alias("tbl"), F.col("id").alias("rec_id"), F.col("content").alias("text"), F.lit(None).cast("string").alias("label"))
    return docs, chunks, chats


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks, chats = _labelled(spark, d)
    model = language.train(chunks)
    return language.identify(docs.unionByName(chunks).unionByName(chats), model)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = p5_languages(spark, d)
    code = language.label_code(F.col("label"))
    wrong = (F.col("seg_no") == 0) & (F.col("tbl") != "chat_messages") & (code.isNull() | (code != F.col("lang"))) & ((F.col("tbl") == "documents") | ~F.col("mixed"))
    line = (F.col("seg_no") > 0) & (F.col("tbl") != "documents")
    return rows.where(F.col("lang").isNotNull() & (wrong | line)).select("tbl", "rec_id", "seg_no", "lang").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    turns = dialogues.sound_messages(_table(spark, d, "chat_messages"), _table(spark, d, "chat_conversations"))
    return turns.select("conversation_id", "turn_no", "speaker", F.col("id").alias("message_id"))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    turns = dialogues.sound_turns(_table(spark, d, "chat_messages"), _table(spark, d, "chat_conversations"))
    return turns.select("conversation_id", "turn_no", "parent_no", "score", "speaker", F.col("id").alias("message_id"), "content")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(_table(spark, d, "pdf_pages"))


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(_table(spark, d, "pdf_pages"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"), _table(spark, d, "bin_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    bins = _table(spark, d, "bin_sizes")
    return packing.fill_report(packing.pack_documents(_table(spark, d, "documents"), bins), bins)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p9_mix(spark, d), _table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(_table(spark, d, "documents"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_share(_table(spark, d, "documents"))


def p10_unshared(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return shared_spans.without_spans(docs, shared_spans.shared_spans(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_LINES = r"""
  WITH s AS (SELECT doc_id, text, coalesce(nullif(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*://|//)?(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), ''), source) AS site FROM documents),
  n AS (SELECT site, count(*) AS docs FROM s WHERE site IS NOT NULL GROUP BY site), l AS (SELECT doc_id, site, string_split(text, chr(10)) AS ls FROM s WHERE site IS NOT NULL AND text IS NOT NULL),
  k AS (SELECT doc_id, site, i AS line_no, regexp_replace(lower(ls[i]), '[^\p{L}]+', '', 'g') AS key FROM l, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
  good AS (SELECT site, key FROM k JOIN n USING (site) WHERE key <> '' GROUP BY site, key, docs HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) / docs >= 0.04)"""

_SPEAKER = """CASE WHEN lower(regexp_replace(role, '[\\s\\x{00a0}]+', '', 'g')) IN ('user', 'human') THEN 'user' WHEN lower(regexp_replace(role, '[\\s\\x{00a0}]+', '', 'g')) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant'
    WHEN lower(regexp_replace(role, '[\\s\\x{00a0}]+', '', 'g')) IN ('system', 'tool', 'function', 'developer') THEN 'note' END"""

_SOUND = f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS LAST) AS n FROM chat_messages WHERE conversation_id IS NOT NULL),
  d AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, sort_order, role, content ORDER BY created_at NULLS LAST, id) AS m FROM r WHERE n = 1),
  c AS (SELECT *, {_SPEAKER} AS speaker FROM d WHERE m = 1),
  whole AS (SELECT conversation_id FROM c GROUP BY conversation_id HAVING count(*) = count(DISTINCT sort_order) AND count(*) = count(speaker) AND min(sort_order) = 1 AND max(sort_order) = count(*)),
  t AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sort_order) AS turn_no FROM c WHERE speaker <> 'note' AND conversation_id IN (SELECT conversation_id FROM whole) AND conversation_id IN (SELECT id FROM chat_conversations)),
  good AS (SELECT conversation_id FROM t GROUP BY conversation_id HAVING count(*) % 2 = 0
    AND bool_and((turn_no % 2 = 1) = (speaker = 'user') AND coalesce(regexp_replace(content, '[\\s\\x0b\\p{{Z}}\\p{{Cc}}\\p{{Cf}}\\x{{115f}}\\x{{1160}}\\x{{3164}}\\x{{2800}}]+', '', 'g'), '') <> ''))
  SELECT conversation_id, turn_no::INT AS turn_no, speaker, id AS message_id FROM t WHERE conversation_id IN (SELECT conversation_id FROM good)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose result SQL defines; the others are tested against brute force."""
    return {
        "p1_found": f"{_LINES} SELECT doc_id, line_no::INT AS line_no FROM k WHERE (site, key) IN (SELECT site, key FROM good)",
        "p1_cleaned": f"""{_LINES}, bad AS (SELECT doc_id, list(line_no) AS nos FROM k WHERE (site, key) IN (SELECT site, key FROM good) GROUP BY doc_id)
  SELECT s.doc_id, CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda v, i: NOT list_contains(nos, i)), chr(10)) END AS text, coalesce(len(nos), 0)::INT AS n_removed FROM s LEFT JOIN bad USING (doc_id)""",
        "p6_found": _SOUND,
    }
