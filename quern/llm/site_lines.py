"""Problem 1: lines that one site repeats across its documents.

Three steps over a table of line hashes, written once:

1. every partition keeps, per site, a summary of its lines (decremented
   counters with a known error); summaries of one site add up, so the merge is
   an ordinary aggregation by (site, line) that no hot site can overload;
2. lines whose summed counter plus summed error can reach the threshold are
   candidates, and a second pass counts their documents exactly;
3. confirmed lines go back to the documents as one broadcast set per site.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import materialize

#: A line must be in this many documents of the site, and this share of them.
MIN_DOCS = 5
MIN_SHARE = 0.04
#: Error a summary may have, as a share of the site's documents; at half a
#: threshold or less no line that reaches the threshold can be lost, and a site
#: keeps at most 1 / SUMMARY_ERROR lines per average document line.
SUMMARY_ERROR = MIN_SHARE / 2
#: Counters a partition holds before it prunes within the same error.
MAX_COUNTERS = 200_000
#: Lines up to which a table of (site, key) is broadcast, about 25 MB in a task's
#: memory; beyond it hashes, never texts, are shuffled by site and line.
BROADCAST_ROWS = 250_000


def site_of(url: Column, source: Column) -> Column:
    """Host of the address (lower case, no leading ``www.``, no port), else the source."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*://|//)?(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host).otherwise(source)


def line_key(line: Column) -> Column:
    """Hash of a line's letters in lower case; null for a line without letters."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(letters != "", F.xxhash64(letters))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, site, keys): one key per line of ``text``, null where it has no letters.

    Null texts count as a document without lines; rows without a site are left
    out, as there is nothing to compare them with.
    """
    lines = F.split(F.col("text"), "\n", -1)
    return docs.select(
        "doc_id",
        site_of(F.col("url"), F.col("source")).alias("site"),
        F.when(F.col("text").isNull(), F.array().cast("array<bigint>")).otherwise(F.transform(lines, line_key)).alias("keys"),
    ).where("site is not null")


class _Summary:
    """Counters of one site in one partition: true count - error <= counter <= true count."""

    def __init__(self) -> None:
        self.docs = self.error = 0
        self.counts: dict[int, int] = {}

    def prune(self) -> None:
        error = int(SUMMARY_ERROR * self.docs)
        drop, self.error = error - self.error, error
        if drop > 0:
            self.counts = {k: n - drop for k, n in self.counts.items() if n > drop}


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sites: dict[str, _Summary] = {}
    for batch in batches:
        for site, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = sites.setdefault(site, _Summary())
            s.docs += 1
            counts = s.counts
            for k in keys:
                counts[k] = counts.get(k, 0) + 1
            if len(counts) > MAX_COUNTERS:
                s.prune()
    for site, s in sites.items():
        s.prune()
        n = len(s.counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([site] * (n + 1), pa.string()),
                pa.array([None, *s.counts], pa.int64()),
                pa.array([s.error, *s.counts.values()], pa.int64()),
                pa.array([s.docs] + [0] * n, pa.int64()),
            ],
            names=["site", "key", "count", "docs"],
        )


def candidates(hashes: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, key, docs): lines that can reach the threshold, none that reaches it missing."""
    if min_share < 2 * SUMMARY_ERROR:
        raise ValueError(f"min_share must be {2 * SUMMARY_ERROR} or more")
    distinct = hashes.select("site", F.array_except(F.array_distinct("keys"), F.array(F.lit(None).cast("bigint"))).alias("keys"))
    merged = (
        distinct.mapInArrow(_summarise, "site string, key long, count long, docs long")
        .groupBy("site", "key")
        .agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    )
    sites = merged.where("key is null").select("site", F.col("count").alias("error"), "docs")
    return (
        merged.where("key is not null")
        .select("site", "key", "count")
        .join(sites, "site")
        .where((F.col("count") + F.col("error") >= min_docs) & ((F.col("count") + F.col("error")) / F.col("docs") >= min_share))
        .select("site", "key", "docs")
    )


def _sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(small) if small.count() <= limit else small


def repeated(hashes: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, key, n_docs, site_docs) of the confirmed lines, counted exactly."""
    wanted = materialize(candidates(hashes, min_docs, min_share), "line-candidates")
    seen = hashes.select("site", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    return (
        seen.join(_sized(wanted), ["site", "key"])
        .groupBy("site", "key")
        .agg(F.count("*").alias("n_docs"), F.first("docs").alias("site_docs"))
        .where((F.col("n_docs") >= min_docs) & (F.col("n_docs") / F.col("site_docs") >= min_share))
    )


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, site, n_docs): every occurrence of a confirmed line.

    ``docs`` has doc_id, text, url, source; other columns are ignored. A row
    given twice counts as two documents. An empty table gives no rows.
    """
    hashes = materialize(line_hashes(docs), "line-hashes")
    confirmed = materialize(repeated(hashes).select("site", "key", "n_docs"), "lines")
    at = hashes.select("doc_id", "site", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    return at.join(_sized(confirmed), ["site", "key"]).select("doc_id", (F.col("pos") + 1).cast("int").alias("line_no"), "site", "n_docs")


def with_site_lines(rows: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """``rows`` (site, keys, ..) with ``name``, those of their site's ``lines`` (site, key) that matter to them; null for none.

    Few lines go to every task as one set per site. More are met by (site, key) hash, and a row gets
    the lines it has itself by the hash of its keys: no site's rows come together, however many.
    """
    if lines.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lines.groupBy("site").agg(F.collect_set("key").alias(name))), "site", "left")
    hashed = rows.withColumn("_row", F.xxhash64("site", "keys"))
    pairs = hashed.select("_row", "site", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    own = pairs.join(lines, ["site", "key"], "left_semi").groupBy("_row").agg(F.collect_set("key").alias(name))
    return hashed.join(own, "_row", "left").drop("_row")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed): every document without its site's repeated lines.

    Null texts stay null. The rest of a text, blank lines included, keeps its order.
    """
    confirmed = materialize(repeated(materialize(line_hashes(docs), "line-hashes")).select("site", "key"), "site-lines")
    lines = F.split("text", "\n", -1)
    base = docs.select("doc_id", "text", site_of(F.col("url"), F.col("source")).alias("site"), F.transform(lines, line_key).alias("keys"))
    bad = F.transform("keys", lambda k: F.coalesce(F.array_contains("bad", k), F.lit(False)))
    kept = F.filter(lines, lambda line, i: ~F.get(bad, i))
    return with_site_lines(base, confirmed, "bad").select(
        "doc_id",
        F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("bad").isNull() | F.col("text").isNull(), 0).otherwise(F.size(F.filter(bad, lambda b: b))).cast("int").alias("n_removed"),
    )
