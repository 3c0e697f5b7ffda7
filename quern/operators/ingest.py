"""From pages to chunks: chunking, identifiers, batches, upserts, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from quern.functions import text as T

#: Characters of a chunk and shared by neighbours, by language.
CHUNK_SIZES = {"en": (3500, 400), "ar": (3000, 350)}
#: Items and estimated tokens of one embedding request.
BATCH_ITEMS, BATCH_TOKENS = 16, 12_000


def chunk_array(text: Column, size: int, overlap: int) -> Column:
    """Array of the overlapping windows of a text, trimmed, blank ones dropped.

    Windows of ``size`` characters start every ``size - overlap``; the first one that reaches the
    end is the last. Null and blank texts give an empty array.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(step))).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: T.strip(F.substring(text, i * step + 1, F.lit(size))))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(windows, lambda w: w != ""))


def chunks(rows: DataFrame, text_col: str = "text", size: int = 3500, overlap: int = 400, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per chunk: the other columns of ``rows``, chunk_index from 0, and the chunk as ``text_col``.

    ``keep`` drops chunks after they are numbered, so numbers may have gaps.
    """
    others = [c for c in rows.columns if c not in (text_col, "chunk_index")]
    out = rows.select(*[F.col(f"`{c}`") for c in others], F.posexplode(chunk_array(F.col(text_col), size, overlap)).alias("chunk_index", text_col))
    return out if keep is None else out.where(keep(F.col(text_col)))


def pdf_chunk_id(pdf: Column, page: Column, index: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), pdf, F.lit("::p"), page.cast("string"), F.lit("::c"), index.cast("string"))


def web_chunk_id(url: Column, index: Column) -> Column:
    return F.concat(F.lit("website::"), F.substring(F.sha1(url), 1, 16), F.lit("::c"), index.cast("string"))


def pdf_chunks(pages: DataFrame, language: str, source_group: str, size: int | None = None, overlap: int | None = None, prefix: str = "", keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of ``pages`` (pdf, title, page, text) with the flat metadata columns of a collection."""
    default = CHUNK_SIZES.get(language, CHUNK_SIZES["en"])
    out = chunks(pages.select("pdf", "title", "page", "text"), size=size or default[0], overlap=default[1] if overlap is None else overlap, keep=keep)
    return out.select(
        pdf_chunk_id(F.col("pdf"), F.col("page"), F.col("chunk_index"), prefix).alias("id"), "text", F.lit("pdf").alias("source_type"), F.lit(None).cast("string").alias("url"),
        "pdf", "title", "page", "chunk_index", F.lit(language).alias("language"), F.lit(source_group).alias("source_group"),
    )


def web_chunks(pages: DataFrame, language: str, source_group: str, size: int = 3500, overlap: int = 400) -> DataFrame:
    """Chunks of ``pages`` (url, title, text); addresses are normalised first, empty ones dropped."""
    known = pages.select(T.normalize_url(F.col("url")).alias("url"), "title", "text").where("url != ''")
    out = chunks(known, size=size, overlap=overlap)
    return out.select(
        web_chunk_id(F.col("url"), F.col("chunk_index")).alias("id"), "text", F.lit("website").alias("source_type"), "url", F.lit(None).cast("string").alias("pdf"),
        "title", F.lit(None).cast("int").alias("page"), "chunk_index", F.lit(language).alias("language"), F.lit(source_group).alias("source_group"),
    )


def dedup_lines(text: Column, least: int = 2) -> Column:
    """Collapsed lines of at least ``least`` characters, each once in its first place."""
    clean = F.transform(T.lines(F.replace(text, F.lit("\x00"), F.lit(" "))), T.collapse)
    return F.array_join(F.array_distinct(F.filter(clean, lambda v: F.length(v) >= least)), "\n")


def greedy_batches(rows: DataFrame, group: str, order: Sequence[str], size_col: str, max_items: int = BATCH_ITEMS, max_size: int = BATCH_TOKENS) -> DataFrame:
    """``rows`` with batch_no from 0 within ``group``: filled in order, closed by items or by size.

    An item above ``max_size`` is a batch of its own. Greedy filling is sequential by nature; the
    group is the unit of parallelism, so give it a hash or range of the keys where order over the
    whole input is not needed. State is two numbers; the rows stream through.
    """
    others = [c for c in rows.columns if c != "batch_no"]
    schema = rows.select(*others).schema.add("batch_no", "long")
    at_group, at_size = others.index(group), others.index(size_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, items, total, no = object(), 0, 0, 0
        for batch in batches:
            out = []
            for g, size in zip(batch.column(at_group).to_pylist(), batch.column(at_size).to_pylist()):
                size = size or 0
                if g != current:
                    current, items, total, no = g, 0, 0, 0
                elif items >= max_items or total + size > max_size:
                    items, total, no = 0, 0, no + 1
                items, total = items + 1, total + size
                out.append(no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*others, "batch_no"])

    return rows.select(*others).repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, text_col: str = "text", max_items: int = BATCH_ITEMS) -> DataFrame:
    """``rows`` with embedding and model; ``embedder`` maps texts to vectors, ``max_items`` at a time."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("model", StringType())])
    names = list(rows.columns)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, max_items):
                part = batch.slice(start, max_items)
                vectors = embedder([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([model] * part.num_rows)], names=[*names, "embedding", "model"])

    return rows.mapInArrow(run, schema)


def retry_seconds(message: Column, attempt: Column, jitter: Column) -> Column:
    """Seconds to wait: what the message asks for and one more, else growing with the attempt, at most 60."""
    asked = F.try_element_at(F.regexp_extract_all(F.lower(F.coalesce(message, F.lit(""))), F.lit(r"try again in ([0-9]+(?:\.[0-9]+)?)s"), 1), F.lit(-1))
    return F.coalesce(asked.cast("double") + 1, F.least(F.lit(60.0), 5 + 3 * attempt + jitter))


def with_retries(call: Callable[[list[str]], list[list[float]]], limited: Callable[[Exception], bool], wait: Callable[[int, str], float], attempts: int = 10) -> Callable[[list[str]], list[list[float]]]:
    """``call`` repeated while it fails for its rate limit only; runs inside ``embed``'s tasks."""

    def run(texts: list[str]) -> list[list[float]]:
        import time

        for attempt in range(attempts):
            try:
                return call(texts)
            except Exception as e:
                if not limited(e) or attempt + 1 == attempts:
                    raise
                time.sleep(wait(attempt, str(e)))
        raise RuntimeError("no attempts left")

    return run


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of, or beside, those of equal key.

    Of rows of ``new`` with one key the last by ``order`` stands, then by all its columns, so the result
    does not depend on partitioning. Null keys never match, and are one row.
    """
    cols = existing.columns
    row = F.struct(*[F.col(f"`{c}`") for c in [*order, *[c for c in cols if c not in order]]])
    once = new.select(*cols).groupBy(F.col(key).alias("_key")).agg(F.max(row).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in cols])
    return existing.join(once.select(key), key, "left_anti").select(*cols).unionByName(once)


def without_stale(existing: DataFrame, new: DataFrame, scope: str = "url", key: str = "id") -> DataFrame:
    """``existing`` without rows of a touched ``scope`` whose key is not among the new ones. Null scopes are never touched."""
    touched = new.select(F.col(scope).alias("_scope")).where(F.col("_scope").isNotNull()).distinct()
    kept = new.select(F.col(key).alias("_key")).distinct()
    stale = existing.join(touched, F.col(scope) == F.col("_scope"), "left_semi").select(key).join(kept, F.col(key) == F.col("_key"), "left_anti").distinct()
    return existing.join(stale, key, "left_anti").select(*existing.columns)


def union_sources(*parts: DataFrame) -> DataFrame:
    """All parts by column name; columns a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def must_ingest(count: int, least: int, enabled: bool) -> bool:
    """Whether a collection of ``count`` rows is to be filled."""
    return enabled and count < max(0, least)


def int_setting(value: str | None, default: int, floor: int = 0) -> int:
    try:
        return max(floor, int((value or "").strip()))
    except ValueError:
        return max(floor, default)


def attempt_sources(sources: dict[str, Callable[[], DataFrame]], required: set[str] = frozenset(), stage: Callable[[DataFrame], DataFrame] | None = None) -> tuple[list[DataFrame], dict[str, str]]:
    """Results of the sources that could be read, and the others' errors; a required source's error is raised.

    ``stage`` writes a source's rows and reads them back (as ``Collection.stage`` does): only then do
    errors that a source has while it is read come up here, one source by itself.
    """
    done, errors = [], {}
    for name, build in sources.items():
        try:
            rows = build()
            done.append(rows if stage is None else stage(rows))
        except Exception as e:
            if name in required:
                raise
            errors[name] = f"{type(e).__name__}: {e}"
    return done, errors


def ingest_stats(chunk_rows: DataFrame) -> DataFrame:
    """One row: n_files, n_pages, n_chunks, n_chars, n_arabic_chunks of a collection's chunks."""
    return chunk_rows.agg(
        F.countDistinct("pdf").alias("n_files"),
        F.countDistinct(F.when(F.col("pdf").isNotNull(), F.struct("pdf", "page"))).alias("n_pages"),
        F.count("*").alias("n_chunks"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"),
        F.count_if(T.has_arabic(F.col("text"))).alias("n_arabic_chunks"),
    )
