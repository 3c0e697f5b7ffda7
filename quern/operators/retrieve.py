"""Finding the chunks that answer a question: vectors, words, their merge, and what is sent on."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.functions import text as T
from quern.operators.match import in_blocks
from quern.operators.ranking import first_wins, ordered_union, positioned, top_per_group

#: Queries of one request that are run, and most results of one.
MOST_QUERIES, MOST_RESULTS = 8, 16
MOST_SOURCES = 6


def distinct_queries(queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """(ordinal, query): collapsed queries, each once whatever its case, the first ``most`` by ordinal."""
    clean = queries.select("ordinal", T.collapse(F.col("query")).alias("query")).where("query != ''")
    return first_wins(clean, [F.lower("query")], ["ordinal", "query"]).orderBy("ordinal", "query").limit(most)


#: Queries that one pass compares with all rows, as one matrix in every task.
MATRIX_QUERIES = 4096
#: Rows whose distances to all queries of a pass are held at a time.
MATRIX_ROWS = 1024


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """(q_id, id_col, distance, rank): the k nearest rows of every query by squared Euclidean distance.

    Exact: queries (q_id, q_vector) are a stated set; they go to every task in matrices of
    ``MATRIX_QUERIES``, one pass over the rows for each. Products of blocks find what may be near, whose
    distances are then computed exactly, and each task passes on what its blocks leave. Ties go to
    the smaller id. Rows without a vector, or of another length, are never near.
    """
    rows = (vectors if where is None else vectors.where(where)).select(id_col, vector_col)
    n = -(-queries.count() // MATRIX_QUERIES)
    out = None
    for i in range(max(1, n)):
        part = queries if n <= 1 else queries.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == i)
        found = _knn_pass(rows, part, k, id_col, vector_col)
        out = found if out is None else out.unionByName(found)
    return out


def _knn_pass(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    asked = [r for r in queries.select("q_id", "q_vector").collect() if r.q_vector]
    schema = StructType([queries.schema["q_id"], rows.schema[id_col], StructField("distance", DoubleType())])
    q_type = to_arrow_type(queries.schema["q_id"].dataType)
    by_length: dict[int, list] = {}
    for r in asked:
        by_length.setdefault(len(r.q_vector), []).append(r)
    matrices = {n: (pa.array([r.q_id for r in qs], q_type), np.array([r.q_vector for r in qs], np.float64)) for n, qs in by_length.items()}
    shared = rows.sparkSession.sparkContext.broadcast(matrices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for n, (q_ids, q) in shared.value.items():
                fit = batch.filter(pa.array(sizes == n))
                for a in range(0, fit.num_rows, MATRIX_ROWS):
                    part = fit.slice(a, MATRIX_ROWS)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                    about = (x * x).sum(axis=1)[None, :] - 2 * q @ x.T + (q * q).sum(axis=1)[:, None]
                    about[np.isnan(about)] = np.inf
                    last = np.partition(about, k - 1, axis=1)[:, k - 1 : k] if about.shape[1] > k else np.full((len(q), 1), np.inf)
                    # products round: what is as near as that leaves open is compared exactly
                    i, j = np.nonzero((about <= last * (1 + 1e-9) + 1e-9) & np.isfinite(about))
                    d = ((x[j] - q[i]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), part.column(0).take(pa.array(j)), pa.array(d)], names=["q_id", id_col, "distance"])

    return top_per_group(rows.mapInArrow(run, schema), ["q_id"], ["distance", id_col], k)


def fuse_each(hits: DataFrame, request: str, key: Sequence[Column | str], k: int, boost: Column | None = None) -> DataFrame:
    """``fuse`` of every ``request`` (a column) by itself: hits (request, ordinal, rank, ..) with position from 0."""
    once = first_wins(hits, [request, *key], ["ordinal", "rank"])
    first = F.lit(0) if boost is None else F.when(F.coalesce(boost, F.lit(False)), 0).otherwise(1)
    ranked = top_per_group(once.withColumn("_b", first), [request], ["_b", "ordinal", "rank"], k, "position")
    return ranked.withColumn("position", F.col("position") - 1).drop("_b")


def fuse(hits: DataFrame, key: Sequence[Column | str], k: int, boost: Column | None = None) -> DataFrame:
    """Hits (ordinal, rank, ..) of several queries as one list: by query then rank, each key once, boosted ones first, the first k."""
    once = first_wins(hits, key, ["ordinal", "rank"])
    first = F.lit(0) if boost is None else F.when(F.coalesce(boost, F.lit(False)), 0).otherwise(1)
    return positioned(once.withColumn("_b", first).orderBy("_b", "ordinal", "rank").limit(k), ["_b", "ordinal", "rank"]).drop("_b")


def chunk_key(chars: int = 120) -> list[Column]:
    """What makes two hits the same chunk; null-safe."""
    return [F.coalesce("source_type", F.lit("pdf")), F.col("pdf"), F.col("page"), F.col("url"), F.col("chunk_index"), F.substring("text", 1, chars)]


def mode_filter(mode: str, titles: dict[str, str]) -> Column | None:
    """Equality on the title for modes that have one collection's title; none for the others."""
    return F.col("title") == titles[mode] if mode in titles else None


def expand_queries(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """(q_id, ordinal, query): every question and the expansions of the rules whose pattern it matches.

    ``rules`` has rule_no, pattern (on the lower-cased question), expansion; a small table.
    """
    base = questions.select("q_id", F.lit(-1).alias("ordinal"), F.col("question").alias("query"))
    more = in_blocks(rules, "expansion", lambda r: questions.join(r, F.expr("lower(question) rlike pattern"))).select("q_id", F.col("rule_no").alias("ordinal"), F.col("expansion").alias("query"))
    return base.unionByName(more)


def _filler(template: str) -> Callable[[Column], Column]:
    return lambda name: F.replace(F.lit(template), F.lit("{entity}"), name)


def entity_queries(questions: DataFrame, templates: Sequence[tuple[str, Sequence[str]]], every: Sequence[str], variants: Callable[[Column], Column]) -> DataFrame:
    """(q_id, ordinal, query): ways to ask for the entity of each question (q_id, question, entity), in order; none without an entity.

    ``templates`` are (pattern on the lower-cased question, texts with {entity}); ``every`` are texts with
    {entity} that all ``variants`` (an array of names) are put into, and the variants follow by themselves.
    """

    e, none = F.col("entity"), F.array().cast("array<string>")
    parts = [F.when(F.lower("question").rlike(p), F.array(*[_filler(t)(e) for t in texts])).otherwise(none) for p, texts in templates]
    names = variants(e)
    parts += [F.transform(names, _filler(t)) for t in every]
    known = questions.where("entity is not null and entity != ''")
    return known.select("q_id", F.posexplode(F.concat(*parts, names)).alias("ordinal", "query"))


def lexical_terms(question: Column, stopwords: Iterable[str], least: int = 3, composed: bool = False, rules: Sequence[tuple[str, Sequence[str]]] = (), names: Column | None = None) -> Column:
    """Distinct searchable words of a question in the normal form of Arabic text, then those of the rules
    (pattern on the normal form, words) that it matches, then the words of ``names`` found in the index."""
    stop = list(stopwords)

    def searchable(words: Column) -> Column:
        return F.filter(words, lambda w: w.rlike(T.ARABIC) & (F.length(w) >= least) & ~w.isin(*stop))

    key = T.arabic_search(question, composed)
    none = F.array().cast("array<string>")
    parts = [F.split(key, " ")]
    parts += [F.when(key.rlike(p), F.array(*[T.arabic_search(F.lit(w), True) for w in words])).otherwise(none) for p, words in rules]
    if names is not None:
        parts.append(F.flatten(F.transform(F.coalesce(names, none), lambda n: F.split(T.arabic_search(n, True), " "))))
    return F.array_distinct(searchable(F.concat(*parts)))


def lexical_phrases(question: Column, removable: Iterable[str], prefix: str, names: Column | None = None, composed: bool = False) -> Column:
    """Distinct phrases of a question: all of it, it without titles, and names found in the index."""
    whole = F.array(T.arabic_search(question, composed), F.array_join(T.name_tokens(question, removable, prefix, composed), " "))
    every = whole if names is None else F.concat(whole, F.transform(names, lambda n: T.arabic_search(n, True)))
    return F.array_distinct(F.filter(every, lambda p: F.length(p) >= 3))


def lexical_score(haystack: Column, terms: Sequence[str], phrases: Sequence[str]) -> Column:
    """10 a term and 120 a phrase contained, 25 for the first two terms, 40 for them side by side; null if nothing is."""

    def score(h: Column) -> Column:
        hits = sum((h.contains(t).cast("int") for t in terms), F.lit(0))
        full = sum((h.contains(p).cast("int") for p in phrases), F.lit(0))
        total = hits * 10 + full * 120
        if len(terms) >= 2:
            total = total + F.when(h.contains(terms[0]) & h.contains(terms[1]), 25).otherwise(0)
        if terms:
            total = total + F.when(h.contains(" ".join(terms[:2])), 40).otherwise(0)
        return F.when((hits > 0) | (full > 0), total)

    return T.let(haystack, score)


def lexical_search(rows: DataFrame, haystack: Column, terms: Sequence[str], phrases: Sequence[str], key: Sequence[Column | str], order: Sequence[str], k: int) -> DataFrame:
    """The k best rows by ``lexical_score``, then page, then ``order``; each key once; with score and position."""
    if not terms:
        return rows.limit(0).withColumn("score", F.lit(0)).withColumn("position", F.lit(0))
    scored = rows.withColumn("score", lexical_score(haystack, terms, phrases)).where("score is not null")
    sort = [F.desc("score"), F.coalesce("page", F.lit(0)), *order]
    once = first_wins(scored.withColumn("_s", -F.col("score")), key, ["_s", F.coalesce("page", F.lit(0)), *order]).drop("_s")
    return positioned(once.orderBy(*sort).limit(max(1, min(k, MOST_RESULTS))), sort)


def hybrid_each(lexical: DataFrame, vector: DataFrame, request: str, key: Sequence[str], k: int) -> DataFrame:
    """``hybrid`` of every ``request`` by itself: both lists have request and position."""
    both = lexical.withColumn("_part", F.lit(0)).unionByName(vector.withColumn("_part", F.lit(1)))
    once = first_wins(both, [request, *key], ["_part", "position"]).withColumnRenamed("position", "_p")
    return top_per_group(once, [request], ["_part", "_p"], k, "position").withColumn("position", F.col("position") - 1).drop("_part", "_p")


def hybrid(lexical: DataFrame, vector: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """Both result lists (with position) as one: lexical hits first, each key once, the first k."""
    a, b = (x.withColumnRenamed("position", "_p") for x in (lexical, vector))
    return ordered_union([a, b], key, ["_p"], k).drop("_p")


def relevance_terms(question: Column, entity: Column, stopwords: Sequence[str], rules: Sequence[tuple[str, Sequence[str], Sequence[str]]] = ()) -> tuple[Column, Column]:
    """(phrases, keywords) that bear on a question: its keywords; a named entity as a phrase and with its words; those of
    the rules (pattern on the lower-cased question, phrases, keywords) it matches. All as ASCII keys, each once."""
    none, low = F.array().cast("array<string>"), F.lower(F.coalesce(question, F.lit("")))

    def listed(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]) if values else none

    named = F.coalesce(entity, F.lit(""))
    phrases = [F.when(named != "", F.array(named)).otherwise(none)]
    keywords = [T.keywords(F.coalesce(question, F.lit("")), stopwords), T.keywords(named, stopwords)]
    for pattern, more, words in rules:
        phrases.append(F.when(low.rlike(pattern), listed(more)).otherwise(none))
        keywords.append(F.when(low.rlike(pattern), listed(words)).otherwise(none))

    def clean(parts: list[Column]) -> Column:
        return F.array_distinct(F.filter(F.transform(F.concat(*parts), T.ascii_key), lambda v: v != ""))

    return clean(phrases), clean(keywords)


def relevant(text: Column, phrases: Column, keywords: Column, required: Column | None = None, topics: Sequence[tuple[Column, Callable[[Column], Column]]] = ()) -> Column:
    """Whether a chunk's ASCII key bears on a question: any phrase, or enough keywords (two; one if there is one; none needed if there are none).

    ``topics`` are (question is of the topic, condition on the text): the first that applies decides in the keywords' place.
    """
    need = F.when(F.size(keywords) == 0, 0).when(F.size(keywords) == 1, 1).otherwise(2) if required is None else required

    def bears(t: Column) -> Column:
        enough = keyword_hits(t, keywords) >= need
        for applies, fits in reversed(list(topics)):
            enough = F.when(applies, fits(t)).otherwise(enough)
        return (t != "") & (F.exists(phrases, lambda p: (p != "") & t.contains(p)) | enough)

    return F.coalesce(T.let(text, bears), F.lit(False))


def keyword_hits(text: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda w: text.contains(w)))


def relevance_split(candidates: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted candidates, and one row (accepted, rejected)."""
    marked = candidates.withColumn("_ok", F.coalesce(flag, F.lit(False)))
    counts = marked.agg(F.count_if("_ok").alias("accepted"), F.count_if(~F.col("_ok")).alias("rejected"))
    return marked.where("_ok").drop("_ok"), counts


def broad_list(question: Column, nouns: Iterable[str]) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    asks = q.rlike(r"(?:^|[^\p{L}\p{N}_])(?:list|show|name|what are|which are|give me)(?:[^\p{L}\p{N}_]|$)")
    return asks & q.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(nouns)})(?:[^\p{{L}}\p{{N}}_]|$)")


def definition(question: Column) -> Column:
    return F.coalesce(question.rlike(r"(?i)^\s*(?:who|what)\s+(?:is|are|were|was)(?:[^\p{L}\p{N}_]|$)"), F.lit(False))


def retrieval_k(asked: int, is_broad: bool = False, is_definition: bool = False, arabic: bool = False) -> tuple[int, int]:
    """(results asked for, results to retrieve)."""
    k = max(1, min(asked, 12))
    wanted = 10 if arabic or (is_definition and not is_broad) else 12 if is_broad else k
    return k, min(MOST_RESULTS, max(k, wanted))


def retrieval_sizes(asked: Column, broad: Column, defines: Column, arabic: Column) -> Column:
    """``retrieval_k`` of every row: struct(k, retrieve_k)."""
    k = F.greatest(F.lit(1), F.least(asked.cast("int"), F.lit(12)))
    wanted = F.when(arabic, 10).when(broad, 12).when(defines, 10).otherwise(k)
    return F.struct(k.alias("k"), F.least(F.lit(MOST_RESULTS), F.greatest(k, wanted)).alias("retrieve_k"))


def source_of() -> Column:
    """The source a chunk is cited by: its page of a file, or its address and title."""
    web = F.col("source_type") == "website"

    def text(c: str) -> Column:
        return F.nullif(T.strip(F.col(c)), F.lit(""))

    return F.struct(
        F.when(web, "website").otherwise("pdf").alias("source_type"),
        F.when(~web | web.isNull(), F.coalesce("pdf", F.lit("unknown.pdf"))).alias("pdf"),
        F.when(~web | web.isNull(), F.coalesce(F.col("page"), F.lit(0))).alias("page"),
        F.when(web, text("url")).alias("url"),
        F.when(web, text("title")).alias("title"),
    )


def distinct_sources(ranked: DataFrame, most: int = MOST_SOURCES, group: Sequence[str] = ()) -> DataFrame:
    """(group, source_type, pdf, page, url, title, position): sources of ranked chunks (rank), each once, the first ``most`` of each group."""
    s = ranked.select(*group, "rank", source_of().alias("s")).select(*group, "rank", "s.*")
    once = first_wins(s, [*group, "source_type", "pdf", "page", "url", "title"], ["rank"])
    if group:
        return top_per_group(once, group, ["rank"], most, "position").withColumn("position", F.col("position") - 1).drop("rank")
    return positioned(once.orderBy("rank").limit(most), ["rank"]).drop("rank")


def context_label() -> Column:
    title, url = (T.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "url"))
    web = F.when((title != "") & (url != ""), F.concat(title, F.lit(" ("), url, F.lit(")"))).when(title != "", title).when(url != "", url).otherwise("website source")
    pdf = F.concat(F.coalesce("pdf", F.lit("unknown.pdf")), F.lit(" p."), F.coalesce(F.col("page"), F.lit(0)).cast("string"))
    return F.when(F.col("source_type") == "website", web).otherwise(pdf)


def context(ranked: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One text per ``group`` of ranked chunks, in order, each under its source's label."""
    block = F.concat(F.lit("[Source: "), context_label(), F.lit("]\n"), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("b")))), lambda s: s["b"])
    return ranked.groupBy(*group).agg(F.array_join(ordered, "\n\n").alias("context"))


def grounding(answer: Column, n_chunks: Column, none: Iterable[str], hedges: Iterable[str]) -> Column:
    """no-source without chunks or with a phrase of ``none``, partial with one of ``hedges``, else full."""
    low = F.lower(F.coalesce(answer, F.lit("")))

    def any_of(phrases: Iterable[str]) -> Column:
        out = F.lit(False)
        for p in phrases:
            out |= low.contains(p)
        return out

    return F.when((n_chunks == 0) | any_of(none), "no-source").when(any_of(hedges), "partial").otherwise("full")


def retrieval_log(ranked: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per ``group`` of ranked chunks (rank, accepted): n_chunks, accepted, rejected, top (labels of the first three), previews (180 characters of each)."""
    preview = F.substring(T.collapse(F.coalesce("text", F.lit(""))), 1, 180)
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", context_label().alias("label"), preview.alias("preview")))))
    ok = F.coalesce("accepted", F.lit(False))
    logs = ranked.groupBy(*group).agg(F.count("*").alias("n_chunks"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), first.alias("_f"))
    return logs.withColumns({"top": F.transform("_f", lambda s: s["label"]), "previews": F.transform("_f", lambda s: s["preview"])}).drop("_f")
