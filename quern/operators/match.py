"""Searching an index of entity names: tiers of fuzziness, aliases, suggestions, pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.ranking import first_wins, page

#: Most results of any name search, and of a list of suggestions.
MOST = 400
MOST_SUGGESTIONS = 12
#: Rows up to which a side without an equality to join by is sent to every task; more are sent in blocks of so many.
BLOCK = 10_000


def name_keys(records: DataFrame, aliases: Column, key, titles: Iterable[str] = ()) -> DataFrame:
    """(id, name, name_key, is_own): the keys of every alias with their rotations; is_own marks keys of the name itself.

    Computed once and kept beside the index; every search reads it.
    """
    own = T.rotations(key(F.col("name")), titles)
    every = F.array_distinct(F.flatten(F.transform(aliases, lambda a: T.rotations(key(a), titles))))
    out = records.select("id", "name", own.alias("own"), F.explode(every).alias("name_key")).where("name_key != ''")
    return out.select("id", "name", "name_key", F.array_contains("own", F.col("name_key")).alias("is_own"))


def tier(query_key: Column, name_key: Column, is_own: Column) -> Column:
    """0 the name itself, 1 another name of it, 2 beginning, 3 part, 4 all words in any order; null for no match."""
    q, n = F.split(query_key, " "), F.split(name_key, " ")
    return (
        F.when(query_key == name_key, F.when(is_own, 0).otherwise(1))
        .when(name_key.startswith(query_key), 2)
        .when(name_key.contains(query_key), 3)
        .when(F.size(F.array_except(q, n)) == 0, 4)
    )


def in_blocks(side: DataFrame, key: str, join: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """Union of ``join`` over blocks of ``side`` that are broadcast: a stated set of any size against all rows.

    Every block has about ``block`` rows, chosen by a hash of ``key``.
    """
    n = -(-side.count() // block)
    if n <= 1:
        return join(F.broadcast(side))
    out = None
    for i in range(n):
        part = join(F.broadcast(side.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)))
        out = part if out is None else out.unionByName(part)
    return out


def tiered(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, name, score): best tier of every record that matches, for each query.

    ``queries`` has query, query_key: search terms, sent in blocks to the tasks that hold ``keys``.
    Records are scored where they lie and reduced by id.
    """
    score = tier(F.col("query_key"), F.col("name_key"), F.col("is_own"))
    pairs = in_blocks(queries.where("query_key != ''"), "query_key", lambda q: keys.join(q, score.isNotNull()))
    return pairs.groupBy("query", "id", "name").agg(F.min(score).alias("score"))


def cut_tiers(scored: DataFrame, ambiguous: Column | None = None) -> DataFrame:
    """Only the exact tiers if a query has an exact match (unless it is ``ambiguous``), only 0 to 2 if its best is 2, else all."""
    best = F.min("score").over(Window.partitionBy("query"))
    loose = F.lit(False) if ambiguous is None else ambiguous
    most = F.when((best <= 1) & ~loose, 1).when((best <= 1) & loose, 4).when(best == 2, 2).otherwise(4)
    return scored.withColumn("_most", most).where("score <= _most").drop("_most")


def best_matches(scored: DataFrame, limit: int = 12, most: int = MOST) -> DataFrame:
    """The first matches of each query by score, length of the name and name; with rank from 1."""
    w = Window.partitionBy("query").orderBy("score", F.length("name"), F.lower("name"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, min(limit, most)))


def alias_hit(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query, canonical, alias): the longest alias equal to a query's key or contained in it.

    ``aliases`` has canonical, alias, alias_key: a hand-kept table. Ties go to the smaller alias.
    """
    known = aliases.where("alias_key != ''")
    pairs = in_blocks(queries, "query_key", lambda q: known.join(q, F.col("query_key").contains(F.col("alias_key"))))
    best = F.max_by(F.struct("canonical", "alias"), F.struct(F.length("alias_key"), F.col("alias_key")))
    return pairs.groupBy("query").agg(best.alias("b")).select("query", "b.canonical", "b.alias")


def records_of(hits: DataFrame, alias_keys: DataFrame, keys: DataFrame) -> DataFrame:
    """(query, id, name): index records sharing any key with the canonical record a query hit.

    ``alias_keys`` has canonical, alias_key for all names of the canonical records.
    """
    wanted = hits.join(alias_keys, "canonical").select("query", F.col("alias_key").alias("name_key")).where("name_key != ''").distinct()
    return keys.join(wanted, "name_key").select("query", "id", "name").distinct()


def search(keys: DataFrame, queries: DataFrame, manual: DataFrame | None = None, ambiguous: Column | None = None, limit: int = 12) -> DataFrame:
    """(query, id, name, score, rank): manual matches where a query has any (score -1), else tiered ones."""
    found = cut_tiers(tiered(keys, queries), ambiguous)
    if manual is not None:
        forced = manual.select("query", "id", "name", F.lit(-1).alias("score"))
        found = forced.unionByName(found.join(manual.select("query").distinct(), "query", "left_anti"))
    return best_matches(found, limit)


def descriptor_rank(query_key: Column, name_key: Column, rules: Sequence[tuple[str, str, int]]) -> Column:
    """Rank of a name for a query by rules (part of the query's key, descriptor, rank); the lowest applies, else 9."""
    ranks = [F.when(query_key.contains(q) & name_key.contains(d), F.lit(r)) for q, d, r in rules]
    return F.coalesce(F.least(*ranks, F.lit(9)), F.lit(9)) if len(ranks) > 0 else F.lit(9)


def tiered_arabic(names: DataFrame, queries: DataFrame, rules: Sequence[tuple[str, str, int]] = (), limit: int = 12) -> DataFrame:
    """(query, name, score, descriptor, rank): names (name, name_key) by 0 equal, 1 beginning, 2 part, 3 all words; then descriptor, length, name.

    ``queries`` may have several keys per query: the key, the key without titles, and more.
    """
    q, n = F.col("query_key"), F.col("name_key")
    t = F.when(n == q, 0).when(n.startswith(q), 1).when(n.contains(q), 2).when(F.size(F.array_except(F.split(q, " "), F.split(n, " "))) == 0, 3)
    pairs = in_blocks(queries.where("query_key != ''"), "query_key", lambda side: names.join(side, t.isNotNull())).withColumn("both", F.struct(t.alias("score"), descriptor_rank(q, n, rules).alias("descriptor")))
    best = pairs.groupBy("query", "name").agg(F.min("both").alias("b")).select("query", "name", "b.score", "b.descriptor")
    w = Window.partitionBy("query").orderBy("score", "descriptor", F.length("name"), "name")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, min(limit, MOST)))


def arabic_query_keys(queries: DataFrame, removable: Iterable[str], prefix: str, composed: bool = False) -> DataFrame:
    """(query, query_key): the key of each query, and its key without titles."""
    c = F.col("query")
    bare = T.arabic_key(F.array_join(T.name_tokens(c, removable, prefix, composed), " "), True)
    both = F.array_distinct(F.array(T.arabic_key(c, composed), bare))
    return queries.select("query", F.explode(both).alias("query_key")).where("query_key != ''")


def search_arabic(names: DataFrame, query_keys: DataFrame, manual: DataFrame | None = None, rules: Sequence[tuple[str, str, int]] = (), limit: int = 12) -> DataFrame:
    """(query, name, score, rank): a query's manual matches (query, name, ordinal) in their order with score -1, then tiered ones."""
    found = tiered_arabic(names, query_keys, rules, MOST).select("query", "name", "score", F.col("rank").alias("_at"))
    if manual is not None:
        forced = manual.groupBy("query", "name").agg(F.min("ordinal").cast("int").alias("_at")).select("query", "name", F.lit(-1).alias("score"), "_at")
        found = forced.unionByName(found.join(forced.select("query", "name"), ["query", "name"], "left_anti"))
    w = Window.partitionBy("query").orderBy(F.col("score") >= 0, "_at", "name")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, min(limit, MOST))).drop("_at")


def suggestions(found: DataFrame, limit: int = 8, most: int = MOST_SUGGESTIONS, least: int = 2) -> DataFrame:
    """The first ``limit`` (1 to ``most``) ranked matches of queries of at least ``least`` characters; shorter ones get none."""
    return found.where((F.length(T.strip(F.col("query"))) >= least) & (F.col("rank") <= max(1, min(limit, most))))


def contained_aliases(records: DataFrame, queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name, ordinal): index names of records one of whose alias keys contains a query or is contained in it.

    ``records`` has ordinal, name_key, alias_key; ``names`` (name, name_key) is the index.
    """
    q, a = F.col("query_key"), F.col("alias_key")
    hits = in_blocks(queries.where("query_key != ''"), "query_key", lambda side: records.where("alias_key != ''").join(side, a.contains(q) | q.contains(a))).select("query", "ordinal", "name_key")
    found = hits.join(names, "name_key").select("query", "name", "ordinal")
    return first_wins(found, ["query", "name"], ["ordinal"])


def listing(records: DataFrame, order: Sequence[Column | str], limit: int = MOST, offset: int = 0, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """One page of the records, and one row with their total (before the page is cut)."""
    return page(records, order, limit, offset, most), records.agg(F.count("*").alias("total"))


def searched_listing(matches: DataFrame, limit: int = MOST, offset: int = 0) -> DataFrame:
    """(query, name, rank, total): one page of each query's ranked matches; total counts them before the page is cut, at most 400."""
    found = matches.where(F.col("rank") <= MOST)
    first = max(0, offset)
    totals = found.groupBy("query").agg(F.count("*").alias("total"))
    return found.where((F.col("rank") > first) & (F.col("rank") <= first + max(1, min(limit, MOST)))).join(totals, "query").select("query", "name", "rank", "total")


def sourced_options(options: DataFrame, names: DataFrame) -> DataFrame:
    """Options (option) that are names of the index, whatever their case."""
    return options.join(names.select(F.lower("name").alias("_n")).distinct(), F.lower("option") == F.col("_n"), "left_semi")


def query_variants(name: Column, prefix: str, spellings: Sequence[tuple[str, str]] = (), suffixes: Sequence[str] = (), topical: Sequence[tuple[str, Sequence[str]]] = ()) -> Column:
    """Array of ways to ask for a name, distinct whatever their case: itself, without and with its title, in other
    spellings, with suffixes where it ends in a numeral, and topical ones by part of the name."""
    full = T.collapse(name)
    base = F.regexp_replace(full, r"(?i)^(?:st\.?|saint)\s+", "")
    out = [full, base, F.concat(F.lit(prefix + " "), base)]
    for old, new in spellings:
        other = F.when(F.lower(base).contains(old.lower()), F.regexp_replace(base, f"(?i)(?<![\\p{{L}}\\p{{N}}_]){old}(?![\\p{{L}}\\p{{N}}_])", new))
        out += [other, F.concat(F.lit(prefix + " "), other)]
    numeral = base.rlike(r"(?:^|[^\p{L}\p{N}_])[IVX]+(?:[^\p{L}\p{N}_]|$)")
    out += [F.when(numeral, F.concat(base, F.lit(" " + s))) for s in suffixes]
    for part, more in topical:
        out += [F.when(F.lower(base).contains(part), F.lit(m)) for m in more]
    every = F.filter(F.array_compact(F.array(*out)), lambda v: v != "")
    return F.filter(every, lambda v, i: F.array_position(F.transform(every, F.lower), F.lower(v)) == i + 1)


def ambiguous_name(question: Column, titles: Sequence[str], openers: Sequence[str] = ("who is", "tell me about", "about"), most_words: int = 2) -> Column:
    """The titled name a question asks for if it is short enough to mean several; else empty."""
    q = F.regexp_replace(T.strip(F.coalesce(question, F.lit(""))), r"\?+$", "")
    title = "|".join(t.replace(".", r"\.?") for t in titles)
    asked = T.collapse(F.regexp_extract(q, rf"(?is)^(?:(?:{'|'.join(openers)})\s+)?((?:{title})\s+.+)$", 1))
    name = F.regexp_replace(asked, rf"(?i)^(?:{title})\s+", "")
    return F.when((asked != "") & (F.size(T.words(name)) <= most_words), asked).otherwise(F.lit(""))


def intent(question: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(mode, subject) of the first rule (pattern with one group, mode) a question matches; null for none."""
    q = T.collapse(F.regexp_replace(T.strip(F.coalesce(question, F.lit(""))), r"[?.!]+$", ""))
    out = F.lit(None).cast("struct<mode:string,subject:string>")
    for pattern, mode in reversed(list(rules)):
        out = F.when(q.rlike(pattern), F.struct(F.lit(mode).alias("mode"), F.regexp_extract(q, pattern, 1).alias("subject"))).otherwise(out)
    return out


def confirmed_intents(questions: DataFrame, keys: DataFrame, titles: Iterable[str], key: Callable[[Column], Column]) -> DataFrame:
    """``questions`` (mode, subject, ..) whose subject holds a title or is found in the index ``keys``; others get neither mode nor subject."""
    marked = F.col("subject").rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(t.replace('.', '[.]?') for t in titles)})(?![\p{{L}}\p{{N}}_])")
    unmarked = questions.where(F.col("subject").isNotNull() & ~marked).select("subject").distinct()
    found = tiered(keys, unmarked.select(F.col("subject").alias("query"), key(F.col("subject")).alias("query_key"))).select(F.col("query").alias("_s"), F.lit(True).alias("_hit")).distinct()
    out = questions.join(found, F.col("subject") == F.col("_s"), "left")
    good = F.coalesce(marked, F.lit(False)) | F.coalesce(F.col("_hit"), F.lit(False))
    return out.withColumns({c: F.when(good, F.col(c)) for c in ("mode", "subject")}).drop("_s", "_hit")


def option_payload(matches: DataFrame, message: str, limit: int = 12) -> DataFrame:
    """(query, answer, options, total): a templated message (%s stands for the query) and the first matches in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"])
    return matches.groupBy("query").agg(F.count("*").alias("total"), F.slice(ordered, 1, limit).alias("options")).select("query", F.format_string(message, "query").alias("answer"), "options", "total")


def index_report(records: DataFrame, chunks: DataFrame, pdf_prefix: str, sample_size: int = 20) -> DataFrame:
    """One row: n_records, sample (first names), n_chunks, n_prefixed chunks, files (pdf, n) of the prefix in order, fields that are filled."""
    names = records.orderBy(F.lower("name"), "name").limit(sample_size).agg(F.array_sort(F.collect_list("name")).alias("sample"))
    totals = records.agg(F.count("*").alias("n_records"))
    prefixed = F.coalesce(F.col("pdf").startswith(pdf_prefix), F.lit(False))
    fields = F.array_compact(F.array(*[F.when(F.max(F.col(c).isNotNull()), F.lit(c)) for c in sorted(chunks.columns)]))
    sizes = chunks.agg(F.count("*").alias("n_chunks"), F.count_if(prefixed).alias("n_prefixed"), fields.alias("fields"))
    files = chunks.where(prefixed).groupBy("pdf").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("pdf", "n"))).alias("files"))
    return totals.crossJoin(names).crossJoin(sizes).crossJoin(files)


def match_report(records: DataFrame, weak: DataFrame) -> DataFrame:
    """(name, is_real_record, position): an index's ranked matches (name, rank) of a query, then names only mentioned (name, rank)."""
    both = records.select("name", F.lit(True).alias("is_real_record"), "rank").unionByName(weak.select("name", F.lit(False).alias("is_real_record"), "rank"))
    return both.withColumn("position", F.row_number().over(Window.orderBy(F.desc("is_real_record"), "rank", "name")) - 1).drop("rank")


def sources_report(parts: Mapping[str, DataFrame], union: DataFrame, chunks: DataFrame, title: str, expected: Iterable[str], sample_size: int = 20) -> DataFrame:
    """One row over an index built of several sources: counts (source, n), used (sources with rows), n_total, sample, n_chunks,
    n_titled (chunks of ``title``), files found and missing of the ``expected`` ones."""
    counts = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("source"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    listed = listed.withColumn("used", F.array_join(F.transform(F.filter("counts", lambda c: c["n"] > 0), lambda c: c["source"]), "+"))
    total = union.agg(F.count("*").alias("n_total"))
    names = union.where(F.col("position") < sample_size).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda s: s["name"]).alias("sample"))
    want = F.array(*[F.lit(e) for e in sorted(expected)])
    rows = chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("title") == title).alias("n_titled"), F.collect_set(F.when(F.col("pdf").isin(*expected), F.col("pdf"))).alias("_have"))
    rows = rows.select("n_chunks", "n_titled", F.array_sort("_have").alias("found"), F.array_except(want, F.col("_have")).alias("missing"))
    return listed.crossJoin(total).crossJoin(names).crossJoin(rows)
