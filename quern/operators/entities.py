"""Entity names out of running text: headings, sections, marked entries, mentions, and one index of them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.ranking import first_wins, ordered_union

# Words that a title-cased name keeps small, and its numerals.
PARTICLES = ("and", "of", "the", "in", "on", "de", "al", "el")
NUMERALS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
UPPER_SHARE = 0.72
# Words that no name holds.
NO_NAME_WORDS = ("was", "is", "and", "or", "in", "on", "to", "for", "with", "from")


@dataclass(frozen=True)
class NameRules:
    """What a collection knows about its names; all lists come from the caller."""

    prefix: str = "St."
    markers: tuple[str, ...] = ("ST", "ST.", "SS", "SS.", "FR", "FR.")
    excluded_terms: tuple[str, ...] = ()
    banned_tokens: tuple[str, ...] = ()
    bad_tokens: tuple[str, ...] = NO_NAME_WORDS
    special: Mapping[str, str] = field(default_factory=dict)
    spellings: tuple[tuple[str, str], ...] = ()
    rewrites: tuple[tuple[str, str], ...] = ()
    titles: tuple[str, ...] = ("st", "saint", "saints")

    def key(self, c: Column) -> Column:
        return T.latin_key(c, self.spellings, self.rewrites, self.titles)


def is_heading(line: Column, excluded: Iterable[str] = ()) -> Column:
    """Whether a line looks like an entry's heading: short, mostly capitals, no excluded term."""
    h = T.collapse(line)
    core = F.regexp_replace(F.regexp_replace(h, r"\([^)]*\)", ""), r"^[ .:]+|[ .:]+$", "")
    letters = F.length(F.regexp_replace(core, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(core, r"[^\p{Lu}]", ""))
    ok = F.length(h).between(3, 100) & ~h.rlike(r"^[0-9]+$") & ~h.contains("...") & (letters >= 3) & (capitals >= UPPER_SHARE * letters)
    low = F.lower(core)
    for term in excluded:
        ok &= ~low.contains(term)
    return F.coalesce(ok & ~low.startswith("[") & ~low.startswith("the "), F.lit(False))


def heading_name(line: Column, rules: NameRules) -> Column:
    """The name a heading gives: no brackets, footnote figures or honours; descriptors behind a comma. Empty for none."""
    h = F.regexp_replace(T.collapse(line), r"\([^)]*\)", "")
    h = F.regexp_replace(h, r"(?<=[\p{L}\p{N}_])[0-9]+(?![\p{L}\p{N}_])", "")
    h = F.regexp_replace(h, r"^[ .:]+|[ .:]+$", "")
    parts = F.filter(F.transform(F.split(h, ","), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", "")), lambda p: p != "")

    def cased(p: Column) -> Column:
        return T.title_case(p, PARTICLES, NUMERALS)

    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~F.upper(p).isin(*rules.markers))
    listed = F.array_join(F.concat(F.array(cased(parts[0])), F.transform(rest, cased)), ", ")
    name = F.concat(F.lit(rules.prefix + " "), F.when(F.size(parts) > 1, listed).otherwise(cased(h)))
    for raw, fixed in rules.special.items():
        name = F.when(F.upper(h) == raw, F.lit(fixed)).otherwise(name)
    return F.when(h == "", F.lit("")).otherwise(name)


def text_lines(rows: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    """``key``, line_pos from 0, line (trimmed)."""
    out = rows.select(*key, F.posexplode(T.lines(F.col(text_col))).alias("line_pos", "line"))
    return out.withColumn("line", T.strip(F.col("line")))


def sections(rows: DataFrame, key: Sequence[str], text_col: str = "text", excluded: Iterable[str] = (), least_words: int = 20) -> DataFrame:
    """``key``, line_pos, heading, body: what stands under each heading up to the next one.

    Done within the row: the lines of a text are cut at its headings, no line is shuffled. Blank lines
    and lines of figures are left out; bodies under ``least_words`` words are dropped.
    """
    lines = F.transform(T.lines(F.col(text_col)), T.strip)
    marked = rows.select(*key, F.transform(lines, lambda v, i: F.struct(v.alias("line"), is_heading(v, excluded).alias("head"), i.alias("pos"))).alias("_l"))
    marked = marked.withColumn("_h", F.filter("_l", lambda v: v["head"]))
    each = marked.select(*key, "_l", "_h", F.posexplode("_h").alias("_i", "_s"))
    end = F.coalesce(F.get("_h", F.col("_i") + 1)["pos"], F.size("_l"))
    inside = F.slice("_l", F.col("_s.pos") + 2, F.greatest(end - F.col("_s.pos") - 1, F.lit(0)))
    kept = F.filter(F.transform(inside, lambda v: v["line"]), lambda v: (v != "") & ~v.rlike(r"^[0-9]+$"))
    out = each.select(*key, F.col("_s.pos").alias("line_pos"), F.col("_s.line").alias("heading"), T.collapse(F.array_join(kept, " ")).alias("body"))
    return out.where(F.size(T.words(F.col("body"))) >= least_words)


def suggestion_name(c: Column, prefix: str = "St.", bad_tokens: Iterable[str] = NO_NAME_WORDS) -> Column:
    """A mention as a name of several capitalised words, with the prefix; empty if it is none."""
    name = F.regexp_replace(T.collapse(c), r"(?i)^(?:st\.?|saint)\s+", "")
    parts = T.words(name)
    fine = F.forall(parts, lambda w: F.lower(w).isin("the", "of", *NUMERALS[:6]) | ((F.length(w) > 2) & w.rlike(r"^\p{Lu}")))
    clean = ~F.exists(parts, lambda w: F.lower(w).isin(*bad_tokens))
    return F.when((F.size(parts) >= 2) & fine & clean, F.concat(F.lit(prefix + " "), name)).otherwise(F.lit(""))


def plausible_name(c: Column, rules: NameRules) -> Column:
    """Whether a name reads like one of several words: no banned word, no apostrophe, no dangling particle."""
    name = suggestion_name(c, rules.prefix, rules.bad_tokens)
    bare = T.strip(F.substring(name, len(rules.prefix) + 1, 10_000))
    low, parts = F.lower(bare), T.words(F.lower(bare))
    trimmed = F.transform(T.words(bare), lambda w: F.regexp_replace(w, r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", ""))
    ok = (name != "") & ~low.contains("'") & ~F.exists(parts, lambda w: w.isin(*rules.banned_tokens or ("",)) | w.endswith("-"))
    ok &= ~low.rlike(r" (?:the|of)$") & F.forall(trimmed, lambda w: F.lower(w).isin("of", "the", *NUMERALS) | (F.length(w) >= 3))
    return F.coalesce(ok, F.lit(False))


def plausible_record(c: Column, rules: NameRules) -> Column:
    """A plausible name, or one capitalised word."""
    bare = T.strip(F.regexp_replace(c, r"(?i)^(?:st\.?|saint)\s+", ""))
    return plausible_name(c, rules) | F.coalesce(bare.rlike(r"^[A-Z][A-Za-z'\-]{2,}$"), F.lit(False))


def rename_and_exclude(rows: DataFrame, name_col: str, renames: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows with names replaced by ``renames`` (name, replacement; an empty one drops the row), then without ``excluded`` (name)."""
    table = renames.groupBy(F.col("name").alias("_old")).agg(F.min("replacement").alias("_new"))
    out = rows.join(table, F.col(name_col) == F.col("_old"), "left").where("_new is null or _new != ''")
    out = out.withColumn(name_col, F.coalesce("_new", name_col)).drop("_old", "_new")
    return out.join(excluded.select(F.col("name").alias(name_col)).distinct(), name_col, "left_anti").select(*rows.columns)


def attach_aliases(records: DataFrame, seeds: DataFrame, rules: NameRules) -> DataFrame:
    """``records`` (id, name, ..) with aliases: the name, then all names of every seed record one of whose Latin names has its key.

    ``seeds`` has seed_id, ordinal, alias, is_latin. Aliases are distinct whatever their case, first spelling wins.
    """
    alias = seeds.select("seed_id", "ordinal", T.collapse(F.col("alias")).alias("alias"), "is_latin")
    keys = alias.where("is_latin").select("seed_id", rules.key(F.col("alias")).alias("key")).where("key != ''").distinct()
    named = records.select("id", "name", rules.key(F.col("name")).alias("key"))
    own = named.select("id", F.lit(-1).alias("rank"), F.lit("").alias("seed_id"), F.lit(-1).alias("ordinal"), T.collapse(F.col("name")).alias("alias"))
    more = named.where("key != ''").join(keys, "key").join(alias.select("seed_id", "ordinal", "alias"), "seed_id").select("id", F.lit(0).alias("rank"), F.col("seed_id").cast("string"), "ordinal", "alias")
    every = own.unionByName(more).where("alias != ''")
    once = first_wins(every, ["id", F.lower("alias")], ["rank", "seed_id", "ordinal", "alias"])
    lists = once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "seed_id", "ordinal", "alias"))), lambda s: s["alias"]).alias("aliases"))
    return records.join(lists, "id")


def record_index(chunks: DataFrame, rules: NameRules, renames: DataFrame, excluded: DataFrame, seeds: DataFrame, pdf_prefix: str) -> DataFrame:
    """The index of entities that have an entry of their own, ordered by name.

    Chunks of files starting with ``pdf_prefix``; (id, name, aliases, raw_heading, is_real_record,
    body_preview, source). Of headings with one key the first by (pdf, page, chunk_index, line) stands.
    """
    place = ["pdf", "page", "chunk_index"]
    found = sections(chunks.where(F.col("pdf").startswith(pdf_prefix)).select(*place, "text").dropDuplicates(place), place, excluded=rules.excluded_terms)
    named = found.withColumn("name", heading_name(F.col("heading"), rules)).where(plausible_record(F.col("name"), rules))
    named = rename_and_exclude(named, "name", renames, excluded).withColumn("id", rules.key(F.col("name"))).where("id != ''")
    once = first_wins(named, ["id"], [*place, "line_pos"])
    source = F.struct(F.lit("pdf").alias("source_type"), "pdf", "page")
    out = once.select("id", "name", F.col("heading").alias("raw_heading"), F.lit(True).alias("is_real_record"), F.substring("body", 1, 300).alias("body_preview"), source.alias("source"))
    return attach_aliases(out, seeds, rules).orderBy(F.lower("name"), "id")


def plausible_arabic_heading(c: Column, body_verbs: Iterable[str] = (), generic_keys: Iterable[str] = (), most_words: int | None = None, composed: bool = False) -> Column:
    text = T.arabic_display(c, composed)
    ok = T.has_arabic(text) & F.length(text).between(2, 90) & ~text.rlike(r"[.!؟:؛]")
    verbs = list(body_verbs)
    if verbs:
        ok &= ~text.rlike(rf"^(?:{'|'.join(verbs)})(?![\p{{L}}\p{{N}}_])")
    generic = list(generic_keys)
    if generic:
        ok &= ~T.arabic_key(text, True).isin(*generic)
    if most_words is not None:
        ok &= F.size(T.words(text)) <= most_words
    return F.coalesce(ok, F.lit(False))


def marked_entries(rows: DataFrame, key: Sequence[str], marker: str = "✞", cues: Iterable[str] = (), text_col: str = "text", composed: bool = False, **plausible) -> DataFrame:
    """``key``, entry_pos, heading, segment: the names behind each entry marker.

    A heading ends at two blanks, at a Latin title, or at a word of ``cues``; figures at its end go.
    """
    text = F.col(text_col) if composed else T.nfkc(F.col(text_col))
    parts = F.split(text, marker)
    out = rows.select(*key, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("entry_pos", "segment"))
    segment = T.strip(F.col("segment"))
    h = F.regexp_replace(segment, rf"(?s){T.SPACE}{{2,}}.*$", "")
    h = T.arabic_display(F.regexp_replace(h, rf"(?s){T.SPACE}+(?:St\.|SS\.).*$", ""), True)
    cue_words = "|".join(cues)
    if cue_words:
        h = F.regexp_replace(h, rf"(?s) +(?:{cue_words})(?![\p{{L}}\p{{N}}_]).*$", "")
    h = T.strip(F.regexp_replace(h, r"\s*[0-9٠-٩]+\s*$", ""))
    return out.select(*key, "entry_pos", h.alias("heading"), segment.alias("segment")).where(plausible_arabic_heading(F.col("heading"), composed=True, **plausible))


def entry_index(pages: DataFrame, prefix: str = "entry-", source_title: str = "", composed: bool = False, **options) -> DataFrame:
    """Index records of ``pages`` (pdf, page, text): (id, name_ar, aliases_ar, source_title, page_start, page_end, preview), by key; the first entry of a key stands."""
    found = marked_entries(pages, ["pdf", "page"], composed=composed, **options).withColumn("key", T.arabic_key(F.col("heading"), True)).where("key != ''")
    once = first_wins(found, ["key"], ["pdf", "page", "entry_pos"]).orderBy("key")
    return once.select(
        T.sha1_id(prefix, F.col("key")).alias("id"), F.col("heading").alias("name_ar"), F.array().cast("array<string>").alias("aliases_ar"), F.lit(source_title).alias("source_title"),
        F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.substring(T.collapse(F.col("segment")), 1, 220).alias("preview"),
    )


def index_warnings(stats: dict[str, int]) -> list[str]:
    """What is suspicious about an index: too few pages, characters or entries."""
    limits = {"n_pages": 10, "n_chars": 1000, "n_entries": 50}
    return [f"{name} is {stats.get(name, 0)}, expected {least} or more" for name, least in limits.items() if stats.get(name, 0) < least]


def name_union(parts: Sequence[DataFrame], name_col: str, order: Sequence[str], composed: bool = False) -> DataFrame:
    """(name, position): names of several sources, earlier sources first, each Arabic key once."""
    keyed = [p.select(T.arabic_display(F.col(name_col), composed).alias("name"), *[c for c in order if c not in (name_col, "name")]) for p in parts]
    keyed = [p.withColumn("key", T.arabic_key(F.col("name"), True)).where("key != ''") for p in keyed]
    return ordered_union(keyed, ["key"], list(order)).select("name", "position")


# Fixed value: how a mention of a name with its title reads.
_MENTION = r"(?<![\p{L}\p{N}_])%s\s+[A-Z][A-Za-z'\-]+(?:\s+(?:of|the|[A-Z][A-Za-z'\-]+)){0,5}"


def mentions(text: Column) -> Column:
    """Array of the names mentioned with a title: all with the short form, then all with the long one."""
    short, long_ = (F.regexp_extract_all(text, F.lit(_MENTION % t), 0) for t in (r"St\.?", "Saint"))
    return F.transform(F.concat(short, long_), T.strip)


def weak_mentions(rows: DataFrame, order: Sequence[str], known_keys: DataFrame, query: str, rules: NameRules, limit: int = 12, text_col: str = "text") -> DataFrame:
    """(name, key): names mentioned whose key holds the query's and that have no entry of their own; first mentions first."""
    found = rows.select(*order, F.posexplode(mentions(F.col(text_col))).alias("mention_pos", "mention"))
    found = found.withColumn("name", suggestion_name(F.col("mention"), rules.prefix, rules.bad_tokens)).where("name != ''")
    found = found.withColumn("key", rules.key(F.col("name"))).where((F.col("key") != "") & F.col("key").contains(rules.key(F.lit(query))))
    new = found.join(known_keys.select("key").distinct(), "key", "left_anti")
    return first_wins(new, ["key"], [*order, "mention_pos"]).orderBy(*order, "mention_pos").limit(max(1, limit)).select("name", "key")


def list_items(text: Column, topical: Iterable[str] = (), most: int = 80) -> Column:
    """Array of the labels of a numbered list that name persons, each once: the bold part, else what stands before a dash."""
    items = F.regexp_extract_all(text, F.lit(r"(?m)\d+[.)]\s*([^\n]+)"), 1)

    def label(item: Column) -> Column:
        bold = F.regexp_extract(item, r"\*\*([^*]+)\*\*", 1)
        plain = F.regexp_replace(T.clean_label(item), r"\s[-:—]\s.*$", "")
        plain = T.strip(F.regexp_replace(plain, r"\s*\([^)]*\)\s*$", ""))
        return F.when(bold != "", T.clean_label(bold)).otherwise(plain)

    return F.array_distinct(F.filter(F.transform(items, label), lambda v: (v != "") & (F.length(v) <= most) & person_like(v, topical)))


def person_like(c: Column, topical: Iterable[str] = (), markers: Iterable[str] = ("st.", "saint")) -> Column:
    """Whether a label names a person: a title in it, or two capitalised words; topical terms never."""
    v = T.clean_label(c)
    low, parts = F.lower(v), T.words(v)
    marked = F.lit(False)
    for m in markers:
        marked |= low.contains(m)
    capitals = F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))
    return F.coalesce((v != "") & ~low.isin(*list(topical) or [""]) & (marked | ((F.size(parts) >= 2) & (capitals >= 2))), F.lit(False))
