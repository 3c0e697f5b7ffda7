"""Text normalisation as Column expressions.

Word lists (titles, stopwords, spellings) are arguments: they belong to a
collection, not to the engine. Every function gives null for null input unless
it says otherwise. White space and word characters follow Unicode explicitly,
so that the same patterns mean the same in other SQL engines.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space: ASCII blanks, the information separators, NEL and the Unicode separators.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Anything that is no letter, number, underscore or white space.
PUNCT = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Line ends of Unicode text.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ARABIC = r"[\x{600}-\x{6ff}]"

# Letters that the key of an Arabic name does not tell apart, and its marks.
ARABIC_LETTERS = ("یىکھةأإآ", "ييكههااا")
ARABIC_MARKS = r"[\x{64b}-\x{65f}\x{670}\x{640}]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark SQL does not have."""
    return text.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``c``, with ``c`` evaluated once a row.

    An expression used inside a lambda (or pushed into a filter) would else run once per use.
    """
    return F.get(F.transform(F.array(c), body), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    """Pieces between white space; an empty array for blank text."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def lines(c: Column) -> Column:
    """Lines without their ends; an end at the very end of the text starts no line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(c == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def respell(c: Column, spellings: Iterable[tuple[str, str]]) -> Column:
    """Trimmed text with literal replacements in order."""
    out = strip(c)
    for old, new in spellings:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _literals(values: Iterable[str]) -> Column:
    found = [F.lit(v) for v in values]
    return F.array(*found) if found else F.array().cast("array<string>")


def without_words(c: Column, drop: Iterable[str]) -> Column:
    """Blank-separated text without the given words."""
    drop = list(drop)
    return F.array_join(F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(*drop)) if drop else words(c), " ")


def latin_key(c: Column, spellings: Iterable[tuple[str, str]] = (), rewrites: Iterable[tuple[str, str]] = (), titles: Iterable[str] = ()) -> Column:
    """Key by which Latin names compare: lower case, no apostrophes, punctuation as blanks, no titles, no "the".

    ``rewrites`` replace whole words before apostrophes go.
    """
    out = F.lower(respell(c, spellings))
    for old, new in rewrites:
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}_]){old}(?![\p{{L}}\p{{N}}_])", new)
    out = F.regexp_replace(out, r"['`\x{2019}]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[-_/]", " "), PUNCT, " ")
    return without_words(collapse(out), [*titles, "the"])


def arabic_key(c: Column, composed: bool = False) -> Column:
    """Key by which Arabic names compare: one letter for its variants, no vowel marks, punctuation as blanks.

    ``composed`` says that the text is in NFKC already, which saves the Python step.
    """
    out = F.translate(c if composed else nfkc(c), *ARABIC_LETTERS)
    out = F.regexp_replace(out, ARABIC_MARKS, "")
    return collapse(F.regexp_replace(out, PUNCT, " "))


def arabic_display(c: Column, composed: bool = False) -> Column:
    """Arabic text for reading: letter forms unified, no tatweel, blanks collapsed."""
    out = F.translate(c if composed else nfkc(c), "یکھـ", "يكه")
    return collapse(out)


def arabic_search(c: Column, composed: bool = False) -> Column:
    return arabic_key(arabic_display(c, composed), True)


def ascii_key(c: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and blanks as a blank."""
    return collapse(F.regexp_replace(F.lower(c), rf"[^a-z0-9\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]", " "))


def rotations(key: Column, titles: Iterable[str]) -> Column:
    """The key, and with a first or last word that is an ordering title the key with it moved to the other end."""
    titles = list(titles)
    parts = F.split(key, " ")
    several = F.size(parts) >= 2
    left = F.array_join(F.concat(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1)), " ")
    right = F.array_join(F.concat(F.slice(parts, -1, 1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), " ")
    out = F.array_compact(F.array(key, F.when(several & parts[0].isin(*titles), left), F.when(several & F.element_at(parts, -1).isin(*titles), right)))
    return F.array_distinct(F.filter(out, lambda k: k != ""))


def without_prefix(c: Column, prefixes: Iterable[str]) -> Column:
    """Text without one leading phrase of ``prefixes`` (plain words, any case, longest first) and any following."""
    alternatives = "|".join(sorted((p.replace(".", r"\.") for p in prefixes), key=len, reverse=True))
    return F.regexp_replace(c, rf"(?i)^{SPACE}*(?:(?:{alternatives}){SPACE}+)+", "")


def core_name(c: Column, prefixes: Iterable[str]) -> Column:
    """First word in lower case behind the prefixes; empty if there is none."""
    return F.coalesce(F.lower(F.get(words(without_prefix(c, prefixes)), 0)), F.lit(""))


def has_arabic(c: Column) -> Column:
    return F.coalesce(c.rlike(ARABIC), F.lit(False))


def detect_language(selected: Column, text: Column) -> Column:
    """An explicit ar or en wins; else the script of the text decides."""
    asked = F.lower(F.trim(F.coalesce(selected, F.lit(""))))
    return F.when(asked.isin("ar", "en"), asked).when(has_arabic(text), "ar").otherwise("en")


def preview_language(c: Column) -> Column:
    latin = F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))
    return F.when(has_arabic(c) & latin, "mixed").when(has_arabic(c), "ar").when(latin, "en").otherwise("unknown")


def known_mode(c: Column, modes: Iterable[str], default: str) -> Column:
    mode = F.lower(collapse(c))
    return F.when(mode.isin(*modes), mode).otherwise(F.lit(default))


def keywords(c: Column, stopwords: Iterable[str], least: int = 3) -> Column:
    """Distinct words of the ASCII key in order, of ``least`` characters and no stopword."""
    stop = list(stopwords)
    return F.array_distinct(F.filter(F.split(ascii_key(c), " "), lambda w: (F.length(w) >= least) & ~w.isin(*stop)))


def name_tokens(c: Column, removable: Iterable[str], prefix: str, composed: bool = False) -> Column:
    """Arabic words of a name: no removable word, a fixed prefix off longer words."""
    drop, n = list(removable), len(prefix)
    found = F.filter(F.split(arabic_search(c, composed), " "), lambda w: w.rlike(ARABIC) & ~w.isin(*drop))
    cut = F.transform(found, lambda w: F.when(w.startswith(prefix) & (F.length(w) > n), w.substr(n + 1, 1_000)).otherwise(w))
    return F.filter(cut, lambda w: (w != "") & ~w.isin(*drop))


def title_case(c: Column, particles: Iterable[str], numerals: Iterable[str]) -> Column:
    """Particles in lower case, numerals in upper case, other words capitalised."""
    low, up = list(particles), list(numerals)

    def one(w: Column) -> Column:
        lower = F.lower(w)
        return F.when(lower.isin(*low), lower).when(lower.isin(*up), F.upper(w)).otherwise(F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(2, 10_000))))

    return F.array_join(F.transform(words(c), one), " ")


def clean_label(c: Column) -> Column:
    """A list item's label: no leading ordinal, no bold marks."""
    return strip(F.replace(F.regexp_replace(strip(c), r"^\d+[.)]\s*", ""), F.lit("**"), F.lit("")))


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def sha1_id(prefix: str, key: Column, n: int = 12) -> Column:
    """``prefix`` and the first hexadecimal digits of the key's SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(key), 1, n))


def display_key(c: Column, titles: Iterable[str], spellings: Iterable[tuple[str, str]] = ()) -> Column:
    """Key of a displayed name: no bold marks, ordinal or leading titles, lower case."""
    out = F.lower(collapse(F.regexp_replace(F.replace(c, F.lit("**"), F.lit("")), r"^\s*\d+[.)]\s*", "")))
    out = F.regexp_replace(out, r"^(?:(?:" + "|".join(t.replace(".", r"\.") for t in titles) + r")\s+)+", "")
    for old, new in spellings:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def short_title(c: Column, default: str, limit: int = 70) -> Column:
    """A trimmed title; the default for none; too long ones end in three dots within the limit."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(default)).when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def escape_html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def text_to_html(c: Column) -> Column:
    return F.replace(escape_html(c), F.lit("\n"), F.lit("<br />"))


def csv_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda v: v != "")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("int")


def normalize_url(c: Column) -> Column:
    """Trimmed address without its fragment."""
    return strip(F.regexp_replace(strip(c), r"#.*$", ""))


def first_match(c: Column, rules: Mapping[str, str], default: str | None = None) -> Column:
    """Value of the first rule (pattern to value) that the lower-cased text matches."""
    text = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, value in rules.items():
        out = out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(default))
