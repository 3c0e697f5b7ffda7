"""Where queries and their SQL are kept together."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources.tables import read_table as table  # noqa: F401  (the queries' modules take it from here)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Unicode white space and punctuation, as the text functions use them, for SQL.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
PUNCT = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda w: w <> '')"


def distinct(x: str) -> str:
    """A list without repetitions, in first-occurrence order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def once_lower(x: str) -> str:
    """A list without repetitions whatever their case, the first spelling of each."""
    return f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda y: lower(y)), lower(v)) = i)"


def ascii_key(x: str) -> str:
    return collapse(rf"regexp_replace(lower({x}), '[^a-z0-9\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', ' ', 'g')")


def without_words(x: str, drop: list[str]) -> str:
    listed = ", ".join(f"'{d}'" for d in drop)
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w <> '' AND w NOT IN ({listed})), ' ')"


def latin_key(x: str, titles: list[str]) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace(lower({strip(x)}), '[''`\\x{{2019}}]', '', 'g'), '[-_/]', ' ', 'g'), '{PUNCT}', ' ', 'g')"
    return without_words(collapse(plain), [*titles, "the"])


def title_case(x: str) -> str:
    low = "'and','of','the','in','on','de','al','el'"
    up = "'i','ii','iii','iv','v','vi','vii','viii','ix','x'"
    one = f"CASE WHEN lower(w) IN ({low}) THEN lower(w) WHEN lower(w) IN ({up}) THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END"
    return f"array_to_string(list_transform({words(x)}, lambda w: {one}), ' ')"


def arabic_key(x: str) -> str:
    plain = f"regexp_replace(translate({x}, 'یىکھةأإآ', 'ييكههااا'), '[\\x{{64b}}-\\x{{65f}}\\x{{670}}\\x{{640}}]', '', 'g')"
    return collapse(f"regexp_replace({plain}, '{PUNCT}', ' ', 'g')")


def arabic_display(x: str) -> str:
    return collapse(f"replace(translate({x}, 'یکھ', 'يكه'), 'ـ', '')")


def nfkc(x: str) -> str:
    """Compatibility composition for SQL, of Arabic position forms, full-width forms and blanks (by the rule of Unicode's data)."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for r in ((0xA0, 0xA1), (0x2000, 0x2030), (0x3000, 0x3001), (0xFB50, 0xFBB2), (0xFE80, 0xFEFD), (0xFF01, 0xFF5F)) for c in range(*r)}
    forms = {a: b for a, b in forms.items() if a != b}
    one = {a: b for a, b in forms.items() if len(b) == 1}
    out = f"translate({x}, '{''.join(one)}', '{''.join(b.replace(chr(39), chr(39) * 2) for b in one.values())}')"
    for a, b in forms.items():
        if len(b) > 1 and unicodedata.category(a).startswith("L"):
            out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"
