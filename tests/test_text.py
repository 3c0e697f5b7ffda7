from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


EDGE = ["", " ", "a b", " x y ", "\x1cz\x1f", "½ Ⅳ", "كَانَ", "a_b-c", "St. Mary's", "ﷺ", None]


@pytest.mark.parametrize("value", EDGE)
def test_spaces_are_pythons(spark, value):
    if value is None:
        assert one(spark, T.collapse, value) is None
        return
    assert one(spark, T.strip, value) == value.strip()
    assert one(spark, T.collapse, value) == " ".join(value.split())
    assert one(spark, T.words, value) == value.split()


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\r\nb", "\n\n", "x y\u0085z", "a\x0bb\x1cc"])
def test_lines_are_pythons(spark, value):
    assert one(spark, T.lines, value) == value.splitlines()


def test_nfkc(spark):
    for v in ("ﬁ", "ﷺ", "ＡＢ", "plain", None):
        assert one(spark, T.nfkc, v) == (None if v is None else unicodedata.normalize("NFKC", v))


def test_latin_key(spark):
    key = lambda c: T.latin_key(c, [("Karol", "Carl")], [("marys", "mary")], ["st", "saint"])
    assert one(spark, key, " St. Karol's the/Great_One ") == "carls great one"
    assert one(spark, key, "Marys") == "mary"
    assert one(spark, key, "the") == ""


def test_arabic_keys(spark):
    assert one(spark, T.arabic_key, "أَحْمَد إلى ﻻ، مـريم") == "احمد الي لا مريم"
    assert one(spark, T.arabic_display, " مـريم   کبیر ") == "مريم كبير"


def test_rotations(spark):
    f = lambda c: T.rotations(c, ["dom", "fra"])
    assert one(spark, f, "dom john fra") == ["dom john fra", "john fra dom", "fra dom john"]
    assert one(spark, f, "dom") == ["dom"]
    assert one(spark, f, "") == []


def test_labels_and_titles(spark):
    assert one(spark, T.clean_label, " 3) **Bold** ") == "Bold"
    assert one(spark, lambda c: T.short_title(c, "New"), "x" * 80) == "x" * 67 + "..."
    assert one(spark, lambda c: T.short_title(c, "New"), None) == "New"
    assert one(spark, T.text_to_html, "<a & 'b'>\n") == "&lt;a &amp; &#39;b&#39;&gt;<br />"
    assert one(spark, T.csv_items, " a ,, b") == ["a", "b"]
    assert one(spark, lambda c: T.display_key(c, ["st.", "saint"]), "1. **St. Saint Ba**") == "ba"
    assert one(spark, lambda c: T.first_match(c, {"b+": "bees", "a": "ay"}, "none"), "AAB") == "bees"
    assert one(spark, lambda c: T.first_match(c, {"b+": "bees"}, "none"), None) == "none"


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=40))
def test_ascii_key_property(spark, value):
    expected = " ".join(re.sub(r"[^a-z0-9\s]", " ", "".join(c.lower() if len(c.lower()) == 1 else c for c in value)).split())
    got = one(spark, T.ascii_key, value)
    assert set(got) <= set("abcdefghijklmnopqrstuvwxyz0123456789 ")
    if value.isascii():
        assert got == expected


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 2.0], [1.0])], "a array<float>, b array<float>, c array<float>")
    a, b, c = row.select(V.squared_l2(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("a")), V.squared_l2(F.col("a"), F.col("c"))).first()
    assert (a, round(b, 9), c) == (4.0, 0.0, None)
