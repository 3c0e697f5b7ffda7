"""Problem 3: one form for strings that look the same.

The skeleton of a string is its compatibility decomposition, without
characters that cannot be seen, with every blank written as a space, every
character replaced by the prototype of its look-alikes, decomposed again.
Strings look the same when their skeletons are equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other alphabets that look like a Latin letter.
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "α": "a", "υ": "u", "χ": "x",
    "ϲ": "c", "Ϲ": "C", "ϳ": "j",
}
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԝ": "W", "Ԛ": "Q",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "Ӏ": "I", "ɡ": "g", "ı": "i", "ȷ": "j",
}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Տ": "S", "Օ": "O", "Լ": "L"}
#: Arabic letters written differently elsewhere; U+06CC is handled by place.
ARABIC = {"ک": "ك", "ڪ": "ك", "ہ": "ه", "ھ": "ه", "ە": "ه", "ۃ": "ة", "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩"}
PUNCTUATION = {"‐": "-", "‑": "-", "‒": "-", "–": "–", "−": "-", "՚": "'", "ʼ": "'", "‘": "'", "’": "'", "′": "'", "“": '"', "”": '"'}
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]

_PROTOTYPE: dict[int, str | None] = {
    **{ord(a): b for t in (GREEK, CYRILLIC, ARMENIAN, ARABIC) for a, b in t.items()},
    **{ord(a): b for a, b in PUNCTUATION.items() if a in "‐‑"},
    **dict.fromkeys(INVISIBLE),
    **{c: " " for c in (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)},
}
_ARABIC_LETTER = r"[ؠ-ؿف-يٮ-ۓۺ-ۼ]"
#: U+06CC looks like U+064A where it joins the next letter, else like U+0649.
_YEH_JOINED = re.compile(rf"ی(?=[ـً-ٰٟ]*{_ARABIC_LETTER})")
_PLAIN = re.compile(r"[\t\n\r -~]*\Z")


def skeleton(text: str | None) -> str | None:
    """The form shared by all strings that look like ``text``; null stays null."""
    if text is None or _PLAIN.match(text):
        return text
    out = unicodedata.normalize("NFKD", text).translate(_PROTOTYPE)
    if "ی" in out:
        out = _YEH_JOINED.sub("ي", out).replace("ی", "ى")
    return unicodedata.normalize("NFKD", out)


@F.pandas_udf(StringType())
def skeleton_udf(text: pd.Series) -> pd.Series:
    return text.map(skeleton, na_action="ignore")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form, raw = [], []
        for t in batch.column(1).to_pylist():
            form.append(xxhash.xxh3_128_digest(skeleton(t).encode("utf-8", "surrogatepass")))
            raw.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["id", "form", "raw"])


def forms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, raw): 128-bit hashes of each row's skeleton and of its own characters.

    Rows given twice count once; rows without id or text are left out.
    """
    pairs = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return pairs.mapInArrow(_hashed, "id string, form binary, raw binary").distinct()


def look_alikes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b): ids whose strings look the same but are stored differently.

    Rows with equal characters are no pair, so groups of exact copies are not
    multiplied out against themselves. Only groups with two spellings take part.
    """
    f = forms(rows, id_col, text_col)
    varied = f.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo != hi").select("form")
    f = f.join(varied, "form", "left_semi").select("id", "form", "raw")
    a, b = f.toDF("id_a", "form", "raw_a"), f.toDF("id_b", "form", "raw_b")
    return a.join(b, "form").where("id_a < id_b and raw_a != raw_b").select("id_a", "id_b").distinct()


def canonical(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, skeleton, class_id, n_in_class): every row in its one form, with the smallest id that looks like it."""
    f = rows.select(F.col(id_col).alias("id"), skeleton_udf(F.col(text_col)).alias("skeleton")).distinct()
    keyed = f.withColumn("form", F.xxhash64("skeleton"))
    classes = keyed.where("skeleton is not null").groupBy("form", F.md5("skeleton").alias("check")).agg(F.min("id").alias("class_id"), F.count("*").alias("n_in_class"))
    keyed = keyed.withColumn("check", F.md5("skeleton"))
    return keyed.join(classes, ["form", "check"], "left").select("id", "skeleton", "class_id", "n_in_class")
