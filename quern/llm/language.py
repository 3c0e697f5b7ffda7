"""Problem 5: the language of every record, and of every line of a mixed one.

Multinomial naive Bayes over hashed character n-grams. The log-probability
matrix (buckets x languages, 1.3 MB) is broadcast; a batch is scored by looking
up one row of the matrix per n-gram and summing by line.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textkit
from quern.llm.skeleton import ARABIC, CYRILLIC, GREEK, INVISIBLE

LANGUAGES = ("en", "ar", "fr", "es", "de")
# Names and codes of the languages (ISO 639-1, 639-2, English and own names).
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "ar": ("ar", "ara", "arabic", "العربية"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
}
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Added to every n-gram's count; one, as names seen in one language only would else outweigh a short question.
SMOOTHING = 1.0
#: Labelled rows of each language that the classifier is fitted on, at most. Up to 1000 the optimizer cuts
#: each partition down to the sample before the shuffle (its window group limit).
SAMPLE_PER_LANGUAGE = 1000
#: Sampled texts that are counted at a time in fitting.
FIT_TEXTS = 200


def label_code(label: Column) -> Column:
    """The code a label names in any spelling (case, region, language name), else null."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(plain.isin(*names), F.lit(code)).otherwise(out)
    return out


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Per code point its lower-case base shape; 1 for everything but letters, 0 for what cannot be seen."""
    out = np.ones(0x10000, np.uint32)
    swap = {**GREEK, **CYRILLIC, **ARABIC}
    for c in range(0x10000):
        ch = swap.get(chr(c), chr(c))
        ch = unicodedata.normalize("NFKC", ch).lower()
        if ch and ch[0].isalpha():
            out[c] = ord(ch[0])
        elif unicodedata.category(chr(c)) == "Mn":
            out[c] = 0
    out[INVISIBLE] = 0
    out[10] = 10
    return out


def line_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the line each belongs to, each line's text, and each line's letters."""
    cps, offsets = textkit.code_points([t + "\n" for t in texts])
    low = _fold()[np.minimum(cps, 0xFFFF)]
    ends = cps == 10
    line = np.zeros(len(cps), np.int64)
    np.cumsum(ends[:-1], out=line[1:])
    n_lines = int(ends.sum())
    line_doc = np.searchsorted(offsets, np.flatnonzero(ends), side="right") - 1
    keep = low != 0
    low, line = low[keep], line[keep]
    low = np.where(low == 10, 1, low)
    # one separator between words
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 1) | (low[:-1] != 1)
    low, line = low[keep], line[keep]
    letters = np.bincount(line[low != 1], minlength=n_lines)
    buckets, owner = [], []
    for n in ORDERS:
        if len(low) < n:
            continue
        h = np.zeros(len(low) - n + 1, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x9E3779B1) + low[i : len(low) - n + 1 + i]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)
        same = line[: len(low) - n + 1] == line[n - 1 :]
        buckets.append(h[same].astype(np.int64))
        owner.append(line[: len(low) - n + 1][same])
    if not buckets:
        z = np.zeros(0, np.int64)
        return z, z, line_doc, letters
    return np.concatenate(buckets), np.concatenate(owner), line_doc, letters


def fit(texts: list[str], labels: list[str]) -> np.ndarray:
    """Log probabilities, buckets x languages, from whole texts; labels that the first fit contradicts are dropped for the second."""
    texts = [t.replace("\n", " ") for t in texts]
    y = np.array([LANGUAGES.index(v) for v in labels], np.int64)
    use = np.ones(len(texts), bool)
    for again in (True, False):
        counts = np.zeros((BUCKETS, len(LANGUAGES)))
        for at in range(0, len(texts), FIT_TEXTS):
            b, owner, _, _ = line_grams(texts[at : at + FIT_TEXTS])
            of, used = y[at + owner], use[at + owner]
            for k in range(len(LANGUAGES)):
                counts[:, k] += np.bincount(b[(of == k) & used], minlength=BUCKETS)
        counts += SMOOTHING
        model = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        if again:
            best = [score_lines(texts[at : at + FIT_TEXTS], model)[2].argmax(axis=1) for at in range(0, len(texts), FIT_TEXTS)]
            use = np.concatenate(best) == y if best else use
    return model


def labelled_sample(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` rows (text, label) of each language, by a hash of the text.

    ``rows`` has text and label. Rows are chosen by smallest hash, so the sample does not depend on
    partitioning; what leaves a partition is already cut down to the sample. Whole texts are taken,
    so the sample is as large as its rows (chunks, at most a few thousand characters each).
    """
    known = rows.select("text", label_code(F.col("label")).alias("label")).where("label is not null and text is not null")
    known = known.withColumn("h", F.xxhash64("text"))
    best = F.expr("row_number() over (partition by label order by h)")
    return known.withColumn("n", best).where(F.col("n") <= per_language).select("text", "label")


def train(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> np.ndarray:
    sample = labelled_sample(rows, per_language).collect()
    return fit([r.text for r in sample], [r.label for r in sample])


def score_lines(texts: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: its text's number, its letters, and the log scores of all languages."""
    b, owner, line_doc, letters = line_grams(texts)
    rows = model[b]
    n = len(line_doc)
    scores = np.stack([np.bincount(owner, rows[:, k], minlength=n) for k in range(model.shape[1])], axis=1)
    return line_doc, letters, scores


def _confidence(scores: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Posterior of the best language, tempered by how many n-grams each letter takes part in."""
    s = scores / len(ORDERS)
    s = s - s.max(axis=-1, keepdims=True)
    p = 1 / np.exp(s).sum(axis=-1)
    return np.where(letters > 0, p, 0.0)


def identify(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Language of every text and, where they differ, of its lines.

    ``rows`` has tbl, rec_id, text, label. Gives (tbl, rec_id, label, seg_no, lang,
    confidence, mixed): one row with seg_no 0 for the text (the language that most of its letters
    are in) and, where not all lines are in one language, one row per line with letters, numbered
    from 1 with blank lines counted. Null and letterless texts have lang null.
    """

    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = np.array(LANGUAGES, dtype=object), shared.value
        for batch in batches:
            tbl, rec, label = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, z in textkit.slices(np.array([len(t) for t in texts], np.int64)):
                doc, letters, scores = score_lines(texts[a:z], model)
                best = scores.argmax(axis=1)
                real = letters > 0
                mass = np.zeros((z - a, len(LANGUAGES)))
                np.add.at(mass, (doc[real], best[real]), letters[real])
                total = np.zeros_like(scores, shape=(z - a, len(LANGUAGES)))
                np.add.at(total, doc, scores)
                has = mass.sum(axis=1) > 0
                main = mass.argmax(axis=1)
                mixed = (mass > 0).sum(axis=1) > 1
                share = mass.max(axis=1) / np.maximum(mass.sum(axis=1), 1)
                conf = np.where(mixed, share, _confidence(total, mass.sum(axis=1)))
                first = np.searchsorted(doc, doc, side="left")
                seg = np.arange(len(doc)) - first + 1
                pick = np.flatnonzero(mixed[doc] & real)
                lines = _confidence(scores, letters)
                which = np.concatenate([np.arange(z - a), doc[pick]])
                lang = np.concatenate([np.where(has, names[main], None), names[best[pick]]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tbl[a + i] for i in which], pa.string()),
                        pa.array([rec[a + i] for i in which], pa.string()),
                        pa.array([label[a + i] for i in which], pa.string()),
                        pa.array(np.concatenate([np.zeros(z - a, np.int32), seg[pick].astype(np.int32)]), pa.int32()),
                        pa.array(lang.tolist(), pa.string()),
                        pa.array(np.concatenate([conf, lines[pick]]), pa.float64()),
                        pa.array(mixed[which], pa.bool_()),
                    ],
                    names=["tbl", "rec_id", "label", "seg_no", "lang", "confidence", "mixed"],
                )

    schema = "tbl string, rec_id string, label string, seg_no int, lang string, confidence double, mixed boolean"
    return rows.select("tbl", "rec_id", "text", "label").mapInArrow(run, schema)
