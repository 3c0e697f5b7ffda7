"""Sizes of texts in tokens of a public tokenizer, read from a file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Vocabulary as ranks (base64 piece, rank); a parameter of everything that counts tokens.
VOCABULARY = os.environ.get("QUERN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-tokenisation pattern that belongs to that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(rows: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens``; null and empty texts have none. Texts are encoded whole."""
    schema = rows.select(*keep).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return rows.select(*keep, text_col).mapInArrow(count, schema)
