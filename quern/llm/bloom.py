"""A Bloom filter over a column of keys, to thin a scan before its shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.textkit import mix

#: Bits for every key (about one row in forty passes wrongly), and the most bits of a filter: 64 MB, full from 50
#: million keys. A fuller filter lets more rows through, never fewer.
KEY_BITS, MOST_BITS = 10, 1 << 29


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(keys.astype(np.uint64))
    g = mix(h ^ np.uint64(0x9E3779B97F4A7C15))
    return [((h + np.uint64(i) * g) % np.uint64(bits)).astype(np.int64) for i in range(3)]


def build(keys: DataFrame) -> np.ndarray:
    """Filter over the only column of ``keys`` (bigint), as large as their number asks for; up to 8 partial filters are merged on the driver."""
    n = keys.count()
    bits = min(MOST_BITS, 1 << max(16, (KEY_BITS * n).bit_length()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in keys.coalesce(8).mapInArrow(partial, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(row.bits), np.uint8)
    return out


def contains(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for at in _places(keys, 8 * len(bits)):
        hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit


def thin(rows: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """Rows whose key may be in the filter; the join that follows decides exactly."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(contains(shared.value, keys)))

    return rows.mapInArrow(run, rows.schema)
