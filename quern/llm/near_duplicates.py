"""Problem 4: records that share most of their word sequences.

Records with the same set of k-word sequences form a class. MinHash bands say
which classes may be compared; every band entry carries sketches of the
record (two bits of each of its MinHash values), and the entries of one key are
compared in array tiles, so that a pair of unlike records that meets in a band
costs a few nanoseconds and is never written. What is left
falls into tiles of two size bands, where parity bitmaps as wide as the band
needs bound the overlap from above; the rest is decided by intersecting sorted
arrays.

Bands are drawn from all sequences of a record, however common: in a large
family of reworked copies the shared text is common itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bloom
from quern.llm.scratch import materialize
from quern.llm.textkit import distinct_grams, mix, slices

#: Chance that a pair exactly at the threshold has no band in common; pairs above it have far less.
MISSED = 0.001
#: Bits of each of a record's two sketches (bits 0 and 1 of its MinHash values), in words of 64.
SKETCH_BITS = 192
#: Standard deviations above the expected number of different values at which the sketches still let a pair through (0.1 %).
SLACK = 3.1
#: Words that tiles compare before the rest, and the standard deviations for them (0.01 %).
FIRST_WORDS, FIRST_SLACK = 2, 3.7
#: Records of a cell that is compared row by row, not in tiles.
SMALL_CELL = 32
#: Records of a band key from which it is dealt to several cells.
HOT = 16_384
#: Records up to which all bands are taken at once, and bands in a pass over more records.
FEW, PASS_BANDS = 1 << 15, 13


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows) for any threshold: rows so that a band is shared with a chance of about 1/8, bands so that ``MISSED`` holds."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    rows = min(5, max(1, round(math.log(1 / 8) / math.log(threshold))))
    return math.ceil(math.log(MISSED) / math.log1p(-(threshold**rows))), rows


def most_apart(threshold: float, values: int = SKETCH_BITS, slack: float = SLACK) -> int:
    """Of so many MinHash values, those in whose two bits a pair at the threshold differs at most; unequal values differ in them with a chance of 3/4."""
    chance = (1 - threshold) * 3 / 4
    return math.floor(values * chance + slack * math.sqrt(values * chance * (1 - chance)))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
    for a, z in slices(np.array([len(t) for t in texts], np.int64)):
        yield ids[a:z], texts[a:z]


def _minima(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of every group of ``h``; groups begin at ``starts``."""
    rng = np.random.default_rng(1)
    a = rng.integers(1 << 32, size=n, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(1 << 32, size=n, dtype=np.uint32)
    h = (mix(h) >> np.uint64(32)).astype(np.uint32)
    out, v, w = np.zeros((len(starts), n), np.uint32), np.empty_like(h), np.empty_like(h)
    for i in range(n):
        np.multiply(h, a[i], out=v)
        v += b[i]
        np.right_shift(v, np.uint32(15), out=w)
        v ^= w
        v *= np.uint32(0x2C1B3C6D)
        np.right_shift(v, np.uint32(12), out=w)
        v ^= w
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def _sketched(h: np.ndarray, d: np.ndarray, n_docs: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n_docs, bands) and both sketches (n_docs, 2 x words) of every text; those of texts without sequences mean nothing."""
    words = SKETCH_BITS // 64
    keys, sketch = np.zeros((n_docs, bands), np.int32), np.zeros((n_docs, 2 * words), np.int64)
    if not len(h):
        return keys, sketch
    starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    sig = _minima(h, starts, max(SKETCH_BITS, bands * rows))
    own = np.ones((len(starts), bands), np.uint64)
    for r in range(rows):
        own = mix(own * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : bands * rows : rows])
    keys[d[starts]] = (own >> np.uint64(32)).astype(np.uint32).view(np.int32)
    planes = [np.packbits((sig[:, :SKETCH_BITS] >> np.uint32(i) & np.uint32(1)).astype(np.uint8), axis=1) for i in (0, 1)]
    sketch[d[starts]] = np.hstack(planes).view(np.int64)
    return keys, sketch


def _record(words: int = SKETCH_BITS // 64) -> np.dtype:
    """A record as band entries carry it: one column is written and sorted faster than eight."""
    return np.dtype([("id", "<i8"), ("size", "<i4"), ("sketch", "<u8", (2 * words,))])


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(id, class_key, size, keys, bits, record): one row per record with visible text; bits is its parity bitmap, record its ``_record``."""
    bands, rows = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for ids, texts in _texts(batch):
                n = len(ids)
                h, d = distinct_grams(texts, k)
                size = np.bincount(d, minlength=n)
                ends = np.cumsum(size)
                band_keys, sketches = _sketched(h, d, n, bands, rows)
                keys, cls, bits = [], [], []
                records = np.zeros(n, _record())
                records["id"], records["size"], records["sketch"] = ids, size, sketches.view(np.uint64)
                for i in range(n):
                    bits.append(parity_bitmap(h[ends[i] - size[i] : ends[i]]).tobytes())
                    keys.append(band_keys[i] if size[i] else np.zeros(0, np.int32))
                    own = h[ends[i] - size[i] : ends[i]].tobytes() if size[i] else b"\0" + texts[i].encode("utf-8", "surrogatepass")
                    cls.append(xxhash.xxh3_128_digest(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(cls, pa.binary()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int32())), pa.array(bits, pa.binary()),
                        pa.array([r.tobytes() for r in records], pa.binary()),
                    ],
                    names=["id", "class_key", "size", "keys", "bits", "record"],
                )

    return docs.mapInArrow(run, "id long, class_key binary, size int, keys array<int>, bits binary, record binary")


def bitmap_bits(size: int) -> int:
    """Width of the parity bitmap of a size band: the power of two from twice the size up, 256 at least."""
    return 1 << max(8, int(2 * size - 1).bit_length())


def parity_bitmap(h: np.ndarray) -> np.ndarray:
    bits = np.bincount((h % np.uint64(bitmap_bits(len(h)))).astype(np.int64), minlength=bitmap_bits(len(h))) & 1
    return np.packbits(bits.astype(np.uint8))


def overlap_bound(size_a: np.ndarray, size_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Most sequences the sets of each row can share: every odd bit of the difference is one they do not."""
    while bits_a.shape[1] > bits_b.shape[1]:
        half = bits_a.shape[1] // 2
        bits_a = bits_a[:, :half] ^ bits_a[:, half:]
    while bits_b.shape[1] > bits_a.shape[1]:
        half = bits_b.shape[1] // 2
        bits_b = bits_b[:, :half] ^ bits_b[:, half:]
    apart = np.bitwise_count(bits_a ^ bits_b).sum(axis=1, dtype=np.int64)
    return np.minimum((size_a + size_b - apart) / 2, np.minimum(size_a, size_b))


def _arrays(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(id, grams): sorted sequences of the records whose id may be in the Bloom filter ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.contains(shared.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for ids, texts in _texts(batch):
                h, d = distinct_grams(texts, k)
                cut = np.searchsorted(d, np.arange(len(ids) + 1))
                parts = [h[cut[i] : cut[i + 1]] for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "grams"]
                )

    return docs.mapInArrow(run, "id long, grams binary")


def _bounded(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of (a, b, size_a, bits_a, size_b, bits_b) that the bitmaps leave possible.

    A batch is taken in tiles of one pair of bitmap widths, so a tile is one array operation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size_a, size_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            bits_a, bits_b = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            tiles: dict[tuple[int, int], list[int]] = {}
            for i in range(len(a)):
                tiles.setdefault((len(bits_a[i]), len(bits_b[i])), []).append(i)
            keep = np.zeros(len(a), bool)
            for (wide_a, wide_b), at in tiles.items():
                x = np.frombuffer(b"".join(bits_a[i] for i in at), np.uint8).reshape(-1, wide_a)
                y = np.frombuffer(b"".join(bits_b[i] for i in at), np.uint8).reshape(-1, wide_b)
                keep[at] = overlap_bound(size_a[at], size_b[at], x, y) >= threshold / (1 + threshold) * (size_a[at] + size_b[at]) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return pairs.select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, grams_a, grams_b) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sim = [], [], []
            for x, y, gx, gy in zip(*(c.to_pylist() for c in batch.columns)):
                gx, gy = np.frombuffer(gx, np.uint64), np.frombuffer(gy, np.uint64)
                need = threshold / (1 + threshold) * (len(gx) + len(gy)) - 1e-9
                both = len(np.intersect1d(gx, gy, assume_unique=True))
                if both >= need:
                    a.append(x)
                    b.append(y)
                    sim.append(both / (len(gx) + len(gy) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long, similarity double")


def _apart(w: np.ndarray, i: np.ndarray | slice, j: np.ndarray | slice, planes: range) -> np.ndarray:
    """MinHash values of which the sketches ``w`` (2 x words, n) of i and j hold different bits, over the words ``planes``."""
    words, out = len(w) // 2, 0
    for k in planes:
        out = out + np.bitwise_count((w[k, i] ^ w[k, j]) | (w[k + words, i] ^ w[k + words, j]))
    return out


def _cells_pairs(cell: np.ndarray, side: np.ndarray, size: np.ndarray, w: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i and j of one cell, on different sides if the cell has sides, whose sketches and sizes let them reach the threshold; cells are contiguous."""
    words = len(w) // 2
    first, most = most_apart(threshold, 64 * FIRST_WORDS, FIRST_SLACK), most_apart(threshold)
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    end = np.r_[begin[1:], len(cell)]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        # sets of such different sizes cannot reach the threshold
        ok = (low >= threshold * high - 1e-9) & ((side[i] != side[j]) | (side[i] == 0))
        i, j = i[ok], j[ok]
        ok = _apart(w, i, j, range(FIRST_WORDS)) <= first
        i, j = i[ok], j[ok]
        ok = _apart(w, i, j, range(words)) <= most
        found.append((i[ok], j[ok]))

    # small cells: every row with all later ones, some rows at a time
    left = np.where(np.repeat(end - begin <= SMALL_CELL, end - begin), np.repeat(end, end - begin) - 1 - np.arange(len(cell)), 0)
    rows = np.flatnonzero(left)
    for at in np.array_split(rows, len(rows) // 20_000 + 1):
        i = np.repeat(at, left[at])
        keep(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left[at]) - left[at], left[at]))
    # large ones: tiles of rows by size, up to the last size that can reach the threshold
    for a, z in zip(begin, end):
        if z - a <= SMALL_CELL:
            continue
        order = a + np.argsort(size[a:z], kind="stable")
        own, sizes, n = np.ascontiguousarray(w[:, order]), size[order], len(order)
        high = max(16, min(128, 16_384 // n))
        for i in range(0, n, high):
            last = np.searchsorted(sizes, (sizes[min(n, i + high) - 1] + 1e-6) / threshold, side="right")
            for j in range(i, last, 1024):
                block = np.zeros((min(n, i + high) - i, min(last, j + 1024) - j), np.uint8)
                for k in range(FIRST_WORDS):
                    x = own[k, i : i + high, None] ^ own[k, None, j : min(last, j + 1024)]
                    y = own[k + words, i : i + high, None] ^ own[k + words, None, j : min(last, j + 1024)]
                    np.bitwise_or(x, y, out=x)
                    block += np.bitwise_count(x)
                hit = np.flatnonzero(block <= first)
                p, q = i + hit // block.shape[1], j + hit % block.shape[1]
                later = q > p
                if later.any():
                    keep(order[p[later]], order[q[later]])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _data(column: pa.Array) -> list[pa.Buffer]:
    """Bytes of a binary column of values of one length."""
    if not len(column):
        return []
    wide = _record().itemsize
    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return [column.buffers()[2].slice(first, wide * len(column))]


def _met(entries: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, within the cells of ``entries`` (cell, side, record), partitioned and sorted by cell."""

    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        r = np.frombuffer(b"".join(memoryview(v) for c in t.column(2).chunks for v in _data(c)), _record())
        ids, w = r["id"], np.ascontiguousarray(r["sketch"].T)
        i, j = _cells_pairs(t.column(0).to_numpy(), t.column(1).to_numpy(), np.ascontiguousarray(r["size"]), w, threshold)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a cell that may go on
        at = None
        for batch in batches:
            cells = batch.column(0).to_numpy()
            if not len(cells):
                continue
            cut = int(np.searchsorted(cells, cells[-1]))
            if held and (cut or cells[-1] != at):
                yield pairs([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield pairs([batch.slice(0, cut)])
            held.append(batch.slice(cut))
            at = cells[-1]
        if held:
            yield pairs(held)

    return entries.mapInArrow(run, "a long, b long")


def _dealt(entries: DataFrame) -> DataFrame:
    """(cell, side, record) of ``entries`` (key, id, record).

    A band key of about g x ``HOT`` records is dealt to g groups and each two groups meet in a cell
    of their own, so no task holds more. How many records a key has is estimated from one record in
    16; it only says how finely a key is dealt: every two of its records meet, whatever the estimate.
    """
    some = entries.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0)
    hot = materialize(some.groupBy("key").agg(F.ceil(16 * F.count("*") / HOT).cast("int").alias("g")).where("g > 1"), "hot", free=True)
    if hot.isEmpty():
        return entries.select(F.col("key").alias("cell"), F.lit(0).cast("tinyint").alias("side"), "record")
    e = entries.join(F.broadcast(hot), "key", "left")
    own = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("g")).cast("int")
    e = e.withColumns({"own": own, "other": F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1)))})
    cell = F.when(F.col("g").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("g").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return e.select(cell.alias("cell"), side.cast("tinyint").alias("side"), "record")


def _alike(sig: DataFrame, threshold: float, bands: int) -> DataFrame:
    """Pairs (a, b), a < b, of records of ``sig`` that share a band and whose sketches differ in few values.

    Sketches travel with the band entries; those of one key are compared in tiles, so a pair costs
    some nanoseconds and is not written. Many records take their bands ``PASS_BANDS`` at a time, and
    the shuffle of a pass is gone before the next begins.
    """
    n = sig.count()
    step = bands if n <= FEW else PASS_BANDS
    out = []
    for a in range(0, bands, step):
        keys = F.slice("keys", a + 1, step)
        e = sig.select("id", "record", F.posexplode(keys).alias("band", "key"))
        key = F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        e = e.select(key.alias("key"), "id", "record")
        e = _dealt(e) if n > HOT else e.select(F.col("key").alias("cell"), F.lit(0).cast("tinyint").alias("side"), "record")
        out.append(materialize(_met(e.repartition("cell").sortWithinPartitions("cell"), threshold).distinct(), "candidates", free=True))
    return reduce(DataFrame.unionByName, out).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of class representatives, and every record's class.

    ``docs`` has doc_id (bigint, unique) and text. Returns pairs (a, b, similarity), a < b, of the
    smallest ids of classes, and members (doc_id, class_id, size). Similarity is the share of
    distinct k-word sequences (words: runs of letters or digits, lower case) found in both among
    those found in either. Records with equal sets are one class; records with under k words are
    one class only if their texts are equal. Null and blank texts take no part.
    """
    base = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]"))
    sig = materialize(signatures(base, k, threshold), "signatures")
    several = sig.groupBy("class_key").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1").select("class_key", "class_id")
    copies = sig.select("id", "class_key").join(several, "class_key").where("id != class_id").select("id", "class_id")
    copies = materialize(copies, "copies")
    members = sig.select("id", "size").join(copies, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), "size")
    reps = sig.join(copies.select("id"), "id", "left_anti")
    near = materialize(_alike(reps, threshold, banding(threshold)[0]), "alike")
    maps = sig.select("id", "size", "bits")
    near = near.join(maps.toDF("a", "size_a", "bits_a"), "a").join(maps.toDF("b", "size_b", "bits_b"), "b")
    pairs = materialize(_bounded(near, threshold), "bounded")
    involved = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
    arrays = _arrays(base, k, bloom.build(involved))
    both = pairs.join(arrays.toDF("a", "grams_a"), "a").join(arrays.toDF("b", "grams_b"), "b")
    return materialize(_verified(both, threshold), "similar"), members


def duplicate_pairs(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of records, copies included, that reach the threshold."""
    pairs, members = near_duplicates(docs, k, threshold)
    members = materialize(members.select("doc_id", "class_id"), "members")
    a, b = members.toDF("doc_a", "a"), members.toDF("doc_b", "b")
    across = pairs.join(a, "a").join(b, "b").select("doc_a", "doc_b")
    several = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    same = members.join(several, "class_id", "left_semi").select(F.col("doc_id").alias("doc_a"), F.col("class_id").alias("c"))
    within = same.join(same.select(F.col("doc_a").alias("doc_b"), "c"), "c").where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(within).select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b"))


def duplicate_classes(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links): one row per record with text; links are to other classes."""
    pairs, members = near_duplicates(docs, k, threshold)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    per_class = copies.join(links, "class_id", "left").fillna(0, ["n_links"])
    return members.join(per_class, "class_id").select("doc_id", "class_id", "n_copies", "n_links")
