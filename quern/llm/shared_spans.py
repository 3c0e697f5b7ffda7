"""Problem 10: spans of at least ``least`` words that stand in another record too.

Every window of ``least`` words has one anchor, the smallest hash among its
k-word sequences, which depends on nothing outside the window. Only windows
whose anchor is found in two records can be shared; they are brought together
by anchor, the equal ones merged, and each such shard is a suffix automaton
whose states know whether one or several records own them. A window is shared
where the longest match with another record reaches ``least`` words.

A shard with too many different segments is cut by anchors of more words, in the
end of whole windows, so every shard goes through an automaton of bounded size.

``reference_spans`` is the same search against a stated set of texts: their
automata are broadcast shard by shard and the records stream past.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import bloom
from quern.llm.scratch import materialize
from quern.llm.textkit import grams, mix, slices, spaced_words

_WORD = re.compile(r"\S+")
LEAST_WORDS = 50
ANCHOR_WORDS = 20
#: Different segments of one anchor that one automaton takes; larger shards are cut by longer anchors.
SHARD_SEGMENTS = 1000
#: Words of a reference that one broadcast automaton takes: about 60 MB of it in a task.
REFERENCE_WORDS = 100_000


def _anchored(words: np.ndarray, doc: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the position of each one's anchor, and the anchor's hash."""
    if len(words) < least:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    h = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    value, at = grams(words, doc, k)
    h[at] = value
    start = np.flatnonzero(doc[: len(doc) - least + 1] == doc[least - 1 :])
    width = least - k + 1
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    anchor = np.zeros(len(start), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    for a in range(0, len(start), 65536):
        part = start[a : a + 65536]
        anchor[a : a + 65536] = part + view[part].argmin(axis=1)
    return start, anchor, h[anchor]


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch.column(1).to_pylist()
    for a, z in slices(np.array([len(t) for t in texts], np.int64)):
        yield a, z, texts[a:z]


def anchors(docs: DataFrame, least: int = LEAST_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(anchor, id): the distinct anchors of every record (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, z, texts in _batches(batch):
                words, doc, _, _ = spaced_words(texts)
                _, at, h = _anchored(words, doc, least, k)
                at, first = np.unique(at, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64), pa.int64()), pa.array(ids[a:z][doc[at]], pa.int64())], names=["anchor", "id"])

    return docs.mapInArrow(run, "anchor long, id long")


def segments(docs: DataFrame, least: int = LEAST_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(anchor, id, start, words): windows next to each other with one recurring anchor, as one segment.

    ``docs`` has id, text and wanted, the record's recurring anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for a, z, texts in _batches(batch):
                words, doc, begin, end = spaced_words(texts)
                first_word = np.searchsorted(doc, np.arange(z - a))
                start, at, h = _anchored(words, doc, least, k)
                keep = np.zeros(len(start), bool)
                bounds = np.searchsorted(doc[start], np.arange(z - a + 1)) if len(start) else np.zeros(z - a + 1, np.int64)
                for i in range(z - a):
                    s = slice(bounds[i], bounds[i + 1])
                    keep[s] = np.isin(h[s].view(np.int64), np.array(wanted[a + i].as_py(), np.int64))
                start, at, h = start[keep], at[keep], h[keep]
                if not len(start):
                    continue
                new = np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]
                lo = np.flatnonzero(new)
                hi = np.r_[lo[1:], len(start)] - 1
                d = doc[start[lo]]
                out = []
                for i, s, e in zip(d, start[lo], start[hi] + least):
                    out.append(" ".join(texts[i][begin[s] : end[e - 1]].split()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[lo].view(np.int64), pa.int64()), pa.array(ids[a:z][d], pa.int64()), pa.array((start[lo] - first_word[d]).astype(np.int32), pa.int32()), pa.array(out, pa.string())],
                    names=["anchor", "id", "start", "words"],
                )

    return docs.select("id", "text", "wanted").mapInArrow(run, "anchor long, id long, start int, words string")


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state knows its owner, or that it has several."""

    SEVERAL = -1

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]
        self._longest: list[int] | None = None

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.owner.append(None)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, word) -> int:
        c = self._state(self.length[p] + 1)
        self.next[c] = dict(self.next[q])
        self.link[c], self.owner[c] = self.link[q], self.owner[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, word) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        cur, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return cur

    def _own(self, state: int, owner) -> None:
        had = self.owner[state]
        self.owner[state] = owner if had is None or had == owner else self.SEVERAL

    def add(self, words: list, owner) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            self._own(last, owner)

    def finish(self) -> None:
        """Owners rise along suffix links; then every state learns its longest suffix with several owners."""
        order = np.argsort(np.array(self.length), kind="stable")
        for s in order[::-1]:
            if self.link[s] >= 0 and self.owner[s] is not None:
                self._own(self.link[s], self.owner[s])
        longest = [0] * len(self.link)
        for s in order[1:]:
            longest[s] = self.length[s] if self.owner[s] == self.SEVERAL else longest[self.link[s]]
        self._longest = longest

    def matching_statistics(self, words: list) -> list[int]:
        """Per position the length of the longest match ending there that another owner has too; 0 outside."""
        out, s, n = [], 0, 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            out.append(min(self._longest[s], n))
        return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def shard_matches(segs: list[tuple[int, int | None, str]], least: int) -> list[tuple[int, int, int]]:
    """(segment key, first word, end) of the shared parts of one shard's segments (key, sole owner or None, words)."""
    out = []
    if len(segs) == 1:
        key, owner, words = segs[0]
        return [(key, 0, len(words.split(" ")))] if owner is None else []
    auto, ids = SuffixAutomaton(), {}
    lists = [[ids.setdefault(w, len(ids)) for w in words.split(" ")] for _, _, words in segs]
    for (_, owner, _), ws in zip(segs, lists):
        auto.add(ws, SuffixAutomaton.SEVERAL if owner is None else ("one", owner))
    auto.finish()
    for (key, _, _), ws in zip(segs, lists):
        ends = np.array(auto.matching_statistics(ws)) >= least
        for a, b in _runs(ends):
            out.append((key, a - least + 1, b))
    return out


def _shards(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    anchor, group, out = None, [], []

    def flush():
        for key, a, b in shard_matches(group, least):
            out.append((anchor, key, a, b))

    for batch in batches:
        for an, key, owner, words in zip(*(c.to_pylist() for c in batch.columns)):
            if an != anchor:
                flush()
                anchor, group = an, []
            group.append((key, owner, words))
        yield _matches(out)
        out = []
    flush()
    yield _matches(out)


def _matches(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "seg", "lo", "hi"])


def _by_shard(kinds: DataFrame, least: int) -> DataFrame:
    """(anchor, seg, lo, hi): the shared parts of the segments of ``kinds`` (anchor, seg, owner, words), by automaton."""
    ordered = kinds.select("anchor", "seg", "owner", "words").repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(lambda b: _shards(b, least), "anchor long, seg long, lo int, hi int")


def _longer_anchors(kinds: DataFrame, least: int, k: int) -> DataFrame:
    """(anchor, seg, inner, id, start, words): the segments of ``kinds`` cut by anchors of k words; inner is the new anchor.

    Equal windows have equal anchors of any length, so none that match are parted. id is lo_id or, for a
    segment that several records own, both lo_id and hi_id.
    """
    owners = F.array_distinct(F.array("lo_id", "hi_id"))
    docs = kinds.select("anchor", "seg", F.monotonically_increasing_id().alias("row"), "words", owners.alias("owners"))
    docs = materialize(docs, "large-shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer, rows, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            words, doc, begin, end = spaced_words(texts)
            first_word = np.searchsorted(doc, np.arange(len(texts)))
            start, at, h = _anchored(words, doc, least, k)
            if not len(start):
                continue
            lo = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
            hi = np.r_[lo[1:], len(start)] - 1
            d = doc[start[lo]]
            inner = mix(h[lo] ^ outer[d].view(np.uint64)).view(np.int64)
            out = [texts[i][begin[s] : end[e - 1]] for i, s, e in zip(d, start[lo], start[hi] + least)]
            yield pa.RecordBatch.from_arrays([pa.array(inner), pa.array(rows[d]), pa.array((start[lo] - first_word[d]).astype(np.int32)), pa.array(out, pa.string())], names=["inner", "row", "at", "part"])

    parts = docs.select("anchor", "row", "words").mapInArrow(run, "inner long, row long, at int, part string")
    return parts.join(docs.select("row", "anchor", "seg", F.explode("owners").alias("id")), "row").select("anchor", "seg", "inner", "id", "at", "part")


def _kinds(segs: DataFrame) -> DataFrame:
    """(anchor, seg, lo_id, hi_id, words, owner): different segments of each anchor; owner is null where several records have it."""
    kinds = segs.groupBy("anchor", "seg").agg(F.min("id").alias("lo_id"), F.max("id").alias("hi_id"), F.min("words").alias("words"))
    return materialize(kinds.withColumn("owner", F.when(F.col("lo_id") == F.col("hi_id"), F.col("lo_id"))), "shards")


def _matches_of(kinds: DataFrame, least: int, k: int) -> DataFrame:
    """(anchor, seg, lo, hi) of shards of any size; k is the length of their anchors."""
    if k >= least:
        # one whole window each: what several records own is shared
        return kinds.where("owner is null").select("anchor", "seg", F.lit(0).alias("lo"), F.lit(least).alias("hi"))
    large = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_SEGMENTS).select("anchor"), "large-anchors")
    if large.isEmpty():
        return _by_shard(kinds, least)
    usual = _by_shard(kinds.join(large, "anchor", "left_anti"), least)
    longer = min(least, k + max(1, (least - k + 1) // 2))
    parts = materialize(_longer_anchors(kinds.join(large, "anchor", "left_semi"), least, longer), "parts")
    inner = parts.select(F.col("inner").alias("anchor"), "id", F.col("part").alias("words")).withColumn("seg", F.xxhash64("words"))
    found = _matches_of(_kinds(inner), least, longer).toDF("inner", "inner_seg", "lo", "hi")
    back = parts.withColumn("inner_seg", F.xxhash64("part")).join(found, ["inner", "inner_seg"])
    return usual.unionByName(back.select("anchor", "seg", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).distinct())


def shared_spans(docs: DataFrame, least: int = LEAST_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words): the longest runs of words that lie in shared spans.

    ``docs`` has doc_id (bigint, unique) and text. Words are pieces between white space, counted
    from 0. Spans repeated within one record only do not count; null, blank and short texts share
    nothing. Equal records share everything if they have ``least`` words.
    """
    base = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null and text is not null")
    found = materialize(anchors(base, least, k), "anchors")
    recurring = found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("anchor")
    wanted = materialize(found.join(recurring, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("wanted")), "recurring")
    few = bloom.thin(base, "id", bloom.build(wanted.select("id")))
    segs = materialize(segments(few.join(wanted, "id"), least, k).withColumn("seg", F.xxhash64("words")), "segments")
    matches = _matches_of(_kinds(segs), least, k)
    at = segs.select("anchor", "seg", "id", "start").join(matches, ["anchor", "seg"])
    spans = at.select("id", (F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi")).alias("z"))
    return _merged(spans)


def _merged(spans: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words): overlapping and touching spans (id, a, z) as one."""
    order = Window.partitionBy("id").orderBy("a", "z")
    reach = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    return (
        spans.groupBy("id", "run")
        .agg(F.min("a").alias("a"), F.max("z").alias("z"))
        .select(F.col("id").alias("doc_id"), F.col("a").cast("int").alias("start_word"), (F.col("z") - F.col("a")).cast("int").alias("n_words"))
    )


def reference_shards(texts: list[str], shard_words: int = REFERENCE_WORDS) -> list[list[str]]:
    """The texts in shards of about ``shard_words`` words; a longer text is a shard of its own."""
    shards, size = [[]], 0
    for t in texts:
        n = len(t.split())
        if shards[-1] and size + n > shard_words:
            shards.append([])
            size = 0
        shards[-1].append(t)
        size += n
    return shards


def reference_spans(docs: DataFrame, reference: list[str], least: int = LEAST_WORDS, shard_words: int = REFERENCE_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words): spans of ``docs`` (doc_id, text) that stand in a text of ``reference``, a stated set that fits the driver.

    One pass over the records for every shard, so for few references only: ``shared_spans`` brings
    records together by anchor instead.
    """
    out = None
    for shard in reference_shards([t for t in reference if t and t.strip()], shard_words):
        if not shard:
            continue
        auto, ids = SuffixAutomaton(), {}
        for t in shard:
            auto.add([ids.setdefault(w, len(ids)) for w in t.split()], SuffixAutomaton.SEVERAL)
        auto.finish()
        shared = docs.sparkSession.sparkContext.broadcast((auto.next, auto.link, auto.length, auto._longest, ids))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto = SuffixAutomaton()
            auto.next, auto.link, auto.length, auto._longest, ids = shared.value
            for batch in batches:
                rows = []
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ends = np.array(auto.matching_statistics([ids.get(w, -1) for w in t.split()]), np.int64) >= least
                    rows += [(doc, a - least + 1, b) for a, b in _runs(ends)]
                cols = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], names=["id", "a", "z"])

        found = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "id long, a int, z int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, start_word int, n_words int")
    return _merged(out)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed): every record without the words of its ``spans`` (doc_id, start_word, n_words).

    What is left keeps its own white space; a record without spans stays as it is, null texts null.
    """
    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = 0
                if t is not None and found:
                    at = [m.span() for m in _WORD.finditer(t)]
                    for s in sorted(found, key=lambda s: -s["start_word"]):
                        lo, hi = at[s["start_word"]][0], at[s["start_word"] + s["n_words"] - 1][1]
                        t, n = t[:lo] + t[hi:], n + s["n_words"]
                texts.append(t)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "n_removed"])

    return docs.select("doc_id", "text").join(own, "doc_id", "left").mapInArrow(run, "doc_id long, text string, n_removed int")


def shared_share(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_shared, share): how much of every record with text is shared elsewhere."""
    spans = shared_spans(docs, least).groupBy("doc_id").agg(F.sum("n_words").alias("n_shared"))
    words = F.size(F.filter(F.split("text", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    sizes = docs.where("text is not null and doc_id is not null").select("doc_id", words.cast("long").alias("n_words"))
    return sizes.join(spans, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.round(F.coalesce("n_shared", F.lit(0)) / F.greatest("n_words", F.lit(1)), 6).alias("share")
    )
