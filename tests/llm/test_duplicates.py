from __future__ import annotations

import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bloom, near_duplicates, shared_spans, textkit

WORD = re.compile(r"[^\W_]+")


def grams(text, k):
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    texts = []
    for i in range(n):
        if i > 20 and rng.random() < 0.6:
            w = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.randrange(0, max(2, len(w) // 9))):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [rng.choice(vocab)]
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 160))))
    return texts


def similar(texts, k, threshold):
    sets = {i: grams(t, k) for i, t in texts if t and t.strip()}
    raw = dict(texts)
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (x or y) and len(x & y) >= threshold * len(x | y) or raw[a] == raw[b]:
            out.add((a, b))
    return out


def test_pairs_like_brute_force(spark):
    texts = list(enumerate(corpus())) + [(1000, None), (1001, "  "), (1002, "one two"), (1003, "one two"), (1004, "One two"), (1005, "!!"), (1006, "!!")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, class_id string").repartition(5)
    for k, threshold in ((3, 0.5), (5, 0.8)):
        want = similar(texts, k, threshold)
        got = {tuple(sorted(r)) for r in near_duplicates.duplicate_pairs(df, k, threshold).collect()}
        assert got <= want and len(got) >= 0.99 * len(want), (len(got), len(want))
    classes = {r.doc_id: r for r in near_duplicates.duplicate_classes(df, 3, 0.5).collect()}
    assert len(classes) == len([t for _, t in texts if t and t.strip()]) and classes[1002].n_copies == 2 and classes[1004].n_copies == 1


def test_large_family_of_reworked_texts(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(170)]
    texts = [" ".join(base)]
    for _ in range(99):
        w = list(base)
        for at in rng.sample(range(170), 10):
            w[at] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts = list(enumerate(texts + [" ".join(rng.choice(vocab) for _ in range(170)) for _ in range(200)]))
    want = similar(texts, 3, 0.5)
    got = {tuple(sorted(r)) for r in near_duplicates.duplicate_pairs(spark.createDataFrame(texts, "doc_id long, text string"), 3, 0.5).collect()}
    assert {(0, i) for i in range(1, 100)} <= want and len(want) > 1000
    assert got <= want and len(got) >= 0.99 * len(want), (len(got), len(want))


def test_common_passage_hides_no_pair(spark):
    """Unlike texts share one passage; pairs of them are alike because of it and of a part of their own."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(20_000)]
    passage = [rng.choice(vocab) for _ in range(90)]
    texts = []
    for _ in range(300):
        own = [rng.choice(vocab) for _ in range(90)]
        texts.append(passage + own)
        texts.append(passage + own[:55] + [rng.choice(vocab) for _ in range(35)])
    texts = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {tuple(sorted(r)) for r in near_duplicates.duplicate_pairs(spark.createDataFrame(texts, "doc_id long, text string"), 3, 0.5).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(300)}


def test_bands_for_any_threshold():
    for threshold in (0.1, 0.3, 0.5, 0.7, 0.8, 0.95):
        bands, rows = near_duplicates.banding(threshold)
        assert (1 - threshold**rows) ** bands <= near_duplicates.MISSED


def test_hot_class_is_not_multiplied(spark):
    rows = [(i, "the very same text in a third of all rows") for i in range(3000)] + [(5000 + i, t) for i, t in enumerate(corpus(2, 60))]
    got = near_duplicates.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.5)
    assert got.where("class_id = 0").count() == 3000 and got.where("class_id = 0").first().n_copies == 3000


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates.duplicate_pairs(empty, 3, 0.5).count() == 0
    assert near_duplicates.duplicate_classes(empty).count() == 0
    assert shared_spans.shared_spans(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 200))
def test_bitmaps_bound_the_overlap(a, b, shared):
    b |= set(itertools.islice(a, shared))
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    bits = [np.frombuffer(near_duplicates.parity_bitmap(v).tobytes(), np.uint8)[None, :] for v in (x, y)]
    bound = near_duplicates.overlap_bound(np.array([len(x)]), np.array([len(y)]), *bits)[0]
    assert bound >= len(a & b)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab C.é١_\n\U0001f600", max_size=30), min_size=1, max_size=6))
def test_words_like_python(texts):
    h, doc = textkit.folded_words(texts)
    words = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t.lower())]
    assert [i for i, _ in words] == doc.tolist()
    by_hash = {}
    for (_, w), v in zip(words, h.tolist()):
        assert by_hash.setdefault(v, w) == w
    _, d, s, e = textkit.spaced_words(texts)
    assert [texts[i][a:b] for i, a, b in zip(d, s, e)] == [w for t in texts for w in t.split()]


def spans(texts, least):
    seen = {}
    words = {i: t.split() for i, t in texts if t}
    for i, w in words.items():
        for p in range(len(w) - least + 1):
            seen.setdefault(tuple(w[p : p + least]), set()).add(i)
    out = set()
    for i, w in words.items():
        flags = np.zeros(len(w) + 2, np.int8)
        for p in range(len(w) - least + 1):
            if len(seen[tuple(w[p : p + least])]) > 1:
                flags[p + 1 : p + least + 1] = 1
        edge = np.flatnonzero(np.diff(flags))
        out |= {(i, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])}
    return out


def span_corpus(seed):
    rng = random.Random(seed)
    vocab = [str(i) for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(10, 200))] for _ in range(25)]
    texts = []
    for i in range(150):
        w = list(rng.choice(base)) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.5:
            other = rng.choice(base)
            a = rng.randrange(len(other))
            at = rng.randrange(len(w) + 1)
            w[at:at] = other[a : a + rng.randrange(120)]
        if rng.random() < 0.3 and w:
            w[rng.randrange(len(w))] = "changed"
        if rng.random() < 0.1:
            w = w + w
        texts.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return texts


def test_spans_like_brute_force(spark, monkeypatch):
    texts = span_corpus(4) + [(900, None), (901, " "), (902, "a " * 80)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, anchor string").repartition(4)
    want = spans(texts, 50)
    assert {tuple(r) for r in shared_spans.shared_spans(df).collect()} == want and len(want) > 50
    # shards too large for an automaton take the other way and find the same
    monkeypatch.setattr(shared_spans, "SHARD_SEGMENTS", 1)
    assert {tuple(r) for r in shared_spans.shared_spans(df).collect()} == want
    share = {r.doc_id: r for r in shared_spans.shared_share(df).collect()}
    assert share[902].n_shared == 0 and share[901].n_words == 0 and 900 not in share


def test_spans_of_equal_texts(spark):
    text = " ".join(str(i) for i in range(60))
    rows = [(i, text) for i in range(2000)] + [(9000, " ".join(str(i) for i in range(10, 60))), (9001, " ".join(str(i) for i in range(11, 60)))]
    got = {tuple(r) for r in shared_spans.shared_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0, 60) for i in range(2000)} | {(9000, 0, 50)}


def test_spans_of_a_reference_and_without_spans(spark):
    texts = span_corpus(7) + [(900, None), (901, " "), (902, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_words int")
    reference = [t for _, t in texts[:40]]
    windows = {tuple(w[p : p + 50]) for w in (t.split() for t in reference) for p in range(len(w) - 49)}
    want = set()
    for i, t in texts:
        w, flags = (t or "").split(), np.zeros(len((t or "").split()) + 2, np.int8)
        for p in range(len(w) - 49):
            if tuple(w[p : p + 50]) in windows:
                flags[p + 1 : p + 51] = 1
        edge = np.flatnonzero(np.diff(flags))
        want |= {(i, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])}
    for shard_words in (500, 10**6):
        assert {tuple(r) for r in shared_spans.reference_spans(df, reference, shard_words=shard_words).collect()} == want
    assert shared_spans.reference_spans(df, ["", None]).count() == 0
    cut = {r.doc_id: r for r in shared_spans.without_spans(df, shared_spans.reference_spans(df, reference)).collect()}
    assert len(cut) == len(texts) and cut[900].text is None and cut[901].text == " "
    for i, t in texts[:150]:
        drop = {p for j, a, n in want if j == i for p in range(a, a + n)}
        assert cut[i].text.split() == [w for p, w in enumerate(t.split()) if p not in drop] and cut[i].n_removed == len(drop)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4))
def test_automaton_matching_statistics(seqs):
    auto = shared_spans.SuffixAutomaton()
    for i, s in enumerate(seqs):
        auto.add(s, i)
    auto.finish()

    def inside(part, other):
        return any(other[p : p + len(part)] == part for p in range(len(other) - len(part) + 1))

    for i, s in enumerate(seqs):
        want = []
        for end in range(1, len(s) + 1):
            want.append(max((n for n in range(end + 1) if any(inside(s[end - n : end], o) for j, o in enumerate(seqs) if j != i)), default=0))
        assert auto.matching_statistics(s) == want


def test_bloom_filter(spark):
    keys = spark.range(0, 5000, 7)
    bits = bloom.build(keys)
    all_keys = np.arange(5000)
    hit = bloom.contains(bits, all_keys)
    assert hit[::7].all() and hit.mean() < 0.2


def test_unlike_texts_of_common_sequences_are_no_candidates(spark, monkeypatch):
    """Texts of the same stock phrases meet in bands; only pairs near the threshold are written, whatever passes and dealt keys there are."""
    rng = random.Random(3)
    stock = [" ".join(f"v{rng.randrange(3000)}" for _ in range(8)) for _ in range(90)]
    texts = [" ".join(rng.choice(stock) for _ in range(22)) for _ in range(1500)]
    texts += [t.rsplit(" ", 16)[0] for t in texts[:60]]
    sets = [grams(t, 3) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    counts = []

    def counted(df, label, *args, **more):
        out = materialize(df, label, *args, **more)
        counts.append(out.count() if label == "candidates" else 0)
        return out

    materialize = near_duplicates.materialize
    monkeypatch.setattr(near_duplicates, "materialize", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sizes in ({}, {"FEW": 100, "HOT": 64}, {"FEW": 100, "HOT": 64, "SMALL_CELL": 2}):
        counts.clear()
        for name, value in sizes.items():
            monkeypatch.setattr(near_duplicates, name, value)
        got = {tuple(sorted(r)) for r in near_duplicates.duplicate_pairs(df, 3, 0.5).collect()}
        assert got <= want and len(got) >= 0.99 * len(want), (len(got), len(want))
        assert sum(counts) < 8 * len(want) + 100, (sum(counts), len(want))
