from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quern.llm import site_lines, skeleton

DOC = "doc_id long, text string, url string, source string, site string"


def plain_lines(rows):
    """The definition, document by document."""
    docs, at = defaultdict(set), []
    sizes = Counter()
    for doc, text, site in rows:
        if site is None:
            continue
        sizes[site] += 1
        for no, line in enumerate((text or "").split("\n"), 1):
            key = re.sub(r"[\W\d_]+", "", line.lower())
            if text is not None and key:
                docs[site, key].add(doc)
                at.append((doc, no, site, key))
    good = {k for k, v in docs.items() if len(v) >= 5 and len(v) / sizes[k[0]] >= 0.04}
    return {(doc, no) for doc, no, site, key in at if (site, key) in good}


def test_lines_of_a_skewed_site(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        site = "hot.example" if rng.random() < 0.7 else f"s{rng.randrange(4)}.example"
        lines = [f"body {rng.choice('abcdefgh')}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} unique" for _ in range(rng.randrange(4))]
        for n, p in enumerate((0.5, 0.05, 0.04, 0.035, 0.01)):
            if rng.random() < p:
                lines.append(rng.choice([f"Line {'abcde'[n]}!", f"LINE {'abcde'[n]} {i}"]))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines) if rng.random() > 0.02 else None, f"HTTPS://www.{site}:80/p?x#y", "src", "clash"))
    rows.append((10_000, "Line a!", None, None, None))
    got = {(r.doc_id, r.line_no) for r in site_lines.repeated_lines(spark.createDataFrame(rows, DOC).repartition(7)).collect()}
    want = plain_lines([(d, t, site_lines_host(u, s)) for d, t, u, s, _ in rows])
    assert got == want and want
    clean = {r.doc_id: r.text for r in site_lines.without_repeated_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert len(clean) == len(rows)
    for d, t, _, _, _ in rows:
        assert clean[d] == (None if t is None else "\n".join(v for n, v in enumerate(t.split("\n"), 1) if (d, n) not in want))


def site_lines_host(url, source):
    return re.sub(r"^www\.", "", re.sub(r"^[a-z]+://", "", url.lower()).split("/")[0].split(":")[0]) if url else source


def test_sites(spark):
    rows = [("https://www.A.example:8080/x", "s"), ("a.example/x", "s"), ("//a.example?q", "s"), ("HTTP://u:p@a.example", "s"), (None, "s"), ("", "s"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string, s string").select(site_lines.site_of(F.col("u"), F.col("s"))).collect()]
    assert got == ["a.example"] * 4 + ["s", "s", None]


def test_pruning_loses_no_frequent_line():
    """A summary that prunes all the time still holds every line over the threshold."""
    s = site_lines._Summary()
    rng = random.Random(1)
    for i in range(4000):
        s.docs += 1
        for k in {("often" if rng.random() < 0.041 else i), *(rng.randrange(10**9) for _ in range(3))}:
            s.counts[k] = s.counts.get(k, 0) + 1
        if len(s.counts) > 300:
            s.prune()
    s.prune()
    assert s.counts["often"] + s.error >= 0.04 * 4000 * 0.95 and len(s.counts) < 300 and s.error <= site_lines.SUMMARY_ERROR * s.docs


def test_empty_and_long_texts(spark):
    empty = spark.createDataFrame([], DOC)
    assert site_lines.repeated_lines(empty).count() == 0 and site_lines.without_repeated_lines(empty).count() == 0
    long = "\n".join(["same line"] + [f"word {i}" for i in range(50_000)])
    rows = [(i, long if i == 0 else "Same LINE.", "x.example", None, None) for i in range(6)]
    assert {tuple(r) for r in site_lines.repeated_lines(spark.createDataFrame(rows, DOC)).where("line_no = 1").select("doc_id", "line_no").collect()} == {(i, 1) for i in range(6)}


def test_skeletons():
    same = [("ﬁne", "fine"), ("ＡＢ１", "AB1"), ("é", "é"), ("a b c", "a b c"), ("zero​width­", "zerowidth"), ("Аррlе", "Apple"), ("ΤΟΚΕΝ", "TOKEN"), ("ﻻ", "لا"), ("کتاب", "كتاب"), ("بیت", "بيت"), ("فتی", "فتى"), ("أ", "أ")]
    for a, b in same:
        assert skeleton.skeleton(a) == skeleton.skeleton(b), (a, b)
    for a, b in [("أ", "ا"), ("ة", "ه"), ("على", "علي"), ("فتی", "فتي"), ("كَ", "ك"), ("a  b", "a b"), ("l", "I"), ("0", "O"), ("é", "e")]:
        assert skeleton.skeleton(a) != skeleton.skeleton(b), (a, b)
    for t in ("plain", "ＡＢﬁ", "Αρχή", "", None):
        assert skeleton.skeleton(skeleton.skeleton(t)) == skeleton.skeleton(t)


def test_look_alikes(spark):
    rows = [("b", "ＡＢ", 1), ("a", "AB", 1), ("a", "AB", 1), ("c", "AB", 1), ("d", "xy", 1), ("e", None, 1), (None, "AB", 1), ("f", "", 1), ("a", "А​В", 1)]
    df = spark.createDataFrame(rows, "id string, text string, form int")
    assert {tuple(r) for r in skeleton.look_alikes(df, "id", "text").collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    forms = {(r.id, r.skeleton, r.class_id, r.n_in_class) for r in skeleton.canonical(df, "id", "text").collect()}
    assert ("b", "AB", "a", 4) in forms or ("b", "AB", "a", 3) in forms
    assert ("e", None, None, None) in forms
    assert skeleton.look_alikes(df.limit(0), "id", "text").count() == 0
