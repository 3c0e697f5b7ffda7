from __future__ import annotations

import random

from pyspark.sql import functions as F

from quern.operators import guard
from quern.streaming.limiter import rate_limit_stream


def plain(events, most, seconds):
    """The rule itself, event by event."""
    out, opened = {}, {}
    for key, at, n in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        count, reset = opened.get(key, (0, 0))
        if count and at >= reset:
            count = 0
        out[n] = count < most
        if out[n]:
            opened[key] = (count + 1, reset if count else at + seconds)
        else:
            opened[key] = (count, reset)
    return out


def _frame(spark, events):
    rows = spark.createDataFrame([(k, at, n) for k, at, n in events], "key string, s long, n long")
    return rows.select("key", F.timestamp_seconds("s").alias("at"), "n", F.lit("x").alias("accepted"))


def test_rate_limit_like_the_rule(spark):
    rng = random.Random(1)
    events = [(rng.choice(["a", "b", "hot", "hot", "hot"]), 1_000_000 + rng.randrange(4000), n) for n in range(600)]
    got = {r.n: r.accepted for r in guard.rate_limit(_frame(spark, events), "key", "at", ["n"], 3, 100).collect()}
    assert got == plain(events, 3, 100)
    free = guard.rate_limit(_frame(spark, events), "key", "at", ["n"], 3, 100, exempt=F.col("key") == "hot").where("key = 'hot' and not accepted")
    assert free.count() == 0


def test_rate_limit_of_nulls_and_nothing(spark):
    assert guard.rate_limit(_frame(spark, []), "key", "at").count() == 0
    got = guard.rate_limit(_frame(spark, [(None, 10, 1), (None, 11, 2), ("a", None, 3)]), "key", "at", ["n"], 1, 100).collect()
    assert {r.n: r.accepted for r in got} == {1: True, 2: False, 3: True}


def test_stream_like_batch(spark, tmp_path):
    rng = random.Random(2)
    events = sorted(((rng.choice(["a", "b"]), 1_000_000 + rng.randrange(3000), n) for n in range(200)), key=lambda e: e[1])
    source = tmp_path / "in"
    for i in range(0, 200, 50):
        _frame(spark, events[i : i + 50]).drop("accepted").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("key string, at timestamp, n long").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = rate_limit_stream(stream, "key", "at", "n", 2, 200, "2 hours").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_id: r.accepted for r in spark.sql("select * from limited").collect()} == plain(events, 2, 200)


def test_validation_order(spark):
    rows = spark.createDataFrame([("", "n", "a@b.c", "s", "long enough text", 5000), ("x", "", "", "", "", 0), ("", "n", "bad", "s", "long enough text", 5000), ("", "n", "a@b.c", "s", "www. www. www. text", 5000), (None, "n", "a@b.c", None, "win the lottery now", 5000)], "company string, name string, email string, subject string, message string, age_ms int")
    got = [r[0] for r in rows.select(guard.first_failure(guard.message_checks(["lottery"]))).collect()]
    assert got == [None, "honeypot", "email", "links", "keywords"]
