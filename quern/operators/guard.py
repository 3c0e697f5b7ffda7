"""Checking what comes in: ordered validation and a rate limit per key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
LINK = r"(?i)(?:https?://|www\.)"


def link_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(LINK)), F.lit(0))


def has_keyword(text: Column, keywords: Iterable[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out |= F.lower(text).contains(k)
    return F.coalesce(out, F.lit(False))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check (name, passes) that fails or cannot be decided; null if all pass."""
    out = F.lit(None).cast("string")
    for name, passes in reversed(checks):
        out = F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def message_checks(keywords: Iterable[str], honeypot: str = "company", least_age_ms: int = 3500, most_links: int = 2) -> list[tuple[str, Column]]:
    """The checks of a contact message (name, email, subject, message, the honeypot, age_ms), in order."""

    def size(c: str) -> Column:
        return F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))

    both = F.concat_ws(" ", "subject", "message")
    return [
        ("honeypot", size(honeypot) == 0),
        ("too fast", F.col("age_ms") >= least_age_ms),
        ("name", size("name").between(1, 120)),
        ("email", (size("email") <= 254) & F.trim("email").rlike(EMAIL)),
        ("subject", size("subject") <= 160),
        ("message", size("message").between(10, 3000)),
        ("links", link_count(F.col("message")) <= most_links),
        ("keywords", ~has_keyword(both, keywords)),
    ]


def client_key(forwarded: Column, *others: Column) -> Column:
    """The first address of a forwarding header, else of the other headers, else unknown."""

    def filled(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return F.coalesce(filled(F.get(F.split(forwarded, ","), 0)), *[filled(o) for o in others], F.lit("unknown"))


class FixedWindow:
    """A window that opens with the first accepted event and takes ``most`` in ``length`` microseconds."""

    __slots__ = ("count", "most", "length", "reset_at")

    def __init__(self, most: int, length: int, count: int = 0, reset_at: int = 0) -> None:
        self.most, self.length, self.count, self.reset_at = most, length, count, reset_at

    def accept(self, at: int) -> bool:
        if self.count and at >= self.reset_at:
            self.count = 0
        if self.count >= self.most:
            return False
        if not self.count:
            self.reset_at = at + self.length
        self.count += 1
        return True


def rate_limit(events: DataFrame, key: str, at: str, order: Iterable[str] = (), most: int = 5, seconds: int = 600, exempt: Column | None = None) -> DataFrame:
    """``events`` with accepted: at most ``most`` of a key within ``seconds`` of the first accepted one.

    Events go by ``at`` then ``order``; the window is neither aligned to the clock nor to gaps, so each
    key is followed in time (sequential by its definition: what is accepted decides when the next window
    opens). Rows stream through in sorted partitions, a key's state is two numbers and
    no key is held in memory. A null key is a key; a null time comes first and opens a window at 0.
    """
    others = [c for c in events.columns if c not in ("accepted", "_exempt", "_us")]
    free = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    rows = events.select(*others, free.alias("_exempt"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0)).alias("_us"))
    schema = events.select(*others).schema.add("accepted", "boolean")
    at_key, n = others.index(key), len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, window = object(), FixedWindow(most, seconds * 1_000_000)
        for batch in batches:
            out = []
            for k, free_row, us in zip(batch.column(at_key).to_pylist(), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                if k != current:
                    current, window = k, FixedWindow(most, seconds * 1_000_000)
                out.append(bool(free_row) or window.accept(us))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.bool_())], names=[*others, "accepted"])

    return rows.repartition(key).sortWithinPartitions(key, "_us", *order).mapInArrow(run, schema)
