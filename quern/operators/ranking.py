"""First-wins de-duplication, ordered merges and pages: the order-sensitive operators.

Order is always a column; ties are broken by the columns the caller names, and
no result depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key by ``order``. Null keys are equal to each other.

    Done as an aggregation (minimum of order and row), which combines before the shuffle, so a key
    that holds most rows is no burden. ``order`` must tell rows of a key apart.
    """
    cols = rows.columns
    names = [f"_k{i}" for i in range(len(key))]
    keyed = rows.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(key, names)])
    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    best = keyed.groupBy(*names).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(sort)])).alias("_r"))
    return best.select("_r.*")


def ordered_union(parts: Sequence[DataFrame], key: Sequence[str], order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows of all parts, earlier parts first, each key once; with ``position`` 0.. and at most ``limit`` rows."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    once = first_wins(both, key, ["_part", *order])
    if limit is None:
        return numbered(once, ["_part", *order]).drop("_part")
    return positioned(once.orderBy("_part", *order).limit(limit), ["_part", *order]).drop("_part")


def positioned(rows: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Rows of a small result numbered 0.. in order (one task: only for what a limit or a list page bounds)."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


#: Ranges into which rows are cut to be numbered.
RANGES = 256


def numbered(rows: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Rows of any number, numbered 0.. by the ``order`` columns, which tell them apart.

    A bounded sample of the keys cuts the order into ranges; each range is ranked by itself and
    begins where the counts of the ranges before it end.
    """
    key = F.struct(*[F.col(o) for o in order])
    bounds = rows.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(RANGES - 1).agg(F.collect_set("k").alias("_bounds"))
    cut = rows.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < key))).drop("_bounds")
    ranked = cut.withColumn("_within", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    return ranked.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_within") - 1).cast("int")).drop("_range", "_within", "_start")


def page(rows: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0, most: int = 400) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` in order; the limit is kept within 1 and ``most``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The k first rows of every group, with their rank from 1 (cut before the shuffle by the optimizer)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)
