"""Problem 8: putting items of varying length into containers of fixed capacity.

Harmonic packing: lengths fall into classes, and every bin of a kind takes a
fixed number of items of each class, so workers fill bins independently from
the items' ranks alone. Classes by reciprocals of the capacity (one item over a
half, two over a third, ...) left 10 to 14 % of the room unused on sf0.1, so the
reciprocal classes are cut into levels of 1/512 of the capacity and a kind of bin
may combine levels: the kinds come from the histogram of levels, which is of
fixed size whatever the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.ranks import ranked
from quern.llm.scratch import materialize

#: Levels of a capacity; a level's items are taken as large as its upper end.
LEVELS = 512
#: Small items in a unit, and the levels up to which items are small.
BUNDLE, SMALL_LEVELS = 8, 8


def bin_kinds(counts: dict[int, int], levels: int = LEVELS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of bins for a histogram of levels: (number of bins, [(level, items in each)]).

    First fit by falling level, a whole level at a time: a kind takes as many of the largest
    remaining items as fit, then of the next, and is repeated until one of its levels runs short.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    kinds = []
    while left:
        room, use = levels, []
        for level in sorted(left, reverse=True):
            fit = min(room // level, left[level])
            if fit:
                use.append((level, fit))
                room -= fit * level
        times = min(left[level] // n for level, n in use)
        kinds.append((times, use))
        for level, n in use:
            left[level] -= times * n
            if not left[level]:
                del left[level]
    return kinds


def pack(items: DataFrame, bins: list[tuple[str, int]], levels: int = LEVELS) -> DataFrame:
    """(bin_name, bin_no, reciprocal_class, doc_id, part_no, start_token, n_tokens).

    ``items`` has doc_id and n_tokens; items without tokens are left out. An item larger than the
    capacity is cut into full containers and a rest; no other item is cut. Bins of one name are
    numbered from 0 without gaps. A doc_id given twice is two items.
    """
    spark = items.sparkSession
    schema = "bin_name string, bin_no long, reciprocal_class int, doc_id long, part_no int, start_token long, n_tokens long"
    bins = [(name, cap) for name, cap in dict(bins).items() if name is not None and cap and cap > 0]
    if not bins:
        return spark.createDataFrame([], schema)
    kinds = F.array(*[F.struct(F.lit(n).alias("bin_name"), F.lit(c).cast("long").alias("capacity")) for n, c in bins])
    sized = items.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0").withColumn("bin", F.explode(kinds)).select("doc_id", "n_tokens", "bin.*")
    n_parts = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int")
    parts = sized.withColumn("part_no", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    start = F.col("part_no") * F.col("capacity")
    parts = parts.select("bin_name", "capacity", "doc_id", "part_no", start.alias("start_token"), F.least(F.col("capacity"), F.col("n_tokens") - start).alias("n_tokens"))
    fine = F.ceil(F.col("n_tokens") * (levels * BUNDLE) / F.col("capacity")).cast("int")
    # positive classes are levels, negative ones the finer classes of small items
    cls = F.when(fine <= SMALL_LEVELS * BUNDLE, -fine).otherwise(F.ceil(fine / F.lit(BUNDLE)).cast("int"))
    parts = parts.withColumns({"cls": cls, "item": F.struct("doc_id", "part_no")})
    counts: dict[str, dict[int, int]] = {}
    for r in parts.groupBy("bin_name", "cls").count().collect():
        counts.setdefault(r.bin_name, {})[r.cls] = r["count"]
    rows = [(name, *row) for name, c in counts.items() for row in place_classes(c, levels)]
    if not rows:
        return spark.createDataFrame([], schema)
    place = "array<struct<from_unit: long, in_each: long, first_bin: long>>"
    table = spark.createDataFrame(rows, f"bin_name string, cls int, bundled long, bundle_from long, bundles {place}, single_from long, singles {place}")
    placed = ranked(parts, ["bin_name", "cls"], "item").join(F.broadcast(table), ["bin_name", "cls"])
    in_bundle = F.col("rank") < F.col("bundled")
    unit = F.when(in_bundle, F.col("bundle_from") + F.floor(F.col("rank") / BUNDLE)).otherwise(F.col("single_from") + F.col("rank") - F.col("bundled"))
    placed = placed.withColumn("unit", unit).withColumn("places", F.when(in_bundle, F.col("bundles")).otherwise(F.col("singles")))
    placed = placed.withColumn("place", F.element_at(F.filter("places", lambda p: p["from_unit"] <= F.col("unit")), -1))
    bin_no = F.col("place.first_bin") + F.floor((F.col("unit") - F.col("place.from_unit")) / F.col("place.in_each"))
    return placed.select("bin_name", bin_no.cast("long").alias("bin_no"), F.floor(F.col("capacity") / F.col("n_tokens")).cast("int").alias("reciprocal_class"), "doc_id", "part_no", "start_token", "n_tokens")


def place_classes(counts: dict[int, int], levels: int = LEVELS) -> list[tuple]:
    """Where the units of every class go: (class, items in bundles, first bundle's unit, places, first single's unit, places).

    Units of one level are numbered on through its classes; a place says from which unit on a bin
    takes how many of them, beginning with which bin.
    """
    units: dict[int, int] = {}
    rows = []
    for cls, n in sorted(counts.items()):
        fine = -cls
        bundles, singles = divmod(n, BUNDLE) if cls < 0 else (0, n)
        high, low = (fine, -(-fine // BUNDLE)) if cls < 0 else (cls, cls)
        bundle_from = units.get(high, 0)
        units[high] = bundle_from + bundles
        single_from = units.get(low, 0)
        units[low] = single_from + singles
        rows.append((cls, bundles * BUNDLE, bundle_from, high, single_from, low))
    places: dict[int, list[tuple[int, int, int]]] = {}
    first_bin, filled = 0, {}
    for times, use in bin_kinds(units, levels):
        for level, n in use:
            at = filled.get(level, 0)
            places.setdefault(level, []).append((at, n, first_bin))
            filled[level] = at + times * n
        first_bin += times
    return [(cls, bundled, b, places.get(high, []), s, places.get(low, [])) for cls, bundled, b, high, s, low in rows]


def pack_documents(docs: DataFrame, bin_sizes: DataFrame, **tokenizer) -> DataFrame:
    """Pack ``docs`` (doc_id, text), measured in tokens, into every capacity of ``bin_sizes`` (a fixed, small table)."""
    from quern.llm.tokens import token_counts

    sizes = materialize(token_counts(docs.where("doc_id is not null"), ["doc_id"], **tokenizer), "sizes")
    bins = [(r.bin_name, r.capacity_tokens) for r in bin_sizes.select("bin_name", "capacity_tokens").distinct().orderBy("bin_name", "capacity_tokens").collect()]
    return pack(sizes, bins)


def fill_report(packed: DataFrame, bin_sizes: DataFrame) -> DataFrame:
    """(bin_name, n_bins, n_items, n_tokens, fill): how full the containers are."""
    per = packed.groupBy("bin_name").agg(F.countDistinct("bin_no").alias("n_bins"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    caps = bin_sizes.groupBy("bin_name").agg(F.max("capacity_tokens").alias("cap"))
    return per.join(F.broadcast(caps), "bin_name").select("bin_name", "n_bins", "n_items", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("cap")), 6).alias("fill"))
