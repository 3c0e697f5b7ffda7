"""Problem 9: a mix of sources with target shares of all tokens.

Systematic sampling: within a source every document is expected the same number
of times (the source's target over its tokens); the running sum of expected
copies plus one random offset crosses an integer once per copy emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.ranks import ranked
from quern.llm.scratch import materialize


def source_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, n_docs, rate): expected copies of each document.

    The total is the largest that no source needs more than its ``max_repeats`` for; sources
    without tokens cannot contribute, and the others keep their proportions.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    want = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = want.join(have, "source", "left").fillna(0, ["tokens", "n_docs"])
    total = both.where("tokens > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("total"))
    rate = F.when(F.col("tokens") > 0, F.col("total") * F.col("target_share") / F.col("tokens")).otherwise(F.lit(0.0))
    return both.crossJoin(F.broadcast(total)).withColumn("rate", F.least(rate, F.col("max_repeats").cast("double"))).drop("total")


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copies): documents of the mix, each with how often it is used.

    ``sizes`` has doc_id, source, n_tokens; ``targets`` (source, target_share, max_repeats) is a
    small fixed table. Documents without tokens or without a target source are not used. Within a
    source, documents go by size, so that the sample holds every size in proportion.
    """
    sizes = sizes.where("n_tokens > 0 and doc_id is not null").select("doc_id", "source", "n_tokens")
    rates = materialize(source_rates(sizes, targets), "rates")
    used = sizes.join(F.broadcast(rates.select("source", "rate", "max_repeats")), "source").where("rate > 0")
    order = ranked(used, ["source"], "doc_id", value="n_tokens")
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / float(1 << 30)
    crossed = F.floor((F.col("rank") + 1) * F.col("rate") + offset) - F.floor(F.col("rank") * F.col("rate") + offset)
    return order.select("doc_id", "source", "n_tokens", F.least(crossed, F.col("max_repeats")).cast("int").alias("copies")).where("copies > 0")


def token_sizes(docs: DataFrame, **tokenizer) -> DataFrame:
    from quern.llm.tokens import token_counts

    return materialize(token_counts(docs, ["doc_id", "source"], **tokenizer), "sizes")


def mix_documents(docs: DataFrame, targets: DataFrame, seed: int = 0, **tokenizer) -> DataFrame:
    """(doc_id, source, n_tokens, copy_no): one row per use of a document, copy_no from 1."""
    mixed = mix(token_sizes(docs, **tokenizer), targets, seed)
    return mixed.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_docs, most_copies) of ``mix_documents``' rows."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.max("copy_no").alias("copies"), F.sum("n_tokens").alias("n_tokens"))
    per = per_doc.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    all_tokens = per.agg(F.sum("n_tokens").alias("all_tokens"))
    want = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    return (
        want.join(per, "source", "left")
        .crossJoin(F.broadcast(all_tokens))
        .select(
            "source",
            "target_share",
            F.round(F.coalesce("n_tokens", F.lit(0)) / F.greatest("all_tokens", F.lit(1)), 6).alias("actual_share"),
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
