"""Mixing sources to target weights by weighted fair queueing.

Every document has a place in the shuffled order of its source. Its virtual finish time is
the tokens of its source up to and including it, divided by the weight of the source; a
repetition starts where the pass before ended. Sorted by finish time, any start of the
mixture has the target shares within one document per source; it is cut at the total.

The running sums are made in two levels (hash buckets of a source, then places in a
bucket), so a source with a third of all documents is spread over its buckets.

Defined results:

* shares of sources that have no tokens are spread over the others in proportion; such
  sources are reported with 0. Negative or null shares count as 0, null repeats as 1.
* null and empty texts have no tokens and never enter; documents without a listed source
  neither. A document id delivered twice is one document.
* the shuffled order of a source is by bucket, hash and document id; the seed changes it.
* ``total`` defaults to the largest total at which every source keeps its share within its
  repeats. With a larger one, sources that run dry end early and the reported shares show it.
* an empty table of documents or targets gives no rows (shares: one row per listed source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomarc.llm.budget import newest
from loomarc.llm.tokens import DEFAULT, TOKENIZERS, with_tokens
from loomarc.runtime import materialize, small_or_shuffled

#: Hash buckets per source for the running sums.
BUCKETS = 1024


def sized_documents(documents: DataFrame, seed: int = 0, name: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, source, tokens, place``: one row per document that has tokens, kept for reuse."""
    sized = with_tokens(documents.where(F.col("source").isNotNull()), "doc_id", "text", ["source", "loaded_at"], name, folder)
    one = newest(sized, "doc_id", ["source", "tokens"], "loaded_at", "tokens").where(F.col("tokens") > 0)
    return materialize(one.withColumn("place", F.xxhash64("doc_id", F.lit(seed))), "sized-documents")


def capacities(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: available tokens, normalized weight, repeats, and the total it allows."""
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("available_documents"))
    listed = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    )
    joined = listed.join(have, "source", "left").fillna(0, ["available", "available_documents"])
    usable = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0)
    everything = Window.partitionBy()  # the listed sources: a handful of rows
    weighted = joined.withColumn("weight", F.try_divide(usable, F.sum(usable).over(everything)))
    allowed = F.when(F.col("weight") > 0, F.col("available") * F.col("max_repeats") / F.col("weight"))
    return weighted.withColumn("largest_total", F.floor(F.min(allowed).over(everything)))


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, sized: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, repeat_no, tokens, finish`` in the order of the mixture."""
    sized = sized_documents(documents, seed) if sized is None else sized
    plan = capacities(sized, targets).where(F.col("weight") > 0)
    limit = F.lit(total).cast("bigint") if total is not None else F.col("largest_total")
    plan = plan.select("source", "weight", "max_repeats", "available", limit.alias("total"))
    bucket = F.pmod(F.shiftright("place", 40), F.lit(BUCKETS)).alias("bucket")
    held = sized.select("*", bucket)
    sums = held.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # One row per source and bucket: at most BUCKETS times the listed sources. It is written down, so its size is
    # known, and broadcast only where that is small.
    listed = sums.join(small_or_shuffled(plan), "source").select("source", "bucket", "weight", "max_repeats", "available", "total", F.coalesce(before, F.lit(0)).alias("offset"))
    offsets = small_or_shuffled(materialize(listed, "mixture-offsets"))
    within = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = held.withColumn("within", within).join(offsets, ["source", "bucket"])
    upto = F.col("offset") + F.col("within")
    repeats = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("max_repeats") - 1)).alias("repeat_no")
    timed = placed.select("doc_id", "source", "tokens", "weight", "total", "available", upto.alias("upto"), repeats)
    finish = (F.col("repeat_no") * F.col("available") + F.col("upto")) / F.col("weight")
    # The finish time of a document is the total of the mixture up to it, so the cut is a filter.
    queued = timed.withColumn("finish", finish).where(F.col("finish") <= F.col("total"))
    return queued.select("doc_id", "source", "repeat_no", "tokens", "finish").orderBy("finish", "source", "doc_id", "repeat_no")


def shares(sized: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Target and actual share of each listed source."""
    used = mixed.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("repeat_no").alias("last_repeat")
    )
    joined = capacities(sized, targets).join(used, "source", "left").fillna(0, ["tokens", "uses"])
    return joined.select(
        "source", "target_share", "max_repeats", "available_documents", F.col("available").alias("available_tokens"), "uses", "tokens",
        F.coalesce(F.col("last_repeat") + 1, F.lit(0)).alias("passes"),
        F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)).alias("actual_share"),
    )


def _tables(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/source_targets.parquet")


def p9_mixture(spark, sf_dir):
    return mixture(*_tables(spark, sf_dir))


def p9_shares(spark, sf_dir):
    documents, targets = _tables(spark, sf_dir)
    sized = sized_documents(documents)
    return shares(sized, targets, mixture(documents, targets, sized=sized))
