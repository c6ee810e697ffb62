"""Token budget: tokens of each document, and totals by source, language and task.

Each document is counted once under an existing tokenizer, with no text leaving the
counting stage. Its metadata row is the one recorded last; language and task come from it
and, where it has none, from the document, each in one spelling. Totals are partial
aggregates before the only shuffles (the metadata join, which moves ids and sizes, and the
small totals).

Defined results: null and '' have 0 tokens. Null or empty source, language or task: the
slice ``unknown``. A document id delivered twice is counted once (the row loaded last).
Documents without a metadata row keep their own labels; metadata of absent documents
counts nothing. ``utf16_units`` is measured, as recorded lengths may be stale;
``stale_context`` counts the documents whose recorded length differs from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomarc.llm.labels import language_code_column
from loomarc.llm.tokens import DEFAULT, TOKENIZERS, with_tokens


def _filled(value: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), F.lit(""))


def newest(df: DataFrame, key: str, columns: list[str], *order: str) -> DataFrame:
    """One row per key: the largest by ``order`` (nulls first). Aggregates, so hot keys combine map-side."""
    rank = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in order])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("_r")).select(key, "_r.*")


def document_tokens(documents: DataFrame, name: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, source, lang, task, utf16_units, tokens``, one row per document."""
    units = documents.withColumn("utf16_units", F.coalesce((F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("bigint"), F.lit(0).cast("bigint")))
    sized = with_tokens(units, "doc_id", "text", ["source", "lang", "task", "utf16_units", "loaded_at"], name, folder)
    return newest(sized, "doc_id", ["source", "lang", "task", "utf16_units", "tokens"], "loaded_at", "tokens")


def labelled_tokens(documents: DataFrame, metadata: DataFrame, name: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, source, language, task, tokens, utf16_units, stale``."""
    latest = newest(metadata, "doc_id", ["language", "task", "context_chars"], "recorded_at", "case_id").select(
        "doc_id", F.col("language").alias("m_language"), F.col("task").alias("m_task"), "context_chars"
    )
    unknown = F.lit("unknown")
    return document_tokens(documents, name, folder).join(latest, "doc_id", "left").select(
        "doc_id",
        F.coalesce(_filled(F.col("source")), unknown).alias("source"),
        F.coalesce(language_code_column(F.col("m_language")), language_code_column(F.col("lang")), unknown).alias("language"),
        F.coalesce(_filled(F.col("m_task")), _filled(F.col("task")), unknown).alias("task"),
        "tokens",
        "utf16_units",
        (~F.col("context_chars").eqNullSafe(F.col("utf16_units"))).alias("stale"),
    )


def totals(labelled: DataFrame) -> DataFrame:
    """Totals by source, language and task, with subtotals of each and the grand total ('*')."""
    slices = labelled.groupBy("source", "language", "task").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum("utf16_units").alias("utf16_units"),
        F.count_if("stale").alias("stale_context"),
    )
    star = lambda c: F.when(F.grouping(c) == 1, F.lit("*")).otherwise(F.col(c)).alias(c)
    sets = [["source", "language", "task"], ["source"], ["language"], ["task"], []]
    sums = [F.sum(c).alias(c) for c in ("documents", "tokens", "utf16_units", "stale_context")]
    grouped = slices.groupingSets([[F.col(c) for c in s] for s in sets], "source", "language", "task")
    return grouped.agg(star("source").alias("s"), star("language").alias("l"), star("task").alias("t"), *sums).select(
        F.col("s").alias("source"), F.col("l").alias("language"), F.col("t").alias("task"), "documents", "tokens", "utf16_units", "stale_context"
    )


def _labelled(spark, sf_dir):
    return labelled_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/case_metadata.parquet"))


def p5_budget(spark, sf_dir):
    return totals(_labelled(spark, sf_dir))


def p5_document_tokens(spark, sf_dir):
    return _labelled(spark, sf_dir).drop("stale")
