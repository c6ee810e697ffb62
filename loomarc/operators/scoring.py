"""Scoring of answers against golds, probes and OCR transcripts.

One projection per row: golds stay an array, so no row is exploded and nothing shuffles.

Defined results: a null answer is scored as ''; null or empty golds give best gold '', F1
0 and kind ``none``; a null score means semantic. Repeated rows are scored alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomarc.functions import lcs as L
from loomarc.functions import text as T

#: F1 from which a semantic answer counts without containing the gold.
HIGH_F1 = 0.85


def score_answers(df: DataFrame, id_col: str, strip_cjk_punct: bool = True) -> DataFrame:
    """Adds ``exact_match, correct, f1, best_gold, match_kind``; needs ``answer, golds, score``.

    ``id_col`` names the item id, whose prefix chooses the comparison in exact mode.
    """
    item = F.col(id_col)
    exact_mode = F.coalesce(F.col("score"), F.lit("semantic")) == "exact"
    answer = F.coalesce(F.col("answer"), F.lit(""))
    golds = F.filter(F.coalesce(F.col("golds"), F.array().cast("array<string>")), lambda g: g.isNotNull())

    def form(text: Column) -> Column:
        return F.when(exact_mode, T.normalize_exact_for_item(item, text)).otherwise(T.normalize_answer(text, strip_cjk_punct))

    base = (
        df.withColumn("_golds", golds)
        .withColumn("_answer", form(answer))
        .withColumn("_forms", F.transform("_golds", form))
        .withColumn("_f1", L.f1_each("_answer", "_forms"))
        .withColumn("_exact_mode", exact_mode)
    )

    def kind(x: Column) -> Column:
        holds = F.contains(F.col("_answer"), x["form"])
        return (
            F.when(F.col("_answer") == x["form"], "exact")
            .when(F.col("_exact_mode") & T.is_code_item(item) & holds, "contains_gold")
            .when(~F.col("_exact_mode") & holds, "contains_gold")
            .when(~F.col("_exact_mode") & T.clauses_match(F.col("_answer"), x["gold"]), "semantic_clauses")
            .when(~F.col("_exact_mode") & (x["f1"] >= HIGH_F1), "high_f1_semantic")
            .otherwise("none")
        )

    each = F.arrays_zip(F.col("_golds").alias("gold"), F.col("_forms").alias("form"), F.col("_f1").alias("f1"))
    start = F.struct(F.lit("").alias("gold"), F.lit(0.0).alias("f1"))
    # The first gold wins ties; a best gold that is '' gives way to the next whatever its F1.
    better = lambda s, x: F.when((s["gold"] == "") | (x["f1"] > s["f1"]), F.struct(x["gold"].alias("gold"), x["f1"].alias("f1"))).otherwise(s)
    kinds = F.transform(each, kind)
    scored = base.withColumn("_kinds", kinds).withColumn("_best", F.aggregate(each, start, better))
    hits = F.filter("_kinds", lambda k: k != "none")
    exact = F.array_contains("_kinds", "exact")
    return scored.select(
        *[c for c in df.columns if c not in ("exact_match", "correct", "f1", "best_gold", "match_kind")],
        exact.alias("exact_match"),
        (F.size(hits) > 0).alias("correct"),
        F.col("_best.f1").alias("f1"),
        F.col("_best.gold").alias("best_gold"),
        F.when(exact, "exact").otherwise(F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("none"))).alias("match_kind"),
    )


def totals(scored: DataFrame, *keys: str) -> DataFrame:
    """Items, correct, exact matches, exact ratio and mean F1, by keys or over all."""
    grouped = scored.groupBy(*keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if("correct").alias("correct"),
        F.count_if("exact_match").alias("exact"),
        T.safe_ratio(F.count_if("exact_match"), F.count(F.lit(1))).alias("em"),
        T.mean_or_zero(F.col("f1")).alias("mean_f1"),
    )


def probe_results(df: DataFrame) -> DataFrame:
    """Adds ``missing`` and ``passed`` to rows with ``answer`` and ``expect_contains``."""
    missing = T.contains_all(F.col("answer"), F.col("expect_contains"))
    return df.withColumn("missing", missing).withColumn("passed", F.size("missing") == 0)


def pass_rates(results: DataFrame, *keys: str) -> DataFrame:
    """Passed, total and pass rate in percent (0 without probes)."""
    return results.groupBy(*keys).agg(
        F.count_if("passed").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        (T.safe_ratio(F.count_if("passed"), F.count(F.lit(1))) * 100).alias("rate"),
    )


def ocr_scores(df: DataFrame, source: str, output: str) -> DataFrame:
    """Adds structs ``strict`` and ``normalized`` with the character metrics of a transcript."""

    def metrics(a: Column, b: Column) -> Column:
        common, edits = L.lcs(a, b), F.levenshtein(a, b)
        return F.struct(
            F.length(a).cast("bigint").alias("source_chars"), F.length(b).cast("bigint").alias("output_chars"), edits.cast("bigint").alias("edit_distance"),
            common.alias("lcs_chars"), T.safe_ratio(edits, F.length(a)).alias("cer"), T.safe_ratio(common, F.length(a)).alias("char_recall"),
            T.safe_ratio(common, F.length(b)).alias("char_precision"),
        )

    s, o = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(output), F.lit(""))
    prepared = df.withColumns({"_a": T.line_endings(s), "_b": T.line_endings(o), "_c": T.normalize_ocr(s), "_d": T.normalize_ocr(o)})
    return prepared.withColumns({"strict": metrics(F.col("_a"), F.col("_b")), "normalized": metrics(F.col("_c"), F.col("_d"))}).drop("_a", "_b", "_c", "_d")
