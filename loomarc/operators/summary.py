"""Run summaries: totals, baseline eligibility, leaderboard, retention, pivots.

``cases`` has one row per run and case: ``run, mode, id, task, score, correct,
exact_match, f1, match_kind, frames, chars_per_frame``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomarc.functions import text as T
from loomarc.runtime import small_or_shuffled

#: F1 of the text baseline from which a case is eligible.
THRESHOLD = 0.7


def case_rows(cases: DataFrame, results: DataFrame, frames: DataFrame | None = None, order: str = "position") -> DataFrame:
    """Cases with their first result row and, where there are any, their frame statistics."""
    value = F.struct(*[c for c in results.columns if c not in ("run", "id")])
    first = results.groupBy("run", "id").agg(F.min_by(value, order).alias("_r")).select("run", "id", "_r.*").drop(order)
    rows = cases.join(first, ["run", "id"])
    if frames is not None:
        rows = rows.join(frames, ["run", "id"], "left")
    for name in ("frames", "chars_per_frame"):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(0)) if name in rows.columns else F.lit(0))
    correct = F.coalesce(F.col("correct"), F.col("exact_match"))
    kind = F.coalesce(F.col("match_kind"), F.when(F.col("exact_match"), "exact").otherwise("none"))
    return rows.withColumns({"correct": correct, "match_kind": kind})


def with_eligibility(cases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``baseline_f1`` and ``baseline_eligible`` from the first text run by name.

    Without a text run every case is eligible. The baseline is broadcast below a checked size.
    """
    base_run = cases.where(F.col("mode") == "text").agg(F.min("run").alias("base_run"))
    base = cases.where(F.col("mode") == "text").join(F.broadcast(base_run), F.col("run") == F.col("base_run")).select("id", F.col("f1").alias("_f1"))
    base = base.groupBy("id").agg(F.max("_f1").alias("_f1"))
    marked = cases.join(small_or_shuffled(base), "id", "left").crossJoin(F.broadcast(base_run))
    no_base = F.col("base_run").isNull()
    return marked.withColumns(
        {
            "baseline_f1": F.when(~no_base, F.coalesce("_f1", F.lit(0.0))),
            "baseline_eligible": no_base | F.coalesce(F.col("_f1") >= threshold, F.lit(False)),
        }
    ).drop("_f1", "base_run")


def low_cases(cases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Cases of text runs whose baseline result is not eligible, once each."""
    marked = with_eligibility(cases, threshold).where((F.col("mode") == "text") & ~F.col("baseline_eligible"))
    return marked.select("id", "task", "f1", "match_kind").distinct()


def _count_of(correct: Column, of: Column) -> Column:
    return F.concat(F.count_if(of & correct).cast("string"), F.lit("/"), F.count_if(of).cast("string"))


def summarize(marked: DataFrame) -> DataFrame:
    """One row per run; ``marked`` comes from ``with_eligibility``."""
    correct, eligible = F.col("correct"), F.col("baseline_eligible")
    return marked.groupBy("run", "mode").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(correct).alias("correct"),
        F.count_if("exact_match").alias("exact_match"),
        _count_of(correct, F.col("score") == "semantic").alias("semantic_correct"),
        _count_of(correct, F.col("score") == "exact").alias("exact_correct"),
        T.mean_or_zero(F.col("f1")).alias("avg_f1"),
        F.count_if(eligible).alias("eligible_cases"),
        F.count_if(eligible & correct).alias("eligible_correct"),
        T.mean_or_zero(F.when(eligible, F.col("f1"))).alias("eligible_avg_f1"),
        F.sum("frames").alias("total_frames"),
        T.mean_or_zero(F.col("frames")).alias("avg_frames"),
        T.mean_or_zero(F.when(F.col("chars_per_frame") > 0, F.col("chars_per_frame"))).alias("avg_chars_per_frame"),
    )


def by_task(cases: DataFrame) -> DataFrame:
    return cases.groupBy("run", "task").agg(F.count(F.lit(1)).alias("cases"), F.count_if("correct").alias("correct"), T.mean_or_zero(F.col("f1")).alias("avg_f1"))


def by_task_map(cases: DataFrame) -> DataFrame:
    """One map of task to statistics per run."""
    entry = F.struct(F.col("task").alias("key"), F.struct("cases", "correct", "avg_f1").alias("value"))
    return by_task(cases).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_task"))


def leaderboard(summaries: DataFrame) -> DataFrame:
    """Best eligible F1 first, then mean F1, correct cases, run name."""
    return summaries.orderBy(F.desc("eligible_avg_f1"), F.desc("avg_f1"), F.desc("correct"), "run")


def report_order(summaries: DataFrame) -> DataFrame:
    """The order of a report: eligible F1, then mean F1 (best first); equal runs by name."""
    return summaries.orderBy(F.desc("eligible_avg_f1"), F.desc("avg_f1"), "run")


def retention(summaries: DataFrame) -> DataFrame:
    """Eligible F1 of image runs against the first text run (null without one, or at 0).

    One pass over the summaries: the text run is found by a window over them, a row per run.
    """
    everything = Window.partitionBy()
    text = F.min_by("eligible_avg_f1", F.when(F.col("mode") == "text", F.col("run"))).over(everything)
    image = summaries.withColumn("_text", F.when(F.max(F.col("mode") == "text").over(everything), text)).where(F.col("mode") == "image")
    return image.select("run", "eligible_avg_f1", F.try_divide("eligible_avg_f1", "_text").alias("retention"), "avg_f1", "total_frames", "avg_chars_per_frame")


def best_image_run(summaries: DataFrame) -> DataFrame:
    rank = F.struct("eligible_avg_f1", "avg_f1")
    return summaries.where(F.col("mode") == "image").agg(F.max_by("run", rank).alias("run"), F.max("eligible_avg_f1").alias("eligible_avg_f1"))


def task_pivot(cases: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Mean F1 by task and run; a task a run does not have is null.

    ``runs`` names the columns; by default every run in the cases has one (in order of names;
    more than ``spark.sql.pivotMaxValues`` runs are an error, none is left out).
    """
    return by_task(cases).groupBy("task").pivot("run", runs).agg(F.first("avg_f1"))


def task_names(cases: DataFrame) -> DataFrame:
    return cases.select("task").where(F.col("task").isNotNull()).distinct().orderBy("task")


def task_names_of_maps(maps: DataFrame) -> DataFrame:
    """Task names over the maps of several runs (map key union)."""
    return maps.select(F.explode(F.map_keys("by_task")).alias("task")).distinct().orderBy("task")


def variant_probes(variants: DataFrame, probes: DataFrame) -> DataFrame:
    """Every variant with every probe. Both sides are settings; the smaller is broadcast after a size check."""
    return variants.crossJoin(small_or_shuffled(probes))
