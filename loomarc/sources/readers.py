"""Sources: sessions, datasets, question sets, frames, runs and settings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomarc.functions.text import trim_unicode
from loomarc.runtime import exists, small_or_shuffled

QA_ITEM = "id string, score string, question string, golds array<string>"
PROBE = "id string, question string, expect_contains array<string>"
VARIANT = (
    "name string, font_path string, font_size float, threshold float, line_spacing float, margin float, max_width float, "
    "frame_size int, content_width int, content_height int"
)
SOURCE_ITEM = "input string, context string, answers array<string>, length bigint, dataset string, language string, all_classes array<string>, _id string"
QA_RESULT = "id string, answer string, exact_match boolean, correct boolean, score string, f1 double, best_gold string, match_kind string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of text files; numbers count from 1 in each file, CR LF ends one line.

    Files are read in splits. A line's number is its place in its split plus the lines of the
    splits before it: places come from the row numbers Spark gives within a partition (a
    split's rows follow one another there), the sums from one count per split. Lines are not shuffled.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value"
    )
    splits = lines.groupBy("path", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    placed = splits.select("path", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    # One row per split of a file: bounded by the input's size over that of a split, and checked.
    joined = lines.join(small_or_shuffled(placed), ["path", "_block"])
    number = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return joined.select("path", number.alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, line_no, byte_len, event`` of JSONL sessions, one file each.

    Line numbers count from 1 and include blank lines, which are then left out. Bad JSON ends
    the query with the line's number. A file of any size is read in splits.
    """
    lines = numbered_lines(spark, path).withColumn("session_id", F.regexp_extract("path", "([^/]+)$", 1))
    kept = lines.where(trim_unicode(F.col("line")) != "")
    parsed = F.try_parse_json("line")
    message = F.concat(F.lit("cannot parse "), F.col("session_id"), F.lit(" line "), F.col("line_no").cast("string"))
    event = F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast("variant"))
    return kept.select("session_id", "line_no", F.octet_length("line").cast("bigint").alias("byte_len"), event.alias("event"))


def string_field(event: Column, path: str) -> Column:
    """A field of a variant if it is a string, else null."""
    value = F.try_variant_get(event, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(event, path, "string"))


def session_events(spark: SparkSession, path: str) -> DataFrame:
    """Session lines as the columns the session operators take."""
    events = session_lines(spark, path)
    e = F.col("event")
    return events.select(
        "session_id", "line_no", "byte_len", string_field(e, "$.type").alias("event_type"),
        F.to_json(F.try_variant_get(e, "$.message", "variant")).alias("message"),
        F.try_variant_get(e, "$.tokensBefore", "bigint").alias("tokens_before"), string_field(e, "$.timestamp").alias("event_ts"),
    )


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Typed JSONL; a malformed line ends the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file that holds one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def qa_items(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, QA_ITEM).withColumn("score", F.coalesce("score", F.lit("semantic")))


def probes(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, PROBE).withColumn("expect_contains", F.coalesce("expect_contains", F.array().cast("array<string>")))


def variants(spark: SparkSession, path: str, max_width: float = 750.0, margin: float = 15.0) -> DataFrame:
    """Render variants; absent widths and margins take the defaults."""
    rows = json_array(spark, path, VARIANT)
    return rows.fillna({"max_width": max_width, "margin": margin})


def source_items(spark: SparkSession, path: str) -> DataFrame:
    """Dataset items of ``<task>.jsonl`` files with ``task`` and ``position`` (line) in the file."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    item = F.from_json("line", SOURCE_ITEM, {"mode": "FAILFAST"})
    task = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("task")
    return lines.select(task, (F.col("line_no") - 1).cast("int").alias("position"), item.alias("i")).select("task", "position", "i.*")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def frame_images(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of a folder in the order of their names, as ``path, url`` (data URLs).

    An empty folder is an error, as a run over no frames would pass for a bad answer.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame-*.png").load(folder)
    if files.limit(1).count() == 0:
        raise FileNotFoundError(f"no frame-*.png in {folder}")
    return files.select("path", data_url(F.col("path"), F.col("content")).alias("url")).orderBy("path")


def data_url(path: Column, content: Column) -> Column:
    """A base64 data URL without line breaks; ``jpg`` and ``jpeg`` are JPEG, all else PNG."""
    kind = F.when(F.lower(path).rlike(r"\.jpe?g$"), "image/jpeg").otherwise("image/png")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def manifest_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a dataset manifest with their ``position``."""
    manifest = spark.read.option("multiLine", True).json(path)
    return manifest.select(F.posexplode("cases").alias("position", "c")).select("position", "c.*")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Run manifests of a folder: its own ``run.json``, else those of its children, by name."""
    own = root.rstrip("/") + "/run.json"
    path = own if exists(spark, own) else root.rstrip("/") + "/*/run.json"
    found = spark.read.option("multiLine", True).json(path)
    return found.withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), "(.*)/run.json$", 1)).orderBy("run_dir")


def qa_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows with ``run_dir`` and ``position``, in file order."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    folder = F.regexp_extract("path", "(.*)/[^/]+$", 1).alias("run_dir")
    return lines.select(folder, (F.col("line_no") - 1).cast("int").alias("position"), F.from_json("line", QA_RESULT).alias("r")).select("run_dir", "position", "r.*")


def frame_stats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, frames, chars_per_frame`` of render manifests; a missing file has zeros."""
    there = [p for p in paths if exists(spark, p)]
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    if not there:
        return asked.select("path", F.lit(0).cast("bigint").alias("frames"), F.lit(0.0).alias("chars_per_frame"))
    read = spark.read.schema("frame_count bigint, chars_per_frame double").option("multiLine", True).json(there)
    stats = read.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("frame_count").alias("frames"), "chars_per_frame")
    return asked.join(stats, "path", "left").fillna(0)


def result_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(run summaries, when they were made) of a results file with ``generated_at`` and ``runs``."""
    whole = spark.read.option("multiLine", True).json(path)
    made = whole.select("generated_at").first() if "generated_at" in whole.columns else None
    return whole.select(F.explode("runs").alias("r")).select("r.*"), made and made[0]


def advance_widths(spark: SparkSession, path: str) -> DataFrame:
    """Advance widths of characters (``char string, advance float``), the layout's view of a font."""
    return spark.read.schema("char string, advance float").option("header", True).csv(path)


def environment(*names: str) -> dict[str, str]:
    """Trimmed settings from the environment; an absent or empty one is an error."""
    out = {}
    for name in names:
        value = os.environ.get(name, "").strip()
        if not value:
            raise ValueError(f"{name} is not set")
        out[name] = value
    return out
