"""Sinks: carriers, metadata, results, reports. Formatting of numbers happens here only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomarc.functions.text import safe_file_name, zero_pad
from loomarc.operators import summary as SU


def carriers(texts: DataFrame, folder: str) -> None:
    """The three carriers of each window as text files below ``session_id=/window_no=/carrier=``."""
    names = ("serialized", "eventized", "structured")
    long = texts.select("session_id", "window_no", F.explode(F.array(*[F.struct(F.lit(n).alias("carrier"), F.col(n).alias("value")) for n in names])).alias("c"))
    long.select("session_id", "window_no", "c.*").write.mode("overwrite").partitionBy("session_id", "window_no", "carrier").option("lineSep", "\n").text(folder)


def carrier_stream(pieces: DataFrame, folder: str) -> None:
    """The carriers from their pieces (``sessions.carrier_pieces``), one text file each.

    A carrier's pieces meet in one task and are sorted there, which spills to disk: no text is held as a
    whole, however large its window.
    """
    joint = F.when(F.col("carrier") == "structured", F.col("text")).otherwise(F.when(F.row_number().over(Window.partitionBy("session_id", "window_no", "carrier").orderBy("place")) > 1, F.concat(F.lit("\n"), "text")).otherwise(F.col("text")))
    ordered = pieces.withColumn("value", joint).sortWithinPartitions("session_id", "window_no", "carrier", "place")
    rows = ordered.select("session_id", "window_no", "carrier", "value")
    rows.write.mode("overwrite").partitionBy("session_id", "window_no", "carrier").option("lineSep", "\n").text(folder)


def pretty_json(df: DataFrame, folder: str, *partition_by: str) -> None:
    """One pretty-printed JSON record per row."""
    kept = [c for c in df.columns if c not in partition_by]
    rows = df.select(*partition_by, F.to_json(F.struct(*kept), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).text(folder)


def json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def csv_rows(df: DataFrame, folder: str) -> None:
    """CSV with a header; fields are quoted only where they hold a comma, quote or line break."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(folder)


def matrix(results: DataFrame, rates: DataFrame, folder: str) -> None:
    """Matrix results as JSONL, rates as CSV and markdown."""
    json_lines(results, os.path.join(folder, "results"))
    csv_rows(rates, os.path.join(folder, "rates"))
    rows = rates.orderBy(*rates.columns[:1]).collect()  # one row per variant
    _write(os.path.join(folder, "rates.md"), markdown_table(rates.columns, ([_cell(x) for x in row] for row in rows)))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """(file system, folder in it) of a local path or a URI of any storage the cluster shares."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))


def frame_files(images: DataFrame, folder: str) -> int:
    """Binary frames ``frame-%04d.png`` of ``frame_no, content``, written by the executors; how many.

    The folder must be one that all executors share. A task that runs again writes the same files.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    named = images.select(F.concat(F.lit("frame-"), zero_pad(F.col("frame_no"), 4), F.lit(".png")).alias("name"), "content")
    return named.mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def frame_manifests(layouts: DataFrame, settings: dict, folder: str, id_col: str) -> None:
    """One manifest per text: the settings it was set with, its sizes and its frames."""
    fixed = [F.lit(value).alias(name) for name, value in settings.items()]
    pretty_json(layouts.select(id_col, *fixed, *[c for c in layouts.columns if c != id_col]), folder, id_col)


def transcripts(scored: DataFrame, folder: str, id_col: str, output: str) -> DataFrame:
    """Transcripts as text files below ``<id>=``, and their metrics as a frame of one JSON line each.

    ``scored`` comes from ``scoring.ocr_scores``.
    """
    scored.select(F.col(id_col), F.coalesce(F.col(output), F.lit("")).alias("value")).write.mode("overwrite").partitionBy(id_col).option("lineSep", "\n").text(folder)
    return scored.select(id_col, F.to_json(F.struct("strict", "normalized"), {"ignoreNullFields": "false"}).alias("metrics"))


def case_files(cases: DataFrame, folder: str) -> None:
    """Contexts, questions and metadata of cases below ``id=``, and the manifest of all."""
    named = cases.withColumn("id", safe_file_name(F.col("id")))
    named.select("id", F.col("context_text").alias("value")).write.mode("overwrite").partitionBy("id").text(os.path.join(folder, "context"))
    qa = F.struct(F.concat(F.col("id"), F.lit("-answer")).alias("id"), "score", "question", F.col("answers").alias("golds"))
    named.select("id", F.to_json(F.array(qa), {"pretty": "true"}).alias("value")).write.mode("overwrite").partitionBy("id").text(os.path.join(folder, "recall_qa"))
    meta = named.drop("context_text", "question", "answers").withColumn("case", F.col("id"))
    pretty_json(meta, os.path.join(folder, "metadata"), "id")
    json_lines(cases.drop("context_text"), os.path.join(folder, "manifest"))


def run_manifest(header: dict, cases: DataFrame, folder: str) -> None:
    """A run's manifest; written last, so that a failed run has none.

    Cases are written as they come from the executors, one partition at a time; the driver holds no list of them.
    """
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    head = json.dumps(header, ensure_ascii=False, indent=2)[:-2] if header else "{"
    with store.open_output_stream(base + "/run.json") as out:
        out.write((head + ("," if header else "") + '\n  "cases": [').encode())
        first = True
        for (line,) in cases.select(F.to_json(F.struct(*cases.columns), {"ignoreNullFields": "false"})).toLocalIterator():
            out.write((("" if first else ",") + "\n    " + line).encode())
            first = False
        out.write(("]" if first else "\n  ]").encode() + b"\n}\n")


def markdown_table(headers: Iterable[str], rows: Iterable[Iterable[str]]) -> str:
    headers = list(headers)
    lines = [headers, ["---"] * len(headers), *rows]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def markdown_leaderboard(summaries: DataFrame) -> str:
    """The leaderboard as markdown; one row per run."""
    columns = ("run", "mode", "eligible_avg_f1", "eligible_cases", "avg_f1", "correct", "exact_correct", "semantic_correct", "total_frames", "avg_chars_per_frame")
    rows = summaries.select(*columns).collect()
    return "# Leaderboard\n\n" + markdown_table(columns, ([_cell(x) for x in row] for row in rows)) + "\n"


def markdown_report(summaries: DataFrame, cases: DataFrame, made: str = "", source: str = "", notes: Iterable[str] = ()) -> str:
    """The report of a benchmark: what is kept, the leaderboard, tasks by run and the hard cases.

    Rows are as many as runs, tasks, and cases the baseline run fails. The order of runs is that of
    ``summary.report_order``.
    """
    ordered = [r.asDict() for r in SU.report_order(summaries).collect()]
    kept = [r.asDict() for r in SU.report_order(SU.retention(summaries)).collect()]
    tasks = SU.task_pivot(cases).orderBy("task")
    hard = SU.low_cases(cases).orderBy("id").collect()
    best = kept[0] if kept else None
    line = f"The best image run ({best['run']}) keeps {percent(best['retention'])} of the text run's eligible F1." if best and best["retention"] is not None else "There is no pair of a text and an image run to compare."
    parts = [
        "# Benchmark report", f"Made {made} from `{source}`." if source else "", "## Summary", line,
        markdown_table(["image run", "eligible F1", "kept", "all-case F1", "frames", "chars/frame"], [[r["run"], format_fixed(r["eligible_avg_f1"]), percent(r["retention"]), format_fixed(r["avg_f1"]), str(r["total_frames"]), format_fixed(r["avg_chars_per_frame"], 1)] for r in kept]) if kept else "",
        "## Leaderboard",
        markdown_table(["run", "eligible F1", "eligible cases", "avg F1", "correct", "exact", "semantic", "frames", "chars/frame"], [[r["run"], format_fixed(r["eligible_avg_f1"]), f"{r['eligible_cases']}/{r['cases']}", format_fixed(r["avg_f1"]), f"{r['correct']}/{r['cases']}", r["exact_correct"], r["semantic_correct"], str(r["total_frames"]), format_fixed(r["avg_chars_per_frame"], 1)] for r in ordered]),
        "## Average F1 by task", markdown_table(tasks.columns, ([_cell(x) for x in row] for row in tasks.collect())),
        "## Hard cases", markdown_table(["case", "task", "text F1", "match"], ([r["id"], r["task"], format_fixed(r["f1"]), r["match_kind"]] for r in hard)),
        *(["## Notes", *(f"- {n}" for n in notes)] if notes else []),
    ]
    return "\n\n".join(p for p in parts if p) + "\n"


def now_iso() -> str:
    """The current time in UTC, to milliseconds; for headers only, never in what is compared."""
    from datetime import UTC, datetime

    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def inside(root: str, path: str) -> str:
    """A relative path below ``root``; an error where it would leave it."""
    import posixpath

    plain = posixpath.normpath(path.replace("\\", "/")).lstrip("/")
    if plain == ".." or plain.startswith("../") or (len(plain) > 1 and plain[1] == ":"):
        raise ValueError(f"{path!r} leaves {root}")
    return posixpath.join(root, plain)


def format_fixed(value: float | None, digits: int = 4) -> str:
    return "—" if value is None else f"{value:.{digits}f}"


def percent(value: float | None) -> str:
    return "—" if value is None else f"{value * 100:.1f}%"


def _cell(value) -> str:
    return format_fixed(value) if isinstance(value, float) or value is None else str(value)


def _write(path: str, text: str) -> None:
    store, target = _store(path)
    store.create_dir(os.path.dirname(target), recursive=True)
    with store.open_output_stream(target) as out:
        out.write(text.encode())
