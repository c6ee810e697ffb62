"""Splitting oversized texts at natural boundaries, with a shared stretch between pieces.

A text is cut into tokens (a word or a run of one script with the marks and blanks behind it,
up to a line break); the prefix sums of their lengths are the offsets of all boundaries, in one
sorted array per kind (turns, lines, sentences, words). A piece starting at ``s`` ends at the last
boundary at or under ``s + limit``, found by binary search in the best kind that leaves the
piece at least half full, else in any kind, else by a hard cut between characters (grapheme
clusters), else between code points. The next piece starts ``overlap`` code points before
that end, moved back to the start of a character.

Lengths are Unicode code points, half-open offsets. Every code point is in a piece, pieces
are never longer than the limit, and consecutive pieces share at least ``overlap`` code
points unless that leaves no room to go on.

Defined results: null text gives no piece; a text within the limit (also '') is one piece.
Null, zero and negative limits: one piece, which counts as oversized if it has any code
point and the limit is not null. Null and negative overlaps are 0; an overlap of the limit
or more is cut to half the limit. Equal rows are split alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomarc.runtime import small_or_shuffled

KINDS = ("turn", "line", "sentence", "word")
_TURN = re.compile(r"(?m)(?:｜ T\d+ )?[A-Z]: |# \S[^\n]* ¶$")
_TOKEN = re.compile(
    r"(?:[぀-ヿ㐀-鿿]+|[^\s぀-ヿ㐀-鿿，、；：。！？｡]+)(?:[，、；：]|[。！？｡]+[”’」』）]*)?[^\S\n]*\n?"
    r"|[，、；：]|[。！？｡]+[”’」』）]*|[^\S\n]+\n?|\n"
)
_STOP = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*\s|[。！？｡]+[”’」』）]*)\s*$")
# Any character outside the ranges in which every code point is a character of its own.
_COMPLEX = re.compile("[^\\x00-\\x0c\\x0e-\\x7e\\xa0-\\xac\\xae-\\u02ff\\u0370-\\u0482\\u048a-\\u052f\\u2010-\\u2027\\u2030-\\u205e\\u3000-\\u3029\\u3031-\\u303c\\u3041-\\u3096\\u309d-\\u30ff\\u3400-\\u9fff\\uff01-\\uff9d]")
_CLUSTER = regex.compile(r"\X")


class Boundaries:
    """Sorted cut positions of one text, by kind, and the starts of its characters."""

    def __init__(self, text: str):
        self.size = len(text)
        self.clusters: list[int] | None = None
        if _COMPLEX.search(text):
            self.clusters = [m.start() for m in _CLUSTER.finditer(text)] + [self.size]
        tokens = _TOKEN.findall(text)
        words = list(accumulate(map(len, tokens)))
        lines = [end for token, end in zip(tokens, words) if token[-1] == "\n"]
        stops = [end for token, end in zip(tokens, words) if _STOP.search(token)]
        turns = [end for end in lines if _TURN.match(text, end)]
        self.kinds = [turns, lines, stops, words]
        if self.clusters is not None:
            known = set(self.clusters)
            self.kinds = [[end for end in ends if end in known] for ends in self.kinds]

    def cut(self, start: int, limit: int, least: int) -> tuple[int, str]:
        """(end, kind) of the piece that starts at ``start``; the end is beyond ``least``."""
        upto = start + limit
        if upto >= self.size:
            return self.size, "end"
        for floor in (max(least, start + limit // 2), least):
            for kind, ends in zip(KINDS, self.kinds):
                i = bisect_right(ends, upto) - 1
                if i >= 0 and ends[i] > floor:
                    return ends[i], kind
        if self.clusters is None:
            return upto, "character"
        i = bisect_right(self.clusters, upto) - 1
        if self.clusters[i] > least:
            return self.clusters[i], "character"
        return upto, "code_point"

    def character_start(self, position: int) -> int:
        """The start of the character that ``position`` lies in."""
        if self.clusters is None:
            return position
        return self.clusters[bisect_right(self.clusters, position) - 1]

    def next_character(self, position: int) -> int:
        if self.clusters is None:
            return position + 1
        return self.clusters[min(bisect_left(self.clusters, position + 1), len(self.clusters) - 1)]


def split_text(text: str, limit: int | None, overlap: int | None) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of each piece."""
    if limit is None or limit <= 0 or len(text) <= limit:
        return [(0, len(text), "whole")]
    overlap = max(0, overlap or 0)
    if overlap >= limit:
        overlap = limit // 2
    bounds, out, start = Boundaries(text), [], 0
    while True:
        end, kind = bounds.cut(start, limit, start + overlap)
        out.append((start, end, kind))
        if end >= len(text):
            return out
        following = bounds.character_start(end - overlap)
        if following <= start:  # a character longer than what is left: share less, but go on
            following = min(bounds.next_character(start), end)
        start = following


PIECES = "id bigint, piece_no int, start int, end int, cut string, shared int, oversized boolean, text string"


def split(df: DataFrame, id_col: str, text_col: str, limit_col: str, overlap_col: str, with_text: bool = True) -> DataFrame:
    """The pieces of each text; one Arrow pass, no shuffle. ``oversized`` says whether the whole text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for row_id, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                oversized = limit is not None and len(text) > max(limit, 0)
                before = 0
                for number, (a, b, kind) in enumerate(split_text(text, limit, overlap)):
                    row = (row_id, number, a, b, kind, max(0, before - a), oversized, text[a:b] if with_text else None)
                    before = b
                    for column, value in zip(out, row):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["id", "piece_no", "start", "end", "cut", "shared", "oversized", "text"]
            )

    columns = [
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{limit_col}`").cast("bigint").alias("limit"), F.col(f"`{overlap_col}`").cast("bigint").alias("overlap"),
    ]
    return df.select(*columns).where(F.col("text").isNotNull()).mapInArrow(run, PIECES)


FRAMES = "manifest_id bigint, frame_no int, path string, chars bigint, part_no int, start bigint, size bigint, cut string"


def split_frames(df: DataFrame) -> DataFrame:
    """New parts for recorded frames; a frame within the limit keeps its one part.

    A frame's place in the text is the prefix sum of the sizes recorded before it. Where
    the text ends before the frame does (stale records), the rest is cut by size alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for row_id, text, limit, overlap, frames in zip(*(c.to_pylist() for c in batch.columns)):
                text, at = text or "", 0
                for number, frame in enumerate(frames or []):
                    size = max(0, (frame or {}).get("chars") or 0)
                    inside = text[at : at + size]
                    parts = [(a, b, kind) for a, b, kind in split_text(inside + "\0" * (size - len(inside)), limit, overlap)]
                    for part, (a, b, kind) in enumerate(parts):
                        row = (row_id, number, (frame or {}).get("path"), (frame or {}).get("chars"), part, at + a, b - a, kind)
                        for column, value in zip(out, row):
                            column.append(value)
                    at += size
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["manifest_id", "frame_no", "path", "chars", "part_no", "start", "size", "cut"]
            )

    rows = df.select("manifest_id", F.col("carrier_text").alias("text"), F.col("max_chars").alias("limit"), F.col("overlap_chars").alias("overlap"), "frames")
    return rows.where(F.col("frames").isNotNull()).mapInArrow(run, FRAMES)


def _split(spark, sf_dir, with_text=True):
    rows = spark.read.parquet(f"{sf_dir}/archive_manifests.parquet")
    return split(rows, "manifest_id", "carrier_text", "max_chars", "overlap_chars", with_text)


def found(spark, sf_dir):
    """Manifests whose text took more than one piece, or has no limit it could keep to."""
    parts = _split(spark, sf_dir, with_text=False)
    cut = (F.col("piece_no") == 1) | F.col("oversized") & (F.col("cut") == "whole")
    return parts.where(cut).select(F.col("id").alias("manifest_id")).distinct()


def piece_checks(spark, sf_dir):
    """What the pieces of each text give back: its digest and size, and how many pieces break a rule.

    ``over``: pieces beyond the limit; ``gaps``: pieces that do not begin at or before the end of the one
    before; ``thin``: pieces that share less with the one before than asked for, although characters are single code points.
    """
    rows = spark.read.parquet(f"{sf_dir}/archive_manifests.parquet").select("manifest_id", "max_chars", "overlap_chars", F.length(F.regexp_replace("carrier_text", r"\P{ASCII}", "")).alias("ascii"))
    parts = _split(spark, sf_dir).withColumn("end", F.col("start") + F.length("text")).withColumn("fresh", F.expr("substring(text, shared + 1)"))
    whole = parts.groupBy(F.col("id").alias("manifest_id")).agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "fresh"))), lambda p: p["fresh"]), "")).alias("digest"),
        F.max("end").cast("bigint").alias("chars"), F.max(F.length("text")).alias("longest"), F.count(F.lit(1)).alias("pieces"),
        F.max(F.when(F.col("piece_no") == 0, F.col("start")).otherwise(0)).alias("first"), F.min(F.when(F.col("piece_no") > 0, F.col("shared"))).alias("least"),
    )
    asked = F.when(F.col("overlap_chars") >= F.col("max_chars"), F.floor(F.col("max_chars") / 2)).otherwise(F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)))
    return whole.join(small_or_shuffled(rows), "manifest_id").select(
        "manifest_id", "digest", "chars",
        F.coalesce((F.col("longest") > F.col("max_chars")) & (F.col("max_chars") > 0), F.lit(False)).alias("over"),
        (F.col("first") > 0).alias("gaps"),
        F.coalesce((F.col("least") < asked) & (F.col("ascii") == F.col("chars")), F.lit(False)).alias("thin"),
        F.coalesce((F.col("pieces") > 1) == ((F.col("chars") > F.col("max_chars")) & (F.col("max_chars") > 0)), F.col("pieces") == 1).alias("as_many"),
    )


def pieces(spark, sf_dir):
    return _split(spark, sf_dir).withColumnRenamed("id", "manifest_id")


def frames(spark, sf_dir):
    return split_frames(spark.read.parquet(f"{sf_dir}/archive_manifests.parquet"))


ORACLE = {
    "p3_found": "SELECT DISTINCT manifest_id FROM archive_manifests WHERE length(carrier_text) > greatest(max_chars, 0)",
    "p3_checks": """SELECT manifest_id, md5(carrier_text) AS digest, length(carrier_text) AS chars, false AS over, false AS gaps, false AS thin, true AS as_many
FROM archive_manifests WHERE carrier_text IS NOT NULL""",
}
