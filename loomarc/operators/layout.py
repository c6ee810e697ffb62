"""Layout of text into fixed frames, and the coverage histogram of glyph pixels.

Packing depends on state that resets by data (lines wrap, frames fill), so it is an Arrow
UDF over one text at a time; with cells of one width it has a closed form in SQL.

Defined results: a null text gives null, '' one blank frame with 0 characters. A frame
takes at least one character however small it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Variant:
    """How a text is set: sizes in pixels, advance widths by character."""

    frame_size: int = 1568
    content_width: int = 1568
    content_height: int = 1568
    font_size: float = 12.0
    threshold: float = 0.3
    line_spacing: float = 0.0
    margin: float = 8.0
    ascent: float = 10.0
    descent: float = -2.0
    advance: float = 6.0
    wide_advance: float = 12.0
    advances: dict[str, float] = field(default_factory=dict)

    def width(self, ch: str) -> float:
        known = self.advances.get(ch)
        if known is not None:
            return known
        return self.wide_advance if ch >= "ᄀ" else self.advance

    @property
    def line_height(self) -> float:
        return math.ceil(self.ascent - self.descent) + self.line_spacing


#: Known presets by id.
PRESETS = {
    # The presets of the benchmark.
    "zpix24-binary-2000": Variant(frame_size=2000, content_width=2000, content_height=2000, font_size=24.0, threshold=0.49, line_spacing=2.0, margin=8.0),
    "zpix18-half-049-2000": Variant(frame_size=2000, content_width=2000, content_height=2000, font_size=18.0, threshold=0.49, line_spacing=2.0, margin=8.0),
}


def preset(mode: str, preset_id: str | None = None) -> Variant | None:
    """The variant of a run: by id in image mode (the first by default), none in text mode.

    An unknown mode, and in image mode an unknown id, is an error that names the known ones.
    """
    if mode not in ("text", "image"):
        raise ValueError(f"mode {mode!r} is neither text nor image")
    if mode == "text":
        return None
    chosen = preset_id if preset_id is not None else next(iter(PRESETS))
    if chosen not in PRESETS:
        raise ValueError(f"unknown preset {chosen}; known presets: {', '.join(PRESETS)}")
    return PRESETS[chosen]


def with_presets(runs: DataFrame, mode: str = "mode", preset_id: str = "preset") -> DataFrame:
    """Runs with ``font_size, threshold, line_spacing, frame_size, margin`` of their preset (null in text mode).

    A row of an image run with an unknown preset ends the query.
    """
    known = [(k, v.font_size, v.threshold, v.line_spacing, v.frame_size, v.margin) for k, v in PRESETS.items()]
    table = runs.sparkSession.createDataFrame(known, "_id string, font_size double, threshold double, line_spacing double, frame_size int, margin double")
    image = F.col(mode) == "image"
    joined = runs.join(F.broadcast(table), image & (F.col(preset_id) == F.col("_id")), "left")  # a row per preset
    failed = F.raise_error(F.concat(F.lit("unknown preset "), F.coalesce(F.col(preset_id), F.lit("null")), F.lit("; known presets: " + ", ".join(PRESETS))))
    checked = F.when(image & F.col("_id").isNull(), failed.cast("double")).otherwise(F.col("font_size"))
    return joined.withColumn("font_size", checked).drop("_id")


def pack(text: str, v: Variant) -> list[int]:
    """Characters of each frame."""
    right = min(v.margin + v.content_width, v.frame_size - v.margin)
    bottom = min(v.margin + v.content_height, v.frame_size - v.margin)
    frames, held, x, y = [], 0, v.margin, v.ascent + v.margin
    for ch in text:
        wide = v.width(ch)
        if x + wide > right:
            x, y = v.margin, y + v.line_height
        if held and y + v.descent + v.margin > bottom:
            frames.append(held)
            held, x, y = 0, v.margin, v.ascent + v.margin
        x += wide
        held += 1
    if held or not frames:
        frames.append(held)
    return frames


def image_size(text: str, v: Variant, max_width: float = 750.0) -> tuple[int, int]:
    """(width, height) of the one image that holds a text with its own line breaks."""
    x, y = v.margin, v.ascent + v.margin
    for ch in text:
        if ch == "\n":
            x, y = v.margin, y + v.line_height
            continue
        wide = v.width(ch)
        if x + wide > max_width:
            x, y = v.margin, y + v.line_height
        x += wide
    return int(max_width + v.margin), math.ceil(y + v.descent) + int(v.margin)


def frames(df: DataFrame, id_col: str, text_col: str, variant: Variant) -> DataFrame:
    """``id_col, compact_chars, frame_count, chars_per_frame, frames`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            packed = [None if t is None else pack(t, variant) for t in texts]
            listed = [None if p is None else [{"path": f"frame-{i:04}.png", "chars": n} for i, n in enumerate(p)] for p in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([None if t is None else len(t) for t in texts], pa.int64()),
                    pa.array([None if p is None else len(p) for p in packed], pa.int64()),
                    pa.array([None if p is None else len(t) / len(p) for t, p in zip(texts, packed)], pa.float64()), pa.array(listed, kind),
                ],
                names=[id_col, "compact_chars", "frame_count", "chars_per_frame", "frames"],
            )

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, compact_chars bigint, frame_count bigint, chars_per_frame double, frames array<struct<path:string,chars:bigint>>"
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def grid_capacity(width: Column, height: Column, cell_width: Column, cell_height: Column) -> Column:
    """Cells of one size that fit a page."""
    return (F.floor(width / cell_width) * F.floor(height / cell_height)).cast("bigint")


def grid_frames(chars: Column, capacity: Column) -> Column:
    """Frames for a text of equal cells (at least one)."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.try_divide(chars.cast("double"), capacity.cast("double"))).cast("bigint"))


def bucket(coverage: Column) -> Column:
    """Bucket 1 to 1000 of a coverage above 0 (half away from zero; single precision)."""
    clamped = F.least(F.lit(1.0).cast("float"), F.greatest(F.lit(0.0).cast("float"), coverage.cast("float")))
    return F.greatest(F.lit(1), F.floor((clamped * F.lit(1000.0).cast("float")).cast("float") + F.lit(0.5).cast("float")).cast("int"))


def histogram(df: DataFrame, coverage: str, threshold: float) -> DataFrame:
    """Counts and shares of the coverage buckets; values of 0 and below count nowhere.

    ``black`` counts raw values above the threshold, ``survives`` compares the bucket.
    """
    limit = F.lit(threshold).cast("float")
    value = F.col(coverage).cast("float")
    counted = (
        df.where(value > 0)
        .groupBy(bucket(value).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"), F.count_if(value > limit).alias("black"))
    )
    level = (F.col("bucket").cast("float") / F.lit(1000.0).cast("float")).cast("float")
    total = F.sum("count").over(Window.partitionBy())  # at most 1000 rows
    return counted.select("bucket", level.alias("coverage"), "count", "black", (F.col("count") / total).alias("share"), (level > limit).alias("survives"))


def top_edges(buckets: DataFrame, n: int = 12) -> DataFrame:
    """The fullest buckets that are neither nearly blank nor nearly full."""
    inner = buckets.where((F.col("coverage") >= F.lit(0.01).cast("float")) & (F.col("coverage") < F.lit(0.999).cast("float")))
    return inner.orderBy(F.desc("count"), "bucket").limit(n)


def near_threshold(buckets: DataFrame, threshold: float, reach: float = 0.03) -> DataFrame:
    """Buckets within reach of the threshold, by coverage."""
    distance = F.abs(F.col("coverage") - F.lit(threshold).cast("float")).cast("float")
    return buckets.where(distance <= F.lit(reach).cast("float")).orderBy("bucket")


def shown_buckets(buckets: DataFrame, threshold: float, reach: float = 0.03, n: int = 8) -> DataFrame:
    """The buckets near the threshold; where there are none, the ``n`` fullest inner ones."""
    near, full = near_threshold(buckets, threshold, reach), top_edges(buckets, n)
    none = near.agg((F.count(F.lit(1)) == 0).alias("_none"))  # buckets are at most 1000 rows
    return near.unionByName(full.crossJoin(F.broadcast(none)).where("_none").drop("_none"))


def axis(value: Column, low: float, high: float, start: float, length: float, upwards: bool = False) -> Column:
    """Where a value lies on an axis of ``length`` from ``start``; ``upwards`` counts from its far end."""
    share = (value.cast("double") - low) / (high - low)
    return F.lit(float(start)) + (1 - share if upwards else share) * float(length)


def threshold_neighbours(buckets: DataFrame, threshold: float) -> DataFrame:
    """The next bucket above and the last at or below a threshold, and the largest share (1e-6 at least)."""
    limit = F.lit(threshold).cast("float")
    return buckets.agg(
        F.min(F.when(F.col("coverage") > limit, F.col("bucket"))).alias("next_above"),
        F.max(F.when(F.col("coverage") <= limit, F.col("bucket"))).alias("last_below"),
        F.greatest(F.max("share"), F.lit(1e-6)).alias("max_share"),
    )
