"""Rebuilding conversations from message rows: keyed streaming state, event-time watermarks.

Rows become small *line features* (role, has text, call ids, result id) before anything is
shuffled; texts never enter the state. A Structured Streaming query keeps, per
``(window, block of lines)``, the latest delivery of each line, buffers late arrivals, and
emits one *block summary* when the block is closed or times out. A closed block is kept for
``retain`` longer: a redelivery or late line that changes it gives a new version of its summary,
and the newest version counts. Blocks are bounded by ``LINES_PER_BLOCK`` distinct lines and spread
by hash over state shards, so a window that holds a third of all rows lies on many keys. Block
summaries combine associatively (first and last speaker, an unanswered user inside, call and
result line ranges), so the verdict of a window needs only its few summaries.

A finished table is replayed in the order of arrival, in several batches between which the
watermark moves (``replay``), so closure, timeout and late lines take place as in a live stream.

Defined results:

* null window id or line number: no conversation can hold the row; it is left out.
* the clock of a row is when it arrived: its ingestion time, else its event time, else
  ``EARLIEST``, which also replaces earlier times. Clocks may be wrong: in a replay they only decide
  when a row is read. In a live stream rows behind the watermark are dropped by Spark.
* equal window, line and ingestion time: the larger row id counts.
* a message that is null, not JSON or no JSON object: ``broken`` for its window.
* a window without messages: ``empty``. An empty table: no rows.
* input columns with other names are ignored.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomarc.runtime import discard, make_folder, move, scratch_path, small_or_shuffled, spread

LINES_PER_BLOCK = 4096
ROWS_PER_SHARD = 4096
#: Rows of a state partition and of a batch of a replay.
ROWS_PER_PARTITION, ROWS_PER_BATCH, MOST_BATCHES = 200_000, 100_000_000, 100
#: Event time of rows that have none or an earlier one.
EARLIEST = "1971-01-01"

# What a line is, as bits.
MESSAGE, INVALID, TEXT, USER, ASSISTANT, RESULT, CLOSING = 1, 2, 4, 8, 16, 32, 64

_SEPARATORS = dict.fromkeys(map(ord, " \t\r\n\f\v_-./: 　"))


def _constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_constant, parse_int=str, parse_float=str)


def plain_role(role) -> str:
    """A role without case, blanks and separators; '' for no role."""
    if not isinstance(role, str):
        return ""
    return "".join(role.translate(_SEPARATORS).split()).casefold()


def read_message(text: str | None) -> tuple[int, list, str | None, str, str]:
    """(bits, tool call ids, tool result id, role, text) of one message."""
    try:
        value = _DECODER.decode(text) if text is not None else None
    except (ValueError, RecursionError):
        value = None
    role = plain_role(value.get("role")) if isinstance(value, dict) else ""
    if not role:
        return MESSAGE | INVALID, [], None, "", ""
    content, calls, texts = value.get("content"), [], []
    if isinstance(content, str):
        texts.append(content)
    elif isinstance(content, list):
        for part in content:
            if isinstance(part, dict):
                if part.get("type") == "text" and isinstance(part.get("text"), str):
                    texts.append(part["text"])
                elif part.get("type") == "toolCall":
                    calls.append(part["id"] if isinstance(part.get("id"), str) else None)
    text = "\n".join(t for t in texts if t.strip())
    bits = MESSAGE | (TEXT if text else 0)
    bits |= {"user": USER, "assistant": ASSISTANT, "toolresult": RESULT}.get(role, 0)
    result = value.get("toolCallId") if bits & RESULT else None
    return bits, calls, result if isinstance(result, str) else None, role, text


FEATURES = (
    "window_id bigint, block bigint, line_no bigint, ingested bigint, row_id bigint, bits int, "
    "calls array<string>, result string, clock timestamp"
)


def clock() -> Column:
    """The arrival of a row; never at or below the epoch, where a watermark starts and would drop it."""
    seen = F.coalesce(F.col("ingested_at").cast("timestamp"), F.col("event_ts").cast("timestamp"))
    return F.coalesce(F.greatest(seen, F.lit(EARLIEST).cast("timestamp")), F.lit(EARLIEST).cast("timestamp"))


def line_features(rows: DataFrame) -> DataFrame:
    """Line features of message rows; one Arrow pass, no shuffle, the texts stop here.

    An id that is missing is kept as null: a call or result without an id can't be matched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, messages = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            bits, calls, results = [], [], []
            for kind, message in zip(kinds, messages):
                if kind == "message":
                    b, c, r, _, _ = read_message(message)
                else:
                    b, c, r = (CLOSING if kind == "compaction" else 0), [], None
                bits.append(b)
                calls.append([_storable(x) for x in c])
                results.append(_storable(r))
            lines = batch.column(1)
            blocks = pa.array([n // LINES_PER_BLOCK for n in lines.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), blocks, lines, batch.column(2), batch.column(3), pa.array(bits, pa.int32()),
                    pa.array(calls, pa.list_(pa.string())), pa.array(results, pa.string()), batch.column(6),
                ],
                names=["window_id", "block", "line_no", "ingested", "row_id", "bits", "calls", "result", "clock"],
            )

    kind = F.col("event_type")
    return (
        rows.where(F.col("window_id").isNotNull() & F.col("line_no").isNotNull())
        .select(
            "window_id",
            "line_no",
            F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(1 << 62))).alias("ingested"),
            F.coalesce("row_id", F.lit(-1)).alias("row_id"),
            kind.alias("kind"),
            F.when(kind == "message", F.col("message")).alias("message"),
            clock().alias("clock"),
        )
        .mapInArrow(run, FEATURES)
    )


def _storable(x: str | None) -> str | None:
    return None if x is None else x.encode("utf-8", "replace").decode()


STATE = "blocks binary"
SUMMARY = (
    "window_id bigint, block bigint, version int, messages bigint, invalid boolean, first_speaker string, last_speaker string, "
    "unanswered boolean, loose boolean, closed boolean, "
    "ids array<struct<id: string, call_min: bigint, call_max: bigint, result_min: bigint, result_max: bigint>>"
)


def summarize_block(lines: list[tuple]) -> dict:
    """The summary of one block from its lines (line_no, bits, calls, result), in line order."""
    first = last = None
    unanswered = invalid = loose = closed = False
    messages, ids = 0, {}
    for line, bits, calls, result in lines:
        closed |= bool(bits & CLOSING)
        if not bits & MESSAGE:
            continue
        messages += 1
        invalid |= bool(bits & INVALID)
        for call in calls:
            if call is None:
                loose = True
            else:
                seen = ids.setdefault(call, [None, None, None, None])
                seen[0], seen[1] = line if seen[0] is None else seen[0], line
        if bits & RESULT:
            if result is None:
                loose = True
            else:
                seen = ids.setdefault(result, [None, None, None, None])
                seen[2], seen[3] = line if seen[2] is None else seen[2], line
        if bits & TEXT and bits & (USER | ASSISTANT):
            who = "user" if bits & USER else "assistant"
            unanswered |= who == "user" and last == "user"
            first, last = first or who, who
    return {
        "messages": messages, "invalid": invalid, "first_speaker": first, "last_speaker": last,
        "unanswered": unanswered, "loose": loose, "closed": closed,
        "ids": [{"id": k, "call_min": v[0], "call_max": v[1], "result_min": v[2], "result_max": v[3]} for k, v in ids.items()],
    }


class Block:
    """The lines of one block known so far, and what was emitted of it."""

    __slots__ = ("clock", "closed", "lines", "version", "changed")

    def __init__(self) -> None:
        self.clock, self.closed, self.lines, self.version, self.changed = 0, False, {}, 0, False

    def add(self, line, ingested, row_id, bits, calls, result, clock) -> None:
        self.clock = max(self.clock, clock)
        self.closed |= bool(bits & CLOSING)
        known = self.lines.get(line)
        if known is None or (ingested, row_id) > known[:2]:
            self.changed |= known is None or known[2:] != (bits, calls, result)
            self.lines[line] = (ingested, row_id, bits, calls, result)

    def __getstate__(self):
        return tuple(getattr(self, name) for name in self.__slots__)

    def __setstate__(self, values) -> None:
        for name, value in zip(self.__slots__, values):
            setattr(self, name, value)


class ShardState:
    """The state function of one shard: the blocks of some windows.

    A call of a state function costs milliseconds however few rows it gets, so blocks
    share keys: a shard holds about ``ROWS_PER_SHARD`` rows. A block is due when its closing
    event was seen and the watermark has passed its last arrival, or ``idle_ms`` later without one.
    It is emitted then, once more whenever a later line changes it, and forgotten ``retain_ms``
    after its last arrival (None: never).
    """

    def __init__(self, idle_ms: int, retain_ms: int | None, end_of_input_ms: int | None):
        self.idle_ms, self.retain_ms, self.end_ms = idle_ms, retain_ms, end_of_input_ms

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blocks: dict[tuple, Block] = pickle.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for frame in frames:
                columns = [frame[c].tolist() for c in ("window_id", "block", "line_no", "ingested", "row_id", "bits", "calls", "result")]
                clocks = (frame["clock"].astype("datetime64[ms]").astype("int64")).tolist()
                for window, block, line, ingested, row_id, bits, calls, result, clock in zip(*columns, clocks):
                    held = blocks.get((window, block))
                    if held is None:
                        held = blocks[(window, block)] = Block()
                    held.add(line, ingested, row_id, bits, tuple(calls), result, clock)
        now = state.getCurrentWatermarkMs()
        due = [k for k, held in blocks.items() if held.changed and (held.version or self._due(held) <= now)]
        if due:
            yield self._emit({k: blocks[k] for k in due})
        if self.retain_ms is not None:
            blocks = {k: held for k, held in blocks.items() if held.changed or self._due(held) + self.retain_ms > now}
        if blocks:
            state.update((pickle.dumps(blocks, protocol=5),))
            times = [self._due(held) if held.changed else self._due(held) + self.retain_ms for held in blocks.values() if held.changed or self.retain_ms is not None]
            if times:
                state.setTimeoutTimestamp(max(min(times), now + 1))
        elif state.exists:
            state.remove()

    def _due(self, held: Block) -> int:
        due = held.clock + (0 if held.closed else self.idle_ms)
        return due if self.end_ms is None else min(due, self.end_ms)

    def _emit(self, blocks: dict[tuple, Block]) -> pd.DataFrame:
        rows = []
        for (window, block), held in blocks.items():
            held.version, held.changed = held.version + 1, False
            found = summarize_block([(n, *held.lines[n][2:]) for n in sorted(held.lines)])
            rows.append({"window_id": window, "block": block, "version": held.version, **found})
        return pd.DataFrame(rows)


def _ms(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def stream_summaries(
    features: DataFrame, shards: int, idle: str = "1 day", lateness: str = "1 hour", retain: str | None = "30 days", end_of_input_ms: int | None = None
) -> DataFrame:
    """Versions of block summaries of a stream of line features.

    The watermark is ``lateness`` behind the latest arrival. ``end_of_input_ms`` is for replays of
    a finite table: the time by which every block still open is due.
    """
    return (
        features.withColumn("shard", F.pmod(F.xxhash64("window_id", "block"), F.lit(shards)))
        .withWatermark("clock", lateness)
        .groupBy("shard")
        .applyInPandasWithState(
            ShardState(_ms(idle), None if retain is None else _ms(retain), end_of_input_ms), SUMMARY, STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def replay(spark: SparkSession, path: str, batches: int = 3, idle: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Run the streaming query over a finite table until all of it is emitted.

    Line features are written once, by quantiles of their arrival (no shuffle), and moved
    into the watched folder one quantile after another: a batch never holds a row that arrived
    before the one before it ended, so none is late, while lines come after their block was
    closed or timed out and amend it. At least ``batches`` batches, and as many as keep one within
    ``ROWS_PER_BATCH`` rows, up to ``MOST_BATCHES`` of then more rows. Nothing is forgotten before the end (``retain`` is None), as the last
    delivery of a line counts whenever it arrives. State is kept in RocksDB below the shared folder, not in
    executor heaps. The query has a session of its own: settings of the caller's do not change.
    """
    rows = spark.read.parquet(path)
    count = rows.count()
    batches = max(batches, min(MOST_BATCHES, -(-count // ROWS_PER_BATCH)))
    shares = [(i + 1) / batches for i in range(batches - 1)]
    last, bounds = rows.agg(F.unix_millis(F.max(clock())), F.percentile_approx(F.unix_millis(clock()), shares or [0.5], 1000)).first()
    where = scratch_path(spark, "conversations")
    number = F.size(F.filter(F.lit((bounds or [])[: len(shares)]).cast("array<bigint>"), lambda bound: bound < F.unix_millis("clock")))
    line_features(spread(rows)).withColumn("batch", number).write.partitionBy("batch").parquet(where + "/staged")
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(max(spark.sparkContext.defaultParallelism, -(-count // ROWS_PER_PARTITION))))
    shards = max(16, -(-count // ROWS_PER_SHARD))
    end_ms = None if last is None else last - _ms(lateness) - 1
    make_folder(spark, where + "/in")
    for i in range(batches):
        if i == batches - 1:  # after the last rows the watermark moves once more, and every block is due
            own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
        move(spark, f"{where}/staged/batch={i}", f"{where}/in/{i}")
        arrived = own.readStream.schema(FEATURES).option("recursiveFileLookup", "true").parquet(where + "/in")
        query = (
            stream_summaries(arrived, shards, idle, lateness, None, end_ms)
            .writeStream.format("parquet")
            .option("path", where + "/out")
            .option("checkpointLocation", where + "/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    for done in ("staged", "in", "checkpoint"):
        discard(spark, f"{where}/{done}")
    return spark.read.schema(query_schema(spark)).parquet(where + "/out")


def query_schema(spark: SparkSession):
    return spark.createDataFrame([], SUMMARY).schema


def verdicts(summaries: DataFrame) -> DataFrame:
    """One row per window: window_id, messages, closed, defect (null for a sound conversation).

    Of each block the newest version counts. Shuffles summaries only. Blocks of one window are few (lines / LINES_PER_BLOCK), so the
    window function over them stays small even for the largest window.
    """
    parts = [F.col(c) for c in summaries.columns if c not in ("window_id", "block", "version")]
    newest = summaries.groupBy("window_id", "block").agg(F.max_by(F.struct(*parts), "version").alias("s"))
    summaries = newest.select("window_id", "block", "s.*")
    ids = summaries.select("window_id", F.explode("ids").alias("x")).select("window_id", "x.*")
    # A tool id seen in one block only is settled there; ids that span blocks meet by (window, id).
    unmatched = (
        ids.groupBy("window_id", "id")
        .agg(F.min("call_min").alias("c0"), F.max("call_max").alias("c1"), F.min("result_min").alias("r0"), F.max("result_max").alias("r1"))
        .where(
            (F.col("c0").isNotNull() & ~F.coalesce(F.col("r1") > F.col("c1"), F.lit(False)))
            | (F.col("r0").isNotNull() & ~F.coalesce(F.col("c0") < F.col("r0"), F.lit(False)))
        )
        .select("window_id", F.lit(True).alias("unmatched"))
        .distinct()
    )
    spoken = F.col("first_speaker").isNotNull()
    order = Window.partitionBy("window_id").orderBy("block")
    before = F.last("last_speaker", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    per_block = summaries.withColumn("across", spoken & (F.col("first_speaker") == "user") & (before == "user"))
    per_window = per_block.groupBy("window_id").agg(
        F.sum("messages").alias("messages"),
        F.bool_or("closed").alias("closed"),
        (F.bool_or("invalid") | F.bool_or("loose")).alias("faulty"),
        F.min_by("first_speaker", F.when(spoken, F.col("block"))).alias("first_speaker"),
        F.max_by("last_speaker", F.when(spoken, F.col("block"))).alias("last_speaker"),
        (F.bool_or("unanswered") | F.coalesce(F.bool_or("across"), F.lit(False))).alias("unanswered"),
    )
    defect = (
        F.when(F.col("faulty") | F.col("unmatched").isNotNull() | (F.col("first_speaker") == "assistant"), "broken")
        .when(F.col("first_speaker").isNull(), "empty")
        .when(F.col("unanswered") | (F.col("last_speaker") == "user"), "missing_reply")
    )
    return per_window.join(unmatched, "window_id", "left").select("window_id", "messages", "closed", defect.alias("defect"))


TURNS = "window_id bigint, line_no bigint, role string, text string, tool_call_id string, calls array<string>"


def turns(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The ordered turns of the sound windows: window_id, turn_no, line_no, role, text, tool_call_id, calls.

    ``turn_no`` counts from 0 within the window. It is built from counts per block of
    lines and a position within the block, so a giant window is never sorted in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_message(m) for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([_storable(x[3]) for x in read], pa.string()), pa.array([_storable(x[4]) for x in read], pa.string()),
                    pa.array([_storable(x[2]) for x in read], pa.string()),
                    pa.array([[_storable(c) for c in x[1]] for x in read], pa.list_(pa.string())),
                ],
                names=["window_id", "line_no", "role", "text", "tool_call_id", "calls"],
            )

    newest = F.struct(F.unix_micros(F.col("ingested_at").cast("timestamp")), "row_id")
    sound = small_or_shuffled(judged.where(F.col("defect").isNull()).select("window_id"))
    latest = (
        rows.where(F.col("window_id").isNotNull() & F.col("line_no").isNotNull())
        .join(sound, "window_id", "left_semi")  # texts of other windows are never shuffled
        .groupBy("window_id", "line_no")
        .agg(F.max_by(F.struct("event_type", "message"), newest).alias("m"))
        .where(F.col("m.event_type") == "message")
        .select("window_id", "line_no", F.col("m.message").alias("message"))
    )
    kept = latest.mapInArrow(run, TURNS)
    block = F.floor(F.col("line_no") / LINES_PER_BLOCK).alias("block")
    counts = latest.groupBy("window_id", block).agg(F.count(F.lit(1)).alias("n"))  # of lines, before texts are read
    before = F.sum("n").over(Window.partitionBy("window_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("window_id", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("window_id", "block").orderBy("line_no")) - 1
    return (
        kept.withColumn("block", block)
        .withColumn("within", within)
        .join(offsets, ["window_id", "block"])
        .select(
            "window_id", (F.col("within") + F.col("offset")).cast("bigint").alias("turn_no"),
            "line_no", "role", "text", "tool_call_id", "calls",
        )
    )


def judge_windows(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts of all windows of a table file or folder."""
    return verdicts(replay(spark, path))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_windows(spark, f"{sf_dir}/session_events.parquet")
    return judged.where(F.col("defect").isNotNull()).select("window_id", "defect")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/session_events.parquet"
    return turns(spark.read.parquet(path), judge_windows(spark, path))


def window_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows and messages end how: defect ('none' for sound ones), windows, messages."""
    judged = judge_windows(spark, f"{sf_dir}/session_events.parquet")
    return judged.groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("messages").alias("messages")
    )
