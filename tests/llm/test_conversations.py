import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomarc.llm import conversations as C

SCHEMA = "row_id bigint, session_id string, window_id bigint, line_no bigint, event_type string, message string, tokens_before bigint, event_ts timestamp_ntz, ingested_at timestamp_ntz"


def verdict(rows):
    """The definition of the verdicts, window by window."""
    out = {}
    for window in {r[2] for r in rows if r[2] is not None}:
        last = {}
        for r in rows:
            if r[2] == window and r[3] is not None:
                rank = (r[8] is not None, r[8] or 0, r[0])
                if r[3] not in last or rank > last[r[3]][0]:
                    last[r[3]] = (rank, r)
        if not last:
            continue
        read = [(n, *C.read_message(r[5])) for n, (_, r) in sorted(last.items()) if r[4] == "message"]
        calls = [(n, c) for n, _, cs, *_ in read for c in cs]
        results = [(n, r) for n, b, _, r, *_ in read if b & C.RESULT]
        spoken = ["u" if b & C.USER else "a" for _, b, *_ in read if b & C.TEXT and b & (C.USER | C.ASSISTANT)]
        bad = any(b & C.INVALID for _, b, *_ in read)
        bad |= any(c is None or not any(r == c and m > n for m, r in results) for n, c in calls)
        bad |= any(r is None or not any(c == r and m < n for m, c in calls) for n, r in results)
        if bad or spoken[:1] == ["a"]:
            out[window] = "broken"
        elif not spoken:
            out[window] = "empty"
        elif "uu" in "".join(spoken) or spoken[-1] == "u":
            out[window] = "missing_reply"
    return out


def generated(seed=1, windows=60):
    import datetime as dt

    rng = random.Random(seed)
    rows, row_id = [], 0
    roles = ["user", "User", "assistant", " ASSISTANT\n", "tool_result", "toolResult", "system", None, ""]
    for w in range(windows):
        for line in rng.sample(range(1, 20), rng.randint(1, 9)) if w else rng.sample(range(1, 30_000), 400):
            for _ in range(rng.choice([1, 1, 1, 2])):
                row_id += 1
                role = rng.choices(roles, [9, 2, 9, 2, 1, 1, 1, 0.05, 0.05])[0]
                content = rng.choice([None, "hi", " \n", [], [{"type": "text", "text": "x"}], [{"type": "text", "text": " "}, {"type": "toolCall", "id": rng.choice(["c1", "c2", None])}], [1]])
                message = {"role": role, "content": content}
                if "esult" in (role or "").lower():
                    message["toolCallId"] = rng.choice(["c1", "c2", None])
                text = rng.choices([json.dumps(message), "{", None, "[]"], [40, 0.3, 0.2, 0.1])[0]
                at = dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randint(0, 90_000))
                kind = rng.choices(["message", "compaction", "custom"], [20, 1, 1])[0]
                rows.append((row_id, "s", w, line, kind, text, None, rng.choice([at, at, None]), rng.choice([at, at + dt.timedelta(hours=1), None])))
    rows.append((0, "s", None, 1, "message", "{}", None, None, None))
    rows.append((0, "s", 3, None, "message", "{}", None, None, None))
    rng.shuffle(rows)
    return rows


def test_replay_equals_definition(spark, tmp_path):
    rows = generated()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    judged = C.judge_windows(spark, str(tmp_path / "t.parquet"))
    got = {r.window_id: r.defect for r in judged.collect()}
    assert {k: v for k, v in got.items() if v} == verdict(rows) and len(got) == 60
    turns = C.turns(spark.read.parquet(str(tmp_path / "t.parquet")), judged).collect()
    assert {t.window_id for t in turns} == {k for k, v in got.items() if v is None}
    for w in {t.window_id for t in turns}:
        own = sorted((t.turn_no, t.line_no) for t in turns if t.window_id == w)
        assert [n for n, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e.parquet"))
    assert C.judge_windows(spark, str(tmp_path / "e.parquet")).count() == 0


@pytest.mark.parametrize("width", [1, 2, 5])
def test_blocks_combine(spark, monkeypatch, width):
    """Summaries of small blocks give the verdicts of whole windows."""
    rows = [r for r in generated(7, 40) if r[2] is not None and r[3] is not None]
    rows = list({(r[2], r[3]): r for r in rows}.values())
    summaries = []
    for window in {r[2] for r in rows}:
        for block in {r[3] // width for r in rows if r[2] == window}:
            lines = []
            for r in sorted((r for r in rows if r[2] == window and r[3] // width == block), key=lambda r: r[3]):
                bits, calls, result = C.read_message(r[5])[:3] if r[4] == "message" else (0, [], None)
                lines.append((r[3], bits, calls, result))
            summaries.append({"window_id": window, "block": block, "version": 1, **C.summarize_block(lines)})
    df = spark.createDataFrame([tuple(s[c] for c in ("window_id", "block", "version", "messages", "invalid", "first_speaker", "last_speaker", "unanswered", "loose", "closed", "ids")) for s in summaries], C.SUMMARY)
    got = {r.window_id: r.defect for r in C.verdicts(df).where(F.col("defect").isNotNull()).collect()}
    assert got == verdict(rows)


class Held:
    """What Spark hands to a state function."""

    def __init__(self):
        self.get, self.hasTimedOut, self.mark, self.timeout = None, False, 0, None

    exists = property(lambda self: self.get is not None)

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def setTimeoutTimestamp(self, at):
        assert at > self.mark
        self.timeout = at


def feature(line, bits, at, ingested=0, row_id=0, window=1):
    return {"window_id": window, "block": 0, "line_no": line, "ingested": ingested, "row_id": row_id, "bits": bits, "calls": [], "result": None, "clock": pd.Timestamp(at, unit="ms")}


def test_redelivery_after_closure(spark):
    user, reply, close = C.MESSAGE | C.TEXT | C.USER, C.MESSAGE | C.TEXT | C.ASSISTANT, C.CLOSING
    state, own = Held(), C.ShardState(idle_ms=1000, retain_ms=5000, end_of_input_ms=None)

    def call(rows, mark):
        state.mark, state.hasTimedOut = mark, not rows
        return [r for frame in own((0,), iter([pd.DataFrame(rows)] if rows else []), state) for r in frame.to_dict("records")]

    assert call([feature(1, user, 100), feature(2, reply, 110), feature(3, close, 120)], 0) == []
    first = call([], 121)
    assert [(r["version"], r["messages"], r["first_speaker"]) for r in first] == [(1, 2, "user")]
    assert call([feature(1, user, 130, ingested=5)], 125) == []  # the same line again changes nothing
    second = call([feature(2, user, 140, ingested=6)], 130)  # another text of a line known does
    assert [(r["version"], r["messages"], r["unanswered"]) for r in second] == [(2, 2, True)]
    assert call([feature(2, reply, 150, ingested=3)], 140) == []  # delivered before what is known
    empty = {"ids": []}
    df = spark.createDataFrame([tuple({**r, **empty}[c] for c in ("window_id", "block", "version", "messages", "invalid", "first_speaker", "last_speaker", "unanswered", "loose", "closed", "ids")) for r in first + second], C.SUMMARY)
    assert [(r.window_id, r.messages, r.defect) for r in C.verdicts(df).collect()] == [(1, 2, "missing_reply")]
    assert state.exists and call([], state.timeout + 1) == [] and not state.exists  # forgotten
    # without a closing event the idle time decides
    assert call([feature(1, user, 9000)], 8000) == [] and call([], 9999) == [] and len(call([], 10_001)) == 1


def test_batches_and_watermarks(spark, tmp_path):
    """Blocks are emitted while later batches are still to come, and amended by them."""
    rows = generated(11, 50)
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "t.parquet"))
    spark.createDataFrame(rows[:5], SCHEMA).write.parquet(str(tmp_path / "t.parquet_old"))  # a neighbour is not read
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions")
    summaries = C.replay(spark, str(tmp_path / "t.parquet"), batches=5, idle="1 hour", lateness="10 minutes")
    versions = [r.version for r in summaries.collect()]
    assert max(versions) > 1 and min(versions) == 1
    assert {r.window_id: r.defect for r in C.verdicts(summaries).collect() if r.defect} == verdict(rows)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions"))


def test_roles_and_messages():
    assert {C.plain_role(x) for x in ("toolResult", "tool-result", "TOOL_RESULT ", "tool result")} == {"toolresult"}
    assert C.read_message('{"role":"user","content":NaN}')[0] & C.INVALID and C.read_message(None)[0] & C.INVALID
