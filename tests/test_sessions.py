import json

from pyspark.sql import functions as F

from loomarc.operators import layout as LO
from loomarc.operators import sessions as SE
from loomarc.operators import windows as W
from loomarc.sources import readers


def test_inline_and_prefix_traps():
    assert SE.plain_inline("**a** `b` [l](u) [x] y | [l]() [open") == "a b l u [x y   l [open"
    assert SE.plain_prefix("## > - a") == "a" and SE.plain_prefix("3.14 is") == "14 is"
    assert SE.dialogue_text("a\n```\ncode\n```\n- b\n<out>\n[shaken 1]\n" + "{" + "x" * 600) == "a b"
    assert SE.json_text({"b": 1.0, "a": [1e16, 1e-7, None, True, "é"]}) == '{"a":[1e16,1e-7,null,true,"é"],"b":1.0}'


def test_flatten():
    parts = [{"type": "text", "text": " a "}, {"type": "thinking", "thinking": "t"}, {"type": "toolCall", "id": "c", "name": "n", "arguments": {"b": 1, "a": 2}}, {"type": "image"}, {"k": 1}]
    assert SE.flatten(parts, False) == ' a \nt\n# Tool call n c\n{"a":2,"b":1}\n[unsupported content: image]\n{"k":1}'
    assert SE.flatten(parts, True).startswith("a\n[thinking]\nt\n[/thinking]\n") and "[unsupported assistant content: image]" in SE.flatten(parts, True)
    assert SE.flatten(None, False) == "" and SE.flatten({"a": 1}, True) == '{"a":1}'


def test_carriers(spark, tmp_path):
    msg = lambda **k: json.dumps(k)
    rows = [
        ("s", 1, "message", msg(role="user", content="Hello  *there*\n")), ("s", 2, "message", msg(role="assistant", content=[{"type": "text", "text": "Hi"}, {"type": "toolCall"}])),
        ("s", 3, "message", msg(role="toolResult", toolCallId="c1", content="out TOKEN=abc")), ("s", 4, "message", msg(content="x")), ("s", 5, "custom", None),
        ("s", 6, "compaction", None), ("s", 7, "message", msg(role="user", content="late")), ("s", 9, "compaction", None), ("s", 10, "message", msg(role="user", content="open")),
    ]
    events = spark.createDataFrame([(*r, None, None) for r in rows], "session_id string, line_no bigint, event_type string, message string, tokens_before bigint, event_ts string")
    got = {r["window_no"]: r for r in SE.carriers(SE.session_windows(events)).collect()}
    assert set(got) == {0, 1}
    first = got[0]
    assert first["eventized"] == "U: Hello there\n\nA: Hi"
    assert first["structured"] == "ARCHIVE EVENT STREAM\n｜ T001 U: Hello there\n｜ T002 A: Hi"
    assert first["serialized"] == "# User ¶\nHello  *there*\n\n# Assistant ¶\nHi\n# Tool call tool unknown\n{}\n\n# Tool result c1 ¶\n<out>\nout TOKEN=<redacted>\n</out>"
    assert (first["event_count"], first["message_count"], first["user_messages"], first["tool_results"], first["turns"]) == (5, 4, 1, 1, 2)
    pieces = SE.carrier_pieces(SE.session_windows(events))
    for n, row in got.items():
        for name, joint in SE.JOINTS.items():
            own = sorted((p.place, p.text) for p in pieces.collect() if (p.window_no, p.carrier) == (n, name))
            assert joint.join(t for _, t in own) == row[name]
    from loomarc.sources import writers

    writers.carrier_stream(pieces, str(tmp_path / "c"))
    for name in SE.JOINTS:
        files = list((tmp_path / "c" / "session_id=s" / "window_no=0" / f"carrier={name}").glob("*.txt"))
        assert len(files) == 1 and files[0].read_text(encoding="utf-8") == first[name] + "\n"
    meta = {r["window_no"]: r for r in SE.window_metadata(SE.carriers(SE.session_windows(events)), events).collect()}
    assert (meta[0]["start_line"], meta[0]["end_line"], meta[1]["end_line"]) == (1, 6, 9)


def test_running_sum_equals_one_window(spark):
    rows = [(k, n * 777 % 20_011, n % 3) for k in range(3) for n in range(400)]
    df = spark.createDataFrame(rows, "k int, n bigint, v int")
    from pyspark.sql import Window

    whole = F.coalesce(F.sum("v").over(Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = {(r.k, r.n): r.s for r in W.running_sum(df, "k", "n", F.col("v"), "s", block=1000).collect()}
    assert got == {(r.k, r.n): r.s for r in df.withColumn("s", whole).collect()}


def test_layout(spark):
    v = LO.Variant(frame_size=40, content_width=40, content_height=40, margin=4, ascent=8, descent=-2, advance=8)
    assert LO.pack("", v) == [0] and sum(LO.pack("a" * 50, v)) == 50
    tiny = LO.Variant(frame_size=4, content_width=4, content_height=4, margin=2)
    assert LO.pack("abc", tiny) == [1, 1, 1]
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r for r in LO.frames(df, "id", "t", v).collect()}
    assert got[1].frame_count == 1 and got[2].frames is None and got[3].frames[0].chars == 0
    assert LO.image_size("ab\nc", LO.Variant(margin=15)) == (765, 10 + 15 + 12 - 2 + 15)


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (0.0001,), (0.05,), (0.5,), (0.5,), (2.0,)], "c float")
    rows = {r.bucket: r for r in LO.histogram(df, "c", 0.3).collect()}
    assert {b: r["count"] for b, r in rows.items()} == {1: 1, 50: 1, 500: 2, 1000: 1}
    assert rows[500].survives and not rows[50].survives and rows[500].black == 2


def test_session_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"message","message":{"role":"user","content":"é"}}\n\n{"type":3}\r\n{"type":"compaction","tokensBefore":7,"timestamp":"T"}\n', encoding="utf-8")
    rows = readers.session_events(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.event_type, r.tokens_before, r.event_ts) for r in rows] == [(1, "message", None, None), (3, None, None, None), (4, "compaction", 7, "T")]
    assert json.loads(rows[0].message) == {"role": "user", "content": "é"} and rows[1].byte_len == 10
    (tmp_path / "b.jsonl").write_text("{bad\n")
    import pytest

    with pytest.raises(Exception, match="line 1"):
        readers.session_events(spark, str(tmp_path / "b.jsonl")).collect()
