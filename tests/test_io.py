import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomarc.operators import completion as C
from loomarc.sources import readers, writers
from loomarc.streaming.session_stream import activity, event_stream


def test_readers(spark, tmp_path):
    (tmp_path / "qa.json").write_text('[{"id":"a","question":"q","golds":["g"]}]')
    assert readers.qa_items(spark, str(tmp_path / "qa.json")).first()["score"] == "semantic"
    (tmp_path / "p.json").write_text('[{"id":"a","question":"q"}]')
    assert readers.probes(spark, str(tmp_path / "p.json")).first()["expect_contains"] == []
    (tmp_path / "v.json").write_text('[{"name":"n","font_path":"f","font_size":12,"threshold":0.3,"line_spacing":0,"frame_size":1568}]')
    v = readers.variants(spark, str(tmp_path / "v.json")).first()
    assert (v["max_width"], v["margin"]) == (750.0, 15.0)
    (tmp_path / "lcc.jsonl").write_text('{"input":"i","context":"c","answers":["a"],"_id":"1"}\n{"input":"j","answers":[]}\n')
    assert [r["position"] for r in readers.source_items(spark, str(tmp_path / "lcc.jsonl")).collect()] == [0, 1]
    with pytest.raises(FileNotFoundError):
        readers.frame_images(spark, str(tmp_path))
    images = spark.createDataFrame([(1, bytearray(b"x" * 100)), (0, bytearray(b"y"))], "frame_no int, content binary")
    writers.frame_files(images, str(tmp_path / "frames"))
    urls = [r["url"] for r in readers.frame_images(spark, str(tmp_path / "frames")).collect()]
    assert urls[0] == "data:image/png;base64,eQ==" and "\n" not in urls[1]
    assert readers.frame_stats(spark, [str(tmp_path / "none.json")]).first()["frames"] == 0
    with pytest.raises(ValueError):
        readers.environment("SURELY_NOT_SET_ANYWHERE")


def test_runs(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(json.dumps({"id": name}))
    assert [r["id"] for r in readers.runs(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert [r["id"] for r in readers.runs(spark, str(tmp_path / "b")).collect()] == ["b"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"x', 1.0), ("c", "d", None)], "a string, b string, f double").coalesce(1)
    writers.csv_rows(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert '"a,b"' in text and '"q""x"' in text and "\nc,d," in text
    writers.pretty_json(df, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() > 2
    assert writers.markdown_table(["x"], [["1"]]) == "| x |\n| --- |\n| 1 |"
    assert writers.percent(0.5) == "50.0%" and writers.format_fixed(None) == "—"
    writers.run_manifest({"id": "r"}, df, str(tmp_path / "run"))
    assert json.loads((tmp_path / "run" / "run.json").read_text())["cases"][1]["a"] == "c"


def test_completion(spark):
    asked = spark.createDataFrame([(1, "q1"), (2, "q2")], "id int, prompt string")
    assert {r.answer for r in C.complete(asked, lambda rs: [r["prompt"].upper() for r in rs]).collect()} == {"Q1", "Q2"}
    recorded = spark.createDataFrame([(1, "a")], "id int, answer string")
    assert {r.id: r.answer for r in C.replay(asked, recorded, "id").collect()} == {1: "a", 2: None}
    body = asked.select(C.chat_request(F.lit("m"), F.col("prompt"), F.lit(5)).alias("b")).first()["b"]
    assert json.loads(body)["messages"][0] == {"role": "user", "content": "q1"} and json.loads(body)["stream"] is False
    reply = spark.createDataFrame([('{"choices":[{"message":{"content":"x"}}]}',)], "b string")
    assert reply.select(C.response_text(F.col("b"))).first()[0] == "x"


def test_stream(spark, small, tmp_path):
    path = f"{small}/session_events.parquet"
    query = activity(event_stream(spark, path)).writeStream.format("memory").queryName("acts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = spark.sql("select sum(events) from acts").first()[0]
    assert streamed == spark.read.parquet(path).where("event_ts is not null").count()


def test_entry(spark, small):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0


def test_the_core_does_not_need_the_training_operators():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "loomarc"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "loomarc.llm" not in path.read_text(), path


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Files read in many splits: numbers as if read in one piece, CR LF and blank lines included."""
    texts = {f"s{k}.jsonl": "".join(f'{{"type":"t","n":{i},"pad":"{"x" * (i % 37)}"}}' + ("\r\n" if i % 3 else "\n") + ("\n" if i % 11 == 0 else "") for i in range(400 + k)) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "empty.jsonl").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20
        got = {(r.path.rsplit("/", 1)[1], r.line_no): r.line for r in lines.collect()}
        events = readers.session_events(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(name, i + 1): line.removesuffix("\r") for name, text in texts.items() for i, line in enumerate(text.removesuffix("\n").split("\n"))}
    assert got == want and events == sum(line != "" for line in want.values())
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\n{bad\n')
    with pytest.raises(Exception, match="cannot parse bad.jsonl line 3"):
        readers.session_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_sinks_of_frames_and_transcripts(spark, tmp_path):
    from loomarc.operators import layout, scoring

    texts = spark.createDataFrame([("a", "some text"), ("b", None)], "name string, text string")
    laid = layout.frames(texts, "name", "text", layout.Variant())
    writers.frame_manifests(laid, {"font": "f.ttf", "threshold": 0.3}, f"file://{tmp_path}/manifests", "name")
    record = json.loads("".join(next((tmp_path / "manifests" / "name=a").glob("*.txt")).read_text()))
    assert (record["font"], record["frame_count"], record["frames"][0]["chars"]) == ("f.ttf", 1, 9)
    scored = scoring.ocr_scores(spark.createDataFrame([("a", "abc", "abd"), ("b", "x", None)], "name string, source string, out string"), "source", "out")
    metrics = {r.name: json.loads(r.metrics) for r in writers.transcripts(scored, str(tmp_path / "t"), "name", "out").collect()}
    assert metrics["a"]["strict"]["edit_distance"] == 1 and metrics["b"]["normalized"]["lcs_chars"] == 0
    assert next((tmp_path / "t" / "name=a").glob("*.txt")).read_text().strip() == "abd"
    assert writers.frame_files(spark.createDataFrame([(0, bytearray(b"y"))], "frame_no int, content binary"), f"file://{tmp_path}/f") == 1
    assert (tmp_path / "f" / "frame-0000.png").read_bytes() == b"y"
    writers.run_manifest({}, texts.limit(0), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none" / "run.json").read_text()) == {"cases": []}


def test_report(spark, tmp_path):
    from loomarc.operators import summary

    rows = [("t", "text", "1", "x", "exact", True, True, 1.0, "exact", 0, 0.0), ("t", "text", "2", "y", "semantic", False, False, 0.5, "none", 0, 0.0), ("i", "image", "1", "x", "exact", True, False, 0.8, "none", 2, 10.0), ("j", "image", "1", "x", "exact", True, False, 0.8, "none", 2, 10.0)]
    cases = spark.createDataFrame(rows, "run string, mode string, id string, task string, score string, correct boolean, exact_match boolean, f1 double, match_kind string, frames bigint, chars_per_frame double")
    report = writers.markdown_report(summary.summarize(summary.with_eligibility(cases)), cases, "today", "results.json", ["a note"])
    assert "(i) keeps 80.0%" in report and "| task | i | j | t |" in report and "| 2 | y | 0.5000 | none |" in report and "- a note" in report
    assert report.index("| t | 1.0000") < report.index("| i | 0.8000 | 1/1") < report.index("| j | 0.8000 | 1/1")
    none = writers.markdown_report(summary.summarize(summary.with_eligibility(cases.limit(0))), cases.limit(0))
    assert "no pair" in none
    (tmp_path / "r.json").write_text('{"generated_at":"now","runs":[{"run":"a"},{"run":"b"}]}')
    found, made = readers.result_summaries(spark, str(tmp_path / "r.json"))
    assert made == "now" and found.count() == 2


def test_presets_axes_and_paths(spark):
    from loomarc.operators import layout

    assert layout.preset("text", "anything") is None and layout.preset("image").font_size == 24.0 and layout.preset("image", "zpix18-half-049-2000").frame_size == 2000
    for mode, name in (("image", "nothing"), ("video", None)):
        with pytest.raises(ValueError):
            layout.preset(mode, name)
    runs = spark.createDataFrame([("text", "x"), ("image", "zpix24-binary-2000")], "mode string, preset string")
    assert [r.font_size for r in layout.with_presets(runs).orderBy("mode").collect()] == [24.0, None]
    with pytest.raises(Exception, match="unknown preset x"):
        layout.with_presets(runs.withColumn("mode", F.lit("image"))).collect()
    at = spark.range(1).select(layout.axis(F.lit(90), 60, 120, 140, 1320).alias("x"), layout.axis(F.lit(0.98), 0.78, 0.98, 235, 475, True).alias("y")).first()
    assert at["x"] == 800.0 and abs(at["y"] - 235) < 1e-9
    assert writers.inside("/r", "a/../b.txt") == "/r/b.txt" and writers.inside("/r", "/a/b") == "/r/a/b"
    for path in ("../x", "a/../../x", "..", "C:/x", "..\\x"):
        with pytest.raises(ValueError):
            writers.inside("/r", path)
    assert writers.now_iso().endswith("Z") and len(writers.now_iso()) == 24


def test_shown_buckets(spark):
    from loomarc.operators import layout

    rows = [(b, b / 1000, 100 - b, 0, 0.1, False) for b in range(20, 40)]
    df = spark.createDataFrame(rows, "bucket int, coverage float, count bigint, black bigint, share double, survives boolean")
    assert [r.bucket for r in layout.shown_buckets(df, 0.9).collect()] == [*range(20, 28)]
    assert layout.shown_buckets(df, 0.03).count() == 20 and layout.shown_buckets(df.limit(0), 0.5).count() == 0


def test_one_rule_for_markdown_marks(spark):
    from loomarc.functions import text as T
    from loomarc.operators.sessions import plain_prefix

    lines = ["# a", "## # > - b", "> 1. c", "3.14 is", "- 1. x", "*x", "1.", "12", "  + \u3000y", "", "#", "> > z", "9.a b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    got = [r.f for r in df.select("i", T.strip_markdown_prefix(F.col("x")).alias("f")).orderBy("i").collect()]
    assert got == [plain_prefix(x) for x in lines]
