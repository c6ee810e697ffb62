"""Queries of scoring, runs, sessions, datasets and layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomarc.functions import text as T
from loomarc.operators import dataset as D
from loomarc.operators import layout as LO
from loomarc.operators import scoring as SC
from loomarc.operators import sessions as SE
from loomarc.operators import summary as SU
from loomarc.operators import windows as W
from loomarc.plans import sql as S
from loomarc.runtime import materialize, small_or_shuffled, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DAY = 86_400_000_000
PROBES = [("p1", ["f1568"]), ("p2", ["mono", "l2"]), ("p3", [])]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# --- scoring -------------------------------------------------------------------------


def _scored(spark, sf_dir):
    answers = table(spark, sf_dir, "recall_answers").select("answer_id", "variant", "qa_id", "answer", "answered_at")
    items = table(spark, sf_dir, "recall_qa").select("qa_id", "golds", F.coalesce("score", F.lit("semantic")).alias("score"))
    return SC.score_answers(answers.join(small_or_shuffled(items), "qa_id"), "qa_id")


_FORM = "CASE WHEN mode = 'exact' THEN {trim} ELSE {norm} END"
_SCORED = f"""WITH r AS (
 SELECT a.answer_id, a.variant, a.qa_id, a.answered_at, coalesce(a.answer,'') AS answer, q.golds, coalesce(q.score,'semantic') AS mode
 FROM recall_answers a JOIN recall_qa q USING (qa_id)
), g AS (
 SELECT *, unnest(golds) AS gold, generate_subscripts(golds, 1) AS pos FROM r
), n AS (
 SELECT *, {_FORM.format(trim=S.trim('answer'), norm=S.normalize('answer'))} AS a, {_FORM.format(trim=S.trim('gold'), norm=S.normalize('gold'))} AS b FROM g
), l AS (SELECT *, string_split(a,'') AS x, string_split(b,'') AS y FROM n
), c AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN length(a) ELSE {S.lcs('x', 'y')} END AS common FROM l
), f AS (SELECT *, {S.f1('a', 'b', 'common')} AS f1,
  list_filter(list_transform(regexp_split_to_array(gold, {S.q(S.WS[:-1] + '，、。,;；]')}), lambda z: {S.normalize('z')}), lambda z: length(z) >= 2) AS cl FROM c
), k AS (SELECT *, CASE WHEN a = b THEN 'exact' WHEN mode <> 'exact' AND contains(a, b) THEN 'contains_gold'
  WHEN mode <> 'exact' AND len(cl) > 0 AND len(list_filter(cl, lambda z: NOT contains(a, z))) = 0 THEN 'semantic_clauses'
  WHEN mode <> 'exact' AND f1 >= 0.85 THEN 'high_f1_semantic' ELSE 'none' END AS kind FROM f
), s AS (SELECT answer_id, any_value(variant) AS variant, any_value(qa_id) AS qa_id, any_value(mode) AS score, any_value(answered_at) AS answered_at,
  bool_or(kind = 'exact') AS exact_match, bool_or(kind <> 'none') AS correct, max(f1) AS f1, arg_max(gold, (f1, -pos)) AS best_gold,
  CASE WHEN bool_or(kind = 'exact') THEN 'exact' ELSE coalesce(arg_min(kind, pos) FILTER (kind <> 'none'), 'none') END AS match_kind
 FROM k GROUP BY answer_id)
"""


@query(_SCORED + "SELECT answer_id, exact_match, correct, f1, best_gold, match_kind FROM s")
def qa_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("answer_id", "exact_match", "correct", "f1", "best_gold", "match_kind")


@query(_SCORED + "SELECT variant, count(*) AS items, count(*) FILTER (correct) AS correct, count(*) FILTER (exact_match) AS exact, (count(*) FILTER (exact_match))::DOUBLE / count(*) AS em, avg(f1) AS mean_f1 FROM s GROUP BY variant")
def qa_totals(spark, sf_dir):
    return SC.totals(_scored(spark, sf_dir), "variant")


@query("SELECT a.answer_id, list_filter(q.golds, lambda g: NOT contains(coalesce(a.answer,''), g)) AS missing, len(list_filter(q.golds, lambda g: NOT contains(coalesce(a.answer,''), g))) = 0 AS passed FROM recall_answers a JOIN recall_qa q USING (qa_id)")
def probe_contains_all(spark, sf_dir):
    items = table(spark, sf_dir, "recall_qa").select("qa_id", F.col("golds").alias("expect_contains"))
    rows = table(spark, sf_dir, "recall_answers").select("qa_id", "answer_id", "answer").join(small_or_shuffled(items), "qa_id")
    return SC.probe_results(rows).select("answer_id", "missing", "passed")


@query("SELECT a.variant, count(*) FILTER (len(list_filter(q.golds, lambda g: NOT contains(coalesce(a.answer,''), g))) = 0) AS passed, count(*) AS total, (count(*) FILTER (len(list_filter(q.golds, lambda g: NOT contains(coalesce(a.answer,''), g))) = 0))::DOUBLE / count(*) * 100 AS rate FROM recall_answers a JOIN recall_qa q USING (qa_id) GROUP BY 1")
def variant_pass_rate(spark, sf_dir):
    items = table(spark, sf_dir, "recall_qa").select("qa_id", F.col("golds").alias("expect_contains"))
    rows = table(spark, sf_dir, "recall_answers").select("qa_id", "variant", "answer").join(small_or_shuffled(items), "qa_id")
    return SC.pass_rates(SC.probe_results(rows), "variant")


@query("SELECT variant, p.id, len(list_filter(p.e, lambda x: NOT contains(variant, x))) = 0 AS passed FROM (SELECT DISTINCT variant FROM recall_answers WHERE variant IS NOT NULL), (VALUES ('p1',['f1568']),('p2',['mono','l2']),('p3',[]::VARCHAR[])) p(id,e)")
def variant_probe_matrix(spark, sf_dir):
    """Every variant (its name stands for its transcript) with every one of three fixed probes; both are settings."""
    probes = spark.createDataFrame(PROBES, "id string, expect_contains array<string>")
    names = table(spark, sf_dir, "recall_answers").select("variant").where(F.col("variant").isNotNull()).distinct()
    return SC.probe_results(SU.variant_probes(names.withColumn("answer", F.col("variant")), probes)).select("variant", "id", "passed")


@query()
def ocr_metrics(spark, sf_dir):
    """Character metrics of each answer as a transcript of its best gold (character edits; DuckDB counts bytes)."""
    rows = table(spark, sf_dir, "recall_answers").select("answer_id", "best_gold", "answer")
    scored = SC.ocr_scores(rows, "best_gold", "answer")
    return scored.select("answer_id", F.col("strict.edit_distance").alias("edits"), F.col("strict.cer").alias("cer"), F.col("normalized.char_recall").alias("recall"), F.col("normalized.char_precision").alias("precision"))


def _ends(column: str) -> str:
    return S.trim(f"replace(coalesce({column}, ''), chr(13)||chr(10), chr(10))")


@query(
    f"""WITH p AS (SELECT answer_id, {_ends('best_gold')} AS a, {_ends('answer')} AS b FROM recall_answers),
 l AS (SELECT *, list_transform(range(1, length(a) + 1), lambda i: substr(a, i, 1)) AS x, list_transform(range(1, length(b) + 1), lambda i: substr(b, i, 1)) AS y FROM p),
 c AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN length(a) ELSE {S.lcs('x', 'y')} END AS common FROM l)
SELECT answer_id, length(a) AS source_chars, length(b) AS output_chars, common AS lcs_chars, CASE WHEN a = '' THEN 0.0 ELSE common::DOUBLE / length(a) END AS recall, CASE WHEN b = '' THEN 0.0 ELSE common::DOUBLE / length(b) END AS precision FROM c"""
)
def ocr_overlap(spark, sf_dir):
    """The character metrics of ``ocr_metrics`` that do not need an edit distance."""
    scored = SC.ocr_scores(table(spark, sf_dir, "recall_answers").select("answer_id", "best_gold", "answer"), "best_gold", "answer")
    strict = [F.col(f"strict.{c}") for c in ("source_chars", "output_chars", "lcs_chars")]
    return scored.select("answer_id", *strict, F.col("strict.char_recall").alias("recall"), F.col("strict.char_precision").alias("precision"))


# --- runs ----------------------------------------------------------------------------


def _cases(spark, sf_dir):
    """Runs are variants; a case's result is its first answer. Scored once, as the summaries read it several times."""
    results = _scored(spark, sf_dir).select(F.col("variant").alias("run"), F.col("qa_id").alias("id"), F.struct("answered_at", "answer_id").alias("position"), "correct", "exact_match", "f1", "match_kind", "score")
    asked = table(spark, sf_dir, "recall_answers").select(F.col("variant").alias("run"), F.col("qa_id").alias("id")).distinct()
    mode = F.when(F.col("run").startswith("text"), "text").otherwise("image")
    known = asked.withColumns({"mode": mode, "task": F.substring_index("id", "-", 1)})
    frames = F.when(F.col("mode") == "text", 0).otherwise(F.length("id") % 5 + 1).cast("bigint")
    rows = SU.case_rows(known, results)
    return materialize(rows.withColumns({"frames": frames, "chars_per_frame": F.when(F.col("mode") == "text", 0.0).otherwise(F.length("id") * 10.0)}), "cases")


_CASES = _SCORED + """, o AS (SELECT *, row_number() OVER (PARTITION BY variant, qa_id ORDER BY answered_at NULLS FIRST, answer_id) AS rn FROM s
), cases AS (SELECT variant AS run, qa_id AS id, split_part(qa_id,'-',1) AS task, score, correct, exact_match, f1, match_kind,
  CASE WHEN starts_with(variant,'text') THEN 'text' ELSE 'image' END AS mode,
  CASE WHEN starts_with(variant,'text') THEN 0 ELSE length(qa_id) % 5 + 1 END AS frames, CASE WHEN starts_with(variant,'text') THEN 0.0::DOUBLE ELSE (length(qa_id)*10)::DOUBLE END AS chars_per_frame
 FROM o WHERE rn = 1
), base AS (SELECT min(run) AS run FROM cases WHERE mode = 'text'
), bf AS (SELECT id, f1 AS base_f1 FROM cases WHERE run = (SELECT run FROM base)
), marked AS (SELECT c.*, coalesce(b.base_f1, 0.0) AS baseline_f1, coalesce(b.base_f1 >= 0.7, false) AS eligible FROM cases c LEFT JOIN bf b USING (id)
), sums AS (SELECT run, mode, count(*) AS cases, count(*) FILTER (correct) AS correct, count(*) FILTER (exact_match) AS exact_match,
  (count(*) FILTER (score='semantic' AND correct)) || '/' || (count(*) FILTER (score='semantic')) AS semantic_correct,
  (count(*) FILTER (score='exact' AND correct)) || '/' || (count(*) FILTER (score='exact')) AS exact_correct,
  avg(f1) AS avg_f1, count(*) FILTER (eligible) AS eligible_cases, count(*) FILTER (eligible AND correct) AS eligible_correct,
  coalesce(avg(f1) FILTER (eligible), 0.0) AS eligible_avg_f1, sum(frames)::BIGINT AS total_frames, avg(frames)::DOUBLE AS avg_frames,
  coalesce(avg(chars_per_frame) FILTER (chars_per_frame > 0), 0.0) AS avg_chars_per_frame FROM marked GROUP BY run, mode)
"""


def _summaries(spark, sf_dir):
    return SU.summarize(SU.with_eligibility(_cases(spark, sf_dir)))


@query(_CASES + "SELECT * FROM sums")
def eligible_summary(spark, sf_dir):
    return _summaries(spark, sf_dir)


@query(_CASES + "SELECT * FROM sums ORDER BY eligible_avg_f1 DESC, avg_f1 DESC, correct DESC, run")
def leaderboard(spark, sf_dir):
    return SU.leaderboard(_summaries(spark, sf_dir))


@query(_CASES + "SELECT run, eligible_avg_f1, avg_f1, row_number() OVER (ORDER BY eligible_avg_f1 DESC, avg_f1 DESC, run) AS place FROM sums")
def report_order(spark, sf_dir):
    """Runs in the order of a report, with their places (a row per run)."""
    place = F.row_number().over(Window.orderBy(F.desc("eligible_avg_f1"), F.desc("avg_f1"), "run"))
    return SU.report_order(_summaries(spark, sf_dir)).select("run", "eligible_avg_f1", "avg_f1", place.cast("bigint").alias("place"))


@query(_CASES + "SELECT id, task, f1, match_kind FROM marked WHERE run = (SELECT run FROM base) AND NOT eligible")
def low_cases(spark, sf_dir):
    return SU.low_cases(_cases(spark, sf_dir))


@query(_CASES + "SELECT run, task, count(*) AS cases, count(*) FILTER (correct) AS correct, avg(f1) AS avg_f1 FROM cases GROUP BY run, task")
def task_group(spark, sf_dir):
    return SU.by_task(_cases(spark, sf_dir))


_RUNS = ["mono12-t030-l0-f1568", "mono24-t049-l2-f2000", "text-baseline"]


@query(_CASES + "SELECT task, " + ", ".join(f"avg(f1) FILTER (run = '{r}') AS \"{r}\"" for r in _RUNS) + " FROM cases GROUP BY task")
def task_pivot(spark, sf_dir):
    return SU.task_pivot(_cases(spark, sf_dir), _RUNS)


@query(_CASES + "PIVOT (SELECT run, task, f1 FROM cases) ON run USING avg(f1) GROUP BY task")
def task_pivot_all(spark, sf_dir):
    """The pivot over every run there is; ``task_pivot`` has the three runs its SQL names."""
    return SU.task_pivot(_cases(spark, sf_dir))


@query(_CASES + "SELECT DISTINCT task FROM cases")
def task_names(spark, sf_dir):
    return SU.task_names_of_maps(SU.by_task_map(_cases(spark, sf_dir)))


@query(_CASES + ", t AS (SELECT eligible_avg_f1 AS base FROM sums WHERE run = (SELECT run FROM base)) SELECT run, eligible_avg_f1, CASE WHEN base <> 0 THEN eligible_avg_f1 / base END AS retention, avg_f1, total_frames, avg_chars_per_frame FROM sums, t WHERE mode = 'image'")
def retention(spark, sf_dir):
    return SU.retention(_summaries(spark, sf_dir))


@query(_CASES + "SELECT run, eligible_avg_f1 FROM sums WHERE mode = 'image' ORDER BY eligible_avg_f1 DESC, avg_f1 DESC LIMIT 1")
def best_image_run(spark, sf_dir):
    return SU.best_image_run(_summaries(spark, sf_dir))


# --- sessions ------------------------------------------------------------------------


@query("""WITH n AS (SELECT event_id, user_id, event_type, coalesce(sum((event_type='error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS window_no,
 sum((event_type='error')::INT) OVER (PARTITION BY user_id) AS total FROM events)
SELECT event_id, user_id, window_no FROM n WHERE event_type <> 'error' AND window_no < total""")
def marker_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    # Blocks of a day: the order column is in microseconds.
    return W.marker_windows(events, "user_id", "at", F.col("event_type") == "error", ("event_id",), block=DAY).select("event_id", "user_id", "window_no")


_LATEST = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY session_id, line_no ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM session_events
), e AS (SELECT *, coalesce(event_type = 'compaction', false) AS m FROM d WHERE rn = 1
), w AS (SELECT *, coalesce(sum(m::INT) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS window_no, sum(m::INT) OVER (PARTITION BY session_id) AS total FROM e)
"""


@query(_LATEST + "SELECT session_id, window_no, count(*) AS events, min(line_no) AS first_line, max(line_no) AS last_line FROM w WHERE NOT m AND window_no < total GROUP BY ALL")
def session_windows(spark, sf_dir):
    events = SE.latest_lines(table(spark, sf_dir, "session_events").select("row_id", "session_id", "line_no", "event_type", "ingested_at"))
    windowed = SE.session_windows(events)
    return windowed.groupBy("session_id", "window_no").agg(F.count(F.lit(1)).alias("events"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query(_LATEST + "SELECT session_id, line_no, sum((coalesce(message,'') <> '')::INT) OVER (PARTITION BY session_id ORDER BY line_no)::BIGINT AS turn_no FROM e")
def running_turns(spark, sf_dir):
    events = SE.latest_lines(table(spark, sf_dir, "session_events").select("row_id", "session_id", "line_no", "message", "ingested_at"))
    return W.running_turns(events, "session_id", "line_no", F.coalesce("message", F.lit(""))).select("session_id", "line_no", "turn_no")


_JSON = "CASE WHEN json_valid(message) AND json_type(message) = 'OBJECT' AND json_type(message, '$.role') = 'VARCHAR' THEN message->>'$.role' END"


@query(_LATEST + f""", c AS (SELECT *, event_type = 'message' AND message IS NOT NULL AS counts, {_JSON} AS role FROM w WHERE NOT m AND window_no < total)
SELECT session_id, window_no, count(*) AS event_count, count(*) FILTER (counts) AS message_count, count(*) FILTER (counts AND role='user') AS user_messages,
 count(*) FILTER (counts AND role='assistant') AS assistant_messages, count(*) FILTER (counts AND role='toolResult') AS tool_results,
 coalesce(sum(octet_length(encode(message))),0)::BIGINT AS source_json_bytes, min(line_no) AS start_line, max(line_no) AS last_line FROM c GROUP BY ALL""")
def window_statistics(spark, sf_dir):
    texts = _carriers(spark, sf_dir)
    return texts.select("session_id", "window_no", "event_count", "message_count", "user_messages", "assistant_messages", "tool_results", "source_json_bytes", "start_line", "last_line")


def _carriers(spark, sf_dir):
    events = SE.latest_lines(table(spark, sf_dir, "session_events"))
    return SE.carriers(SE.session_windows(events))


@query()
def session_carriers(spark, sf_dir):
    """The three carriers of each window; their framing is checked against a plain writer on fixtures."""
    return _carriers(spark, sf_dir).select("session_id", "window_no", "turns", "serialized", "eventized", "structured", "serialized_chars", "eventized_chars", "structured_chars")


@query(_LATEST + """SELECT session_id, window_no, true AS serialized, true AS eventized, true AS structured FROM w WHERE NOT m AND window_no < total GROUP BY session_id, window_no""")
def carrier_piece_checks(spark, sf_dir):
    """The streamed pieces of every window, put together, are its carriers (digests, so texts are not kept twice)."""
    windowed = SE.session_windows(SE.latest_lines(table(spark, sf_dir, "session_events")))
    pieces = SE.carrier_pieces(windowed).withColumn("piece", F.struct("place", "text"))
    digest = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("carrier") == c, F.col("piece")))), lambda x: x["text"]), SE.JOINTS[c]))
    put = pieces.groupBy("session_id", "window_no").agg(*[digest(c).alias(f"_{c}") for c in SE.JOINTS])
    whole = SE.carriers(windowed).select("session_id", "window_no", *[F.md5(c).alias(c) for c in SE.JOINTS])
    both = whole.join(put, ["session_id", "window_no"], "left")
    return both.select("session_id", "window_no", *[(F.col(c) == F.coalesce(f"_{c}", F.md5(F.lit("")))).alias(c) for c in SE.JOINTS])


@query(_LATEST + """SELECT session_id, window_no, true AS framed, true AS numbered, true AS separated, true AS trimmed, true AS redacted, true AS measured
FROM w WHERE NOT m AND window_no < total GROUP BY session_id, window_no""")
def carrier_checks(spark, sf_dir):
    """What has to hold of the carriers of every window, whatever its texts."""
    texts, turns = _carriers(spark, sf_dir), F.col("turns")
    ends = F.lit(r"(?mU)[^\S\n]+$")
    every = lambda rule: rule("serialized") & rule("eventized") & rule("structured")
    return texts.select(
        "session_id", "window_no",
        F.when(turns == 0, F.col("structured") == "").otherwise(F.startswith("structured", F.lit(SE.STREAM_HEADER))).alias("framed"),
        (F.regexp_count("structured", F.lit(r"(?m)^｜ T[0-9]{3,} [UA]: ")) == turns).alias("numbered"),
        (F.when(turns == 0, F.lit(0)).otherwise(F.size(F.split("eventized", "\n\n", -1))) == turns).alias("separated"),
        every(lambda c: (F.regexp_count(c, ends) == 0) & (T.trim_unicode(F.col(c)) == F.col(c))).alias("trimmed"),
        every(lambda c: F.regexp_count(c, F.lit("sk-[A-Za-z0-9_-]{8,}|(?:API_KEY|TOKEN)=(?!<redacted>)\\S")) == 0).alias("redacted"),
        every(lambda c: F.length(c) == F.col(f"{c}_chars")).alias("measured"),
    )


@query(_LATEST + """, c AS (SELECT session_id, line_no AS end_line, tokens_before, event_ts, window_no FROM w WHERE m),
 s AS (SELECT session_id, window_no, min(line_no) AS start_line, count(*) AS event_count, count(*) FILTER (event_type = 'message' AND message IS NOT NULL) AS message_count, coalesce(sum(octet_length(encode(message))),0)::BIGINT AS bytes FROM w WHERE NOT m GROUP BY ALL)
SELECT session_id, window_no, end_line, tokens_before, event_ts, coalesce(start_line, end_line) AS start_line, coalesce(event_count, 0) AS event_count, coalesce(message_count, 0) AS message_count, coalesce(bytes, 0) AS source_json_bytes FROM c LEFT JOIN s USING (session_id, window_no)""")
def window_closings(spark, sf_dir):
    """The metadata of windows without what depends on their texts."""
    return window_metadata(spark, sf_dir).select("session_id", "window_no", "end_line", "tokens_before", "event_ts", "start_line", "event_count", "message_count", "source_json_bytes")


@query()
def window_metadata(spark, sf_dir):
    events = SE.latest_lines(table(spark, sf_dir, "session_events"))
    return SE.window_metadata(SE.carriers(SE.session_windows(events)), events)


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, json_type(props, '$.k') IN ('UBIGINT','BIGINT') AS whole FROM events")
def json_extract(spark, sf_dir):
    parsed = F.try_parse_json("props")
    value = F.try_variant_get(parsed, "$.k", "variant")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"), (F.schema_of_variant(value) == "BIGINT").alias("whole"))


@query("SELECT session_id, date_trunc('day', event_ts)::TIMESTAMP AS day, count(*) AS events, count(*) FILTER (event_type='message') AS messages, count(*) FILTER (event_type='compaction') AS closings FROM session_events WHERE event_ts IS NOT NULL GROUP BY ALL")
def session_activity(spark, sf_dir):
    """The streaming extension's grouping, over the finished table."""
    from loomarc.streaming.session_stream import activity

    counted = activity(table(spark, sf_dir, "session_events"))
    return counted.select("session_id", F.col("period.start").cast("timestamp_ntz").alias("day"), "events", "messages", "closings")


# --- datasets ------------------------------------------------------------------------


def _items(spark, sf_dir):
    """Documents as dataset items; the title of a case stands for its input."""
    return table(spark, sf_dir, "documents").select(
        "task", F.col("doc_id").alias("position"), F.col("session_id").alias("input"), F.col("text").alias("context"), F.array("source").alias("answers"),
        F.col("n_chars").alias("length"), F.col("lang").alias("language"), F.col("doc_id").cast("string").alias("_id"),
    )


_QUESTION = (
    "CASE WHEN task IN ('lcc','repobench-p') THEN {code} || coalesce(nullif(session_id,''), {empty_code}) WHEN task = 'passage_retrieval_zh' THEN {passage} || {shown} "
    "WHEN task = 'dureader' THEN {search} || {shown} WHEN lang = 'zh' THEN {zh} || {shown} ELSE {en} || {shown} END"
).format(
    code=S.q(D.CODE_QUESTION), empty_code=S.q(D.EMPTY_CODE_INPUT), passage=S.q(D.PASSAGE_QUESTION), search=S.q(D.SEARCH_QUESTION), zh=S.q(D.CHINESE_QUESTION), en=S.q(D.ENGLISH_QUESTION),
    shown="coalesce(nullif(session_id,''),'<empty>')",
)


@query(f"SELECT doc_id, {_QUESTION} AS question FROM documents")
def question_builder(spark, sf_dir):
    return _items(spark, sf_dir).select(F.col("position").alias("doc_id"), D.question(F.col("task"), F.col("language"), F.col("input")).alias("question"))


@query("SELECT doc_id, 'Source: LongBench' || chr(10) || 'Dataset: ' || coalesce(task,'') || chr(10) || 'Language: ' || coalesce(lang,'') || chr(10) || 'Source id: ' || doc_id || chr(10) || chr(10) || 'Input:' || chr(10) || coalesce(nullif(session_id,''),'<empty>') || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(text,'') AS context FROM documents")
def context_builder(spark, sf_dir):
    return _items(spark, sf_dir).select(F.col("position").alias("doc_id"), D.context(F.col("task"), F.col("language"), F.col("_id"), F.col("input"), F.col("context")).alias("context"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY doc_id) AS rn FROM documents)
SELECT regexp_replace(regexp_replace(lower(task),'[^a-z0-9_-]+','-','g'),'^-+|-+$','','g') || '-' || lpad((rn-1)::VARCHAR,4,'0') AS id, doc_id::VARCHAR AS source_id, task,
 CASE WHEN task IN ('passage_retrieval_zh','lcc','repobench-p') THEN 'exact' ELSE 'semantic' END AS score,
 coalesce(length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')), 0) AS context_chars, 1::BIGINT AS answer_count FROM n WHERE rn <= 5""")
def import_cases(spark, sf_dir):
    return D.import_cases(_items(spark, sf_dir), 5).select("id", "source_id", "task", "score", "context_chars", "answer_count")


@query("SELECT * EXCLUDE rn FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def first_per_group(spark, sf_dir):
    return W.first_per_group(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id")


@query("SELECT doc_id, source, (rn - 1)::INT AS index_in_group FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def top_per_group(spark, sf_dir):
    return W.top_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 3, "doc_id")


@query("SELECT case_id, task FROM case_metadata WHERE case_id IN ('multihop-000000856','multifieldqa_en-000000284','nothing')")
def case_selection(spark, sf_dir):
    cases = table(spark, sf_dir, "case_metadata").select("case_id", "task")
    return D.select_cases(cases, ids=" multihop-000000856, ,multifieldqa_en-000000284,nothing", id_col="case_id")


@query("SELECT arg_min(case_id, (case_id, recorded_at)) AS case_id, task FROM case_metadata GROUP BY task")
def one_case_per_task(spark, sf_dir):
    cases = table(spark, sf_dir, "case_metadata").select("case_id", "task", F.struct("case_id", "recorded_at").alias("position"))
    return D.select_cases(cases, one_per_task=True).select("case_id", "task")


@query("SELECT case_id FROM case_metadata ORDER BY case_id, recorded_at LIMIT 7")
def limited_cases(spark, sf_dir):
    cases = table(spark, sf_dir, "case_metadata").select("case_id", F.struct("case_id", "recorded_at").alias("position"))
    return D.select_cases(cases, limit=7).select("case_id")


@query("SELECT DISTINCT task FROM (SELECT task FROM documents UNION ALL SELECT task FROM case_metadata) WHERE task IS NOT NULL")
def task_union(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("task").unionByName(table(spark, sf_dir, "case_metadata").select("task"))
    return SU.task_names(both)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM case_metadata")
def documents_without_case(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "case_metadata").select("doc_id"), "doc_id", "left_anti").distinct()


@query("SELECT qa_id, 'Answer the question using only the image. Reply with the shortest exact answer span. Do not explain.' || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM recall_qa")
def image_prompts(spark, sf_dir):
    return table(spark, sf_dir, "recall_qa").select("qa_id", D.image_prompt(F.col("question")).alias("prompt"))


# --- layout --------------------------------------------------------------------------

def _buckets(value: str, threshold: str) -> str:
    """The histogram in SQL (single precision throughout)."""
    return f"""WITH v AS (SELECT ({value})::FLOAT AS x FROM lineitem), b AS (SELECT greatest(1, floor((least(1::FLOAT, x) * 1000::FLOAT)::FLOAT + 0.5::FLOAT)::INT) AS bucket, count(*) AS count, count(*) FILTER (x > {threshold}::FLOAT) AS black
 FROM v WHERE x > 0 GROUP BY 1), h AS (SELECT bucket, (bucket::FLOAT / 1000::FLOAT)::FLOAT AS coverage, count, black, count::DOUBLE / (sum(count) OVER ())::DOUBLE AS share, (bucket::FLOAT / 1000::FLOAT)::FLOAT > {threshold}::FLOAT AS survives FROM b)
"""


#: The last three digits of a price stand for a pixel's coverage.
_BUCKETS = _buckets("(l_extendedprice - floor(l_extendedprice / 1000) * 1000) / 1000", "0.05")
_FEW = _buckets("l_discount", "0.05")


def _histogram(spark, sf_dir):
    price = F.col("l_extendedprice")
    return LO.histogram(table(spark, sf_dir, "lineitem").select(((price - F.floor(price / 1000) * 1000) / 1000).alias("coverage")), "coverage", 0.05)


@query(_BUCKETS + "SELECT * FROM h")
def coverage_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir)


@query(_BUCKETS + "SELECT * FROM h WHERE coverage >= 0.01::FLOAT AND coverage < 0.999::FLOAT ORDER BY count DESC, bucket LIMIT 12")
def histogram_top12(spark, sf_dir):
    return LO.top_edges(_histogram(spark, sf_dir))


@query(_BUCKETS + "SELECT * FROM h WHERE abs(coverage - 0.05::FLOAT)::FLOAT <= 0.03::FLOAT")
def near_threshold(spark, sf_dir):
    return LO.near_threshold(_histogram(spark, sf_dir), 0.05)


@query(_FEW + "SELECT * FROM h WHERE abs(coverage - 0.5::FLOAT)::FLOAT <= 0.03::FLOAT UNION ALL SELECT * FROM (SELECT * FROM h WHERE coverage >= 0.01::FLOAT AND coverage < 0.999::FLOAT ORDER BY count DESC, bucket LIMIT 8) WHERE NOT EXISTS (SELECT 1 FROM h WHERE abs(coverage - 0.5::FLOAT)::FLOAT <= 0.03::FLOAT)")
def shown_buckets(spark, sf_dir):
    """Nothing lies near this threshold, so the eight fullest buckets are shown."""
    return LO.shown_buckets(LO.histogram(table(spark, sf_dir, "lineitem").select("l_discount"), "l_discount", 0.05), 0.5)


@query("SELECT manifest_id, 140 + (font_size::DOUBLE - 6) / 30 * 1320 AS x, 235 + (1 - (threshold::DOUBLE - 0) / 1) * 475 AS y FROM archive_manifests")
def chart_points(spark, sf_dir):
    return table(spark, sf_dir, "archive_manifests").select("manifest_id", LO.axis(F.col("font_size"), 6, 36, 140, 1320).alias("x"), LO.axis(F.col("threshold"), 0, 1, 235, 475, True).alias("y"))


@query("""WITH p(id, fs, th, fr) AS (VALUES ('zpix24-binary-2000', 24.0::DOUBLE, 0.49::DOUBLE, 2000), ('zpix18-half-049-2000', 18.0::DOUBLE, 0.49::DOUBLE, 2000)),
 r AS (SELECT DISTINCT variant AS run, CASE WHEN starts_with(variant, 'text') THEN 'text' ELSE 'image' END AS mode, CASE WHEN contains(variant, '24') THEN 'zpix24-binary-2000' ELSE 'zpix18-half-049-2000' END AS preset FROM recall_answers)
SELECT run, mode, preset, fs AS font_size, th AS threshold, fr AS frame_size FROM r LEFT JOIN p ON mode = 'image' AND preset = id""")
def run_presets(spark, sf_dir):
    """Presets of the runs, looked up by id (which one is chosen by the run's name here)."""
    runs = table(spark, sf_dir, "recall_answers").select(F.col("variant").alias("run")).distinct()
    mode = F.when(F.col("run").startswith("text"), "text").otherwise("image")
    named = runs.select("run", mode.alias("mode"), F.when(F.contains("run", F.lit("24")), "zpix24-binary-2000").otherwise("zpix18-half-049-2000").alias("preset"))
    return LO.with_presets(named).select("run", "mode", "preset", "font_size", "threshold", "frame_size")


@query(_BUCKETS + "SELECT min(bucket) FILTER (coverage > 0.05::FLOAT) AS next_above, max(bucket) FILTER (coverage <= 0.05::FLOAT) AS last_below, greatest(max(share), 1e-6) AS max_share FROM h")
def threshold_neighbours(spark, sf_dir):
    return LO.threshold_neighbours(_histogram(spark, sf_dir), 0.05)


@query("""SELECT manifest_id, (floor(frame_size / 8) * floor(frame_size / 22))::BIGINT AS capacity,
 greatest(1, ceil(coalesce(length(carrier_text),0)::DOUBLE / nullif((floor(frame_size / 8) * floor(frame_size / 22)), 0)))::BIGINT AS frames,
 least(9999.0, greatest(1.0, coalesce(content_width, 1568)))::DOUBLE AS width FROM archive_manifests""")
def grid_capacity(spark, sf_dir):
    cells = LO.grid_capacity(F.col("frame_size"), F.col("frame_size"), F.lit(8), F.lit(22))
    chars = F.coalesce(F.length("carrier_text"), F.lit(0))
    return table(spark, sf_dir, "archive_manifests").select(
        "manifest_id", cells.alias("capacity"), LO.grid_frames(chars, cells).alias("frames"), T.clamp(F.col("content_width").cast("double"), 1.0, 9999.0, 1568.0).alias("width")
    )


@query()
def frame_layout(spark, sf_dir):
    """Frames of every carrier under the default variant (data-dependent packing)."""
    return LO.frames(table(spark, sf_dir, "archive_manifests"), "manifest_id", "carrier_text", LO.Variant())


@query("SELECT manifest_id, length(carrier_text) AS compact_chars, length(carrier_text) AS in_frames, true AS counted, true AS named, CASE WHEN length(carrier_text) > 0 THEN true ELSE false END AS filled FROM archive_manifests WHERE carrier_text IS NOT NULL")
def frame_checks(spark, sf_dir):
    """What has to hold of the frames of every carrier: all characters, in order, none in an empty frame."""
    laid = frame_layout(spark, sf_dir).where(F.col("compact_chars").isNotNull())
    frames = F.col("frames")
    total = F.aggregate(frames, F.lit(0).cast("bigint"), lambda n, f: n + f["chars"])
    names = F.transform(frames, lambda f, i: f["path"] == F.concat(F.lit("frame-"), T.zero_pad(i, 4), F.lit(".png")))
    return laid.select(
        "manifest_id", "compact_chars", total.alias("in_frames"), (F.size(frames) == F.col("frame_count")).alias("counted"),
        F.forall(names, lambda n: n).alias("named"), F.forall(frames, lambda f: f["chars"] > 0).alias("filled"),
    )


@query("""SELECT q.qa_id, m.manifest_id AS carrier_id, md5('Answer the question using only the image. Reply with the shortest exact answer span. Do not explain.' || chr(10) || chr(10) || 'Question: ' || coalesce(q.question, '')) AS prompt
FROM recall_qa q JOIN (SELECT session_id, min(manifest_id) AS manifest_id FROM archive_manifests GROUP BY session_id) m USING (session_id)""")
def questions_with_carrier(spark, sf_dir):
    """Every question with the one carrier of its session, as an exam over images asks it."""
    carriers = table(spark, sf_dir, "archive_manifests").select("session_id", F.col("manifest_id").alias("carrier_id"), F.col("carrier_text").alias("text"))
    asked = D.items_with_carrier(table(spark, sf_dir, "recall_qa"), carriers, "session_id", image=True)
    return asked.select("qa_id", "carrier_id", F.md5("prompt").alias("prompt"))
