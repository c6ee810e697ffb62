"""Queries of the text functions (normalisation, cleaning, redaction, layout lengths)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomarc.functions import lcs as L
from loomarc.functions import redact as R
from loomarc.functions import text as T
from loomarc.plans import sql as S
from loomarc.runtime import table
from loomarc.sources.readers import data_url

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _answers(spark, sf_dir, *columns):
    return table(spark, sf_dir, "recall_answers").select("answer_id", *columns)


@query(f"SELECT answer_id, {S.normalize('answer')} AS form FROM recall_answers")
def normalize_answer(spark, sf_dir):
    return _answers(spark, sf_dir, T.normalize_answer(F.col("answer")).alias("form"))


@query(f"SELECT answer_id, {S.trim('answer')} AS form FROM recall_answers")
def normalize_exact(spark, sf_dir):
    return _answers(spark, sf_dir, T.normalize_exact(F.col("answer")).alias("form"))


@query(f"SELECT answer_id, CASE WHEN regexp_replace(answer,'[^0-9]','','g') <> '' THEN '段落'||regexp_replace(answer,'[^0-9]','','g') ELSE {S.normalize('answer')} END AS form FROM recall_answers")
def passage_label(spark, sf_dir):
    return _answers(spark, sf_dir, T.passage_label(F.col("answer")).alias("form"))


_CODE = S.replace(S.replace(S.replace(S.trim("'```' || content || '```'"), "^(?:```)+"), "(?:```)+$"), S.WS)


@query(f"SELECT output_id, {_CODE} AS form FROM tool_outputs")
def code_exact(spark, sf_dir):
    fenced = F.concat(F.lit("```"), "content", F.lit("```"))
    return table(spark, sf_dir, "tool_outputs").select("output_id", T.code_exact(fenced).alias("form"))


@query(f"SELECT doc_id, trim({S.replace('text', S.WS + '+', ' ')}, ' ') AS form FROM documents")
def collapse_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("form"))


_HEAD = f"list_transform({S.lines('text')}, lambda x: {S.replace(S.replace(S.trim('x'), '^#+'), '^' + S.WS + '+')})"


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN trim({S.replace(f'array_to_string(list_filter({_HEAD}, lambda x: x <> {S.q(str())}), chr(32))', S.WS + '+', ' ')}, ' ') END AS form FROM documents")
def compact_headings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.compact_headings(F.col("text")).alias("form"))


@query(f"SELECT doc_id, {S.trim(f'array_to_string(list_transform({S.lines(chr(116) + chr(101) + chr(120) + chr(116))}, lambda x: {S.replace(chr(120), S.WS + chr(43) + chr(36))}), chr(10))')} AS form FROM documents")
def normalize_archive(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_archive(F.col("text")).alias("form"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest({S.lines('text')}) AS x FROM documents), t AS (SELECT doc_id, {S.trim('x')} AS x FROM l)
SELECT doc_id, count(*) AS lines,
 count(*) FILTER (x = '' OR x IN ('<out>','</out>') OR starts_with(x,'[shaken ') OR starts_with(x,'[raw output:')) AS noise,
 count(*) FILTER (octet_length(encode(x)) > 500 AND (starts_with(x,'{{') OR starts_with(x,'[') OR contains(x,'\\n') OR contains(x,'"type":') OR contains(x,'function ') OR contains(x,'const ') OR contains(x,'=>'))) AS machine
FROM t GROUP BY doc_id"""
)
def noise_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("x"))
    trimmed = lines.select("doc_id", T.trim_unicode(F.col("x")).alias("x"))
    return trimmed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(T.is_noise_line(F.col("x"))).alias("noise"), F.count_if(T.is_machine_line(F.col("x"))).alias("machine")
    )


_BARE = S.replace(S.replace(S.replace("x", f"^{S.WS}+"), f"^(?:#{S.WS}*)+"), f"^>{S.WS}*")


@query(
    f"""WITH l AS (SELECT doc_id, unnest({S.lines('text')}) AS x, generate_subscripts({S.lines('text')}, 1) AS line_no FROM documents), b AS (SELECT doc_id, line_no, {_BARE} AS b FROM l)
SELECT doc_id, line_no, f AS form FROM (SELECT doc_id, line_no,
 CASE WHEN regexp_matches(b,'^[-*+] ') THEN {S.replace('b', f'^[-*+] {S.WS}*')} WHEN octet_length(encode(b)) > 2 THEN {S.replace('b', f'^[0-9]+[.]{S.WS}*')} ELSE b END AS f FROM b)"""
)
def markdown_prefix(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "x"))
    return lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), T.strip_markdown_prefix(F.col("x")).alias("form"))


@query(f"SELECT answer_id, translate({S.trim('replace(answer, chr(13)||chr(10), chr(10))')}, '（），。：“”【】'||chr(10)||chr(9)||' ', '(),.:\"\"[]') AS form FROM recall_answers")
def ocr_form(spark, sf_dir):
    return _answers(spark, sf_dir, T.normalize_ocr(F.col("answer")).alias("form"))


_CLAUSES = f"list_filter(list_transform(regexp_split_to_array(best_gold, {S.q(S.WS[:-1] + '，、。,;；]')}), lambda x: {S.normalize('x')}), lambda x: length(x) >= 2)"


@query(f"""SELECT answer_id, len({_CLAUSES}) AS clauses, CASE WHEN len({_CLAUSES}) = 0 THEN false WHEN best_gold IS NOT NULL AND answer IS NOT NULL
 THEN len(list_filter({_CLAUSES}, lambda c: NOT contains({S.normalize('answer')}, c))) = 0 END AS holds FROM recall_answers""")
def clause_match(spark, sf_dir):
    """Null where the gold is, or where a missing answer would have to hold clauses."""
    return table(spark, sf_dir, "recall_answers").select(
        "answer_id", F.size(T.clauses(F.col("best_gold"))).cast("bigint").alias("clauses"),
        T.clauses_match(T.normalize_answer(F.col("answer")), F.col("best_gold")).alias("holds"),
    )


def _sql_lines(rule: str) -> str:
    return S.replace(f"array_to_string(list_transform({S.lines('content')}, lambda x: {rule}), chr(10))", S.WS + r"+\z")


_ASSIGN = "CASE WHEN instr(x,'TOKEN') > 0 AND substr(x, instr(x,'TOKEN')+5, 1) = '=' THEN substr(x,1,instr(x,'TOKEN')+5) || '<redacted>' || regexp_replace(substr(x,instr(x,'TOKEN')+6), " + S.q("^[^" + S.WS[1:-1] + "]*") + ", '') ELSE x END"


@query(f"SELECT output_id, {_sql_lines(_ASSIGN)} AS form FROM tool_outputs")
def redact_assignment(spark, sf_dir):
    return table(spark, sf_dir, "tool_outputs").select("output_id", R.assignment(F.col("content"), "TOKEN").alias("form"))


_AFTER = "substr(x, instr(x,'KEY')+3)"
_REST = f"substr({_AFTER}, instr({_AFTER},':')+1)"
_HIT = f"instr(x,'KEY') > 0 AND instr({_AFTER},':') > 0 AND regexp_matches({_REST}, '^[ \\t]*(?:\"[^\"]*\"|''[^'']*'')')"
_COLON = f"CASE WHEN {_HIT} THEN substr(x, 1, length(x) - length({_REST})) || regexp_replace({_REST}, '^([ \\t]*)(?:(\")[^\"]*\"|('')[^'']*'')', '\\1\\2\\3<redacted>\\2\\3') ELSE x END"


@query(f"SELECT output_id, {_sql_lines(_COLON)} AS form FROM tool_outputs")
def redact_colon(spark, sf_dir):
    return table(spark, sf_dir, "tool_outputs").select("output_id", R.colon_value(F.col("content"), "KEY").alias("form"))


@query("SELECT output_id, regexp_replace(content, 'sk-[A-Za-z0-9_-]{8,}', 'sk-<redacted>', 'g') AS form FROM tool_outputs")
def redact_sk(spark, sf_dir):
    return table(spark, sf_dir, "tool_outputs").select("output_id", R.sk_tokens(F.col("content")).alias("form"))


def _key_rules(text: str, number: int) -> str:
    """The colon and the = rule of one key, line by line."""
    key = R.KEYS[number]
    after = f"substr(x, instr(x,'{key}')+{len(key)})"
    rest = f"substr({after}, instr({after},':')+1)"
    hit = f"instr(x,'{key}') > 0 AND instr({after},':') > 0 AND regexp_matches({rest}, '^[ \\t]*(?:\"[^\"]*\"|''[^'']*'')')"
    colon = f"CASE WHEN {hit} THEN substr(x, 1, length(x) - length({rest})) || regexp_replace({rest}, '^([ \\t]*)(?:(\")[^\"]*\"|('')[^'']*'')', '\\1\\2\\3<redacted>\\2\\3') ELSE x END"
    at = f"instr(y,'{key}')+{len(key)}"
    assign = f"CASE WHEN instr(y,'{key}') > 0 AND substr(y, {at}, 1) = '=' THEN substr(y,1,{at}) || '<redacted>' || regexp_replace(substr(y,{at}+1), {S.q('^[^' + S.WS[1:-1] + ']*')}, '') ELSE y END"
    return f"list_transform(list_transform({text}, lambda x: {colon}), lambda y: {assign})"


def _all_rules() -> str:
    steps, last = [], "home"
    steps.append(f"home AS (SELECT output_id, {S.lines(chr(39).join(('replace(content, ', '/srv/lab', ', ', '~', ')')))} AS ls FROM tool_outputs WHERE content IS NOT NULL)")
    for number in range(len(R.KEYS)):
        steps.append(f"k{number} AS (SELECT output_id, {_key_rules('ls', number)} AS ls FROM {last})")
        last = f"k{number}"
    joined = S.replace("array_to_string(ls, chr(10))", S.WS + r"+\z")
    return f"WITH {', '.join(steps)} SELECT t.output_id, CASE WHEN t.content IS NOT NULL THEN regexp_replace({joined}, 'sk-[A-Za-z0-9_-]{{8,}}', 'sk-<redacted>', 'g') END AS form FROM tool_outputs t LEFT JOIN {last} USING (output_id)"


@query(_all_rules())
def redact_all(spark, sf_dir):
    """All export rules in order."""
    return table(spark, sf_dir, "tool_outputs").select("output_id", R.redact(F.col("content"), "/srv/lab").alias("form"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, {S.lines('text')} AS ls FROM documents WHERE text IS NOT NULL)),
 f AS (SELECT *, starts_with({S.replace('x', '^' + S.WS + '+')}, '```') AS fence FROM l),
 p AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS inside FROM f),
 k AS (SELECT doc_id, string_agg(x || chr(10), '' ORDER BY i) AS form FROM p WHERE NOT fence AND inside = 0 GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(form, '') END AS form FROM documents LEFT JOIN k USING (doc_id)"""
)
def strip_code_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_code_blocks(F.col("text")).alias("form"))


@query("SELECT doc_id, length(text) AS scalars, octet_length(encode(text)) AS bytes, length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')) AS utf16 FROM documents")
def length_units(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(text).cast("bigint").alias("scalars"), F.octet_length(text).cast("bigint").alias("bytes"), T.utf16_length(text).alias("utf16")
    )


@query(
    """SELECT manifest_id, regexp_replace(name,'[^A-Za-z0-9_-]','_','g') AS file_name,
 regexp_replace(regexp_replace(lower(source),'[^a-z0-9_-]+','-','g'),'^-+|-+$','','g') AS slug,
 concat_ws('__', regexp_replace(regexp_replace(lower(name),'[^a-z0-9._-]+','-','g'),'^-+|-+$','','g'), regexp_replace(regexp_replace(lower(source),'[^a-z0-9._-]+','-','g'),'^-+|-+$','','g')) AS run_id,
 CASE WHEN length(frame_count::VARCHAR) >= 4 THEN frame_count::VARCHAR ELSE lpad(frame_count::VARCHAR,4,'0') END AS padded FROM archive_manifests"""
)
def names(spark, sf_dir):
    from loomarc.operators.dataset import run_id

    return table(spark, sf_dir, "archive_manifests").select(
        "manifest_id", T.safe_file_name(F.col("name")).alias("file_name"), T.slug(F.col("source")).alias("slug"),
        run_id(F.col("name"), F.col("source")).alias("run_id"), T.zero_pad(F.col("frame_count"), 4).alias("padded"),
    )


@query("SELECT answer_id, levenshtein(variant, qa_id) AS distance FROM recall_answers")
def edit_distance(spark, sf_dir):
    """Edits between two names of each answer (ASCII, as DuckDB counts bytes)."""
    return table(spark, sf_dir, "recall_answers").select("answer_id", F.levenshtein("variant", "qa_id").cast("bigint").alias("distance"))


_PAIR = f"WITH p AS (SELECT answer_id, {S.normalize('answer')} AS a, {S.normalize('best_gold')} AS b FROM recall_answers), l AS (SELECT *, string_split(a,'') AS x, string_split(b,'') AS y FROM p), c AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = '' OR b = '' THEN 0 ELSE {S.lcs('x', 'y')} END AS common FROM l) "


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "recall_answers").select("answer_id", T.normalize_answer(F.col("answer")).alias("a"), T.normalize_answer(F.col("best_gold")).alias("b"))


@query(_PAIR + "SELECT answer_id, common FROM c")
def lcs_length(spark, sf_dir):
    return _pairs(spark, sf_dir).select("answer_id", L.lcs("a", "b").alias("common"))


@query(_PAIR + f", n AS (SELECT answer_id, coalesce(a, '') AS a, coalesce(b, '') AS b, common FROM c) SELECT answer_id, {S.f1('a', 'b', 'common')} AS f1 FROM n")
def char_f1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("answer_id", L.f1("a", "b").alias("f1"))


@query("SELECT output_id, 'data:' || CASE WHEN regexp_matches(lower(file_path), '\\.jpe?g$') THEN 'image/jpeg' ELSE 'image/png' END || ';base64,' || base64(encode(content)) AS url FROM tool_outputs")
def image_data_url(spark, sf_dir):
    return table(spark, sf_dir, "tool_outputs").select("output_id", data_url(F.col("file_path"), F.col("content").cast("binary")).alias("url"))


@query("SELECT answer_id, replace(replace(replace(replace(answer,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;') AS form FROM recall_answers")
def xml_escape(spark, sf_dir):
    return _answers(spark, sf_dir, T.xml_escape(F.col("answer")).alias("form"))
