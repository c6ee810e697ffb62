import pytest
from pyspark.sql import functions as F

from loomarc.functions import lcs as L
from loomarc.functions import redact as R
from loomarc.functions import text as T


def run(spark, build, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_normalisation(spark):
    assert run(spark, T.normalize_answer, "A b\tC。（x）", None, "", "a；b\r　") == ["abcx", None, "", "a；b\r　"]
    assert run(spark, lambda c: T.normalize_answer(c, False), "甲，乙") == ["甲，乙"]
    assert run(spark, T.normalize_exact, "　 a b \n") == ["a b"]
    assert run(spark, T.passage_label, "段落2和7", "No.") == ["段落27", "no"]
    assert run(spark, T.code_exact, " ```a b\n``` ", "``````x```") == ["ab", "x"]
    assert run(spark, T.normalize_ocr, " （A，b）。\r\nC", "“x”【y】") == ["(A,b).C", '"x"[y]']


def test_lines_and_markdown(spark):
    assert run(spark, T.lines, "a\r\nb\n", "", "\n", "a\n\n", None) == [["a", "b"], [], [""], ["a", ""], None]
    cases = {"## # T": "T", "#tag": "tag", "> - x": "x", "* a": "a", "3.14 is": "14 is", "- 1. x": "1. x", "12. y": "y", "1.": "1.", "a": "a"}
    assert run(spark, T.strip_markdown_prefix, *cases) == list(cases.values())
    assert run(spark, T.compact_headings, "# A\n\n  b   c\n##\n") == ["A b c"]
    assert run(spark, T.strip_code_blocks, "a\n```py\nx\n```\nb", "a\n```\nx", "", None) == ["a\nb\n", "a\n", "", None]
    assert run(spark, T.normalize_archive, " a  \nb\t\n\n", "") == ["a\nb", ""]
    assert run(spark, T.is_noise_line, "", "<out>", "[shaken 3]", "[raw output: x", "x") == [True, True, True, True, False]
    assert run(spark, T.is_machine_line, "{" + "x" * 500, "{", "x" * 600) == [True, False, False]


def test_clauses(spark):
    df = spark.createDataFrame([("abc甲乙", "甲乙，ab"), ("abc", "甲乙，ab"), ("abc", "a b"), ("x", None)], "a string, g string")
    assert [r[0] for r in df.select(T.clauses_match(F.col("a"), F.col("g"))).collect()][:3] == [True, False, False]


@pytest.mark.parametrize(
    ("rule", "before", "after"),
    [
        (lambda c: R.assignment(c, "TOKEN"), "A TOKEN=x y\nTOKEN_A TOKEN=x\nTOKEN=", "A TOKEN=<redacted> y\nTOKEN_A TOKEN=x\nTOKEN=<redacted>"),
        (lambda c: R.colon_value(c, "API_KEY"), "API_KEY\": \"v\", 'w'\nAPI_KEY: v\nAPI_KEY x: 'v'", "API_KEY\": \"<redacted>\", 'w'\nAPI_KEY: v\nAPI_KEY x: '<redacted>'"),
        (R.sk_tokens, "sk-1234567 sk-12345678 task-force-something", "sk-1234567 sk-<redacted> task-<redacted>"),
        (lambda c: R.redact(c, "/home/me"), "/home/me/a OPENAI_API_KEY=k sk-aaaaaaaaaa", "~/a OPENAI_API_KEY=<redacted> sk-<redacted>"),
    ],
)
def test_redaction(spark, rule, before, after):
    assert run(spark, rule, before) == [after]


def test_small_functions(spark):
    assert run(spark, T.utf16_length, "a😀b", None) == [4, None]
    assert run(spark, T.slug, "A b.C!", "--x--") == ["a-b-c", "x"]
    assert run(spark, lambda c: T.zero_pad(c, 3), "7", "12345") == ["007", "12345"]
    assert run(spark, lambda c: T.or_empty_mark(c), "", None, "a") == ["<empty>", "<empty>", "a"]
    assert run(spark, T.xml_escape, '<a&"b">') == ["&lt;a&amp;&quot;b&quot;&gt;"]


def test_lcs():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc甲😀") for _ in range(rng.randint(0, 90))) for _ in "ab")
        assert L.lcs_length(a, b) == table(a, b)
    assert L.char_f1("", "") == 1.0 and L.char_f1("a", "") == 0.0 and L.char_f1("ab", "cd") == 0.0


def test_redaction_skips_only_what_has_no_key(spark, small):
    chained = F.col("content")
    for key in R.KEYS:
        chained = R.assignment(R.colon_value(chained, key), key)
    df = spark.read.parquet(f"{small}/tool_outputs.parquet")
    assert df.where(~R.sk_tokens(chained).eqNullSafe(R.redact(F.col("content")))).count() == 0
