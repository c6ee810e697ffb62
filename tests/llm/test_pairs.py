import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomarc.llm import pairs as P

GOLDS = [
    "the gateway drops the wide frames because the reviewer keeps the exact values", "the reviewer keeps the exact values", "the renderer splits the oldest window although the gateway drops the wide frames",
    "网关导出标题符号，然后会话日志仍然需要更短的文本", "渲染器合并轮转顺序，因为渲染器替换缺失的答案", "评分脚本重写标题符号，虽然网关跳过更短的文本",
] * 3
ENDS = P.Endings([P.folded(g) for g in GOLDS])
Q = "Which path did the user give for the renderer in note 1160?"


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", max_size=25), st.text("abc ", max_size=40), st.integers(1, 6))
def test_coverage_equals_brute_force(prompt, text, least):
    covered = {k for i in range(len(text)) for j in range(i + least, len(text) + 1) if text[i:j] in prompt for k in range(i, j)}
    longest = max([j - i for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in prompt], default=0)
    got = P.SuffixAutomaton(prompt).coverage(text, least)
    assert (got[0], got[2]) == (len(covered), longest) and (got[1] > 0) == (got[0] > 0) and got[1] <= min(len(prompt), len(covered) * max(1, len(prompt)))


def test_pieces_of_the_question():
    a, b = P.SuffixAutomaton("abcdefgh"), "efghabcd"
    assert a.coverage(b, 3) == (8, 8, 4) and a.coverage("abcdabcd", 3) == (8, 4, 4) and a.coverage("xxabc", 3) == (3, 3, 3)


def test_kept_automata_are_bounded():
    for i in range(30):
        P._automaton(f"{i:02d}" * 5_000)
    assert sum(map(len, P._AUTOMATA)) <= P.KEPT_LETTERS


def test_border():
    rng = random.Random(3)
    for _ in range(300):
        g, a = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in "ga")
        assert P.border(g, a) == max((k for k in range(len(g) + 1) if k <= len(a) and a.endswith(g[:k])), default=0)


@pytest.mark.parametrize(
    ("answer", "question", "golds", "defect"),
    [
        (None, Q, ["a"], "empty"), ("\\n ​", Q, ["a"], "empty"), ("...", Q, ["a"], "empty"), ("...", None, None, "empty"), ("x", None, None, None),
        (Q, Q, ["a/b.md"], "copies_question"), (Q[:-6], Q, ["a/b.md"], "copies_question"), (f"**{Q} {Q}", Q, ["a/b.md"], "copies_question"), (f"Q: {Q}", Q, ["a/b.md"], "copies_question"),
        ("for the renderer in note 1160, which path did the user give", Q, ["a/b.md"], "copies_question"), (Q + " - unsure", Q, ["a/b.md"], "copies_question"), (Q + " Not sure...", Q, ["a/b.md"], "copies_question"),
        (Q + " X1", Q, ["a/b.md"], None), ("The renderer in note 1160", Q, ["a/b.md"], None), ("在注记里用户给渲染器哪条路径", "用户在注记里给渲染器哪条路径？", ["不改"], None), ("给渲染器哪条路径，用户在注记里", "用户在注记里给渲染器哪条路径？", ["不改"], "copies_question"),
        (Q + " It is ~/a/b.md.", Q, ["~/a/b.md"], None), ("Sorry, there is no way for me to tell.", Q, ["~/a/b.md"], "refusal"), ("不好意思，不可确定。", "问题是什么？", ["不改"], "refusal"),
        ("cannot be determined", Q, ["not stated in the archive"], None), ("Sorry for the mix-up, the answer is ~/a/b.md", Q, ["~/a/b.md"], None), ("The renderer cannot read the marks.", Q, ["~/a/b.md"], None),
        ("El generador de imágenes redondea la tabla de aciertos por tercera vez", Q, ["~/a/b.md"], "wrong_language"), ("X1", Q, ["~/a/b.md"], None), ("~/Work/a-b", Q, ["~/Work/a-b-c/d.md"], "truncated"),
        ("网关导出标题符号，然后会话日", "为什么？", GOLDS[3:4], "truncated"), ("“网关导出标题符号，然后", "为什么？", GOLDS[3:4], "truncated"), ("渲染器合并轮转顺序，因为渲染器替换缺失的答案", "为什么？", GOLDS[3:4], None),
        ("the renderer splits the oldest wind...", Q, GOLDS[:1], "truncated"), (GOLDS[1], Q, GOLDS[:2], None), ("The answer is X2.", Q, ["X1"], None),
    ],
)
def test_defects(answer, question, golds, defect):
    assert P.defect_of(answer, question, golds, None, ENDS) == defect


def test_frames(spark):
    answers = spark.createDataFrame([(1, "q", None, None, 0), (2, "q", "a", "a", 0), (3, None, "x", None, 0), (1, "q", None, None, 0)], "answer_id bigint, qa_id string, answer string, best_gold string, question int")
    asked = spark.createDataFrame([("q", Q, ["a"]), ("q", Q, ["a"]), (None, None, None)], "qa_id string, question string, golds array<string>")
    assert sorted(tuple(r) for r in P.defects(answers, asked).collect()) == [(1, "empty"), (1, "empty")]
    assert P.defects(answers.limit(0), asked.limit(0)).count() == 0


def test_endings_at_every_size(spark):
    """A stray gold that ends in a word does not take it from the others; more golds of the same kind change nothing."""
    names = ["".join(chr(97 + (k // 26**j) % 26) for j in range(3)) for k in range(400)]
    golds = [f"the {n} gateway drops the wide frames because the reviewer keeps exact values" for n in names]
    stray = ["some odd note stops here because"]
    text = "my own gateway skips whole rows because"
    for n in (40, 400):
        assert P.defect_of(text, Q, golds[:n] + stray, None, P.Endings(golds[:n] + stray)) == "truncated"
        assert P.defect_of(text + " values", Q, golds[:n], None, P.Endings(golds[:n])) is None
    asked = spark.createDataFrame([("q", Q, golds + stray), ("long", Q, ["word " * 1000 + "because the end"] * 2), ("none", Q, [None])], "qa_id string, question string, golds array<string>")
    answers = spark.createDataFrame([(1, "q", text, None), (2, "q", text + " values", None)], "answer_id bigint, qa_id string, answer string, best_gold string")
    assert [tuple(r) for r in P.defects(answers, asked).collect()] == [(1, "truncated")]
    assert "because" in {r.unit for r in P.breaking_units(asked).collect()}
