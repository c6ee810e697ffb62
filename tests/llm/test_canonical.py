import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomarc.llm import canonical as C

FORM = C.transducer()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ａｂ１", "Ab1"), ("ｷﾞﾝ", "ギン"), ("café", "café"), ("a​b﻿", "ab"), ("a b", "a b"), ("a　 b", "a b"), ("Ρinthеr", "Pinther"), ("⽤户", "用户"),
        ("ﬁn", "fin"), ("不", "不"), ("a‑b‐c", "a-b-c"), ("，", ","), ("x­y", "xy"), ("ё", "ё"), (" a ", "a"), ("й", "й"),
    ],
)
def test_equal_on_screen(a, b):
    assert FORM(a) == FORM(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("0", "O"), ("1", "l"), ("x²", "x2"), ("③", "3"), ("–", "-"), ("—", "–"), ("“", '"'), ("’", "'"), ("a b", "ab"), ("З", "3"), ("。", "."), ("a\nb", "ab")])
def test_visible_differences(a, b):
    assert FORM(a) != FORM(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_idempotent(text):
    assert FORM(FORM(text)) == FORM(text)


def test_quick_way_equals_the_units():
    slow = C.Transducer()
    slow._plain, slow._odd, slow._stays = set(), set(), lambda ch: False
    for text in ("мама и Rom", "汉字 と カナ", "é à  ü", "한글 각", "👩‍👩‍👧 ok", "🇩🇪🇫🇷", "a\u0301b", "x \u3000 y", "ﬁn…", "각\u1100\u1161\u11a8"):
        assert FORM(text) == slow(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_quick_way_on_any_text(text):
    slow = C.Transducer.__new__(C.Transducer)
    slow.__dict__ = {**FORM.__dict__, "_plain": set(), "_odd": set(), "_stays": lambda ch: False}
    assert FORM(text) == slow(text)


def test_reading_keeps_whole_words():
    read = C.readable()
    assert read("мама ест сор") == "мама ест сор" and FORM("мама") != "мама"
    assert read("Ρinthеr") == "Pinther" and read("ｐａｙ­ pal") == "pay pal" and read("пpивет") == "привет"
    assert read("Αθήνα ﬁn") == "Αθήνα fin" and read(None) is None and read("") == ""
    assert all(FORM(read(t)) == FORM(t) for t in ("мама Ρinthеr пpивет", "Αθήνα", "Ａ　б"))


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        C.Transducer({"a": "b", "b": "c"}, {})
    with pytest.raises(ValueError):
        C.Transducer({}, {"Ａ": "B"})


def test_pairs_equal_brute_force(spark):
    answers = [(1, "q", "Ａ b"), (2, "q", "A b"), (3, "q", None), (4, None, "A b"), (5, "r", "x​"), (6, "q", "a b"), (7, "q", "А b"), (7, "q", "А b")]
    golds = [("q", ["A b", None, "a b"]), ("r", ["x"]), ("s", None), ("t", [])]
    a = spark.createDataFrame(answers, "answer_id bigint, qa_id string, answer string")
    g = spark.createDataFrame(golds, "qa_id string, golds array<string>").select("qa_id", F.posexplode("golds").alias("no", "gold"))
    got = sorted((r[0], r[1]) for r in C.equal_looking_pairs(a, g, "qa_id", F.col("answer_id"), F.col("answer"), F.col("no"), F.col("gold")).collect())
    want = sorted(
        {(i, n) for i, q, t in answers for k, gs in golds if k == q for n, x in enumerate(gs or []) if t is not None and x is not None and t != x and FORM(t) == FORM(x)}
    )
    assert got == want == [(1, 0), (5, 0), (6, 2), (7, 0)]
