import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from loomarc.llm import splitting as S


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab c.\n。，é👩‍💻🇩🇪กำU:", max_size=150), st.integers(1, 40), st.integers(0, 45))
def test_nothing_is_lost(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    starts = {m.start() for m in regex.finditer(r"\X", text)} | {len(text)}
    at = 0
    for i, (a, b, kind) in enumerate(pieces):
        assert a <= at and b - a <= max(limit, 0) and (b > a or not text)
        assert i == 0 or a > pieces[i - 1][0]
        if kind != "code_point" and b not in starts:
            raise AssertionError((text, limit, pieces))
        at = b
    assert at == len(text)
    assert (len(pieces) > 1) == (len(text) > limit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c.\n。，”é👩‍💻กำU:　\x1c", max_size=80))
def test_tokens_are_the_text(text):
    assert "".join(S._TOKEN.findall(text)) == text


def test_boundaries():
    assert S.split_text("U: a b\n\nA: c d\n\nU: e", 12, 0)[0] == (0, 8, "turn")
    assert S.split_text("aaaa bbbb. cccc dddd", 13, 0)[0] == (0, 11, "sentence")
    assert S.split_text("aaaaaaa bbbbbbb", 10, 2)[:2] == [(0, 8, "word"), (6, 15, "end")]
    assert S.split_text("abcdefgh", 3, 1) == [(0, 3, "character"), (2, 5, "character"), (4, 7, "character"), (6, 8, "end")]
    assert S.split_text("", 5, 1) == [(0, 0, "whole")] and S.split_text("abc", None, 1) == [(0, 3, "whole")] and S.split_text("abc", 0, 1) == [(0, 3, "whole")]


def test_frames_of_rows(spark):
    schema = "manifest_id bigint, carrier_text string, max_chars bigint, overlap_chars bigint, frames array<struct<path:string,chars:bigint>>, id int"
    rows = [(1, "aaaa bbbb", 5, 1, [("f0", 9), (None, 3)], 0), (2, None, 5, 1, [("f", 12)], 0), (3, "x" * 50_000, 7, None, None, 0), (4, "abc", 0, 0, [], 0), (5, "abc", None, 0, None, 0)]
    df = spark.createDataFrame(rows, schema)
    got = S.split(df, "manifest_id", "carrier_text", "max_chars", "overlap_chars").collect()
    assert {r.id for r in got if r.oversized} == {1, 3, 4} and {r.id for r in got} == {1, 3, 4, 5}
    frames = S.split_frames(df).collect()
    assert {(r.manifest_id, r.frame_no) for r in frames} == {(1, 0), (1, 1), (2, 0)} and all(r["size"] <= 5 for r in frames)
    assert S.split(df.limit(0), "manifest_id", "carrier_text", "max_chars", "overlap_chars").count() == 0
