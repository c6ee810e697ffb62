"""Longest common subsequence, bit-parallel, as Arrow-batched UDFs.

Spark has no such function. One row of the classic table is one integer, so a text of n
characters against one of m costs n operations on m-bit integers: exact, without caps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(left: str, right: str) -> int:
    """Length of the longest common subsequence in code points."""
    if left == right:
        return len(left)
    if len(left) < len(right):
        left, right = right, left
    if not right:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(right):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(right)) - 1
    row = full
    for ch in left:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(right) - row.bit_count()


def char_f1(answer: str | None, gold: str | None) -> float:
    """Harmonic mean of precision and recall of the common subsequence; 1 for two empty texts."""
    answer, gold = answer or "", gold or ""
    if not answer or not gold:
        return 1.0 if answer == gold else 0.0
    common = lcs_length(answer, gold)
    if common == 0:
        return 0.0
    precision, recall = common / len(answer), common / len(gold)
    return 2.0 * precision * recall / (precision + recall)


@F.pandas_udf(T.LongType())
def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else lcs_length(a, b) for a, b in zip(left, right)], dtype="Int64")


@F.pandas_udf(T.DoubleType())
def f1(answer: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([char_f1(a, b) for a, b in zip(answer, gold)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def f1_each(answer: pd.Series, golds: pd.Series) -> pd.Series:
    """F1 of an answer against each of its golds."""
    return pd.Series([None if g is None else [char_f1(a, x) for x in g] for a, g in zip(answer, golds)], dtype="object")
