"""Line rules that hide keys in exported carriers (column expressions, JVM-side).

The rules are those of the export format: the first occurrence of a key in a line decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomarc.functions.text import bound, lines

# Keys in the order in which their rules are applied.
KEYS = ("OPENAI_API_KEY", "ANTHROPIC_API_KEY", "GEMINI_API_KEY", "API_KEY", "TOKEN")
MARK = "<redacted>"


def _per_line(text: Column, rule) -> Column:
    joined = F.array_join(F.transform(lines(text), rule), "\n")
    return F.regexp_replace(joined, r"(?U)\s+\z", "")


def assignment(text: Column, key: str) -> Column:
    """``KEY=value`` to ``KEY=<redacted>``; the value ends at white space.

    Only where ``=`` follows the first occurrence of the key in its line at once.
    """
    pattern = rf"(?sU)^((?:(?!{key}).)*{key}=)\S*"
    return _per_line(text, lambda x: F.regexp_replace(x, pattern, f"$1{MARK}"))


def colon_value(text: Column, key: str) -> Column:
    """``KEY ... : "value"`` keeps its quotes and loses what is between them.

    The first colon after the first occurrence of the key counts; only blanks and tabs may
    stand between it and the opening quote.
    """
    pattern = rf"""(?s)^((?:(?!{key}).)*{key}[^:]*:[ \t]*)(["'])(?:(?!\2).)*\2"""
    return _per_line(text, lambda x: F.regexp_replace(x, pattern, f"$1$2{MARK}$2"))


def sk_tokens(text: Column) -> Column:
    """``sk-`` and eight or more letters, digits, ``_`` or ``-``; no word boundary is asked for."""
    return F.regexp_replace(text, "sk-[A-Za-z0-9_-]{8,}", f"sk-{MARK}")


def redact(text: Column, home: str | None = None) -> Column:
    """Home folder, then for each key the colon and the ``=`` rule, then ``sk-`` tokens.

    A key's rules are tried only on texts that hold it; the line ends they leave behind are
    brought about once for all texts.
    """
    out = F.replace(text, F.lit(home), F.lit("~")) if home else text
    out = _per_line(out, lambda x: x)
    for key in KEYS:
        out = bound(out, lambda t, key=key: F.when(F.contains(t, F.lit(key)), assignment(colon_value(t, key), key)).otherwise(t))
    return sk_tokens(out)
