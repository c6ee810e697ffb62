"""Text normalisation and cleaning as column expressions (all JVM-side).

Nulls give null, '' gives the rule's value of ''. "White space" is Unicode white space,
``(?U)\\s`` in Spark's regular expressions, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that answers are compared without.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PUNCTUATION = "（），、。：“”【】"
BLANKS = "\n\t "
# Item id prefixes that choose a comparison.
PASSAGE_PREFIX = "passage_retrieval_zh-"
CODE_PREFIXES = ("lcc-", "repobench-p-")
PASSAGE_LABEL = "段落"
# Characters between clauses of a gold answer.
CLAUSE_ENDS = "，、。,;；"

_EDGES = r"(?U)^\s+|\s+$"
_SPACE = r"(?U)\s"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Expressions are trees: a rule that names its input twice doubles what it is built on,
    and a chain of ten such rules would have a thousand copies. A lambda variable has one.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def trim_unicode(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, _EDGES, "")


def trim_start_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def collapse_whitespace(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_answer(text: Column, strip_cjk_punct: bool = True) -> Column:
    """Lower case without blanks, line feeds, tabs and punctuation (carriage returns stay)."""
    drop = BLANKS + (CJK_PUNCTUATION if strip_cjk_punct else "") + ASCII_PUNCTUATION
    return F.translate(F.lower(text), drop, "")


def normalize_exact(text: Column) -> Column:
    return trim_unicode(text)


def passage_label(text: Column) -> Column:
    """All ASCII digits behind a fixed label; without digits the normalised answer."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit(PASSAGE_LABEL), digits)).otherwise(normalize_answer(text))


def code_exact(text: Column) -> Column:
    """Code without fences at its ends and without any white space."""
    unfenced = F.regexp_replace(F.regexp_replace(trim_unicode(text), "^(?:```)+", ""), "(?:```)+$", "")
    return F.regexp_replace(unfenced, _SPACE, "")


def is_code_item(item_id: Column) -> Column:
    found = F.lit(False)
    for prefix in CODE_PREFIXES:
        found = found | F.coalesce(item_id.startswith(prefix), F.lit(False))
    return found


def normalize_exact_for_item(item_id: Column, text: Column) -> Column:
    """The comparison form in exact mode; the item id chooses it."""
    return (
        F.when(item_id.startswith(PASSAGE_PREFIX), passage_label(text)).when(is_code_item(item_id), code_exact(text)).otherwise(normalize_exact(text))
    )


def clauses(gold: Column) -> Column:
    """Normalised clauses of two or more characters."""
    pieces = F.transform(F.split(gold, rf"(?U)[\s{CLAUSE_ENDS}]"), lambda c: normalize_answer(c))
    return F.filter(pieces, lambda c: F.length(c) >= 2)


def clauses_match(answer_norm: Column, gold: Column) -> Column:
    """Whether a gold has clauses and the answer holds all of them, in any order."""
    parts = clauses(gold)
    return (F.size(parts) > 0) & F.forall(parts, lambda c: F.contains(answer_norm, c))


def line_endings(text: Column) -> Column:
    return trim_unicode(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def normalize_ocr(text: Column) -> Column:
    """Line endings, then no blanks and full-width punctuation in ASCII; letter case stays."""
    return F.translate(line_endings(text), "（），。：“”【】" + BLANKS, '(),.:""[]')


def lines(text: Column) -> Column:
    """Lines of a text; a final line end opens no further line, CR LF ends one line."""
    empty = F.array().cast("array<string>")
    return bound(text, lambda t: F.when(t == "", empty).otherwise(F.split(F.regexp_replace(t, r"\r?\n\z", ""), r"\r?\n", -1)))


def is_noise_line(line: Column) -> Column:
    """Empty lines and output marks (of a trimmed line)."""
    return (line == "") | line.isin("<out>", "</out>") | line.startswith("[shaken ") | line.startswith("[raw output:")


def looks_machine_generated(line: Column) -> Column:
    found = line.startswith("{") | line.startswith("[")
    for mark in ("\\n", '"type":', "function ", "const ", "=>"):
        found = found | F.contains(line, F.lit(mark))
    return found


def is_machine_line(line: Column) -> Column:
    """Machine-looking lines of more than 500 bytes."""
    return (F.octet_length(line) > 500) & looks_machine_generated(line)


def strip_markdown_prefix(line: Column) -> Column:
    """Without heading marks, one quote mark, then one list mark or number.

    A number's dot may stand anywhere after the digits, so ``3.14 is`` becomes ``14 is``;
    a list mark ends the work, so ``- 1. x`` keeps ``1.``.
    """
    bare = F.regexp_replace(trim_start_unicode(line), r"(?U)^(?:#\s*)+", "")
    bare = F.regexp_replace(bare, r"(?U)^>\s*", "")
    numbered = F.when(F.octet_length(bare) > 2, F.regexp_replace(bare, r"(?U)^[0-9]+\.\s*", "")).otherwise(bare)
    return F.when(bare.rlike(r"^[-*+] "), F.regexp_replace(bare, r"(?U)^[-*+] \s*", "")).otherwise(numbered)


def compact_headings(text: Column) -> Column:
    """One line of text: heading marks and empty lines gone, white space collapsed."""
    kept = F.transform(lines(text), lambda x: trim_start_unicode(F.regexp_replace(trim_unicode(x), "^#+", "")))
    return collapse_whitespace(F.array_join(F.filter(kept, lambda x: x != ""), " "))


def normalize_archive(text: Column) -> Column:
    """No white space at line ends, none around the text."""
    return trim_unicode(F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n"))


def strip_code_blocks(text: Column) -> Column:
    """Lines outside fences, each with its line end; an unclosed fence drops the rest.

    The text is split at its fence lines, and every second part is inside: linear in its length.
    """
    ended = F.when(F.endswith(text, F.lit("\n")) | (text == ""), text).otherwise(F.concat(text, F.lit("\n")))
    parts = F.split(F.replace(ended, F.lit("\r\n"), F.lit("\n")), r"(?mdU)^[^\S\n]*+```[^\n]*+\n", -1)
    return F.array_join(F.filter(parts, lambda _, i: i % 2 == 0), "")


def slug(text: Column, keep_dots: bool = False) -> Column:
    """Lower-case name of letters, digits, ``_`` and ``-`` (and dots)."""
    allowed = "a-z0-9._-" if keep_dots else "a-z0-9_-"
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"[^{allowed}]+", "-"), "^-+|-+$", "")


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def zero_pad(number: Column, width: int) -> Column:
    """At least ``width`` digits; longer numbers are not cut."""
    digits = number.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def or_empty_mark(text: Column, mark: str = "<empty>") -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(mark))


def safe_ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def clamp(value: Column, low: float, high: float, fallback: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(value, F.lit(fallback))))


def contains_all(answer: Column, expected: Column) -> Column:
    """Expected strings that are missing from an answer (none for an empty list)."""
    return F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda x: ~F.contains(F.coalesce(answer, F.lit("")), x))


def xml_escape(text: Column) -> Column:
    out = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out
