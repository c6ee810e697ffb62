"""One consistent form for texts that look alike but differ in their characters.

A longest-match transducer reads a text grapheme cluster by grapheme cluster and writes
the canonical form in one pass. Its mapping is compiled once from the Unicode data (widths,
blanks, invisible characters, compatibility ideographs, radicals and ligatures) and a fixed
list of look-alike letters, and is checked for conflicts: every target must map to itself,
so the form is idempotent and no rule feeds another.

There are two forms. The *key* compares: look-alike letters become one, whatever the word. The
form for *reading* (``Readable``) leaves the letters of a word that is in one script.

What is visible stays: letter case, accents, digits against letters, raised and circled
digits, the length of dashes, quote styles, a blank or none. What is not is unified: full-
and half-width forms, the width and number of blanks in a row, blanks at the ends, order and
composition of accents, characters that are not drawn.

Defined results: null stays null, '' stays ''; a text of invisible characters becomes ''.
Line breaks stay (CR LF becomes LF). Texts of any length take linear time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters drawn alike, by the letter they become.
LOOK_ALIKES = {
    "a": "а", "c": "сϲⅽ", "d": "ԁⅾ", "e": "е", "g": "ɡ", "h": "һ", "i": "іⅰ", "j": "јϳ", "l": "ӏⅼ", "m": "ⅿ", "o": "оοօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "v": "νѵⅴ", "w": "ԝ", "x": "хⅹ", "y": "у", "A": "АΑ", "B": "ВΒ", "C": "СϹⅭ", "D": "Ⅾ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀⅠ", "J": "ЈͿ",
    "K": "КΚK", "L": "Ⅼ", "M": "МΜⅯ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "ѴⅤ", "W": "Ԝ", "X": "ХΧⅩ", "Y": "УΥҮ",
    "Z": "Ζ", "Å": "Å", "力": "カ", "口": "ロ", "二": "ニ", "工": "エ", "卜": "ト", "夕": "タ", "へ": "ヘ", "-": "‐‑﹣", ";": ";", "·": "·",
}
# Ranges of characters whose compatibility form is drawn the same.
SAME_GLYPH_RANGES = (
    (0x2E80, 0x2FDF),  # radicals
    (0xF900, 0xFAFF),  # compatibility ideographs
    (0xFB00, 0xFB06),  # Latin ligatures
    (0xFF00, 0xFFEF),  # half and full width
    (0xFE50, 0xFE6B),  # small forms
    (0x2F800, 0x2FA1F),  # compatibility ideographs, supplement
)
SEQUENCES = {"\r\n": "\n", "...": "...", "…": "..."}


_BLANKS = re.compile(" {2,}")


def _invisible(ch: str) -> bool:
    """Characters that are not drawn: format characters, variation selectors, fillers."""
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or ch in "͏ᅟᅠ឴឵ㅤﾠ" or 0xE0100 <= ord(ch) <= 0xE01EF


class Transducer:
    """Compiled mapping with longest match over grapheme clusters."""

    def __init__(self, look_alikes: dict[str, str] = LOOK_ALIKES, sequences: dict[str, str] = SEQUENCES):
        self.rules: dict[str, str] = {}
        for first, last in SAME_GLYPH_RANGES:
            for code in range(first, last + 1):
                ch = chr(code)
                plain = unicodedata.normalize("NFKC", ch)
                if plain != ch and not (0xFF9E <= code <= 0xFF9F):
                    self._rule(ch, plain)
        self._rule("ﾞ", "゙")
        self._rule("ﾟ", "゚")
        for code in (*range(0x2000, 0x200B), 0xA0, 0x1680, 0x202F, 0x205F, 0x3000, 0x09, 0x0B, 0x0C):
            self._rule(chr(code), " ")
        for target, sources in look_alikes.items():
            for ch in sources:
                self._rule(ch, target)
        for source, target in sequences.items():
            if source != target:
                self._rule(source, target)
        # Targets are brought to the end of their chain (width, then look-alike), then checked.
        for source, target in list(self.rules.items()):
            self.rules[source] = "".join(self.rules.get(ch, ch) for ch in target)
        self._check()
        longest = sorted((s for s in self.rules if len(s) > 1), key=len, reverse=True)
        heads = "|".join(regex.escape(s) for s in longest)
        self._units = regex.compile((heads + "|" if heads else "") + r"\X")
        self._memo: dict[str, str] = {}
        self._heads = {s[0] for s in longest}
        self._odd: set[str] = set()
        self._plain: set[str] = set(map(chr, range(0x21, 0x7F))) - set("".join(longest)) | {" ", "\n"}

    def _rule(self, source: str, target: str) -> None:
        known = self.rules.get(source)
        if known is not None and known != target:
            raise ValueError(f"conflict: {source!r} to {known!r} and {target!r}")
        if source != target:
            self.rules[source] = target

    def _check(self) -> None:
        for source, target in self.rules.items():
            for ch in target:
                if ch in self.rules:
                    raise ValueError(f"conflict: {source!r} gives {target!r}, and {ch!r} is mapped again")

    def _cluster(self, unit: str) -> str:
        """The canonical form of one unit."""
        whole = self.rules.get(unit)
        if whole is not None:
            return whole
        if "‍" in unit and regex.search(r"\p{Extended_Pictographic}", unit):
            return unit.rstrip("‍")  # joined pictures are drawn as one
        out = []
        for ch in unicodedata.normalize("NFD", unit):
            mapped = self.rules.get(ch)
            if mapped is not None:
                out.append(mapped)
            elif not _invisible(ch):
                out.append(ch)
        return unicodedata.normalize("NFC", "".join(out))

    def _stays(self, ch: str) -> bool:
        """Whether a character is its own form and never joins another."""
        kind = unicodedata.category(ch)
        if kind[0] in "MC" or "ᄀ" <= ch <= "ᇿ" or "ힰ" <= ch <= "퟿" or ch in self._heads:
            return False
        return self._cluster(ch) == ch

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            if "\t" not in text and "\r" not in text and "\x0b" not in text and "\x0c" not in text:
                return _BLANKS.sub(" ", text).strip(" ") if " " in text else text
        odd = set(text) - self._plain
        for ch in odd - self._odd:
            (self._plain if self._stays(ch) else self._odd).add(ch)
        if odd <= self._plain:  # every character is its own form, wherever it stands
            return _BLANKS.sub(" ", text).strip(" ") if " " in text else text
        out, memo, gap, mark = [], self._memo, True, False
        for unit in self._units.findall(text):
            plain = memo.get(unit)
            if plain is None:
                plain = self._cluster(unit)
                if len(memo) < 100_000:
                    memo[unit] = plain
            if plain == " ":
                if not gap:
                    out.append(" ")
                gap = True
            elif plain:
                mark = mark or unicodedata.combining(plain[0]) > 0
                out.append(plain)
                gap = False
        joined = "".join(out).rstrip(" ")
        # A mark whose base was a unit of its own (half-width voicing) joins it here.
        return unicodedata.normalize("NFC", joined) if mark else joined


_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_GREEK = regex.compile(r"\p{Greek}")
_OWN_WORD = regex.compile(r"[\p{L}\p{M}]+")


class Readable:
    """The form for reading: like the key, but look-alike letters of a word that is all in one script stay.

    Words that mix scripts are spoofed or mistyped: they become Latin where every other letter
    has a Latin look-alike, and else the script that cannot be written in Latin letters. So
    ``Ρinthеr`` is written in Latin and a Russian word keeps its Cyrillic letters.
    """

    def __init__(self) -> None:
        alike = {ch: target for target, sources in LOOK_ALIKES.items() for ch in sources}
        self.to_latin = {ch: target for ch, target in alike.items() if target.isascii()}
        self.back = {p: {} for p in (_CYRILLIC, _GREEK)}
        for ch, target in self.to_latin.items():
            for pattern, table in self.back.items():
                if pattern.match(ch):
                    table.setdefault(target, ch)
        signs = {target: "".join(c for c in sources if not c.isalpha() or not (_CYRILLIC.match(c) or _GREEK.match(c))) for target, sources in LOOK_ALIKES.items()}
        self._rest = Transducer({target: sources for target, sources in signs.items() if sources})

    def __call__(self, text: str | None) -> str | None:
        plain = self._rest(text)
        if plain is None or plain.isascii():
            return plain
        return _OWN_WORD.sub(lambda m: self._word(m.group()), plain) if _CYRILLIC.search(plain) or _GREEK.search(plain) else plain

    def _word(self, word: str) -> str:
        if not regex.search(r"\p{Latin}", word):
            return word
        for pattern, table in self.back.items():
            foreign = pattern.findall(word)
            if foreign and all(c in self.to_latin for c in foreign):
                word = "".join(self.to_latin.get(c, c) if pattern.match(c) else c for c in word)
            elif foreign and all(c in table for c in regex.findall(r"\p{Latin}", word)):
                word = "".join(table.get(c, c) for c in word)
        return word


_TRANSDUCER: Transducer | None = None
_READABLE: Readable | None = None


def transducer() -> Transducer:
    """The process-wide transducer; compiled on first use."""
    global _TRANSDUCER
    if _TRANSDUCER is None:
        _TRANSDUCER = Transducer()
    return _TRANSDUCER


def readable() -> Readable:
    """The process-wide form for reading; compiled on first use."""
    global _READABLE
    if _READABLE is None:
        _READABLE = Readable()
    return _READABLE


def canonical_text(texts: Iterable[str | None]) -> Iterator[str | None]:
    form = transducer()
    return map(form, texts)


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    form = transducer()
    return texts.map(lambda t: form(t) if isinstance(t, str) else None)


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("key", T.StringType())]))
def both_forms(texts: pd.Series) -> pd.DataFrame:
    form, key = readable(), transducer()
    whole = [t if isinstance(t, str) else None for t in texts]
    return pd.DataFrame({"form": [form(t) for t in whole], "key": [key(t) for t in whole]})


def with_forms(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``form`` (for reading) and ``key`` (for comparing) of a text column; Arrow batches, no shuffle."""
    return df.withColumn("_forms", both_forms(F.col(f"`{column}`"))).select("*", "_forms.form", "_forms.key").drop("_forms")


def equal_looking_pairs(
    left: DataFrame, right: DataFrame, key: str, left_id: Column, left_text: Column, right_no: Column, right_text: Column
) -> DataFrame:
    """(left id, right number) of pairs of one key that differ in characters but not in form.

    The join is on (key, form): a key that holds a third of all rows spreads over its
    forms, and what one form still holds AQE splits, the right side having few rows.
    """
    a = left.select(F.col(key), left_id.alias("a_id"), left_text.alias("a")).where(F.col("a").isNotNull() & F.col(key).isNotNull())
    b = right.select(F.col(key), right_no.alias("b_no"), right_text.alias("b")).where(F.col("b").isNotNull() & F.col(key).isNotNull())
    joined = a.withColumn("form", canonical("a")).join(b.withColumn("form", canonical("b")), [key, "form"])
    return joined.where(F.col("a") != F.col("b")).select("a_id", "b_no").distinct()


def found(spark, sf_dir):
    answers = spark.read.parquet(f"{sf_dir}/recall_answers.parquet").select("qa_id", "answer_id", "answer")
    golds = spark.read.parquet(f"{sf_dir}/recall_qa.parquet").select("qa_id", F.posexplode("golds").alias("gold_no", "gold"))
    pairs = equal_looking_pairs(
        answers, golds, "qa_id", F.col("answer_id"), F.col("answer"), F.col("gold_no").cast("bigint"), F.col("gold")
    )
    return pairs.select(F.col("a_id").alias("answer_id"), F.col("b_no").alias("gold_no"))


def forms(spark, sf_dir):
    """Every answer in the form for reading, the key it compares by, and whether the form differs from it."""
    answers = spark.read.parquet(f"{sf_dir}/recall_answers.parquet").select("answer_id", "answer")
    changed = F.coalesce(F.col("form") != F.col("answer"), F.lit(False)).alias("changed")
    return with_forms(answers, "answer").select("answer_id", "form", "key", changed)


def gold_forms(spark, sf_dir):
    golds = spark.read.parquet(f"{sf_dir}/recall_qa.parquet").select("qa_id", F.posexplode("golds").alias("gold_no", "gold"))
    return with_forms(golds, "gold").select("qa_id", "gold_no", "form", "key")
