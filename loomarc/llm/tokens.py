"""Public tokenizers: loading, word splitting, and token counts of documents.

The folder of the vocabulary files is a parameter everywhere; nothing is copied and
nothing is trained. Each Python worker loads a vocabulary once.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"

# Fixed value: the pattern that splits text into words before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for characters on which the two engines' classes agree; this engine is faster.
_QUICK = re.compile(r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_EXACT = regex.compile(PATTERN)

#: Distinct words remembered by one worker; beyond it the memory starts anew.
MEMORY = 400_000


class Words:
    """Splits texts into the words within which merges happen."""

    def __init__(self) -> None:
        self._agreed: set[str] = set(map(chr, range(32, 127))) | {"\n", "\t", "\r"}
        self._odd: set[str] = set()

    def __call__(self, text: str) -> list[str]:
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return _QUICK.findall(text)
        new = set(text) - self._agreed
        if new:
            for ch in new - self._odd:
                if self._same(ch):
                    self._agreed.add(ch)
                    new.discard(ch)
                else:
                    self._odd.add(ch)
            if new:
                return _EXACT.findall(text)
        return _QUICK.findall(text)

    @staticmethod
    def _same(ch: str) -> bool:
        letter, number, blank = (bool(regex.match(p, ch)) for p in (r"\p{L}", r"\p{N}", r"\s"))
        return (letter, number, blank) == (bool(re.match(r"[^\W\d_]", ch)), bool(re.match(r"\d", ch)), bool(re.match(r"\s", ch))) and unicodedata.category(ch) != "Cn"


def load_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file with their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def counter(name: str = DEFAULT, folder: str = TOKENIZERS) -> Callable[[list[str | None]], list[int]]:
    """A function from texts to token counts (null and '' have 0), without special tokens.

    Rank files count word by word with a memory of words; unigram vocabularies by the
    double-array trie; other files by their own library.
    """
    stem = os.path.join(folder, name)
    if os.path.exists(stem + ".tiktoken"):
        return _rank_counter(load_ranks(stem + ".tiktoken"))
    if os.path.exists(stem + ".json"):
        with open(stem + ".json", encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"].get("type") == "Unigram":
            from loomarc.llm.unigram import from_tokenizer_json

            return from_tokenizer_json(spec).counts
        return _library_counter(stem + ".json")
    if os.path.exists(stem + ".model"):
        return _piece_counter(stem + ".model")
    raise FileNotFoundError(f"no tokenizer {name} in {folder}")


def _rank_counter(ranks: dict[bytes, int]) -> Callable[[list[str | None]], list[int]]:
    import tiktoken

    core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    words, known = Words(), {}

    def counts(texts: list[str | None]) -> list[int]:
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            found = words(text)
            try:
                out.append(sum([known[w] for w in found]))
            except KeyError:
                if len(known) > MEMORY:
                    known.clear()
                for w in found:
                    if w not in known:
                        known[w] = len(core.encode_single_piece(w.encode()))
                out.append(sum([known[w] for w in found]))
        return out

    return counts


def _library_counter(path: str) -> Callable[[list[str | None]], list[int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _piece_counter(path: str) -> Callable[[list[str | None]], list[int]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.is_unused(0) is None:
        raise ValueError(path)
    return lambda texts: [len(model.encode(t)) if t else 0 for t in texts]


def with_tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str], name: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """``id_col``, ``keep`` and ``tokens`` (bigint) of each row; one Arrow pass, no shuffle.

    The text is read once and goes no further than the counting stage.
    """
    columns = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name, folder)
        for batch in batches:
            sizes = count(batch.column(len(columns)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*columns, "tokens"])

    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("tokens", T.LongType())])
    rows = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, schema)
