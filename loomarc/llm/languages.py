"""Missing and wrong language labels: the languages of each document and segment.

Prose is taken out of each text (fences, code lines, headings, speaker and list marks,
quoted words, paths and identifiers go), cut into paragraphs at blank lines and into words,
and labelled word by word by a linear-chain conditional random field (``crf``). A
paragraph's language is the one that fills it; its confidence is the mean probability of
that language over the paragraph's characters.

The field is fitted in the session on a bounded sample of labelled documents: at most about
``SAMPLE`` documents by hash, of each up to ``PER_DOCUMENT`` paragraphs by hash, of each the
first ``FIT_WORDS`` words; of all these ``PARAGRAPHS`` paragraphs, no language having more
than twice its even part. Executors take the paragraphs out, so the driver gets words only.
Labels of the sample may be wrong: paragraphs that the rest of the sample contradicts are
left out, and stretches of different languages are joined so that switches are learned.
Everything else covers all documents and all of every text.

A document labelled with a programming language keeps that label where its text has a line
of code, or nothing but blanks; where it has none the text decides like any other.

Defined results: null, empty and blank texts, and texts without prose, have no language
(document row with null language and 0 confidence; no segment). A label of code that holds is
the language with confidence 1, and a text that is not blank is one segment of it. Letters of
other scripts than Latin, Cyrillic, Han and kana have no language.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomarc.llm.crf import Chain, learn
from loomarc.llm.labels import CODE, PROSE, language_code
from loomarc.runtime import spread

#: Documents of which the field is fitted at most, and paragraphs used of them.
SAMPLE, PARAGRAPHS = 6_000, 8_000
#: Paragraphs taken of one of them, and words of each.
PER_DOCUMENT, FIT_WORDS = 16, 48
#: Share of a paragraph's characters that a language must have to fill it.
FILL = 0.6
#: Characters of prose that a paragraph needs (characters of scripts without blanks count three).
LEAST = 12
#: Characters (counted in the same way) from which a run of words of one language is a segment.
RUN = 12
#: Distinct words remembered by one worker.
MEMORY = 300_000

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)")
_BLANK = re.compile(r"\n[ \t\r\f\v　]*(?:\n[ \t\r\f\v　]*)*\n")
_HEADING = re.compile(r"(?m)^[ \t]*(?:#{1,6}[ \t][^\n]*|={3,}[^\n]*|-{3,}[^\n]*|(?:\d{1,3}(?:\.\d+)*\.|[IVX]+\.)[ \t][^\n.!?。！？]{1,80})$")
_MARK = re.compile(r"(?m)^[ \t]*(?:[A-Z]:|｜ T\d+ [A-Z]:|\[\d+\]|[-*+>•]|\d{1,3}[.)])[ \t]+")
_QUOTED = re.compile(r"“[^”\n]{1,80}”|„[^“”\n]{1,80}[“”]|«[^»\n]{1,80}»|「[^」\n]{1,60}」|『[^』\n]{1,60}』|\"[^\"\n]{1,80}\"|`[^`\n]{1,120}`|(?<!\w)'[^'\n]{1,40}'(?!\w)|‘[^’\n]{1,60}’(?!\w)")
_CODE_LINE = re.compile(
    r"(?m)^(?:[ \t]{2,}[^\n]*[;{}()\[\]=:][^\n]*|[ \t]{2,}(?:return|pass|break|continue|else|end)\b[^\n]*|[ \t]*(?:import|from|use|using|package|def|class|return|public|private|protected|const|let|var|fn|impl|struct|namespace|raise|if|for|while|export|async|await|throw|try|catch)\b"
    r"[^\n.]*[;{}()\[\]=:_.][^\n]*|[ \t]*[}\])][^\n]{0,3}|[^\n]*(?:[;{}]|\);?|=>)[ \t]*|[ \t]*(?://|/\*|\*/|#!|#[^ #])[^\n]*|[ \t]*import[ \t]+\w+)$"
)
_PATHLIKE = re.compile(r"[^\s（(，。、]*[\\/_=@][^\s）)，。、]*")
_BLOB = re.compile(r"[A-Za-z0-9+]{32,}")
# Scripts without blanks are cut into pairs of Han and short runs of kana, so a run can change its language.
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+|[Ѐ-ӿ]+|[㐀-鿿々]{1,2}|[぀-ゟ]{1,4}|[゠-ヿ]+")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_QUOTE_SIGNS = re.compile("[“„«「『\"`'‘]")


def _blanks(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def paragraphs(text: str, spans: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, prose) of each paragraph that has prose words; offsets are into the text given.

    With ``spans`` what is no prose becomes blanks, so offsets into prose and text agree.
    """
    none, blank = (_blanks, _blanks) if spans else ("", " ")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(_blanks if spans else "\n\n", text)
    out, at = [], 0
    for piece in _split(text):
        start, at = at, at + len(piece[0]) + piece[1]
        prose = piece[0]
        if not prose.strip():
            continue
        if "\n" in prose or prose[0] in " \t#/" or any(c in prose for c in ";{}=") or prose.startswith(("import", "def", "use", "return")):
            prose = _CODE_LINE.sub(none, _HEADING.sub(none, prose))
        elif prose[0].isdigit():
            prose = _HEADING.sub(none, prose)
        prose = _MARK.sub(none, prose)
        if _QUOTE_SIGNS.search(prose):
            prose = _QUOTED.sub(blank, prose)
        if "/" in prose or "_" in prose or "\\" in prose or "=" in prose or "@" in prose:
            prose = _PATHLIKE.sub(blank, prose)
        if _BLOB.search(prose):
            prose = _BLOB.sub(blank, prose)
        out.append((start, start + len(piece[0]), prose))
    return out


def _split(text: str) -> Iterator[tuple[str, int]]:
    at = 0
    for m in _BLANK.finditer(text):
        yield text[at : m.start()], m.end() - m.start()
        at = m.end()
    yield text[at:], 0


def plain(text: str) -> str:
    """Composed form without hidden characters and with full-width letters narrowed."""
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if _HIDDEN.search(text):
        text = _HIDDEN.sub("", text)
    if "Ａ" <= max(text, default="") and re.search("[Ａ-ｚ]{3}", text):
        text = text.translate({c: c - 0xFEE0 for c in range(0xFF21, 0xFF5B)})
    return text


def words_of(prose: str) -> list[str]:
    return _WORD.findall(prose.lower())


def placed_words(prose: str) -> tuple[list[str], list[int]]:
    """The words of a prose and their offsets in it."""
    low = prose.lower()
    if len(low) != len(prose):  # a few letters have a longer small form
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in prose)
    found = [*_WORD.finditer(low)]
    return [m.group() for m in found], [m.start() for m in found]


def weight(word: str) -> int:
    return 3 * len(word) if word[0] >= "぀" else len(word)


class Labeller:
    """The fitted field with a memory of words; labels batches of paragraphs."""

    def __init__(self, chain: Chain):
        self.chain, self.states = chain, len(chain.states)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.emission = np.zeros((0, self.states), np.float32)
        self.weights = np.zeros(0, np.float32)

    def probabilities(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(word probabilities, word weights) of all words of the sequences, in order."""
        new = set().union(*sequences).difference(self.known) if sequences else set()
        if len(self.known) + len(new) > MEMORY:
            self.reset()
            new = set().union(*sequences)
        if new:
            fresh = list(new)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.emission = np.concatenate([self.emission, self.chain.emissions(fresh)])
            self.weights = np.concatenate([self.weights, np.fromiter(map(weight, fresh), np.float32, len(fresh))])
        known = self.known
        ids = np.fromiter((known[w] for words in sequences for w in words), np.int64)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        starts = np.cumsum(lengths) - lengths
        return self.chain.marginals(self.emission[ids], starts, lengths), self.weights[ids]

    def fill(self, sequences: list[list[str]]) -> list[tuple[str | None, float, float]]:
        """(language that fills it or None, its share, characters) of each paragraph."""
        if not sequences:
            return []
        probability, weights = self.probabilities(sequences)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        starts = np.cumsum(lengths) - lengths
        mass = np.add.reduceat(probability * weights[:, None], starts, 0)
        size = np.add.reduceat(weights, starts)
        share = mass / size[:, None]
        best = share.argmax(1)
        out = []
        for i, b in enumerate(best.tolist()):
            top = float(share[i, b])
            out.append((self.chain.states[b] if size[i] >= LEAST and top >= FILL else None, top, float(size[i])))
        return out


def fit(documents: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Chain:
    """Fit the field on at most about ``sample`` documents, chosen by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pair for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for pair in fit_paragraphs(text, label)]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w, _ in out], pa.string()), pa.array([s for _, s in out], pa.int32())], names=["words", "state"])

    step = max(1, documents.count() // sample)
    chosen = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = spread(chosen.select("text", "lang")).mapInArrow(run, "words string, state int").limit(2 * sample * PER_DOCUMENT).toArrow()
    pairs = zip(rows.column("words").to_pylist(), rows.column("state").to_pylist())
    return fit_pairs(sorted((words.split(" "), state) for words, state in pairs), seed)


def fit_paragraphs(text: str, label: str | None) -> list[tuple[list[str], int]]:
    """(words, state) of some paragraphs of a labelled text, chosen by hash."""
    code = language_code(label)
    if code not in PROSE:
        return []
    prose = [p for _, _, p in paragraphs(plain(text))]
    if len(prose) > PER_DOCUMENT:
        prose = sorted(prose, key=lambda p: xxhash.xxh32_intdigest(p.encode("utf-8", "replace")))[:PER_DOCUMENT]
    kept = (words_of(p) for p in prose)
    return [(words[:FIT_WORDS], PROSE.index(code)) for words in kept if sum(map(weight, words)) >= LEAST]


def fit_texts(labelled: Iterator[tuple[str, str | None]], seed: int = 7) -> Chain:
    """Fit the field on (text, label) pairs, some of whose labels are wrong."""
    return fit_pairs([pair for text, label in labelled for pair in fit_paragraphs(text, label)], seed)


def fit_pairs(kept: list[tuple[list[str], int]], seed: int = 7) -> Chain:
    """Fit the field on (words, state) pairs, some of which are wrong."""
    rng = random.Random(seed)
    rng.shuffle(kept)
    kept = kept[: 3 * PARAGRAPHS]
    # What the labels of the whole sample say of each word decides which paragraphs are doubtful.
    agreed = [kept[i] for i in np.flatnonzero(_agrees([words for words, _ in kept], np.array([state for _, state in kept], np.int64))).tolist()]
    # Frequent languages are thinned so that each has a fair part of the sample.
    quota = PARAGRAPHS // len(PROSE) * 2
    taken, chosen = Counter(), []
    for words, state in agreed:
        if taken[state] < quota and len(chosen) < PARAGRAPHS:
            taken[state] += 1
            chosen.append((words, state))
    if not chosen:
        chosen = [([w], PROSE.index("en")) for w in ("the", "and")]
    sequences = [(words, [state] * len(words)) for words, state in chosen]
    for _ in range(len(chosen) // 2):
        (a, x), (b, y) = rng.choice(chosen), rng.choice(chosen)
        a, b = a[: rng.randint(3, 24)], b[: rng.randint(3, 24)]
        sequences.append((a + b, [x] * len(a) + [y] * len(b)))
    rng.shuffle(sequences)
    return learn(sequences)


def _agrees(paragraphs_: list[list[str]], states: np.ndarray) -> np.ndarray:
    """Whether a naive vote of the words and their ends, counted over all labels, names a paragraph's own label."""
    if not paragraphs_:
        return np.zeros(0, bool)
    units: dict[str, int] = {}
    of_word: dict[str, list[int]] = {}
    for w in dict.fromkeys(w for words in paragraphs_ for w in words):
        of_word[w] = [units.setdefault(u, len(units)) for u in ({w, *w} if w[0] >= "぀" else {w, w[-3:]})]
    flat = [[u for w in set(words) for u in of_word[w]] for words in paragraphs_]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    pairs = np.unique(np.repeat(np.arange(len(flat)), sizes) * len(units) + np.array([u for own in flat for u in own], np.int64))
    paragraph, unit = pairs // len(units), pairs % len(units)
    k = len(PROSE)
    counts = np.bincount(unit * k + states[paragraph], minlength=len(units) * k).reshape(-1, k)
    says = np.log((counts + 0.05) / (np.bincount(states, minlength=k) + 1))
    votes = np.stack([np.bincount(paragraph, says[unit, s], len(flat)) for s in range(k)], 1)
    return votes.argmax(1) == states


_LABELLERS: dict[int, Labeller] = {}


def _labeller(key: int, chain: Chain) -> Labeller:
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(chain)
    return _LABELLERS[key]


def label_documents(documents: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id, label, languages, confidence, code``: languages that fill paragraphs, largest first.

    ``code`` is the programming language of a document rightly so labelled, which has no ``languages``.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((chain.weights, chain.transitions))  # fixed size: 2 MB
    key = hash(chain.transitions.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _labeller(key, Chain(*shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids, labels = part.column(0).to_pylist(), part.column(1).to_pylist()
                owner, sequences = [], []
                texts = part.column(2).to_pylist()
                codes = [code_label(label, text) for label, text in zip(labels, texts)]
                for i, (text, code) in enumerate(zip(texts, codes)):
                    if not text or code:
                        continue
                    for _, _, prose in paragraphs(plain(text)):
                        words = words_of(prose)
                        if words:
                            owner.append(i)
                            sequences.append(words)
                mass: list[dict[str, list[float]]] = [{} for _ in ids]
                for i, (lang, share, size) in zip(owner, own.fill(sequences)):
                    if lang:
                        held = mass[i].setdefault(lang, [0.0, 0.0])
                        held[0] += size
                        held[1] += size * share
                ranked = [sorted(m, key=lambda x: (-m[x][0], x)) for m in mass]
                sure = [sum(v[1] for v in m.values()) / sum(v[0] for v in m.values()) if m else 0.0 for m in mass]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ranked, pa.list_(pa.string())), pa.array(sure, pa.float64()), pa.array(codes, pa.string())],
                    names=["doc_id", "label", "languages", "confidence", "code"],
                )

    rows = spread(documents.select("doc_id", F.col("lang").alias("label"), "text"))
    return rows.mapInArrow(run, "doc_id bigint, label string, languages array<string>, confidence double, code string")


def code_label(label: str | None, text: str | None) -> str | None:
    """The programming language of a label, unless the text has words and no line of code."""
    code = language_code(label)
    if code not in CODE:
        return None
    return code if not text or not text.strip() or _CODE_LINE.search(text) else None


SEGMENTS = "doc_id bigint, segment_no int, start int, end int, lang string, confidence double"


def label_segments(documents: DataFrame, chain: Chain) -> DataFrame:
    """Each maximal stretch of one language: offsets (code points of the composed text), language, confidence.

    Every paragraph is cut at the runs of the most probable language, however small their
    share of it. A run shorter than ``RUN`` characters, or of a single word in a script with
    blanks, is a name or loan and belongs to the run beside it.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((chain.weights, chain.transitions))
    key = hash(chain.transitions.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _labeller(key, Chain(*shared.value))
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                yield labelled(own, batch.slice(first, 1000))

    def labelled(own: Labeller, part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], []]
        found = []
        for i, (doc_id, label, text) in enumerate(zip(*(c.to_pylist() for c in part.columns))):
            if not text:
                continue
            body = plain(text)
            if code := code_label(label, text):
                if body.strip():
                    for column, value in zip(out, (doc_id, 0, 0, len(body), code, 1.0)):
                        column.append(value)
                continue
            for start, end, prose in paragraphs(body, spans=True):
                words, places = placed_words(prose)
                if words:
                    found.append((i, doc_id, start, end, words, places))
        if found:
            probability, weights = own.probabilities([f[4] for f in found])
        at, number, last = 0, 0, -1
        for i, doc_id, start, end, words, places in found:
            p, w = probability[at : at + len(words)], weights[at : at + len(words)]
            at += len(words)
            if i != last:
                number, last = 0, i
            if w.sum() < LEAST:
                continue
            for a, b, lang, sure in _stretches(start, end, words, places, p, w, own.chain.states):
                for column, value in zip(out, (doc_id, number, a, b, lang, sure)):
                    column.append(value)
                number += 1
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "segment_no", "start", "end", "lang", "confidence"])

    return spread(documents.select("doc_id", F.col("lang").alias("label"), "text")).mapInArrow(run, SEGMENTS)


def _runs(words: list[str], p: np.ndarray, w: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, end, state) of each run of one language that is long enough to be one."""
    best = p.argmax(1)
    if (best == best[0]).all():
        return [(0, len(best), int(best[0]))]
    for i in range(1, len(best) - 1):  # stray words
        if best[i - 1] == best[i + 1] != best[i] and (words[i][0] < "぀" or w[i] < RUN):
            best[i] = best[i - 1]
    edges = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
    runs = [(a, b, int(best[a]), float(w[a:b].sum())) for a, b in zip(edges, edges[1:])]
    stands = [r for r in runs if r[3] >= RUN and (r[1] - r[0] > 1 or words[r[0]][0] >= "぀")]
    if not stands:
        return [(0, len(best), int((p * w[:, None]).sum(0).argmax()))]
    out: list[tuple[int, int, int]] = []
    for (a, _, state, size), before in zip(stands, [None, *stands]):
        if before is None:
            a = 0
        elif before[3] < size or before[2] == state:  # short runs between two go to the longer one
            a = before[1]
        if out and out[-1][2] == state:
            a = out.pop()[0]
        elif out:
            out[-1] = (out[-1][0], a, out[-1][2])
        out.append((a, len(best), state))
    return out


def _stretches(start, end, words, places, p, w, states) -> list[tuple[int, int, str, float]]:
    runs = _runs(words, p, w)
    cuts = [start, *(start + places[a] for a, _, _ in runs[1:]), end]
    return [(i, j, states[state], float((p[a:b, state] * w[a:b]).sum() / w[a:b].sum())) for (a, b, state), i, j in zip(runs, cuts, cuts[1:])]


def wrong_labels(labelled: DataFrame) -> DataFrame:
    """``doc_id, lang`` for documents whose label is not the set of languages found; one row per language."""
    from loomarc.llm.labels import language_code_column

    code = language_code_column(F.col("label"))
    right = (F.size("languages") == 1) & code.eqNullSafe(F.try_element_at("languages", F.lit(1)))
    return labelled.where((F.size("languages") > 0) & ~right).select("doc_id", F.explode("languages").alias("lang"))


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


def found(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    return wrong_labels(label_documents(documents, fit(documents)))


def languages_of_documents(labelled: DataFrame) -> DataFrame:
    """``doc_id, lang, languages, confidence`` of every document; labels of code are always right."""
    code = F.col("code")
    return labelled.select(
        "doc_id",
        F.coalesce(code, F.try_element_at("languages", F.lit(1))).alias("lang"),
        F.coalesce(code, F.array_join("languages", "+")).alias("languages"),
        F.when(code.isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def document_languages(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    return languages_of_documents(label_documents(documents, fit(documents)))


def segment_languages(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    return label_segments(documents, fit(documents))
