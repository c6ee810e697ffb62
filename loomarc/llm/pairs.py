"""Broken prompt and response pairs: one defect type for each defective answer.

Copied coverage comes from a suffix automaton of the prompt: the response is traversed
through it once, and the stretches it shares with the prompt are summed, on both sides. Refusals are
found by an Aho-Corasick automaton over fixed phrases, unclosed quotes and brackets by a
delimiter stack, languages by votes of function words and scripts. An answer that equals a
gold is never defective, unless it is empty.

Order of the types, first that holds: ``empty``, ``copies_question``, ``refusal``,
``wrong_language``, ``truncated``.

Defined results: a null answer is ``empty``; an answer without a question row, or with null
question and golds, can only be ``empty``; repeated answers each have their row. A literal
``\\n`` is a line break. Long texts take time linear in their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomarc.llm.canonical import transducer
from loomarc.llm.lexicon import REFUSALS, STOPWORDS
from loomarc.runtime import small_or_shuffled, spread

#: Share of the question that a copy must hold: all but its last word or characters.
COPY_SHARE = 0.6
#: Letters of the shortest stretch that counts as copied, in scripts with and without blanks.
STRETCH, STRETCH_CJK = 6, 3
#: Letters of the prompts whose automata are kept at once.
KEPT_LETTERS = 100_000
# What may stand beside a copied question without answering it.
HEDGES = (
    "unsure|not sure|no idea|idk|i wonder|hmm|please|thanks|thank you|sorry|unsicher|keine ahnung|danke|bitte|je ne sais pas|merci|"
    "no estoy seguro|gracias|não tenho certeza|obrigado|не уверен|спасибо|不确定|谢谢|不明"
).split("|")

_CLOSERS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "{": "}", "《": "》", "【": "】", "„": "“"}
_TERMINAL = ".。!！?？…"
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_PATH = re.compile(r"^(?:[A-Za-z]:\\|~/|\./|\.\./|/|[a-z]+://)[^\s]*$")


class SuffixAutomaton:
    """Suffix automaton of one prompt (linear construction)."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for i, ch in enumerate(text):
            at = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.end.append(i + 1)
            self.link.append(0)
            p = last
            while p != -1 and ch not in self.next[p]:
                self.next[p][ch] = at
                p = self.link[p]
            if p != -1:
                q = self.next[p][ch]
                if self.length[p] + 1 == self.length[q]:
                    self.link[at] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.end.append(self.end[q])
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[at] = clone
            last = at

    def coverage(self, text: str, least: int) -> tuple[int, int, int]:
        """Characters of ``text`` inside shared stretches of ``least`` or more, characters of the prompt
        that these give back, and the longest stretch."""
        state = run = longest = covered = upto = 0
        given: list[tuple[int, int]] = []
        for i, ch in enumerate(text):
            before, length = state, run
            while state and ch not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if length >= least and (run < length or ch not in self.next[state]):  # a stretch ended
                given.append((self.end[before] - length, self.end[before]))
            if ch in self.next[state]:
                state = self.next[state][ch]
                run += 1
            longest = max(longest, run)
            if run >= least:
                covered += i + 1 - max(upto, i + 1 - run)
                upto = i + 1
        if run >= least:
            given.append((self.end[state] - run, self.end[state]))
        back = reach = 0
        for a, b in sorted(given):
            back += max(0, b - max(a, reach))
            reach = max(reach, b)
        return covered, back, longest


_AUTOMATA: dict[str, SuffixAutomaton] = {}


def _automaton(prompt: str) -> SuffixAutomaton:
    """The automaton of a prompt; those kept hold ``KEPT_LETTERS`` letters together, longer ones are not kept."""
    found = _AUTOMATA.get(prompt)
    if found is None:
        found = SuffixAutomaton(prompt)
        if sum(map(len, _AUTOMATA)) + len(prompt) > KEPT_LETTERS:
            _AUTOMATA.clear()
        if len(prompt) <= KEPT_LETTERS:
            _AUTOMATA[prompt] = found
    return found


_LABEL = re.compile(r"^\W*(?:\w{1,12}\s?[:：])")
_HEDGE_END = re.compile(r"[\W_]*\b(?:" + "|".join(sorted({re.escape(h) for h in HEDGES}, key=len, reverse=True)) + r")[\W_]*$")


def copies(text: str, ask: str) -> bool:
    """Whether a folded answer gives a folded question back, in whatever pieces, and says nothing else.

    All its letters lie in stretches it shares with the question (a label before and hedges
    behind it aside), which give back ``COPY_SHARE`` of the question or more.
    """
    prompt = letters(ask)
    least = STRETCH_CJK if _CJK.search(prompt) else STRETCH
    own = letters(text)
    need = COPY_SHARE * len(prompt)
    if not prompt or len(own) < need:
        return False
    if own.startswith(prompt) and prompt.startswith(own[len(prompt) :]):
        return True
    while own[-least:] not in prompt and (m := _HEDGE_END.search(text)):
        text = text[: m.start()]
        own = letters(text)
    # An answer that does not end in letters of the question, or has fewer than are needed, is none: no automaton.
    if len(own) < max(need, 4) or own[-min(least, len(prompt)) :] not in prompt:
        return False
    label = _LABEL.match(text)
    rests = [own, own[len(letters(label.group())) :]] if label else [own]
    whole = _automaton(prompt)
    for rest in rests:
        if len(rest) >= max(need, 4):
            covered, back, _ = whole.coverage(rest, min(least, len(prompt)))
            if covered == len(rest) and back >= need:
                return True
    return False


@lru_cache(maxsize=1)
def _refusals() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in REFUSALS:
        found.add_word(transducer()(phrase).casefold(), phrase)
    found.make_automaton()
    return found


def refuses(text: str) -> bool:
    """Whether a folded text holds a refusal phrase at word boundaries."""
    for end, phrase in _refusals().iter(text):
        start = end + 1 - len(transducer()(phrase))
        if _CJK.search(phrase) or not (text[start - 1 : start].isalnum() and start) and not text[end + 1 : end + 2].isalnum():
            return True
    return False


@lru_cache(maxsize=65536)
def folded(text: str) -> str:
    """Canonical form without case and line breaks; what comparisons are made on."""
    plain = transducer()(text.replace("\\n", "\n"))
    return " ".join(plain.casefold().replace("’", "'").split())


_NO_LETTERS = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """The letters and digits of a text."""
    return _NO_LETTERS.sub("", text)


_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _voter in {transducer()(w) for w in _words} if _lang != "ru" else ():
        _VOTES[_voter] = (*_VOTES.get(_voter, ()), _lang)
_FORMAT = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf") + "]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")


@lru_cache(maxsize=65536)
def language_of(text: str) -> str | None:
    """The language of prose by script and function words; None for names, numbers, paths and short bits."""
    plain = text if text.isascii() else _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    han, kana = len(_HAN.findall(plain)), len(_KANA.findall(plain))
    if han + kana >= 4 and (han + kana) * 2 >= sum(map(str.isalpha, plain)):
        return "ja" if kana and kana * 10 >= han else "zh"
    words = _WORD.findall(folded(text))
    if not words:
        return None
    cyrillic = 0 if plain.isascii() else sum(_CYRILLIC.search(w) is not None for w in words)
    if cyrillic >= 2 and cyrillic * 2 >= len(words):
        return "ru"
    votes: Counter = Counter()
    for w in words:
        votes.update({*_VOTES.get(w, ()), *(_VOTES.get(w.split("'")[0], ()) if "'" in w else ())})
    ranked = votes.most_common(2)
    if ranked and ranked[0][1] >= 2 and (len(ranked) == 1 or ranked[0][1] > ranked[1][1]):
        return ranked[0][0]
    return None


def strong_language(text: str) -> str | None:
    """The language of a text long enough to be prose."""
    lang = language_of(text)
    size = len(letters(text))
    return lang if lang and size >= (6 if lang in ("zh", "ja") else 12) else None


def unclosed(text: str) -> bool:
    """Whether a quote or bracket is opened and never closed (delimiter stack)."""
    stack: list[str] = []
    for ch in text:
        if stack and ch == stack[-1]:
            stack.pop()
        elif ch in _CLOSERS:
            stack.append(_CLOSERS[ch])
    straight = text.count('"') % 2 == 1 and text.lstrip().startswith('"')
    return bool(stack) or straight or text.count("**") % 2 == 1 or text.count("```") % 2 == 1


def border(gold: str, answer: str) -> int:
    """Length of the longest start of ``gold`` that ends ``answer``."""
    tail = answer[-len(gold) :]
    if not tail or not gold:
        return 0
    if tail == gold:
        return len(gold)
    at = len(gold)
    for _ in range(32):  # few places end in the last two characters, in most texts
        at = gold.rfind(tail[-2:], 0, at)
        if at < 0:
            return int(gold[0] == tail[-1])
        if tail.endswith(gold[: at + len(tail[-2:])]):
            return at + len(tail[-2:])
        at += len(tail[-2:]) - 1
    joined = gold + "\0" + tail
    fail = [0] * len(joined)
    for i in range(1, len(joined)):
        k = fail[i - 1]
        while k and joined[i] != joined[k]:
            k = fail[k - 1]
        fail[i] = k + (joined[i] == joined[k])
    return fail[-1]


def ending(text: str) -> str:
    """The last word of a folded text, or its last two characters in scripts without blanks."""
    text = text.rstrip(_TERMINAL + " \"'”»」』)")
    if not text:
        return ""
    if _CJK.match(text[-1]):
        return text[-2:]
    words = _WORD.findall(text[-64:])
    return words[-1] if words and text.endswith(words[-1]) else ""


def is_clause(text: str) -> bool:
    return len(_CJK.findall(text)) >= 8 or sum(w.isalpha() and len(w) > 1 for w in _WORD.findall(text)) >= 4


#: How often a unit must have occurred inside clauses to count as no ending.
INSIDE = 3
#: How many occurrences of one kind outweigh a single one of the other, at any size of the input.
OUTWEIGH = 20


def breaks(inside, ends, starts):
    """Whether a unit breaks a clause off, from its occurrences (numbers or columns).

    It does where it stands inside clauses and hardly ever ends one, or begins longer words
    and hardly ever is one.
    """
    return (inside >= INSIDE) & (ends * OUTWEIGH <= inside) | (starts >= 1) & ((inside + ends) * OUTWEIGH <= starts)


def clause_units(texts: list[str]) -> dict[str, list[int]]:
    """Unit -> number of folded texts which hold it inside a clause, at its end, as the start of a longer word."""
    counts = (Counter(), Counter(), Counter())
    inside, ends, starts = counts
    for text in texts:
        if not is_clause(text) or not (end := ending(text)):
            continue
        ends[end] += 1
        if _CJK.match(end):
            inside.update({text[i : i + 2] for i in range(len(text) - 2)})
        else:
            words = set(_WORD.findall(text))
            inside.update(words - {end})
            starts.update({w[:k] for w in words for k in range(1, len(w))})
    return {unit: [c[unit] for c in counts] for unit in set().union(*counts)}


class Endings:
    """The units that break a clause off, learned from folded golds in memory."""

    def __init__(self, texts: list[str]):
        self.breaking = {unit for unit, counts in clause_units(texts).items() if breaks(*counts)}


def breaks_off(answer: str, golds: list[str]) -> tuple[bool, str]:
    """Whether an answer stops inside a word, phrase, name or path (all arguments folded).

    Where its form does not tell, the unit at its end does, which comes second.
    """
    text = answer.strip()
    if text.endswith(("…", "...", "‥")) or re.search(r"\w-$", text) and not _PATH.match(text):
        return True, ""
    core = text.strip("“\"'„«「*` ")
    for gold in golds:
        k = border(gold, core)
        if not k or k == len(gold):
            continue
        before = core[: len(core) - k]
        lead = not before or before[-1] in " :：，,。.、“\"'「«" or _CJK.match(before[-1]) is not None
        if lead and (k == len(core) and k >= 2 or k >= max(4, len(gold) // 4)):
            if not any(g == core or core.endswith(g) and len(g) >= k for g in golds):
                return True, ""
    if unclosed(text) and text[-1:] not in _TERMINAL:
        return True, ""
    if _PATH.match(text) and not re.search(r"(?:/|\.\w{1,5})$", text):
        return True, ""
    if text[-1:] not in _TERMINAL and is_clause(text) and not _PATH.match(text):
        return False, ending(text)
    return False, ""


def verdict(answer: str | None, question: str | None, golds: list[str | None] | None, best: str | None) -> tuple[str | None, str]:
    """(defect type of one answer or None, unit at its end that makes it truncated where it breaks clauses off)."""
    if answer is None or not letters(transducer()(answer.replace("\\n", "\n"))):
        return "empty", ""
    if question is None and not golds:
        return None, ""
    text, ask = folded(answer), folded(question or "")
    known = [folded(g) for g in [*(golds or []), best] if g]
    if text in known or text.rstrip(_TERMINAL) in known:
        return None, ""
    if ask and copies(text, ask):
        return "copies_question", ""
    real = [g for g in known if not refuses(g)]
    if real and refuses(text) and not any(len(g) > 2 and g in text for g in real):
        if not any(refuses(g) for g in [folded(g) for g in golds or [] if g]):
            return "refusal", ""
    expected = {lang for lang in (language_of(question or ""), *(language_of(g) for g in golds or [] if g)) if lang}
    lang = strong_language(answer.replace("\\n", "\n"))
    if lang and expected and lang not in expected and not any(len(g) > 3 and g in text for g in known):
        return "wrong_language", ""
    broken, unit = breaks_off(text, [folded(g) for g in golds or [] if g])
    return "truncated" if broken else None, unit


def defect_of(answer: str | None, question: str | None, golds: list[str | None] | None, best: str | None, endings: Endings) -> str | None:
    """The defect type of one answer, or None."""
    defect, unit = verdict(answer, question, golds, best)
    return "truncated" if unit in endings.breaking else defect


def breaking_units(questions: DataFrame) -> DataFrame:
    """``unit`` of every unit that breaks clauses off, counted over all distinct golds.

    Golds are whole by definition; what hardly ever ends one of them is no ending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = clause_units([folded(text) for text in batch.column(0).to_pylist()])
            columns = [*zip(*counts.values())] or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*counts], pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["unit", "inside", "ends", "starts"]
            )

    texts = questions.select(F.explode("golds").alias("gold")).where(F.col("gold").isNotNull()).distinct()
    counted = texts.mapInArrow(run, "unit string, inside bigint, ends bigint, starts bigint")
    summed = counted.groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("inside", "ends", "starts")))
    return summed.where(breaks(F.col("inside"), F.col("ends"), F.col("starts"))).select("unit")


def defects(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``answer_id, defect`` of every defective answer.

    Joins on ``qa_id`` and on the unit at the end of an answer: the other side is broadcast
    below a checked size; beyond it the join shuffles and AQE splits a hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, judged = batch.column(0).to_pylist(), []
            for answer, best, question, golds in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                judged.append(verdict(answer, question, golds, best))
            keep = [i for i, (defect, unit) in enumerate(judged) if defect or unit]
            columns = [[ids[i] for i in keep], [judged[i][0] for i in keep], [judged[i][1] or None for i in keep]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["answer_id", "defect", "unit"]
            )

    asked = questions.select("qa_id", "question", "golds").where(F.col("qa_id").isNotNull()).dropDuplicates(["qa_id"])
    rows = spread(answers.select("qa_id", "answer_id", "answer", "best_gold")).join(small_or_shuffled(asked), "qa_id", "left")
    rows = rows.select("answer_id", "answer", "best_gold", "question", "golds").mapInArrow(run, "answer_id bigint, defect string, unit string")
    units = small_or_shuffled(breaking_units(questions).withColumn("_breaks", F.lit("truncated")))
    rows = rows.join(units, "unit", "left").select("answer_id", F.coalesce("defect", "_breaks").alias("defect"))
    return rows.where(F.col("defect").isNotNull())


def found(spark, sf_dir):
    return defects(spark.read.parquet(f"{sf_dir}/recall_answers.parquet"), spark.read.parquet(f"{sf_dir}/recall_qa.parquet"))


def defect_report(spark, sf_dir):
    """Answers by variant and defect ('none' for proper answers)."""
    answers = spark.read.parquet(f"{sf_dir}/recall_answers.parquet").select("answer_id", "variant")
    return (
        answers.join(found(spark, sf_dir), "answer_id", "left")
        .groupBy("variant", F.coalesce("defect", F.lit("none")).alias("defect"))
        .agg(F.count(F.lit(1)).alias("answers"))
    )
