"""A linear-chain conditional random field over words, in numpy.

Features of a word are its script, affixes, character n-grams, the word itself and the
function-word lists it is in, hashed into one weight table; a word has as many as it has.
Transitions between the states (languages) of neighbouring words are learned with the
weights by gradient ascent on the conditional likelihood; forward-backward gives the
probability of each state at each word. Many sequences are run side by side, so one step of
the recursion is one matrix product. Long sequences are run in stretches side by side too:
the product of a stretch's steps carries the recursion over it, which gives the same
probabilities as one run over the whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import cycle, islice

import numpy as np
import xxhash

from loomarc.llm.labels import PROSE
from loomarc.llm.lexicon import STOPWORDS

WIDTH = 1 << 16
#: Words of a stretch; longer sequences are run as several, joined exactly.
STRETCH = 192
_LEXICON: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _word in _words:
        _LEXICON.setdefault(_word, []).append(_lang)


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word."""
    first = word[0]
    out = [f"l:{lang}" for lang in _LEXICON.get(word, ())]
    out.append(f"w:{word}")
    if first >= "぀":
        out.append("s:h" if first < "゠" else "s:k" if first <= "ヿ" else "s:z")
        out += [f"c:{ch}" for ch in dict.fromkeys(word)]
        out += [f"b:{word[i : i + 2]}" for i in range(len(word) - 1)]
    else:
        out.append("s:c" if first >= "Ѐ" else "s:l")
        out += [f"p:{word[:k]}" for k in (1, 2, 3) if len(word) > k]
        out += [f"e:{word[-k:]}" for k in (1, 2, 3, 4) if len(word) > k]
        edge = f"^{word}$"
        out += [f"g:{edge[i : i + 3]}" for i in range(len(edge) - 2)]
        if not word.isascii():
            out += [f"x:{ch}" for ch in dict.fromkeys(word) if ch > "\x7f"]
    return [xxhash.xxh32_intdigest(f) & (WIDTH - 1) for f in out]


def feature_lists(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words one after the other, where each word's begin)."""
    rows = [word_features(w) for w in words]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.array([f for row in rows for f in row], np.int32), np.cumsum(sizes) - sizes


class Chain:
    """Weights and transitions, with batched forward-backward."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, states: tuple[str, ...] = PROSE):
        self.weights, self.transitions, self.states = weights, transitions, states

    def emissions(self, words: list[str]) -> np.ndarray:
        parts = [np.zeros((0, len(self.states)), np.float32)]
        for a in range(0, len(words), 20_000):
            flat, begins = feature_lists(words[a : a + 20_000])
            parts.append(np.add.reduceat(self.weights[flat], begins, 0))
        return np.concatenate(parts)

    def marginals(self, emission: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 4096) -> np.ndarray:
        """State probabilities of each word; sequence i is ``emission[starts[i]:starts[i]+lengths[i]]``."""
        k = emission.shape[1]
        out = np.empty_like(emission)
        move = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        level = np.exp(emission - emission.max(1, keepdims=True)) if len(emission) else emission
        before, after = np.ones((len(lengths), k), np.float32), np.ones((len(lengths), k), np.float32)
        if len(lengths) and lengths.max() > STRETCH:
            starts, lengths, before, after = self._stretches(level, starts, lengths, move)
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(order), block):
            part = order[a : a + block]
            self._block(level, starts[part], lengths[part], before[part], after[part], move, out)
        return out

    @staticmethod
    def _stretches(level, starts, lengths, move) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sequences cut into stretches, with what the words before and after say of each one's ends."""
        counts = np.maximum(-(-lengths // STRETCH), 1)
        owner = np.repeat(np.arange(len(lengths)), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = starts[owner] + place * STRETCH
        size = np.minimum(lengths[owner] - place * STRETCH, STRETCH)
        k = level.shape[1]
        before, after = np.ones((len(owner), k), np.float32), np.ones((len(owner), k), np.float32)
        several = np.flatnonzero(counts[owner] > 1)
        products = np.concatenate([Chain._products(level, begin[part], size[part], move) for part in np.split(several, range(4096, len(several), 4096))])
        for i, s in enumerate(several.tolist()):
            if place[s]:
                row = before[s - 1] @ products[i - 1] @ move
                before[s] = row / row.max()
        for i, s in [*enumerate(several.tolist())][::-1]:
            if place[s]:
                row = move @ (products[i] @ after[s])
                after[s - 1] = row / row.max()
        return begin, size, before, after

    @staticmethod
    def _products(level, begin, size, move) -> np.ndarray:
        """Of each stretch the product of its steps, up to a factor."""
        product = np.eye(level.shape[1], dtype=np.float32) * level[begin][:, None, :]
        for t in range(1, int(size.max())):
            live = np.flatnonzero(size > t)
            step = (product[live] @ move) * level[begin[live] + t][:, None, :]
            product[live] = step / step.max((1, 2), keepdims=True)
        return product

    @staticmethod
    def _block(level, starts, lengths, before, after, move, out) -> None:
        longest = int(lengths[0]) if len(lengths) else 0
        if not longest:
            return
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
        alphas = []
        for t in range(longest):
            n = active[t]
            alpha = (before[:n] if t == 0 else alphas[-1][:n] @ move) * level[starts[:n] + t]
            alpha /= alpha.sum(1, keepdims=True)
            alphas.append(alpha)
        beta = after[:0]
        for t in range(longest - 1, -1, -1):
            n = active[t]
            if len(beta) < n:  # sequences that end here
                beta = np.concatenate([beta, after[len(beta) : n]])
            gamma = alphas[t] * beta
            at = starts[:n] + t
            out[at] = gamma / gamma.sum(1, keepdims=True)
            if t:
                beta = (level[at] * beta) @ move.T
                beta /= beta.sum(1, keepdims=True)

    def expectations(self, emission: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state probabilities of each word, expected transitions) of a batch, in one recursion (for learning)."""
        move = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        longest, k = int(lengths[0]), emission.shape[1]
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        level = np.exp(emission - emission.max(1, keepdims=True))
        alphas = []
        for t in range(longest):
            e = level[starts[: active[t]] + t]
            alpha = e if t == 0 else (alphas[-1][: active[t]] @ move) * e
            alphas.append(alpha / alpha.sum(1, keepdims=True))
        out, total = np.empty_like(emission), np.zeros_like(self.transitions)
        beta = np.ones((0, k), np.float32)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), k), np.float32)])
            at = starts[:n] + t
            gamma = alphas[t] * beta
            out[at] = gamma / gamma.sum(1, keepdims=True)
            if t:
                right, left = level[at] * beta, alphas[t - 1][:n]
                size = ((left @ move) * right).sum(1, keepdims=True)
                total += move * ((left / size).T @ right)
                beta = right @ move.T
                beta /= beta.sum(1, keepdims=True)
        return out, total


def learn(sequences: list[tuple[list[str], list[int]]], states: tuple[str, ...] = PROSE, steps: int = 40, batch: int = 2000, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """Fit a chain to labelled word sequences (Adagrad on the regularized likelihood, in batches as they come)."""
    k = len(states)
    chain = Chain(np.zeros((WIDTH, k), np.float32), np.zeros((k, k), np.float32), states)
    squares, t_squares = np.full((WIDTH, k), 1e-4, np.float32), np.full((k, k), 1e-4, np.float32)
    prepared = [_prepared(sequences[a : a + batch], k) for a in range(0, len(sequences), batch)]
    for ids, gold, starts, lengths, flat, begins, seen in islice(cycle(prepared), steps):
        emission = np.add.reduceat(chain.weights[flat], begins, 0)[ids]
        probability, moved = chain.expectations(emission, starts, lengths)
        error = -probability
        error[np.arange(len(gold)), gold] += 1
        sizes = np.diff(begins, append=len(flat))
        gradient = np.empty((WIDTH, k), np.float32)
        for s in range(k):
            by_word = np.bincount(ids, error[:, s], len(begins))
            gradient[:, s] = np.bincount(flat, np.repeat(by_word, sizes), WIDTH)
        gradient = gradient / len(lengths) - decay * chain.weights
        squares += gradient**2
        chain.weights += rate * gradient / np.sqrt(squares)
        t_gradient = (seen - moved) / len(lengths) - decay * chain.transitions
        t_squares += t_gradient**2
        chain.transitions += rate * t_gradient / np.sqrt(t_squares)
    return chain


def _prepared(sequences, k: int) -> tuple:
    """A batch in arrays: words, states, sequences' starts and lengths, features, seen transitions."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in sequences for w in words))}
    flat, begins = feature_lists(vocabulary)
    ids = np.array([vocabulary[w] for words, _ in sequences for w in words], np.int64)
    gold = np.array([s for _, labels in sequences for s in labels], np.int64)
    lengths = np.array([len(words) for words, _ in sequences], np.int64)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    seen = np.zeros((k, k), np.float32)
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    return ids, gold, starts, lengths, flat, begins, seen
