"""Count-only Viterbi over a double-array trie, for unigram vocabularies.

The pieces of the vocabulary are the keys of a double-array trie over UTF-8 bytes. A
normalized segment is segmented by the best sum of piece scores; only the length of the
best path is kept at each position, never the path itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class DoubleArrayTrie:
    """Static trie in two integer arrays: child = base[node] + byte + 1, valid if check[child] is the node."""

    #: Slots searched at once for a node's children.
    WINDOW = 2048

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        size = max(1024, 2 * sum(map(len, keys)) + 512)
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.value = np.full(size, -1, np.int64)
        taken = np.zeros(size, bool)
        taken[0] = True
        free = 1
        stack = [(0, 0, len(order), 0)]
        while stack:
            node, lo, hi, depth = stack.pop()
            children: list[tuple[int, int, int]] = []
            i = lo
            while i < hi:
                key = keys[order[i]]
                if len(key) == depth:
                    self.value[node] = order[i]
                    i += 1
                    continue
                byte, j = key[depth], i
                while j < hi and len(keys[order[j]]) > depth and keys[order[j]][depth] == byte:
                    j += 1
                children.append((byte, i, j))
                i = j
            if not children:
                continue
            while free < len(taken) and taken[free]:
                free += 1
            codes = np.array([byte + 1 for byte, _, _ in children])
            base, at = 0, free
            while not base:
                while at + self.WINDOW + 512 >= len(taken):
                    grow = len(taken)
                    self.base = np.concatenate([self.base, np.zeros(grow, np.int64)])
                    self.check = np.concatenate([self.check, np.full(grow, -1, np.int64)])
                    self.value = np.concatenate([self.value, np.full(grow, -1, np.int64)])
                    taken = np.concatenate([taken, np.zeros(grow, bool)])
                # All places of the first child in a window are tried at once.
                tried = at + np.flatnonzero(~taken[at : at + self.WINDOW]) - codes[0]
                tried = tried[tried >= 1]
                for code in codes[1:]:
                    tried = tried[~taken[tried + code]]
                base = int(tried[0]) if len(tried) else 0
                at += self.WINDOW
            self.base[node] = base
            taken[base + codes] = True
            for byte, i, j in children:
                child = base + byte + 1
                self.check[child] = node
                stack.append((child, i, j, depth + 1))
        # Plain lists are several times faster to index one element at a time.
        self.base, self.check, self.value = self.base.tolist(), self.check.tolist(), self.value.tolist()

    def prefixes(self, data: bytes, start: int) -> list[tuple[int, int]]:
        """(end, key number) of each key that starts at ``start``."""
        base, check, value = self.base, self.check, self.value
        node, out = 0, []
        for i in range(start, len(data)):
            child = base[node] + data[i] + 1
            if child >= len(check) or check[child] != node or not base[node]:
                break
            node = child
            if value[node] >= 0:
                out.append((i + 1, value[node]))
        return out


class Unigram:
    """A unigram vocabulary: pieces with scores, an unknown piece, and how texts are prepared."""

    #: How far below the lowest score an unknown character is scored.
    UNKNOWN_PENALTY = 10.0
    #: Characters of the longest segment that is remembered.
    LONGEST = 64

    def __init__(self, pieces: list[tuple[str, float]], segments: Callable[[str], list[str]] | None = None, memory: int = 4_000_000):
        self.scores = [score for _, score in pieces]
        self.trie = DoubleArrayTrie([piece.encode() for piece, _ in pieces])
        self.unknown = min(self.scores, default=0.0) - self.UNKNOWN_PENALTY
        self.segments = segments or (lambda text: [text])
        self.memory, self._known, self._held = memory, {}, 0  # characters of remembered segments

    def count(self, segment: str) -> int:
        """Tokens of the best segmentation; neighbouring unknown characters are one token."""
        data = segment.encode("utf-8", "replace")
        n = len(data)
        best = [float("-inf")] * (n + 1)
        length = [0] * (n + 1)
        unknown_end = [False] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            if best[at] == float("-inf"):
                continue
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            single = False
            for end, piece in self.trie.prefixes(data, at):
                single |= end == at + width
                score = best[at] + self.scores[piece]
                if score > best[end]:
                    best[end], length[end], unknown_end[end] = score, length[at] + 1, False
            if not single:
                end, score = at + width, best[at] + self.unknown
                if score > best[end]:
                    best[end], length[end], unknown_end[end] = score, length[at] + (not unknown_end[at]), True
        return length[n]

    def counts(self, texts: list[str | None]) -> list[int]:
        out, known = [], self._known
        for text in texts:
            total = 0
            for segment in self.segments(text) if text else ():
                size = known.get(segment)
                if size is None:
                    size = self.count(segment)
                    if len(segment) <= self.LONGEST:
                        if self._held + len(segment) > self.memory:
                            known.clear()
                            self._held = 0
                        known[segment] = size
                        self._held += len(segment)
                total += size
            out.append(total)
        return out


def from_tokenizer_json(spec: dict) -> Unigram:
    """A unigram vocabulary of a tokenizer file; its own normalizer and splitter prepare the texts."""
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json.dumps(spec))

    def segments(text: str) -> list[str]:
        plain = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        if not tokenizer.pre_tokenizer:
            return [plain]
        return [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    return Unigram([(piece, score) for piece, score in spec["model"]["vocab"]], segments)
