"""Token ids of the whole corpus under a byte-level BPE vocabulary, by recursive SQL.

Each Python worker holds an in-process DuckDB with the merge table of the vocabulary. Per
Arrow batch the words of its texts are collected, new ones are cut into fragments between
which no merge can happen, and the fragments become token-position rows. A recursive query
joins neighbouring rows with the merge table and contracts the pair of minimum rank in
each fragment, leftmost first, until nothing is left to merge; an ordered aggregation gives
the ids. A memory of words means that each word is merged about once per worker.

Cutting is exact: a fragment ends between two bytes that no token of the vocabulary holds
side by side, so no token can span the cut.

A recursion keeps the rows of its steps, so it stops after ``STEPS`` and goes on from its last
one: memory is linear in the bytes merged at once (``ROWS``). Long fragments contract many
pairs a step: every pair that is the minimum (rank, then position) of all pairs that start up to
``span`` bytes before and twice that after it, ``span`` being the longest token of its bytes. No
merge that comes before it can reach its tokens, for the first one of such a chain would be a pair
of lower rank within that distance. In a run of equal pairs of which that holds every second one
goes, unless lower ranks can appear beside them. Fragments beyond ``ROWS`` bytes are merged in stretches, leaving
pairs too near a cut for stretches cut elsewhere. DuckDB never writes to disk.

Defined results: null and '' give an empty list. Text that looks like a special token is
ordinary text. Repeated rows each have their ids; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomarc.llm.tokens import DEFAULT, MEMORY, TOKENIZERS, Words, load_ranks
from loomarc.runtime import spread

# ``alone`` marks ranks after which a lower rank may appear beside the merged token; of
# those only the leftmost pair is contracted in a step. Of all others every pair of the
# minimum rank is, alternating within runs of overlapping pairs: the order does not matter.
MERGE_SQL = """
WITH RECURSIVE steps(step, fragment, position, token) AS (
  SELECT 0, fragment, position, token FROM fragments
  UNION ALL
  SELECT step + 1, fragment, position, coalesce(merged, token)
  FROM (
    SELECT *, lag(merged) OVER (PARTITION BY fragment ORDER BY position) AS merged_before
    FROM (
      SELECT *, CASE WHEN rank = best AND (position = leftmost OR (NOT alone AND place % 2 = 1)) THEN rank END AS merged
      FROM (
        SELECT *,
          row_number() OVER (PARTITION BY fragment, run, rank = best ORDER BY position) AS place,
          min(CASE WHEN rank = best THEN position END) OVER (PARTITION BY fragment) AS leftmost
        FROM (
          SELECT *, sum(CASE WHEN rank = best THEN 0 ELSE 1 END) OVER (PARTITION BY fragment ORDER BY position) AS run
          FROM (
            SELECT p.*, m.rank, m.alone, min(m.rank) OVER (PARTITION BY p.fragment) AS best
            FROM (
              SELECT step, fragment, position, token,
                lead(token) OVER (PARTITION BY fragment ORDER BY position) AS following
              FROM steps
            ) p LEFT JOIN merges m ON m.left_token = p.token AND m.right_token = p.following
          ) WHERE best IS NOT NULL
        )
      )
    )
  ) WHERE merged_before IS NULL AND step < {steps}
), last AS (SELECT fragment, max(step) AS step FROM steps GROUP BY fragment)
SELECT fragment, list(token ORDER BY position) AS ids, list(position ORDER BY position) AS places, any_value(step) AS step
FROM steps JOIN last USING (fragment, step) GROUP BY fragment
"""

LONG_SQL = """
WITH RECURSIVE steps(step, fragment, position, token) AS (
  SELECT 0, fragment, position, token FROM fragments
  UNION ALL
  SELECT step + 1, fragment, position, coalesce(merged, token)
  FROM (
    SELECT *, lag(merged) OVER one AS merged_before, count(merged) OVER (PARTITION BY fragment) AS merges_done
    FROM (
      SELECT step, fragment, position, token,
        CASE WHEN p.key = p.best OR p.whole = p.rank AND p.place % 2 = 1 AND NOT p.alone THEN p.rank END AS merged
      FROM (
        SELECT *, min(best >> 32) OVER run AS whole, row_number() OVER run_order AS place
        FROM (
          SELECT *, CASE WHEN (position - {span} >= lo OR open_left) AND (position + 2 * {span} <= hi OR open_right)
              THEN min(key) OVER (PARTITION BY fragment ORDER BY position RANGE BETWEEN {span} PRECEDING AND 2 * {span} FOLLOWING) ELSE -1 END AS best,
            sum(turn) OVER (PARTITION BY fragment ORDER BY position) AS run
          FROM (
            SELECT *, CASE WHEN rank IS NOT DISTINCT FROM lag(rank) OVER (PARTITION BY fragment ORDER BY position) THEN 0 ELSE 1 END AS turn
            FROM (
              SELECT q.*, m.rank, m.alone, m.rank::BIGINT * 4294967296 + q.position AS key
              FROM (SELECT step, fragment, position, token, lead(token) OVER one AS following FROM steps WINDOW one AS (PARTITION BY fragment ORDER BY position)) q
              LEFT JOIN merges m ON m.left_token = q.token AND m.right_token = q.following
            ) JOIN cuts USING (fragment)
          )
        ) WINDOW run AS (PARTITION BY fragment, run), run_order AS (PARTITION BY fragment, run ORDER BY position)
      ) p
    ) WINDOW one AS (PARTITION BY fragment ORDER BY position)
  ) WHERE merges_done > 0 AND merged_before IS NULL AND step < {steps}
), last AS (SELECT fragment, max(step) AS step FROM steps GROUP BY fragment)
SELECT fragment, list(token ORDER BY position) AS ids, list(position ORDER BY position) AS places, any_value(step) AS step
FROM steps JOIN last USING (fragment, step) GROUP BY fragment
"""

#: Steps of one recursion, whose rows are kept until it ends.
STEPS = 16
#: Token rows merged at once.
ROWS = 200_000
#: Bytes from which a fragment is long.
LONG = 256


class Encoder:
    """Word and fragment memory of one worker, over an in-process DuckDB."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.split = Words()
        self.words: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        inside = np.zeros((256, 256), bool)
        left, right, rank = [], [], []
        for token, number in ranks.items():
            for cut in range(1, len(token)):
                inside[token[cut - 1], token[cut]] = True
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(number)
        self.inside = inside
        # The longest token of each set of bytes, to know how far one reaches in a fragment.
        self.sets: dict[frozenset[int], int] = {}
        for token in ranks:
            own = frozenset(token)
            self.sets[own] = max(self.sets.get(own, 0), len(token))
        merged = {number for token, number in ranks.items() if len(token) > 1}
        alone = {x for a, b, k in zip(left, right, rank) for x in (a, b) if x in merged and k < x}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("given", pa.table({"left_token": left, "right_token": right, "rank": rank, "alone": [k in alone for k in rank]}))
        self.db.execute("CREATE TABLE merges AS SELECT left_token::INT AS left_token, right_token::INT AS right_token, rank::INT AS rank, alone FROM given")
        self.db.unregister("given")

    def encode(self, texts: list[str | None]) -> tuple[list[int], bytes]:
        """(offsets, ids as 32-bit integers) of a batch of texts."""
        split = [self.split(t) if t else () for t in texts]
        known = self.words
        new = set().union(*split).difference(known)
        if new:
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = set().union(*split)
            self._learn(list(new))
        parts, offsets, size = [], [0], 0
        for words in split:
            part = b"".join([known[word] for word in words])
            parts.append(part)
            size += len(part) // 4
            offsets.append(size)
        return offsets, b"".join(parts)

    def _learn(self, words: list[str]) -> None:
        """Enter the ids of new words: cut all of them at once, merge what is new, put together."""
        raw = [word.encode() for word in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        joined = b"".join(raw)
        values = np.frombuffer(joined, np.uint8)
        bound = np.ones(len(values) + 1, bool)
        bound[1:-1] = ~self.inside[values[:-1], values[1:]]
        ends = np.cumsum(sizes)
        bound[ends] = True
        cuts = np.flatnonzero(bound)
        pieces = [joined[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        self._enter(set(pieces))
        found = self.fragments
        ids = [found[p] for p in pieces]
        last = np.searchsorted(cuts, ends).tolist()
        first = 0
        for word, stop in zip(words, last):
            self.words[word] = ids[first] if stop == first + 1 else b"".join(ids[first:stop])
            first = stop

    def _enter(self, pieces: set[bytes]) -> None:
        new = pieces.difference(self.fragments)
        if len(self.fragments) + len(new) > MEMORY:
            self.fragments.clear()
            new = pieces
        pending = []
        for piece in new:
            whole = self.ranks.get(piece)
            if whole is not None:
                self.fragments[piece] = whole.to_bytes(4, sys.byteorder)
            else:
                pending.append(piece)
        group, size = [], 0
        for piece in pending:
            if len(piece) >= LONG:
                self.fragments[piece] = self._merge_long(piece)
                continue
            if size + len(piece) > ROWS:
                self._merge(group)
                group, size = [], 0
            group.append(piece)
            size += len(piece)
        if group:
            self._merge(group)

    def _merge(self, pieces: list[bytes]) -> None:
        """Merge short fragments, all at once, until none changes."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        positions = (np.arange(sizes.sum()) - np.repeat(starts, sizes)).astype(np.int32)
        left = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), positions, self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(left[0]):
            open_: list[tuple] = []
            for number, ids, places, step in self._run(MERGE_SQL.format(steps=STEPS), *left):
                if step < STEPS:
                    self.fragments[pieces[number]] = np.array(ids, np.int32).tobytes()
                else:
                    open_.append((number, ids, places))
            left = (
                np.repeat(np.array([o[0] for o in open_], np.int32), [len(o[1]) for o in open_]),
                np.array([x for o in open_ for x in o[2]], np.int32), np.array([x for o in open_ for x in o[1]], np.int32),
            )

    def _run(self, sql: str, fragment: np.ndarray, position: np.ndarray, token: np.ndarray, cuts: pa.Table | None = None) -> list[tuple]:
        self.db.register("fragments", pa.table({"fragment": fragment, "position": position, "token": token}))
        if cuts is not None:
            self.db.register("cuts", cuts)
        try:
            return self.db.sql(sql).fetchall()
        finally:
            self.db.unregister("fragments")
            if cuts is not None:
                self.db.unregister("cuts")

    def _merge_long(self, piece: bytes) -> bytes:
        """Merge one long fragment, in stretches where it is longer than what is merged at once."""
        own = frozenset(piece)
        span = max(length for known, length in self.sets.items() if known <= own)
        width = max(ROWS, 16 * span)
        position, token = np.arange(len(piece), dtype=np.int64), self.single[np.frombuffer(piece, np.uint8)]
        shift, idle = 0, 0
        while idle < (2 if len(piece) > width else 1):
            edges = [0, *range(width - shift, len(piece), width), len(piece)] if len(piece) > width else [0, len(piece)]
            parts, changed = [], False
            for lo, hi in zip(edges, edges[1:]):
                a, b = np.searchsorted(position, (lo, hi))
                if a == b:
                    continue
                cuts = pa.table({"fragment": pa.array([0], pa.int32()), "lo": [lo], "hi": [hi], "open_left": [lo == 0], "open_right": [hi == len(piece)]})
                p, t, step = position[a:b], token[a:b], STEPS
                while step == STEPS:
                    ((_, ids, places, step),) = self._run(LONG_SQL.format(span=span, steps=STEPS), np.zeros(len(p), np.int32), p, t, cuts)
                    changed |= step > 0
                    p, t = np.array(places, np.int64), np.array(ids, np.int32)
                parts.append((p, t))
            position, token = np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts])
            idle = 0 if changed else idle + 1
            shift = width // 2 - shift
        return token.astype(np.int32).tobytes()


@lru_cache(maxsize=1)
def encoder(name: str = DEFAULT, folder: str = TOKENIZERS) -> Encoder:
    return Encoder(load_ranks(os.path.join(folder, name + ".tiktoken")))


def token_ids(df: DataFrame, id_col: str, text_col: str, name: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of each row; one Arrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, folder)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                offsets, ids = own.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), F.col(f"`{text_col}`"))
    return spread(rows).mapInArrow(run, f"`{id_col}` bigint, ids array<int>")


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of a list of ids (for round trips)."""
    back = {number: token for token, number in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


def p8_ids(spark, sf_dir):
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def p8_lengths(spark, sf_dir):
    """Documents and ids by length class (powers of two)."""
    sized = p8_ids(spark, sf_dir).select(F.size("ids").alias("n"))
    length = F.when(F.col("n") == 0, 0).otherwise(F.floor(F.log2(F.col("n").cast("double"))) + 1).cast("int")
    return sized.groupBy(length.alias("class")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("ids"))
