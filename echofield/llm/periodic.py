"""Maximal periodic runs of words, found by uniting suffix classes by falling common prefix.

Two positions of a document belong to one class at level l where the next l
words agree.  Classes are united from the longest common prefix downwards, each
an ordered set of positions.  Where a union at level l makes x < y neighbours in
their set and d = y - x is at most l, the words from x to y + l - 1 repeat with
period d, and no shorter one: a shorter period would have put a position of the
same class between them.  The leftmost such pair of every run is united exactly
once, so each run is found exactly once.

A run of at least ``repeats`` periods and ``shortest`` words needs a common
prefix of shortest x (repeats - 1) / repeats words.  Documents in which no
window of that many words occurs twice have none and are not sorted.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofield.llm.common import binary_texts, small

SHORTEST, REPEATS = 24, 3
BLOCK = 512
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Positions:
    """An ordered set of numbers in sorted blocks, so that one of a million is placed as fast as one of a thousand."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, x: int) -> None:
        self.blocks, self.heads, self.size = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The next smaller and the next larger member; ``x`` itself is no member."""
        b = bisect_right(self.heads, x) - 1
        if b < 0:
            return None, self.heads[0]
        block = self.blocks[b]
        i = bisect_right(block, x)
        if i < len(block):
            return block[i - 1], block[i]
        return block[-1], self.heads[b + 1] if b + 1 < len(self.heads) else None

    def add(self, x: int) -> None:
        b = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[b]
        insort(block, x)
        self.heads[b] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b:b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads[b:b + 1] = [block[0], block[BLOCK]]


def common_prefixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, longest common prefix of each with the next), by doubling the compared length."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [], 1
    while rank.max() < n:
        levels.append(np.append(rank, 0).astype(np.int32))
        ahead = np.zeros(n, np.int64)
        ahead[:max(n - width, 0)] = rank[width:]
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(1, np.diff(key[order]) != 0))
        width *= 2
    order = np.empty(n, np.int64)
    order[rank - 1] = np.arange(n)
    left, right = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        step = np.where(levels[k][left] == levels[k][right], 1 << k, 0)
        left += step
        right += step
    return order, left - order[:-1]


def runs_of(words: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run in one document's word numbers, by start, then period."""
    if len(words) < 2:
        return []
    order, prefix = common_prefixes(words)
    at = np.flatnonzero(prefix >= -(-shortest * (repeats - 1) // repeats))
    at = at[np.argsort(-prefix[at], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    found = []

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def seed(x: int | None, y: int | None, level: int) -> None:
        if x is None or y is None:
            return
        period = y - x
        length = period + level
        if length >= shortest and length >= repeats * period and (x == 0 or words[x - 1] != words[y - 1]):
            found.append((x, length, period))

    for x, y, level in zip(order[at].tolist(), order[at + 1].tolist(), prefix[at].tolist()):
        x, y = root(x), root(y)
        large, few = sets.pop(x, None) or Positions(x), sets.pop(y, None) or Positions(y)
        if large.size < few.size:
            large, few, x, y = few, large, y, x
        parent[y], sets[x] = x, large
        # Only pairs that no third member of the united set lies between are neighbours.
        moved = list(few)
        for i, z in enumerate(moved):
            below, above = large.around(z)
            if i == 0 or below is not None and moved[i - 1] < below:
                seed(below, z, level)
            if i + 1 == len(moved) or above is not None and above < moved[i + 1]:
                seed(z, above, level)
        for z in moved:
            large.add(z)
    return sorted(found, key=lambda run: (run[0], run[2]))


def with_repeats(words: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """The documents in which some window of ``width`` words may occur twice, judged by its hash.

    ``doc`` holds the document of each word, ascending.  No repeated window is missed.
    """
    if len(words) < width:
        return np.empty(0, np.int64)
    count = len(words) - width + 1
    value = doc[:count].astype(np.uint64)
    for k in range(width):
        value = value * np.uint64(0x9E3779B97F4A7C15) + words[k:k + count].astype(np.uint64)
        value ^= value >> np.uint64(29)
    value, owner = value[doc[:count] == doc[width - 1:]], doc[:count][doc[:count] == doc[width - 1:]]
    order = np.argsort(value, kind="stable")
    twin = value[order][1:] == value[order][:-1]
    return np.unique(owner[order[1:][twin]])


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs``.

    Words are what ASCII white space separates.  ``runs`` holds every stretch of
    at least ``shortest`` words and ``repeats`` smallest periods that cannot be
    extended, by start, then period.  ``collapsed`` is the text without the
    words that some run holds after its first period, joined by single blanks.
    A null or empty text has no words, no runs and an empty ``collapsed``.  Rows
    with the same or a null key stay rows of their own, other columns are left
    out, an empty table gives no rows.  Nothing is shuffled; a task holds the
    words of about 2 MB of texts, or of one longer text.
    """
    if repeats < 2 or shortest < 1:
        raise ValueError("a run has at least two periods and one word")
    width = -(-shortest * (repeats - 1) // repeats)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole, 1):
                bodies = [body.split() for body in binary_texts(batch.column(1))]
                sizes = np.array([len(b) for b in bodies], np.int64)
                ends = np.cumsum(sizes)
                numbers = _Numbers()
                words = np.concatenate([
                    np.empty(0, np.int64), *(np.fromiter(map(numbers.__getitem__, b), np.int64, len(b)) for b in bodies)
                ])
                runs: list[list] = [[] for _ in bodies]
                for d in with_repeats(words, np.repeat(np.arange(len(bodies)), sizes), width).tolist():
                    runs[d] = runs_of(words[ends[d] - sizes[d]:ends[d]], shortest, repeats)
                    gone = np.zeros(len(bodies[d]) + 1, np.int64)
                    for start, length, period in runs[d]:
                        gone[start + period] += 1
                        gone[start + length] -= 1
                    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    bodies[d] = [bodies[d][i] for i in kept.tolist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(sizes),
                    pa.array([[dict(zip(("start", "length", "period"), run)) for run in r] for r in runs], pa.list_(RUN)),
                    pa.array([b" ".join(b) for b in bodies], pa.binary()).cast(pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, SCHEMA)
