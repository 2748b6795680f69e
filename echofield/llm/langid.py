"""Language identification by cross-parsing.

For each language the suffix automaton of labelled text is built.  A text is
read against it in phrases: each phrase is the longest match that starts where
the last one ended.  c phrases over n symbols against a reference of N symbols
give the normalised count c log2(N) / n; the language with the fewest wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
TEXTS, CHARS = 96, 256
READ = 4  # characters read for each symbol kept
LANGUAGES = 512  # languages with the most texts in the sample
CELLS = 1 << 25  # moves of all languages together that are held as full tables
BLOCK = 1024
_LANES = 1 << 13
_BREAK = np.uint32(1 << 31)
_STATE = np.uint32((1 << 31) - 1)


def training_sample(docs: DataFrame, use: Column, texts: int = TEXTS, chars: int = CHARS, text: str = "text",
                    lang: str = "lang", languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """(lang, text) of at most ``texts`` labelled texts per language, ``chars`` symbols of each.

    The bounded sample that the models are fitted on.  Texts are dealt into
    ``texts`` bins by a hash of the text alone and the smallest hash of each
    bin is taken, so copies count once and the choice does not depend on the
    partitions.  Rows without label, without letters or not in ``use`` are left out,
    and so are labels beyond the ``languages`` that fill the most bins.
    """
    rows = docs.filter(use & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text)).alias("h"),
        F.substring(F.col(text), 1, READ * chars).alias("text"),
    )
    best = rows.groupBy("lang", F.pmod("h", F.lit(texts)).alias("bin")).agg(F.min(F.struct("h", "text")).alias("s"))
    snippet = F.substring(F.lower(F.regexp_replace("s.text", r"\P{L}+", " ")), 1, chars)
    found = best.select("lang", "s.h", snippet.alias("text"))
    # At most ``texts`` rows of a language are here; those of the languages with most come to the driver.
    found = found.withColumn("_bins", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    taken = found.orderBy(F.desc("_bins"), "lang", "h").limit(languages * texts).collect()
    known = set(list(dict.fromkeys(r["lang"] for r in taken))[:languages])
    return [(r["lang"], r["text"]) for r in sorted(taken, key=lambda r: (r["lang"], r["h"])) if r["lang"] in known]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``symbols``."""
    moves: list[dict[int, int]] = [{}]
    longest, link, last = [0], [-1], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at != -1 and s not in moves[at]:
            moves[at][s] = new
            at = link[at]
        if at != -1:
            old = moves[at][s]
            if longest[old] == longest[at] + 1:
                link[new] = old
            else:
                copy = len(moves)
                moves.append(dict(moves[old]))
                longest.append(longest[at] + 1)
                link.append(link[old])
                while at != -1 and moves[at].get(s) == old:
                    moves[at][s] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
    return moves


class Phrases:
    """Moves for cross-parsing one language: the next state, with the top bit set when a phrase ends first.

    Symbols from ``size`` on occur in no text.  One state more stands for a
    phrase that was one unseen symbol: whatever follows starts another.  Moves
    are a full table, or where that is too large the moves that exist, by state
    and symbol; both read a text alike.
    """

    def __init__(self, symbols: list[int], size: int):
        moves = suffix_automaton(symbols)
        self.size, self.states = size, len(moves) + 1
        self.first = np.full(size, len(moves), np.uint32)
        for s, to in moves[0].items():
            if s < size:
                self.first[s] = to
        listed = [(state, s, to) for state, out in enumerate(moves[1:], 1) for s, to in out.items() if s < size]
        flat = np.array(listed, np.int64).reshape(-1, 3)
        keys = flat[:, 0] * size + flat[:, 1]
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(flat[order, 2], 0).astype(np.uint32)
        self.table: np.ndarray | None = None

    def fill(self) -> None:
        """Hold the moves as a full table."""
        table = np.tile(self.first | _BREAK, (self.states, 1))
        table[0] = self.first
        table = table.reshape(-1)
        table[self.keys[:-1]] = self.to[:-1]
        self.table = table

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(state * np.uint32(self.size) + symbol)
        key = state.astype(np.int64) * self.size + symbol
        at = np.searchsorted(self.keys, key)
        fresh = self.first.take(symbol)
        return np.where(self.keys.take(at) == key, self.to.take(at), np.where(state == 0, fresh, fresh | _BREAK))


class Models:
    """Phrase moves of all languages, built from a training sample, each over the letters of its own sample."""

    def __init__(self, sample: tuple[tuple[str, str], ...], cells: int = CELLS):
        own: dict[str, set[str]] = {}
        for lang, text in sample:
            own.setdefault(lang, set()).update(text)
        letters = sorted(set().union(*own.values()) - {" "})
        # 0 is the gap between words, 1 a letter of no sample.
        self.codes = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), np.uint32, 0x110000)
        for i, c in enumerate(letters, 2):
            self.codes[ord(c)] = i
        self.langs = sorted(own)
        self.tables, self.maps, self.norms = [], [], []
        for lang in self.langs:
            # Letters that the language's sample lacks are one symbol, the one behind them parts training texts.
            mine = sorted(own[lang] - {" "})
            to_own = np.ones(len(letters) + 2, np.uint32)
            to_own[0] = 0
            to_own[self.codes[[ord(c) for c in mine]]] = np.arange(2, len(mine) + 2)
            symbols: list[int] = []
            for owner, text in sample:
                if owner == lang:
                    symbols += [*to_own[self.encode(text)].tolist(), len(mine) + 2]
            known = [s if s != 1 else len(mine) + 2 for s in symbols]
            self.tables.append(Phrases(known, len(mine) + 2))
            self.maps.append(to_own)
            self.norms.append(math.log2(max(2, len(symbols))))
        if sum(t.states * t.size for t in self.tables) <= cells:
            for t in self.tables:
                t.fill()

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text: lower-cased letters, one gap for whatever lies between words."""
        raw = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
        return raw[keep]

    def phrases(self, texts: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns).

        Texts are read in blocks of ``block`` symbols, all blocks side by side;
        a block starts a new phrase.
        """
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // block) for t in texts])
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        pieces = [t[i:i + block] for t in texts for i in range(0, len(t), block)]
        for lo in range(0, len(pieces), _LANES):
            lanes, mine = pieces[lo:lo + _LANES], owner[lo:lo + _LANES]
            lengths = np.array([len(p) for p in lanes])
            order = np.argsort(-lengths, kind="stable")
            grid = np.zeros((int(lengths.max()), len(lanes)), np.uint32)
            for place, lane in enumerate(order):
                grid[:lengths[lane], place] = lanes[lane]
            live = np.searchsorted(-lengths[order], -np.arange(len(grid)), side="left")
            for k, (moves, to_own) in enumerate(zip(self.tables, self.maps)):
                state, ends = np.zeros(len(lanes), np.uint32), np.zeros(len(lanes), np.uint32)
                for row, n in zip(grid, live):
                    step = moves.step(state[:n], to_own.take(row[:n]))
                    ends[:n] += step >> np.uint32(31)
                    state[:n] = step & _STATE
                np.add.at(counts[:, k], mine[order], ends.astype(np.int64) + 1)
        return counts

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text; UNKNOWN and 0 for a text without a letter."""
        codes = [self.encode(t) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        lengths = np.array([max(1, len(c)) for c in codes])
        per = self.phrases(codes) * np.array(self.norms) / lengths[:, None]
        best = per.argmin(axis=1)
        ranked = np.sort(per, axis=1)
        lead = 1 - ranked[:, 0] / ranked[:, 1].clip(1e-12) if len(self.langs) > 1 else np.ones(len(texts))
        named = [bool(c.any()) for c in codes]
        return ([self.langs[b] if ok else UNKNOWN for b, ok in zip(best, named)],
                [float(min(1.0, max(0.0, s))) if ok else 0.0 for s, ok in zip(lead, named)])


@lru_cache(maxsize=2)
def _models(sample: tuple[tuple[str, str], ...]) -> Models:
    return Models(sample)


def predict(docs: DataFrame, sample: list[tuple[str, str]], text: str = "text", label: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """``docs`` without its text, with the predicted language and the score of each whole text.

    ``score`` is 1 - best / second of the normalised phrase counts, and 1 where
    only one language was learned.  Ties go to the first language by name.  A
    null text, and one without a letter, is UNKNOWN with score 0; so is every
    text when the sample is empty.  The models are built once per Python
    worker from the bounded sample.
    """
    known = tuple(sample)
    kept = [c for c in docs.columns if c not in (text, label, score)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text_read"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(known)
        for batch in batches:
            langs, scores = models.judge([t or "" for t in batch.column("_text_read").to_pylist()])
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, label, score]
            )

    schema = rows.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(label), F.lit(0.0).alias(score)).schema
    return rows.mapInArrow(mark, schema)


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language; all columns are kept.

    Trained on the labelled rows of ``docs``; texts that are null or without
    a letter go.  Where nothing is labelled no language can be told, and every
    text with a letter stays.
    """
    sample = training_sample(docs, F.lit(True), text=text, lang=lang)
    if not sample:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return predict(known, sample).filter(F.col("lang_pred") != UNKNOWN).select("row.*")
