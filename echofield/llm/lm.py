"""Scoring text with a probabilistic suffix tree.

Symbols are the UTF-8 bytes of a text whose words are joined by single blanks
and closed by a line end, so the probability of the symbols is that of the
sequence of words and its end.  A context of up to DEPTH symbols becomes a
state of the tree when it is frequent enough and its next-symbol distribution
diverges from that of its parent, the context without its oldest symbol.  Each
state's distribution is smoothed with its parent's.  A symbol is scored by the
longest suffix of what came before that is a state.

A unigram base score over words goes along.  Counts cover the whole training
part; only the states (at most DEPTH / SHARE) and the frequent words (at most
1 / WORD_SHARE) travel to every executor, all other words are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield.llm.common import binary_texts, shared_table, small

DEPTH = 6
SHARE = 3e-6
DIVERGENCE = 0.02
WORD_SHARE = 1e-6
LANE = 512
_PAD = b"\0" * (DEPTH - 1) + b"\n"
_CHUNK = 1 << 21
_GRAMS = 1 << 21
_WORDS = 400_000
_LANES = 1 << 14


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: split at ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def symbols_of(words: list[bytes]) -> bytes:
    """The symbols of a document after its start mark; byte 0 is kept for the mark."""
    return _PAD + b" ".join(words).replace(b"\0", b"\1") + b"\n"


def grams_of(symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, next) windows of joined documents and their counts."""
    flat = np.frombuffer(symbols, np.uint8)
    n = len(flat) - DEPTH
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for i in range(DEPTH + 1):
        packed = (packed << np.uint64(8)) | flat[i:i + n]
    last, before = flat[DEPTH:], flat[DEPTH - 1:-1]
    return np.unique(packed[(last != 0) & ((last != 10) | (before != 0))], return_counts=True)


def count_training(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, gram, n): how often each word and each packed window of symbols occurs.

    One of ``word`` and ``gram`` is null.  The end of a document is the empty
    word.  Tasks count before anything is shuffled.  The table is written to
    the shared folder.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in small(batch, 0):
                held = bytearray()
                for body in binary_texts(part.column(0)):
                    found = words_of(body)
                    words.update(found)
                    words[b""] += 1
                    held += symbols_of(found)
                for lo in range(0, len(held), _CHUNK):
                    # Windows that span two chunks belong to the first.
                    keys, counts = _merged(keys, counts, *grams_of(bytes(held[lo:lo + _CHUNK + DEPTH])))
                if len(words) > _WORDS:
                    yield from _rows(list(words), None, np.fromiter(words.values(), np.int64, len(words)))
                    words = Counter()
                if len(keys) > _GRAMS:
                    yield from _rows(None, keys.view(np.int64), counts)
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from _rows(None, keys.view(np.int64), counts)
        yield from _rows(list(words), None, np.fromiter(words.values(), np.int64, len(words)))

    partial = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, gram bigint, n bigint")
    return shared_table(partial.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")


def _merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add the counts ``n`` of the sorted keys ``more`` to those of the sorted ``keys``."""
    every, totals = np.concatenate([keys, more]), np.concatenate([counts, n])
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[starts], np.add.reduceat(totals[order], starts) if len(starts) else totals


def _rows(words: list[bytes] | None, grams: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(n), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        size = len(n[part])
        yield pa.RecordBatch.from_arrays([
            pa.nulls(size, pa.binary()) if words is None else pa.array(words[part], pa.binary()),
            pa.nulls(size, pa.int64()) if grams is None else pa.array(grams[part]),
            pa.array(n[part]),
        ], ["word", "gram", "n"])


def _tail(context: Column, k: Column) -> Column:
    """The last ``k`` symbols of a packed context."""
    masks = F.array(*[F.lit((1 << 8 * i) - 1).cast("long") for i in range(DEPTH + 1)])
    return context.bitwiseAND(masks[k])


def suffix_states(counts: DataFrame, share: float = SHARE, divergence: float = DIVERGENCE) -> DataFrame:
    """(k, context, symbol, n): next-symbol counts of the contexts that are kept, with all their suffixes.

    A context of k symbols is kept when it makes up ``share`` of all positions
    and its next-symbol distribution has a Kullback-Leibler divergence of
    ``divergence`` (natural log) or more from its parent's.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("k")
    level = counts.filter(F.col("gram").isNotNull()).select("gram", "n", k).select(
        "k", _tail(F.shiftright("gram", 8), F.col("k")).alias("context"),
        F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n",
    ).groupBy("k", "context", "symbol").agg(F.sum("n").alias("n"))
    level = shared_table(level, "levels")
    sizes = level.groupBy("k", "context").agg(F.sum("n").alias("total"))
    everything = level.filter("k = 0").agg(F.sum("n").alias("all"))
    positions = everything.first()["all"] or 0
    frequent = shared_table(sizes.filter(F.col("total") >= share * positions), "frequent")
    rows = level.join(frequent, ["k", "context"])
    parent = rows.select(
        (F.col("k") + 1).alias("k"), F.col("context").alias("parent"), "symbol",
        F.col("n").alias("parent_n"), F.col("total").alias("parent_total"),
    )
    share_of = F.col("n") / F.col("total")
    kept = (
        rows.filter("k > 0").withColumn("parent", _tail(F.col("context"), F.col("k") - 1))
        .join(parent, ["k", "parent", "symbol"])
        .groupBy("k", "context")
        .agg(F.sum(share_of * F.ln(share_of / (F.col("parent_n") / F.col("parent_total")))).alias("kl"))
        .filter(F.col("kl") >= divergence)
    )
    with_suffixes = kept.select(F.explode(F.sequence(F.lit(0), F.col("k"))).alias("k"), "context").select(
        "k", _tail(F.col("context"), F.col("k")).alias("context")
    ).union(sizes.filter("k = 0").select("k", "context")).distinct()
    return level.join(with_suffixes, ["k", "context"])


class SuffixTree:
    """The states as one automaton: ``step`` gives the next state, ``logp`` the log10 probability.

    Prefixes of states are added, so that following one symbol at a time always
    leads to the longest suffix among the states; such a prefix takes over the
    distribution of its own longest suffix.
    """

    def __init__(self, k: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        levels = [set() for _ in range(DEPTH + 1)]
        levels[0].add(0)
        for depth in range(1, DEPTH + 1):
            for c in np.unique(context[k == depth]).tolist():
                for cut in range(depth):
                    levels[depth - cut].add(c >> 8 * cut)
        keys = [np.array(sorted(level), np.int64) for level in levels]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
        seen = np.union1d(np.unique(symbol), np.unique(np.concatenate([x & 255 for x in keys[1:]]))).astype(np.int64)
        self.classes = np.zeros(256, np.uint8 if len(seen) < 255 else np.uint16)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.size = len(seen) + 1
        self.step = np.zeros((int(starts[-1]), self.size), np.int32)
        p = np.zeros((int(starts[-1]), self.size))
        for depth, key in enumerate(keys):
            own = np.arange(starts[depth], starts[depth + 1])
            if depth:
                shorter = keys[depth - 1]
                fail = starts[depth - 1] + np.searchsorted(shorter, key & ((1 << 8 * (depth - 1)) - 1))
                before = starts[depth - 1] + np.searchsorted(shorter, key >> 8)
                # The level above is complete once it points here, and this level starts from its moves.
                self.step[before, self.classes[key & 255]] = own
                self.step[own] = self.step[fail]
                p[own] = p[fail]
            else:
                p[0] = 1 / 256
            at = k == depth
            state = starts[depth] + np.searchsorted(key, context[at])
            counts = np.zeros((len(key), self.size))
            np.add.at(counts, (state - starts[depth], self.classes[symbol[at]]), n[at])
            total, kinds = counts.sum(axis=1), (counts > 0).sum(axis=1)
            held = total > 0
            p[own[held]] = ((counts[held] + kinds[held, None] * p[own[held]]) /
                            (total[held] + kinds[held])[:, None])
        self.logp = np.log10(p).astype(np.float32).reshape(-1)
        self.step = self.step.reshape(-1)

    def score(self, documents: list[bytes]) -> np.ndarray:
        """log10 probability of the symbols of each document after its start mark.

        A state depends on the last DEPTH symbols alone, so a document is cut
        into lanes that warm up on the DEPTH symbols before them, and all lanes
        of a batch advance together.
        """
        out = np.zeros(len(documents))
        if not documents:
            return out
        flat = self.classes[np.frombuffer(b"".join(documents), np.uint8)]
        sizes = np.array([len(d) for d in documents])
        origin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        lanes = -(-(sizes - DEPTH) // LANE)
        owner = np.repeat(np.arange(len(documents)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = origin[owner] + nth * LANE
        length = np.minimum(LANE + DEPTH, sizes[owner] - nth * LANE)
        order = np.argsort(-length, kind="stable")
        for lo in range(0, len(order), _LANES):
            mine = order[lo:lo + _LANES]
            at, ends = begin[mine], length[mine]
            state, total = np.zeros(len(mine), np.int32), np.zeros(len(mine))
            live = np.searchsorted(-ends, -np.arange(int(ends[0])), side="left")
            for t, m in enumerate(live):
                place = state[:m] * np.int32(self.size) + flat[at[:m] + t]
                if t >= DEPTH:
                    total[:m] += self.logp[place]
                state[:m] = self.step[place]
            np.add.at(out, owner[mine], total)
        return out


def score_texts(docs: DataFrame, counts: DataFrame, key: str = "doc_id", text: str = "text",
                word_share: float = WORD_SHARE, **tree) -> DataFrame:
    """``key``, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    ``counts`` comes from ``count_training``.  A null or empty text is the end
    token alone.  Rows that agree in everything are scored one by one.
    """
    spark = docs.sparkSession
    words = counts.filter(F.col("word").isNotNull()).select("word", F.col("n").alias("c"))
    size = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, floor = size["n"] or 0, math.log10((size["n"] or 0) + (size["v"] + 1))
    head = words.filter(F.col("c") >= word_share * tokens).toArrow()
    frequent = dict(zip(head.column("word").to_pylist(), np.log10(head.column("c").to_numpy() + 1.0).tolist()))
    rows = suffix_states(counts, **tree).select("k", "context", "symbol", "n").toArrow()
    model = SuffixTree(*[rows.column(c).to_numpy() for c in ("k", "context", "symbol", "n")])
    sent = spark.sparkContext.broadcast((frequent, model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tree_ = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in small(batch, 1):
                bodies = [words_of(b) for b in binary_texts(part.column(1))]
                scores = tree_.score([symbols_of(b) for b in bodies])
                n_tokens, n_known, base, rare, times = [], [], [], [], []
                for body in bodies:
                    counted = Counter(body)
                    counted[b""] = 1
                    here, hits, odd = 0.0, 0, []
                    for word, n in counted.items():
                        value = known.get(word)
                        if value is None:
                            odd.append(word)
                        else:
                            hits += n
                            here += n * value
                    n_tokens.append(len(body) + 1)
                    n_known.append(hits)
                    base.append(here - floor * (len(body) + 1))
                    rare.append(odd)
                    times.append([counted[w] for w in odd])
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + len(bodies)), pa.int64()), part.column(0),
                    pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.binary())),
                    pa.array(times, pa.list_(pa.int64())),
                ], names)
                row += len(bodies)

    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    names = ["row", "key", "n_tokens", "n_known", "base", "score", "rare", "times"]
    kind = slim.schema["_key"].dataType.simpleString()
    schema = f"row bigint, key {kind}, n_tokens bigint, n_known bigint, base double, score double, " \
        "rare array<binary>, times array<bigint>"
    scored = shared_table(slim.mapInArrow(judge, schema), "scored")
    mentions = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("m")).select(
        "row", F.col("m.rare").alias("word"), F.col("m.times").alias("n")
    )
    seldom = words.filter(F.col("c") < word_share * tokens)
    rest = mentions.join(seldom, "word").groupBy("row").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("add")
    )
    return scored.drop("rare", "times").join(rest, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"), "score",
    )
