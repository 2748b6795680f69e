"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut at blanks into words.  All substrings of the distinct words, up
to the length of the longest piece, are joined with the piece table; the
matches are the edges of each word's lattice, and one fold over them
(``aggregate``) keeps the best path to every place: Viterbi.  Units too rare
to be known to all tasks go through the same lattice in numpy in their task.  A character that
is no piece is an edge of byte pieces, so every text can be encoded, and
decoding gives the text back exactly.  The ids of a text are its words' ids
one after another.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofield.llm.common import shared_table, small

MARK = "▁"  # stands for the blank before a word
BYTE_COST = 10.0
PIECE_COST = 5.0
UNIT_SHARE = 2e-7
MOST = 1 << 20  # units that travel to all tasks; the rest is joined, whatever its frequency
PRIME = (1 << 31) - 1
SPREAD = 4
WINDOW, LONG = 64, 256
CHUNK = 1 << 17  # distinct words held by a task
PART = 1 << 22  # bytes of text that a task cuts at once
CELLS = 1 << 16  # characters of the units that go through the lattice of a task together


@lru_cache(maxsize=2)
def _pieces(model: str) -> tuple[tuple[str, int, float], ...]:
    """(piece, id, score) of the ordinary pieces of a SentencePiece model file.

    The scores of a unigram model are log-probabilities.  Those of a BPE model
    are minus the order of the merges, whole numbers, whose sum would favour many
    early pieces; their order is read as the rank in Zipf's law, and each piece
    costs PIECE_COST more, so that long pieces win as they do in merging.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    odd = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
    found = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not any(f(i) for f in odd)]
    if all(s == int(s) for _, _, s in found):
        rank = {i: n for n, (_, i, _) in enumerate(sorted(found, key=lambda piece: (-piece[2], piece[1])), 2)}
        found = [(p, i, -PIECE_COST - math.log(rank[i])) for p, i, _ in found]
    return tuple(found)


@lru_cache(maxsize=2)
def _adjacent(model: str) -> frozenset[str]:
    """The pairs of neighbouring characters inside pieces; a path never crosses any other pair."""
    return frozenset(p[i - 1:i + 1] for p, _, _ in _pieces(model) for i in range(1, len(p)))


def units_of(word: str, adjacent: frozenset[str]) -> list[str]:
    """A word with its mark, cut where no piece spans; a mark inside the word stands alone.

    The best path of a word is those of its units one after another.
    """
    marked = MARK + word
    cuts = [i for i in range(1, len(marked)) if marked[i - 1:i + 1] not in adjacent or marked[i] == MARK or i > 1 and marked[i - 1] == MARK]
    return [marked[lo:hi] for lo, hi in zip([0, *cuts], [*cuts, len(marked)])]


@lru_cache(maxsize=2)
def _bytes(model: str) -> tuple[int, ...]:
    """The id of each byte piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))


def _floor(model: str) -> float:
    """The score of a character that is written in bytes."""
    return min(s for _, _, s in _pieces(model)) - BYTE_COST


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """(piece, id, score); its size is that of the vocabulary file."""
    return spark.createDataFrame(list(_pieces(model)), "piece string, id int, score double")


def encode_words(words: DataFrame, model: str) -> DataFrame:
    """(word, ids, score) of distinct words: the path of the largest total score, by Viterbi.

    Of equal paths the one whose last piece is longest wins, at every place.
    A mark inside a word is written in bytes, so that only the blank before a
    word is read as a mark.  Repeated words and nulls are dropped.
    """
    rows = words.select("word").filter(F.col("word").isNotNull()).distinct()
    coded = encode_marked(rows.select(F.concat(F.lit(MARK), "word").alias("unit")), model)
    return coded.select(F.expr("substr(unit, 2)").alias("word"), "ids", "score")


def encode_marked(units: DataFrame, model: str, kind: str = "rare") -> DataFrame:
    """(unit, ids, score) of distinct units, whose first character alone may be a mark.

    A unit is named by its text, or by any name with the text in a column ``text``.
    Edges stay where the unit is: the piece table is broadcast, its size being
    that of the vocabulary, and units that are already partitioned by ``unit`` are
    not shuffled.  A unit's edges meet in one row, as its path is one value.
    ``kind`` names the lattice in plans.
    """
    spark = units.sparkSession
    pieces = _pieces(model)
    longest = max(len(p) for p, _, _ in pieces)
    floor = _floor(model)
    w, at = f"_{kind}", F.col("base")
    body = F.coalesce("text", "unit") if "text" in units.columns else F.col("unit")
    marked = units.select("unit", body.alias(w)).withColumn("size", F.char_length(w))
    # A long text is cut in windows first, so that it is not copied once per substring.
    windows = marked.select("unit", w, "size", F.explode(
        F.sequence(F.lit(0), F.floor((F.col("size") - 1) / WINDOW).cast("int"))).alias("nth")
    ).select("unit", (F.col("nth") * WINDOW).alias("base"), F.least(F.lit(WINDOW), F.col("size") - F.col("nth") * WINDOW).alias("n"),
             F.substr(w, F.col("nth") * WINDOW + 1, F.lit(WINDOW + longest - 1)).alias("part_of"))
    starts = windows.select("unit", "base", "part_of", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("start"))
    most = F.least(F.lit(longest), F.char_length("part_of") - F.col("start") + 1)
    parts = starts.select("unit", "base", "part_of", "start", F.explode(F.sequence(F.lit(1), most)).alias("len")).select(
        "unit", (at + F.col("start") + F.col("len") - 1).alias("end"), "len", F.substr("part_of", "start", "len").alias("part")
    )
    inner = F.when(F.col("end") == F.col("len"), F.expr("substr(part, 2)")).otherwise(F.col("part"))
    table = F.broadcast(piece_table(spark, model))
    edges = parts.join(table, F.col("part") == F.col("piece"), "left").withColumn(
        "id", F.when(F.col("id").isNotNull() & ~F.contains(inner, F.lit(MARK)), F.col("id"))
    ).filter((F.col("len") == 1) | F.col("id").isNotNull())
    # A step of the path is a piece id, or minus the code point of a character that is written in bytes.
    edge = F.struct(
        "end", (-F.col("len")).alias("back"), F.when(F.col("id").isNull(), F.lit(floor)).otherwise(F.col("score")).alias("score"),
        F.coalesce("id", -F.ascii("part")).alias("step"),
    )
    lattice = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    # The state: the place reached, its best score and last edge, the best scores of the places
    # before it, nearest first, and the last edges of all places before.  Paths are read once, at the end.
    past = f"slice(concat(array(s.score), s.past), 1, {longest})"
    best = F.expr(f"""aggregate(edges,
        named_struct('at', 0, 'score', 0D, 'len', 0, 'step', 0, 'past', CAST(array() AS ARRAY<DOUBLE>),
                     'done', CAST(array() AS ARRAY<STRUCT<len: INT, step: INT>>)),
        (s, e) -> CASE
            WHEN e.end > s.at AND e.back = -1 THEN named_struct(
                'at', e.end, 'score', s.score + e.score, 'len', 1, 'step', e.step, 'past', {past},
                'done', CASE WHEN s.at = 0 THEN s.done ELSE array_append(s.done, named_struct('len', s.len, 'step', s.step)) END)
            WHEN e.end > s.at THEN named_struct(
                'at', e.end, 'score', s.past[-e.back - 2] + e.score, 'len', -e.back, 'step', e.step, 'past', {past},
                'done', CASE WHEN s.at = 0 THEN s.done ELSE array_append(s.done, named_struct('len', s.len, 'step', s.step)) END)
            WHEN s.past[-e.back - 1] + e.score > s.score THEN named_struct(
                'at', s.at, 'score', s.past[-e.back - 1] + e.score, 'len', -e.back, 'step', e.step, 'past', s.past, 'done', s.done)
            ELSE s END,
        s -> named_struct('score', s.score, 'edges', array_append(s.done, named_struct('len', s.len, 'step', s.step))))""")
    # From the last place back: an edge is on the path where the path has come to its end.
    path = F.expr("""reverse(aggregate(reverse(b.edges),
        named_struct('at', size(b.edges), 'want', size(b.edges), 'path', CAST(array() AS ARRAY<INT>)),
        (t, e) -> CASE WHEN t.at = t.want
            THEN named_struct('at', t.at - 1, 'want', t.want - e.len, 'path', array_append(t.path, e.step))
            ELSE named_struct('at', t.at - 1, 'want', t.want, 'path', t.path) END,
        t -> t.path))""")
    octets = F.array(*[F.lit(i) for i in _bytes(model)])

    def written(step: Column) -> Column:
        """The byte pieces of a character's UTF-8."""
        c = -step

        def tail(shift: int) -> Column:
            return F.shiftright(c, shift).bitwiseAND(F.lit(63)) + 128

        octet = F.when(c < 0x80, F.array(c)).when(c < 0x800, F.array(F.shiftright(c, 6) + 192, tail(0))).when(
            c < 0x10000, F.array(F.shiftright(c, 12) + 224, tail(6), tail(0))
        ).otherwise(F.array(F.shiftright(c, 18) + 240, tail(12), tail(6), tail(0)))
        return F.transform(octet, lambda b: F.get(octets, b))

    found = lattice.select("unit", best.alias("b")).select("unit", "b.score", path.alias("path"))
    # No ordinary piece has the id 0, which is the unknown piece.
    ids = F.flatten(F.transform("path", lambda x: F.when(x > 0, F.array(x)).otherwise(written(x))))
    return found.select("unit", ids.alias("ids"), "score")


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the piece ids of each row's text; a null or empty text has none.  Keys may repeat or be null."""
    return encodings(docs, model, key, text).select(key, "ids")


def decode(coded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of ``key`` and ``ids``, row by row: the texts that ``encode`` came from."""
    return with_text(coded, model).select(key, "text")


def with_text(coded: DataFrame, model: str) -> DataFrame:
    """The rows of ``coded``, with the text that their ``ids`` stand for."""
    table = {i: p.replace(MARK, " ").encode() for p, i, _ in _pieces(model)}
    table |= {i: bytes([b]) for b, i in enumerate(_bytes(model))}
    sent = coded.sparkSession.sparkContext.broadcast([table.get(i) for i in range(1 + max(table))])
    names = coded.columns
    at = names.index("ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets = pa.array(sent.value, pa.large_binary())
        for batch in batches:
            taken = pc.take(octets, batch.column(at).flatten())
            if taken.null_count:
                raise ValueError("ids that stand for no text")
            ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()])
            places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset + ends]
            # The first octet is the blank before the first word.
            data, full = taken.buffers()[2], places[1:] > places[:-1]
            data = np.delete(np.frombuffer(data or b"", np.uint8), places[:-1][full])
            places = places - np.append(0, np.cumsum(full))
            whole = pa.Array.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(places), pa.py_buffer(data)])
            try:
                texts = whole.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:  # ids from elsewhere need not end at whole characters
                texts = pa.array([b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, "text"])

    return coded.mapInArrow(read, coded.withColumn("text", F.lit("")).schema)


def _name(unit: str) -> str:
    """A unit itself, or two marks and a digest for one of more than LONG characters; no unit has two marks."""
    return unit if len(unit) <= LONG else MARK * 2 + hashlib.sha256(unit.encode()).hexdigest()


@lru_cache(maxsize=2)
def _prefixes(model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of the pieces' prefixes: sorted (node, next character), where each leads, and the nodes' ids and scores."""
    nodes = {"": 0}
    for p, _, _ in _pieces(model):
        for i in range(1, len(p) + 1):
            nodes.setdefault(p[:i], len(nodes))
    ids, scores = np.zeros(len(nodes), np.int64), np.full(len(nodes), -np.inf)
    for p, i, score in _pieces(model):
        ids[nodes[p]], scores[nodes[p]] = i, score
    steps = np.array([nodes[p[:-1]] << 21 | ord(p[-1]) for p in nodes if p], np.int64)
    order = np.argsort(steps)
    return steps[order], order + 1, ids, scores


def unit_paths(units: list[str], model: str) -> list[bytes]:
    """The packed ids of units, whose first character alone may be a mark: the paths of ``encode_marked``, in this task."""
    found = [b""] * len(units)
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(units[order[hi]]) <= CELLS:
            hi += 1
        for i, ids in zip(order[lo:hi], _paths([units[i] for i in order[lo:hi]], model)):
            found[i] = ids
        lo = hi
    return found


def _paths(units: list[str], model: str) -> list[bytes]:
    """``unit_paths`` of units of about one length, all of them one place further at a time."""
    steps, to, piece, score = _prefixes(model)
    longest, floor = max(len(p) for p, _, _ in _pieces(model)), _floor(model)
    sizes, every = np.array([len(u) for u in units]), np.arange(len(units))
    most = int(sizes.max())
    unit = np.repeat(every, sizes)
    start = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = np.zeros((most, len(units)), np.int64)
    letters[start, unit] = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    # edges[end, longest - size, unit]: the node of the piece of that size that ends there; 0 is none.
    edges = np.zeros((most + 1, longest, len(units)), np.int32)
    node = np.zeros(len(unit), np.int64)
    for size in range(1, longest + 1):
        inside = start + size <= sizes[unit]
        start, unit, node = start[inside], unit[inside], node[inside]
        step = node << 21 | letters[start + size - 1, unit]
        at = np.minimum(np.searchsorted(steps, step), len(steps) - 1)
        met = steps[at] == step
        start, unit, node = start[met], unit[met], to[at[met]]
        edges[start + size, longest - size, unit] = node
    # The scores of the places lie behind those of longest - 1 places before the first.
    best = np.full((most + longest, len(units)), -np.inf)
    best[longest - 1] = 0.0
    back = np.zeros((most + 1, len(units)), np.int16)
    for end in range(1, most + 1):
        scores = score[edges[end]]
        scores[-1] = np.where(scores[-1] == -np.inf, floor, scores[-1])
        scores += best[end - 1:end - 1 + longest]
        back[end] = scores.argmax(axis=0)  # of equal ones the first: the longest piece
        best[end + longest - 1] = scores[back[end], every]
    # From the last places back; a character that is no piece is written in bytes, and met as minus its code point.
    place, live, owners, met = sizes.copy(), every, [], []
    while len(live):
        end, kind = place[live], back[place[live], live]
        ids = piece[edges[end, kind, live]]
        owners.append(live)
        met.append(np.where(ids > 0, ids, -letters[end - 1, live]))
        place[live] -= longest - kind
        live = live[place[live] > 0]
    owner, step = np.concatenate(owners)[::-1], np.concatenate(met)[::-1]
    order = np.argsort(owner, kind="stable")
    owner, step = owner[order], step[order]
    width = np.where(step > 0, 1, 1 + (step <= -0x80) + (step <= -0x800) + (step <= -0x10000))
    left = np.repeat(np.cumsum(width), width) - 1 - np.arange(width.sum())
    whole, width_of = np.repeat(step, width), np.repeat(width, width)
    first = left == width_of - 1
    octet = np.abs(whole) >> 6 * left
    octet = np.where(first, octet | np.array([0, 0, 0xC0, 0xE0, 0xF0])[width_of], octet & 63 | 128)
    ids = np.where(whole > 0, whole, np.array(_bytes(model))[octet & 255]).astype(np.int32)
    ends = np.cumsum(np.bincount(owner, width, len(units)).astype(np.int64)) * 4
    packed = ids.tobytes()
    return [packed[lo:hi] for lo, hi in zip([0, *ends], ends)]


class _Coded:
    """Ids, sums and hashes of words, as arrays that grow with the words asked for."""

    def __init__(self, known: dict[str, bytes], adjacent: frozenset[str], mark: bytes, scores: np.ndarray, model: str) -> None:
        self.known, self.adjacent, self.mark, self.scores, self.model = known, adjacent, mark, scores, model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = self.sizes = self.hashes = np.zeros(0, np.int64)
        self.totals = np.zeros(0)

    def add(self, words: list[str]) -> None:
        """Enter words that are not there yet; their units that not all tasks know go through the lattice here."""
        known, mark, parts, sizes = self.known, self.mark, [], []
        cut = [units_of(word, self.adjacent) for word in words]
        new = list({u: None for units in cut for i, u in enumerate(units) if u not in known and not (i and u == MARK)})
        rare = dict(zip(new, unit_paths(new, self.model)))
        for word, units in zip(words, cut):
            if len(units) == 1:
                ids = known.get(units[0]) or rare[units[0]]
            else:
                ids = b"".join([mark if i and u == MARK else known.get(u) or rare[u] for i, u in enumerate(units)])
            self.at[word] = len(self.at)
            parts.append(ids)
            sizes.append(len(ids) >> 2)
        flat, sizes = np.frombuffer(b"".join(parts), np.int32), np.array(sizes, np.int64)
        ends = np.cumsum(sizes)
        sums = np.append(0.0, np.cumsum(self.scores[flat]))
        self.starts = np.concatenate([self.starts, ends - sizes + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.totals = np.concatenate([self.totals, sums[ends] - sums[ends - sizes]])
        self.hashes = np.concatenate([self.hashes, _array_hashes(flat, sizes)])

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids of words one after another."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[places] - ends + sizes, sizes)
        return self.flat[index]


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and the words of all one after another; a null or empty text has none."""
    cut = pc.split_pattern(texts, " ")
    n_words = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0
    return n_words * full, pc.list_flatten(cut).filter(pa.array(np.repeat(full, n_words)))


def frequent_units(docs: DataFrame, model: str, text: str, share: float) -> DataFrame:
    """(unit, n): the units that make up at least ``share`` of all, at most MOST of them, the most frequent.

    A task counts its texts in chunks and passes on what reaches the share
    within the chunk and came up twice.  What is left out is below twice
    ``share``, and once per chunk.
    """
    adjacent = docs.sparkSession.sparkContext.broadcast(_adjacent(model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            units: Counter[str] = Counter()
            for word, n in words.items():
                for i, unit in enumerate(units_of(word, adjacent.value)):
                    if not i or unit != MARK:  # a mark inside a word is always written in bytes
                        units[unit] += n
            total = units.total()
            least = max(2, share * total)
            found = {u: n for u, n in units.items() if n >= least}
            return pa.RecordBatch.from_arrays(
                [pa.array([*found, None], pa.string()), pa.array([*found.values(), total], pa.int64())], ["unit", "n"]
            )

        for batch in batches:
            for part in small(batch, 0, PART):
                counted = pc.value_counts(_words(part.column(0))[1])
                for word, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                    words[word] += n
                if len(words) > CHUNK:
                    yield passed()
                    words.clear()
        yield passed()

    counted = shared_table(
        docs.select(F.col(text)).mapInArrow(count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")), "units"
    )
    every = counted.filter(F.col("unit").isNull()).select("n").scalar()
    return counted.filter(F.col("unit").isNotNull() & (F.col("n") >= F.lit(share) * every)).orderBy(F.desc("n"), "unit").limit(MOST)


def _array_hashes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of arrays of ints, modulo PRIME, for many arrays that lie one after another."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    starts = (np.cumsum(sizes) - sizes)[order]
    numbers = flat.astype(np.uint32).astype(np.uint64)
    state = np.full(len(sizes), 42, np.uint64)
    for k in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-falling, -k))  # the arrays with more than k numbers
        h = state[:n] + p5 + np.uint64(4)
        h ^= numbers[starts[:n] + k] * p1
        h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        state[:n] = h ^ h >> np.uint64(32)
    out = np.empty(len(sizes), np.int64)
    out[order] = state.view(np.int64) % PRIME
    return out


def encodings(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
              word_share: float = UNIT_SHARE) -> DataFrame:
    """key, n_words, n_pieces, score, digest and ids: the encoding of each whole text.

    ``digest`` is the sum over the words, modulo PRIME, of (2 place + 1) times
    the xxhash64 of the word's ids, so it depends on the ids and their order.

    Words are cut into units where no piece spans.  The units of at least
    ``word_share`` of all go through the lattice once and travel to all tasks; a
    task takes the others through the same lattice, once per batch of texts.
    No text is shuffled.
    """
    spark = docs.sparkSession
    spread = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = frequent_units(docs, model, text, word_share).select(F.col("unit").alias("text"))
    named = often.withColumn("unit", F.when(F.char_length("text") <= LONG, F.col("text")).otherwise(
        F.concat(F.lit(MARK * 2), F.sha2("text", 256))))
    head = encode_marked(named.repartition(spread, "unit"), model, "frequent").select("unit", "ids").toArrow()
    coded_head = {u: _packed(ids) for u, ids in zip(head.column("unit").to_pylist(), head.column("ids").to_pylist())}
    sent = spark.sparkContext.broadcast((
        _adjacent(model), {u: coded_head[_name(u)] for u in often.toArrow().column("text").to_pylist()}
    ))
    scores = np.zeros(1 + max(i for _, i, _ in _pieces(model)))
    octets = _bytes(model)
    # A character written in bytes counts once, at its first byte.
    scores[[i for b, i in enumerate(octets) if b & 0xC0 != 0x80]] = _floor(model)
    scores[[i for _, i, _ in _pieces(model)]] = [s for _, _, s in _pieces(model)]
    mark = _packed([octets[b] for b in MARK.encode()])
    named_docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = named_docs.schema["key"].dataType
    final = T.StructType([
        T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_pieces")),
        T.StructField("score", T.DoubleType()), T.StructField("digest", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adjacent, known = sent.value
        coded = _Coded(known, adjacent, mark, scores, model)
        for batch in batches:
            for part in small(batch, 1, PART):
                n_words, words = _words(part.column(1))
                words = words.dictionary_encode()
                distinct = words.dictionary.to_pylist()
                if len(coded.at) > CHUNK:
                    coded.clear()
                coded.add([w for w in distinct if w not in coded.at])
                at = np.fromiter(map(coded.at.__getitem__, distinct), np.int64, len(distinct))
                places = at[words.indices.to_numpy()]
                ends = np.cumsum(n_words)
                nth = np.arange(len(places)) - np.repeat(ends - n_words, n_words)
                terms = (2 * nth + 1) % PRIME * coded.hashes[places] % PRIME

                def per_text(values: np.ndarray) -> np.ndarray:
                    sums = np.append(values.dtype.type(0), np.cumsum(values))
                    return sums[ends] - sums[ends - n_words]

                n_pieces = per_text(coded.sizes[places])
                edges = np.append(0, np.cumsum(n_pieces)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n_words), pa.array(n_pieces),
                    pa.array(per_text(coded.totals[places])), pa.array(per_text(terms) % PRIME),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(coded.ids(places))),
                ], final.names)

    return named_docs.mapInArrow(code, final)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()
