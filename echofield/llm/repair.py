"""Repair of damaged conversations by the cheapest audited edits.

The turns of a conversation are kept (K, free), given the role user or assistant
(R, 2) or deleted (D, 3); empty turns are inserted (I, 2).  A blank turn or one
whose role and text were seen earlier has to go; a turn that stays but ends
without a full stop, exclamation or question mark costs 1 more.  The initials
of the roles that remain must read ``(s?(ua)+)?``.  Among the cheapest edits
those whose initials are least as text win.

The dynamic program holds one edit text per state of that pattern.  Texts are
persistent: a longer one is a node that points at the text it extends, with
ancestors at powers of two and a rolling hash, so states share their prefixes
and a tie is settled by a search for the longest common prefix instead of by
comparing texts.  A prefix that the hashes call common is verified.

A conversation may hold any share of the rows.  Rows are ordered by ranges, and
what one range holds of a conversation is a block, worked on alone: its result
is the best text from every state to every state.  Blocks are then joined by
the same program with whole block texts as labels.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield.llm.common import shared_table

MODULUS = (1 << 61) - 1
BASE = 1_000_003
ASCII_SPACE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, DONE = range(4)  # what the kept roles end in; NOTHING and DONE may end a conversation
LEGAL = {"su", "ua", "au"}
PLACES = 33  # a row's place is its range, then its number in the range, in so many bits

PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
EDIT = pa.struct([("edit", pa.string()), ("role", pa.string())])
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
BLOCK_SCHEMA = (
    "conv_id bigint, first bigint, kinds string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "paths array<struct<start int, end int, cost bigint, audit string>>"
)
CHOSEN_SCHEMA = (
    "conv_id bigint, first bigint, kinds string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "state int, cost bigint, audit string"
)
EDIT_SCHEMA = "place bigint, edits array<struct<edit string, role string>>"


class Audit:
    """A text of edit initials that extends another by a label of one or more letters."""

    __slots__ = ("up", "label", "length", "value", "mark")

    def __init__(self, parent: Audit | None = None, label: str = "", mark: int = NOTHING) -> None:
        self.label, self.mark = label, mark
        if parent is None:
            self.up, self.length, self.value = [], 0, 0
            return
        self.up = [parent]
        while len(self.up[-1].up) >= len(self.up):
            self.up.append(self.up[-1].up[len(self.up) - 1])
        self.length = parent.length + len(label)
        self.value = _rolled(parent.value, label)

    def covering(self, size: int) -> Audit:
        """The shortest text on the way to this one that has at least ``size`` letters."""
        at = self
        for k in range(len(self.up) - 1, -1, -1):
            if k < len(at.up) and at.up[k].length >= size:
                at = at.up[k]
        return at

    def prefix_value(self, size: int) -> int:
        """The rolling hash of the first ``size`` letters."""
        at = self.covering(size)
        return at.value if at.length == size else _rolled(at.up[0].value, at.label[:size - at.up[0].length])

    def letter(self, i: int) -> str:
        at = self.covering(i + 1)
        return at.label[i - at.up[0].length]

    def chain(self) -> list[Audit]:
        """All texts from the first extension to this one."""
        nodes, at = [], self
        while at.up:
            nodes.append(at)
            at = at.up[0]
        return nodes[::-1]

    def text(self) -> str:
        return "".join(node.label for node in self.chain())


def _rolled(value: int, label: str) -> int:
    for letter in label:
        value = (value * BASE + ord(letter)) % MODULUS
    return value


def common_prefix(a: Audit, b: Audit) -> int:
    """Letters that two texts share from the start."""
    low, high = 0, min(a.length, b.length)
    if a.prefix_value(high) == b.prefix_value(high):
        low = high
    while high - low > 1:
        middle = (low + high) // 2
        if a.prefix_value(middle) == b.prefix_value(middle):
            low = middle
        else:
            high = middle
    # Equal hashes prove nothing by themselves; a shared node does, else the letters are read.
    if a.covering(low) is not b.covering(low):
        one, two = a.text(), b.text()
        if one[:low] != two[:low]:
            return len(os.path.commonprefix([one, two]))
    return low


def comes_first(a: Audit, b: Audit) -> bool:
    n = common_prefix(a, b)
    if n == min(a.length, b.length):
        return a.length < b.length
    return a.letter(n) < b.letter(n)


Tips = list[tuple[int, Audit] | None]


def _offer(tips: Tips, state: int, cost: int, parent: Audit, label: str, mark: int = NOTHING) -> None:
    held = tips[state]
    if held is not None and held[0] < cost:
        return
    node = Audit(parent, label, mark)
    if held is None or cost < held[0] or comes_first(node, held[1]):
        tips[state] = cost, node


def _insert(tips: Tips) -> None:
    """Offer empty turns: a user where one may follow, then an assistant."""
    for state in (NOTHING, SYSTEM, DONE):
        if tips[state]:
            _offer(tips, USER, tips[state][0] + 2, tips[state][1], "I")
    if tips[USER]:
        _offer(tips, DONE, tips[USER][0] + 2, tips[USER][1], "I")


def after_row(tips: Tips, kind: str, must_go: bool, truncated: bool) -> Tips:
    """The best text per state after one more turn, whose role starts with ``kind``."""
    _insert(tips)
    new: Tips = [None] * 4
    for state, tip in enumerate(tips):
        if tip is None:
            continue
        cost, node = tip
        _offer(new, state, cost + 3, node, "D")
        if must_go:
            continue
        cost += truncated
        follows, wanted = (DONE, "a") if state == USER else (USER, "u")
        if kind == wanted:
            _offer(new, follows, cost, node, "K")
        else:
            _offer(new, follows, cost + 2, node, "R")
        if kind == "s" and state == NOTHING:
            _offer(new, SYSTEM, cost, node, "K")
    return new


def _groups(batches: Iterator[pa.RecordBatch], key) -> Iterator[list[dict]]:
    """Consecutive rows of one key, across batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and key(row) != key(held[0]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _flush(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _emit(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield _flush(out, fields)
            out = []
    yield _flush(out, fields)


_HEAD = [("conv_id", pa.int64()), ("first", pa.int64()), ("kinds", pa.string()), *((c, pa.int64()) for c in COUNTS)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation and range: its counts and its best texts from state to state."""
    def results() -> Iterator[tuple]:
        key, tables, kinds, counts, first = None, [], [], dict.fromkeys(COUNTS, 0), 0

        def done() -> tuple:
            paths = [
                {"start": start, "end": end, "cost": tip[0], "audit": tip[1].text()}
                for start, tips in tables for end, tip in enumerate(tips) if tip
            ]
            return key[0], first, "".join(kinds), *counts.values(), paths

        for batch in batches:
            for conv, place, kind, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (conv, place >> PLACES):
                    if key:
                        yield done()
                    key, kinds, counts, first = (conv, place >> PLACES), [], dict.fromkeys(COUNTS, 0), place
                    # Only the first conversation of a range may have begun in an earlier one.
                    starts = range(4) if place >> PLACES and not place & ((1 << PLACES) - 1) else [NOTHING]
                    tables = [(s, [(0, Audit()) if s == t else None for t in range(4)]) for s in starts]
                if kinds and kinds[-1] + kind not in LEGAL:
                    counts["illegal"] += 1
                kinds.append(kind)
                if fault:
                    counts[fault] += 1
                tables = [
                    (s, after_row(tips, kind, fault in ("blank", "duplicate"), fault == "truncated")) for s, tips in tables
                ]
        if key:
            yield done()

    yield from _emit(results(), [*_HEAD, ("paths", pa.list_(PATH))])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each conversation with the texts that are cheapest together."""
    def results() -> Iterator[tuple]:
        for blocks in _groups(batches, lambda row: row["conv_id"]):
            tips: Tips = [(0, Audit()), None, None, None]
            for block in blocks:
                new: Tips = [None] * 4
                for path in block["paths"]:
                    if tip := tips[path["start"]]:
                        _offer(new, path["end"], tip[0] + path["cost"], tip[1], path["audit"], path["start"])
                tips = new
            _insert(tips)
            best: Tips = [tips[DONE]]
            if tips[NOTHING]:
                cost, node = tips[NOTHING]
                if best[0] is None or cost < best[0][0] or cost == best[0][0] and comes_first(node, best[0][1]):
                    best = [tips[NOTHING]]
            cost, node = best[0]
            nodes = node.chain()
            tail = "".join(n.label for n in nodes[len(blocks):])
            before = ""
            for i, (block, part) in enumerate(zip(blocks, nodes)):
                last = i + 1 == len(blocks)
                broken = bool(before) and before + block["kinds"][0] not in LEGAL
                before = block["kinds"][-1]
                yield (
                    block["conv_id"], block["first"], block["kinds"], block["blank"], block["duplicate"], block["truncated"],
                    block["illegal"] + broken, part.mark, cost if last else 0, part.label + (tail if last else ""),
                )

    yield from _emit(results(), [*_HEAD, ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, edits) per turn: insertions before it, its own edit, and after the last turn those at the end."""
    def results() -> Iterator[tuple]:
        for batch in batches:
            for first, kinds, state, audit in zip(*(c.to_pylist() for c in batch.columns)):
                row, edits, waiting = -1, [], []
                for edit in audit:
                    role = ("assistant" if state == USER else "user") if edit in "IR" else None
                    if edit == "I":
                        waiting.append({"edit": edit, "role": role})
                    else:
                        if row >= 0:
                            yield first + row, edits
                        row += 1
                        edits, waiting = [*waiting, {"edit": edit, "role": role}], []
                    if edit == "K" and kinds[row] == "s":
                        state = SYSTEM
                    elif edit != "D":
                        state = DONE if state == USER else USER
                yield first + row, edits + waiting

    yield from _emit(results(), [("place", pa.int64()), ("edits", pa.list_(EDIT))])


def ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns with their place in the order of conversation, turn (null first), role and text; written once."""
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    blank = F.lit(" ")
    kept = rows.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"),
    ).withColumn("digest", digest)
    by = ["conv_id", "turn", "role", "digest"]
    placed = kept.repartitionByRange(*by).sortWithinPartitions(*by)
    return shared_table(placed.withColumn("place", F.monotonically_increasing_id()), "turns")


def _fault(seen: Column) -> Column:
    rest = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    return F.when(rest == "", "blank").when(seen, "duplicate").when(~F.right(rest, F.lit(1)).rlike("[.!?]"), "truncated")


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of a table of turns.

    The report has one row per conversation: conv_id, gaps in the turn numbers,
    the faults (each turn's first of blank, duplicate, truncated), illegal
    neighbours, cost and the audit text.  The repaired table has a row per turn
    that remains: conv_id, place, at (order them by these two), edit, role, text.

    Turns are taken by number, null first, then role and a digest of role and
    text; repeated rows are turns of their own.  A null role or text counts as
    one space, a null conv_id is a conversation.  Other columns are left out.
    An empty table gives two empty tables.

    One task holds the turns of one range of rows, as letters; texts only pass through
    joins.  What a conversation has in all ranges meets as one letter per turn,
    since its audit is one value.
    """
    placed = ordered(rows, conv, turn, role, text)
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("_new"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    letters = placed.join(firsts, "place", "left").select(
        "conv_id", "place", kind.alias("kind"), _fault(F.col("_new").isNull()).alias("fault")
    )
    block = F.shiftright("place", PLACES)
    blocks = letters.repartition(F.col("conv_id"), block).sortWithinPartitions("conv_id", "place").mapInArrow(
        _blocks, BLOCK_SCHEMA)
    chosen = shared_table(
        blocks.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(_chosen, CHOSEN_SCHEMA), "audits"
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = placed.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("first", "audit"))), lambda s: s["audit"])
    audits = chosen.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in (*COUNTS, "cost")], F.array_join(parts, "").alias("audit")
    )
    report = gaps.join(audits.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    edits = chosen.select("first", "kinds", "state", "audit").mapInArrow(_edits, EDIT_SCHEMA)
    each = placed.join(edits, "place").select(
        "conv_id", "place", F.posexplode("edits").alias("at", "_e"), F.col("role").alias("_role"), "text"
    ).filter("_e.edit <> 'D'")
    repaired = each.select(
        "conv_id", "place", "at", "_e.edit", F.coalesce("_e.role", "_role").alias("role"),
        F.when(F.col("_e.edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )
    return report, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of each conversation's ``role:text`` lines, joined by newlines.

    Lines are read in order and none is held; conversations without a line are absent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            started, key, digest = False, None, None
            for batch in batches:
                for conv, line in zip(*(c.to_pylist() for c in batch.columns)):
                    if started and conv == key:
                        digest.update(b"\n")
                    else:
                        if started:
                            yield key, digest.hexdigest()
                        started, key, digest = True, conv, hashlib.sha256()
                    digest.update(line.encode())
            if started:
                yield key, digest.hexdigest()

        yield from _emit(results(), [("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    line = F.concat("role", F.lit(":"), "text")
    lines = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place", "at").select("conv_id", line.alias("line"))
    return lines.mapInArrow(run, "conv_id bigint, repaired_sha256 string")
