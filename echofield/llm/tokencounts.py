"""Token counts of a byte-level vocabulary without token ids.

A text is cut into pre-tokens as the vocabulary's library cuts it.  How many
pieces a pre-token has does not depend on its text, so it is found once per
distinct pre-token, joined to the frequencies per document and summed.

Two passes read the texts.  The first finds the frequent pre-tokens, of which
there are at most 1 / SHARE whatever the corpus; their piece counts go to every
task.  The second adds those up on the spot and sends only the rarer
pre-tokens, each below 2 x SHARE of all occurrences, through one shuffle on the
pre-token.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofield.llm.common import shared_table, small
from echofield.llm.packing import _encoder, _octets

SHARE = 5e-7
CHUNK = 1 << 19  # distinct pre-tokens held by a task of the first pass
FREQUENT_SCHEMA = "word string, n bigint"
SCAN_SCHEMA = "row bigint, doc_id bigint, n_bytes bigint, word string, n bigint"


@lru_cache(maxsize=4)
def _splitter(vocabulary: str) -> Callable[[str], tuple[list[str], int]]:
    """Function text -> (pre-tokens, added tokens named in the text) for a vocabulary file.

    The pre-token pattern runs in ``regex``.  Its letter and digit classes are
    those of a newer Unicode than the library's, so a text with a character
    that Unicode 3.2 does not assign goes through the library.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    if not plain or spec["normalizer"] or any(t[f] for t in spec["added_tokens"] for f in flags):
        raise ValueError(f"{vocabulary} is no plain byte-level vocabulary")
    names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    added = re.compile("|".join(map(re.escape, names))) if names else None
    pattern, newer = regex.compile(public_tokenizers.PATTERN), _newer()

    def pretokens(text: str) -> list[str]:
        if text.isascii() or not newer.search(text):
            return pattern.findall(text)
        return [text[lo:hi] for _, (lo, hi) in whole.pre_tokenizer.pre_tokenize_str(text)]

    def split(text: str) -> tuple[list[str], int]:
        if added is None or not added.search(text):
            return pretokens(text), 0
        parts = added.split(text)
        return [w for part in parts for w in pretokens(part)], len(parts) - 1

    return split


@lru_cache(maxsize=1)
def _newer() -> re.Pattern:
    """A pattern for characters that Unicode 3.2 does not assign."""
    old = unicodedata.ucd_3_2_0.category
    spans, start = [], None
    for c in range(0x110001):
        new = c < 0x110000 and old(chr(c)) == "Cn"
        if new and start is None:
            start = c
        elif not new and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(spans)}]")


@lru_cache(maxsize=4)
def _listed(vocabulary: str) -> dict[str, int]:
    """1 for every text that the vocabulary lists and encodes as one piece; no longer than the vocabulary."""
    encode = _encoder(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"] for t in spec["added_tokens"]}
    texts = (_octets(piece) for piece in spec["model"]["vocab"] if piece not in added)
    known = {}
    for octets in texts:
        try:
            text = octets.decode()
        except UnicodeDecodeError:  # part of a character, so never a pre-token
            continue
        if len(encode(text)) == 1:
            known[text] = 1
    return known


def frequent_pretokens(docs: DataFrame, vocabulary: str, text: str = "text", share: float = SHARE) -> DataFrame:
    """(word, n): pre-tokens that make up at least ``share`` of all, without those the vocabulary lists.

    A task counts its texts in chunks and passes on what reaches the share
    within the chunk.  What is frequent overall is so in some chunk, and what a
    pre-token lacks in the others is below ``share`` of them: every pre-token
    left out makes up less than twice ``share``, and at most 1 / share are found.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, listed = _splitter(vocabulary), _listed(vocabulary)
        counts: Counter[str] = Counter()
        total = 0

        def passed() -> pa.RecordBatch:
            found = {w: n for w, n in counts.items() if n >= share * total}
            return pa.RecordBatch.from_arrays(
                [pa.array([*found, None], pa.string()), pa.array([*found.values(), total], pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for body in batch.column(0).to_pylist():
                words, _ = split(body or "")
                total += len(words)
                counts.update(words)
                if len(counts) > CHUNK:
                    for w in listed.keys() & counts.keys():
                        del counts[w]
                    if len(counts) > CHUNK // 2:
                        yield passed()
                        counts.clear()
                        total = 0
        for w in listed.keys() & counts.keys():
            del counts[w]
        yield passed()

    # The row without a word holds the number of all pre-tokens; written, so that the texts are read once for both.
    counted = shared_table(
        docs.select(F.col(text)).mapInArrow(count, FREQUENT_SCHEMA).groupBy("word").agg(F.sum("n").alias("n")), "pretokens"
    )
    all_words = counted.filter(F.col("word").isNull()).select("n").scalar()
    return counted.filter(F.col("word").isNotNull() & (F.col("n") >= F.lit(share) * all_words))


def token_counts(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", share: float = SHARE
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row of ``docs``, whole texts, no begin or end tokens.

    ``vocabulary`` is the path of a byte-level vocabulary file that every
    executor has; the counts are those of its own library, which reads the name
    of an added token inside a text as that token.  A null or empty text has no
    bytes and no tokens.  Rows with the same or a null key stay rows of their
    own, other columns are left out, an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = frequent_pretokens(docs, vocabulary, text, share)
    encode = _encoder(vocabulary)
    frequent = spark.sparkContext.broadcast(
        {w: len(encode(w)) for w in found.select("word").toArrow().column(0).to_pylist()}
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(vocabulary)
        known = _listed(vocabulary) | frequent.value
        for whole in batches:
            for batch in small(whole, 2):
                columns: list[list] = [[], [], [], [], []]
                for row, doc, body in zip(*(c.to_pylist() for c in batch.columns)):
                    body = body or ""
                    words, tokens = split(body)
                    counts = Counter(words)
                    rare = [w for w in counts if w not in known]
                    n = [counts.pop(w) for w in rare]
                    tokens += sum(times * known[w] for w, times in counts.items())
                    many = len(rare)
                    columns[0] += [row] * (many + 1)
                    columns[1] += [doc] + [None] * many
                    columns[2] += [len(body.encode())] + [None] * many
                    columns[3] += [None, *rare]
                    columns[4] += [tokens, *n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string(), pa.int64()])],
                    ["row", "doc_id", "n_bytes", "word", "n"],
                )

    @F.pandas_udf("long")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Pieces per pre-token, counted once for each run of equal ones; 1 for null."""
        count, last = _encoder(vocabulary), (None, 1)
        for words in batches:
            codes, values = pd.factorize(words)
            sizes = [last[1] if w == last[0] else len(count(w)) for w in values]
            if sizes:
                last = values[-1], sizes[-1]
            yield pd.Series([*sizes, 1], dtype="int64").take(codes).reset_index(drop=True)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")
    ).mapInArrow(scan, SCAN_SCHEMA)
    # Rows without a word carry what is known of a document; they go by their row, not all to one task.
    own = F.when(F.col("word").isNull(), F.col("row"))
    return (
        rows.repartition(own, F.col("word")).sortWithinPartitions("word")
        .withColumn("tokens", F.col("n") * pieces("word"))
        .groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens")
        ).drop("row")
    )
