"""Packing by power-of-two decomposition.

The token count of a document is written as a sum of powers of two, with as
many pieces of the longest length as fit.  Every piece is a sequence of its
own and needs no padding; sequences of equal length form a bucket, from which
batches of equal shape are drawn.  No sequence crosses a document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 2048
END = 1
PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int"
)


@lru_cache(maxsize=4)
def _encoder(vocabulary: str):
    """Functions text -> ids for a byte-level BPE vocabulary file.

    The file's merges are handed to a faster library that gives the same ids.
    A text that names an added token goes through the file's own library,
    which reads such a name as that token.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec["added_tokens"]]
    ranks = {_octets(piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(name in text for name in added):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


@lru_cache(maxsize=1)
def _letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _octets(piece: str) -> bytes:
    return bytes(_letters()[c] for c in piece)


def binary_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, falling, that add up to ``tokens``; none above ``longest``."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", longest: int = LONGEST,
           end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, bucket.

    ``longest`` must be a power of two.  ``end`` closes each document; a null or
    empty text is that id alone.  ``vocabulary`` is a path that every executor
    has.  Rows keep their partition; the only state is one document's ids.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(body or ""), end], "<u4")
                start = 0
                for length in binary_lengths(len(ids), longest):
                    values = (doc, start, length, ids[start:start + length].tobytes(), len(ids), length.bit_length() - 1)
                    for column, value in zip(out, values):
                        column.append(value)
                    start += length
                held += len(ids)
                if held > 1 << 22:
                    yield _batch(out)
                    out, held = [[], [], [], [], [], []], 0
            if out[0]:
                yield _batch(out)

    return rows.mapInArrow(cut, PIECE_SCHEMA)


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def sequences(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    A piece is a sequence by itself, so ``offset`` is 0 and the id only has to
    be unique: it is the place of the piece in its input partition, which needs
    no shuffle.  Ids stay the same when a task is repeated.
    """
    return pieces(docs, vocabulary, **options).withColumns({
        "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
    })


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences to one folder per length, from which batches of equal shape are read."""
    packed.write.partitionBy("bucket").parquet(path)
