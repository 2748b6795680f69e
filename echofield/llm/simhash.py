"""SimHash near-duplicates found through multi-index hashing.

A fingerprint has 64 bits, cut into two segments of 32.  Two fingerprints at
three differing bits or fewer agree in one segment up to one bit.  So every
fingerprint probes a table of segment values with the small Hamming ball of
each of its segments, and each match is verified on all 64 bits.

A segment value that more than ``bucket`` different fingerprints share would
give all pairs of them.  Those values go another exact way: in the other
segment every fingerprint visits the points within a small distance, and
fingerprints that visit the same point are tied to one of them (see
``_through_points``).  At most 1,585 fingerprints can meet at a point, so no
group and no pair count grows with a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield.llm.common import binary_texts, components, shared_table

BITS, HALF = 64, 32
DISTANCE = 3
SHINGLE = 3
SEED = 42
BUCKET = 64
_ROWS = 1 << 15
_MASK = (1 << HALF) - 1


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text as a signed 64-bit integer; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, runs)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, _ROWS):
        octets = hashes[i:i + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The ``key`` columns of each row and ``fp``, the fingerprint of its whole text.

    Words are split at ASCII white space and A-Z lower-cased; a null text counts
    as empty.  Rows keep their partition, nothing is shuffled.
    """
    rows = docs.select(*[F.col(k) for k in key], F.col(text).alias("_text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t, shingle) for t in binary_texts(batch.column("_text"))]
            kept = [batch.column(k) for k in key]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.int64())], [*key, "fp"])

    schema = rows.select(*key, F.lit(0).cast("long").alias("fp")).schema
    return rows.mapInArrow(prints, schema)


def _segment(seg: int) -> Column:
    fp = F.col("fp")
    return F.shiftrightunsigned(fp, HALF) if seg == 0 else fp.bitwiseAND(F.lit(_MASK))


def _probes() -> Column:
    """The segment value itself and every value with one more bit set.

    Of two values one bit apart exactly one has that bit clear and finds the
    other, so half of the ball is enough.
    """
    flips = F.array(*[F.lit(1 << i).cast("long") for i in range(HALF)])
    ups = F.filter(flips, lambda m: F.col("val").bitwiseAND(m) == 0)
    return F.concat(F.array(F.col("val")), F.transform(ups, lambda m: F.col("val").bitwiseOR(m)))


def _ball(value: Column, radius: int) -> Column:
    """(point, r): the points of HALF bits within ``radius`` (0 to 2) of ``value``."""
    masks = [(0, 0)] + [(1 << i, 1) for i in range(HALF)] * (radius > 0)
    if radius > 1:
        masks += [((1 << i) | (1 << j), 2) for i in range(HALF) for j in range(i)]
    table = F.from_json(
        F.lit("[" + ",".join(f'{{"m":{m},"r":{r}}}' for m, r in masks) + "]"), "array<struct<m:bigint,r:int>>"
    )
    return F.transform(table, lambda x: F.struct(value.bitwiseXOR(x["m"]).alias("point"), x["r"].alias("r")))


def _through_points(members: DataFrame, visitors: DataFrame) -> DataFrame:
    """Edges among fingerprints of crowded segment values, (seg, val, fp) each.

    ``members`` have the segment value itself, ``visitors`` are one bit away
    from it.  In the other segment members visit all points within two bits,
    visitors those within one.  A member within one bit of a point is an anchor
    there.  Everything that meets an anchor at a point is linked to it: a
    member differs in 0 + (2 + 1) bits at most, a visitor in 1 + (1 + 1).  And
    every linked pair with a member in it meets at such a point, so tying all
    to the smallest anchor keeps the components.
    """
    other = F.when(F.col("seg") == 0, _segment(1)).otherwise(_segment(0))
    near = members.select("seg", "val", "fp", F.lit(True).alias("own"), F.explode(_ball(other, 2)).alias("x"))
    far = visitors.select("seg", "val", "fp", F.lit(False).alias("own"), F.explode(_ball(other, 1)).alias("x"))
    met = near.union(far).groupBy("seg", "val", "x.point").agg(
        F.min(F.when(F.col("own") & (F.col("x.r") <= 1), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all")
    )
    return met.filter(F.col("a").isNotNull() & (F.size("all") > 1)).select("a", F.explode("all").alias("b"))


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints ``fp`` of at most DISTANCE differing bits.

    Not every pair is listed, but the connected components are those of all of them.
    """
    distinct = prints.select("fp").distinct()
    table = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), _segment(s).alias("val")) for s in (0, 1)
    ])).alias("s")).select("s.seg", "s.val", "fp")
    crowded = table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)
    crowded = shared_table(crowded.select("seg", "val", F.lit(True).alias("full")), "crowded")
    table = table.join(crowded, ["seg", "val"], "left")
    probes = (
        table.select("seg", "val", "fp").select("seg", "val", "fp", F.explode(_probes()).alias("at"))
        .withColumn("own", F.col("at") == F.col("val"))
    )
    members = table.filter("full").select("seg", "val", "fp")
    entries = table.filter(F.col("full").isNull()).select("seg", F.col("val").alias("at"), F.col("fp").alias("b"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("b")))
    # Spark takes exploded rows for no more than the rows they come from, and would broadcast millions of probes.
    pairs = probes.hint("merge").join(entries, ["seg", "at"]).filter(
        (~F.col("own") | (F.col("fp") < F.col("b"))) & (apart <= DISTANCE)
    ).select(F.col("fp").alias("a"), "b")
    visitors = probes.filter(~F.col("own")).select("seg", F.col("at").alias("val"), "fp").join(
        crowded.select("seg", "val"), ["seg", "val"]
    )
    return pairs.union(_through_points(members, visitors))


def near_duplicates(docs: DataFrame, key: list[str], text: str = "text", shingle: int = SHINGLE,
                    bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): ``key`` and ``fp`` of each row; ``fp`` and ``root``, the class of linked fingerprints.

    Fingerprints link when at most DISTANCE of their bits differ; ``root`` is
    the smallest fingerprint reachable.  Equal texts, texts without words and
    null texts fall together by their fingerprint.  Both tables are written to
    the shared folder.
    """
    rows = shared_table(fingerprints(docs, key, text, shingle), "fingerprints")
    found = components(links(rows, bucket))
    classes = rows.select("fp").distinct().join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return rows, shared_table(classes.select("fp", F.coalesce("root", "fp").alias("root")), "classes")


def component_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key of the class.

    One row per row of ``docs``.  Null keys are left out of the minimum.  An
    empty table gives no rows; other columns are ignored.
    """
    rows, classes = near_duplicates(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), ["doc"])
    least = rows.groupBy("fp").agg(F.min("doc").alias("least")).join(classes, "fp")
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = least.select("fp", "root").join(whole, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select(
        F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate class, that of the smallest key.

    All columns are kept.  A null key counts as largest; rows that agree in key
    and text count as one.
    """
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slim = docs.select(F.col(key).alias("doc"), mark.alias("mark"), F.col(text).alias("text"))
    rows, classes = near_duplicates(slim, ["doc", "mark"])
    rank = F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("mark"))
    per_print = rows.groupBy("fp").agg(F.min(rank).alias("best")).join(classes, "fp")
    chosen = per_print.groupBy("root").agg(F.min("best").alias("best")).select("best.doc", "best.mark")
    whole = docs.select(F.col(key).alias("doc"), mark.alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = whole["doc"].eqNullSafe(chosen["doc"]) & (whole["mark"] == chosen["mark"])
    kept = whole.join(chosen, same, "left_semi")
    return kept.groupBy("doc", "mark").agg(F.min("row").alias("row")).select("row.*")
