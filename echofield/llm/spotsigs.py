"""Document fingerprints from spots: chains of content words after common words.

Every occurrence of a common word (an anchor) together with the content words
that follow it makes one signature.  The set of a document's signatures is its
fingerprint, and two documents are as alike as the Jaccard coefficient of
their sets.  Sets whose lengths lie too far apart cannot be alike, so pairs are
only sought within a length partition and the next one.  Everything is
DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofield.llm.common import shared_table

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it not of on or she that the their they this "
    "to was we were what which who will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas plus pour que qui sa se ses "
    "son sur un une "
    "als am auch auf aus bei das dass dem den der die ein eine einem einen einer es für ich im ist mit nicht noch nur "
    "sich sie sind so um und von war wie zu zum zur "
    "al como con del el ella ha las lo los más no nos para pero por se si sin su sus también una y ya"
).split()
CHAIN = 2
REACH = 16
ALIKE = 0.8


def signatures(text: str, chain: int = CHAIN, reach: int = REACH) -> Column:
    """The sorted set of signature hashes of the string column named ``text``.

    Words are runs of letters and digits, lower-cased.  After an anchor the
    first ``chain`` content words among the next ``reach`` words are taken; an
    anchor without that many makes no signature.  A text without signatures is
    described by its single words, one without words by itself, and an empty
    or null text by the empty set.
    """
    anchors = "(" + ", ".join(f"'{a}'" for a in sorted(set(ANCHORS))) + ")"
    # Each one-element transform binds a value to a variable, so that it is computed once.
    spot = f"""transform(array(slice(filter(slice(w, i + 2, {reach}), x -> x NOT IN {anchors}), 1, {chain})),
        c -> CASE WHEN size(c) = {chain} THEN hash(w[i], c) END)[0]"""
    spots = f"filter(transform(filter(sequence(0, size(w) - 1), i -> w[i] IN {anchors}), i -> {spot}), h -> h IS NOT NULL)"
    words = f"filter(split(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), x -> x <> '')"
    chosen = f"""transform(array({words}), w -> CASE
        WHEN {text} IS NULL OR {text} = '' THEN array()
        WHEN size(w) = 0 THEN array(hash({text}))
        ELSE transform(array({spots}), s -> CASE WHEN size(s) > 0 THEN s ELSE transform(w, x -> hash(x)) END)[0] END)[0]"""
    return F.array_sort(F.array_distinct(F.expr(f"CAST({chosen} AS ARRAY<INT>)")))


def fingerprint(spots: Column) -> Column:
    """A signature set as text: 8 hex digits per signature, in order."""
    return F.array_join(F.transform(spots, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two signature sets; 1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def partition(spots: Column, alike: float = ALIKE) -> Column:
    """Length partition of a set.  Sets two or more partitions apart are less alike than ``alike``."""
    return F.floor(F.ln(F.size(spots)) / F.lit(math.log(1 / alike))).cast("int")


def near_pairs(prints: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(a, b, likeness): pairs of different signature sets at ``alike`` or above, a < b as fingerprints.

    ``prints`` has a column ``spots``; equal sets count once and join by their
    fingerprint.  Empty sets have no pairs.  Of each set only its rarest
    signatures are looked up, as many as two sets that are alike cannot all
    miss, under its own length partition and the one above.  Candidates are
    then pruned by length before their Jaccard coefficient is computed.
    """
    sets = prints.filter(F.size("spots") > 0).select(fingerprint(F.col("spots")).alias("fp"), "spots").groupBy("fp").agg(
        F.first("spots").alias("spots")
    )
    sets = shared_table(sets.withColumn("part", partition(F.col("spots"), alike)), "sets")
    each = sets.select("fp", "part", F.size("spots").alias("n"), F.explode("spots").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("fp").orderBy("df", "s")
    need = F.col("n") - F.ceil(F.lit(alike) * F.col("n")) + 1
    rare = each.join(often, "s").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= need)
    left = rare.select("s", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"))
    right = rare.select("s", F.col("fp").alias("b"), F.col("n").alias("nb"), F.explode(F.array("part", F.col("part") - 1)).alias("pa"))
    close = F.least("na", "nb") >= F.lit(alike) * F.greatest("na", "nb")
    pairs = left.join(right, ["s", "pa"]).filter(close & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    of = lambda x: sets.select(F.col("fp").alias(x), F.col("spots").alias(f"s{x}"))
    scored = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return scored.filter(F.col("likeness") >= alike).select("a", "b", "likeness")


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, r, n, idx): the rows in ascending order of doc, numbered from 0 without a one-task sort."""
    slim = docs.select("doc", "mark", F.char_length("text").cast("long").alias("n"))
    slim = slim.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy("mark")))
    cut = shared_table(
        slim.repartitionByRange("doc", "r").withColumn("range", F.spark_partition_id()).select("doc", "r", "n", "range"),
        "ordered",
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range from here on.
    starts = cut.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).select(
        "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")
    )
    inside = F.row_number().over(Window.partitionBy("range").orderBy("doc", "r"))
    return cut.withColumn("at", inside).join(starts, "range").select(
        "doc", "r", "n", (F.col("first") + F.col("at") - 1).alias("idx")
    )


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text, its signatures, and those of the text with its end replaced.

    The last quarter of the code points (rounded down) gives way to the first
    as many, or all, of the next document by ascending ``key``; the last
    document's next is the first.  Rows of one key are ordered by their text's
    hash, a null key comes first and a null text counts as empty.  Returns key,
    n_chars, spots, next_spots, edited, edited_spots.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), body.alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    order = shared_table(_numbered(rows), "numbered")
    count = order.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    own = order.select((F.pmod(F.col("idx") + 1, F.lit(max(1, count)))).alias("idx"), F.col("doc").alias("to"),
                       F.col("r").alias("to_r"), F.floor(F.col("n") / 4).cast("int").alias("k"))
    wanted = own.join(order.select("idx", "doc", "r"), "idx").select("doc", F.col("r").alias("of"), "to", "to_r", "k")
    full = rows.withColumn("spots", signatures("text"))
    full = full.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy("mark"))).select("doc", "r", "text", "spots")
    # Rows meet by document; comparing the difference of the row numbers keeps one shuffle of the texts for both joins.
    heads = full.join(wanted, "doc").filter(F.col("r") - F.col("of") == 0).select(
        F.col("to").alias("doc"), F.col("to_r").alias("of"), "k",
        F.expr("substring(text, 1, k)").alias("head"), F.col("spots").alias("next_spots"),
    )
    met = full.join(heads, "doc").filter(F.col("r") - F.col("of") == 0)
    kept = F.expr("substring(text, 1, char_length(text) - k)")
    whole = met.select("doc", "text", "spots", "next_spots", F.concat(kept, "head").alias("edited"))
    return whole.select(
        F.when(F.col("doc") > F.lit(-(1 << 63)), F.col("doc")).alias(key),
        F.char_length("text").cast("long").alias("n_chars"), "spots", "next_spots", "edited",
        signatures("edited").alias("edited_spots"),
    )
