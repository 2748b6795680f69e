"""Approximate nearest neighbours by inner product with a forest of projection trees.

Every vector is put into one leaf of each tree.  A query walks all trees in
one order of priority: the most promising leaf of any tree is visited next,
until enough leaves are found.  How many are enough is measured on the table
itself.  All vectors in those leaves are scored exactly.  Vectors that occur
more than once are indexed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofield.llm.common import shared_table

TREES = 16
LEAF = 256
VISITS = 192
RECALL = 0.95
PROBES = 192
SAMPLE = 65_536
LEAST_SAMPLED = 4
CHUNK = 256
_ROUTED = 1 << 15


class Forest:
    """Trees of hyperplane splits at the median, fitted on a sample of vectors.

    Inner products become angles by one more component that fills every vector
    up to the largest norm; queries have 0 there.
    """

    def __init__(self, sample: np.ndarray, depth: int, top: float, trees: int = TREES, seed: int = 11):
        self.depth, self.top, self.trees = depth, top, trees
        points = self.lifted(sample)
        inner = (1 << depth) - 1
        self.normals = np.zeros((trees, inner, points.shape[1]))
        self.cuts = np.zeros((trees, inner))
        rng = np.random.default_rng(seed)
        for tree in range(trees):
            members = {0: np.arange(len(points))}
            for node in range(inner):
                mine = members.pop(node, np.zeros(0, np.int64))
                if len(mine) > 1:
                    a, b = points[rng.choice(mine, 2, replace=False)]
                    normal = a - b
                else:
                    normal = rng.normal(size=points.shape[1])
                length = np.linalg.norm(normal)
                normal = normal / length if length > 0 else normal
                along = points[mine] @ normal
                cut = float(np.median(along)) if len(mine) else 0.0
                self.normals[tree, node], self.cuts[tree, node] = normal, cut
                members[2 * node + 1], members[2 * node + 2] = mine[along <= cut], mine[along > cut]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.top**2 - (vectors**2).sum(axis=1)))
        return np.hstack([vectors, rest[:, None]])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector (rows) in each tree (columns)."""
        points = self.lifted(vectors)
        out = np.zeros((len(points), self.trees), np.int64)
        for tree in range(self.trees):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", points, self.normals[tree, node]) > self.cuts[tree, node]
                node = 2 * node + 1 + right
            out[:, tree] = node - ((1 << self.depth) - 1)
        return out

    def order(self, query: np.ndarray) -> np.ndarray:
        """All leaves, numbered tree by tree, most promising first.

        A leaf is as far as the farthest hyperplane that the query would have to cross on the way to it.
        """
        norm = np.linalg.norm(query)
        point = np.append(query * (self.top / norm if norm > 0 else 0.0), 0.0)
        margins = self.normals @ point - self.cuts
        far = np.zeros((self.trees, 1))
        for level in range(self.depth):
            side = margins[:, (1 << level) - 1:(2 << level) - 1]
            crossed = np.maximum(far, np.abs(side))
            both = [np.where(side > 0, crossed, far), np.where(side > 0, far, crossed)]
            far = np.stack(both, axis=2).reshape(self.trees, -1)
        return np.argsort(far.reshape(-1), kind="stable")

    def search(self, query: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs to visit, most promising first, over all trees together."""
        return [divmod(x, 1 << self.depth) for x in self.order(query)[:visits].tolist()]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the vectors that take part: none null or zero, none with a null or non-finite component.

    Only vectors of the most frequent length (the shorter one in a tie) are comparable.
    """
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (sizes["d"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    """The rows of an Arrow list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _chunks(rows: DataFrame) -> DataFrame:
    """(tree, leaf, ids, vecs): the rows of each leaf in chunks of about CHUNK, however many there are."""
    counts = rows.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("parts"))
    # A row per leaf of the forest; the rows are many more than Spark takes them for.
    salted = rows.join(F.broadcast(counts), ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return salted.groupBy("tree", "leaf", "part").agg(F.collect_list(F.struct("id", "vec")).alias("s")).select(
        "tree", "leaf", F.col("s.id").alias("ids"), F.flatten("s.vec").alias("vecs")
    )


def top_rows(queries: np.ndarray, mat: np.ndarray, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``m`` rows of ``mat`` with the largest inner product, ties to the smaller id, and the products.

    A matrix product tells what may be among them, within its rounding; those
    rows are added up component by component, so that a pair scores the same
    wherever it is met and equal products are equal.
    """
    rough = queries @ mat.T
    cut = -np.partition(-rough, m - 1, axis=1)[:, m - 1]
    longest = np.sqrt((mat**2).sum(axis=1).max()) if len(mat) else 0.0
    slack = 8 * mat.shape[1] * np.finfo(float).eps * longest * np.sqrt((queries**2).sum(axis=1))
    kept = rough >= (cut - slack)[:, None]
    most = int(kept.sum(axis=1).max())
    # The rows of a query that are kept first; the others are filled up with ones that cannot win.
    some = np.argsort(~kept, axis=1, kind="stable")[:, :most]
    exact = (mat[some] * queries[:, None, :]).sum(axis=2)
    exact[~np.take_along_axis(kept, some, axis=1)] = -np.inf
    order = np.lexsort((ids[some], -exact), axis=1)[:, :m]
    return np.take_along_axis(some, order, axis=1), np.take_along_axis(exact, order, axis=1)


def visits_for(index: DataFrame, sought: DataFrame, sent, k: int, recall: float) -> int:
    """Leaves to visit so that ``recall`` of the ``k`` nearest vectors are among theirs.

    Measured on at most PROBES queries, chosen by hash: their exact neighbours
    are looked up in the whole table, and each is found as soon as one of its
    leaves is visited.
    """
    some = sought.orderBy(F.xxhash64("id"), "id").limit(PROBES).toArrow()
    if not len(some):
        return 0
    own, probes = some.column("id").to_numpy(), _matrix(some.column("vec").combine_chunks())

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, rows = np.zeros((len(probes), 0)), np.zeros((len(probes), 0, probes.shape[1]))
        for batch in batches:
            if not len(batch):
                continue
            mat = _matrix(batch.column(1))
            here = np.where(own[:, None] == batch.column(0).to_numpy()[None, :], -np.inf, probes @ mat.T)
            m = min(k, len(batch))
            best = np.argpartition(-here, m - 1, axis=1)[:, :m]
            score = np.concatenate([score, np.take_along_axis(here, best, axis=1)], axis=1)
            rows = np.concatenate([rows, mat[best]], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, rows = np.take_along_axis(score, best, axis=1), np.take_along_axis(rows, best[:, :, None], axis=1)
        nth, at = np.nonzero(score > -np.inf)
        if not len(nth):
            return
        yield pa.RecordBatch.from_arrays([
            pa.array(nth, pa.int32()), pa.array(-score[nth, at]), pa.array(list(sent.value.leaves(rows[nth, at]))),
        ], ["probe", "s", "leaves"])

    near = index.select("id", "vec").mapInArrow(closest, "probe int, s double, leaves array<bigint>")
    lists = near.groupBy("probe").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("s", "leaves"))), 1, k)["leaves"].alias("leaves")
    ).collect()
    forest, needed = sent.value, []
    for row in lists:
        order = forest.order(probes[row["probe"]])
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(1, len(order) + 1)
        places = np.array(row["leaves"], np.int64) + (np.arange(forest.trees) << forest.depth)
        needed.append(nth[places].min(axis=1))
    every = np.sort(np.concatenate(needed)) if needed else np.zeros(1, np.int64)
    return int(every[max(0, math.ceil(recall * len(every)) - 1)])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, leaf: int = LEAF, visits: int = VISITS, sample: int = SAMPLE,
            recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows found for each query row, by inner product.

    ``is_query`` is a condition on the column ``id``.  A query's own id is no
    candidate; ties go to the smaller id.  The forest is fitted on at most about
    ``sample`` vectors chosen by hash, and every vector is indexed.  There are
    as many leaves as give ``leaf`` vectors each, but at least LEAST_SAMPLED
    sampled vectors per leaf.  A query scores the vectors of ``visits`` leaves,
    or of as many more as ``recall`` takes on this table (``visits_for``): on
    clustered vectors few, on vectors without structure a fixed share of all
    leaves, so that the work of a query grows with the table there.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector).distinct()
    first = Window.partitionBy("vec").orderBy("id")
    # Of a vector that many rows share, the k + 1 smallest ids are all that a result can name.
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    index = shared_table(
        few.groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("copies")), "index"
    )
    wanted = shared_table(
        rows.filter(is_query).join(index.select("vec", F.col("id").alias("q")), "vec").select(
            F.col("id").alias("query_id"), "q"
        ), "queries"
    )
    sums = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(
        "aggregate(vec, 0D, (s, x) -> s + x * x)")).alias("top")).first()
    n, top = sums["n"], math.sqrt(sums["top"] or 1.0)
    step = max(1, math.ceil(n / sample))
    chosen = index.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("vec", "id").toArrow().sort_by("id")
    points = _matrix(chosen.column("vec").combine_chunks()) if len(chosen) else np.zeros((0, 1))
    most = max(1, len(points) // LEAST_SAMPLED)
    depth = max(0, math.ceil(math.log2(max(1, min(n / leaf, most)))))
    forest = spark.sparkContext.broadcast(Forest(points, depth, top, trees))
    sought = index.join(wanted.select(F.col("q").alias("id")).distinct(), "id", "left_semi").select("id", "vec")
    if visits < trees << depth:
        visits = max(visits, visits_for(index, sought, forest, k, recall))
    each = max(1, _ROUTED // visits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = forest.value.leaves(_matrix(batch.column(1)))
            repeat = np.repeat(np.arange(len(batch)), found.shape[1])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(found.shape[1]), len(batch)), pa.int32()), pa.array(found.reshape(-1)),
                batch.column(0).take(pa.array(repeat)), batch.column(1).take(pa.array(repeat)),
            ], ["tree", "leaf", "id", "vec"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            # A query's vector goes along to every leaf it visits, so few queries at a time are written.
            for part in (batch.slice(lo, each) for lo in range(0, len(batch), each)):
                pairs = np.concatenate([forest.value.order(v)[:visits] for v in _matrix(part.column(1))])
                repeat = pa.array(np.repeat(np.arange(len(part)), len(pairs) // len(part)))
                yield pa.RecordBatch.from_arrays([
                    pa.array((pairs >> depth).astype(np.int32)), pa.array(pairs & ((1 << depth) - 1)),
                    part.column(0).take(repeat), part.column(1).take(repeat),
                ], ["tree", "leaf", "id", "vec"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q_ids, q_vecs, ids, vecs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(4))
                q_mat, mat = q_vecs.reshape(len(q_ids), -1), vecs.reshape(len(ids), -1)
                m = min(k + 1, len(ids))
                best, exact = top_rows(q_mat, mat, ids, m)
                yield pa.RecordBatch.from_arrays([
                    pa.array(q_ids),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(q_ids) + 1, dtype=np.int32) * m),
                                             pa.array(ids[best].reshape(-1))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(q_ids) + 1, dtype=np.int32) * m),
                                             pa.array(exact.reshape(-1))),
                ], ["q", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 best of each query, rows of a query one after the other; holds one batch and one query's best."""
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def out(q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores)], ["q", "id", "score"])

        for batch in batches:
            if not len(batch):
                continue
            ids, scores = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            q = np.concatenate([held[0], np.repeat(batch.column(0).to_numpy(), sizes)])
            ids, scores = np.concatenate([held[1], ids]), np.concatenate([held[2], scores])
            order = np.lexsort((ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            # A vector met in several leaves has the same score in each, so its repeats stand side by side.
            new = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]))
            q, ids, scores = q[new], ids[new], scores[new]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            q, ids, scores = (x[nth <= k] for x in (q, ids, scores))
            # The last query may go on in the next batch.
            open_ = q == q[-1]
            yield out(q[~open_], ids[~open_], scores[~open_])
            held = (q[open_], ids[open_], scores[open_])
        yield out(*held)

    shape = "tree int, leaf bigint, id bigint, vec array<double>"
    blocks = _chunks(index.select("id", "vec").mapInArrow(place, shape))
    asked = _chunks(sought.repartition("id").mapInArrow(route, shape)).withColumnsRenamed({"ids": "q_ids", "vecs": "q_vecs"})
    # Both are many times what Spark takes them for: every vector stands in a leaf of each tree, a query in all it visits.
    scored = asked.hint("merge").join(blocks, ["tree", "leaf"]).select("q_ids", "q_vecs", "ids", "vecs").mapInArrow(
        score, "q bigint, ids array<bigint>, scores array<double>"
    )
    best = scored.repartition("q").sortWithinPartitions("q").mapInArrow(merge, "q bigint, id bigint, score double").select(
        "q", (-F.col("score")).alias("s"), "id"
    )
    spread = best.join(index.select("id", "copies"), "id").groupBy("q").agg(
        F.collect_list(F.transform("copies", lambda c: F.struct(F.col("s"), c.alias("id")))).alias("all")
    )
    lists = spread.select("q", F.slice(F.array_sort(F.flatten("all")), 1, k + 1).alias("top"))
    own = F.filter("top", lambda x: x["id"] != F.col("query_id"))
    return wanted.join(lists, "q").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.s")).alias("score")
    )
