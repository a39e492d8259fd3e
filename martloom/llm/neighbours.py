"""Approximate nearest neighbours: stable projections in a kd-tree, with a chi-square stop.

Largest inner product becomes least distance: every vector gets one more
coordinate that lifts it to the largest norm M, a query is scaled to M. Few
Gaussian (2-stable) projections then tell about distances: the squared
projected distance of two points is their squared distance times a chi-square
variable. A kd-tree over the projections returns points by rising projected
distance. They are verified on the original vectors until the test holds: if
even the next projected distance is beyond the ``CONFIDENCE`` quantile for the
k-th best distance found, whatever is unseen is unlikely to be nearer.

The upper levels of the tree are fitted on a bounded sample (``SAMPLE`` vectors,
by hash) and deal all vectors into cells; a cell is cut into blocks of about
``BLOCK`` vectors, each with a tree of its own. A query first searches the
cell it lies in, then only cells whose box passes the test for what it found.
A task holds one block and at most about ``BATCH`` queries.

Defined results: a null or zero vector, one with a null or non-finite component,
and one of another length than the commonest (ties: the longer) takes no part;
a null vec_id takes no part; a repeated row counts once; equal vectors are
searched once and all their ids are found, smaller first; rows that share an id
with the query are its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martloom.llm.common import named, table
from martloom.session import stage

TOP = 20
EVERY = 20  # queries: ids divisible by it
DIMENSIONS = 8  # even
CONFIDENCE = 0.99
SAMPLE = 8192  # vectors that the upper tree is fitted on
CELL = 4096  # vectors aimed at per cell
MOST_CELLS = 1024
BLOCK = 8192
BATCH = 4096
LEAF = 256  # vectors verified at once
SPARE = 12  # kept beyond k, so that rounding in a block cannot decide what is found
SEED = 20


def chi_square_quantile(p: float, m: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Projection:
    """Lifts vectors to norm ``top`` and projects them."""

    def __init__(self, dim: int, top: float):
        self.top = top
        self.matrix = np.random.default_rng(SEED).standard_normal((dim + 1, DIMENSIONS))

    def points(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0.0))
        return x @ self.matrix[:-1] + lift[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.top / np.linalg.norm(q, axis=1))[:, None]) @ self.matrix[:-1]

    def square_distance(self, score: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.maximum(2 * self.top**2 - 2 * self.top * score / norms, 0.0)


def kd_cells(points: np.ndarray, depth: int) -> list[np.ndarray]:
    """Indices of the points of each of 2^depth cells, halved at the median of the widest direction."""
    cells = [np.arange(len(points))]
    for _ in range(depth):
        halves = []
        for cell in cells:
            axis = int(np.argmax(np.ptp(points[cell], axis=0))) if len(cell) else 0
            order = cell[np.argsort(points[cell, axis], kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        cells = halves
    return cells


class Splits:
    """The upper kd-tree: ``depth`` levels of (axis, value), heap order, and the cells' open boxes."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(2**depth, int)
        self.value = np.zeros(2**depth)
        parts = {1: sample}
        for node in range(1, 2**depth):
            part = parts.pop(node)
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            self.axis[node], self.value[node] = axis, value
            below = part[:, axis] < value
            parts[2 * node], parts[2 * node + 1] = part[below], part[~below]
        self.low = np.full((2**depth, DIMENSIONS), -np.inf)
        self.high = np.full((2**depth, DIMENSIONS), np.inf)
        for cell in range(2**depth):
            node = cell + 2**depth
            while node > 1:
                parent = node // 2
                axis, value = self.axis[parent], self.value[parent]
                if node % 2:
                    self.low[cell, axis] = max(self.low[cell, axis], value)
                else:
                    self.high[cell, axis] = min(self.high[cell, axis], value)
                node = parent

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[rows, self.axis[node]] >= self.value[node])
        return node - 2**self.depth

    def square_gaps(self, points: np.ndarray) -> np.ndarray:
        return square_gaps(points, self.low, self.high)


def square_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        at = points[:, axis][:, None]
        gap = np.maximum(np.maximum(low[:, axis] - at, at - high[:, axis]), 0.0)
        out += gap * gap
    return out


def search_block(space: Projection, x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` rows of ``x`` for each query, and their scores; -1 where there are fewer.

    ``bound``: squared distance of the k-th best that each query has so far. ``SPARE`` of the ``k`` are kept for rounding
    only: a search ends at the best before them.
    """
    limit = chi_square_quantile(CONFIDENCE, DIMENSIONS)
    points = space.points(x)
    leaves = [c for c in kd_cells(points, max(0, math.ceil(math.log2(len(x) / LEAF)))) if len(c)]
    low = np.stack([points[c].min(axis=0) for c in leaves])
    high = np.stack([points[c].max(axis=0) for c in leaves])
    norms = np.linalg.norm(q, axis=1)
    best = np.full((len(q), k), -np.inf)
    rows = np.full((len(q), k), -1)
    for start in range(0, len(q), 512):
        active = np.arange(start, min(start + 512, len(q)))
        gaps = square_gaps(space.queries(q[active]), low, high)
        order = np.argsort(gaps, axis=1, kind="stable")
        for turn in range(len(leaves)):
            near = order[active - start, turn]
            reach = np.minimum(bound[active], space.square_distance(best[active, k - 1 - SPARE], norms[active]))
            go = gaps[active - start, near] <= limit * reach
            active, near = active[go], near[go]
            if not len(active):
                break
            for leaf in np.unique(near):
                who, members = active[near == leaf], leaves[leaf]
                seen = q[who] @ x[members].T
                better = seen.max(axis=1) > best[who, -1]
                who, seen = who[better], seen[better]
                if not len(who):
                    continue
                scores = np.concatenate([best[who], seen], axis=1)
                found = np.concatenate([rows[who], np.broadcast_to(members, (len(who), len(members)))], axis=1)
                first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                best[who] = np.take_along_axis(scores, first, axis=1)
                rows[who] = np.take_along_axis(found, first, axis=1)
    return rows, best


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if len(flat) else flat.values
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with doubles, and ``hash``es of the vector."""
    rows = vectors.select(named(key).cast("long").alias("id"), named(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1))})


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, top: int = TOP) -> DataFrame:
    """(query_id, rank, id, score) of the ``top`` largest inner products."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, id long, score double"
    given = stage(valid_vectors(vectors, key, vector), "vectors")
    lengths = given.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], empty)
    dim = common["dim"]
    given = given.where(F.size("v") == dim)
    # Equal vectors are one, with the ids that could be among the best: a query may meet itself, so one more.
    smaller = Window.partitionBy("h1", "h2").orderBy("id")
    ids = given.select("h1", "h2", "id").distinct().withColumn("n", F.row_number().over(smaller)).where(F.col("n") <= top + 1)
    ids = ids.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    representative = given.join(ids.select("h1", "h2", "ids", F.col("ids")[0].alias("id")), ["h1", "h2", "id"])
    single = stage(representative.dropDuplicates(["h1", "h2"]).select("h1", "h2", "ids", "v"), "single-vectors")
    size = single.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("square")
    ).first()
    space = Projection(dim, math.sqrt(size["square"]))

    sample = single.select("v").orderBy(F.col("h1")).limit(SAMPLE).toArrow()
    depth = max(0, min(math.ceil(math.log2(size["n"] / CELL)), int(math.log2(MOST_CELLS))))
    splits = Splits(space.points(matrix(sample.column("v"), dim)), depth)

    def deal(batches):
        for batch in batches:
            cell = splits.cell(space.points(matrix(pa.chunked_array([batch.column("v")]), dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], [*batch.schema.names, "cell"])

    dealt = stage(single.mapInArrow(deal, "h1 long, h2 long, ids array<long>, v array<double>, cell long"), "cells")
    asked = given.where(F.col("id") % every == 0).select("id", "h1", "h2").distinct()
    queries = stage(asked.select("h1", "h2").distinct().join(dealt.select("h1", "h2", "v", "cell"), ["h1", "h2"]), "queries")
    # At most MOST_CELLS rows.
    cells = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    k = top + 1 + SPARE

    def search(visits: DataFrame) -> DataFrame:
        """visits: h1, h2, v, bound, cell."""
        busy = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BATCH).alias("batches"))
        plan = F.broadcast(stage(cells.join(busy, "cell"), "cell-plan"))
        blocks = dealt.join(plan, "cell").select(
            "cell", F.pmod("h1", "blocks").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"), "h1", "ids", "v",
        )
        sent = visits.join(plan, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod("h2", "batches").alias("batch"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), "v", "bound",
        )

        def found(data: pa.Table, asked: pa.Table) -> pa.Table:
            if not data.num_rows or not asked.num_rows:
                return pa.table({c: pa.array([], t) for c, t in FOUND})
            data = data.sort_by("h1")
            x, q = matrix(data.column("v"), dim), matrix(asked.column("v"), dim)
            rows, _ = search_block(space, x, q, asked.column("bound").to_numpy(), k)
            who, at = np.nonzero(rows >= 0)
            hit = rows[who, at]
            # Summed alike for every pair, so equal vectors get equal scores in any block.
            score = np.concatenate([(q[w] * x[h]).sum(axis=1) for w, h in zip(*[np.array_split(a, len(a) // 65536 + 1) for a in (who, hit)])])
            # What is behind the k-th best that the query had before is no candidate.
            near = space.square_distance(score, np.linalg.norm(q, axis=1)[who]) <= asked.column("bound").to_numpy()[who] * (1 + 1e-9) + 1e-9
            who, hit, score = who[near], hit[near], score[near]
            return pa.table({
                "q1": asked.column("q1").take(pa.array(who)), "q2": asked.column("q2").take(pa.array(who)),
                "ids": data.column("ids").take(pa.array(hit)), "score": pa.array(score),
            })

        keys = ["cell", "block", "batch"]
        return blocks.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(
            found, "q1 long, q2 long, ids array<long>, score double"
        )

    first = stage(search(queries.withColumn("bound", F.lit(float("inf")))), "home-cells")
    kth = first.groupBy("q1", "q2").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(top)).alias("kth"))
    known = queries.join(kth, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left").select(
        "h1", "h2", "v", "cell", "kth"
    )
    limit = chi_square_quantile(CONFIDENCE, DIMENSIONS)

    def further(batches):
        for batch in batches:
            q = matrix(pa.chunked_array([batch.column("v")]), dim)
            if not len(q):
                continue
            kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
            reach = np.where(np.isnan(kth), np.inf, space.square_distance(kth, np.linalg.norm(q, axis=1)))
            go = splits.square_gaps(space.queries(q)) <= limit * reach[:, None]
            go[np.arange(len(q)), batch.column("cell").to_numpy()] = False
            who, cell = np.nonzero(go)
            part = batch.select(["h1", "h2", "v"]).take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(reach[who]), pa.array(cell, pa.int64())], ["h1", "h2", "v", "bound", "cell"])

    visits = stage(known.mapInArrow(further, "h1 long, h2 long, v array<double>, bound double, cell long"), "visits")
    second = search(visits)
    hits = first.union(second).select("q1", "q2", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")
    named_hits = asked.select(F.col("id").alias("query_id"), "h1", "h2").join(
        hits, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))
    ).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return named_hits.select("query_id", rank.alias("rank"), "id", "score").where(F.col("rank") <= top)


FOUND = [("q1", pa.int64()), ("q2", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())]


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
