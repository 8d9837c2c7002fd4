"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers and get one more coordinate, which makes all norms the
largest one, M: then distance**2 = |q|**2 + M**2 - 2 * product, and the nearest
are those of largest product. Each vector is keyed by its nearest pivot (PIVOTS
vectors of least hash, a bounded sample) and its distance to it, and the keys
are cut into sorted annuli of about BLOCK vectors; every vector is in one.

A query first expands the annuli round its own distance at its own pivot; the
k-th best product found bounds how far away a better vector can be. By the
triangle inequality an annulus (pivot, near, far) has none closer than
max(0, d - far, near - d), d being the query's distance to the pivot; only
annuli within the bound are searched in the second round. Bounds have slack for
rounding, scores are exact integers, so the result is exact (recall 1).

At most ANNULI annuli exist, whatever the number of vectors, so their list of
(pivot, near, far) has a bounded size. Queries meet an annulus in groups of
QUERIES of those that ask for it, so neither side of a task grows with the
other, and an annulus that no query reaches is sent nowhere.

Defined results: null vectors, and vectors with null or non-finite components,
take no part; shorter vectors count as padded with zeros; vec_id is a key:
rows of the query's id are no candidates, each other row is one, and of two
queries of one id the smaller vector asks; a null id takes no part; fewer than k candidates give all; ties go to the smaller id;
a component of over LARGEST units counts as LARGEST, and a score that 64 bits
don't hold as the largest or smallest number that they hold; other columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.sources.shared import written

PIVOTS = 64
BLOCK = 2048
ANNULI = 200_000
QUERIES = 1024
#: Distances of queries to annuli that a task holds at once.
PAIRS = 1 << 22
SLACK = 1e-6
LARGEST = 1 << 62
#: Sums of products up to here are exact in 64 bits; beyond, Python's integers are used.
SAFE = 1 << 62
MOST_SCORE = (1 << 63) - 1
KEYED = "id long, pivot int, near double, vector binary"
FOUND = "query long, id long, score long"


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and integer components of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    finite = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.where(finite & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long")).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), dim), np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def product(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Inner products, exact within 64 bits; most: no partial sum is larger."""
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < SAFE:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -MOST_SCORE - 1, MOST_SCORE).astype(np.int64)


class Space:
    """Distances to the pivots, in the space with one more coordinate."""

    def __init__(self, pivots: np.ndarray, most: int):
        self.pivots, self.most = pivots.astype(np.float64), most
        self.up = np.sqrt(np.maximum(most - (self.pivots**2).sum(axis=1), 0))

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype(np.float64)
        up = np.sqrt(np.maximum(self.most - (x**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.most - 2 * (x @ self.pivots.T + np.outer(up, self.up)), 0))


def top_products(table: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k largest products. queries: rows like the table's."""
    every, asked = integer_vectors(table, key, vector, scale), integer_vectors(queries, key, vector, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = every.unionByName(asked).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("most")).first()
    spark = table.sparkSession
    if not facts["n"] or not facts["dim"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, most = facts["dim"], int(facts["most"] * (1 + 1e-12)) + 1  # at least each norm, whatever the sums' rounding
    space = Space(np.stack([np.pad(np.array(r["v"], np.int64), (0, dim - len(r["v"]))) for r in every.orderBy(F.xxhash64("v"), "id").limit(PIVOTS).collect()]), most)
    size = max(BLOCK, -(-facts["n"] // ANNULI))
    parts = max(1, -(-facts["n"] // size))

    def keyed(batches):
        for b in batches:
            v = matrix(b.column("v"), dim)
            d = space.distances(v)
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(v)), at]), pa.array([x.tobytes() for x in v], pa.binary())], names=["id", "pivot", "near", "vector"])

    def annuli(batches):
        """A sorted partition as annuli: cut where the pivot changes, and by size."""
        held = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("pivot", pa.int32()), ("near", pa.float64()), ("vector", pa.binary())]))  # about `size` rows
        pivot, near = held.column("pivot").to_numpy(), held.column("near").to_numpy()
        edge = np.flatnonzero(np.diff(pivot)) + 1
        cut = sorted({0, len(pivot), *edge.tolist(), *range(0, len(pivot), 2 * size)})
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a < b:
                rows.append((int(pivot[a]), float(near[a : b].min()), float(near[a : b].max()), held.column("id")[a:b].to_numpy().astype(np.int64).tobytes(), b"".join(held.column("vector")[a:b].to_pylist())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()], strict=True)], names=["pivot", "near", "far", "ids", "vectors"])

    points = every.mapInArrow(keyed, KEYED).repartitionByRange(parts, "pivot", "near", "id").sortWithinPartitions("pivot", "near", "id")
    index = written(points.mapInArrow(annuli, "pivot int, near double, far double, ids binary, vectors binary").withColumn("annulus", F.monotonically_increasing_id()), "annuli")
    known = sorted(index.select("annulus", "pivot", "near", "far").collect())  # at most ANNULI rows, and one more for each pivot and partition cut
    number, pivot, near, far = (np.array([r[c] for r in known]) for c in range(4))

    step = max(1, PAIRS // max(1, len(known)))

    def own(v):
        """The nearest annuli of the query's own pivot, as many as may hold k others."""
        all_d = space.distances(v)
        home = all_d.argmin(axis=1)
        d = all_d[:, pivot]
        g = np.where(pivot == home[:, None], np.maximum(0, np.maximum(d - far, near - d)), np.inf)
        two = np.argsort(g, axis=1, kind="stable")[:, :2]
        return [number[m[np.isfinite(x[m])]] for m, x in zip(two, g, strict=True)]

    def others(v, kth):
        """All annuli that the bound doesn't exclude."""
        f = v.astype(np.float64)
        norm2 = (f**2).sum(axis=1)
        # a query's further coordinate is 0, so that only true products enter its distances
        d = np.sqrt(np.maximum(norm2[:, None] + most - 2 * (f @ space.pivots.T), 0))[:, pivot]
        reach = np.sqrt(np.maximum(norm2 + most - 2 * kth, 0))
        gap = np.maximum(0, np.maximum(d - far, near - d))
        near_enough = gap <= (reach * (1 + SLACK) + SLACK)[:, None]
        return [number[m] for m in near_enough]

    def asks(choose):
        """Each query with the list of its annuli; so many queries at once that their distances to all annuli are PAIRS numbers at most."""

        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, step):
                    b = batch.slice(k, step)
                    v = matrix(b.column("v"), dim)
                    kth = np.array([float("-inf") if x is None or x <= -MOST_SCORE else x for x in b.column("kth").to_pylist()])
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(choose(v, kth), pa.list_(pa.int64()))], names=["query", "asked", "annuli"])

        return run

    def search(_, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids = np.frombuffer(right.column("ids")[0].as_py(), np.int64)
        x = np.frombuffer(right.column("vectors")[0].as_py(), np.int64).reshape(-1, dim)
        q = left.column("query").to_numpy()
        scores = product(np.frombuffer(b"".join(left.column("asked").to_pylist()), np.int64).reshape(-1, dim), x, most)
        out = []
        for i in range(len(q)):
            free = np.flatnonzero(ids != q[i])
            s = scores[i, free]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                free = free[s >= least]
                s = scores[i, free]
            best = np.lexsort((ids[free], -s))[:k]
            out.append((np.full(len(best), q[i]), ids[free][best], s[best]))
        return pa.table(dict(zip(("query", "id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    def searched(queries: DataFrame, choose, name: str) -> DataFrame:
        """An annulus is sent once for each QUERIES of the queries that ask for it, not of all."""
        asking = written(queries.mapInArrow(asks(choose), "query long, asked binary, annuli array<long>"), name)
        pairs = asking.select("query", "asked", F.explode("annuli").alias("annulus"))
        chunks = pairs.groupBy("annulus").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))  # at most one row for each annulus
        pairs = pairs.join(F.broadcast(chunks), "annulus").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int")).drop("chunks")
        blocks = index.select("annulus", "ids", "vectors").join(F.broadcast(chunks), "annulus").select("annulus", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        return pairs.groupBy("annulus", "chunk").cogroup(blocks.groupBy("annulus", "chunk")).applyInArrow(lambda key, a, b: search(key, a, b), FOUND)

    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    first = searched(asked.withColumn("kth", F.lit(None).cast("long")), lambda v, kth: own(v), "near")
    first = first.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select(F.col("query").alias("id"), F.col("score").alias("kth"))
    second = searched(asked.join(first, "id", "left").select("id", "v", "kth"), others, "reached")
    return second.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
