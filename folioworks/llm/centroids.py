"""Centroid clustering with bounds by the norm of the sum of displacements.

Vectors become integers and Lloyd's rounds run on them exactly. Each vector keeps an upper bound of the distance to its
own centroid and a lower bound of that to every other one, both with the round in which they were measured. All former
centroids are kept, so a bound is loosened by the distance between the centroid then and now: the norm of the summed
displacement, which is never more than the sum of the norms of each round's drift. Only where a loosened lower bound does
not exceed the upper one are distances measured again, in integers.

Vectors and bounds are a stored table that each round reads and writes once, without a shuffle; what a round passes
through the driver are the sums of its clusters, clusters times components numbers, as the centroids that every task gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, sliced

CLUSTERS = 16
ROUNDS = 3
COMPONENTS = 64
SEED = 1
SCALE = 64
MOST = 1 << 27  # of a component: squared distances stay within a long
ROWS = 4096
#: Bounds are rounded outwards by this share, more than the error of the few operations on doubles behind them.
SLACK = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, up float, up_at tinyint, low array<float>, low_at array<tinyint>, measured int"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, v: each component x as floor(64 * x), of the vectors that have all components and only finite ones."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.greatest(F.least(F.floor(e.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return vectors.filter((F.size(x) == components) & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances in integers; centroid: one, or one for each row of x."""
    apart = x.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", apart, apart)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def _first(history: np.ndarray, last: bool):
    """Measure everything: vec_id, v in, state out."""
    centroids = history[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            x = _matrix(batch.column(1), centroids.shape[1])
            d = np.stack([_squared(x, c) for c in centroids], axis=1) if len(x) else np.zeros((0, len(centroids)), np.int64)
            cluster = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)  # the first of equals
            root = np.sqrt(d.astype(np.float64))
            up = root[np.arange(len(x)), cluster]
            yield _state(batch.column(0), x, cluster, _above(up), np.zeros(len(x), np.int8), _below(root), np.zeros(d.shape, np.int8), np.full(len(x), len(centroids)))

    return run


def _state(ids: pa.Array, x, cluster, up, up_at, low, low_at, measured) -> pa.RecordBatch:
    columns = [ids, _lists(x), pa.array(cluster.astype(np.int32)), pa.array(up), pa.array(up_at), _lists(low), _lists(low_at), pa.array(measured.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _again(history: np.ndarray, last: bool):
    """Measure what the bounds leave open: state in, state out. history: centroids by round, the last ones are those of now.

    In the last pass the result is vec_id, cluster, distance instead.
    """
    now, (k, width) = len(history) - 1, history.shape[1:]
    moved = np.sqrt(((history - history[now]) ** 2).sum(axis=2).astype(np.float64)) * (1 + SLACK)  # by round and centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            x, low, low_at = (_matrix(batch.column(i), w).copy() for i, w in ((1, width), (5, k), (6, k)))
            cluster, up, up_at, measured = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4, 7))
            rows, every = np.arange(len(x)), np.arange(k)
            ceiling = up + moved[up_at, cluster]
            floor = low - moved[low_at, every]
            floor[rows, cluster] = np.inf
            open_ = (floor <= ceiling[:, None]).any(axis=1).nonzero()[0]
            if len(open_):  # first the own centroid, then those that are still in question
                d = _squared(x[open_], history[now][cluster[open_]])
                measured[open_] += 1
                up[open_], up_at[open_] = _above(np.sqrt(d.astype(np.float64))), now
                low[open_, cluster[open_]], low_at[open_, cluster[open_]] = _below(np.sqrt(d.astype(np.float64))), now
                best, best_d = cluster[open_].copy(), d
                for j in range(k):
                    asked = (floor[open_, j] <= up[open_]).nonzero()[0]
                    if not len(asked):
                        continue
                    at = open_[asked]
                    d = _squared(x[at], history[now][j])
                    measured[at] += 1
                    low[at, j], low_at[at, j] = _below(np.sqrt(d.astype(np.float64))), now
                    nearer = (d < best_d[asked]) | ((d == best_d[asked]) & (j < best[asked]))
                    best[asked[nearer]], best_d[asked[nearer]] = j, d[nearer]
                cluster[open_] = best
                up[open_] = _above(np.sqrt(best_d.astype(np.float64)))
            if last:
                exact = _squared(x, history[now][cluster])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(exact)], names=["vec_id", "cluster", "distance"])
            else:
                yield _state(batch.column(0), x, cluster, up, up_at, low, low_at, measured)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cluster, v in; a row for each cluster of the task out: cluster, n, total."""
    n, total = {}, {}
    for batch in sliced(batches, ROWS):
        cluster = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(cluster):
            continue
        order = np.argsort(cluster, kind="stable")
        found, at, count = np.unique(cluster[order], return_index=True, return_counts=True)
        x = _matrix(batch.column(1), -1 if not len(cluster) else len(batch.column(1)[0])).astype(np.int64)
        for j, c, s in zip(found.tolist(), count.tolist(), np.add.reduceat(x[order], at, axis=0), strict=True):
            n[j], total[j] = n.get(j, 0) + c, total.get(j, 0) + s
    columns = [pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "total"])


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Centroids of the clusters, floor(sum / count) by component; empty ones stay as before."""
    parts = state.select("cluster", "v").mapInArrow(_sums, "cluster int, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    after = before.copy()
    for row in sums.collect():  # clusters times components at most
        after[row["cluster"], row["i"]] = row["x"] // row["n"]
    return after


def start(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and identifier, in order of the hash; of rows with one identifier in order of the vector."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.withColumn("hash", hashed).orderBy("hash", "v").limit(clusters).select("v").collect()  # clusters at most
    return np.array([r["v"] for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that is kept: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another number of components, or a null or non-finite one are left out; components beyond
    2**21 in size count as that. A null identifier is hashed as empty text. Repeated rows are vectors of their own and fall
    into one cluster; equally near centroids go by number. With fewer vectors than clusters there are as many clusters as
    vectors. Extra columns are not read; an empty table gives no rows. Memory of a task: rounds times clusters times components.
    """
    spark = vectors.sparkSession
    store = Scratch(spark)
    whole = whole_vectors(vectors, id_col, vector_col, components)
    first = start(whole, clusters, seed)
    if not len(first):
        return whole.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256").limit(0)
    history = first[None]
    state = store.keep(whole.mapInArrow(_first(history, False), _STATE))
    for r in range(rounds):
        history = np.concatenate([history, _means(state, history[-1])[None]])
        if r == rounds - 1:
            break
        moved_on = store.keep(state.mapInArrow(_again(history, False), _STATE))
        store.drop(state)
        state = moved_on
    done = store.keep(state.mapInArrow(_again(history, True), "vec_id long, cluster int, distance long"))
    store.drop(state)
    sums = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # clusters at most
    rows = [(j, s, hashlib.sha256(",".join(map(str, history[-1][j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = done.join(F.broadcast(facts), "cluster")  # a row a cluster
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")
