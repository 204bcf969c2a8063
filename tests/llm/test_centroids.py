"""Centroid clustering against plain Lloyd rounds in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from folioworks.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster string, `low` int"


def plain(rows, clusters, rounds, components):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*(v for (_, v), k in zip(kept, own, strict=True) if k == j), strict=True)] or y for j, y in enumerate(c)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, k in got if k == j) for _, _, j in got}
    return sorted(((i is None, i), k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in got)


def listed(df):
    return sorted(((r["vec_id"] is None, r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def blobs(n, components, seed, spread=0.1):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(components)] for _ in range(6)]
    return [(i, [x + draw.gauss(0, spread) for x in draw.choice(middles)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", "y", 1) for i, e in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_rounds(spark, seed):
    rows = blobs(300, 8, seed)
    got = centroids.cluster_vectors(table(spark, rows), clusters=7, rounds=5, components=8)
    assert listed(got) == plain(rows, 7, 5, 8)


def test_odd_rows(spark):
    good = blobs(40, 4, 3)
    odd = [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]), (104, [math.nan, 0.0, 0.0, 0.0]), (105, [math.inf, 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (7, good[7][1]), (7, [9.0, 9.0, 9.0, 9.0])]
    ties = [(200 + i, [0.25, 0.25, 0.0, 0.0]) for i in range(60)]  # a third and more are one vector
    rows = good + odd + ties
    got = centroids.cluster_vectors(table(spark, rows), clusters=9, rounds=3, components=4)
    assert listed(got) == plain(rows, 9, 3, 4)


def test_few_vectors_and_none(spark):
    rows = blobs(3, 4, 5)
    assert listed(centroids.cluster_vectors(table(spark, rows), components=4)) == plain(rows, 16, 3, 4)
    empty = centroids.cluster_vectors(table(spark, [(1, [0.0])]), components=4)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components_count_as_the_limit(spark):
    rows = [(i, [1e300 if i % 2 else -1e30, float(i)]) for i in range(10)]
    got = centroids.cluster_vectors(table(spark, rows), clusters=2, components=2)
    assert got.count() == 10 and got.filter(F.col("distance") < 0).count() == 0


def test_bounds_spare_most_distances(spark):
    """After the first pass, a round measures far fewer distances than vectors times centroids."""
    rows = blobs(400, 16, 9, 0.02)
    whole = centroids.whole_vectors(table(spark, rows), components=16)
    history = centroids.start(whole, 6)[None]
    state = whole.mapInArrow(centroids._first(history, False), centroids._STATE)
    history = centroids.np.concatenate([history, centroids._means(state, history[-1])[None]])
    again = state.mapInArrow(centroids._again(history, False), centroids._STATE)
    extra = again.agg(F.sum("measured").alias("n")).collect()[0]["n"] - 400 * 6
    assert 0 <= extra < 400 * 6 / 2


def test_displacement_bound_holds_where_drifts_would_be_larger():
    """A centroid that comes back loosens nothing: the norm of the sum is zero, the sum of norms is not."""
    import pyarrow as pa

    x = centroids.np.array([[0, 0], [10, 0]], centroids.np.int32)
    history = centroids.np.array([[[0, 0], [10, 0]], [[5, 5], [20, 9]], [[0, 0], [10, 0]]], centroids.np.int64)
    (state,) = centroids._first(history[:1], False)([pa.RecordBatch.from_arrays([pa.array([1, 2]), centroids._lists(x)], names=["vec_id", "v"])])
    (after,) = centroids._again(history, False)([state])
    assert after.column(2).to_pylist() == [0, 1] and after.column(7).to_pylist() == state.column(7).to_pylist()
