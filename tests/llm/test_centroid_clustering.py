"""Clusters with bounds against calculating every distance, and odd tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import op12_centroid_clustering as op12

from ..oracle import flat, run


def plain(rows, k=16, rounds=3, dim=64):
    """(vec_id, cluster, distance) and centroids by the contract, in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(64 * float(x))) for x in v]))
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))[:k]
    centroids = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=str), centroids


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out, centroids, calculated = op12.elkan_clusters(df, **more)
    return sorted((tuple(r) for r in out.collect()), key=str), [c.tolist() for c in centroids], calculated


@pytest.mark.parametrize("seed, spread", [(1, 1.0), (2, 0.02), (3, 0.0)])
def test_brute_force(spark, seed, spread):
    # coarse values, so that ties are frequent; with no spread whole clusters are one vector
    rng = np.random.default_rng(seed)
    middle = rng.integers(-3, 4, (9, 64)) / 64
    rows = [(int(i), [float(x) for x in middle[i % 9] + np.round(rng.normal(0, spread, 64) * 64) / 64]) for i in range(150)]
    got, centroids, calculated = found(spark, rows)
    want, wanted = plain(rows)
    assert got == want and centroids == wanted
    assert calculated[0] == 150 * 16


def test_bounds_skip_work(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, (16, 64))
    rows = [(int(i), [float(x) for x in np.float32(middle[i % 16] + rng.normal(0, 0.01, 64))]) for i in range(640)]
    got, _, calculated = found(spark, rows, rounds=5)
    assert got == plain(rows, rounds=5)[0] and sum(calculated[1:]) < 0.5 * sum(calculated)


def test_sql(spark, sf):
    assert flat(op12.op12_centroid_clustering(spark, sf).toPandas()) == flat(run(op12.ORACLE, sf))


def test_odd_tables(spark):
    one, two = [0.5] * 64, [-0.25] * 63 + [1e5]
    rows = [(1, one), (1, one), (1, two), (2, None), (3, []), (4, [1.0] * 63), (5, [*one[:-1], None]), (6, [*one[:-1], float("nan")]), (7, [*one[:-1], float("inf")]), (None, two), (8, [0.0] * 64)]
    got, centroids, _ = found(spark, rows)
    assert (got, centroids) == plain(rows)
    assert len(got) == 5 and all(d == 0 for _, _, d in got)
    assert [r[0] for r in found(spark, [*rows, (9, [3e7] * 64)])[0]].count(9) == 0  # its squares fit no long
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op12.elkan_clusters(empty)[0].count() == 0
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit("x").alias(c) for c in ("x", "mine", "upper", "cluster", "distance")])
    assert sorted(map(str, op12.elkan_clusters(clash)[0].collect())) == sorted(map(str, op12.elkan_clusters(clash.select("vec_id", "embedding"))[0].collect()))


def test_query_columns(spark, sf):
    out = op12.op12_centroid_clustering(spark, sf)
    assert out.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
