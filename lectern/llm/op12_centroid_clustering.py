"""Clusters of integer vectors by k-means with Elkan's bounds, exact to the last unit.

Every vector keeps, from one assignment to the next, its centroid, an upper bound on the
distance to it and a lower bound on the distance to each of the ``k`` centroids. When
centroids have moved, the bounds move by as much, and by the triangle inequality

* a vector whose upper bound is under half the distance from its centroid to the nearest
  other one is left as it is: nothing is calculated for it;
* of the others, a centroid is skipped where its lower bound, or half its distance to the
  vector's centroid, is over the upper bound.

All squared distances are whole numbers, so they are exact; bounds are their roots, rounded
up or down on the safe side (``_up``, ``_down``), and a centroid is skipped only where it is
*strictly* farther. So a tie is always calculated and goes to the smaller number, and the
result equals that of calculating everything.

The state of all vectors is a table in the shared folder (id, whole components, centroid,
bounds), written anew by each round, after which the one before is deleted: a lost
executor's share is made again from the last one. Vectors never move between tasks;
a round shuffles one row of sums for each task and centroid, whatever the clusters' sizes,
and sends ``k`` centroids back.

Kept are vectors of exactly ``dim`` components, none null or non-finite. A component of
2^26 or more after scaling has no squared distance that surely fits a long; such vectors
are not kept either. With fewer than ``k`` kept vectors there are as many centroids as
vectors; with none the result is empty. A null vec_id comes last in the order of the
first centroids; equal ids come in the order of their components. Rows that repeat an id,
or whole rows, are vectors of their own. Columns besides vec_id and embedding may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

SCALE, LIMIT = 64, 1 << 26
_SLACK = 1e-6


def _up(x):
    """A float32 that is surely no less than ``x``."""
    return np.nextafter((np.asarray(x, np.float64) * (1 + _SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x):
    """A float32 that is surely no more than ``x``, and not below 0."""
    return np.maximum(np.nextafter((np.asarray(x, np.float64) * (1 - _SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from ``c``."""
    d = x.astype(np.int64) - c
    return (d * d).sum(-1)


def assign(x: np.ndarray, centroids: np.ndarray, mine: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None, moved: np.ndarray | None = None):
    """One assignment: (centroid, upper bound, lower bounds, number of distances calculated).

    ``mine``, ``upper`` and ``lower`` are those of the assignment before, ``moved`` says how far
    each centroid has gone since, rounded up; without them every distance is calculated.
    """
    n, k = len(x), len(centroids)
    if mine is None:
        all_ = np.stack([squared(x, c) for c in centroids], 1) if k else np.empty((n, 0), np.int64)
        mine = all_.argmin(1).astype(np.int32)  # the first of equal ones
        return mine, _up(np.sqrt(all_[np.arange(n), mine])), _down(np.sqrt(all_)), n * k
    between = np.sqrt(np.stack([squared(centroids, c) for c in centroids], 1).astype(np.float64))
    half = _down(between / 2)
    np.fill_diagonal(half, np.inf)
    mine, upper = mine.copy(), _up(upper.astype(np.float64) + moved[mine])
    lower = _down(lower.astype(np.float64) - moved)
    open_ = np.nonzero(upper >= half.min(1)[mine])[0]
    if not len(open_):
        return mine, upper, lower, 0
    xs, a, low = x[open_], mine[open_], lower[open_]
    best = squared(xs, centroids[a])
    up = _up(np.sqrt(best))
    low[np.arange(len(a)), a] = _down(np.sqrt(best))
    done = len(a)
    for c in range(k):
        ask = np.nonzero((a != c) & ~(low[:, c] > up) & ~(half[a, c] > up))[0]
        if not len(ask):
            continue
        d = squared(xs[ask], centroids[c])
        done += len(ask)
        low[ask, c] = _down(np.sqrt(d))
        nearer = (d < best[ask]) | ((d == best[ask]) & (c < a[ask]))
        to = ask[nearer]
        a[to], best[to] = c, d[nearer]
        up[to] = _up(np.sqrt(d[nearer]))
    mine[open_], upper[open_], lower[open_] = a, up, low
    return mine, upper, lower, done


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _blobs(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _pack(x: np.ndarray) -> pa.Array:
    """Whole components as bytes that sort as the components do."""
    return _blobs((x.astype(np.int64) + (1 << 31)).astype(">u4"))


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    return _rows(column, ">u4", dim).astype(np.int64) - (1 << 31)


_STATE = "vec_id long, x binary, mine int, upper float, lower binary, done long"


def _state(ids, x, mine, upper, lower, done: int) -> pa.RecordBatch:
    times = np.zeros(len(mine), np.int64)
    times[:1] = done
    return pa.RecordBatch.from_arrays([ids, x, pa.array(mine, pa.int32()), pa.array(upper, pa.float32()), _blobs(lower), pa.array(times)], ["vec_id", "x", "mine", "upper", "lower", "done"])


def whole(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, x): kept vectors as packed whole numbers floor(scale * component)."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) >= LIMIT))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), _pack(np.floor(v * float(scale)))], ["vec_id", "x"])

    kept = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return staged(kept.mapInArrow(packed, "vec_id long, x binary"))


def first_centroids(rows: DataFrame, k: int, dim: int) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of "1:<vec_id>", in that order."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()
    return _unpack(pa.array([bytes(r.x) for r in found], pa.binary()), dim)


def moved_to(state: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """Each centroid's floor(sum / count) over its vectors; one without vectors stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            mine = batch.column(0).to_numpy()
            x = _unpack(batch.column(1), dim)
            np.add.at(count, mine, 1)
            for c in np.unique(mine):
                total[c] += x[mine == c].sum(0, dtype=np.int64)
        used = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["mine", "n", "total"])

    parts = state.select("mine", "x").mapInArrow(sums, "mine int, n long, total array<long>")
    each = parts.select("mine", "n", F.posexplode("total").alias("i", "s"))
    out = centroids.copy()
    for r in each.groupBy("mine", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k * dim rows
        out[r.mine, r.i] = int(r.s) // r.n
    return out


def elkan_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) of kept vectors, the final centroids, and how many distances each assignment calculated."""
    rows = whole(vectors, dim, scale)
    centroids = first_centroids(rows, k, dim)
    state, moved, calculated = None, None, []
    for at in range(rounds + 1):

        def step(batches: Iterator[pa.RecordBatch], centroids=centroids, moved=moved) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unpack(batch.column("x"), dim)
                if moved is None:
                    got = assign(x, centroids)
                else:
                    got = assign(x, centroids, batch.column("mine").to_numpy(), batch.column("upper").to_numpy(), _rows(batch.column("lower"), np.float32, len(centroids)), moved)
                yield _state(batch.column("vec_id"), batch.column("x"), *got)

        before = rows if state is None else state.drop("done")
        now = staged(before.mapInArrow(step, _STATE))
        dropped(rows if state is None else state)
        state = now
        calculated.append(state.agg(F.sum("done")).first()[0] or 0)
        if at < rounds:
            new = moved_to(state, centroids, dim)
            moved = _up(np.sqrt(squared(new, centroids).astype(np.float64))).astype(np.float64)
            centroids = new

    def exact(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(1)
            d = squared(_unpack(batch.column(2), dim), centroids[mine.to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column(0), mine, pa.array(d)], ["vec_id", "cluster", "distance"])

    out = staged(state.select("vec_id", "mine", "x").mapInArrow(exact, "vec_id long, cluster int, distance long"))
    dropped(state)
    return out, centroids, calculated


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found, centroids, _ = elkan_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row for each centroid
    inertia = {r.cluster: r.s for r in per}
    table = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    steps = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e FROM v QUALIFY c < {k})",
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(v.e, m.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := m.c)) AS b
      FROM v CROSS JOIN c{t} m GROUP BY r)""")
        if t < rounds:
            steps.append(f"""s{t} AS (SELECT a.b.c AS c, i, sum(v.e[i]) AS s, count(*) AS n FROM a{t} a JOIN v USING (r), range(1, {dim + 1}) AS g(i) GROUP BY ALL),
n{t} AS (SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS e FROM s{t} GROUP BY c),
c{t + 1} AS (SELECT m.c, coalesce(n{t}.e, m.e) AS e FROM c{t} m LEFT JOIN n{t} USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, a.b.c::INTEGER AS cluster, a.b.d AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.c))::BIGINT AS cluster_inertia,
       (sum(a.b.d) OVER ())::BIGINT AS inertia, sha256(list_aggregate(m.e, 'string_agg', ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} m ON m.c = a.b.c"""


ORACLE = _oracle()
