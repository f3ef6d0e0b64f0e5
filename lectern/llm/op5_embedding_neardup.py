"""Near duplicates among embeddings: Euclidean p-stable hashing, then exact cosines.

For unit vectors, cosine c means the distance sqrt(2 - 2c). Each of ``TABLES`` tables
hashes a vector by ``BITS`` projections on Gaussian directions, each shifted at random
and quantised to steps of ``STEP``; near vectors share a bucket in some table with
high probability (0.95 for a cosine of just 0.95, nearly 1 above 0.97). Pairs within a
bucket are compared exactly, in double precision.

A pair is counted in the first table whose bucket both share, so each pair counts
once without any list of pairs. A bucket is dealt in blocks of ``BLOCK`` vectors, and
each pair of blocks is one matrix product in a task of its own, so a bucket of any
size is shared out and memory stays bounded. A task returns for each of its vectors
the number of links and a label of the linked set it is in: rows in proportion to
vectors, never to pairs.

Equal vectors are one class from the start: they link with each other without being
compared, and their class goes through the tables once, with its number of members.
Vectors of each length are hashed and compared among themselves; the length is part
of the bucket. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing. Only its vector decides what a row links with: rows that repeat
a vec_id are vectors of their own, and a row without a vec_id links as any other. Such a
row can't name a component: its component is the smallest vec_id it reaches, or null, and
it is kept only where it reaches none. An empty table gives an empty result. Only vec_id and embedding are read, so
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, dropped, staged

TABLES, BITS, STEP, SEED = 18, 6, 1.0, 29
BLOCK = 1024
#: Members of small buckets that share a group.
GROUP = 2000
#: A vector that more rows than this repeat.
OFTEN = 1000


@lru_cache(maxsize=64)
def planes(dim: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, TABLES * BITS)), rng.uniform(0, STEP, TABLES * BITS)


def buckets(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """One 64-bit bucket for each row and table."""
    a, b = planes(x.shape[1], seed)
    q = np.floor((x @ a + b) / STEP).astype(np.int64).reshape(len(x), TABLES, BITS)
    h = np.zeros((len(x), TABLES), np.uint64)
    for i in range(BITS):
        h = (h ^ q[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _unit(rows: list, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(-1, dim)
    return x


def compare(ids: np.ndarray, times: np.ndarray, x: np.ndarray, keys: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows ``left`` against rows ``right``: (number of links, smallest linked row, itself included) by row."""
    s = x[left] @ x[right].T >= least
    for t in range(table):
        s &= keys[left, t][:, None] != keys[right, t][None, :]
    s &= left[:, None] != right[None, :]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, left, s @ times[right])
    label = np.arange(len(ids))
    rows, cols = np.nonzero(s)
    # hook each row to the smallest label around it until nothing changes
    while len(rows):
        new = label.copy()
        np.minimum.at(new, left[rows], label[right[cols]])
        np.minimum.at(new, right[cols], label[left[rows]])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return links, label


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    # 0.0 and -0.0 are one number
    rows = vectors.select("vec_id", F.when(sound, F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))).alias("v"))
    grouped = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("times"))
    # a class is named by a number of its own, written with it, as ids may repeat and may be null
    classes = staged(grouped.withColumn("rep", F.monotonically_increasing_id()))
    if classes.isEmpty():
        dropped(classes)
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column(0)).to_numpy()
            for dim in np.unique(length):
                part = batch.filter(pa.array(length == dim))
                x = np.array(part.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                keys = buckets(x)
                blob = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(np.full(len(x), dim, np.int32)), blob(x), blob(keys), pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64()))], ["rep", "times", "dim", "x", "keys", "buckets"])

    table = staged(classes.select("v", "rep", "times").mapInArrow(hashed, "rep long, times long, dim int, x binary, keys binary, buckets array<long>"))
    spread = table.select("rep", "dim", F.posexplode("buckets").alias("t", "bucket"))
    spread = spread.withColumn("b", F.xxhash64("dim", "t", "bucket"))
    sizes = staged(spread.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"))
    # a bucket's blocks: each vector is in one, and goes to every pair of blocks that holds it. Members of large
    # buckets are told their number before any of them meet; of the others at most BLOCK share a key
    told = staged(attach(spread, sizes.where(F.col("n") > BLOCK), "b", salt="rep", how="left"))
    few = told.where("n is null").drop("n").join(sizes.where(F.col("n") <= BLOCK), "b")
    member = told.where("n is not null").unionByName(few).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int"))
    meet = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("rep", "dim", "t", "bucket", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    meet = meet.join(table.select("rep", "times", "x", "keys"), "rep")
    # small buckets share a task's group, so there are not as many groups as buckets; a group's size stays the same as the table grows
    groups = max(256, table.count() * TABLES // GROUP)
    group = F.when(F.col("j") > 0, F.xxhash64("dim", "t", "bucket", "i", "j")).otherwise(F.pmod(F.xxhash64("dim", "t", "bucket"), F.lit(groups)))

    def links(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.lexsort([t["j"].to_numpy(), t["i"].to_numpy(), t["bucket"].to_numpy(), t["t"].to_numpy(), t["dim"].to_numpy()])
        t = t.take(pa.array(order))
        x, keys = t["x"].to_pylist(), np.frombuffer(b"".join(t["keys"].to_pylist()), np.uint64).reshape(-1, TABLES)
        cols = {c: t[c].to_numpy() for c in ("rep", "times", "dim", "t", "bucket", "mine", "i", "j")}
        change = np.ones(len(t), bool)
        change[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in ("dim", "t", "bucket", "i", "j")], axis=0)
        starts = np.append(np.nonzero(change)[0], len(t))
        out = ([], [], [])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            ids, mine = cols["rep"][a:b], cols["mine"][a:b]
            i, j, table_no = int(cols["i"][a]), int(cols["j"][a]), int(cols["t"][a])
            everyone = np.arange(b - a)
            left, right = (everyone, everyone) if i == j else (everyone[mine == i], everyone[mine == j])
            if not len(left) or not len(right):
                continue
            near = _unit(x[a:b], int(cols["dim"][a]))
            n, label = compare(ids, cols["times"][a:b], near, keys[a:b], table_no, left, right, least)
            if i != j:
                n += compare(ids, cols["times"][a:b], near, keys[a:b], table_no, right, left, least)[0]
            hit = n > 0
            out[0].append(ids[hit])
            out[1].append(n[hit])
            out[2].append(ids[label[hit]])
        flat = [np.concatenate(o) if o else np.empty(0, np.int64) for o in out]
        return pa.table({"rep": pa.array(flat[0], pa.int64()), "n": pa.array(flat[1], pa.int64()), "near": pa.array(flat[2], pa.int64())})

    found = staged(meet.withColumn("grp", group).groupBy("grp").applyInArrow(links, "rep long, n long, near long"))
    dropped(sizes, told, table)
    count = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found.where("rep <> near"), "rep", "near")
    each = staged(classes.join(count, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").select("v", "times", "least_id", F.coalesce("component", "rep").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    # the component's name: the smallest id of any of its rows
    linked = staged(attach(each, each.groupBy("c").agg(F.min("least_id").alias("component_id")), "c", salt="n_links", salts=8).select("v", "times", "n_links", "component_id"))
    dropped(classes, found, each)
    # vectors that very many rows repeat are told apart first, so that no key gathers their rows
    often = attach(rows, linked.where(F.col("times") > OFTEN).drop("times"), "v", salt="vec_id", salts=8, how="left")
    rest = often.where("n_links is null").select("vec_id", "v").join(linked.where(F.col("times") <= OFTEN).drop("times"), "v", "left")
    out = often.where("n_links is not null").unionByName(rest)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op5_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
         WHERE e IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
         WHERE a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN comp ON comp.a = v.vec_id
"""
