"""Shared pieces of the training-data operators.

Rows are identified by ``(doc_id, xxhash64(text))`` wherever a result has to be
joined back, so repeated ids with different texts stay apart and exactly
repeated rows share one verdict.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on this machine (tests) a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lectern-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def staged(df: DataFrame, *partition: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete what ``staged`` wrote, once nothing reads it any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/lectern-" in path:
                to = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                to.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(to, True)


def threshold(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of highest ``count``, as many of them as a least count can tell and ``most`` at most.

    The least count comes from a histogram of a few hundred rows, so nothing is sorted and
    only what passes travels, however many partitions there are.
    """
    n = F.col(count)
    step = F.when(n < 64, n.cast("double")).otherwise(F.floor(F.log2(n) * 16) + 1000.0)
    bins = df.groupBy(step.alias("bin")).agg(F.count("*").alias("rows"), F.min(count).alias("least")).collect()
    left, least = most, None
    for b in sorted(bins, key=lambda b: -b.bin):
        left -= b.rows
        if left < 0:
            break
        least = b.least
    return df.where(n >= least) if least is not None else df.where("false")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def row_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\0null")))


class WordHash(dict):
    """bytes -> 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 120_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public constants of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``k`` words; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return out


def spark_count(df: DataFrame, most: int) -> int | None:
    """The number of rows if it is ``most`` or less, else None; reads no more than it needs."""
    n = df.limit(most + 1).count()
    return n if n <= most else None


#: A table of keys up to this many rows is broadcast; a larger one is joined by salted shuffle.
BROADCAST_ROWS = 50_000


def attach(rows: DataFrame, table: DataFrame, key: str, salt: str = "doc_id", salts: int = 32, how: str = "inner") -> DataFrame:
    """Join a table with one row for each key: broadcast if its size is within the bound, else with the keys salted by ``salt``."""
    table = table.withColumnRenamed(key, "_k")
    if spark_count(table, BROADCAST_ROWS) is not None:
        return rows.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("_k")), how).drop("_k")
    salted = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_r", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    return rows.join(salted, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_s")), how).drop("_k", "_s", "_r")


def without(docs: DataFrame, bad: DataFrame, most: int = 300_000) -> DataFrame:
    """Rows of ``docs`` that ``bad`` (doc_id, key) doesn't name; no shuffle of texts while it names ``most`` rows or fewer."""
    names = bad.select("doc_id", "key").distinct()
    names = F.broadcast(names) if spark_count(names, most) is not None else names
    return docs.alias("_docs").join(names.alias("_bad"), _named("_docs", "_bad"), "left_anti")


def _named(docs: str, names: str) -> Column:
    """Whether a row of (doc_id, text) is the one that (doc_id, key) names; no column is added, so any other names will do."""
    return F.col(f"{docs}.doc_id").eqNullSafe(F.col(f"{names}.doc_id")) & (row_key(f"{docs}.text") == F.col(f"{names}.key"))


def once(docs: DataFrame) -> DataFrame:
    """One row for each (doc_id, text); only rows that repeat are moved."""
    again = staged(docs.select("doc_id", row_key().alias("key")).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    if not again.limit(1).count():
        return docs
    repeated = docs.alias("_docs").join(again.alias("_names"), _named("_docs", "_names"), "left_semi").dropDuplicates(["doc_id", "text"])
    return without(docs, again).unionByName(repeated)


#: Edges up to this many: the table of their least neighbours is broadcast.
BROADCAST_EDGES = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` as (node, component), the smallest id reachable.

    Alternating large-star and small-star steps; every step is two aggregations with
    map-side minima and two joins that are broadcast (few edges) or salted (many), so a
    node with very many links never meets in one task whole. Each step is written to the
    shared folder and the one before it deleted. Nodes without edges are not returned.
    The number of steps grows with the logarithm of the longest path; if ``rounds`` don't
    do, it raises rather than return components in part.
    """

    def least(rows: DataFrame, low: DataFrame, few: bool) -> DataFrame:
        if few:
            return rows.join(F.broadcast(low), "u")
        salted = low.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(31))))
        return rows.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(32)).cast("int")).join(salted, ["u", "_s"]).drop("_s")

    e = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    previous, few = None, e.count() <= BROADCAST_EDGES
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour is hung on the smallest node around
        large = least(both.where("v > u"), low, few).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = least(down, low, few).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        old, e = e, staged(small.where("u <> v").distinct())
        dropped(old)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state == previous and state[0] == state[2]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        previous, few = state, state[0] <= BROADCAST_EDGES
    raise RuntimeError(f"components: not settled after {rounds} rounds")


def doc_batches(batches: Iterator, docs: int = 2000, most_bytes: int = 8 << 20) -> Iterator:
    """Arrow batches cut to a bounded number of rows and bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_binary(c.type) or pa.types.is_string(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + most_bytes
            to = min(at + docs, max(at + 1, int(np.searchsorted(ends, most, side="right"))), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
