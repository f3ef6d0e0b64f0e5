"""Joins that aren't on equal keys: overlapping spans, and the nearest vector within a source. No nested loops, no group whole in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 256
BLOCK = 2048


def overlapping(left: DataFrame, right: DataFrame, *key: str, cell: int = CELL, left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("span_start", "span_end")) -> DataFrame:
    """Pairs of rows of equal ``key`` whose half-open spans overlap: start < other end and end > other start.

    Spans are dealt into cells of ``cell`` units, a long one into several; rows meet where key and cell are
    equal, and a pair counts in the first cell that both have. Spans that end before they start, or with
    a null, overlap nothing; one of no length overlaps those that hold its place within. Column names must differ but for ``key``.
    """

    def dealt(rows: DataFrame, start: str, end: str) -> DataFrame:
        first, last = F.floor(F.col(start) / cell), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / cell)
        return rows.where(F.col(start) <= F.col(end)).withColumn(f"_first_{start}", first).withColumn("_cell", F.explode(F.sequence(first, last)))

    a, b = dealt(left, *left_span), dealt(right, *right_span)
    met = a.join(b, [*key, "_cell"])
    once = F.col("_cell") == F.greatest(f"_first_{left_span[0]}", f"_first_{right_span[0]}")
    truly = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(left_span[1]) > F.col(right_span[0]))
    return met.where(once & truly).drop("_cell", f"_first_{left_span[0]}", f"_first_{right_span[0]}")


def nearest_in_source(rows: DataFrame, among: DataFrame, key: str, source: str, vector: str = "embedding", other: str | None = None, block: int = BLOCK) -> DataFrame:
    """(key, nearest): for each of ``rows`` (key, source, vector) the highest cosine with any vector of its source in ``among``, null without any.

    Both sides of a source are dealt into blocks of at most about ``block`` vectors, and each pair of blocks is one
    product in a task of its own, so a source of any size is shared out and memory is bounded; the maxima
    are merged. With ``other``, a column of ``among``, a row isn't compared with the vector of its own key. Vectors
    that are null, zero or hold nulls or what isn't finite have no cosine; those of another length aren't compared.
    """
    v = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)

    def dealt(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        side = side.where(sound & F.col(source).isNotNull()).select(F.col(source).alias("s"), F.size(vector).alias("dim"), F.col(name).cast("long").alias("k"), v.alias("v"))
        return side, side.groupBy("s", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))

    mine, n_mine = dealt(rows.where(F.col(key).isNotNull()), key)
    theirs, n_theirs = dealt(among, other or key) if other or key in among.columns else dealt(among.withColumn("_none", F.lit(None).cast("long")), "_none")
    sizes = n_mine.join(n_theirs.withColumnRenamed("n", "m"), ["s", "dim"])  # a row for each source and length
    own = lambda n: F.pmod(F.xxhash64("k", "v"), F.col(n)).cast("int")
    left = mine.join(sizes, ["s", "dim"]).withColumn("i", own("n")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    right = theirs.join(sizes, ["s", "dim"]).withColumn("j", own("m")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    group = F.xxhash64("s", "dim", "i", "j")
    same = other is not None

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"k": pa.array([], pa.int64()), "nearest": pa.array([], pa.float64())})
        x, y = (np.array(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(t.num_rows, -1) for t in (a, b))
        x, y = (m / np.abs(m).max(1, keepdims=True) for m in (x, y))
        c = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ (y / np.sqrt((y * y).sum(1, keepdims=True))).T
        if same:
            c = np.where(a["k"].to_numpy()[:, None] == b["k"].to_numpy(zero_copy_only=False)[None, :], -np.inf, c)
        top = c.max(1)
        fine = np.isfinite(top)
        return pa.table({"k": pa.array(a["k"].to_numpy()[fine], pa.int64()), "nearest": pa.array(top[fine], pa.float64())})

    met = left.select(group.alias("g"), "k", "v").groupBy("g").cogroup(right.select(group.alias("g"), "k", "v").groupBy("g")).applyInArrow(best, "k long, nearest double")
    return rows.select(key).join(met.groupBy(F.col("k").alias(key)).agg(F.max("nearest").alias("nearest")), key, "left")


def supported(lexical, nearest, threshold: float):
    """Whether a sentence is kept: its words are in the source, or a sentence of the source is near enough."""
    return F.coalesce(lexical, F.lit(False)) | F.coalesce(nearest >= threshold, F.lit(False))
