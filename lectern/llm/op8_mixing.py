"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document's copies are ``target / source_size``: a whole part, the same for all
documents of its source, and a fractional part, which the pivotal method rounds.
Two documents meet and words move from one to the other, at random in either
direction, until a fraction has become 0 or 1; the odds keep both expectations and
the words of the two stay the same in sum. The one left with a fraction meets the
next. So a block of documents ends with one fraction at most; those left over of all
blocks of a source meet again in blocks, level after level (a reduction tree of depth
log N to the base ``block``), until one per source is left, which is drawn on its
own. The words taken of a source miss its target by less than that one document.

A level is one aggregation on (source, block); a source with a third of all rows has
a third of the blocks, and each is of bounded size. Draws are hashes of the document,
level and seed, so reruns agree.

Sources are few against documents, yet no step needs them in one place: ranks come
from a range partitioning and the water level from a handful of aggregations.

Null texts have size 0; documents of size 0 take nothing. A null source comes last.
Repeated rows are documents of their own. A null ``doc_id`` is kept. An empty table gives
an empty result. Only doc_id, text and source are read, so other columns may have any
names. Documents of equal size differ by the hash of id, text and source alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, attach, staged

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0


def tie(of: str = "") -> Column:
    """With doc_id, what names a row (of the alias ``of``): a hash of text and source."""
    return F.xxhash64(*[F.coalesce(F.col(of + c), F.lit("\0null")) for c in ("text", "source")])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def ranked(keys: DataFrame, column: str) -> DataFrame:
    """Adds ``rank`` from 0 by code point, null last, without a global window."""
    null_last = F.col(column).isNull()
    spread = keys.repartitionByRange(F.asc(null_last), F.asc(column)) if keys.count() else keys
    spread = spread.sortWithinPartitions(F.asc(null_last), F.asc(column))
    spread = staged(spread.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    parts = spread.groupBy("_p").agg(F.count("*").alias("n"))
    before = parts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))
    return spread.join(F.broadcast(before), "_p").withColumn("rank", (F.col("_before") + F.col("_i")).cast("long")).drop("_p", "_i", "_before")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of the whole by weight, none above ``cap`` times its size.

    What a capped source can't take is shared by weight among the others. The level
    rises until no further source is capped; each round is one aggregation.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = staged(ranked(sources, "source").withColumn("weight", w).withColumn("most", F.col("source_size") * cap))
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level = total / (s.agg(F.sum("weight")).first()[0] or 1.0)
    while True:
        capped = F.col("most") < F.col("weight") * level
        full, free, n = s.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        new = (total - (full or 0.0)) / free if free else level
        if not n or new <= level:
            break
        level = new
    return s.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * level)).drop("rank", "weight", "most")


def _meet(p: Column, item: Column, level: int, seed: int) -> Column:
    """Fold step: the document in hand (h, hp) meets ``item``; the settled one goes to ``out`` as (doc, 0 or 1)."""
    hp, q, a, b = p["hp"], item["p"], p["h"]["size"], item["size"]
    u = F.xxhash64(item["doc_id"], item["tie"], F.lit(level), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    room, mass, other_room, other = a * (1.0 - hp), a * hp, b * (1.0 - q), b * q
    up, down = F.least(room, other), F.least(mass, other_room)
    rises = u * (up + down) < down  # the odds that keep both expectations
    settles = F.when(rises, room <= other).otherwise(mass <= other_room)
    one = F.when(rises == settles, F.lit(1)).otherwise(F.lit(0))
    moved = F.when(rises, up).otherwise(-down)
    left = F.when(settles, q - moved / b).otherwise(hp + moved / a)
    done = F.when(settles, p["h"]).otherwise(item)
    kept = F.when(settles, item).otherwise(p["h"])
    settled = F.struct(done["doc_id"].alias("doc_id"), done["tie"].alias("tie"), one.alias("one"))
    return F.struct(kept.alias("h"), F.least(F.greatest(left, F.lit(0.0)), F.lit(1.0)).alias("hp"), F.concat(p["out"], F.array(settled)).alias("out"))


def _step(level: int, seed: int):
    return lambda p, item: _meet(p, item, level, seed)


def pivotal(rows: DataFrame, groups: Sequence[str], block: int = 512, seed: int = 11, edge: float = 1e-9) -> DataFrame:
    """(doc_id, tie, one): ``one`` is 1 with probability ``p`` for each row, by dependent rounding within ``groups``.

    ``rows`` has doc_id, tie, size, p and the columns of ``groups``; sizes of rows with
    0 < p < 1 are positive.
    """
    g = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(c) for c in groups]
    now = rows.select("doc_id", "tie", "size", "p", F.xxhash64(*g).alias("g"))
    out = None
    for level in count():  # each level leaves a row of a block at most, so few are needed and the last leaves one of each group
        sure = now.where(f"p <= {edge} or p >= 1 - {edge}").select("doc_id", "tie", F.round("p").cast("int").alias("one"))
        out = sure if out is None else out.union(sure)
        now = now.where(f"p > {edge} and p < 1 - {edge}")
        per = staged(now.groupBy("g").agg(F.count("*").alias("n")))
        if (per.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        slot = F.pmod(F.xxhash64("doc_id", "tie", F.lit(level + 1000 * seed)), F.ceil(F.col("n") / block))
        packed = attach(now, per, "g").withColumn("b", slot).groupBy("g", "b").agg(F.sort_array(F.collect_list(F.struct("size", "tie", "doc_id", "p")), asc=False).alias("items"))
        first = F.element_at("items", 1)
        start = F.struct(first.alias("h"), first["p"].alias("hp"), F.array().cast("array<struct<doc_id:bigint,tie:bigint,one:int>>").alias("out"))
        met = packed.withColumn("r", F.aggregate(F.slice("items", 2, F.size("items")), start, _step(level, seed)))
        met = staged(met.select("g", F.col("r.h").alias("h"), F.col("r.hp").alias("hp"), F.col("r.out").alias("out")))
        out = out.union(met.select(F.explode("out").alias("x")).select("x.doc_id", "x.tie", "x.one"))
        now = met.select("h.doc_id", "h.tie", "h.size", F.col("hp").alias("p"), "g")
    u = F.xxhash64("doc_id", "tie", F.lit(seed + 1)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return out.union(now.select("doc_id", "tie", (u < F.col("p")).cast("int").alias("one")))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 11) -> DataFrame:
    """(doc_id, tie, size, source, source_size, target, copies, taken) for every row of ``docs``.

    ``tie`` is a hash of text and source, which with doc_id names the row.
    """
    rows = staged(docs.select("doc_id", tie().alias("tie"), "source", word_count(F.col("text")).alias("size")))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    rows = attach(rows, sources, "source")
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor(share)).otherwise(0).cast("long"))
    rows = staged(rows.withColumn("p", F.when(F.col("size") > 0, share - F.col("whole")).otherwise(0.0)))
    ones = pivotal(rows, ["source"], seed=seed).groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list("one")).alias("ones")).alias("o")
    # rows that are equal in id, text and source share the draws made for them, one each
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("source"))).alias("r")
    both = numbered.join(ones, F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.tie") == F.col("o.tie")), "left")
    copies = F.col("r.whole") + F.coalesce(F.try_element_at("o.ones", F.col("r.k")), F.lit(0))
    return both.select("r.doc_id", "r.tie", "r.size", "r.source", "r.source_size", "r.target", copies.cast("long").alias("copies"), (copies * F.col("r.size")).cast("long").alias("taken"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", "taken")
