"""Answer attempts: latest, due, mastery, weak topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(attempts: DataFrame, *key: str) -> DataFrame:
    """The last attempt at each question: an aggregation with map-side maxima, no window."""
    rest = [c for c in attempts.columns if c not in key]
    return attempts.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("id")).alias("x")).select(*key, "x.*")


def due(attempts: DataFrame, now: Column, *key: str) -> DataFrame:
    """Questions whose last attempt lost marks and is due."""
    return latest(attempts, *key).where((F.col("awarded") < F.col("most")) & (F.col("due_at") <= now))


def mastery(attempts: DataFrame, *by: str) -> DataFrame:
    """(by..., attempts, awarded, most, score) over the last attempt at each question."""
    g = attempts.groupBy(*by).agg(F.count("*").alias("attempts"), F.sum("awarded").alias("awarded"), F.sum("most").alias("most"))
    return g.withColumn("score", F.when(F.col("most") > 0, F.bround(F.col("awarded") / F.col("most"), 4)).otherwise(0.0))


def weak_topics(mastered: DataFrame, weights: DataFrame | None, by: str, limit: int = 10) -> DataFrame:
    """Topics by weight * (1 - score), positive ones only; without weights each counts 1."""
    m = mastered.withColumn("weight", F.lit(1.0)) if weights is None else mastered.join(weights, by, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    m = m.withColumn("priority", F.bround(F.col("weight") * (1 - F.col("score")), 4)).where("priority > 0")
    return m.orderBy(F.desc("priority"), by).limit(limit).select(by, "score", "weight", "priority")


def marks_for(met: Column, points: Column, most: Column) -> Column:
    """Half-even rounding of the share of marking points met."""
    return F.when(points == 0, 0).otherwise(F.bround(most * met / points)).cast("int")


def rating(awarded: Column, most: Column) -> Column:
    return F.when(awarded >= most, "good").when(awarded * 2 >= most, "hard").otherwise("again")
