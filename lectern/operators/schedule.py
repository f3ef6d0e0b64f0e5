"""Spaced repetition: the published FSRS-6 memory model, folded over each question's attempts in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published default parameters of FSRS-6.
W = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
RETENTION, LONGEST_DAYS, LEAST = 0.9, 36_500, 0.001
DECAY = -W[20]
FACTOR = 0.9 ** (1 / DECAY) - 1
GRADES = {"again": 1, "hard": 2, "good": 3, "easy": 4}
STATE = "struct<stability:double,difficulty:double,last:timestamp>"


def _clamp(d: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), d))


def first_difficulty(g: Column) -> Column:
    return W[4] - F.exp(W[5] * (g - 1)) + 1


def next_difficulty(d: Column, g: Column) -> Column:
    moved = d - W[6] * (g - 3) * (10 - d) / 9
    easy = W[4] - math.exp(W[5] * 3) + 1
    return _clamp(W[7] * easy + (1 - W[7]) * moved)


def next_stability(s: Column, d: Column, days: Column, g: Column) -> Column:
    """Stability after a review ``days`` whole days later; a review on the same day follows the short-term rule."""
    soon = F.exp(W[17] * (g - 3 + W[18])) * F.pow(s, F.lit(-W[19]))
    r = F.pow(1 + FACTOR * days / s, F.lit(DECAY))
    weight = F.when(g == 2, W[15]).when(g == 4, W[16]).otherwise(1.0)
    kept = s * (1 + math.exp(W[8]) * (11 - d) * F.pow(s, F.lit(-W[9])) * (F.exp((1 - r) * W[10]) - 1) * weight)
    lost = W[11] * F.pow(d, F.lit(-W[12])) * (F.pow(s + 1, F.lit(W[13])) - 1) * F.exp((1 - r) * W[14])
    lost = F.least(lost, s / math.exp(W[17] * W[18]))
    later = F.when(g == 1, lost).otherwise(kept)
    return F.greatest(F.lit(LEAST), F.when(days < 1, s * F.when(g >= 3, F.greatest(soon, F.lit(1.0))).otherwise(soon)).otherwise(later))


def interval_days(s: Column) -> Column:
    days = F.bround(s / FACTOR * (RETENTION ** (1 / DECAY) - 1))
    return F.greatest(F.lit(1), F.least(F.lit(LONGEST_DAYS), days.cast("int")))


def memory(reviews: Column) -> Column:
    """State after ``reviews``, an array of (at, id, grade) in order; no learning steps, no fuzz."""

    def step(a: Column, x: Column) -> Column:
        g = x["grade"].cast("double")
        days = F.greatest(F.lit(0), F.floor((x["at"].cast("double") - a["last"].cast("double")) / 86400))
        fresh = a["last"].isNull()
        first = F.element_at(F.array(*map(F.lit, W[:4])), x["grade"])
        s = F.when(fresh, first).otherwise(next_stability(a["stability"], a["difficulty"], days, g))
        d = F.when(fresh, _clamp(first_difficulty(g))).otherwise(next_difficulty(a["difficulty"], g))
        return F.struct(s.alias("stability"), d.alias("difficulty"), x["at"].alias("last")).cast(STATE)

    start = F.struct(F.lit(None).alias("stability"), F.lit(None).alias("difficulty"), F.lit(None).alias("last")).cast(STATE)
    return F.aggregate(F.array_sort(reviews), start, step)


def schedule(attempts: DataFrame, *key: str, places: int = 4) -> DataFrame:
    """(key..., reviews, stability, difficulty, due_at) of ``attempts`` (key..., id, answered_at, grade).

    One learner's history of one question is a sequence by nature and is folded whole:
    its rows are three numbers each. Attempts without a time or grade don't count.
    """
    a = attempts.where("answered_at is not null and grade between 1 and 4")
    s = a.groupBy(*key).agg(F.collect_list(F.struct(F.col("answered_at").cast("timestamp").alias("at"), "id", F.col("grade").cast("int").alias("grade"))).alias("x"))
    s = s.select(*key, F.size("x").cast("long").alias("reviews"), memory(F.col("x")).alias("m"))
    due = F.col("m.last") + F.make_dt_interval(interval_days(F.col("m.stability")))
    return s.select(*key, "reviews", F.bround("m.stability", places).alias("stability"), F.bround("m.difficulty", places).alias("difficulty"), due.alias("due_at"))
