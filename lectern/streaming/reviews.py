"""Review schedules kept as state of a stream: each question's memory, and a timer for when it comes due.

State holds the question's attempts (three numbers each), so the memory equals ``schedule.memory`` of the same attempts
however they fall into batches, and in whatever order they come within the time that late ones have. A timer of event time tells when the
watermark has passed the due time of a question that was not answered since.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.schedule import DECAY, FACTOR, LEAST, LONGEST_DAYS, RETENTION, W

OUT = "question string, kind string, reviews long, stability double, difficulty double, due_at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def reviewed(state: tuple[float, float, float] | None, at: float, grade: int) -> tuple[float, float, float]:
    """(stability, difficulty, last) after a review at ``at`` (seconds)."""
    within = lambda d: min(10.0, max(1.0, d))
    if state is None:
        return W[grade - 1], within(W[4] - math.exp(W[5] * (grade - 1)) + 1), at
    s, d, last = state
    days = max(0, math.floor((at - last) / 86400))
    if days < 1:
        rise = math.exp(W[17] * (grade - 3 + W[18])) * s ** -W[19]
        new = s * (max(rise, 1.0) if grade >= 3 else rise)
    else:
        r = (1 + FACTOR * days / s) ** DECAY
        if grade == 1:
            new = min(W[11] * d ** -W[12] * ((s + 1) ** W[13] - 1) * math.exp((1 - r) * W[14]), s / math.exp(W[17] * W[18]))
        else:
            new = s * (1 + math.exp(W[8]) * (11 - d) * s ** -W[9] * (math.exp((1 - r) * W[10]) - 1) * {2: W[15], 4: W[16]}.get(grade, 1.0))
    moved = d - W[6] * (grade - 3) * (10 - d) / 9
    easy = W[4] - math.exp(W[5] * 3) + 1
    return max(LEAST, new), within(W[7] * easy + (1 - W[7]) * moved), at


def due_seconds(stability: float, last: float) -> float:
    days = round(stability / FACTOR * (RETENTION ** (1 / DECAY) - 1))
    return last + 86400 * max(1, min(LONGEST_DAYS, days))


class Reviews(StatefulProcessor):
    """Rows: question, id, answered_at, grade (1 to 4). Emits kind "state" for each change and "due" when a question comes due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("attempts", "at double, id long, grade int")

    def _row(self, key, kind: str) -> tuple[Row, float]:
        attempts = sorted((a[0], a[1], a[2]) for a in self.seen.get())
        state = None
        for at, _, grade in attempts:
            state = reviewed(state, at, grade)
        due = due_seconds(state[0], state[2])
        return Row(question=key[0], kind=kind, reviews=len(attempts), stability=round(state[0], 4), difficulty=round(state[1], 4), due_at=dt.datetime.fromtimestamp(due)), due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.answered_at.timestamp(), r.id, r.grade) for r in rows if r.answered_at is not None and r.grade in (1, 2, 3, 4)]
        if not new:
            return
        # a batch that is tried again brings what is there already
        held = {(a[0], a[1]) for a in self.seen.get()}
        for a in new:
            if (a[0], a[1]) not in held:
                self.seen.appendValue(a)
        out, due = self._row(key, "state")
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(due * 1000))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._row(key, "due")[0]

    def close(self) -> None:
        pass


def review_stream(attempts: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(question, kind, reviews, stability, difficulty, due_at) of a stream of attempts (question string, id, answered_at, grade).

    Needs the state store ``PROVIDER`` (``spark.sql.streaming.stateStore.providerClass``). Attempts of up to ``late`` before the
    newest seen are taken in any order; Spark leaves out older ones. Timers wait as long.
    """
    rows = attempts.select("question", "id", "answered_at", "grade").withWatermark("answered_at", late)
    return rows.groupBy("question").transformWithState(statefulProcessor=Reviews(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
