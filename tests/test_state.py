"""Conversations round by round, review schedules as state, overlapping spans, nearest vectors of a source, places in an order."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import conversation, ordering, overlap, schedule, tools, writing
from lectern.sources.shared import shared_folder
from lectern.streaming import reviews

from .conftest import rows


@pytest.mark.parametrize("seed, cell", [(1, 7), (2, 64)])
def test_overlaps_brute_force(spark, seed, cell, capsys):
    r = random.Random(seed)
    spans = lambda n: [(i, r.choice("ab"), (s := r.randint(0, 300)), s + r.choice((0, 1, 5, 40, 200))) for i in range(n)]
    left, right = spans(60), spans(40)
    a = spark.createDataFrame([*left, (99, None, 1, 5), (98, "a", 9, 2), (97, "a", None, 3)], "id long, doc string, start int, end int")
    b = spark.createDataFrame(right, "label long, doc string, span_start int, span_end int")
    out = overlap.overlapping(a, b, "doc", cell=cell)
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < y[3] and x[3] > y[2])
    assert sorted(rows(out.select("id", "label"))) == want
    out.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_of_a_source_is_shared_out(spark):
    rng = np.random.default_rng(3)
    data = [(i, "big" if i % 3 else f"s{i % 5}", [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    odd = [(200, "big", None), (201, "big", [0.0] * 6), (202, None, [1.0] * 6), (203, "alone", [1.0] * 6), (204, "big", [1.0, 2.0])]
    df = spark.createDataFrame(data + odd, "id long, source string, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in data}
    want = {i: max((float(unit[i] @ unit[j]) for j, t, _ in data if j != i and t == s), default=None) for i, s, _ in data}
    for block in (7, 2048):
        got = {r.id: r.nearest for r in overlap.nearest_in_source(df, df, "id", "source", other="id", block=block).collect()}
        assert len(got) == 125 and all(got[i] is None for i in (200, 201, 202, 203, 204))
        assert all((got[i] is None) == (w is None) and (w is None or abs(got[i] - w) < 1e-12) for i, w in want.items())
    kept = spark.createDataFrame([(True, None), (False, 0.9), (False, 0.8), (None, None)], "lexical boolean, c double").select(overlap.supported(F.col("lexical"), F.col("c"), 0.84))
    assert [r[0] for r in kept.collect()] == [True, True, False, False]


def test_places_in_an_order(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(100)], "a long, b long").repartition(5)
    assert [tuple(r) for r in ordering.numbered(df, "a", "b").orderBy("place").select("a", "place").collect()] == [(a, k + 1) for k, a in enumerate(sorted(i * 7 % 101 for i in range(100)))]


def script(prompt: str) -> str | None:
    """A model whose replies depend on the history alone."""
    said = json.loads(prompt)
    task, heard = said[0]["content"], sum(m["role"] == "tool" for m in said)
    if "don't fit" in said[-1]["content"]:
        return '{"expression": "2 * 3"}' if "mend" in task else "no"
    if task.startswith("lost") and said[-1]["role"] == "user" and not ("once" in task and len(said) > 1):
        return None
    if "endless" in task or heard < int(task.split()[-1]):
        bad = "mend" in task or "wrong" in task
        two = '<tool_call>{"name": "calculate", "arguments": {"expression": "1 + 1"}}</tool_call><tool_call>{"name": "dance", "arguments": {}}</tool_call>'
        return two if "two" in task else "<tool_call>" + json.dumps({"name": "calculate", "arguments": {"text": 1} if bad else {"expression": f"{heard} + 1"}}) + "</tool_call>"
    return f"<think>so</think> after {heard}"


def by_hand(task: str):
    """One conversation, row by row: (steps, retries, stopped, answer, [(name, content)], filled)."""
    history, results, retries, filled = [{"role": "user", "content": task}], [], 0, 0
    for step in range(1, 7):
        reply = script(json.dumps(history))
        if reply is None:
            if retries:
                return step, retries, "failed", None, results, filled
            retries = 1
            history = [*history, {"role": "user", "content": conversation.AGAIN}]
            continue
        calls = [json.loads(x.split("</tool_call>")[0]) for x in reply.split("<tool_call>")[1:]]
        if not calls:
            return step, retries, "answered", reply.split("</think>")[-1].strip(), results, filled
        turn = [{"role": "assistant", "content": reply}]
        for c in calls:
            args, fault = c["arguments"], None
            if c["name"] not in tools.TOOLS:
                fault = "unknown tool " + c["name"]
            elif set(args) != {"expression"}:
                fault = "expression: missing; text: not a parameter"
                given = script(json.dumps([*history, {"role": "user", "content": f"The arguments of calculate don't fit ({fault}). Give its arguments again as JSON, from what was said here."}]))
                if given != "no":
                    args, fault, filled = json.loads(given), None, filled + 1
            content = f"error: {fault}" if fault else f"value of {args['expression']}"
            results.append((c["name"], content))
            turn.append({"role": "tool", "content": content})
        history += turn
    return 6, retries, "max_steps", None, results, filled


TASKS = ["plain 0", "plain 2", "two calls 4", "mend 1", "wrong 2", "endless 1", "endless mend 1", "lost 1", "lost once 2", "plain 5", "plain 6"]


def test_rounds_equal_conversations_one_by_one(spark):
    asked = []

    @F.pandas_udf("string")
    def model(p: pd.Series) -> pd.Series:
        return p.map(script)

    def run(calls):
        asked.append(calls.where("name <> 'calculate'").count())
        return calls.select("conv_id", "i", F.concat(F.lit("value of "), F.get_json_object("arguments", "$.expression")).alias("content"))

    df = spark.createDataFrame([(i, [("user", t)]) for i, t in enumerate(TASKS)], f"conv_id long, history {conversation.HISTORY}").repartition(3)
    folder = shared_folder(spark)
    got = conversation.converse(df, model, run, folder).collect()
    assert len(got) == len(TASKS) and sum(asked) == 0  # unknown tools are never run
    for r in got:
        steps, retries, stopped, answer, results, filled = by_hand(TASKS[r.conv_id])
        assert (r.steps, r.retries, r.stopped, r.answer) == (steps, retries, stopped, answer), TASKS[r.conv_id]
        assert [(c.name, c.content) for c in r.results] == results and sum(c.filled for c in r.results) == filled
    # what is written is not asked for again

    def silent(p):
        return F.raise_error(F.lit("asked again")).cast("string")

    again = conversation.converse(df, silent, run, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert conversation.converse(df.limit(0), model, run, shared_folder(spark)).count() == 0


def test_blank_answers_never_reach_the_model(spark):
    @F.pandas_udf("string")
    def model(p: pd.Series) -> pd.Series:
        if p.str.contains("BLANK").any():
            raise ValueError("a blank answer was sent")
        return p.map(lambda _: '{"points_met": [true], "feedback": "fine"}')

    answers = spark.createDataFrame([(1, "q", ["a"], "words", 2), (2, "q BLANK", ["a"], "  ", 2), (3, "q BLANK", ["a"], None, 2), (4, "q BLANK", [], "words", 2)], "id long, question string, marking_points array<string>, answer string, most int")
    got = {r.id: (r.awarded, r.feedback) for r in writing.grade_answers(answers, model, "id").collect()}
    assert got == {1: (2, "fine"), 2: (0, "No answer was given."), 3: (0, "No answer was given."), 4: (0, "No answer was given.")}


def test_review_stream_equals_the_batch_schedule(spark, tmp_path):
    r = random.Random(5)
    attempts = [(f"q{r.randint(0, 7)}", i, f"2024-0{r.randint(1, 6)}-{r.randint(10, 28)} {r.randint(10, 20)}:00:00", r.randint(1, 4)) for i in range(60)]
    df = spark.createDataFrame(attempts, "question string, id long, at string, grade int").select("question", "id", F.to_timestamp("at").alias("answered_at"), "grade")
    want = {r.question: (r.reviews, r.stability, r.difficulty, r.due_at) for r in schedule.schedule(df, "question").collect()}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", reviews.PROVIDER)
    try:
        for n, late in ((1, "0 seconds"), (3, "200 days")):  # in one batch, and in three that are out of order, stopped and gone on with in between
            path, out, at = (str(tmp_path / f"{n}-{x}") for x in ("in", "out", "at"))

            def go(path=path, out=out, at=at, late=late):
                stream = reviews.review_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), late)
                query = stream.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}")).option("checkpointLocation", at).outputMode("update").trigger(availableNow=True).start()
                query.awaitTermination()

            for k in range(n):
                df.where(F.col("id") % n == k).coalesce(1).write.mode("append").parquet(path)
                go()
            states = spark.read.parquet(out).where("kind = 'state'")
            last = {r.question: (r.reviews, r.stability, r.difficulty, r.due_at) for r in states.withColumn("r", F.expr("row_number() over (partition by question order by b desc)")).where("r = 1").collect()}
            assert last == want
            due = spark.read.parquet(out).where("kind = 'due'")
            assert sorted(r.question for r in due.collect()) == (sorted(q for q, w in want.items() if w[3] < df.agg(F.max("answered_at")).first()[0]) if n == 1 else [])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
