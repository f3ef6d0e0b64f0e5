"""Conversations with tools, many at once, round by round over tables.

A round is one batched call of the model for all open conversations. Replies without calls end theirs; calls
become rows, are checked against the tools' parameters, and those that don't fit are asked for once more in a
second batched call, which sees only them. Valid calls go to ``run``, a function from calls to results (a join
with a table, or operators of this library), and results come back into the history in the order of the calls.

Each round is written as a table of all conversations; a run that broke off goes on after the last whole round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import agent, tools

Model = Callable[[Column], Column]
Run = Callable[[DataFrame], DataFrame]
ROUNDS = 6
HISTORY = "array<struct<role:string,content:string>>"
CALL = "struct<i:int,name:string,arguments:string,fault:string,filled:boolean,content:string>"
STATE = f"conv_id long, history {HISTORY}, results array<{CALL}>, steps int, retries int, stopped string, answer string"
AGAIN = "The tool call in the last reply could not be read. Make it again, with less in its arguments."


def _said(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def one_round(state: DataFrame, model: Model, run: Run, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The open conversations of ``state`` a step further; ``keep`` writes a table under a name and reads it again, so no model is asked twice."""
    asked = keep(state.where("stopped is null").withColumn("reply", model(F.to_json("history"))), "replies")
    asked = asked.withColumn("calls", F.when(F.col("reply").isNotNull(), agent.text_calls(agent.strip_thinking(F.col("reply")))))
    steps = (F.col("steps") + 1).cast("int").alias("steps")
    # no reply: asked once more, then given up
    lost = asked.where("reply is null")
    first = F.col("retries") == 0
    lost = lost.select("conv_id", F.when(first, F.concat("history", F.array(_said("user", F.lit(AGAIN))))).otherwise(F.col("history")).alias("history"), "results", steps, F.when(first, 1).otherwise(F.col("retries")).cast("int").alias("retries"), F.when(~first, "failed").alias("stopped"), F.lit(None).cast("string").alias("answer"))
    done = asked.where("size(calls) = 0").select("conv_id", "history", "results", steps, "retries", F.lit("answered").alias("stopped"), agent.strip_thinking(F.col("reply")).alias("answer"))
    calling = asked.where("size(calls) > 0")
    calls = calling.select("conv_id", F.posexplode("calls").alias("i", "call")).select("conv_id", "i", "call.name", "call.arguments")
    named = [r.name for r in calls.where(F.col("name").isin(*tools.TOOLS)).select("name").distinct().collect()]  # as many as tools at most
    calls = keep(calls.withColumn("fault", tools.call_fault(F.col("name"), F.col("arguments"), named)), "faults")
    # calls of known tools that don't fit are asked for again, and only they
    wrong = calls.where(F.col("fault").isNotNull() & F.col("name").isin(*tools.TOOLS))
    if wrong.limit(1).count():
        request = F.concat(F.lit("The arguments of "), F.col("name"), F.lit(" don't fit ("), F.col("fault"), F.lit("). Give its arguments again as JSON, from what was said here."))
        prompt = F.to_json(F.concat("history", F.array(_said("user", request))))
        filled = keep(wrong.join(calling.select("conv_id", "history"), "conv_id").select("conv_id", "i", "name", model(prompt).alias("given")), "filled")
        filled = filled.where(tools.call_fault(F.col("name"), F.col("given"), named).isNull()).select("conv_id", "i", "given")
        calls = calls.join(filled, ["conv_id", "i"], "left")
    else:
        calls = calls.withColumn("given", F.lit(None).cast("string"))
    known = keep(calls.select("conv_id", "i", "name", F.coalesce("given", "arguments").alias("arguments"), F.when(F.col("given").isNull(), F.col("fault")).alias("fault"), F.col("given").isNotNull().alias("filled")), "calls")
    results = run(known.where("fault is null").select("conv_id", "i", "name", "arguments")).select("conv_id", "i", F.col("content").alias("got"))
    content = F.when(F.col("fault").isNotNull(), F.concat(F.lit("error: "), "fault")).otherwise(F.coalesce("got", F.lit("error: the tool gave nothing")))
    got = known.join(results, ["conv_id", "i"], "left").select("conv_id", F.struct("i", "name", "arguments", "fault", "filled", content.alias("content")).cast(CALL).alias("r"))
    got = got.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("turn"))  # the calls of one reply
    heard = F.transform("turn", lambda r: _said("tool", r["content"]))
    on = calling.join(got, "conv_id").select("conv_id", F.concat("history", F.array(_said("assistant", F.col("reply"))), heard).alias("history"), F.concat("results", "turn").alias("results"), steps, "retries", F.lit(None).cast("string").alias("stopped"), F.lit(None).cast("string").alias("answer"))
    return state.where("stopped is not null").unionByName(lost).unionByName(done).unionByName(on)


def converse(conversations: DataFrame, model: Model, run: Run, folder: str, rounds: int = ROUNDS) -> DataFrame:
    """(conv_id, history, results, steps, retries, stopped, answer) of ``conversations`` (conv_id, history array<struct<role,content>>).

    ``stopped`` is answered, failed (two replies lost) or max_steps. ``folder`` is shared by driver and executors;
    what stands in it is gone on with. Conversation ids are unique; a null history is an empty one.
    """
    spark = conversations.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def keep(rows: DataFrame, name: str) -> DataFrame:
        at = f"{folder}/{name}"
        if not fs.exists(path(f"{at}/_SUCCESS")):
            rows.write.mode("overwrite").parquet(at)
        return spark.read.schema(rows.schema).parquet(at)

    start = conversations.select("conv_id", F.coalesce("history", F.array().cast(HISTORY)).cast(HISTORY).alias("history"), F.array().cast(f"array<{CALL}>").alias("results"), F.lit(0).alias("steps"), F.lit(0).alias("retries"), F.lit(None).cast("string").alias("stopped"), F.lit(None).cast("string").alias("answer"))
    state = keep(start.to(spark.createDataFrame([], STATE).schema), "round=0")
    for k in range(1, rounds + 1):
        if not state.where("stopped is null").limit(1).count():
            break
        if fs.exists(path(f"{folder}/round={k}/_SUCCESS")):
            state = spark.read.schema(state.schema).parquet(f"{folder}/round={k}")
        else:
            state = keep(one_round(state, model, run, lambda rows, name, k=k: keep(rows, f"work={k}/{name}")), f"round={k}")
    return state.withColumn("stopped", F.coalesce("stopped", F.lit("max_steps")))
