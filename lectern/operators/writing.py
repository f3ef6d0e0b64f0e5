"""Notes, questions and marks written by a model, over tables of sections and answers.

A model is a function from a column of prompts to a column of replies, such as a Pandas UDF that
loads its weights once a task. Prompts are deterministic, so a reply can be kept beside its prompt.
Replies are data: what isn't JSON of the wanted shape gives no questions, or no points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import marks_met
from ..functions.text import strip_space
from . import practice
from .agent import strip_thinking
from .ordering import numbered
from .verify import formula_fault, nearest_copy, question_faults, verify_notes

Model = Callable[[Column], Column]
# The mark of uncertain readings, the most text of a section in a prompt to write notes, the most questions of one call.
UNCERTAIN, SECTION_CHARS, CALL = r"%uncertain(?:\n|\z)", 6000, 10


def _plain(c: Column) -> Column:
    return strip_space(F.regexp_replace(c, UNCERTAIN, ""))


def write_notes(sections: DataFrame, saved: DataFrame, model: Model) -> DataFrame:
    """(doc_id, sid, markdown, kept, dropped, resumed) for ``sections`` (doc_id, sid, title, text).

    Sections with a row in ``saved`` (doc_id, sid, markdown, kept, dropped) aren't written again, so a broken run goes on
    where it stopped once what it wrote is saved. The model sees the first ``SECTION_CHARS`` characters; a note is
    verified against the same.
    """
    keys = ["doc_id", "sid"]
    text = F.substring(F.coalesce("text", F.lit("")), 1, SECTION_CHARS)
    new = sections.join(saved.select(*keys).distinct(), keys, "left_anti").select(*keys, "title", text.alias("source"))
    prompt = F.concat_ws("\n\n", F.lit("Write study notes in Markdown. Use only what the section says."), F.concat_ws(" ", F.lit("Section"), "sid", "title"), "source")
    reply = new.select(F.struct(*keys).alias("id"), _plain(F.coalesce(strip_thinking(model(prompt)), F.lit(""))).alias("markdown"), "source")
    written = verify_notes(reply).select("id.*", strip_space(F.col("markdown")).alias("markdown"), "kept", "dropped", F.lit(False).alias("resumed"))
    known = saved.join(sections.select(*keys).distinct(), keys, "left_semi")
    return known.select(*keys, "markdown", F.col("kept").cast("long"), F.col("dropped").cast("long"), F.lit(True).alias("resumed")).unionByName(written)


QUESTIONS = "struct<questions:array<struct<question:string,answer:string,marks:int,marking_points:array<string>>>>"


def question_calls(sections: DataFrame, count: int) -> DataFrame:
    """``sections`` (sid, ord, text) with ``call`` and ``wanted``: ``count`` questions spread evenly, the earlier sections first, at most ``CALL`` a call.

    Sections without text get none. Places are numbered range by range, without a task that holds all sections.
    """
    usable = sections.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    places = numbered(usable.select("sid", "ord"), "ord", "sid", name="i")
    places = places.join(F.broadcast(places.agg(F.count("*").alias("n"))))
    share = F.floor(F.lit(count) / F.col("n")) + F.when(F.col("i") <= F.lit(count) % F.col("n"), 1).otherwise(0)
    shares = places.select("sid", share.cast("int").alias("share")).where("share > 0")
    calls = shares.select("sid", "share", F.explode(F.sequence(F.lit(0), F.floor((F.col("share") - 1) / CALL).cast("int"))).alias("call"))
    return usable.join(calls.select("sid", "call", F.least(F.lit(CALL), F.col("share") - F.col("call") * CALL).alias("wanted")), "sid")


def generate_questions(sections: DataFrame, existing: DataFrame, model: Model, count: int, marks: int, kind: str = "short") -> DataFrame:
    """(sid, call, place, question, answer, marks, marking_points, reasons) of ``sections`` (sid, ord, text).

    ``existing`` (sid, text) holds questions that must not be copied. A question is accepted if it has no reasons.
    """
    calls = question_calls(sections, count)
    ask = F.concat(F.lit("Write exactly "), F.col("wanted").cast("string"), F.lit(f" {kind} questions worth {marks} marks each, as JSON."))
    prompt = F.concat_ws("\n\n", F.concat(F.lit("Section "), "sid"), "text", ask)
    read = F.from_json(strip_thinking(model(prompt)), QUESTIONS)["questions"]
    q = calls.select("sid", "call", "text", "wanted", read.alias("read")).select("sid", "call", F.col("text").alias("source"), F.posexplode(F.slice("read", F.lit(1), F.col("wanted"))).alias("place", "q"))
    q = q.where("q.question is not null and q.answer is not null")
    q = q.select("sid", "call", "place", "source", _plain(F.col("q.question")).alias("question"), _plain(F.col("q.answer")).alias("answer"), "q.marks", F.transform("q.marking_points", _plain).alias("marking_points"))
    q = q.withColumn("key", F.to_json(F.struct("sid", "call", "place")))
    other = existing.select(F.xxhash64("sid", "text").cast("string").alias("other"), "sid", "text").distinct()
    near = nearest_copy(q.select("key", "sid", F.col("question").alias("text")), other, "key", "other", "sid")
    q = q.join(near, "key")
    faults = question_faults(F.col("answer"), F.col("marks"), F.lit(marks), F.col("source"), F.col("nearest"), F.lit(kind == "numerical"), formula_fault(F.col("answer"), F.col("source")))
    return q.select("sid", "call", "place", "question", "answer", "marks", "marking_points", faults.alias("reasons"))


def grade_answers(answers: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(keep..., awarded, met, missing, by_formula, feedback) of ``answers`` (question, marking_points, answer, most).

    A point is met if the model says so or an equal formula stands in the answer. Empty answers and questions
    without points get nothing; they are parted from the others before the call, so the model never sees them.
    """
    points, answer = F.coalesce("marking_points", F.array().cast("array<string>")), F.coalesce("answer", F.lit(""))
    listed = F.array_join(F.transform(points, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")
    prompt = F.concat_ws("\n\n", F.lit("Mark the answer. Reply as JSON with points_met and feedback."), "question", listed, answer)
    empty, shape = (strip_space(answer) == "") | (F.size(points) == 0), "struct<points_met:array<boolean>,feedback:string>"
    asked = answers.where(~empty).withColumn("_read", F.from_json(strip_thinking(model(prompt)), shape)).withColumn("_empty", F.lit(False))
    rest = answers.where(empty).withColumn("_read", F.lit(None).cast(shape)).withColumn("_empty", F.lit(True))
    a = asked.unionByName(rest).withColumn("_points", points).withColumn("_formula", marks_met(F.col("_points"), answer))
    said = lambda i: F.coalesce(F.get("_read.points_met", i), F.lit(False))
    met = F.transform("_points", lambda p, i: ~F.col("_empty") & (said(i) | F.get("_formula", i)))
    a = a.withColumn("_met", met)
    missing = F.filter("_points", lambda p, i: ~F.get("_met", i))
    feedback = F.when(F.col("_empty"), "No answer was given.").when(F.col("_read.points_met").isNull() & F.col("_read.feedback").isNull(), "The answer could not be marked.").otherwise(F.trim(F.coalesce("_read.feedback", F.lit(""))))
    return a.select(*keep, practice.marks_for(F.size(F.filter("_met", lambda x: x)), F.size("_points"), F.col("most")).alias("awarded"), F.col("_met").alias("met"), missing.alias("missing"), F.transform("_formula", lambda x: x & ~F.col("_empty")).alias("by_formula"), feedback.alias("feedback"))
