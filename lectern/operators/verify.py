"""Checks of generated notes and questions against their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import consistent_with, each_consistent, relations_in
from ..functions.text import content_stems, jaccard, sentences, strip_space, support

LEAST_SUPPORT, QUESTION_SUPPORT, COPY = 0.5, 0.6, 0.7


def verify_notes(notes: DataFrame) -> DataFrame:
    """(id, kept, dropped, markdown) of ``notes`` (id, markdown, source): sentences go that are unsupported or contradict a formula of the source.

    Formulas are read once a note, and only of lines with an equals sign. Fenced blocks, headings, tables and blank lines stay; a bullet without a sentence left goes whole.
    """
    w = Window.partitionBy("id").orderBy("i")
    notes = notes.withColumn("relations", relations_in(F.when(F.contains("source", F.lit("=")), F.col("source"))))
    lines = notes.select("id", content_stems(F.col("source")).alias("stems"), "relations", F.posexplode(F.split("markdown", "\n")).alias("i", "line"))
    lines = lines.withColumn("fence", F.col("line").rlike(r"^\s*```")).withColumn("inside", F.sum(F.col("fence").cast("int")).over(w) % 2 == 1)
    whole = F.col("fence") | F.col("inside") | F.col("line").rlike(r"^\s*(?:#|\||$)")
    lines = lines.withColumn("bullet", F.regexp_extract("line", r"^(\s*(?:[-*+]|\d+\.)\s+)", 1))
    said = F.filter(sentences(F.expr("substring(line, length(bullet) + 1)"), stars=True), lambda s: s != "")
    lines = lines.withColumn("said", F.when(whole, F.array().cast("array<string>")).otherwise(said))
    lines = lines.withColumn("agrees", each_consistent(F.when(F.contains("line", F.lit("=")) & (F.size("relations") > 0), F.col("said")), F.col("relations")))
    good = F.filter("said", lambda s, i: (support(content_stems(s), F.col("stems")) >= LEAST_SUPPORT) & F.coalesce(F.get("agrees", i), F.lit(True)))
    lines = lines.withColumn("good", good)
    text = F.when(whole, F.col("line")).when(F.size("good") > 0, F.concat("bullet", F.array_join("good", " ")))
    return lines.groupBy("id").agg(
        F.sum(F.size("good")).alias("kept"),
        F.sum(F.size("said") - F.size("good")).alias("dropped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("i", text.alias("t"))))), lambda x: x["t"]), "\n").alias("markdown"),
    )


LEAST_ANSWER = 3


def question_faults(answer: Column, marks: Column, wanted: Column, source: Column, nearest: Column, numeric: Column, contradicts: Column | None = None) -> Column:
    """Reasons against a question, in a fixed order; ``marks`` are held against the marks asked for.

    ``contradicts`` tells whether the answer contradicts a formula of the section, as ``formula_fault`` finds it; none is checked without it.
    """
    stems = content_stems(answer)
    thin = F.size(stems) < LEAST_ANSWER
    return F.array_compact(
        F.array(
            F.when(~thin & (support(stems, content_stems(source)) < QUESTION_SUPPORT), "not supported by the section"),
            F.when(~numeric & thin, "answer too thin"),
            F.when(contradicts if contradicts is not None else F.lit(False), "contradicts a formula"),
            F.when(nearest >= COPY, "too like another question"),
            F.when(~marks.eqNullSafe(wanted), "marks are not those asked for"),
        )
    )


def formula_fault(answer: Column, source: Column) -> Column:
    """Whether a relation in the answer contradicts one of its section without matching another; false without formulas."""
    equals = lambda c: F.when(F.contains(c, F.lit("=")), c)
    return F.coalesce(~consistent_with(equals(answer), relations_in(equals(source))), F.lit(False))


def nearest_copy(questions: DataFrame, existing: DataFrame, key: str, other: str, by: str) -> DataFrame:
    """(key, nearest): the largest Jaccard similarity of stems with a question of the same section.

    Pairs meet by a common stem, so only questions that share one are compared.
    """
    q, e = (d.select(k, by, content_stems(F.col("text")).alias(f"s_{k}")) for d, k in ((questions, key), (existing, other)))
    pairs = q.select("*", F.explode(f"s_{key}").alias("stem")).join(e.select("*", F.explode(f"s_{other}").alias("stem")), [by, "stem"]).where(F.col(key) != F.col(other))
    pairs = pairs.groupBy(key, other).agg(F.first(f"s_{key}").alias("a"), F.first(f"s_{other}").alias("b"))
    return questions.select(key).join(pairs.groupBy(key).agg(F.max(jaccard(F.col("a"), F.col("b"))).alias("nearest")), key, "left").select(key, F.coalesce("nearest", F.lit(0.0)).alias("nearest"))


def flashcards(notes: DataFrame) -> DataFrame:
    """(id, front, back) from lines that hold '**term**: definition', its first 300 characters; the first of each term counts."""
    lines = notes.select("id", F.posexplode(F.split("markdown", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")).alias("i", "line"))
    at = r"(?U)\*\*([^*\n]{2,60}?)\*\*\s*(?:\([^)]{1,40}\))?\s*[:—–-]\s*(.{8,300})"
    front = F.regexp_replace(strip_space(F.regexp_extract("line", at, 1)), ":+$", "")
    cards = lines.where(F.col("line").rlike(at)).select("id", "i", front.alias("front"), strip_space(F.regexp_extract("line", at, 2)).alias("back")).where(~F.col("back").startswith("**"))
    return cards.groupBy("id", F.lower("front").alias("term")).agg(F.min_by(F.struct("front", "back"), F.col("i")).alias("c")).select("id", "c.front", "c.back")
