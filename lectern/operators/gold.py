"""Questions of a book's exercise lists with the section each belongs to: windows over blocks, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_space

# Headings of lists, what kind of list they start (none: it is left out), and headings that end one.
LIST = r"(?:^|(?<=[.?!)\]”\"'])\s+)(Conceptual Questions|Additional Problems|Challenge Problems|Problems)\s*$"
KINDS = {"Conceptual Questions": "conceptual", "Problems": "problem", "Additional Problems": "", "Challenge Problems": ""}
ENDS = ("key terms", "key equations", "summary", "chapter review")
SECTION, NUMBER, LEAST = r"^(\d{1,2})\.(\d{1,2})\s+\S", r"(?:^|(?<=\s))(\d{1,3}) \. ", 30


def before_answer_key(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """Blocks (book, page) before the first page which the book's bookmarks (book, title, page) call an answer key; blocks without a page stay."""
    cut = toc.where(F.contains(F.lower("title"), F.lit("answer key"))).groupBy("book").agg(F.min("page").alias("cut"))
    return blocks.join(cut, "book", "left").where("cut is null or page is null or page < cut").drop("cut")


def numbered(body: Column) -> Column:
    """array<struct<number, question>> of a text with '12 . ' before each question; short ones are left out."""
    numbers = F.regexp_extract_all(body, F.lit(NUMBER), F.lit(1))
    texts = F.transform(F.split(body, NUMBER), strip_space)
    pairs = F.transform(numbers, lambda n, i: F.struct(n.cast("int").alias("number"), F.get(texts, i + 1).alias("question")))
    return F.filter(pairs, lambda x: F.length(x["question"]) >= LEAST)


def questions(blocks: DataFrame) -> DataFrame:
    """(id, book, kind, chapter, gold_section, question) of ``blocks`` (book, ord, kind, text); of several with one id the first.

    The heading of a list may stand at the end of a block. What kind of list a block is in, and of which
    section, is the last that was said before it, so both are windows over a book's blocks.
    """
    before = Window.partitionBy("book").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    text = strip_space(F.coalesce("text", F.lit("")))
    marker = F.nullif(F.regexp_extract(text, LIST, 1), F.lit(""))
    b = blocks.select("book", "ord", F.col("kind").alias("block"), marker.alias("marker"), strip_space(F.regexp_replace(text, LIST, "")).alias("body"))
    b = b.withColumn("ends", F.lower("body").rlike("^(?:" + "|".join(ENDS) + ")"))
    of = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    said = F.when(F.col("marker").isNotNull(), of[F.col("marker")]).when(F.col("ends"), "")
    b = b.withColumn("kind", F.when(F.col("ends"), "").otherwise(F.coalesce(F.last(said, ignorenulls=True).over(before), F.lit(""))))
    b = b.withColumn("head", F.when((F.col("kind") != "") & (F.col("block") == "heading") & F.col("body").rlike(SECTION), F.regexp_extract("body", r"^(\d{1,2}\.\d{1,2})", 1)))
    left = F.when(F.col("marker").isNotNull() | F.col("ends"), "").otherwise(F.col("head"))
    b = b.withColumn("gold_section", F.coalesce(F.last(left, ignorenulls=True).over(before), F.lit("")))
    inside = b.where("kind <> '' and gold_section <> '' and head is null and not ends").select("book", "ord", "kind", "gold_section", F.posexplode(numbered(F.col("body"))).alias("place", "q"))
    chapter = F.split_part("gold_section", F.lit("."), F.lit(1)).cast("int")
    q = inside.select("book", "ord", "place", "kind", chapter.alias("chapter"), "gold_section", "q.question", F.concat_ws("-", "book", F.concat(F.lit("ch"), chapter.cast("string")), F.concat(F.lit("q"), F.col("q.number").cast("string"))).alias("id"))
    first = q.groupBy("id").agg(F.min_by(F.struct("book", "kind", "chapter", "gold_section", "question"), F.struct("ord", "place")).alias("x"))
    return first.select("id", "x.*")
