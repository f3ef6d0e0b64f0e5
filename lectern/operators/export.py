"""Notes and cards as files' contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}]", "-"), "^-+|-+$", ""), F.lit("")), F.lit("all"))


def stable_id(text: Column) -> Column:
    """A 31-bit id from the name alone."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("long") % 2147483648


def section_markdown(markdown: Column, visuals: Column) -> Column:
    """A section's note with its ``visuals`` array<struct<format,text>>; blank parts are left out."""
    drawn = F.transform(F.coalesce(visuals, F.array().cast("array<struct<format:string,text:string>>")), lambda v: F.when(v["format"] == "mermaid", F.concat(F.lit("```mermaid\n"), v["text"], F.lit("\n```"))).otherwise(v["text"]))
    return F.array_join(F.filter(F.concat(F.array(markdown), drawn), lambda b: F.trim(b) != ""), "\n\n")


def to_markdown(notes: DataFrame, *key: str) -> DataFrame:
    """(key..., markdown): the notes (key..., ord, markdown, visuals) of each key in order, rules between sections."""
    part = F.struct("ord", section_markdown(F.col("markdown"), F.col("visuals")).alias("t"))
    return notes.groupBy(*key).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n---\n\n"), F.lit("\n")).alias("markdown"))


def deck(cards: DataFrame, name: str) -> DataFrame:
    """Cards (front, back, section) with stable deck and note ids, ready for a tab-separated writer."""
    tidy = lambda c: F.regexp_replace(c, r"[\t\r\n]+", " ")
    return cards.select(stable_id(F.lit(name)).alias("deck_id"), stable_id(F.concat(F.lit(name + "\0"), "front")).alias("note_id"), tidy("front").alias("front"), tidy("back").alias("back"), "section")
