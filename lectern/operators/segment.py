"""Text to pieces to chunks, as folds over arrays: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, squash, strip_space

LONGEST, TARGET = 1800, 1200
HEADING = r"^\d{1,2}(?:\.\d{1,2}){0,3}\.?\s+[A-Z].{2,90}$"
# Titles of exercise sections, and the marks of a list of exercises within a section.
EXERCISES = r"(?i)^(?:(?:review|critical thinking|interactive link|conceptual)\s+questions|(?:additional\s+|challenge\s+)?problems)$"
TAIL = r"(?:^|(?<=[.?!)\]”\"'])\s+|\n\n)(?:Conceptual Questions|Review Questions|Critical Thinking Questions|Interactive Link Questions|Problems|Additional Problems|Challenge Problems)(?=\s*(?:$|\d{1,2}\.\d{1,2}\s|\d{1,3} \. ))"


#: Words before the number of a heading of the first level.
DIVISIONS = r"(?i)^(?:chapter|unit|module|part)\s+(\d+|[ivxlc]+)\b[\s.:–—-]*"


def heading_number(title: Column) -> Column:
    """The number of a heading, '4.2' or that of a chapter, null for none."""
    plain, chapter = F.regexp_extract(title, r"^(\d{1,2}(?:\.\d{1,2}){0,3})", 1), F.lower(F.regexp_extract(title, DIVISIONS, 1))
    return F.coalesce(F.nullif(F.rtrim(plain, F.lit(".")), F.lit("")), F.nullif(chapter, F.lit("")))


def heading_title(line: Column) -> Column:
    """A chapter heading without its word and number; the whole line where nothing is left, or for other headings."""
    return F.coalesce(F.nullif(strip_space(F.regexp_replace(line, DIVISIONS, "")), F.lit("")), line)


def heading_level(line: Column) -> Column:
    """Level of a heading line, null for other lines: numbered (dots + 1), or chapter, unit, module, part (1)."""
    line = F.trim(line)
    fit = (F.size(F.split(line, r"\s+")) <= 14) & ~line.rlike(r"[.,;]$")
    number = F.regexp_replace(F.regexp_extract(line, r"^(\d{1,2}(?:\.\d{1,2}){0,3})", 1), "[^.]", "")
    return F.when(fit & line.rlike(HEADING), F.length(number) + 1).when(fit & line.rlike(r"(?i)^(?:chapter|unit|module|part)\s+(?:\d+|[ivxlc]+)\b"), 1)


def is_exercise(title: Column) -> Column:
    return strip_space(title).rlike(EXERCISES)


def split_tail(text: Column) -> Column:
    """struct(teaching, exercises): a section's text before and from the first list of exercises in it, '' if there is none."""
    at = F.regexp_instr(text, F.lit(TAIL))
    teaching = F.when(at == 0, text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"(?U)\s+$", ""))
    return F.struct(teaching.alias("teaching"), F.when(at == 0, "").otherwise(F.regexp_replace(F.substring(text, at, F.length(text)), r"(?U)^\s+", "")).alias("exercises"))


def section_chunks(sections: DataFrame, *keep: str) -> DataFrame:
    """(keep..., ord, chunk, is_exercise) of ``sections`` (title, text): a section of exercises whole, any other in its two parts."""
    halves = F.when(is_exercise(F.coalesce("title", F.lit(""))), F.array(F.struct(F.lit(True).alias("is_exercise"), F.col("text").alias("t")))).otherwise(F.transform(F.array(split_tail(F.col("text"))), lambda x: F.array(F.struct(F.lit(False).alias("is_exercise"), x["teaching"].alias("t")), F.struct(F.lit(True).alias("is_exercise"), x["exercises"].alias("t"))))[0])
    parts = F.flatten(F.transform(halves, lambda h: F.transform(pack(pieces(h["t"])), lambda c: F.struct(c.alias("chunk"), h["is_exercise"].alias("is_exercise")))))
    return sections.select(*keep, F.posexplode(parts).alias("ord", "x")).select(*keep, "ord", "x.chunk", "x.is_exercise")


def pieces(text: Column) -> Column:
    """Paragraphs, trimmed; a long one becomes its sentences, a long sentence is cut every ``LONGEST`` characters."""
    trimmed = lambda x: F.filter(F.transform(x, strip_space), lambda p: F.length(p) > 0)
    paragraphs = trimmed(F.split(text, r"\n\n"))
    split = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= LONGEST, F.array(p)).otherwise(trimmed(sentences(p)))))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / LONGEST).cast("int")), lambda i: F.substring(s, i * LONGEST + 1, F.lit(LONGEST)))
    return F.flatten(F.transform(F.filter(split, lambda s: F.length(s) > 0), cut))


def pack(parts: Column) -> Column:
    """Greedy packing: a chunk is closed when the next piece would take it over ``TARGET`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def step(a: Column, p: Column) -> Column:
        full = (F.length(a["now"]) > 0) & (a["size"] + F.length(p) > TARGET)
        joined = F.when(full | (F.length(a["now"]) == 0), p).otherwise(F.concat(a["now"], F.lit("\n\n"), p))
        size = F.when(full, F.length(p) + 2).otherwise(a["size"] + F.length(p) + 2)
        done = F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.struct(done.alias("done"), joined.alias("now"), size.cast("int").alias("size"))

    return F.aggregate(parts, start, step, lambda a: F.when(F.length(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def chunks(sections: DataFrame, *keep: str) -> DataFrame:
    """(keep..., ord, chunk) of ``sections`` with a text."""
    return sections.select(*keep, F.posexplode(pack(pieces(F.col("text")))).alias("ord", "chunk"))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, level, text): paragraphs and headings of raw text, hyphen breaks joined."""
    clean = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"(\w)-\n(?=[a-z])", "$1")
    lines = docs.select("doc_id", F.split(clean, "\n").alias("lines")).select("doc_id", F.posexplode("lines").alias("i", "line"))
    level = heading_level(F.col("line"))
    w = "PARTITION BY doc_id ORDER BY i"
    lines = lines.withColumn("level", level).withColumn("blank", F.length(F.trim("line")) == 0)
    lines = lines.withColumn("edge", F.expr(f"CASE WHEN level IS NOT NULL OR blank OR lag(level IS NOT NULL OR blank, 1, true) OVER ({w}) THEN 1 ELSE 0 END"))
    lines = lines.withColumn("ord", F.expr(f"sum(edge) OVER ({w})")).where("NOT blank")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.trim("line").alias("t")))), lambda x: x["t"]), " ")
    return lines.groupBy("doc_id", "ord").agg(F.max("level").alias("level"), text.alias("text")).withColumn("kind", F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph"))


def sections(parts: DataFrame) -> DataFrame:
    """(doc_id, sid, ord, title, level, path, text): text between headings; text before the first is 'front', without any 'all'.

    The path holds, for each smaller level, the nearest heading before; ids that occur again get ~2, ~3 and so on.
    """
    w = "PARTITION BY doc_id ORDER BY ord"
    p = parts.withColumn("head", F.expr(f"sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER ({w})")).withColumn("any", F.expr("max(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id)"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "heading", F.struct("ord", "text")))), lambda x: x["text"]), "\n\n")
    s = p.groupBy("doc_id", "head").agg(F.max(F.when(F.col("kind") == "heading", F.col("text"))).alias("title"), F.coalesce(F.max("level"), F.lit(1)).alias("level"), F.max("any").alias("any"), body.alias("text"))
    number = heading_number(F.col("title"))
    s = s.withColumn("base", F.when(F.col("head") == 0, F.when(F.col("any") == 1, "front").otherwise("all")).otherwise(F.coalesce(number, F.concat(F.lit("s"), F.col("head").cast("string")))))
    s = s.where("head > 0 OR text <> ''").withColumn("again", F.expr("row_number() OVER (PARTITION BY doc_id, base ORDER BY head)"))
    s = s.withColumn("sid", F.when(F.col("again") > 1, F.concat("base", F.lit("~"), F.col("again").cast("string"))).otherwise(F.col("base"))).withColumn("title", heading_title(F.col("title")))
    above = F.array_compact(F.array(*[F.expr(f"CASE WHEN level > {k} THEN last(CASE WHEN level <= {k} THEN named_struct('level', level, 'head', head, 'title', title) END, true) OVER (PARTITION BY doc_id ORDER BY head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END") for k in (1, 2, 3)]))
    path = F.transform(F.filter(F.array_distinct(above), lambda x: x["title"].isNotNull()), lambda x: x["title"])
    return s.withColumn("path", path).select("doc_id", "sid", F.col("head").cast("int").alias("ord"), "title", "level", "path", "text")


def strip_title(text: Column, title: Column) -> Column:
    """Text without the title before it, whatever stands between its letters and digits; other texts stay."""
    key = squash(title)
    between = "[^A-Za-z0-9]*"
    pattern = F.concat(F.lit(f"(?i)^{between}"), F.regexp_replace(key, r"(.)(?=.)", f"$1{between}"), F.lit(r"[ \t\n:.\-–—]*"))
    return F.when(key == "", text).otherwise(F.regexp_replace(text, pattern, F.lit("")))


TOC = "array<struct<title:string,level:int,page:int>>"
SLACK = 12


def bookmark_anchors(blocks: Column, toc: Column) -> Column:
    """array<struct<at, title, level>>: the block (from 0) that each bookmark points to, in one forward fold.

    Of the blocks of its page (of any page without one) from the last anchor on, the first that
    begins with the title, else the first; a bookmark without such blocks is left out.
    """
    start = F.struct(F.lit(0).alias("from"), F.array().cast("array<struct<at:int,title:string,level:int>>").alias("found"))
    heads = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), squash(b["text"]).alias("text"), b["page"].alias("page")))

    def step(a: Column, e: Column) -> Column:
        key = squash(e["title"])
        here = F.filter(heads, lambda b: (b["i"] >= a["from"]) & (e["page"].isNull() | b["page"].eqNullSafe(e["page"])))
        titled = F.filter(here, lambda b: (key != "") & F.contains(F.substring(b["text"], F.lit(1), F.length(key) + SLACK), key))
        at = F.coalesce(F.get(titled, F.lit(0))["i"], F.get(here, F.lit(0))["i"])
        anchor = F.array(F.struct(at.alias("at"), strip_space(e["title"]).alias("title"), e["level"].alias("level")))
        return F.struct(F.coalesce(at, a["from"]).alias("from"), F.when(at.isNull(), a["found"]).otherwise(F.concat(a["found"], anchor)).alias("found"))

    return F.aggregate(F.coalesce(toc.cast(TOC), F.array().cast(TOC)), start, step, lambda a: a["found"])


def bookmark_sections(docs: DataFrame) -> DataFrame:
    """``sections`` of ``docs`` (doc_id, blocks array<struct<text,page>>, toc), cut at the bookmarks; titles run into a block are taken off it."""
    d = docs.select("doc_id", "blocks", bookmark_anchors(F.col("blocks"), F.col("toc")).alias("anchors"))
    step = F.size("anchors") + 1
    last = lambda i: F.element_at(F.filter("anchors", lambda a: a["at"] == i), -1)
    body = F.transform("blocks", lambda b, i: F.struct((i * step + F.size("anchors")).alias("ord"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.when(F.exists("anchors", lambda a: a["at"] == i), strip_title(b["text"], last(i)["title"])).otherwise(b["text"]).alias("text")))
    heads = F.transform("anchors", lambda a, j: F.struct((a["at"] * step + j).alias("ord"), F.lit("heading").alias("kind"), a["level"].alias("level"), a["title"].alias("text")))
    return sections(d.select("doc_id", F.inline(F.concat(body, heads))))
