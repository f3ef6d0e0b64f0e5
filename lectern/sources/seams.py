"""Where readers that need a library or a model are put in: PDF text and bookmarks, images, recognised lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a gap of this many line heights starts a paragraph.
GAP = 1.6
LINES = "array<struct<text:string,top:double,bottom:double,score:double>>"
PAGES = "array<struct<page:int,text:string>>"


def recognised_text(lines: Column) -> Column:
    """struct(text, score) of recognised lines in order: a blank line where a line begins far below the one before, else a line end; the mean score.

    Lines without a place are joined by spaces; no lines give '' and 0.
    """
    lines = F.coalesce(lines.cast(LINES), F.array().cast(LINES))
    heights = F.array_sort(F.transform(lines, lambda x: x["bottom"] - x["top"]))
    n = F.size(heights)
    median = (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2
    height = F.when(median == 0, 1.0).otherwise(median)
    apart = lambda x, i: F.when(i == 0, "").when(x["top"] - F.get(lines, i - 1)["top"] > GAP * height, "\n\n").otherwise("\n")
    placed = ~F.exists(lines, lambda x: x["top"].isNull() | x["bottom"].isNull())
    text = F.when(placed, F.array_join(F.transform(lines, lambda x, i: F.concat(apart(x, i), x["text"])), "")).otherwise(F.array_join(F.transform(lines, lambda x: x["text"]), " "))
    score = F.aggregate(lines, F.lit(0.0), lambda a, x: a + F.coalesce(x["score"], F.lit(0.0))) / F.greatest(n, F.lit(1))
    return F.struct(text.alias("text"), score.alias("score"))


def images(files: DataFrame, recognise: Callable[[Column], Column]) -> DataFrame:
    """(id, path, text, score) of the images among ``files``; ``recognise`` gives the lines of an image's bytes, as a Pandas UDF would."""
    read = recognised_text(recognise(F.col("content")))
    return files.where("kind in ('png', 'jpeg', 'webp')").select("id", "path", read.alias("r")).select("id", "path", "r.*")


def pdfs(files: DataFrame, pages: Callable[[Column], Column], bookmarks: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, blocks, toc) of the PDFs among ``files``, as ``segment.bookmark_sections`` takes them.

    ``pages`` gives the text of each page of a file's bytes, ``bookmarks`` its bookmarks (title, level, page); those without a title are left out.
    A page's paragraphs are its blocks.
    """
    parts = lambda p: F.filter(F.split(p["text"], r"\n\s*\n"), lambda t: F.trim(t) != "")
    blocks = F.flatten(F.transform("pages", lambda p: F.transform(parts(p), lambda t: F.struct(F.trim(t).alias("text"), p["page"].alias("page")))))
    toc = F.filter("marks", lambda m: F.trim(m["title"]) != "")
    read = files.where("kind = 'pdf'").select(F.col("id").alias("doc_id"), pages(F.col("content")).cast(PAGES).alias("pages"), bookmarks(F.col("content")).alias("marks"))
    return read.select("doc_id", blocks.alias("blocks"), toc.alias("toc"))
