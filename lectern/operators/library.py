"""The library as tables: documents, sections, chunks and notes, each a DataFrame keyed by doc_id.

Replacing and removing are anti-joins against the few doc_ids that change (broadcast by
their bounded number, ``FEW``; more are joined by shuffle), so nothing else is moved.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEW = 100_000


def _ids(rows: DataFrame) -> DataFrame:
    ids = rows.select("doc_id").distinct()
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def add_documents(tables: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All rows of the new documents take the place of what their ids had, notes included; a table without new rows loses them too."""
    ids = _ids(new["documents"])
    return {name: _with(old.join(ids, "doc_id", "left_anti"), new.get(name)) for name, old in tables.items()}


def replace_documents(tables: Mapping[str, DataFrame], new: Mapping[str, DataFrame], keep: tuple[str, ...] = ("documents", "notes")) -> dict[str, DataFrame]:
    """Sections and chunks of the documents in ``new`` are swapped; the tables in ``keep`` stay as they are."""
    ids = _ids(new["sections"])
    return {name: old if name in keep else _with(old.join(ids, "doc_id", "left_anti"), new.get(name)) for name, old in tables.items()}


def remove_documents(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of ``ids`` (doc_id)."""
    few = _ids(ids)
    return {name: old.join(few, "doc_id", "left_anti") for name, old in tables.items()}


def _with(old: DataFrame, new: DataFrame | None) -> DataFrame:
    return old if new is None else old.unionByName(new)


def unknown(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files (doc_id) that the library doesn't have."""
    return files.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")


def teaching_sections(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections with a chunk that is no exercise, in order of document and place."""
    return sections.join(chunks.where("not is_exercise").select("doc_id", "sid").distinct(), ["doc_id", "sid"], "left_semi").orderBy("doc_id", "ord")


def section_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, sid, text): the chunks of each section that are no exercises, in order, a blank line between."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return chunks.where("not is_exercise").groupBy("doc_id", "sid").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def in_order_of(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """``rows`` in the order of ``asked`` (place, key): unknown keys fall out, keys asked twice come twice."""
    return asked.join(rows, key).orderBy("place")


def distinct_by_first(ranked: DataFrame, query: str, *key: str) -> DataFrame:
    """The first row of each key of a query's ranking, ranked anew."""
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(query, *key).orderBy("rank"))).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank")))


def unmatched(questions: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(unmatched): how many questions have no match."""
    return questions.select(key).distinct().join(matches.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("unmatched"))


def find_section(sections: DataFrame, documents: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, doc_id, sid, ...) for each id of ``asked`` (asked): the section of that id in the document added first (``added_at``, then doc_id)."""
    met = asked.join(sections, F.col("asked") == F.col("sid")).join(documents.select("doc_id", "added_at"), "doc_id")
    rest = [c for c in met.columns if c not in ("asked", "added_at")]
    return met.groupBy("asked").agg(F.min_by(F.struct(*rest), F.struct("added_at", "doc_id")).alias("x")).select("asked", "x.*")


def notes_of(sections: DataFrame, notes: DataFrame) -> DataFrame:
    """The notes of ``sections`` (doc_id, sid, ord), in their order; sections without notes fall out."""
    return notes.join(sections.select("doc_id", "sid", "ord"), ["doc_id", "sid"]).orderBy("doc_id", "ord")
