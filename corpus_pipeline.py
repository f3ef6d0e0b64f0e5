"""A training corpus from ``documents``: toxicity, near duplicates, decontamination, mixing.

Each stage works on what the one before kept, and its decisions take effect. The first
three return the columns they got; the last adds what the mix takes of each document.
A stage's result is written as Parquet and read again as the next one's input.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows,
empty tables and columns of any other names; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import once, spark_count, staged, without
from lectern.llm.op1_ngram_jaccard import jaccard_components
from lectern.llm.op2_toxicity import fit_toxicity, score_toxicity
from lectern.llm.op3_decontamination import contaminated
from lectern.llm.op8_mixing import mix_sources, tie

BROADCAST_ROWS = 300_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay. Fitted on the labels of ``sf_dir`` whose crc32(doc_id) mod 5 is not 0.

    Null and empty texts are scored like a text without words; repeated rows share a
    verdict. Without labels of both classes all documents stay.
    """
    scorer = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name in docs.columns:
        name += "_"
    scored = score_toxicity(docs, scorer, *docs.columns, name=name)
    return scored.where(F.col(name) < 0.5).drop(name)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the smallest doc_id stays; equal rows (doc_id and text) stay once.

    Texts without words (null, empty) all stay. Of several texts under the smallest
    doc_id the one of the least hash stays. A null doc_id is the last of its component.
    """
    docs = once(docs)
    rows = staged(jaccard_components(docs))
    # a component is named by its smallest doc_id, so only rows of that id can stay: nothing large is dealt by component
    linked = rows.where("component is not null").withColumn("named", F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = linked.where("named").select("component", "doc_id", "key")
    again = named.groupBy("component").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    later = named.join(again, "component").where("key > least").select("doc_id", "key")
    beaten = linked.where("not named").select("doc_id", "key").union(later)
    return without(docs, staged(beaten))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty texts hold none, repeated rows share a verdict."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select("doc_id", "key"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes a copy or more, with size, target (of the source), copies and taken.

    Equal rows (doc_id and text) count once; documents without words are not taken. A
    null source is a source of its own. Added columns that ``docs`` has already get "mix_" before their names.
    """
    docs = once(docs)
    added = ["size", "target", "copies", "taken"]
    mix = staged(mix_sources(docs).where("copies > 0").select("doc_id", "tie", *added))
    mix = F.broadcast(mix) if spark_count(mix, BROADCAST_ROWS) is not None else mix
    joined = docs.alias("_docs").join(mix.alias("_mix"), F.col("_docs.doc_id").eqNullSafe(F.col("_mix.doc_id")) & (tie("_docs.") == F.col("_mix.tie")))
    names = []
    for c in added:
        while c in docs.columns or c in names:
            c = f"mix_{c}"
        names.append(c)
    return joined.select("_docs.*", *[F.col(f"_mix.{c}").alias(n) for c, n in zip(added, names, strict=True)])


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("mixing", mixing)]
#: The first and last stages (a fitted model, random rounding) have no SQL; tests/llm/test_pipeline.py holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
