import pytest

from lectern import catalog

from .oracle import flat, run


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, name):
    assert flat(catalog.queries()[name](spark, sf).toPandas()) == flat(run(catalog.oracle_sql()[name], sf))


def test_chunks_keep_text(spark, sf):
    from pyspark.sql import functions as F

    out = catalog.chunk_stats(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length(F.regexp_replace("text", r"\s+", "")).alias("n"))
    assert out.join(docs, "doc_id").where("kept_chars <> n").count() == 0
    assert out.where("longest > 1800").count() == 0
