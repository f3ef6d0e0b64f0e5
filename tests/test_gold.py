import os

from pyspark.sql import functions as F

from lectern.operators import gold
from lectern.streaming import ingest

ASK = "What does a body do that no force acts upon"


def test_questions_of_lists(spark):
    blocks = [
        ("heading", "5.1 Forces", 1),
        ("paragraph", f"1 . {ASK} too early?", 1),
        ("paragraph", "Prose about solving problems. Conceptual Questions", 2),
        ("heading", "5.1 Forces", 2),
        ("paragraph", f"1 . {ASK}? 2 . short 3 . {ASK} three?", 2),
        ("paragraph", "and now. Problems", 3),
        ("paragraph", f"4 . {ASK} without a section?", 3),
        ("heading", "5.2 Law", 3),
        ("paragraph", f"5 . {ASK} five?", 3),
        ("paragraph", "Additional Problems", 4),
        ("heading", "5.3 Law", 4),
        ("paragraph", f"6 . {ASK} left out?", 4),
        ("heading", "Problems", 4),
        ("heading", "5.4 Law", 4),
        ("paragraph", f"1 . {ASK} again?", 4),
        ("heading", "Summary", 5),
        ("paragraph", f"7 . {ASK} after the end?", 5),
        ("paragraph", None, None),
    ]
    rows = spark.createDataFrame([("b", i, *x) for i, x in enumerate(blocks)], "book string, ord int, kind string, text string, page int")
    out = {r.id: (r.kind, r.chapter, r.gold_section, r.question) for r in gold.questions(rows).collect()}
    assert out == {"b-ch5-q1": ("conceptual", 5, "5.1", f"{ASK}?"), "b-ch5-q3": ("conceptual", 5, "5.1", f"{ASK} three?"), "b-ch5-q5": ("problem", 5, "5.2", f"{ASK} five?")}
    toc = spark.createDataFrame([("b", "Answer Key", 3), ("b", "Index", 1)], "book string, title string, page int")
    assert sorted(r.ord for r in gold.before_answer_key(rows, toc).collect()) == [0, 1, 2, 3, 4, 17]


def test_the_last_attempt_stays_over_batches(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    kind = "id long, question string, section string, awarded int"
    for batch in ([(1, "q", "s", 1), (2, "q", "t", 2)], [(3, "q", "s", 5)], [(4, "r", "s", 1)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(src)
        ingest.upsert_latest(spark.readStream.schema(kind).parquet(src), table, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(x for x in os.listdir(table) if x.startswith("v=")) == ["v=1", "v=2"]
    got = spark.read.parquet(f"{table}/v=2").select("id", "question", "section", "awarded").orderBy(F.col("id")).collect()
    assert [tuple(r) for r in got] == [(2, "q", "t", 2), (3, "q", "s", 5), (4, "r", "s", 1)]
