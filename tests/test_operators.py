from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import blueprint, metrics, practice, retrieve, segment, verify
from lectern.sources import readers

from .conftest import rows

PAPER = """Physics 2019 exam
Q1. State the law of conservation of energy. [4 marks]
2) A ball of mass 2 kg falls from a tower.
(a) Find its speed at the ground level. (5)
(b) Find the time that it takes to fall at
4. m/s downwards. [3 marks]
3. Explain what a semiconductor is made of [2]"""


def test_paper(spark):
    got = rows(blueprint.papers_to_questions(spark.createDataFrame([("p", PAPER), ("q", None)], "source string, text string")))
    assert [(g[1], g[3], g[4]) for g in got] == [("1", 4, 2019), ("2(a)", 5, 2019), ("2(b)", 3, 2019), ("3", 2, 2019)]
    assert got[1][2] == "A ball of mass 2 kg falls from a tower. Find its speed at the ground level."


def test_sections(spark):
    text = "Preface line\n\n4 Circuits\nIntro to cir-\ncuits here\n4.1 Ohm and others\nV = IR holds\n\nmore\n4.1 Ohm again\nx"
    b = segment.blocks(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    got = rows(segment.sections(b).orderBy("ord").select("sid", "path", "text"))
    assert got == [("front", [], "Preface line"), ("4", [], "Intro to circuits here"), ("4.1", ["4 Circuits"], "V = IR holds\n\nmore"), ("4.1~2", ["4 Circuits"], "x")]


def test_hard_cut_and_packing(spark):
    df = spark.createDataFrame([("a" * 4000,), ("b" * 700 + "\n\n" + "c" * 700,), ("",), (None,)], "text string")
    got = rows(df.select(segment.pack(segment.pieces(F.col("text")))))
    assert [len(x) for x in got[0][0]] == [1800, 1800, 400]
    assert [len(x) for x in got[1][0]] == [700, 700]
    assert got[2][0] == [] and got[3][0] is None


def test_fusion(spark):
    r = lambda ids: spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(ids)], "q int, d int, rank int")
    assert [x[1] for x in rows(retrieve.fuse([r([1, 2, 3]), r([3, 1, 4])], "q", "d").orderBy("rank"))] == [1, 3, 2, 4]


def test_scope(spark):
    df = spark.createDataFrame([("ch4", "4.2"), ("4", "41.1"), (None, "x"), ("chapter 4.", "4"), ("d", "9"), ("", "1")], "s string, sid string")
    assert [x[0] for x in rows(df.select(retrieve.in_scope(F.col("s"), F.lit("d"), F.col("sid"))))] == [True, False, True, True, True, True]


def test_verify(spark):
    md = "# Head\n- The membrane regulates transport across cells.\n- Dragons invented quantum computers yesterday morning.\n```\ncode stays\n```"
    got = rows(verify.verify_notes(spark.createDataFrame([(1, md, "The cell membrane regulates transport across the membrane of cells")], "id int, markdown string, source string")))
    assert got[0][1:3] == (1, 1) and "Dragons" not in got[0][3] and "code stays" in got[0][3]


def test_flashcards(spark):
    got = rows(verify.flashcards(spark.createDataFrame([(1, "- **Ohm**: unit of resistance\n**ohm** - a second meaning here\nno card")], "id int, markdown string")))
    assert got == [(1, "Ohm", "unit of resistance")]


def test_attempts(spark):
    a = spark.createDataFrame([(1, "q", "s", 2, 5, 1), (2, "q", "s", 5, 5, 1), (3, "r", "s", 1, 5, 9), (4, "z", "t", 1, 5, 10)], "id int, question string, section string, awarded int, most int, due_at int")
    assert sorted(x[0] for x in rows(practice.due(a, F.lit(9), "question"))) == ["r"]
    m = practice.mastery(practice.latest(a, "question"), "section")
    assert dict((r[0], r[4]) for r in rows(m)) == {"s": 0.6, "t": 0.2}
    assert [r[0] for r in rows(practice.weak_topics(m, None, "section"))] == ["t", "s"]
    assert rows(spark.range(1).select(practice.marks_for(F.lit(1), F.lit(2), F.lit(5))))[0][0] == 2


def test_regression(spark):
    v = "metric string, value double"
    got = dict((r[0], r[3]) for r in rows(metrics.compare_runs(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)], v), spark.createDataFrame([("a", 0.99), ("b", 0.97), ("c", 0.5), ("e", 1.0)], v), spark.createDataFrame([(m, 1, 0.02, False, True) for m in "abcde"], "metric string, direction int, band double, relative boolean, gated boolean"))))
    assert got == {"a": "PASS", "b": "SUSPECT", "c": "FAIL", "d": "MISSING", "e": "NEW"}


def test_text(spark):
    df = spark.createDataFrame([("Ohm's Law: $x^2$ (3 marks) electricity Thévenin",)], "t string")
    got = rows(df.select(t.squash(F.col("t")), t.content_stems(F.col("t")), t.tokens(F.lit("Thévenin")), t.tokens(F.lit("Thévenin"), True)))[0]
    assert got[1] == ["electr", "venin"] and got[2] == ["thévenin"] and got[3] == ["th", "venin"]


def test_readers(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("hello")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01\x02")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    files = readers.read_files(spark, str(tmp_path))
    assert sorted(r.kind for r in files.collect()) == ["text", "zip"]
    assert [r[2:] for r in rows(readers.office_blocks(files).orderBy("ord").select("id", "ord", "page", "kind", "level", "text"))] == [(None, "heading", 2, "Head"), (None, "paragraph", None, "Body")]


def test_stream(spark, tmp_path):
    from lectern.streaming import ingest

    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS answered_at, 's' AS section, 1 AS awarded, 5 AS most").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("answered_at timestamp, section string, awarded int, most int").parquet(str(tmp_path / "in"))
    q = ingest.attempts_by_window(s).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.sql("select section, attempts, awarded from w")) == [("s", 1, 1)]
