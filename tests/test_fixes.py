"""Rules of segmentation, papers, questions, the library tables and the evaluation figures."""

from pyspark.sql import functions as F

from lectern.functions.text import strip_maths
from lectern.operators import blueprint, library, metrics, segment, verify

from .conftest import rows


def test_exercises(spark):
    titles = ["Problems", "Problems of induction", " Review Questions ", "Conceptual questions", "Exercises in style", "Additional Problems"]
    got = [r[0] for r in rows(spark.createDataFrame([(t,) for t in titles], "t string").select(segment.is_exercise(F.col("t"))))]
    assert got == [True, False, True, True, False, True]
    texts = ["Teaching ends. Problems 1 . Find it.", "strategies for solving Problems in physics", "All of it.\n\nReview Questions\n4.1 What?", ""]
    got = [tuple(r[0]) for r in rows(spark.createDataFrame([(t,) for t in texts], "t string").select(segment.split_tail(F.col("t"))))]
    assert got == [("Teaching ends.", "Problems 1 . Find it."), (texts[1], ""), ("All of it.", "Review Questions\n4.1 What?"), ("", "")]
    s = spark.createDataFrame([("a", "Force", texts[0]), ("b", "Problems", "One. Two.")], "sid string, title string, text string")
    assert sorted((r.sid, r.chunk, r.is_exercise) for r in segment.section_chunks(s, "sid").collect()) == [("a", "Problems 1 . Find it.", True), ("a", "Teaching ends.", False), ("b", "One. Two.", True)]


def test_papers():
    one = blueprint.parse("1. A car of mass\n1200 kg moves at\n3. m/s along a road; find its momentum. [2 marks]", "")
    assert [q["number"] for q in one] == ["1"] and "3. m/s" in one[0]["text"] and one[0]["marks"] == 2
    two = blueprint.parse("Exam of 2019\nQ1 Explain entropy in words. [3m]\n2. (a) Find the first value here.\n(b) Find the second value here. (4)\nPage 1 of 2\nTurn over\n2. (c) Find the third value here.", "p")
    assert [(q["number"], q["marks"], q["year"]) for q in two] == [("1", 3, 2019), ("2(a)", None, 2019), ("2(b)", 4, 2019), ("2(c)", None, 2019)]
    assert not any("Page" in q["text"] or "Turn" in q["text"] for q in two)
    three = blueprint.parse("2) A block slides down a plane.\n(a) Find its acceleration now. [3]\n(b) Find its final speed now. [4]", "")
    assert [(q["number"], q["text"]) for q in three] == [("2(a)", "A block slides down a plane. Find its acceleration now."), ("2(b)", "A block slides down a plane. Find its final speed now.")]
    assert blueprint.parse("", "") == []


def test_question_faults(spark):
    source = "momentum energy velocity acceleration gravity pressure density"
    df = spark.createDataFrame([("momentum energy velocity acceleration", 2, 2, 0.1, False), ("nothing", 2, 3, 0.8, False), ("42", 2, 2, None, True), ("wholly different subjects entirely", 1, 1, 0.0, False)], "a string, m int, w int, n double, num boolean")
    got = [r[0] for r in rows(df.select(verify.question_faults(F.col("a"), F.col("m"), F.col("w"), F.lit(source), F.col("n"), F.col("num"))))]
    assert got == [[], ["answer too thin", "too like another question", "marks are not those asked for"], [], ["not supported by the section"]]


def test_library(spark):
    t = {"documents": spark.createDataFrame([("a", "A"), ("b", "B")], "doc_id string, title string"), "sections": spark.createDataFrame([("a", "1"), ("b", "1")], "doc_id string, sid string"), "notes": spark.createDataFrame([("a", "n"), ("b", "m")], "doc_id string, markdown string")}
    new = {"documents": t["documents"].where("doc_id = 'a'"), "sections": spark.createDataFrame([("a", "2"), ("a", "3")], "doc_id string, sid string")}
    got = library.replace_documents(t, new)
    assert sorted(rows(got["sections"])) == [("a", "2"), ("a", "3"), ("b", "1")] and got["notes"].count() == 2
    assert library.add_documents(t, new)["notes"].count() == 1
    assert {k: v.count() for k, v in library.remove_documents(t, t["documents"].where("doc_id = 'b'")).items()} == {"documents": 1, "sections": 1, "notes": 1}
    assert rows(library.unknown(spark.createDataFrame([("a",), ("z",)], "doc_id string"), t["documents"])) == [("z",)]
    c = spark.createDataFrame([("a", "1", 1, "y", False), ("a", "1", 0, "x", False), ("a", "1", 2, "ex", True)], "doc_id string, sid string, ord int, text string, is_exercise boolean")
    assert rows(library.section_text(c)) == [("a", "1", "x\n\ny")]
    r = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "q int, sid string, rank int")
    assert sorted(rows(library.distinct_by_first(r, "q", "sid"))) == [(1, "a", 1), (1, "b", 2)]
    assert rows(library.unmatched(spark.createDataFrame([(1,), (2,)], "q int"), r, "q")) == [(1,)]


def test_threshold(spark):
    df = spark.createDataFrame([(0.1, True), (0.2, True), (0.6, False), (0.9, False), (None, True)], "s double, bad boolean")
    assert rows(metrics.best_threshold(df, "s", "bad", [0.0, 0.3, 0.5, 1.0])) == [(0.3, 1.0, 0.0)]
    assert rows(metrics.catch_rates(df.withColumn("d", F.lit(True)), "bad", "d")) == [(1.0, 1.0)]


def test_chapter_numbers_and_titles(spark):
    text = "Chapter 4 Circuits\n\nWires carry charge.\n\n4.1 Ohm and his law\n\nMore volts, more amperes.\n\nUnit IV\n\nLast words."
    got = segment.sections(segment.blocks(spark.createDataFrame([("d", text)], "doc_id string, text string"))).orderBy("ord")
    assert [(r.sid, r.title, r.path) for r in got.collect()] == [("4", "Circuits", []), ("4.1", "4.1 Ohm and his law", ["Circuits"]), ("iv", "Unit IV", [])]


def test_pieces_are_trimmed(spark):
    df = spark.createDataFrame([("  a para \n\n\t\n\nsecond\n \nline  ",)], "text string")
    assert df.select(segment.pieces(F.col("text"))).first()[0] == ["a para", "second\n \nline"]


def test_notes_on_marks_in_words(spark):
    df = spark.createDataFrame([("Newtons (one mark for units) (3 marks) (Half mark) (markers)",)], "t string")
    assert df.select(strip_maths(F.col("t"))).first()[0].split() == ["Newtons", "(markers)"]
