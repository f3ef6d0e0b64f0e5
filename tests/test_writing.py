import json

from pyspark.sql import functions as F

from lectern.operators import writing

SOURCE = "Ohm's law relates voltage and current. Resistance limits current in every conductor. The law reads $V = I R$ for wires."


def test_notes_go_on_where_they_stopped(spark):
    sections = spark.createDataFrame([("d", "1", "One", SOURCE), ("d", "2", "Two", SOURCE), ("d", "3", "Three", None)], "doc_id string, sid string, title string, text string")
    saved = spark.createDataFrame([("d", "1", "kept note", 4, 1), ("x", "9", "elsewhere", 1, 0)], "doc_id string, sid string, markdown string, kept long, dropped long")
    reply = "<think>so</think># Notes\n- Resistance limits current in conductor. Volcanoes erupt molten basalt everywhere.\n- Current is given by $V = I/R$ in the law.\n- So $I = V/R$ holds.%uncertain\n"
    out = {r.sid: r for r in writing.write_notes(sections, saved, lambda p: F.when(p.contains("Section 3"), F.lit(None)).otherwise(F.lit(reply))).collect()}
    assert set(out) == {"1", "2", "3"} and (out["1"].markdown, out["1"].resumed) == ("kept note", True)
    assert out["2"].markdown == "# Notes\n- Resistance limits current in conductor.\n- So $I = V/R$ holds." and (out["2"].kept, out["2"].dropped) == (2, 2)
    assert out["3"].markdown == "" and not out["3"].resumed


def test_questions_are_spread_and_checked(spark):
    sections = spark.createDataFrame([("1", 1, SOURCE), ("2", 2, " "), ("3", 3, SOURCE)], "sid string, ord int, text string")
    calls = sorted((r.sid, r.call, r.wanted) for r in writing.question_calls(sections, 25).collect())
    assert calls == [("1", 0, 10), ("1", 1, 3), ("3", 0, 10), ("3", 1, 2)]
    one = {"question": "How does resistance affect current?", "answer": "Resistance limits current in conductor.", "marks": 2, "marking_points": ["limits current"]}
    two = {"question": "State the law about voltage", "answer": "The law of voltage, current, resistance is $V = I/R$.", "marks": 3, "marking_points": []}
    reply = json.dumps({"questions": [one, two, one, one]})
    existing = spark.createDataFrame([("1", "How does resistance affect current?")], "sid string, text string")
    out = writing.generate_questions(sections, existing, lambda p: F.when(p.contains("Section 1"), F.lit(reply)).otherwise(F.lit("no json")), 4, 2).collect()
    assert [(r.sid, r.place) for r in sorted(out, key=lambda r: r.place)] == [("1", 0), ("1", 1)]
    reasons = {r.place: r.reasons for r in out}
    assert reasons[0] == ["too like another question"] and reasons[1] == ["contradicts a formula", "marks are not those asked for"]
    assert writing.generate_questions(sections, existing, lambda p: F.lit(reply), 0, 2).count() == 0


def test_marking(spark):
    rows = [
        (1, "q", ["States $F = ma$", "more force", "more speed"], "So $a = F/m$ and force.", 5),
        (2, "q", ["a"], " ", 5),
        (3, "q", None, "text", 5),
        (4, "q", ["a", "b"], "broken", 5),
    ]
    answers = spark.createDataFrame(rows, "id int, question string, marking_points array<string>, answer string, most int")
    model = lambda p: F.when(p.contains("broken"), F.lit("?")).otherwise(F.lit('{"points_met": [false, true], "feedback": " good "}'))
    out = {r.id: r for r in writing.grade_answers(answers, model, "id").collect()}
    assert (out[1].awarded, out[1].met, out[1].missing, out[1].by_formula, out[1].feedback) == (3, [True, True, False], ["more speed"], [True, False, False], "good")
    assert (out[2].awarded, out[2].met, out[2].feedback) == (0, [False], "No answer was given.") and out[3].awarded == 0
    assert (out[4].awarded, out[4].missing, out[4].feedback) == (0, ["a", "b"], "The answer could not be marked.")
