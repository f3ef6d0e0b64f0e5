import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import agent, diagrams, export, schedule

from .conftest import rows

STEPS = [("a", "Start here"), ("b", "Boil water"), ("c", "Boil eggs"), ("d", None)]
T = "steps array<struct<id:string,label:string>>, edges array<struct<source:string,target:string,label:string>>"


def test_repair(spark):
    edges = [("a", "Boil water", "then"), ("start", "c", None), ("boil", "c", None), ("a", "a", None), ("a", "b", "again"), ("?", "b", None)]
    df = spark.createDataFrame([(STEPS, edges), (STEPS, []), (None, None), (STEPS[:1], None)], T)
    got = [r[0] for r in rows(df.select(diagrams.repair_flowchart(F.col("steps"), F.col("edges"))))]
    assert [tuple(e) for e in got[0].edges] == [("a", "b", "then"), ("a", "c", None)]
    assert tuple(got[0])[1:] == (6, 2, 2, 4, False, False)
    assert [(e.source, e.target) for e in got[1].edges] == [("a", "b"), ("b", "c"), ("c", "d")] and got[1].chained
    assert got[2].edges == [] and got[3].edges == [] and not got[3].chained


def test_renderers(spark):
    df = spark.createDataFrame([(STEPS[:2], [("a", "b", 'x "y" [z]')])], T)
    assert rows(df.select(diagrams.flowchart(F.col("steps"), F.col("edges"))))[0][0].split("\n") == ["flowchart TD", '    n0["Start here"]', '    n1["Boil water"]', '    n0 -->|"x #quot;y#quot; (z)"| n1']
    one = spark.sql("select array(named_struct('label', 'A', 'children', array('x', 'y')), named_struct('label', 'B', 'children', cast(null as array<string>))) b, array(named_struct('when', '10:30', 'what', 'go')) ev, array('p', 'q') c, array(array('1|2'), array('a', 'b', 'c')) r, array(named_struct('name', 'Ohm', 'expression', 'V_1', 'variables', 'V'), named_struct('name', 'N', 'expression', 'F=ma', 'variables', null)) f, array(named_struct('term', 'T', 'definition', 'D')) g")
    got = rows(one.select(diagrams.mindmap(F.lit(None), F.col("b")), diagrams.timeline(F.lit("t"), F.col("ev")), diagrams.table(F.lit("H"), F.col("c"), F.col("r")), diagrams.formula_sheet(F.lit(None), F.col("f")), diagrams.glossary(F.col("g"))))[0]
    assert got[0].split("\n") == ["mindmap", '  n0["Topic"]', '    n1["A"]', '      n2["x"]', '      n3["y"]', '    n4["B"]']
    assert got[1].split("\n") == ["timeline", "    title t", "    10 -30 : go"]
    assert got[2].split("\n") == ["**H**", "", "| p | q |", "|---|---|", "| 1\\|2 |  |", "| a | b |"]
    assert got[3].split("\n")[4:] == ["| Ohm | $V_1$ | V |", "| N | `F=ma` |  |"] and got[4] == "- **T** — D"


def test_calls(spark):
    text = '<think>no</think> ok <tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call> functools[{"name": "g", "parameters": "{bad"}] <tool_call>oops</tool_call>'
    df = spark.createDataFrame([(text,), (None,), ("plain",)], "t string")
    got = rows(df.select(agent.text_calls(F.col("t")), agent.without_calls(agent.strip_thinking(F.col("t")))))
    assert [tuple(c) for c in got[0][0]] == [("f", '{"x":1}', True), ("", "oops", False), ("g", "{bad", False)]
    assert got[0][1].split() == ["ok"] and got[1] == ([], "") and got[2] == ([], "plain")


def test_scoring(spark):
    df = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (["c", "a"], ["a", "c"]), ([], [])], "w array<string>, m array<string>")
    assert [r[0] for r in rows(df.select(agent.in_order(F.col("w"), F.col("m"))))] == [True, False, True]
    r = spark.createDataFrame([("Not found.", True), ("It is 5. Not found", True), ("It is 5", True), ("NOT FOUND", False)], "a string, ok boolean")
    assert [tuple(x[0]) for x in rows(r.select(agent.refusal(F.col("a"), "not found", F.col("ok"), F.array(F.lit("5")))))] == [(True, False, False), (False, True, False), (False, False, True), (True, False, True)]


def _meets(spark, want, got):
    df = spark.createDataFrame([(json.dumps(got) if got is not None else None,)], "j string")
    return df.select(agent.meets(agent.compiled(want), F.try_parse_json("j"))).first()[0]


@pytest.mark.parametrize(
    ("want", "got", "fits"),
    [
        # texts hold every wanted part, whatever stands between letters and digits
        ({"$contains": ["9.81", "x 40"]}, "0.5 * 9.81 * X-40", True),
        ({"$contains": ["9.81", "41"]}, "0.5 * 9.81 * X-40", False),
        ("Ohm's law", "ohms LAW", True),
        # one of several, and numbers within ends; a text is no number, a truth value neither
        ({"$one_of": ["north", "south"]}, "South", True),
        ({"$one_of": ["north", "south"]}, "west", False),
        ({"$range": [0.5, 2]}, 2, True),
        ({"$range": [0.5, 2]}, 2.5, False),
        ({"$range": [0.5, 2]}, "1", False),
        (7, 7.0, True),
        (0, False, False),
        (False, False, True),
        (False, 0, False),
        # lists by length and place, or by what they hold
        (["b", 2], ["B", 2.0], True),
        (["b"], ["b", "c"], False),
        ({"$min_items": 2}, ["one", "two"], True),
        ({"$min_items": 2}, ["one"], False),
        ({"$all": [{"$min_items": 2}, {"$items_contain": ["granite", "basalt"]}]}, [["Granite", "pale"], ["Basalt", "dark"]], True),
        ({"$all": [{"$min_items": 2}, {"$items_contain": ["granite", "marble"]}]}, [["Granite", "pale"], ["Basalt", "dark"]], False),
        # fields that may be left out, and fields that must be there
        ({"limit": 3, "unit": {"$optional": {"$one_of": ["m", "km"]}}}, {"limit": 3}, True),
        ({"limit": 3, "unit": {"$optional": {"$one_of": ["m", "km"]}}}, {"limit": 3, "unit": "mile"}, False),
        ({"id": {"$any": 1}}, {"id": None}, True),
        ({"id": {"$any": 1}}, {"other": 2}, False),
        ({"id": 1}, None, False),
    ],
)
def test_expectations(spark, want, got, fits):
    assert _meets(spark, want, got) == fits


def test_call_scores(spark):
    want = [{"name": "export", "args": {"format": "markdown"}}, {"name": "export", "args": {"format": "pdf"}}]
    rows_ = [([("export", '{"format": "pdf"}'), ("export", '{"format": "markdown"}')],), ([("export", '{"format": "pdf"}'), ("export", '{"format": "pdf"}')],), ([("export", '{"format": "pdf"}')],), ([],)]
    df = spark.createDataFrame(rows_, "c array<struct<name:string,arguments:string>>")
    assert [tuple(r[0]) for r in rows(df.select(agent.call_score(want, F.col("c"))))] == [(True, True), (True, False), (False, False), (False, False)]
    assert [tuple(r[0]) for r in rows(df.select(agent.call_score([], F.col("c"))))] == [(False, False)] * 3 + [(True, True)]
    with pytest.raises(ValueError):
        agent.compiled({"$nothing": 1})


@pytest.mark.parametrize(("text", "value"), [("2+3*4", 14), ("-2^2", -4), ("2^-1", 0.5), ("2^3^2", 512), ("7//2 % 2", 1), ("sqrt(16)+abs(-1)", 5), ("round(2.567, 2)", 2.57), ("1/0", None), ("2^1001", None), ("__import__('os')", None), ("", None), ("1+", None), ("(1", None), ("9" * 201, None), ("1e3 ÷ 4 × 2", 500)])
def test_calculate(text, value):
    assert agent.calculate(text) == value


def test_export(spark):
    v = "array(named_struct('format', 'mermaid', 'text', 'flowchart TD'))"
    n = spark.sql(f"select 1 k, 2 ord, 'two' markdown, cast(null as array<struct<format:string,text:string>>) visuals union all select 1, 1, 'one', {v}")
    assert rows(export.to_markdown(n, "k")) == [(1, "one\n\n```mermaid\nflowchart TD\n```\n\n---\n\ntwo\n")]
    got = rows(spark.range(1).select(export.safe_name(F.lit("Ch. 4: é!")), export.safe_name(F.lit("??")), export.stable_id(F.lit("deck"))))[0]
    import hashlib

    assert got == ("Ch--4--é", "all", int(hashlib.sha256(b"deck").hexdigest()[:12], 16) % 2**31)


def test_schedule(spark):
    a = spark.sql("select * from values ('q', 1, timestamp'2024-01-01 10:00:00', 1), ('r', 2, timestamp'2024-01-01 10:00:00', 3), ('r', 3, timestamp'2024-01-03 10:00:00', 3), ('n', 4, null, 3) as t(question, id, answered_at, grade)")
    got = {r[0]: r for r in rows(schedule.schedule(a, "question"))}
    assert set(got) == {"q", "r"} and got["q"][2] == 0.212 and str(got["q"][4]) == "2024-01-02 10:00:00"
    assert got["r"][1] == 2 and got["r"][2] > 8 and got["r"][4].day > 10
