import json
import re

from pyspark.sql import functions as F

from lectern.operators import html, tools


def test_calls_are_held_against_their_parameters(spark):
    calls = [
        ("calculate", {"expression": "1+1"}, None),
        ("calculate", {"expr": "1+1"}, "expression: missing; expr: not a parameter"),
        ("calculate", "{broken", "arguments were not valid JSON"),
        ("calculate", [1], ": an object wanted"),
        ("fly", {}, "unknown tool fly"),
        ("search_book", {"query": "x", "top_k": 5, "scope": None}, None),
        ("search_book", {"query": None, "top_k": 21}, "query: text wanted; top_k: a whole number from 1 to 20 wanted"),
        ("make_table", {"title": "t", "columns": ["a"], "rows": ["a | b"]}, "columns: at least 2 wanted; rows.0: a list wanted"),
        ("make_table", {"title": "t", "columns": ["a", "b"], "rows": [["x", "y"]]}, None),
        ("make_flowchart", {"title": "t", "steps": [{"id": "1", "label": "A"}, {"id": "2"}], "edges": [{"source": "1", "target": "2", "label": None}]}, "steps.1.label: missing"),
        ("generate_questions", {"topic": "x", "count": 2.5, "marks": True, "question_type": "odd"}, "count: a whole number from 1 to 20 wanted; marks: a whole number from 1 to 25 wanted; question_type: one of mcq, short, long, numerical, diagram, case_study"),
        (None, {}, "unknown tool "),
    ]
    rows = spark.createDataFrame([(n, a if isinstance(a, str) else json.dumps(a), w) for n, a, w in calls], "name string, a string, want string")
    out = rows.select("name", "want", tools.call_fault(F.col("name"), F.col("a")).alias("got")).collect()
    assert [(r.name, r.got) for r in out] == [(r.name, r.want) for r in out]
    assert len(json.loads(tools.schemas())) == len(tools.TOOLS) and json.loads(tools.schemas(["calculate"]))[0]["function"]["name"] == "calculate"


def test_calculations_in_a_column(spark):
    out = spark.createDataFrame([("3.2 * 450",), ("import os",), (None,), ("2**3 + sqrt(16)",)], "e string").select(tools.calculated("e").alias("v")).collect()
    assert [r.v for r in out] == [1440.0, None, None, 12.0]


def test_markdown():
    page = html.markdown_html("# A *b*\n\n<script>x</script> & $a_1*b_2*c$ and $$V = IR$$\nnext `c<d`\n\n- **one**\n- two\n\n1. first\n\n| Law | Says |\n|---|---|\n| a \\| b | *c* |\n\n```mermaid\nflowchart TD\n  A --> B\n```\n```py\nx\n")
    assert "<script>" not in page and "<h1>A <em>b</em></h1>" in page and "<code>c&lt;d</code>" in page
    assert '<span class="math" title="$a_1*b_2*c$">a_1*b_2*c</span>' in page and 'title="$$V = IR$$">V = IR</span>' in page
    assert "<ul><li><strong>one</strong></li><li>two</li></ul>" in page and "<ol><li>first</li></ol>" in page
    assert "<tr><th>Law</th><th>Says</th></tr><tr><td>a | b</td><td><em>c</em></td></tr>" in page
    assert '<pre class="mermaid">flowchart TD\n  A --&gt; B\n</pre>' in page and page.endswith("<pre><code>x\n</code></pre>") and html.markdown_html("") == ""


def test_pages(spark):
    notes = spark.createDataFrame(
        [("d", 2, "4.2", "4.2 Nodes", "text", None), ("d", 1, "4.1", "Loops <b>", "# 4.1", [("mermaid", 'flowchart TD\n  A["x"]'), ("markdown", "*v*")]), ("e", 1, "1", "One", None, [])],
        "doc_id string, ord int, sid string, title string, markdown string, visuals array<struct<format:string,text:string>>",
    )
    out = {r.doc_id: r.html for r in html.to_html(notes, "doc_id", title="Notes & more", drawer="window.x=1;").collect()}
    d = out["d"]
    assert d.index('<a href="#s0">4.1 Loops &lt;b&gt;</a>') < d.index('<a href="#s1">4.2 Nodes</a>') and d.index("<em>v</em>") < d.index("<p>text</p>")
    assert "<script>window.x=1;</script>" in d and "A[&quot;x&quot;]" in d and "Notes &amp; more" in d and not re.search(r"(src|href)=[\"']?(https?:)?//", d)
    assert "<script" not in out["e"] and "as their source text" in html.to_html(notes, "doc_id", title="t").where("doc_id = 'd'").collect()[0].html
