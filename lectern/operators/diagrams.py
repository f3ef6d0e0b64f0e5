"""Diagrams and tables as text, and repair of flowcharts: column expressions over arrays, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import squash, strip_space

EDGE = "array<struct<source:string,target:string,label:string>>"


def _line(c: Column) -> Column:
    return strip_space(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def node_text(c: Column) -> Column:
    """Text that is safe inside a quoted node: quotes escaped, brackets and braces rounded."""
    return F.translate(F.replace(_line(c), F.lit('"'), F.lit("#quot;")), "[]{}", "()()")


def cell(c: Column) -> Column:
    return F.replace(_line(c), F.lit("|"), F.lit("\\|"))


def _lines(head: Column, *parts: Column) -> Column:
    return F.array_join(F.concat(F.array(head), *parts), "\n")


def _resolve(steps: Column, ref: Column) -> Column:
    """The id that ``ref`` names: an id, the only equal label, or else the only label that holds it or is held by it."""
    key = squash(ref)
    equal = F.filter(steps, lambda s: squash(s["label"]) == key)
    part = F.filter(steps, lambda s: (squash(s["label"]) != "") & (F.contains(squash(s["label"]), key) | F.contains(key, squash(s["label"]))))
    found = F.when(F.size(equal) == 1, F.get(equal, F.lit(0))["id"]).when(F.size(part) == 1, F.get(part, F.lit(0))["id"])
    return F.when(F.exists(steps, lambda s: s["id"] == ref), ref).when(key != "", found)


def repair_flowchart(steps: Column, edges: Column) -> Column:
    """struct(edges, edges_in, edges_kept, edges_relinked, edges_dropped, chained, was_valid).

    ``steps`` array<struct<id,label>>, ``edges`` array<struct<source,target,label>>. Ends that name no step,
    loops and repeats are dropped; if none is left, the steps are chained in order. Null arrays count as empty.
    """
    steps = F.coalesce(steps, F.array().cast("array<struct<id:string,label:string>>"))
    edges = F.coalesce(edges.cast(EDGE), F.array().cast(EDGE))
    ends = F.transform(edges, lambda e: F.struct(_resolve(steps, e["source"]).alias("s"), _resolve(steps, e["target"]).alias("t"), e.alias("e")))
    sound = F.filter(ends, lambda x: x["s"].isNotNull() & x["t"].isNotNull() & (x["s"] != x["t"]))
    pairs = F.transform(sound, lambda x: F.struct(x["s"], x["t"]))
    once = F.filter(sound, lambda x, i: F.array_position(pairs, F.struct(x["s"], x["t"])) == i + 1)
    kept = F.transform(once, lambda x: F.struct(x["s"].alias("source"), x["t"].alias("target"), F.nullif(x["e"]["label"], F.lit("")).alias("label"))).cast(EDGE)
    moved = F.size(F.filter(once, lambda x: (x["s"] != x["e"]["source"]) | (x["t"] != x["e"]["target"])))
    chain = F.transform(F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))), lambda s, i: F.struct(F.get(steps, i)["id"].alias("source"), s["id"].alias("target"), F.lit(None).cast("string").alias("label"))).cast(EDGE)
    chained = (F.size(once) == 0) & (F.size(steps) > 1)
    dropped = F.size(edges) - F.size(once)
    return F.struct(
        F.when(chained, chain).otherwise(kept).alias("edges"),
        F.size(edges).alias("edges_in"),
        F.size(once).alias("edges_kept"),
        moved.alias("edges_relinked"),
        dropped.alias("edges_dropped"),
        chained.alias("chained"),
        ((F.size(edges) > 0) & (moved == 0) & (dropped == 0)).alias("was_valid"),
    )


def flowchart(steps: Column, edges: Column) -> Column:
    """Text of a repaired flowchart; nodes are numbered in the order of ``steps``."""
    ids = F.transform(steps, lambda s: s["id"])
    node = lambda ref: F.concat(F.lit("n"), (F.array_position(ids, ref) - 1).cast("string"))
    arrow = lambda e: F.when(F.coalesce(e["label"], F.lit("")) != "", F.concat(F.lit(' -->|"'), node_text(e["label"]), F.lit('"| '))).otherwise(" --> ")
    boxes = F.transform(steps, lambda s: F.concat(F.lit("    "), node(s["id"]), F.lit('["'), node_text(F.coalesce(s["label"], s["id"])), F.lit('"]')))
    links = F.transform(repair_flowchart(steps, edges)["edges"], lambda e: F.concat(F.lit("    "), node(e["source"]), arrow(e), node(e["target"])))
    return _lines(F.lit("flowchart TD"), boxes, links)


def mindmap(root: Column, branches: Column) -> Column:
    """Text of a map of ``branches`` array<struct<label,children array<string>>>; nodes are numbered in reading order."""
    named = lambda pad, t: F.struct(F.lit(pad).alias("pad"), t.alias("t"))
    flat = F.flatten(F.transform(branches, lambda b: F.concat(F.array(named("    ", b["label"])), F.transform(F.coalesce(b["children"], F.array().cast("array<string>")), lambda c: named("      ", c)))))
    line = lambda pad, i, t: F.concat(pad, F.lit("n"), i.cast("string"), F.lit('["'), node_text(t), F.lit('"]'))
    return _lines(F.lit("mindmap"), F.array(line(F.lit("  "), F.lit(0), F.coalesce(root, F.lit("Topic")))), F.transform(flat, lambda x, i: line(x["pad"], i + 1, x["t"])))


def timeline(title: Column, events: Column) -> Column:
    """Text of a timeline of ``events`` array<struct<when,what>>; colons would end a field, so they become dashes."""
    plain = lambda c: F.replace(node_text(c), F.lit(":"), F.lit(" -"))
    return _lines(F.lit("timeline"), F.array(F.concat(F.lit("    title "), plain(F.coalesce(title, F.lit("Timeline"))))), F.transform(events, lambda e: F.concat(F.lit("    "), plain(e["when"]), F.lit(" : "), plain(e["what"]))))


def _bold(c: Column) -> Column:
    return F.concat(F.lit("**"), cell(c), F.lit("**"))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table(title: Column, columns: Column, rows: Column) -> Column:
    """A Markdown table; rows are cut or filled up to the number of columns."""
    columns = F.when(F.size(columns) > 0, F.transform(columns, cell)).otherwise(F.array(F.lit("Item")))
    width = F.size(columns)
    fit = F.transform(rows, lambda r: _row(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.get(r, i)))))
    return _lines(_bold(title), F.array(F.lit(""), _row(columns), F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))), fit)


def formula_sheet(title: Column, formulas: Column) -> Column:
    """A table of ``formulas`` array<struct<name,expression,variables>>: LaTeX between dollars, other text as code."""
    shown = lambda e: F.when(e.rlike(r"[\\^_{}]"), F.concat(F.lit("$"), e, F.lit("$"))).otherwise(F.concat(F.lit("`"), e, F.lit("`")))
    body = F.transform(formulas, lambda f: _row(F.array(cell(f["name"]), cell(shown(F.coalesce(f["expression"], F.lit("")))), cell(f["variables"]))))
    return _lines(_bold(F.coalesce(title, F.lit("Formulas"))), F.array(F.lit(""), F.lit("| Name | Formula | Symbols |"), F.lit("|---|---|---|")), body)


def glossary(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- **"), cell(t["term"]), F.lit("** — "), cell(t["definition"]))), "\n")


DRAWN = ("flowchart", "mindmap", "timeline")


def problems(kind: Column, text: Column) -> Column:
    """What would stop a diagram or table from being drawn, as texts; none if it is sound. Names in labels are no nodes."""
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    drawn, flow = kind.isin(*DRAWN), kind == "flowchart"
    named = F.regexp_extract_all(text, F.lit(r"\b(n\d+)\["), F.lit(1))
    lost = F.array_sort(F.array_except(F.regexp_extract_all(F.regexp_replace(text, '"[^"\n]*"', ""), F.lit(r"\b(n\d+)\b"), F.lit(1)), named))
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))
    uneven = F.transform(lines, lambda x, i: F.when((i > 0) & ((count(x, "[") != count(x, "]")) | (count(x, '"') % 2 == 1)), F.concat(F.lit("unbalanced brackets or quotes on line "), (i + 1).cast("string"))))
    rows = F.filter(lines, lambda x: F.startswith(x, F.lit("| ")))
    width = lambda x: F.size(F.split(x, r" \| "))
    ragged = F.size(F.filter(rows, lambda x: width(F.replace(x, F.lit("\\|"), F.lit(""))) != width(F.get(rows, F.lit(0)))))
    faults = F.concat(
        F.array(
            F.when(drawn & ~F.coalesce(F.get(lines, F.lit(0)), F.lit("")).rlike("^(?:" + "|".join(DRAWN) + ")"), "unknown diagram type"),
            F.when(flow & (F.size(lost) > 0), F.concat(F.lit("undeclared nodes: ['"), F.array_join(lost, "', '"), F.lit("']"))),
        ),
        F.when(drawn, uneven).otherwise(F.array().cast("array<string>")),
        F.array(F.when(flow & (F.size(lines) < 2), "empty flowchart"), F.when(~drawn & (ragged > 0), F.concat(ragged.cast("string"), F.lit(" table row(s) with the wrong number of cells")))),
    )
    return F.array_compact(faults)
