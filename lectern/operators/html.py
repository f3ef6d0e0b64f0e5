"""Notes as pages of HTML that load nothing from elsewhere: a small Markdown reader, formulas left as written, diagrams as figures."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CSP = "default-src 'none'; script-src 'unsafe-inline'; style-src 'unsafe-inline'; img-src data:; font-src data:"
STYLE = "body{display:grid;grid-template-columns:minmax(0,46rem);justify-content:center;font:17px/1.6 serif}table{border-collapse:collapse}td,th{border:1px solid;padding:.3em}.math,code,pre{font-family:monospace}"
MATHS = re.compile(r"\$\$.+?\$\$|\$[^$\n]+?\$", re.S)
INLINE = ((re.compile(r"`([^`]+)`"), r"<code>\1</code>"), (re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"), (re.compile(r"(?<![*\w])\*([^*\s][^*]*?)\*(?![*\w])"), r"<em>\1</em>"))
ITEM = re.compile(r"(\s*)([-*+]|\d+[.)])\s+(.*)")


def _line(text: str) -> str:
    out = html.escape(text)
    for pattern, by in INLINE:
        out = pattern.sub(by, out)
    return out


def _table(rows: list[str]) -> str:
    cells = [[c.strip().replace("\x01", "|") for c in r.strip().strip("|").replace("\\|", "\x01").split("|")] for r in rows]
    made = ["<tr>" + "".join(f"<{tag}>{_line(c)}</{tag}>" for c in row) + "</tr>" for row, tag in [(cells[0], "th"), *((r, "td") for r in cells[2:])]]
    return "<table>" + "".join(made) + "</table>"


def _list(items: list[re.Match]) -> str:
    tag = "ol" if items[0][2][0].isdigit() else "ul"
    return f"<{tag}>" + "".join(f"<li>{_line(m[3])}</li>" for m in items) + f"</{tag}>"


def figure(diagram: str) -> str:
    return f'<figure class="diagram"><pre class="mermaid">{html.escape(diagram)}</pre></figure>'


def _blocks(lines: list[str]):
    """(kind, lines) of each block in order."""
    at = 0
    while at < len(lines):
        line, start = lines[at], at
        fence = re.match(r"\s*```+\s*(\w*)", line)
        if fence:
            at += 1
            while at < len(lines) and not lines[at].lstrip().startswith("```"):
                at += 1
            yield f"fence {fence[1]}", lines[start + 1 : at]
            at += 1
            continue
        if line.lstrip().startswith("|") and at + 1 < len(lines) and re.fullmatch(r"[\s|:-]*-[\s|:-]*", lines[at + 1]):
            kind, more = "table", lambda s: s.lstrip().startswith("|")
        elif ITEM.match(line):
            kind, more = "list", ITEM.match
        elif re.match(r"#{1,6}\s", line):
            kind, more = "heading", lambda s: False
        elif not line.strip():
            kind, more = "blank", lambda s: not s.strip()
        else:
            kind, more = "text", lambda s: s.strip() and not ITEM.match(s) and not re.match(r"#{1,6}\s|\s*```", s)
        at += 1
        while at < len(lines) and more(lines[at]):
            at += 1
        yield kind, lines[start:at]


def markdown_html(text: str) -> str:
    """Headings, lists, tables, fences, emphasis and code; HTML in the text is escaped, formulas are taken out first."""
    spans: list[str] = []

    def lift(m: re.Match) -> str:
        spans.append(m[0])
        return f"\x02{len(spans) - 1}\x03"

    out = []
    for kind, lines in _blocks(MATHS.sub(lift, re.sub("[\x01-\x03]", "", text)).splitlines()):
        if kind.startswith("fence"):
            body = "\n".join(lines) + "\n" if lines else ""
            out.append(figure(body) if kind == "fence mermaid" else f"<pre><code>{html.escape(body)}</code></pre>")
        elif kind == "heading":
            marks, _, title = lines[0].partition(" ")
            out.append(f"<h{len(marks)}>{_line(title.strip())}</h{len(marks)}>")
        elif kind != "blank":
            out.append(_table(lines) if kind == "table" else _list([ITEM.match(x) for x in lines]) if kind == "list" else f"<p>{_line(chr(10).join(lines))}</p>")
    shown = lambda m: f'<span class="math" title="{html.escape(spans[int(m[1])])}">{html.escape(spans[int(m[1])].strip("$").strip())}</span>'
    return re.sub("\x02(\\d+)\x03", shown, "\n".join(out))


@F.pandas_udf(StringType())
def html_of(markdown: pd.Series) -> pd.Series:
    return markdown.map(markdown_html, na_action="ignore")


@F.pandas_udf(StringType())
def figure_of(diagram: pd.Series) -> pd.Series:
    return diagram.map(figure, na_action="ignore")


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_html(notes: DataFrame, *key: str, title: str, drawer: str | None = None) -> DataFrame:
    """(key..., html): one page of the notes (key..., ord, sid, title, markdown, visuals array<struct<format,text>>) of each key.

    ``drawer`` is the source of a script that draws diagrams; without one a page with diagrams says that they stand as text.
    """
    v = notes.select(*key, "ord", F.posexplode_outer("visuals").alias("j", "v")).where("j is not null")
    drawn = F.when(F.col("v.format") == "mermaid", figure_of("v.text")).otherwise(html_of("v.text"))
    v = v.select(*key, "ord", "j", drawn.alias("h")).groupBy(*key, "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "h"))), lambda x: x["h"]), "").alias("drawn"))
    label = F.when(F.startswith(F.col("title"), F.col("sid")), F.col("title")).otherwise(F.concat_ws(" ", "sid", "title"))
    n = notes.join(v, [*key, "ord"], "left").select(*key, F.struct("ord", _escaped(label).alias("label"), F.concat(html_of(F.coalesce("markdown", F.lit(""))), F.coalesce("drawn", F.lit(""))).alias("body")).alias("n"))
    page = n.groupBy(*key).agg(F.array_sort(F.collect_list("n")).alias("ns"))
    at = lambda i: i.cast("string")
    toc = F.array_join(F.transform("ns", lambda x, i: F.concat(F.lit('<li><a href="#s'), at(i), F.lit('">'), x["label"], F.lit("</a></li>"))), "")
    body = F.array_join(F.transform("ns", lambda x, i: F.concat(F.lit('<section id="s'), at(i), F.lit('">'), x["body"], F.lit("</section>"))), "")
    draws = F.contains(body, F.lit('class="mermaid"'))
    script = f"<script>{drawer}</script><script>mermaid.initialize({{startOnLoad:true,securityLevel:'strict'}});</script>" if drawer else '<p class="note">Diagrams are shown as their source text.</p>'
    head = f'<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta http-equiv="Content-Security-Policy" content="{CSP}">\n<title>{html.escape(title)}</title>\n<style>{STYLE}</style>\n</head>\n<body>\n<header><h1>{html.escape(title)}</h1></header>\n<nav><ol>'
    return page.select(*key, F.concat(F.lit(head), toc, F.lit("</ol></nav>\n<main>"), body, F.lit("</main>\n"), F.when(draws, script).otherwise(""), F.lit("\n</body>\n</html>\n")).alias("html"))
