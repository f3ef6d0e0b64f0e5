"""Formulas drawn on pages: where they stand, what was read of them, and where they go in the text. Folds over arrays of boxes, all in the JVM.

A box is a struct (l, b, r, t) of doubles, its origin at the lower left of the page. Null arrays count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<l:double,b:double,r:double,t:double>"
# Sizes and gaps in points, and the bounds of a reading.
PAD, JOIN, EDGE, LEAST_WIDTH, LEAST_HEIGHT, HIGHEST, WIDEST = 3.0, 2.0, 40.0, 20.0, 6.0, 80.0, 0.8
INLINE_PAD, INLINE_JOIN, INLINE_MERGE, LEAST_INLINE, WIDEST_INLINE = 4.0, 2.5, 12.0, 1.5, 0.5
LONGEST_READING, WORDY = 600, r"\\(?:text[a-z]*|mathrm|operatorname)\s*\{[^{}]*[A-Za-z]{5,}[^{}]*\}"


def clean_latex(c: Column) -> Column:
    """Without spaces, but for those between a command and a letter."""
    tokens = F.regexp_extract_all(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(r"(?s)\\[A-Za-z]+|\\.|\s+|."), F.lit(0))

    def kept(w: Column, i: Column) -> Column:
        apart = F.coalesce(F.get(tokens, i - 1).rlike(r"^\\[A-Za-z]+$") & F.get(tokens, i + 1).rlike(r"^\p{L}"), F.lit(False))
        return F.when(~w.rlike(r"^\s"), w).when(apart, F.lit(" ")).otherwise("")

    return F.array_join(F.transform(tokens, kept), "")


def plausible(latex: Column) -> Column:
    """Whether a reading may be a formula: not empty, not over long, no whole words in its text commands."""
    return F.coalesce((F.trim(latex) != "") & (F.length(latex) <= LONGEST_READING) & ~latex.rlike(WORDY), F.lit(False))


def touch(a: Column, b: Column) -> Column:
    return (a["r"] >= b["l"]) & (b["r"] >= a["l"]) & (a["t"] >= b["b"]) & (b["t"] >= a["b"])


def around(a: Column, b: Column) -> Column:
    """The smallest box that holds both."""
    return F.struct(F.least(a["l"], b["l"]).alias("l"), F.least(a["b"], b["b"]).alias("b"), F.greatest(a["r"], b["r"]).alias("r"), F.greatest(a["t"], b["t"]).alias("t"))


def _boxes(c: Column) -> Column:
    return F.coalesce(c.cast(f"array<{BOX}>"), F.array().cast(f"array<{BOX}>"))


def _sorted(items: Column, *by: Callable[[Column], Column]) -> Column:
    """Items in ascending order of the keys; equal ones stay in their order."""
    keyed = F.transform(items, lambda x, i: F.struct(*[k(x).alias(f"k{n}") for n, k in enumerate(by)], i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def _runs(items: Column, kind: str, joins: Callable[[Column, Column], Column], both: Callable[[Column, Column], Column]) -> Column:
    """One fold: an item joins the run before it or starts another."""
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))

    def step(a: Column, x: Column) -> Column:
        now = a["now"]
        more = now.isNotNull() & joins(now, x)
        done = F.when(now.isNull() | more, a["done"]).otherwise(F.concat(a["done"], F.array(now)))
        return F.struct(done.alias("done"), F.when(more, both(now, x)).otherwise(x).cast(kind).alias("now"))

    return F.aggregate(items, start, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def equation_regions(texts: Column, paths: Column, width: Column, height: Column) -> Column:
    """Padded boxes of displayed formulas: drawn shapes that touch no text, joined where they are close one below another, top first."""
    texts = _boxes(texts)
    clear = lambda p: ~F.exists(texts, lambda t: touch(p, t))
    small = lambda p: (p["r"] - p["l"] < width * WIDEST) & (p["t"] - p["b"] < HIGHEST)
    lone = _sorted(F.filter(_boxes(paths), lambda p: small(p) & clear(p)), lambda p: -p["t"])
    bands = _runs(lone, BOX, lambda now, p: (p["t"] >= now["b"] - JOIN) & (p["b"] <= now["t"] + JOIN), around)
    sized = F.filter(bands, lambda r: (r["r"] - r["l"] >= LEAST_WIDTH) & (r["t"] - r["b"] >= LEAST_HEIGHT) & (r["l"] >= EDGE) & (r["b"] >= EDGE) & (r["t"] <= height - EDGE))
    padded = F.transform(sized, lambda r: F.struct((r["l"] - PAD).alias("l"), (r["b"] - PAD).alias("b"), (r["r"] + PAD).alias("r"), (r["t"] + PAD).alias("t")))
    return F.filter(padded, clear)


def text_lines(chars: Column) -> Column:
    """Boxes of the lines of a page: a character joins the first line that it overlaps by more than half of the lower of both."""
    lines = F.array().cast(f"array<{BOX}>")

    def step(lines: Column, c: Column) -> Column:
        over = F.transform(lines, lambda n: F.least(n["t"], c["t"]) - F.greatest(n["b"], c["b"]) > 0.5 * F.least(n["t"] - n["b"], c["t"] - c["b"]))
        at = F.array_position(over, F.lit(True))
        return F.when(at == 0, F.concat(lines, F.array(c))).otherwise(F.transform(lines, lambda n, i: F.when(i + 1 == at, around(n, c)).otherwise(n)))

    return F.aggregate(_sorted(_boxes(chars), lambda c: -c["t"]), lines, step)


def inline_regions(chars: Column, paths: Column, display: Column, width: Column) -> Column:
    """array<struct<shapes, crop>> of formulas drawn within lines of text; a crop reaches to the letters on both sides.

    Shapes of a line are joined where they nearly touch, then where only a small gap without letters parts them.
    """
    chars, display = _boxes(chars), _boxes(display)
    lines = text_lines(chars)
    kind = f"struct<shapes:{BOX},line:{BOX}>"

    def line_of(p: Column) -> Column:
        middle = (p["b"] + p["t"]) / 2
        on = F.filter(lines, lambda n: middle.between(n["b"] - 2, n["t"] + 2) & p["l"].between(n["l"] - 5, n["r"] + 5) & (p["t"] - p["b"] <= 2.5 * (n["t"] - n["b"])))
        return F.get(on, F.lit(0))

    free = lambda p: (p["t"] - p["b"] >= LEAST_INLINE) & (p["r"] - p["l"] <= width * WIDEST_INLINE) & ~F.exists(display, lambda d: touch(p, d)) & ~F.exists(chars, lambda c: touch(p, c))
    placed = F.transform(F.filter(_boxes(paths), free), lambda p: F.struct(p.alias("shapes"), line_of(p).alias("line")))
    placed = _sorted(F.filter(placed, lambda x: x["line"].isNotNull()), lambda x: -x["line"]["t"], lambda x: x["shapes"]["l"])
    same = lambda a, x: a["line"] == x["line"]
    both = lambda a, x: F.struct(around(a["shapes"], x["shapes"]).alias("shapes"), a["line"].alias("line"))
    groups = _runs(placed, kind, lambda a, x: same(a, x) & (x["shapes"]["l"] <= a["shapes"]["r"] + INLINE_JOIN), both)
    beside = lambda c, line: (c["b"] < line["t"]) & (c["t"] > line["b"])

    def parted(a: Column, x: Column) -> Column:
        return F.exists(chars, lambda c: beside(c, x["line"]) & (c["l"] >= a["shapes"]["r"] - 0.5) & (c["r"] <= x["shapes"]["l"] + 0.5))

    groups = _runs(groups, kind, lambda a, x: same(a, x) & (x["shapes"]["l"] - a["shapes"]["r"] <= INLINE_MERGE) & ~parted(a, x), both)

    def crop(g: Column) -> Column:
        s, line = g["shapes"], g["line"]
        near = F.filter(chars, lambda c: beside(c, line))
        left = F.array_max(F.concat(F.transform(F.filter(near, lambda c: c["r"] <= s["l"]), lambda c: c["r"]), F.array(s["l"] - INLINE_PAD)))
        right = F.array_min(F.concat(F.transform(F.filter(near, lambda c: c["l"] >= s["r"]), lambda c: c["l"]), F.array(s["r"] + INLINE_PAD)))
        return F.struct(left.alias("l"), (line["b"] - 1).alias("b"), right.alias("r"), (line["t"] + 1).alias("t"))

    return F.transform(groups, lambda g: F.struct(g["shapes"].alias("shapes"), crop(g).alias("crop")))


def shape_key(shapes: Column, region: Column) -> Column:
    """A key of a drawing wherever it stands: sha-1 of its outlines beside the region's corner, in any order.

    ``shapes`` array<struct<a,b,c,d,e,f,points array<struct<kind,x,y>>>>: a matrix and the points of each shape.
    """

    def shape(s: Column) -> Column:
        turn = [F.round(s[k], 3).alias(k) for k in "abcd"]
        points = F.transform(s["points"], lambda p: F.struct(p["kind"].alias("kind"), F.round(p["x"], 1).alias("x"), F.round(p["y"], 1).alias("y")))
        return F.to_json(F.struct(*turn, F.round(s["e"] - region["l"], 1).alias("e"), F.round(s["f"] - region["b"], 1).alias("f"), points.alias("points")))

    size = F.concat_ws(" ", F.round(region["r"] - region["l"], 1).cast("string"), F.round(region["t"] - region["b"], 1).cast("string"))
    return F.sha1(F.concat_ws("\n", F.array_sort(F.transform(shapes, shape)), size))


READ = "array<struct<l:double,b:double,r:double,t:double,latex:string>>"


def place_formulas(text: Column, chars: Column, display: Column, inline: Column) -> Column:
    """The page's text with each formula where it was drawn.

    ``chars`` array<struct<i,l,b,r,t>> gives the boxes of characters by their place in ``text`` (from 0);
    ``display`` and ``inline`` hold boxes with latex. A displayed formula is a paragraph before the first
    character below it; one in a line goes before the first character to its right, or after the line's last.
    """
    chars = F.coalesce(chars.cast("array<struct<i:int,l:double,b:double,r:double,t:double>>"), F.array().cast("array<struct<i:int,l:double,b:double,r:double,t:double>>"))
    places = lambda of: F.transform(of, lambda c: c["i"])

    def shown(f: Column) -> Column:
        below = F.filter(chars, lambda c: (c["b"] + c["t"]) / 2 < f["b"])
        return F.struct((-F.coalesce(F.array_min(places(below)), F.length(text))).alias("at"), F.lit(0).alias("kind"), f["latex"].alias("latex"))

    def within(f: Column) -> Column:
        line = F.filter(chars, lambda c: (c["b"] < f["t"]) & (c["t"] > f["b"]))
        right = F.filter(line, lambda c: c["l"] >= (f["l"] + f["r"]) / 2)
        return F.struct((-F.coalesce(F.array_min(places(right)), F.array_max(places(line)) + 1)).alias("at"), F.lit(1).alias("kind"), f["latex"].alias("latex"))

    none = F.array().cast(READ)
    inserts = F.concat(F.transform(F.coalesce(display.cast(READ), none), shown), F.filter(F.transform(F.coalesce(inline.cast(READ), none), within), lambda x: x["at"].isNotNull()))

    def splice(page: Column, x: Column) -> Column:
        before, after = F.substring(page, F.lit(1), -x["at"]), F.substring(page, 1 - x["at"], F.length(page))
        lead = F.when(before == "", "").when(F.endswith(before, F.lit("\n")), "\n").otherwise("\n\n")
        block = F.concat(lead, F.lit("$$"), x["latex"], F.lit("$$"), F.when(after == "", "").otherwise("\n\n"))
        gap = lambda edge, at: F.when((edge == "") | edge.rlike(at), "").otherwise(" ")
        word = F.concat(gap(before, r"(?U)\s\z"), F.lit("$"), x["latex"], F.lit("$"), gap(after, r"(?U)^\s"))
        return F.concat(before, F.when(x["kind"] == 0, block).otherwise(word), after)

    return F.aggregate(_sorted(inserts, lambda x: x["at"], lambda x: x["kind"]), text, splice)
