from pyspark.sql import functions as F

from lectern.operators import diagrams, pages, segment


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]


def boxes(*of):
    return F.array(*[F.struct(*[F.lit(float(x)).alias(k) for k, x in zip("lbrt", b, strict=True)]) for b in of]).cast(f"array<{pages.BOX}>")


def test_latex_readings(spark):
    got = one(spark, pages.clean_latex(F.lit(r" \frac { a } { 2 }  \bf v \, x \\ b ")), pages.plausible(F.lit(r"\text{hello} x")), pages.plausible(F.lit(r"x_{\mathrm{net}}")), pages.plausible(F.lit(" ")), pages.plausible(F.lit("x" * 601)), pages.plausible(F.lit(None).cast("string")))
    assert list(got) == [r"\frac{a}{2}\bf v\,x\\b", False, True, False, False, False]


def test_displayed_formulas(spark):
    texts = boxes((50, 700, 550, 712), (50, 600, 550, 612))
    paths = boxes((200, 650, 260, 660), (262, 648, 300, 662), (210, 645, 290, 649), (60, 702, 100, 706), (60, 640, 590, 641), (5, 400, 35, 410), (300, 300, 305, 303))
    got = one(spark, pages.equation_regions(texts, paths, F.lit(600.0), F.lit(800.0)), pages.equation_regions(F.lit(None), F.lit(None), F.lit(1.0), F.lit(1.0)))
    assert [tuple(b) for b in got.c0] == [(197.0, 642.0, 303.0, 665.0)] and got.c1 == []


def test_formulas_in_lines(spark):
    chars = boxes(*[(50 + 10 * i, 700, 58 + 10 * i, 710) for i in range(5)], *[(150 + 10 * i, 700, 158 + 10 * i, 710) for i in range(5)])
    paths = boxes((105, 701, 112, 709), (113, 701, 120, 709), (128, 701, 135, 709), (105, 699, 140, 699.5), (400, 701, 410, 709), (52, 701, 56, 709))
    got = one(spark, pages.inline_regions(chars, paths, F.lit(None), F.lit(600.0)), pages.text_lines(chars))
    assert [tuple(b) for b in got.c1] == [(50.0, 700.0, 198.0, 710.0)]
    assert [(tuple(g.shapes), tuple(g.crop)) for g in got.c0] == [((105.0, 701.0, 135.0, 709.0), (101.0, 699.0, 139.0, 711.0))]


def test_formulas_are_placed(spark):
    text = "so is it\nend"
    chars = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(k) for k, v in zip("lbrt", (10 * i, 700 if i < 8 else 600, 10 * i + 8, 710 if i < 8 else 610), strict=True)]) for i in range(len(text)) if i != 8])
    read = lambda *of: F.array(*[F.struct(*[F.lit(float(x)).alias(k) for k, x in zip("lbrt", b[:4], strict=True)], F.lit(b[4]).alias("latex")) for b in of])
    got = one(
        spark, pages.place_formulas(F.lit(text), chars, read((0, 640, 90, 660, "x=1")), read((18, 699, 22, 711, "y"), (85, 699, 95, 711, "z"))),
        pages.place_formulas(F.lit(text), chars, read((0, 500, 9, 510, "e")), F.lit(None)), pages.place_formulas(F.lit(""), F.lit(None), F.lit(None), F.lit(None)),
    )
    assert got.c0 == "so $y$ is it $z$\n\n$$x=1$$\n\nend"
    assert got.c1 == text + "\n\n$$e$$" and got.c2 == ""


def test_a_drawing_has_one_key(spark):
    shape = lambda e, x: F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("abcdef", (1, 0, 0, 1, e, 5), strict=True)], F.array(F.struct(F.lit(1).alias("kind"), F.lit(float(x)).alias("x"), F.lit(2.0).alias("y"))).alias("points"))
    region = lambda x: boxes((x, 0, x + 10, 10))[0]
    got = one(spark, pages.shape_key(F.array(shape(3, 1), shape(4, 2)), region(0)), pages.shape_key(F.array(shape(104, 2), shape(103, 1)), region(100)), pages.shape_key(F.array(shape(3, 1)), region(0)))
    assert got.c0 == got.c1 != got.c2


def test_problems_of_diagrams(spark):
    cases = [
        ("flowchart", 'flowchart TD\n    n0["A n9"]\n    n0 --> n7', ["undeclared nodes: ['n7']"]),
        ("flowchart", 'flowchart TD\n    n0["A"]\n    n1["B"]\n    n0 --> n1', []),
        ("flowchart", "flowchart TD", ["empty flowchart"]),
        ("mindmap", 'map\n  n0["A"', ["unknown diagram type", "unbalanced brackets or quotes on line 2"]),
        ("table", "| A | B |\n|---|---|\n| 1 | 2 | 3 |", ["1 table row(s) with the wrong number of cells"]),
        ("table", "| A | B |\n|---|---|\n| 1 \\| x | 2 |", []),
        ("timeline", "", ["unknown diagram type"]),
    ]
    rows = spark.createDataFrame(cases, "kind string, text string, want array<string>").select("want", diagrams.problems(F.col("kind"), F.col("text")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_bookmarks(spark):
    blocks = [("Front matter", 1), ("1 Circuits Circuits carry charge.", 2), ("More.", 2), ("1.1 Ohm's law", 3), ("Ohm found it.", 3), ("Key Terms: charge", 4)]
    toc = [("1 Circuits", 1, 2), ("1.1 Ohm’s Law", 2, 3), ("Key terms", 2, 4), ("Gone", 1, 9), ("Same page", 3, 4)]
    docs = spark.createDataFrame([("d", blocks, toc), ("e", blocks[:1], None)], "doc_id string, blocks array<struct<text:string,page:int>>, toc array<struct<title:string,level:int,page:int>>")
    got = {(r.doc_id, r.sid): (r.title, r.level, r.path, r.text) for r in segment.bookmark_sections(docs).collect()}
    assert got[("d", "front")][3] == "Front matter" and got[("e", "all")][3] == "Front matter"
    assert got[("d", "1")] == ("1 Circuits", 1, [], "Circuits carry charge.\n\nMore.")
    assert got[("d", "1.1")][2] == ["1 Circuits"] and got[("d", "1.1")][3].endswith("Ohm found it.")
    assert got[("d", "s3")][3] == "" and got[("d", "s4")][:2] == ("Same page", 3) and got[("d", "s4")][3].endswith("charge")
    assert one(spark, segment.strip_title(F.lit("Key Terms abdomen"), F.lit("key-terms")), segment.strip_title(F.lit("x"), F.lit("?"))).c0 == "abdomen"
