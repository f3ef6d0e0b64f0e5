from pyspark.sql import functions as F

from lectern.operators import metrics, segment
from lectern.sources import seams


def test_recognised_lines(spark):
    rows = [
        (1, [("a", 0.0, 10.0, 0.5), ("b", 12.0, 22.0, 1.0), ("c", 40.0, 50.0, 0.0)], "a\nb\n\nc", 0.5),
        (2, [("a", None, None, 1.0), ("b", None, None, 1.0)], "a b", 1.0),
        (3, [], "", 0.0),
        (4, None, "", 0.0),
        (5, [("flat", 3.0, 3.0, 1.0), ("next", 5.0, 5.0, 1.0)], "flat\n\nnext", 1.0),
    ]
    t = spark.createDataFrame(rows, f"i int, lines {seams.LINES}, want string, score double")
    out = t.select("want", "score", seams.recognised_text(F.col("lines")).alias("r")).collect()
    assert [(r.r.text, r.r.score) for r in out] == [(r.want, r.score) for r in out]


def test_files_through_seams(spark):
    files = spark.createDataFrame([("x", "p.png", "png", b"1"), ("y", "b.pdf", "pdf", b"2")], "id string, path string, kind string, content binary")
    line = F.array(F.struct(F.lit("seen").alias("text"), F.lit(0.0).alias("top"), F.lit(1.0).alias("bottom"), F.lit(0.9).alias("score")))
    assert [tuple(r) for r in seams.images(files, lambda c: line).collect()] == [("x", "p.png", "seen", 0.9)]
    pages = F.array(F.struct(F.lit(1).alias("page"), F.lit("Cover\n\n 1 Law The law.").alias("text")))
    marks = F.array(F.struct(F.lit(" ").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("page")), F.struct(F.lit("1 Law").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("page")))
    got = {r.sid: r.text for r in segment.bookmark_sections(seams.pdfs(files, lambda c: pages, lambda c: marks)).collect()}
    assert got == {"front": "Cover", "1": "The law."}


def test_verdict_of_runs(spark):
    v, spec = "metric string, value double", "metric string, direction int, band double, relative boolean, gated boolean"
    base = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 10.0), ("d", 1.0)], v)
    specs = spark.createDataFrame([("a", 1, 0.02, False, True), ("b", 1, 0.5, True, True), ("c", -1, 0.1, True, False), ("d", 1, 0.1, False, True)], spec)

    def run(*values):
        m = metrics.compare_runs(base, spark.createDataFrame(list(zip("abcd", values, strict=False)), v), specs)
        return {r.metric: r.status for r in m.collect()}, metrics.verdict(m).collect()[0].verdict

    assert run(1.0, 0.0, 10.5, 1.0) == ({"a": "PASS", "b": "PASS", "c": "INFO", "d": "PASS"}, "PASS")
    assert run(0.97, 0.0, 15.0, 1.0) == ({"a": "SUSPECT", "b": "PASS", "c": "INFO-FAIL", "d": "PASS"}, "SUSPECT")
    assert run(1.0, -0.1, 10.0) == ({"a": "PASS", "b": "FAIL", "c": "INFO", "d": "MISSING"}, "FAIL")


def test_fingerprints_tell_inputs_apart(spark):
    one = lambda *rows, build="1": metrics.fingerprint(spark.createDataFrame(list(rows), "name string, content binary"), build).collect()[0].fingerprint
    a = one(("x", b"1"), ("y", b"2"))
    assert len(a) == 16 and a == one(("y", b"2"), ("x", b"1")) and len({a, one(("x", b"1"), ("y", b"3")), one(("x", b"1"), ("y", b"2"), build="2")}) == 3
