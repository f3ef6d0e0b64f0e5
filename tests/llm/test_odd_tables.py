"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns of clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import op1_ngram_jaccard as op1
from lectern.llm import op2_toxicity as op2
from lectern.llm import op3_decontamination as op3
from lectern.llm import op4_url_filter as op4
from lectern.llm import op5_embedding_neardup as op5
from lectern.llm import op6_html_extraction as op6
from lectern.llm import op7_token_counts as op7
from lectern.llm import op8_mixing as op8
from lectern.llm import op9_lm_scoring as op9
from lectern.llm import op10_license_scan as op10
from lectern.llm.common import components

#: Names that the operators use for columns of their own.
CLASH = ("key", "_key", "score", "size", "line", "t", "u", "categories", "n", "sig", "gid", "h", "tie", "target", "copies", "_d", "_k", "_url", "html_", "toxic", "part", "k0", "doc")
LONG = " ".join(f"word{i % 997}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, LONG, "b"), (5, LONG, "b"), (None, "mit license here", "a"), (6, "mit license here", "a"), (6, "mit license here", "a"), (6, "mit license here", "b"), (7, "x" * 200_000, None), (8, "one two three four five six seven", "a"), (9, "one two three four five six seven", "a")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def ids(df, *columns):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", *columns).collect())))


def test_jaccard(odd):
    got = op1.jaccard_components(odd).select("doc_id", "n_shingles", "component_id").collect()
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == 12 and of[1] == (0, 1) and of[2] == (0, 2) and of[3] == (0, 3)
    assert of[4] == (997, 4) and of[5] == (997, 4) and of[6] == (1, 6) and of[None] == (1, 6) and of[9] == (3, 8) and of[7] == (1, 7)


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'mild'} w{'abcdefghij'[i % 7]} w{'klmnopqrst'[i % 9]} the") for i in range(400)], "doc_id long, text string")
    scorer = op2.fit_toxicity(texts.withColumn("toxic", F.lit("clash")).withColumn("part", F.lit(1)), labels)
    got = op2.score_toxicity(odd, scorer, *odd.columns, name="made")
    assert got.columns == [*odd.columns, "made"] and got.count() == 12
    assert got.where("made is null or made < 0 or made > 1").count() == 0
    assert got.where("doc_id in (6)").select("made").distinct().count() == 1
    assert op2.fit_toxicity(texts, labels.limit(0)) is None and op2.fit_toxicity(texts.limit(0), labels) is None
    assert op2.fit_toxicity(texts, labels.where("toxic = 0")) is None
    assert op2.score_toxicity(odd.limit(0), scorer, "doc_id").count() == 0


def test_toxicity_brute_force(spark):
    """The models by their definition, in plain Python, on texts of five words."""
    from math import log, sqrt
    from statistics import median
    from zlib import crc32

    vocabulary = ["the", "of", "and", "red", "green", "blue", "oak", "elm", "ash", "fir"]
    rows = [(i, " ".join(["vile" if i % 3 == 0 and j in (i % 5, (i + 2) % 5) else vocabulary[(i * 7 + j * j * 3 + i // 10) % 10] for j in range(5)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = op2.fit_toxicity(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    before = ({}, {})
    for i, text in rows:
        if crc32(str(i).encode()) % 5 in (1, 2, 3):
            w = text.split()
            for v, x in zip(["", *w], w):
                before[i % 3 == 0].setdefault(x, set()).add(v)
    n = [{w: len(s) for w, s in b.items()} for b in before]
    kinds = len(n[0]) + len(n[1]) + 1

    def p(c, w):
        total = sum(n[c].values())
        return max(n[c].get(w, 0) - 0.75, 0) / total + 0.75 * len(n[c]) / total * ((w in n[0]) + (w in n[1])) / kinds

    known = {*n[0], *n[1]}
    assert len(scorer.model.keys) == len(known)
    for w in known:
        assert abs(scorer.model.of(w) - log(p(1, w) / p(0, w))) < 1e-9
    for _, text in rows[:30]:
        r = [scorer.model.of(w) for w in text.split()]
        far = [x - median(r) for x in r]
        want = sum((x > 0) * max(x - scorer.tau, 0) - (x < 0) * max(-x - scorer.tau, 0) for x in far) / len(r) * sqrt(len(set(text.split())))
        assert abs(scorer.model.figure(text, scorer.tau) - want) < 1e-9
    got = {r.doc_id: r.score for r in op2.score_toxicity(docs, scorer, "doc_id").collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(300))


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "one two three four five six seven", "x"), (2, None, "x"), (3, "", "x"), (4, " ".join(LONG.split()[:200]), "x")], "item_id long, text string, key string")
    got = {(r.doc_id, r.item_id) for r in op3.contaminated(odd, items).collect()}
    assert got == {(8, 1), (9, 1), (4, 4), (5, 4)}
    assert op3.contaminated(odd.limit(0), items).count() == 0 and op3.contaminated(odd, items.limit(0)).count() == 0


def test_urls(spark):
    caps = spark.sql("select * from values ('http://spam-farm.example.org/a', timestamp'2024-02-01', 1, 2, 'c'), ('http://spam-farm.example.org/a', timestamp'2024-02-01', 1, 2, 'c'), (null, null, 3, 4, null), ('x', timestamp'2024-01-01', 5, 6, '') as v(url, fetched_at, t, u, `_k0`)")
    got = op4.filter_urls(caps, op4.entry_table(spark), "url", "t", "u", "_k0")
    assert got.columns == ["url", "t", "u", "_k0", "blocked", "categories", "pattern"]
    assert sorted((r.t, r.blocked, r.categories) for r in got.collect()) == [(1, True, "spam"), (1, True, "spam"), (3, False, ""), (5, False, "")]
    assert op4.filter_urls(caps, op4.entry_table(spark).limit(0), "t").where("blocked").count() == 0


def test_embeddings(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "c"), (1, [0.0, 1.0], "c"), (2, [1.0, 0.0], "c"), (3, [], "c"), (4, None, "c"), (5, [float("inf"), 1.0], "c")], "vec_id long, embedding array<double>, rep string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in op5.near_duplicates(df).collect())
    assert (1, 1, 1, True) in got and (1, 0, 1, True) in got and (2, 1, 1, False) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got and (5, 0, 5, True) in got and len(got) == 6
    assert op5.near_duplicates(df.limit(0)).count() == 0


def vectors_by_pairs(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) of each row by comparing every pair of rows."""
    unit = [[x / sum(y * y for y in v) ** 0.5 for x in v] for _, v in rows]
    near = [[j for j in range(len(rows)) if j != i and len(unit[i]) == len(unit[j]) and sum(a * b for a, b in zip(unit[i], unit[j])) >= least] for i in range(len(rows))]
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        named = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((name, len(near[i]), named, named is None or name == named))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])],
    [(None, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.001])],
    [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, -1.0]), (7, [-0.0, -1.0]), (9, [1.0]), (8, [2.0])],
    [(5, [1.0, i / 500]) for i in range(60)] + [(i, [1.0, 0.3 + i / 500]) for i in range(60)],
])
def test_repeated_and_missing_vector_ids(spark, monkeypatch, rows):
    monkeypatch.setattr(op5, "OFTEN", 1)
    monkeypatch.setattr(op5, "BLOCK", 16)
    got = op5.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == vectors_by_pairs(rows)


def test_pages(spark):
    long = "<html><body><article>" + "".join(f"<p>paragraph {i} of it</p>" for i in range(3000)) + "</article></body></html>"
    deep = "<div>" * 400 + "<p>far down</p>" + "</div>" * 400
    rows = [(1, "http://a.com/1", long, "x"), (2, "http://a.com/2", long, "x"), (2, "http://a.com/2", long, "x"), (3, None, None, "x"), (4, "http://b.com", deep, "x"), (None, "http://b.com", "", None)]
    got = op6.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), "page_id", "host")
    of = {r.page_id: r.text for r in got.collect()}
    assert got.count() == 6 and of[1] == of[2] == " ".join(f"paragraph {i} of it" for i in range(3000)) and of[3] == of[None] == "" and of[4] == "far down"
    assert op6.extract(spark.createDataFrame([], "page_id long, url string, html string"), "page_id").count() == 0


def test_alignment():
    for a, b in (("abcabc", "abxcabc"), ("", "abc"), ("aaaa", "aa"), ("abcd", "dcba"), ("xaybzc", "abc"), ("abc", "abc")):
        got = op6.aligned(list(a), list(b))
        assert all(a[i] == b[j] for i, j in got) and all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))
    assert len(op6.aligned(list("xaybzc"), list("abc"))) == 3 and len(op6.aligned(list("abcabc"), list("abxcabc"))) == 6


def test_tokens(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted((str(r.doc_id), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in op7.token_counts(odd, path, head=2).collect()) == want
    with pytest.raises(ValueError):
        op7.token_counts(odd, "some.model").count()


def test_mixing(spark, odd):
    got = op8.mix_sources(odd)
    assert got.count() == 12 and got.where("taken > 3 * size or taken <> copies * size").count() == 0
    # equal ids and texts in two sources are apart
    two = spark.createDataFrame([(i, "w " * (1 + i % 7), s) for i in range(600) for s in ("a", "b")], "doc_id long, text string, source string")
    for r in op8.mix_sources(two).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r.target - r.taken) <= r.most


def test_mixing_brute_force(spark):
    """Over many seeds the copies of a document have the expectation target / source size, and the sum stays."""
    rows = [(i, "w " * (1 + i % 5), "a" if i % 3 else "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, share = {}, {}
    for seed in range(12):
        for r in op8.mix_sources(docs, seed=seed).collect():
            share[r.source] = r.target / r.source_size
            total.setdefault(r.source, []).append(r.copies)
            assert r.copies in (int(share[r.source]), int(share[r.source]) + 1)
    for s, copies in total.items():
        assert abs(sum(copies) / len(copies) - share[s]) < 0.12


def test_lm(odd):
    for order in (2, 3):
        got = {r.doc_id: (r.n_words, r.score) for r in op9.lm_scores(odd, order).collect()}
        assert len(got) == 10 and got[1] == got[2] == got[3] == (0, None) and got[4] == pytest.approx(got[5]) and got[4][0] == 60_000 and got[7][0] == 1


def test_licenses(odd):
    keep = [c for c in odd.columns if c not in ("text", "source", "score", "n_words")]
    got = op10.scan_licenses(odd, *keep)
    assert got.count() == 12 and {r.labels for r in got.where("doc_id = 6").collect()} == {"mit"}
    r = got.where("doc_id = 1").first()
    assert (r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r["score"]) == (0, 0, None, "", "", 0.0)
    assert op10.scan_licenses(odd.limit(0), "doc_id").count() == 0


def test_components(spark):
    path = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(path, rounds=2)
