"""Languages of texts: against a plain path and plain scores, held-out labels, and odd tables."""

from collections import Counter
from math import log
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import op13_language_id as op13


def plain_path(scores, penalty):
    """Every word tries every language before it."""
    if not len(scores):
        return []
    k = len(scores[0])
    best, back = [list(scores[0])], []
    for s in scores[1:]:
        row, from_ = [], []
        for j in range(k):
            stay, (turn, i) = best[-1][j], max((best[-1][i] - penalty, -i) for i in range(k))
            row.append(max(stay, turn) + s[j])
            from_.append(j if stay >= turn else -i)
        best.append(row)
        back.append(from_)
    at = max(range(k), key=lambda j: (best[-1][j], -j))
    out = [at]
    for from_ in reversed(back):
        at = from_[at]
        out.append(at)
    return out[::-1]


@pytest.mark.parametrize("seed", range(4))
def test_path_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 30, 25)
    # quarters, so that ties are frequent and sums exact
    scores = -rng.integers(0, 12, (lengths.sum(), 3)).astype(np.float32) / 4
    want, at = [], 0
    for n in lengths:
        want += plain_path(scores[at : at + n].tolist(), 2.5)
        at += n
    assert op13.viterbi(scores, lengths, 2.5).tolist() == want


def test_scores_brute_force():
    texts = {"aa": ["the cat", "éa that"], "bb": ["der hut", "die"], "cc": ["кот дом"]}
    counts, letters = {}, {}
    for name, some in texts.items():
        found = [w for t in some for w in op13.words(t)]
        counts[name] = Counter(op13.trigrams(found)[0].tolist())
        letters[name] = np.bincount(op13.scripts_of(found)[0], minlength=len(op13.SCRIPTS))
    model = op13.Languages(["aa", "bb", "cc"], counts, letters)
    grams = {name: Counter(f" {w} "[i : i + 3] for t in some for w in t.split() for i in range(len(w))) for name, some in texts.items()}
    every = {g for c in grams.values() for g in c}

    def plain(w):
        return [sum(log(c[g] + 0.5) - log(sum(c.values()) + 0.5 * len(every)) for i in range(len(w)) if (g := f" {w} "[i : i + 3]) in every) for c in grams.values()]

    for w in ("the", "hut", "that", "thut", "diet"):
        got, p = model.score([w])[0][0], plain(w)
        assert np.allclose(got, [p[0] - max(p[:2]), p[1] - max(p[:2]), -op13.EXCLUDED], atol=1e-4)  # Latin letters leave no room for Cyrillic
    # é is used by one of the two, кот by the third; letters that none uses and trigrams that none has say nothing
    assert model.score(["éat"])[0][0].argmax() == 0 and model.score(["кот"])[0][0].argmax() == 2
    assert model.score(["中", "qqq"])[1].tolist() == [False, False] and not model.score(["中", "qqq"])[0].any()


@pytest.fixture(scope="module")
def model(spark):
    one, two, three = "the quick brown fox jumps over that lazy dog while they were thinking", "der schnelle braune fuchs springt über den faulen hund während sie dachten", "быстрая коричневая лиса прыгает через ленивую собаку"
    rows = [(i, (one, two, three)[i % 3], ("en", "de", "ru")[i % 3]) for i in range(90)]
    return op13.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_texts(spark, model):
    text = "they were thinking over that dog, während sie über den hund dachten. Быстрая лиса! The quick fox jumps."
    got = op13.language_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(s.lang, s.first, s.words) for s in got.spans] == [("en", 0, 6), ("de", 6, 6), ("ru", 12, 2), ("en", 14, 4)]
    assert got.lang_pred == "en" and 0.4 < got.score < 0.6


def test_odd_tables(spark, model):
    long = "während sie dachten " * 30_000
    docs = [(1, None), (2, ""), (3, "123 ... ²½ \n"), (4, long), (None, "the dog"), (5, "the dog"), (5, "the dog"), (5, "der hund"), (6, "中文"), (7, "x" * 200_000), (8, "İstanbul the dog"), (9, "́the dog")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("lang", "score", "key", "spans", "_r", "t", "n")])
    got = sorted(op13.language_spans(df, model).collect(), key=str)
    of = {(r.doc_id, i): r for i, r in enumerate(got)}
    by = {}
    for r in of.values():
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert len(got) == len(docs) and by[1] == by[2] == by[3] == [("und", 0.0)]
    assert by[4] == [("de", 1.0)] and by[None] == [("en", 1.0)] and sorted(by[5]) == [("de", 1.0), ("en", 1.0), ("en", 1.0)]
    assert by[6][0][0] in model.names and by[6][0][1] == 0.0 and by[7][0][0] in model.names
    assert all(0 <= r.score <= 1 for r in got)
    assert op13.language_spans(df.limit(0), model).count() == 0
    none = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert op13.fit_languages(none) is None and op13.fit_languages(none.limit(0)) is None
    assert [r.lang_pred for r in op13.language_spans(none, None).collect()] == ["und"]


def test_sample_is_bounded_and_skips_held_out(spark):
    rows = [(i, f"text {i}", "en" if i % 4 else "de") for i in range(2000)] + [(5, "same", "en")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op13.labelled(df, 50).collect()
    assert Counter(r.lang for r in got) == {"en": 50, "de": 50} and len(set(got)) == 100
    assert all(crc32(r.text.split()[1].encode()) % 3 != 1 for r in got if r.text != "same")


def test_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = op13.op13_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert out and all(crc32(str(r.doc_id).encode()) % 3 == 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
