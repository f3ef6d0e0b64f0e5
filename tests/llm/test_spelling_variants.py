"""Spelling variants against a plain comparison of all words, and odd tables."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from lectern.llm import op11_spelling_variants as op11

from ..oracle import flat, run


def plain(docs, slips=97):
    """The contract word for word."""
    count = Counter()
    for doc, text in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = crc32(f"{'' if doc is None else doc}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and near(v, w)] for w in n}
    form = {}
    for w, some in by.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(by[w]), n.get(form[w])) for w in n)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def made(seed, letters, words, texts):
    """Texts over few letters, so that words repeat bigrams and stand one edit from many others."""
    r = random.Random(seed)
    pool = ["".join(r.choices(letters, k=r.choice((5, 5, 6, 6, 7, 8)))) for _ in range(words)]
    return [(i, " ".join(r.choices(pool, k=120))) for i in range(texts)]


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (3, "aéÿzÀZ"), (4, "abcdefgh")])
def test_brute_force(spark, seed, letters):
    docs = made(seed, letters, 400, 25)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(op11.spelling_variants(op11.variant_words(df))) == plain(docs)
    assert found(op11.spelling_variants(op11.variant_words(df, slips=0))) == plain(docs, 0)


def test_large_cells_are_dealt_out(spark, monkeypatch):
    docs = made(6, "abc", 500, 30)
    monkeypatch.setattr(op11, "LARGE", 3)
    monkeypatch.setattr(op11, "PAIRS", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(op11.spelling_variants(op11.variant_words(df))) == plain(docs)


def test_sql(spark, sf):
    assert flat(op11.op11_spelling_variants(spark, sf).toPandas().astype({"form_n": "Int64"})) == flat(run(op11.ORACLE, sf).astype({"form_n": "Int64"}))


def test_odd_tables(spark):
    long = "wörterbuch" * 3000
    docs = [(1, None), (2, ""), (None, "apple apple apple appel"), (3, f"{long} {long} {long}"), (3, "apple apple applee applee applee"), (3, "apple apple applee applee applee"), (4, "ab abc 12345 abcd-ef"), (5, f"{long}e {long}e {long}e {long} {long} {long}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("word", "n", "cell", "gram", "key", "_k", "size")])
    assert found(op11.spelling_variants(op11.variant_words(df))) == plain(docs)
    empty = op11.spelling_variants(op11.variant_words(df.limit(0)))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(70)] + [(f"leaf{i}", f"w{i:03d}") for i in range(70)]
    got = op11.roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert len(got) == 140 and {r.root for r in got} == {"w070"}
