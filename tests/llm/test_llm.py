"""The training-data operators against SQL, the libraries they must agree with, and brute force on small tables."""

import re

import numpy as np
import pytest

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
from lectern.llm import queries

from ..oracle import flat, run

TEXTS = [(1, None), (2, ""), (3, "a b"), (4, "A b"), (None, "a b"), (5, "a b c d e f g"), (5, "x y"), (6, "x  y"), (6, "x  y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s" if t else None, "n") for i, t in TEXTS], "doc_id long, text string, source string, n string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    assert flat(queries.queries()[name](spark, sf).toPandas()) == flat(run(queries.oracle_sql()[name], sf))


def test_jaccard_small(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in op1.jaccard_components(docs).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (None, 1, 3), (5, 3, 5), (5, 1, 5), (6, 1, 5)}
    assert op1.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_family(spark):
    """Many copies with a few words changed: components as by brute force."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(120):
        w = list(base)
        for at in rng.integers(0, 90, rng.integers(0, 5)):
            w[at] = f"v{rng.integers(0, 6)}"
        texts.append(" ".join(w))
    sets = [set(op1.shingle_set(t.encode(), op1.WordHash()).tolist()) for t in texts]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if 100 * len(a & sets[j]) >= 75 * len(a | sets[j])]
    label, before = list(range(len(sets))), None
    while label != before:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in op1.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label))


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        w = list(rng.choice(words, 40))
        if bad:
            w[int(rng.integers(0, 39))], w[int(rng.integers(0, 39))] = "vile", "nasty"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    scorer = op2.fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in op2.score_toxicity(d, scorer, "doc_id").collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in range(400)]) > 0.97
    assert 0 <= got[None] <= 1 and got[900] < 0.5
    assert {r.score for r in op2.score_toxicity(d, None, "doc_id").collect()} == {0.0}


def test_decontamination_small(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "The quick brown fox jumps over the lazy dog again and again today!"), (None, "x x THE quick, brown fox jumps over the lazy dog again and again today y"), (5, "quick brown fox jumps over the lazy dog again and again today"), (6, "quick brown fox jumps over a lazy dog")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two"), (2, "The quick brown fox jumps over the lazy dog again and again today"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.first_word, round(r.similarity, 3)) for r in op3.contaminated(d, b).collect()}
    assert got == {(3, 1, 0, 1.0), (4, 2, 0, 1.0), (None, 2, 2, 1.0), (5, 2, 0, 0.889)}
    assert op3.contaminated(d.limit(0), b).count() == 0 and op3.contaminated(d, b.limit(0)).count() == 0


def test_url_filter_small(spark):
    caps = spark.sql("select * from values (1, 'HTTP://u@Sub.Spam-Farm.example.org:80/x/?q#f', timestamp'2024-05-31 00:00:00'), (2, 'http://spam-farm.example.org', timestamp'2024-06-01 00:00:00'), (3, null, null), (4, 'foo', timestamp'2024-01-01'), (5, 'http://thther.example.org/fr/x', timestamp'2024-02-01'), (6, 'http://thther.example.org/frx', timestamp'2024-02-01') as t(id, url, fetched_at)")
    got = {r.id: (r.blocked, r.categories) for r in op4.filter_urls(caps, op4.entry_table(spark), "id").collect()}
    assert got == {1: (True, "spam"), 2: (False, ""), 3: (False, ""), 4: (False, ""), 5: (True, "scraper"), 6: (False, "")}
    assert op4.filter_urls(caps.limit(0), op4.entry_table(spark).limit(0), "id").count() == 0


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[0] + 0.12 * rng.standard_normal((100, 16)) * np.linalg.norm(x[0]) / 4
    x[200:220] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (None, rows[1][1]), (904, [1.0])]
    got = {r.vec_id: r for r in op5.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    u = np.concatenate([x, x[1:2]]).astype(np.float32).astype(np.float64)  # the row without an id links too
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    n = np.array([got[i].n_links for i in (*range(300), None)])
    assert (n <= link.sum(1)).all() and n.sum() >= 0.9 * link.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904))
    assert got[None].component_id == 1 and not got[None].kept
    assert {got[i].component_id for i in range(200, 220)} == {1}


def test_html(spark, sf):
    def plain(h):
        import html

        m = re.search(r"<article>(.*?)(</article>|$)", h or "", re.S)
        b = re.sub(r"</?(p|h1|br)[^>]*>", "\n", re.sub(r"<!--.*?-->", "", m[1] if m else "", flags=re.S))
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())

    got = {r.page_id: r.text for r in op6.op6_html_extraction(spark, sf).collect()}
    assert all(got[r.page_id] == plain(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    rows = [(1, "http://a.com/1", None), (2, None, "<p>x"), (3, "http://b.com/1", '<html><div id=menu><a href=x>home</a></div><div class="content"><p>Hello &amp; <b>wor</b>ld</p><p>a < b</p></div><div class="comments"><p>nice</p></div><script>if(a<b){}</script></html>'), (4, "http://b.com/2", "")]
    got = {r.page_id: r.text for r in op6.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id").collect()}
    assert got == {1: "", 2: "x", 3: "Hello & world a < b", 4: ""}


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [None, "", "a  b   c<|endoftext|> d\n\n\n x'll don't  ", "a  b", "a\x1cb!\x1c!  z zz1 12 ab\tc", "zzqqyy " * 30, "a  b"]
    d = spark.createDataFrame([(i % 5, x) for i, x in enumerate(texts)], "doc_id long, text string")
    want = sorted((i % 5, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts))
    assert sorted(tuple(r) for r in op7.token_counts(d, path, head=3).collect()) == want
    assert op7.token_counts(d.limit(0), path).count() == 0


def test_mixing(spark, sf, docs):
    got = op8.op8_mixing(spark, sf).toPandas()
    size = got.groupby("source")["size"].sum()
    level, names = {}, sorted(size.index)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left = set(names), float(size.sum())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * size[s]]
        if not full:
            break
        for s in full:
            level[s] = 3.0 * size[s]
            left -= level[s]
            free.discard(s)
    level |= share
    for s, g in got.groupby("source"):
        assert abs(g["target"].iloc[0] - level[s]) < 1e-6 * level[s]
        assert abs(g["taken"].sum() - level[s]) <= g["size"].max() + 1
    assert (got["taken"] <= 3 * got["size"]).all()
    again = op8.op8_mixing(spark, sf).toPandas()
    assert flat(got) == flat(again)
    assert op8.mix_sources(docs).count() == docs.count() and op8.mix_sources(docs.limit(0)).count() == 0


def test_lm_small(docs):
    got = op9.lm_scores(docs)
    assert got.count() == docs.count()
    assert {r.doc_id for r in got.where("score is null").collect()} == {1, 2}
    assert op9.lm_scores(docs.limit(0)).count() == 0


def test_licenses_brute_force(spark, sf):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans(op10.ascii_lower.__globals__["UPPER"], op10.ascii_lower.__globals__["LOWER"])

    def base(text):
        w, at, found = word.findall((text or "").translate(lower)), [], set()
        for phrase, label in op10.BASE:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    found.add(label)
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))

    rows = [(1, None), (2, ""), (3, "MIT License. Released under the MIT License, CC-BY cc by CC BY-NC-SA 4.0 GNU general public license version 3"), (4, "mit license " * 500), (5, "Licensed under the Apache License, Version 2.0")]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op10.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[3].labels == "cc-by,cc-by-nc-sa,gpl,mit" and [tuple(x)[:3] for x in got[5].detections] == [("apache", 0, 8)]


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in c.STAGES:
        before, kept = kept, c.staged(stage(spark, kept, sf))
        if name == "ngram_jaccard":
            comp = {(r.doc_id): r.component_id for r in op1.jaccard_components(before).collect()}
            assert {r.doc_id for r in kept.collect()} == set(comp.values())
        if name == "decontamination":
            bad = {r.doc_id for r in op3.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()} - bad
        if name != "mixing":
            assert kept.columns == before.columns
    assert kept.where("copies < 1 or taken <> copies * size").count() == 0
