"""The pipeline against a brute-force version in plain Python, and its stages on odd tables."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as c


def tables(spark, path):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    drawn = np.random.default_rng(5).choice(words, (400, 48)).tolist()
    text = lambda i: drawn[i][: 40 + i % 9]
    item = " ".join(f"item{chr(97 + i)}" for i in range(20))
    docs, labels = [], []
    for i in range(400):
        w = text(i)
        if i % 4 == 0:
            w[i % 30], w[(i + 7) % 30], w[(i + 13) % 30] = "vile", "nasty", "foul"
        if i % 10 == 3:
            w = text(i - 2)
            w[5] = "changed"
        if i % 25 == 9:
            w = w[:10] + item.split() + w[10:]
        docs.append((i, " ".join(w), "abc"[i % 3]))
        labels.append((i, int(i % 4 == 0)))
    spark.createDataFrame([*docs, (1000, None, "a"), (1001, "", None), docs[6]], "doc_id long, text string, source string").withColumn("score", F.lit("x")).withColumn("size", F.lit(1)).withColumn("_key", F.lit(2)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, item


def test_brute_force(spark, tmp_path):
    docs, item = tables(spark, str(tmp_path))
    kept, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in c.STAGES:
        kept = c.staged(stage(spark, kept, str(tmp_path)))
        got.append(kept)
    clean = [(i, t) for i, t, _ in docs if "vile" not in t.split()]
    assert sorted(r.doc_id for r in got[0].collect()) == sorted([*(i for i, _ in clean), 6, 1000, 1001])
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in clean}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert links
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    first = {i for i in label if label[i] == i}
    assert sorted(r.doc_id for r in got[1].collect()) == sorted([*first, 1000, 1001])
    text = dict(clean)
    left = {i for i in first if item not in text[i]}
    assert left < first and sorted(r.doc_id for r in got[2].collect()) == sorted([*left, 1000, 1001])
    assert all(df.columns == got[0].columns for df in got[:3])
    # the mix: whole copies, near the target of each source
    source = {i: s for i, _, s in docs}
    rows = got[3].collect()
    assert {"mix_size", "target", "copies", "taken"} < set(got[3].columns) and {r.doc_id for r in rows} <= left
    for s in "abc":
        of = [r for r in rows if r.source == s]
        size = sum(len(text[i].split()) for i in left if source[i] == s)
        assert all(r.taken == r.copies * len(text[r.doc_id].split()) and 1 <= r.copies <= 3 for r in of)
        assert of and abs(sum(r.taken for r in of) - of[0].target) <= 60 and of[0].target <= 3 * size + 1e-6
    total = sum(len(text[i].split()) for i in left)
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-6 * total


def test_empty(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
