"""Character error over whole texts against brute force."""

import re

from lectern import catalog


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def clean(text):
    return re.sub("[^a-z0-9]+", " ", text.lower().translate(str.maketrans("²³", "23"))).strip()


def test_whole_texts(spark, sf):
    items = {r.item_id: clean(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {i: min(1.0, distance(a, items[i + 1]) / max(len(items[i + 1]), 1)) for i, a in items.items() if i + 1 in items}
    got = {r.item_id: r.cer for r in catalog.item_text_error_rates(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_differences_after_the_first_letters(spark, tmp_path):
    rows = [(1, "a" * 100 + " one, two"), (2, "a" * 100 + " one two three")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    (got,) = catalog.item_text_error_rates(spark, str(tmp_path)).collect()
    assert got.cer == round(6 / 114, 6)
