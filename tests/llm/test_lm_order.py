"""Stupid backoff of order 3 against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from lectern.llm import op9_lm_scoring as op9


def brute(texts):
    seqs = [["<s> ", *t.split()] if t and t.split() else [] for t in texts]
    gram = lambda s, k: Counter(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    own = [{k: gram(s, k) for k in (1, 2, 3)} for s in seqs]
    every = {k: sum((o[k] for o in own), Counter()) for k in (1, 2, 3)}
    n = sum(len(s) - 1 for s in seqs if s)

    def log_s(g, o):
        if len(g) == 1:
            return math.log(every[1][g] / n)
        rest = every[len(g)][g] - o[len(g)][g]
        return math.log(rest / every[len(g) - 1][g[:-1]]) if rest else math.log(0.4) + log_s(g[1:], o)

    return [sum(log_s(tuple(s[max(0, i - 2) : i + 1]), o) for i in range(1, len(s))) / (len(s) - 1) if s else None for s, o in zip(seqs, own, strict=True)]


@pytest.mark.parametrize("head", [150_000, 4])
def test_order_three(spark, monkeypatch, head):
    monkeypatch.setattr(op9, "HEAD", head)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, rng.integers(1, 40)) % 30) for _ in range(60)] + [None, "", "w1", "w1", "lone word"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in op9.lm_scores(d, 3).collect()}
    want = brute(texts)
    assert all((got[i] is None) if w is None else abs(got[i] - w) < 1e-9 for i, w in enumerate(want))
    assert any(abs(r.score - got[r.doc_id]) > 1e-3 for r in op9.lm_scores(d).where("score is not null").collect())
