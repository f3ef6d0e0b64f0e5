"""Near duplicates in a table with vectors of several lengths."""

import numpy as np

from lectern.llm import op5_embedding_neardup as op5


def test_every_length_is_compared(spark):
    rng = np.random.default_rng(7)
    rows, at = [], 0
    for dim, n in ((16, 60), (8, 20), (1, 3)):
        for k in range(n):
            base = np.full(dim, 1.0) if k % 4 == 0 else rng.standard_normal(dim)
            rows.append((at, (base if dim == 1 else base + 0.01 * rng.standard_normal(dim)).tolist()))
            at += 1
    rows += [(500 + i, []) for i in range(100)] + [(600, rows[62][1]), (None, rows[62][1])]
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v}
    want = {i: sum(j != i and len(v) == len(u) and float(v @ u) >= 0.95 for j, u in units.items()) for i, v in units.items()}
    got = {r.vec_id: r for r in op5.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) and {i: got[i].n_links for i in want} == want
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 600))
    assert got[None].component_id == 62 and not got[None].kept
    assert got[600].component_id == 62
