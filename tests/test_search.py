"""Searches of a table of queries against a table."""

import numpy as np

from stepweave.operators import search


def test_each_query_against_all_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 6))
    rows = [(k, [float(v) for v in vec]) for k, vec in enumerate(x)] + [(90, None), (91, [0.0] * 6), (92, [1.0, 2.0]), (100, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, search.similar_to_each(e, e.where("vec_id % 20 = 0"), "embedding", "vec_id", 0.3, 4, block=16).collect()))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close, want = np.round(unit @ unit.T, 6), []
    for q in range(0, 90, 20):
        hits = sorted((-close[q, k], k) for k in range(90) if close[q, k] >= 0.3)
        want += [(q, k, -c, len(hits)) for c, k in hits[:4]]
    assert got == sorted(want)
