"""Vectors of several lengths, and long ones."""

import numpy as np
import pytest

from stepweave.llm import embeddings


def test_each_length_is_compared(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=16)]) for k in range(40)]
    rows += [(100 + k, [2 * v for v in rows[k][1]]) for k in range(10)] + [(200 + k, rows[0][1][:8]) for k in range(3)] + [(300, [1.0] * 99)]
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=16, lead=4).collect()}
    want = {k: (1, k, True) if k < 10 else (0, k, True) for k in range(40)} | {100 + k: (1, k, False) for k in range(10)}
    assert got == want | {200 + k: (2, 200, k == 0) for k in range(3)} | {300: (0, 300, True)}


@pytest.mark.parametrize("dim", [2049, 3000])
def test_copies_of_long_vectors(spark, dim):
    x = np.random.default_rng(dim).normal(size=dim)
    rows = [(k, [float(v) for v in x]) for k in range(12)] + [(50, [float(v) for v in -x])]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(k, 11, 0, k == 0) for k in range(12)] + [(50, 0, 50, True)]
