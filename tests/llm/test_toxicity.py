"""Operator 9 against exhaustive search, the conditions of a fitted model, and documents held out."""

from itertools import product

import numpy as np
import pytest

from stepweave.llm import queries, toxicity


def model_of(text):
    n = toxicity.trigrams([text]).reshape(61, 61, 61) + 0.01
    return np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def decoder():
    return toxicity.Decoder(model_of("you are a moron and an idiot, total scum, what trash; the moon is on a morning " * 20))


@pytest.mark.parametrize("token", ["m0r0n", "m o r o n", "i d 1 o t  s c u m", "mooor", "tr@$h", "a i d i o t", "5cum!", "t_r a-s h"])
def test_viterbi_against_every_path(decoder, token):
    def score(path):
        at, total = [0, 0], 0.0
        for emitted, cost in path:
            total += 2.2 * len(emitted) - cost
            for c in emitted:
                k = ord(c) - 96 if "a" <= c <= "z" else 0
                total += float(decoder.logp[at[0]][at[1]][k])
                at = [at[1], k]
        return total + float(decoder.logp[at[0]][at[1]][0])

    paths = list(product(*decoder.lattice(token)))
    best = max(map(score, paths))
    readings = {"".join(e for e, _ in p) for p in paths if score(p) > best - 1e-6}
    assert decoder.restore(token) in readings


def test_separators_are_arcs(decoder):
    assert decoder.spaced("you m o r o n!") == ["moron"]
    assert decoder.spaced("i d i o t  s c u m") == ["idiot", "scum"]
    assert decoder.spaced("i.d.i.o.t") == ["idiot"]
    assert decoder.restored_text("what t r 4 s h") == "what trash"
    assert decoder.spaced("") == [] and decoder.spaced("no letters apart") == []


def test_fit_against_a_plain_descent():
    rng = np.random.default_rng(4)
    x = rng.random((400, 6)) < 0.25
    true = np.array([2.0, 1.0, 0.3, 0, 0, 0])
    y = (rng.random(400) < 1 - np.exp(-(x @ true) - 0.02)).astype(float)
    w, base = toxicity._fit(*np.nonzero(x), y, 6)

    def loss(v):
        s = np.maximum(x @ v[:6] + v[6], 1e-12)
        return -(y * np.log(-np.expm1(-s)) - (1 - y) * s).sum() + toxicity.DOUBT * v[:6].sum() + v[6] - 0.5 * np.log(v[6])

    best = loss(np.append(w, base))
    assert (w >= 0).all() and w[0] > w[1] > w[3]
    for k in range(7):  # no step to either side is better
        for step in (-0.02, 0.02):
            v = np.append(w, base)
            v[k] = max(v[k] + (step if k < 6 else step / 10), 1e-9)
            assert loss(v) > best - 1e-3


def test_calibration_finds_slope_and_shift():
    rng = np.random.default_rng(5)
    odds = rng.normal(size=20_000) * 2
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * odds - 1)))).astype(float)
    slope, shift = toxicity._calibrate(odds, y)
    assert abs(slope - 1.5) < 0.1 and abs(shift + 1) < 0.1


def test_one_class_and_repeats(spark):
    docs = spark.createDataFrame([(k, f"plain words {k % 3}") for k in range(20)] + [(None, None)], "doc_id long, text string")
    logp = toxicity.language_model(docs)
    for toxic, shift in ((0, -30.0), (1, 30.0)):
        labels = spark.createDataFrame([(k, toxic) for k in range(20)], "doc_id long, toxic int")
        assert toxicity.learn(docs, labels, logp) == {"base": 1.0, "weights": {}, "slope": 0.0, "shift": shift}
    # Nothing tells the classes apart: the score is the share of toxic rows, about.
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.with_toxicity(docs, logp, toxicity.learn(docs, labels, logp)).collect()}
    assert all(0.3 < s < 0.7 for s in scores)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic > 0 for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").collect()}
    rows = [(r.score, truth[r.doc_id], r.predicted) for r in queries.op9_toxicity(spark, folder).where("held_out").collect() if r.doc_id in truth]
    bad, good = [s for s, t, _ in rows if t], [s for s, t, _ in rows if not t]
    above = np.mean([[(a > b) + (a == b) / 2 for b in good] for a in bad])
    assert above >= 0.95
    assert np.mean([p for _, t, p in rows if t]) >= 0.85 and np.mean([p for _, t, p in rows if not t]) <= 0.01
