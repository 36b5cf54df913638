"""The models of the classifiers and the fit of packing patterns against plain loops, differences and optimality conditions."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import quality_model as Q
from latticework.llm.packing import fit_repeats, length_patterns, plan, rounded
from latticework.llm.toxicity import FactorizationMachine, learn_toxicity, telling_terms, terms, toxicity

SF = "/root/testdata/sf0.001"


def machine_of(n, factors, seed):
    g = np.random.default_rng(seed)
    machine = FactorizationMachine(n, factors)
    machine.bias, machine.w, machine.v = 0.3, g.normal(0, 1, n), g.normal(0, 1, (n, factors))
    return machine, g


def logit_by_pairs(machine, features):
    pairs = sum(float(machine.v[a] @ machine.v[b]) for a, b in itertools.combinations(features, 2))
    return machine.bias + sum(machine.w[f] for f in features) + pairs


@pytest.mark.parametrize("factors", [0, 1, 8])
def test_logits_are_sums_over_pairs(factors):
    """Rows of no, one and many features."""
    machine, g = machine_of(30, factors, 4)
    rows = [np.flatnonzero(g.random(30) < share) for share in (0, 0.05, 0.3, 0.7, 1)]
    feature, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    assert np.allclose(machine.logits(feature, row, len(rows)), [logit_by_pairs(machine, r) for r in rows])


def test_machine_follows_the_gradient():
    """A first step of Adam goes down the loss in every weight, as differences of it tell: against its sign, by the rate of that step."""
    g = np.random.default_rng(8)
    has = g.random((64, 6)) < 0.4
    row, feature = np.nonzero(has)
    label = (g.random(64) < 0.4).astype(float)
    fitted, start = FactorizationMachine(6, 3), FactorizationMachine(6, 3)
    start.bias = math.log(label.mean() / (1 - label.mean()))
    decay_w, decay_v = 1e-5, 1e-4

    def loss(machine):
        z = machine.logits(feature, row, 64)
        return np.mean(np.logaddexp(0, z) - label * z) + decay_w / 2 * (machine.w**2).sum() + decay_v / 2 * (machine.v**2).sum()

    fitted.fit(feature, row, label, rounds=1, least_steps=1, batch=64, decay_w=decay_w, decay_v=decay_v)
    for name in ("w", "v"):
        values, moved = getattr(start, name), getattr(fitted, name) - getattr(start, name)
        for at in np.ndindex(values.shape):
            kept = values[at]
            values[at] = kept + 1e-6
            up = loss(start)
            values[at] = kept - 1e-6
            slope = (up - loss(start)) / 2e-6
            values[at] = kept
            if abs(slope) > 1e-6:
                assert np.sign(moved[at]) == -np.sign(slope) and abs(moved[at]) == pytest.approx(0.02 * 0.1, rel=0.02)


def test_telling_terms_against_loops(spark):
    g = np.random.default_rng(3)
    rows = []
    for i in range(200):
        toxic = int(g.random() < 0.3)
        share = np.array([0.5, 0.05 + 0.6 * toxic, 0.6 - 0.55 * toxic, 0.02, 0.2, 0.2])
        rows.append((i, toxic, np.flatnonzero(g.random(6) < share).tolist()))

    def off(some, t):
        of, share = len(some), sum(y for _, y, _ in some) / len(some)
        n = sum(t in f for _, _, f in some)
        toxic = sum(y for _, y, f in some if t in f)
        return n, of, (toxic - n * share) / math.sqrt(n * share * (1 - share) * (1 - n / of) + 1e-9)

    errors, common = 3.0, 0.4
    alone = {t: off(rows, t) for t in range(6)}
    toxic = {t for t, (n, _, z) in alone.items() if n >= 3 and z >= errors}
    marked = [r for r in rows if toxic & set(r[2])]
    want = {t for t, (n, of, z) in alone.items() if (n >= 3 and abs(z) >= errors) or n >= common * of}
    want |= {t for t in range(6) if (x := off(marked, t))[0] >= 3 and abs(x[2]) >= errors}
    frame = spark.createDataFrame(rows, "row long, label int, features array<int>")
    assert {r.feature for r in telling_terms(frame, errors, common).collect()} == want and 0 < len(want) < 6


def test_toxicity_scores_by_pairs(spark):
    """Scores of whole texts of the tables are those of an explicit sum over pairs of the learnt machine."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    src = docs.select("doc_id", "text")
    slots, machine = learn_toxicity(src, labels)
    got = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    for r in src.where(F.length("text") < 3000).orderBy("doc_id").limit(60).collect():
        features = sorted({int(slots[t]) for t in terms([r.text or ""])[0] if slots[t] >= 0})
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, logit_by_pairs(machine, features))))), abs=1e-9)


def test_word_vectors_against_loops(spark):
    """Index vectors of the neighbours within two places, words and shapes in turn, summed by a plain loop."""
    texts = ["One plain text, of a few words words.", "", None, "ALL CAPS!! and 12 numbers, 12 of them", "Überall éine Zeile", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = np.zeros((Q.TERMS, Q.WIDE))
    for t in range(Q.TERMS):
        for place, sign in zip(Q.PLACES[t], Q.SIGNS[t], strict=True):
            index[t, place] += sign
    want = np.zeros((Q.TERMS, Q.WIDE))
    for text in texts:
        word, shape, _ = Q.term_pairs([text or ""])
        line = [t for pair in zip(word, shape, strict=True) for t in pair]
        for a, b in itertools.permutations(range(len(line)), 2):
            if abs(a - b) <= 2:
                want[line[a]] += index[line[b]]
    size = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(Q.corpus_vectors(docs), want / np.maximum(size, 1e-12), atol=1e-6)


def test_pooled_against_means():
    vectors = np.random.default_rng(1).normal(0, 1, (Q.TERMS, Q.WIDE)).astype(np.float32)
    texts = ["", "one", "one two  two\nthree.", " ", "word " * 500]
    got = Q.pooled(vectors, texts)
    for x, text in zip(got, texts, strict=True):
        word, shape, _ = Q.term_pairs([text])
        assert len(word) == len(re.findall("[^\x20\x09-\x0d]+", text))
        want = np.concatenate([vectors[word].mean(0), vectors[shape].mean(0)]) if len(word) else np.zeros(2 * Q.WIDE)
        assert np.allclose(x, want, atol=1e-5)


def test_network_follows_the_gradient():
    """One step of Adam, in every weight against the sign of the loss's difference quotient."""
    g = np.random.default_rng(2)
    x, y = g.normal(0, 1, (90, 4)), (g.random(90) < 0.5).astype(float)
    rate, decay = 0.01, 1e-3
    start, fitted = Q.Network(4, 3), Q.Network(4, 3)
    fitted.fit(x, y, steps=1, rate=rate, decay=decay)
    start.mean, start.scale = fitted.mean, fitted.scale
    test = np.arange(90) % 7 == 6
    train = ~test if test.sum() >= 20 else np.ones(90, bool)

    def loss():
        z = start.logits(x[train])
        return np.mean(np.logaddexp(0, z) - y[train] * z) + decay / 2 * ((start.a**2).sum() + (start.b**2).sum())

    for name in ("a", "a0", "b", "b0"):
        values, moved = getattr(start, name), getattr(fitted, name) - getattr(start, name)
        for at in np.ndindex(values.shape):
            kept = values[at]
            values[at] = kept + 1e-6
            up = loss()
            values[at] = kept - 1e-6
            slope = (up - loss()) / 2e-6
            values[at] = kept
            if abs(slope) > 1e-5:
                assert moved[at] == pytest.approx(-rate * np.sign(slope), rel=0.01)


def test_temperature_calibrates():
    """Of all temperatures tried none gives held-back rows less log loss; noisy labels call for one above 1 in an overfitted network."""
    g = np.random.default_rng(6)
    x = g.normal(0, 1, (280, 12))
    y = (g.random(280) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    network = Q.Network(12)
    network.fit(x, y, steps=600)
    rest = np.arange(280) % 7 == 6

    def loss(temperature):
        z = network.logits(x[rest]) / temperature
        return np.mean(np.logaddexp(0, z) - y[rest] * z)

    assert network.temperature > 1 and all(loss(network.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.2, 5, 60))


def fit_of(histogram, room):
    patterns = length_patterns(room)
    patterns = patterns[((histogram[patterns] > 0) | (patterns == 0)).all(1)]
    x = fit_repeats(histogram, patterns)
    made = np.bincount(patterns.ravel(), np.repeat(x, 3), minlength=room + 1)
    made[0] = 0
    return patterns, x, histogram - made


@pytest.mark.parametrize(("room", "most"), [(4, 3), (12, 1), (40, 7), (200, 50), (200, 10**12)])
def test_repeats_are_least_squares(room, most):
    """No pattern's count could rise, and none above 0 could change, to less squared error; counts above 0 are no more than lengths."""
    for seed in range(5):
        histogram = np.random.default_rng(seed).integers(0, most + 1, room + 1)
        histogram[[0, room]] = 0
        patterns, x, left = fit_of(histogram, room)
        slope = ((np.arange(room + 1) / (room + 1)) ** 1.5 * left / max(1, histogram.max()))[patterns].sum(1)
        assert (x >= 0).all() and (slope <= 1.01e-4).all() and (np.abs(slope[x > 0]) <= 1e-6).all()
        assert (x > 0).sum() <= (histogram > 0).sum()


def test_repeats_of_nothing():
    assert len(fit_of(np.zeros(9, np.int64), 8)[1]) == 0
    assert plan(np.zeros(1025, np.int64), 1024).shape == (0, 5)
    assert plan(np.array([0, 0, 7]), 2).tolist() == [[2, 0, 7, 0, 0]]


def test_patterns_pack_most_pieces():
    """With some pieces of each length patterns take over 80 % of them, those of three lengths among them, and few sequences more than the bound are used."""
    lengths = np.random.default_rng(7).gamma(2, 190, 20_000).astype(int)
    histogram = np.bincount(lengths[(lengths > 0) & (lengths < 1024)], minlength=1025)
    patterns, x, _ = fit_of(histogram, 1024)
    some = rounded(x, patterns, histogram, 0)
    used = np.zeros(1025, np.int64)
    for sizes, repeat in some:
        assert sum(sizes) == 1024
        np.add.at(used, sizes, repeat)
    assert (used <= histogram).all() and sum(n for sizes, n in some if len(sizes) == 3) > 1000
    assert used.sum() > 0.8 * histogram.sum()
    rows = plan(histogram, 1024)
    assert (np.bincount(rows[:, 0], rows[:, 2], 1025) == histogram).all()
    assert int((rows[:, 3] + rows[:, 2]).max()) <= 1.002 * -(-int((histogram * np.arange(1025)).sum()) // 1024)
