"""The two trained models against plain evaluations of their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import secret_scan, toxicity


def sample(seed, n, grades):
    """(grade, words): some words are commoner the higher the grade."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        g = r.randrange(grades)
        words = {w for w in range(1, 30) if r.random() < 0.2} | {100 + k for k in range(1, grades) if r.random() < (0.7 if g >= k else 0.08)}
        out.append((g, np.array(sorted(words), np.uint64)))
    return out


def loss(rows, vocabulary, weights, theta, l2):
    """Mean of -ln P(grade) plus the penalty, one document at a time."""
    at, total = {int(v): w for v, w in zip(vocabulary, weights, strict=True)}, 0.0
    for g, words in rows:
        score = sum(at.get(int(w), 0.0) for w in words)
        beyond = [1.0, *(1 / (1 + math.exp(t - score)) for t in theta), 0.0]
        total -= math.log(beyond[g] - beyond[g + 1])
    return (total + l2 / 2 * sum(w * w for w in weights)) / len(rows)


@pytest.mark.parametrize("grades", [2, 4])
def test_ordinal_fit_is_at_the_least_of_its_loss(grades):
    rows = sample(grades, 400, grades)
    model = toxicity.fit(rows, l2=0.5)
    assert len(model.theta) == grades - 1 and len(model.weights)
    params = np.concatenate((model.weights, model.theta))
    d = len(model.weights)
    f = lambda p: loss(rows, model.vocabulary, p[:d], p[d:], 0.5)
    slope = np.array([(f(params + e) - f(params - e)) / 2e-5 for e in np.eye(len(params)) * 1e-5])
    assert np.abs(slope).max() < 1e-3
    rng, least = np.random.default_rng(1), f(params)
    assert all(f(params + rng.normal(0, 0.1, len(params))) >= least - 1e-9 for _ in range(50))


def test_severity_is_the_expected_grade():
    rows = sample(4, 400, 4)
    model = toxicity.fit(rows)
    for _, words in rows[:50]:
        score = model.score(words)
        beyond = [1.0, *(1 / (1 + math.exp(t - score)) for t in model.theta), 0.0]
        want = sum(g * (beyond[k] - beyond[k + 1]) for k, g in enumerate(model.grades))
        assert model.severity(np.array([score]))[0] == pytest.approx(want)
        assert model.grade(np.array([score]))[0] == model.grades[max(k for k in range(4) if beyond[k] >= 0.5)]


def walk(node, x):
    while isinstance(node, tuple):
        f, cut, left, right = node
        node = left if x[f] <= cut else right
    return node


def test_forest_expression_walks_its_trees(spark):
    rows = secret_scan.labelled_findings(60, seed=3)
    df = spark.createDataFrame(rows, "b string, c string, a string, p string, y int")
    made = df.select(*secret_scan.features(F.col("c"), F.col("b"), F.col("a"), F.col("p")), "y")
    data = np.array([tuple(r) for r in made.collect()], float)
    trees = secret_scan.forest(data[:, :-1], data[:, -1], trees=5)
    got = [r.s for r in made.select(secret_scan.score_column(trees).alias("s")).collect()]
    assert got == pytest.approx([sum(walk(t, x) for t in trees) / 5 for x in data[:, :-1]])


def test_a_split_is_the_best_of_all_cuts():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 1)), np.zeros(40)
    y[x[:, 0] > 0.3] = 1
    y[:3] = 1 - y[:3]
    f, cut, left, right = secret_scan.grow(x, y, rng, 1)
    best = min((sum(p * (1 - p) * n for p, n in ((y[x[:, 0] <= c].mean(), (x[:, 0] <= c).sum()), (y[x[:, 0] > c].mean(), (x[:, 0] > c).sum()))), c) for c in (np.sort(x[:, 0])[4:-5] + np.sort(x[:, 0])[5:-4]) / 2)
    side = x[:, 0] <= cut
    got = sum(p * (1 - p) * n for p, n in ((y[side].mean(), side.sum()), (y[~side].mean(), (~side).sum())))
    assert got <= best[0] * 1.1 + 1e-9
