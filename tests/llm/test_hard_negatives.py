import random

import numpy as np
import pytest

from skein.llm import hard_negatives as hard
from skein.llm import topk

SCHEMA = "vec_id long, label int, embedding array<float>, score int, node long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)


def brute(rows, is_anchor, positives=5, negatives=5, low=80, scale=256):
    ok = [(i, y, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, seen = [], set()
    for i, y, v in ok:
        if not is_anchor(i) or i in seen:
            continue
        seen.add(i)
        mates = sorted((-dot(v, w), j) for j, z, w in ok if z == y and j != i and len(w) == len(v))[:positives]
        for s, p in mates:
            fits = sorted((-dot(v, w), j) for j, z, w in ok if z != y and len(w) == len(v) and low * -s <= 100 * dot(v, w) <= 100 * -s)[:negatives]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def vectors(seed, n, dim=6, labels=4):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(5, dim))
    return [(i, int(r.integers(labels)), (centers[i % 5] + 0.3 * r.normal(size=dim)).tolist()) for i in range(n)]


def mined(spark, rows, is_anchor="id % 10 = 0"):
    own = hard.labelled(table(spark, rows), "vec_id", "label", "embedding")
    return sorted(tuple(x) for x in hard.mine(own, own.where(is_anchor), scale=256).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hard, "TILE", 50)
    monkeypatch.setattr(hard, "BLOCK", 7)
    monkeypatch.setattr(hard, "LEAF", 4)
    monkeypatch.setattr(hard, "SHARD_BYTES", 1 << 12)
    monkeypatch.setattr(hard, "grow", lambda q, y, f=hard.grow: f(q, y, 4))
    rows = vectors(seed, 300)
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(60)]  # copies, so ties
    rows += [(-10, 1, [0.5] * 6), (None, 1, [0.1] * 6), (500, None, [0.1] * 6), (501, 1, None), (502, 1, []), (503, 1, [None] * 6), (504, 1, [float("nan")] * 6), (505, 1, [float("inf")] * 6)]
    rows += [(600 + i, i % 2, [0.2, 0.3 + i / 9]) for i in range(12)] + [(620, 9, [1.0] * 3), (621, 9, [3e12] * 3)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == want and len(want) > 300


def test_repeated_rows_and_empty_tables(spark):
    rows = vectors(3, 80)
    rows += rows[:20]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == [] and mined(spark, rows, "id < 0") == []
    assert mined(spark, [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [0.0, 1.0])]) == []  # the only positive scores below 0


def node(q, labels, ids=None, wants=()):
    q, labels = np.array(q, float), np.array(labels, np.int64)
    order, tree, balls = hard.grow(q, labels, 8)
    ids = np.arange(len(q)) if ids is None else ids
    w = np.array(wants, np.int64).reshape(len(q), -1)[order]
    return hard.Node(q.shape[1], ids[order].tobytes(), labels[order].tobytes(), q[order].tobytes(), tree.tobytes(), balls.tobytes(), w.tobytes())


def test_bounds_hold_and_trees_cover_their_rows():
    r = np.random.default_rng(4)
    a, c = node(np.round(50 * r.normal(size=(60, 5))), r.integers(3, size=60)), node(np.round(50 * r.normal(size=(90, 5))), r.integers(3, size=90))
    for x in range(len(a.tree)):
        for y in range(len(c.tree)):
            (s, e), (p, q) = a.tree[x, :2], c.tree[y, :2]
            lo, hi = hard.bounds(a, c, np.array([x]), np.array([y]))
            products = a.v[s:e] @ c.v[p:q].T
            assert lo[0] <= products.min() and products.max() <= hi[0]
    leaves = sorted(tuple(t[:2]) for t in a.tree.tolist() if t[2] < 0)
    assert [s for s, _ in leaves] == [0, *[e for _, e in leaves][:-1]] and leaves[-1][1] == 60 and max(e - s for s, e in leaves) <= 8
    assert sorted((x, y) for _, x, y in hard.leaf_pairs(a, c, lambda ia, ic, lo, hi: np.ones(len(ia), bool))) == sorted((x, y) for x in range(len(a.tree)) for y in range(len(c.tree)) if a.tree[x, 2] < 0 and c.tree[y, 2] < 0)


def test_groups_are_dropped_at_once():
    """Of clusters far apart only those that can hold a result are scored."""
    r = np.random.default_rng(5)
    centers = 1000 * np.eye(8)
    q = np.round(np.repeat(centers, 64, 0) + r.normal(size=(512, 8)))
    labels = np.arange(512) % 2
    a, c = node(q[:64], labels[:64]), node(q, labels, np.arange(512))
    best = hard.Positives(a, 5, 1)
    assert 0 < best.meet(c) <= 64 * 512 / 3
    wants = np.full((64, 1), 990_000)
    b = node(q[:64], labels[:64], None, wants)
    hard_ = hard.Negatives(b, 5, 1, 80)
    assert 0 < hard_.meet(c) <= 64 * 512 / 3


def test_least_score_that_counts():
    scores = np.array([0, 1, 2, 4, 5, 6, 99, 100, 101, 2**62])
    assert hard.lower(scores, 80).tolist() == [-(-80 * int(s) // 100) for s in scores]
    assert topk.NONE < topk.LOW
