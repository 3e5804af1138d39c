import itertools
import math

import numpy as np
import pytest

from skein.functions import special
from skein.operators import factors, flow, pathmodel
from skein.operators.strains import Gene, StrainModel


def random_dag(rng, n=7):
    names = [f"n{i}" for i in range(n)]
    edges = {(names[i], names[j]): float(rng.uniform(0.1, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
    edges.setdefault((names[0], names[-1]), 1.0)
    return edges


def all_paths(edges, start, end):
    out = [[start]]
    while out:
        p = out.pop()
        if p[-1] == end:
            yield p
        out += [[*p, v] for u, v in edges if u == p[-1] and p[-1] != end]


@pytest.mark.parametrize("seed", range(20))
def test_path_sums_match_enumeration(seed):
    rng = np.random.default_rng(seed)
    edges = random_dag(rng)
    dag = pathmodel.Dag(edges, ("n0", "n6"))
    node = rng.normal(size=len(dag.names))
    edge = {(dag.at[u], dag.at[v]): math.log(w) for (u, v), w in edges.items()}
    s, e = [dag.at["n0"]], [dag.at["n6"]]
    weigh = lambda p: math.exp(sum(node[dag.at[n]] for n in p) + sum(edge[dag.at[a], dag.at[b]] for a, b in zip(p, p[1:], strict=False)))
    paths = list(all_paths(edges, "n0", "n6"))
    total = sum(map(weigh, paths))
    got = dag.marginals(node, edge, s, e)
    for n in dag.names:
        assert got[dag.at[n]] == pytest.approx(sum(weigh(p) for p in paths if n in p) / total, abs=1e-12)
    best, value = dag.best_path(node, edge, s, e)
    assert math.exp(value) == pytest.approx(max(map(weigh, paths))) and weigh(best) == pytest.approx(math.exp(value))
    low, cost = dag.best_path(node, edge, s, e, sign=-1)
    assert math.exp(cost) == pytest.approx(min(map(weigh, paths)))
    wide, width = flow.widest_path(edges, "n0", "n6")
    assert width == pytest.approx(max(min(edges[x] for x in zip(p, p[1:], strict=False)) for p in paths))


def test_samples_follow_the_weights():
    rng = np.random.default_rng(1)
    edges = random_dag(rng)
    dag = pathmodel.Dag(edges, ("n0", "n6"))
    none, edge, s, e = np.zeros(len(dag.names)), {(dag.at[u], dag.at[v]): math.log(w) for (u, v), w in edges.items()}, [dag.at["n0"]], [dag.at["n6"]]
    p = dag.marginals(none, edge, s, e)
    draws = [dag.sample(none, edge, s, e, rng) for _ in range(2000)]
    for n in dag.names:
        assert np.mean([n in d for d in draws]) == pytest.approx(p[dag.at[n]], abs=0.05)


def test_cycles_are_refused_and_broken():
    w = {("a", "b"): 3.0, ("b", "c"): 1.0, ("c", "a"): 2.0, ("c", "d"): 5.0, ("d", "c"): 4.0}
    with pytest.raises(ValueError):
        pathmodel.Dag(w)
    left = pathmodel.break_cycles(w)
    assert set(w) - set(left) == {("b", "c"), ("d", "c")}
    pathmodel.Dag(left)


def test_superbubbles():
    e = {("s", "a"), ("s", "b"), ("a", "t"), ("b", "t"), ("t", "u"), ("u", "x"), ("u", "y"), ("x", "z"), ("y", "z"), ("z", "q")}
    assert pathmodel.superbubble(e, "s") == ("t", {"s", "a", "b", "t"})
    assert pathmodel.superbubble(e | {("a", "out")}, "s") is None
    assert pathmodel.superbubble(e | {("t", "s")}, "s") is None
    assert [x[0] for x in pathmodel.bubble_chain(e, "s")][:3] == ["t", "u", "z"]


def test_superbubbles_are_searched_by_parts(spark, monkeypatch):
    def whole(pdf):
        raise AssertionError("a gene went to one task")

    rng, rows = np.random.default_rng(3), []
    for i in range(40):  # parts of one gene with a chain of bubbles each, some of them not closed
        rows += [(0, f"s{i}", f"a{i}{k}") for k in range(2 + i % 3)] + [(0, f"a{i}{k}", f"t{i}") for k in range(2 + i % 3)]
        rows += [(0, f"t{i}", f"b{i}{k}") for k in range(2)] + [(0, f"b{i}{k}", f"u{i}") for k in range(2)]
        rows += [(0, f"b{i}0", f"out{i}")] * (i % 2) + [(1, f"s{i}", f"a{i}")]
    rows += [(2, u, v) for u, v in random_dag(rng)] + [(None, "s", "x"), (None, "s", "y"), (None, "x", "t"), (None, "y", "t")]
    rows = [rows[i] for i in rng.permutation(len(rows))] + rows[:50]
    want = set()
    for gene in (0, 1, 2, None):
        own = {(u, v) for g, u, v in rows if g == gene}
        want |= {(gene, s, b[0], tuple(sorted(b[1]))) for s in {u for u, _ in own} if (b := pathmodel.superbubble(own, s)) and len(b[1]) > 3}
    edges = spark.createDataFrame(rows, "gene int, u string, v string").repartition(7)
    monkeypatch.setattr(pathmodel, "some", whole)
    monkeypatch.setattr(type(edges.groupBy("gene")), "applyInPandas", lambda *_: whole(None))
    got = [(r.gene, r.source, r.sink, tuple(r.nodes)) for r in pathmodel.superbubbles(edges).collect()]
    assert len(got) == len(want) >= 61
    assert set(got) == want
    none = pathmodel.superbubbles(edges.limit(0))
    assert none.count() == 0 and none.schema == pathmodel.superbubbles(edges).schema


def test_roots_join_what_is_connected(spark):
    from skein.operators.iteration import roots

    rng = np.random.default_rng(5)
    pairs = [tuple(map(int, p)) for p in rng.integers(-(2**62), 2**62, 300)[rng.integers(0, 300, (220, 2))]]
    pairs += [(10 * i, 10 * i + 10) for i in range(70)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    out = roots(spark.createDataFrame(pairs, "a long, b long")).collect()
    got = {r.id: r.root for r in out}
    assert len(out) == len(got)
    name = {x: got.get(x, x) for x in label}
    assert len({(label[x], name[x]) for x in label}) == len(set(label.values())) == len(set(name.values()))


def test_sources_and_sinks_rules():
    lengths = {"1": 100, "2": 100, "3": 100}
    edges = [("1+", "2+", 1.0), ("2+", "3+", 1.0), ("3-", "2-", 1.0), ("2-", "1-", 1.0)]
    tips = {"1": True, "3": False}
    assert pathmodel.sources_and_sinks(edges, lengths, tips, set(), [("3", True)], 300) == (["1+"], ["3+"])
    assert pathmodel.sources_and_sinks([], {"1": 900}, {"1": None}, {"1"}, [("1", False)], 300) == (["1-"], ["1-"])
    assert pathmodel.sources_and_sinks([], {"1": 900, "2": 10}, {"1": None, "2": None}, {"1", "2"}, [], 300) == (["1+"], ["1+"])


@pytest.mark.parametrize("seed", range(10))
def test_flows(seed):
    rng = np.random.default_rng(seed)
    edges = random_dag(rng)
    value, used = flow.max_flow(edges, "n0", "n6")
    cut = min(sum(w for (u, v), w in edges.items() if u in side and v not in side) for r in range(6) for c in itertools.combinations(["n1", "n2", "n3", "n4", "n5"], r) for side in [{"n0", *c}])
    assert value == pytest.approx(cut)
    parts = flow.decompose(used, "n0", "n6")
    assert sum(a for _, a in parts) == pytest.approx(value)
    cost = {e: (w, float(rng.uniform(1, 5))) for e, w in edges.items()}
    price, sent = flow.min_cost_flow(cost, "n0", "n6", value)
    assert sum(f for (u, _), f in sent.items() if u == "n0") - sum(f for (_, v), f in sent.items() if v == "n0") == pytest.approx(value)
    assert price <= sum(used[e] * cost[e][1] for e in used) + 1e-6


def test_fit_flow_recovers_path_amounts():
    edges = {("S", "a"), ("S", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), ("d", "T"), ("e", "T")}
    goal = {"a": 3.0, "b": 1.0, "c": 4.0, "d": 2.5, "e": 1.5}
    got, _ = flow.fit_flow(edges, "S", "T", goal, {}, rounds=500, least=1e-12)
    assert all(got[n] == pytest.approx(goal[n], abs=0.05) for n in goal)
    unit, paths = flow.fit_flow(edges, "S", "T", {n: g / 4 for n, g in goal.items()}, {}, unit=True, rounds=500, least=1e-12)
    assert unit["c"] == pytest.approx(1) and sum(a for _, a in paths) == pytest.approx(1) and unit["a"] == pytest.approx(0.75, abs=0.05)
    assert flow.coverage_walk(edges - {("S", "b")}, {"a": 5, "c": 5, "d": 4, "e": 1}, "S", "T") == ["S", "a", "c", "d", "T"]


def test_special_functions():
    assert special.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721], abs=1e-10)
    mu, tau = np.array([1.0, -2.0, 0.0, -1e4, 3.0]), np.array([1.0, 2.0, 4.0, 1.0, 0.0])
    mean, var = special.truncated_normal(mu, tau)
    x = np.linspace(0, 20, 200_001)
    for i in range(3):
        p = np.exp(-0.5 * tau[i] * (x - mu[i]) ** 2)
        m = (x * p).sum() / p.sum()
        assert mean[i] == pytest.approx(m, abs=1e-3) and var[i] == pytest.approx(((x - m) ** 2 * p).sum() / p.sum(), abs=1e-3)
    assert mean[3] == pytest.approx(1e-4) and mean[4] == var[4] == 0
    draws = special.draw_truncated_normal(np.full(4000, -1.0), np.full(4000, 1.0), np.random.default_rng(1))
    assert draws.min() >= 0 and draws.mean() == pytest.approx(special.truncated_normal(-1.0, 1.0)[0], abs=0.02)
    grid = np.arange(30.0)
    assert special.lowess(grid, 2 * grid + 1) == pytest.approx(2 * grid + 1)
    assert list(special.isotonic([1, 2, 3, 4], [1, 3, 2, 5], True)) == [1, 2.5, 2.5, 5]
    assert list(special.isotonic([1, 2, 3], [3, 1, 2], False)) == [3, 1.5, 1.5]


def test_factorisations_lower_their_error():
    rng = np.random.default_rng(3)
    x = rng.exponential(size=(20, 2)) @ rng.exponential(size=(2, 12))
    mask = (rng.random(x.shape) > 0.1).astype(float)
    w, h, div = factors.kl_nmf(x, mask, 2, rng, rounds=2000, restarts=2)
    assert div < 0.05 * factors.kl(x, np.full_like(x, x.mean()), mask)
    fit = factors.VariationalFactors(x, mask, 5, rng)
    bounds = [fit.train(10).bound() for _ in range(15)]
    assert fit.quality("mse") < 0.02 * x.var() and bounds[-1] > bounds[0]
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(bounds[3:], bounds[4:], strict=False))
    held = ((1 - mask) * (x - fit.u @ fit.v.T) ** 2).sum() / (1 - mask).sum()
    assert held < 0.3 * x.var()
    with pytest.raises(ValueError):
        factors.VariationalFactors(x, np.zeros_like(x), 2, rng)


def planted(seed, strains=3, genes=3):
    rng, out, rows, truth = np.random.default_rng(seed), [], 0, []
    for gi in range(genes):
        layers = [[f"{gi}{level}{k}" for k in range(rng.integers(2, 4) if level % 2 else 1)] for level in range(9)]
        edges = [("source+", n + "+") for n in layers[0]] + [(a + "+", b + "+") for x, y in zip(layers, layers[1:], strict=False) for a in x for b in y] + [(n + "+", "sink+") for n in layers[-1]]
        own = {n: rows + i for i, n in enumerate(x for level in layers for x in level)}
        rows += len(own)
        out.append(Gene(f"g{gi}", edges, own))
        truth.append([[level[rng.integers(len(level))] for level in layers] for _ in range(strains)])
    phi = np.zeros((rows, strains))
    for gene, t in zip(out, truth, strict=True):
        for k in range(strains):
            phi[[gene.rows[n] for n in t[k]], k] = 1
    length = rng.integers(100, 600, rows).astype(float)
    gamma = rng.exponential(0.2, (strains, 12)) + 0.02
    return out, rng.poisson(length[:, None] * (phi @ gamma)).astype(float), length, truth


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_planted_strains_are_found(seed):
    genes, x, length, truth = planted(seed)
    model = StrainModel(genes, x, length, 5, seed=1)
    model.initialise(2)
    model.update(150, prune_below=0.05)
    found = [{n[:-1] for q in p.values() for n in q} for p in model.paths]
    wanted = [{n for t in truth for n in t[k]} for k in range(3)]
    assert all(min(len(w ^ f) for f in found) <= 2 for w in wanted)
    assert model.map_score(np.ones_like(x)) > -5e3 and (model.divergence(10) < 0.2).all()
