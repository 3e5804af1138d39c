"""Ends by distance, widths, factor graphs, flow fits and draws on small graphs, against enumeration."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from skein.functions import special
from skein.operators import factorgraph, flow, pathmodel
from skein.operators.strains import Gene, StrainModel


def random_factor_graph(seed, cyclic):
    rng, g = np.random.default_rng(seed), factorgraph.FactorGraph()
    names = [f"v{i}" for i in range(5)]
    pairs = [(0, 1), (1, 2), (1, 3), (3, 4)] + ([(2, 4)] if cyclic else [])
    for i, j in pairs:
        g.add((names[i], names[j]), rng.uniform(0.1, 1, (2 + i % 2, 2 + j % 2)))
    return g


@pytest.mark.parametrize("seed", range(4))
def test_sum_product_is_exact_on_trees(seed):
    g = random_factor_graph(seed, False)
    g.seen = {"v4": 1} if seed % 2 else {}
    want, got = g.brute_force(), g.sum_product()
    assert all(np.allclose(got[n], want[n]) for n in want)


def test_sum_product_comes_near_on_cycles():
    g = random_factor_graph(1, True)
    want, got = g.brute_force(), g.sum_product()
    assert all(np.abs(got[n] - want[n]).max() < 0.05 for n in want)


def test_factor_text_reads_back():
    g = random_factor_graph(3, True)
    back = factorgraph.from_text(g.text())
    names = sorted(g.states)
    assert [tuple(names[int(x)] for x in n) for n, _ in back.factors] == [n for n, _ in g.factors]
    assert all(np.allclose(a, b) for (_, a), (_, b) in zip(g.factors, back.factors, strict=True))
    lines = ["twidth: 3", "({x0}, (0.25, 0.75))", "({x2}, (1, 0))"]
    got = factorgraph.read_marginals(lines, names)
    assert got["v0"].tolist() == [0.25, 0.75] and got["v2"].tolist() == [1, 0] and len(got) == 2
    assert factorgraph.read_states(["2", "0 1", "3 0"], names) == {"v0": 1, "v3": 0}


def test_path_factors_agree_with_path_sums():
    edges = [("source+", "a+"), ("source+", "b+"), ("a+", "c+"), ("b+", "c+"), ("a+", "d+"), ("c+", "sink+"), ("d+", "sink+")]
    weight = {"a+": 2.0, "b+": 0.5, "c+": 3.0, "d+": 0.7}
    g = factorgraph.path_factors(edges, weight, {"source+"}, {"sink+"})
    p = g.brute_force()
    dag = pathmodel.Dag(edges)
    want = dag.marginals(np.log([weight.get(n, 1.0) for n in dag.names]), {}, [dag.at["source+"]], [dag.at["sink+"]])
    for n in "abcd":
        assert math.isclose(sum(p[e][1] for e in p if e.endswith(f">{n}+")), want[dag.at[f"{n}+"]], rel_tol=1e-9)


def test_widths():
    path = {str(i): {str(j) for j in (i - 1, i + 1) if 0 <= j < 6} for i in range(6)}
    clique = {str(i): {str(j) for j in range(5) if j != i} for i in range(5)}
    grid = {(i, j): {(i + a, j + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < 3 and 0 <= j + b < 3} for i in range(3) for j in range(3)}
    assert factorgraph.min_fill(path) == 1 and factorgraph.min_fill(clique) == 4 and factorgraph.min_fill({str(k): {str(x) for x in v} for k, v in grid.items()}) == 3
    assert factorgraph.min_fill({}) == -1 and factorgraph.min_fill({"a": set()}) == 0


CHAIN = [("1+", "2+", 10.0), ("2+", "3+", 20.0), ("4+", "2+", 15.0), ("2+", "5+", 2.0), ("2-", "1-", 10.0), ("3-", "2-", 20.0), ("2-", "4-", 15.0), ("5-", "2-", 2.0)]
LENGTH = {"1": 50, "2": 50, "3": 50, "4": 50, "5": 50, "9": 300, "8": 100}


def test_ends_by_distance():
    sources, sinks = pathmodel.ends_by_distance(CHAIN, LENGTH, ["1", "3", "4", "5"], {"8", "9"}, 0.5)
    # 4 and 3 are farthest apart; 1 is 30 before 3; 5 is 17 behind 4, under half of 35
    assert (sources, sinks) in ((["3-", "9+"], ["4-", "1-", "9+"]), (["4+", "1+", "9+"], ["3+", "9+"]))
    assert pathmodel.ends_by_distance(CHAIN, LENGTH, ["1", "3", "4", "5"], set(), 0.4)[1][-1][0] in "51"
    assert pathmodel.ends_by_distance([], {"7": 10}, ["7"], {"7"}, 0.5) == (["7+"], ["7+"])


def test_ends_from_the_first_tip():
    sources, sinks = pathmodel.ends_from_first(CHAIN, ["1", "3", "4", "5"])
    assert sources[0] == "1+" and sinks[0] == "5+"  # the nearest that it leads to
    assert set(sources[1:]) | set(sinks[1:]) == {"3+", "4+"} and "3+" in sinks and "4+" in sources
    assert pathmodel.ends_from_first([], []) == ([], [])


def test_dead_ends_are_no_ends():
    tips, stops = {"1": True, "3": True, "4": True, "5": True}, [("3", True)]
    sources, sinks = pathmodel.sources_and_sinks(CHAIN, LENGTH, tips, set(), stops, 10.0)
    assert set(sources) == {"1+", "4+"} and set(sinks) == {"3+", "5+"}
    sources, sinks = pathmodel.sources_and_sinks(CHAIN, LENGTH, tips, set(), stops, 10.0, {"4"})
    assert set(sources) == {"1+"} and set(sinks) == {"3+", "5+"}


def test_paths_are_carried_on_through_overlaps():
    edges = {("a+", "b+"), ("b+", "c+"), ("c+", "d+"), ("c+", "e+")}
    lengths = dict.fromkeys("abcde", 20)
    assert pathmodel.extended(["a+"], 19, edges, lengths, 15, True) == (["a+", "b+", "c+"], 9)
    assert pathmodel.extended(["a+"], 3, edges, lengths, 15, True) == (["a+"], 3)
    assert pathmodel.extended(["c+"], 3, edges, lengths, 15, False) == (["b+", "c+"], 8) or pathmodel.extended(["c+"], 3, edges, lengths, 15, False)[0][0] == "a+"
    assert pathmodel.bubbles_around({("s", "a"), ("s", "b"), ("a", "t"), ("b", "t"), ("r", "s")}, "s") >= {"s", "a", "b", "t"}


def test_logit_flow_finds_a_planted_flow():
    edges = {("source+", "a"), ("source+", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("c", "sink+"), ("d", "sink+")}
    want = {"a": 0.7, "b": 0.3, "c": 0.5, "d": 0.5}
    goal = {n: math.log((p + 1e-3) / (1 - p + 1e-3)) for n, p in want.items()}
    got, trace = flow.fit_logit_flow(edges, "source+", "sink+", goal, np.random.default_rng(3), rounds=400, least=1e-12)
    assert trace == sorted(trace, reverse=True) and trace[-1] < 0.02
    assert all(abs(got[n] - p) < 0.06 for n, p in want.items())


def test_divergences_of_rates():
    x, one = np.array([0.0, 2.0, 5.0]), np.ones(3)
    assert flow.kl_of_rates(x, np.maximum(x, 1e-300), one) == pytest.approx(0)
    assert flow.kl_of_rates(x, np.array([1.0, 2.0, 4.0]), one) == pytest.approx(1 + 5 * math.log(5 / 4) - 1)
    assert flow.rms_of_rates(x, x + 2, np.array([1.0, 1.0, 0.0])) == pytest.approx(2)


def bubbles(n):
    """A chain of n two-way bubbles: common segments c0.., sides a and b."""
    edges, rows = [("source+", "c0+")], ["c0"]
    for i in range(n):
        edges += [(f"c{i}+", f"a{i}+"), (f"c{i}+", f"b{i}+"), (f"a{i}+", f"c{i + 1}+"), (f"b{i}+", f"c{i + 1}+")]
        rows += [f"a{i}", f"b{i}", f"c{i + 1}"]
    return edges + [(f"c{n}+", "sink+")], rows


@pytest.mark.parametrize("kind", ["flow", "factors"])
def test_initialisers_lead_to_the_planted_strains(kind):
    edges, names = bubbles(4)
    rows = {u: i for i, u in enumerate(names)}
    rng = np.random.default_rng(5)
    truth = [{f"c{i}" for i in range(5)} | {f"{s}{i}" for i in range(4)} for s in "ab"]
    phi = np.array([[float(u in t) for t in truth] for u in names])
    gamma = np.array([[9, 2, 6, 3, 8, 1.0], [2, 7, 3, 9, 1, 5.0]])
    length = np.full(len(names), 100.0)
    x = rng.poisson(length[:, None] * (phi @ gamma)).astype(float)
    model = StrainModel([Gene("g", edges, rows)], x, length, 2, seed=1, bias=False, noise=False)
    if kind == "flow":
        model.initialise_by_flow(100)
    else:
        model.initialise_by_factors(5)
    model.update(60)
    got = sorted(sorted(n[:-1] for n in p["g"]) for p in model.best_paths())
    assert got == sorted(sorted(t) for t in truth)
    assert set(model.gene_deviance()) == {"g"} and model.deviance().shape == x.shape
    full = model.fit()
    assert np.allclose(model.shift(model.shift(full, 0, -1), 0, 1), full)
    model.filter_strains([1], 3)
    assert model.g == 1 and model.paths == [{}] and model.gamma.shape[0] == 1


@pytest.mark.parametrize("low,high", [(-1, 2), (0.3, 0.6), (2, 9), (-9, -2), (4, math.inf), (-math.inf, 0.5), (1, 8)])
def test_draws_between_bounds_have_the_right_mean(low, high):
    mu, sigma = 0.2, 1.3
    z = special.draw_normal_between(low, high, mu, sigma, np.random.default_rng(1), 20000)
    grid = np.linspace(max(low, mu - 12), min(high, mu + 12), 200001)
    p = np.exp(-0.5 * ((grid - mu) / sigma) ** 2)
    mean = (grid * p).sum() / p.sum()
    assert z.min() >= low and z.max() <= high and abs(z.mean() - mean) < 0.03
    with pytest.raises(ValueError):
        special.draw_normal_between(1, 1, 0, 1, np.random.default_rng(1), 1)


def test_column_draws_have_the_right_moments(spark):
    from pyspark.sql import functions as F

    from skein.functions import columns

    rows = spark.range(20000).select(columns.exponential_draw(F.lit(2.0), 1).alias("e"), columns.normal_draw(F.lit(3.0), F.lit(4.0), 2).alias("n"), special.gamma_draw(3)(F.lit(2.0), F.lit(4.0), F.col("id")).alias("g"))
    m = rows.agg(F.avg("e"), F.avg("n"), F.stddev("n"), F.avg("g")).first()
    assert all(abs(a - b) < 0.02 for a, b in zip(m, (0.5, 3.0, 0.5, 0.5), strict=True))


def test_min_fill_equals_plain_elimination_and_takes_thousands_of_variables():
    def plain(near):
        left, width = {n: set(m) for n, m in near.items()}, -1
        while left:
            node = min(left, key=lambda n: (sum(1 for a, b in itertools.combinations(sorted(left[n]), 2) if b not in left[a]), n))
            around = left.pop(node)
            width = max(width, len(around))
            for a in around:
                left[a] |= around - {a}
                left[a].discard(node)
        return width

    for seed in range(60):
        r = random.Random(seed)
        names, near = [f"v{i}" for i in range(r.randint(1, 24))], {}
        for n in names:
            near.setdefault(n, set())
        for a, b in itertools.combinations(names, 2):
            if r.random() < r.choice((0.1, 0.3, 0.6)):
                near[a].add(b), near[b].add(a)
        assert factorgraph.min_fill(near) == plain(near), seed
    side = 50
    cell = lambda i, j: f"{i:02}_{j:02}"
    grid = {cell(i, j): {cell(a, b) for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < side and 0 <= b < side} for i in range(side) for j in range(side)}
    began = time.perf_counter()
    assert factorgraph.min_fill(grid) >= side // 2 and time.perf_counter() - began < 30
