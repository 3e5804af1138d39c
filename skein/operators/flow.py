"""Flows on one gene's graph: widest-path decomposition, cheapest unit paths, maximum flow, and conditional-gradient fits."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pathmodel import Dag, given, some

Edge = tuple[str, str]


def widest_path(flow: dict[Edge, float], source: str, sink: str) -> tuple[list[str], float]:
    dag = Dag(flow, (source, sink))
    edge = {(dag.at[u], dag.at[v]): f for (u, v), f in flow.items()}
    return dag.best_path(np.full(len(dag.names), np.inf), edge, [dag.at[source]], [dag.at[sink]], min)


def decompose(flow: dict[Edge, float], source: str, sink: str, least: float = 1e-9) -> list[tuple[list[str], float]]:
    """Widest paths taken off one by one until none carries more than least; every edge on a path loses its amount, those of source and
    sink too."""
    left, out = {e: f for e, f in flow.items() if f > least}, []
    while left:
        path, amount = widest_path(left, source, sink)
        if len(path) < 2 or amount <= least:
            break
        out.append((path, float(amount)))
        for e in zip(path, path[1:], strict=False):
            left[e] -= amount
        left = {e: f for e, f in left.items() if f > least}
    return out


def cheapest_path(cost: dict[Edge, float], source: str, sink: str) -> tuple[list[str], float]:
    dag = Dag(cost, (source, sink))
    edge = {(dag.at[u], dag.at[v]): c for (u, v), c in cost.items()}
    return dag.best_path(np.zeros(len(dag.names)), edge, [dag.at[source]], [dag.at[sink]], sign=-1)


def max_flow(capacity: dict[Edge, float], source: str, sink: str) -> tuple[float, dict[Edge, float]]:
    """Shortest augmenting paths."""
    left, ahead = defaultdict(float), defaultdict(set)
    for (u, v), c in capacity.items():
        left[u, v] += c
        ahead[u].add(v)
        ahead[v].add(u)
    total = 0.0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            n = queue.popleft()
            for v in sorted(ahead[n]):
                if v not in came and left[n, v] > 1e-12:
                    came[v] = n
                    queue.append(v)
        if sink not in came:
            return total, {e: c - left[e] for e, c in capacity.items() if c - left[e] > 1e-12}
        path, n = [], sink
        while n != source:
            path.append((came[n], n))
            n = came[n]
        step = min(left[e] for e in path)
        for u, v in path:
            left[u, v] -= step
            left[v, u] += step
        total += step


def min_cost_flow(arcs: dict[Edge, tuple[float, float]], source: str, sink: str, amount: float) -> tuple[float, dict[Edge, float]]:
    """The cheapest flow of up to amount from source to sink; arcs: (capacity, cost). Successive shortest paths (Bellman-Ford)."""
    left = {e: c for e, (c, _) in arcs.items()}
    cost = {e: c for e, (_, c) in arcs.items()}
    for u, v in list(arcs):
        left.setdefault((v, u), 0.0)
        cost.setdefault((v, u), -cost[u, v])
    sent, flow = 0.0, defaultdict(float)
    while sent < amount - 1e-12:
        dist, came = {source: 0.0}, {}
        for _ in range(len({n for e in left for n in e})):
            moved = False
            for (u, v), c in left.items():
                if c > 1e-12 and u in dist and dist[u] + cost[u, v] < dist.get(v, np.inf) - 1e-12:
                    dist[v], came[v], moved = dist[u] + cost[u, v], u, True
            if not moved:
                break
        if sink not in dist:
            break
        path, n = [], sink
        while n != source:
            path.append((came[n], n))
            n = came[n]
        step = min(amount - sent, *(left[e] for e in path))
        for u, v in path:
            left[u, v] -= step
            left[v, u] += step
            flow[u, v] += step
            flow[v, u] -= step
        sent += step
    return sum(flow[e] * cost[e] for e in arcs if flow[e] > 0), {e: flow[e] for e in arcs if flow[e] > 1e-12}


def squared_loss(x: float, f: float, length: float) -> float:
    return 0.5 * (x - f * length) ** 2


def squared_slope(x: float, f: float, length: float) -> float:
    return -(x - f * length) * length


def poisson_loss(x: float, f: float, length: float) -> float:
    rate = max(f * length, 1e-12)
    return rate - x * np.log(rate)


def poisson_slope(x: float, f: float, length: float) -> float:
    return length - x / max(f, 1e-12)


def fit_flow(
    edges: set[Edge], source: str, sink: str, target: dict[str, float], length: dict[str, float],
    loss: Callable[[float, float, float], float] = squared_loss, slope: Callable[[float, float, float], float] = squared_slope,
    rounds: int = 200, unit: bool = False, least: float = 1e-6,
) -> tuple[dict[str, float], list[tuple[list[str], float]]]:
    """A nonnegative flow from source to sink whose node throughput times length comes near the targets: conditional gradients over
    paths, with away steps (flow taken off the worst path in use) and back-tracking. unit: one unit of flow in all. Returns the throughput
    of each node and the paths in use."""
    used: dict[tuple[str, ...], float] = {}
    nodes = sorted({n for e in edges for n in e} - {source, sink})
    flow = dict.fromkeys(nodes, 0.0)

    def value(f: dict[str, float]) -> float:
        return sum(loss(target[n], f[n], length.get(n, 1.0)) for n in nodes if n in target)

    def refreshed() -> dict[str, float]:
        out = dict.fromkeys(nodes, 0.0)
        for p, a in used.items():
            for n in p:
                if n in out:
                    out[n] += a
        return out

    def slopes() -> dict[str, float]:
        return {n: slope(target[n], flow[n], length.get(n, 1.0)) if n in target else 0.0 for n in nodes}

    def best(g: dict[str, float]) -> tuple[list[str], float]:
        return cheapest_path({(u, v): g.get(v, 0.0) for u, v in edges}, source, sink)

    if unit:
        path, _ = best(slopes())
        if not path:
            return flow, []
        used[tuple(path)] = 1.0
        flow = refreshed()
    now = value(flow)
    for _ in range(rounds):
        g = slopes()
        path, gain = best(g)
        if not path:
            break
        worst = max(used, key=lambda p: sum(g.get(n, 0.0) for n in p), default=None)
        bad = sum(g.get(n, 0.0) for n in worst) if worst else -np.inf
        step = used[worst] if unit else max(max(target.values(), default=1.0), 1.0)
        better = False
        while step > 1e-9:
            trial = dict(used)
            if unit:
                trial[worst] -= step
                trial[tuple(path)] = trial.get(tuple(path), 0.0) + step
            elif bad > -gain:
                trial[worst] = max(0.0, trial[worst] - step)
            else:
                trial[tuple(path)] = trial.get(tuple(path), 0.0) + step
            kept, used = used, {p: a for p, a in trial.items() if a > 1e-12}
            moved = refreshed()
            new = value(moved)
            if new < now - 1e-12:
                better, flow = True, moved
                break
            used = kept
            step /= 2
        if not better or now - new < least * max(1.0, abs(now)):
            now = new if better else now
            break
        now = new
    return flow, [(list(p), a) for p, a in sorted(used.items(), key=lambda x: -x[1])]


def random_path(edges: set[Edge], source: str, sink: str, rng: np.random.Generator) -> list[str]:
    """A path that follows an edge at random at each node; edges must lead to the sink from everywhere."""
    ahead: dict[str, list[str]] = defaultdict(list)
    for u, v in sorted(edges):
        ahead[u].append(v)
    path = [source]
    while path[-1] != sink:
        options = ahead[path[-1]]
        if not options:
            raise ValueError(f"{path[-1]} does not lead to the sink")
        path.append(options[rng.integers(len(options))])
    return path


def fit_logit_flow(edges: set[Edge], source: str, sink: str, goal: dict[str, float], rng: np.random.Generator, rounds: int = 100, least: float = 1e-6, soft: float = 1e-3) -> tuple[dict[str, float], list[float]]:
    """Throughput of each node under one unit of flow whose soft log odds ln((p + soft) / (1 - p + soft)) come near the goals by half the
    summed squares, and that loss by round. From two random paths of a half each, flow moves to the cheapest path under the slope; steps are
    halved until the loss falls."""
    nodes = sorted({n for e in edges for n in e} - {source, sink})
    share = dict.fromkeys(nodes, 0.0)
    for _ in range(2):
        for n in random_path(edges, source, sink, rng)[1:-1]:
            share[n] += 0.5

    def odds(p: float) -> float:
        return float(np.log((p + soft) / (1 - p + soft)))

    def loss(p: dict[str, float]) -> float:
        return 0.5 * sum((goal[n] - odds(p[n])) ** 2 for n in nodes if n in goal)

    trace = [loss(share)]
    for _ in range(rounds):
        slope = {n: (odds(share[n]) - goal[n]) * (1 / (share[n] + soft) + 1 / (1 - share[n] + soft)) if n in goal else 0.0 for n in nodes}
        path = set(cheapest_path({(u, v): slope.get(v, 0.0) for u, v in edges}, source, sink)[0])
        step = 0.5
        while step > 1e-6:
            trial = {n: min(1.0, max(0.0, (1 - step) * share[n] + step * (n in path))) for n in nodes}
            if loss(trial) < trace[-1]:
                break
            step /= 2
        else:
            break
        share = trial
        trace.append(loss(share))
        if trace[-2] - trace[-1] < least:
            break
    return share, trace


def kl_of_rates(x: np.ndarray, rate: np.ndarray, mask: np.ndarray) -> float:
    """Summed x ln(x / rate) - x + rate; a count of zero adds its rate."""
    log = np.where(x > 0, np.log(np.maximum(x, 1e-300)), 0.0) - np.log(np.maximum(rate, 1e-300))
    return float((mask * (rate - x + np.where(x > 0, x * log, 0.0))).sum())


def rms_of_rates(x: np.ndarray, rate: np.ndarray, mask: np.ndarray) -> float:
    return float(np.sqrt(((mask * (rate - x)) ** 2).sum() / mask.sum()))


def total_flows(graphs: dict[str, set[Edge]], rows: dict[str, dict[str, int]], x: np.ndarray, lengths: np.ndarray, mask: np.ndarray, poisson: bool = False, rounds: int = 200) -> tuple[np.ndarray, dict[str, list[tuple[list[str], float]]]]:
    """Throughput of each segment, and the paths that carry it, of the flows from source+ to sink+ on each gene's graph that come nearest the
    counts summed over samples. rows: a gene's segments and their rows; rows of mask 0 have no target."""
    phi, paths = np.zeros(len(x)), {}
    for gene, edges in sorted(graphs.items()):
        own = rows[gene]
        node_row = {n: own[n[:-1]] for e in edges for n in e if n[:-1] in own}
        goal = {n: float(x[r]) for n, r in node_row.items() if mask[r]}
        loss = (poisson_loss, poisson_slope) if poisson else (squared_loss, squared_slope)
        flow, used = fit_flow(edges, "source+", "sink+", goal, {n: float(lengths[r]) for n, r in node_row.items()}, *loss, rounds=rounds)
        for n, f in flow.items():
            if n in node_row:
                phi[node_row[n]] += f
        carried: dict[Edge, float] = defaultdict(float)
        for p, a in used:
            for e in zip(p, p[1:], strict=False):
                carried[e] += a
        paths[gene] = decompose(carried, "source+", "sink+") if carried else []
    return phi, paths


def coverage_walk(edges: set[Edge], capacity: dict[str, float], source: str, sink: str) -> list[str]:
    """Maximum flow under node capacities, then from source on always along the largest flow."""
    arcs = {(n + "|in", n + "|out"): capacity.get(n, np.inf) for n in {x for e in edges for x in e}}
    arcs |= {(u + "|out", v + "|in"): np.inf for u, v in edges}
    top = sum(c for c in capacity.values() if np.isfinite(c)) + 1
    _, flow = max_flow({e: min(c, top) for e, c in arcs.items()}, source + "|in", sink + "|out")
    walk, at = [source], source
    while at != sink:
        options = sorted(((f, e[1].removesuffix("|in")) for e, f in flow.items() if e[0] == at + "|out"), key=lambda o: (-o[0], o[1]))
        options = [o for o in options if o[1] not in walk]
        if not options:
            return walk
        at = options[0][1]
        walk.append(at)
    return walk


def flow_paths(flows: DataFrame) -> DataFrame:
    """(gene, nth, path, amount): each gene's flow (gene, u, v, flow; from source+ to sink+) as widest paths."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = decompose({(u, v): float(f) for u, v, f in zip(pdf["u"], pdf["v"], pdf["flow"], strict=True)}, "source+", "sink+")
        return some({"gene": [pdf["gene"].iloc[0]] * len(out), "nth": list(range(len(out))), "path": [p for p, _ in out], "amount": [a for _, a in out]})

    return given(flows.groupBy("gene").applyInPandas(run, flows.select("gene").schema.add("nth", "integer").add("path", T.ArrayType(T.StringType())).add("amount", "double")))


def normalised_flows(targets: DataFrame) -> DataFrame:
    """(gene, node, flow): throughput of the fitted flow; targets: (gene, u, v, target), where target is that of v, null for the ends."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        goal = {v: float(t) for v, t in zip(pdf["v"], pdf["target"], strict=True) if t == t and v != "sink+"}
        flow, _ = fit_flow(set(zip(pdf["u"], pdf["v"], strict=True)), "source+", "sink+", goal, {})
        return some({"gene": [pdf["gene"].iloc[0]] * len(flow), "node": list(flow), "flow": list(flow.values())})

    return given(targets.groupBy("gene").applyInPandas(run, targets.select("gene").schema.add("node", "string").add("flow", "double")))


def widest_paths_of(flows: DataFrame, most: int, least: float) -> DataFrame:
    """(gene, nth, path, amount): of flow_paths the `most` widest of each gene that carry more than least."""
    return flow_paths(flows).where((F.col("amount") > least) & (F.col("nth") < most))
