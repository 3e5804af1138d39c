"""One gene's acyclic graph in NumPy: sums over all source-to-sink paths, best paths, samples, distances, bubbles, cycles."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .iteration import roots, settle, small


class Dag:
    """Nodes in topological order, edges as index arrays. Raises ValueError on a cycle."""

    def __init__(self, edges: Iterable[tuple[str, str]], extra: Iterable[str] = ()):
        self.edges = sorted(set(edges))
        names = sorted({n for e in self.edges for n in e} | set(extra))
        ahead, degree = defaultdict(list), dict.fromkeys(names, 0)
        for u, v in self.edges:
            ahead[u].append(v)
            degree[v] += 1
        ready, order = [n for n in names if not degree[n]], []
        heapq.heapify(ready)
        while ready:
            n = heapq.heappop(ready)
            order.append(n)
            for v in ahead[n]:
                degree[v] -= 1
                if not degree[v]:
                    heapq.heappush(ready, v)
        if len(order) < len(names):
            raise ValueError("the graph has a cycle")
        self.names, self.at = order, {n: i for i, n in enumerate(order)}
        self.into: list[list[int]] = [[] for _ in order]
        self.out: list[list[int]] = [[] for _ in order]
        for u, v in self.edges:
            self.into[self.at[v]].append(self.at[u])
            self.out[self.at[u]].append(self.at[v])

    def log_sums(self, log_node: np.ndarray, log_edge: dict[tuple[int, int], float], starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Log weights of all paths that end in each node, and that go on from it (without its own weight); and of all paths."""
        n = len(self.names)
        forth, back = np.full(n, -np.inf), np.full(n, -np.inf)
        for i in range(n):
            terms = [forth[j] + log_edge.get((j, i), 0.0) for j in self.into[i]] + ([0.0] if i in starts else [])
            forth[i] = (np.logaddexp.reduce(terms) if terms else -np.inf) + log_node[i]
        for i in reversed(range(n)):
            terms = [back[j] + log_node[j] + log_edge.get((i, j), 0.0) for j in self.out[i]] + ([0.0] if i in ends else [])
            back[i] = np.logaddexp.reduce(terms) if terms else -np.inf
        return forth, back, float(np.logaddexp.reduce([forth[i] for i in ends])) if ends else -np.inf

    def marginals(self, log_node, log_edge, starts, ends) -> np.ndarray:
        forth, back, total = self.log_sums(log_node, log_edge, starts, ends)
        with np.errstate(invalid="ignore"):
            return np.exp(forth + back - total) if np.isfinite(total) else np.zeros(len(self.names))

    def best_path(self, log_node, log_edge, starts, ends, combine: Callable[[float, float], float] = lambda a, b: a + b, sign: int = 1) -> tuple[list[str], float]:
        """The path of highest (sign 1) or lowest (-1) value; of equal ones the first by names. Empty where no path exists."""
        best: list[tuple[float, list[str]] | None] = [None] * len(self.names)
        for i, name in enumerate(self.names):
            options = [(combine(combine(best[j][0], log_edge.get((j, i), 0.0)), log_node[i]), best[j][1]) for j in self.into[i] if best[j]]
            if i in starts:
                options.append((log_node[i], []))
            if options:
                value, path = min(options, key=lambda o: (-sign * round(o[0], 9), o[1]))
                best[i] = (value, [*path, name])
        done = [best[i] for i in ends if best[i]]
        if not done:
            return [], float("-inf")
        value, path = min(done, key=lambda o: (-sign * round(o[0], 9), o[1]))
        return path, value

    def sample(self, log_node, log_edge, starts, ends, rng: np.random.Generator) -> list[str]:
        """A path drawn with probability in proportion to its weight."""
        forth, _, total = self.log_sums(log_node, log_edge, starts, ends)
        if not np.isfinite(total):
            return []

        def pick(options: list[int | None], logs: list[float]):
            p = np.exp(np.array(logs) - np.logaddexp.reduce(logs))
            return options[rng.choice(len(options), p=p / p.sum())]

        at, path = pick(list(ends), [forth[i] for i in ends]), []
        while at is not None:
            path.append(self.names[at])
            options = [*self.into[at], *([None] if at in starts else [])]
            at = pick(options, [0.0 if j is None else forth[j] + log_edge.get((j, at), 0.0) for j in options])
        return path[::-1]


def greedy_walk(dag: Dag, edge_p: dict[tuple[int, int], float], starts, ends, rng: np.random.Generator) -> list[str]:
    """A walk back from an end that picks in-edges in proportion to their marginals, evenly where all are zero."""
    at, path = ends[rng.integers(len(ends))], []
    while True:
        path.append(dag.names[at])
        if at in starts or not dag.into[at]:
            return path[::-1]
        p = np.array([edge_p.get((j, at), 0.0) for j in dag.into[at]])
        p = p / p.sum() if p.sum() > 0 else np.full(len(p), 1 / len(p))
        at = dag.into[at][rng.choice(len(p), p=p)]


def shortest_distances(edges: list[tuple[str, str, float]], start: str) -> dict[str, float]:
    ahead, done, heap = defaultdict(list), {}, [(0.0, start)]
    for u, v, w in edges:
        ahead[u].append((v, w))
    while heap:
        d, n = heapq.heappop(heap)
        if n in done:
            continue
        done[n] = d
        for v, w in ahead[n]:
            if v not in done:
                heapq.heappush(heap, (d + w, v))
    return done


def ball(edges: list[tuple[str, str, float]], start: str, radius: float) -> tuple[set[str], set[str]]:
    """Nodes within a weighted distance, and those among them with an edge that leads out of it."""
    inside = {n for n, d in shortest_distances(edges, start).items() if d <= radius}
    return inside, {u for u, v, _ in edges if u in inside and v not in inside}


def find_cycle(edges: set[tuple[str, str]]) -> list[tuple[str, str]]:
    ahead = defaultdict(list)
    for u, v in sorted(edges):
        ahead[u].append(v)
    state: dict[str, int] = {}
    for root in sorted(ahead):
        if root in state:
            continue
        stack, trail = [(root, iter(ahead[root]))], [root]
        state[root] = 1
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                state[node] = 2
                stack.pop()
                trail.pop()
            elif state.get(nxt) == 1:
                loop = trail[trail.index(nxt) :] + [nxt]
                return list(zip(loop, loop[1:], strict=False))
            elif nxt not in state:
                state[nxt] = 1
                stack.append((nxt, iter(ahead[nxt])))
                trail.append(nxt)
    return []


def break_cycles(weights: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Edges without cycles: while there is one, its lightest edge goes, ties to the smaller name."""
    left = dict(weights)
    while loop := find_cycle(set(left)):
        del left[min(loop, key=lambda e: (left[e], e))]
    return left


def neighbours(edges: Iterable[tuple[str, str]]) -> tuple[dict[str, set[str]], dict[str, set[str]]]:
    """Where each node leads, and what leads to it."""
    ahead, parents = defaultdict(set), defaultdict(set)
    for u, v in edges:
        ahead[u].add(v)
        parents[v].add(u)
    return ahead, parents


def superbubble(edges: set[tuple[str, str]], source: str, near: tuple[dict[str, set[str]], dict[str, set[str]]] | None = None) -> tuple[str, set[str]] | None:
    """The end and the nodes of the superbubble that opens at source, if there is one: a region that is entered at source alone and left at
    its end alone, without dead ends and cycles. near: neighbours(edges), if at hand."""
    ahead, parents = near or neighbours(edges)
    ready, seen, visited = [source], {source}, set()
    while ready:
        node = ready.pop()
        visited.add(node)
        seen.discard(node)
        if not ahead[node]:
            return None
        for child in sorted(ahead[node]):
            if child == source:
                return None
            seen.add(child)
            if parents[child] <= visited:
                ready.append(child)
        if len(ready) == 1 and len(seen) == 1:
            end = ready[0]
            if source in ahead[end]:
                return None
            return end, visited | {end}
    return None


def bubble_chain(edges: set[tuple[str, str]], start: str) -> list[tuple[str, set[str]]]:
    """Superbubbles one behind the other from start on."""
    out, at, been, near = [], start, set(), neighbours(edges)
    while at not in been and (found := superbubble(edges, at, near)):
        been.add(at)
        out.append(found)
        at = found[0]
    return out


def hops_from(edges: set[tuple[str, str]], start: str) -> dict[str, int]:
    ahead = defaultdict(list)
    for u, v in edges:
        ahead[u].append(v)
    out, queue = {start: 0}, deque([start])
    while queue:
        n = queue.popleft()
        for v in ahead[n]:
            if v not in out:
                out[v] = out[n] + 1
                queue.append(v)
    return out


def sources_and_sinks(edges: list[tuple[str, str, float]], lengths: dict[str, int], tips: dict[str, bool | None], isolated: set[str], stops: list[tuple[str, bool]], least: float, dead: set[str] = frozenset()) -> tuple[list[str], list[str]]:
    """Oriented sources and sinks of one gene from stop codons. tips: each tip and the direction it is known to leave in; stops:
    (segment, forward), a later one of a segment replacing an earlier; dead: tips known to be dead ends, which are neither. Where every segment has a stop, those are both. Else sinks are tips
    with a stop (not isolated, or longer than least) or reached from one, '+' before '-'; sources the other tips that reach a
    sink; further tips that a source reaches are sinks; isolated long tips are both."""
    name = lambda u, f: u + ("+" if f else "-")
    known = dict(stops)
    if len(known) == len(lengths):
        both = [name(u, f) for u, f in known.items()]
        return both, list(both)
    tips = {u: f for u, f in tips.items() if u not in dead}
    reach: dict[str, dict[str, float]] = {}

    def reached(a: str, b: str) -> bool:
        if a not in reach:
            reach[a] = shortest_distances(edges, a)
        return b in reach[a]

    sinks, sources, rest = [], [], []
    for u in tips:
        if u in known:
            if u not in isolated or lengths[u] > least:
                sinks.append(name(u, known[u]))
            continue
        hit = next((name(u, f) for f in (True, False) if any(reached(name(s, d), name(u, f)) for s, d in known.items())), None)
        if hit:
            sinks.append(hit)
        else:
            rest.append(u)
    left = []
    for u in rest:
        hit = next((name(u, f) for f in (True, False) if any(s != name(u, f) and reached(name(u, f), s) for s in sinks)), None)
        (sources if hit else left).append(hit or u)
    for u in left:
        hit = next((name(u, f) for f in (True, False) if any(reached(s, name(u, f)) for s in sources)), None)
        if hit:
            sinks.append(hit)
        elif u in isolated and lengths[u] > least:
            both = name(u, tips[u] if tips[u] is not None else True)
            sources.append(both)
            sinks.append(both)
    for u, f in known.items():
        if u in isolated and u in tips and lengths[u] > least:
            sources.append(name(u, f))
    return sources, sinks


def tip_distances(edges: list[tuple[str, str, float]], tips: list[str]) -> dict[str, dict[str, float]]:
    """Least weights between the oriented nodes of tips, from each that is in the graph to those that it leads to, itself included."""
    nodes, own = {n for u, v, _ in edges for n in (u, v)}, {u + d for u in tips for d in "+-"}
    return {a: {b: d for b, d in shortest_distances(edges, a).items() if b in own} for a in sorted(own & nodes)}


def _farthest(options: list[tuple[str, list[float]]]) -> tuple[float, str]:
    """The node of the largest distance, the first of equal ones; each with the distances to those that count."""
    best = [(max([0.0, *d]), n) for n, d in options]
    return best[0] if best[0][0] >= best[1][0] else best[1]


def ends_by_distance(edges: list[tuple[str, str, float]], lengths: dict[str, int], tips: list[str], isolated: set[str], share: float, least: int = 200) -> tuple[list[str], list[str]]:
    """Sources and sinks without stop codons: the two tips farthest apart, then each other tip on the side that it is farther from, if that
    is over share of the largest distance. Isolated segments longer than least are both; a single segment is both."""
    if len(lengths) == 1:
        return [next(iter(lengths)) + "+"], [next(iter(lengths)) + "+"]
    apart = tip_distances(edges, tips)
    pairs = [(d, a, b) for a, own in apart.items() for b, d in own.items() if d > 0]
    sources, sinks = [], []
    if pairs:
        top, first, last = min(pairs, key=lambda x: (-x[0], x[1], x[2]))
        sources, sinks = [first], [last]
        for u in (u for u in tips if u not in (first[:-1], last[:-1])):
            ahead, source = _farthest([(u + d, [apart.get(u + d, {}).get(s, 0.0) for s in sinks]) for d in "+-"])
            back, sink = _farthest([(u + d, [apart.get(s, {}).get(u + d, 0.0) for s in sources]) for d in "+-"])
            if ahead > back:
                if ahead > share * top:
                    sources.append(source)
            elif back > share * top:
                sinks.append(sink)
    both = [u + "+" for u in isolated if lengths[u] > least]
    return sources + both, sinks + both


def ends_from_first(edges: list[tuple[str, str, float]], tips: list[str]) -> tuple[list[str], list[str]]:
    """Sources and sinks without stop codons and thresholds: the first tip is a source, the nearest one that it leads to a sink, and each other
    tip goes to the side that it is farther from."""
    if not tips:
        return [], []
    apart, leaves = tip_distances(edges, tips), {u for u, _, _ in edges}
    first = tips[0] + ("+" if tips[0] + "+" in leaves else "-")
    sources, sinks, rest = [first], [], list(tips[1:])
    near = sorted((d, b) for b, d in apart.get(first, {}).items() if b[:-1] in rest)
    if near:
        sinks.append(near[0][1])
        rest.remove(near[0][1][:-1])
    for u in rest:
        back, sink = _farthest([(u + d, [apart.get(s, {}).get(u + d, 0.0) for s in sources]) for d in "-+"])
        ahead, source = _farthest([(u + d, [apart.get(u + d, {}).get(s, 0.0) for s in sinks]) for d in "-+"])
        (sinks if back > ahead else sources).append(sink if back > ahead else source)
    return sources, sinks


def extended(path: list[str], position: int, edges: set[tuple[str, str]], lengths: dict[str, int], overlap: int, ahead: bool) -> tuple[list[str], int]:
    """The path and its end (or start) position, carried on to the next segment while the position lies in the overlap and only one
    segment follows (or precedes)."""
    near: dict[str, list[str]] = defaultdict(list)
    for u, v in sorted(edges):
        near[u if ahead else v].append(v if ahead else u)
    path = list(path)
    while True:
        node = path[-1] if ahead else path[0]
        inside = position > lengths[node[:-1]] - overlap if ahead else position < overlap
        if not inside or len(near[node]) != 1 or near[node][0] in path:
            return path, position
        nxt = near[node][0]
        position += overlap - lengths[node[:-1]] if ahead else lengths[nxt[:-1]] - overlap
        path.insert(len(path) if ahead else 0, nxt)


def bubbles_around(edges: set[tuple[str, str]], node: str) -> set[str]:
    """All nodes of the superbubble chains that leave node ahead and, on the reversed graph, backwards."""
    out = {node}
    for own in (edges, {(v, u) for u, v in edges}):
        for _, inside in bubble_chain(own, node):
            out |= inside
    return out


# ---- per gene, as DataFrame operators ----


def some(columns: dict[str, list]) -> pd.DataFrame:
    """A group's rows; of a group without any, one row of nulls, which `given` takes out again: Arrow takes no empty group."""
    return pd.DataFrame(columns if len(next(iter(columns.values()))) else {k: [None] for k in columns})


def given(df: DataFrame) -> DataFrame:
    return df.where(f"{df.columns[0]} is not null")


def _ends(pdf: pd.DataFrame) -> tuple[set, set]:
    u, v = set(pdf["u"]), set(pdf["v"])
    return u - v, v - u


def _model(pdf: pd.DataFrame, log: bool) -> tuple[Dag, dict, list[int], list[int]]:
    dag = Dag(zip(pdf["u"], pdf["v"], strict=True))
    w = np.log(pdf["weight"].to_numpy(float)) if log else pdf["weight"].to_numpy(float)
    edge = {(dag.at[a], dag.at[b]): x for a, b, x in zip(pdf["u"], pdf["v"], w, strict=True)}
    first, last = _ends(pdf)
    return dag, edge, [dag.at[n] for n in first], [dag.at[n] for n in last]


def node_marginals(edges: DataFrame) -> DataFrame:
    """(gene, node, p): share of the weight of all paths from nodes without in-edges to nodes without out-edges that passes each node; a
    path weighs the product of its edges (gene, u, v, weight)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dag, edge, starts, ends = _model(pdf, True)
        return pd.DataFrame({"gene": pdf["gene"].iloc[0], "node": dag.names, "p": dag.marginals(np.zeros(len(dag.names)), edge, starts, ends)})

    return edges.groupBy("gene").applyInPandas(run, edges.select("gene").schema.add("node", "string").add("p", "double"))


def best_paths(edges: DataFrame, kind: str) -> DataFrame:
    """(gene, path array, value) of edges (gene, u, v, weight). kind: map (highest product, of which value is the logarithm), heaviest (highest sum), shortest (lowest sum),
    widest (highest least weight)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dag, edge, starts, ends = _model(pdf, kind == "map")
        none = np.full(len(dag.names), np.inf if kind == "widest" else 0.0)
        path, value = dag.best_path(none, edge, starts, ends, min if kind == "widest" else (lambda a, b: a + b), -1 if kind == "shortest" else 1)
        return pd.DataFrame({"gene": [pdf["gene"].iloc[0]], "path": [path], "value": [value]})

    return edges.groupBy("gene").applyInPandas(run, edges.select("gene").schema.add("path", T.ArrayType(T.StringType())).add("value", "double"))


def path_samples(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """(gene, sample, path): n paths of each gene, drawn with probability in proportion to their weight."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dag, edge, starts, ends = _model(pdf.sort_values(["u", "v"]), True)
        rng = np.random.default_rng([seed, *str(pdf["gene"].iloc[0]).encode()])
        paths = [dag.sample(np.zeros(len(dag.names)), edge, sorted(starts), sorted(ends), rng) for _ in range(n)]
        return pd.DataFrame({"gene": pdf["gene"].iloc[0], "sample": range(n), "path": paths})

    return edges.groupBy("gene").applyInPandas(run, edges.select("gene").schema.add("sample", "integer").add("path", T.ArrayType(T.StringType())))


def distances(edges: DataFrame, start: str) -> DataFrame:
    """(gene, node, distance): least summed weight from start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = shortest_distances(list(zip(pdf["u"], pdf["v"], pdf["weight"], strict=True)), start)
        return pd.DataFrame({"gene": pdf["gene"].iloc[0], "node": list(d), "distance": list(d.values())})

    return edges.groupBy("gene").applyInPandas(run, edges.select("gene").schema.add("node", "string").add("distance", "double"))


def without_cycles(edges: DataFrame) -> DataFrame:
    """(gene, u, v, weight): edges left once every cycle has lost its lightest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = break_cycles({(a, b): w for a, b, w in zip(pdf["u"], pdf["v"], pdf["weight"], strict=True)})
        return some({"gene": [pdf["gene"].iloc[0]] * len(left), "u": [a for a, _ in left], "v": [b for _, b in left], "weight": list(left.values())})

    return given(edges.groupBy("gene").applyInPandas(run, edges.select("gene", "u", "v", "weight").schema))


#: Edges that a task of superbubbles links at once; they are packed by the parts they form.
PACK = 1 << 19


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes, the least that the edges a - b connect it with."""
    to = np.arange(n)
    while True:
        x, y = to[a], to[b]
        apart = x != y
        if not apart.any():
            return to
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    new = np.ones(len(columns[0]) + 1, bool)
    new[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gene, u, v, a, b), a and b the ids of u and v -> (gene, us, vs, part, null) for edges that are connected here, part being one of their ids; and (null, null, null, part, id)
    for each of the ids but part itself."""

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gene, u, v, a, b = (c.combine_chunks() for c in rows.columns)
        ids, at = np.unique(np.concatenate((a.to_numpy(), b.to_numpy())), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        to = _least(a, b, len(ids))
        codes = _codes(gene)
        order = np.lexsort((codes, to[a]))
        cut = _cuts(to[a][order], codes[order])
        lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), x.take(pa.array(order))) for x in (u, v)]
        first, more = order[cut[:-1]], np.flatnonzero(to != np.arange(len(ids)))
        n = len(first)
        yield pa.RecordBatch.from_arrays([gene.take(pa.array(first)), *lists, pa.array(ids[to[a[first]]]), pa.nulls(n, pa.int64())], ["gene", "us", "vs", "part", "id"])
        none = [pa.nulls(len(more), t) for t in (gene.type, lists[0].type, lists[1].type)]
        yield pa.RecordBatch.from_arrays([*none, pa.array(ids[to[more]]), pa.array(ids[more])], ["gene", "us", "vs", "part", "id"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK:
            yield from packed(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from packed(pa.Table.from_batches(held))


def _bubbles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gene, us, vs, part), a gene's rows of a part one behind the other -> (gene, source, sink, nodes)."""

    def found(own: set[tuple[str, str]]) -> list[tuple[str, str, list[str]]]:
        near = neighbours(own)
        several = sorted(u for u, to in near[0].items() if len(to) > 1)  # with one child a bubble has no inner nodes
        return [(s, b[0], sorted(b[1])) for s in several if (b := superbubble(own, s, near)) and len(b[1]) > 3]

    def rows(gene: pa.Array, out: list) -> pa.RecordBatch:
        at, out = pa.array([i for i, _ in out], pa.int64()), [x for _, x in out]
        return pa.RecordBatch.from_arrays([gene.take(at), *[pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))]], ["gene", "source", "sink", "nodes"])

    open_, own = None, set()  # the gene and part whose edges may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        gene, us, vs, part = batch.columns
        cut = _cuts(_codes(gene), part.to_numpy()).tolist()
        u, v, offset = us.flatten().to_pylist(), vs.flatten().to_pylist(), np.concatenate(([0], np.cumsum(us.value_lengths().to_numpy()))).tolist()
        out = []
        for s, e in zip(cut, cut[1:]):
            edges = zip(u[offset[s] : offset[e]], v[offset[s] : offset[e]], strict=True)
            if s == 0 and open_ and open_[1] == part[0].as_py() and open_[0][0].equals(gene[0]):
                own.update(edges)
            else:
                if s == 0 and open_:
                    yield rows(open_[0], [(0, x) for x in found(own)])
                own = set(edges)
            if e < len(gene):
                out += [(s, x) for x in found(own)]
        open_ = gene.slice(len(gene) - 1), part[len(gene) - 1].as_py()
        yield rows(gene, out)
    if open_:
        yield rows(open_[0], [(0, x) for x in found(own)])


def superbubbles(edges: DataFrame) -> DataFrame:
    """(gene, source, sink, nodes): every superbubble of two and more inner nodes. A gene's connected parts are searched one by one, a part in one task: tasks link the
    edges that they hold, and parts that share a node of another task are joined. Edges that lack an end are none."""
    ids = [F.xxhash64("gene", c).alias(n) for c, n in (("u", "a"), ("v", "b"))]  # where two nodes share an id, two parts are searched as one
    kinds = edges.select("gene").schema
    schema = T.StructType([*kinds, *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("us", "vs")], T.StructField("part", T.LongType()), T.StructField("id", T.LongType())])
    packed = settle(edges.where("u is not null and v is not null").select("gene", "u", "v", *ids).mapInArrow(_pack, schema))
    held, named = packed.where("id is not null").select("id", "part"), packed.where("id is null").select(F.col("part").alias("id"), "part")
    shared = held.union(named).groupBy("id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    to = small(roots(held.join(small(settle(shared.select("id", "low"))), "id").select(F.col("id").alias("a"), F.col("part").alias("b"))))
    rows = packed.where("id is null").select("gene", "us", "vs", "part").join(to.withColumnRenamed("id", "part"), "part", "left").select("gene", "us", "vs", F.coalesce("root", "part").alias("part"))
    dealt = rows.repartition("part").sortWithinPartitions("part", "gene")
    return dealt.mapInArrow(_bubbles, T.StructType([*kinds, T.StructField("source", T.StringType()), T.StructField("sink", T.StringType()), T.StructField("nodes", T.ArrayType(T.StringType()))]))


def all_distances(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """(gene, start, node, distance): least summed weights between the tips (gene, node) of edges (gene, u, v, weight)."""
    rows = edges.select("gene", "u", "v", "weight").unionByName(tips.select("gene", "node").withColumnRenamed("node", "u"), allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links, own = pdf[pdf["v"].notna()], set(pdf[pdf["v"].isna()]["u"])
        edge = list(zip(links["u"], links["v"], links["weight"], strict=True))
        found = [(a, b, d) for a in sorted(own) for b, d in shortest_distances(edge, a).items() if b in own]
        return some({"gene": [pdf["gene"].iloc[0]] * len(found), "start": [a for a, _, _ in found], "node": [b for _, b, _ in found], "distance": [float(d) for _, _, d in found]})

    return given(rows.groupBy("gene").applyInPandas(run, edges.select("gene").schema.add("start", "string").add("node", "string").add("distance", "double")))


def distance_ends(edges: DataFrame, tips: DataFrame, share: float) -> DataFrame:
    """(gene, role, node): ends_by_distance (share >= 0) or ends_from_first (share < 0) of each gene; tips: (gene, unitig, len, isolated)."""
    rows = edges.select("gene", "u", "v", "weight").unionByName(tips.select("gene", "unitig", "len", "isolated"), allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links, ends = pdf[pdf["v"].notna()], pdf[pdf["unitig"].notna()].sort_values("unitig")
        edge, names = list(zip(links["u"], links["v"], links["weight"], strict=True)), list(ends["unitig"])
        length = {n[:-1]: 0 for u, v, _ in edge for n in (u, v)} | dict(zip(ends["unitig"], ends["len"], strict=True))
        alone = [u for u, i in zip(ends["unitig"], ends["isolated"], strict=True) if i]
        sources, sinks = ends_by_distance(edge, length, names, alone, share) if share >= 0 else ends_from_first(edge, [u for u in names if u not in alone])
        found = [("source", x) for x in sources] + [("sink", x) for x in sinks]
        return some({"gene": [pdf["gene"].iloc[0]] * len(found), "role": [r for r, _ in found], "node": [x for _, x in found]})

    return given(rows.groupBy("gene").applyInPandas(run, edges.select("gene").schema.add("role", "string").add("node", "string")))
