"""Factor graphs over discrete variables: loopy sum-product, exhaustive sums, widths by min-fill, and their text form."""

from __future__ import annotations

import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class FactorGraph:
    """Variables with their numbers of states; factors as (names, table with one axis for each name); observed states."""

    states: dict[str, int] = field(default_factory=dict)
    factors: list[tuple[tuple[str, ...], np.ndarray]] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)

    def add(self, names: tuple[str, ...], table) -> None:
        table = np.asarray(table, float)
        for name, n in zip(names, table.shape, strict=True):
            if self.states.setdefault(name, n) != n:
                raise ValueError(f"{name} has {self.states[name]} states, not {n}")
        self.factors.append((tuple(names), table))

    def observed(self) -> list[tuple[tuple[str, ...], np.ndarray]]:
        """The factors, with what contradicts the observations set to zero."""
        out = []
        for names, table in self.factors:
            table = table.copy()
            for axis, name in enumerate(names):
                if name in self.seen:
                    off = np.ones(table.shape[axis], bool)
                    off[self.seen[name]] = False
                    table[(slice(None),) * axis + (off,)] = 0
            out.append((names, table))
        return out

    def brute_force(self) -> dict[str, np.ndarray]:
        """Marginals of all variables by the sum over every joint state."""
        names = sorted(self.states)
        out = {n: np.zeros(self.states[n]) for n in names}
        factors = self.observed()
        for joint in itertools.product(*(range(self.states[n]) for n in names)):
            at = dict(zip(names, joint, strict=True))
            if any(at[n] != s for n, s in self.seen.items() if n in at):
                continue
            p = float(np.prod([t[tuple(at[n] for n in own)] for own, t in factors]))
            for n in names:
                out[n][at[n]] += p
        total = sum(next(iter(out.values()))) if out else 0
        return {n: v / total for n, v in out.items()} if total else out

    def sum_product(self, rounds: int = 500, least: float = 1e-9) -> dict[str, np.ndarray]:
        """Marginals by parallel message passing, exact where the graph is a tree; stops once no message moves by more than least."""
        factors = self.observed()
        near: dict[str, list[int]] = {n: [] for n in self.states}
        for f, (names, _) in enumerate(factors):
            for n in names:
                near[n].append(f)
        even = lambda n: np.full(self.states[n], 1 / self.states[n])
        to_factor = {(n, f): even(n) for n, fs in near.items() for f in fs}
        to_var = {(f, n): even(n) for n, fs in near.items() for f in fs}
        for _ in range(rounds):
            moved = 0.0
            for f, (names, table) in enumerate(factors):
                for axis, n in enumerate(names):
                    t = table
                    for other, m in enumerate(names):
                        if other != axis:
                            t = t * to_factor[m, f].reshape([-1 if i == other else 1 for i in range(t.ndim)])
                    new = t.sum(tuple(i for i in range(t.ndim) if i != axis))
                    new = new / new.sum() if new.sum() > 0 else even(n)
                    moved = max(moved, float(np.abs(new - to_var[f, n]).max()))
                    to_var[f, n] = new
            for n, fs in near.items():
                for f in fs:
                    new = np.prod([np.ones(self.states[n]), *(to_var[g, n] for g in fs if g != f)], axis=0)
                    to_factor[n, f] = new / new.sum() if new.sum() > 0 else even(n)
            if moved < least:
                break
        out = {}
        for n, fs in near.items():
            p = np.prod([np.ones(self.states[n]), *(to_var[f, n] for f in fs)], axis=0)
            out[n] = p / p.sum() if p.sum() > 0 else p
        return out

    def width(self) -> int:
        """Treewidth bound of min-fill elimination; -1 without variables."""
        near: dict[str, set[str]] = {n: set() for n in self.states}
        for names, _ in self.factors:
            for n in names:
                near[n] |= set(names) - {n}
        return min_fill(near)

    def text(self) -> str:
        """The number of factors; of each, its variables by number in name order, their states, and its cells that aren't zero, the first
        variable moving fastest."""
        at = {n: i for i, n in enumerate(sorted(self.states))}
        out = [str(len(self.factors))]
        for names, table in self.observed():
            cells = [(i, x) for i, x in enumerate(table.ravel(order="F")) if x]
            out += ["", str(len(names)), " ".join(str(at[n]) for n in names), " ".join(str(s) for s in table.shape), str(len(cells)), *(f"{i} {x:.17g}" for i, x in cells)]
        return "\n".join(out) + "\n"


def from_text(text: str) -> FactorGraph:
    """What `text` wrote; variables are named by their numbers."""
    words = iter([line for line in text.split("\n") if line.strip() and not line.startswith("#")])
    graph = FactorGraph()
    for _ in range(int(next(words))):
        n = int(next(words))
        names, shape = (next(words).split(), [int(s) for s in next(words).split()]) if n else ([], [])
        flat = np.zeros(int(np.prod(shape)) if n else 1)
        for _ in range(int(next(words))):
            i, x = next(words).split()
            flat[int(i)] = float(x)
        graph.add(tuple(names), flat.reshape(shape, order="F"))
    return graph


def read_marginals(lines: list[str], names: list[str]) -> dict[str, np.ndarray]:
    """Marginals printed as ({x3}, (0.2, 0.8)), by the names of the variables numbered in order; other lines are passed over."""
    out = {}
    for line in lines:
        if m := re.search(r"\(\{x(\d+)\},\s*\(([^)]*)\)\)", line):
            out[names[int(m[1])]] = np.array([float(x) for x in m[2].split(",")])
    return out


def read_states(lines: list[str], names: list[str]) -> dict[str, int]:
    """A best joint state printed as lines 'number state'."""
    return {names[int(m[1])]: int(m[2]) for line in lines if (m := re.fullmatch(r"\s*(\d+)\s+(\d+)\s*", line))}


def min_fill(near: dict[str, set[str]]) -> int:
    """Largest clique less one of the elimination that adds fewest edges at each step, ties to the smaller name; -1 for no node. Neighbours are bits of whole numbers; after a step only nodes
    whose neighbours or whose neighbours' edges changed are counted again."""
    names = sorted(near)
    at = {n: i for i, n in enumerate(names)}
    left, width = [sum(1 << at[m] for m in near[n]) for n in names], -1

    def bits(mask: int) -> Iterator[int]:
        while mask:
            low = mask & -mask
            yield low.bit_length() - 1
            mask ^= low

    def fill(i: int) -> int:
        around, d = left[i], left[i].bit_count()
        return (d * (d - 1) - sum((left[a] & around).bit_count() for a in bits(around))) // 2

    fills: list[int | None] = [fill(i) for i in range(len(names))]
    waits = [(f, i) for i, f in enumerate(fills)]
    heapq.heapify(waits)
    while waits:
        f, node = heapq.heappop(waits)
        if fills[node] != f:  # gone, or counted again since
            continue
        around, fills[node] = left[node], None
        width = max(width, around.bit_count())
        changed = around
        for a in bits(around):
            left[a] &= ~(1 << node)
        for a in bits(around):
            fresh = around & ~left[a] & ~(1 << a)
            left[a] |= fresh
            for b in bits(fresh):
                left[b] |= 1 << a
                changed |= left[a] & left[b]
        for i in bits(changed):
            if (now := fill(i)) != fills[i]:
                fills[i] = now
                heapq.heappush(waits, (now, i))
    return width


def path_factors(edges: list[tuple[str, str]], weight: dict[str, float], sources: set[str], sinks: set[str]) -> FactorGraph:
    """A unit of flow as a factor graph: a binary variable for each edge, as many edges into a node as out of it and one at most; a node's
    weight counts if its edges are used. Cycles are allowed."""
    graph, into, out = FactorGraph(), {}, {}
    for u, v in edges:
        out.setdefault(u, []).append(f"{u}>{v}")
        into.setdefault(v, []).append(f"{u}>{v}")
    for node in sorted(set(into) | set(out)):
        names = [*into.get(node, []), *out.get(node, [])]
        n_in, table = len(into.get(node, [])), np.zeros([2] * len(names))
        for state in itertools.product((0, 1), repeat=len(names)):
            a, b = sum(state[:n_in]), sum(state[n_in:])
            ok = b == 1 if node in sources else a == 1 if node in sinks else a == b and a <= 1
            if ok:
                table[state] = weight.get(node, 1.0) if a + b else 1.0
        graph.add(tuple(names), table)
    return graph


def graph_widths(edges: DataFrame) -> DataFrame:
    """(gene, width): the min-fill bound of each gene's edge variables (gene, u, v), neighbours if they share a node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, at = set(zip(pdf["u"], pdf["v"], strict=True)), defaultdict(set)
        for u, v in own:
            at[u].add(f"{u}>{v}")
            at[v].add(f"{u}>{v}")
        near = {f"{u}>{v}": (at[u] | at[v]) - {f"{u}>{v}"} for u, v in own}
        return pd.DataFrame({"gene": [pdf["gene"].iloc[0]], "width": [min_fill(near)]})

    return edges.groupBy("gene").applyInPandas(run, edges.select("gene").schema.add("width", "integer"))


def narrow_genes(widths: DataFrame, outliers: DataFrame, most: int = 16) -> DataFrame:
    """(gene): genes of a width from 0 to most that are no outliers (gene)."""
    return widths.where(F.col("width").between(0, most)).select("gene").join(outliers.select("gene").distinct(), "gene", "left_anti")
