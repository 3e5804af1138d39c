"""Graph rounds against plain searches over small random graphs."""

import random
from collections import defaultdict

import pytest

from skein.operators import graph, iteration, wavefront


def random_edges(seed, n=14, m=30, genes=(1, 2), acyclic=False):
    r, out = random.Random(seed), {}
    for g in genes:
        for _ in range(m):
            a, b = r.randrange(n), r.randrange(n)
            if acyclic:
                a, b = min(a, b), max(a, b)
                if a == b:
                    continue
            out[g, f"n{a:02}", f"n{b:02}"] = float(r.randint(0, 6))
    return out


def table(spark, edges, more=()):
    rows = [(*e, w, "clash") for e, w in edges.items()] + [(*e, None if e[2] is None else 1.0, "clash") for e in more]
    return spark.createDataFrame(rows, "gene int, u string, v string, weight double, sample string").repartition(3)


@pytest.fixture(params=[False, True], ids=["one task", "shuffled"])
def sizes(request, monkeypatch):
    if request.param:
        for module in (iteration, graph, wavefront):
            monkeypatch.setattr(module, "FEW", 0)


def reach(edges, gene, start):
    hops, front = {start: 0}, [start]
    while front:
        front = [v for u in front for (g, a, v) in edges if g == gene and a == u and v not in hops and not hops.update({v: hops[u] + 1})]
    return hops


def test_hops_equal_a_search(spark, sizes):
    edges = random_edges(1)
    starts = spark.createDataFrame([(1, "n00"), (1, "n03"), (2, "n05"), (2, "n05"), (9, "alone")], "gene int, node string")
    got = {(r.gene, r.start, r.node): r.hops for r in graph.hops(table(spark, edges, [(1, None, "n01"), (1, "n00", None)]), starts.selectExpr("gene", "node AS start", "node"), ("gene", "start")).collect()}
    want = {(g, s, n): h for g, s in ((1, "n00"), (1, "n03"), (2, "n05"), (9, "alone")) for n, h in reach(edges, g, s).items()}
    assert got == want
    one = {(r.gene, r.node): r.hops for r in graph.hops(table(spark, edges), starts, limit=2).collect()}
    assert one == {k: h for k in {(g, n) for g, _, n in want} if (h := min(want[g, s, n] for g, s, n in want if (g, n) == k)) <= 2}


def balls(edges, gene, start, radius):
    best, todo = {start: 0.0}, [start]
    while todo:
        u = todo.pop(0)
        if best[u] > radius:
            continue
        for (g, a, v), w in edges.items():
            if g == gene and a == u and best[u] + w < best.get(v, 1e9):
                best[v] = best[u] + w
                todo.append(v)
    # on the rim only what the nodes within lead to
    inner = {n: d for n, d in best.items() if d <= radius}
    rim = defaultdict(lambda: 1e9)
    for (g, a, v), w in edges.items():
        if g == gene and a in inner and v not in inner:
            rim[v] = min(rim[v], inner[a] + w)
    return inner, dict(rim)


@pytest.mark.parametrize("radius", [0, 5.5])
def test_ego_graphs_equal_a_search(spark, radius):
    edges = random_edges(2)
    starts = spark.createDataFrame([(g, f"n{i:02}") for g in (1, 2) for i in range(4)] + [(1, "alone")], "gene int, start string")
    got = {(r.gene, r.start, r.node): (r.distance, r.on_rim) for r in wavefront.ego_graphs(table(spark, edges), starts, radius).collect()}
    want = {}
    for g, s in [(r.gene, r.start) for r in starts.collect()]:
        inner, rim = balls(edges, g, s, radius)
        want |= {(g, s, n): (d, False) for n, d in inner.items()} | {(g, s, n): (d, True) for n, d in rim.items()}
    assert got == want


def test_ego_core_equals_a_search(spark):
    edges = {e: w for e, w in random_edges(3, 20, 30).items() if e[1] != e[2]}
    flipped = {(g, v, u): w for (g, u, v), w in edges.items()}

    def side(ahead, behind, g, start, radius=4):
        fan = defaultdict(int)
        for gg, u, _ in ahead:
            fan[u] += gg == g
        inner, _ = balls(ahead, g, start, radius)
        seen, todo, ends = {start}, [start], set()
        while todo:
            u = todo.pop()
            for gg, a, v in ahead:
                if gg == g and a == u and v not in seen:
                    seen.add(v)
                    if v not in inner and fan[v] == 1:
                        ends.add(v)
                    else:
                        todo.append(v)
        return {n for e in ends for part in balls(behind, g, e, radius) for n in part}

    starts = [(g, f"n{i:02}") for g in (1, 2) for i in range(6)]
    want = {(g, s, n) for g, s in starts for n in side(edges, flipped, g, s) & side(flipped, edges, g, s)}
    got = {tuple(r) for r in wavefront.ego_core(table(spark, edges), spark.createDataFrame(starts, "gene int, start string"), 4).collect()}
    assert got == want and want


def test_sample_paths_equal_dynamic_programming(spark, sizes, seed=1):
    edges = {e: w for e, w in random_edges(seed, 18, 22, acyclic=True).items()}
    r = random.Random(seed)
    nodes = sorted({(g, n) for g, u, v in edges for n in (u, v)})
    cov = [(g, n, s, float(r.choice([0, 0, 1, 2, 5]))) for g, n in nodes for s in ("a", "b", "c") if r.random() < 0.8] + [(1, "elsewhere", "a", 99.0)]
    length = {(g, n): r.randint(5, 9) for g, n in nodes}
    got = {(x.gene, x.part, x.sample): (x.path, x.value) for x in wavefront.sample_paths(table(spark, edges), spark.createDataFrame(cov, "gene int, node string, sample string, cov double"), spark.createDataFrame([(*k, v) for k, v in length.items()], "gene int, node string, len int"), 3).collect()}
    part = {k: k[1] for k in nodes}
    for _ in nodes:
        for g, u, v in edges:
            part[g, u] = part[g, v] = min(part[g, u], part[g, v])
    leads, want = {(g, u) for g, u, _ in edges}, {}
    for s in ("a", "b", "c", None):
        best = {}
        for g, n in nodes:  # names are in topological order
            own = sum(c for gg, nn, ss, c in cov if (gg, nn) == (g, n) and s in (ss, None)) * (length[g, n] - (3 if (g, n) in leads else 0))
            before = min(((-best[g, u][0], u) for gg, u, v in edges if (gg, v) == (g, n) and best[g, u][0] > 0), default=(0, None))
            best[g, n] = own - before[0], before[1]
        for g, p in {(g, part[g, n]) for g, n in nodes}:
            value, n = min((-best[k][0], k[1]) for k in nodes if k[0] == g and part[k] == p)
            path = []
            while n and value < 0:
                path.insert(0, n)
                n = best[g, n][1]
            if path:
                want[g, p, s] = path, -value
    assert got == want and len(want) > 4


def test_a_cycle_is_an_error(spark):
    e = table(spark, {(1, "a", "b"): 1.0, (1, "b", "c"): 1.0, (1, "c", "b"): 1.0})
    with pytest.raises(ValueError, match="cycle"):
        wavefront.sample_paths(e, spark.createDataFrame([(1, n, 1, 1.0) for n in "abc"], "gene int, node string, sample int, cov double")).count()


@pytest.mark.parametrize("seed,m", [(2, 18), (3, 30)])
def test_strong_components_and_cuts(spark, seed, m):
    edges = random_edges(seed, 14, m)
    edges[3, "x", "x"] = 1.0
    got = {(r.gene, r.node): r.component for r in wavefront.strong_components(table(spark, edges)).collect()}
    want, nodes = {}, {(g, n) for g, u, v in edges for n in (u, v)}
    ahead = {k: set(reach(edges, *k)) for k in nodes}
    for g, n in nodes:
        mates = [o for o in ahead[g, n] if n in ahead[g, o]]
        if len(mates) > 1 or (g, n, n) in edges:
            want[g, n] = min(mates)
    assert got == want
    if m > 18:
        return
    left = {(r.gene, r.u, r.v): r.weight for r in wavefront.acyclic(table(spark, edges)).collect()}
    assert left.items() <= edges.items()
    assert all(u not in reach(left, g, v) for g, u, v in left)
    for e in set(edges) - set(left):  # what went was the lightest of a cycle
        heavier = {k: w for k, w in edges.items() if (w, k) > (edges[e], e)}
        assert e[1] in reach(heavier, e[0], e[2])


def test_chains_are_ranked_also_closed_ones(spark, sizes):
    chains = [["c", "a", "b"], ["z"], [f"k{i:02}" for i in range(21)]]
    rows = [(1, "p", "q"), (1, "q", "o"), (1, "o", "p")] + [(g, a, b) for g in (1, 2) for c in chains for a, b in zip(c, [*c[1:], None])]
    got = {(r.gene, r.id): (r.head, r.nth) for r in wavefront.ranked_chains(spark.createDataFrame(rows, "gene int, id string, to string").repartition(3), ["gene"]).collect()}
    assert got == {(g, x): (c[0], i + 1) for g in (1, 2) for c in chains for i, x in enumerate(c)} | {(1, "o"): ("o", 1), (1, "p"): ("o", 2), (1, "q"): ("o", 3)}
    bubbles = spark.createDataFrame([(1, "s", "t"), (1, "t", "u"), (1, "x", "y")], "gene int, source string, sink string")
    assert sorted(map(tuple, wavefront.bubble_chains(bubbles).collect())) == [(1, "s", 1, "s", "t"), (1, "s", 2, "t", "u"), (1, "x", 1, "x", "y")]


@pytest.mark.parametrize("ahead", [True, False])
def test_paths_are_carried_on(spark, ahead):
    from skein.operators.pathmodel import extended

    r = random.Random(5)
    edges = {(1, f"n{i:02}+", f"n{i + 1:02}+"): 1.0 for i in range(40)} | {(1, "n20+", "n33+"): 1.0, (1, "n05+", "x+"): 1.0}
    length = {f"n{i:02}+": 60 + r.randint(1, 9) for i in range(41)} | {"x+": 61}
    ends = [(1, i, n, p) for i, (n, p) in enumerate((n, p) for n in sorted(length) for p in (0, 1, 30, 60, 65))]
    got = {x.path: (x.node, x.pos, x.added) for x in wavefront.extended_paths(table(spark, edges), spark.createDataFrame(ends, "gene int, path int, node string, pos int"), spark.createDataFrame([(1, n, v) for n, v in length.items()], "gene int, node string, len int"), 60, ahead).collect()}
    for _, i, n, p in ends:
        path, pos = extended([n], p, {(u, v) for _, u, v in edges}, {k[:-1]: v for k, v in length.items()}, 60, ahead)
        added = path[1:] if ahead else path[:-1][::-1]
        assert got[i] == ((path[-1] if ahead else path[0]), pos, added)
    assert max(len(a) for _, _, a in got.values()) > 8


def test_empty_tables(spark):
    e = table(spark, {}).select("gene", "u", "v", "weight")
    none = spark.createDataFrame([], "gene int, start string, node string, sample int, cov double, path int, pos int, len int, source string, sink string")
    assert wavefront.ego_graphs(e, none, 5).count() == wavefront.ego_core(e, none, 5).count() == wavefront.strong_components(e).count() == wavefront.acyclic(e).count() == 0
    assert wavefront.sample_paths(e, none).count() == wavefront.bubble_chains(none).count() == wavefront.extended_paths(e, none, none, 5).count() == graph.hops(e, none).count() == 0


def test_flow_along_paths_stays_above_zero(spark):
    flows = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 1.0), ("c", "d", 2.0)], "u string, v string, flow double")
    paths = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (2, 2, "b")], "path int, pos int, node string")
    got = {(r.u, r.v): r.flow for r in graph.add_path_flow(flows, paths, ["path"], -1.25).collect()}
    assert got == {("a", "b"): 0.5, ("b", "c"): 0.0, ("c", "d"): 2.0}


def test_settled_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    """Files of a few bytes a row lie under Spark's threshold long after their rows, as a broadcast, fill the driver."""
    monkeypatch.setattr(iteration, "BROADCAST_ROWS", 1000)
    plan = lambda left, right: left.join(right, "id", "left")._jdf.queryExecution().executedPlan().toString()
    many, few = iteration.settle(spark.range(1001)), iteration.settle(spark.range(1000))
    assert "BroadcastHashJoin" not in plan(spark.range(10), many) and "BroadcastHashJoin" in plan(spark.range(10), few)
    assert "BroadcastHashJoin" not in plan(spark.range(10), iteration.union_of([few, few])) and "BroadcastHashJoin" in plan(spark.range(10), iteration.small(many))


def test_cycles_within_tasks_and_in_rounds_are_the_same(spark):
    """Genes of up to 16 edges take one task each, larger ones rounds; a long way that turns back at its end is one component."""
    edges = random_edges(5, 14, 24) | random_edges(6, 9, 12) | {(4, f"k{i:04}", f"k{(i + 1) % 3000:04}"): 1.0 for i in range(3000)} | {(3, "x", "x"): 1.0}
    rows = lambda df: sorted(map(tuple, df.select("gene", "node", "component").collect()))
    got = rows(wavefront.strong_components(table(spark, edges)))
    few = {k: w for k, w in edges.items() if k[0] != 4}
    assert [r for r in got if r[0] == 4] == [(4, f"k{i:04}", "k0000") for i in range(3000)] and (3, "x", "x") in got
    want = rows(wavefront.cycles_in_rounds(table(spark, few)))
    assert [r for r in got if r[0] != 4] == want == rows(wavefront.strong_components(table(spark, few), 16))


def test_cycles_of_small_genes_take_few_jobs(spark):
    """Rounds took some hundred jobs over all genes until the last one had no cycle left."""
    edges = {(g, f"n{i}", f"n{j}"): 1.0 for g in range(5) for i, j in ((0, 1), (1, 0), (1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (5, 4))}
    spark.sparkContext.setJobGroup("cycles", "cycles")
    got = wavefront.strong_components(table(spark, edges)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cycles"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 30 and {r.component for r in got} == {"n0", "n2", "n4"} and jobs < 20


def test_ego_cores_within_tasks_and_in_rounds_are_the_same(spark):
    """Few jobs where genes are small; rounds over all genes took some hundred, with their tables held by the driver."""
    edges = {(g, u, v): 1.0 + (ord(u[-1]) + ord(v[-1])) % 5 for g, u, v in random_edges(7, 16, 30) if u != v}
    starts = spark.createDataFrame(sorted({(g, n) for g, u, v in edges for n in (u, v)}), "gene int, start string")
    spark.sparkContext.setJobGroup("ego", "ego")
    got = sorted(map(tuple, wavefront.ego_core(table(spark, edges), starts, 3).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ego"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got and got == sorted(map(tuple, wavefront.ego_core(table(spark, edges), starts, 3, work=0).collect()))
    assert jobs < 20


def test_strands_are_told_apart_before_they_are_named(spark):
    """Links that repeat, null ends and null strands: the same rows as of names, but what is shuffled and hashed are ids."""
    rows = [(1, 2, True, 3, False), (1, 3, True, 2, False), (1, 2, True, 3, False), (2, None, True, 3, None), (2, None, False, 3, False), (None, 4, None, 5, True)]
    links = spark.createDataFrame(rows, "gene int, src long, src_fwd boolean, dst long, dst_fwd boolean")
    named = graph.strand_rows(links.fillna(False, ["src_fwd", "dst_fwd"])).distinct()
    got = graph.both_strands(links)
    assert sorted(map(str, got.collect())) == sorted(map(str, named.collect()))
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x]
    assert dealt and all("src_fwd" in x for x in dealt)
