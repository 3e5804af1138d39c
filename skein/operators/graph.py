"""Strand-aware segment graphs as edge tables. Links (gene, src, src_fwd, dst, dst_fwd) are read in both directions; edges are
(gene, u, v) with nodes id+ and id-."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.sequence import node_name, reverse_node, unitig_of

from .iteration import FEW, ahead, counted, discard, in_steps, narrow, roots, settle, small, union_of


def strand_rows(links: DataFrame) -> DataFrame:
    """(gene, u, v): each link and its twin on the other strand, as often as they come."""
    own = links.select("gene", node_name(F.col("src"), F.col("src_fwd")).alias("u"), node_name(F.col("dst"), F.col("dst_fwd")).alias("v"))
    return own.select("gene", F.inline(F.array(F.struct("u", "v"), F.struct(reverse_node(F.col("v")).alias("u"), reverse_node(F.col("u")).alias("v")))))


def strand_ids(links: DataFrame) -> DataFrame:
    """(gene, src, src_fwd, dst, dst_fwd): each link and its twin on the other strand, as often as they come."""
    at = lambda c: (F.col(c), F.when(F.col(c).isNotNull(), F.coalesce(f"{c}_fwd", F.lit(False))))
    (src, ahead_), (dst, on) = at("src"), at("dst")
    named = lambda *columns: F.struct(*[c.alias(n) for c, n in zip(columns, ("src", "src_fwd", "dst", "dst_fwd"), strict=True)])
    return links.select("gene", F.inline(F.array(named(src, ahead_, dst, on), named(dst, ~on, src, ~ahead_))))


def both_strands(links: DataFrame) -> DataFrame:
    """(gene, u, v): each link and its twin on the other strand, once. They are told apart by ids and strands, and named then, as names take more room in hash tables."""
    return strand_ids(links).distinct().select("gene", node_name(F.col("src"), F.col("src_fwd")).alias("u"), node_name(F.col("dst"), F.col("dst_fwd")).alias("v"))


def bigraph(links: DataFrame, unitigs: DataFrame, overlap: int) -> DataFrame:
    """(gene, u, v, weight, covweight): weight is the letters that u adds, plus all of v where v leads nowhere; covweight the same
    times the segments' summed coverage. unitigs: (gene, unitig, len, cov)."""
    edges = settle(both_strands(links))
    ends = edges.select("gene", F.col("v").alias("n")).distinct().join(edges.select("gene", F.col("u").alias("n")).distinct(), ["gene", "n"], "left_anti")
    seg = lambda s: unitigs.select("gene", F.col("unitig").cast("string").alias(f"{s}_id"), F.col("len").alias(f"{s}_len"), F.col("cov").alias(f"{s}_cov"))
    e = edges.withColumn("u_id", unitig_of(F.col("u"))).withColumn("v_id", unitig_of(F.col("v"))).join(seg("u"), ["gene", "u_id"]).join(seg("v"), ["gene", "v_id"])
    e = e.join(ends.withColumnRenamed("n", "v").withColumn("end", F.lit(True)), ["gene", "v"], "left")
    extra = lambda c: F.when(F.col("end"), c).otherwise(F.lit(0.0))
    return e.select(
        "gene", "u", "v", ((F.col("u_len") - overlap) + extra(F.col("v_len"))).cast("double").alias("weight"),
        (F.col("u_cov") * (F.col("u_len") - overlap) + extra(F.col("v_cov") * F.col("v_len"))).cast("double").alias("covweight"),
    )


def tips(links: DataFrame, unitigs: DataFrame) -> DataFrame:
    """(gene, unitig, isolated, tip, leaves_forward): a tip's links all leave from one end, or it has none."""
    out = links.select("gene", F.col("src").alias("unitig"), F.col("src_fwd").alias("fwd"))
    into = links.select("gene", F.col("dst").alias("unitig"), (~F.col("dst_fwd")).alias("fwd"))
    sides = out.union(into).groupBy("gene", "unitig").agg(F.min("fwd").alias("lo"), F.max("fwd").alias("hi"))
    s = unitigs.select("gene", "unitig").join(sides, ["gene", "unitig"], "left")
    return s.select("gene", "unitig", F.col("lo").isNull().alias("isolated"), (F.col("lo").isNull() | (F.col("lo") == F.col("hi"))).alias("tip"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("leaves_forward"))


#: Hops that go into one job where they are known to stay few rows.
CHAIN = 16


def hops(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = ("gene",), limit: int = 1 << 30) -> DataFrame:
    """keys + (node, hops): for each combination of keys, the gene among them, all nodes that its starts (keys, node) lead to within `limit` edges, with the least number of edges.
    Only the last nodes reached go on. Where the largest number of edges from a node, or the number of all, bounds what a few hops can reach, these hops are one job without a shuffle; otherwise each hop is a
    job of its own. What is new is told from what was reached before once a job."""
    table, all_ = counted(edges.select("gene", "u", "v").where("u is not null and v is not null").distinct(), n=F.count("*"))
    near = small(table)
    widest = table.groupBy("gene", "u").count().agg(F.max("count")).first()[0] or 0
    front, got = counted(starts.select(*keys, "node").distinct().withColumn("hops", F.lit(0)), n=F.count("*"))
    most = got["n"] + all_["n"] * (1 if keys == ("gene",) else got["n"])  # rows that can be reached at all
    seen, hop, n = [front], 0, got["n"]
    named = ", ".join(keys)
    step = f"""SELECT {named}, node, min(hops) AS hops FROM (
        SELECT {", ".join(f"r.{k}" for k in keys)}, inline(if(n.v IS NULL, array(named_struct('n', r.node, 'h', r.hops)), array(named_struct('n', r.node, 'h', r.hops), named_struct('n', n.v, 'h', r.hops + 1)))) AS (node, hops)
        FROM {{rows}} r LEFT JOIN {{near}} n ON n.gene = r.gene AND n.u = r.node AND r.hops = {{i}}) GROUP BY {named}, node"""
    while n and hop < limit:
        steps = CHAIN
        while steps > 1 and min(most, n * widest**steps) > FEW:
            steps //= 2
        steps = min(steps, limit - hop)
        bound = min(most, n * widest**steps)
        reached = in_steps(narrow(front.select(*keys, "node", F.lit(0).alias("hops")), bound), step, steps, near=near)
        new = reached.where("hops > 0").withColumn("hops", F.col("hops") + hop)
        for before in seen:
            new = new.join(narrow(before.select(*keys, "node"), bound), [*keys, "node"], "left_anti")
        hop += steps
        table, got = counted(new, n=F.count_if(F.col("hops") == hop))
        front, n = table.where(F.col("hops") == hop), got["n"]
        seen.append(table)
        if len(seen) > 8:
            before = seen
            seen = [settle(union_of(before))]
            front = seen[0].where(F.col("hops") == hop)
            discard(*before)
    return union_of(seen)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(gene, node, hops): all nodes that the starts (gene, node) lead to, with the least number of edges."""
    return hops(edges, starts)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("gene", F.col("v").alias("u"), F.col("u").alias("v"))


def core(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(gene, node): nodes that a source leads to and that lead to a sink."""
    return reachable(edges, sources).select("gene", "node").intersect(reachable(reversed_edges(edges), sinks).select("gene", "node"))


def components(edges: DataFrame) -> DataFrame:
    """(gene, node, component): weakly connected parts, each named by its smallest node. Nodes get 64-bit ids and move to their least neighbours, round by round; edges may
    repeat. Edges that lack gene or end are none. Ids that two nodes share are found, and others taken."""
    e = settle(edges.select("gene", "u", "v").where("gene is not null and u is not null and v is not null"))
    seed = 0
    while (out := _components(e, seed)) is None:
        seed += 1
    return out


def _node_id(node: str, seed: int) -> Column:
    return F.xxhash64("gene", node, F.lit(seed))


def _components(e: DataFrame, seed: int) -> DataFrame | None:
    """components, or None if two nodes have the same id."""
    e = e.withColumn("a", _node_id("u", seed)).withColumn("b", _node_id("v", seed))
    up = F.col("a") >= F.col("b")
    e = e.select("gene", F.when(up, F.col("u")).otherwise(F.col("v")).alias("top"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("low"), F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tops = settle(e.groupBy("gene", F.col("top").alias("node"), F.col("a").alias("id")).agg(F.min("b").alias("to")))
    step = settle(ahead(tops.where("id <> to").select("id", "to")))
    follow = step.select(F.col("id").alias("to"), F.col("to").alias("up"))
    tops = settle(tops.join(follow, "to", "left").select("gene", "node", "id", F.coalesce("up", "to").alias("to")))

    # The lower ends are looked up by name, so one that is never the upper end shows.
    pairs = e.join(tops.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").select("gene", "low", "b", "x")
    pairs = pairs.join(tops.select(F.col("id").alias("b"), "gene", F.col("node").alias("low"), F.col("to").alias("y")), ["b", "gene", "low"], "left")
    least = F.col("y").isNull()
    pairs = settle(pairs.select(F.when(least, F.col("gene")).alias("gene"), F.when(least, F.col("low")).alias("node"), "x", F.coalesce("y", "b").alias("y"), F.col("b").alias("id")).where("x <> y or node is not null"))
    nodes = settle(tops.union(pairs.where("node is not null").select("gene", "node", "id", F.col("id").alias("to")).distinct()))
    if not nodes.groupBy("id").count().where("count > 1").isEmpty():
        return None
    named = small(roots(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    label = settle(nodes.join(named.select(F.col("id").alias("to"), "root"), "to", "left").select("gene", "node", F.coalesce("root", "to").alias("root")))
    names = settle(label.groupBy("root").agg(F.min("node").alias("component")))
    return label.join(small(names), "root").select("gene", "node", "component")


def rooted(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Edges with a virtual source+ before all sources and a sink+ behind all sinks, without components that lack either."""
    more = sources.select("gene", F.lit("source+").alias("u"), F.col("node").alias("v")).union(sinks.select("gene", F.col("node").alias("u"), F.lit("sink+").alias("v")))
    every = edges.select("gene", "u", "v").union(more)
    label = components(every)
    named = label.where("node in ('source+', 'sink+')").groupBy("gene", "component").agg(F.countDistinct("node").alias("n")).where("n = 2")
    return every.join(label.withColumnRenamed("node", "u"), ["gene", "u"]).join(named.select("gene", "component"), ["gene", "component"]).select("gene", "u", "v")


def lowest_common_descendant(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(gene, node, total): of the nodes that every start of a gene leads to, the one of least summed hops, ties to the smaller name."""
    own = settle(starts.select("gene", "node").distinct())
    pairs = hops(edges, own.select("gene", F.col("node").alias("start"), "node"), ("gene", "start"))
    need = own.groupBy("gene").agg(F.count("*").alias("need"))
    sums = pairs.groupBy("gene", "node").agg(F.count("*").alias("n"), F.sum("hops").alias("total")).join(need, "gene").where("n = need")
    w = Window.partitionBy("gene").orderBy("total", "node")
    return sums.withColumn("r", F.row_number().over(w)).where("r = 1").select("gene", "node", F.col("total").cast("long").alias("total"))


def split_nodes(edges: DataFrame) -> DataFrame:
    """(gene, u, v, through): nodes of several in-edges get an entry node x + 's', so that one edge carries all that passes each node;
    through names the node whose flow the edge is."""
    into = edges.groupBy("gene", "v").agg(F.count("*").alias("n"))
    e = edges.join(into, ["gene", "v"])
    moved = e.select("gene", "u", F.when(F.col("n") > 1, F.concat("v", F.lit("s"))).otherwise(F.col("v")).alias("v"), F.when((F.col("n") == 1) & (F.col("v") != "sink+"), F.col("v")).alias("through"))
    entry = into.where("n > 1").select("gene", F.concat("v", F.lit("s")).alias("u"), "v", F.when(F.col("v") != "sink+", F.col("v")).alias("through"))
    return moved.union(entry)


def residual(flows: DataFrame) -> DataFrame:
    """(gene, u, v, capacity, cost) of (gene, u, v, flow, capacity, cost): what still fits ahead, and what can be taken back at the
    negative cost."""
    ahead = flows.select("gene", "u", "v", (F.col("capacity") - F.col("flow")).alias("capacity"), "cost")
    back = flows.where("flow > 0").select("gene", F.col("v").alias("u"), F.col("u").alias("v"), F.col("flow").alias("capacity"), (-F.col("cost")).alias("cost"))
    return ahead.union(back)


def path_edges(paths: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (u, v): consecutive nodes of paths (keys, pos, node)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return paths.withColumn("v", F.lead("node").over(w)).where("v is not null").select(*keys, F.col("node").alias("u"), "v")


def path_weights(edges: DataFrame, paths: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """keys + total: the weights of the edges along each path."""
    return path_edges(paths, keys).join(edges, ["u", "v"]).groupBy(*keys).agg(F.sum(weight).alias("total"))


def read_weights(edges: DataFrame, paths: DataFrame, read: str) -> DataFrame:
    """edges (u, v, weight) with readweight: the edge's weight once for each read whose path uses it."""
    used = path_edges(paths, [read]).groupBy("u", "v").agg(F.count("*").alias("n"))
    return edges.join(used, ["u", "v"], "left").withColumn("readweight", F.coalesce(F.col("weight") * F.col("n"), F.lit(0.0))).drop("n")


def add_path_flow(flows: DataFrame, paths: DataFrame, keys: list[str], amount: float) -> DataFrame:
    """flows (u, v, flow) plus `amount` for each path's step, no flow below zero."""
    used = path_edges(paths, keys).groupBy("u", "v").agg((F.count("*") * F.lit(amount)).alias("more"))
    return flows.join(used, ["u", "v"], "left").withColumn("flow", F.greatest(F.col("flow") + F.coalesce("more", F.lit(0.0)), F.lit(0.0))).drop("more")


def with_neighbours(edges: DataFrame, nodes: DataFrame, labelled: DataFrame) -> DataFrame:
    """(gene, node): the nodes plus all direct neighbours of those that aren't labelled."""
    plain = nodes.join(labelled, ["gene", "node"], "left_anti")
    ahead = edges.join(plain.withColumnRenamed("node", "u"), ["gene", "u"]).select("gene", F.col("v").alias("node"))
    back = edges.join(plain.withColumnRenamed("node", "v"), ["gene", "v"]).select("gene", F.col("u").alias("node"))
    return nodes.select("gene", "node").union(ahead).union(back).distinct()


def propagate_bins(edges: DataFrame, bins: DataFrame, lengths: DataFrame, levels: int = 20) -> DataFrame:
    """(unitig, bin, votes): each segment without a bin takes the bin of most summed length, ties to the smaller bin, among the nodes that its two strands lead to within `levels` edges; what
    both strands lead to counts for each. So a walk that enters a segment at one end leaves it at the other. edges: (u, v) between nodes id+ and id-; bins: (unitig, bin); lengths: (unitig, len)."""
    named = lambda df: df.withColumn("unitig", F.col("unitig").cast("string"))
    kind = lengths.schema["unitig"].dataType
    bins, lengths = named(bins), named(lengths)
    open_ = lengths.join(bins, "unitig", "left_anti").select(F.explode(F.array(F.concat("unitig", F.lit("+")), F.concat("unitig", F.lit("-")))).alias("start"))
    one = F.lit(0).alias("gene")
    seen = hops(edges.select(one, "u", "v"), open_.select(one, "start", F.col("start").alias("node")), ("gene", "start"), levels)
    reached = seen.select(unitig_of(F.col("start")).alias("open"), unitig_of(F.col("node")).alias("unitig"))
    votes = reached.join(bins, "unitig").join(lengths, "unitig").groupBy(F.col("open").alias("unitig"), "bin").agg(F.sum("len").alias("votes"))
    w = Window.partitionBy("unitig").orderBy(F.desc("votes"), "bin")
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("unitig").cast(kind).alias("unitig"), "bin", "votes")


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes (gene, node)."""
    at = lambda c: nodes.select("gene", F.col("node").alias(c)).distinct()
    return edges.join(at("u"), ["gene", "u"], "left_semi").join(at("v"), ["gene", "v"], "left_semi")


def strands(edges: DataFrame, unitigs: DataFrame) -> DataFrame:
    """(gene, node): which of id+ and id- of the segments (gene, unitig) the graph holds."""
    held = edges.select("gene", F.col("u").alias("node")).union(edges.select("gene", F.col("v").alias("node"))).distinct()
    return held.withColumn("unitig", unitig_of(F.col("node"))).join(unitigs.select("gene", F.col("unitig").cast("string").alias("unitig")), ["gene", "unitig"], "left_semi").select("gene", "node")


def common_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gene, role, node): the nearest common descendant of the nodes (gene, node) as sink and their nearest common ancestor as source."""
    sink = lowest_common_descendant(edges, nodes).select("gene", F.lit("sink").alias("role"), "node")
    return sink.union(lowest_common_descendant(reversed_edges(edges), nodes).select("gene", F.lit("source").alias("role"), "node"))


def chained(edges: DataFrame, order: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(u, v) of all genes in one graph: behind each gene's sinks a connector, from there to the sources of the next. order: (gene, place), places
    from 0 without gaps; sources and sinks: (gene, node). Nodes of a gene are told apart by 'gene/'."""
    name = lambda c: F.concat_ws("/", F.col("gene").cast("string"), c)
    connector = lambda c: F.concat(F.lit("connect_"), c.cast("string"), F.lit("+"))
    own = edges.join(order.select("gene"), "gene", "left_semi").select(name(F.col("u")).alias("u"), name(F.col("v")).alias("v"))
    most = order.agg((F.max("place") - 1).alias("most"))
    out = sinks.join(order, "gene").join(F.broadcast(most)).where("place <= most").select(name(F.col("node")).alias("u"), connector(F.col("place")).alias("v"))
    into = sources.join(order, "gene").where("place > 0").select(connector(F.col("place") - 1).alias("u"), name(F.col("node")).alias("v"))
    return own.union(out).union(into).distinct()


def flow_costs(through: DataFrame, slopes: DataFrame, scale: float = 1e5, least: float = 1e-9) -> DataFrame:
    """Edges (gene, u, v, through) with cost: the slope (gene, node, slope) of the node whose flow they are, over the gene's largest, as
    whole numbers up to scale; 0 for other edges."""
    top = slopes.groupBy("gene").agg(F.greatest(F.max(F.abs("slope")), F.lit(least)).alias("top"))
    cost = slopes.join(top, "gene").select("gene", F.col("node").alias("through"), (F.col("slope") * F.lit(scale) / F.col("top")).cast("long").alias("cost"))
    return through.join(cost, ["gene", "through"], "left").withColumn("cost", F.coalesce("cost", F.lit(0).cast("long"))).select("gene", "u", "v", "through", "cost")


def unscaled_cost(cost: Column, top: Column, scale: float = 1e5, unit: float = 1e6) -> Column:
    """What a summed cost of whole numbers is in slopes and flows."""
    return cost * top / F.lit(scale) / F.lit(unit)


def with_shunt(flows: DataFrame, capacity: float) -> DataFrame:
    """Edges (gene, u, v, flow, capacity, cost) with one from sink+ back to source+ in each gene, which makes every flow a circulation."""
    back = flows.select("gene").distinct().select("gene", F.lit("sink+").alias("u"), F.lit("source+").alias("v"), F.lit(0.0).alias("flow"), F.lit(capacity).alias("capacity"), F.lit(0.0).alias("cost"))
    return without_shunt(flows).unionByName(back)


def without_shunt(flows: DataFrame) -> DataFrame:
    return flows.where("not (u = 'sink+' and v = 'source+')")


def throughput(flows: DataFrame) -> DataFrame:
    """(gene, node, phi): the flow of the edge that carries all of a node's; flows: (gene, u, v, through, flow)."""
    return flows.where("through is not null").groupBy("gene", F.col("through").alias("node")).agg(F.sum("flow").alias("phi"))


def loss_change(flows: DataFrame, move: DataFrame, targets: DataFrame, step: float, poisson: bool = False, penalty: float = 0.0) -> DataFrame:
    """(gene, change): how the loss of the targets (gene, node, x, len) changes if the flow (gene, u, v, through, flow) moves by step times (gene,
    u, v, move), negative where flow is taken back; squared loss, or x against a Poisson rate; penalty for each unit of throughput."""
    moved = flows.join(move, ["gene", "u", "v"], "left").where("through is not null").groupBy("gene", F.col("through").alias("node"))
    moved = moved.agg(F.sum("flow").alias("old"), F.sum(F.greatest(F.col("flow") + F.lit(step) * F.coalesce("move", F.lit(0.0)), F.lit(0.0))).alias("new"))
    t = targets.join(moved, ["gene", "node"])
    was, now, x = F.col("len") * F.col("old"), F.col("len") * F.col("new"), F.col("x")
    floor = lambda r: F.greatest(r, F.lit(1e-12))
    change = (now - was) - x * F.ln(floor(now) / floor(was)) if poisson else 0.5 * ((x - now) ** 2 - (x - was) ** 2)
    return t.groupBy("gene").agg(F.sum(change + F.lit(penalty) * (F.col("new") - F.col("old"))).alias("change"))
