"""Graph algorithms as rounds over edge tables, for graphs of any size: bounded distances by buckets, heaviest paths by topological wavefronts, cycles by colouring,
chains and unary walks by pointer doubling. A row is a node (of a gene, start or sample); nothing is gathered in one task or on the driver, and each
round is a table in the shared folder."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .graph import CHAIN, components, hops, reversed_edges
from .iteration import BROADCAST_ROWS, FEW, counted, dealt, discard, in_steps, narrow, settle, small, union_of


def _either(when: Column, own: Column, there: Column) -> Column:
    """own, and where `when` holds there as well, as rows."""
    return F.inline(F.when(when, F.array(own, there)).otherwise(F.array(own)))


def _each_gene(solve: Callable[[list[tuple]], Iterable[tuple]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (gene, u, v, ...) in the order of genes: the gene with each row that `solve` makes of the gene's other columns; what it makes are nodes, as u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gene, own, rows, types = None, [], [], None

        def made() -> pa.RecordBatch:
            out, columns = pa.RecordBatch.from_arrays, zip(zip(*rows, strict=True), types, strict=True)
            return out([pa.array(c, t) for c, t in columns], names)

        for batch in batches:
            types = types or [batch.column(0).type] + [batch.column(1).type] * (len(names) - 1)
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != gene and own:
                    rows += [(gene, *x) for x in solve(own)]
                    own = []
                gene = g
                own.append(tuple(row))
            if len(rows) > 10_000:
                yield made()
                rows.clear()
        if own:
            rows += [(gene, *x) for x in solve(own)]
        if rows:
            yield made()

    return run


# ---- bounded distances ----


def ego_graphs(edges: DataFrame, starts: DataFrame, radius: float) -> DataFrame:
    """(gene, start, node, distance, on_rim): around each start (gene, start) the nodes within `radius`, by summed weights of edges (gene, u, v, weight), and
    on the rim those that an edge leads to from there; distances are over paths whose nodes but the last lie within. Weights are not negative.

    All starts of all genes share the rounds. A round takes only the nodes within that the last one reached or brought nearer; the rim, most of the rows, is made once at the
    end. Edges are dealt by their first node once, so rounds shuffle what moves, not the edges."""
    own = edges.where("gene is not null and u is not null and v is not null").select("gene", F.col("u").alias("node"), "v", F.col("weight").cast("double").alias("weight"))
    table = dealt(own, ["gene", "node"], lambda rows: rows.groupBy("gene", "node", "v").agg(F.min("weight").alias("weight")))
    near = small(table)
    widest = table.groupBy("gene", "node").count().agg(F.max("count")).first()[0] or 0
    keys, far = ["gene", "start", "node"], F.col("distance") + F.col("weight")

    def led(rows: DataFrame) -> DataFrame:
        """Where edges lead to from nodes within the radius."""
        return rows.where(F.col("distance") <= radius).join(near, ["gene", "node"]).select("gene", "start", F.col("v").alias("node"), far.alias("distance"))

    front, got = counted(starts.select("gene", "start", F.col("start").alias("node")).distinct().withColumn("distance", F.lit(0.0)), n=F.count("*"))
    found, rows = [front], got["n"]
    while got["n"]:
        bound = rows + got["n"] * widest
        met, all_ = counted(led(narrow(front, bound)).where(F.col("distance") <= radius).groupBy(*keys).agg(F.min("distance").alias("distance")), n=F.count("*"))
        before = union_of(found)
        if bound > FEW and all_["n"] <= BROADCAST_ROWS:
            before = before.join(F.broadcast(met.select(*keys)), keys, "left_semi")
        was = narrow(before, bound).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("distance").alias("had"))
        same = [F.col(k) == F.col(f"{k}_") for k in keys]
        front, got = counted(narrow(met, bound).join(was, [*same, F.col("had") <= F.col("distance")], "left_anti"), n=F.count("*"))
        discard(met)
        found.append(front)
        rows += got["n"]
        if len(found) > 8:
            older = found[:-1]
            found = [settle(union_of(older)), front]
            discard(*older)
    within = narrow(union_of(found), rows * (1 + widest))
    rim = led(within).where(~F.coalesce(F.col("distance") <= radius, F.lit(False)))
    out = settle(within.union(rim).groupBy(*keys).agg(F.min("distance").alias("distance")).withColumn("on_rim", F.col("distance") > radius))
    discard(table, *found)
    return out


#: A gene's edges times its edges and starts up to which one task does it.
EGO_WORK = 1 << 22


def _ball(near: dict, start, radius: float) -> dict:
    """Distances from start to the nodes within the radius, and to those that an edge leads to from there."""
    best, waits, done = {start: 0.0}, [(0.0, start)], set()
    while waits:
        far, node = heapq.heappop(waits)
        if node in done or far > radius:
            continue
        done.add(node)
        for v, w in near.get(node, ()):
            if far + w < best.get(v, float("inf")):
                best[v] = far + w
                heapq.heappush(waits, (far + w, v))
    return best


def _between(rows: list[tuple], radius: float) -> Iterator[tuple]:
    """(start, node) of one gene's core: rows are edges (u, v, weight) and, with v null, starts."""
    starts, ahead, behind = [], defaultdict(list), defaultdict(list)
    for u, v, w in rows:
        if v is None:
            starts.append(u)
        else:
            ahead[u].append((v, w))
            behind[v].append((u, w))
    reach: dict = {}
    for start in starts:
        sides = []
        for own, other in ((ahead, behind), (behind, ahead)):
            ball = _ball(own, start, radius)
            past = [n for n, far in ball.items() if far > radius]
            seen = set(past)
            for node in past:
                for v, _ in own.get(node, ()) if len(own.get(node, ())) != 1 else ():
                    if v not in seen:
                        seen.add(v)
                        past.append(v)
            side: set = set()
            for node in past:
                if len(own.get(node, ())) == 1 and ball.get(node, radius + 1) > radius:
                    key = (own is ahead, node)
                    if key not in reach:
                        reach[key] = set(_ball(other, node, radius))
                    side |= reach[key]
            sides.append(side)
        yield from ((start, node) for node in sides[0] & sides[1])


def ego_core(edges: DataFrame, starts: DataFrame, radius: float, work: int | None = None) -> DataFrame:
    """(gene, start, node): what lies between the far ends of each start's surroundings. Ahead and behind of it walks go on within the radius and, past it, through nodes that have not exactly one next
    node; they end at the first node past it that has one. The core is what lies (within the radius or on the rim) back from an end ahead and also on from an end behind.

    Genes of few edges and starts (EGO_WORK) are dealt over the tasks, each whole; larger ones take rounds over all their edges."""
    e = settle(edges.where("gene is not null and u is not null and v is not null").groupBy("gene", "u", "v").agg(F.min("weight").cast("double").alias("weight")))
    s = settle(starts.select("gene", "start").where("gene is not null and start is not null").distinct())
    rows = e.select("gene", "u", "v", "weight").union(s.select("gene", "start", F.lit(None).cast(e.schema["v"].dataType), F.lit(None).cast("double")))
    sizes = rows.groupBy("gene").agg(F.count("v").alias("edges"), F.count("*").alias("all"))
    large, got = counted(sizes.where(F.col("edges") * F.col("all") > (EGO_WORK if work is None else work)).select("gene"), n=F.count("*"))
    schema = StructType([StructField("gene", e.schema["gene"].dataType), StructField("start", e.schema["u"].dataType), StructField("node", e.schema["u"].dataType)])
    each = rows.join(large, "gene", "left_anti") if got["n"] else rows
    whole = each.repartition("gene").sortWithinPartitions("gene").mapInArrow(_each_gene(partial(_between, radius=radius), ["gene", "start", "node"]), schema)
    return whole.union(ego_core_in_rounds(*(t.join(large, "gene", "left_semi") for t in (e, s)), radius)) if got["n"] else whole


def ego_core_in_rounds(e: DataFrame, starts: DataFrame, radius: float) -> DataFrame:
    """ego_core of genes of any size; e: distinct edges (gene, u, v, weight)."""
    e = settle(e)
    back = e.select("gene", F.col("v").alias("u"), F.col("u").alias("v"), "weight")
    keys, sides = ["gene", "start", "node"], []
    for ahead, behind in ((e, back), (back, e)):
        fan = ahead.groupBy("gene", F.col("u").alias("node")).agg(F.count("*").alias("fan"))
        ball = settle(ego_graphs(ahead, starts, radius))
        wide = ahead.join(fan.where("fan <> 1").select("gene", F.col("node").alias("u")), ["gene", "u"], "left_semi")
        past = hops(wide, ball.where("on_rim").select(*keys), ("gene", "start")).join(ball.where("not on_rim").select(*keys), keys, "left_anti")
        ends = settle(past.join(fan.where("fan = 1"), ["gene", "node"], "left_semi").select("gene", "start", F.col("node").alias("end")))
        reach = ego_graphs(behind, ends.select("gene", F.col("end").alias("start")).distinct(), radius).select("gene", F.col("start").alias("end"), "node")
        sides.append(ends.join(reach, ["gene", "end"]).select(*keys))
    return sides[0].intersect(sides[1])


# ---- heaviest paths ----


def jumps(pointers: DataFrame, keys: list[str], most: int) -> list[DataFrame]:
    """Tables keys + (id, to) of 1, 2, 4 ... pointers in a row, as far as up to `most` steps need; ids without a pointer are left out."""
    first, got = counted(pointers.select(*keys, "id", "to"), n=F.count("*"))
    out = [first]
    while 1 << len(out) <= most:
        rows = narrow(out[-1], got["n"])
        ahead = rows.select(*keys, F.col("id").alias("to"), F.col("to").alias("up"))
        table, got = counted(rows.join(ahead, [*keys, "to"]).select(*keys, "id", F.col("up").alias("to")), n=F.count("*"))
        if not got["n"]:
            break
        out.append(table)
    return out


def trails(starts: DataFrame, steps: list[DataFrame], keys: list[str], name: str) -> DataFrame:
    """starts + (id, back): each start (keys, name), which has the id `name`, and all ids behind it along the pointers, with their distance: halves of the way are added, from the longest jump to the least."""
    own, n = starts.withColumns({"id": F.col(name), "back": F.lit(0)}), 1 << 60
    for k in reversed(range(len(steps))):
        met = narrow(own, 2 * n).join(narrow(steps[k], 2 * n), [*keys, "id"], "left")
        own, got = counted(met.select(*starts.columns, _either(F.col("to").isNotNull(), F.struct("id", "back"), F.struct(F.col("to").alias("id"), (F.col("back") + (1 << k)).alias("back")))), n=F.count("*"))
        n = got["n"]
    return own


def wavefront(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(gene, node, sample, value, pred): for each node and sample the highest sum of values along a path that ends in the node, and the node before it on that path (null where it begins; ties to the smaller
    name). Paths begin anywhere, sums before that are not above 0 don't count. edges: (gene, u, v) without cycles, or it is an error; values: (gene, node, sample, value), a row for each node and sample.

    A node is ready when all edges into it have brought their sums; ready nodes send theirs on. Nodes that have sent leave the table. While few wait, several levels are one job."""
    e = settle(edges.select("gene", "u", "v").where("u is not null and v is not null").distinct())
    into = e.groupBy("gene", F.col("v").alias("node")).agg(F.count("*").alias("need"))
    own, every = counted(values.join(into, ["gene", "node"], "left").select("gene", "node", "sample", "value", F.coalesce("need", F.lit(0)).alias("need")), n=F.count("*"), most=F.max("need"))
    all_rows = every["n"] * (1 + (every["most"] or 0))  # what one step can make of all rows
    out = small(settle(e.join(into.withColumnRenamed("node", "v"), ["gene", "v"]).select("gene", F.col("u").alias("node"), "v", "need")))
    # A state row: how many edges have brought something (got of need), the least of (-sum, node) that they brought, whether it has sent. Ready rows meet their edges; a row that meets several comes again with each,
    # so what it had got is kept by the largest.
    first = own.where("need = 0").selectExpr("gene", "node", "sample", "cast(need AS long) AS need", "0L AS got", "cast(NULL AS struct<cost: double, pred: string>) AS best", "false AS sent")
    step = """SELECT gene, node, sample, max(need) AS need, max(had) + sum(got) AS got, min(best) AS best, max(sent) AS sent FROM (
        SELECT gene, sample, if(to_self, had, 0L) AS had, node, need, got, best, sent FROM (
        SELECT r.gene, r.sample, r.got AS had, inline(if(e.v IS NULL, array(named_struct('s', true, 'n', r.node, 'm', r.need, 'g', 0L, 'b', r.best, 't', r.sent OR r.got = r.need)), array(named_struct('s', true, 'n', r.node, 'm', r.need, 'g', 0L, 'b', r.best, 't', true),
          named_struct('s', false, 'n', e.v, 'm', cast(e.need AS long), 'g', 1L, 'b', if(coalesce(-r.best.cost, 0D) + w.value > 0, named_struct('cost', -(coalesce(-r.best.cost, 0D) + w.value), 'pred', r.node), NULL), 't', false)))) AS (to_self, node, need, got, best, sent)
        FROM {rows} r LEFT JOIN {edges} e ON e.gene = r.gene AND e.node = r.node AND NOT r.sent AND r.got = r.need LEFT JOIN {worth} w ON w.gene = r.gene AND w.node = r.node AND w.sample = r.sample)) GROUP BY gene, node, sample"""
    worth = own.select("gene", "node", "sample", "value")
    state, got = counted(first, n=F.count("*"), ready=F.count("*"))
    done = []
    while got["n"]:
        if not got["ready"]:
            raise ValueError("the graph has a cycle")
        rows = in_steps(narrow(state, all_rows), step, CHAIN // 2 if all_rows <= FEW else 1, edges=out, worth=narrow(worth, all_rows))
        waits = ~F.col("sent")
        table, got = counted(rows, n=F.count_if(waits), ready=F.count_if(waits & (F.col("got") == F.col("need"))))
        done.append(table.where("sent"))
        state = table.where(waits)
    if not done:
        return own.select("gene", "node", "sample", "value", F.lit(None).cast("string").alias("pred")).limit(0)
    every = done[0]
    for t in done[1:]:
        every = every.union(t)
    return every.join(worth, ["gene", "node", "sample"]).select("gene", "node", "sample", (F.coalesce(-F.col("best.cost"), F.lit(0.0)) + F.col("value")).alias("value"), F.col("best.pred").alias("pred"))


def sample_paths(edges: DataFrame, coverage: DataFrame, lengths: DataFrame | None = None, overlap: int = 0) -> DataFrame:
    """(gene, part, sample, path, value): the path of most covered letters in each connected part for each sample, and for all samples together (sample null); ties go to the smaller
    last node and from there back to the smaller node before. No row where all counts are 0. edges: (gene, u, v) without cycles; coverage: (gene, node, sample, cov), 0 where
    a pair is missing; lengths: (gene, node, len), each node counts len - overlap letters, or len if it leads nowhere; without them, one letter a node."""
    e = settle(edges.select("gene", "u", "v").where("u is not null and v is not null").distinct())
    ends = e.select("gene", F.col("u").alias("node"), F.lit(1).alias("leads")).union(e.select("gene", "v", F.lit(0)))
    nodes = ends.groupBy("gene", "node").agg(F.max("leads").alias("leads"))
    if lengths is None:
        nodes = nodes.withColumn("letters", F.lit(1.0))
    else:
        nodes = nodes.join(lengths, ["gene", "node"]).withColumn("letters", (F.col("len") - F.when(F.col("leads") == 1, F.lit(overlap)).otherwise(F.lit(0))).cast("double"))
    nodes = settle(nodes.select("gene", "node", "letters"))
    cov = coverage.groupBy("gene", "node", "sample").agg(F.sum("cov").cast("double").alias("cov"))
    every = settle(cov.join(nodes, ["gene", "node"], "left_semi").union(cov.join(nodes, ["gene", "node"], "left_semi").groupBy("gene", "node").agg(F.lit(None).cast(cov.schema["sample"].dataType).alias("sample"), F.sum("cov").alias("cov"))))
    samples = every.select("gene", F.col("sample").alias("of"), F.coalesce(F.col("sample").cast("string"), F.lit("all ")).alias("sample")).distinct()
    dense = nodes.join(samples, "gene")  # a gene's nodes each with its samples
    named = every.select("gene", "node", F.coalesce(F.col("sample").cast("string"), F.lit("all ")).alias("sample"), "cov")
    values = dense.join(named, ["gene", "node", "sample"], "left").select("gene", "node", "sample", (F.coalesce("cov", F.lit(0.0)) * F.col("letters")).alias("value"))
    paths = settle(wavefront(e, values))
    part = components(e).withColumnRenamed("component", "part")
    top = paths.where("value > 0").join(part, ["gene", "node"]).groupBy("gene", "part", "sample").agg(F.min(F.struct((-F.col("value")).alias("cost"), "node")).alias("x"))
    top = settle(top.select("gene", "part", "sample", F.col("x.node").alias("last"), (-F.col("x.cost")).alias("value")))
    keys = ["gene", "sample"]
    steps = jumps(paths.where("pred is not null").select(*keys, F.col("node").alias("id"), F.col("pred").alias("to")), keys, 1 << 60)
    on = trails(top, steps, keys, "last")
    out = on.groupBy("gene", "part", "sample", "value").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "id"))).alias("x"))
    return out.join(samples, ["gene", "sample"]).select("gene", "part", F.col("of").alias("sample"), F.col("x.id").alias("path"), "value")


# ---- cycles ----


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (gene, u, v, ...) that remain when nodes without edges in or without edges out go, again and again; settled."""
    left, got = counted(edges, n=F.count("*"))
    while got["n"]:
        before, rows = left, narrow(left, got["n"])
        for _ in range(2):
            rows = rows.join(rows.select("gene", F.col("v").alias("u")).distinct(), ["gene", "u"], "left_semi")
            rows = rows.join(rows.select("gene", F.col("u").alias("v")).distinct(), ["gene", "v"], "left_semi")
        n = got["n"]
        left, got = counted(rows.select(*edges.columns), n=F.count("*"))
        discard(before)
        if got["n"] == n:
            break
    return left


#: Edges of a gene up to which one task finds its cycles.
ALONE = 1 << 16


def _cycles(edges: list[tuple]) -> Iterator[tuple]:
    """(node, component) of the nodes on cycles: depth-first order of leaving ahead, then what leads back (Kosaraju)."""
    out, back = defaultdict(list), defaultdict(list)
    for u, v in edges:
        out[u].append(v)
        back[v].append(u)
    seen, left = set(), []
    for root in out:
        if root in seen:
            continue
        seen.add(root)
        way = [(root, iter(out[root]))]
        while way:
            node, rest = way[-1]
            for v in rest:
                if v not in seen:
                    seen.add(v)
                    way.append((v, iter(out.get(v, ()))))
                    break
            else:
                left.append(node)
                way.pop()
    for root in reversed(left):
        if root not in seen:
            continue
        seen.discard(root)
        part = [root]
        for node in part:
            for u in back.get(node, ()):
                if u in seen:
                    seen.discard(u)
                    part.append(u)
        if len(part) > 1 or root in out.get(root, ()):
            least = min(part)
            yield from ((node, least) for node in part)


def strong_components(edges: DataFrame, alone: int | None = None) -> DataFrame:
    """(gene, node, component): nodes that lie on cycles of edges (gene, u, v), with the least node of those that lead to them and back. Other nodes have no row.

    Genes of up to `alone` edges (ALONE) are dealt over the tasks, each whole; larger ones take rounds over all their edges."""
    e = settle(edges.select("gene", "u", "v").where("gene is not null and u is not null and v is not null").distinct())
    large, got = counted(e.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") > (ALONE if alone is None else alone)).select("gene"), n=F.count("*"))
    schema = StructType([StructField("gene", e.schema["gene"].dataType), StructField("node", e.schema["u"].dataType), StructField("component", e.schema["u"].dataType)])
    each = e.join(large, "gene", "left_anti") if got["n"] else e
    whole = each.repartition("gene").sortWithinPartitions("gene").mapInArrow(_each_gene(_cycles, ["gene", "node", "component"]), schema)
    return whole.union(cycles_in_rounds(e.join(large, "gene", "left_semi"))) if got["n"] else whole


def cycles_in_rounds(edges: DataFrame) -> DataFrame:
    """strong_components of genes of any size.

    Nodes that can be on no cycle are trimmed; each of the rest takes the least name among those that lead to it; what leads back to that node inside its colour is a component.
    Components are taken out, edges between colours as well, and the rest goes on."""
    e = edges.select("gene", "u", "v").where("u is not null and v is not null").distinct()
    found = [settle(e.where("u = v").select("gene", F.col("u").alias("node"), F.col("u").alias("component")))]
    rest = trimmed(e.where("u <> v"))
    paint = """SELECT gene, node, min(colour) AS colour, max(was) AS was FROM (
        SELECT r.gene, inline(if(n.v IS NULL, array(named_struct('n', r.node, 'c', r.colour, 'w', r.was)), array(named_struct('n', r.node, 'c', r.colour, 'w', r.was), named_struct('n', n.v, 'c', r.colour, 'w', cast(NULL AS string))))) AS (node, colour, was)
        FROM {rows} r LEFT JOIN {near} n ON n.gene = r.gene AND n.u = r.node) GROUP BY gene, node"""
    while not rest.isEmpty():
        near, many = small(rest), 2 * rest.count()  # each step makes a row for each edge, and one for each node
        colour, moved = settle(rest.select("gene", F.col("u").alias("node"), F.col("u").alias("colour")).distinct()), 1
        while moved:
            rows = in_steps(narrow(colour, many).select("gene", "node", "colour", F.col("colour").alias("was")), paint, CHAIN // 2 if many <= FEW else 1, near=near)
            before, (colour, got) = colour, counted(rows, n=F.count_if(F.col("colour") != F.col("was")))
            discard(before)
            moved = got["n"]
        c = colour.select("gene", "node", "colour")
        own = rest.join(c.withColumnsRenamed({"node": "u", "colour": "cu"}), ["gene", "u"]).join(c.withColumnsRenamed({"node": "v", "colour": "cv"}), ["gene", "v"])
        same = settle(own.where("cu = cv").select("gene", "u", "v", F.col("cu").alias("colour")))
        roots = same.select("gene", F.col("colour").alias("node")).distinct()
        back = hops(reversed_edges(same), roots.join(same.select("gene", F.col("v").alias("node")).distinct(), ["gene", "node"], "left_semi"))
        part = settle(back.join(c, ["gene", "node"]).select("gene", "node", F.col("colour").alias("component")))
        found.append(part)
        gone = part.select("gene", "node")
        rest = trimmed(same.select("gene", "u", "v").join(gone.withColumnRenamed("node", "u"), ["gene", "u"], "left_anti").join(gone.withColumnRenamed("node", "v"), ["gene", "v"], "left_anti"))
    out = found[0]
    for t in found[1:]:
        out = out.union(t)
    return settle(out.groupBy("gene", "node").agg(F.min("component").alias("component")))


def acyclic(edges: DataFrame) -> DataFrame:
    """(gene, u, v, weight): edges left when no cycle is. In each round every node on a cycle points along its lightest edge that may be on one; the cycles that these
    pointers close, no two of which share a node, lose their lightest edge, ties to the smaller names. Loops go at once. Pointers are followed by doubling, so rounds of any length of cycle take few jobs."""
    e = edges.where("u is not null and v is not null").groupBy("gene", "u", "v").agg(F.min("weight").alias("weight"))
    left = settle(e.where("u <> v"))
    core = trimmed(left)
    gone: list[DataFrame] = []
    while not core.isEmpty():
        lightest = core.groupBy("gene", F.col("u").alias("id")).agg(F.min(F.struct("weight", "u", "v")).alias("edge"))
        at, got = counted(lightest.select("gene", "id", F.col("edge.v").alias("to"), "edge"), n=F.count("*"))
        nodes = core.groupBy("gene").agg(F.countDistinct("u").alias("n")).agg(F.max("n")).first()[0]
        for _ in range(max(1, int(nodes - 1).bit_length())):
            at = narrow(at, got["n"])
            up = at.select("gene", F.col("id").alias("to"), F.col("to").alias("up"), F.col("edge").alias("next"))
            at = settle(at.join(up, ["gene", "to"]).select("gene", "id", F.col("up").alias("to"), F.least("edge", "next").alias("edge")))
        on = narrow(at, got["n"]).select("gene", F.col("to").alias("id")).distinct()  # after so many steps every node is on a cycle
        cut = settle(narrow(at, got["n"]).join(on, ["gene", "id"], "left_semi").select("gene", "edge.u", "edge.v").distinct())
        gone.append(cut)
        core = trimmed(core.join(cut, ["gene", "u", "v"], "left_anti"))
    for cut in gone:
        left = left.join(cut, ["gene", "u", "v"], "left_anti")
    return left


# ---- chains ----


def ranked_chains(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (id, head, nth): the place of each id in its chain, from 1, and the chain's first id. links: keys + (id, to), `to` the next id or null; no two ids have the same next one. A chain that
    closes begins at its least id. List ranking by doubling: who comes 1, 2, 4 ... places before."""
    ids = links.select(*keys, "id", "to")
    prev = ids.where("to is not null").select(*keys, F.col("to").alias("id"), F.col("id").alias("up"))
    # up: the id so many places before; far: places; low: the least id on the way and its places
    state, got = counted(ids.select(*keys, "id").join(prev, [*keys, "id"], "left").select(*keys, "id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("far"), F.struct(F.col("id").alias("id"), F.lit(0).cast("long").alias("far")).alias("low")), n=F.count("*"), left=F.count_if(F.col("up").isNotNull()))
    n, rounds = got["n"], 0
    head = F.lit(None).cast(links.schema["id"].dataType)
    state = state.withColumn("head", F.when(F.col("up").isNull(), F.col("id")).otherwise(head))
    waiting = got["left"]
    while waiting and rounds <= int(n).bit_length():
        rounds += 1
        state = narrow(state, n)
        there = state.select(*keys, F.col("id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("low").alias("low2"), F.col("head").alias("head2"))
        met = state.join(there, [*keys, "up"], "left")
        goes = F.col("head").isNull()
        moved = F.struct(F.col("low2.id").alias("id"), (F.col("low2.far") + F.col("far")).alias("far"))
        step = met.select(
            *keys, "id", F.when(goes, F.col("up2")).otherwise(F.col("up")).alias("up"), F.when(goes, F.col("far") + F.col("far2")).otherwise(F.col("far")).alias("far"),
            F.when(goes, F.least("low", moved)).otherwise(F.col("low")).alias("low"), F.when(goes, F.col("head2")).otherwise(F.col("head")).alias("head"),
        )
        before = state
        state, got = counted(step, left=F.count_if(F.col("head").isNull()))
        discard(before)
        waiting = got["left"]
    # Those without a head are on closed chains; they have seen all of theirs.
    return state.select(*keys, "id", F.coalesce("head", "low.id").alias("head"), (F.when(F.col("head").isNull(), F.col("low.far")).otherwise(F.col("far")) + 1).alias("nth"))


def bubble_chains(bubbles: DataFrame) -> DataFrame:
    """(gene, chain, nth, source, sink): superbubbles (gene, source, sink) one behind the other, where the sink of one is the source of the next; a chain is named by its first source. On the
    reversed graph the same chains run from their last sink to their first source, so both directions are covered."""
    b = settle(bubbles.select("gene", "source", "sink").distinct())
    links = b.join(b.select("gene", F.col("source").alias("sink"), F.lit(True).alias("goes")), ["gene", "sink"], "left").select("gene", F.col("source").alias("id"), F.when(F.col("goes"), F.col("sink")).alias("to"))
    ranks = ranked_chains(links, ["gene"])
    return ranks.join(b.withColumnRenamed("source", "id"), ["gene", "id"]).select("gene", F.col("head").alias("chain"), F.col("nth").cast("int").alias("nth"), F.col("id").alias("source"), "sink")


def extended_paths(edges: DataFrame, ends: DataFrame, lengths: DataFrame, overlap: int, ahead: bool = True) -> DataFrame:
    """(gene, path, node, pos, added): ends of paths (gene, path, node, pos), pos a place in the node's segment, carried on to the next node as long as the place lies past len - overlap (ahead) or before the overlap
    (ahead false: against the edges), and only one node follows. Every step ahead takes len - overlap letters off the place, back it adds those of the node entered; added: names of the nodes entered, in order.
    lengths: (gene, node, len), every len above the overlap.

    Walks of any length take a logarithmic number of joins: for 1, 2, 4 ... steps along single neighbours a table has where they lead and the letters that they take, and each end takes the longest jumps
    that its place allows, from the longest to the least."""
    e = edges.select("gene", "u", "v").where("u is not null and v is not null").distinct()
    e = e if ahead else reversed_edges(e)
    single = e.groupBy("gene", "u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").select("gene", F.col("u").alias("node"), F.col("v").alias("to"))
    # Ahead, a step from x asks for a place past len(x) - overlap = cost(x) and takes cost(x); so n steps ask for one past the sum of their costs. Back, a step from x asks
    # for a place before the overlap and adds cost of the node entered; that node is left only if place + cost < overlap, so n steps ask for the sum but the last cost.
    of = settle(lengths.select("gene", "node", (F.col("len") - overlap).cast("long").alias("cost")))
    step = single.join(of, ["gene", "node"]) if ahead else single.join(of.withColumnRenamed("node", "to"), ["gene", "to"])
    # ask: what a place must exceed (ahead), or the most it may be to stay below the overlap (back: place + ask < overlap); take: what it loses or gains
    table, got = counted(step.select("gene", "node", "to", (F.col("cost") if ahead else F.lit(0).cast("long")).alias("ask"), F.col("cost").alias("take")), n=F.count("*"))
    tables = [table]
    most = settle(ends.select("pos").agg(F.max("pos").alias("most"))).first()["most"] if ahead else overlap
    while got["n"] and most is not None:
        last = narrow(tables[-1], got["n"])
        second = last.select("gene", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("ask").alias("ask2"), F.col("take").alias("take2"))
        twice = last.join(second, ["gene", "to"]).select("gene", "node", F.col("to2").alias("to"), (F.col("take") + F.col("ask2")).alias("ask"), (F.col("take") + F.col("take2")).alias("take"))
        table, got = counted(twice.where(F.col("ask") < int(most)), n=F.count("*"))  # nobody goes further than the largest place
        if got["n"]:
            tables.append(table)
    rows = settle(ends.select("gene", "path", "node", F.col("pos").cast("long").alias("pos")).withColumns({"last": F.col("node"), "at": F.lit(0)}))
    for k in reversed(range(len(tables))):
        jump = tables[k].select("gene", F.col("node").alias("last"), "to", "ask", "take")
        fits = (F.col("pos") > F.col("ask")) if ahead else (F.col("pos") + F.col("ask") < overlap)
        met = rows.join(jump, ["gene", "last"], "left").withColumn("goes", F.coalesce(F.col("to").isNotNull() & fits, F.lit(False)))
        moved = F.col("pos") - F.col("take") if ahead else F.col("pos") + F.col("take")
        rows = settle(met.select("gene", "path", "node", F.when(F.col("goes"), moved).otherwise(F.col("pos")).alias("pos"), F.when(F.col("goes"), F.col("to")).otherwise(F.col("last")).alias("last"), (F.col("at") + F.when(F.col("goes"), F.lit(1 << k)).otherwise(F.lit(0))).alias("at")))
    # The nodes on the way: from the first one, all that the jumps reach within `at` steps.
    way = rows.where("at > 0").select("gene", "path", "at", F.col("node").alias("id"), F.lit(0).alias("back"))
    for k in reversed(range(len(tables))):
        met = way.join(tables[k].select("gene", F.col("node").alias("id"), "to"), ["gene", "id"], "left")
        way = met.select("gene", "path", "at", _either(F.col("to").isNotNull() & (F.col("back") + (1 << k) <= F.col("at")), F.struct("id", "back"), F.struct(F.col("to").alias("id"), (F.col("back") + (1 << k)).alias("back"))))
    names = way.where("back > 0").groupBy("gene", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("back", "id"))), lambda x: x["id"]).alias("added"))
    return rows.join(names, ["gene", "path"], "left").select("gene", "path", F.col("last").alias("node"), "pos", F.coalesce("added", F.array().cast("array<string>")).alias("added"))
