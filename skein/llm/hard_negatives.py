"""Hard-negative mining by dual-tree search: ball trees over anchors and candidates; bounds of the inner products of two nodes drop whole groups of anchors and candidates
at once, and pairs of leaves that remain are scored exactly.

The candidates' tree has the order of the range partitions at its top (length, label, signs of projections), then tiles, then a binary tree in each
tile; that of the anchors has blocks in place of tiles. Blocks and tiles meet where neither labels nor bounds rule it out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, topk

#: Rows of a leaf; most rows of a tile and of a block, and most bytes of their vectors; bytes of the tiles that a block meets in one cell of the grid.
LEAF, TILE, BLOCK, NODE_BYTES, SHARD_BYTES = 64, 1024, 4096, 2 << 20, 8 << 20
#: Projections whose signs make a row's code.
SIGNS = 12
NONE = topk.NONE
NODE = "dim int, lo long, hi long, center array<double>, radius double, most double, least double, ids binary, labels binary, v binary, wants binary, tree binary, balls binary"


# ---- trees ----


def grow(q: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order of the rows, tree (start, end, left, right, lowest label, highest label) of each node, children -1 at leaves, and balls (centre, radius).
    Nodes of several labels are halved by label, others across the two rows far apart."""
    order, tree, balls, todo = np.arange(len(q)), [], [], [(0, len(q), -1, 0)]
    with np.errstate(all="ignore"):
        while todo:
            s, e, parent, side = todo.pop()
            own = order[s:e]
            x, y = q[own], labels[own]
            center = x.mean(axis=0)
            away = np.sqrt(((x - center) ** 2).sum(axis=1))
            me = len(tree)
            if parent >= 0:
                tree[parent][2 + side] = me
            tree.append([s, e, -1, -1, int(y.min()), int(y.max())])
            balls.append(np.append(center, away.max()))
            if e - s > leaf:
                if tree[me][4] < tree[me][5]:
                    at = np.argsort(y, kind="stable")
                else:
                    a = int(np.argmax(np.nan_to_num(away)))
                    b = int(np.argmax(np.nan_to_num(((x - x[a]) ** 2).sum(axis=1))))
                    at = np.argsort(np.nan_to_num(x @ (x[b] - x[a])), kind="stable")
                order[s:e] = own[at]
                mid = (s + e) // 2
                todo += [(mid, e, me, 1), (s, mid, me, 0)]
    return order, np.array(tree, np.int64).reshape(-1, 6), np.array(balls).reshape(len(tree), -1)


class Node:
    """A block or a tile, with its tree: rows in the tree's order."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, v: bytes, tree: bytes, balls: bytes, wants: bytes = b""):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.v, self.tree = np.frombuffer(v, np.float64).reshape(-1, dim), np.frombuffer(tree, np.int64).reshape(-1, 6)
        balls_ = np.frombuffer(balls, np.float64).reshape(-1, dim + 1)
        self.center, self.radius = balls_[:, :-1], balls_[:, -1]
        with np.errstate(all="ignore"):
            self.far = np.sqrt((self.center**2).sum(axis=1))
        self.wants = np.frombuffer(wants, np.int64).reshape(len(self.ids), -1)

    def per_node(self, rows: np.ndarray, f) -> np.ndarray:
        return np.array([f(rows[s:e]) for s, e in self.tree[:, :2].tolist()])


def bounds(a: Node, c: Node, ia: np.ndarray, ic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between these lie the inner products of all rows of nodes ia of a with those of nodes ic of c; no bound where numbers are too large."""
    with np.errstate(all="ignore"):
        dot = np.einsum("ij,ij->i", a.center[ia], c.center[ic])
        slack = a.far[ia] * c.radius[ic] + a.radius[ia] * c.far[ic] + a.radius[ia] * c.radius[ic]
        slack = slack + 1 + 1e-9 * (np.abs(dot) + a.far[ia] * c.far[ic] + slack)
        lo, hi = dot - slack, dot + slack
    return np.where(np.isfinite(lo), lo, -np.inf), np.where(np.isfinite(hi), hi, np.inf)


def leaf_pairs(a: Node, c: Node, alive) -> list[tuple[float, int, int]]:
    """(upper bound, leaf of a, leaf of c), highest first, of the pairs that alive(nodes of a, nodes of c, lo, hi) leaves on the way down both trees."""
    ia, ic = np.zeros(1, np.int64), np.zeros(1, np.int64)
    out: list[tuple[float, int, int]] = []
    while len(ia):
        lo, hi = bounds(a, c, ia, ic)
        keep = alive(ia, ic, lo, hi)
        ia, ic, hi = ia[keep], ic[keep], hi[keep]
        leaf_a, leaf_c = a.tree[ia, 2] < 0, c.tree[ic, 2] < 0
        done = leaf_a & leaf_c
        out += zip(hi[done].tolist(), ia[done].tolist(), ic[done].tolist(), strict=True)
        ia, ic, leaf_a, leaf_c = ia[~done], ic[~done], leaf_a[~done], leaf_c[~done]
        down = ~leaf_a & (leaf_c | (a.radius[ia] >= c.radius[ic]))  # the wider of two inner nodes is opened
        left = [np.where(down, a.tree[ia, 2 + side], ia) for side in (0, 1)]
        right = [np.where(down, ic, c.tree[ic, 2 + side]) for side in (0, 1)]
        ia, ic = np.concatenate(left), np.concatenate(right)
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


def _coded(seed: int = 5):
    """(id, label, v, more) -> (dim, label, code, h, id, v, more): code has the signs of SIGNS fixed projections, h is a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2).value_lengths()).astype(np.int32)
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x = np.asarray(own.column(2).flatten()).reshape(-1, dim)
                with np.errstate(all="ignore"):
                    side = np.nan_to_num(x @ np.random.default_rng([seed, dim]).standard_normal((dim, SIGNS))) > 0
                code = pa.array((side @ (1 << np.arange(SIGNS)[::-1])).astype(np.int32))
                h = pa.array(common.mix(np.asarray(own.column(0)).view(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int32)), own.column(1), code, h, own.column(0), own.column(2), own.column(3)], ["dim", "label", "code", "h", "id", "v", "wants"])

    return run


def _packer(most: int, scale: int, low: int):
    """Rows (dim, label, code, h, id, v, wants) in this order -> NODE rows; low: per cent of a positive's score that counts."""

    def node(rows: pa.Table) -> pa.RecordBatch:
        dim, label, id_, v, wants = (rows.column(c).combine_chunks() for c in ("dim", "label", "id", "v", "wants"))
        d = dim[0].as_py()
        x, y, ids = np.asarray(v.flatten()).reshape(-1, d), np.asarray(label), np.asarray(id_)
        order, tree, balls = grow(topk.quantize(x, scale), y)
        w = np.asarray(wants.flatten()).astype(np.int64).reshape(len(ids), -1)[order]
        floor = lower(w, low)[w >= 0]
        top = w[w >= 0]
        own = [ids[order], y[order], x[order], w, tree, balls]
        ball = pa.ListArray.from_arrays(pa.array([0, d], pa.int32()), pa.array(balls[0, :-1]))
        numbers = [pa.array([d], pa.int32()), pa.array([tree[0, 4]]), pa.array([tree[0, 5]]), ball, *[pa.array([float(n)]) for n in (balls[0, -1], top.max() if len(top) else -1, floor.min() if len(top) else 0)]]
        return pa.RecordBatch.from_arrays([*numbers, *[pa.array([o.tobytes()], pa.binary()) for o in own]], [f.split()[0] for f in NODE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = d = 0
        for batch in batches:
            dims = np.asarray(batch.column(0))
            at = 0
            while at < len(dims):
                if held and dims[at] != d:
                    yield node(pa.Table.from_batches(held))
                    held, n = [], 0
                d = int(dims[at])
                room = max(1, min(most, NODE_BYTES // (8 * d))) - n
                same = np.flatnonzero(dims[at : at + room] != d)
                take = min(room, len(dims) - at, int(same[0]) if len(same) else room)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if take == room:
                    yield node(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield node(pa.Table.from_batches(held))

    return run


def forest(rows: DataFrame, most: int, scale: int, low: int) -> DataFrame:
    """Rows (id, label, v, wants) as nodes of at most `most` rows each, materialized, with a number of their own. Copies are told apart by their ids' hashes, so no
    label and no group of copies must go to one task."""
    by = ["dim", "label", "code", "h", "id"]
    coded = rows.select("id", "label", "v", "wants").mapInArrow(_coded(), "dim int, label long, code int, h long, id long, v array<double>, wants array<long>")
    sorted_ = common.materialize(coded).repartitionByRange(*by).sortWithinPartitions(*by)
    return common.materialize(sorted_.mapInArrow(common.tidy(_packer(most, scale, low)), NODE).withColumn("node", F.xxhash64("ids", "labels", F.monotonically_increasing_id())))


# ---- searches ----


def lower(score: np.ndarray, per_cent: int) -> np.ndarray:
    """The least whole number s with 100 s >= per_cent * score, for scores from 0 on, without running over."""
    whole, rest = score // 100, score % 100
    return whole * per_cent - (-(rest * per_cent) // 100)


class Positives:
    """The k best rows of the same label, another id."""

    def __init__(self, a: Node, k: int, scale: int):
        self.a, self.k, self.scale = a, k, scale
        self.s, self.i = np.full((len(a.ids), k), NONE), np.full((len(a.ids), k), topk.LOW)

    def meet(self, c: Node) -> int:
        a, t = self.a, self.a.tree
        worst = a.per_node(self.s[:, -1], np.min).astype(float)
        alive = lambda ia, ic, lo, hi: (hi >= worst[ia]) & (t[ia, 4] <= c.tree[ic, 5]) & (c.tree[ic, 4] <= t[ia, 5])
        scored = 0
        for hi, x, y in leaf_pairs(a, c, alive):
            (s, e), (p, q) = t[x, :2], c.tree[y, :2]
            if hi < self.s[s:e, -1].min():
                continue
            skip = (a.labels[s:e, None] != c.labels[None, p:q]) | (a.ids[s:e, None] == c.ids[None, p:q])
            score = topk.scores_of(a.v[s:e], c.v[p:q], skip, self.scale)
            new_s, new_i = topk._best(score, np.broadcast_to(c.ids[p:q], score.shape), self.k)
            self.s[s:e], self.i[s:e] = topk._best(np.concatenate((self.s[s:e], new_s), 1), np.concatenate((self.i[s:e], new_i), 1), self.k)
            scored += score.size
        return scored

    def rows(self) -> tuple[np.ndarray, ...]:
        row, col = np.nonzero(self.s > NONE)
        return self.a.ids[row], np.zeros(len(row), np.int64), self.i[row, col], self.s[row, col]


class Negatives:
    """For each wanted score of an anchor, the k best rows of another label from `low` per cent of that score up to it."""

    def __init__(self, a: Node, k: int, scale: int, low: int):
        self.a, self.k, self.scale = a, k, scale
        self.open = a.wants >= 0
        self.top = np.where(self.open, a.wants, NONE)
        self.low = np.where(self.open, lower(np.maximum(a.wants, 0), low), np.iinfo(np.int64).max)
        self.s, self.i = np.full((*a.wants.shape, k), NONE), np.full((*a.wants.shape, k), topk.LOW)
        self.most, self.least = a.per_node(self.top, np.max).astype(float), a.per_node(self.low, np.min).astype(float)

    def _worst(self, s: int, e: int) -> float:
        """What a row must reach to change any list of these anchors."""
        return float(np.where(self.open[s:e], np.maximum(self.s[s:e, :, -1], self.low[s:e]), np.iinfo(np.int64).max).min())

    def meet(self, c: Node) -> int:
        a, t = self.a, self.a.tree
        worst = np.array([self._worst(s, e) for s, e in t[:, :2].tolist()])
        one = lambda ia, ic: (t[ia, 4] == t[ia, 5]) & (c.tree[ic, 4] == c.tree[ic, 5]) & (t[ia, 4] == c.tree[ic, 4])
        alive = lambda ia, ic, lo, hi: (hi >= worst[ia]) & (lo <= self.most[ia]) & ~one(ia, ic)
        scored = 0
        for hi, x, y in leaf_pairs(a, c, alive):
            (s, e), (p, q) = t[x, :2], c.tree[y, :2]
            if hi < self._worst(s, e):
                continue
            skip = a.labels[s:e, None] == c.labels[None, p:q]
            score = topk.scores_of(a.v[s:e], c.v[p:q], skip, self.scale)
            scored += score.size
            for j in range(a.wants.shape[1]):
                fits = (score <= self.top[s:e, j, None]) & (score >= self.low[s:e, j, None])
                if fits.any():
                    new_s, new_i = topk._best(np.where(fits, score, NONE), np.broadcast_to(c.ids[p:q], score.shape), self.k)
                    self.s[s:e, j], self.i[s:e, j] = topk._best(np.concatenate((self.s[s:e, j], new_s), 1), np.concatenate((self.i[s:e, j], new_i), 1), self.k)
        return scored

    def rows(self) -> tuple[np.ndarray, ...]:
        row, nth, col = np.nonzero(self.s > NONE)
        return self.a.ids[row], nth.astype(np.int64), self.i[row, nth, col], self.s[row, nth, col]


FOUND = "anchor_id long, nth long, vec_id long, score long"


def _meeting(search):
    """Rows of cells (block, shard), each cell's block (kind 0) before its tiles (kind 1), likeliest first -> FOUND of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = state = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in state.rows()], [f.split()[0] for f in FOUND.split(", ")])

        for batch in batches:
            for block, shard, kind, dim, ids, labels, v, wants, tree, balls in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                node = Node(dim, ids, labels, v, tree, balls, wants)
                if kind == 0:
                    if state is not None:
                        yield out()
                    cell, state = (block, shard), search(node)
                elif cell != (block, shard):
                    raise RuntimeError("hard negatives: tiles without their anchors")
                else:
                    state.meet(node)
        if state is not None:
            yield out()

    return run


def _met(blocks: DataFrame, tiles: DataFrame, apart: Column, search, k: int, fan_in: int = 16) -> DataFrame:
    """(anchor_id, nth, r, vec_id, score): the k best for each anchor and nth of what `search` finds where blocks meet tiles, but for pairs that `apart` tells of
    (a_lo, a_hi, a_most, a_least against c_lo, c_hi, down, up, the bounds of their products)."""
    ball = ["node", "dim", "lo", "hi", "center", "radius"]
    side = lambda x, df, *more: df.select("dim", *[F.col(c).alias(f"{x}_{c}") for c in [*ball, *more] if c != "dim"])
    far = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("a_center", "c_center", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    slack = F.col("a_far") * F.col("c_radius") + F.col("a_radius") * F.col("c_far") + F.col("a_radius") * F.col("c_radius")
    pairs = side("c", tiles).withColumn("c_far", far("c_center")).join(common.sized(side("a", blocks, "most", "least").withColumn("a_far", far("a_center")), 4096), "dim")
    pairs = pairs.select("*", dot.alias("dot"), slack.alias("slack"))
    wide = F.col("slack") + 1 + 1e-9 * (F.abs("dot") + F.col("a_far") * F.col("c_far") + F.col("slack"))
    pairs = pairs.withColumns({"down": F.col("dot") - wide, "up": F.col("dot") + wide}).where(~F.coalesce(apart, F.lit(False)))
    held = tiles.agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()[0]
    shards = int(max(1, -(-held // SHARD_BYTES)))
    pairs = common.materialize(pairs.select(F.col("a_node").alias("block"), F.col("c_node").alias("node"), F.pmod(F.xxhash64("c_node"), F.lit(shards)).cast("int").alias("shard"), F.coalesce("up", F.lit(float("inf"))).alias("up")))
    body = ["dim", "ids", "labels", "v", "wants", "tree", "balls"]
    cells = tiles.select("node", *body).join(common.sized(pairs, 40), "node").select("block", "shard", F.lit(1).alias("kind"), *body, "up")
    asked = pairs.select("block", "shard").distinct().join(blocks.select(F.col("node").alias("block"), *body), "block").select("block", "shard", F.lit(0).alias("kind"), *body, F.lit(0.0).alias("up"))
    dealt = asked.union(cells).repartition("block", "shard").sortWithinPartitions("block", "shard", "kind", F.desc("up"))
    found = dealt.drop("up").mapInArrow(common.tidy(_meeting(search)), FOUND)
    by = [F.desc("score"), F.asc("vec_id")]
    few = found.withColumn("branch", F.spark_partition_id() % fan_in)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("anchor_id", "nth", "branch").orderBy(*by))).where(F.col("r") <= k)
    out = few.withColumn("r", F.row_number().over(Window.partitionBy("anchor_id", "nth").orderBy(*by))).where(F.col("r") <= k)
    return out.select("anchor_id", "nth", "r", "vec_id", "score")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 1) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each anchor's `positives` best rows of its label and another id, and for each the
    `negatives` best rows of other labels whose scores are from `low` per cent of the positive's up to it. A score is the inner product of
    floor(scale * component), scale a power of two; ties go to the smaller id. Fewer where there are fewer; a positive score below 0 has no such rows.

    rows, anchors: (id long, label long, v array<double>), none null, vectors finite and not empty. Vectors meet those of their length. An id that
    repeats among the anchors counts once, by its first label and vector in order; a repeated row is a candidate each time. Empty tables give
    no rows. A score beyond 64 bits is an error that says so. Trees only save work: bounds that are not finite drop nothing.
    """
    none = F.array().cast("array<long>")
    asked = common.materialize(anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))
    tiles = forest(rows.select("id", "label", "v", none.alias("wants")), TILE, scale, low)
    blocks = forest(asked.select("*", none.alias("wants")), BLOCK, scale, low)
    others = (F.col("a_lo") > F.col("c_hi")) | (F.col("c_lo") > F.col("a_hi"))
    found = common.materialize(_met(blocks, tiles, others, lambda a: Positives(a, positives, scale), positives).drop("nth"))
    good = found.where("score >= 0")
    wanted = good.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("r", "score"))).alias("x"))
    fill = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.when(i < F.size("x"), F.get("x", i)["score"]).otherwise(F.lit(-1)).cast("long"))
    blocks = forest(asked.join(wanted.select(F.col("anchor_id").alias("id"), "x"), "id").select("id", "label", "v", fill.alias("wants")), BLOCK, scale, low)
    same = (F.col("a_lo") == F.col("a_hi")) & (F.col("c_lo") == F.col("c_hi")) & (F.col("a_lo") == F.col("c_lo"))
    hard = _met(blocks, tiles, same | (F.col("up") < F.col("a_least")) | (F.col("down") > F.col("a_most")), lambda a: Negatives(a, negatives, scale, low), negatives)
    own = good.select("anchor_id", (F.col("r") - 1).cast("long").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.withColumnsRenamed({"r": "rank", "vec_id": "negative_id", "score": "negative_score"}).join(own, ["anchor_id", "nth"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v): rows with a null id or label, a null or empty vector, or null or non-finite components take no part."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    return out.where("id is not null and label is not null and size(v) > 0").where(fits)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = labelled(common.table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where(F.col("id") % 100 == 0), scale=256)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS DOUBLE[]) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
