"""Exact top-k search: tiled integer matrix products, partial selection per tile, tree merging of the per-query lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a block of queries, and of the vectors that it meets in one cell of the grid of blocks and shards.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 32 << 20
#: Vectors of a tile.
TILE = 1024
PACKED = "dim int, ids binary, v binary"


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, v array<double>); rows with a null id, a null or empty vector, or null or non-finite components take no part."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0)).where(fits)


def _pack(rows: int, width: int):
    """(id, v) -> PACKED: runs of vectors of one length, at most `rows` of them (if 0, of `width` bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, v, _ = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(v).tobytes()], pa.binary())], ["dim", "ids", "v"])

        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dim))
                ids, flat, most = np.asarray(own.column(0)), np.asarray(own.column(1).flatten()).reshape(-1, dim), rows or max(1, width // (8 * dim))
                at = 0
                while at < len(ids):
                    mine = held.setdefault(dim, [[], [], 0])
                    take = min(most - mine[2], len(ids) - at)
                    mine[0].append(ids[at : at + take])
                    mine[1].append(flat[at : at + take].ravel())
                    mine[2] += take
                    at += take
                    if mine[2] == most:
                        yield out(dim)
            if sum(8 * d * x[2] for d, x in held.items()) > 4 * max(width, BLOCK_BYTES):  # many lengths
                for dim in list(held):
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return pack


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the k highest scores, ties to smaller ids; scores of NONE sort last."""
    if scores.shape[1] > k:
        at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(scores, at, 1).min(axis=1)
        tied = (scores == edge[:, None]).sum(axis=1) > (np.take_along_axis(scores, at, 1) == edge[:, None]).sum(axis=1)
        for r in np.flatnonzero(tied):  # more rows have the edge score than fit
            at[r] = np.lexsort((ids[r], -scores[r]))[:k]
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


NONE = np.iinfo(np.int64).min + 1  # its negative fits too
#: Stands for any score below the range of a long.
LOW = NONE + 1


def quantize(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as whole floats; scale is a power of two, so beyond 2^53 nothing is rounded either."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers, of any size."""
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(np.floor(c * scale)) if abs(c) < 2.0**60 else int(c) * scale for c in x.ravel().tolist()]
    return out


def scores_of(a: np.ndarray, b: np.ndarray, skip: np.ndarray, scale: int) -> np.ndarray:
    """Exact integer products of all rows of a and b, NONE where skip is true, LOW below the range of a long; beyond it, an error.
    Floats where every partial sum fits their mantissa; rows too large for 64-bit sums go by Python's integers."""
    p, q, dim = quantize(a, scale), quantize(b, scale), a.shape[1]
    size_a, size_b = np.abs(p).max(axis=1), np.abs(q).max(axis=1)
    bound = dim * max(1.0, size_a.max(initial=0)) * max(1.0, size_b.max(initial=0))
    if bound < 2**24:
        out = (p.astype(np.float32) @ q.T.astype(np.float32)).astype(np.int64)
    elif bound < 2**53:
        out = (p @ q.T).astype(np.int64)
    else:
        safe = np.sqrt(2.0**62 / dim)
        small_a, small_b = size_a < safe, size_b < safe
        out = np.zeros((len(a), len(b)), np.int64)
        out[np.ix_(small_a, small_b)] = p[small_a].astype(np.int64) @ q[small_b].astype(np.int64).T
        for rows, cols in ((~small_a, np.ones(len(b), bool)), (small_a, ~small_b)):
            if rows.any() and cols.any():
                big = _whole(a[rows], scale) @ _whole(b[cols], scale).T
                big[skip[np.ix_(rows, cols)]] = NONE
                if (big > np.iinfo(np.int64).max).any():
                    raise OverflowError("exact top-k: an inner product is beyond the 64 bits of a score")
                out[np.ix_(rows, cols)] = np.where(big < LOW, LOW, big).astype(np.int64)
    out[skip] = NONE
    return out


def _searcher(k: int, scale: int):
    """Rows of cells (block, shard), each cell's block of queries (kind 0) before its tiles (kind 1) -> the k best of each cell."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None

        def best():
            keep = top_s > NONE
            row, _ = np.nonzero(keep)
            return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(top_i[keep]), pa.array(top_s[keep])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for block, shard, kind, dim, ids, v in zip(*(batch.column(i) for i in range(6)), strict=True):
                ids, v = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(v.as_py(), np.float64).reshape(-1, dim.as_py())
                if kind.as_py() == 0:
                    if cell is not None:
                        yield best()
                    cell, q_ids, q = (block.as_py(), shard.as_py()), ids, v
                    top_s, top_i = np.full((len(ids), k), NONE), np.full((len(ids), k), np.iinfo(np.int64).max)
                    continue
                if cell != (block.as_py(), shard.as_py()):
                    raise RuntimeError("exact top-k: tiles without their queries")
                for lo in range(0, len(q_ids), TILE):
                    hi = min(lo + TILE, len(q_ids))
                    scores = scores_of(q[lo:hi], v, q_ids[lo:hi, None] == ids[None, :], scale)
                    s, i = _best(scores, np.broadcast_to(ids, scores.shape), k)
                    s, i = np.concatenate((top_s[lo:hi], s), 1), np.concatenate((top_i[lo:hi], i), 1)
                    top_s[lo:hi], top_i[lo:hi] = _best(s, i, k)
        if cell is not None:
            yield best()

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 1, fan_in: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (id long, v array<double>) the k rows of vectors (id, v) of another id with the
    highest inner product of floor(scale * component), ties to the smaller id; fewer where there are fewer. scale is a power of two.
    Queries meet vectors of their own length.

    Queries are packed into blocks of at most BLOCK_BYTES, vectors into tiles and those into shards of about SHARD_BYTES; every block meets every
    shard in a cell of its own, so a task holds one block and one tile, and nothing passes through the driver. Each cell keeps k rows
    a query; lists merge in a tree, fan_in at a time. A query id that repeats counts once, by its first vector in order; a repeated
    vector row is a candidate each time. Finite components of any size take part; a score among a query's k that is
    beyond 64 bits is an error that says so. Empty inputs give no rows. Vectors must be finite.
    """
    rows = queries.groupBy("id").agg(F.min("v").alias("v"))
    blocks = rows.select(F.col("id").alias("i"), "v").mapInArrow(_pack(0, BLOCK_BYTES), PACKED)
    blocks = common.materialize(blocks.withColumn("block", F.xxhash64("dim", "ids")))
    tiles = common.materialize(vectors.select("id", "v").mapInArrow(_pack(TILE, 0), PACKED))
    held = tiles.agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()[0]
    shards = max(1, -(-held // SHARD_BYTES))
    meets = common.sized(blocks.select("dim", "block"), 24)
    cells = tiles.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int")).join(meets, "dim").select("block", "shard", F.lit(1).alias("kind"), "dim", "ids", "v")
    asked = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1)))).select("block", "shard", F.lit(0).alias("kind"), "dim", "ids", "v")
    dealt = asked.union(cells).repartition("block", "shard").sortWithinPartitions("block", "shard", "kind")
    found = dealt.mapInArrow(_searcher(k, scale), "query_id long, vec_id long, score long")
    by = [F.desc("score"), F.asc("vec_id")]
    few = found.withColumn("branch", F.spark_partition_id() % fan_in)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy(*by))).where(F.col("r") <= k)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)
    score = F.when(F.col("score") <= LOW, F.raise_error(F.lit("exact top-k: an inner product is beyond the 64 bits of a score"))).otherwise(F.col("score"))
    return out.select("query_id", "rank", "vec_id", score.cast("long").alias("score"))


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = finite(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5, scale=256)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
