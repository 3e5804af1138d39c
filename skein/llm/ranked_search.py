"""Ranked lexical search: document-at-a-time merges of compressed postings, shard by shard, with a bounded heap of results, merged over all shards.

Weights are integers: a term's is floor(1000 * ln((2N + 2) / (2 df + 1))), a document's share of it (10^9 tf) div (1000 tf + 8 m) with m its length
against the mean, 10 + 90 n N div L."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Postings and documents at which a shard is closed, and bytes of a block of items.
POSTINGS, DOCS, BLOCK_BYTES = 1 << 20, 1 << 17, 4 << 20
#: Bytes of distinct terms up to which an index can be limited to them.
TERM_BYTES = 16 << 20
#: Stands for a null id, behind all others.
LAST = np.iinfo(np.int64).max
SHARD = "n_docs long, n_terms long, ids binary, sizes binary, terms array<long>, dfs array<long>, postings array<binary>"


# ---- compressed postings ----


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers of any size, seven bits a byte and the eighth where more follow; and the bounds of each number in them."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= np.uint64(1 << (7 * k))
    bounds = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(bounds[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[bounds[:-1][has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out, bounds


def unpacked(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(data < 128)[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), start)


def postings_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the documents in their shard, rising, and how often the term is in each."""
    both = unpacked(np.frombuffer(data, np.uint8))
    return np.cumsum(both[::2]) - 1, both[1::2]


# ---- the index ----


def _indexer(wanted: np.ndarray | None):
    """(doc_id long, text binary) -> SHARD rows, each with the postings of the documents of a run of this task's rows; wanted: sorted terms, or all."""

    def shard(n_docs: int, n_terms: int, ids: list, sizes: list, found: list) -> pa.RecordBatch:
        ids_, sizes_ = np.concatenate(ids), np.concatenate(sizes)
        term, doc, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        held = np.zeros(len(ids_), bool)
        held[doc] = True
        order = np.lexsort((np.arange(len(ids_)), ids_))
        order = order[held[order]]
        place = np.zeros(len(ids_), np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((place[doc], term))
        term, at, tf = term[by], place[doc[by]], tf[by]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        gap = np.diff(at, prepend=-1)
        gap[first] = at[first] + 1
        data, bounds = packed(np.column_stack((gap, tf)).ravel())
        cut = np.append(bounds[2 * first], bounds[-1]).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cut), pa.py_buffer(data)])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), values)
        columns = [pa.array([n_docs]), pa.array([n_terms]), pa.array([ids_[order].tobytes()], pa.binary()), pa.array([sizes_[order].tobytes()], pa.binary())]
        dfs = np.diff(np.append(first, len(term))).astype(np.int64)
        return pa.RecordBatch.from_arrays([*columns, one(pa.array(term[first].view(np.int64))), one(pa.array(dfs)), one(lists)], ["n_docs", "n_terms", "ids", "sizes", "terms", "dfs", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = n_post = seen = 0
        ids: list = []
        sizes: list = []
        found: list = []
        for batch in batches:
            own = np.asarray(batch.column(0).fill_null(LAST))
            for i, j, texts in common.chunked(batch.column(1)):
                words, bounds = common.word_hashes(texts)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(j - i), n)
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, words), max(0, len(wanted) - 1))
                    hit = wanted[at] == words if len(wanted) else np.zeros(len(words), bool)
                    words, doc = words[hit], doc[hit]
                by = np.lexsort((doc, words))
                words, doc = words[by], doc[by]
                new = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])))) if len(words) else np.zeros(0, np.int64)
                ids.append(own[i:j])
                sizes.append(n.astype(np.int64))
                found.append((words[new], doc[new] + seen, np.diff(np.append(new, len(words)))))
                seen, n_docs, n_terms, n_post = seen + j - i, n_docs + int((n > 0).sum()), n_terms + int(n.sum()), n_post + len(new)
                if n_post >= POSTINGS or seen >= DOCS:
                    yield shard(n_docs, n_terms, ids, sizes, found)
                    n_docs = n_terms = n_post = seen = 0
                    ids, sizes, found = [], [], []
        if seen:
            yield shard(n_docs, n_terms, ids, sizes, found)

    return run


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """An index of docs, a row for each shard: n_docs and n_terms of its documents that have terms, and, by the places of ids (int64, rising; null as LAST, behind all
    others) and sizes (terms of each), for each of its terms the df there and the packed postings. Shards are runs of a task's rows with about
    POSTINGS postings, so texts are not shuffled and a shard fits a task, however often a term comes. terms, a table (term) of hashes: postings of these only, if the distinct ones take at
    most TERM_BYTES; else of all. Terms are told by 64-bit hashes of runs of a-z, 0-9 and what is beyond ASCII, A-Z lower-cased."""
    wanted = None
    if terms is not None:
        own = common.materialize(terms.select("term").distinct())
        if own.count() * 8 <= TERM_BYTES:
            wanted = np.sort(np.asarray(own.toArrow().column(0)).view(np.uint64))
        common.discard(own)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(common.tidy(_indexer(wanted)), SHARD)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item; rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in common.chunked(batch.column(1)):
                words, bounds = common.word_hashes(texts)
                own = pa.array(np.repeat(np.arange(i, j), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(words.view(np.int64))], ["item", "term"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(common.tidy(run), rows.select("item").schema.add("term", "long")).distinct()


# ---- the search ----


class Shard:
    """One row of the index: postings are unpacked when an item first asks for them, together with each document's share of the term's weight."""

    def __init__(self, ids: bytes, sizes: bytes, terms: np.ndarray, postings: pa.Array, n: int, total: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.m = 10 + (90 * np.frombuffer(sizes, np.int64) * n) // total
        self.at, self.postings, self.known = {t: i for i, t in enumerate(terms.tolist())}, postings, {}

    def list_of(self, term: int) -> tuple[list[int], list[int], int] | None:
        """Places, shares, the largest share."""
        if term not in self.known:
            i = self.at.get(term)
            if i is None:
                return None
            place, tf = postings_of(self.postings[i].as_py())
            share = (1_000_000_000 * tf) // (1000 * tf + 8 * self.m[place])
            self.known[term] = place.tolist(), share.tolist(), int(share.max())
        return self.known[term]


def best_of(shard: Shard, terms: list[int], weights: list[int], k: int, floor: int) -> list[tuple[int, int]]:
    """(score, place) of the k documents of the shard with the highest scores of at least floor (1 or more), ties to smaller places, in no order.

    Document at a time: a heap holds the next place of each list that must be merged, and results are a heap of k. Lists whose
    largest sums together can't reach the worst result that still counts aren't merged: documents that the others bring look up their shares there,
    from the list of the largest bound to that of the least, as long as the worst result can be reached."""
    lists = []
    for term, w in zip(terms, weights, strict=True):
        if w > 0 and (x := shard.list_of(term)):
            lists.append((w * x[2], w, x[0], x[1]))
    lists.sort(key=lambda x: x[0])
    bound = [0]
    for x in lists:
        bound.append(bound[-1] + x[0])
    best: list[tuple[int, int]] = []
    least, rest, at = max(1, floor), 0, [0] * len(lists)
    while rest < len(lists) and bound[rest + 1] < least:
        rest += 1
    heap = [(lists[i][2][0], i) for i in range(rest, len(lists))]
    heapq.heapify(heap)
    while heap:
        place, score = heap[0][0], 0
        while heap and heap[0][0] == place:
            i = heap[0][1]
            _, w, places, shares = lists[i]
            score += w * shares[at[i]]
            at[i] += 1
            if at[i] < len(places):
                heapq.heapreplace(heap, (places[at[i]], i))
            else:
                heapq.heappop(heap)
        i = rest
        while i and score + bound[i] >= least:
            i -= 1
            _, w, places, shares = lists[i]
            at[i] = bisect_left(places, place, at[i])
            if at[i] < len(places) and places[at[i]] == place:
                score += w * shares[at[i]]
        if i or score < least:
            continue
        (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -place))
        if len(best) == k and best[0][0] >= least:
            least = best[0][0] + 1  # what comes later has a larger place
            before = rest
            while rest < len(lists) and bound[rest + 1] < least:
                rest += 1
            if rest > before:
                heap = [x for x in heap if x[1] >= rest]
                heapq.heapify(heap)
    return [(s, -p) for s, p in best]


def _searcher(k: int, n: int, total: int, kind: pa.DataType):
    """Rows (shard, block of items) -> the k best documents of each item in each shard. A shard need not bring what k documents of an earlier shard
    of this task surpass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, list[int]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block, items, starts, terms, weights, ids, sizes, own, postings = (c[r] for c in batch.columns)
                shard = Shard(ids.as_py(), sizes.as_py(), np.asarray(own.values), postings.values, n, total)
                starts, terms, weights = (np.frombuffer(x.as_py(), np.int64).tolist() for x in (starts, terms, weights))
                floor = floors.setdefault(block.as_py(), [1] * (len(starts) - 1))
                rows, places, scores = [], [], []
                for i in range(len(starts) - 1):
                    s, e = starts[i], starts[i + 1]
                    found = best_of(shard, terms[s:e], weights[s:e], k, floor[i])
                    if len(found) == k:
                        floor[i] = max(floor[i], min(found)[0])
                    rows += [i] * len(found)
                    places += [p for _, p in found]
                    scores += [s for s, _ in found]
                doc = pa.array(shard.ids[np.array(places, np.int64)])
                yield pa.RecordBatch.from_arrays([items.values.take(pa.array(rows, pa.int64())).cast(kind), doc, pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, terms, weights) -> (items, starts, terms, weights) of about BLOCK_BYTES."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        items, terms, weights = (c.chunk(0) for c in t.columns)
        starts = np.concatenate(([0], np.cumsum(np.asarray(terms.value_lengths())))).astype(np.int64)
        flat = [pa.array([np.asarray(c.flatten()).astype(np.int64).tobytes()], pa.binary()) for c in (terms, weights)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items), pa.array([starts.tobytes()], pa.binary()), *flat], ["items", "starts", "terms", "weights"])

    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            held.append(batch.slice(i, 1024))
            size += 16 * int(np.asarray(held[-1].column(1).value_lengths()).sum())
            if size >= BLOCK_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def search(shards: DataFrame, terms: DataFrame, k: int, fan_in: int = 16) -> DataFrame:
    """(item, rank, doc_id, score): the k documents of highest score above 0 for each item, all if fewer, ties to the smaller doc_id, null ids last. shards: a materialized
    index of all documents that holds the terms; terms: (item, term), distinct.

    Items go in blocks of about BLOCK_BYTES; each block meets every shard once, in the task that reads the shard, or, if the blocks are beyond
    what may be broadcast, where a shuffle brings them. Each shard gives at most k rows an item; these lists are cut to k in two steps,
    so a task holds a share of an item's lists. No terms, no documents, or none that match: no rows. Rows that repeat an id are documents each."""
    stats = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = stats[0] or 0, stats[1] or 0
    own = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select("x.terms", "x.dfs").groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = terms.join(own, "term").select("item", F.struct("term", weight.alias("w")).alias("x"))
    lists = weighed.groupBy("item").agg(F.sort_array(F.collect_list("x")).alias("x")).select("item", "x.term", "x.w")
    kind = terms.schema["item"].dataType
    blocks = lists.mapInArrow(common.tidy(_blocks), f"items array<{kind.simpleString()}>, starts binary, q_terms binary, weights binary".replace("q_terms", "terms"))
    blocks = common.materialize(blocks.withColumn("block", F.xxhash64("starts", "terms")).withColumnRenamed("terms", "q_terms"))
    # One part on both sides: all blocks meet all shards, which is the search itself.
    parts = shards.rdd.getNumPartitions()
    dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = blocks.agg(F.coalesce(F.sum(F.octet_length("q_terms") * 2 + F.octet_length("starts") * 2), F.lit(0))).first()[0]
    dealt = F.broadcast(dealt) if held * parts <= common.BROADCAST_BYTES else dealt
    met = shards.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).join(dealt, "part")
    met = met.select("block", "items", "starts", "q_terms", "weights", "ids", "sizes", "terms", "postings")
    arrow = pa.schema(terms.sparkSession.createDataFrame([], terms.select("item").schema).toArrow().schema).field(0).type
    found = met.mapInArrow(common.tidy(_searcher(k, n, total, arrow)), terms.select("item").schema.add("doc_id", "long").add("score", "long"))
    by = [F.desc("score"), F.asc("doc_id")]
    few = found.withColumn("branch", F.spark_partition_id() % fan_in)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("item", "branch").orderBy(*by))).where(F.col("r") <= k)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)
    return out.select("item", "rank", F.when(F.col("doc_id") != int(LAST), F.col("doc_id")).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) for all rows of items (item_id, text) against all of docs (doc_id, text); other columns play no part. Null and empty texts have no terms:
    such documents count nowhere, such items get no rows. Rows of one item_id are one item, also those of null."""
    terms = common.materialize(item_terms(items))
    shards = common.materialize(index(docs, terms=terms))
    return search(shards, terms, k).withColumnRenamed("item", "item_id")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents),
t AS (SELECT row, doc_id, unnest(ws) AS term FROM d),
n AS (SELECT row, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark)),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT item_id, q.term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM q JOIN df ON q.term = df.term, c),
s AS (
  SELECT item_id, tf.row, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM w JOIN tf ON w.term = tf.term JOIN n ON n.row = tf.row, c GROUP BY 1, 2, 3
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
