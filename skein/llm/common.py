"""Shared pieces of the training-data operators: shared-folder tables, connected components, vectorised text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a local one, but on local masters only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="skein-")
        where = _OWN[app]
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more: what was made of them is materialized itself."""
    for df in tables:
        if path := getattr(df, "_skein_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def tidy(f):
    """The same function of Arrow batches, but a worker that has run it gives the memory that it freed back to the system. Workers live on from
    stage to stage, and what they hold adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of few rows, schema as in "a long, b string". Handed over by Arrow: a list goes through Python workers of another kind than those of
    Arrow batches, and these would stay in each executor's memory beside them."""
    fields = [f.split() for f in schema.split(", ")]
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], KINDS[kind]) for i, (name, kind) in enumerate(fields)}))


#: Edges that are joined in one task.
FEW = 20_000


def _roots(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node of the edges and the smallest of its component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(parent)]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), at most FEW -> (a, to): each node and the smallest of its component."""
    edges = ((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    roots = _roots(edges)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in roots], pa.int64()), pa.array([to for _, to in roots], pa.int64())], ["a", "to"])


def connected_components(edges: DataFrame, max_rounds: int = 60, native: bool = False) -> DataFrame:
    """(a long, b long) -> (node long, component long): component is the smallest node id of the component.

    Contraction: in each round every node moves to the neighbour with the smallest hash (a new hash every round), edges
    are renamed and self links go, until at most FEW edges are left, which one task joins (native: the driver, so that
    no Python runs on the executors). Expected rounds are logarithmic in the
    component size; each round's tables are written to the shared folder. Nulls and self links are ignored; no edges give no rows.
    """
    both = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    where = None
    for round_ in range(max_rounds):
        n = both.count()
        if not n:
            break
        sym = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seed = F.lit(round_)
        near = sym.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("x"))).alias("n"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("x"))
        if n <= FEW and native:
            step = materialize(local_table(edges.sparkSession, _roots([(e["a"], e["b"]) for e in both.collect()]), "a long, to long"))
        elif n <= FEW:
            step = materialize(both.repartition(1).mapInArrow(tidy(_joined), "a long, to long"))
        else:
            step = materialize(near.select("a", F.least(F.col("n"), own)["x"].alias("to")))
        before = where
        if where is None:
            where = materialize(step.select(F.col("a").alias("node"), F.col("to").alias("at")))
        else:
            where = materialize(where.join(step.withColumnRenamed("a", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at")))
            discard(before)
        if n <= FEW:
            break
        moved = both.join(step, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(step, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        left = materialize(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(both, step)
        both = left
    else:
        raise RuntimeError("connected components did not converge")
    if where is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    least = where.groupBy("at").agg(F.min("node").alias("component"))
    return where.join(least, "at").select("node", "component")


ROW = "row_id long, row_th long"


def judged_rows(docs: DataFrame, drops) -> DataFrame:
    """docs without the rows whose text `drops`, a function from an Arrow array of binary texts to booleans, condemns. Rows are told by
    doc_id and the hash of their text, so a row is judged by its own text, and texts don't come back from the workers; columns of any name stay."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(drops(batch.column(2)), pa.bool_())
            yield batch.select([0, 1]).filter(keep).rename_columns(["row_id", "row_th"])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary"))
    id_, th = fresh(docs, "row_id", "row_th")
    bad = materialize(texts.mapInArrow(tidy(judge), ROW).distinct()).select(F.col("row_id").alias(id_), F.col("row_th").alias(th))
    return docs.join(sized(bad, 40), docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(th)), "left_anti")


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


# ---- vectorised text, on the executors ----

#: Odd multiplier of the polynomial hash and its inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK = 1 << 20


def _byte_classes(word_of: list[tuple[int, int]], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    isw = np.zeros(256, bool)
    for lo, hi in word_of:
        isw[lo : hi + 1] = True
    low = np.arange(256)
    if lower:
        low[65:91] += 32
        isw[65:91] = isw[97]
    table_ = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
    return isw, table_[low]


#: Words of a-z, 0-9 and all beyond ASCII, after lower-casing A-Z.
WORDS = _byte_classes([(48, 57), (97, 122), (128, 255)], True)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, BASE, np.uint64), dtype=np.uint64)
        down = np.cumprod(np.full(size, INVERSE, np.uint64), dtype=np.uint64)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with about CHUNK bytes, one text at least."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def chunked(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs [i, j) of a binary column with about CHUNK bytes, one value at least, and their values; null is empty."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    i = 0
    while i < len(size):
        j = i + max(1, int(np.searchsorted(np.cumsum(size[i : i + CHUNK]), CHUNK, "right")))
        yield i, min(j, len(size)), [t.as_py() or b"" for t in column.slice(i, j - i)]
        i = j


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with the hash of [s, e) being (P[e] - P[s]) * INVERSE^s, wrapped to 64 bits."""
    up, _ = _powers(max(CHUNK, 1 << int(max(1, len(codes))).bit_length()))
    out = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(max(CHUNK, 1 << int(max(1, len(prefix) - 1)).bit_length()))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start])


def word_hashes(texts: list[bytes], classes=WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the bounds of each text's words in them (len(texts) + 1)."""
    isw, codes = classes
    buf = np.frombuffer(b"\x00".join(texts), np.uint8)
    inside = isw[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    hashes = span_hash(prefix_hash(codes[buf]), start, end) if len(start) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of fewer words, but not none, one run of all."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        acc = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            acc = acc * BASE + words[i : len(words) - n + 1 + i]
    return mix(acc)


#: A side goes out as a broadcast if its measured rows take no more than this; else it is shuffled.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, a table cheap to count, with a broadcast hint if rows * row_bytes is within BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
