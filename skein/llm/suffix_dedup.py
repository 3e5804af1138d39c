"""Repeated-substring dedup over a prefix-free parse: rolling-hash triggers cut texts into overlapping phrases; distinct phrases make the
dictionary, their places in corpus order the parse, and sorted suffixes of the dictionary's phrases tell which windows are equal.

Every window of `length` bytes belongs to the trigger whose rolling hash is least in it, which its own bytes decide. A phrase is a trigger
with all its windows, so neighbours overlap by `length` - 1 bytes, no window leaves its phrase, and equal windows lie in phrases of equal
triggers: suffixes of phrases with different triggers have no window in common (the parse is prefix-free), and the dictionary's suffix array falls
apart into one for each trigger, built where its phrases meet. As no window leaves its phrase, the order of the parse's suffixes decides
nothing beyond the order of places, which stands in for it. Equal phrases are found by 64-bit fingerprints, windows of different phrases by
their bytes (those of triggers with over HOT phrases by fingerprints of single windows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .ngram_join import bounds_of, groups

#: Bytes that a trigger is chosen by, and that its fingerprint covers.
GRAM, CONTEXT = 8, 32
#: Low bits of a trigger's order that hold its place in a chunk; the others are its hash.
PLACE_BITS = 36
#: Records of one trigger that are compared in one place; those of more common triggers are dealt by single windows.
HOT = 20_000

BYTES = common._byte_classes([(0, 255)], False)[1]


def records(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Of each trigger with windows in a text: text (index), lo and hi (its first and last window's start), trigger (fingerprint),
    all_ (fingerprint of the bytes of all its windows, and where the trigger lies in them), and the prefix hash under `prefix`, `base`."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    prefix = common.prefix_hash(BYTES[buf])
    width = length - CONTEXT + 1
    empty = np.zeros(0, np.int64)
    out = {"text": empty, "lo": empty, "hi": empty, "trigger": empty.view(np.uint64), "all_": empty.view(np.uint64), "prefix": prefix, "base": starts}
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return out
    n = len(buf) - GRAM + 1
    _, down = common._powers(max(common.CHUNK, 1 << len(buf).bit_length()))
    with np.errstate(over="ignore"):
        key = (prefix[GRAM:] - prefix[:-GRAM]) * down[:n]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64((1 << PLACE_BITS) - 1)  # the same for every chunk, so equal windows choose alike; of equal hashes the first counts
    key = (key & ~mask) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    count = sizes[long] - length + 1
    first = starts[long]
    at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    least = (key[at] & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    end = np.concatenate((new[1:], [len(at)])) - 1
    p, lo, hi = least[new], at[new], at[end]
    text = np.searchsorted(starts, lo, "right") - 1
    with np.errstate(over="ignore"):
        whole = common.mix(common.span_hash(prefix, lo, hi + length) + (p - lo).astype(np.uint64) * common.BASE)
    return out | {"text": text, "lo": lo, "hi": hi, "trigger": common.span_hash(prefix, p, p + CONTEXT), "all_": whole}


def _pack(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (lo << 12) | (hi - lo)


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = span >> 12
    return lo, lo + (span & 4095)


def _repeats(keys: tuple[np.ndarray, ...], ord_: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, ord and lo, and in it which rows repeat the keys of an earlier one."""
    order = np.lexsort((lo, ord_, *reversed(keys)))
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = True
        for k in keys:
            same[1:] &= k[order][1:] == k[order][:-1]
    return order, same


def _parse(length: int):
    """(ord, text) -> (key, all_, ord, span): a row for each record, but of equal records of a batch the first alone meets others; the
    rest, already known to repeat, come with a negative span and any key."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, parts = [t.as_py() or b"" for t in batch.column(1)], np.asarray(batch.column(0)), []
            for i, j in common.chunks(texts):
                r = records(texts[i:j], length)
                parts.append((r["trigger"], r["all_"], ids[i:j][r["text"]], r["lo"] - r["base"][r["text"]], r["hi"] - r["base"][r["text"]]))
            if not parts:
                continue
            key, all_, ord_, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, again = _repeats((all_, key), ord_, lo)
            key, all_, ord_, span = key[order], all_[order], ord_[order], _pack(lo, hi)[order]
            key = np.where(again, common.mix(ord_.astype(np.uint64) + span.astype(np.uint64)), key)
            span = np.where(again, -1 - span, span)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(all_.view(np.int64)), pa.array(ord_), pa.array(span)], ["key", "all_", "ord", "span"])

    return parse


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, all_, ord, span -> (ord, span, key, open): repeats (open false), and first records whose trigger has others with
    different surroundings (open true). A record waits for the next one only."""
    held = None  # the last first record, not given out yet: key, all_, ord, span, whether it is open

    def out(ord_, span, key, open_):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ord_, span, key, open_)], ["ord", "span", "key", "open"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, all_, ord_, span = (np.asarray(batch.column(k)) for k in range(4))
        done = span < 0
        yield out(ord_[done], -1 - span[done], key[done], np.zeros(done.sum(), bool))
        key, all_, ord_, span = (x[~done] for x in (key, all_, ord_, span))
        if not len(key):
            continue
        if held:
            key, all_, ord_, span = (np.concatenate(([h], x)) for h, x in zip(held, (key, all_, ord_, span), strict=False))
        again = np.concatenate(([False], (key[1:] == key[:-1]) & (all_[1:] == all_[:-1])))
        yield out(ord_[again], span[again], key[again], np.zeros(again.sum(), bool))
        key, all_, ord_, span = (x[~again] for x in (key, all_, ord_, span))
        alike = key[1:] == key[:-1]
        open_ = np.concatenate((alike, [False])) | np.concatenate(([bool(held and held[4])], alike))
        yield out(ord_[:-1][open_[:-1]], span[:-1][open_[:-1]], key[:-1][open_[:-1]], np.ones(open_[:-1].sum(), bool))
        held = (key[-1], all_[-1], ord_[-1], span[-1], open_[-1])
    if held and held[4]:
        yield out([held[2]], [held[3]], [held[0]], [True])


def _surroundings(length: int):
    """(ord, text, open array<struct<span, key, hot>>) -> (key, ord, lo, bytes): the bytes of an open record's windows under its trigger,
    or for hot triggers each window by itself under its fingerprint, without bytes."""

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ords, los, strings = [], [], [], []
            for ord_, text, opened in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                prefix = None
                for x in opened:
                    lo, hi = x["span"] >> 12, (x["span"] >> 12) + (x["span"] & 4095)
                    if not x["hot"]:
                        keys.append(np.array([x["key"]]))
                        los.append(np.array([lo]))
                        strings.append(text[lo : hi + length])
                    else:
                        prefix = common.prefix_hash(BYTES[np.frombuffer(text, np.uint8)]) if prefix is None else prefix
                        s = np.arange(lo, hi + 1)
                        keys.append(common.span_hash(prefix, s, s + length).view(np.int64))
                        los.append(s)
                        strings += [None] * len(s)
                    ords.append(np.full(len(los[-1]), ord_))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ords)), pa.array(np.concatenate(los)), pa.array(strings, pa.binary())], ["key", "ord", "lo", "bytes"])

    return surroundings


def prefix_ranks(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes of buf at these places by their first `length` bytes (8 at least), equal for equal bytes: prefix doubling from words of 8."""
    n, width = len(buf), 8
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    _, rank = np.unique(np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64), return_inverse=True)
    while 2 * width <= length:
        _, rank = np.unique(rank[: n - 2 * width + 1] * np.int64(n + 1) + rank[width : n - width + 1], return_inverse=True)
        width *= 2
    _, out = np.unique(rank[at] * np.int64(n + 1) + rank[at + length - width], return_inverse=True)
    return out


def _compare(length: int):
    """Rows of _surroundings sorted by key -> (ord, span) of the windows that repeat an earlier one: equal ranks in the suffix array of
    the phrases, and among those all but the first place."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 1):
            bounds = bounds_of(part, 1)
            key, ord_, lo, strings = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3).to_pylist()
            i = 0
            while i < len(bounds) - 1:  # whole groups, some at a time
                j = i + 1
                while j < len(bounds) - 1 and bounds[j + 1] - bounds[i] <= 8192:
                    j += 1
                rows = range(bounds[i], bounds[j])
                own = [strings[r] or b"" for r in rows]
                size = np.array([len(s) for s in own])
                at = np.concatenate(([0], np.cumsum(size)))
                count = np.where(size > 0, size - length + 1, 1)
                row = np.repeat(np.arange(len(own)), count)
                nth = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
                prints = np.zeros(len(row), np.int64)  # of single windows the key tells all
                real = size[row] > 0
                if real.any():
                    prints[real] = prefix_ranks(np.frombuffer(b"".join(own), np.uint8), at[row[real]] + nth[real], length)
                k, o, w = key[bounds[i] + row], ord_[bounds[i] + row], lo[bounds[i] + row] + nth
                order, again = _repeats((k, prints), o, w)
                repeat = np.zeros(len(row), bool)
                repeat[order] = again
                hit = np.flatnonzero(repeat)
                new = np.concatenate(([True], (row[hit][1:] != row[hit][:-1]) | (hit[1:] != hit[:-1] + 1))) if len(hit) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(hit)])) - 1 if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(o[hit[first]]), pa.array(_pack(w[hit[first]], w[hit[last]]))], ["ord", "span"])
                i = j

    return compare


def _joined(length: int):
    """(ord, spans) -> (ord, runs): the maximal runs of bytes that the windows cover."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for spans in batch.column(1):
                lo, hi = _unpack(np.sort(np.asarray(spans.values)))
                end = np.maximum.accumulate(hi + length)
                new = np.concatenate(([True], lo[1:] > end[:-1]))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(lo)])) - 1
                out.append([{"start": s, "end": e} for s, e in zip(lo[first].tolist(), end[last].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["ord", "runs"])

    return joined


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            text, digest, at = text.as_py() or b"", hashlib.sha256(), 0
            for x in runs or []:
                digest.update(text[at : x["start"]])
                at = x["end"]
            digest.update(text[at:])
            rows.append((len(text), sum(x["end"] - x["start"] for x in runs or []), len(runs or []), digest.hexdigest(), runs or []))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], kind)], [x.split()[0] for x in RESULT.split(", ")[:5]] + ["removed"])


def dedup_substrings(docs: DataFrame, length: int = 100) -> DataFrame:
    """RESULT for each row of docs (doc_id, text): bytes that a string of `length` bytes covers that also starts earlier (in a smaller
    doc_id, or earlier in the text) are removed; overlaps count and all is judged on the input. A text is parsed in one piece and takes some tens
    of bytes of memory for each of its own.

    Null texts are empty; texts of fewer bytes lose none; rows of one doc_id count in the order of their texts' hashes, so of repeated
    rows one stays; null doc_ids come first; an empty table gives no rows; further columns are ignored. length: more than CONTEXT and below 4096.
    """
    if not CONTEXT < length < 4096:
        raise ValueError("length")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    if texts.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        texts = texts.withColumn("ord", F.col("doc_id"))
    else:
        texts = common.materialize(texts.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).withColumn("ord", F.monotonically_increasing_id()))
    parsed = texts.where(F.octet_length("text") >= length).select("ord", "text").mapInArrow(_parse(length), "key long, all_ long, ord long, span long")
    settled = parsed.repartition(F.col("key")).sortWithinPartitions("key", "all_", "ord", "span").mapInArrow(_settle, "ord long, span long, key long, open boolean")
    settled = common.materialize(settled)

    opened = settled.where("open")
    hot = common.materialize(opened.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot")))
    opened = opened.join(common.sized(hot, 32), "key", "left")
    lists = common.materialize(opened.groupBy("ord").agg(F.collect_list(F.struct("span", "key", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("open")))
    around = texts.join(lists, "ord").select("ord", "text", "open").mapInArrow(_surroundings(length), "key long, ord long, lo long, bytes binary")
    compared = around.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_compare(length), "ord long, span long")

    spans = settled.where("not open").select("ord", "span").union(compared)
    runs = common.materialize(spans.groupBy("ord").agg(F.collect_list("span").alias("spans")).mapInArrow(_joined(length), "ord long, runs array<struct<start: long, end: long>>"))
    wide = runs.select(F.coalesce(F.sum(F.size("runs") * 40 + 64), F.lit(0))).first()[0]
    out = texts.join(F.broadcast(runs) if wide <= common.BROADCAST_BYTES else runs, "ord", "left")
    return out.select("doc_id", "text", "runs").mapInArrow(_removed, RESULT)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.table(spark, sf_dir, "documents")).drop("removed")
