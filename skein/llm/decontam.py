"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lower-cases A-Z and turns every byte that is in no word into a space.
TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: long, end: long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


class WuManber:
    """Patterns of one length m over word ids. shift: how far the search may move if a block of two words (one, if m = 1) ends
    at a position; buckets: patterns by the block that ends them."""

    def __init__(self, m: int, patterns: dict[tuple[int, ...], set[str]], base: int):
        self.m, self.base, self.patterns = m, base, patterns
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[list[int], set[str]]]] = defaultdict(list)
        for p, items in patterns.items():
            for j in range(min(1, m - 1), m):
                block = self.block(p, j)
                self.shift[block] = min(self.shift.get(block, m), m - 1 - j)
            self.buckets[self.block(p, m - 1)].append((list(p), items))

    def block(self, ids, j: int) -> int:
        return ids[j - 1] * self.base + ids[j] if self.m > 1 else ids[j]

    def search(self, ids: list[int], spans: list[tuple[int, int]], found: set[str]) -> None:
        m, base, shift, buckets, n = self.m, self.base, self.shift.get, self.buckets, len(ids)
        i, pair = m - 1, m > 1
        while i < n:
            key = ids[i]
            if not key:  # in no pattern
                i += m
                continue
            if pair:
                before = ids[i - 1]
                if not before:
                    i += m - 1
                    continue
                key += before * base
            step = shift(key, m - 1 if pair else 1)
            if step:
                i += step
                continue
            window = ids[i - m + 1 : i + 1]
            for pattern, items in buckets[key]:
                if pattern == window:
                    found |= items
                    if spans and spans[-1][1] >= i - m + 1:
                        spans[-1] = (spans[-1][0], i + 1)
                    else:
                        spans.append((i - m + 1, i + 1))
                    break
            i += 1


def compiled(windows: dict[tuple[bytes, ...], set[str]]) -> tuple[dict[bytes, int], list[WuManber]]:
    vocabulary: dict[bytes, int] = {}
    by: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(dict)
    for window, items in windows.items():
        by[len(window)][tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in window)] = items
    return vocabulary, [WuManber(m, p, len(vocabulary) + 1) for m, p in sorted(by.items())]


def window_blocks(rows: Iterable[tuple[str, bytes | None]], n: int, most: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """The windows of all items, at most `most` in a block."""
    block: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in rows:
        words = words_of(text)
        for i in range(max(1, len(words) - n + 1) if words else 0):
            block.setdefault(tuple(words[i : i + n]), set()).add(item)
            if len(block) >= most:
                yield block
                block = {}
    if block:
        yield block


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _judged(sent: list, texts: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Words, hit spans and found items of each text."""
    n = len(texts)
    sizes, spans, found = [0] * n, [[] for _ in range(n)], [set() for _ in range(n)]
    for k in range(max(1, len(sent))):
        vocabulary, searches = sent[k].value if sent else ({}, [])
        for r, text in enumerate(texts):
            words = words_of(text.as_py())
            sizes[r] = len(words)
            ids = list(map(vocabulary.get, words, [0] * len(words)))
            for search in searches:
                mine: list[tuple[int, int]] = []
                search.search(ids, mine, found[r])
                spans[r] += mine
        if len(sent) > 1:
            sent[k].__dict__.pop("_value", None)  # one block in memory at a time
    return sizes, [joined(s) for s in spans], found


def _contaminated(sizes: list[int], spans: list[list[tuple[int, int]]]) -> tuple[list[int], list[bool]]:
    hits = [sum(e - s for s, e in x) for x in spans]
    return hits, [h > 0 and 20 * h >= w for h, w in zip(hits, sizes, strict=True)]


def _finder(sent: list):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, found = _judged(sent, batch.column(1))
            hits, bad = _contaminated(sizes, spans)
            items = [sorted(x) for x in found]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            rows = [[{"start": s, "end": e} for s, e in x] for x in spans]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = [batch.column(0), sizes, hits, [len(x) for x in items], digests, bad, items, rows]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")[:7]] + ["spans"])

    return find


def _sent(spark, benchmark: DataFrame, n: int, most: int) -> list:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t"))
    rows = ((r["i"], bytes(r["t"]) if r["t"] is not None else None) for r in items.toLocalIterator())
    return [spark.sparkContext.broadcast(compiled(block)) for block in window_blocks(rows, n, most)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, most: int = 100_000) -> DataFrame:
    """One row for each row of docs (doc_id, text), in SCHEMA: its words, the words inside occurrences of benchmark windows, the
    items with occurring windows (by digest and as a sorted list), the hit spans in words, and whether it is contaminated.

    benchmark (item_id, text) is read in blocks of at most `most` windows, each searched for on its own, so what is sent to
    the executors is bounded whatever the number of items. Null texts have no words; a null item_id counts as the empty id;
    rows of one item_id are one item; repeated rows of docs are judged each; an empty benchmark hits nothing; further
    columns are ignored. No shuffle: documents stay where they are read.
    """
    sent = _sent(docs.sparkSession, benchmark, n, most)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(common.tidy(_finder(sent)), SCHEMA)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.drop("items", "spans")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated, each row judged by its own text, whatever its doc_id; columns of any name are kept. Null and
    empty texts are clean; repeated rows are judged alike; an empty table gives no rows."""
    sent = _sent(spark, common.table(spark, sf_dir, "benchmark"), 13, 100_000)

    def bad(texts: pa.Array) -> list[bool]:
        sizes, spans, _ = _judged(sent, texts)
        return _contaminated(sizes, spans)[1]

    return common.judged_rows(docs, bad)
