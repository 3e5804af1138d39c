"""Packing of documents into token sequences by order-preserving dynamic programming: windows are cut where documents or sentences end, so that padding and
penalties for cut documents are least; a monotone queue gives each cut its best window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Penalties in tokens of padding: for each sequence, for a cut where a sentence of a document ends, for one elsewhere in it.
SEQUENCE, SENTENCE, WITHIN = 8, 8, 64
#: Where no sentence ends within this share of a window, one sixteenth, cuts may also fall after each of as many tokens.
STRETCH = 16
#: Tokens after which a run of documents is cut into windows; the last window is left open for the next run.
RUN = 1 << 19
#: Chunks of text whose ids a worker keeps, chunks that go to the tokenizer at once, and bytes of texts that are cut into chunks at once.
KNOWN, BATCH, TEXTS = 1_500_000, 4096, 4 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


# ---- ids ----


class Ids:
    """Token ids of whole texts. Texts are cut where the tokenizer cuts them in any case - at ASCII white space, between an ASCII letter or digit and ASCII
    punctuation (after an apostrophe excepted) - and each distinct chunk is tokenized once; ids are those of the whole text. That holds for tokenizers that drop white
    space and never join letters or digits with punctuation, but for what follows an apostrophe; others must be given whole texts (by_chunk False)."""

    def __init__(self, path: str, by_chunk: bool = True, ends: str = ".!?。！？…"):
        from tokenizers import Tokenizer

        self.t, self.by_chunk = Tokenizer.from_file(path), by_chunk
        self.specials = [x.content.encode() for x in self.t.get_added_tokens_decoder().values()]
        kind = np.zeros(128, np.int8)  # 1 space, 2 letter or digit, 3 punctuation, 4 apostrophe
        kind[[9, 10, 13, 32]] = 1
        kind[33:127] = 3
        for lo, hi in ((48, 57), (65, 90), (97, 122)):
            kind[lo : hi + 1] = 2
        kind[39] = 4
        self.kind = np.concatenate((kind, np.zeros(128, np.int8)))
        single = (self._plain([c]) for c in ends)
        self.ends = np.zeros(self.t.get_vocab_size(), bool)
        self.ends[[x[0] for x, *_ in single if len(x) == 1]] = True
        mark = self._plain(["\x01"])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.pool, self.starts = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64)  # chunk i has the ids from starts[i] to starts[i + 1]

    def _room(self, pool: int, starts: int) -> None:
        while pool > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while starts > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        for i in range(0, len(chunks), BATCH):
            own = chunks[i : i + BATCH]
            texts = [c.decode() for c in own]
            if self.mark is None or any("\x01" in t for t in texts):
                ids = self._plain(texts)
                flat, size = np.concatenate(ids), [len(x) for x in ids]
            else:  # one call: chunks with a mark between them
                flat = self._plain([" \x01 ".join(texts)])[0]
                is_mark = flat == self.mark
                size = np.diff(np.concatenate(([-1], np.flatnonzero(is_mark), [len(flat)]))) - 1
                flat = flat[~is_mark]
            n, filled = len(self.at), int(self.starts[len(self.at)])
            self._room(filled + len(flat), n + len(own) + 1)
            self.pool[filled : filled + len(flat)] = flat
            self.starts[n + 1 : n + 1 + len(own)] = filled + np.cumsum(size)
            self.at.update(zip(own, range(n, n + len(own)), strict=True))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and the bounds of each text's in them."""
        whole = [i for i, t in enumerate(texts) if not self.by_chunk or (b"<" in t and any(s in t for s in self.specials))]
        held = set(whole)
        if not whole:
            return self._chunked(texts)
        ids, bounds = self._chunked([b"" if i in held else t for i, t in enumerate(texts)])
        each = [ids[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i, own in zip(whole, self._plain([texts[i].decode() for i in whole]), strict=True):
            each[i] = own
        return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)

    def _chunked(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(b" ".join([b"", *texts]), np.uint8).copy()
        kind = self.kind[buf]
        buf[kind == 1] = 32
        buf[:-1] += (32 * ((buf[:-1] - np.uint8(65) < 26) & (buf[1:] < 128))).astype(np.uint8)  # no accent can follow, so it is as good as lower-cased later
        cut = kind == 1
        a, b = kind[:-1], kind[1:]
        cut[1:] |= ((a == 2) & (b >= 3)) | ((a == 3) & (b == 2))
        bounds = np.append(np.flatnonzero(cut), len(buf)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(buf)]).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        if len(self.at) + len(distinct) > KNOWN:
            self._forget()
        if new := [c for c in distinct if c not in self.at]:
            self._learn(new)
        own = np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))
        lo, code = self.starts[own], chunks.indices.to_numpy()
        size, begin = (self.starts[own + 1] - lo)[code], lo[code]
        to = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(begin - to[:-1], size) + np.arange(to[-1])]
        ends = np.cumsum([len(t) + 1 for t in texts])
        return ids, np.concatenate(([0], to[np.searchsorted(bounds, ends)])).astype(np.int64)


@lru_cache(maxsize=2)
def ids_of(path: str, by_chunk: bool) -> Ids:
    return Ids(path, by_chunk)


# ---- windows ----


def cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, penalties: tuple[int, int], stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) where a window may end: where documents end, sentences end, and in long stretches without either."""
    at = np.union1d(doc_ends, sentence_ends).astype(np.int64)
    gap = np.diff(at, prepend=0)
    wide = np.flatnonzero(gap > stretch)
    n = (gap[wide] - 1) // stretch
    steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
    more = np.repeat(at[wide] - gap[wide], n) + steps * stretch
    places = np.union1d(at, more)
    cost = np.full(len(places), penalties[1], np.int64)
    cost[np.searchsorted(places, sentence_ends)] = penalties[0]
    cost[np.searchsorted(places, doc_ends)] = 0
    keep = (places > 0) & (places <= total)
    return places[keep], cost[keep]


def windows(places: list[int], cost: list[int], length: int, each: int) -> list[int]:
    """The ends of windows of at most `length` tokens, chosen from places (rising, to the end of all, no gap beyond length), of least padding to length plus cost of
    their ends plus `each` for every window. A window of a power of two up to length is not padded.

    A window that is padded from i to j costs length - (j - i): so the best i is the one of least total + place among those in reach, which the front of a
    monotone queue holds; the powers of two, a few for each j, are looked up."""
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    best, back = [0], [0]
    place_of = {0: 0}
    at = [0, *places]
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (total + place, index), rising in both
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - length:
            queue.popleft()
        value, i = queue[0]
        value += length - p
        for w in powers:
            x = place_of.get(p - w)
            if x is not None and best[x] <= value:
                value, i = best[x], x
        value += cost[j - 1] + each
        best.append(value)
        back.append(i)
        place_of[p] = j
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def _packer(path: str, by_chunk: bool, end_id: int, length: int, penalties: tuple[int, int, int]):
    """(doc_id long, text binary) -> PIECES, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = ids_of(path, by_chunk), TaskContext.get()
        state = {"sequence": (task.partitionId() if task else 0) << 40}
        docs: list[tuple[int | None, int]] = []  # id and tokens of documents not packed to their ends
        held: list[np.ndarray] = []
        skipped = n = 0  # tokens of the first document that are packed; tokens held

        def pack(last: bool) -> pa.RecordBatch:
            nonlocal docs, held, skipped, n
            ids = np.concatenate(held)
            sizes = np.array([t for _, t in docs], np.int64)
            ends = np.cumsum(sizes) - skipped
            inside = np.flatnonzero(encode.ends[ids]) + 1
            ends_ = np.array(windows(*(x.tolist() for x in cuts(ends, inside, len(ids), penalties[1:], max(1, length // STRETCH))), length, penalties[0]), np.int64)
            if not last:
                ends_ = ends_[:-1]
            done = int(ends_[-1]) if len(ends_) else 0
            cut = np.union1d(ends_, ends[ends <= done])
            begin = np.concatenate(([0], cut[:-1])) if len(cut) else cut
            doc = np.searchsorted(ends, begin, "right")
            window = np.searchsorted(ends_, begin, "right")
            first = np.concatenate(([0], ends_))[window] if len(cut) else begin
            data = ids[:done].astype("<u4").view(np.uint8)
            pieces = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((4 * np.append(begin, done)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            names = pa.array([docs[d][0] for d in doc.tolist()], pa.int64())
            numbers = [begin - (ends[doc] - sizes[doc]), cut - begin, sizes[doc], state["sequence"] + window, begin - first]
            out = pa.RecordBatch.from_arrays([names, *[pa.array(x.astype(np.int64)) for x in numbers], pieces], [f.split()[0] for f in PIECES.split(", ")])
            state["sequence"] += len(ends_)
            gone = int(np.searchsorted(ends, done, "right"))
            skipped = done - int(ends[gone - 1]) if gone else skipped + done
            docs, held, n = docs[gone:], [ids[done:].copy()], len(ids) - done
            return out

        def took(names: list, texts: list[bytes]) -> None:
            nonlocal docs, n
            ids, bounds = encode.of(texts)
            docs += zip(names, (np.diff(bounds) + 1).tolist(), strict=True)
            held.append(np.insert(ids, bounds[1:], end_id))
            n += len(held[-1])

        names: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, j, more in common.chunked(batch.column(1)):
                names += batch.column(0).slice(i, j - i).to_pylist()
                texts += more
                size += sum(map(len, more))
                if size >= TEXTS:
                    took(names, texts)
                    names, texts, size = [], [], 0
                    if n >= RUN:
                        yield pack(False)
        if names:
            took(names, texts)
        if n:
            yield pack(True)

    return run


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, by_chunk: bool = True, penalties: tuple[int, int, int] = (SEQUENCE, SENTENCE, WITHIN)) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): pieces of the documents (doc_id, text), token ids as little-endian 32-bit numbers. A document is the ids of its whole text and
    end_id; each id is in one piece; a piece begins `start` ids into its document of doc_tokens and at `offset` of its sequence. Pieces of a sequence follow one another from 0,
    `length` tokens at most, in the order of the rows.

    Every task packs the documents it reads, in their order, in runs of about RUN tokens: no shuffle, and only the last sequence of a task is padded more than the cuts
    need. A run's last window stays open for the next run, so runs leave no seam. sequence_id is unique, not without gaps. A null or empty text is end_id alone. A document's ids are in one task's
    memory, 4 bytes each. Rows that repeat are packed each. No rows give none. Ids of special tokens whose strings stand in a text are as the tokenizer's file says."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(common.tidy(_packer(path, by_chunk, end_id, length, penalties)), PIECES)


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
