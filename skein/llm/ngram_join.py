"""N-gram Jaccard self-join by chosen paths: sets split recursively on sampled shared tokens, small buckets brute-forced, in
as many runs as the target recall asks for; exact Jaccard verification of all that meets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Min-hash coordinates of a set; a set's token at a coordinate is what paths split on.
COORDS = 64
#: Children of a node on a path.
BRANCH = 2
#: A bucket of up to so many sets is brute-forced.
LIMIT = 1024
DEPTH = 4
TILE = 128

_MULT = np.random.default_rng(11).integers(1, 2**63, COORDS, dtype=np.uint64) | np.uint64(1)


def runs_for(similarity: float, recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets with this probability."""
    f = 1.0
    for _ in range(depth - 1):
        f = 1 - (1 - similarity * f) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity * f)))


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j in common.chunks(texts):
        words, bounds = common.word_hashes(texts[i:j])
        for r in range(j - i):
            yield np.unique(common.shingle_hashes(words[bounds[r] : bounds[r + 1]], n))


def set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(common.mix(common.mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDS) uint32; sets are not empty."""
    out = np.empty((len(sets), COORDS), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 1 << 17):
            size += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i:j]])[:-1]))
        with np.errstate(over="ignore"):
            for k in range(COORDS):
                h = flat * _MULT[k]
                h ^= h >> np.uint64(29)
                out[i:j, k] = np.minimum.reduceat((h * _MULT[k - 1] >> np.uint64(32)).astype(np.uint32), starts)
        i = j
    return out


def _sign(n: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            sizes, keys, sigs, held, at = [0] * m, [None] * m, [None] * m, [], []

            def flush():
                for r, s in zip(at, signatures(held) if held else [], strict=True):
                    sigs[r] = s.tobytes()
                held.clear()
                at.clear()

            for r, s in ((r, s) for i, _, texts in common.chunked(batch.column(1)) for r, s in enumerate(shingle_sets(texts, n), i)):
                if len(s):
                    sizes[r], keys[r] = len(s), set_key(s)
                    held.append(s)
                    at.append(r)
                    if len(held) >= 256:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "th", "n", "c", "sig"])

    return sign


def _next_paths(paths: np.ndarray, sigs: np.ndarray, branch: int) -> np.ndarray:
    """Children of each node for each set in it: (rows, branch). The coordinates depend on the path alone."""
    out = np.empty((len(paths), branch), np.uint64)
    with np.errstate(over="ignore"):
        first = common.mix(paths + np.uint64(1)) % np.uint64(COORDS)
        step = common.mix(paths + np.uint64(2)) % np.uint64(COORDS // 2) * np.uint64(2) + np.uint64(1)
        for b in range(branch):
            coord = (first + np.uint64(b) * step) % np.uint64(COORDS)
            token = sigs[np.arange(len(paths)), coord.astype(np.int64)].astype(np.uint64)
            out[:, b] = common.mix(paths * common.BASE + common.mix(token * np.uint64(COORDS) + coord))
    return out


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)


def _roots(runs: int):
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs, c = _sig_matrix(batch.column(1)), np.asarray(batch.column(0))
            out = []
            for run in range(runs):
                with np.errstate(over="ignore"):
                    top = common.mix(sigs[:, run % COORDS].astype(np.uint64) + common.mix(np.array([run + 1], np.uint64)))
                out.append(_next_paths(top, sigs, BRANCH))
            paths = np.concatenate(out, 1)
            yield pa.RecordBatch.from_arrays([pa.array(paths.ravel().view(np.int64)), pa.array(np.repeat(c, paths.shape[1]))], ["path", "c"])

    return roots


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            paths = _next_paths(np.asarray(batch.column(0)).view(np.uint64), _sig_matrix(batch.column(2)), BRANCH)
            yield pa.RecordBatch.from_arrays([pa.array(paths.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(1)), BRANCH))], ["path", "c"])


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, of batches sorted by them; whole runs, several at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = [np.asarray(batch.column(k)) for k in range(keys)]
        last_same = np.ones(batch.num_rows, bool)
        for x in first:
            last_same &= x == x[-1]
        cut = int(np.argmax(last_same))  # where the last run begins
        if held and cut == 0 and all(np.asarray(held[-1].column(k))[-1] == first[k][0] for k in range(keys)):
            held.append(batch)
            continue
        if held and all(np.asarray(held[-1].column(k))[-1] == first[k][0] for k in range(keys)):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        else:
            if held:
                yield pa.Table.from_batches(held)
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def bounds_of(table: pa.Table, keys: int) -> np.ndarray:
    n = table.num_rows
    new = np.zeros(n + 1, bool)
    new[0] = new[n] = True
    for k in range(keys):
        x = table.column(k).to_numpy()
        new[1:n] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def labels_of(linked: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of a symmetric boolean matrix."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] >= 0:
            continue
        label[i], front = i, np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
            label[front] = i
    return label


def tree(label: np.ndarray) -> np.ndarray:
    """For each element a parent in its component (itself for the first), at most two children each: no hot node."""
    order = np.argsort(label, kind="stable")
    rank = np.arange(len(label)) - np.searchsorted(label[order], label[order])
    parent = np.empty(len(label), np.int64)
    parent[order] = order[np.arange(len(label)) - rank + np.maximum(0, (rank - 1) // 2)]
    return parent


def _meet(floor: float):
    """Brute force of leaf buckets (path, c, side, sig) on signatures: tree edges (a, b) within each linked part. Of a tile pair, all pairs."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = math.ceil(floor * COORDS)
        for part in groups(batches, 1):
            bounds, c, sigs = bounds_of(part, 1), part.column(1).to_numpy(), _sig_matrix(part.column(2).combine_chunks())
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            ok = two[(sigs[two] == sigs[two + 1]).sum(axis=1) >= need]
            out_a, out_b = [c[ok]], [c[ok + 1]]
            for s, e in zip(bounds[:-1][size > 2], bounds[1:][size > 2], strict=True):
                own = sigs[s:e]
                linked = np.empty((e - s, e - s), bool)
                for i in range(0, e - s, 32):
                    linked[i : i + 32] = (own[i : i + 32, None, :] == own[None, :, :]).sum(axis=2) >= need
                parent = tree(labels_of(linked))
                moved = np.flatnonzero(parent != np.arange(e - s))
                out_a.append(c[s + moved])
                out_b.append(c[s + parent[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return meet


def _sets(n: int):
    """(comp, size, c, docs, text) -> the sets of those rows whose text has the key c."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s if len(s) and set_key(s) == c else None for s, c in zip(shingle_sets([t.as_py() or b"" for t in batch.column(4)], n), batch.column(2).to_pylist(), strict=True)]
            keep = pa.array([s is not None for s in found])
            out = batch.select([0, 1, 2, 3]).filter(keep)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([s.tobytes() for s in found if s is not None], pa.binary())], ["comp", "size", "c", "docs", "s"])

    return sets


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    row, col = row[use], column[inverse[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 8192
    for lo in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(col, (lo, lo + width))
        x = np.zeros((len(sets), width), np.float32)
        x[row[s:e], col[s:e] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(num: int, den: int):
    """Exact Jaccard of all pairs of a tile (ti = tj) or of two (ti, tj): per row its linked documents and texts and a tree parent."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 3):
            bounds = bounds_of(part, 3)
            ti, tj, tile, c, docs = (part.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            raw = part.column(6).to_pylist()
            out: list[list] = [[], [], [], []]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                _, first = np.unique(c[s:e], return_index=True)  # repeated rows of one text
                at = s + first
                if len(at) < 2:
                    continue
                sets = [np.frombuffer(raw[i], np.uint64) for i in at]
                both = overlaps(sets)
                size = np.array([len(x) for x in sets])
                linked = both * den >= (size[:, None] + size[None, :] - both) * num
                np.fill_diagonal(linked, False)
                if ti[s] != tj[s]:
                    linked &= tile[at][:, None] != tile[at][None, :]
                parent = tree(labels_of(linked))
                some = np.flatnonzero(linked.any(axis=1))
                for column, values in zip(out, (c[at][some], (linked @ docs[at])[some], linked.sum(axis=1)[some], c[at][parent][some]), strict=True):
                    column.append(values.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], ["c", "docs_linked", "texts_linked", "parent"])

    return verify


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, recall: float = 0.999) -> DataFrame:
    """(doc_id, class_id long, n_links long, n_text_links long, n_shingles int, text_key long) for each row of docs (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of n-word shingles (of fewer words, the one run of all)
    is num/den or more; words are lower-cased and as in the decontamination. class_id: the smallest doc_id of the connected part;
    n_links: linked other documents, copies counted; n_text_links: linked other sets; text_key: equal for equal sets.
    Equal sets count once in the join. A pair at the threshold meets with probability `recall` (parameter; higher above it); what
    meets is verified exactly, in tiles of at most 2 * TILE sets, so a group of any size is spread over tasks and no pair is emitted
    as a row. Null, empty and wordless texts link to nothing and are their own class; repeated rows link as copies; null doc_ids
    keep their rows, with the class of the others; an empty table gives no rows; further columns are ignored. Sets are keyed by
    64-bit hashes.
    """
    return _joined(docs, n, num, den, recall).drop("th", "class_key")


def _joined(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, recall: float = 0.999) -> DataFrame:
    """jaccard_join with th, the hash of the text, and class_key, which names the class whatever its doc_ids."""
    similarity = num / den
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))
    signed = common.materialize(texts.mapInArrow(common.tidy(_sign(n)), "doc_id long, th long, n int, c long, sig binary"))
    reps = common.materialize(signed.where("c is not null").groupBy("c").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.first("sig").alias("sig")))

    level = reps.select("c", "sig").mapInArrow(common.tidy(_roots(runs_for(similarity, recall))), "path long, c long")
    edges = None
    for depth in range(2, DEPTH + 1):
        level = common.materialize(level)
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        if depth < DEPTH:
            small, large = sizes.where(F.col("size") <= LIMIT), sizes.where(F.col("size") > LIMIT)
            leaves = level.join(small.select("path"), "path")
        else:  # what is still large is dealt in pairs of tiles
            large = None
            tiles = F.greatest(F.lit(1), F.ceil(F.col("size") / (LIMIT // 2)).cast("int"))
            leaves = level.join(sizes, "path").withColumn("t", tiles).withColumn("own", F.pmod(F.xxhash64("c"), F.col("t")))
            leaves = leaves.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
            leaves = leaves.select(F.when(F.col("t") == 1, F.col("path")).otherwise(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))).alias("path"), "c")
        leaves = leaves.join(reps.select("c", "sig"), "c").select("path", "c", "sig")
        found = leaves.repartition(F.col("path")).sortWithinPartitions("path").mapInArrow(common.tidy(_meet(similarity - 4 * math.sqrt(similarity * (1 - similarity) / COORDS))), "a long, b long")
        found = common.materialize(found.distinct())
        edges = found if edges is None else edges.union(found)
        if large is None or large.isEmpty():
            break
        level = level.join(large.select("path"), "path").join(reps.select("c", "sig"), "c").select("path", "c", "sig").mapInArrow(common.tidy(_children), "path long, c long").distinct()

    parts = common.materialize(common.connected_components(edges))
    counted = parts.join(parts.groupBy("component").agg(F.count("*").alias("size")), "component")
    members = counted.join(reps.select(F.col("c").alias("node"), "docs", "first_doc"), "node")
    members = common.sized(common.materialize(members), 80)
    fetched = texts.join(members, texts["doc_id"].eqNullSafe(members["first_doc"]))
    sets = fetched.select(F.col("component").alias("comp"), "size", F.col("node").alias("c"), "docs", "text").mapInArrow(common.tidy(_sets(n)), "comp long, size long, c long, docs long, s binary")
    t = F.ceil(F.col("size") / TILE).cast("int")
    dealt = sets.withColumn("tile", F.pmod(F.xxhash64("c"), t)).withColumn("other", F.explode(F.sequence(F.lit(0), t - 1)))
    dealt = dealt.select("comp", F.least("tile", "other").cast("long").alias("ti"), F.greatest("tile", "other").cast("long").alias("tj"), F.col("tile").cast("long").alias("tile"), "c", "docs", "s")
    verified = common.materialize(
        dealt.repartition(F.col("comp"), F.col("ti"), F.col("tj")).sortWithinPartitions("comp", "ti", "tj").mapInArrow(common.tidy(_verify(num, den)), "c long, docs_linked long, texts_linked long, parent long")
    )
    linked = verified.groupBy("c").agg(F.sum("docs_linked").alias("docs_linked"), F.sum("texts_linked").alias("texts_linked"))
    joined = common.connected_components(verified.select(F.col("c").alias("a"), F.col("parent").alias("b")))
    named = joined.join(reps.select(F.col("c").alias("node"), "first_doc"), "node")
    least = named.groupBy("component").agg(F.min("first_doc").alias("class_doc"))
    named = named.join(least, "component").select(F.col("node").alias("c"), "class_doc", F.col("component").alias("class_key"))
    classes = reps.select("c", "docs", "first_doc").join(named, "c", "left").join(linked, "c", "left")
    classes = classes.select(
        F.col("c").alias("text_key"), F.coalesce("class_doc", "first_doc").alias("class_id"), F.coalesce("class_key", "c").alias("class_key"),
        (F.col("docs") - 1 + F.coalesce("docs_linked", F.lit(0))).alias("n_links"), F.coalesce("texts_linked", F.lit(0)).alias("n_text_links"),
    )
    out = signed.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("c").alias("text_key")).join(classes, "text_key", "left")
    return out.select(
        "doc_id", "th", "class_key", F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"), "n_shingles", "text_key",
    )


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, that with the smallest doc_id (null last), then the smallest hash of its text; columns of any name are kept.

    Rows are told apart by doc_id and text: a doc_id that repeats with another text is another row, and of rows that repeat both one stays,
    any of them. Rows without words stay, all of them, as they are in no class. An empty table gives no rows.
    """
    rows = common.materialize(_joined(docs).where("class_key is not null").groupBy("doc_id", "th").agg(F.first("class_key").alias("class_key"), F.count("*").alias("times")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    best = rows.groupBy("class_key").agg(F.min(order).alias("best"))
    id_, th = common.fresh(docs, "row_id", "row_th")
    named = [F.col("doc_id").alias(id_), F.col("th").alias(th)]
    gone = common.materialize(rows.join(best, "class_key").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))).select(*named))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(th))
    kept = docs.join(common.sized(gone, 40), same, "left_anti")
    again = rows.where("times > 1").select(*named)
    if again.isEmpty():
        return kept
    again = common.sized(common.materialize(again), 40)
    text = common.fresh(docs, "row_text")[0]
    once = kept.join(again, same).withColumn(text, F.xxhash64("text")).dropDuplicates([id_, text]).select(*docs.columns)
    return kept.join(again, same, "left_anti").unionByName(once)
