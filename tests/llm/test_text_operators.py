import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import decontam, line_dedup, mixing, ngram_join, suffix_dedup, toxicity
from tests.llm import helpers
from tests.llm.helpers import documents, empty, words


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


class Parts(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


# ---- mixing ----


def test_mix_takes_targets(spark):
    got = rows_of(mixing.mix(documents(spark), block=7)[0])
    assert len(got) == len(helpers.texts())
    by = defaultdict(list)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(min(1.5 * total, 2 * total))
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v)
        assert v[0]["target"] <= 2 * v[0]["source_size"]
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1


def test_mix_reruns_agree_and_block_size_does_not_matter(spark):
    key = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    a, b = key(mixing.mix(documents(spark), block=7)[0]), key(mixing.mix(documents(spark).repartition(5), block=100)[0])
    assert a == b


def test_mix_plan_interleaves_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 100, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    out, plan = mixing.mix(docs, weights=(2, 1), block=10)
    slots = [r["src"] for r in plan.select("slot", "src").distinct().orderBy("slot").collect()]
    shares = Counter(slots)
    for n in (30, 60, 150):
        assert abs(slots[:n].count(0) - n * shares[0] / len(slots)) <= 3
    assert plan.groupBy("rid").sum("words").count() == 40


def test_mix_edges(spark):
    assert mixing.mix(empty(spark))[0].count() == 0
    got = rows_of(mixing.mix(documents(spark, nulls=True))[0])
    assert len(got) == len(helpers.texts()) + 4
    assert all(r["taken"] == 0 for r in got if not r["size"])
    assert mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"))[0].first()["target"] == 0


def test_targets_reshare():
    got = [Fraction(*x) for x in mixing.targets([10, 1000, 1000], [5, 2, 1], Fraction(3015))]
    assert got[0] == 20 and sum(got) == 3015 and all(t <= 2 * s for t, s in zip(got, [10, 1000, 1000], strict=True))
    assert [Fraction(*x) for x in mixing.targets([0, 0], [5, 2], Fraction(0))] == [0, 0]


# ---- decontamination ----


def brute_windows(docs, items, n=13):
    win = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            win[tuple(w[k : k + n])].add("" if i is None else str(i))
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in win}:
            for k in range(len(w) - m + 1):
                if (x := win.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= x
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most", [100_000, 7])
def test_decontamination_is_exact(spark, most):
    docs = documents(spark, nulls=True)
    texts = helpers.texts()
    items = [(1, texts[0]), (2, texts[1][:120]), (11, "alpha beta"), (3, None), (4, ""), (None, texts[2]), (5, "a a a a a a a a a a a a a a"), (2, texts[3]), (6, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(docs, bench, most=most).collect()), key=str)
    want = sorted(brute_windows([(r.doc_id, r.text) for r in docs.collect()], items), key=str)
    assert got == want
    assert any(r[2] for r in got)


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.decontaminate(documents(spark), none).collect()} == {0}
    assert decontam.decontaminate(empty(spark), none).count() == 0


# ---- n-gram join ----


def brute_join(docs, n=5):
    sets = {}
    for d, t in docs:
        w = words(t)
        k = min(n, len(w))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    parts, links = Parts(), Counter()
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 5 * both >= 4 * len(sets[a] | sets[b]) and both:
                parts.join(a, b)
                links[a] += 1
                links[b] += 1
    return {d: (parts.find(d), links[d]) for d in ids}


def family(seed, n, copies):
    r = random.Random(seed)
    base = helpers.prose(r, 150)
    return [base] * copies + [helpers.near(r, base, r.randint(0, 6)) for _ in range(n)]


@pytest.mark.parametrize("tile,limit", [(128, 1024), (8, 16)])
def test_jaccard_join_is_exact(spark, monkeypatch, tile, limit):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "LIMIT", limit)
    texts = helpers.texts() + family(3, 60, 5) + family(4, 10, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(docs).collect()}
    assert got == brute_join(list(enumerate(texts)))


def test_jaccard_join_edges(spark):
    assert ngram_join.jaccard_join(empty(spark)).count() == 0
    got = rows_of(ngram_join.jaccard_join(documents(spark, nulls=True)))
    assert len(got) == len(helpers.texts()) + 4
    assert [r["n_links"] for r in got if r["doc_id"] == 0] == [6] * 3
    kept = ngram_join.stage(spark, documents(spark, nulls=True), "")
    assert kept.columns == documents(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and 12 not in ids and ids[29] == 1


def test_runs_reach_recall():
    assert 1 <= ngram_join.runs_for(0.8, 0.9) < ngram_join.runs_for(0.8, 0.9999)


def test_chosen_paths_reach_recall():
    """Pairs just over the threshold meet, even where every bucket is so large that paths go down to the last level."""
    r, sets = random.Random(9), []
    while len(sets) < 4000:
        text = helpers.prose(r, r.randint(30, 150))
        a, b = ngram_join.shingle_sets([text.encode(), helpers.near(r, text, r.randint(1, 3)).encode()], 5)
        both = len(np.intersect1d(a, b))
        if 0.8 <= both / (len(a) + len(b) - both) <= 0.85:
            sets += [a, b]
    sigs = ngram_join.signatures(sets)
    runs = ngram_join.runs_for(0.8, 0.999)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([s.tobytes() for s in sigs], pa.binary())], ["c", "sig"])
    (level,) = ngram_join._roots(runs)(iter([batch]))
    for depth in range(2, ngram_join.DEPTH + 1):
        own = defaultdict(set)
        for path, c in zip(*(x.to_pylist() for x in level.columns), strict=True):
            own[c].add(path)
        met = [own[i] & own[i + 1] for i in range(0, len(sets), 2)]
        assert sum(map(bool, met)) >= 0.98 * len(met), depth
        rows = [(p, c) for i, paths in enumerate(met) for p in sorted(paths) for c in (2 * i, 2 * i + 1)]
        batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows]), pa.array([c for _, c in rows]), pa.array([sigs[c].tobytes() for _, c in rows], pa.binary())], ["path", "c", "sig"])
        (level,) = ngram_join._children(iter([batch]))
    need = math.ceil((0.8 - 4 * math.sqrt(0.8 * 0.2 / ngram_join.COORDS)) * ngram_join.COORDS)
    assert ((sigs[::2] == sigs[1::2]).sum(axis=1) >= need).mean() >= 0.99


# ---- substrings ----


def brute_substrings(docs, length):
    seen, out = set(), []
    for d, t in docs:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cov[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i in range(len(b)) if cov[i] and (i == 0 or not cov[i - 1]))
        out.append((d, len(b), sum(cov), runs, hashlib.sha256(bytes(c for c, x in zip(b, cov, strict=True) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("length,hot", [(100, 20_000), (40, 20_000), (100, 3)])
def test_substring_dedup_is_exact(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = helpers.texts(2) + family(5, 20, 2) + ["q" * 5000, "ab" * 3000, "abc" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_substrings(docs, length).collect())
    assert got == brute_substrings(list(enumerate(texts)), length)


def test_substring_dedup_edges(spark):
    assert suffix_dedup.dedup_substrings(empty(spark)).count() == 0
    got = rows_of(suffix_dedup.dedup_substrings(documents(spark, nulls=True)))
    assert len(got) == len(helpers.texts()) + 4
    repeated = sorted(r["n_removed"] for r in got if r["doc_id"] == 0)
    assert repeated[0] < repeated[1] == repeated[2] == next(r["n_bytes"] for r in got if r["doc_id"] == 0)


# ---- lines ----


def brute_lines(docs, k=8):
    occ = defaultdict(list)
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            if norm := line.lower().strip():
                occ[norm].append((d, i))
    sets, parts, keys = {n: {n[i : i + k] for i in range(len(n))if i == 0 or i + k <= len(n)} for n in occ}, Parts(), sorted(occ)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if (both := len(sets[a] & sets[b])) and 5 * both >= 4 * len(sets[a] | sets[b]):
                parts.join(a, b)
    keep = {}
    for n, o in occ.items():
        keep[parts.find(n)] = min([*o, keep.get(parts.find(n), o[0])])
    gone = defaultdict(list)
    for n, o in occ.items():
        for d, i in o:
            if (d, i) != keep[parts.find(n)]:
                gone[d].append((i, keep[parts.find(n)][0]))
    return {d: sorted(gone[d]) for d, _ in docs}


@pytest.mark.parametrize("tile", [512, 4])
def test_line_dedup_is_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    r = random.Random(8)
    lines = [helpers.prose(r, 40).replace("\n", " ") for _ in range(10)]
    texts = helpers.texts(3) + ["\n".join([lines[i % 10], helpers.near(r, lines[(i + 1) % 10], r.randint(0, 5)), "Home | About", ""]) for i in range(40)]
    texts += ["https://example.com/a/first-report", "https://example.com/b/other-thing", "short", "Short ", "shorts"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: list(zip(x.removed, x.kept_docs, strict=True)) for x in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(list(enumerate(texts)))


def test_line_bands_reach_recall():
    r, pairs = random.Random(5), []
    while len(pairs) < 3000:
        a = helpers.prose(r, r.randint(4, 60)).replace("\n", " ")
        b = list(a)
        for _ in range(r.randint(1, 1 + len(a) // 25)):
            b[r.randrange(len(b))] = r.choice("klmnop")
        x, y = helpers.shingles(a), helpers.shingles("".join(b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            pairs.append((a, "".join(b)))
    met = helpers.band_keys([a for a, _ in pairs]) == helpers.band_keys([b for _, b in pairs])
    assert met.any(axis=1).mean() >= 0.99


def test_line_dedup_edges(spark):
    out = line_dedup.stage(spark, documents(spark, nulls=True), "")
    assert out.columns == documents(spark).columns and out.count() == len(helpers.texts()) + 4
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    got = {r.doc_id: r for r in line_dedup.stage(spark, documents(spark), "").collect()}
    assert got[29].text is None and got[30].text == "" and got[12].text == "" and got[0].text == helpers.texts()[0]
    assert all(r.n_chars == len(r.text or "") for r in got.values())


# ---- toxicity ----


def graded(seed, n):
    r = random.Random(seed)
    bad = {1: ["meh", "dull"], 2: ["vile", "foul"], 3: ["worst", "horrid"]}
    out = []
    for i in range(n):
        g = r.choice([0, 0, 0, 1, 2, 3])
        ws = helpers.prose(r, 60).split(" ")
        for _ in range(3 if g else 0):
            ws.insert(r.randrange(len(ws)), r.choice(bad[g]))
        out.append((i, " ".join(ws), g))
    return out


def test_toxicity_orders_grades_on_held_out_texts(spark):
    rows = graded(1, 1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows[:800]], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.theta) == 3 and list(model.theta) == sorted(model.theta)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = rows[800:]
    assert sum(got[i].toxic == (g > 0) for i, _, g in held) >= 0.98 * len(held)
    mean = [sum(got[i].severity for i, _, x in held if x == g) / sum(x == g for _, _, x in held) for g in range(4)]
    assert mean == sorted(mean) and sum(got[i].grade == g for i, _, g in held) >= 0.9 * len(held)


def test_toxicity_edges(spark):
    docs = documents(spark, nulls=True)
    for labels in ([], [(0, 1), (1, 1)], [(0, None), (None, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.toxicity(docs, model).collect()
        assert len(got) == docs.count() and not any(r.toxic for r in got)
    assert toxicity.toxicity(empty(spark), model).count() == 0


@pytest.mark.parametrize("tile", [512, 16])
def test_residual_pairs_meet_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    r = random.Random(4)
    base = [helpers.prose(r, 14).replace("\n", " ") for _ in range(4)]
    text = {k: helpers.near(r, base[k % 4], r.randint(0, 1)) for k in range(150)}
    comp = {k: 0 if k % 3 else k for k in text}
    bands = [(b, k, comp[k]) for b in range(3) for k in text if (k * 7 + b) % 3]
    members = spark.createDataFrame(bands, "band long, key long, comp long")
    texts = spark.createDataFrame([(k, t, len(t)) for k, t in text.items()], "key long, norm string, n long")
    got, want = Parts(), Parts()
    for a, b in line_dedup._residual(members, texts).collect():
        got.join(a, b)
    inside = defaultdict(set)
    for b, k, _ in bands:
        inside[b].add(k)
    sets = {k: helpers.shingles(t) for k, t in text.items()}
    for ks in inside.values():
        for a in ks:
            for b in ks:
                if a < b and comp[a] != comp[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    want.join(a, b)
    for k in text:
        got.join(comp[k], k), want.join(comp[k], k)
    assert [got.find(k) for k in text] == [want.find(k) for k in text] and len({want.find(k) for k in text}) < 40
