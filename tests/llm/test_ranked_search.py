import math
import random
from collections import Counter

import numpy as np

from skein.llm import common, ranked_search
from tests.llm import helpers

ITEMS = "item_id long, text string, term string, df int"


def brute(docs, items, k):
    counts = [(i, Counter(helpers.words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    terms: dict = {}
    for i, t in items:
        terms.setdefault(i, set()).update(helpers.words(t))
    out = []
    for item, own in terms.items():
        scored = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_packed_numbers_read_back():
    r = random.Random(1)
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**35, 2**62, *[r.randrange(2 ** r.randrange(1, 50)) for _ in range(500)]])
    data, bounds = ranked_search.packed(values)
    assert ranked_search.unpacked(data).tolist() == values.tolist()
    assert [ranked_search.unpacked(data[s:e]).tolist() for s, e in zip(bounds, bounds[1:])] == [[v] for v in values]
    assert ranked_search.unpacked(data[:0]).tolist() == []


def test_ranks_equal_brute_force(spark, monkeypatch):
    r = random.Random(2)
    docs = [(i, t) for i, t in enumerate(helpers.texts())] + [(None, helpers.texts()[0]), (None, None), (3, helpers.texts()[3]), (3, helpers.texts()[3]), (-5, "river river STONE")]
    items = [(i, " ".join(r.choice(["river", "stone", "Über", "cloud7", "gamma", "edit12", "nowhere", "one", "two", "x"]) for _ in range(r.randint(1, 12)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, helpers.texts()[3]), (92, "more words of one item: glass"), (None, "cloud paper"), (93, "nowhere at all nothing")]
    want = brute(docs, items, 10)
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, term string, item long").repartition(3)
    q = spark.createDataFrame([(*x, "clash", 2) for x in items], ITEMS)
    assert rows(ranked_search.rank_documents(d, q)) == want and len({x[0] for x in want}) > 20
    monkeypatch.setattr(ranked_search, "TERM_BYTES", 0)  # all terms are indexed
    assert rows(ranked_search.rank_documents(d, q)) == want


def test_many_shards_and_blocks_give_the_same(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate(helpers.texts(3))]
    items = [(i, helpers.prose(random.Random(i), 9)) for i in range(40)]
    own = common.materialize(ranked_search.item_terms(spark.createDataFrame([(*x, "", 0) for x in items], ITEMS)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)

    def shards(most):
        index = ranked_search._indexer(None)
        monkeypatch.setattr(ranked_search, "DOCS", most)
        return [r for b in index(iter([table.toArrow().combine_chunks().to_batches()[0].cast(pa_schema())])) for r in b.to_pylist()]

    import pyarrow as pa

    def pa_schema():
        return pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

    monkeypatch.setattr(common, "CHUNK", 1 << 10)
    few, many = shards(1 << 17), shards(4)
    assert len(few) == 1 and len(many) > 5 and sum(x["n_docs"] for x in many) == few[0]["n_docs"]
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 64)
    got = ranked_search.search(spark.createDataFrame([tuple(x.values()) for x in many], ranked_search.SHARD).repartition(5), own, 4).withColumnRenamed("item", "item_id")
    assert rows(got) == brute(docs, items, 4)


def test_documents_are_skipped_but_none_that_counts():
    class Plain(ranked_search.Shard):
        def __init__(self, lists):
            self.lists = lists

        def list_of(self, term):
            return self.lists.get(term)

    for seed in range(60):
        r = random.Random(seed)
        lists = {}
        for t in range(r.randint(1, 8)):
            places = sorted(r.sample(range(200), r.randint(1, 150)))
            shares = [r.randint(0, 5) for _ in places]
            lists[t] = places, shares, max(shares)
        weights = [r.randint(0, 4) for _ in range(9)]
        scores = Counter()
        for t, (places, shares, _) in lists.items():
            for p, s in zip(places, shares):
                scores[p] += s * weights[t]
        for floor in (1, 15):
            want = sorted(((s, p) for p, s in scores.items() if s >= floor), key=lambda x: (-x[0], x[1]))[:5]
            assert sorted(ranked_search.best_of(Plain(lists), list(range(9)), weights, 5, floor), key=lambda x: (-x[0], x[1])) == want


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "river", "", 0)], ITEMS)
    assert ranked_search.rank_documents(helpers.empty(spark), items).count() == 0
    assert ranked_search.rank_documents(helpers.documents(spark), items.limit(0)).count() == 0
    assert ranked_search.rank_documents(helpers.documents(spark, nulls=True), items).count() == 10
