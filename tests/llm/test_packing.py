import random
import zlib

import numpy as np
import pytest

from skein.llm import packing
from tests.llm import helpers

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "don't it's they'll we've I'm ''s x'-s '-s -'s a'b", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "á̸ ≮ ≠ x H̱ K Å", "ΑΣ ΑΣ. İstanbul", "x\x01y \x01", "\x1c\x1d a\x85b c d", "日本語。はい！", "1234 12.5 a1b2", "(word) [x] _y_ a_b", "a' \x00 'tis\r\n\r\nA.B.C", "😀" * 30]


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def padded(n, length):
    return 0 if n & (n - 1) == 0 else length - n


def test_ids_are_those_of_whole_texts():
    texts = ODD + [x or "" for x in helpers.texts()]
    want = [x[:-1] for x in tokens(texts)]
    for by_chunk, own in ((True, texts), (True, texts[4:]), (False, texts)):
        ids, bounds = packing.Ids(PATH, by_chunk).of([x.encode() for x in own])
        assert [ids[s:e].tolist() for s, e in zip(bounds, bounds[1:])] == want[len(texts) - len(own) :]


def test_forgotten_chunks_are_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 50)
    monkeypatch.setattr(packing, "BATCH", 7)
    encode = packing.Ids(PATH)
    for x in helpers.texts()[:8] * 2:
        assert encode.of([x.encode()])[0].tolist() == tokens([x])[0][:-1]


def cost_of(ends, places, cost, length, each):
    price = dict(zip(places, cost))
    return sum(padded(b - a, length) + price[b] + each for a, b in zip([0, *ends], ends))


def least(places, cost, length, each):
    best = {0: 0}
    for p, c in zip(places, cost):
        best[p] = min(best[q] + padded(p - q, length) + c + each for q in best if p - q <= length)
    return best[places[-1]]


def test_windows_are_of_least_cost():
    for seed in range(300):
        r = random.Random(seed)
        length, each = r.choice([16, 20, 64]), r.choice([0, 3])
        places = np.cumsum([r.randint(1, length if r.random() < 0.2 else 6) for _ in range(r.randint(1, 60))]).tolist()
        cost = [r.choice([0, 2, 9]) for _ in places]
        ends = packing.windows(places, cost, length, each)
        assert set(ends) <= set(places) and ends[-1] == places[-1] and max(b - a for a, b in zip([0, *ends], ends)) <= length
        assert cost_of(ends, places, cost, length, each) == least(places, cost, length, each)


def test_cuts_leave_no_wide_gap():
    docs, sentences = np.array([5, 400, 401, 2000]), np.array([3, 5, 90, 700])
    places, cost = packing.cuts(docs, sentences, 2000, (8, 64), 128)
    price = dict(zip(places.tolist(), cost.tolist()))
    assert np.diff(places, prepend=0).max() <= 128 and price[5] == price[400] == price[2000] == 0 and price[3] == price[90] == price[700] == 8 and price[90 + 128] == 64
    assert set(places) - set(docs) - set(sentences) <= {p for g, e in ((90, 400), (401, 700), (700, 2000)) for p in range(g + 128, e, 128)}


@pytest.mark.parametrize("run", [1 << 19, 300])
def test_pieces_put_together_are_the_documents(spark, monkeypatch, run):
    monkeypatch.setattr(packing, "RUN", run)
    monkeypatch.setattr(packing, "TEXTS", 2000)
    monkeypatch.setattr(packing.common, "CHUNK", 1000)
    rows = list(enumerate(ODD + helpers.texts()))
    rows += [(None, "a null id"), (None, None), rows[20]]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, length int, ids int, offset string").repartition(2)
    got = packing.pack(docs, PATH, 64, penalties=(1, 1, 2)).collect()
    want: dict = {}
    for (i, _), ids in zip(rows, tokens([t for _, t in rows])):
        want.setdefault((i, len(ids)), []).append(ids)
    seqs: dict = {}
    for r in got:
        assert r.length == len(r.ids) // 4 > 0
        seqs.setdefault(r.sequence_id, []).append(r)
    total = pad = 0
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and (n := sum(r.length for r in own)) <= 64
        total, pad = total + n, pad + padded(n, 64)
    assert total == sum(len(x) for own in want.values() for x in own) and pad < 0.12 * total
    pieces: dict = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for key, own in want.items():
        flat = [x for _, ids in sorted(pieces.pop(key), key=lambda p: p[0]) for x in ids]
        assert sorted(flat) == sorted(x for ids in own for x in ids) and (len(own) > 1 or flat == own[0])
    assert not pieces


def test_query_and_empty_table(spark, tmp_path):
    assert packing.pack(helpers.empty(spark), PATH).count() == 0
    helpers.documents(spark, nulls=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op12_packing(spark, str(tmp_path)).where("doc_id is not null").collect()
    ids = dict(enumerate(tokens(helpers.texts())))
    assert {r.doc_id for r in rows} == set(ids)
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert "Exchange" not in packing.op12_packing(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
