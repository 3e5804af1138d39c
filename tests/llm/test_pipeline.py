"""The stages one by one on odd rows, and the pipeline against a brute-force composition."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

import corpus_pipeline
from skein.llm import common, decontam, line_dedup, mixing, ngram_join, toxicity
from tests.llm import helpers
from tests.llm.test_text_operators import brute_join, brute_lines, brute_windows

CLASH = "doc_id long, text string, lang string, source string, n_chars long, removed string, kept_docs int, kept_id string, row_id int, row_th int, gone string, size string, taken string, target int, mix_id int, TH string"
BAD = ["vile", "foul"]


def put(df, folder, name):
    df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, near copies, near lines, benchmark passages and toxic words; labels and benchmark."""
    folder, r = str(tmp_path_factory.mktemp("corpus")), random.Random(12)
    passages = [helpers.prose(r, 30).replace("\n", " ") for _ in range(3)]
    boiler = [helpers.prose(r, 25).replace("\n", " ") for _ in range(4)]
    texts = []
    for i in range(120):
        body = helpers.prose(r, r.randint(40, 120))
        if i % 6 == 1:
            body = helpers.near(r, texts[-1], 1)
        if i % 17 == 0:
            body += "\n" + passages[i % 3]
        if i % 5 == 0:
            body += "\n" + helpers.near(r, boiler[i % 4], i % 2) + "\n" + boiler[(i + 1) % 4]
        if i % 7 == 3:
            body = body.replace(" ", f" {BAD[i % 2]} ", 4)
        texts.append(body)
    texts += [texts[0], None, "", "x"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    put(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), folder, "documents")
    put(spark.createDataFrame([(i, 1, int(any(b in (t or "") for b in BAD))) for i, t in enumerate(texts) if i % 10 < 8], "doc_id long, quality int, toxic int"), folder, "labels")
    put(spark.createDataFrame(list(enumerate(passages)), "item_id long, text string"), folder, "benchmark")
    return folder, rows, passages


def test_pipeline_is_its_brute_force_composition(spark, corpus):
    folder, rows, passages = corpus
    got = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, folder).collect()}

    docs = common.table(spark, folder, "documents")
    severity = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, toxicity.train(docs, common.table(spark, folder, "labels"))).collect()}
    assert sum(severity[i] == any(b in (t or "") for b in BAD) for i, t, *_ in rows) >= 0.98 * len(rows)
    left = {i: t for i, t, *_ in rows if not severity[i]}
    for i, gone in brute_lines(list(left.items())).items():
        if gone:
            numbers = {n for n, _ in gone}
            left[i] = "\n".join(x for n, x in enumerate(left[i].split("\n")) if n not in numbers)
    classes = brute_join(list(left.items()))
    left = {i: t for i, t in left.items() if classes[i][0] == i}
    left = {row[0]: left[row[0]] for row in brute_windows(list(left.items()), list(enumerate(passages))) if not row[5]}
    assert {i: r["text"] for i, r in got.items()} == left
    assert 20 < len(left) < len(rows) - 20
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())
    by, share = defaultdict(list), 0
    for r in got.values():
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for source in by.values():
        assert abs(sum(r["taken"] for r in source) - source[0]["target"]) <= 1
        share += source[0]["target"]
    assert share == pytest.approx(float(Fraction(3, 2) * sum(r["size"] for r in got.values())))


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", 2, 3, "c", "d", "e", 4, 5, "f") for r in rows], CLASH).repartition(3)


def odd_rows():
    r = random.Random(3)
    base = [helpers.prose(r, 60) for _ in range(6)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [rows[0], rows[0], (0, base[1] + " vile foul", "en", None, 1), (1, helpers.near(r, base[5], 1), "en", "s0", 1), (None, base[2], None, None, None), (None, helpers.near(r, base[3], 1), None, None, None)]
    return [*rows, (None, "alone " * 3 + helpers.prose(r, 30), None, None, None), (7, None, None, "s1", None), (7, None, None, "s1", None), (8, "", "en", "s1", 0), (None, None, None, None, None)], base


def listed(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns_and_empty_tables(spark, corpus, stage):
    rows, _ = odd_rows()
    docs = clashing(spark, rows)
    out = stage(spark, docs, corpus[0])
    if stage is not mixing.stage:
        assert out.dtypes == docs.dtypes
        assert all(r[5:] == ("a", 1, "b", 2, 3, "c", "d", "e", 4, 5, "f") for r in map(tuple, out.collect()))
    assert stage(spark, docs.limit(0), corpus[0]).count() == 0


def test_rows_are_judged_by_their_own_texts(spark, corpus):
    rows, base = odd_rows()
    clean = [r for r in corpus[1] if not any(b in (r[1] or "") for b in BAD)]
    toxic = [(clean[0][0], base[1] + " vile foul", "en", None, 1), (None, base[2] + " vile foul vile", "en", None, 1)]
    kept = listed(toxicity.stage(spark, clashing(spark, [*corpus[1], *toxic, *rows[11:]]), corpus[0]))
    assert kept == Counter((r[0], r[1]) for r in [*clean, *rows[11:]])

    folder, _, passages = corpus
    bad = [*rows, (2, passages[0], "en", "s0", 1), (None, passages[1], "en", "s0", 1)]
    assert listed(decontam.stage(spark, clashing(spark, bad), folder)) == Counter((r[0], r[1]) for r in rows)


def test_join_stage_keeps_one_row_of_each_class(spark, corpus):
    rows, base = odd_rows()
    kept = listed(ngram_join.stage(spark, clashing(spark, rows), ""))
    want = Counter({(i, base[i]): 1 for i in (0, 2, 3, 4)})
    want[1, base[1]] += 1  # that of doc 0 with two more words is a near copy of it, with the smaller doc_id
    near = {(0, base[1] + " vile foul"), (1, base[1])}
    assert sum(kept[x] for x in near) == 1 and kept[0, base[1] + " vile foul"] == 1
    assert kept[1, rows[9][1]] == 1 and kept[5, base[5]] == 0  # a near copy of document 5 with a smaller doc_id
    assert all(kept[x] == 1 for x in want if x not in near)
    assert sum(n for (i, t), n in kept.items() if i is None and t) == 1  # the others are near copies of documents with ids
    assert kept[7, None] == 2 and kept[8, ""] == 1 and kept[None, None] == 1


def test_line_stage_counts_every_row(spark, corpus):
    rows, _ = odd_rows()
    out = line_dedup.stage(spark, clashing(spark, rows), "")
    assert out.count() == len(rows) and Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows)


def test_mixing_stage_shares_words_of_repeated_rows(spark, corpus):
    rows, _ = odd_rows()
    out = [r.asDict() for r in mixing.stage(spark, clashing(spark, rows), "").collect()]
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)
    assert all(r["size"] == len((r["text"] or "").split()) and r["TH"] == "f" for r in out)
    want = {(r["source"]): 0 for r in out}
    for r in out:
        want[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(want[r["source"]] - r["target"]) <= 1 for r in out)


def test_local_tables_start_no_python_workers(spark, monkeypatch, tmp_path):
    kind, made = type(spark), []
    texts = ["some words to keep", "a vile word", None, "and more words"] * 5
    put(spark.createDataFrame([(i, i % 4 == 1) for i in range(20)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic"), tmp_path, "labels")
    docs = spark.createDataFrame([(i, t, [None, "b", "a"][i % 3], 1.5) for i, t in enumerate(texts)], "doc_id long, text string, source string, score double").cache()
    docs.count()
    make = kind.createDataFrame
    monkeypatch.setattr(kind, "createDataFrame", lambda self, data, *a, **k: made.append(type(data).__name__) or make(self, data, *a, **k))
    toxicity.stage(spark, docs, str(tmp_path)).count()
    mixing.stage(spark, docs, str(tmp_path)).count()
    mixing.stage(spark, docs.limit(0), str(tmp_path)).count()
    assert made == ["Table"] * 3
    assert [tuple(r) for r in common.local_table(spark, [(1, None, 0.5), (None, "x", None)], "a long, b string, c double").collect()] == [(1, None, 0.5), (None, "x", None)]
