"""Toxicity by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct word hashes of each text; null has none."""
    for i, j, texts in common.chunked(column):
        hashes, bounds = common.word_hashes(texts)
        for r in range(j - i):
            yield np.unique(hashes[bounds[r] : bounds[r + 1]])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w.view(np.int64) for w in _words(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["place", "grade", "n", "words"])


def _excess(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Chernoff exponent of k or more of n by chance at rate p."""
    r = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(r > 0, r * np.log(r / p), 0) + np.where(r < 1, (1 - r) * np.log((1 - r) / (1 - p)), 0)
    return np.where(r > p, n * d, 0)


def _chosen(excess: np.ndarray, tests: int, rate: float = 0.1) -> np.ndarray:
    """Those whose bounds pass at this false discovery rate over so many tests."""
    order = np.argsort(-excess, kind="stable")
    passed = np.flatnonzero(-excess[order] <= np.log(rate * np.arange(1, len(order) + 1) / max(1, tests)))
    keep = np.zeros(len(excess), bool)
    keep[order[: passed[-1] + 1 if len(passed) else 0]] = True
    return keep


class CumulativeLink:
    """P(grade > k) = sigmoid(w.x - theta_k), theta ascending: one weight vector shared by all thresholds."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, theta: np.ndarray, grades: np.ndarray):
        self.vocabulary, self.weights, self.theta, self.grades = vocabulary, weights, theta, grades

    def score(self, words: np.ndarray) -> float:
        if not len(self.vocabulary) or not len(words):
            return 0.0
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return float(self.weights[at[self.vocabulary[at] == words]].sum())

    def beyond(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.theta[None, :], -50, 50)))

    def grade(self, scores: np.ndarray) -> np.ndarray:
        """The median grade."""
        return self.grades[(self.beyond(scores) >= 0.5).sum(axis=1)]

    def toxic(self, scores: np.ndarray) -> np.ndarray:
        return self.grade(scores) > self.grades[0]

    def severity(self, scores: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.beyond(scores) @ np.diff(self.grades)


def fit(rows: list[tuple[int, np.ndarray]], l2: float = 0.02, steps: int = 1500) -> CumulativeLink:
    """Fit to (grade, sorted distinct word hashes). Words take part whose share in some upper range of grades exceeds chance
    by a Chernoff bound, at a false discovery rate of a tenth over all words tried; the fit is full-batch gradient descent, its steps fading out, with an L2 penalty."""
    y = np.array([g for g, _ in rows], np.int64)
    grades = np.unique(y)
    if len(grades) < 2:
        return CumulativeLink(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), grades if len(grades) else np.zeros(1, np.int64))
    level = np.searchsorted(grades, y)
    flat = np.concatenate([w for _, w in rows])
    doc = np.repeat(np.arange(len(rows)), [len(w) for _, w in rows])
    words, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    excess = np.zeros(len(words))
    for k in range(1, len(grades)):
        up = np.bincount(inverse, weights=level[doc] >= k, minlength=len(words))
        excess = np.maximum(excess, _excess(up, count, float((level >= k).mean())))
        excess = np.maximum(excess, _excess(count - up, count, float((level < k).mean())))
    keep = _chosen(np.where(count > 1, excess, 0), tests=2 * (len(grades) - 1) * int((count > 1).sum()))
    column = np.cumsum(keep) - 1
    used = keep[inverse]
    doc, col, d = doc[used], column[inverse[used]], int(keep.sum())
    share = np.array([(level >= k).mean() for k in range(1, len(grades))])
    theta, w = np.log((1 - share) / share), np.zeros(d)
    above = (level[:, None] >= np.arange(1, len(grades))[None, :]).astype(float)
    model = CumulativeLink(words[keep], w, theta, grades)
    m1, m2 = np.zeros(d + len(theta)), np.zeros(d + len(theta))
    for step in range(1, steps + 1):  # Adam
        score = np.bincount(doc, weights=w[col], minlength=len(rows)) if d else np.zeros(len(rows))
        p = model.beyond(score)
        # gradient of -log(P(> k-1) - P(> k)) by score and thresholds
        full = np.concatenate((np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))), 1)
        slope = np.concatenate((np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))), 1)
        at = np.arange(len(rows))
        mass = np.maximum(full[at, level] - full[at, level + 1], 1e-12)
        g_score = -(slope[at, level] - slope[at, level + 1]) / mass
        g_theta = np.array([((above[:, k] > 0) & (level == k + 1)) @ (p[:, k] * (1 - p[:, k]) / mass) - (level == k) @ (p[:, k] * (1 - p[:, k]) / mass) for k in range(len(theta))]) / len(rows)
        g_w = (np.bincount(col, weights=g_score[doc], minlength=d) / len(rows) + l2 * w / len(rows)) if d else np.zeros(0)
        g = np.concatenate((g_w, g_theta))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.05 * (1 + np.cos(np.pi * step / steps)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-10)
        w = w - move[:d]
        theta = np.maximum.accumulate(theta - move[d:] + 1e-9 * np.arange(len(theta)))
        model.weights, model.theta = w, theta
    return model


def train(docs: DataFrame, labels: DataFrame, grade: str = "toxic", most: int = 8000, most_words: int = 4_000_000) -> CumulativeLink:
    """Fit on at most `most` labelled documents, those whose doc_id hashes lowest, as far as their distinct words, summed in that order, stay
    within most_words (the first counts anyway). Rows with a null doc_id or grade don't count; of several grades of a doc_id the highest, of several
    texts the least counts."""
    spark = docs.sparkSession
    own = labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull()).select("doc_id", F.col(grade).cast("long").alias("grade"))
    own = own.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = common.local_table(spark, [(r["doc_id"], place, r["grade"]) for place, r in enumerate(own.collect())], "doc_id long, place long, grade long")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")  # `most` rows of three integers
    texts = texts.groupBy("place", "grade").agg(F.min("text").alias("text"))
    rows = common.materialize(texts.mapInArrow(common.tidy(_features), "place long, grade long, n long, words array<long>"))
    total, until = 0, 0
    for place, n in sorted(tuple(r) for r in rows.select("place", "n").collect()):
        total += n
        if total > most_words and until:
            break
        until = place + 1
    got = rows.where(F.col("place") < until).select("grade", "words").toArrow()
    common.discard(rows)
    order = [(g.as_py(), np.asarray(w.values, np.int64).view(np.uint64)) for g, w in zip(got.column(0), got.column(1), strict=True)]
    order.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # the same sums whatever the order of arrival
    return fit(order)


def _scorer(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: CumulativeLink = sent.value
        for batch in batches:
            scores = np.array([model.score(w) for w in _words(batch.column(1))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.severity(scores), pa.float64()), pa.array(model.grade(scores), pa.int32()), pa.array(model.toxic(scores))], ["doc_id", "severity", "grade", "toxic"])

    return score


def toxicity(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """(doc_id, severity double, grade int, toxic boolean) for each row of docs (doc_id, text): the expected grade, the median
    grade, and whether that is above the lowest. Null and empty texts score as texts without known words; repeated rows
    each get a row; with labels of one grade only, all get that grade; without labels grade 0. Whole texts count."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most one weight for each word of the labelled sample
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(common.tidy(_scorer(sent)), "doc_id long, severity double, grade int, toxic boolean")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, common.table(spark, sf_dir, "labels")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, each row judged by its own text, whatever its doc_id; columns of any name are kept. Null and empty
    texts score as texts without known words; repeated rows are judged alike; an empty table gives no rows."""
    sent = spark.sparkContext.broadcast(train(docs, common.table(spark, sf_dir, "labels")))

    def bad(texts: pa.Array) -> np.ndarray:
        model: CumulativeLink = sent.value
        return model.toxic(np.array([model.score(w) for w in _words(texts)], float))

    return common.judged_rows(docs, bad)
