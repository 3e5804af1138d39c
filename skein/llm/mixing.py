"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

GOLDEN = 0.6180339887498949


def words_of(text: Column) -> Column:
    """Runs of non-space characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], budget: Fraction) -> list[tuple[int, int]]:
    """Share budget by weight; what exceeds twice a source's size is shared again among the others. As exact fractions
    (numerator, denominator). All sizes zero: all targets zero."""
    order = sorted(range(len(sizes)), key=lambda i: (Fraction(sizes[i], weights[i]), i))
    left, weight, out = budget, sum(weights), [(0, 1)] * len(sizes)
    for n, i in enumerate(order):  # those that fill first come first
        if left * weights[i] <= 2 * sizes[i] * weight:
            for j in order[n:]:
                out[j] = (left.numerator * weights[j], weight * left.denominator)
            break
        out[i] = (2 * sizes[i], 1)
        left -= 2 * sizes[i]
        weight -= weights[i]
    return out


def schedule(spark, quotas: DataFrame, slots: int, chunk: int = 1 << 16) -> DataFrame:
    """(slot long, src int, rank long): golden-ratio points 0..slots-1 mapped through the cumulative shares of the quotas
    (src int, quota long, lo double, hi double), ranked per source; a source's surplus points go, missing ones are
    added after the last slot, so that each source has exactly its quota."""
    bounds = F.array(*[F.lit(float(r["hi"])) for r in quotas.orderBy("src").collect()])
    points = spark.range(slots).select(
        F.col("id").alias("slot"),
        F.least(F.size(F.filter(bounds, lambda hi: hi <= (F.col("id") * F.lit(GOLDEN)) % F.lit(1.0))), F.size(bounds) - 1).alias("src"),
    )
    points = points.withColumn("part", F.floor(F.col("slot") / chunk))
    counts = points.groupBy("src", "part").agg(F.count("*").alias("n"))
    before = counts.select("src", "part", (F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n")).alias("before"))
    ranked = points.withColumn("own", F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1)
    ranked = ranked.join(before, ["src", "part"]).select("slot", "src", (F.col("own") + F.col("before")).alias("rank"))
    kept = ranked.join(quotas.select("src", "quota"), "src").where("rank < quota").select("slot", "src", "rank")
    have = quotas.join(counts.groupBy("src").agg(F.sum("n").alias("have")), "src", "left").where("quota > coalesce(have, 0)")
    more = have.select("src", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("quota") - 1)).alias("rank"))
    return kept.unionByName(more.select((F.lit(slots) + F.col("rank")).alias("slot"), "src", "rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), block: int = 2048, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix documents (doc_id, source, text). Returns (documents, plan).

    documents: doc_id, source, size, source_size, target, taken - one row for each input row, and key, if such an expression of it is given. plan: slot, src, epoch, rid,
    start, words - the words of document rid that slot takes, in mixing order.

    Size is the number of words of whole texts. Sources, by code point with null last, get the weights in turn; share times
    all words is dealt by weight, at most twice a source's size. Each source's documents are shuffled (by digest of doc_id) and
    cut into blocks of `block` words; slots of the schedule take blocks in order, epoch after epoch, so no word is
    taken more than twice. Null texts have size 0 and take part with 0 words; repeated rows count each; an empty table gives
    no rows; further columns are ignored. A source may hold any part of the rows: prefix sums go over digest buckets.
    The sources' names are gathered on the driver, one row each.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), (F.lit(None).cast("long") if key is None else key).alias("key"))
    slim = slim.withColumn("k", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slim = common.materialize(slim.withColumn("rid", F.monotonically_increasing_id()))
    sources = [(r["source"], r["n"], r["size"]) for r in slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()]
    sources.sort(key=lambda r: (r[0] is None, r[0] or ""))
    own = [weights[i % len(weights)] for i in range(len(sources))]
    goal = targets([s for _, _, s in sources], own, share * sum(s for _, _, s in sources))
    rows, lo = [], 0.0
    for i, ((name, _, size), (num, den)) in enumerate(zip(sources, goal, strict=True)):
        words = (2 * num + den) // (2 * den)
        blocks = -(-size // block)
        quota = (words // size) * blocks + -(-(words % size) // block) if size else 0
        rows.append([i, name, size, num / den, words, blocks, quota])
    slots = sum(r[-1] for r in rows)
    for r in rows:
        hi = lo + r[-1] / max(1, slots)
        r += [lo, hi]
        lo = hi
    plan = common.local_table(spark, rows, "src int, source string, source_size long, target double, words long, blocks long, quota long, lo double, hi double")
    most = max([n for _, n, _ in sources], default=0)
    digits = next(d for d in range(1, 9) if most / 16**d <= 1000 or d == 8)
    named = slim.join(plan.select("src", "source", "source_size", "target"), slim["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    named = named.withColumn("bucket", F.substring("k", 1, digits))
    sums = named.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("k", "doc_id", "size", "rid")
    at = named.withColumn("own", F.sum("size").over(inside) - F.col("size")).join(sums, ["src", "bucket"])
    at = at.select("rid", "src", "size", (F.col("own") + F.col("before")).alias("start"))
    pieces = at.where("size > 0").select(
        "rid", "src", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("e"),
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"),
    )
    order = schedule(spark, plan, slots).join(plan.select("src", "blocks", "source_size", "words"), "src")
    order = order.select(
        "slot", "src", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"),
        F.least(F.col("source_size"), (F.col("rank") % F.col("blocks") + 1) * block, F.col("words") - F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size")).alias("until"),
    )
    first = F.greatest("a", F.col("block") * block)
    taken = order.join(pieces, ["src", "block"]).select("slot", "src", "epoch", "rid", (first - F.col("a")).alias("start"), (F.least("e", "until") - first).alias("words")).where("words > 0")
    per = taken.groupBy("rid").agg(F.sum("words").alias("taken"))
    out = named.join(per, "rid", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "key")
    return (out.drop("key") if key is None else out), taken


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))[0]


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their texts and columns, and size, source_size, target and taken of the mix (in place of columns of these names): a
    document's words are to be taken taken / size times. Rows that repeat doc_id, source and text share their words evenly, the rest going
    to any of them; nulls and empty tables are as in mix."""
    names = ["size", "source_size", "target", "taken"]
    id_, src, th, rest, times = common.fresh(docs, "mix_id", "mix_source", "mix_text", "mix_rest", "mix_times")
    per = mix(docs, key=F.xxhash64("text"))[0].groupBy(F.col("doc_id").alias(id_), F.col("source").alias(src), F.col("key").alias(th)).agg(
        F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias(times)
    )
    per = common.materialize(per)
    kept = docs.drop(*names)
    same = kept["doc_id"].eqNullSafe(F.col(id_)) & kept["source"].eqNullSafe(F.col(src)) & F.xxhash64(kept["text"]).eqNullSafe(F.col(th))
    columns = [kept[c] for c in kept.columns]
    several = per.where(F.col(times) > 1)
    single = kept.join(common.sized(per, 120), same).where(F.col(times) == 1).select(*columns, *names)
    if several.isEmpty():
        return single
    met = kept.join(common.sized(common.materialize(several), 120), same)
    nth = F.row_number().over(Window.partitionBy(id_, src, th).orderBy(F.lit(1))) - 1
    shared = met.withColumn(rest, nth).withColumn("taken", F.floor(F.col("taken") / F.col(times)) + (F.col(rest) < F.col("taken") % F.col(times)).cast("long"))
    return single.unionByName(shared.select(*columns, *names))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(source_size) OVER () AS total FROM s
), o AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
), f AS (
  SELECT *, (3 * total - 4 * capped) * w > 4 * source_size * rest AS filled FROM o
), g AS (
  SELECT *, (SELECT min(struct_pack(r := source_size / w, j := i, num := CAST(3 * total - 4 * capped AS BIGINT), den := CAST(2 * rest AS BIGINT))) FROM f WHERE NOT filled) AS x FROM f
), t AS (
  SELECT source, source_size, CASE WHEN filled THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(x.num * w AS DOUBLE) / CAST(x.den AS DOUBLE) END AS target FROM g
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(a + size, goal % source_size) - a) END AS BIGINT) AS taken
FROM p
"""
