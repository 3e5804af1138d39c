"""Best hits, votes, ranks and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.columns import symmetric_difference_size


def best_hit(hits: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of the highest score for each key; ties go to the first by `ties`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def majority(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """keys + (value, n): the most frequent value; of equally frequent ones the one seen first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("_p"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_p", value)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")


def consensus(hits: DataFrame) -> DataFrame:
    """(haplo, ref, matches, length, pid) from (haplo, gene, ref, matches, length): the best match count for each gene and reference,
    summed over genes; the reference with most matches."""
    best = hits.groupBy("haplo", "gene", "ref").agg(F.max(F.struct("matches", "length")).alias("b"))
    sums = best.groupBy("haplo", "ref").agg(F.sum("b.matches").alias("matches"), F.sum("b.length").alias("length"))
    return best_hit(sums, ["haplo"], "matches", ["ref"]).withColumn("pid", F.col("matches") / F.col("length"))


def marginal_uncertainty(marginals: DataFrame) -> DataFrame:
    """(g, uncertainty): mean over genes of the mean distance of p from 0 or 1; marginals: (gene, unitig, g, p)."""
    per = marginals.groupBy("g", "gene").agg(F.avg(F.abs(F.col("p") - F.round("p"))).alias("u"))
    return per.groupBy("g").agg(F.avg("u").alias("uncertainty"))


def rank_strains(gamma: DataFrame) -> DataFrame:
    """(g, intensity, rank): by summed intensity, largest first."""
    total = gamma.groupBy("g").agg(F.sum("value").alias("intensity"))
    return total.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("intensity"), "g")))  # strains are few


def merge_strains(gamma: DataFrame, signature: DataFrame) -> DataFrame:
    """(g, head, intensity): strains of one signature (g, path) merge into the one of highest intensity."""
    total = gamma.groupBy("g").agg(F.sum("value").alias("intensity"))
    w = Window.partitionBy("path").orderBy(F.desc("intensity"), "g")
    return total.join(signature, "g").select("g", F.first("g").over(w).alias("head"), "intensity")


def drop_weakest(gamma: DataFrame, least: float) -> DataFrame:
    """(g, intensity, kept): at most the weakest strain goes, if its intensity is under least and it is not the only one."""
    total = rank_strains(gamma)
    n = total.agg(F.max("rank").alias("n"))
    return total.crossJoin(F.broadcast(n)).select("g", "intensity", (~((F.col("rank") == F.col("n")) & (F.col("n") > 1) & (F.col("intensity") < least))).alias("kept"))


def path_distances(paths: DataFrame) -> DataFrame:
    """(g, h, distance), g < h: symmetric differences of node sets (gene, g, nodes array), summed over genes where both have nodes."""
    a = paths.where(F.size("nodes") > 0)
    b = a.select("gene", F.col("g").alias("h"), F.col("nodes").alias("other"))
    return a.join(b, "gene").where("g < h").groupBy("g", "h").agg(F.sum(symmetric_difference_size(F.col("nodes"), F.col("other"))).alias("distance"))


def path_divergence(samples: DataFrame, best: DataFrame) -> DataFrame:
    """(g, divergence): mean over samples of the symmetric difference to the best path, over the best paths' total length; samples:
    (gene, g, sample, nodes), best: (gene, g, nodes)."""
    ref = best.select("gene", "g", F.col("nodes").alias("ref"))
    d = samples.join(ref, ["gene", "g"]).groupBy("g", "sample").agg((F.sum(symmetric_difference_size(F.col("nodes"), F.col("ref"))) / F.sum(F.size("ref"))).alias("d"))
    return d.groupBy("g").agg(F.avg("d").alias("divergence"))


def exact_assignments(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """(unitig, genomes): references that match a whole segment at 100 percent; hits: (unitig, ref, pid, aligned), lengths: (unitig, len)."""
    full = hits.join(lengths, "unitig").where((F.col("pid") == 100) & (F.col("aligned") == F.col("len")))
    return full.groupBy("unitig").agg(F.array_sort(F.collect_set("ref")).alias("genomes"))


def with_default(rows: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    return rows.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def path_uncertainty(paths: DataFrame, marginals: DataFrame) -> DataFrame:
    """(g, uncertainty): the mean of 1 - p over the nodes of all paths (gene, g, node) of each strain; marginals: (gene, g, node, p), 0 where a node has none."""
    met = paths.select("gene", "g", "node").distinct().join(marginals, ["gene", "g", "node"], "left")
    return met.groupBy("g").agg(F.avg(1 - F.coalesce("p", F.lit(0.0))).alias("uncertainty"))
