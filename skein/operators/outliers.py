"""Robust filters by median absolute deviation, and duplicate sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_mad(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Adds dev (distance from the group's median) and mad (median of dev)."""
    return _spread(df, value, keys).withColumn("dev", F.abs(F.col(value) - F.col("med")))


def _spread(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    joined = _join(df, med, keys)
    mad = joined.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return _join(joined, mad, keys)


def _join(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # a single row


def inside(dev: Column, mad: Column, m: float) -> Column:
    return F.when(mad == 0, F.lit(True)).otherwise(dev / mad < m)


def outlier_genes(means: DataFrame, m: float, share: float) -> DataFrame:
    """(gene, n_inside, outlier) from (gene, sample, value): a gene fails if it lies inside the samples' MAD bands in fewer than share of
    all samples."""
    marked = with_mad(means, "value", ["sample"]).withColumn("ok", inside(F.col("dev"), F.col("mad"), m).cast("long"))
    n = means.agg(F.countDistinct("sample").alias("n"))
    per = marked.groupBy("gene").agg(F.sum("ok").alias("n_inside"))
    return per.crossJoin(F.broadcast(n)).select("gene", "n_inside", (F.col("n_inside") < F.lit(share) * F.col("n")).alias("outlier"))


def filter_genes(errors: DataFrame, m: float = 3.0) -> DataFrame:
    """(gene, error, kept): one-sided; a gene goes if its error is above the median by more than m MADs."""
    marked = with_mad(errors, "error", [])
    return marked.select("gene", "error", (~((F.col("dev") > m * F.col("mad")) & (F.col("error") > F.col("med")))).alias("kept"))


def duplicate_sequences(rows: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """Rows with their rank among rows of equal sequence and the first such row's order columns as first_<column>."""
    digest = F.sha2(F.col(seq), 256)
    firsts = rows.groupBy(digest.alias("digest")).agg(F.min(F.struct(*order)).alias("f"))
    marked = rows.withColumn("digest", digest).join(firsts, "digest")
    same = F.struct(*order) == F.col("f")
    return marked.select(*order, *[F.col(f"f.{c}").alias(f"first_{c}") for c in order], (~same).alias("degenerate"))


def closure_of_removed(removed: DataFrame, maps: DataFrame, rounds: int = 50) -> DataFrame:
    """Genes removed plus all that map to a removed one, over any number of steps; maps: (gene, to)."""
    out = removed.select("gene").distinct()
    for _ in range(rounds):
        more = maps.join(out.withColumnRenamed("gene", "to"), "to").select("gene").subtract(out)
        if more.isEmpty():
            return out
        out = out.union(more)
    return out
