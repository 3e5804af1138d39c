"""Coverage: (gene, unitig, sample, cov) rows joined with segments (gene, unitig, len)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_factor(read_length: int, overlap: int) -> float:
    """k-mer coverage times this is read coverage."""
    return read_length / (read_length - overlap + 1)


def adjust(coverage: DataFrame, unitigs: DataFrame, read_length: int, overlap: int) -> DataFrame:
    """Adds adj_len = len - 2 overlap + read length, x = cov adj_len factor / read length (expected reads), and xn = x / adj_len, for
    segments of positive adjusted length."""
    adj = F.col("len") - 2 * overlap + read_length
    factor = read_factor(read_length, overlap)
    joined = coverage.join(unitigs.select("gene", "unitig", adj.cast("double").alias("adj_len")).where("adj_len > 0"), ["gene", "unitig"])
    return joined.withColumn("x", F.col("cov") * F.col("adj_len") * F.lit(factor) / F.lit(float(read_length))).withColumn("xn", F.col("x") / F.col("adj_len"))


def select_samples(coverage: DataFrame, factor: float, least: float, share: float) -> DataFrame:
    """(sample, mean_cov, kept): mean over all genes' segments times factor; kept if above max(least, share of the largest mean)."""
    means = coverage.groupBy("sample").agg((F.avg("cov") * F.lit(factor)).alias("mean_cov"))
    top = means.agg(F.max("mean_cov").alias("top"))
    return means.join(F.broadcast(top)).select("sample", "mean_cov", (F.col("mean_cov") > F.greatest(F.lit(least), F.lit(share) * F.col("top"))).alias("kept"))


def mean_coverage(coverage: DataFrame, unitigs: DataFrame, length: float) -> DataFrame:
    """(gene, sample, mean_cov): sum of len * cov over a given length."""
    return coverage.join(unitigs.select("gene", "unitig", "len"), ["gene", "unitig"]).groupBy("gene", "sample").agg((F.sum(F.col("len") * F.col("cov")) / F.lit(float(length))).alias("mean_cov"))


#: Steps of paths that one partition fans out over its segments' samples.
STEPS = 1 << 17


def path_coverage(paths: DataFrame, coverage: DataFrame, unitigs: DataFrame, overlap: int, keys: list[str], parts: int | None = None) -> DataFrame:
    """keys + (sample, path_cov): mean along paths (keys, pos, gene, unitig), weighted by len - overlap, the last by its whole length; paths without weight are left out. Where paths have no
    gene, segments are looked up by unitig alone.

    Paths meet in the partitions that they come in by their keys. A segment's samples go once to each partition that has it, with all its steps there, and fan out there: dealt by ranges of
    keys, paths that share segments share what is moved. parts: how many partitions these are, if not as many as a shuffle has."""
    on, at, w = [c for c in ("gene", "unitig") if c in paths.columns], [*keys, "sample"], Window.partitionBy(*keys)
    steps = paths.withColumn("last", F.max("pos").over(w)).select(*on, F.spark_partition_id().alias("_part"), F.struct(*keys, (F.col("pos") == F.col("last")).alias("_last")).alias("_step"))
    steps = steps.repartition(*on).groupBy(*on, "_part").agg(F.collect_list("_step").alias("_steps"))
    covered = coverage.groupBy(*on).agg(F.collect_list(F.struct("sample", "cov")).alias("_cov"))
    met = steps.join(unitigs.select(*on, "len"), on).join(covered, on)
    met = met.repartitionById(parts or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("_part"))
    met = met.select("_part", "len", "_cov", F.explode("_steps").alias("_step"))
    weight = F.when(F.col("_step._last"), F.col("len")).otherwise(F.col("len") - overlap).cast("double")
    met = met.select("_part", *[F.col("_step")[k].alias(k) for k in keys], weight.alias("_weight"), F.inline("_cov").alias("sample", "_c"))
    sums = met.groupBy("_part", *at).agg(F.sum(F.col("_weight") * F.col("_c")).alias("_sum"), F.sum("_weight").alias("_all")).where("_all > 0")
    return sums.select(*at, (F.col("_sum") / F.col("_all")).alias("path_cov"))


def noise_nodes(x: DataFrame, share: float) -> DataFrame:
    """(gene, unitig, total, noise): segments whose summed x is under share times the mean sum of their gene."""
    total = x.groupBy("gene", "unitig").agg(F.sum("x").alias("total"))
    return total.select("gene", "unitig", "total", (F.col("total") < F.lit(share) * F.avg("total").over(Window.partitionBy("gene"))).alias("noise"))


def role_coverage(coverage: DataFrame, roles: DataFrame) -> DataFrame:
    """(gene, sample, end_cov): mean of the summed coverage of sources and of sinks; roles: (gene, unitig, role)."""
    return coverage.join(roles, ["gene", "unitig"]).groupBy("gene", "sample", "role").agg(F.sum("cov").alias("c")).groupBy("gene", "sample").agg(F.avg("c").alias("end_cov"))


def gates(x: DataFrame, low: float = 100.0) -> DataFrame:
    """One row: n_samples, total, spread and what they allow: use_bias (two samples and more), use_noise (total of low and more),
    tau (fixed where the spread above the least positive x is under low, else log)."""
    s = x.agg(F.countDistinct("sample").alias("n_samples"), F.sum("x").alias("total"), (F.max("x") - F.min(F.when(F.col("x") > 0, F.col("x")))).alias("spread"))
    return s.select("*", (F.col("n_samples") >= 2).alias("use_bias"), (F.col("total") >= low).alias("use_noise"), F.when((F.col("n_samples") < 2) | (F.col("spread") < low), "fixed").otherwise("log").alias("tau"))
