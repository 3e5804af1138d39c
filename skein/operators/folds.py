"""Cross-validation folds over observed cells (v, s)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_folds(cells: DataFrame, k: int, key: list[str]) -> DataFrame:
    """A fold for each cell from a digest of its key: the same whatever the partitioning, without a shuffle."""
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key]))
    return cells.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int"))


def stratified_folds(cells: DataFrame, k: int, by: str, order: list[str]) -> DataFrame:
    """Folds dealt in turn within each row (or column) `by`."""
    return cells.withColumn("fold", ((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) % k).cast("int"))


def hold_out(cells: DataFrame, share: float, key: list[str]) -> DataFrame:
    """Cells with held (boolean): about this share, by digest."""
    return hash_folds(cells, 1_000_000, key).withColumn("held", F.col("fold") < int(share * 1_000_000)).drop("fold")


def uncovered(cells: DataFrame, row: str, column: str) -> DataFrame:
    """Folds that leave a row or a column without any training cell: (fold, kind, id). Empty if all folds are usable."""
    folds = cells.select("fold").distinct()
    out = None
    for kind in (row, column):
        per = cells.groupBy(kind, "fold").agg(F.count("*").alias("n"))
        total = cells.groupBy(kind).agg(F.count("*").alias("all"))
        bad = per.join(total, kind).where(F.col("n") == F.col("all")).select("fold", F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("id"))
        out = bad if out is None else out.union(bad)
    return out.join(folds, "fold", "left_semi")


def summary(scores: DataFrame) -> DataFrame:
    """(n_strains, runs, mean_score, best) from (n_strains, score); best marks the highest mean."""
    means = scores.groupBy("n_strains").agg(F.count("*").alias("runs"), F.avg("score").alias("mean_score"))
    return means.withColumn("best", F.row_number().over(Window.orderBy(F.desc("mean_score"), "n_strains")) == 1)  # one row for each number of strains
