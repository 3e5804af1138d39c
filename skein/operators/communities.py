"""Strain fits of many communities side by side: one group, one model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pathmodel import given, some
from .strains import Gene, StrainModel


def model_of(edges: pd.DataFrame, counts: pd.DataFrame, strains: int, seed: int, **options) -> tuple[StrainModel, list[tuple], list]:
    """A model of edges (gene, u, v; from source+ to sink+) and counts (gene, unitig, sample, x, len), its row keys and samples."""
    keys = sorted(set(zip(counts["gene"], counts["unitig"], strict=True)), key=str)
    at, samples = {k: i for i, k in enumerate(keys)}, sorted(counts["sample"].unique())
    column = {s: j for j, s in enumerate(samples)}
    x, length = np.zeros((len(keys), len(samples))), np.ones(len(keys))
    for g, u, s, v, n in zip(counts["gene"], counts["unitig"], counts["sample"], counts["x"], counts["len"], strict=True):
        x[at[g, u], column[s]] += v
        length[at[g, u]] = n
    genes = []
    for g, part in sorted(edges.groupby("gene"), key=lambda p: str(p[0])):
        own = sorted({n[:-1] for e in zip(part["u"], part["v"], strict=True) for n in e if n not in ("source+", "sink+")})
        if all((g, u) in at for u in own):
            genes.append(Gene(str(g), sorted(zip(part["u"], part["v"], strict=True)), {u: at[g, u] for u in own}))
    return StrainModel(genes, x, length, strains, seed, **options), keys, samples


def _rows(edges: DataFrame, counts: DataFrame) -> DataFrame:
    none = F.lit(None)
    e = edges.select("community", "gene", "u", "v", none.cast("string").alias("unitig"), none.cast("string").alias("sample"), none.cast("double").alias("x"), none.cast("double").alias("len"))
    c = counts.select("community", "gene", none.cast("string").alias("u"), none.cast("string").alias("v"), F.col("unitig").cast("string").alias("unitig"), F.col("sample").cast("string").alias("sample"), F.col("x").cast("double").alias("x"), F.col("len").cast("double").alias("len"))
    return e.union(c)


def fit_strains(edges: DataFrame, counts: DataFrame, strains: int, seed: int = 1, rounds: int = 60, restarts: int = 1, least: float = 0.0) -> DataFrame:
    """(community, strain, intensity, path_length, divergence, elbo): each community's surviving strains."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_edge = pdf["u"].notna()
        model, _, _ = model_of(pdf[is_edge], pdf[~is_edge], strains, seed)
        model.initialise(restarts, 50)
        bound = model.update(rounds, least)[-1]
        away, total = model.divergence(20), model.gamma[: model.g].sum(1)
        order = np.argsort(-total, kind="stable")
        return some({
            "community": [pdf["community"].iloc[0]] * model.g, "strain": list(range(model.g)), "intensity": [float(total[g]) for g in order],
            "path_length": [sum(map(len, model.paths[g].values())) for g in order], "divergence": [float(away[g]) for g in order], "elbo": [bound] * model.g,
        })

    schema = T.StructType([edges.schema["community"], *[T.StructField(n, t) for n, t in (("strain", T.IntegerType()), ("intensity", T.DoubleType()), ("path_length", T.IntegerType()), ("divergence", T.DoubleType()), ("elbo", T.DoubleType()))]])
    return given(_rows(edges, counts).groupBy("community").applyInPandas(run, schema))


def choose_strains(edges: DataFrame, counts: DataFrame, most: int, folds: int = 3, seed: int = 1, rounds: int = 30) -> DataFrame:
    """(community, n_strains, fold, surviving, score): every number of strains on every fold of every community, each a task's group."""
    spark = edges.sparkSession
    grid = F.broadcast(spark.range(1, most + 1).select(F.col("id").cast("int").alias("n_strains")).crossJoin(spark.range(folds).select(F.col("id").cast("int").alias("fold"))))
    rows = _rows(edges, counts).crossJoin(grid)  # a few copies of each community's rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, fold, is_edge = int(pdf["n_strains"].iloc[0]), int(pdf["fold"].iloc[0]), pdf["u"].notna()
        model, _, _ = model_of(pdf[is_edge], pdf[~is_edge], n, seed + fold)
        of = np.random.default_rng(seed).integers(0, folds, model.x.shape)
        model.mask = (of != fold).astype(float)
        model.mask[:, model.mask.sum(0) == 0] = model.mask[model.mask.sum(1) == 0] = 1
        model.initialise(1, 30)
        model.update(rounds, None)
        return pd.DataFrame({"community": [pdf["community"].iloc[0]], "n_strains": [n], "fold": [fold], "surviving": [model.g], "score": [model.map_score((of == fold).astype(float))]})

    schema = T.StructType([edges.schema["community"], *[T.StructField(n, t) for n, t in (("n_strains", T.IntegerType()), ("fold", T.IntegerType()), ("surviving", T.IntegerType()), ("score", T.DoubleType()))]])
    return rows.groupBy("community", "n_strains", "fold").applyInPandas(run, schema)
