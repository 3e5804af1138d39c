"""Annotated and combined graphs: strain colours, gene graphs joined along strains, components, contig and segment bins."""

from __future__ import annotations

import colorsys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.columns import mean_color
from skein.functions.sequence import unitig_of

from . import graph, ranking
from .iteration import ranked

GREY = "D3D3D3"


def palette(n: int) -> list[str]:
    """n evenly spaced hues as RRGGBB."""
    return ["".join(f"{round(255 * c):02X}" for c in colorsys.hls_to_rgb(i / max(1, n), 0.55, 0.75)) for i in range(n)]


def segment_colors(paths: DataFrame, colors: DataFrame) -> DataFrame:
    """(unitig, color, strains): the mean colour of the strains (strain, color) that pass each segment of paths (strain, unitig)."""
    used = paths.select("strain", "unitig").distinct().join(colors, "strain")
    per = used.groupBy("unitig").agg(F.array_sort(F.collect_list(F.struct("strain", "color"))).alias("s"))
    return per.select("unitig", mean_color(F.transform("s", lambda x: x["color"])).alias("color"), F.concat_ws(",", F.transform("s", lambda x: x["strain"])).alias("strains"))


def colored(unitigs: DataFrame, colors: DataFrame) -> DataFrame:
    """unitigs with color, grey where no strain passes."""
    return ranking.with_default(unitigs, colors, "unitig", "color", GREY)


def joined_genes(paths: DataFrame, spacer: int = 100) -> tuple[DataFrame, DataFrame]:
    """(segments, links) that join each strain's genes, in order of their names: between the last node of one gene and the first of the
    next lies a segment of `spacer` N. paths: (strain, gene, pos, unitig, forward); segment names are gene_unitig."""
    ends = paths.groupBy("strain", "gene").agg(F.min_by(F.struct("unitig", "forward"), "pos").alias("first"), F.max_by(F.struct("unitig", "forward"), "pos").alias("last"))
    w = Window.partitionBy("strain").orderBy("gene")
    steps = ends.select("strain", "gene", "last", F.lead("gene").over(w).alias("next"), F.lead("first").over(w).alias("to")).where("next is not null")
    steps = steps.withColumn("buffer", F.concat_ws("_", F.lit("join"), "gene", "next", "strain"))
    segments = steps.select(F.col("buffer").alias("unitig"), F.repeat(F.lit("N"), spacer).alias("seq"), F.lit(spacer).alias("len"))
    name = lambda g, s: F.concat_ws("_", F.col(g), F.col(f"{s}.unitig"))
    into = steps.select(name("gene", "last").alias("src"), F.col("last.forward").alias("src_fwd"), F.col("buffer").alias("dst"), F.lit(True).alias("dst_fwd"), F.lit(0).alias("overlap"))
    out = steps.select(F.col("buffer").alias("src"), F.lit(True).alias("src_fwd"), name("next", "to").alias("dst"), F.col("to.forward").alias("dst_fwd"), F.lit(0).alias("overlap"))
    return segments, into.union(out)


def segment_components(links: DataFrame) -> DataFrame:
    """(unitig, component, size, rank): connected segments, the largest component first."""
    e = links.select(F.lit(0).alias("gene"), F.col("src").cast("string").alias("u"), F.col("dst").cast("string").alias("v"))
    label = graph.components(e).select(F.col("node").alias("unitig"), "component")
    sizes = label.groupBy("component").agg(F.count("*").alias("size"))
    return label.join(ranked(sizes, F.desc("size"), F.asc("component")), "component").select("unitig", "component", "size", "rank")


def contig_bins(paths: DataFrame, bins: DataFrame) -> DataFrame:
    """(contig, bin): the most frequent bin among a contig's segments, the earliest of equally frequent ones; -1 where no segment has one.
    paths: (contig, pos, unitig), bins: (unitig, bin)."""
    steps = ranking.with_default(paths, bins, "unitig", "bin", -1)
    known = ranking.majority(steps.where("bin >= 0"), ["contig"], "bin", "pos").select("contig", "bin")
    return ranking.with_default(steps.select("contig").distinct(), known, "contig", "bin", -1)


def unitig_bins(paths: DataFrame, bins: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """(unitig, bin, n_contigs[, cov]): the bin of most contigs through each segment; paths: (contig, unitig), bins: (contig, bin),
    coverage: (contig, cov), averaged."""
    steps = paths.select("contig", "unitig").distinct().join(bins, "contig")
    out = ranking.majority(steps, ["unitig"], "bin", "bin").withColumnRenamed("n", "n_contigs")
    if coverage is not None:
        out = out.join(paths.select("contig", "unitig").distinct().join(coverage, "contig").groupBy("unitig").agg(F.avg("cov").alias("cov")), "unitig", "left")
    return out


def best_gene_hits(hits: DataFrame, least_coverage: float) -> DataFrame:
    """The hit of lowest e-value for each query and gene (query, gene, evalue, coverage), the first of equal ones by query name."""
    good = hits.where(F.col("coverage") >= least_coverage).withColumn("score", -F.col("evalue"))
    return ranking.best_hit(good, ["gene"], "score", ["query"]).drop("score")


def through_strains(paths: DataFrame) -> DataFrame:
    """(unitig, strains) of node paths (strain, node)."""
    return paths.select("strain", unitig_of(F.col("node")).alias("unitig")).groupBy("unitig").agg(F.array_sort(F.collect_set("strain")).alias("strains"))
