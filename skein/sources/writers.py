"""Sinks: graphs, coverage, colours and the outputs of a strain fit, written by Spark as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.sequence import walk_sequences
from skein.operators import factorgraph, graph


def gfa(unitigs: DataFrame, links: DataFrame, path: str, colors: DataFrame | None = None) -> None:
    """S lines with length and k-mer count (and colour, grey if a segment has none); each pair of twin links once."""
    cols = [F.lit("S"), "unitig", "seq", F.concat(F.lit("LN:i:"), F.col("len")), F.concat(F.lit("KC:i:"), F.coalesce("kc", F.lit(0)))]
    if colors is not None:
        unitigs = unitigs.join(colors.select("unitig", "color"), "unitig", "left")
        cols.append(F.concat(F.lit("CL:z:#"), F.coalesce("color", F.lit("d3d3d3"))))
    s = unitigs.select(F.lit(0).alias("o"), F.concat_ws("\t", *cols).alias("value"))
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    ahead = F.struct("src", "src_fwd", "dst", "dst_fwd")
    twin = F.struct(F.col("dst").alias("src"), (~F.col("dst_fwd")).alias("src_fwd"), F.col("src").alias("dst"), (~F.col("src_fwd")).alias("dst_fwd"))
    once = links.select("gene", F.least(ahead, twin).alias("l"), "overlap").distinct().select("l.*", "overlap")
    lines = once.select(F.lit(1).alias("o"), F.concat_ws("\t", F.lit("L"), "src", sign("src_fwd"), "dst", sign("dst_fwd"), F.concat("overlap", F.lit("M"))).alias("value"))
    s.union(lines).repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def coverage(cov: DataFrame, path: str, sep: str = ",") -> None:
    rows = cov.groupBy("gene", "unitig").agg(F.array_sort(F.collect_list(F.struct("sample", "cov"))).alias("c"))
    rows.select(F.concat_ws(sep, "unitig", F.concat_ws(sep, F.transform("c", lambda x: x["cov"].cast("string")))).alias("value")).write.mode("overwrite").text(path)


def node_and_edge_tables(edges: DataFrame, path: str) -> None:
    """Nodes with ids and edges between ids, as two CSV tables."""
    edges = graph.settle(edges)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("id", F.xxhash64("node"))
    nodes.write.mode("overwrite").csv(f"{path}/nodes", header=True)
    edges.select(F.xxhash64("u").alias("from"), F.xxhash64("v").alias("to"), *[c for c in edges.columns if c not in ("u", "v")]).write.mode("overwrite").csv(f"{path}/edges", header=True)


def fasta(records: DataFrame, path: str) -> None:
    """records: (name, seq)."""
    records.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def table(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=sep)


def fit(outputs: dict[str, DataFrame], stub: str) -> None:
    """Every output of a strain fit under its name: haplotypes as FASTA, the rest as CSV."""
    for name, df in outputs.items():
        if name.startswith("Haplo"):
            fasta(df, f"{stub}{name}")
        else:
            table(df, f"{stub}{name}")


def graph_tables(edges: DataFrame, cov: DataFrame, sources: DataFrame, sinks: DataFrame, path: str) -> None:
    """Of the nodes that a source leads to and that lead to a sink: a GraphML file, nodes with numbers, names and coverages, and edges between the
    numbers. edges (gene, u, v), cov (unitig, sample, cov), sources and sinks (gene, node); numbers are hashes of gene and name."""
    held = graph.settle(graph.core(edges, sources, sinks))
    kept = graph.settle(graph.subgraph(edges, held).select("gene", "u", "v"))
    number = lambda c: F.xxhash64("gene", c)
    wide = cov.groupBy("unitig").agg(F.array_sort(F.collect_list(F.struct("sample", "cov"))).alias("c")).select("unitig", F.concat_ws(",", F.transform("c", lambda x: x["cov"].cast("string"))).alias("c"))
    nodes = held.withColumn("unitig", F.regexp_replace("node", "[+-]$", "")).join(wide, "unitig", "left")
    nodes.select(F.concat_ws(",", number("node"), "node", F.coalesce("c", F.lit(""))).alias("value")).write.mode("overwrite").text(f"{path}/nodes.csv")
    kept.select(F.concat_ws(",", number("u"), number("v")).alias("value")).write.mode("overwrite").text(f"{path}/edges.csv")
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="directed">']
    line = lambda o, rows: edges.sparkSession.createDataFrame([(o, x) for x in rows], "o int, value string")
    body = held.select(F.lit(1).alias("o"), F.concat(F.lit('<node id="'), "node", F.lit('"/>')).alias("value"))
    body = body.union(kept.select(F.lit(2).alias("o"), F.concat(F.lit('<edge source="'), "u", F.lit('" target="'), "v", F.lit('"/>')).alias("value")))
    whole = line(0, ["\n".join(head)]).union(body).union(line(3, ["</graph>\n</graphml>"]))
    whole.repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(f"{path}/graph.graphml")


def factor_graphs(edges: DataFrame, weights: DataFrame, path: str) -> None:
    """A text file of factors for each gene, in a folder gene=...: edges (gene, u, v) from source+ to sink+, weights (gene, node, weight)."""
    rows = edges.select("gene", "u", "v").unionByName(weights.select("gene", F.col("node").alias("u"), "weight"), allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links, own = pdf[pdf["v"].notna()], pdf[pdf["v"].isna()]
        made = factorgraph.path_factors(list(zip(links["u"], links["v"], strict=True)), dict(zip(own["u"], own["weight"], strict=True)), {"source+"}, {"sink+"})
        return pd.DataFrame({"gene": [str(pdf["gene"].iloc[0])], "value": [made.text()]})

    rows.groupBy("gene").applyInPandas(run, "gene string, value string").write.mode("overwrite").partitionBy("gene").text(path)


def posterior_parameters(mu: DataFrame, tau: DataFrame, stub: str) -> None:
    """Location and precision of each intensity, without headers: (g, s, value)."""
    for name, df in (("muGamma.csv", mu), ("tauGamma.csv", tau)):
        rows = df.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("s", "value"))).alias("c"))
        rows.orderBy("g").select(F.concat_ws(",", F.transform("c", lambda x: x["value"].cast("string"))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{stub}{name}")  # strains are few


def reference_paths(paths: DataFrame, segments: DataFrame, overlap: int, path: str) -> None:
    """Sequences of the best paths of references (ref, gene, pos, unitig, forward), one record for each; segments: (unitig, seq)."""
    walks = walk_sequences(paths, segments, overlap, ["ref", "gene"])
    fasta(walks.select(F.concat_ws("_", "ref", "gene").alias("name"), "seq"), path)


def fold_summary(scores: DataFrame, path: str) -> None:
    """Means over folds by number of strains, in order: scores (n_strains, fold, and one column for each score)."""
    own = [c for c in scores.columns if c not in ("n_strains", "fold")]
    scores.groupBy("n_strains").agg(*[F.avg(c).alias(f"mean_{c}") for c in own]).withColumnRenamed("n_strains", "No_strains").orderBy("No_strains").coalesce(1).write.mode("overwrite").csv(path, header=True)


def summary(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
