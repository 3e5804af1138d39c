"""Queries that write a file with a sink (or as plain text, where there is none) into the shared folder and read it with a scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import factorgraph
from skein.operators.iteration import shared_path
from skein.sources import readers, writers

from . import domain
from .catalogue import BIGRAPH, query
from .domain import COVERAGE, LAYERED, LINKS, table

GENE = "COG0001"


def _text(df: DataFrame, name: str, *columns, sep: str = "\t") -> str:
    """The columns as lines of a file."""
    path = shared_path(df.sparkSession, f"{GENE}.{name}")
    df.select(F.concat_ws(sep, *columns).alias("value")).write.text(path)
    return path


def _graph(spark, d):
    part = table(spark, d, "part")
    unitigs = part.select(F.lit("").alias("gene"), F.col("p_partkey").alias("unitig"), F.col("p_name").alias("seq"), F.char_length("p_name").alias("len"), F.col("p_size").alias("kc"))
    path = shared_path(spark, f"{GENE}.gfa")
    writers.gfa(unitigs, domain.links(spark, d).withColumn("gene", F.lit("")).distinct().withColumn("overlap", F.lit(3)), path)
    return readers.gfa(spark, path)


@query(f"""SELECT '{GENE}' AS gene, CAST(p_partkey AS VARCHAR) AS unitig, p_name AS seq, CAST(p_size AS BIGINT) AS kc, CAST(length(p_name) AS INTEGER) AS len FROM part""")
def gfa_segments(spark, d):
    return _graph(spark, d)[0]


@query(f"""WITH {LINKS}, o AS (SELECT DISTINCT CASE WHEN (src, src_fwd, dst, dst_fwd) <= (dst, NOT dst_fwd, src, NOT src_fwd) THEN (src, src_fwd, dst, dst_fwd) ELSE (dst, NOT dst_fwd, src, NOT src_fwd) END AS t FROM links)
SELECT '{GENE}' AS gene, CAST(t[1] AS VARCHAR) AS src, t[2] AS src_fwd, CAST(t[3] AS VARCHAR) AS dst, t[4] AS dst_fwd, CAST(3 AS INTEGER) AS overlap FROM o""")
def gfa_links(spark, d):
    return _graph(spark, d)[1]


@query("SELECT '' AS gene, 'u' || p_partkey AS unitig, p_name AS seq, CAST(p_size AS BIGINT) AS kc, CAST(length(p_name) AS INTEGER) AS len FROM part")
def unitig_fasta(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("u"), "p_partkey", F.lit(" LN:i:1 KC:i:"), "p_size", F.lit(" km:f:1.0 L:+:u1:-")).alias("name"), F.col("p_name").alias("seq"))
    path = shared_path(spark, "unitigs.fa")
    writers.fasta(part, path)
    return readers.bcalm(spark, path)[0].select("gene", "unitig", "seq", "kc", "len")


@query(f"WITH {COVERAGE}, s AS (SELECT unitig, sample, cov, row_number() OVER (PARTITION BY unitig ORDER BY sample) - 1 AS i FROM cov) SELECT '{GENE}' AS gene, CAST(unitig AS VARCHAR) AS unitig, CAST(i AS INTEGER) AS sample, cov FROM s")
def coverage_table(spark, d):
    path = shared_path(spark, f"{GENE}.csv")
    writers.coverage(domain.coverage(spark, d), path)
    return readers.coverage(spark, path, ",")


@query("SELECT p_brand AS gene, CAST(max(p_size) AS DOUBLE) AS aa_len FROM part GROUP BY 1")
def gene_length_table(spark, d):
    path = shared_path(spark, "lengths.tsv")
    writers.table(table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size")), path, header=False, sep="\t")
    return readers.gene_lengths(spark, path)


@query(f"SELECT '{GENE}' AS gene, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS nth, CAST(s_suppkey AS VARCHAR) AS unitig, s_nationkey % 2 = 0 AS forward FROM supplier")
def stop_codons(spark, d):
    rows = table(spark, d, "supplier").orderBy("s_suppkey").coalesce(1)
    return readers.stops(spark, _text(rows, "stops", "s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "+").otherwise("-"), F.lit("-1")))


@query(f"SELECT '{GENE}' AS gene, CAST(s_suppkey AS VARCHAR) AS unitig FROM supplier")
def dead_end_list(spark, d):
    return readers.dead_ends(spark, _text(table(spark, d, "supplier"), "deadends", F.concat(F.lit(" "), "s_suppkey")))


@query("SELECT n_name AS gene FROM nation")
def selected_names(spark, d):
    return readers.names(spark, _text(table(spark, d, "nation"), "names", F.concat("n_name", F.lit(" "))))


@query("SELECT CAST(l_partkey AS VARCHAR) AS unitig, CAST(l_suppkey AS VARCHAR) AS hit, l_quantity AS pid, l_tax AS divergence FROM lineitem")
def reference_hit_table(spark, d):
    return readers.reference_hits(spark, _text(table(spark, d, "lineitem"), "hits", "l_partkey", "l_suppkey", "l_quantity", F.lit("x"), "l_tax"))


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS unitig, CAST(l_suppkey AS VARCHAR) AS hit FROM lineitem")
def reference_assignment_table(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("s"))
    return readers.reference_assignments(spark, _text(rows, "assigned", "l_partkey", F.concat_ws("\t", "s")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS unitig, CASE WHEN p_size % 3 > 0 THEN p_size ELSE -1 END AS start, p_size + 10 AS \"end\", p_size % 2 = 0 AS forward FROM part")
def unitig_order_table(spark, d):
    part = table(spark, d, "part")
    start = F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).otherwise("None")
    rows = readers.unitig_order(spark, _text(part, "order", "p_partkey", start, F.col("p_size") + 10, F.when(F.col("p_size") % 2 == 0, "True").otherwise("False"), sep=","))
    return rows.withColumn("start", F.coalesce("start", F.lit(-1)))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS query, CAST(l_partkey AS VARCHAR) AS ref, l_quantity AS pid, CAST(l_linenumber AS INTEGER) AS length, l_extendedprice AS bits FROM lineitem")
def blast_table(spark, d):
    path = _text(table(spark, d, "lineitem"), "blast", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber", *[F.lit("0")] * 7, "l_extendedprice")
    return readers.blast(spark, path).select("query", "ref", "pid", "length", "bits")


@query("SELECT CAST(p_partkey AS VARCHAR) AS query, p_brand AS gene, CAST(p_size AS DOUBLE) AS evalue, p_retailprice AS pid FROM part")
def gene_hit_table(spark, d):
    path = _text(table(spark, d, "part"), "besthits", "p_partkey", "p_brand", "p_size", "p_retailprice", *[F.lit("1.0")] * 3)
    return readers.gene_best_hits(spark, path).select("query", "gene", "evalue", "pid")


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM s)
SELECT 'NODE_' || l_orderkey AS contig, CAST(pos AS INTEGER) AS pos, CAST(l_partkey AS VARCHAR) AS unitig FROM r""")
def contig_path_table(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    path = _text(rows, "paths", F.concat(F.lit("NODE_"), "l_orderkey"), F.concat_ws(",", F.transform("p", lambda x: F.concat(x["l_partkey"].cast("string"), F.lit("+")))), sep="\n")
    return readers.contig_paths(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_size AS bin FROM part")
def bin_table(spark, d):
    path = shared_path(spark, "bins.csv")
    writers.table(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return readers.bins(spark, path)


@query("SELECT count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS letters, min(p_name) AS first, max(p_name) AS last FROM part")
def fastq_reads(spark, d):
    path = _text(table(spark, d, "part"), "fastq", F.concat(F.lit("@"), "p_partkey"), "p_name", F.lit("+"), F.repeat(F.lit("@"), F.char_length("p_name")), sep="\n")
    reads = readers.fastq(spark, path)
    return reads.agg(F.count("*").alias("n"), F.sum(F.char_length("seq")).alias("letters"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("""WITH p AS (SELECT DISTINCT p_brand, p_partkey FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM p)
SELECT p_brand AS gene, '0' AS strain, CAST(pos AS INTEGER) AS pos, CAST(p_partkey AS VARCHAR) AS unitig, p_partkey % 2 = 0 AS forward FROM r""")
def haplotype_path_table(spark, d):
    node = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-"))
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", node.alias("n")))).alias("p"))
    path = shared_path(spark, "path.txt")
    writers.fasta(rows.select(F.concat("p_brand", F.lit("_0")).alias("name"), F.concat_ws(",", F.transform("p", lambda x: x["n"])).alias("seq")), path)
    return readers.haplotype_paths(spark, path)


# ---- sinks ----


def _read(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path)


@query(f"""WITH RECURSIVE {LAYERED}, a AS (SELECT DISTINCT gene, u AS node FROM layered WHERE u LIKE '%@_1' ESCAPE '@' UNION SELECT a.gene, v FROM a JOIN layered l ON l.gene = a.gene AND l.u = a.node),
b AS (SELECT DISTINCT gene, v AS node FROM layered WHERE v LIKE 'purchase%' UNION SELECT b.gene, u FROM b JOIN layered l ON l.gene = b.gene AND l.v = b.node), n AS (SELECT * FROM a INTERSECT SELECT * FROM b)
SELECT 'node' AS kind, count(*) AS n FROM n UNION ALL SELECT 'edge', count(*) FROM layered l WHERE (gene, u) IN (SELECT gene, node FROM n) AND (gene, v) IN (SELECT gene, node FROM n)
UNION ALL SELECT 'named', (SELECT count(*) FROM n) + count(*) FROM layered l WHERE (gene, u) IN (SELECT gene, node FROM n) AND (gene, v) IN (SELECT gene, node FROM n)""")
def graph_tables_sink(spark, d):
    e = domain.layered(spark, d)
    path = shared_path(spark, "graph")
    writers.graph_tables(e, domain.coverage(spark, d).select(F.col("unitig").cast("string").alias("unitig"), "sample", "cov"), e.where("u like '%\\_1'").select("gene", F.col("u").alias("node")), e.where("v like 'purchase%'").select("gene", F.col("v").alias("node")), path)
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    nodes, edges = _read(spark, f"{path}/nodes.csv", "id long, node string"), _read(spark, f"{path}/edges.csv", "a long, b long")
    joined = edges.join(nodes.select(F.col("id").alias("a")), "a").join(nodes.select(F.col("id").alias("b")), "b")
    xml = spark.read.text(f"{path}/graph.graphml").where("value like '<node %' or value like '<edge %'")
    return count("node", nodes).union(count("edge", joined)).union(count("named", xml))


@query(f"""WITH {BIGRAPH}, n AS (SELECT u AS node FROM e UNION SELECT v FROM e) SELECT 'nodes' AS kind, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT u, v FROM e)""")
def node_and_edge_sink(spark, d):
    from skein.operators import graph

    path = shared_path(spark, "tables")
    writers.node_and_edge_tables(graph.both_strands(domain.link_rows(spark, d).withColumn("gene", F.lit(0))).select("u", "v"), path)
    nodes, edges = spark.read.csv(f"{path}/nodes", header=True), spark.read.csv(f"{path}/edges", header=True)
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("nodes", nodes).union(count("edges", edges))


@query(f"""WITH {LAYERED}, k AS (SELECT gene, u AS node FROM layered UNION SELECT gene, v FROM layered), f AS (SELECT gene, count(*) AS factors FROM k GROUP BY 1), c AS (SELECT gene, count(*) AS edges FROM layered GROUP BY 1)
SELECT CAST(f.gene AS VARCHAR) AS gene, CAST(factors AS INTEGER) AS factors, CAST(edges AS INTEGER) AS variables FROM f JOIN c USING (gene)""")
def factor_graph_sink(spark, d):
    """Of each gene's file: its factors, one for each node, and variables, one for each edge."""
    e = domain.layered(spark, d).where("gene >= 0")
    path = shared_path(spark, "factors")
    writers.factor_graphs(e, e.select("gene", F.col("u").alias("node"), F.lit(2.0).alias("weight")).distinct(), path)
    rows = spark.read.text(path, wholetext=True).select(F.col("gene").cast("string").alias("gene"), "value")

    def count(batches):
        for pdf in batches:
            made = [factorgraph.from_text(t) for t in pdf["value"]]
            pdf["factors"], pdf["variables"] = [len(g.factors) for g in made], [len(g.states) for g in made]
            yield pdf[["gene", "factors", "variables"]].astype({"factors": np.int32, "variables": np.int32})

    return rows.mapInPandas(count, "gene string, factors int, variables int")


@query("SELECT CAST(p_size AS BIGINT) AS \"No_strains\", round(avg(p_retailprice), 6) AS mean_ll, round(avg(p_partkey), 6) AS mean_err FROM part GROUP BY 1")
def fold_summary_sink(spark, d):
    path = shared_path(spark, "CV.csv")
    writers.fold_summary(table(spark, d, "part").select(F.col("p_size").alias("n_strains"), F.col("p_partkey").alias("fold"), F.col("p_retailprice").alias("ll"), F.col("p_partkey").alias("err")), path)
    return spark.read.csv(path, header=True).select(F.col("No_strains").cast("long").alias("No_strains"), F.round(F.col("mean_ll").cast("double"), 6).alias("mean_ll"), F.round(F.col("mean_err").cast("double"), 6).alias("mean_err"))


@query("WITH s AS (SELECT s_nationkey AS g, sum(s_acctbal) AS a FROM supplier GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n, round(sum(a), 2) AS total FROM s")
def posterior_sink(spark, d):
    stub = shared_path(spark, "fit") + "_"
    long = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("g")).agg(F.sum("s_acctbal").alias("value")).withColumn("s", F.lit(0))
    writers.posterior_parameters(long, long, stub)
    return _read(spark, f"{stub}tauGamma.csv", "value double").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH s AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part)
SELECT p_brand || '_x' AS header, string_agg(CASE WHEN pos = 1 THEN p_name ELSE substr(p_name, 4) END, '' ORDER BY pos) AS seq FROM s GROUP BY 1""")
def reference_path_sink(spark, d):
    part = table(spark, d, "part")
    path = shared_path(spark, "Ref.fa")
    steps = part.select(F.col("p_brand").alias("ref"), F.lit("x").alias("gene"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("unitig"), F.lit(True).alias("forward"))
    writers.reference_paths(steps, part.select(F.col("p_partkey").alias("unitig"), F.col("p_name").alias("seq")), 3, path)
    return readers.fasta(spark, path)


@query("SELECT n_name AS line FROM nation")
def summary_sink(spark, d):
    path = shared_path(spark, "summary.txt")
    writers.summary(spark, [r["n_name"] for r in table(spark, d, "nation").collect()], path)  # 25 nations
    return spark.read.text(path).select(F.col("value").alias("line"))
