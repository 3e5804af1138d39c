"""The star-schema tables as domain tables: segment = part, gene = brand, sample = supplier's nation, coverage = summed quantity; and a
layered graph of each user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """(gene, unitig, sample, cov)"""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    per = li.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sample")), "l_suppkey")
    per = per.groupBy(F.col("l_partkey").alias("unitig"), "sample").agg(F.sum("l_quantity").alias("cov"))
    return per.join(unitigs(spark, d).select("gene", "unitig"), "unitig").select("gene", "unitig", "sample", "cov")


def unitigs(spark: SparkSession, d: str) -> DataFrame:
    """(gene, unitig, len)"""
    return table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("unitig"), F.col("p_size").alias("len"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    """(gene, user_id, pos, node): each user's events by time, as nodes type_rank; a gene is an eighth of the users."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type").withColumn("pos", F.row_number().over(w))
    return e.select((F.col("user_id") % 8).alias("gene"), "user_id", "pos", F.concat_ws("_", "event_type", "pos").alias("node"))


def layered(spark: SparkSession, d: str) -> DataFrame:
    """(gene, u, v, weight): transitions between layers with their counts."""
    w = Window.partitionBy("user_id").orderBy("pos")
    e = steps(spark, d).withColumn("v", F.lead("node").over(w)).where("v is not null")
    return e.groupBy("gene", F.col("node").alias("u"), "v").agg(F.count("*").cast("double").alias("weight"))


def firsts(edges: DataFrame) -> DataFrame:
    """(gene, node): the nodes of the first layer that have successors."""
    return edges.where("u like '%\\_1'").select("gene", F.col("u").alias("node")).distinct()


def lasts(edges: DataFrame) -> DataFrame:
    """(gene, node): nodes without successors."""
    return edges.select("gene", F.col("v").alias("node")).subtract(edges.select("gene", "u"))


def ends(spark: SparkSession, d: str) -> DataFrame:
    """(gene, u, v, weight): edges from source+ to the first and from the last of all events of each user, with their counts."""
    e = steps(spark, d)
    last = e.groupBy("gene", "user_id").agg(F.max_by("node", "pos").alias("u")).select("gene", "u", F.lit("sink+").alias("v"))
    both = e.where("pos = 1").select("gene", F.lit("source+").alias("u"), F.col("node").alias("v")).union(last)
    return both.groupBy("gene", "u", "v").agg(F.count("*").cast("double").alias("weight"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """(gene, src, src_fwd, dst, dst_fwd): parts of one order's neighbouring lines, the strand by the parity of key sums."""
    return link_rows(spark, d).distinct()


def link_rows(spark: SparkSession, d: str) -> DataFrame:
    """links, as often as they come."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = li.withColumn("dst", F.lead("l_partkey").over(w)).where("dst is not null and dst <> l_partkey")
    return e.select((F.col("l_orderkey") % 5).alias("gene"), F.col("l_partkey").alias("src"), (F.col("l_orderkey") % 2 == 0).alias("src_fwd"), "dst", (F.col("dst") % 2 == 0).alias("dst_fwd"))


# ---- the same in SQL ----

COVERAGE = """cov AS (
  SELECT p_brand AS gene, l_partkey AS unitig, s_nationkey AS sample, sum(l_quantity) AS cov
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""

STEPS = """steps AS (
  SELECT user_id % 8 AS gene, user_id, pos, event_type || '_' || pos AS node
  FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events))"""

LAYERED = (
    STEPS
    + """, layered AS (
  SELECT gene, node AS u, v, CAST(count(*) AS DOUBLE) AS weight
  FROM (SELECT gene, node, lead(node) OVER (PARTITION BY user_id ORDER BY pos) AS v FROM steps) WHERE v IS NOT NULL GROUP BY 1, 2, 3)"""
)

LINKS = """links AS (
  SELECT DISTINCT l_orderkey % 5 AS gene, l_partkey AS src, l_orderkey % 2 = 0 AS src_fwd, dst, dst % 2 = 0 AS dst_fwd
  FROM (SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND dst <> l_partkey)"""

#: Ends of the layered graph: nodes of the first layer, and nodes without successors.
ENDS = (
    LAYERED
    + """, firsts AS (SELECT DISTINCT gene, u AS node FROM layered WHERE u LIKE '%@_1' ESCAPE '@'),
lasts AS (SELECT gene, v AS node FROM layered EXCEPT SELECT gene, u FROM layered)"""
)


def best_by_layer(start: str, step: str) -> str:
    """The best value of all paths from the first layer to each node, one layer a round: start is the value of a first node, step the aggregate over the edges l
    from values r.x."""
    return f"""{ENDS}, best AS (SELECT gene, node, {start} AS x FROM firsts
  UNION ALL SELECT l.gene, l.v, {step} FROM best r JOIN layered l ON l.gene = r.gene AND l.u = r.node GROUP BY 1, 2),
ended AS (SELECT gene, node, x FROM best JOIN lasts USING (gene, node))"""
