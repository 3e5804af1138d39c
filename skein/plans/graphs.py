"""Queries on graphs of any size, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.sequence import node_name
from skein.operators import graph, pathmodel, wavefront

from . import domain
from .catalogue import BIGRAPH, query
from .domain import LAYERED, table

# ---- the tables as graphs ----


#: Links that one task tells apart, so that its memory does not grow with the tables.
LINK_ROWS = 1 << 17


def _sized(spark, d):
    """Both strands' edges, an edge as long as the segment that it leaves; and the nodes of one brand's segments. Each link has both nodes of both its segments."""
    part = domain.unitigs(spark, d)
    links = graph.settle(domain.link_rows(spark, d))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), links._skein_rows // LINK_ROWS)
    once = graph.strand_ids(links).repartition(parts, "src").distinct()  # dealt by what the lengths are looked up by
    e = once.join(part.select(F.col("unitig").alias("src"), F.col("len").cast("double").alias("weight")), "src")
    brand = part.where("gene = 'Brand#25'").select("unitig")
    core = links.select("gene", F.explode(F.array("src", "dst")).alias("unitig")).join(brand, "unitig", "left_semi").distinct()
    core = core.select("gene", F.explode(F.array(*[node_name(F.col("unitig"), F.lit(f)) for f in (True, False)])).alias("start"))
    return e.select("gene", node_name(F.col("src"), F.col("src_fwd")).alias("u"), node_name(F.col("dst"), F.col("dst_fwd")).alias("v"), "weight"), core


SIZED = (
    BIGRAPH
    + """, w AS (SELECT e.gene, u, v, CAST(p_size AS DOUBLE) AS weight FROM e JOIN part ON CAST(p_partkey AS VARCHAR) = substr(u, 1, length(u) - 1)),
s AS (SELECT gene, n AS start FROM (SELECT gene, u AS n FROM e UNION SELECT gene, v FROM e) JOIN part ON CAST(p_partkey AS VARCHAR) = substr(n, 1, length(n) - 1) WHERE p_brand = 'Brand#25')"""
)


def tour_steps(spark, d) -> DataFrame:
    """(gene, pos, node, cov): each customer's lines in the order of their orders, as the nations of their suppliers."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(F.col("o_custkey").alias("gene"), F.row_number().over(w).alias("pos"), F.concat(F.lit("n"), "s_nationkey").alias("node"), F.col("l_quantity").cast("double").alias("cov"))


def tours(spark, d) -> DataFrame:
    """(gene, u, v, weight): the steps of each customer's tour from nation to nation with their counts."""
    w = Window.partitionBy("gene").orderBy("pos")
    e = tour_steps(spark, d).withColumn("v", F.lead("node").over(w)).where("v is not null")
    return e.groupBy("gene", F.col("node").alias("u"), "v").agg(F.count("*").cast("double").alias("weight"))


TOURS = """tour AS (SELECT o_custkey AS gene, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos, 'n' || s_nationkey AS node
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
tours AS (SELECT gene, node AS u, v, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT *, lead(node) OVER (PARTITION BY gene ORDER BY pos) AS v FROM tour) WHERE v IS NOT NULL GROUP BY 1, 2, 3)"""


def deliveries(spark, d) -> DataFrame:
    """(gene, nth, order, lines): the orders of each customer in time, with their distinct line numbers."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("lines"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("gene"), "o_orderdate", F.col("o_orderkey").alias("l_orderkey")).join(li, "l_orderkey")
    w = Window.partitionBy("gene").orderBy("o_orderdate", "l_orderkey")
    return o.select("gene", F.row_number().over(w).alias("nth"), F.col("l_orderkey").alias("order"), "lines")


DELIVERIES = """deliveries AS (SELECT o_custkey AS gene, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, o_orderkey AS "order", lines
  FROM orders JOIN (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


# ---- queries ----

RADIUS = 30


@query(f"""WITH RECURSIVE {SIZED}, r AS (SELECT gene, start, start AS node, 0.0::DOUBLE AS distance FROM s UNION SELECT r.gene, start, v, distance + weight FROM r JOIN w ON w.gene = r.gene AND w.u = r.node WHERE distance <= {RADIUS})
SELECT gene, start, node, min(distance) AS distance, min(distance) > {RADIUS} AS on_rim FROM r GROUP BY 1, 2, 3""")
def ego_graphs(spark, d):
    """What lies within thirty letters ahead of each node of one brand's segments."""
    e, core = _sized(spark, d)
    return wavefront.ego_graphs(e, core, RADIUS)


def _ego_sql(name: str, u: str, v: str) -> str:
    """The ball, the walks past it, and their ends with what lies back from these."""
    return f"""{name}_b AS (SELECT gene, u AS start, u AS node, 0.0::DOUBLE AS distance FROM near UNION SELECT r.gene, start, w.{v}, distance + weight FROM {name}_b r JOIN w ON w.gene = r.gene AND w.{u} = r.node WHERE distance <= 8),
{name}_ball AS (SELECT gene, start, node, min(distance) AS distance FROM {name}_b GROUP BY 1, 2, 3),
{name}_fan AS (SELECT gene, {u} AS node, count(*) AS fan FROM w GROUP BY 1, 2),
{name}_p AS (SELECT gene, start, node FROM {name}_ball WHERE distance > 8 UNION SELECT p.gene, start, w.{v} FROM {name}_p p JOIN w ON w.gene = p.gene AND w.{u} = p.node JOIN {name}_fan f ON f.gene = p.gene AND f.node = p.node AND fan <> 1),
{name}_ends AS (SELECT p.gene, p.start, p.node FROM {name}_p p JOIN {name}_fan f ON f.gene = p.gene AND f.node = p.node AND fan = 1 WHERE NOT EXISTS (SELECT 1 FROM {name}_ball b WHERE b.gene = p.gene AND b.start = p.start AND b.node = p.node AND distance <= 8)),
{name}_r AS (SELECT DISTINCT gene, node AS start, node, 0.0::DOUBLE AS distance FROM {name}_ends UNION SELECT r.gene, start, w.{u}, distance + weight FROM {name}_r r JOIN w ON w.gene = r.gene AND w.{v} = r.node WHERE distance <= 8),
{name} AS (SELECT DISTINCT e.gene, e.start, r.node FROM {name}_ends e JOIN {name}_r r ON r.gene = e.gene AND r.start = e.node)"""


@query(f"""WITH RECURSIVE {TOURS}, w AS (SELECT gene, u, v, 1 + weight AS weight FROM tours WHERE u <> v), near AS (SELECT gene, node AS u FROM tour WHERE pos = 1), {_ego_sql("ahead", "u", "v")}, {_ego_sql("behind", "v", "u")}
SELECT * FROM ahead INTERSECT SELECT * FROM behind""")
def ego_core(spark, d):
    """Of each customer's tour, what lies between the ends around its first nation."""
    e = tours(spark, d).where("u <> v").withColumn("weight", F.col("weight") + 1)
    return wavefront.ego_core(e, tour_steps(spark, d).where("pos = 1").select("gene", F.col("node").alias("start")), 8)


def _counts(spark, d):
    """(gene, node, sample, cov) and (gene, node, len) of the layered events: users in ten samples; a node is ten letters longer than its name."""
    s = domain.steps(spark, d)
    cov = s.groupBy("gene", "node", (F.col("user_id") % 10).alias("sample")).agg(F.count("*").alias("cov"))
    return cov, s.select("gene", "node", (F.char_length("node") + 10).alias("len")).distinct()


@query(f"""WITH RECURSIVE {LAYERED}, nodes AS (SELECT gene, u AS node FROM layered UNION SELECT gene, v FROM layered), leads AS (SELECT DISTINCT gene, u AS node FROM layered),
counts AS (SELECT gene, node, user_id % 10 AS sample, count(*) AS cov FROM steps GROUP BY 1, 2, 3), every AS (SELECT * FROM counts UNION ALL SELECT gene, node, NULL, sum(cov) FROM counts GROUP BY 1, 2), samples AS (SELECT DISTINCT gene, sample FROM every JOIN nodes USING (gene, node)),
worth AS (SELECT n.gene, n.node, s.sample, CAST(coalesce(cov, 0) * (length(n.node) + 10 - CASE WHEN l.node IS NULL THEN 0 ELSE 4 END) AS DOUBLE) AS value
  FROM nodes n JOIN samples s ON s.gene = n.gene LEFT JOIN every e ON e.gene = n.gene AND e.node = n.node AND e.sample IS NOT DISTINCT FROM s.sample LEFT JOIN leads l ON l.gene = n.gene AND l.node = n.node),
best AS (
  SELECT gene, node, sample, value, CAST(NULL AS VARCHAR) AS pred FROM worth WHERE node LIKE '%@_1' ESCAPE '@'
  UNION ALL SELECT w.gene, w.node, w.sample, greatest(any_value(r.x).total, 0) + any_value(w.value), CASE WHEN any_value(r.x).total > 0 THEN any_value(r.x).node END
  FROM (SELECT l.gene, l.v, b.sample, max_by(struct_pack(total := b.value, node := b.node), struct_pack(total := b.value, n := list_transform(range(1, 25), lambda i: -ascii(substr(b.node, CAST(i AS INTEGER), 1))))) AS x
    FROM best b JOIN layered l ON l.gene = b.gene AND l.u = b.node GROUP BY 1, 2, 3) r
  JOIN worth w ON w.gene = r.gene AND w.node = r.v AND w.sample IS NOT DISTINCT FROM r.sample GROUP BY 1, 2, 3),
both_ AS (SELECT gene, u, v FROM layered UNION SELECT gene, v, u FROM layered),
c(gene, node, component) USING KEY (gene, node) AS (
  SELECT gene, u, least(u, min(v)) FROM both_ GROUP BY 1, 2
  UNION SELECT b.gene, b.u, min(x.component) FROM c x JOIN both_ b ON b.gene = x.gene AND b.v = x.node JOIN recurring.c o ON o.gene = b.gene AND o.node = b.u WHERE x.component < o.component GROUP BY 1, 2),
top AS (SELECT b.gene, component AS part, sample, b.node, value FROM best b JOIN c ON c.gene = b.gene AND c.node = b.node WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY b.gene, component, sample ORDER BY value DESC, b.node) = 1),
walk AS (SELECT gene, part, sample, value, node, 0 AS back FROM top UNION ALL SELECT w.gene, part, w.sample, w.value, pred, back + 1 FROM walk w JOIN best b ON b.gene = w.gene AND b.node = w.node AND b.sample IS NOT DISTINCT FROM w.sample WHERE pred IS NOT NULL)
SELECT gene, part, sample, list(node ORDER BY back DESC) AS path, any_value(value) AS value FROM walk GROUP BY 1, 2, 3""")
def sample_paths(spark, d):
    """The path of most covered letters through each gene's layered events, for each sample of users and for all."""
    cov, lengths = _counts(spark, d)
    return wavefront.sample_paths(domain.layered(spark, d), cov, lengths, 4)


@query(f"""WITH RECURSIVE {TOURS}, r AS (SELECT gene, u, v FROM tours UNION SELECT r.gene, r.u, t.v FROM r JOIN tours t ON t.gene = r.gene AND t.u = r.v)
SELECT a.gene, a.u AS node, min(a.v) AS component FROM r a JOIN r b ON b.gene = a.gene AND b.u = a.v AND b.v = a.u GROUP BY 1, 2""")
def cycle_components(spark, d):
    """The nations that each customer's tour goes through in cycles."""
    return wavefront.strong_components(tours(spark, d))


@query(f"""WITH {DELIVERIES}, m AS (SELECT *, nth - row_number() OVER (PARTITION BY gene ORDER BY nth) AS run FROM deliveries WHERE len(lines) > 1)
SELECT gene, 'j' || gene || '_' || min(nth) OVER (PARTITION BY gene, run) AS chain, CAST(row_number() OVER (PARTITION BY gene, run ORDER BY nth) AS INTEGER) AS nth, 'j' || gene || '_' || nth AS source, 'j' || gene || '_' || (nth + 1) AS sink FROM m""")
def bubble_chains(spark, d):
    """A customer's orders one behind the other, each order's lines side by side; orders of one line are no bubble and part the chains."""
    o = deliveries(spark, d)
    junction = lambda n: F.concat(F.lit("j"), F.col("gene").cast("string"), F.lit("_"), n.cast("string"))
    line = F.concat(F.lit("l"), F.col("order").cast("string"), F.lit("_"), F.col("line").cast("string"))
    steps = o.select("gene", "nth", "order", F.explode("lines").alias("line"))
    e = steps.select("gene", F.inline(F.array(F.struct(junction(F.col("nth")).alias("u"), line.alias("v")), F.struct(line.alias("u"), junction(F.col("nth") + 1).alias("v")))))
    return wavefront.bubble_chains(pathmodel.superbubbles(e).select("gene", "source", "sink"))


OVERLAP = 150
#: A line's segment is as long as the overlap and its part's size; lines follow one another, and those returned also lead past the next one.
CHAINED = f"""lines AS (SELECT o_custkey AS gene, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos, l_orderkey, l_returnflag, p_size + {OVERLAP} AS len
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
named AS (SELECT *, 's' || pos AS node, lead(pos) OVER w AS p1, lead(pos, 2) OVER w AS p2 FROM lines WINDOW w AS (PARTITION BY gene ORDER BY pos)),
steps AS (SELECT gene, node AS u, 's' || p1 AS v FROM named WHERE p1 IS NOT NULL UNION SELECT gene, node, 's' || p2 FROM named WHERE p2 IS NOT NULL AND l_returnflag = 'R'),
ends AS (SELECT gene, l_orderkey AS path, max(pos) AS last, min(pos) AS first FROM named GROUP BY 1, 2)"""


def _chained(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = li.select(F.col("o_custkey").alias("gene"), F.row_number().over(w).alias("pos"), "l_orderkey", "l_returnflag", (F.col("p_size") + OVERLAP).alias("len"))
    w, name = Window.partitionBy("gene").orderBy("pos"), lambda c: F.concat(F.lit("s"), c.cast("string"))
    nodes = graph.settle(li.withColumns({"p1": F.lead("pos").over(w), "p2": F.lead("pos", 2).over(w), "node": name(F.col("pos"))}))
    e = nodes.where("p1 is not null").select("gene", F.col("node").alias("u"), name(F.col("p1")).alias("v")).union(nodes.where("p2 is not null and l_returnflag = 'R'").select("gene", "node", name(F.col("p2"))))
    ends = nodes.groupBy("gene", F.col("l_orderkey").alias("path")).agg(F.max(F.struct("pos", "node", "len")).alias("last"), F.min(F.struct("pos", "node")).alias("first"))
    return e, ends, nodes.select("gene", "node", "len")


@query(f"""WITH RECURSIVE {CHAINED}, ahead_ AS (SELECT gene, u, min(v) AS v FROM steps GROUP BY 1, 2 HAVING count(*) = 1), single AS (SELECT gene, v, min(u) AS u FROM steps GROUP BY 1, 2 HAVING count(*) = 1),
a AS (SELECT e.gene, path, node, CAST(len AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS added FROM ends e JOIN named n ON n.gene = e.gene AND n.pos = last
  UNION ALL SELECT a.gene, path, o.v, a.pos - (n.len - {OVERLAP}), list_append(added, o.v) FROM a JOIN named n ON n.gene = a.gene AND n.node = a.node JOIN ahead_ o ON o.gene = a.gene AND o.u = a.node WHERE a.pos > n.len - {OVERLAP}),
b AS (SELECT e.gene, path, node, 0::BIGINT AS pos, CAST([] AS VARCHAR[]) AS added FROM ends e JOIN named n ON n.gene = e.gene AND n.pos = first
  UNION ALL SELECT b.gene, path, o.u, b.pos + (n.len - {OVERLAP}), list_append(added, o.u) FROM b JOIN single o ON o.gene = b.gene AND o.v = b.node JOIN named n ON n.gene = b.gene AND n.node = o.u WHERE b.pos < {OVERLAP})
SELECT 'ahead' AS side, * FROM a QUALIFY row_number() OVER (PARTITION BY gene, path ORDER BY len(added) DESC) = 1 UNION ALL SELECT 'back', * FROM b QUALIFY row_number() OVER (PARTITION BY gene, path ORDER BY len(added) DESC) = 1""")
def extended_paths(spark, d):
    """Each order's lines, carried on ahead from the end of its last segment and back from the begin of its first."""
    e, ends, lengths = _chained(spark, d)
    ahead = wavefront.extended_paths(e, ends.select("gene", "path", F.col("last.node").alias("node"), F.col("last.len").cast("long").alias("pos")), lengths, OVERLAP)
    back = wavefront.extended_paths(e, ends.select("gene", "path", F.col("first.node").alias("node"), F.lit(0).cast("long").alias("pos")), lengths, OVERLAP, ahead=False)
    return ahead.select(F.lit("ahead").alias("side"), "*").union(back.select(F.lit("back").alias("side"), "*"))
