"""Queries on flows, ends, deviances and loads, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import columns, special
from skein.operators import factorgraph, flow, graph, metrics, pathmodel

from . import domain
from .catalogue import BIGRAPH, CELLS, _cells, query, rounded
from .domain import ENDS, LAYERED, table

SLOPES = LAYERED + ", slopes AS (SELECT gene, v AS node, sum(weight) - 20 AS slope FROM layered GROUP BY 1, 2), flows AS (SELECT gene, u, v, v AS through, weight AS flow FROM layered)"
WHOLE = """whole AS (SELECT user_id % 8 AS gene, user_id, pos, event_type || '_' || pos AS node FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)),
carried AS (SELECT gene, node AS u, coalesce(lead(node) OVER (PARTITION BY user_id ORDER BY pos), 'sink+') AS v FROM whole UNION ALL SELECT gene, 'source+', node FROM whole WHERE pos = 1)"""


def _flows(spark, d):
    e = domain.layered(spark, d)
    slopes = e.groupBy("gene", F.col("v").alias("node")).agg((F.sum("weight") - 20).alias("slope"))
    return e.select("gene", "u", "v", F.col("v").alias("through"), F.col("weight").alias("flow")), slopes


# ---- flows ----


@query(f"""WITH {SLOPES}, t AS (SELECT gene, greatest(max(abs(slope)), 1e-9::DOUBLE) AS top FROM slopes GROUP BY 1)
SELECT f.gene, u, v, through, CAST(trunc(slope * 100000.0::DOUBLE / top) AS BIGINT) AS cost FROM flows f JOIN slopes s ON s.gene = f.gene AND s.node = through JOIN t ON t.gene = f.gene""")
def flow_costs(spark, d):
    flows, slopes = _flows(spark, d)
    return graph.flow_costs(flows.drop("flow"), slopes)


@query(f"""WITH {SLOPES} SELECT gene, u, v, flow, 1000.0::DOUBLE AS capacity, 1.0::DOUBLE AS cost FROM flows UNION ALL SELECT DISTINCT gene, 'sink+', 'source+', 0.0::DOUBLE, 50.0::DOUBLE, 0.0::DOUBLE FROM flows""")
def flow_shunt(spark, d):
    return graph.with_shunt(_flows(spark, d)[0].select("gene", "u", "v", "flow", F.lit(1000.0).alias("capacity"), F.lit(1.0).alias("cost")), 50.0)


@query(f"""WITH {SLOPES} SELECT gene, through AS node, sum(flow) AS phi FROM flows GROUP BY 1, 2""")
def flow_throughput(spark, d):
    return graph.throughput(_flows(spark, d)[0])


@query(f"""WITH {SLOPES}, m AS (SELECT *, CASE WHEN u LIKE 'click%' THEN 1.0::DOUBLE WHEN u LIKE 'view%' THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END AS move FROM flows),
n AS (SELECT gene, through AS node, sum(flow) AS old, sum(greatest(flow + 0.5::DOUBLE * move, 0.0::DOUBLE)) AS new FROM m GROUP BY 1, 2)
SELECT n.gene, round(sum(0.5::DOUBLE * (power(slope - 2 * new, 2) - power(slope - 2 * old, 2)) + 0.25::DOUBLE * (new - old)), 6) AS change FROM n JOIN slopes s ON s.gene = n.gene AND s.node = n.node GROUP BY 1""")
def flow_loss_change(spark, d):
    flows, slopes = _flows(spark, d)
    move = flows.select("gene", "u", "v", F.when(F.col("u").startswith("click"), 1.0).when(F.col("u").startswith("view"), -2.0).otherwise(0.0).alias("move"))
    return rounded(graph.loss_change(flows, move, slopes.select("gene", "node", F.col("slope").alias("x"), F.lit(2.0).alias("len")), 0.5, penalty=0.25), "change")


@query(f"""WITH {CELLS}, r AS (SELECT *, (pred + 1e-9::DOUBLE) * len AS rate FROM cells)
SELECT gene, round(sum(mask * (rate - x - x * ln(rate) + x * ln(x + 1e-15::DOUBLE))), 4) AS kl, round(sqrt(sum(power(mask * (rate - x), 2)) / sum(mask)), 5) AS rms FROM r GROUP BY 1""")
def flow_divergence(spark, d):
    out = metrics.flow_divergences(_cells(spark, d).withColumnRenamed("pred", "phi"), ["gene"])
    return out.select("gene", F.round("kl", 4).alias("kl"), F.round("rms", 5).alias("rms"))


@query(f"""WITH {WHOLE} SELECT gene, u, v, CAST(count(*) AS DOUBLE) AS flow FROM carried GROUP BY 1, 2, 3""")
def flow_recompose(spark, d):
    """The paths of the decomposition, put together again: all of the flow."""
    e = domain.layered(spark, d).union(domain.ends(spark, d))
    paths = flow.flow_paths(e.select("gene", "u", "v", F.col("weight").alias("flow")))
    pairs = F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("u"), F.slice("path", 2, F.size("path") - 1).alias("v")))
    steps = paths.select("gene", "amount", pairs.alias("e")).select("gene", "amount", F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    return steps.groupBy("gene", "u", "v").agg(F.round(F.sum("amount"), 6).alias("flow"))


@query(f"""WITH {WHOLE}, n AS (SELECT user_id % 8 AS gene, count(DISTINCT user_id) AS k FROM events GROUP BY 1) SELECT gene, CAST(k AS DOUBLE) AS total FROM n""")
def flow_total(spark, d):
    """What the decomposed paths of each gene carry in all: one unit for each user."""
    e = domain.layered(spark, d).union(domain.ends(spark, d))
    return flow.widest_paths_of(e.select("gene", "u", "v", F.col("weight").alias("flow")), 1 << 30, 0.0).groupBy("gene").agg(F.round(F.sum("amount"), 6).alias("total"))


# ---- errors, loads, draws ----


@query(f"""WITH {CELLS}, p AS (SELECT gene, v, avg(0.5::DOUBLE / (x + 0.5::DOUBLE) * power(x - len * pred, 2) + 0.5::DOUBLE * ln(x + 0.5::DOUBLE)) AS dv FROM cells GROUP BY 1, 2) SELECT gene, round(avg(dv), 5) AS mean_deviance FROM p GROUP BY 1""")
def gene_deviance(spark, d):
    return rounded(metrics.gene_deviance(_scored(spark, d)), "mean_deviance", digits=5)


@query(f"""WITH {CELLS} SELECT gene, round(0.5::DOUBLE * (sum(-ln(x + 0.5::DOUBLE)) - count(*) * ln(2 * pi())) - 0.5::DOUBLE * sum(power(x - len * pred, 2) / (x + 0.5::DOUBLE)), 4) AS score FROM cells WHERE mask = 1 GROUP BY 1""")
def expected_ll(spark, d):
    return rounded(metrics.expected_log_likelihood(_scored(spark, d), ["gene"]), "score", digits=4)


def _scored(spark, d):
    rate = F.col("x") + 0.5
    return _cells(spark, d).select("gene", "v", "s", "mask", (1 / rate).alias("tau"), (-F.ln(rate)).alias("log_tau"), ((F.col("x") - F.col("len") * F.col("pred")) ** 2).alias("err2"))


@query(f"""WITH {CELLS} SELECT v, s, round(xn - (v % 7) / 7.0::DOUBLE * s, 6) AS value FROM cells""")
def component_taken_out(spark, d):
    c = _cells(spark, d)
    phi = c.select("v", F.lit(1).alias("g"), (F.col("v") % 7 / 7.0).alias("p")).distinct()
    gamma = c.select("s", F.lit(1).alias("g"), F.col("s").cast("double").alias("y")).distinct()
    return rounded(metrics.shift_component(c.select("v", "s", F.col("xn").alias("value")), phi, gamma, 1, -1), "value")


@query(f"""WITH {CELLS} SELECT gene, round(0.5::DOUBLE * sum(power(xn - pred, 2)), 5) AS frobenius FROM cells WHERE mask = 1 GROUP BY 1""")
def frobenius(spark, d):
    return rounded(metrics.frobenius(_cells(spark, d).select("gene", F.col("xn").alias("x"), "pred", "mask"), ["gene"]), "frobenius", digits=5)


@query("""WITH m AS (SELECT c_nationkey, median(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_custkey AS v, c_nationkey AS g, c_acctbal > 0.5::DOUBLE * m AS on FROM customer JOIN m USING (c_nationkey)""".replace(" AS on ", ' AS "on" '))
def binarised_loads(spark, d):
    return metrics.binarised(table(spark, d, "customer").select(F.col("c_custkey").alias("v"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("value")))


@query("""SELECT s_suppkey AS v, s_nationkey AS g, s_acctbal AS value FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING sum(s_acctbal) > 10000)""")
def collapsed_loads(spark, d):
    return metrics.collapsed(table(spark, d, "supplier").select(F.col("s_suppkey").alias("v"), F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("value")), 10000.0)


@query("""SELECT c_nationkey AS g, round(sum(least(c_custkey % 101 / 100.0::DOUBLE, 1 - c_custkey % 101 / 100.0::DOUBLE)), 6) AS penalty FROM customer GROUP BY 1""")
def tent_penalty(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.round(F.sum(columns.tent(F.col("c_custkey") % 101 / 100.0)), 6).alias("penalty"))


@query("SELECT p_partkey, round((p_size - 1) / p_retailprice, 9) AS mode FROM part")
def gamma_mode(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(columns.gamma_mode(F.col("p_size"), F.col("p_retailprice")), 9).alias("mode"))


@query()
def draws(spark, d):
    """Draws for each customer: exponential, normal and gamma."""
    c = table(spark, d, "customer").select("c_custkey", (F.abs("c_acctbal") + 1).alias("a"))
    return c.select("c_custkey", columns.exponential_draw(F.lit(2.0), 7).alias("exponential"), columns.normal_draw(F.lit(3.0), F.lit(4.0), 8).alias("normal"), special.gamma_draw(9)(F.lit(2.0), F.lit(4.0), F.col("c_custkey")).alias("gamma"))


# ---- graphs ----


@query(f"""WITH {BIGRAPH}, n AS (SELECT gene, u AS node FROM e UNION SELECT gene, v FROM e) SELECT gene, node FROM n""")
def strands_present(spark, d):
    links = graph.settle(domain.links(spark, d))
    return graph.strands(graph.both_strands(links), links.select("gene", F.col("src").alias("unitig")).union(links.select("gene", "dst")).distinct())


@query(f"""WITH {LAYERED} SELECT gene, u, v, weight FROM layered WHERE u NOT LIKE 'view%' AND v NOT LIKE 'view%'""")
def induced_subgraph(spark, d):
    e = domain.layered(spark, d)
    nodes = e.select("gene", F.col("u").alias("node")).union(e.select("gene", "v")).where("node not like 'view%'")
    return graph.subgraph(e, nodes)


@query(f"""WITH {ENDS}, f AS (FROM firsts), t AS (FROM lasts)
SELECT gene || '/' || u AS u, gene || '/' || v AS v FROM layered UNION SELECT gene || '/' || node, 'connect_' || gene || '+' FROM t WHERE gene < 7 UNION SELECT 'connect_' || (gene - 1) || '+', gene || '/' || node FROM f WHERE gene > 0""")
def chained_graph(spark, d):
    e = domain.layered(spark, d)
    order = e.select("gene", F.col("gene").alias("place")).distinct()
    return graph.chained(e, order, domain.firsts(e), domain.lasts(e))


def _common(u: str, v: str, role: str) -> str:
    return f"""{role}_s AS (SELECT DISTINCT gene, u AS node FROM layered WHERE u LIKE '%@_3' ESCAPE '@'), {role}_r AS (SELECT gene, node AS start, node, 0 AS hops FROM {role}_s UNION SELECT r.gene, start, {v}, hops + 1 FROM {role}_r r JOIN layered l ON l.gene = r.gene AND l.{u} = r.node),
{role}_m AS (SELECT gene, start, node, min(hops) AS hops FROM {role}_r GROUP BY 1, 2, 3), {role}_t AS (SELECT gene, node, count(*) AS n, sum(hops) AS total FROM {role}_m GROUP BY 1, 2), {role}_k AS (SELECT gene, count(*) AS k FROM {role}_s GROUP BY 1),
{role}_b AS (SELECT t.gene, node, row_number() OVER (PARTITION BY t.gene ORDER BY total, node) AS q FROM {role}_t t JOIN {role}_k k ON t.gene = k.gene AND n = k.k)"""


@query(f"WITH RECURSIVE {LAYERED}, {_common('u', 'v', 'sink')}, {_common('v', 'u', 'source')} SELECT gene, 'sink' AS role, node FROM sink_b WHERE q = 1 UNION ALL SELECT gene, 'source', node FROM source_b WHERE q = 1")
def common_ends(spark, d):
    e = graph.settle(domain.layered(spark, d))
    return graph.common_ends(e, e.where("u like '%\\_3'").select("gene", F.col("u").alias("node")).distinct())


@query(f"""WITH RECURSIVE {ENDS}, t AS (FROM firsts UNION FROM lasts),
r AS (SELECT gene, node AS start, node, 0.0::DOUBLE AS distance FROM t UNION ALL SELECT r.gene, start, v, min(distance + weight) FROM r JOIN layered l ON l.gene = r.gene AND l.u = r.node GROUP BY 1, 2, 3)
SELECT gene, start, node, min(distance) AS distance FROM r WHERE (gene, node) IN (SELECT gene, node FROM t) GROUP BY 1, 2, 3""")
def tip_distances(spark, d):
    e = domain.layered(spark, d)
    tips = domain.firsts(e).union(domain.lasts(e)).distinct()
    return pathmodel.all_distances(e, tips)


@query()
def source_sink(spark, d):
    """Ends without stop codons, by distance, of the genes that the segments' brands make."""
    e, tips = _tips(spark, d)
    return pathmodel.distance_ends(e, tips, 0.5)


@query()
def source_sink_first(spark, d):
    e, tips = _tips(spark, d)
    return pathmodel.distance_ends(e, tips, -1.0)


def _tips(spark, d):
    """The layered graph with strands: a node's tip is one without in- or out-edges."""
    e = domain.layered(spark, d).select("gene", F.concat("u", F.lit("+")).alias("u"), F.concat("v", F.lit("+")).alias("v"), "weight")
    ends = e.select("gene", F.col("u").alias("n")).subtract(e.select("gene", "v")).union(e.select("gene", F.col("v").alias("n")).subtract(e.select("gene", "u")))
    return e, ends.select("gene", F.regexp_replace("n", "\\+$", "").alias("unitig"), F.lit(300).alias("len"), F.lit(False).alias("isolated"))


@query("""SELECT p_brand AS gene FROM part GROUP BY 1 HAVING max(p_size) - 35 BETWEEN 0 AND 16 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 97 = 0)""")
def narrow_genes(spark, d):
    part = table(spark, d, "part")
    widths = part.groupBy(F.col("p_brand").alias("gene")).agg((F.max("p_size") - 35).alias("width"))
    return factorgraph.narrow_genes(widths, part.where("p_partkey % 97 = 0").select(F.col("p_brand").alias("gene")))


@query()
def graph_widths(spark, d):
    return factorgraph.graph_widths(domain.layered(spark, d).select("gene", "u", "v"))

