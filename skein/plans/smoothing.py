"""Queries on smoothing and factors, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import folds, graph, metrics, pathmodel, ranking, smoothing

from . import domain
from .catalogue import CELLS, _cells, query, rounded
from .domain import COVERAGE, ENDS, LAYERED, best_by_layer, table

TOTALS = f"""{COVERAGE}, t AS (SELECT unitig, sum(cov) AS c FROM cov GROUP BY 1), pts AS (SELECT CAST(p_retailprice AS DOUBLE) AS x, CAST(coalesce(c, 0) AS DOUBLE) AS y FROM part LEFT JOIN t ON unitig = p_partkey)"""


def _totals(spark, d):
    """(x, y): each part's price and summed quantity."""
    total = domain.coverage(spark, d).groupBy("unitig").agg(F.sum("cov").alias("cov"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("unitig"), F.col("p_retailprice").cast("double").alias("x"))
    return part.join(total, "unitig", "left").select("x", F.coalesce("cov", F.lit(0)).cast("double").alias("y"))


@query(f"""WITH {TOTALS}, p AS (SELECT x, -sum(y) AS y, count(*) AS n, row_number() OVER (ORDER BY x) AS i FROM pts GROUP BY 1), s AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn FROM p),
m AS (SELECT a.i AS lo, b.i AS hi, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM s a JOIN s b ON a.i <= b.i),
least AS (SELECT lo, hi AS "at", min(mean) OVER (PARTITION BY lo ORDER BY hi DESC) AS mean FROM m)
SELECT p.x, round(-max(mean), 6) AS fit FROM least JOIN p ON p.i = least."at" GROUP BY 1""")
def monotone_precision(spark, d):
    """The falling fit of quantities to prices: of every price the highest of the least means of runs that begin up to it and end from it on."""
    return smoothing.monotone(_totals(spark, d), rising=False).select("x", F.round("fit", 6).alias("fit")).distinct()


NEAR = 10
_LOCAL = f"""{TOTALS}, o AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS place FROM pts), g AS (SELECT a.x, a.y, a.place, b.x AS bx, b.y AS b_y, b.place AS other, abs(b.x - a.x) AS gap FROM o a JOIN o b ON b.place BETWEEN a.place - {NEAR} AND a.place + {NEAR}),
k AS (SELECT *, greatest(list_sort(list(gap) OVER w)[least({NEAR + 1}, count(*) OVER w)], 1e-12) AS width FROM g WINDOW w AS (PARTITION BY place)),
kernel AS (SELECT *, power(1 - power(least(gap / width, 1), 3), 3) AS w FROM k)"""


@query(f"""WITH {_LOCAL} SELECT place, x, y, round(any_value(width), 6) AS width, round(sum(w), 5) AS total FROM kernel GROUP BY 1, 2, 3""")
def neighbour_kernel(spark, d):
    out = smoothing.neighbour_kernel(_totals(spark, d), NEAR)
    return out.select("place", "x", "y", F.round("width", 6).alias("width"), F.round(F.aggregate("near", F.lit(0.0), lambda a, n: a + n["w"]), 5).alias("total"))


def _fit(weights: str) -> str:
    d = "(bx - x)"
    s0, s1, s2, t0, t1 = (f"sum({weights}{f})" for f in ("", f" * {d}", f" * {d} * {d}", " * b_y", f" * b_y * {d}"))
    return f"CASE WHEN {s0} * {s2} - {s1} * {s1} > 1e-12 * {s0} * {s2} THEN ({t0} * {s2} - {t1} * {s1}) / ({s0} * {s2} - {s1} * {s1}) ELSE {t0} / {s0} END"


@query(f"""WITH {_LOCAL}, f1 AS (SELECT place, x, y, {_fit("w")} AS fit FROM kernel GROUP BY 1, 2, 3), r1 AS (SELECT place AS other, abs(y - fit) AS e, 6 * median(abs(y - fit)) OVER () AS scale FROM f1),
k2 AS (SELECT k.*, w * power(1 - power(least(e / scale, 1), 2), 2) AS w2 FROM kernel k JOIN r1 USING (other)), f2 AS (SELECT place, x, y, {_fit("w2")} AS fit FROM k2 GROUP BY 1, 2, 3)
SELECT place, x, y, round(fit, 3) AS fit FROM f2""".replace("SELECT place, x, y, round(fit, 3)", "SELECT x, y, round(fit, 3)"))
def local_line(spark, d):
    return smoothing.local_line(_totals(spark, d), NEAR, 2).select("x", "y", F.round("fit", 3).alias("fit"))


STRAINS = 3
#: Each cell with each strain: what the segment holds of it (phi, p2), its intensity there (gamma, g2), and the segment's bias.
_MODEL = f"""{CELLS}, model AS (SELECT c.v, g, s, x, len, 1 + (v % 5) / 50.0::DOUBLE AS theta, power(1 + (v % 5) / 50.0::DOUBLE, 2) + 0.01::DOUBLE AS theta2, (v * (g + 3)) % 11 / 10.0::DOUBLE AS phi, (v * (g + 3)) % 11 / 10.0::DOUBLE AS phi2,
  (1 + s % (g + 4)) / 4.0::DOUBLE AS gamma, power((1 + s % (g + 4)) / 4.0::DOUBLE, 2) + 0.05::DOUBLE AS gamma2, mask / (x + 0.5::DOUBLE) AS weight FROM cells c, range({STRAINS}) r(g))"""


def _model(spark, d):
    c = _cells(spark, d).withColumn("g", F.explode(F.array(*[F.lit(g) for g in range(STRAINS)])))
    theta, phi, gamma = 1 + (F.col("v") % 5) / 50.0, (F.col("v") * (F.col("g") + 3)) % 11 / 10.0, (1 + F.col("s") % (F.col("g") + 4)) / 4.0
    return c.select("v", "g", "s", "x", "len", theta.alias("theta"), (theta**2 + 0.01).alias("theta2"), phi.alias("phi"), phi.alias("phi2"), gamma.alias("gamma"), (gamma**2 + 0.05).alias("gamma2"), (F.col("mask") / (F.col("x") + 0.5)).alias("weight"))


@query(f"""WITH {_MODEL}, f AS (SELECT v, s, sum(phi * gamma) AS fit FROM model GROUP BY 1, 2), u AS (SELECT g, m.s, sum(weight * len * len * theta2 * phi2) AS tau, sum(weight * len * phi * (x * theta - len * (fit - phi * gamma) * theta2)) AS slope FROM model m JOIN f ON f.v = m.v AND f.s = m.s GROUP BY 1, 2)
SELECT CAST(g AS INTEGER) AS g, s, round((slope - 0.5::DOUBLE) / tau, 6) AS mu, round(tau, 4) AS tau FROM u""")
def gamma_update(spark, d):
    return smoothing.gamma_update(_model(spark, d), 0.5).select("g", "s", F.round("mu", 6).alias("mu"), F.round("tau", 4).alias("tau"))


@query(f"""WITH {_MODEL}, f AS (SELECT v, s, any_value(x) AS x, any_value(len) AS len, any_value(weight) AS weight, sum(phi * gamma) AS fit, sum(phi2 * gamma2 - phi * gamma * phi * gamma) AS more FROM model GROUP BY 1, 2),
u AS (SELECT v, 100 + sum(weight * len * len * (fit * fit + more)) AS tau, 100 + sum(weight * len * x * fit) AS slope FROM f GROUP BY 1) SELECT v, round(slope / tau, 6) AS mu, round(tau, 4) AS tau FROM u""")
def theta_update(spark, d):
    return smoothing.theta_update(_model(spark, d)).select("v", F.round("mu", 6).alias("mu"), F.round("tau", 4).alias("tau"))


def _rounds(n: int) -> str:
    """SQL of n rounds of updates, rows and columns in turn, from w0 and h0."""
    out, a, b = [], 0, 0
    for i in range(n):
        for rows in (True, False):
            name, key = f"{i}_{int(rows)}", "v, k" if rows else "k, s"
            out.append(f"q{name} AS (SELECT c.v, c.s, any_value(x) / sum(a * b) AS q FROM cell c JOIN w{a} w ON w.v = c.v JOIN h{b} h ON h.k = w.k AND h.s = c.s GROUP BY 1, 2)")
            mine, other = ("b", "w") if rows else ("a", "h")
            keys = "w.v, w.k" if rows else "w.k, h.s"
            up = f"SELECT {keys}, sum({mine} * q) / sum({mine}) AS r FROM q{name} q JOIN w{a} w ON w.v = q.v JOIN h{b} h ON h.k = w.k AND h.s = q.s GROUP BY 1, 2"
            if rows:
                out.append(f"w{a + 1} AS (SELECT v, k, a * r AS a FROM w{a} JOIN ({up}) USING ({key}))")
                a += 1
            else:
                out.append(f"h{b + 1} AS (SELECT k, s, b * r AS b FROM h{b} JOIN ({up}) USING ({key}))")
                b += 1
    return ",\n".join(out)


@query(f"""WITH {COVERAGE}, cell AS (SELECT unitig AS v, sample AS s, CAST(sum(cov) AS DOUBLE) AS x FROM cov GROUP BY 1, 2 HAVING (unitig + sample) % 10 <> 0),
w0 AS (SELECT DISTINCT v, k, 1 + (v * (k + 2)) % 7 / 7.0::DOUBLE AS a FROM cell, range(4) r(k)), h0 AS (SELECT DISTINCT k, s, 1 + (s * (k + 3)) % 5 / 5.0::DOUBLE AS b FROM cell, range(4) r(k)),
{_rounds(3)}
SELECT v, CAST(k AS INTEGER) AS k, round(a, 6) AS a FROM w3""")
def factorised_cells(spark, d):
    """Segments by four components, after three rounds against all segments' counts in all samples."""
    cells = domain.coverage(spark, d).groupBy(F.col("unitig").alias("v"), F.col("sample").alias("s")).agg(F.sum("cov").cast("double").alias("x")).where("(v + s) % 10 <> 0").withColumn("mask", F.lit(1))
    cells = graph.settle(cells)
    k = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k")
    w = cells.select("v", k).distinct().withColumn("a", 1 + (F.col("v") * (F.col("k") + 2)) % 7 / 7.0)
    h = cells.select(k, "s").distinct().withColumn("b", 1 + (F.col("s") * (F.col("k") + 3)) % 5 / 5.0)
    return rounded(smoothing.factorised(cells, w, h, 3)[0].select("v", "k", "a"), "a")


@query(f"""WITH {_MODEL}, f AS (SELECT v, s, any_value(x) AS x, any_value(len) AS len, any_value(theta) AS theta, any_value(theta2) AS theta2, sum(phi * gamma) AS lam, sum(phi * phi * gamma * gamma) AS own, sum(phi2 * gamma2) AS second FROM model GROUP BY 1, 2)
SELECT v, s, round(power(x - len * theta * lam, 2) + len * len * (theta2 * second - theta * theta * own), 7) AS err2 FROM f""")
def expected_square_errors(spark, d):
    m = _model(spark, d).groupBy("v", "s").agg(*[F.first(c).alias(c) for c in ("x", "len", "theta", "theta2")], F.sum(F.col("phi") * F.col("gamma")).alias("lam"), F.sum((F.col("phi") * F.col("gamma")) ** 2).alias("own"), F.sum(F.col("phi2") * F.col("gamma2")).alias("second"))
    return m.select("v", "s", F.round(metrics.expected_square_error(*[F.col(c) for c in ("x", "len", "theta", "theta2", "lam", "own", "second")]), 7).alias("err2"))


@query(f"""WITH RECURSIVE {best_by_layer("1.0::DOUBLE", "sum(r.x * weight)")},
back AS (SELECT gene, node, 1.0::DOUBLE AS x FROM lasts UNION ALL SELECT l.gene, l.u, sum(r.x * weight) FROM back r JOIN layered l ON l.gene = r.gene AND l.v = r.node GROUP BY 1, 2),
z AS (SELECT gene, sum(x) AS z FROM ended GROUP BY 1), b AS (SELECT gene, node, sum(x) AS x FROM back GROUP BY 1, 2), p AS (SELECT gene, node, best.x / z * b.x AS p FROM best JOIN b USING (gene, node) JOIN z USING (gene)),
top AS (SELECT gene, node, struct_pack(cost := 0.0::DOUBLE, path := list_value(node)) AS x FROM firsts UNION ALL SELECT l.gene, l.v, min(struct_pack(cost := r.x.cost - weight, path := list_append(r.x.path, l.v))) FROM top r JOIN layered l ON l.gene = r.gene AND l.u = r.node GROUP BY 1, 2),
path AS (SELECT gene, unnest(min(x).path) AS node FROM top JOIN lasts USING (gene, node) GROUP BY 1)
SELECT gene AS g, round(avg(1 - p), 6) AS uncertainty FROM path JOIN p USING (gene, node) GROUP BY 1""")
def path_uncertainty(spark, d):
    """How far the nodes of each gene's heaviest path are from certain."""
    e = domain.layered(spark, d)
    paths = pathmodel.best_paths(e, "heaviest").select(F.lit(0).alias("gene"), F.col("gene").alias("g"), F.explode("path").alias("node"))
    p = pathmodel.node_marginals(e).select(F.lit(0).alias("gene"), F.col("gene").alias("g"), "node", "p")
    return rounded(ranking.path_uncertainty(paths, p), "uncertainty")


@query(f"""WITH {LAYERED}, w AS (SELECT u, v, sum(weight) AS flow FROM layered GROUP BY 1, 2), p AS (SELECT u, v, count(*) AS n FROM (SELECT user_id, node AS u, lead(node) OVER (PARTITION BY user_id ORDER BY pos) AS v FROM steps) WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT w.u, w.v, greatest(flow - 0.25::DOUBLE * coalesce(n, 0), 0) AS flow FROM w LEFT JOIN p ON p.u = w.u AND p.v = w.v""")
def path_flow_taken(spark, d):
    """The transitions' counts less a quarter for each user's way, none below zero."""
    flows = domain.layered(spark, d).groupBy("u", "v").agg(F.sum("weight").alias("flow"))
    return graph.add_path_flow(flows, domain.steps(spark, d).select("user_id", "pos", "node"), ["user_id"], -0.25)


@query(f"""WITH {COVERAGE} SELECT unitig AS v, sample AS s, CAST('0x' || substr(md5(unitig || ':' || sample), 1, 8) AS BIGINT) % 1000000 < 100000 AS held FROM cov""")
def held_out(spark, d):
    return folds.hold_out(domain.coverage(spark, d).select(F.col("unitig").alias("v"), F.col("sample").alias("s")), 0.1, ["v", "s"])


@query(f"""WITH {ENDS} SELECT gene, u, v FROM layered UNION SELECT gene, 'source+', node FROM firsts UNION SELECT gene, node, 'sink+' FROM lasts""")
def rooted_graph(spark, d):
    """The layered events between a source before the first layer and a sink behind what leads nowhere."""
    e = graph.settle(domain.layered(spark, d))
    return graph.rooted(e, domain.firsts(e), domain.lasts(e))
