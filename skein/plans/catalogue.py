"""Queries over the star-schema tables, one for each operator, with the SQL that they equal where SQL can tell it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import columns, sequence, special
from skein.operators import annotate, communities
from skein.operators import coverage as cov
from skein.operators import factors, flow, folds, graph, metrics, outliers, pathmodel, ranking

from . import domain
from .domain import COVERAGE, LAYERED, LINKS, STEPS, best_by_layer, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _adjusted(spark, d):
    return cov.adjust(domain.coverage(spark, d), domain.unitigs(spark, d), 150, 77)


# ---- coverage and filters ----

FACTOR = "(150.0::DOUBLE / 74.0::DOUBLE)"
ADJUSTED = (
    COVERAGE
    + f""", adj AS (
  SELECT c.*, CAST(p_size - 4 AS DOUBLE) AS adj_len, c.cov * CAST(p_size - 4 AS DOUBLE) * {FACTOR} / 150.0::DOUBLE AS x, c.cov * CAST(p_size - 4 AS DOUBLE) * {FACTOR} / 150.0::DOUBLE / CAST(p_size - 4 AS DOUBLE) AS xn
  FROM cov c JOIN part ON unitig = p_partkey WHERE p_size - 4 > 0)"""
)


@query(f"WITH {ADJUSTED} SELECT gene, unitig, sample, cov, adj_len, round(x, 6) AS x, round(xn, 6) AS xn FROM adj")
def coverage_adjust(spark, d):
    return rounded(_adjusted(spark, d), "x", "xn").select("gene", "unitig", "sample", "cov", "adj_len", "x", "xn")


@query(f"""WITH {COVERAGE}, m AS (SELECT sample, avg(cov) * {FACTOR} AS mean_cov FROM cov GROUP BY 1)
SELECT sample, round(mean_cov, 6) AS mean_cov, mean_cov > greatest(1.0::DOUBLE, 0.97::DOUBLE * (SELECT max(mean_cov) FROM m)) AS kept FROM m""")
def select_samples(spark, d):
    return rounded(cov.select_samples(domain.coverage(spark, d), cov.read_factor(150, 77), 1.0, 0.97), "mean_cov")


@query(f"""WITH {COVERAGE}, v AS (SELECT gene, sample, avg(cov) AS value FROM cov GROUP BY 1, 2),
m AS (SELECT sample, median(value) AS med FROM v GROUP BY 1), q AS (SELECT v.*, abs(value - med) AS dev FROM v JOIN m USING (sample)),
b AS (SELECT sample, median(dev) AS mad FROM q GROUP BY 1)
SELECT gene, CAST(sum(CASE WHEN mad = 0 OR dev / mad < 2.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_inside,
       sum(CASE WHEN mad = 0 OR dev / mad < 2.0 THEN 1 ELSE 0 END) < 0.8::DOUBLE * (SELECT count(DISTINCT sample) FROM v) AS outlier
FROM q JOIN b USING (sample) GROUP BY gene""")
def gene_outlier_mad(spark, d):
    values = domain.coverage(spark, d).groupBy("gene", "sample").agg(F.avg("cov").alias("value"))
    return outliers.outlier_genes(values, 2.0, 0.8)


@query(f"""WITH {COVERAGE}, e AS (SELECT gene, sum(cov) AS error FROM cov GROUP BY 1), q AS (SELECT gene, error, abs(error - (SELECT median(error) FROM e)) AS dev FROM e)
SELECT gene, error, NOT (dev > 1.5 * (SELECT median(dev) FROM q) AND error > (SELECT median(error) FROM e)) AS kept FROM q""")
def gene_filter_mad(spark, d):
    return outliers.filter_genes(domain.coverage(spark, d).groupBy("gene").agg(F.sum("cov").alias("error")), 1.5)


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS degenerate FROM documents""")
def degenerate_dedupe(spark, d):
    return outliers.duplicate_sequences(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"])


@query(f"""WITH {COVERAGE}, t AS (SELECT gene, unitig, sum(cov) AS total FROM cov GROUP BY 1, 2)
SELECT gene, unitig, total, total < 0.5::DOUBLE * avg(total) OVER (PARTITION BY gene) AS noise FROM t""")
def noise_nodes(spark, d):
    return cov.noise_nodes(domain.coverage(spark, d).withColumnRenamed("cov", "x"), 0.5)


@query(f"WITH {COVERAGE} SELECT gene, sample, round(sum(p_size * cov) / 1000.0::DOUBLE, 6) AS mean_cov FROM cov JOIN part ON unitig = p_partkey GROUP BY 1, 2")
def mean_coverage(spark, d):
    return rounded(cov.mean_coverage(domain.coverage(spark, d), domain.unitigs(spark, d), 1000.0), "mean_cov")


@query(f"""WITH {COVERAGE}, s AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS last FROM lineitem)
SELECT l_orderkey, sample, round(sum((p_size - CASE WHEN pos = last THEN 0 ELSE 1 END) * cov) / sum(p_size - CASE WHEN pos = last THEN 0 ELSE 1 END), 6) AS path_cov
FROM s JOIN part ON l_partkey = p_partkey JOIN cov ON unitig = l_partkey GROUP BY 1, 2 HAVING sum(p_size - CASE WHEN pos = last THEN 0 ELSE 1 END) > 0""")
def path_coverage(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("unitig"))
    parts = 1 + lines.count() // cov.STEPS
    w = Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("l_linenumber"), F.asc_nulls_last("unitig"))
    paths = lines.repartitionByRange(parts, "l_orderkey").select("l_orderkey", F.row_number().over(w).alias("pos"), "unitig")
    return rounded(cov.path_coverage(paths, domain.coverage(spark, d), domain.unitigs(spark, d), 1, ["l_orderkey"], parts), "path_cov")


@query(f"""WITH {ADJUSTED}, g AS (SELECT count(DISTINCT sample) AS n_samples, round(sum(x), 4) AS total, round(max(x) - min(CASE WHEN x > 0 THEN x END), 6) AS spread FROM adj)
SELECT *, n_samples >= 2 AS use_bias, total >= 100 AS use_noise, CASE WHEN n_samples < 2 OR spread < 100 THEN 'fixed' ELSE 'log' END AS tau FROM g""")
def gates(spark, d):
    return cov.gates(_adjusted(spark, d)).withColumns({"total": F.round("total", 4), "spread": F.round("spread", 6)})


# ---- errors, divergences, scores ----

CELLS = (
    ADJUSTED
    + """, mean AS (SELECT gene, sample, avg(xn) AS pred FROM adj GROUP BY 1, 2), cells AS (
  SELECT a.gene, a.unitig AS v, a.sample AS s, x, xn, adj_len AS len, pred, CASE WHEN (a.unitig + a.sample) % 10 = 0 THEN 0 ELSE 1 END AS mask FROM adj a JOIN mean m ON a.gene = m.gene AND a.sample = m.sample)"""
)


def _cells(spark, d):
    a = _adjusted(spark, d)
    mean = a.groupBy("gene", "sample").agg(F.avg("xn").alias("pred"))
    return a.join(mean, ["gene", "sample"]).select("gene", F.col("unitig").alias("v"), F.col("sample").alias("s"), "x", "xn", F.col("adj_len").alias("len"), "pred", F.when((F.col("unitig") + F.col("sample")) % 10 == 0, 0).otherwise(1).alias("mask"))


@query(f"""WITH {CELLS}, p AS (SELECT gene, v, avg((pred - xn) * (pred - xn)) AS dd, sum((x - len * pred) * (x - len * pred)) AS e, count(*) AS n FROM cells GROUP BY 1, 2)
SELECT gene, round(avg(dd), 5) AS mean_diff, round(sum(e) / sum(n), 5) AS mse FROM p GROUP BY 1""")
def gene_errors(spark, d):
    return rounded(metrics.group_errors(_cells(spark, d)), "mean_diff", "mse", digits=5)


@query(f"""WITH {CELLS}, c AS (SELECT x, len * pred AS y FROM cells WHERE mask = 1)
SELECT count(*) AS n, round(avg((x - y) * (x - y)), 5) AS mse, round(1 - avg((x - y) * (x - y)) / var_pop(x), 6) AS r2, round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) AS rp FROM c""")
def masked_mse_r2_rp(spark, d):
    cells = _cells(spark, d).withColumn("pred", F.col("len") * F.col("pred"))
    return metrics.masked_fit(cells).select("n", F.round("mse", 5).alias("mse"), F.round("r2", 6).alias("r2"), F.round("rp", 6).alias("rp"))


@query(f"WITH {CELLS} SELECT gene, round(sum(CASE WHEN xn = 0 THEN 2.220446049250313e-16 * 0 ELSE xn * ln(xn / pred) END - xn + pred), 5) AS kl FROM cells GROUP BY 1")
def kl_divergence(spark, d):
    return rounded(metrics.kl_divergence(_cells(spark, d).select("gene", F.col("xn").alias("x"), "pred"), ["gene"]), "kl", digits=5)


@query(f"WITH {CELLS} SELECT gene, round(0.5 * (sum(1 / (x + 0.5)) - count(*) * ln(2 * pi())) - 0.5 * sum((x - len * pred) * (x - len * pred) / (x + 0.5)), 4) AS score FROM cells WHERE mask = 1 GROUP BY 1")
def poisson_score(spark, d):
    return rounded(metrics.poisson_score(_cells(spark, d).withColumn("pred", F.col("len") * F.col("pred")), ["gene"]), "score", digits=4)


@query("""WITH a AS (SELECT p_brand AS v, p_type AS k, CAST(count(*) AS DOUBLE) AS a FROM part GROUP BY 1, 2), b AS (
  SELECT p_type AS k, s_nationkey AS s, sum(l_quantity) AS b FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT v, s, sum(a * b) AS value, sum(a * b) - sum(CASE WHEN k = 'ECONOMY' THEN a * b ELSE 0 END) AS without FROM a JOIN b USING (k) GROUP BY 1, 2""")
def delete_one_product(spark, d):
    left, right = _factors(spark, d)
    return metrics.product_without(left, right, "v", "k", "s", F.col("k") == "ECONOMY")


@query("""WITH a AS (SELECT p_brand AS v, p_type AS k, CAST(count(*) AS DOUBLE) AS a FROM part GROUP BY 1, 2), b AS (
  SELECT p_type AS k, s_nationkey AS s, sum(l_quantity) AS b FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT v, s, sum(a * b) AS value FROM a JOIN b USING (k) GROUP BY 1, 2""")
def matrix_product(spark, d):
    return metrics.product(*_factors(spark, d), "v", "k", "s")


def _factors(spark, d):
    part, sup = table(spark, d, "part"), table(spark, d, "supplier")
    left = part.groupBy(F.col("p_brand").alias("v"), F.col("p_type").alias("k")).agg(F.count("*").cast("double").alias("a"))
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    right = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey).groupBy(F.col("p_type").alias("k"), F.col("s_nationkey").alias("s")).agg(F.sum("l_quantity").alias("b"))
    return left, right


@query("""WITH t AS (SELECT c_nationkey AS v, c_acctbal / 10000.0::DOUBLE AS p, abs(c_acctbal) / 10000.0::DOUBLE AS g FROM customer)
SELECT v, round(sum(p * g), 5) AS lam, round(sum(p * g) * sum(p * g) - sum(p * p * g * g) + sum((p * p + 0.1) * (g * g + 0.2)), 4) AS lam2 FROM t GROUP BY 1""")
def squared_moments(spark, d):
    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("v"), (F.col("c_acctbal") / 10000.0).alias("p"), (F.abs("c_acctbal") / 10000.0).alias("g"))
    t = t.withColumn("p2", F.col("p") ** 2 + 0.1).withColumn("g2", F.col("g") ** 2 + 0.2)
    return metrics.squared_moments(t, ["v"]).select("v", F.round("lam", 5).alias("lam"), F.round("lam2", 4).alias("lam2"))


@query("""WITH w AS (SELECT s_nationkey AS k, exp(-s_acctbal / 1000.0::DOUBLE - max(-s_acctbal / 1000.0::DOUBLE) OVER (PARTITION BY s_nationkey)) AS e, s_suppkey FROM supplier)
SELECT s_suppkey, k, round(e / sum(e) OVER (PARTITION BY k), 9) AS p FROM w""")
def softmax_factor(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (-F.col("s_acctbal") / 1000.0).alias("l"))
    return s.select("s_suppkey", "k", F.round(columns.softmax_over(F.col("l"), ["k"]), 9).alias("p"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(-sum(p * ln(p)), 9) + 0.0 AS entropy, CAST(count(*) AS INTEGER) AS n_types FROM p GROUP BY 1""")
def entropy_marginal(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = c.groupBy("user_id").agg(F.array_sort(F.collect_list("n")).alias("n"))
    share = F.transform("n", lambda x: x / F.aggregate("n", F.lit(0).cast("long"), lambda a, y: a + y))
    return p.select("user_id", (F.round(columns.entropy(share), 9) + 0.0).alias("entropy"), F.size("n").alias("n_types"))


@query("SELECT p_type AS g, 1e-9::DOUBLE + count(*) AS shape, 1e-9::DOUBLE + sum(CAST(p_size AS DOUBLE)) AS rate, round((1e-9::DOUBLE + count(*)) / (1e-9::DOUBLE + sum(CAST(p_size AS DOUBLE))), 9) AS mean FROM part GROUP BY 1")
def ard_rate(spark, d):
    return rounded(metrics.relevance(table(spark, d, "part").select(F.col("p_type").alias("g"), F.col("p_size").cast("double").alias("value")), 1e-9, 1e-9), "mean", digits=9)


@query("SELECT 1e-9::DOUBLE + count(*) / 2 AS shape, round(1e-9::DOUBLE + 0.5 * sum(l_quantity * l_quantity), 6) AS rate, round((1e-9::DOUBLE + count(*) / 2) / (1e-9::DOUBLE + 0.5 * sum(l_quantity * l_quantity)), 12) AS mean FROM lineitem WHERE l_linenumber <> 1")
def fixed_tau(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_quantity") ** 2).alias("err2"), (F.col("l_linenumber") != 1).cast("int").alias("mask"))
    return metrics.gamma_posterior(li, 1e-9, 1e-9).select("shape", F.round("rate", 6).alias("rate"), F.round("mean", 12).alias("mean"))


@query(f"""WITH {COVERAGE}, x AS (SELECT gene AS v, sample AS s, sum(cov) AS x FROM cov GROUP BY 1, 2), m AS (SELECT *, CASE WHEN hash_v % 7 = 0 THEN 0 ELSE 1 END AS mask FROM (SELECT *, length(v) + s AS hash_v FROM x)),
w AS (SELECT p_brand AS v, p_type AS k, CAST(count(*) AS DOUBLE) AS a FROM part GROUP BY 1, 2), h AS (SELECT k, s, 1.0::DOUBLE + s AS b FROM (SELECT DISTINCT k FROM w), (SELECT DISTINCT s FROM x)),
f AS (SELECT v, s, sum(a * b) AS fit FROM w JOIN h USING (k) GROUP BY 1, 2), q AS (SELECT m.v, m.s, x / fit AS q FROM m JOIN f ON m.v = f.v AND m.s = f.s WHERE mask = 1),
u AS (SELECT k, s, sum(a * q) / sum(a) AS r FROM q JOIN w USING (v) GROUP BY 1, 2) SELECT h.k, h.s, round(b * r, 6) AS value FROM h JOIN u ON h.k = u.k AND h.s = u.s""")
def nmf_kl_step(spark, d):
    x = domain.coverage(spark, d).groupBy(F.col("gene").alias("v"), F.col("sample").alias("s")).agg(F.sum("cov").alias("x"))
    x = x.withColumn("mask", F.when((F.char_length("v") + F.col("s")) % 7 == 0, 0).otherwise(1))
    w = table(spark, d, "part").groupBy(F.col("p_brand").alias("v"), F.col("p_type").alias("k")).agg(F.count("*").cast("double").alias("a"))
    ks, ss = w.select("k").distinct(), x.select("s").distinct()
    h = ks.crossJoin(F.broadcast(ss)).withColumn("b", 1.0 + F.col("s"))  # one matrix of factors by samples
    return rounded(metrics.multiplicative_step(w, h, x), "value")


# ---- ranks, votes, folds ----


@query("SELECT l_suppkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_hit(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    return ranking.best_hit(li, ["l_suppkey"], "l_extendedprice", ["l_partkey", "l_orderkey", "l_linenumber"]).select("l_suppkey", "l_partkey", "l_extendedprice")


@query("""WITH b AS (SELECT l_suppkey AS haplo, l_linenumber AS gene, l_returnflag AS ref, max(row(CAST(l_quantity AS BIGINT), CAST(50 AS BIGINT))) AS b FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT haplo, ref, CAST(sum(b[1]) AS BIGINT) AS matches, CAST(sum(b[2]) AS BIGINT) AS length FROM b GROUP BY 1, 2)
SELECT haplo, ref, matches, length, round(CAST(matches AS DOUBLE) / length, 9) AS pid FROM (SELECT *, row_number() OVER (PARTITION BY haplo ORDER BY matches DESC, ref) AS r FROM s) WHERE r = 1""")
def blast_consensus(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("haplo"), F.col("l_linenumber").alias("gene"), F.col("l_returnflag").alias("ref"), F.col("l_quantity").cast("long").alias("matches"), F.lit(50).cast("long").alias("length"))
    return rounded(ranking.consensus(li), "pid", digits=9)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(row(ts, event_id)) AS p FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, p, event_type) AS r FROM c) WHERE r = 1""")
def majority_vote(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return ranking.majority(e, ["user_id"], "event_type", "at")


@query("SELECT p_type AS g, sum(CAST(p_size AS DOUBLE)) AS intensity, CAST(row_number() OVER (ORDER BY sum(CAST(p_size AS DOUBLE)) DESC, p_type) AS INTEGER) AS rank FROM part GROUP BY 1")
def strain_rank(spark, d):
    return ranking.rank_strains(_loads(spark, d))


def _loads(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("g"), F.col("p_size").cast("double").alias("value"))


@query("""WITH t AS (SELECT p_brand AS g, sum(CAST(p_size AS DOUBLE)) AS intensity, min(p_type) AS path FROM part GROUP BY 1)
SELECT g, first_value(g) OVER (PARTITION BY path ORDER BY intensity DESC, g) AS head, intensity FROM t""")
def strain_merge(spark, d):
    part = table(spark, d, "part")
    return ranking.merge_strains(part.select(F.col("p_brand").alias("g"), F.col("p_size").cast("double").alias("value")), part.groupBy(F.col("p_brand").alias("g")).agg(F.min("p_type").alias("path")))


@query("""WITH t AS (SELECT p_type AS g, sum(CAST(p_size AS DOUBLE)) AS intensity FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY intensity DESC, g) AS k, count(*) OVER () AS n FROM t)
SELECT g, intensity, NOT (k = n AND n > 1 AND intensity < 1e9) AS kept FROM r""")
def strain_drop(spark, d):
    return ranking.drop_weakest(_loads(spark, d), 1e9)


def _type_sets(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("gene"), (F.col("o_custkey") % 40).alias("g")).agg(F.collect_set(F.dayofyear("o_orderdate")).alias("nodes"))


@query("""WITH p AS (SELECT DISTINCT o_orderpriority AS gene, o_custkey % 40 AS g, dayofyear(o_orderdate) AS node FROM orders), n AS (SELECT gene, g, count(*) AS n FROM p GROUP BY 1, 2),
b AS (SELECT a.gene, a.g, c.g AS h, count(*) AS shared FROM p a JOIN p c ON a.gene = c.gene AND a.node = c.node AND a.g < c.g GROUP BY 1, 2, 3)
SELECT x.g, y.g AS h, CAST(sum(x.n + y.n - 2 * coalesce(shared, 0)) AS BIGINT) AS distance FROM n x JOIN n y ON x.gene = y.gene AND x.g < y.g LEFT JOIN b ON b.gene = x.gene AND b.g = x.g AND b.h = y.g GROUP BY 1, 2""")
def path_distance(spark, d):
    return ranking.path_distances(_type_sets(spark, d))


@query("""WITH p AS (SELECT DISTINCT o_orderpriority AS gene, o_custkey % 40 AS g, dayofyear(o_orderdate) AS node FROM orders), r AS (SELECT gene, min(g) AS g0 FROM p GROUP BY 1), ref AS (SELECT p.gene, node FROM p JOIN r ON p.gene = r.gene AND g = g0),
n AS (SELECT gene, g, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT gene, count(*) AS m FROM ref GROUP BY 1), b AS (SELECT p.gene, p.g, count(*) AS shared FROM p JOIN ref ON p.gene = ref.gene AND p.node = ref.node GROUP BY 1, 2)
SELECT n.gene AS g, round(avg((n.n + m.m - 2 * coalesce(shared, 0)) / CAST(m.m AS DOUBLE)), 9) AS divergence FROM n JOIN m ON n.gene = m.gene LEFT JOIN b ON b.gene = n.gene AND b.g = n.g GROUP BY 1""")
def path_divergence(spark, d):
    sets = _type_sets(spark, d)
    samples = sets.select(F.lit(1).alias("gene"), F.col("gene").alias("g"), F.col("g").alias("sample"), "nodes")
    best = sets.groupBy("gene").agg(F.min_by("nodes", "g").alias("nodes")).select(F.lit(1).alias("gene"), F.col("gene").alias("g"), "nodes")
    return rounded(ranking.path_divergence(samples, best), "divergence", digits=9)


@query("""SELECT l_partkey AS unitig, list_sort(list(DISTINCT l_suppkey)) AS genomes FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = p_size GROUP BY 1""")
def exact_match_assign(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("unitig"), F.col("l_suppkey").alias("ref"), F.lit(100.0).alias("pid"), F.col("l_quantity").cast("int").alias("aligned"))
    return ranking.exact_assignments(hits, domain.unitigs(spark, d).select("unitig", "len"))


@query("""SELECT p_partkey, coalesce(n, -1) AS bin FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey""")
def left_default(spark, d):
    bins = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("bin"))
    return ranking.with_default(table(spark, d, "part").select("p_partkey"), bins, "p_partkey", "bin", -1)


FOLD = "CAST(('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT % 10 AS INTEGER)"


@query(f"SELECT l_orderkey, l_linenumber, {FOLD} AS fold FROM lineitem")
def cv_folds(spark, d):
    return folds.hash_folds(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), 10, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) % 3 AS INTEGER) AS fold FROM lineitem")
def stratified_folds(spark, d):
    return folds.stratified_folds(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 3, "l_orderkey", ["l_linenumber", "l_partkey"])


@query("""WITH m AS (SELECT l_linenumber AS n_strains, count(*) AS runs, avg(l_quantity) AS mean_score FROM lineitem GROUP BY 1)
SELECT n_strains, runs, round(mean_score, 9) AS mean_score, row_number() OVER (ORDER BY mean_score DESC, n_strains) = 1 AS best FROM m""")
def cv_summary(spark, d):
    return rounded(folds.summary(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("n_strains"), F.col("l_quantity").alias("score"))), "mean_score", digits=9)


# ---- graphs ----

BIGRAPH = (
    LINKS
    + """, e AS (
  SELECT gene, src || CASE WHEN src_fwd THEN '+' ELSE '-' END AS u, dst || CASE WHEN dst_fwd THEN '+' ELSE '-' END AS v FROM links
  UNION SELECT gene, dst || CASE WHEN dst_fwd THEN '-' ELSE '+' END, src || CASE WHEN src_fwd THEN '-' ELSE '+' END FROM links)"""
)


def _edges(spark, d):
    return graph.both_strands(domain.link_rows(spark, d))


@query(f"""WITH {BIGRAPH}, {COVERAGE}, t AS (SELECT unitig, sum(cov) AS c FROM cov GROUP BY 1), seg AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_size AS len, coalesce(c, 0) AS c FROM part LEFT JOIN t ON unitig = p_partkey)
SELECT e.gene, u, v, CAST(a.len - 1 + CASE WHEN o.n IS NULL THEN b.len ELSE 0 END AS DOUBLE) AS weight, a.c * (a.len - 1) + CASE WHEN o.n IS NULL THEN b.c * b.len ELSE 0 END AS covweight
FROM e JOIN seg a ON a.id = substr(u, 1, length(u) - 1) JOIN seg b ON b.id = substr(v, 1, length(v) - 1) LEFT JOIN (SELECT DISTINCT gene, u AS n FROM e) o ON o.gene = e.gene AND o.n = e.v""")
def bigraph_edges(spark, d):
    total = domain.coverage(spark, d).groupBy("unitig").agg(F.sum("cov").alias("cov"))
    links = graph.settle(domain.links(spark, d))
    linked = links.select("gene", F.col("src").alias("unitig")).union(links.select("gene", "dst")).distinct()
    seg = linked.join(domain.unitigs(spark, d).drop("gene"), "unitig").join(total, "unitig", "left").withColumn("cov", F.coalesce("cov", F.lit(0.0)))
    return graph.bigraph(links, seg, 1)


@query(f"""WITH {LINKS}, s AS (SELECT src AS unitig, src_fwd AS f FROM links UNION ALL SELECT dst, NOT dst_fwd FROM links), k AS (SELECT unitig, min(f) AS lo, max(f) AS hi FROM s GROUP BY 1)
SELECT 0 AS gene, p_partkey AS unitig, lo IS NULL AS isolated, lo IS NULL OR lo = hi AS tip, CASE WHEN lo = hi THEN lo END AS leaves_forward FROM part LEFT JOIN k ON unitig = p_partkey""")
def graph_tips(spark, d):
    return graph.tips(domain.links(spark, d).withColumn("gene", F.lit(0)), domain.unitigs(spark, d).withColumn("gene", F.lit(0)))


@query(f"""WITH RECURSIVE {LAYERED}, r AS (SELECT DISTINCT gene, u AS node, 0 AS hops FROM layered WHERE u LIKE 'click%@_1' ESCAPE '@' UNION SELECT r.gene, v, hops + 1 FROM r JOIN layered l ON l.gene = r.gene AND l.u = r.node)
SELECT gene, node, min(hops) AS hops FROM r GROUP BY 1, 2""")
def reachable_nodes(spark, d):
    e = graph.settle(domain.layered(spark, d))
    return graph.reachable(e, e.where("u like 'click%\\_1'").select("gene", F.col("u").alias("node")))


@query(f"""WITH RECURSIVE {LAYERED}, a AS (SELECT DISTINCT gene, u AS node FROM layered WHERE u LIKE '%@_1' ESCAPE '@' UNION SELECT a.gene, v FROM a JOIN layered l ON l.gene = a.gene AND l.u = a.node),
b AS (SELECT DISTINCT gene, v AS node FROM layered WHERE v LIKE 'purchase%' UNION SELECT b.gene, u FROM b JOIN layered l ON l.gene = b.gene AND l.v = b.node) SELECT gene, node FROM a INTERSECT SELECT gene, node FROM b""")
def reachable_core(spark, d):
    e = graph.settle(domain.layered(spark, d))
    return graph.core(e, e.where("u like '%\\_1'").select("gene", F.col("u").alias("node")), e.where("v like 'purchase%'").select("gene", F.col("v").alias("node")))


@query(f"""WITH RECURSIVE {BIGRAPH}, both_ AS (SELECT gene, u, v FROM e UNION SELECT gene, v, u FROM e),
r(gene, node, component) USING KEY (gene, node) AS (
  SELECT gene, u, least(u, min(v)) FROM both_ GROUP BY 1, 2
  UNION SELECT b.gene, b.u, min(x.component) FROM r x JOIN both_ b ON b.gene = x.gene AND b.v = x.node JOIN recurring.r o ON o.gene = b.gene AND o.node = b.u WHERE x.component < o.component GROUP BY 1, 2
) SELECT gene, node, component FROM r""")
def components(spark, d):
    return graph.components(graph.strand_rows(domain.link_rows(spark, d)))


@query(f"""WITH RECURSIVE {LAYERED}, s AS (SELECT DISTINCT gene, u AS node FROM layered WHERE u LIKE '%@_1' ESCAPE '@'), r AS (SELECT gene, node AS start, node, 0 AS hops FROM s UNION SELECT r.gene, start, v, hops + 1 FROM r JOIN layered l ON l.gene = r.gene AND l.u = r.node),
m AS (SELECT gene, start, node, min(hops) AS hops FROM r GROUP BY 1, 2, 3), t AS (SELECT gene, node, count(*) AS n, sum(hops) AS total FROM m GROUP BY 1, 2), need AS (SELECT gene, count(*) AS k FROM s GROUP BY 1)
SELECT gene, node, CAST(total AS BIGINT) AS total FROM (SELECT t.*, row_number() OVER (PARTITION BY t.gene ORDER BY total, node) AS q FROM t JOIN need ON t.gene = need.gene AND n = k) WHERE q = 1""")
def lowest_common_descendant(spark, d):
    e = graph.settle(domain.layered(spark, d))
    return graph.lowest_common_descendant(e, e.where("u like '%\\_1'").select("gene", F.col("u").alias("node")))


@query(f"""WITH {LAYERED}, n AS (SELECT gene, v, count(*) AS k FROM layered GROUP BY 1, 2)
SELECT l.gene, u, CASE WHEN k > 1 THEN l.v || 's' ELSE l.v END AS v, CASE WHEN k = 1 THEN l.v END AS through FROM layered l JOIN n ON n.gene = l.gene AND n.v = l.v UNION ALL SELECT gene, v || 's', v, v FROM n WHERE k > 1""")
def node_split(spark, d):
    return graph.split_nodes(domain.layered(spark, d).select("gene", "u", "v"))


@query(f"""WITH {LAYERED} SELECT gene, u, v, 1000 - weight AS capacity, weight AS cost FROM layered UNION ALL SELECT gene, v, u, weight, -weight FROM layered WHERE weight > 0""")
def residual_graph(spark, d):
    e = domain.layered(spark, d)
    return graph.residual(e.select("gene", "u", "v", F.col("weight").alias("flow"), F.lit(1000.0).alias("capacity"), F.col("weight").alias("cost")))


@query(f"""WITH {STEPS}, p AS (SELECT user_id, node AS u, lead(node) OVER (PARTITION BY user_id ORDER BY pos) AS v FROM steps), w AS (SELECT u, v, CAST(count(*) AS DOUBLE) AS weight FROM p WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT u, v, weight, weight * weight AS readweight FROM w""")
def read_weights(spark, d):
    e = domain.layered(spark, d).groupBy("u", "v").agg(F.sum("weight").alias("weight"))
    return graph.read_weights(e, domain.steps(spark, d).select("user_id", "pos", "node"), "user_id")


@query(f"""WITH {LAYERED}, p AS (SELECT user_id, gene, node AS u, lead(node) OVER (PARTITION BY user_id ORDER BY pos) AS v FROM steps), w AS (SELECT u, v, sum(weight) AS weight FROM layered GROUP BY 1, 2) SELECT user_id, sum(weight) AS total FROM p JOIN w USING (u, v) GROUP BY 1""")
def path_weights(spark, d):
    e = domain.layered(spark, d).groupBy("u", "v").agg(F.sum("weight").alias("weight"))
    return graph.path_weights(e, domain.steps(spark, d).select("user_id", "pos", "node"), ["user_id"])


@query(f"""WITH {LAYERED}, n AS (SELECT DISTINCT gene, u AS node FROM layered WHERE u LIKE '%@_3' ESCAPE '@') SELECT gene, node FROM n UNION SELECT l.gene, v FROM layered l JOIN n ON n.gene = l.gene AND n.node = u WHERE u NOT LIKE 'view%' UNION SELECT l.gene, u FROM layered l JOIN n ON n.gene = l.gene AND n.node = v WHERE v NOT LIKE 'view%'""")
def connecting_nodes(spark, d):
    e = domain.layered(spark, d)
    nodes = e.where("u like '%\\_3'").select("gene", F.col("u").alias("node")).distinct()
    return graph.with_neighbours(e, nodes, nodes.where("node like 'view%'"))


@query(f"""WITH {BIGRAPH}, g AS (SELECT DISTINCT u, v FROM e), bins AS (SELECT CAST(p_partkey AS VARCHAR) AS unitig, p_brand AS bin FROM part WHERE p_retailprice % 7 < 6),
s AS (SELECT CAST(p_partkey AS VARCHAR) || unnest(['+', '-']) AS start FROM part WHERE NOT p_retailprice % 7 < 6), r1 AS (SELECT start, v AS node FROM s JOIN g ON u = start UNION SELECT start, start FROM s), r2 AS (SELECT start, v AS node FROM r1 JOIN g ON u = node UNION FROM r1),
v AS (SELECT substr(start, 1, length(start) - 1) AS unitig, bin, sum(p_size) AS votes FROM r2 JOIN bins ON unitig = substr(node, 1, length(node) - 1) JOIN part ON CAST(p_partkey AS VARCHAR) = unitig GROUP BY 1, 2)
SELECT CAST(unitig AS BIGINT) AS unitig, bin, CAST(votes AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY unitig ORDER BY votes DESC, bin) AS q FROM v) WHERE q = 1""")
def bin_propagate(spark, d):
    part = table(spark, d, "part")
    bins = part.where("p_retailprice % 7 < 6").select(F.col("p_partkey").alias("unitig"), F.col("p_brand").alias("bin"))
    return graph.propagate_bins(_edges(spark, d), bins, domain.unitigs(spark, d).select("unitig", "len"), 2)


# ---- sets, strings ----


@query("""(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def symmetric_difference(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return a.subtract(b).union(b.subtract(a))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size = 1)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size = 1)
UNION ALL SELECT 'missing', count(*) FROM (SELECT p_partkey FROM part WHERE p_size = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def set_ops(spark, d):
    a, b = table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"), table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    count = lambda op, df: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count("union", a.union(b).distinct()).union(count("intersect", a.intersect(b))).union(count("missing", b.subtract(a)))


@query("SELECT item_id, translate(reverse(translate(text, 'acgt', 'ACGT')), 'ACGT', 'TGCA') AS rc FROM benchmark")
def revcomp(spark, d):
    return table(spark, d, "benchmark").select("item_id", sequence.reverse_complement(F.translate("text", "acgt", "ACGT")).alias("rc"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN p_name ELSE translate(reverse(p_name), 'ACGT', 'TGCA') END AS piece, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, string_agg(CASE WHEN pos = 1 THEN piece ELSE substr(piece, 4) END, '' ORDER BY pos) AS seq FROM s GROUP BY 1""")
def unitig_walk(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("unitig"), (F.min("l_returnflag") == "N").alias("forward"))
    return sequence.walk_sequences(li, table(spark, d, "part").select(F.col("p_partkey").alias("unitig"), F.col("p_name").alias("seq")), 3, ["l_orderkey"])


@query("""WITH r AS (SELECT regexp_replace(translate(text, 'eiounhdrsl', 'ACGTACGTAC'), '[^ACGT]', '', 'g') AS s FROM benchmark), k AS (SELECT substr(s, i, 4) AS raw, i FROM r, unnest(range(1, length(s) - 2)) AS u(i) WHERE length(s) > 25),
c AS (SELECT least(raw, translate(reverse(raw), 'ACGT', 'TGCA')) AS kmer, i FROM k) SELECT kmer, count(*) AS n, CAST(sum(CASE WHEN i = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_start FROM c GROUP BY 1""")
def kmer_count(spark, d):
    s = F.regexp_replace(F.translate("text", "eiounhdrsl", "ACGTACGTAC"), "[^ACGT]", "")
    return sequence.kmer_composition(table(spark, d, "benchmark").select("item_id", s.alias("seq")), 4)


@query("""WITH c AS (SELECT p_brand, p_type, lpad(upper(to_hex(CAST((p_partkey * 7919) % 16777216 AS BIGINT))), 6, '0') AS color FROM part), x AS (SELECT p_brand, p_type, CAST('0x' || substr(color, 1, 2) AS BIGINT) AS r, CAST('0x' || substr(color, 3, 2) AS BIGINT) AS g, CAST('0x' || substr(color, 5, 2) AS BIGINT) AS b FROM c)
SELECT p_brand, p_type, lpad(upper(to_hex(CAST(floor(avg(r)) AS BIGINT))), 2, '0') || lpad(upper(to_hex(CAST(floor(avg(g)) AS BIGINT))), 2, '0') || lpad(upper(to_hex(CAST(floor(avg(b)) AS BIGINT))), 2, '0') AS color FROM x GROUP BY 1, 2""")
def color_merge(spark, d):
    c = table(spark, d, "part").select("p_brand", "p_type", F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0").alias("color"))
    return c.groupBy("p_brand", "p_type").agg(F.collect_list("color").alias("colors")).select("p_brand", "p_type", columns.mean_color(F.col("colors")).alias("color"))


@query("SELECT p_partkey, round(p_retailprice * (p_size + 77) / p_size, 6) AS kc FROM part")
def kc_correction(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(columns.corrected_kmer_count(F.col("p_retailprice"), F.col("p_size") + 77, 77), 6).alias("kc"))


# ---- paths ----


@query(f"""WITH RECURSIVE {best_by_layer("1.0::DOUBLE", "sum(r.x * weight)")},
back AS (SELECT gene, node, 1.0::DOUBLE AS x FROM lasts UNION ALL SELECT l.gene, l.u, sum(r.x * weight) FROM back r JOIN layered l ON l.gene = r.gene AND l.v = r.node GROUP BY 1, 2),
z AS (SELECT gene, sum(x) AS z FROM ended GROUP BY 1), b AS (SELECT gene, node, sum(x) AS x FROM back GROUP BY 1, 2)
SELECT gene, node, round(best.x / z * b.x, 9) AS p FROM best JOIN b USING (gene, node) JOIN z USING (gene)""")
def path_marginals(spark, d):
    return rounded(pathmodel.node_marginals(domain.layered(spark, d)), "p", digits=9)


def _best(kind: str, sign: str, wanted: str):
    start, step = "struct_pack(cost := 0.0::DOUBLE, path := list_value(node))", f"min(struct_pack(cost := r.x.cost {sign} weight, path := list_append(r.x.path, l.v)))"
    sql = f"WITH RECURSIVE {best_by_layer(start, step)}, w AS (SELECT gene, min(x) AS x FROM ended GROUP BY 1) SELECT gene, x.path AS path, round(0.0::DOUBLE {sign} x.cost, 6) AS value FROM w"

    def run(spark, d):
        return rounded(pathmodel.best_paths(domain.layered(spark, d), kind), "value")

    run.__name__ = wanted
    return query(sql)(run)


_best("heaviest", "-", "heaviest_path")
_best("shortest", "+", "shortest_path")


@query(f"""WITH RECURSIVE {best_by_layer("0.0::DOUBLE", "max(r.x + ln(weight))")} SELECT gene, round(max(x), 6) AS value FROM ended GROUP BY 1""")
def map_path(spark, d):
    """The logarithm of the highest product."""
    return rounded(pathmodel.best_paths(domain.layered(spark, d), "map").select("gene", "value"), "value")


@query(f"""WITH RECURSIVE {best_by_layer("'infinity'::DOUBLE", "max(least(r.x, weight))")} SELECT gene, max(x) AS value FROM ended GROUP BY 1""")
def widest_path(spark, d):
    return pathmodel.best_paths(domain.layered(spark, d), "widest").select("gene", "value")


@query(f"""WITH RECURSIVE {LAYERED}, r AS (SELECT gene, v AS node, weight AS distance FROM layered WHERE u = 'click_1' UNION ALL SELECT r.gene, v, min(distance + weight) FROM r JOIN layered l ON l.gene = r.gene AND l.u = r.node GROUP BY 1, 2)
SELECT gene, node, min(distance) AS distance FROM (SELECT * FROM r UNION ALL SELECT DISTINCT gene, 'click_1', 0.0::DOUBLE FROM layered) GROUP BY 1, 2""")
def shortest_distances(spark, d):
    return pathmodel.distances(domain.layered(spark, d), "click_1")


@query()
def path_samples(spark, d):
    return pathmodel.path_samples(domain.layered(spark, d), 100, 23724839)


@query("""SELECT l_orderkey % 8 AS gene, 's' || l_orderkey AS source, 't' || l_orderkey AS sink,
       list_sort(list_concat(list('l' || l_orderkey || '_' || l_linenumber), list_value('s' || l_orderkey, 't' || l_orderkey))) AS nodes
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey HAVING count(*) > 1""")
def superbubbles(spark, d):
    """Each order's lines side by side between two ends."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey").distinct().sortWithinPartitions("l_orderkey")
    order, line = F.col("l_orderkey").cast("string"), F.concat(F.lit("l"), "l_orderkey", F.lit("_"), "l_linenumber")
    both = F.array(F.struct(F.concat(F.lit("s"), order).alias("u"), line.alias("v")), F.struct(line.alias("u"), F.concat(F.lit("t"), order).alias("v")))
    e = li.select((F.col("l_orderkey") % 8).alias("gene"), F.inline(both))
    return pathmodel.superbubbles(e)


@query()
def cycle_removal(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("v", F.lead("event_type").over(w)).where("v is not null")
    return pathmodel.without_cycles(e.groupBy((F.col("user_id") % 8).alias("gene"), F.col("event_type").alias("u"), "v").agg(F.count("*").cast("double").alias("weight")))


@query()
def flow_decompose(spark, d):
    e = domain.layered(spark, d).union(domain.ends(spark, d))
    return flow.flow_paths(e.select("gene", "u", "v", F.col("weight").alias("flow")))


@query()
def flow_normalise(spark, d):
    e = domain.layered(spark, d)
    got = e.groupBy("gene", "v").agg(F.sum("weight").alias("target"))
    outer = domain.ends(spark, d).select("gene", "u", "v", F.lit(None).cast("double").alias("target"))
    return flow.normalised_flows(e.select("gene", "u", "v").join(got, ["gene", "v"]).select("gene", "u", "v", "target").union(outer))


# ---- fits ----


@query()
def truncnorm_moments(spark, d):
    m = table(spark, d, "customer").select("c_custkey", special.truncated_normal_moments(F.col("c_acctbal") / 1000.0, F.lit(1.0)).alias("m"))
    return m.select("c_custkey", "m.mean", "m.variance")


def _brand_cells(spark, d):
    c = domain.coverage(spark, d).groupBy(F.col("gene").alias("v"), F.col("sample").alias("s")).agg(F.sum("cov").alias("x"))
    return folds.hash_folds(c, 10, ["v", "s"]).select(F.lit(1).alias("model"), "v", "s", "x", (F.col("fold") != 0).cast("double").alias("mask"))


@query()
def variational_nmf(spark, d):
    return factors.variational_restarts(_brand_cells(spark, d), 3, 4, 7, rounds=50)


# ---- annotations ----


@query("""WITH l AS (SELECT DISTINCT l_suppkey % 10 AS strain, l_partkey AS unitig FROM lineitem), c AS (SELECT unitig, avg(strain * 20) AS a, string_agg(CAST(strain AS VARCHAR), ',' ORDER BY strain) AS strains FROM l GROUP BY 1)
SELECT unitig, repeat(lpad(upper(to_hex(CAST(floor(a) AS BIGINT))), 2, '0'), 3) AS color, strains FROM c""")
def strain_colors(spark, d):
    paths = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("strain"), F.col("l_partkey").alias("unitig"))
    shades = paths.select("strain").distinct().withColumn("color", F.repeat(F.lpad(F.hex(F.col("strain") * 20), 2, "0"), 3))
    return annotate.segment_colors(paths, shades)


@query("""WITH p AS (SELECT l_orderkey AS contig, l_linenumber AS pos, l_partkey AS unitig, CASE WHEN p_size < 25 THEN p_size ELSE -1 END AS bin FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT contig, bin, count(*) AS n, min(pos) AS f FROM p WHERE bin >= 0 GROUP BY 1, 2), m AS (SELECT contig, bin FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY n DESC, f, bin) AS r FROM c) WHERE r = 1)
SELECT contig, coalesce(m.bin, -1) AS bin FROM (SELECT DISTINCT contig FROM p) LEFT JOIN m USING (contig)""")
def contig_bins(spark, d):
    paths = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("contig"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("unitig"))
    bins = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("unitig"), F.col("p_size").alias("bin"))
    return annotate.contig_bins(paths, bins)


@query("""WITH e AS (SELECT p_brand AS strain, p_type AS gene, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1, 2), s AS (SELECT *, lead(gene) OVER w AS nxt, lead(first) OVER w AS tt FROM e WINDOW w AS (PARTITION BY strain ORDER BY gene)),
b AS (SELECT *, 'join_' || gene || '_' || nxt || '_' || strain AS buffer FROM s WHERE nxt IS NOT NULL)
SELECT gene || '_' || last AS src, true AS src_fwd, buffer AS dst, true AS dst_fwd, 0 AS overlap FROM b UNION ALL SELECT buffer, true, nxt || '_' || tt, true, 0 FROM b""")
def joined_graphs(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("strain"), F.col("p_type").alias("gene"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("unitig"), F.lit(True).alias("forward"))
    return annotate.joined_genes(part)[1]


# ---- strain fits ----


def _community(spark, d):
    """The layered event graph as two communities of four genes: a segment's count in a sample is the number of users there."""
    signed = lambda n: F.when(F.col(n).isin("source+", "sink+"), F.col(n)).otherwise(F.concat(n, F.lit("+"))).alias(n)
    e = domain.layered(spark, d).union(domain.ends(spark, d)).select("gene", signed("u"), signed("v"))
    edges = e.withColumn("community", F.col("gene") % 2)
    counts = domain.steps(spark, d).groupBy((F.col("gene") % 2).alias("community"), "gene", F.col("node").alias("unitig"), (F.col("user_id") % 10).alias("sample")).agg(F.count("*").alias("x"))
    return edges, counts.withColumn("len", F.lit(10.0))


@query()
def vi_fit(spark, d):
    return communities.fit_strains(*_community(spark, d), 3)


@query()
def cv_select(spark, d):
    return communities.choose_strains(*_community(spark, d), 2)
