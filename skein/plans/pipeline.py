"""From graphs and coverage to strains: scan, prepare, fit, select, write."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.sequence import walk_sequences
from skein.operators import coverage, factorgraph, graph, outliers
from skein.operators.pathmodel import break_cycles, given, some, sources_and_sinks
from skein.operators.strains import Gene, StrainModel
from skein.sources import readers, writers


log = logging.getLogger("skein")


@dataclass
class Config:
    """Options of a run; the names follow the command line."""

    graph_dir: str
    k: int
    stub: str = ""
    genes: str = ""
    lengths: str = ""
    frac_cov: float = 0.02
    min_cov: float = 1.0
    min_frac_cov: float = 0.05
    strains: int = 5
    relevance: bool = True
    squares: bool = False
    noise: bool = True
    bias: bool = True
    bias_type: str = "unitig"
    tau_type: str = "auto"
    smoother: str = "isotonic"
    iterations: int = 250
    folds: int = 10
    read_length: int = 100
    seed: int = 23724839
    uncertain: float = 2.0
    restarts: int = 10
    gene_rounds: int = 4
    filter_genes: bool = True
    gene_deviance: bool = True
    relax: bool = True
    elbow: bool = True
    init_type: str = "bnmf"
    most_width: int = 16


def scan(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    unitigs, links = readers.gfa(spark, f"{cfg.graph_dir}/*.gfa")
    cov = readers.coverage(spark, f"{cfg.graph_dir}/*.tsv")
    stop = readers.stops(spark, f"{cfg.graph_dir}/*.stops")
    dead = readers.dead_ends(spark, f"{cfg.graph_dir}/*.deadends") if readers.exists(spark, f"{cfg.graph_dir}/*.deadends") else spark.createDataFrame([], "gene string, unitig string")
    out = {"dead": dead, "unitigs": unitigs, "links": links, "coverage": cov.where("gene <> ''"), "stops": stop, "lengths": readers.gene_lengths(spark, cfg.lengths)}
    if cfg.genes:
        chosen = readers.names(spark, cfg.genes)
        out = {k: df.join(chosen, "gene", "left_semi") for k, df in out.items()}
    return out


ENDS = "gene string, role string, node string"


def ends(tables: dict[str, DataFrame], overlap: int) -> DataFrame:
    """(gene, role, node): sources and sinks of each gene by the stop-codon rule, one task a gene; genes that lack either are left out."""
    unitigs, links = tables["unitigs"], tables["links"]
    total = tables["coverage"].groupBy("gene", "unitig").agg(F.sum("cov").alias("cov"))
    edges = graph.bigraph(links, unitigs.join(total, ["gene", "unitig"], "left").select("gene", "unitig", "len", F.coalesce("cov", "kc", F.lit(0.0)).alias("cov")), overlap)
    none = F.lit(None)
    e = edges.select("gene", F.lit("e").alias("t"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").alias("w"))
    n = graph.tips(links, unitigs).join(unitigs.select("gene", "unitig", "len"), ["gene", "unitig"])
    n = n.select("gene", F.when(F.col("tip"), F.when(F.col("isolated"), "i").otherwise("t")).otherwise("n").alias("t"), F.col("unitig").alias("a"), F.col("leaves_forward").cast("string").alias("b"), F.col("len").cast("double").alias("w"))
    s = tables["stops"].select("gene", F.lit("s").alias("t"), F.col("unitig").alias("a"), F.col("forward").cast("string").alias("b"), F.col("nth").cast("double").alias("w"))
    dead = tables["dead"].select("gene", F.lit("d").alias("t"), F.col("unitig").alias("a"), none.cast("string").alias("b"), none.cast("double").alias("w"))
    least = tables["lengths"].select("gene", F.lit("l").alias("t"), none.cast("string").alias("a"), none.cast("string").alias("b"), (F.col("aa_len") * 3).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = dict(list(pdf.groupby("t")))
        get = lambda k: part.get(k, pdf.iloc[:0])
        nodes = pd.concat([get("n"), get("t"), get("i")])
        known = {"true": True, "false": False}
        stop = [(a, b == "true") for a, b, _ in sorted(zip(get("s")["a"], get("s")["b"], get("s")["w"], strict=True), key=lambda x: x[2])]
        ends_of = {a: known.get(b) for k in "ti" for a, b in zip(get(k)["a"], get(k)["b"], strict=True)}
        limit = float(get("l")["w"].iloc[0]) if len(get("l")) else float("inf")
        sources, sinks = sources_and_sinks(list(zip(get("e")["a"], get("e")["b"], get("e")["w"], strict=True)), dict(zip(nodes["a"], nodes["w"], strict=True)), ends_of, set(get("i")["a"]), stop, limit, set(get("d")["a"]))
        rows = [("source", x) for x in dict.fromkeys(sources)] + [("sink", x) for x in dict.fromkeys(sinks)] if sources and sinks else []
        return some({"gene": [pdf["gene"].iloc[0]] * len(rows), "role": [r for r, _ in rows], "node": [x for _, x in rows]})

    return given(e.union(n).union(s).union(dead).union(least).groupBy("gene").applyInPandas(run, ENDS))


def prepare(tables: dict[str, DataFrame], cfg: Config) -> dict[str, DataFrame]:
    """Rooted edges and adjusted counts (gene, unitig, sample, cov, x, adj_len) of kept genes and samples; degenerate segments."""
    role = graph.settle(ends(tables, cfg.k))
    x = coverage.adjust(tables["coverage"], tables["unitigs"], cfg.read_length, cfg.k)
    kept = coverage.select_samples(tables["coverage"].join(role, "gene", "left_semi"), coverage.read_factor(cfg.read_length, cfg.k), cfg.min_cov, cfg.min_frac_cov).where("kept")
    source, sink = role.where("role = 'source'"), role.where("role = 'sink'")
    edges = graph.rooted(graph.both_strands(tables["links"]), source, sink)
    wide = factorgraph.graph_widths(edges).where(F.col("width") > cfg.most_width).select("gene")
    edges = edges.join(wide, "gene", "left_anti")
    if cfg.filter_genes:
        at_ends = role.select("gene", "role", F.regexp_replace("node", "[+-]$", "").alias("unitig")).distinct()
        value = coverage.role_coverage(tables["coverage"], at_ends).withColumnRenamed("end_cov", "value")
        bad = outliers.outlier_genes(value, 3.0, 0.8).where("outlier")
        edges = edges.join(bad, "gene", "left_anti")
    return {"edges": graph.settle(edges), "x": x.join(kept, "sample", "left_semi"), "degenerate": outliers.duplicate_sequences(tables["unitigs"], "seq", ["gene", "unitig"]).where("degenerate").select("gene", "unitig"), "ends": role}


def _build(edges: pd.DataFrame, x: pd.DataFrame, degenerate: set[tuple[str, str]], cfg: Config, strains: int, seed: int) -> tuple[StrainModel, pd.MultiIndex, list]:
    genes, rows = [], {}
    have = set(zip(x["gene"], x["unitig"], strict=True))
    for name, part in sorted(edges.groupby("gene")):
        weight = {(u, v): 1.0 for u, v in zip(part["u"], part["v"], strict=True)}
        left = break_cycles(weight)
        own = sorted({n[:-1] for e in left for n in e if n not in ("source+", "sink+")}, key=lambda u: (len(u), u))
        if any((name, u) not in have for u in own) or not own:
            continue
        for u in own:
            rows[name, u] = len(rows)
        genes.append(Gene(name, list(left), {u: rows[name, u] for u in own}))
    samples = sorted(x["sample"].unique())
    wide = x.pivot_table(index=["gene", "unitig"], columns="sample", values="x").reindex(list(rows)).fillna(0.0)
    length = x.groupby(["gene", "unitig"])["adj_len"].first().reindex(list(rows)).to_numpy()
    gone = np.array([float(k in degenerate) for k in rows])
    counts = wide.to_numpy()
    for gene in genes:
        own = sorted(gene.rows.values())
        ends_ = [gene.rows[n[:-1]] for e in gene.edges for n in e if n not in ("source+", "sink+") and ("source+" in e or "sink+" in e)]
        level = cfg.frac_cov * counts[ends_].sum(1).mean()
        gene.noise = {r for r in own if counts[r].sum() < level}
    by_gene = np.concatenate([np.full(len(g.rows), i) for i, g in enumerate(genes)]) if cfg.bias_type == "gene" else None
    model = StrainModel(genes, counts, length, strains, seed, cfg.relevance, cfg.noise, cfg.bias, cfg.tau_type, cfg.smoother, by_gene, gone, squares=cfg.squares)
    return model, wide.index, samples


def initialise(model: StrainModel, cfg: Config, restarts: int) -> None:
    """bnmf: variational factors made feasible flows; flow and flownmf: the widest paths of one flow, with factorised intensities; nmf: plain factors."""
    if cfg.init_type in ("flow", "flownmf"):
        model.initialise_by_flow(cfg.read_length)
    elif cfg.init_type == "nmf":
        model.initialise_by_factors(restarts)
    else:
        model.initialise(restarts)


def _least(model: StrainModel, cfg: Config) -> float:
    total = float((model.x / np.maximum(model.len[:, None], 1e-12)).mean(0).sum())
    return max(1.5, cfg.frac_cov * total * cfg.read_length) / cfg.read_length


def choose_strains(spark: SparkSession, edges: pd.DataFrame, x: pd.DataFrame, degenerate: set, cfg: Config, most: int) -> DataFrame:
    """(n_strains, fold, surviving, elbo, err, ll, score, ll_total): every number of strains on every fold, each a task of its own; the
    squared error, the expected log-likelihood and the best paths' score (score) are those of the cells left out, ll_total that of all."""
    sent = spark.sparkContext.broadcast((edges, x, degenerate))  # one model's matrix, small by nature
    grid = spark.range(1, most + 1).withColumnRenamed("id", "n_strains").crossJoin(spark.range(cfg.folds).withColumnRenamed("id", "fold"))
    grid = grid.repartition(most * cfg.folds, "n_strains", "fold")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, fold = int(pdf["n_strains"].iloc[0]), int(pdf["fold"].iloc[0])
        model, _, _ = _build(*sent.value, cfg, n, cfg.seed + fold)
        of = np.random.default_rng(cfg.seed).integers(0, cfg.folds, model.x.shape)
        model.mask = (of != fold).astype(float)
        initialise(model, cfg, 1)
        trace = model.update(cfg.iterations, _least(model, cfg), cfg.relax)
        out = (of == fold).astype(float)
        fit = model.len[:, None] * model.theta[:, None] * model.fit()
        seen, model.mask = model.mask, out
        ll, model.mask = model.log_likelihood(), np.ones_like(out)
        total, model.mask = model.log_likelihood(), seen
        err = float((out * (model.x - fit) ** 2).sum() / max(1.0, out.sum()))
        return pd.DataFrame({"n_strains": [n], "fold": [fold], "surviving": [model.g], "elbo": [trace[-1]], "err": [err], "ll": [ll], "score": [model.map_score(out, cfg.relax)], "ll_total": [total]})

    return grid.groupBy("n_strains", "fold").applyInPandas(run, "n_strains long, fold long, surviving int, elbo double, err double, ll double, score double, ll_total double")


def outputs(spark: SparkSession, model: StrainModel, index: pd.MultiIndex, samples: list, tables: dict[str, DataFrame], cfg: Config) -> dict[str, DataFrame]:
    """All outputs of a fit as DataFrames by name."""
    model.best_paths()
    keys = [f"{g}_{u}" for g, u in index]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema) if len(rows) else spark.createDataFrame([], schema)
    wide = lambda m, head, name: frame([(h, *map(float, r)) for h, r in zip(head, m, strict=True)], ", ".join([f"{name} string", *[f"`{c}` double" for c in (samples if m.shape[1] == len(samples) else range(m.shape[1]))]]))
    paths = [(gene, str(g), i, n[:-1], n.endswith("+")) for g, own in enumerate(model.paths) for gene, p in own.items() for i, n in enumerate(p)]
    steps = frame(paths, "gene string, strain string, pos int, unitig string, forward boolean")
    by_gene = tables["unitigs"].select("gene", "unitig", "seq")
    seqs = walk_sequences(steps.withColumn("unitig", F.concat_ws("|", "gene", "unitig")), by_gene.select(F.concat_ws("|", "gene", "unitig").alias("unitig"), "seq"), cfg.k, ["gene", "strain"])
    named = seqs.select(F.concat_ws("_", "gene", "strain").alias("name"), "seq")
    path_text = steps.groupBy("gene", "strain").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("unitig", F.when(F.col("forward"), "+").otherwise("-")).alias("n")))).alias("p"))
    path_text = path_text.select(F.concat_ws("_", "gene", "strain").alias("name"), F.concat_ws(",", F.transform("p", lambda z: z["n"])).alias("seq"))
    strains = [str(g) for g in range(model.g)]
    fit, err = model.len[:, None] * model.theta[:, None] * model.fit(), model.square_error()
    pred = [(v, str(s), *index[v], float(model.mask[v, j]), float(model.live[v]), float(model.x[v, j]), float(fit[v, j]), float(err[v, j]), float(model.exp_tau[v, j])) for v in range(len(index)) for j, s in enumerate(samples)]
    onpath = [[float(1 - model.phi[g.rows[n[:-1]], k]) for g in model.genes for n in model.paths[k][g.name]] for k in range(model.g)]
    return {
        "geneError.csv": frame([(g, *s) for g, s in model.gene_scores().items()], "gene string, mean_sq_error double, mean_elbo double"),
        "margProb.csv": wide(model.phi, keys, "unitig"),
        f"Haplo_{model.g}.fa": named, f"Haplo_{model.g}_path.txt": path_text,
        "maxPath.tsv": steps.groupBy(F.concat_ws("_", "gene", "unitig").alias("unitig")).agg(F.concat_ws("\t", F.array_sort(F.collect_set("strain"))).alias("strains")),
        "Intensity.csv": wide(model.gamma[: model.g], strains, "Haplo"), "varIntensity.csv": wide(model.gamma_var[: model.g], strains, "Haplo"),
        "Bias.csv": frame([(k, float(t)) for k, t in zip(keys, model.theta, strict=True)], "unitig string, theta double"),
        "Precision.csv": wide(model.exp_tau, keys, "unitig"),
        "Divergence.csv": frame([(k, float(d)) for k, d in zip(strains, model.divergence(), strict=True)], "strain string, divergence double"),
        "maxMargProb.csv": frame([(k, float(np.mean(p)) if p else 0.0) for k, p in zip(strains, onpath, strict=True)], "strain string, uncertainty double"),
        "Pred.csv": frame(pred, "v_idx int, sample string, gene string, unitig string, mask double, mask_degen double, x double, x_est double, r2 double, tau double"),
    }


def run(spark: SparkSession, cfg: Config) -> tuple[StrainModel, dict[str, DataFrame]]:
    """The whole run. Scans and preparation are distributed over genes; the prepared matrix of one community is gathered and fitted as one
    model, and numbers of strains and folds are fitted side by side."""
    tables = scan(spark, cfg)
    ready = prepare(tables, cfg)
    edges, x = ready["edges"].toPandas(), ready["x"].toPandas()
    degenerate = {(r["gene"], r["unitig"]) for r in ready["degenerate"].collect()}
    if not len(x) or not len(edges):
        raise ValueError("no gene with sources, sinks and coverage, or no sample with enough of it")
    model, index, samples = _build(edges, x, degenerate, cfg, cfg.strains, cfg.seed)
    for _ in range(cfg.gene_rounds if cfg.filter_genes else 0):
        initialise(model, cfg, 1)
        model.update(2 * cfg.iterations, _least(model, cfg))
        scores = model.gene_deviance() if cfg.gene_deviance else {g: s[0] for g, s in model.gene_scores().items()}
        errors = spark.createDataFrame(list(scores.items()), "gene string, error double")
        gone = {r["gene"] for r in outliers.filter_genes(errors).where("not kept").collect()}
        if not gone or len(gone) == len(scores):
            break
        edges, x = edges[~edges["gene"].isin(gone)], x[~x["gene"].isin(gone)]
        model, index, samples = _build(edges, x, degenerate, cfg, cfg.strains, cfg.seed)
    log.info("%d genes, %d samples, %d strains to begin with", len(model.genes), len(samples), model.g)
    initialise(model, cfg, cfg.restarts)
    model.update(cfg.iterations, _least(model, cfg))
    if cfg.relax:
        model.update(cfg.iterations, _least(model, cfg), True)
    model.update(cfg.iterations, _least(model, cfg), cfg.relax, cfg.uncertain)
    scores = None
    if cfg.elbow and model.g >= 4 and len(samples) >= 5:
        scores = graph.settle(choose_strains(spark, edges, x, degenerate, cfg, model.g + 1))
        best = scores.groupBy("surviving").agg(F.avg("score").alias("score")).orderBy(F.desc("score"), "surviving").first()["surviving"]
        if best != model.g:
            model, index, samples = _build(edges, x, degenerate, cfg, best, cfg.seed)
            initialise(model, cfg, cfg.restarts)
            model.update(cfg.iterations, _least(model, cfg), cfg.relax)
    out = outputs(spark, model, index, samples, tables, cfg)
    if cfg.stub:
        writers.fit(out, cfg.stub)
        if scores is not None:
            by = scores.drop("n_strains").withColumnRenamed("surviving", "n_strains").withColumnRenamed("score", "ll_max")
            writers.fold_summary(by.select("n_strains", "fold", "elbo", "err", "ll", "ll_max", "ll_total"), f"{cfg.stub}CV.csv")
        long = lambda m: spark.createDataFrame([(g, s, float(m[g, s])) for g in range(m.shape[0]) for s in range(m.shape[1])], "g int, s int, value double")
        writers.posterior_parameters(long(model.gamma_mu), long(model.gamma_tau), cfg.stub)
        odds = [(g.name, n, float(np.exp(np.clip(model.odds[g.rows[n[:-1]], 0], -500, 500)))) for g in model.genes for n in g.dag.names if n[:-1] in g.rows]
        links = spark.createDataFrame([(g.name, u, v) for g in model.genes for u, v in g.edges], "gene string, u string, v string")
        writers.factor_graphs(links, spark.createDataFrame(odds, "gene string, node string, weight double"), f"{cfg.stub}factors")
        writers.summary(spark, [f"{model.g} strains over {len(model.genes)} genes and {len(samples)} samples"], f"{cfg.stub}summary.txt")
    log.info("%d strains", model.g)
    return model, out


def logged(path: str, level: int = logging.INFO) -> logging.Logger:
    """The run's log, to a file of the driver as well."""
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.setLevel(level)
    log.addHandler(handler)
    return log


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Resolve strains on segment graphs")
    p.add_argument("graph_dir")
    p.add_argument("k", type=int)
    p.add_argument("stub")
    p.add_argument("-l", "--genes", default="")
    p.add_argument("-t", "--lengths", required=True)
    for flags, kind, default in (
        (("-f", "--frac_cov"), float, 0.02), (("-m", "--min_cov"), float, 1.0), (("-mf", "--min_frac_cov"), float, 0.05), (("-g", "--strains"), int, 5), (("-i", "--iterations"), int, 250),
        (("-nfo", "--folds"), int, 10), (("-r", "--read_length"), int, 100), (("-s", "--seed"), int, 23724839), (("-u", "--uncertain"), float, 2.0), (("-nr", "--restarts"), int, 10), (("-ngf", "--gene_rounds"), int, 4),
    ):
        p.add_argument(*flags, type=kind, default=default)
    p.add_argument("--bias_type", choices=["unitig", "gene"], default="unitig")
    p.add_argument("--tau_type", choices=["fixed", "log", "empirical", "auto", "poisson"], default="auto")
    p.add_argument("--smoother", choices=["isotonic", "lowess", "quadratic"], default="isotonic")
    p.add_argument("--init_type", choices=["bnmf", "flow", "flownmf", "nmf"], default="bnmf")
    p.add_argument("--ard2", dest="squares", action="store_true")
    for flag, name in (("--no_ard", "relevance"), ("--no_noise", "noise"), ("--nobias", "bias"), ("--nofilter", "filter_genes"), ("--norelax", "relax"), ("--norun_elbow", "elbow"), ("--nogenedev", "gene_deviance")):
        p.add_argument(flag, dest=name, action="store_false")
    cfg = Config(**vars(p.parse_args(argv)))
    spark = SparkSession.builder.appName("skein").getOrCreate()
    if cfg.stub and "://" not in cfg.stub:
        logged(f"{cfg.stub}run.log")
    model, _ = run(spark, cfg)
    print(f"{model.g} strains over {len(model.genes)} genes and {model.x.shape[1]} samples")


if __name__ == "__main__":
    main()
