"""Paths that share segments, parts that are missing, and what is moved."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import coverage as cov
from skein.plans import catalogue, registry


def means(paths, coverage, lens, overlap):
    got = {}
    for key in {p[0] for p in paths}:
        own = [p for p in paths if p[0] == key]
        last = max(p[1] for p in own)
        for _, pos, g, u in own:
            weight = lens[g, u] - (0 if pos == last else overlap)
            for (gg, uu, s), c in coverage.items():
                if (gg, uu) == (g, u):
                    a, b = got.get((key, s), (0, 0))
                    got[key, s] = (a + weight * c, b + weight)
    return {k: a / b for k, (a, b) in got.items() if b > 0}


def made(spark, seed=1):
    r = random.Random(seed)
    units = [(g, u) for g in ("a", "b") for u in range(12)]
    lens = {x: r.randint(1, 9) for x in units}
    coverage = {(*x, s): float(r.randint(1, 50)) for x in units for s in range(6) if r.random() < 0.7}
    paths = [(p, i, *r.choice(units)) for p in range(120) for i in range(r.randint(1, 6))]
    frames = (spark.createDataFrame(paths, "path long, pos int, gene string, unitig long"), spark.createDataFrame([(*k, c) for k, c in coverage.items()], "gene string, unitig long, sample long, cov double"),
              spark.createDataFrame([(*k, n) for k, n in lens.items()], "gene string, unitig long, len int"))
    return frames, means(paths, coverage, lens, 1)


@pytest.mark.parametrize("parts", [None, 1, 3, 7])
def test_path_coverage_equals_plain_means(spark, parts):
    (paths, coverage, lens), want = made(spark)
    paths = paths.repartitionByRange(parts, "path") if parts else paths
    got = {(r.path, r.sample): r.path_cov for r in cov.path_coverage(paths, coverage, lens, 1, ["path"], parts).collect()}
    assert got == pytest.approx(want) and len(got) == len(want)


def test_rows_of_steps_and_samples_are_not_shuffled(spark):
    (paths, coverage, lens), want = made(spark)
    out = cov.path_coverage(paths.repartitionByRange(3, "path"), coverage, lens, 1, ["path"], 3)
    assert len(out.collect()) == len(want)
    plan = [line.strip(" :+-") for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    fan = next(i for i, line in enumerate(plan) if line.startswith("Generate inline"))
    assert not any(line.startswith(("Repartition", "Join")) for line in plan[:fan])
    physical = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].split("\n")
    assert not any("Exchange" in line for line in physical[: next(i for i, line in enumerate(physical) if "Generate inline" in line)])  # before: each step times its samples


def test_path_coverage_of_missing_parts_and_nulls(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    lines = "(1, 1, 1, 0, 5), (1, 9, 2, 0, 5), (2, 1, NULL, 0, 3), (2, 2, 1, 1, 4), (3, 3, 1, 1, 2), (NULL, 1, 1, 0, 7), (NULL, 2, 2, 1, 7), (4, 2, 1, 0, NULL), (5, 1, 1, 1, 6), (5, 1, 1, 1, 6), (6, 4, 1, 0, NULL)"
    con.sql(f"create table lineitem as select l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_linenumber, l_suppkey::BIGINT AS l_suppkey, l_quantity::DOUBLE AS l_quantity from (values {lines}) t(l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity)")
    con.sql("create table part as select p_partkey::BIGINT AS p_partkey, p_brand, p_size from (values (1, 'a', 5), (2, 'b', 9), (3, 'a', 0), (4, 'b', 3)) t(p_partkey, p_brand, p_size)")
    con.sql("create table supplier as select s_suppkey::BIGINT AS s_suppkey, s_nationkey::BIGINT AS s_nationkey from (values (0, 3), (1, 4)) t(s_suppkey, s_nationkey)")
    for t in ("lineitem", "part", "supplier"):
        con.sql(f"copy {t} to '{tmp_path}/{t}.parquet'")
    want = sorted(map(repr, con.sql(registry.ORACLES["path_coverage"]).fetchall()))
    got = sorted(repr(tuple(r)) for r in catalogue.path_coverage(spark, str(tmp_path)).select("l_orderkey", "sample", F.col("path_cov")).collect())
    assert got == want and want
