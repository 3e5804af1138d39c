"""What the rounds of ego_graphs write, and its query where a part is missing."""

import pytest

from skein.operators import iteration, wavefront
from skein.plans import graphs, registry


@pytest.fixture(params=[False, True], ids=["one task", "shuffled"])
def written(request, monkeypatch):
    """Rows of each settled table, also where all is shuffled and no edge table goes out as a broadcast."""
    if request.param:
        for module in (iteration, wavefront):
            monkeypatch.setattr(module, "FEW", 0)
        monkeypatch.setattr(iteration, "SMALL", 0)
        monkeypatch.setattr(wavefront, "BROADCAST_ROWS", 0)
    rows, write = [], iteration.settle

    def settle(df):
        out = write(df)
        rows.append(out._skein_rows)
        return out

    for module in (iteration, wavefront):
        monkeypatch.setattr(module, "settle", settle)
    return rows


def test_rounds_write_what_lies_within_and_the_rim_once(spark, written):
    line = [(1, f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(12)] + [(1, "n05", "n02", 0.0), (1, "n00", "n03", 1.5)]
    fan = [(1, f"n{i:02}", f"x{i:02}_{j}", 50.0) for i in range(12) for j in range(20)]
    edges = spark.createDataFrame(line + fan + [(None, "n00", "n09", 0.0)], "gene int, u string, v string, weight double")
    starts = spark.createDataFrame([(1, "n00"), (None, "n00")], "gene int, start string")
    got = {(r.gene, r.node): (r.distance, r.on_rim) for r in wavefront.ego_graphs(edges, starts, 8).collect()}
    near = {f"n{i:02}": float(i if i < 3 else i - 1.5) for i in range(10)}
    want = {(1, n): (d, False) for n, d in near.items()} | {(1, f"x{n[1:]}_{j}"): (d + 50, True) for n, d in near.items() for j in range(20)} | {(1, "n10"): (8.5, True), (None, "n00"): (0.0, False)}
    assert got == want
    assert sum(written) <= len(want) + 4 * len(near) + 20  # before: all rows that were met, in each round
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("skein_")]


def test_a_weight_that_is_missing_leaves_no_distance(spark):
    edges = spark.createDataFrame([(1, "a", "b", None), (1, "a", "c", None), (1, "a", "d", 2.0), (1, "d", "c", 2.0)], "gene int, u string, v string, weight double")
    starts = spark.createDataFrame([(1, "a")], "gene int, start string")
    got = {r.node: (r.distance, r.on_rim) for r in wavefront.ego_graphs(edges, starts, 3).collect()}
    assert got == {"a": (0.0, False), "b": (None, None), "c": (4.0, True), "d": (2.0, False)}


def test_rounds_do_not_shuffle_the_edges(spark, monkeypatch):
    monkeypatch.setattr(iteration, "SMALL", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans, write = [], iteration.settle
        for module in (iteration, wavefront):
            monkeypatch.setattr(module, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
        edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}", 1.0) for i in range(9)], "gene int, u string, v string, weight double")
        wavefront.ego_graphs(edges, spark.createDataFrame([(1, "n0")], "gene int, start string"), 4).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [p for p in plans if "Bucketed: true" in p]
    assert joins


def test_ego_graphs_where_a_part_is_missing(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    lines = "(5, 1, 1), (5, 2, 2), (5, 3, 3), (10, 3, 1), (10, 1, 2), (10, 4, 3), (10, 9, 4), (15, 9, 1), (15, 2, 2)"
    con.sql(f"create table lineitem as select * from (values {lines}) t(l_orderkey, l_partkey, l_linenumber)")
    con.sql("create table part as select * from (values (2, 'Brand#25', 5), (3, 'Brand#1', 40), (4, 'Brand#25', 7), (1, 'Brand#2', 20)) t(p_partkey, p_brand, p_size)")
    for t, keys in (("lineitem", "l_orderkey, l_partkey"), ("part", "p_partkey")):
        cast = ", ".join(f"{k}::BIGINT AS {k}" for k in keys.split(", "))
        con.sql(f"copy (select * replace ({cast}) from {t}) to '{tmp_path}/{t}.parquet'")
    want = sorted(map(repr, con.sql(registry.ORACLES["ego_graphs"]).fetchall()))
    got = sorted(repr(tuple(r)) for r in graphs.ego_graphs(spark, str(tmp_path)).select("gene", "start", "node", "distance", "on_rim").collect())
    assert got == want and want


def test_links_are_told_apart_in_more_tasks_where_there_are_more(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id div 5 AS l_orderkey", "id AS l_partkey", "cast(id % 5 AS int) AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id AS p_partkey", "'Brand#25' AS p_brand", "cast(9 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(graphs, "LINK_ROWS", 8)
    edges, core = graphs._sized(spark, str(tmp_path))
    assert "RepartitionByExpression [src" in (plan := edges._jdf.queryExecution().optimizedPlan().toString()) and ", 10" in plan  # 80 links
    assert edges.count() == 160 and core.count() == 200
