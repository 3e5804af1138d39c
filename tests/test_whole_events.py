"""The queries on layered events that have no SQL take in all events of each user."""

import pytest
from pyspark.sql import functions as F

from skein.plans import catalogue, registry

LENGTHS = {0: 1, 1: 4, 8: 9, 9: 7, 16: 12}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    rows = [(100 * u + i, u, 1000 + 10 * i, ["click", "view", "purchase"][(u + i * i) % 3]) for u, n in LENGTHS.items() for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string").write.parquet(f"{d}/events.parquet")
    return d


def test_flows_carry_every_event(spark, tables):
    got = registry.QUERIES["flow_decompose"](spark, tables).collect()
    assert sum(r.amount for r in got) == pytest.approx(len(LENGTHS))
    assert sum(r.amount * len([n for n in r.path if n not in ("source+", "sink+")]) for r in got) == pytest.approx(sum(LENGTHS.values()))


def test_fits_count_every_event(spark, tables):
    edges, counts = catalogue._community(spark, tables)
    assert counts.agg(F.sum("x")).first()[0] == sum(LENGTHS.values())
    assert {r.u.rsplit("_", 1)[1] for r in edges.where("v = 'sink+'").collect()} == {f"{n}+" for n in LENGTHS.values()}


def test_samples_and_flows_reach_the_last_layer(spark, tables):
    assert max(len(r.path) for r in registry.QUERIES["path_samples"](spark, tables).collect()) == 12
    assert any(r.node.endswith("_12") for r in registry.QUERIES["flow_normalise"](spark, tables).collect())
