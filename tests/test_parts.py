"""Partitions of parts follow the line items and spread a part of many orders, degrees make the edges once; Tikhonov smoothing solves its equation where the series of the SQL does not converge."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwright.graph import Graph
from graphwright.operators import matrices, spectral
from graphwright.plans import catalogue
from graphwright.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_partitions_follow_line_items(spark, monkeypatch):
    lines = fx.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(fx, "PART_LINES", 500)
    assert fx.parts(spark, SF).upper.rdd.getNumPartitions() == -(-lines // 500)


@pytest.fixture
def bought(spark, tmp_path):
    """2,000 orders of part 0 and two of their own, one of the two twice; a part in no order."""
    lines = [(k, p) for k in range(2000) for p in (0, 2 * k + 1, 2 * k + 2, 2 * k + 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"p{k}") for k in range(4002)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_pairs_of_a_part_in_every_order_are_spread(spark, bought, monkeypatch):
    monkeypatch.setattr(fx, "PART_LINES", 1000)
    made, degrees = [], matrices.degrees
    monkeypatch.setattr(matrices, "degrees", lambda g: made.append(g) or degrees(g))
    catalogue.queries()["degree_parts"](spark, bought)
    sizes = made[0].upper.where("src = 0").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.sum() == 4000 and len(sizes) == 8 and sizes.max() < 2 * 4000 / 8


def test_degrees_make_the_edges_once(spark, bought):
    """The plan joins the line items with themselves once, and both ends count."""
    df = catalogue.queries()["degree_parts"](spark, bought)
    joins = df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    got = {r.node: (r.degree, r.links) for r in df.collect()}
    assert joins == 1
    assert got == {0: (6000.0, 4000), 4001: (0.0, 0)} | {2 * k + 1: (3.0, 2) for k in range(2000)} | {2 * k + 2: (4.0, 2) for k in range(2000)}


def test_tikhonov_solves_its_equation(spark):
    """All weights near 1 on 25 nodes: the largest eigenvalue of I + L is over 2 / 0.09, so steps of 0.09 run away."""
    a = np.random.default_rng(3).uniform(0.8, 1, (25, 25))
    a = np.triu(a, 1) + np.triu(a, 1).T
    m, x = np.eye(25) + np.diag(a.sum(1)) - a, np.random.default_rng(4).uniform(4000, 5000, 25)
    assert np.linalg.eigvalsh(m)[-1] > 2 / 0.09
    s = spark.createDataFrame([("g", "s", k, float(v)) for k, v in enumerate(x)], "graph_id string, signal string, node int, value double")
    y = np.array([r.value for r in spectral.tikhonov(Graph.from_matrix(spark, a), s).orderBy("node").collect()])
    assert np.abs(m @ y - x).max() < 1e-6
