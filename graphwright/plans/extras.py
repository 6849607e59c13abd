"""Further registered queries: round trips, degenerate random models and invariants, whose results SQL knows exactly."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..graph import checkpoint_folder
from ..operators import dynamics, montecarlo, prepare, spectral, traversal, whatif
from ..sources import readers
from ..streaming import transitions
from . import fixtures as fx

#: Perturbations whose strength is nothing: every sample is the graph itself.
STILL = {
    "identity": montecarlo.Identity(), "additive": montecarlo.AdditiveNoise(0.0), "lognormal": montecarlo.LognormalNoise(0.0), "edge_dropout": montecarlo.EdgeDropout(0.0),
    "node_dropout": montecarlo.NodeDropout(0.0), "thinning": montecarlo.ContactThinning(1.0, by_weight=False), "degree": montecarlo.DegreeNoise(0.0), "rewire": montecarlo.Rewire(0.0),
    "composite": montecarlo.CompositePerturbation((montecarlo.EdgeDropout(0.0), montecarlo.LognormalNoise(0.0))),
}
#: Distributions without spread: kind, parameters and the only value.
FIXED = (("constant", {"value": 2.5}, 2.5), ("normal", {"mean": 1.5, "std": 0.0}, 1.5), ("uniform", {"low": 3.0, "high": 3.0}, 3.0), ("lognormal", {"mean": 0.0, "sigma": 0.0}, 1.0), ("bernoulli", {"p": 1.0}, 1.0))


def _shared(spark) -> str:
    return f"{checkpoint_folder(spark)}/trip-{uuid.uuid4().hex}"


def still_perturbations(spark, sf) -> DataFrame:
    g = fx.nations(spark, sf)
    of = lambda name: montecarlo.samples(g, dynamics.seeds(g), STILL[name], n_trials=2, steps=10, dt=0.02, parts=2).withColumn("model", F.lit(name))
    return reduce(DataFrame.unionByName, map(of, STILL))


def edge_bootstrap_total(spark, sf) -> DataFrame:
    """Bootstrapped edges keep the graph's total weight, whatever is drawn."""
    g = fx.nations(spark, sf)
    a, rng = g.to_matrix(), np.random.default_rng(5)
    rows = [(k, float(montecarlo.EdgeBootstrap(f).sample(a, rng).sum())) for k, f in enumerate((0.5, 1.0, 2.0))]
    return spark.createDataFrame(rows, "trial long, total double")


def csv_round_trip(spark, sf) -> DataFrame:
    """The adjacency matrix written as headerless CSV and read again."""
    g, path = fx.nations(spark, sf), _shared(spark)
    cells = g.nodes.select(F.col("node").alias("i")).crossJoin(g.nodes.select(F.col("node").alias("j")))  # 25 by 25
    cells = cells.join(g.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight"), ["i", "j"], "left").na.fill(0.0, ["weight"])
    lines = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "weight"))).alias("row"))
    lines = lines.repartition(1).sortWithinPartitions("i").select(F.array_join(F.transform("row", lambda c: c["weight"].cast("string")), ","))
    lines.write.text(path)
    return readers.from_csv(spark, path).edges


def tables_round_trip(spark, sf) -> DataFrame:
    path = _shared(spark)
    readers.write_tables(fx.nations(spark, sf), path)
    return readers.from_tables(spark, path).edges


def graph_hashes(spark, sf) -> DataFrame:
    """The hash does not depend on the order of rows, and is 64 digits long; one weight changes it."""
    g = fx.nations(spark, sf)
    h = lambda e, n: scalars.graph_hash(e, n).select("graph_id", F.col("hash"))
    other = whatif.ReweightEdge(0, 1, factor=0.5).apply(g)
    a = h(g.edges, g.nodes).join(h(g.edges.repartition(5, "weight"), g.nodes).withColumnRenamed("hash", "again"), "graph_id").join(h(other.edges, g.nodes).withColumnRenamed("hash", "changed"), "graph_id")
    return a.select((F.col("hash") == F.col("again")).alias("same"), (F.col("hash") != F.col("changed")).alias("differs"), F.length("hash").alias("digits"))


def embedding_moments(spark, sf) -> DataFrame:
    """Coordinates of the spectral embedding are centred and of length 1."""
    e = spectral.embedding(spectral.decompose(fx.nations(spark, sf)), 3).select(F.posexplode("coordinates").alias("axis", "x"))
    return e.groupBy("axis").agg(F.sum("x").alias("total"), F.sum(F.col("x") ** 2).alias("squares"))


def eigen_residuals(spark, sf) -> DataFrame:
    """Of every mode: the largest part of L v - lambda v, and the vector's length."""
    g = fx.nations(spark, sf)
    s = spectral.decompose(g)
    from ..operators.matrices import laplacian_entries

    lv = laplacian_entries(g, "unnormalized").join(s.select("graph_id", "mode", F.col("node").alias("j"), F.col("v").alias("x")), ["graph_id", "j"]).groupBy("graph_id", "mode", F.col("i").alias("node")).agg(F.sum(F.col("value") * F.col("x")).alias("lv"))
    return s.join(lv, ["graph_id", "mode", "node"]).groupBy("mode").agg(F.max(F.abs(F.col("lv") - F.col("eigenvalue") * F.col("v"))).alias("residual"), F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))


def single_paths(spark, sf) -> DataFrame:
    g = fx.nations(spark, sf)
    one = lambda kind, column: traversal.paths(g, [0], [12], kind=kind).select(F.lit(kind).alias("kind"), F.col(column).cast("double").alias("value"))
    return one("shortest", "cost").union(one("widest", "min_weight")).union(one("hops", "length"))


def configured_interventions(spark, sf) -> DataFrame:
    g = fx.nations(spark, sf)
    changes = whatif.from_config([{"type": "remove_node", "nodes": [5]}, {"kind": "composite", "children": [{"kind": "node-removal", "nodes": [3]}, {"kind": "Node_Removal", "nodes": [7, 8]}]}])
    return reduce(lambda h, c: c.apply(h), changes, g).edges


def drawn(spark, sf) -> DataFrame:
    rng = np.random.default_rng(1)
    rows = [(kind, float(x)) for kind, p, _ in FIXED for x in montecarlo.draw(kind, rng, 3, **p)]
    return spark.createDataFrame(rows, "kind string, value double")


def register(query: Callable, out: Callable, rd: Callable[[str], str], nation: str, years: str, diffusion: str, cheapest: str) -> None:
    """Adds the queries of this module. diffusion: SQL of (node, value); cheapest: CTE p0(node, c)."""
    e = f"{nation} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('w')} AS weight FROM e"
    edges = lambda f: lambda spark, sf: out(f(spark, sf), "src", "dst", "weight")
    names = ", ".join(f"'{n}'" for n in STILL)
    query(f"SELECT model, trial::BIGINT AS trial, node, value, 0.0::DOUBLE AS delta FROM ({diffusion}), unnest([{names}]) m(model), range(2) t(trial)", "still_perturbations")(lambda spark, sf: out(still_perturbations(spark, sf), "model", "trial", "node", "value", "delta"))
    query(f"{nation} SELECT k::BIGINT AS trial, {rd('(SELECT sum(w) FROM e)')} AS total FROM range(3) r(k)", "edge_bootstrap_total")(lambda spark, sf: out(edge_bootstrap_total(spark, sf), "trial", "total"))
    query(e, "csv_round_trip")(edges(csv_round_trip))
    query(e, "tables_round_trip")(edges(tables_round_trip))
    query(f"{e} WHERE i NOT IN (3, 5, 7, 8) AND j NOT IN (3, 5, 7, 8)", "configured_interventions")(edges(configured_interventions))
    query(f"{nation} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('w')} AS weight FROM u", "upper_edges")(edges(lambda spark, sf: prepare.upper_edges(fx.nations(spark, sf).edges)))
    query("SELECT true AS same, true AS differs, 64::BIGINT AS digits", "graph_hashes")(lambda spark, sf: out(graph_hashes(spark, sf), "same", "differs", "digits"))
    query("SELECT k::BIGINT AS axis, 0.0::DOUBLE AS total, 1.0::DOUBLE AS squares FROM range(3) r(k)", "embedding_moments")(lambda spark, sf: out(embedding_moments(spark, sf), "axis", "total", "squares"))
    query("SELECT n_nationkey::BIGINT AS mode, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS norm FROM nation", "eigen_residuals")(lambda spark, sf: out(eigen_residuals(spark, sf), "mode", "residual", "norm"))
    widest = "wi AS (SELECT 0 k, 0 node, 1e300::DOUBLE c UNION ALL SELECT k + 1, node, max(c) FROM (SELECT wi.k, e.j node, least(wi.c, w) c FROM wi JOIN e ON e.i = wi.node WHERE wi.k < 10 UNION ALL SELECT k, node, c FROM wi WHERE k < 10) GROUP BY k, node)"
    query(f"{nation}, {cheapest}, {widest} SELECT 'shortest' AS kind, {rd('c')} AS value FROM p0 WHERE node = 12 UNION ALL SELECT 'widest', {rd('c')} FROM wi WHERE k = 10 AND node = 12 UNION ALL SELECT 'hops', CASE WHEN EXISTS (SELECT 1 FROM u WHERE i = 0 AND j = 12) THEN 1.0 ELSE 2.0 END::DOUBLE", "single_paths")(lambda spark, sf: out(single_paths(spark, sf), "kind", "value"))
    query(" UNION ALL ".join(f"SELECT '{k}' AS kind, {v}::DOUBLE AS value FROM range(3)" for k, _, v in FIXED), "distribution_draws")(lambda spark, sf: out(drawn(spark, sf), "kind", "value"))
    change = whatif.ReweightEdge(5, 17, factor=0.1)
    query(f"{nation} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('w')} AS before, {rd('w * 0.1')} AS after FROM u WHERE i = 5 AND j = 17", "affected_edges")(lambda spark, sf: out(change.affected_edges(fx.nations(spark, sf)), "src", "dst", "before", "after"))
    query(f"{nation} SELECT unnest([i, j])::BIGINT AS node FROM u WHERE i = 5 AND j = 17", "affected_nodes")(lambda spark, sf: out(change.affected_nodes(fx.nations(spark, sf)), "node"))
    query(f"{years} SELECT node::BIGINT AS node, count(*)::BIGINT AS n, {rd('avg(x)')} AS mean, {rd('stddev_samp(x)')} AS std, {rd('min(x)')} AS min, {rd('max(x)')} AS max FROM s GROUP BY node", "running_moments")(lambda spark, sf: out(transitions.running_moments(fx.years(spark, sf)), "node", "n", "mean", "std", "min", "max"))
    same = lambda spark, sf: fx.years(spark, sf).withColumn("value", F.col("node").cast("double"))
    query("SELECT n_nationkey::BIGINT AS node, n_nationkey::DOUBLE AS low, n_nationkey::DOUBLE AS high FROM nation", "bootstrap_of_constants")(lambda spark, sf: out(montecarlo.bootstrap(same(spark, sf), np.mean, n_boot=50), "node", "low", "high"))
