"""Closed forms, properties and kernels against independent NumPy formulas."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwright.functions import scalars
from graphwright.graph import Graph, GraphError
from graphwright.operators import dynamics, flow, matrices, montecarlo, prepare, signals, spectral, stats, traversal, whatif
from graphwright.plans import experiments
from graphwright.plans.script import ScriptError, format_script, parse, run_script
from graphwright.sources import readers, writers


def ring(n):
    a = np.zeros((n, n))
    i = np.arange(n)
    a[i, (i + 1) % n] = a[(i + 1) % n, i] = 1
    return a


def two_parts():
    """A weighted clique of 4, an edge, and a lone node."""
    a = np.zeros((7, 7))
    a[:4, :4] = np.array([[0, 1, 2, 1], [1, 0, 1, 3], [2, 1, 0, 1], [1, 3, 1, 0]])
    a[4, 5] = a[5, 4] = 2
    return a


def values(df, column="value"):
    return np.array([r[column] for r in df.orderBy("node").collect()])


@pytest.fixture(scope="module")
def g(spark):
    return Graph.from_matrix(spark, two_parts())


def test_degrees_and_components(g):
    d = matrices.degrees(g)
    assert values(d, "degree").tolist() == two_parts().sum(1).tolist()
    assert values(traversal.components(g), "component").tolist() == [0, 0, 0, 0, 4, 4, 6]
    assert [r.node for r in traversal.largest_component(traversal.components(g)).orderBy("node").collect()] == [0, 1, 2, 3]


def test_laplacian_kinds(g):
    for kind, isolated in (("unnormalized", 0), ("normalized", 0), ("normalized", 1), ("random_walk", 0)):
        m = np.zeros((7, 7))
        for r in matrices.laplacian_entries(g, kind, isolated_diagonal=float(isolated)).collect():
            m[r.i, r.j] = r.value
        assert np.allclose(m, spectral.laplacian(two_parts(), kind, isolated))


@pytest.mark.parametrize("model,dt", [("heat", 0.05), ("hop", 1.0), ("lazy", 0.3), ("pagerank", 0.15)])
def test_joined_steps_equal_kernel(g, model, dt):
    x = dynamics.seeds(g, [0, 4], strengths=[1.0, 0.5])
    assert np.allclose(values(dynamics.run(g, x, model=model, steps=3, dt=dt)), values(dynamics.run_joined(g, x, model=model, steps=3, dt=dt)))


def test_diffusion_conserves_sum_and_scan_is_one(g):
    assert np.isclose(values(dynamics.forward(g, seed_nodes=[1], steps=30, dt=0.05)).sum(), 1)
    assert np.allclose(values(dynamics.scan(g, steps=10, dt=0.05, chunk=3), "score"), 1)


def test_gradient_divergence_dirichlet(g, spark):
    x = signals.from_mapping(g, {0: 1.0, 1: -2.0, 4: 3.0, 6: 5.0})
    v = values(x)
    lap = np.diag(two_parts().sum(1)) - two_parts()
    assert np.allclose(values(signals.laplacian_apply(g, x)), lap @ v)
    assert np.allclose(values(signals.divergence(g, signals.gradient(g, x))), -(lap @ v))
    assert np.isclose(signals.dirichlet(g, x).first().energy, v @ lap @ v / 2)
    assert np.allclose(values(signals.p_laplacian(g, x)), lap @ v)


def test_ring_spectrum_and_foster(spark):
    n = 8
    g = Graph.from_matrix(spark, ring(n))
    s = spectral.decompose(g)
    got = sorted(r.eigenvalue for r in spectral.modes(s).collect())
    assert np.allclose(got, sorted(2 - 2 * np.cos(2 * np.pi * np.arange(n) / n)), atol=1e-9)
    r = spectral.effective_resistance(g, s).withColumnsRenamed({"i": "src", "j": "dst"})
    total = prepare.upper_edges(g.edges).join(r, ["graph_id", "src", "dst"]).agg(F.sum(F.col("weight") * F.col("value"))).first()[0]
    assert np.isclose(total, n - 1)


def test_resistance_is_infinite_across_components(g):
    r = {(x.i, x.j): x.value for x in spectral.effective_resistance(g, spectral.decompose(g)).collect()}
    assert r[0, 4] == np.inf and np.isclose(r[4, 5], 0.5)


def test_heat_smoothing_methods_agree(g):
    x = dynamics.seeds(g, [0])
    a = values(spectral.heat_smooth(g, x, 0.2))
    for method in ("chebyshev", "lanczos"):
        assert np.allclose(a, values(spectral.heat_smooth(g, x, 0.2, method)), atol=1e-8)


def test_conductance_complement_and_sweep(g):
    a = spectral.conductance(g, g.nodes.where("node < 2")).first().phi
    b = spectral.conductance(g, g.nodes.where("node >= 2")).first().phi
    assert np.isclose(a, b)


def test_triangles(g):
    got = {(r.src, r.dst): r.support for r in matrices.triangle_support(g).collect()}
    b = (two_parts() > 0).astype(int)
    assert got == {(i, j): int((b[i] & b[j]).sum()) for i in range(7) for j in range(i + 1, 7) if b[i, j]}


def test_paths(spark):
    a = np.zeros((5, 5))
    for u, v, w in ((0, 1, 1.0), (1, 2, 1.0), (0, 3, 4.0), (3, 4, 4.0), (4, 2, 4.0)):
        a[u, v] = a[v, u] = w
    assert traversal.hop_path(a, 0, 2) == [0, 1, 2] and traversal.bottleneck_path(a, 0, 2) == [0, 3, 4, 2]
    g = Graph.from_matrix(spark, a)
    assert traversal.paths(g, [0], [2], "shortest").first().nodes == [0, 3, 4, 2]
    assert [r.nodes for r in traversal.paths(g, [0], [2], k=4, penalty=3.0).orderBy("rank").collect()][:2] == [[0, 3, 4, 2], [0, 1, 2]]
    with pytest.raises(GraphError):
        traversal.terminals(g, [0], [0])


def test_current_power_is_resistance(g):
    r = flow.current_flow(g, [0], [3]).first()
    lap = np.linalg.pinv(np.diag(two_parts().sum(1)) - two_parts())
    assert np.isclose(r.power, r.resistance) and np.isclose(r.resistance, lap[0, 0] + lap[3, 3] - 2 * lap[0, 3], atol=1e-6)


def test_adjoint_equals_finite_difference(g, spark):
    x, y = dynamics.seeds(g, [0]), dynamics.seeds(g, [3], signal="t").drop("signal")
    d = {(r.i, r.j): r.derivative for r in whatif.edge_sensitivity(g, x, y, steps=5, dt=0.05).collect()}
    a, h = two_parts(), 1e-6
    x0 = np.eye(7)[:, [0]]
    for (i, j), got in d.items():
        b = a.copy()
        b[i, j] += h
        b[j, i] += h
        exact = (dynamics.evolve(b, x0, steps=5, dt=0.05) - dynamics.evolve(a, x0, steps=5, dt=0.05))[3, 0] / h
        assert np.isclose(got, exact, atol=1e-5)


def test_interventions(g):
    assert whatif.make("remove_node", nodes=[0]).apply(g).edges.where("src = 0").isEmpty()
    w = whatif.ReweightEdge(0, 6, weight=2.5).apply(g).edges.where("src = 6").collect()
    assert [(r.dst, r.weight) for r in w] == [(0, 2.5)]
    assert {r.node for r in whatif.RemoveEdges(((0, 1),)).affected_nodes(g).collect()} == {0, 1}
    assert whatif.make("threshold", mode="remove_below", value=2).identifier() == whatif.Threshold("remove_below", 2).identifier()
    with pytest.raises(GraphError):
        whatif.make("nothing")


def test_identity_trials_are_robust_and_seeds_decide(g):
    x = dynamics.seeds(g, [0])
    base = montecarlo.baseline(g, x, steps=5, dt=0.05)
    s = montecarlo.samples(g, x, montecarlo.Identity(), n_trials=3, steps=5, dt=0.05)
    assert stats.fragility(s, base).first().fragility_index < 1e-9
    runs = [montecarlo.samples(g, x, montecarlo.AdditiveNoise(0.1), n_trials=4, steps=5, dt=0.05, parts=p).orderBy("trial", "node").select("value").collect() for p in (1, 3)]
    assert runs[0] == runs[1]
    for kind in montecarlo.NOISE:
        a = montecarlo.noise(kind, 0.2).sample(two_parts(), np.random.default_rng(1))
        assert np.allclose(a, a.T) and (a >= 0).all() and not a.diagonal().any()


def test_sources_round_trip(spark, g, tmp_path):
    np.savetxt(tmp_path / "a.csv", two_parts(), delimiter=",")
    assert np.allclose(readers.from_csv(spark, str(tmp_path / "a.csv")).to_matrix(), two_parts())
    readers.write_tables(g, str(tmp_path / "t"))
    assert np.allclose(readers.from_tables(spark, str(tmp_path / "t")).to_matrix(), two_parts())
    readers.write_npz(g, str(tmp_path / "g.npz"))
    assert np.allclose(readers.from_npz(spark, str(tmp_path / "g.npz")).to_matrix(), two_parts())
    (tmp_path / "bad.csv").write_text("1,2\n3\n")
    with pytest.raises(GraphError):
        readers.from_csv(spark, str(tmp_path / "bad.csv"))


def test_structure_file(spark, tmp_path):
    row = "ATOM  {:>5}  CA {:1}ALA {:1}{:>4}{:1}   {:8.3f}{:8.3f}{:8.3f}{:6.2f}  0.00           C\n"
    text = row.format(1, " ", "A", 1, " ", 0, 0, 0, 1) + row.format(2, "A", "A", 2, " ", 5, 0, 0, 0.4) + row.format(3, "B", "A", 2, " ", 3, 0, 0, 0.6)
    text += row.format(4, " ", "B", 7, "C", 20, 0, 0, 1) + "HETATM    5  CA   CA A   9       0.000   0.000   0.000  1.00\nENDMDL\n" + row.format(6, " ", "C", 1, " ", 0, 0, 0, 1)
    (tmp_path / "x.pdb").write_text(text)
    path = str(tmp_path / "x.pdb")
    g = readers.from_pdb(spark, path, cutoff=4.0, mode="inv_distance")
    assert g.labels() == ["A:1", "A:2", "B:7C"] and readers.chains(spark, path) == ["A", "B"]
    assert np.isclose(g.to_matrix()[0, 1], 1 / 3) and g.edges.count() == 2


def test_contacts_equal_all_pairs(spark):
    p = np.random.default_rng(0).uniform(-6, 6, (60, 3))
    df = spark.createDataFrame([("g", i, *map(float, x)) for i, x in enumerate(p)], "graph_id string, node int, x double, y double, z double")
    d = np.sqrt(((p[:, None] - p) ** 2).sum(2))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 2.5}
    assert {(r.src, r.dst) for r in readers.points_to_contacts(df, 2.5).collect()} == want
    v = df.select("graph_id", "node", F.array("x", "y", "z").alias("v"))
    assert {(r.src, r.dst) for r in readers.vectors_to_contacts(v, 2.5, block=16).collect()} == want


def test_symmetrize_and_sanitize(spark):
    a = np.array([[1.0, 2, 0], [0, 0, -1], [3, 4, 0]])
    g = Graph.from_matrix(spark, a)
    for mode, want in (("average", (a + a.T) / 2), ("max", np.maximum(a, a.T)), ("min", np.minimum(a, a.T))):
        assert np.allclose(g.with_edges(prepare.symmetrize(g.edges, mode)).to_matrix(), want), mode
    c = np.maximum(a, 0)
    np.fill_diagonal(c, 0)
    assert np.allclose(prepare.sanitize(g).to_matrix(), (c + c.T) / 2)


def test_empty_graph(spark):
    g = Graph.from_matrix(spark, np.zeros((3, 3)))
    assert values(dynamics.forward(g, steps=3)).tolist() == [1, 0, 0]
    assert values(traversal.components(g), "component").tolist() == [0, 1, 2]
    assert matrices.graph_summary(g).first().edges == 0


SCRIPT = """
LOAD DEMO NODES 12 SEED 1 AS g   # a comment
SEED g NODES [0, 3] STRENGTH 2.0 AS s; DIFFUSE s STEPS 5 DT 0.05 MODEL "diffusion" AS d
SPECTRAL g MODES 4 LAPLACIAN normalized AS m
COUNTERFACTUAL g REMOVE_EDGE (0, 1) COMPARE s AS c
COUNTERFACTUAL g BLOCK_PATH [0, 1, 2] FACTOR 0.5 AS b
EXPORT d TO "d.csv"
EXPORT g TO "g.json" FORMAT json
LET k AS [1, 2.5, "x\\n"]
DESCRIBE c
SHOW
HELP SEED
"""


def test_script(spark, tmp_path):
    it = run_script(spark, SCRIPT, base=str(tmp_path))
    assert it.values["c"].info["edges_after"] == it.values["c"].info["edges_before"] - 1
    assert it.values["c"].info["n_compared"] == 12
    rows = (tmp_path / "d.csv").read_text().splitlines()
    assert rows[0] == "node,state" and len(rows) == 13
    assert json.loads((tmp_path / "g.json").read_text())["kind"] == "graph"
    assert parse(format_script(SCRIPT)) is not None and format_script(format_script(SCRIPT)) == format_script(SCRIPT)


@pytest.mark.parametrize("text", ["LOAD", "SEED g AS s", "DIFFUSE x AS y", 'LET a AS "open', "COUNTERFACTUAL g AS c", "NOTHING", "LOAD DEMO AS g\nDIFFUSE g AS d", "LET a AS @"])
def test_script_faults(spark, text):
    with pytest.raises(ScriptError):
        run_script(spark, text)


def test_experiment(spark, tmp_path):
    config = json.loads(json.dumps(experiments.EXAMPLE))
    config["graph"]["params"]["n"] = 14
    config["tasks"] = [t for t in config["tasks"] if t["kind"] in ("diffusion", "robustness")] + [{"name": "bad", "kind": "pathway", "allow_failure": True, "params": {}}, {"name": "after", "kind": "mediation", "depends_on": ["bad"]}]
    config["tasks"][1]["params"] = {"n_trials": 3, "steps": 5}
    s = experiments.run(spark, config, str(tmp_path))
    assert {k: v["status"] for k, v in s["tasks"].items()} == {"diffusion": "success", "robustness": "success", "bad": "failed", "after": "skipped"}
    assert s["status"] == "success" and os.path.exists(tmp_path / "example" / "report.html")
    with pytest.raises(experiments.ConfigError, match="depend on each other"):
        experiments.Config.of({"tasks": [{"name": "a", "kind": "scan", "depends_on": ["b"]}, {"name": "b", "kind": "scan", "depends_on": ["a"]}]}).validate()


def test_scalars(spark):
    df = spark.createDataFrame([("  Ab c!!d ",), ("--",)], "t string").select(scalars.slug(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == ["ab-c-d", "item"] == [scalars.slugify("  Ab c!!d "), scalars.slugify("--")]
    assert scalars.stable_json({"b": float("nan"), "a": np.int64(2)}) == '{"a": 2, "b": null}'


def test_session_and_report(spark, g, tmp_path):
    data = json.loads(json.dumps(experiments.session_dump(g, {"dt": 0.1}, {"d": matrices.degrees(g)})))
    h, params, results = experiments.session_load(spark, data)
    assert np.allclose(h.to_matrix(), two_parts()) and params == {"dt": 0.1} and results["d"].count() == 7
    paths = writers.report(str(tmp_path), "r", {"degrees": matrices.degrees(g)}, {"n": 7}, order={"degrees": ["node"]})
    assert all(os.path.getsize(p) for p in paths)


def test_streaming_transitions(spark, tmp_path):
    import datetime

    from graphwright.streaming import transitions

    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(minutes=i), i % 2, "abc"[i % 3]) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    q = transitions.steps(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("steps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.user_id, r.previous, r.event_type) for r in spark.table("steps").collect())
    want = sorted((u, a[3], b[3]) for u in (0, 1) for a, b in zip([r for r in rows if r[2] == u], [r for r in rows if r[2] == u][1:], strict=False))
    assert got == want


def test_ablation_scan_kinds(spark, g):
    from graphwright.plans import catalogue

    seed = dynamics.seeds(g, [0])
    got = {r.i: r for r in whatif.ablation_scan(g, seed, kind="mutations", steps=8, dt=0.02).collect()}
    assert len(got) == 7
    for node in (1, 4):
        want = whatif.evaluate(g, whatif.MutateNode(node), seed, model="heat", steps=8, dt=0.02).first()
        assert got[node].l1_delta == pytest.approx(want.l1_delta) and got[node].l2_delta == pytest.approx(want.l2_delta)
    with pytest.raises(GraphError):
        whatif.ablation_scan(g, seed, kind="chains")
    all_edges = catalogue.queries()["edge_ablation"](spark, "/root/testdata/sf0.001")
    assert all_edges.count() > 12 and catalogue.queries()["mutation_scan"](spark, "/root/testdata/sf0.001").select("factor").distinct().count() == 3


def test_discordance_against_all_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 64, 101):
        for top in (3, 10**6):
            a, b = rng.integers(0, top, n).astype(float), rng.integers(0, top, n).astype(float)
            sign = (np.sign(a[:, None] - a) * np.sign(b[:, None] - b))[np.triu_indices(n, 1)]
            assert stats.discordance(a, b) == (sign.sum(), np.abs(sign).sum())
