"""Spectra of graphs and what follows from them, as joins over modes(graph_id, mode, eigenvalue) and vectors(graph_id, mode, node, v).

The decomposition is a kernel per graph; everything else is relational, so that many graphs, times, scales and signals are one plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import transfers
from ..graph import MAX_DENSE, Graph, GraphError, per_graph
from .dynamics import chebyshev_apply, chebyshev_coefficients, heat_lanczos, per_signal
from .matrices import canonical_kind, degrees
from .signals import ONE, dirichlet, robust_zscored, total_variation
from .sparse import EdgeLaplacian, lowest, per_graph_edges
from .traversal import components

ZERO = 1e-8
#: Nodes up to which the first k modes come from a dense matrix.
DENSE_UP_TO = 450


def laplacian(a: np.ndarray, kind: str = "unnormalized", isolated_diagonal: float = 0.0) -> np.ndarray:
    kind, d = canonical_kind(kind), a.sum(1)
    on = d > 1e-12
    if kind == "unnormalized":
        return np.diag(d) - a
    if kind == "normalized":
        r = np.where(on, 1 / np.sqrt(np.where(on, d, 1)), 0)
        return np.diag(np.where(on, 1.0, isolated_diagonal)) - r[:, None] * a * r
    return np.eye(len(a)) - np.where(on, 1 / np.where(on, d, 1), 0)[:, None] * a


def eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues (tiny ones 0) and vectors whose entry of largest size is positive."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    values[np.abs(values) < 1e-11] = 0
    top = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(top < 0, -1, 1)


def decompose(graph: Graph, kind: str = "unnormalized", *, k: int | None = None, isolated_diagonal: float = 0.0, dense_up_to: int = DENSE_UP_TO) -> DataFrame:
    """(graph_id, mode, eigenvalue, node, v): the first k modes, one row per node. A random-walk Laplacian is symmetrised first.

    With k, graphs of over `dense_up_to` nodes get their lowest modes from the edge list, without a matrix and without a limit of nodes.
    """
    if k is not None:
        return truncated(graph, kind, k, isolated_diagonal, dense_up_to)

    def kernel(a: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> dict:
        values, vectors = eigen(laplacian(a, kind, isolated_diagonal))
        m = len(values) if k is None else min(k, len(values))
        return {"mode": np.repeat(np.arange(m), len(ids)), "eigenvalue": np.repeat(values[:m], len(ids)), "node": np.tile(ids, m), "v": vectors[:, :m].T.ravel()}

    return per_graph(graph, kernel, "mode int, eigenvalue double, node int, v double")


def truncated(graph: Graph, kind: str, k: int, isolated_diagonal: float, dense_up_to: int) -> DataFrame:
    def kernel(ids: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> dict:
        n = len(ids)
        m = max(min(k, n), 0)
        if n <= dense_up_to or (m >= n - 1 and n <= MAX_DENSE):
            a = np.zeros((n, n))
            np.add.at(a, (i, j), w)
            values, vectors = eigen(laplacian(a, kind, isolated_diagonal))
        else:
            values, vectors = lowest(EdgeLaplacian(n, i, j, w, kind, isolated_diagonal), m)
        return {"mode": np.repeat(np.arange(m), n), "eigenvalue": np.repeat(values[:m], n), "node": np.tile(ids, m), "v": vectors[:, :m].T.ravel()}

    return per_graph_edges(graph, kernel, "mode int, eigenvalue double, node int, v double")


def modes(spectrum: DataFrame) -> DataFrame:
    return spectrum.groupBy("graph_id", "mode").agg(F.first("eigenvalue").alias("eigenvalue"))


def nontrivial(spectrum: DataFrame, k: int, tolerance: float = ZERO) -> DataFrame:
    """The first k modes with an eigenvalue over the tolerance."""
    m = modes(spectrum).where(F.col("eigenvalue") > tolerance).withColumn("turn", F.row_number().over(Window.partitionBy("graph_id").orderBy("mode"))).where(F.col("turn") <= k)
    return spectrum.join(m.select("graph_id", "mode"), ["graph_id", "mode"], "left_semi")


def summary(spectrum: DataFrame) -> DataFrame:
    """(graph_id, modes, trace, algebraic_connectivity (first over 1e-8), second_eigenvalue, gap, radius)."""
    lam = F.col("eigenvalue")
    return modes(spectrum).groupBy("graph_id").agg(
        F.count("*").alias("modes"), F.sum(lam).alias("trace"), F.coalesce(F.min(F.when(lam > ZERO, lam)), F.lit(0.0)).alias("algebraic_connectivity"),
        F.coalesce(F.max(F.when(F.col("mode") == 1, lam)), F.lit(0.0)).alias("second_eigenvalue"),
        (F.coalesce(F.max(F.when(F.col("mode") == 1, lam)), F.lit(0.0)) - F.max(F.when(F.col("mode") == 0, lam))).alias("gap"), F.max(F.abs(lam)).alias("radius"),
    )


def fiedler(spectrum: DataFrame) -> DataFrame:
    """(graph_id, mode, eigenvalue, node, v) of the first mode with an eigenvalue over 1e-8."""
    return nontrivial(spectrum, 1)


def mode_table(spectrum: DataFrame) -> DataFrame:
    """(graph_id, mode, eigenvalue, norm, mean, std, max_abs, ipr, participation, entropy) per mode."""
    v2 = F.col("v") * F.col("v")
    s = spectrum.groupBy("graph_id", "mode").agg(F.first("eigenvalue").alias("eigenvalue"), F.sqrt(F.sum(v2)).alias("norm"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max(F.abs("v")).alias("max_abs"), (F.sum(v2 * v2) / F.sum(v2) ** 2).alias("ipr"), F.sum(v2).alias("s"), F.sum(F.when(v2 > 1e-15, v2 * F.ln(v2)).otherwise(0.0)).alias("vl"))
    return s.select("graph_id", "mode", "eigenvalue", "norm", "mean", "std", "max_abs", "ipr", (1 / F.col("ipr")).alias("participation"), (F.ln("s") - F.col("vl") / F.col("s")).alias("entropy"))


def localized_nodes(spectrum: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes of largest size in each mode."""
    return spectrum.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id", "mode").orderBy(F.desc(F.abs("v")), "node"))).where(F.col("rank") <= k)


def spectral_entropy(spectrum: DataFrame, *, beta: float | None = None, skip_zero: bool = True, normalized: bool = True) -> DataFrame:
    """(graph_id, entropy) of eigenvalues, or of exp(-beta eigenvalue), as shares; over the logarithm of how many there are."""
    m = modes(spectrum)
    m = m.where("eigenvalue > 1e-10") if skip_zero else m
    w = F.greatest("eigenvalue", F.lit(0.0)) if beta is None else F.exp(-beta * F.col("eigenvalue"))
    m = m.withColumn("w", w)
    p = m.join(m.groupBy("graph_id").agg(F.sum("w").alias("s")), "graph_id").select("graph_id", (F.col("w") / F.when(F.col("s") > 1e-15, F.col("s"))).alias("p")).where("p > 1e-15")
    h = p.groupBy("graph_id").agg(F.sum(-F.col("p") * F.ln("p")).alias("h"), F.count("*").alias("n"))
    return h.select("graph_id", (F.when(F.col("n") > 1, F.col("h") / F.ln("n")).otherwise(0.0) if normalized else F.col("h")).alias("entropy"))


def fourier(spectrum: DataFrame, signals: DataFrame) -> DataFrame:
    """(graph_id, signal, mode, eigenvalue, c): graph Fourier coefficients."""
    return spectrum.join(signals, ["graph_id", "node"]).groupBy(*ONE, "mode").agg(F.first("eigenvalue").alias("eigenvalue"), F.sum(F.col("v") * F.col("value")).alias("c"))


def synthesize(spectrum: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Signals from coefficients (graph_id, signal, mode, c)."""
    return spectrum.join(coefficients.select(*ONE, "mode", "c"), ["graph_id", "mode"]).groupBy(*ONE, "node").agg(F.sum(F.col("v") * F.col("c")).alias("value"))


def filtered(spectrum: DataFrame, signals: DataFrame, gain: Column) -> DataFrame:
    """V g(eigenvalue) V' x; gain is a column over eigenvalue (a pandas UDF may be one)."""
    return synthesize(spectrum, fourier(spectrum, signals).withColumn("c", F.col("c") * gain))


def energy_density(spectrum: DataFrame, signals: DataFrame) -> DataFrame:
    return fourier(spectrum, signals).withColumn("energy", F.col("c") * F.col("c"))


def cumulative_energy(spectrum: DataFrame, signals: DataFrame) -> DataFrame:
    """Running share of the energy by mode."""
    e = energy_density(spectrum, signals)
    total = e.groupBy(*ONE).agg(F.sum("energy").alias("total"))
    run = F.sum("energy").over(Window.partitionBy(*ONE).orderBy("mode"))
    return e.withColumn("run", run).join(total, ONE).select(*ONE, "mode", F.coalesce(F.col("run") / F.when(F.col("total") > 1e-12, F.col("total")), F.lit(0.0)).alias("share"))


def energy_report(graph: Graph, spectrum: DataFrame, signals: DataFrame) -> DataFrame:
    """Norms, mean, deviation, variation, Dirichlet energy, and entropy, centroid and high-frequency share (over the median eigenvalue) of the spectrum."""
    v = F.col("value")
    base = signals.groupBy(*ONE).agg(F.sqrt(F.sum(v * v)).alias("l2_norm"), F.sum(F.abs(v)).alias("l1_norm"), F.max(F.abs(v)).alias("linf_norm"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    middle = modes(spectrum).groupBy("graph_id").agg(F.median("eigenvalue").alias("cutoff"), F.count("*").alias("n"))
    e = energy_density(spectrum, signals).join(middle, "graph_id")
    t = e.groupBy(*ONE).agg(F.sum("energy").alias("s"), F.sum(F.col("energy") * F.col("eigenvalue")).alias("le"), F.sum(F.when(F.col("eigenvalue") >= F.col("cutoff"), F.col("energy"))).alias("he"), F.first("n").alias("n"))
    h = e.join(t.select(*ONE, "s"), ONE).withColumn("p", F.col("energy") / F.when(F.col("s") > 1e-12, F.col("s"))).where("p > 1e-15").groupBy(*ONE).agg(F.sum(-F.col("p") * F.ln("p")).alias("h"))
    df = base.join(total_variation(graph, signals), ONE).join(dirichlet(graph, signals), ONE).join(t, ONE).join(h, ONE, "left")
    safe = F.when(F.col("s") > 1e-12, F.col("s"))
    return df.select(
        *ONE, "l2_norm", "l1_norm", "linf_norm", "mean", "std", F.col("tv").alias("total_variation"), F.col("energy").alias("dirichlet_energy"),
        F.coalesce(F.when(F.col("n") > 1, F.col("h") / F.ln("n")), F.lit(0.0)).alias("spectral_entropy"), F.coalesce(F.col("le") / safe, F.lit(0.0)).alias("spectral_centroid"), F.coalesce(F.col("he") / safe, F.lit(0.0)).alias("high_frequency_ratio"),
    )


def spectral_angle(spectrum: DataFrame, signals: DataFrame, a: str, b: str) -> DataFrame:
    """(graph_id, angle) between two signals' spectra."""
    c = fourier(spectrum, signals)
    x = c.where(F.col("signal") == a).select("graph_id", "mode", F.col("c").alias("x")).join(c.where(F.col("signal") == b).select("graph_id", "mode", F.col("c").alias("y")), ["graph_id", "mode"])
    norm = F.sqrt(F.sum(F.col("x") ** 2) * F.sum(F.col("y") ** 2))
    cosine = F.coalesce(F.sum(F.col("x") * F.col("y")) / F.when(norm > 1e-12, norm), F.lit(0.0))
    return x.groupBy("graph_id").agg(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))).alias("angle"))


# Heat kernels, resistance, embeddings


def heat_kernel(spectrum: DataFrame, times: list[float]) -> DataFrame:
    """(graph_id, time, i, j, value) for all pairs: the whole matrix, so for graphs whose matrix is wanted."""
    if any(t < 0 for t in times):
        raise GraphError("times must not be negative")
    t = spectrum.withColumn("time", F.explode(F.array(*map(F.lit, map(float, times)))))
    a = t.select("graph_id", "time", "mode", F.col("node").alias("i"), (F.col("v") * F.exp(-F.col("time") * F.col("eigenvalue"))).alias("a"))
    b = spectrum.select("graph_id", "mode", F.col("node").alias("j"), F.col("v").alias("b"))
    return a.join(b, ["graph_id", "mode"]).groupBy("graph_id", "time", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def heat_signature(spectrum: DataFrame, times: list[float]) -> DataFrame:
    """(graph_id, time, node, value): the kernel's diagonal."""
    t = spectrum.withColumn("time", F.explode(F.array(*map(F.lit, map(float, times)))))
    return t.groupBy("graph_id", "time", "node").agg(F.sum(F.col("v") * F.col("v") * F.exp(-F.col("time") * F.col("eigenvalue"))).alias("value"))


def heat_trace(spectrum: DataFrame, times: list[float]) -> DataFrame:
    t = modes(spectrum).withColumn("time", F.explode(F.array(*map(F.lit, map(float, times)))))
    return t.groupBy("graph_id", "time").agg(F.sum(F.exp(-F.col("time") * F.col("eigenvalue"))).alias("value"))


def _pairs(spectrum: DataFrame, term: Callable[[Column], Column], where: str) -> DataFrame:
    a = spectrum.select("graph_id", "mode", "eigenvalue", F.col("node").alias("i"), F.col("v").alias("a"))
    b = spectrum.select("graph_id", "mode", F.col("node").alias("j"), F.col("v").alias("b"))
    return a.join(b, ["graph_id", "mode"]).where(where).groupBy("graph_id", "i", "j").agg(F.sum(term((F.col("a") - F.col("b")) ** 2)).alias("value"))


def diffusion_distance(spectrum: DataFrame, time: float) -> DataFrame:
    """(graph_id, i, j, value) for i < j: distance of the heat kernel's rows."""
    return _pairs(spectrum, lambda d: d * F.exp(-2 * time * F.col("eigenvalue")), "i < j").withColumn("value", F.sqrt("value"))


def effective_resistance(graph: Graph, spectrum: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(graph_id, i, j, value) for i < j from the unnormalised spectrum; infinite across components.

    A graph's modes are multiplied in one task (they came from one); node pairs of different components share no mode but those of eigenvalue 0.
    """
    rows = spectrum.select("graph_id", "mode", "eigenvalue", "node", "v")

    def kernel(key: tuple, table: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        v = table.pivot(index="node", columns="mode", values="v").sort_index()
        lam = table.groupby("mode")["eigenvalue"].first().to_numpy()
        parts = nodes.set_index("node").loc[v.index, "component"].to_numpy()
        x = v.to_numpy()[:, lam > tolerance] / np.sqrt(lam[lam > tolerance])
        own = (x * x).sum(1)
        i, j = np.triu_indices(len(x), 1)
        value = np.where(parts[i] == parts[j], np.maximum((own[:, None] + own - 2 * x @ x.T)[i, j], 0), np.inf)
        return pd.DataFrame({"graph_id": key[0], "i": v.index.to_numpy()[i], "j": v.index.to_numpy()[j], "value": value})

    return rows.groupBy("graph_id").cogroup(components(graph).groupBy("graph_id")).applyInPandas(kernel, "graph_id string, i int, j int, value double")


def commute_times(graph: Graph, resistance: DataFrame) -> DataFrame:
    volume = degrees(graph).groupBy("graph_id").agg(F.sum("degree").alias("volume"))
    return resistance.join(volume, "graph_id").select("graph_id", "i", "j", (F.col("value") * F.col("volume")).alias("value"))


def resistance_centrality(resistance: DataFrame, mode: str = "harmonic") -> DataFrame:
    """(graph_id, node, value): harmonic, mean_inverse or closeness (finite others less one, over their sum)."""
    both = resistance.select("graph_id", F.col("i").alias("node"), "value").union(resistance.select("graph_id", "j", "value")).where((F.col("value") > 1e-12) & (F.col("value") < float("inf")))
    f = {"harmonic": F.sum(1 / F.col("value")), "mean_inverse": F.avg(1 / F.col("value")), "closeness": F.coalesce(F.try_divide((F.count("*") - 1).cast("double"), F.sum("value")), F.lit(0.0))}.get(mode)
    if f is None:
        raise GraphError(f"unknown mode {mode!r}")
    return both.groupBy("graph_id", "node").agg(f.alias("value"))


def pair_geometry(graph: Graph, spectrum: DataFrame, normalized_spectrum: DataFrame, *, time: float = 1.0) -> DataFrame:
    """(graph_id, i, j, label_i, label_j, weight, effective_resistance, commute_time, diffusion_distance) on the edges."""
    e = graph.edges.where("src < dst").select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), "weight")
    r = effective_resistance(graph, spectrum)
    on = ["graph_id", "i", "j"]
    name = lambda end: graph.nodes.select("graph_id", F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    df = e.join(r.withColumnRenamed("value", "effective_resistance"), on).join(commute_times(graph, r).withColumnRenamed("value", "commute_time"), on)
    df = df.join(diffusion_distance(normalized_spectrum, time).withColumnRenamed("value", "diffusion_distance"), on)
    return df.join(name("i"), ["graph_id", "i"]).join(name("j"), ["graph_id", "j"]).select(*on, "label_i", "label_j", "weight", "effective_resistance", "commute_time", "diffusion_distance")


def embedding(spectrum: DataFrame, k: int = 2, *, skip: int = 1, scale: str = "none", time: float = 1.0, row_normalize: bool = False) -> DataFrame:
    """(graph_id, node, coordinates): modes skip .. skip + k - 1; scaled by eigenvalue, inverse-sqrt or heat."""
    lam = F.col("eigenvalue")
    factor = {"none": F.lit(1.0), "eigenvalue": lam, "inverse-sqrt": F.when(lam > 1e-12, 1 / F.sqrt(F.when(lam > 1e-12, lam).otherwise(1.0))).otherwise(0.0), "heat": F.exp(-time * lam)}[scale]
    rows = spectrum.where((F.col("mode") >= skip) & (F.col("mode") < skip + k)).groupBy("graph_id", "node").agg(F.array_sort(F.collect_list(F.struct("mode", (F.col("v") * factor).alias("x")))).alias("s"))
    rows = rows.select("graph_id", "node", F.transform("s", lambda s: s["x"]).alias("coordinates"))
    if not row_normalize:
        return rows
    norm = F.sqrt(F.aggregate("coordinates", F.lit(0.0), lambda acc, x: acc + x * x))
    return rows.withColumn("norm", norm).select("graph_id", "node", F.when(F.col("norm") > 1e-12, F.transform("coordinates", lambda x: x / F.col("norm"))).otherwise(F.col("coordinates")).alias("coordinates"))


def kmeans(x: np.ndarray, k: int, *, seed: int = 0, rounds: int = 200, tolerance: float = 1e-6, starts: int = 8) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of some seeded k-means++ starts; an empty cluster takes the farthest point."""
    rng, best = np.random.default_rng(seed), (np.zeros(len(x), int), np.inf)
    for _ in range(starts):
        centers = x[[rng.integers(len(x))]]
        while len(centers) < k:
            d = ((x[:, None] - centers) ** 2).sum(2).min(1)
            centers = np.vstack([centers, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            d = ((x[:, None] - centers) ** 2).sum(2)
            label = d.argmin(1)
            new = np.array([x[label == c].mean(0) if (label == c).any() else x[d.min(1).argmax()] for c in range(k)])
            moved, centers = np.abs(new - centers).max(), new
            if moved <= tolerance:
                break
        d = ((x[:, None] - centers) ** 2).sum(2)
        if d.min(1).sum() < best[1]:
            best = d.argmin(1), float(d.min(1).sum())
    return best


def clusters(graph: Graph, k: int, *, kind: str = "normalized", n_components: int | None = None, row_normalize: bool = True, seed: int = 0) -> DataFrame:
    """(graph_id, node, cluster, inertia) of spectral clustering."""

    def kernel(a: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> dict:
        _, v = eigen(laplacian(a, kind))
        x = v[:, : n_components or k]
        if row_normalize:
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.where(norm > 1e-12, x / np.where(norm > 1e-12, norm, 1), x)
        label, inertia = kmeans(x, min(k, len(x)), seed=seed)
        return {"node": ids, "cluster": label, "inertia": inertia}

    return per_graph(graph, kernel, "node int, cluster int, inertia double")


def conductance(graph: Graph, members: DataFrame) -> DataFrame:
    """(graph_id, phi, cut, volume_in, volume_out) of the nodes in members(graph_id, node); phi is infinite if either side has no volume."""
    m = members.select("graph_id", "node", F.lit(1).alias("inside")).distinct()
    tag = lambda end: m.select("graph_id", F.col("node").alias(end), F.col("inside").alias(f"in_{end}"))
    e = graph.edges.join(tag("src"), ["graph_id", "src"], "left").join(tag("dst"), ["graph_id", "dst"], "left").na.fill(0, ["in_src", "in_dst"])
    s = e.groupBy("graph_id").agg(F.sum(F.when((F.col("in_src") == 1) & (F.col("in_dst") == 0), F.col("weight")).otherwise(0.0)).alias("cut"), F.sum(F.when(F.col("in_src") == 1, F.col("weight")).otherwise(0.0)).alias("volume_in"), F.sum(F.when(F.col("in_src") == 0, F.col("weight")).otherwise(0.0)).alias("volume_out"))
    least = F.least("volume_in", "volume_out")
    return s.select("graph_id", F.when(least > 1e-12, F.col("cut") / F.when(least > 1e-12, least)).otherwise(float("inf")).alias("phi"), "cut", "volume_in", "volume_out")


def sweep(graph: Graph, order: DataFrame) -> DataFrame:
    """(graph_id, size, node, cut, volume_in, phi) of every prefix of the nodes by rising value of order(graph_id, node, value), ties by node."""
    pos = order.withColumn("pos", F.row_number().over(Window.partitionBy("graph_id").orderBy("value", "node"))).select("graph_id", "node", "pos")
    d = degrees(graph).select("graph_id", "node", "degree")
    e = graph.edges.where("src <> dst").join(pos.select("graph_id", F.col("node").alias("src"), F.col("pos").alias("ps")), ["graph_id", "src"]).join(pos.select("graph_id", F.col("node").alias("dst"), F.col("pos").alias("pd")), ["graph_id", "dst"])
    back = e.where("pd < ps").groupBy("graph_id", F.col("src").alias("node")).agg(F.sum("weight").alias("earlier"))
    rows = pos.join(d, ["graph_id", "node"]).join(back, ["graph_id", "node"], "left").na.fill(0.0, ["earlier"])
    run = Window.partitionBy("graph_id").orderBy("pos")
    rows = rows.withColumn("cut", F.sum(F.col("degree") - 2 * F.col("earlier")).over(run)).withColumn("volume_in", F.sum("degree").over(run))
    total = d.groupBy("graph_id").agg(F.sum("degree").alias("volume"), F.count("*").alias("n"))
    rows = rows.join(total, "graph_id").where("pos < n")
    least = F.least(F.col("volume_in"), F.col("volume") - F.col("volume_in"))
    return rows.select("graph_id", F.col("pos").alias("size"), "node", "cut", "volume_in", F.when(least > 1e-12, F.col("cut") / F.when(least > 1e-12, least)).otherwise(float("inf")).alias("phi"))


def cheeger(graph: Graph, spectrum: DataFrame) -> DataFrame:
    """The best prefix of the Fiedler order: (graph_id, size, node, cut, volume_in, phi); the first on ties."""
    s = sweep(graph, fiedler(spectrum).select("graph_id", "node", F.col("v").alias("value")))
    return s.withColumn("turn", F.row_number().over(Window.partitionBy("graph_id").orderBy("phi", "size"))).where("turn = 1").drop("turn")


def bipartition(spectrum: DataFrame) -> DataFrame:
    """(graph_id, node, side): 0 up to the Fiedler vector's median, 1 over it."""
    f = fiedler(spectrum)
    return f.join(f.groupBy("graph_id").agg(F.median("v").alias("m")), "graph_id").select("graph_id", "node", (F.col("v") > F.col("m")).cast("int").alias("side"))


def node_features(graph: Graph, spectrum: DataFrame, normalized_spectrum: DataFrame, *, k: int = 10, times: list[float] | None = None) -> DataFrame:
    """One wide row per node: degree, resistance_centrality, eigvec_m, hks_t."""
    times = [0.1, 1.0, 5.0] if times is None else times
    on = ["graph_id", "node"]
    df = degrees(graph).select(*on, "label", "degree").join(resistance_centrality(effective_resistance(graph, spectrum)).withColumnRenamed("value", "resistance_centrality"), on, "left")
    df = df.join(normalized_spectrum.where(F.col("mode") < k).groupBy(*on).pivot("mode", list(range(k))).agg(F.first("v")).withColumnsRenamed({str(i): f"eigvec_{i}" for i in range(k)}), on, "left")
    h = heat_signature(normalized_spectrum, times)
    return df.join(h.groupBy(*on).agg(*(F.max(F.when(F.col("time") == t, F.col("value"))).alias(f"hks_{i}") for i, t in enumerate(times))), on, "left").na.fill(0.0, ["resistance_centrality"])


def compare(before: DataFrame, after: DataFrame, *, k: int = 20, time: float = 1.0) -> DataFrame:
    """(graph_id, mode, before, after, delta) of the first k eigenvalues of two spectra of the same graphs."""
    a, b = (modes(s).where(F.col("mode") < k) for s in (before, after))
    return a.select("graph_id", "mode", F.col("eigenvalue").alias("before")).join(b.select("graph_id", "mode", F.col("eigenvalue").alias("after")), ["graph_id", "mode"]).withColumn("delta", F.col("after") - F.col("before"))


# Wavelets, denoising, anomalies


def default_scales(spectrum: DataFrame, count: int = 8) -> list[float]:
    """Geometric from 1 / largest to 1 / least positive eigenvalue, within [0.001, 1000]; from the first graph of the frame."""
    r = modes(spectrum).where("eigenvalue > 1e-10").agg(F.min("eigenvalue"), F.max("eigenvalue")).first()
    if r[0] is None:
        return [1.0]
    low, high = max(1e-3, 1 / r[1]), min(1e3, 1 / r[0])
    return np.geomspace(low, high, count).tolist() if high > low else np.linspace(0.25, 4.0, count).tolist()


def wavelets(spectrum: DataFrame, signals: DataFrame, scales: list[float], *, kernel: str = "mexican_hat", scaling: bool = True) -> DataFrame:
    """(graph_id, signal, scale, node, value); scale 0 is the low-pass channel at the largest scale."""
    lam, s = F.col("eigenvalue"), F.col("scale")
    c = fourier(spectrum, signals).withColumn("scale", F.explode(F.array(*map(F.lit, map(float, ([0.0] if scaling else []) + list(scales))))))
    gain = F.when(s == 0, F.exp(-max(scales) * lam)).otherwise(transfers.wavelet(kernel, lam, s))
    c = c.select(*ONE, "scale", "mode", (F.col("c") * gain).alias("c"))
    return spectrum.join(c, ["graph_id", "mode"]).groupBy(*ONE, "scale", "node").agg(F.sum(F.col("v") * F.col("c")).alias("value"))


def wavelet_report(coefficients: DataFrame) -> DataFrame:
    """(graph_id, signal, scale, energy, l1, l2, linf, entropy, share) per scale."""
    v = F.col("value")
    each = coefficients.groupBy(*ONE, "scale").agg(F.sum(v * v).alias("energy"), F.sum(F.abs(v)).alias("l1"), F.max(F.abs(v)).alias("linf"), F.count("*").alias("n"), F.sum(F.when(F.abs(v) > 1e-15, F.abs(v) * F.ln(F.abs(v))).otherwise(0.0)).alias("vl"))
    total = each.groupBy(*ONE).agg(F.sum("energy").alias("total"))
    entropy = F.when((F.col("l1") > 1e-12) & (F.col("n") > 1), (F.ln("l1") - F.col("vl") / F.col("l1")) / F.ln("n")).otherwise(0.0)
    return each.join(total, ONE).select(*ONE, "scale", "energy", "l1", F.sqrt("energy").alias("l2"), "linf", entropy.alias("entropy"), F.coalesce(F.col("energy") / F.when(F.col("total") > 1e-12, F.col("total")), F.lit(0.0)).alias("share"))


def dominant_scale(coefficients: DataFrame) -> DataFrame:
    """(graph_id, signal, node, scale): where the coefficient is largest in size, the first on ties."""
    return coefficients.withColumn("turn", F.row_number().over(Window.partitionBy(*ONE, "node").orderBy(F.desc(F.abs("value")), "scale"))).where("turn = 1").select(*ONE, "node", "scale")


def cross_scale(coefficients: DataFrame) -> DataFrame:
    """(graph_id, signal, scale_a, scale_b, value): Pearson over nodes, for scale_a < scale_b."""
    a = coefficients.select(*ONE, "node", F.col("scale").alias("scale_a"), F.col("value").alias("a"))
    b = coefficients.select(*ONE, "node", F.col("scale").alias("scale_b"), F.col("value").alias("b"))
    s = a.join(b, [*ONE, "node"]).where("scale_a < scale_b").groupBy(*ONE, "scale_a", "scale_b").agg(F.covar_pop("a", "b").alias("c"), (F.stddev_pop("a") * F.stddev_pop("b")).alias("d"))
    return s.select(*ONE, "scale_a", "scale_b", F.coalesce(F.col("c") / F.when(F.col("d") > 1e-12, F.col("d")), F.lit(0.0)).alias("value"))


def approximate_inverse(coefficients: DataFrame) -> DataFrame:
    """Plain mean over the channels."""
    return coefficients.groupBy(*ONE, "node").agg(F.avg("value").alias("value"))


def denoise_wavelet(spectrum: DataFrame, signals: DataFrame, scales: list[float], *, kernel: str = "mexican_hat", threshold: float | None = None, mode: str = "soft") -> DataFrame:
    """Detail channels shrunk by a threshold (default 1.4826 MAD sqrt(2 ln n) of each channel), then averaged."""
    c = wavelets(spectrum, signals, scales, kernel=kernel)
    key = [*ONE, "scale"]
    m = c.join(c.groupBy(*key).agg(F.median("value").alias("med"), F.count("*").alias("n")), key)
    t = F.lit(float(threshold)) if threshold is not None else 1.4826 * F.median(F.abs(F.col("value") - F.col("med"))) * F.sqrt(2 * F.ln(F.first("n")))
    m = c.join(m.groupBy(*key).agg(t.alias("t")), key)
    v = F.col("value")
    shrunk = F.signum(v) * F.greatest(F.abs(v) - F.col("t"), F.lit(0.0)) if mode == "soft" else F.when(F.abs(v) >= F.col("t"), v).otherwise(0.0)
    return approximate_inverse(m.withColumn("value", F.when(F.col("scale") == 0, v).otherwise(shrunk)))


def tikhonov(graph: Graph, signals: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(I + alpha L)^-1 x."""
    return per_signal(graph, signals, lambda a, x: np.linalg.solve(np.eye(len(a)) + alpha * laplacian(a), x))


def heat_smooth(graph: Graph, signals: DataFrame, time: float = 1.0, method: str = "spectral") -> DataFrame:
    """exp(-t L) x: spectral, chebyshev (order 40) or lanczos (dimension up to 40)."""

    def f(a: np.ndarray, x: np.ndarray) -> np.ndarray:
        if method == "lanczos":
            return heat_lanczos(a, x, time, 40)
        values, vectors = eigen(laplacian(a))
        if method == "chebyshev":
            return chebyshev_apply(a, x, chebyshev_coefficients(lambda z: np.exp(-time * z), 40, float(values[-1])), float(values[-1]))
        return vectors @ (np.exp(-time * values) * (vectors.T @ x))

    if method not in ("spectral", "chebyshev", "lanczos"):
        raise GraphError(f"unknown method {method!r}")
    return per_signal(graph, signals, f)


def chebyshev_filter(graph: Graph, signals: DataFrame, transfer: Callable, order: int = 30) -> DataFrame:
    """transfer(eigenvalues) by a polynomial of some order."""

    def f(a: np.ndarray, x: np.ndarray) -> np.ndarray:
        top = float(np.linalg.eigvalsh(laplacian(a))[-1]) if len(a) else 1.0
        return chebyshev_apply(a, x, chebyshev_coefficients(transfer, order, top), top)

    return per_signal(graph, signals, f)


def variation_ista(a: np.ndarray, x: np.ndarray, lam: float = 0.1, rounds: int = 250, step: float | None = None, tolerance: float = 1e-7) -> np.ndarray:
    """Gradient steps on half of |y - x|^2 plus lam times a smoothed weighted variation."""
    i, j = np.nonzero(np.triu(a, 1) > 1e-12)
    w = a[i, j]
    step = step or 1 / (1 + lam * max(2 * a.sum(1).max(initial=0), 1))
    y = x.copy()
    for _ in range(rounds):
        d = y[j] - y[i]
        flow = w * d / np.sqrt(d * d + 1e-10)
        grad = y - x + lam * (np.bincount(j, flow, len(x)) - np.bincount(i, flow, len(x)))
        new = y - step * grad
        moved = np.linalg.norm(new - y) / (np.linalg.norm(y) + 1e-12)
        y = new
        if moved < tolerance:
            break
    return y


def denoise_variation(graph: Graph, signals: DataFrame, lam: float = 0.1, **options) -> DataFrame:
    return per_signal(graph, signals, lambda a, x: variation_ista(a, x, lam, **options))


def denoise_all(graph: Graph, signals: DataFrame, *, method: str = "tikhonov", alpha: float = 1.0, time: float = 1.0) -> DataFrame:
    """Every signal by one method: tikhonov, heat or wavelet (default scales and thresholds)."""
    if method == "tikhonov":
        return tikhonov(graph, signals, alpha)
    if method == "heat":
        return heat_smooth(graph, signals, time)
    if method == "wavelet":
        spectrum = decompose(graph)
        return denoise_wavelet(spectrum, signals, default_scales(spectrum))
    raise GraphError(f"unknown method {method!r}")


def denoising_report(graph: Graph, signals: DataFrame, smooth: DataFrame, *, alpha: float = 0.0) -> DataFrame:
    """(graph_id, signal, residual_norm, signal_norm, objective): half of |y - x|^2 plus half of alpha times y's Dirichlet energy."""
    d = signals.join(smooth.withColumnRenamed("value", "y"), [*ONE, "node"]).groupBy(*ONE).agg(F.sum((F.col("y") - F.col("value")) ** 2).alias("r"), F.sqrt(F.sum(F.col("value") ** 2)).alias("signal_norm"))
    return d.join(dirichlet(graph, smooth), ONE).select(*ONE, F.sqrt("r").alias("residual_norm"), "signal_norm", (F.col("r") / 2 + alpha / 2 * F.col("energy")).alias("objective"))


def anomalies(graph: Graph, signals: DataFrame, *, method: str = "residual", threshold: float = 3.0, alpha: float = 1.0, quantile: float = 0.6) -> DataFrame:
    """(graph_id, signal, node, value, z, flag): robust z of the residual of Tikhonov smoothing, of local disagreement (one-sided), or of the part on high modes."""
    from .signals import local_disagreement

    if method == "residual":
        s = tikhonov(graph, signals, alpha)
        score = signals.join(s.withColumnRenamed("value", "y"), [*ONE, "node"]).select(*ONE, "node", (F.col("value") - F.col("y")).alias("value"))
    elif method == "local":
        score = local_disagreement(graph, signals)
    elif method == "leverage":
        spec = decompose(graph)
        cut = modes(spec).groupBy("graph_id").agg(F.percentile("eigenvalue", quantile).alias("cut"))
        high = fourier(spec, signals).join(cut, "graph_id").where("eigenvalue >= cut")
        score = synthesize(spec, high)
    else:
        raise GraphError(f"unknown method {method!r}")
    z = robust_zscored(score).withColumnRenamed("value", "z")
    return score.join(z, [*ONE, "node"]).withColumn("flag", F.col("z") >= threshold if method == "local" else F.abs("z") >= threshold)


