"""Robustness by random perturbation: trials (trial, seed) are dealt out over tasks, and samples(graph_id, trial, node, value) are aggregated in SQL.

Seeds are drawn on the driver from one generator, so that results don't depend on how the trials are dealt.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, GraphError, dense
from .dynamics import evolve, model_of, run
from .stats import fragility, trial_agreement


@dataclass(frozen=True)
class Perturbation:
    """A random change of a symmetric matrix; edges are visited in row-major order."""

    def change(self, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return a

    def sample(self, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        s = (a + a.T) / 2
        np.fill_diagonal(s, 0)
        out = np.maximum(self.change(s, rng), 0)
        np.fill_diagonal(out, 0)
        return out


def upper(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.triu(a, 1) > 0)
    return i, j, a[i, j]


def with_upper(a: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros_like(a)
    np.add.at(out, (i, j), w)
    return out + out.T


@dataclass(frozen=True)
class Identity(Perturbation):
    pass


@dataclass(frozen=True)
class AdditiveNoise(Perturbation):
    std: float = 0.05
    relative: bool = True

    def change(self, a, rng):
        i, j, w = upper(a)
        noise = rng.normal(0, self.std, len(w)) * (np.maximum(np.abs(w), 1e-12) if self.relative else 1)
        return with_upper(a, i, j, np.maximum(w + noise, 0))


@dataclass(frozen=True)
class LognormalNoise(Perturbation):
    """Weights times a lognormal of mean 1."""

    sigma: float = 0.1

    def change(self, a, rng):
        i, j, w = upper(a)
        return with_upper(a, i, j, w * rng.lognormal(-self.sigma**2 / 2, self.sigma, len(w)))


@dataclass(frozen=True)
class EdgeDropout(Perturbation):
    """Each edge goes with a probability; edges whose end has no other may be protected (no number is drawn for them)."""

    probability: float = 0.05
    protect: bool = False

    def change(self, a, rng):
        i, j, w = upper(a)
        links = (a > 0).sum(1)
        open_ = (links[i] > 1) & (links[j] > 1) if self.protect else np.ones(len(w), bool)
        keep = np.ones(len(w), bool)
        keep[open_] = rng.random(int(open_.sum())) >= self.probability
        return with_upper(a, i[keep], j[keep], w[keep])


@dataclass(frozen=True)
class EdgeBootstrap(Perturbation):
    """Edges drawn with replacement in proportion to weight, scaled to the old total."""

    fraction: float = 1.0

    def change(self, a, rng):
        i, j, w = upper(a)
        if not len(w):
            return a
        k = rng.choice(len(w), max(1, round(self.fraction * len(w))), p=w / w.sum())
        out = with_upper(a, i[k], j[k], w[k])
        return out * (2 * w.sum() / out.sum())


@dataclass(frozen=True)
class NodeDropout(Perturbation):
    probability: float = 0.05
    protected: tuple[int, ...] = ()

    def change(self, a, rng):
        gone = rng.random(len(a)) < self.probability
        gone[list(self.protected)] = False
        out = a.copy()
        out[gone] = 0
        out[:, gone] = 0
        return out


@dataclass(frozen=True)
class ContactThinning(Perturbation):
    """Each edge stays with probability p, or p times (weight over the 90 % quantile, at most 1) to a power."""

    probability: float = 0.9
    by_weight: bool = True
    power: float = 1.0

    def change(self, a, rng):
        i, j, w = upper(a)
        q = np.quantile(w, 0.9) if len(w) else 1.0
        p = self.probability * np.clip(w / max(q, 1e-12), 0, 1) ** self.power if self.by_weight else np.full(len(w), self.probability)
        keep = rng.random(len(w)) < p
        return with_upper(a, i[keep], j[keep], w[keep])


@dataclass(frozen=True)
class DegreeNoise(Perturbation):
    """Relative noise whose deviation grows with the ends' degrees."""

    std: float = 0.05
    exponent: float = 0.5

    def change(self, a, rng):
        i, j, w = upper(a)
        d = a.sum(1)
        std = self.std * (np.sqrt(d[i] * d[j]) / max(d.mean(), 1e-12)) ** self.exponent
        return with_upper(a, i, j, np.maximum(w + rng.normal(0, 1, len(w)) * std * w, 0))


@dataclass(frozen=True)
class Rewire(Perturbation):
    """An edge's weight moves to a free pair with some probability; after 50 tries it is lost."""

    probability: float = 0.05

    def change(self, a, rng):
        out = a.copy()
        for i, j in zip(*upper(a)[:2], strict=True):
            if rng.random() >= self.probability:
                continue
            w, out[i, j], out[j, i] = out[i, j], 0, 0
            for _ in range(50):
                u, v = rng.integers(len(a)), rng.integers(len(a))
                if u != v and out[u, v] == 0:
                    out[u, v] = out[v, u] = w
                    break
        return out


@dataclass(frozen=True)
class CompositePerturbation(Perturbation):
    children: tuple[Perturbation, ...] = ()

    def change(self, a, rng):
        for c in self.children:
            a = c.sample(a, rng)
        return a


NOISE = {
    "gaussian": lambda s, p: AdditiveNoise(s), "lognormal": lambda s, p: LognormalNoise(s), "edge_dropout": lambda s, p: EdgeDropout(s), "node_dropout": lambda s, p: NodeDropout(s, p),
    "thinning": lambda s, p: ContactThinning(max(0.0, 1 - s)), "degree": lambda s, p: DegreeNoise(s), "rewire": lambda s, p: Rewire(s),
}


def noise(kind: str, strength: float, protected: tuple[int, ...] = ()) -> Perturbation:
    if kind not in NOISE:
        raise GraphError(f"unknown noise {kind!r}")
    return NOISE[kind](float(strength), tuple(protected))


DISTRIBUTIONS: dict[str, Callable] = {
    "constant": lambda rng, n, value=0.0: np.full(n, float(value)), "normal": lambda rng, n, mean=0.0, std=1.0: rng.normal(mean, std, n), "uniform": lambda rng, n, low=0.0, high=1.0: rng.uniform(low, high, n),
    "lognormal": lambda rng, n, mean=0.0, sigma=0.2: rng.lognormal(mean, sigma, n), "bernoulli": lambda rng, n, p=0.5: (rng.random(n) < p).astype(float),
}


def draw(kind: str, rng: np.random.Generator, n: int, **parameters) -> np.ndarray:
    return DISTRIBUTIONS[kind](rng, n, **parameters)


def trial_seeds(n_trials: int, seed: int) -> list[int]:
    rng = np.random.default_rng(seed)
    return [int(rng.integers(0, 2**31 - 1)) for _ in range(n_trials)]


def samples(graph: Graph, seed_signal: DataFrame, perturbation: Perturbation, *, n_trials: int = 200, seed: int = 0, model: str = "diffusion", steps: int = 60, dt: float = 0.1, parts: int = 32, **options) -> DataFrame:
    """(graph_id, trial, node, value, delta): the state that each perturbed graph ends with, and the relative Frobenius change of its matrix."""
    kind, spark = model_of(model), graph.spark
    trials = spark.createDataFrame(pd.DataFrame({"trial": np.arange(n_trials, dtype="int32"), "rng": trial_seeds(n_trials, seed), "part": np.arange(n_trials, dtype="int32") % parts}), "trial int, rng long, part int")
    graphs = graph.nodes.select("graph_id").distinct()
    tasks = trials.crossJoin(graphs)
    used = trials.select("part").distinct()
    rows = graph.edges.crossJoin(used).select("graph_id", "part", F.lit("e").alias("kind"), "src", "dst", "weight")
    rows = rows.union(graph.nodes.crossJoin(used).select("graph_id", "part", F.lit("v"), "node", "node", F.lit(0.0)))
    rows = rows.union(seed_signal.crossJoin(used).select("graph_id", "part", F.lit("s"), "node", "node", "value"))
    rows = rows.union(tasks.select("graph_id", "part", F.lit("t"), "trial", "trial", F.col("rng").cast("double")))

    def kernel(table: pd.DataFrame) -> pd.DataFrame:
        e, v, s, t = (table[table["kind"] == k] for k in "evst")
        a, ids, _ = dense(e, pd.DataFrame({"node": v["src"], "label": v["src"]}))
        x0 = np.zeros(len(ids))
        np.add.at(x0, np.searchsorted(ids, s["src"]), s["weight"])
        out, size = [], np.linalg.norm(a)
        for trial, number in sorted(zip(t["src"].tolist(), t["weight"].tolist(), strict=True)):
            b = perturbation.sample(a, np.random.default_rng(int(number)))
            x = evolve(b, x0[:, None], model=kind, steps=steps, dt=dt, **options)[:, 0]
            out.append(pd.DataFrame({"graph_id": table["graph_id"].iloc[0], "trial": trial, "node": ids, "value": x, "delta": np.linalg.norm(b - a) / (size + 1e-12)}))
        return pd.concat(out)

    return rows.groupBy("graph_id", "part").applyInPandas(kernel, "graph_id string, trial int, node int, value double, delta double")


def baseline(graph: Graph, seed_signal: DataFrame, **dynamics) -> DataFrame:
    return run(graph, seed_signal, **dynamics).select("graph_id", "node", "value")


def robustness_curve(graph: Graph, seed_signal: DataFrame, strengths: list[float], *, kind: str = "gaussian", n_trials: int = 50, seed: int = 0, k: int = 10, **dynamics) -> DataFrame:
    """(graph_id, strength, n_trials, mean_spearman_to_baseline, mean_l2_delta, mean_relative_graph_delta, fragility_index)."""
    base, out = baseline(graph, seed_signal, **dynamics), None
    for at, s in enumerate(strengths):
        x = samples(graph, seed_signal, noise(kind, s), n_trials=n_trials, seed=seed + 1009 * at, **dynamics)
        d = x.join(base.withColumnRenamed("value", "b"), ["graph_id", "node"]).groupBy("graph_id", "trial").agg(F.sqrt(F.sum((F.col("value") - F.col("b")) ** 2)).alias("l2"), F.max("delta").alias("delta"))
        row = d.groupBy("graph_id").agg(F.count("*").alias("n_trials"), F.avg("l2").alias("mean_l2_delta"), F.avg("delta").alias("mean_relative_graph_delta"))
        row = row.join(trial_agreement(x, base).groupBy("graph_id").agg(F.avg("spearman").alias("mean_spearman_to_baseline")), "graph_id").join(fragility(x, base, k).select("graph_id", "topk_overlap", "fragility_index"), "graph_id")
        row = row.select("graph_id", F.lit(float(s)).alias("strength"), "n_trials", "mean_spearman_to_baseline", "topk_overlap", "mean_l2_delta", "mean_relative_graph_delta", "fragility_index")
        out = row if out is None else out.union(row)
    return out


def bootstrap(samples_: DataFrame, statistic: Callable[[np.ndarray], float], *, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0, parts: int = 32) -> DataFrame:
    """(graph_id, node, low, high): interval of a statistic of a node's values over resampled trials. Nodes are dealt out over tasks."""

    def kernel(table: pd.DataFrame) -> pd.DataFrame:
        x = table.sort_values("trial")["value"].to_numpy()
        rng = np.random.default_rng([seed, int(table["node"].iloc[0])])
        found = [statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(n_boot)]
        low, high = np.quantile(found, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({"graph_id": [table["graph_id"].iloc[0]], "node": [table["node"].iloc[0]], "low": [low], "high": [high]})

    return samples_.select("graph_id", "trial", "node", "value").groupBy("graph_id", "node").applyInPandas(kernel, "graph_id string, node int, low double, high double")
