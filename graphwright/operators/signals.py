"""Signals on graphs: frames (graph_id, signal, node, value), one row per node (missing rows count as 0 where noted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, GraphError
from .matrices import EPS, degrees, laplacian_entries, product
from .prepare import soft_threshold

ONE = ["graph_id", "signal"]


def aligned(graph: Graph, signals: DataFrame) -> DataFrame:
    """Every node of the graph for every signal: rows outside it drop, missing ones are 0."""
    names = signals.select(*ONE).distinct()
    return graph.nodes.join(names, "graph_id").join(signals, [*ONE, "node"], "left").select(*ONE, "node", F.coalesce("value", F.lit(0.0)).alias("value"))


def zeros(graph: Graph, signal: str = "zero") -> DataFrame:
    return graph.nodes.select("graph_id", F.lit(signal).alias("signal"), "node", F.lit(0.0).alias("value"))


def from_mapping(graph: Graph, mapping: dict[int, float], *, default: float = 0.0, signal: str = "mapped") -> DataFrame:
    value = F.lit(float(default))
    for i, v in mapping.items():
        value = F.when(F.col("node") == int(i), F.lit(float(v))).otherwise(value)
    return graph.nodes.select("graph_id", F.lit(signal).alias("signal"), "node", value.alias("value"))


def gradient(graph: Graph, signals: DataFrame, *, weighted: bool = True) -> DataFrame:
    """(graph_id, signal, src, dst, weight, value) on edges src < dst: x_dst - x_src, times the root of the weight."""
    e = graph.edges.where(f"src < dst and weight > {EPS}")
    x = signals.select(*ONE, "node", "value")
    ends = e.join(x.select(*ONE, F.col("node").alias("src"), F.col("value").alias("a")), ["graph_id", "src"])
    ends = ends.join(x.select(*ONE, F.col("node").alias("dst"), F.col("value").alias("b")), ["graph_id", "signal", "dst"])
    d = F.col("b") - F.col("a")
    return ends.select(*ONE, "src", "dst", "weight", (F.sqrt("weight") * d if weighted else d).alias("value"))


def divergence(graph: Graph, fields: DataFrame, *, weighted: bool = True) -> DataFrame:
    """-B' (sqrt(w) y) of edge fields (graph_id, signal, src, dst, weight, value): added at src, taken at dst."""
    y = F.sqrt("weight") * F.col("value") if weighted else F.col("value")
    ends = fields.select(*ONE, F.explode(F.array(F.struct(F.col("src").alias("node"), y.alias("v")), F.struct(F.col("dst").alias("node"), (-y).alias("v")))).alias("e"))
    return aligned(graph, ends.groupBy(*ONE, F.col("e.node").alias("node")).agg(F.sum("e.v").alias("value")))


def laplacian_apply(graph: Graph, signals: DataFrame) -> DataFrame:
    return aligned(graph, product(laplacian_entries(graph), signals))


def p_laplacian(graph: Graph, signals: DataFrame, *, p: float = 2.0, epsilon: float = 1e-8) -> DataFrame:
    """B' (w (d^2 + eps^2)^((p - 2) / 2) d); for p = 2 it is L x."""
    g = gradient(graph, signals, weighted=False)
    flow = F.col("weight") * F.pow(F.col("value") * F.col("value") + epsilon * epsilon, F.lit((p - 2) / 2)) * F.col("value")
    out = divergence(graph, g.withColumn("value", flow), weighted=False)
    return out.withColumn("value", -F.col("value"))


def dirichlet(graph: Graph, signals: DataFrame) -> DataFrame:
    """(graph_id, signal, energy): half of x' L x."""
    names = signals.select(*ONE).distinct()
    e = gradient(graph, signals).groupBy(*ONE).agg((F.sum(F.col("value") ** 2) / 2).alias("energy"))
    return names.join(e, ONE, "left").na.fill(0.0)


def total_variation(graph: Graph, signals: DataFrame, *, p: float = 1.0, weighted: bool = True) -> DataFrame:
    """(graph_id, signal, tv): the p-norm of the gradient; p may be infinite."""
    g = F.abs("value")
    norm = F.max(g) if p == float("inf") else F.sum(g) if p == 1 else F.sqrt(F.sum(g * g)) if p == 2 else F.pow(F.sum(F.pow(g, F.lit(p))), F.lit(1 / p))
    names = signals.select(*ONE).distinct()
    return names.join(gradient(graph, signals, weighted=weighted).groupBy(*ONE).agg(norm.alias("tv")), ONE, "left").na.fill(0.0)


def _neighbours(graph: Graph, signals: DataFrame) -> DataFrame:
    own = signals.select(*ONE, F.col("node").alias("src"), F.col("value").alias("a"))
    other = signals.select(*ONE, F.col("node").alias("dst"), F.col("value").alias("b"))
    return graph.edges.join(own, ["graph_id", "src"]).join(other, ["graph_id", "signal", "dst"])


def local_disagreement(graph: Graph, signals: DataFrame) -> DataFrame:
    """Mean absolute difference to the neighbours, weighted; 0 where the degree is tiny."""
    got = _neighbours(graph, signals).groupBy(*ONE, F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.abs(F.col("a") - F.col("b"))).alias("s"), F.sum("weight").alias("d"))
    return aligned(graph, got.select(*ONE, "node", F.when(F.col("d") > EPS, F.col("s") / F.when(F.col("d") > EPS, F.col("d")).otherwise(1.0)).otherwise(0.0).alias("value")))


def local_mean(graph: Graph, signals: DataFrame) -> DataFrame:
    """Weighted mean of the neighbours; isolated nodes keep their own value."""
    got = _neighbours(graph, signals).groupBy(*ONE, F.col("src").alias("node")).agg(F.when(F.sum("weight") > EPS, F.sum(F.col("weight") * F.col("b")) / F.sum("weight")).alias("m"))
    return signals.join(got, [*ONE, "node"], "left").select(*ONE, "node", F.coalesce("m", "value").alias("value"))


def with_stats(signals: DataFrame, **stats) -> DataFrame:
    """The rows with aggregates of their signal beside them (aggregated first, so that a long signal isn't one task)."""
    return signals.join(signals.groupBy(*ONE).agg(*(c.alias(n) for n, c in stats.items())), ONE)


def _value(df: DataFrame, value) -> DataFrame:
    return df.select(*ONE, "node", value.alias("value"))


def centered(signals: DataFrame, graph: Graph | None = None) -> DataFrame:
    """Less the mean, or less the mean weighted by degree if a graph is given."""
    if graph is None:
        return _value(with_stats(signals, m=F.avg("value")), F.col("value") - F.col("m"))
    d = signals.join(degrees(graph).select("graph_id", "node", "degree"), ["graph_id", "node"])
    m = d.groupBy(*ONE).agg(F.coalesce(F.try_divide(F.sum(F.col("degree") * F.col("value")), F.sum("degree")), F.avg("value")).alias("m"))
    return _value(signals.join(m, ONE), F.col("value") - F.col("m"))


def normalized(signals: DataFrame, p: float = 2.0) -> DataFrame:
    """Divided by the p-norm; zeros if it is tiny."""
    v = F.abs("value")
    norm = F.max(v) if p == float("inf") else F.pow(F.sum(F.pow(v, F.lit(float(p)))), F.lit(1 / p))
    return _value(with_stats(signals, s=norm), F.when(F.col("s") > EPS, F.col("value") / F.when(F.col("s") > EPS, F.col("s")).otherwise(1.0)).otherwise(0.0))


def zscored(signals: DataFrame) -> DataFrame:
    s = F.when(F.col("s") > EPS, F.col("s"))
    return _value(with_stats(signals, m=F.avg("value"), s=F.stddev_pop("value")), F.coalesce((F.col("value") - F.col("m")) / s, F.lit(0.0)))


def robust_zscored(signals: DataFrame) -> DataFrame:
    """(x - median) / (1.4826 MAD); zeros if the scale is tiny."""
    mid = with_stats(signals, med=F.median("value"))
    mad = mid.groupBy(*ONE).agg((1.4826 * F.median(F.abs(F.col("value") - F.col("med")))).alias("s"))
    return _value(mid.join(mad, ONE), F.coalesce((F.col("value") - F.col("med")) / F.when(F.col("s") > EPS, F.col("s")), F.lit(0.0)))


def scaled(signals: DataFrame, norm: str, *, tiny_to_zero: bool = True) -> DataFrame:
    """none, raw, l1, l2, max, sum or zscore; a signal of tiny scale becomes zeros, or stays as it is."""
    if norm in ("none", "raw"):
        return signals
    if norm == "zscore":
        return zscored(signals)
    v = F.col("value")
    s = {"l1": F.sum(F.abs(v)), "l2": F.sqrt(F.sum(v * v)), "max": F.max(F.abs(v)), "sum": F.sum(v)}[norm]
    return _value(with_stats(signals, s=s), F.coalesce(v / F.when(F.abs("s") > EPS, F.col("s")), F.lit(0.0) if tiny_to_zero else v))


def minmax(signals: DataFrame) -> DataFrame:
    """From 0 to 1; zeros if flat."""
    span = F.col("hi") - F.col("lo")
    return _value(with_stats(signals, lo=F.min("value"), hi=F.max("value")), F.coalesce((F.col("value") - F.col("lo")) / F.when(span > EPS, span), F.lit(0.0)))


def distribution(signals: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Nonnegative part over its sum; uniform if there is none."""
    v = F.greatest("value", F.lit(0.0))
    return _value(with_stats(signals, s=F.sum(v), n=F.count("*")), F.coalesce(v / F.when(F.col("s") > eps, F.col("s")), 1 / F.col("n")))


def softmax(signals: DataFrame, temperature: float = 1.0) -> DataFrame:
    top = with_stats(signals, m=F.max("value"))
    e = _value(top, F.exp((F.col("value") - F.col("m")) / temperature))
    return _value(with_stats(e, s=F.sum("value")), F.col("value") / F.col("s"))


def thresholded(signals: DataFrame, threshold: float, mode: str = "absolute") -> DataFrame:
    v = F.col("value")
    keep = {"absolute": F.abs(v) >= threshold, "positive": v >= threshold, "negative": v <= -threshold}.get(mode)
    if keep is None:
        raise GraphError(f"unknown mode {mode!r}")
    return signals.withColumn("value", F.when(keep, v).otherwise(0.0))


def clipped(signals: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    v = F.col("value")
    v = v if low is None else F.greatest(v, F.lit(float(low)))
    return signals.withColumn("value", v if high is None else F.least(v, F.lit(float(high))))


def soft_thresholded(signals: DataFrame, tau: float) -> DataFrame:
    return signals.withColumn("value", soft_threshold(F.col("value"), tau))


def top_nodes(signals: DataFrame, k: int = 10, *, absolute: bool = True) -> DataFrame:
    """The k first nodes of each signal by value or absolute value; ties by node. Adds rank from 1."""
    by = F.abs("value") if absolute else F.col("value")
    turn = Window.partitionBy(*ONE).orderBy(by.desc(), "node")
    return signals.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def consensus(signals: DataFrame, weights: dict[str, float] | None = None, *, name: str = "consensus") -> DataFrame:
    """Mean over the signals of a graph at each node, weighted if weights are given and their sum isn't tiny."""
    w = F.lit(1.0)
    if weights and abs(sum(weights.values())) > EPS:
        w = F.lit(0.0)
        for s, v in weights.items():
            w = F.when(F.col("signal") == s, F.lit(float(v))).otherwise(w)
    got = signals.groupBy("graph_id", "node").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))
    return got.select("graph_id", F.lit(name).alias("signal"), "node", "value")


def average_ranks(signals: DataFrame) -> DataFrame:
    """Ascending ranks from 1, ties sharing their mean."""
    low = F.rank().over(Window.partitionBy(*ONE).orderBy("value"))
    ties = F.count("*").over(Window.partitionBy(*ONE, "value"))
    return _value(signals, (low + (ties - 1) / 2).cast("double"))


def _pair_stats(pairs: DataFrame, by: list[str]) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"), F.covar_pop("a", "b").alias("cov"), F.stddev_pop("a").alias("da"), F.stddev_pop("b").alias("db"), F.sqrt(F.sum((a - b) * (a - b))).alias("l2"))


def similarity_matrix(signals: DataFrame, mode: str = "pearson") -> DataFrame:
    """(graph_id, signal_a, signal_b, value) for all ordered pairs; the diagonal is 1. cosine, pearson, spearman or l2_negative."""
    x = average_ranks(signals) if mode == "spearman" else signals
    a = x.select("graph_id", F.col("signal").alias("signal_a"), "node", F.col("value").alias("a"))
    b = x.select("graph_id", F.col("signal").alias("signal_b"), "node", F.col("value").alias("b"))
    s = _pair_stats(a.join(b, ["graph_id", "node"]).where("signal_a < signal_b"), ["graph_id", "signal_a", "signal_b"])
    if mode == "cosine":
        scale, top = F.sqrt(F.col("aa") * F.col("bb")), F.col("ab")
    elif mode in ("pearson", "spearman"):
        scale, top = F.col("n") * F.col("da") * F.col("db"), F.col("n") * F.col("cov")
    elif mode == "l2_negative":
        scale, top = F.lit(1.0), -F.col("l2")
    else:
        raise GraphError(f"unknown mode {mode!r}")
    half = s.select("graph_id", "signal_a", "signal_b", F.coalesce(top / F.when(scale > EPS, scale), F.lit(0.0)).alias("value"))
    same = signals.select("graph_id", F.col("signal").alias("signal_a")).distinct().select("graph_id", "signal_a", F.col("signal_a").alias("signal_b"), F.lit(1.0).alias("value"))
    return half.union(half.select("graph_id", F.col("signal_b"), F.col("signal_a"), "value")).union(same)


def wide_table(graph: Graph, signals: DataFrame) -> DataFrame:
    """One column per signal, with labels."""
    return graph.nodes.join(signals.groupBy("graph_id", "node").pivot("signal").agg(F.first("value")), ["graph_id", "node"], "left")
