"""Ranks, comparisons of states and summaries over ensembles of trials.

samples(graph_id, trial, node, value) hold one state per trial; two states are compared as frames (graph_id, node, value).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def ordinal_ranks(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds rank 1..n by falling value, ties by node, within each of `by`."""
    return samples.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or ["graph_id", "trial"])).orderBy(F.desc("value"), "node")))


def guarded(top, scale):
    return F.coalesce(top / F.when(F.abs(scale) > EPS, scale), F.lit(0.0))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("graph_id", "node", F.col("value").alias("a")).join(after.select("graph_id", "node", F.col("value").alias("b")), ["graph_id", "node"])


def tied_rank(column: str):
    low = F.rank().over(Window.partitionBy("graph_id").orderBy(column))
    return low + (F.count("*").over(Window.partitionBy("graph_id", column)) - 1) / 2


def compare_states(before: DataFrame, after: DataFrame, *, target: DataFrame | None = None, k: int = 10) -> DataFrame:
    """One row per graph: l1, l2, linf, mean absolute and signed deltas, cosine, pearson, spearman (ties share ranks), first nodes, overlap of the top k,
    and for a target (graph_id, node, value) the objective's delta, its size and its share of the first."""
    p = paired(before, after)
    if target is not None:
        p = p.join(target.select("graph_id", "node", F.col("value").alias("t")), ["graph_id", "node"], "left").na.fill(0.0, ["t"])
    else:
        p = p.withColumn("t", F.lit(None).cast("double"))
    p = p.withColumn("ra", tied_rank("a")).withColumn("rb", tied_rank("b"))
    p = p.withColumn("ka", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("a"), "node"))).withColumn("kb", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("b"), "node")))
    d = F.col("b") - F.col("a")
    s = p.groupBy("graph_id").agg(
        F.count("*").alias("n"), F.sum(F.abs(d)).alias("l1_delta"), F.sqrt(F.sum(d * d)).alias("l2_delta"), F.max(F.abs(d)).alias("linf_delta"), F.avg(F.abs(d)).alias("mean_abs_delta"), F.sum(d).alias("signed_sum_delta"),
        F.sum(F.col("a") * F.col("b")).alias("ab"), F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2)).alias("norms"),
        F.covar_pop("a", "b").alias("cov"), (F.stddev_pop("a") * F.stddev_pop("b")).alias("dev"), F.covar_pop("ra", "rb").alias("rcov"), (F.stddev_pop("ra") * F.stddev_pop("rb")).alias("rdev"),
        F.max(F.when(F.col("ka") == 1, F.col("node"))).alias("top1_before"), F.max(F.when(F.col("kb") == 1, F.col("node"))).alias("top1_after"),
        F.count_if((F.col("ka") <= k) & (F.col("kb") <= k)).alias("both"), F.sum(F.col("t") * F.col("a")).alias("ta"), F.sum(F.col("t") * F.col("b")).alias("tb"),
    )
    delta = F.col("tb") - F.col("ta")
    return s.select(
        "graph_id", "l1_delta", "l2_delta", "linf_delta", "mean_abs_delta", "signed_sum_delta",
        guarded(F.col("ab"), F.col("norms")).alias("cosine"), guarded(F.col("cov"), F.col("dev")).alias("pearson"), guarded(F.col("rcov"), F.col("rdev")).alias("spearman"),
        "top1_before", "top1_after", (F.col("top1_before") != F.col("top1_after")).alias("top1_changed"), (F.col("both") / F.greatest(F.lit(1), F.least(F.lit(k), "n"))).alias("topk_overlap"),
        delta.alias("target_delta"), F.abs(delta).alias("target_abs_delta"), (delta / (F.abs("ta") + EPS)).alias("target_relative_delta"),
    )


def jaccard_topk(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """(graph_id, value): intersection over union of both top k; 1 if both are empty."""
    p = paired(before, after)
    p = p.withColumn("ka", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("a"), "node"))).withColumn("kb", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("b"), "node")))
    return p.groupBy("graph_id").agg(F.coalesce(F.try_divide(F.count_if((F.col("ka") <= k) & (F.col("kb") <= k)), F.count_if((F.col("ka") <= k) | (F.col("kb") <= k))), F.lit(1.0)).alias("value"))


def ordinal_spearman(before: DataFrame, after: DataFrame) -> DataFrame:
    """(graph_id, value): Pearson of ordinal ranks (ties by node); 1 for fewer than two nodes."""
    p = paired(before, after)
    p = p.withColumn("ka", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("a"), "node"))).withColumn("kb", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("b"), "node")))
    n = F.count("*")
    return p.groupBy("graph_id").agg(F.coalesce(1 - F.try_divide(6.0 * F.sum((F.col("ka") - F.col("kb")).cast("double") ** 2), (n * (n * n - 1)).cast("double")), F.lit(1.0)).alias("value"))


def discordance(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(concordant - discordant, concordant + discordant) pairs; pairs tied in either are neither. n log n: inversions are counted block against block while merging."""
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    order = np.lexsort((b, a))
    pairs = lambda key: int((n := np.unique(key, return_counts=True)[1]) @ (n - 1)) // 2
    runs = b[order].astype(np.int64)
    discordant, width, size = 0, 1, len(runs)
    while width < size:
        # rows of one merged block share a base above all values, so that one sort and one search serve all blocks
        base = (np.arange(size) // (2 * width)) * (size + 1)
        left = np.arange(size) // width % 2 == 0
        low, high = (runs + base)[left], (runs + base)[~left]
        ends = np.searchsorted(low, base[~left] + size, side="right")
        discordant += int((ends - np.searchsorted(low, high, side="right")).sum())
        runs = np.sort(runs + base) - base
        width *= 2
    both = size * (size - 1) // 2 - pairs(a) - pairs(b) + pairs(a * (size + 1) + b)
    return both - 2 * discordant, both


def tau(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Kendall's tau of columns a and b in each group, whose nodes are one task's: n log n work instead of n^2 pairs."""
    kinds = dict(rows.dtypes)

    def kernel(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
        over, both = discordance(table["a"].to_numpy(), table["b"].to_numpy())
        return pd.DataFrame([(*group, over / both if both else 0.0)], columns=[*key, name])

    return rows.select(*key, "a", "b").groupBy(*key).applyInPandas(kernel, ", ".join([*(f"{k} {kinds[k]}" for k in key), f"{name} double"]))


def kendall(before: DataFrame, after: DataFrame) -> DataFrame:
    """(graph_id, value): (concordant - discordant) / (both), tied pairs left out; exact over all pairs of nodes."""
    return tau(paired(before, after), ["graph_id"], "value")


def node_moments(samples: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(graph_id, node, mean, std, ci_low, ci_high, min_score, max_score): sample deviation, interpolated quantiles."""
    return samples.groupBy("graph_id", "node").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.percentile("value", alpha / 2).alias("ci_low"), F.percentile("value", 1 - alpha / 2).alias("ci_high"), F.min("value").alias("min_score"), F.max("value").alias("max_score"),
    )


def rank_probability(samples: DataFrame) -> DataFrame:
    """(graph_id, node, rank, probability) over the trials."""
    ranked = ordinal_ranks(samples)
    trials = samples.groupBy("graph_id").agg(F.countDistinct("trial").alias("trials"))
    return ranked.groupBy("graph_id", "node", "rank").agg(F.count("*").alias("n")).join(trials, "graph_id").select("graph_id", "node", "rank", (F.col("n") / F.col("trials")).alias("probability"))


def rank_entropy(samples: DataFrame) -> DataFrame:
    """(graph_id, node, rank_entropy) in bits."""
    p = F.col("probability")
    return rank_probability(samples).groupBy("graph_id", "node").agg(F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0)).alias("rank_entropy"))


def borda(samples: DataFrame) -> DataFrame:
    """(graph_id, node, consensus_score): mean of (n - rank) / (n - 1)."""
    n = F.count("*").over(Window.partitionBy("graph_id", "trial"))
    r = ordinal_ranks(samples).withColumn("n", n)
    return r.groupBy("graph_id", "node").agg(F.avg(F.when(F.col("n") > 1, (F.col("n") - F.col("rank")) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(1.0)).alias("consensus_score"))


def rank_shifts(samples: DataFrame, baseline: DataFrame) -> DataFrame:
    """(graph_id, node, rank_baseline, rank_median, mean_abs_rank_shift)."""
    base = ordinal_ranks(baseline, ["graph_id"]).select("graph_id", "node", F.col("rank").alias("rank_baseline"))
    r = ordinal_ranks(samples).join(base, ["graph_id", "node"])
    return r.groupBy("graph_id", "node", "rank_baseline").agg(F.median("rank").alias("rank_median"), F.avg(F.abs(F.col("rank") - F.col("rank_baseline"))).alias("mean_abs_rank_shift"))


def node_summaries(samples: DataFrame, baseline: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The 13 columns of a node's uncertainty, and graph_id, in the order of falling consensus."""
    on = ["graph_id", "node"]
    df = baseline.select(*on, F.col("value").alias("baseline_score")).join(node_moments(samples, alpha), on).join(rank_shifts(samples, baseline), on).join(rank_entropy(samples), on).join(borda(samples), on)
    return df.select(*on, "baseline_score", "mean", "std", "ci_low", "ci_high", "min_score", "max_score", "rank_baseline", "rank_median", "mean_abs_rank_shift", "rank_entropy", "consensus_score").orderBy("graph_id", F.desc("consensus_score"), "node")


def probability_above(samples: DataFrame, threshold: float) -> DataFrame:
    return samples.groupBy("graph_id", "node").agg(F.avg((F.col("value") > threshold).cast("int")).alias("probability"))


def probability_topk(samples: DataFrame, k: int) -> DataFrame:
    return ordinal_ranks(samples).groupBy("graph_id", "node").agg(F.avg((F.col("rank") <= k).cast("int")).alias("probability"))


def credible_topk(samples: DataFrame, k: int = 10) -> DataFrame:
    """The k first by consensus, with moments and the probability of being among them."""
    on = ["graph_id", "node"]
    df = borda(samples).join(node_moments(samples), on).join(probability_topk(samples, k), on)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("consensus_score"), "node"))).where(F.col("rank") <= k)


def trial_agreement(samples: DataFrame, baseline: DataFrame) -> DataFrame:
    """(graph_id, trial, spearman): ordinal, of each trial with the baseline."""
    base = ordinal_ranks(baseline, ["graph_id"]).select("graph_id", "node", F.col("rank").alias("r0"))
    r = ordinal_ranks(samples).join(base, ["graph_id", "node"])
    n = F.count("*")
    return r.groupBy("graph_id", "trial").agg(F.coalesce(1 - F.try_divide(6.0 * F.sum((F.col("rank") - F.col("r0")).cast("double") ** 2), (n * (n * n - 1)).cast("double")), F.lit(1.0)).alias("spearman"))


def trial_kendall(samples: DataFrame, baseline: DataFrame) -> DataFrame:
    """(graph_id, trial, kendall) of each trial with the baseline, over all pairs of nodes."""
    base = baseline.select("graph_id", "node", F.col("value").alias("b"))
    return tau(samples.join(base, ["graph_id", "node"]).withColumnRenamed("value", "a"), ["graph_id", "trial"], "kendall")


def pairwise_agreement(samples: DataFrame) -> DataFrame:
    """(graph_id, mean, std, min, max) of ordinal Spearman over all pairs of trials."""
    r = ordinal_ranks(samples).select("graph_id", "trial", "node", "rank")
    q = r.select("graph_id", F.col("trial").alias("trial2"), "node", F.col("rank").alias("rank2"))
    n = F.count("*")
    each = r.join(q, ["graph_id", "node"]).where("trial < trial2").groupBy("graph_id", "trial", "trial2").agg((1 - 6.0 * F.sum((F.col("rank") - F.col("rank2")).cast("double") ** 2) / (n * (n * n - 1))).alias("s"))
    return each.groupBy("graph_id").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("min"), F.max("s").alias("max"))


def fragility(samples: DataFrame, baseline: DataFrame, k: int = 10) -> DataFrame:
    """(graph_id, topk_overlap, mean_shift, mean_cv, mean_spearman, fragility_index, label)."""
    consensus = borda(samples).select("graph_id", "node", F.col("consensus_score").alias("value"))
    top = compare_states(baseline, consensus, k=k).select("graph_id", "topk_overlap")
    n = baseline.groupBy("graph_id").agg(F.count("*").alias("n"))
    shift = rank_shifts(samples, baseline).groupBy("graph_id").agg(F.avg("mean_abs_rank_shift").alias("mean_shift"))
    cv = samples.groupBy("graph_id", "node").agg((F.stddev_pop("value") / (F.abs(F.avg("value")) + EPS)).alias("cv")).groupBy("graph_id").agg(F.avg(F.least("cv", F.lit(2.0))).alias("mean_cv"))
    rho = trial_agreement(samples, baseline).groupBy("graph_id").agg(F.avg("spearman").alias("mean_spearman"))
    df = top.join(n, "graph_id").join(shift, "graph_id").join(cv, "graph_id").join(rho, "graph_id")
    index = 0.35 * (1 - F.col("topk_overlap")) + 0.25 * F.least(F.lit(1.0), F.col("mean_shift") / F.greatest(F.lit(1.0), F.col("n") / 2)) + 0.20 * F.col("mean_cv") / 2 + 0.20 * (1 - F.col("mean_spearman")) / 2
    index = F.least(F.greatest(index, F.lit(0.0)), F.lit(1.0))
    label = F.when(index < 0.20, "robust").when(index < 0.40, "mostly_robust").when(index < 0.65, "sensitive").otherwise("fragile")
    return df.select("graph_id", "topk_overlap", "mean_shift", "mean_cv", "mean_spearman", index.alias("fragility_index"), label.alias("label"))
