"""Mixing sources by temperature.

A source's weight is its token share to the power of an exponent, normalised: 1 keeps the shares, 0 makes them equal. The exponent is bisected
(many points at a time: each round narrows the bracket by POINTS) to the least one at which no source is repeated over `max_repetition` times and, if
`target_entropy` (bits) is given, the weights' entropy isn't over it; limits that no exponent meets are an error. The budget of tokens is a parameter; without it, it is the least at which every
source is read whole once, so that nothing is dropped.

The weights are realised as budgeted block permutations: a source's documents are dealt into blocks by hash, every epoch reads its
blocks in an order of its own, and a source ends where its budget does: whole blocks up to there, and of the block on the edge the documents in
the order of their hashes whose tokens end within the budget. `position` (0 to 1) is where a block starts in its source's budget; sorted by it,
the sources run side by side. Tokens are words; a document without any counts as none and is read in every epoch of its block.

Contract: one output row for each time a row is read (none if the budget ends before); null sources are a source of their own; rows of one id are
documents of their own; an empty table gives an empty one. Everything runs in DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import settled
from .native import join_small, whole, words_of

MAX_REPETITION = 1.5
BLOCK_TOKENS = 10_000_000
MIN_BLOCKS = 96
POINTS = 64
ROUNDS = 6
SEED = 20


def bisected(totals: DataFrame, max_repetition: float | None, target_entropy: float | None, budget: float | None = None) -> float:
    """The least exponent from 0 to 1 that meets both limits; an error if none does. totals: (source, tokens), tokens over 0."""
    low, high = 0.0, 1.0
    largest = totals.agg(F.max("tokens")).first()[0] or 1
    for _ in range(ROUNDS):
        step = (high - low) / POINTS
        tried = totals.select((F.col("tokens") / F.lit(float(largest))).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(POINTS))).alias("k"))
        a = F.lit(low) + F.col("k") * F.lit(step)
        w = F.pow("s", a)
        # source i is read budget * s_i ** (a - 1) / (z * largest) times; without a budget, that of the source read least is 1
        per = F.pow("s", a - 1)
        read = F.max(per) / F.min(per) if budget is None else F.max(per) / F.sum(w) * F.lit(budget / largest)
        found = tried.groupBy("k").agg(F.sum(w).alias("z"), F.sum(w * F.log2(w)).alias("wl"), read.alias("rep")).orderBy("k").collect()
        if not found:
            return high
        meets = [
            (max_repetition is None or r.rep <= max_repetition + 1e-12) and (target_entropy is None or math.log2(r.z) - r.wl / r.z <= target_entropy + 1e-12)
            for r in found
        ]
        if (first := next((i for i, ok in enumerate(meets) if ok), None)) is None:
            raise ValueError(f"no exponent from 0 to 1 meets max_repetition {max_repetition} and target_entropy {target_entropy} with a budget of {budget} tokens")
        if first == 0:
            return low
        low, high = low + (first - 1) * step, low + first * step
    return high


def plan(docs: DataFrame, *, doc_id: str, source: str, text: str, budget: float | None, max_repetition: float | None, target_entropy: float | None, seed: int) -> tuple[DataFrame, DataFrame, float]:
    """Rows with __source, __tokens, __block; (source, block, epoch, start, tokens, quota, share) of each reading of a block; the exponent."""
    key = F.coalesce(F.col(source).cast("string"), F.lit("\0null"))
    rows = docs.select("*", key.alias("__source"), F.size(words_of(whole(text))).cast("long").alias("__tokens"))
    fine = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 20))
    total = rows.agg(F.sum("__tokens")).first()[0] or 0
    n_blocks = max(MIN_BLOCKS, math.ceil(total / BLOCK_TOKENS))
    rows = rows.withColumn("__block", F.pmod(fine, F.lit(n_blocks)).cast("int"))
    blocks = settled(rows.groupBy("__source", "__block").agg(F.sum("__tokens").alias("tokens")))
    totals = settled(blocks.groupBy("__source").agg(F.sum("tokens").alias("tokens")))
    positive = totals.where("tokens > 0")
    exponent = bisected(positive, max_repetition, target_entropy, budget)
    w = F.pow("tokens", F.lit(exponent))
    z = positive.agg(F.sum(w).alias("z"), F.max(F.col("tokens") / w).alias("b")).first()
    z_sum, least = (z.z or 1.0), (z.b or 0.0)
    budget = least * z_sum if budget is None else float(budget)
    # quotas are whole tokens; a source without tokens is read once
    quota = F.when(F.col("tokens") > 0, F.floor(w / F.lit(z_sum) * F.lit(budget) + 1e-6)).otherwise(0)
    sources = totals.select("__source", F.col("tokens").alias("own"), quota.cast("long").alias("quota"), F.when(F.col("tokens") > 0, w / F.lit(z_sum)).otherwise(0.0).alias("weight"))
    epochs = F.when(F.col("own") > 0, F.ceil(F.col("quota") / F.greatest(F.col("own"), F.lit(1)))).otherwise(1).cast("int")
    reads = blocks.join(sources, "__source").where(epochs > 0).select("*", F.explode(F.sequence(F.lit(0), epochs - 1)).alias("epoch"))
    turn = Window.partitionBy("__source").orderBy("epoch", F.xxhash64("__source", "__block", "epoch", F.lit(seed)), "__block")
    before = F.coalesce(F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reads = reads.withColumn("start", before).where("own = 0 or start < quota")
    return rows, settled(reads), exponent


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", budget: float | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, seed: int = SEED) -> DataFrame:
    """The table's rows as often as they are read, with __source, __tokens, __block, epoch, position, weight."""
    rows, reads, _ = plan(docs, doc_id=doc_id, source=source, text=text, budget=budget, max_repetition=max_repetition, target_entropy=target_entropy, seed=seed)
    whole_ = (F.col("start") + F.col("tokens") <= F.col("quota")) | (F.col("own") == 0)
    edges = reads.where(~whole_).select("__source", "__block", F.col("epoch").alias("edge_epoch"), (F.col("quota") - F.col("start")).alias("room"))
    place = F.when(F.col("quota") > 0, F.col("start") / F.col("quota")).otherwise(0.0)
    per_block = reads.groupBy("__source", "__block").agg(
        F.array_sort(F.collect_list(F.when(whole_, F.struct("epoch", place.alias("position"))))).alias("full"),
        F.max(F.when(~whole_, F.struct(F.col("epoch").alias("epoch"), place.alias("position"), (F.col("quota") - F.col("start")).alias("room")))).alias("edge"),
        F.max("weight").alias("weight"),
    )
    df = join_small(rows, per_block, ["__source", "__block"], F.col(doc_id))
    # only the rows of the one block on each source's edge are summed up, by id and size
    order = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(seed + 1))
    skinny = join_small(rows.select(F.col(doc_id).alias("__id"), "__source", "__block", "__tokens", order.alias("__order")), edges, ["__source", "__block"], F.col("__id")).where("room is not null")
    turn = Window.partitionBy("__source", "__block").orderBy("__order", "__id")
    cut = skinny.groupBy("__source", "__block", "__order", "__id", "room").agg(F.sum("__tokens").alias("t")).withColumn("end", F.sum("t").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    last = cut.where("end <= room").groupBy("__source", "__block").agg(F.max(F.struct("__order", "__id")).alias("last"))
    df = join_small(df, last, ["__source", "__block"], F.col(doc_id))
    inside = F.coalesce(F.struct(order.alias("__order"), F.col(doc_id).alias("__id")) <= F.col("last"), F.lit(False))
    times = F.concat(F.coalesce("full", F.array()), F.when(inside & F.col("edge").isNotNull(), F.array(F.struct(F.col("edge.epoch").alias("epoch"), F.col("edge.position").alias("position")))).otherwise(F.array()))
    df = df.select(*docs.columns, "__source", "__tokens", "__block", "weight", F.explode(times).alias("__read"))
    return df.select("*", F.col("__read.epoch").alias("epoch"), F.col("__read.position").alias("position")).drop("__read")


def schedule(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """doc_id, source, n_tokens, block, weight, epoch, position: one row for each reading of a document."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    out = mixed(slim, **options)
    return out.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__block").alias("block"), "weight", "epoch", "position")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the table's own columns."""
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    args = {k: names[options.pop(k, k)] for k in ("doc_id", "source", "text")}
    out = mixed(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), **args, **options)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))
