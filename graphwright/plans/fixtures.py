"""Graphs and signals derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..sources.readers import vectors_to_contacts

MAX_DISTANCE = 1.20
#: Line items of a partition.
PART_LINES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> Graph:
    """Trade between customers' and suppliers' nations: line items over the most of any pair."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cn"))
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sn"))
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey").select("l_orderkey", "cn")
    # line items are summed by order and supplier's nation before the large join
    part = t("lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey").groupBy("l_orderkey", "sn").agg(F.count("*").alias("n"))
    pairs = part.join(o, "l_orderkey").where("cn <> sn").groupBy(F.least("cn", "sn").alias("src"), F.greatest("cn", "sn").alias("dst")).agg(F.sum("n").alias("n"))
    top = pairs.agg(F.max("n").alias("top"))
    e = pairs.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("n") / F.col("top")).alias("weight"))  # one row
    return Graph.from_edges(e, t("nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("label")), graph_id="nation", name="nation")


def balances(spark: SparkSession, sf_dir: str, signal: str = "balance") -> DataFrame:
    """Mean account balance of customers by nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("node"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("value"))
    return n.join(c, "node", "left").select(F.lit("nation").alias("graph_id"), F.lit(signal).alias("signal"), "node", F.coalesce("value", F.lit(0.0)).alias("value"))


def supplies(spark: SparkSession, sf_dir: str, signal: str = "supply") -> DataFrame:
    """Mean account balance of suppliers by nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("node"))
    c = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.avg("s_acctbal").alias("value"))
    return n.join(c, "node", "left").select(F.lit("nation").alias("graph_id"), F.lit(signal).alias("signal"), "node", F.coalesce("value", F.lit(0.0)).alias("value"))


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples(graph_id, trial, node, value): mean price of a nation's orders in each year, a trial."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    v = o.groupBy(F.year("o_orderdate").alias("trial"), F.col("c_nationkey").alias("node")).agg(F.avg("o_totalprice").alias("value"))
    trials = v.select("trial").distinct()
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("node")).crossJoin(F.broadcast(trials))  # 25 rows by years
    return cells.join(v, ["trial", "node"], "left").select(F.lit("nation").alias("graph_id"), "trial", "node", F.coalesce("value", F.lit(0.0)).alias("value"))


def embeddings(spark: SparkSession, sf_dir: str) -> Graph:
    """Vectors within a distance of MAX_DISTANCE."""
    v = table(spark, sf_dir, "embeddings").select(F.lit("embed").alias("graph_id"), F.col("vec_id").cast("int").alias("node"), F.col("embedding").cast("array<double>").alias("v"))
    return Graph.from_edges(vectors_to_contacts(v, MAX_DISTANCE), v.select("graph_id", "node"), graph_id="embed", name="embed", ordered=True)


def events(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed transitions between event types of one user, by count; nodes are types in order of name."""
    ev = table(spark, sf_dir, "events")
    types = ev.select("event_type").distinct().withColumn("node", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))  # one row per type
    step = ev.select("user_id", "ts", "event_id", "event_type").withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next is not null")
    counts = step.groupBy("event_type", "next").agg(F.count("*").cast("double").alias("weight"))
    e = counts.join(types.withColumnRenamed("node", "src"), "event_type").join(types.select(F.col("event_type").alias("next"), F.col("node").alias("dst")), "next")
    return Graph.from_edges(e.select("src", "dst", "weight"), types.select("node", F.col("event_type").alias("label")), graph_id="event", name="event", both=True)


def parts(spark: SparkSession, sf_dir: str, *deal: str) -> Graph:
    """Parts bought in one order, by the number of shared line items. Partitions follow the number of line items, so that no task grows with the tables.

    deal: what pairs are dealt by, src if not given; by src and dst, the pairs of a part that is in very many orders are spread, too.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = max(1, -(-li.count() // PART_LINES))
    li = li.repartition(n, "l_orderkey")
    pairs = li.alias("a").join(li.alias("b"), F.col("a.l_orderkey") == F.col("b.l_orderkey")).where("a.l_partkey < b.l_partkey")
    pairs = pairs.select(F.col("a.l_partkey").cast("int").alias("src"), F.col("b.l_partkey").cast("int").alias("dst")).repartition(n, *(deal or ("src",)))
    e = pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return Graph.from_edges(e, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label")), graph_id="part", name="part", ordered=True)
