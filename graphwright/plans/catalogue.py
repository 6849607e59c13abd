"""The registered queries and the SQL that says the same.

Doubles are rounded to DIGITS on both sides (and 0.0 added, against negative zeros); ids are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, transfers
from ..operators import dynamics, flow, matrices, montecarlo, prepare, signals, sparse, spectral, stats, traversal, whatif
from ..streaming import transitions
from . import extras, oracles
from . import fixtures as fx

DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def r(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS) + F.lit(0.0)


def out(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles rounded, integers long; names may be given as old:new."""
    kinds, made = dict(df.dtypes), []
    for c in columns:
        old, _, new = c.partition(":")
        col = r(old) if kinds[old] == "double" else F.col(old).cast("long") if kinds[old] in ("int", "bigint", "smallint") else F.col(old)
        made.append(col.alias(new or old))
    return df.select(*made)


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# SQL of the fixtures: e(i, j, w) both directions, v(node), x(node, x), y(node, x), d(node, d, k)
NATION = """
WITH RECURSIVE pairs AS (
  SELECT least(c_nationkey, s_nationkey) a, greatest(c_nationkey, s_nationkey) b, count(*) n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
u AS (SELECT a i, b j, n / (SELECT max(n) FROM pairs) w FROM pairs),
e AS (SELECT i, j, w FROM u UNION ALL SELECT j, i, w FROM u),
v AS (SELECT n_nationkey node, n_name label FROM nation),
x AS (SELECT node, coalesce(avg(c_acctbal), 0.0) x FROM v LEFT JOIN customer ON c_nationkey = node GROUP BY node),
y AS (SELECT node, coalesce(avg(s_acctbal), 0.0) x FROM v LEFT JOIN supplier ON s_nationkey = node GROUP BY node),
d AS (SELECT node, coalesce(sum(w), 0.0) d, count(w) k FROM v LEFT JOIN e ON i = node GROUP BY node),
lap AS (SELECT a.node i, b.node j, CASE WHEN a.node = b.node THEN a.d ELSE 0.0 END - coalesce(w, 0.0) m FROM d a CROSS JOIN v b LEFT JOIN e ON e.i = a.node AND e.j = b.node)
"""
YEARS = NATION + """,
vals AS (SELECT year(o_orderdate) trial, c_nationkey node, avg(o_totalprice) x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT trial, node, coalesce(x, 0.0) x FROM v CROSS JOIN (SELECT DISTINCT trial FROM vals) LEFT JOIN vals USING (trial, node)),
rk AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY x DESC, node) r, count(*) OVER (PARTITION BY trial) n FROM s)
"""
EVENT = """
WITH ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 node FROM (SELECT DISTINCT event_type FROM events)),
st AS (SELECT event_type a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events),
e AS (SELECT p.node i, q.node j, count(*)::DOUBLE w FROM st JOIN ty p ON p.event_type = a JOIN ty q ON q.event_type = b GROUP BY ALL),
z AS (SELECT p.node i, q.node j, coalesce(f.w, 0.0) f, coalesce(g.w, 0.0) g FROM ty p CROSS JOIN ty q LEFT JOIN e f ON f.i = p.node AND f.j = q.node LEFT JOIN e g ON g.i = q.node AND g.j = p.node)
"""
EMBED = """
WITH p AS (SELECT a.vec_id i, b.vec_id j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
"""
PART = """
WITH u AS (SELECT a.l_partkey i, b.l_partkey j, count(*)::DOUBLE w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL),
e AS (SELECT i, j, w FROM u UNION ALL SELECT j, i, w FROM u)
"""


def rd(x: str) -> str:
    return f"round({x}, {DIGITS}) + 0.0"


def iterate(matrix: str, start: str, steps: int, final: str) -> str:
    """SQL of so many products with a full matrix m(i, j, m) from a vector of all nodes."""
    return f"{NATION}, mm AS ({matrix}), it AS (SELECT 0 k, node, ({start}) x FROM v UNION ALL SELECT it.k + 1, mm.i, sum(mm.m * it.x) FROM it JOIN mm ON mm.j = it.node WHERE it.k < {steps} GROUP BY it.k + 1, mm.i) {final}"


# Edges and their repair


@query(f"{NATION} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('w')} AS weight FROM e")
def edges_nation(spark, sf):
    return out(fx.nations(spark, sf).edges, "src", "dst", "weight")


@query(f"{EMBED} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('1 / (dist + 1e-9)')} AS weight FROM p WHERE dist <= 1.2")
def contact_edges(spark, sf):
    v = fx.table(spark, sf, "embeddings").select(F.lit("embed").alias("graph_id"), F.col("vec_id").cast("int").alias("node"), F.col("embedding").cast("array<double>").alias("v"))
    return out(fx.vectors_to_contacts(v, fx.MAX_DISTANCE, mode="inv_distance"), "src", "dst", "weight")


for _mode, _f in {"average": "(f + g) / 2", "max": "greatest(f, g)", "min": "least(f, g)", "none": "f"}.items():
    query(f"{EVENT} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd(_f)} AS weight FROM z WHERE {_f} <> 0", f"symmetrize_{_mode}")(lambda spark, sf, m=_mode: out(prepare.symmetrize(fx.events(spark, sf).edges, m), "src", "dst", "weight"))


@query(f"{EVENT} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('(f + g) / 2')} AS weight FROM z WHERE i <> j AND f + g > 0")
def sanitize(spark, sf):
    return out(prepare.sanitize(fx.events(spark, sf)).edges, "src", "dst", "weight")


@query(f"{EVENT} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('(f + g) / 2')} AS weight FROM z WHERE i < j AND f + g > 0")
def mean_upper_edges(spark, sf):
    return out(prepare.mean_upper_edges(fx.events(spark, sf).edges), "src", "dst", "weight")


@query(f"{NATION} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('least(greatest(w, 0.3), 0.8)')} AS weight FROM e")
def clip_weights(spark, sf):
    return out(prepare.clip_weights(fx.nations(spark, sf).edges, 0.3, 0.8), "src", "dst", "weight")


@query(f"{NATION} SELECT (i - 5)::BIGINT AS src, (j - 5)::BIGINT AS dst, {rd('w')} AS weight FROM e WHERE i BETWEEN 5 AND 14 AND j BETWEEN 5 AND 14")
def induced_subgraph(spark, sf):
    g = fx.nations(spark, sf)
    return out(prepare.induced_subgraph(g, g.nodes.where("node between 5 and 14")).edges, "src", "dst", "weight")


_COSTS = {"inverse": "1 / greatest(w, 1e-12)", "negative_log": "-ln(least(greatest(w / (SELECT max(w) FROM e), 1e-12), 1.0)) + 1e-12", "affinity": "(SELECT median(w) FROM e) / greatest(w, 1e-12)", "unit": "1.0::DOUBLE"}
for _s, _f in _COSTS.items():
    query(f"{NATION} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd(_f)} AS cost FROM e", f"cost_{_s}")(lambda spark, sf, s=_s: out(prepare.weight_to_cost(fx.nations(spark, sf).edges, s), "src", "dst", "cost"))


@query(f"{NATION}, k AS (SELECT *, row_number() OVER (ORDER BY w DESC, i, j) rank FROM u) SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('w')} AS weight, rank::BIGINT AS rank FROM k WHERE rank <= 40")
def strongest_edges(spark, sf):
    return out(prepare.strongest(fx.nations(spark, sf).edges, 40), "src", "dst", "weight", "rank")


# Matrices


@query(f"{NATION} SELECT node::BIGINT AS node, {rd('d')} AS degree, k::BIGINT AS links FROM d")
def degree(spark, sf):
    return out(matrices.degrees(fx.nations(spark, sf)), "node", "degree", "links")


@query(f"{PART}, d AS (SELECT i, sum(w) d, count(*) k FROM e GROUP BY i) SELECT p_partkey::BIGINT AS node, {rd('coalesce(d, 0.0)')} AS degree, coalesce(k, 0)::BIGINT AS links FROM part LEFT JOIN d ON i = p_partkey")
def degree_parts(spark, sf):
    return out(matrices.degrees(fx.parts(spark, sf, "src", "dst")), "node", "degree", "links")


@query(f"{NATION} SELECT node::BIGINT AS node, k::BIGINT AS score FROM d")
def mediation(spark, sf):
    return out(dynamics.mediation(fx.nations(spark, sf)), "node", "score")


@query(f"{NATION} SELECT count(*)::BIGINT AS nodes, (SELECT count(*) FROM u)::BIGINT AS edges, {rd('(SELECT count(*) FROM u) / (count(*) * (count(*) - 1) / 2)')} AS density, {rd('sum(d)')} AS volume, {rd('min(d)')} AS degree_min, {rd('max(d)')} AS degree_max, {rd('avg(d)')} AS degree_mean, {rd('stddev_pop(d)')} AS degree_std FROM d")
def graph_summary(spark, sf):
    return out(matrices.graph_summary(fx.nations(spark, sf)), "nodes", "edges", "density", "volume", "degree_min", "degree_max", "degree_mean", "degree_std")


_ON = "{a} FROM d a CROSS JOIN d b LEFT JOIN e ON e.i = a.node AND e.j = b.node"
_LAP = {
    "unnormalized": "CASE WHEN a.node = b.node THEN a.d ELSE 0.0 END - coalesce(w, 0.0)",
    "normalized": "CASE WHEN a.node = b.node THEN (a.d > 1e-12)::INT ELSE coalesce(-w / sqrt(a.d * b.d), 0.0) END",
    "random_walk": "CASE WHEN a.node = b.node THEN 1.0 ELSE coalesce(-w / a.d, 0.0) END",
}
for _k, _f in _LAP.items():
    query(f"{NATION} SELECT a.node::BIGINT AS i, b.node::BIGINT AS j, {rd(_f)} AS value {_ON.format(a='')} WHERE w IS NOT NULL OR a.node = b.node", f"laplacian_{_k}")(lambda spark, sf, k=_k: out(matrices.laplacian_entries(fx.nations(spark, sf), k), "i", "j", "value"))


@query(f"{NATION} SELECT i::BIGINT AS i, j::BIGINT AS j, {rd('w / d')} AS value FROM e JOIN d ON node = i")
def transition(spark, sf):
    return out(matrices.transition_entries(fx.nations(spark, sf)), "i", "j", "value")


@query(f"{NATION} SELECT i::BIGINT AS i, j::BIGINT AS j, {rd('w * exp(-1 / w) / sum(w * exp(-1 / w)) OVER (PARTITION BY i)')} AS value FROM e")
def transition_by_cost(spark, sf):
    g = fx.nations(spark, sf)
    return out(matrices.transition_entries(g, self_loops=True, cost=prepare.weight_to_cost(g.edges), beta=1.0), "i", "j", "value")


@query(f"{NATION} SELECT a.node::BIGINT AS i, b.node::BIGINT AS j, {rd('coalesce(w, 0.0) - a.d * b.d / (SELECT sum(d) FROM d)')} AS value {_ON.format(a='')}")
def modularity(spark, sf):
    return out(matrices.modularity_entries(fx.nations(spark, sf)), "i", "j", "value")


@query(f"{PART}, t AS (SELECT a.i i, b.j j, count(*) n FROM e a JOIN e b ON a.j = b.i WHERE a.i < b.j GROUP BY ALL) SELECT u.i::BIGINT AS src, u.j::BIGINT AS dst, coalesce(n, 0)::BIGINT AS support FROM u LEFT JOIN t USING (i, j)")
def triangle_support(spark, sf):
    return out(matrices.triangle_support(fx.parts(spark, sf)), "src", "dst", "support")


@query(f"{NATION}, c AS (SELECT a.node i, b.node j, coalesce(w, 0.0) w {_ON.format(a='')}) SELECT (SELECT count(*) FROM v)::BIGINT AS n, {rd('min(w)')} AS min, {rd('max(w)')} AS max, {rd('avg(w)')} AS mean, {rd('stddev_pop(w)')} AS std, {rd('sqrt(sum(w * w))')} AS frobenius, count(*) FILTER (w <> 0)::BIGINT AS nnz, {rd('count(*) FILTER (w <> 0) / count(*)')} AS density FROM c")
def matrix_summary(spark, sf):
    return out(matrices.matrix_summary(fx.nations(spark, sf)), "n", "min", "max", "mean", "std", "frobenius", "nnz", "density")


# Propagation

SEED = "CASE WHEN node = 0 THEN 1.0::DOUBLE ELSE 0.0 END"
_HEAT = "SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END - 0.02 * m m FROM lap"
_WALK = "SELECT a.node i, b.node j, {stay} + {go} * coalesce(w / b.d, 0.0) m FROM d a CROSS JOIN d b LEFT JOIN e ON e.i = a.node AND e.j = b.node"


@query(iterate(_HEAT, SEED, 10, f"SELECT node::BIGINT AS node, {rd('x')} AS value FROM it WHERE k = 10"))
def diffusion(spark, sf):
    return out(dynamics.forward(fx.nations(spark, sf), steps=10, dt=0.02), "node", "value")


@query(iterate(_HEAT, SEED, 4, f"SELECT node::BIGINT AS node, {rd('x')} AS value FROM it WHERE k = 4"))
def diffusion_joined(spark, sf):
    g = fx.nations(spark, sf)
    return out(dynamics.run_joined(g, dynamics.seeds(g), steps=4, dt=0.02), "node", "value")


@query(iterate(_HEAT, SEED, 10, f"SELECT k::BIGINT AS t, node::BIGINT AS node, {rd('x')} AS value FROM it"))
def trajectory(spark, sf):
    g = fx.nations(spark, sf)
    return out(dynamics.trajectory(g, dynamics.seeds(g), steps=10, dt=0.02), "t", "node", "value")


@query(iterate("SELECT a.node i, b.node j, coalesce(w, 0.0) m FROM v a CROSS JOIN v b LEFT JOIN e ON e.i = a.node AND e.j = b.node", SEED, 5, f"SELECT node::BIGINT AS node, {rd('x / (SELECT sum(abs(x)) FROM it WHERE k = 5)')} AS value FROM it WHERE k = 5"))
def hop(spark, sf):
    return out(dynamics.forward(fx.nations(spark, sf), model="hop", steps=5), "node", "value")


@query(iterate(_WALK.format(stay="CASE WHEN a.node = b.node THEN 0.7 ELSE 0.0 END", go="0.3"), SEED, 8, f"SELECT node::BIGINT AS node, {rd('x')} AS value FROM it WHERE k = 8"))
def lazy_walk(spark, sf):
    return out(dynamics.forward(fx.nations(spark, sf), model="lazy", steps=8, dt=0.3), "node", "value")


@query(iterate(_WALK.format(stay="CASE WHEN a.node = 0 THEN 0.15 ELSE 0.0 END", go="0.85"), SEED, 12, f"SELECT node::BIGINT AS node, {rd('x')} AS value FROM it WHERE k = 12"))
def pagerank(spark, sf):
    return out(dynamics.forward(fx.nations(spark, sf), model="pagerank", steps=12, dt=0.15), "node", "value")


@query(iterate("SELECT i, j, m FROM lap", SEED, 2, f"SELECT node::BIGINT AS node, {rd('sum(x * [1.0, -0.5, 0.1][k + 1])')} AS value FROM it GROUP BY node"))
def polynomial_filter(spark, sf):
    g = fx.nations(spark, sf)
    return out(dynamics.polynomial(g, dynamics.seeds(g), [1.0, -0.5, 0.1]), "node", "value")


@query(f"{NATION}, mm AS ({_HEAT}), it AS (SELECT 0 k, a.node s, b.node, CASE WHEN a.node = b.node THEN 1.0::DOUBLE ELSE 0.0 END x FROM v a CROSS JOIN v b UNION ALL SELECT it.k + 1, it.s, mm.i, sum(mm.m * it.x) FROM it JOIN mm ON mm.j = it.node WHERE it.k < 6 GROUP BY it.k + 1, it.s, mm.i) SELECT s::BIGINT AS node, {rd('sum(abs(x))')} AS score FROM it WHERE k = 6 GROUP BY s")
def scan(spark, sf):
    return out(dynamics.scan(fx.nations(spark, sf), steps=6, dt=0.02, chunk=8), "node", "score")


@query(f"{NATION} SELECT node::BIGINT AS node, {rd('x / (sqrt(sum(x * x) OVER ()) + 1e-12)')} AS value FROM x")
def inverse(spark, sf):
    return out(dynamics.inverse(fx.balances(spark, sf)), "node", "value")


@query(f"{NATION} SELECT {rd('2 * 0.1 * max(d)')} AS bound, 2 * 0.1 * max(d) <= 2.1 AS stable FROM d")
def euler_stability(spark, sf):
    return out(dynamics.stability(fx.nations(spark, sf), 0.1), "bound", "stable")


# Signals

_GRAD = f"{NATION}, g AS (SELECT i, j, w, q.x - p.x dx FROM u JOIN x p ON p.node = i JOIN x q ON q.node = j)"


@query(f"{_GRAD} SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('sqrt(w) * dx')} AS value FROM g")
def gradient(spark, sf):
    return out(signals.gradient(fx.nations(spark, sf), fx.balances(spark, sf)), "src", "dst", "value")


@query(f"{_GRAD}, f AS (SELECT i node, w * dx y FROM g UNION ALL SELECT j, -w * dx FROM g) SELECT node::BIGINT AS node, {rd('sum(y)')} AS value FROM f GROUP BY node")
def divergence(spark, sf):
    g = fx.nations(spark, sf)
    return out(signals.divergence(g, signals.gradient(g, fx.balances(spark, sf))), "node", "value")


@query(f"{NATION} SELECT i::BIGINT AS node, {rd('sum(m * x)')} AS value FROM lap JOIN x ON node = j GROUP BY i")
def laplacian_apply(spark, sf):
    return out(signals.laplacian_apply(fx.nations(spark, sf), fx.balances(spark, sf)), "node", "value")


@query(f"{_GRAD}, f AS (SELECT i node, -w * pow(dx * dx + 1e-16, -0.25) * dx y FROM g UNION ALL SELECT j, w * pow(dx * dx + 1e-16, -0.25) * dx FROM g) SELECT node::BIGINT AS node, {rd('sum(y)')} AS value FROM f GROUP BY node")
def p_laplacian(spark, sf):
    return out(signals.p_laplacian(fx.nations(spark, sf), fx.balances(spark, sf), p=1.5), "node", "value")


@query(f"{_GRAD} SELECT {rd('0.5 * sum(w * dx * dx)')} AS energy FROM g")
def dirichlet(spark, sf):
    return out(signals.dirichlet(fx.nations(spark, sf), fx.balances(spark, sf)), "energy")


for _p, _f in {"1": "sum(abs(sqrt(w) * dx))", "2": "sqrt(sum(w * dx * dx))", "inf": "max(abs(sqrt(w) * dx))", "3": "pow(sum(pow(abs(sqrt(w) * dx), 3)), 1.0 / 3)"}.items():
    query(f"{_GRAD} SELECT round({_f}, 4) AS tv FROM g", f"total_variation_{_p}")(lambda spark, sf, p=_p: signals.total_variation(fx.nations(spark, sf), fx.balances(spark, sf), p=float(p)).select(F.round("tv", 4).alias("tv")))


@query(f"{NATION} SELECT i::BIGINT AS node, {rd('sum(w * abs(p.x - q.x)) / sum(w)')} AS value FROM e JOIN x p ON p.node = i JOIN x q ON q.node = j GROUP BY i")
def local_disagreement(spark, sf):
    return out(signals.local_disagreement(fx.nations(spark, sf), fx.balances(spark, sf)), "node", "value")


@query(f"{NATION} SELECT i::BIGINT AS node, {rd('sum(w * x) / sum(w)')} AS value FROM e JOIN x ON node = j GROUP BY i")
def local_mean(spark, sf):
    return out(signals.local_mean(fx.nations(spark, sf), fx.balances(spark, sf)), "node", "value")


def _on_x(f: str) -> str:
    return f"{NATION} SELECT node::BIGINT AS node, {rd(f)} AS value FROM x"


def _x(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: out(f(fx.balances(spark, sf)), "node", "value")


_M, _D = "(SELECT median(x) FROM x)", "(SELECT sum(d * x) / sum(d) FROM d JOIN x USING (node))"
for _n, _f, _q in (
    ("centered", "x - avg(x) OVER ()", signals.centered),
    ("zscore", "(x - avg(x) OVER ()) / stddev_pop(x) OVER ()", signals.zscored),
    ("robust_zscore", f"(x - {_M}) / (1.4826 * (SELECT median(abs(x - {_M})) FROM x))", signals.robust_zscored),
    ("normalize_l1", "x / sum(abs(x)) OVER ()", lambda d: signals.scaled(d, "l1")),
    ("normalize_l2", "x / sqrt(sum(x * x) OVER ())", lambda d: signals.scaled(d, "l2")),
    ("normalize_max", "x / max(abs(x)) OVER ()", lambda d: signals.scaled(d, "max")),
    ("normalize_sum", "x / sum(x) OVER ()", lambda d: signals.scaled(d, "sum")),
    ("normalize_lp", "x / pow(sum(pow(abs(x), 3)) OVER (), 1.0 / 3)", lambda d: signals.normalized(d, 3.0)),
    ("threshold_absolute", "CASE WHEN abs(x) >= 4500 THEN x ELSE 0.0 END", lambda d: signals.thresholded(d, 4500.0)),
    ("soft_threshold", "sign(x) * greatest(abs(x) - 4000, 0.0)", lambda d: signals.soft_thresholded(d, 4000.0)),
    ("clip_signal", "least(greatest(x, 4200.0), 4800.0)", lambda d: signals.clipped(d, 4200.0, 4800.0)),
    ("minmax_scores", "(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())", signals.minmax),
    ("distribution", "greatest(x, 0.0) / sum(greatest(x, 0.0)) OVER ()", signals.distribution),
    ("softmax", "exp((x - max(x) OVER ()) / 500) / sum(exp((x - (SELECT max(x) FROM x)) / 500)) OVER ()", lambda d: signals.softmax(d, 500.0)),
    ("average_ranks", "rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2", signals.average_ranks),
):
    query(_on_x(_f), _n)(_x(_q))


@query(_on_x(f"x - {_D}"))
def centered_by_degree(spark, sf):
    return out(signals.centered(fx.balances(spark, sf), fx.nations(spark, sf)), "node", "value")


@query(f"{NATION}, k AS (SELECT *, row_number() OVER (ORDER BY abs(x) DESC, node) rank FROM x) SELECT node::BIGINT AS node, {rd('x')} AS value, rank::BIGINT AS rank FROM k WHERE rank <= 10")
def top_nodes(spark, sf):
    return out(signals.top_nodes(fx.balances(spark, sf), 10), "node", "value", "rank")


_XY = f"{NATION}, p AS (SELECT node, x.x a, y.x b FROM x JOIN y USING (node)), rr AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 rb, row_number() OVER (ORDER BY a DESC, node) ka, row_number() OVER (ORDER BY b DESC, node) kb FROM p)"
for _m, _f in {"pearson": "corr(a, b)", "spearman": "corr(ra, rb)", "cosine": "sum(a * b) / sqrt(sum(a * a) * sum(b * b))", "l2_negative": "-sqrt(sum((a - b) * (a - b)))"}.items():
    query(f"{_XY}, c AS (SELECT {rd(_f)} c FROM rr) SELECT p AS signal_a, q AS signal_b, CASE WHEN p = q THEN 1.0 ELSE c END AS value FROM c, unnest(['balance', 'supply']) t(p), unnest(['balance', 'supply']) s(q)", f"similarity_{_m}")(
        lambda spark, sf, m=_m: out(signals.similarity_matrix(fx.balances(spark, sf).union(fx.supplies(spark, sf)), m), "signal_a", "signal_b", "value")
    )


@query(f"{_XY} SELECT node::BIGINT AS node, {rd('(3 * a + b) / 4')} AS value FROM p")
def consensus(spark, sf):
    return out(signals.consensus(fx.balances(spark, sf).union(fx.supplies(spark, sf)), {"balance": 3.0, "supply": 1.0}), "node", "value")


@query(f"{_XY} SELECT node::BIGINT AS node, label, {rd('a')} AS balance, {rd('b')} AS supply FROM p JOIN v USING (node)")
def signal_table(spark, sf):
    return out(signals.wide_table(fx.nations(spark, sf), fx.balances(spark, sf).union(fx.supplies(spark, sf))), "node", "label", "balance", "supply")


# Comparison and ensembles

_CMP = "sum(abs(b - a))|sqrt(sum((b - a) * (b - a)))|max(abs(b - a))|avg(abs(b - a))|sum(b - a)|sum(a * b) / sqrt(sum(a * a) * sum(b * b))|corr(a, b)|corr(ra, rb)".split("|")
_CMP_NAMES = ["l1_delta", "l2_delta", "linf_delta", "mean_abs_delta", "signed_sum_delta", "cosine", "pearson", "spearman"]


def _state(spark, sf, signal):
    return (fx.balances if signal == "x" else fx.supplies)(spark, sf).drop("signal")


@query(f"{_XY} SELECT {', '.join(f'{rd(f)} AS {n}' for f, n in zip(_CMP, _CMP_NAMES, strict=True))}, max(node) FILTER (ka = 1)::BIGINT AS top1_before, max(node) FILTER (kb = 1)::BIGINT AS top1_after, max(node) FILTER (ka = 1) <> max(node) FILTER (kb = 1) AS top1_changed, {rd('count(*) FILTER (ka <= 10 AND kb <= 10) / 10')} AS topk_overlap, {rd('sum(CASE WHEN node < 5 THEN b - a ELSE 0 END)')} AS target_delta FROM rr")
def compare_states(spark, sf):
    t = fx.nations(spark, sf).nodes.where("node < 5").select("graph_id", "node", F.lit(1.0).alias("value"))
    return out(stats.compare_states(_state(spark, sf, "x"), _state(spark, sf, "y"), target=t), *_CMP_NAMES, "top1_before", "top1_after", "top1_changed", "topk_overlap", "target_delta")


@query(f"{_XY} SELECT {rd('count(*) FILTER (ka <= 10 AND kb <= 10) / count(*) FILTER (ka <= 10 OR kb <= 10)')} AS value FROM rr")
def jaccard_topk(spark, sf):
    return out(stats.jaccard_topk(_state(spark, sf, "x"), _state(spark, sf, "y"), 10), "value")


@query(f"{_XY} SELECT {rd('corr(ka, kb)')} AS value FROM rr")
def spearman_ordinal(spark, sf):
    return out(stats.ordinal_spearman(_state(spark, sf, "x"), _state(spark, sf, "y")), "value")


@query(f"{_XY} SELECT {rd('sum(sign(p.a - q.a) * sign(p.b - q.b)) / sum(abs(sign(p.a - q.a) * sign(p.b - q.b)))')} AS value FROM rr p JOIN rr q ON p.node < q.node")
def kendall(spark, sf):
    return out(stats.kendall(_state(spark, sf, "x"), _state(spark, sf, "y")), "value")


@query(f"{YEARS} SELECT node::BIGINT AS node, {rd('avg(x)')} AS mean, {rd('stddev_samp(x)')} AS std, {rd('quantile_cont(x, 0.025)')} AS ci_low, {rd('quantile_cont(x, 0.975)')} AS ci_high, {rd('min(x)')} AS min_score, {rd('max(x)')} AS max_score FROM s GROUP BY node")
def node_moments(spark, sf):
    return out(stats.node_moments(fx.years(spark, sf)), "node", "mean", "std", "ci_low", "ci_high", "min_score", "max_score")


@query(f"{YEARS} SELECT node::BIGINT AS node, r::BIGINT AS rank, {rd('count(*) / (SELECT count(DISTINCT trial) FROM s)')} AS probability FROM rk GROUP BY node, r")
def rank_probability(spark, sf):
    return out(stats.rank_probability(fx.years(spark, sf)), "node", "rank", "probability")


@query(f"{YEARS}, p AS (SELECT node, r, count(*) / (SELECT count(DISTINCT trial) FROM s) p FROM rk GROUP BY node, r) SELECT node::BIGINT AS node, {rd('sum(-p * log2(p))')} AS rank_entropy FROM p GROUP BY node")
def rank_entropy(spark, sf):
    return out(stats.rank_entropy(fx.years(spark, sf)), "node", "rank_entropy")


@query(f"{YEARS} SELECT node::BIGINT AS node, {rd('avg((n - r) / (n - 1))')} AS consensus_score FROM rk GROUP BY node")
def borda(spark, sf):
    return out(stats.borda(fx.years(spark, sf)), "node", "consensus_score")


@query(f"{YEARS}, b AS (SELECT node, row_number() OVER (ORDER BY x DESC, node) r0 FROM x) SELECT node::BIGINT AS node, r0::BIGINT AS rank_baseline, {rd('median(r)')} AS rank_median, {rd('avg(abs(r - r0))')} AS mean_abs_rank_shift FROM rk JOIN b USING (node) GROUP BY node, r0")
def rank_shifts(spark, sf):
    return out(stats.rank_shifts(fx.years(spark, sf), _state(spark, sf, "x")), "node", "rank_baseline", "rank_median", "mean_abs_rank_shift")


@query(f"{YEARS} SELECT node::BIGINT AS node, {rd('avg((r <= 5)::INT)')} AS probability FROM rk GROUP BY node")
def probability_topk(spark, sf):
    return out(stats.probability_topk(fx.years(spark, sf), 5), "node", "probability")


@query(f"{YEARS} SELECT node::BIGINT AS node, {rd('avg((x > 150000)::INT)')} AS probability FROM s GROUP BY node")
def probability_above(spark, sf):
    return out(stats.probability_above(fx.years(spark, sf), 150000.0), "node", "probability")


@query(f"{YEARS}, b AS (SELECT node, row_number() OVER (ORDER BY x DESC, node) r0 FROM x) SELECT trial::BIGINT AS trial, {rd('corr(r, r0)')} AS spearman FROM rk JOIN b USING (node) GROUP BY trial")
def trial_agreement(spark, sf):
    return out(stats.trial_agreement(fx.years(spark, sf), _state(spark, sf, "x")), "trial", "spearman")


@query(f"{YEARS}, c AS (SELECT p.trial a, q.trial b, corr(p.r, q.r) s FROM rk p JOIN rk q ON p.node = q.node AND p.trial < q.trial GROUP BY ALL) SELECT {rd('avg(s)')} AS mean, {rd('stddev_pop(s)')} AS std, {rd('min(s)')} AS min, {rd('max(s)')} AS max FROM c")
def pairwise_agreement(spark, sf):
    return out(stats.pairwise_agreement(fx.years(spark, sf)), "mean", "std", "min", "max")


@query()
def fragility(spark, sf):
    return out(stats.fragility(fx.years(spark, sf), _state(spark, sf, "x")), "topk_overlap", "mean_shift", "mean_cv", "mean_spearman", "fragility_index", "label")


# Traversal


@query(f"{EMBED}, e AS (SELECT i, j FROM p WHERE dist <= 1.2 UNION ALL SELECT j, i FROM p WHERE dist <= 1.2), it AS (SELECT 0 k, vec_id node, vec_id c FROM embeddings UNION ALL SELECT k + 1, node, min(c) FROM (SELECT it.k, e.i node, it.c FROM it JOIN e ON e.j = it.node WHERE it.k < 12 UNION ALL SELECT k, node, c FROM it WHERE k < 12) GROUP BY k, node) SELECT node::BIGINT AS node, c::BIGINT AS component FROM it WHERE k = 12".replace("WITH", "WITH RECURSIVE"))
def components(spark, sf):
    return out(traversal.components(fx.embeddings(spark, sf)), "node", "component")


@query(f"{EMBED}, e AS (SELECT i, j FROM p WHERE dist <= 1.2 UNION ALL SELECT j, i FROM p WHERE dist <= 1.2), it AS (SELECT 0 k, 0::BIGINT node UNION SELECT k + 1, e.j FROM it JOIN e ON e.i = it.node WHERE k < 4) SELECT node::BIGINT AS node, min(k)::DOUBLE AS value FROM it GROUP BY node".replace("WITH", "WITH RECURSIVE"))
def bfs_hops(spark, sf):
    return out(traversal.bfs_hops(fx.embeddings(spark, sf), [0], 4), "node", "value")


_MINPLUS = NATION + ", it AS (SELECT 0 k, 0 node, {start} c UNION ALL SELECT k + 1, node, {agg}(c) FROM (SELECT it.k, e.j node, {step} c FROM it JOIN e ON e.i = it.node WHERE it.k < 10 UNION ALL SELECT k, node, c FROM it WHERE k < 10) GROUP BY k, node) SELECT node::BIGINT AS node, {value} AS value FROM it WHERE k = 10"


@query(_MINPLUS.format(start="0.0::DOUBLE", agg="min", step="it.c + 1 / w", value=rd("c")))
def shortest_distance(spark, sf):
    return out(traversal.shortest_distances(fx.nations(spark, sf), [0]), "node", "value")


@query(_MINPLUS.format(start="1e300::DOUBLE", agg="max", step="least(it.c, w)", value=rd("CASE WHEN c > 1e200 THEN 0.0 ELSE c END")))
def widest_capacity(spark, sf):
    d = traversal.widest_capacity(fx.nations(spark, sf), [0])
    return out(d.withColumn("value", F.when(F.col("value") > 1e200, 0.0).otherwise(F.col("value"))), "node", "value")


@query()
def diverse_paths(spark, sf):
    return out(traversal.paths(fx.nations(spark, sf), [0, 2], [12, 20], k=6), "rank", "source", "target", "length", "cost", "weight_sum", "min_weight", "mean_weight").join(traversal.paths(fx.nations(spark, sf), [0, 2], [12, 20], k=6).select(F.col("rank").cast("long").alias("rank"), F.array_join("nodes", " ").alias("nodes")), "rank")


# Spectra: what SQL can say of eigenvalues, it says by invariants


@query(f"{NATION} SELECT {rd('(SELECT sum(d) FROM d)')} AS trace, {rd('(SELECT sum(d * d) FROM d) + (SELECT sum(w * w) FROM e)')} AS squares")
def eigenvalue_moments(spark, sf):
    m = spectral.modes(spectral.decompose(fx.nations(spark, sf)))
    return out(m.agg(F.sum("eigenvalue").alias("trace"), F.sum(F.col("eigenvalue") ** 2).alias("squares")), "trace", "squares")


@query("SELECT 24.0::DOUBLE AS total")
def foster(spark, sf):
    g = fx.nations(spark, sf)
    res = spectral.effective_resistance(g, spectral.decompose(g)).withColumnsRenamed({"i": "src", "j": "dst"})
    return out(prepare.upper_edges(g.edges).join(res, ["graph_id", "src", "dst"]).agg(F.sum(F.col("weight") * F.col("value")).alias("total")), "total")


@query(f"{NATION} SELECT node::BIGINT AS node, {rd('x')} AS value FROM x")
def fourier_round_trip(spark, sf):
    s = spectral.decompose(fx.nations(spark, sf))
    return out(spectral.synthesize(s, spectral.fourier(s, fx.balances(spark, sf))), "node", "value")


@query(f"{NATION} SELECT {rd('sum(x * x) / 1e6')} AS energy FROM x")
def parseval(spark, sf):
    s = spectral.decompose(fx.nations(spark, sf))
    return out(spectral.energy_density(s, fx.balances(spark, sf)).agg((F.sum("energy") / 1e6).alias("energy")), "energy")


def _taylor(t: float, steps: int, start: str, select: str) -> str:
    return f"{NATION}, it AS (SELECT 0 k, node, ({start}) x FROM v UNION ALL SELECT it.k + 1, lap.i, sum(-{t} * lap.m * it.x) / (it.k + 1) FROM it JOIN lap ON lap.j = it.node WHERE it.k < {steps} GROUP BY it.k + 1, lap.i) {select}"


@query(_taylor(0.1, 40, SEED, f"SELECT node::BIGINT AS node, {rd('sum(x)')} AS value FROM it GROUP BY node"))
def heat_filter(spark, sf):
    g = fx.nations(spark, sf)
    return out(spectral.filtered(spectral.decompose(g), dynamics.seeds(g), transfers.heat(F.col("eigenvalue"), 0.1)), "node", "value")


for _method in ("spectral", "chebyshev", "lanczos"):
    query(_taylor(0.1, 40, SEED, f"SELECT node::BIGINT AS node, {rd('sum(x)')} AS value FROM it GROUP BY node"), f"heat_smooth_{_method}")(lambda spark, sf, m=_method: out(spectral.heat_smooth(fx.nations(spark, sf), dynamics.seeds(fx.nations(spark, sf)), 0.1, m), "node", "value"))


@query(_taylor(0.1, 40, SEED, f"SELECT node::BIGINT AS node, {rd('sum(x)')} AS value FROM it GROUP BY node"))
def heat_smooth_joined(spark, sf):
    g = fx.nations(spark, sf)
    return out(sparse.heat_smooth_joined(g, dynamics.seeds(g), 0.1), "node", "value")


@query(_taylor(0.1, 40, SEED, f"SELECT {rd('sum(x) FILTER (node = 0)')} AS value FROM it"))
def heat_kernel_signature(spark, sf):
    return out(spectral.heat_signature(spectral.decompose(fx.nations(spark, sf)), [0.1]).where("node = 0"), "value")


_RICHARDSON = NATION + ", z AS (SELECT {a} node_count), it AS (SELECT 0 k, node, 0.0::DOUBLE x FROM v UNION ALL SELECT it.k + 1, lap.i, any_value(f.b) * {h} + sum((CASE WHEN lap.i = lap.j THEN 1.0 - {h} ELSE 0.0 END - {h} * {alpha} * lap.m) * it.x) FROM it JOIN lap ON lap.j = it.node JOIN (SELECT node, x b FROM x) f ON f.node = lap.i WHERE it.k < {steps} GROUP BY it.k + 1, lap.i) SELECT node::BIGINT AS node, {value} AS value FROM it WHERE k = {steps}"


@query(_RICHARDSON.format(a="count(*) FROM v", h="0.09", alpha="1.0", steps=300, value=rd("x")).replace("z AS (SELECT count(*) FROM v node_count)", "z AS (SELECT count(*) c FROM v)"))
def tikhonov(spark, sf):
    return out(spectral.tikhonov(fx.nations(spark, sf), fx.balances(spark, sf), 1.0), "node", "value")


@query(f"{NATION}, s AS (SELECT node < 10 s, node FROM v), f AS (SELECT coalesce(sum(w) FILTER (p.s AND NOT q.s), 0) cut, sum(w) FILTER (p.s) vi, sum(w) FILTER (NOT p.s) vo FROM e JOIN s p ON p.node = i JOIN s q ON q.node = j) SELECT {rd('cut / least(vi, vo)')} AS phi, {rd('cut')} AS cut, {rd('vi')} AS volume_in, {rd('vo')} AS volume_out FROM f")
def conductance(spark, sf):
    g = fx.nations(spark, sf)
    return out(spectral.conductance(g, g.nodes.where("node < 10")), "phi", "cut", "volume_in", "volume_out")


@query(f"{NATION}, o AS (SELECT node, row_number() OVER (ORDER BY x, node) pos FROM x), c AS (SELECT o.pos, sum(e.w) FILTER (p.pos <= o.pos AND q.pos > o.pos) cut, sum(e.w) FILTER (p.pos <= o.pos) vi, sum(e.w) vol FROM o CROSS JOIN e JOIN o p ON p.node = e.i JOIN o q ON q.node = e.j GROUP BY o.pos) SELECT pos::BIGINT AS size, {rd('cut')} AS cut, {rd('vi')} AS volume_in, {rd('cut / least(vi, vol - vi)')} AS phi FROM c WHERE pos < 25")
def sweep_cut(spark, sf):
    return out(spectral.sweep(fx.nations(spark, sf), _state(spark, sf, "x")), "size", "cut", "volume_in", "phi")


@query("SELECT k::BIGINT AS k, round(CASE WHEN k = 0 THEN 0.5 ELSE 1 END * 2 / 2048 * sum(exp(-0.3 * 5 * (cos(pi() * (j + 0.5) / 2048) + 1)) * cos(k * pi() * (j + 0.5) / 2048)), 6) + 0.0 AS coefficient FROM range(2048) a(j), range(13) b(k) GROUP BY k")
def chebyshev_coefficients(spark, sf):
    import numpy as np

    c = dynamics.chebyshev_coefficients(lambda z: np.exp(-0.3 * z), 12, 10.0)
    return out(spark.createDataFrame([(k, float(v)) for k, v in enumerate(c)], "k long, coefficient double"), "k", "coefficient")


def _spectral(f: Callable, *columns: str, digits: bool = True) -> Query:
    return lambda spark, sf: out(f(fx.nations(spark, sf), spark, sf), *columns)


for _n, _f, _c in (
    ("eigenvalues", lambda g, s, d: spectral.modes(spectral.decompose(g)), ("mode", "eigenvalue")),
    ("spectral_summary", lambda g, s, d: spectral.summary(spectral.decompose(g, "normalized")), ("modes", "trace", "algebraic_connectivity", "second_eigenvalue", "gap", "radius")),
    ("fiedler_vector", lambda g, s, d: spectral.fiedler(spectral.decompose(g)), ("mode", "eigenvalue", "node", "v")),
    ("mode_table", lambda g, s, d: spectral.mode_table(spectral.decompose(g)), ("mode", "eigenvalue", "norm", "mean", "std", "max_abs", "ipr", "participation", "entropy")),
    ("spectral_entropy", lambda g, s, d: spectral.spectral_entropy(spectral.decompose(g)), ("entropy",)),
    ("low_pass", lambda g, s, d: spectral.filtered(spectral.decompose(g), fx.balances(s, d), transfers.low_pass(F.col("eigenvalue"), 12.0, 0.5)), ("node", "value")),
    ("band_pass", lambda g, s, d: spectral.filtered(spectral.decompose(g), fx.balances(s, d), transfers.band_pass(F.col("eigenvalue"), 8.0, 14.0)), ("node", "value")),
    ("cumulative_energy", lambda g, s, d: spectral.cumulative_energy(spectral.decompose(g), fx.balances(s, d)), ("mode", "share")),
    ("energy_report", lambda g, s, d: spectral.energy_report(g, spectral.decompose(g), fx.balances(s, d)), ("l2_norm", "l1_norm", "linf_norm", "mean", "std", "total_variation", "dirichlet_energy", "spectral_entropy", "spectral_centroid", "high_frequency_ratio")),
    ("heat_trace", lambda g, s, d: spectral.heat_trace(spectral.decompose(g, "normalized"), [0.1, 1.0, 5.0]), ("time", "value")),
    ("effective_resistance", lambda g, s, d: spectral.effective_resistance(g, spectral.decompose(g)), ("i", "j", "value")),
    ("resistance_centrality", lambda g, s, d: spectral.resistance_centrality(spectral.effective_resistance(g, spectral.decompose(g))), ("node", "value")),
    ("pair_geometry", lambda g, s, d: spectral.pair_geometry(g, spectral.decompose(g), spectral.decompose(g, "normalized")), ("i", "j", "label_i", "label_j", "weight", "effective_resistance", "commute_time", "diffusion_distance")),
    ("spectral_clusters", lambda g, s, d: spectral.clusters(g, 4), ("node", "cluster", "inertia")),
    ("cheeger_cut", lambda g, s, d: spectral.cheeger(g, spectral.decompose(g)), ("size", "node", "cut", "volume_in", "phi")),
    ("wavelet_report", lambda g, s, d: spectral.wavelet_report(spectral.wavelets(spectral.decompose(g), fx.balances(s, d), [0.05, 0.1, 0.2])), ("scale", "energy", "l1", "l2", "linf", "entropy", "share")),
    ("dominant_scale", lambda g, s, d: spectral.dominant_scale(spectral.wavelets(spectral.decompose(g), fx.balances(s, d), [0.05, 0.1, 0.2])), ("node", "scale")),
    ("denoise_wavelet", lambda g, s, d: spectral.denoise_wavelet(spectral.decompose(g), fx.balances(s, d), [0.05, 0.1, 0.2]), ("node", "value")),
    ("denoise_variation", lambda g, s, d: spectral.denoise_variation(g, signals.zscored(fx.balances(s, d)), 0.1), ("node", "value")),
    ("anomaly_residual", lambda g, s, d: spectral.anomalies(g, fx.balances(s, d)), ("node", "value", "z", "flag")),
    ("anomaly_local", lambda g, s, d: spectral.anomalies(g, fx.balances(s, d), method="local"), ("node", "value", "z", "flag")),
    ("anomaly_leverage", lambda g, s, d: spectral.anomalies(g, fx.balances(s, d), method="leverage"), ("node", "value", "z", "flag")),
    ("node_features", lambda g, s, d: spectral.node_features(g, spectral.decompose(g), spectral.decompose(g, "normalized"), k=3), ("node", "label", "degree", "resistance_centrality", "hks_0", "hks_1", "hks_2")),
    ("current_flow", lambda g, s, d: flow.current_flow(g, [0, 2], [12]), ("node", "potential", "through", "resistance", "power")),
    ("bridge_flow", lambda g, s, d: flow.bridge_flow(g, [0, 2], [12]), ("node", "hitting", "visits", "absorption", "entropy_rate")),
    ("heat_corridor", lambda g, s, d: flow.heat_corridor(g, [0], [12], [0.05, 0.1]), ("node", "value")),
    ("pathway_nodes", lambda g, s, d: flow.node_scores(g, [0, 2], [12]), ("node", "current", "bridge", "heat", "geodesic", "degree", "score", "rank")),
    ("pathway_edges", lambda g, s, d: flow.edge_scores(g, [0, 2], [12]), ("i", "j", "weight", "cost", "current", "bridge", "heat", "geodesic", "score", "rank")),
    ("bottleneck_scan", lambda g, s, d: flow.bottleneck_scan(g, [0], [12]), ("node", "baseline", "value", "delta", "rank")),
    ("edge_cuts", lambda g, s, d: flow.edge_cuts(g, [0], [12]), ("i", "j", "weight", "current", "support", "score", "rank")),
    ("distance_profile", lambda g, s, d: traversal.distance_profile(g, [0], [12]), ("node", "from_sources", "to_targets", "corridor", "excess")),
):
    query(None, _n)(_spectral(_f, *_c))


# Interventions and sensitivity


def _changed(change: whatif.Intervention) -> Query:
    return lambda spark, sf: out(change.apply(fx.nations(spark, sf)).edges, "src", "dst", "weight")


for _n, _c, _f in (
    ("node_isolation", whatif.RemoveNodes((5,)), "SELECT i, j, w FROM e WHERE i <> 5 AND j <> 5"),
    ("edge_removal", whatif.RemoveEdges(((0, 1), (2, 13))), "SELECT i, j, w FROM e WHERE (least(i, j), greatest(i, j)) NOT IN ((0, 1), (2, 13))"),
    ("edge_reweight", whatif.ReweightEdge(5, 17, factor=0.1), "SELECT i, j, CASE WHEN least(i, j) = 5 AND greatest(i, j) = 17 THEN w * 0.1 ELSE w END w FROM e"),
    ("path_block", whatif.BlockPath((0, 3, 7, 12), 0.25), "SELECT i, j, CASE WHEN (least(i, j), greatest(i, j)) IN ((0, 3), (3, 7), (7, 12)) THEN w * 0.25 ELSE w END w FROM e"),
    ("threshold_below", whatif.Threshold("remove_below", 0.5), "SELECT i, j, w FROM e WHERE w >= 0.5"),
    ("threshold_above", whatif.Threshold("remove_above", 0.5), "SELECT i, j, w FROM e WHERE w <= 0.5"),
    ("threshold_top", whatif.Threshold("keep_top_fraction", 0.2), "SELECT e.i, e.j, e.w FROM e JOIN (SELECT i, j FROM u QUALIFY row_number() OVER (ORDER BY w DESC, i, j) <= ceil(0.2 * (SELECT count(*) FROM u))) k ON k.i = least(e.i, e.j) AND k.j = greatest(e.i, e.j)"),
    ("shell_mutation", whatif.MutateNode(10, 0.4, 1), "SELECT e.i, e.j, CASE WHEN least(e.i, e.j) = 10 OR greatest(e.i, e.j) = 10 OR e.i IN (SELECT j FROM e WHERE i = 10) OR e.j IN (SELECT j FROM e WHERE i = 10) THEN w * 0.4 ELSE w END w FROM e"),
    ("composite", whatif.Composite((whatif.RemoveNodes((5,)), whatif.Threshold("remove_below", 0.5))), "SELECT i, j, w FROM e WHERE i <> 5 AND j <> 5 AND w >= 0.5"),
):
    query(f"{NATION}, c AS ({_f}) SELECT i::BIGINT AS src, j::BIGINT AS dst, {rd('w')} AS weight FROM c", _n)(_changed(_c))


@query()
def ablation_scan(spark, sf):
    g = fx.nations(spark, sf)
    return out(whatif.ablation_scan(g, dynamics.seeds(g), steps=8, dt=0.02), "i", "j", "l1_delta", "l2_delta")


_ADJOINT = f"""{NATION}, mm AS ({_HEAT}),
f AS (SELECT 0 k, node, {SEED} x FROM v UNION ALL SELECT f.k + 1, mm.i, sum(mm.m * f.x) FROM f JOIN mm ON mm.j = f.node WHERE f.k < 8 GROUP BY f.k + 1, mm.i),
b AS (SELECT 0 k, node, CASE WHEN node = 12 THEN 1.0::DOUBLE ELSE 0.0 END x FROM v UNION ALL SELECT b.k + 1, mm.i, sum(mm.m * b.x) FROM b JOIN mm ON mm.j = b.node WHERE b.k < 8 GROUP BY b.k + 1, mm.i)
SELECT u.i::BIGINT AS i, u.j::BIGINT AS j, {rd('-0.02 * sum((p.x - q.x) * (r.x - s.x))')} AS derivative FROM u JOIN f p ON p.node = u.i JOIN f q ON q.node = u.j AND q.k = p.k JOIN b r ON r.node = u.i AND r.k = 7 - p.k JOIN b s ON s.node = u.j AND s.k = 7 - p.k WHERE p.k < 8 GROUP BY u.i, u.j"""


def _target(g, node: int = 12) -> DataFrame:
    return dynamics.seeds(g, [node], signal="target").drop("signal")


@query(_ADJOINT)
def edge_sensitivity(spark, sf):
    g = fx.nations(spark, sf)
    return out(whatif.edge_sensitivity(g, dynamics.seeds(g), _target(g), steps=8, dt=0.02), "i", "j", "derivative")


for _n, _f, _c in (
    ("node_sensitivity", lambda g, s, d: whatif.node_sensitivity(g, whatif.edge_sensitivity(g, dynamics.seeds(g), _target(g), steps=8, dt=0.02)), ("node", "label", "degree", "incident_abs_derivative_sum", "incident_signed_derivative_sum", "predicted_removal_delta", "max_incident_abs_derivative", "incident_edges")),
    ("global_sensitivity", lambda g, s, d: whatif.global_sensitivity(g, dynamics.seeds(g), steps=8, dt=0.02), ("i", "j", "impact", "score", "rank")),
    ("validate_top_edges", lambda g, s, d: whatif.validate_top_edges(g, dynamics.seeds(g), _target(g), k=10, steps=8, dt=0.02), ("i", "j", "predicted", "exact", "absolute_error", "relative_error", "rank_predicted", "rank_exact")),
    ("node_ablation", lambda g, s, d: whatif.ablation_scan(g, dynamics.seeds(g), kind="nodes", steps=8, dt=0.02), ("i", "l1_delta", "l2_delta", "linf_delta", "rank")),
    ("edge_ablation", lambda g, s, d: whatif.ablation_scan(g, dynamics.seeds(g), steps=8, dt=0.02), ("i", "j", "l1_delta", "l2_delta", "linf_delta", "rank")),
    ("mutation_scan", lambda g, s, d: reduce(DataFrame.union, [whatif.ablation_scan(g, dynamics.seeds(g), kind="mutations", factor=f, steps=8, dt=0.02).withColumn("factor", F.lit(f)) for f in (0.25, 0.5, 1.5)]), ("i", "factor", "l1_delta", "l2_delta", "linf_delta", "rank")),
    ("evaluate_interventions", lambda g, s, d: whatif.evaluate_many(g, {"cut": whatif.RemoveEdges(((0, 1),)), "isolate": whatif.RemoveNodes((5,))}, dynamics.seeds(g), steps=8, dt=0.02), ("scenario", "l1_delta", "l2_delta", "pearson", "topk_overlap")),
    ("monte_carlo", lambda g, s, d: stats.node_moments(montecarlo.samples(g, dynamics.seeds(g), montecarlo.LognormalNoise(0.1), n_trials=40, steps=10, dt=0.02)), ("node", "mean", "std", "ci_low", "ci_high", "min_score", "max_score")),
    ("node_uncertainty", lambda g, s, d: stats.node_summaries(montecarlo.samples(g, dynamics.seeds(g), montecarlo.EdgeDropout(0.05), n_trials=20, steps=10, dt=0.02), montecarlo.baseline(g, dynamics.seeds(g), steps=10, dt=0.02)), ("node", "baseline_score", "mean", "std", "rank_baseline", "rank_median", "rank_entropy", "consensus_score")),
    ("robustness_curve", lambda g, s, d: montecarlo.robustness_curve(g, dynamics.seeds(g), [0.05, 0.2], n_trials=10, steps=10, dt=0.02), ("strength", "n_trials", "mean_spearman_to_baseline", "topk_overlap", "mean_l2_delta", "mean_relative_graph_delta", "fragility_index")),
    ("slugs", lambda g, s, d: g.nodes.select("node", scalars.slug(F.concat(F.lit("  Nation: "), "label")).alias("slug")), ("node", "slug")),
):
    query(None, _n)(_spectral(_f, *_c))
SQL["slugs"] = "SELECT n_nationkey::BIGINT AS node, trim(regexp_replace(lower(trim('  Nation: ' || n_name)), '[^a-z0-9._-]+', '-', 'g'), '-._') AS slug FROM nation"


@query(f"""WITH st AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) previous FROM events)
SELECT date_trunc('day', ts)::TIMESTAMP AS day, previous, event_type, count(*)::DOUBLE AS weight FROM st WHERE previous IS NOT NULL GROUP BY ALL""")
def transition_windows(spark, sf):
    ev = fx.table(spark, sf, "events").withColumn("previous", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("previous is not null")
    w = transitions.windowed_transitions(ev.select("ts", "previous", "event_type"))
    return w.select(F.col("window.start").alias("day"), "previous", "event_type", "weight")


SQL |= oracles.of(NATION, YEARS, EMBED, rd)
SQL["ablation_scan"] = f"SELECT i, j, l1_delta, l2_delta FROM ({SQL['edge_ablation']})"
extras.register(query, out, rd, NATION, YEARS, SQL["diffusion"], oracles.CHEAPEST)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
