"""SQL for queries whose kernels solve, invert or take eigenvectors: the same numbers by power series and walks.

Series over the 25 nations converge long before their last term: walks on a dense graph mix by a factor of about 3 a step or more.
"""

from __future__ import annotations

from collections.abc import Callable

STEPS = 60


def walks(nodes: str = "d", edges: str = "e", steps: int = STEPS) -> str:
    """z(i, j, m): sums of P^k D^-1 up to a constant, which differences take out: a generalised inverse of the Laplacian."""
    return f"""zk AS (SELECT 0 k, a.node i, b.node j, CASE WHEN a.node = b.node THEN 1 / a.d ELSE 0.0 END m FROM {nodes} a CROSS JOIN {nodes} b
UNION ALL SELECT zk.k + 1, s.i, zk.j, sum(s.w / o.d * zk.m) FROM zk JOIN {edges} s ON s.j = zk.i JOIN {nodes} o ON o.node = s.i WHERE zk.k < {steps} GROUP BY zk.k + 1, s.i, zk.j),
z AS (SELECT i, j, sum(m) m FROM zk GROUP BY i, j)"""


RESISTANCE = walks() + ", res AS (SELECT p.i, q.i j, p.m + q.m - 2 * c.m r FROM z p JOIN z q ON p.i < q.i AND p.i = p.j AND q.i = q.j JOIN z c ON c.i = p.i AND c.j = q.i)"

#: n^k / k! times s^k of the normalised adjacency: nk(k, i, j, m)
NORMALISED = """nk AS (SELECT 0 k, a.node i, b.node j, CASE WHEN a.node = b.node THEN 1.0::DOUBLE ELSE 0.0 END m FROM v a CROSS JOIN v b
UNION ALL SELECT nk.k + 1, e.i, nk.j, sum(e.w / sqrt(p.d * q.d) * nk.m) FROM nk JOIN e ON e.j = nk.i JOIN d p ON p.node = e.i JOIN d q ON q.node = e.j WHERE nk.k < 60 GROUP BY nk.k + 1, e.i, nk.j)"""


def share(k: str, s: str) -> str:
    """exp(-s) s^k / k!"""
    return f"exp({k} * ln({s}) - lgamma({k} + 1) - {s})"


FLOW = walks() + """, b AS (SELECT node, CASE WHEN node IN (0, 2) THEN 0.5::DOUBLE WHEN node = 12 THEN -1.0 ELSE 0.0 END b FROM v),
f0 AS (SELECT z.i node, sum(z.m * b.b) f FROM z JOIN b ON b.node = z.j GROUP BY z.i), f AS (SELECT node, f - avg(f) OVER () f FROM f0),
dr AS (SELECT e.i, e.j, e.w, abs(p.f - q.f) drop FROM e JOIN f p ON p.node = e.i JOIN f q ON q.node = e.j)"""

#: Walks by weight times exp(-1 / weight) that end in node 12: pb(i, j, m) before that, vis(node, x) their visits from 0 and 2.
BRIDGE = """pb AS (SELECT i, j, w * exp(-1 / w) / sum(w * exp(-1 / w)) OVER (PARTITION BY i) m FROM e),
vk AS (SELECT 0 k, node, CASE WHEN node IN (0, 2) THEN 0.5::DOUBLE ELSE 0.0 END x FROM v UNION ALL SELECT vk.k + 1, pb.j, sum(vk.x * pb.m) FROM vk JOIN pb ON pb.i = vk.node AND pb.j <> 12 AND pb.i <> 12 WHERE vk.k < 4000 GROUP BY vk.k + 1, pb.j),
vis AS (SELECT node, sum(x) x FROM vk GROUP BY node), ent AS (SELECT i node, -sum(m * ln(m)) h FROM pb WHERE i <> 12 GROUP BY i)"""

CORRIDOR = """hk AS (SELECT 0 k, s.node s, v.node, CASE WHEN s.node = v.node THEN 1.0::DOUBLE ELSE 0.0 END x FROM (SELECT 0 node UNION ALL SELECT 12) s CROSS JOIN v
UNION ALL SELECT hk.k + 1, hk.s, lap.i, sum(-lap.m * hk.x) / (hk.k + 1) FROM hk JOIN lap ON lap.j = hk.node WHERE hk.k < 60 GROUP BY hk.k + 1, hk.s, lap.i),
h AS (SELECT t, s, node, greatest(sum(x * pow(t, k)), 0) x FROM hk, (SELECT unnest([0.05, 0.1]) t) GROUP BY t, s, node)"""


#: Mexican-hat wavelets z exp(-z) and the low-pass channel (scale 0) of the balances: wv(s, node, c).
WAVELET = """lx AS (SELECT 0 k, node, x FROM x UNION ALL SELECT lx.k + 1, lap.i, sum(-lap.m * lx.x) / (lx.k + 1) FROM lx JOIN lap ON lap.j = lx.node WHERE lx.k < 70 GROUP BY lx.k + 1, lap.i),
wv AS (SELECT s, node, sum(CASE WHEN s = 0 THEN x * pow(0.2, k) ELSE -k * x * pow(s, k) END) c FROM lx, (SELECT unnest([0.0, 0.05, 0.1, 0.2]) s) GROUP BY s, node)"""


def scenarios(pairs: str) -> str:
    """dl(s, node, x): what diffusion of 8 steps ends with under each scenario's edges sc(s, i, j, w), less the graph's own end (s = -1 there)."""
    return f"""sc AS ({pairs} UNION ALL SELECT -1, i, j, w FROM e), ss AS (SELECT DISTINCT s FROM sc),
sd AS (SELECT ss.s, v.node, coalesce(sum(sc.w), 0) d FROM ss CROSS JOIN v LEFT JOIN sc ON sc.s = ss.s AND sc.i = v.node GROUP BY ALL),
sm AS (SELECT s, i, j, 0.02 * w m FROM sc UNION ALL SELECT s, node, node, 1 - 0.02 * d FROM sd),
sx AS (SELECT 0 k, s, node, CASE WHEN node = 0 THEN 1.0::DOUBLE ELSE 0.0 END x FROM ss CROSS JOIN v UNION ALL SELECT sx.k + 1, sx.s, sm.i, sum(sm.m * sx.x) FROM sx JOIN sm ON sm.s = sx.s AND sm.j = sx.node WHERE sx.k < 8 GROUP BY sx.k + 1, sx.s, sm.i),
en AS (SELECT s, node, x FROM sx WHERE k = 8), dl AS (SELECT a.s, a.node, a.x - b.x x FROM en a JOIN en b ON b.s = -1 AND b.node = a.node WHERE a.s >= 0),
sz AS (SELECT s, sum(abs(x)) l1, sqrt(sum(x * x)) l2, max(abs(x)) linf FROM dl GROUP BY s)"""


#: Forward and backward states of diffusion, and each edge's derivative: de(i, j, w, g).
ADJOINT = """mm AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END - 0.02 * m m FROM lap),
fw AS (SELECT 0 k, node, CASE WHEN node = 0 THEN 1.0::DOUBLE ELSE 0.0 END x FROM v UNION ALL SELECT fw.k + 1, mm.i, sum(mm.m * fw.x) FROM fw JOIN mm ON mm.j = fw.node WHERE fw.k < 8 GROUP BY fw.k + 1, mm.i),
bw AS (SELECT 0 k, node, CASE WHEN node = 12 THEN 1.0::DOUBLE ELSE 0.0 END x FROM v UNION ALL SELECT bw.k + 1, mm.i, sum(mm.m * bw.x) FROM bw JOIN mm ON mm.j = bw.node WHERE bw.k < 8 GROUP BY bw.k + 1, mm.i),
de AS (SELECT u.i, u.j, u.w, -0.02 * sum((p.x - q.x) * (r.x - s.x)) g FROM u JOIN fw p ON p.node = u.i JOIN fw q ON q.node = u.j AND q.k = p.k JOIN bw r ON r.node = u.i AND r.k = 7 - p.k JOIN bw s ON s.node = u.j AND s.k = 7 - p.k WHERE p.k < 8 GROUP BY u.i, u.j, u.w)"""

#: Cheapest distances from a node by 1 / weight: p0(node, c) from 0 and p12 from 12.
CHEAPEST = ", ".join(
    f"q{t} AS (SELECT 0 k, {t} node, 0.0::DOUBLE c UNION ALL SELECT k + 1, node, min(c) FROM (SELECT q.k, e.j node, q.c + 1 / w c FROM q{t} q JOIN e ON e.i = q.node WHERE q.k < 10 UNION ALL SELECT k, node, c FROM q{t} WHERE k < 10) GROUP BY k, node), p{t} AS (SELECT node, c FROM q{t} WHERE k = 10)"
    for t in (0, 12)
)


def of(nation: str, years: str, embed: str, rd: Callable[[str], str]) -> dict[str, str]:
    """SQL by query. nation, years, embed: WITH clauses of the fixtures; rd rounds."""
    size = f"{rd('l1')} AS l1_delta, {rd('l2')} AS l2_delta, {rd('linf')} AS linf_delta"
    edge_cut = "SELECT u.i * 100 + u.j s, e.i, e.j, e.w FROM u JOIN e ON NOT (least(e.i, e.j) = u.i AND greatest(e.i, e.j) = u.j)"
    mutated = "SELECT v.node * 10 + f.k s, e.i, e.j, CASE WHEN e.i = v.node OR e.j = v.node OR p.i IS NOT NULL OR q.i IS NOT NULL THEN e.w * f.f ELSE e.w END w FROM v CROSS JOIN (VALUES (0, 0.25::DOUBLE), (1, 0.5), (2, 1.5)) f(k, f) CROSS JOIN e LEFT JOIN e p ON p.i = v.node AND p.j = e.i LEFT JOIN e q ON q.i = v.node AND q.j = e.j"
    return {
        "effective_resistance": f"{nation}, {RESISTANCE} SELECT i::BIGINT AS i, j::BIGINT AS j, {rd('r')} AS value FROM res",
        "resistance_centrality": f"{nation}, {RESISTANCE} SELECT node::BIGINT AS node, {rd('sum(1 / r)')} AS value FROM (SELECT i node, r FROM res UNION ALL SELECT j, r FROM res) GROUP BY node",
        "pair_geometry": f"""{nation}, {RESISTANCE}, {NORMALISED}, hh AS (SELECT i, j, sum({share('k', '2.0')} * m) m FROM nk GROUP BY i, j)
SELECT u.i::BIGINT AS i, u.j::BIGINT AS j, a.label AS label_i, b.label AS label_j, {rd('w')} AS weight, {rd('r')} AS effective_resistance, {rd('r * (SELECT sum(d) FROM d)')} AS commute_time, {rd('sqrt(x.m + y.m - 2 * c.m)')} AS diffusion_distance
FROM u JOIN res USING (i, j) JOIN v a ON a.node = u.i JOIN v b ON b.node = u.j JOIN hh x ON x.i = u.i AND x.j = u.i JOIN hh y ON y.i = u.j AND y.j = u.j JOIN hh c ON c.i = u.i AND c.j = u.j""",
        "heat_trace": f"{nation}, {NORMALISED} SELECT t::DOUBLE AS time, {rd('sum(' + share('k', 't') + ' * m)')} AS value FROM nk, (SELECT unnest([0.1, 1.0, 5.0]) t) WHERE i = j GROUP BY t",
        "current_flow": f"{nation}, {FLOW} SELECT f.node::BIGINT AS node, {rd('f')} AS potential, {rd('thr')} AS through, {rd('(SELECT sum(b * f) FROM b JOIN f USING (node))')} AS resistance, {rd('(SELECT sum(w * drop * drop) / 2 FROM dr)')} AS power FROM f JOIN (SELECT i node, sum(w * drop) / 2 thr FROM dr GROUP BY i) USING (node)",
        "bridge_flow": f"{nation}, {BRIDGE} SELECT v.node::BIGINT AS node, 1.0::DOUBLE AS hitting, {rd('coalesce(vis.x, 0.0)')} AS visits, 1.0::DOUBLE AS absorption, {rd('(SELECT sum(x * h) / sum(x) FROM vis JOIN ent USING (node))')} AS entropy_rate FROM v LEFT JOIN vis USING (node)",
        "heat_corridor": f"{nation}, {CORRIDOR} SELECT a.node::BIGINT AS node, {rd('avg(sqrt(a.x * b.x))')} AS value FROM h a JOIN h b ON a.t = b.t AND a.node = b.node AND a.s = 0 AND b.s = 12 GROUP BY a.node",
        "bottleneck_scan": f"""{nation}, cs AS (SELECT node c FROM v WHERE node NOT IN (0, 12)), ce AS (SELECT c, i, j, w FROM cs JOIN e ON i <> c AND j <> c UNION ALL SELECT -1, i, j, w FROM e),
cd AS (SELECT c, i node, sum(w) d FROM ce GROUP BY c, i), ck AS (SELECT 0 k, c, node, CASE WHEN node = 0 THEN 1 / d WHEN node = 12 THEN -1 / d ELSE 0.0 END x FROM cd
UNION ALL SELECT ck.k + 1, ck.c, ce.i, sum(ce.w / cd.d * ck.x) FROM ck JOIN ce ON ce.c = ck.c AND ce.j = ck.node JOIN cd ON cd.c = ce.c AND cd.node = ce.i WHERE ck.k < {STEPS} GROUP BY ck.k + 1, ck.c, ce.i),
rs AS (SELECT c, sum(CASE WHEN node = 0 THEN x WHEN node = 12 THEN -x ELSE 0 END) r FROM ck GROUP BY c), dd AS (SELECT c, b.r b, a.r, a.r - b.r delta FROM rs a CROSS JOIN (SELECT r FROM rs WHERE c = -1) b WHERE c >= 0)
SELECT c::BIGINT AS node, {rd('b')} AS baseline, {rd('r')} AS value, {rd('delta')} AS delta, row_number() OVER (ORDER BY delta DESC, c)::BIGINT AS rank FROM dd""",
        "node_ablation": f"{nation}, {scenarios('SELECT v.node s, e.i, e.j, e.w FROM v JOIN e ON e.i <> v.node AND e.j <> v.node')} SELECT s::BIGINT AS i, {size}, row_number() OVER (ORDER BY round(l2, 12) DESC, s)::BIGINT AS rank FROM sz",
        "edge_ablation": f"{nation}, {scenarios(edge_cut)} SELECT (s // 100)::BIGINT AS i, (s % 100)::BIGINT AS j, {size}, row_number() OVER (ORDER BY round(l2, 12) DESC, s)::BIGINT AS rank FROM sz",
        "mutation_scan": f"{nation}, {scenarios(mutated)} SELECT (s // 10)::BIGINT AS i, CASE s % 10 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.5 ELSE 1.5 END AS factor, {size}, row_number() OVER (PARTITION BY s % 10 ORDER BY round(l2, 12) DESC, s)::BIGINT AS rank FROM sz",
        "evaluate_interventions": f"""{nation}, {scenarios("SELECT 0 s, i, j, w FROM e WHERE NOT (least(i, j) = 0 AND greatest(i, j) = 1) UNION ALL SELECT 1, i, j, w FROM e WHERE i <> 5 AND j <> 5")},
rr AS (SELECT s, node, x, row_number() OVER (PARTITION BY s ORDER BY x DESC, node) r FROM en)
SELECT CASE a.s WHEN 0 THEN 'cut' ELSE 'isolate' END AS scenario, {rd('any_value(sz.l1)')} AS l1_delta, {rd('any_value(sz.l2)')} AS l2_delta, {rd('corr(a.x, b.x)')} AS pearson, {rd('count(*) FILTER (a.r <= 10 AND b.r <= 10) / 10')} AS topk_overlap FROM rr a JOIN rr b ON b.s = -1 AND b.node = a.node JOIN sz ON sz.s = a.s GROUP BY a.s""",
        "node_sensitivity": f"""{nation}, {ADJOINT}, en AS (SELECT i node, w, g FROM de UNION ALL SELECT j, w, g FROM de)
SELECT v.node::BIGINT AS node, label, {rd('any_value(d.d)')} AS degree, {rd('sum(abs(g))')} AS incident_abs_derivative_sum, {rd('sum(g)')} AS incident_signed_derivative_sum, {rd('sum(-w * g)')} AS predicted_removal_delta, {rd('max(abs(g))')} AS max_incident_abs_derivative, count(*)::BIGINT AS incident_edges FROM v JOIN d USING (node) JOIN en USING (node) GROUP BY v.node, label""",
        "global_sensitivity": f"""{nation}, {ADJOINT}, tg AS (SELECT 0 k, u.i a, u.j b, v.node, 0.0::DOUBLE x FROM u CROSS JOIN v
UNION ALL SELECT tg.k + 1, tg.a, tg.b, mm.i, sum(mm.m * tg.x) + any_value(CASE WHEN mm.i = tg.a THEN -0.02 * (p.x - q.x) WHEN mm.i = tg.b THEN 0.02 * (p.x - q.x) ELSE 0.0 END) FROM tg JOIN mm ON mm.j = tg.node JOIN fw p ON p.node = tg.a AND p.k = tg.k JOIN fw q ON q.node = tg.b AND q.k = tg.k WHERE tg.k < 8 GROUP BY tg.k + 1, tg.a, tg.b, mm.i),
im AS (SELECT a i, b j, sqrt(sum(x * x)) x FROM tg WHERE k = 8 GROUP BY a, b) SELECT i::BIGINT AS i, j::BIGINT AS j, {rd('x')} AS impact, {rd('w * x')} AS score, row_number() OVER (ORDER BY w * x DESC, i, j)::BIGINT AS rank FROM im JOIN u USING (i, j)""",
        "validate_top_edges": f"""{nation}, {ADJOINT}, tp AS (SELECT *, row_number() OVER (ORDER BY abs(w * g) DESC, i, j) rp FROM de QUALIFY rp <= 10), {scenarios('SELECT tp.rp s, e.i, e.j, e.w FROM tp JOIN e ON NOT (least(e.i, e.j) = tp.i AND greatest(e.i, e.j) = tp.j)')}
SELECT i::BIGINT AS i, j::BIGINT AS j, {rd('-w * g')} AS predicted, {rd('x')} AS exact, {rd('abs(-w * g - x)')} AS absolute_error, {rd('abs(-w * g - x) / (abs(x) + 1e-12)')} AS relative_error, rp::BIGINT AS rank_predicted, row_number() OVER (ORDER BY abs(x) DESC, i, j)::BIGINT AS rank_exact FROM tp JOIN dl ON dl.s = rp AND dl.node = 12""",
        "distance_profile": f"{nation}, {CHEAPEST} SELECT p0.node::BIGINT AS node, {rd('p0.c')} AS from_sources, {rd('p12.c')} AS to_targets, {rd('p0.c + p12.c')} AS corridor, {rd('p0.c + p12.c - min(p0.c + p12.c) OVER ()')} AS excess FROM p0 JOIN p12 USING (node)",
        "edge_cuts": f"""{nation}, {FLOW.replace('node IN (0, 2) THEN 0.5::DOUBLE', 'node = 0 THEN 1.0::DOUBLE')}, tr AS (SELECT a.i, b.j, count(*) n FROM e a JOIN e b ON a.j = b.i WHERE a.i < b.j GROUP BY ALL), sc AS (SELECT dr.i, dr.j, w, w * drop cur, coalesce(n, 0) n, w * drop / (1 + coalesce(n, 0)) s FROM dr LEFT JOIN tr USING (i, j) WHERE dr.i < dr.j)
SELECT i::BIGINT AS i, j::BIGINT AS j, {rd('w')} AS weight, {rd('cur')} AS current, n::BIGINT AS support, {rd('s')} AS score, row_number() OVER (ORDER BY s DESC, i, j)::BIGINT AS rank FROM sc QUALIFY rank <= 10""",
        "wavelet_report": f"""{nation}, {WAVELET}, q AS (SELECT s, sum(c * c) e, sum(abs(c)) l1, max(abs(c)) linf, sum(abs(c) * ln(abs(c))) vl, count(*) n FROM wv GROUP BY s)
SELECT s::DOUBLE AS scale, {rd('e')} AS energy, {rd('l1')} AS l1, {rd('sqrt(e)')} AS l2, {rd('linf')} AS linf, {rd('(ln(l1) - vl / l1) / ln(n)')} AS entropy, {rd('e / sum(e) OVER ()')} AS share FROM q""",
        "dominant_scale": f"{nation}, {WAVELET} SELECT node::BIGINT AS node, s::DOUBLE AS scale FROM wv QUALIFY row_number() OVER (PARTITION BY node ORDER BY abs(c) DESC, s) = 1",
        "fragility": f"""{years}, b AS (SELECT node, row_number() OVER (ORDER BY x DESC, node) r0 FROM x), bo AS (SELECT node, avg((n - r) / (n - 1)) s FROM rk GROUP BY node), bk AS (SELECT node, row_number() OVER (ORDER BY s DESC, node) rb FROM bo),
q AS (SELECT (SELECT count(*) FROM b JOIN bk USING (node) WHERE r0 <= 10 AND rb <= 10) / 10 AS o, (SELECT avg(m) FROM (SELECT avg(abs(r - r0)) m FROM rk JOIN b USING (node) GROUP BY node)) AS sh, (SELECT avg(least(c, 2.0)) FROM (SELECT stddev_pop(x) / (abs(avg(x)) + 1e-12) c FROM s GROUP BY node)) AS cv, (SELECT avg(c) FROM (SELECT corr(r, r0) c FROM rk JOIN b USING (node) GROUP BY trial)) AS rho, (SELECT count(*) FROM v) AS n),
f AS (SELECT *, least(greatest(0.35 * (1 - o) + 0.25 * least(1.0, sh / greatest(1.0, n / 2)) + 0.2 * cv / 2 + 0.2 * (1 - rho) / 2, 0), 1) f FROM q)
SELECT {rd('o')} AS topk_overlap, {rd('sh')} AS mean_shift, {rd('cv')} AS mean_cv, {rd('rho')} AS mean_spearman, {rd('f')} AS fragility_index, CASE WHEN f < 0.2 THEN 'robust' WHEN f < 0.4 THEN 'mostly_robust' WHEN f < 0.65 THEN 'sensitive' ELSE 'fragile' END AS label FROM f""",
        "anomaly_local": f"""{nation}, sc AS (SELECT i node, sum(w * abs(p.x - q.x)) / sum(w) s FROM e JOIN x p ON p.node = i JOIN x q ON q.node = j GROUP BY i), m AS (SELECT median(s) m FROM sc), zz AS (SELECT node, s, (s - m) / (1.4826 * (SELECT median(abs(s - m)) FROM sc, m)) z FROM sc, m)
SELECT node::BIGINT AS node, {rd('s')} AS value, {rd('z')} AS z, z >= 3 AS flag FROM zz""",
        "anomaly_residual": f"""{nation}, it AS (SELECT 0 k, node, 0.0::DOUBLE y FROM v UNION ALL SELECT it.k + 1, lap.i, any_value(x.x) * 0.09 + sum((CASE WHEN lap.i = lap.j THEN 0.91 ELSE 0.0 END - 0.09 * lap.m) * it.y) FROM it JOIN lap ON lap.j = it.node JOIN x ON x.node = lap.i WHERE it.k < 600 GROUP BY it.k + 1, lap.i),
sc AS (SELECT node, x - y s FROM it JOIN x USING (node) WHERE k = 600), m AS (SELECT median(s) m FROM sc), zz AS (SELECT node, s, (s - m) / (1.4826 * (SELECT median(abs(s - m)) FROM sc, m)) z FROM sc, m) SELECT node::BIGINT AS node, {rd('s')} AS value, {rd('z')} AS z, abs(z) >= 3 AS flag FROM zz""",
    }
