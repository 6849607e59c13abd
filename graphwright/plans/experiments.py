"""Experiments: a JSON (or YAML) file of one graph and a DAG of tasks becomes a folder of artifacts with provenance and reports."""

from __future__ import annotations

import hashlib
import os
import platform
import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import media_type, parse_bool, plain, sha256_file, slugify, stable_json, utc_now
from ..graph import Graph, GraphError
from ..operators import dynamics, flow, matrices, montecarlo, spectral, stats, whatif
from ..sources import readers, writers
from .script import run_script

EVENTS_KEPT = 10_000


class ConfigError(ValueError):
    """All faults of a configuration together."""


@dataclass
class TaskSpec:
    name: str
    kind: str
    params: dict = field(default_factory=dict)
    enabled: bool = True
    depends_on: list[str] = field(default_factory=list)
    allow_failure: bool = False

    @staticmethod
    def of(data: dict, index: int) -> TaskSpec:
        return TaskSpec(str(data.get("name") or f"task_{index + 1}"), str(data.get("kind", "")).strip().lower(), dict(data.get("params") or {}), parse_bool(data.get("enabled"), True), [str(d) for d in data.get("depends_on") or []], parse_bool(data.get("allow_failure"), False))


@dataclass
class Config:
    name: str
    graph: dict
    tasks: list[TaskSpec]
    description: str = ""
    output_dir: str = "runs"
    tags: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    strict: bool = False
    fail_fast: bool = False
    base: str | None = None

    @staticmethod
    def of(data: dict, base: str | None = None) -> Config:
        data = substituted(data, data.get("variables") or {})
        graph = {"kind": "synthetic", **(data.get("graph") or {})}
        return Config(
            str(data.get("name", "experiment")), graph, [TaskSpec.of(t, i) for i, t in enumerate(data.get("tasks") or [])], str(data.get("description", "")), str(data.get("output_dir", "runs")),
            [str(t) for t in data.get("tags") or []], dict(data.get("metadata") or {}), parse_bool(data.get("strict")), parse_bool(data.get("fail_fast")), base,
        )

    @staticmethod
    def load(path: str) -> Config:
        with open(path) as f:
            text = f.read()
        if os.path.splitext(path)[1].lower() in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError as e:
                raise ConfigError("YAML needs PyYAML") from e
            data = yaml.safe_load(text)
        else:
            import json

            data = json.loads(text)
        if not isinstance(data, dict):
            raise ConfigError("the configuration must be a mapping")
        return Config.of(data, os.path.dirname(os.path.abspath(path)))

    def as_dict(self) -> dict:
        return plain({k: v if k != "tasks" else [t.__dict__ for t in v] for k, v in self.__dict__.items() if k != "base"})

    def content_hash(self) -> str:
        return hashlib.sha256(stable_json(self.as_dict()).encode()).hexdigest()

    def validate(self) -> Config:
        faults, names = [], [t.name for t in self.tasks]
        if not self.tasks:
            faults.append("there are no tasks")
        faults += [f"{n} is the name of more than one task" for n in sorted({n for n in names if names.count(n) > 1})]
        if self.graph.get("kind") not in readers.LOADERS:
            faults.append(f"unknown source of graphs {self.graph.get('kind')!r}")
        for t in self.tasks:
            if t.kind not in TASKS:
                faults.append(f"{t.name}: unknown kind {t.kind!r}")
            faults += [f"{t.name}: depends on {d}, which isn't a task" for d in t.depends_on if d not in names]
        try:
            self.order()
        except ConfigError as e:
            faults.append(str(e))
        if faults:
            raise ConfigError("; ".join(faults))
        return self

    def order(self) -> list[TaskSpec]:
        """Each task after those it depends on."""
        by, state, out = {t.name: t for t in self.tasks}, {}, []

        def visit(t: TaskSpec, trail: tuple[str, ...]) -> None:
            if state.get(t.name) == 1:
                raise ConfigError("tasks depend on each other: " + " -> ".join([*trail, t.name]))
            if state.get(t.name) != 2:
                state[t.name] = 1
                for d in t.depends_on:
                    if d in by:
                        visit(by[d], (*trail, t.name))
                state[t.name] = 2
                out.append(t)

        for t in self.tasks:
            visit(t, ())
        return out


def substituted(x: object, variables: dict) -> object:
    """${name} in strings stands for a variable; a string that is only one takes its type."""
    if isinstance(x, dict):
        return {k: v if k == "variables" else substituted(v, variables) for k, v in x.items()}
    if isinstance(x, list):
        return [substituted(v, variables) for v in x]
    if isinstance(x, str):
        for k, v in variables.items():
            if x == f"${{{k}}}":
                return v
            x = x.replace(f"${{{k}}}", str(v))
    return x


class Context:
    """What a task may use, and where it writes."""

    def __init__(self, spark: SparkSession, config: Config, graph: Graph, folder: str):
        self.spark, self.config, self.graph, self.folder = spark, config, graph, folder
        self.artifacts: list[dict] = []
        self.events: list[dict] = []
        self.results: dict[str, dict] = {}

    def note(self, event: str, **more) -> None:
        self.events.append({"time": utc_now(), "event": event, **more})

    def task_dir(self, task: TaskSpec) -> str:
        path = os.path.join(self.folder, "tasks", slugify(task.name))
        os.makedirs(path, exist_ok=True)
        return path

    def register(self, path: str, task: str | None = None) -> None:
        self.artifacts.append({"path": os.path.relpath(path, self.folder), "task": task, "bytes": os.path.getsize(path), "sha256": sha256_file(path), "media_type": media_type(path)})

    def frame(self, df: DataFrame, task: TaskSpec, name: str, order: list | None = None) -> DataFrame:
        path = os.path.join(self.task_dir(task), f"{name}.csv")
        writers.frame_csv(df, path, order=order)
        self.register(path, task.name)
        return df

    def seed(self, params: dict, signal: str = "seed") -> DataFrame:
        nodes = [self.graph.resolve(x) for x in params.get("seed_nodes", params.get("seeds", [0]))]
        return dynamics.seeds(self.graph, nodes, strengths=params.get("strengths"), strength=float(params.get("strength", 1.0)), accumulate=True, skip_outside=False, signal=signal)

    def target(self, params: dict) -> DataFrame:
        nodes = params.get("target_nodes")
        if nodes is None:
            return self.graph.nodes.select("graph_id", "node", F.lit(1.0).alias("value"))
        return dynamics.seeds(self.graph, [self.graph.resolve(x) for x in nodes], strengths=params.get("target_weights"), accumulate=True, skip_outside=False, signal="target").drop("signal")


def dynamics_of(p: dict) -> dict:
    return {"model": str(p.get("model", "diffusion")), "steps": int(p.get("steps", 60)), "dt": float(p.get("dt", 0.03))}


TASKS: dict[str, Callable[[Context, TaskSpec], dict]] = {}


def task(*names: str) -> Callable:
    """Registers a task under its names; it takes (context, spec) and returns metrics."""

    def add(f: Callable[[Context, TaskSpec], dict]) -> Callable:
        for n in names:
            TASKS[n] = f
        return f

    return add


def task_kinds() -> list[str]:
    """Names that a task's kind may have."""
    return sorted(TASKS)


def vector_metrics(df: DataFrame) -> dict:
    v = F.col("value")
    return df.agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(F.abs(v)).alias("l1"), F.sqrt(F.sum(v * v)).alias("l2")).first().asDict()


@task("diffusion", "forward")
def run_diffusion(c: Context, t: TaskSpec) -> dict:
    x = dynamics.run(c.graph, c.seed(t.params), **dynamics_of(t.params)).join(c.graph.nodes, ["graph_id", "node"])
    return vector_metrics(c.frame(x.select("node", "value", "label"), t, "state", ["node"]))


@task("scan")
def run_scan(c: Context, t: TaskSpec) -> dict:
    x = dynamics.scan(c.graph, **dynamics_of(t.params)).select("node", F.col("score").alias("value"))
    return vector_metrics(c.frame(x, t, "scan", ["node"]))


@task("inverse")
def run_inverse(c: Context, t: TaskSpec) -> dict:
    observed = dynamics.run(c.graph, c.seed(t.params), **dynamics_of(t.params)) if "observed" not in t.params else readers.signal_from_csv(c.graph, c.spark, t.params["observed"])
    return vector_metrics(c.frame(dynamics.inverse(observed).select("node", "value"), t, "scores", ["node"]))


@task("mediation")
def run_mediation(c: Context, t: TaskSpec) -> dict:
    return vector_metrics(c.frame(dynamics.mediation(c.graph).select("node", F.col("score").cast("double").alias("value")), t, "degree", ["node"]))


@task("spectral")
def run_spectral(c: Context, t: TaskSpec) -> dict:
    s = spectral.decompose(c.graph, str(t.params.get("laplacian_kind", "normalized")))
    c.frame(spectral.modes(s).select("mode", "eigenvalue"), t, "spectrum", ["mode"])
    c.frame(spectral.node_features(c.graph, spectral.decompose(c.graph), s, k=int(t.params.get("modes", 10))), t, "node_features", ["node"])
    return spectral.summary(s).first().asDict()


@task("gsp", "graph_signal_processing")
def run_signal(c: Context, t: TaskSpec) -> dict:
    x, s = c.seed(t.params), spectral.decompose(c.graph)
    w = spectral.wavelets(s, x, t.params.get("scales") or spectral.default_scales(s))
    c.frame(spectral.wavelet_report(w).drop("graph_id"), t, "multiscale", ["scale"])
    c.frame(spectral.anomalies(c.graph, x).drop("graph_id"), t, "anomalies", ["node"])
    return spectral.energy_report(c.graph, s, x).first().asDict()


@task("counterfactual")
def run_counterfactual(c: Context, t: TaskSpec) -> dict:
    x, y, d = c.seed(t.params), c.target(t.params), dynamics_of(t.params)
    changes = whatif.from_config(t.params.get("interventions") or [])
    if changes:
        c.frame(whatif.evaluate_many(c.graph, {f"{i}_{type(k).__name__}": k for i, k in enumerate(changes)}, x, target=y, **d), t, "evaluations", ["scenario"])
    edges = whatif.edge_sensitivity(c.graph, x, y, steps=d["steps"], dt=d["dt"])
    c.frame(edges.drop("graph_id"), t, "edge_sensitivity", [F.desc("score"), "i", "j"])
    c.frame(whatif.node_sensitivity(c.graph, edges).drop("graph_id"), t, "node_sensitivity", [F.desc(F.abs("predicted_removal_delta")), "node"])
    if parse_bool(t.params.get("ablation"), True):
        c.frame(whatif.ablation_scan(c.graph, x, max_edges=int(t.params.get("max_edges", 50)), steps=d["steps"], dt=d["dt"]).drop("graph_id"), t, "ablation", ["rank"])
    return edges.agg(F.count("*").alias("edges"), F.max("absolute_derivative").alias("largest_derivative")).first().asDict()


@task("robustness")
def run_robustness(c: Context, t: TaskSpec) -> dict:
    x, d, p = c.seed(t.params), dynamics_of(t.params), t.params
    s = montecarlo.samples(c.graph, x, montecarlo.noise(str(p.get("noise", "lognormal")), float(p.get("strength", 0.05))), n_trials=int(p.get("n_trials", 50)), seed=int(p.get("seed", 0)), **d)
    base = montecarlo.baseline(c.graph, x, **d)
    c.frame(stats.node_summaries(s, base).drop("graph_id"), t, "node_uncertainty", [F.desc("consensus_score"), "node"])
    return stats.fragility(s, base).first().asDict()


@task("pathway")
def run_pathway(c: Context, t: TaskSpec) -> dict:
    s, g = [c.graph.resolve(x) for x in t.params["sources"]], [c.graph.resolve(x) for x in t.params["targets"]]
    nodes, edges = flow.node_scores(c.graph, s, g), flow.edge_scores(c.graph, s, g)
    c.frame(nodes.drop("graph_id"), t, "nodes", ["rank"])
    c.frame(edges.drop("graph_id"), t, "edges", ["rank"])
    return {"top_node": nodes.where("rank = 1").first().node}


@task("script")
def run_task_script(c: Context, t: TaskSpec) -> dict:
    source = t.params.get("source")
    if source is None:
        path = str(t.params["path"])
        with open(path if os.path.isabs(path) else os.path.join(c.config.base or ".", path)) as f:
            source = f.read()
    it = run_script(c.spark, source, base=c.task_dir(t))
    for name in sorted(os.listdir(c.task_dir(t))):
        if os.path.isfile(path := os.path.join(c.task_dir(t), name)):
            c.register(path, t.name)
    return {"values": len(it.values), "shown": it.shown}


def git_commit(folder: str | None = None) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def run(spark: SparkSession, config: Config | dict | str, output_dir: str | None = None) -> dict:
    """Runs the tasks in order and writes config, graph, artifacts, provenance, manifest and reports; returns the summary.

    A task is skipped if one it depends on didn't succeed (or is disabled). strict: a failure that isn't allowed raises at the end; fail_fast: the rest is skipped.
    """
    config = (Config.load(config) if isinstance(config, str) else Config.of(config) if isinstance(config, dict) else config).validate()
    folder = os.path.join(output_dir or config.output_dir, slugify(config.name))
    os.makedirs(folder, exist_ok=True)
    spec = {k: v for k, v in config.graph.items() if k not in ("kind", "path", "name", "params")}
    graph = readers.load(spark, config.graph["kind"], config.graph.get("path"), base=config.base, **spec, **(config.graph.get("params") or {}))
    c = Context(spark, config, graph, folder)
    c.note("start", config=config.content_hash(), python=platform.python_version(), spark=spark.version, commit=git_commit())
    writers.write_json(os.path.join(folder, "config.json"), config.as_dict())
    about = matrices.graph_summary(graph).first().asDict()
    writers.write_json(os.path.join(folder, "graph.json"), about)
    failed = False
    for t in config.order():
        began = time.time()
        blocked = [d for d in t.depends_on if c.results.get(d, {}).get("status") != "success"]
        result = {"status": "disabled"} if not t.enabled else {"status": "skipped", "message": f"waits for {', '.join(blocked)}"} if blocked else {"status": "skipped", "message": "an earlier task failed"} if failed and config.fail_fast else None
        if result is None:
            try:
                result = {"status": "success", "metrics": plain(TASKS[t.kind](c, t))}
            except Exception as e:
                result = {"status": "failed", "message": f"{type(e).__name__}: {e}"[:2000]}
                failed |= not t.allow_failure
        c.results[t.name] = {**result, "kind": t.kind, "seconds": round(time.time() - began, 3)}
        c.note("task", task=t.name, status=result["status"])
    status = "failed" if failed else "success"
    c.note("end", status=status)
    summary = {"name": config.name, "status": status, "graph": plain(about), "tasks": c.results, "artifacts": len(c.artifacts)}
    text = writers.markdown(config.name, {"Description": config.description or "-", "Graph": about, "Tasks": [{"task": k, "kind": r["kind"], "status": r["status"], "seconds": r["seconds"], "message": r.get("message", "")} for k, r in c.results.items()], "Artifacts": c.artifacts})
    writers.write_text(os.path.join(folder, "report.md"), text)
    writers.write_text(os.path.join(folder, "report.html"), writers.page(text, config.name))
    writers.write_json(os.path.join(folder, "provenance.json"), c.events[-EVENTS_KEPT:])
    writers.write_json(os.path.join(folder, "manifest.json"), c.artifacts)
    writers.write_json(os.path.join(folder, "summary.json"), summary)
    if failed and config.strict:
        raise GraphError(f"{config.name}: a task failed; see {folder}")
    return summary


EXAMPLE = {
    "name": "example", "description": "All kinds of analysis on a generated graph.", "graph": {"kind": "synthetic", "params": {"n": 60, "k": 4, "seed": 0}},
    "tasks": [
        {"name": "diffusion", "kind": "diffusion", "params": {"seed_nodes": [0], "steps": 60, "dt": 0.03}}, {"name": "spectral", "kind": "spectral"},
        {"name": "counterfactual", "kind": "counterfactual", "depends_on": ["diffusion"], "params": {"seed_nodes": [0], "target_nodes": [12], "interventions": [{"kind": "remove_node", "nodes": [5]}], "max_edges": 10}},
        {"name": "gsp", "kind": "gsp", "params": {"seed_nodes": [0]}}, {"name": "robustness", "kind": "robustness", "params": {"n_trials": 20}},
    ],
}


def session_dump(graph: Graph, params: dict, results: dict[str, DataFrame]) -> dict:
    """A session as JSON: its graph's edges and nodes, parameters, and results of bounded size."""
    rows = lambda df: [plain(r.asDict(recursive=True)) for r in df.collect()]
    return {"name": graph.name, "meta": plain(graph.meta), "edges": rows(graph.edges), "nodes": rows(graph.nodes), "params": plain(params), "results": {k: rows(v) for k, v in results.items()}}


def session_load(spark: SparkSession, data: dict) -> tuple[Graph, dict, dict[str, DataFrame]]:
    from ..graph import EDGES, NODES

    pick = lambda rows, ddl: spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in rows], ddl)
    g = Graph(pick(data["edges"], EDGES), pick(data["nodes"], NODES), data["name"], data["meta"])
    return g, data["params"], {k: spark.createDataFrame(v) for k, v in data["results"].items() if v}
