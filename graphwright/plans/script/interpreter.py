"""Analysis and execution of scripts over lazy frames."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...graph import Graph
from ...operators import dynamics, spectral, whatif
from ...sources import readers, writers
from .syntax import FORMATS, GRAMMAR, OPERATIONS, Name, ScriptError, Statement, parse

#: What each statement makes, and of what.
MAKES = {"LOAD": "graph", "GRAPH": "graph", "SEED": "signal", "DIFFUSE": "diffusion", "SPECTRAL": "spectrum", "COUNTERFACTUAL": "counterfactual"}
TAKES = {"GRAPH": ("graph",), "SEED": ("graph",), "DIFFUSE": ("signal",), "SPECTRAL": ("graph",), "COUNTERFACTUAL": ("graph",)}


@dataclass
class Value:
    """A named thing: kind, frames or a plain value, and the graph that it belongs to."""

    kind: str
    data: object
    graph: Graph | None = None
    info: dict = field(default_factory=dict)


@dataclass
class Hooks:
    """Functions that take the place of the built-in ones: (interpreter, statement) -> Value, or None to decline."""

    load: Callable | None = None
    graph: Callable | None = None
    diffuse: Callable | None = None
    spectral: Callable | None = None
    counterfactual: Callable | None = None
    export: Callable | None = None


def analyze(program: list[Statement], known: dict[str, str] | None = None, source: str = "") -> dict[str, str]:
    """Kinds of all names; an error for names used before they are made, or for another purpose."""
    kinds = dict(known or {})

    def need(name: str, allowed: tuple[str, ...] | None, s: Statement) -> None:
        if name not in kinds:
            raise ScriptError(f"{name} is not defined", s.line, 1, source)
        if allowed and kinds[name] not in allowed:
            raise ScriptError(f"{name} is a {kinds[name]}, not a {' or '.join(allowed)}", s.line, 1, source)

    for s in program:
        if s.verb in TAKES:
            need(str(s.source), TAKES[s.verb], s)
        if s.verb in ("EXPORT", "DESCRIBE") or s.verb == "SHOW" and s.source:
            need(str(s.source), None, s)
        if "COMPARE" in s.clauses:
            need(str(s.clauses["COMPARE"]), ("signal",), s)
        if s.target:
            kinds[s.target] = MAKES.get(s.verb) or ("array" if isinstance(s.source, list) else kinds.get(s.source.text, "text") if isinstance(s.source, Name) else "text" if isinstance(s.source, str) else "scalar")
    return kinds


class Interpreter:
    def __init__(self, spark: SparkSession, *, hooks: Hooks | None = None, base: str | None = None, out: Callable[[str], None] | None = None):
        self.spark, self.hooks, self.base = spark, hooks or Hooks(), base
        self.values: dict[str, Value] = {}
        self.shown: list[str] = []
        self.out = out or self.shown.append

    def path(self, p: object) -> str:
        p = str(p.text if isinstance(p, Name) else p)
        return p if self.base is None or "://" in p or os.path.isabs(p) else os.path.join(self.base, p)

    def plain(self, x: object) -> object:
        if isinstance(x, Name):
            return self.values[x.text].data if x.text in self.values else x.text
        return [self.plain(v) for v in x] if isinstance(x, list) else x

    def get(self, name: str, *kinds: str) -> Value:
        if name not in self.values:
            raise ScriptError(f"{name} is not defined")
        if kinds and self.values[name].kind not in kinds:
            raise ScriptError(f"{name} is a {self.values[name].kind}, not a {' or '.join(kinds)}")
        return self.values[name]

    def run(self, source: str | list[Statement]) -> dict[str, Value]:
        text = source if isinstance(source, str) else ""
        program = parse(source) if isinstance(source, str) else source
        analyze(program, {k: v.kind for k, v in self.values.items()}, text)
        for s in program:
            try:
                self.step(s)
            except ScriptError:
                raise
            except Exception as e:
                raise ScriptError(f"{s.verb}: {e}", s.line, 1, text) from e
        return self.values

    def step(self, s: Statement) -> None:
        hook = getattr(self.hooks, s.verb.lower(), None) if s.verb in GRAMMAR else None
        made = hook(self, s) if hook else None
        if made is None:
            made = getattr(self, f"_{s.verb.lower()}")(s)
        if s.target:
            self.values[s.target] = made

    def _load(self, s: Statement) -> Value:
        c = s.clauses
        path = None if s.source is None else self.plain(s.source)
        kind = c.get("KIND") or ("demo" if path == "demo" else os.path.splitext(str(path))[1].lstrip(".").lower())
        if kind.upper() not in FORMATS:
            raise ScriptError(f"{path}: unknown kind of file", s.line, 1)
        if kind == "demo":
            params = {k: int(self.plain(c[n])) for n, k in (("NODES", "n"), ("SEED", "seed")) if n in c}
        elif kind == "pdb":
            params = self._contacts(c)
        else:
            params = {}
        g = readers.load(self.spark, kind, None if kind == "demo" else str(path), base=self.base, **params)
        return Value("graph", g, g, {"load": (kind, path)})

    def _contacts(self, c: dict) -> dict:
        out = {}
        if "CUTOFF" in c or "CONTACT" in c:
            out["cutoff"] = float(self.plain(c.get("CUTOFF", c.get("CONTACT"))))
        if "CHAIN" in c:
            out["chain"] = str(self.plain(c["CHAIN"]))
        if "WEIGHT" in c or "MODE" in c:
            out["mode"] = str(c.get("WEIGHT", c.get("MODE")))
        return out

    def _graph(self, s: Statement) -> Value:
        v = self.get(str(s.source), "graph")
        kind, path = v.info.get("load", (None, None))
        if kind == "pdb":  # built anew with other contacts
            g = readers.load(self.spark, "pdb", str(path), base=self.base, **self._contacts(s.clauses))
            return Value("graph", g, g, v.info)
        g = Graph(v.graph.edges, v.graph.nodes, v.graph.name, dict(v.graph.meta))
        return Value("graph", g, g, v.info)

    def _node(self, g: Graph, x: object) -> int:
        x = self.plain(x)
        return g.resolve(x)

    def _seed(self, s: Statement) -> Value:
        g, c = self.get(str(s.source), "graph").graph, s.clauses
        nodes = [self._node(g, x) for x in [*([c["NODE"]] if "NODE" in c else []), *c.get("NODES", [])]]
        x = dynamics.seeds(g, nodes, strength=float(self.plain(c.get("STRENGTH", 1.0))), signal=s.target) if nodes else None
        if file := c.get("VALUES", c.get("FILE")):
            with open(self.path(self.plain(file))) as f:
                numbers = [float(t) for t in f.read().replace(",", " ").split()]
            if len(numbers) != g.count():
                raise ScriptError(f"{len(numbers)} values for {g.count()} nodes", s.line, 1)
            rows = self.spark.createDataFrame(list(enumerate(numbers)), "node int, v double")
            base = g.nodes.join(rows, "node").select("graph_id", F.lit(s.target).alias("signal"), "node", F.col("v").alias("value"))
            if x is not None:  # seeds overwrite values
                x = base.join(x.select("graph_id", "node", F.col("value").alias("w")), ["graph_id", "node"]).select("graph_id", "signal", "node", F.when(F.col("node").isin(nodes), F.col("w")).otherwise(F.col("value")).alias("value"))
            else:
                x = base
        return Value("signal", x, g)

    def _diffuse(self, s: Statement) -> Value:
        v, c = self.get(str(s.source), "signal"), s.clauses
        steps, dt, model = int(self.plain(c.get("STEPS", 60))), float(self.plain(c.get("DT", 0.1))), str(c.get("MODEL", c.get("MODE", "diffusion")))
        return Value("diffusion", dynamics.run(v.graph, v.data, model=model, steps=steps, dt=dt), v.graph, {"steps": steps, "dt": dt, "model": model})

    def _spectral(self, s: Statement) -> Value:
        g, c = self.get(str(s.source), "graph").graph, s.clauses
        kind = "normalized" if c.get("NORMALIZED") else str(c.get("LAPLACIAN", c.get("MODE", "unnormalized")))
        return Value("spectrum", spectral.decompose(g, kind, k=int(self.plain(c.get("MODES", 20)))), g, {"laplacian": kind})

    def _counterfactual(self, s: Statement) -> Value:
        g, c = self.get(str(s.source), "graph").graph, s.clauses
        op = next(o for o in OPERATIONS if o in c)
        factor, arg = float(self.plain(c.get("FACTOR", 0.5))), c[op]
        mapping = g.nodes.select("graph_id", "node", F.col("node").alias("new"))
        if op == "REMOVE_NODE":
            after, mapping = whatif.delete_node(g, self._node(g, arg))
        elif op == "MUTATE_NODE":
            after = whatif.scale_node(g, self._node(g, arg), factor)
        elif op == "REMOVE_EDGE":
            after = whatif.RemoveEdges((tuple(self._node(g, x) for x in arg),)).apply(g)
        elif op == "REWEIGHT_EDGE":
            after = whatif.ReweightEdge(*(self._node(g, x) for x in arg), factor=factor).apply(g)
        else:
            after = whatif.BlockPath(tuple(self._node(g, x) for x in arg), factor if "FACTOR" in c else 0.0).apply(g)
        weight = lambda h: h.edges.agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
        a, b = weight(g), weight(after)
        info = {"operation": op.lower(), "edges_before": a.n // 2, "edges_after": b.n // 2, "weight_before": a.w / 2, "weight_after": b.w / 2}
        if "COMPARE" in c:
            x = self.get(str(c["COMPARE"]), "signal").data
            moved = x.join(mapping, ["graph_id", "node"]).select("graph_id", "signal", F.col("new").alias("node"), "value")
            before = dynamics.run(g, x).join(mapping, ["graph_id", "node"]).select("graph_id", F.col("new").alias("node"), F.col("value").alias("p"))
            both = before.join(dynamics.run(after, moved).select("graph_id", "node", F.col("value").alias("q")), ["graph_id", "node"])
            d = F.col("q") - F.col("p")
            r = both.agg(F.count("*").alias("n_compared"), F.sqrt(F.sum(d * d)).alias("l2_delta"), (F.sqrt(F.sum(d * d)) / (F.sqrt(F.sum(F.col("p") ** 2)) + 1e-12)).alias("relative_l2"), F.max(F.abs(d)).alias("max_abs"), F.sum("p").alias("sum_before"), F.sum("q").alias("sum_after")).first()
            info |= r.asDict()
        return Value("counterfactual", after, after, info)

    def _export(self, s: Statement) -> Value | None:
        writers.export(self.get(str(s.source)), self.path(self.plain(s.clauses["TO"])), str(s.clauses["FORMAT"]) if "FORMAT" in s.clauses else None)
        return None

    def _let(self, s: Statement) -> Value:
        if isinstance(s.source, Name) and s.source.text in self.values:
            return self.values[s.source.text]
        x = self.plain(s.source)
        return Value("array" if isinstance(x, list) else "text" if isinstance(x, str) else "scalar", x)

    def _show(self, s: Statement) -> None:
        if s.source is None:
            for k, v in self.values.items():
                self.out(f"{k}: {v.kind}")
        else:
            v = self.get(str(s.source))
            self.out(v.data._show_string(20, 20, False) if isinstance(v.data, DataFrame) else f"{s.source}: {writers.described(v)}")

    def _describe(self, s: Statement) -> None:
        self.out(f"{s.source}: {writers.described(self.get(str(s.source)))}")

    def _help(self, s: Statement) -> None:
        self.out(help_text(str(s.source) if s.source else None))


def help_text(topic: str | None = None) -> str:
    if topic and topic.upper() in GRAMMAR:
        return f"{topic.upper()}: " + ", ".join(f"{k} ({v})" for k, v in GRAMMAR[topic.upper()].items())
    return "Statements: " + ", ".join([*GRAMMAR, "LET", "SHOW", "DESCRIBE", "HELP"])


def run_script(spark: SparkSession, source: str, *, hooks: Hooks | None = None, base: str | None = None, out: Callable[[str], None] | None = None) -> Interpreter:
    it = Interpreter(spark, hooks=hooks, base=base, out=out)
    it.run(source)
    return it


def repl(spark: SparkSession, read: Callable[[str], str] = input, out: Callable[[str], None] = print, hooks: Hooks | None = None) -> None:
    """Statements line by line until an empty end of input or EXIT; faults are shown and forgotten."""
    it = Interpreter(spark, hooks=hooks, out=out)
    while True:
        try:
            line = read("> ")
        except EOFError:
            return
        if line.strip().upper() in ("EXIT", "QUIT"):
            return
        try:
            it.run(line)
        except ScriptError as e:
            out(str(e))
