"""Command line: forward, scan, inverse, mediation, spectral, pathway, report, script, experiment, example, kinds."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import dynamics, flow, spectral
from .plans import experiments
from .plans.script import run_script
from .sources import readers, writers


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="graphwright")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("forward", "scan", "inverse", "mediation", "spectral", "pathway"):
        c = sub.add_parser(name)
        c.add_argument("--pdb")
        c.add_argument("--csv")
        c.add_argument("--demo", action="store_true")
        c.add_argument("--cutoff", type=float, default=8.0)
        c.add_argument("--seed", type=int, default=0)
        c.add_argument("--steps", type=int, default=60)
        c.add_argument("--dt", type=float, default=0.1)
        c.add_argument("--model", default="diffusion")
        c.add_argument("--observed")
        c.add_argument("--sources", type=lambda s: [int(x) for x in s.split(",")], default=[0])
        c.add_argument("--targets", type=lambda s: [int(x) for x in s.split(",")], default=[30])
        c.add_argument("--out", default=f"{name}.csv")
    r = sub.add_parser("report", help="all files of one kind of analysis of a graph")
    r.add_argument("kind", choices=[k for k in experiments.task_kinds() if k != "script"])
    r.add_argument("--csv", required=True)
    r.add_argument("--out", default="runs")
    r.add_argument("--params", type=json.loads, default={}, help="the task's parameters as JSON, such as seed_nodes, target_nodes, interventions")
    sub.add_parser("kinds", help="the kinds of tasks that experiments may have")
    sub.add_parser("script").add_argument("path")
    e = sub.add_parser("experiment")
    e.add_argument("config")
    e.add_argument("--out")
    sub.add_parser("example").add_argument("path")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if a.command == "example":
        writers.write_json(a.path, experiments.EXAMPLE)
        return 0
    if a.command == "kinds":
        print("\n".join(experiments.task_kinds()))
        return 0
    spark = SparkSession.builder.appName("graphwright").getOrCreate()
    if a.command == "script":
        with open(a.path) as f:
            run_script(spark, f.read(), out=print)
        return 0
    if a.command in ("experiment", "report"):
        config = a.config if a.command == "experiment" else {"name": a.kind, "graph": {"kind": "csv", "path": a.csv}, "tasks": [{"name": a.kind, "kind": a.kind, "params": a.params}]}
        summary = experiments.run(spark, config, a.out)
        print(json.dumps(summary, indent=2, default=str))
        return int(summary["status"] != "success")
    g = readers.from_pdb(spark, a.pdb, cutoff=a.cutoff) if a.pdb else readers.from_csv(spark, a.csv) if a.csv else readers.synthetic(spark)
    run = dict(model=a.model, steps=a.steps, dt=a.dt)
    if a.command == "pathway":
        s, t = a.sources, a.targets
        writers.report(a.out.removesuffix(".csv"), g.name, {"nodes": flow.node_scores(g, s, t), "edges": flow.edge_scores(g, s, t)}, {"sources": s, "targets": t})
    elif a.command == "spectral":
        writers.frame_csv(spectral.modes(spectral.decompose(g)).select("mode", "eigenvalue"), a.out, order=["mode"])
    elif a.command == "scan":
        writers.vector_csv(dynamics.scan(g, **run).withColumnRenamed("score", "value"), a.out)
    elif a.command == "mediation":
        writers.vector_csv(dynamics.mediation(g).withColumnRenamed("score", "value"), a.out)
    elif a.command == "inverse":
        observed = readers.signal_from_csv(g, spark, a.observed) if a.observed else dynamics.forward(g, seed_nodes=[a.seed], **run)
        writers.vector_csv(dynamics.inverse(observed), a.out)
    else:
        writers.vector_csv(dynamics.forward(g, seed_nodes=[a.seed], **run), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
