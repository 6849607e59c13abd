"""Sinks: single files written by the driver for results of bounded size, and Spark's writers for tables of any size."""

from __future__ import annotations

import csv
import html
import json
import os
import re
from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import plain
from ..graph import Graph, GraphError
from ..operators import matrices
from .readers import write_npz, write_tables


def prepared(path: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return path


def write_json(path: str, value: Any, indent: int = 2) -> None:
    with open(prepared(path), "w") as f:
        json.dump(plain(value), f, indent=indent, sort_keys=True)


def write_text(path: str, text: str) -> None:
    with open(prepared(path), "w") as f:
        f.write(text)


def write_csv(path: str, rows: Iterable[dict]) -> None:
    """Columns in the order in which rows first have them; an empty file without rows."""
    rows = list(rows)
    names = list(dict.fromkeys(k for r in rows for k in r))
    with open(prepared(path), "w", newline="") as f:
        if names:
            w = csv.DictWriter(f, names, restval="")
            w.writeheader()
            w.writerows(rows)


def frame_csv(df: DataFrame, path: str, *, order: list | None = None) -> None:
    """A frame of bounded size as one CSV file; rows stream through the driver."""
    df = df.orderBy(*order) if order else df
    with open(prepared(path), "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow([" ".join(map(str, v)) if isinstance(v, list) else "" if v is None else v for v in r])


def frame_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A frame of any size, by Spark's writers."""
    df.write.mode(mode).format(fmt).option("header", True).save(path)


def node_link(nodes: DataFrame, edges: DataFrame, sources: list[int], targets: list[int]) -> dict:
    """Node-link JSON of a subgraph: nodes(node, ...), edges(i, j, ...)."""
    return {
        "nodes": [plain(r.asDict()) | {"is_source": r.node in sources, "is_target": r.node in targets} for r in nodes.orderBy("node").collect()],
        "links": [plain(r.asDict()) | {"source": r.i, "target": r.j} for r in edges.orderBy("i", "j").collect()],
    }


def markdown_table(rows: list[dict], limit: int | None = None) -> str:
    if not rows:
        return "(none)\n"
    names = list(rows[0])
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    body = [[cell(r.get(n, "")) for n in names] for r in rows[:limit]]
    return "\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *body]) + "\n"


def markdown(title: str, sections: dict[str, Any], limit: int = 25) -> str:
    """Headed sections of tables (lists of rows), pairs (dicts) and text."""
    out = [f"# {title}", ""]
    for name, x in sections.items():
        out += [f"## {name}", ""]
        if isinstance(x, DataFrame):
            x = [r.asDict() for r in x.limit(limit).collect()]
        if isinstance(x, list):
            out.append(markdown_table(x, limit))
        elif isinstance(x, dict):
            out += [f"- {k}: {v}" for k, v in plain(x).items()] + [""]
        else:
            out += [str(x), ""]
    return "\n".join(out)


def page(text: str, title: str = "Report") -> str:
    """HTML of the small Markdown that markdown() writes."""
    out, table = [], False
    for line in text.split("\n"):
        row = line.startswith("| ")
        if row != table:
            out.append("<table>" if row else "</table>")
            table = row
        if row:
            if not set(line) <= set("|- "):
                out.append("<tr>" + "".join(f"<td>{html.escape(c.strip())}</td>" for c in line.strip("|").split("|")) + "</tr>")
        elif m := re.match(r"(#+) (.*)", line):
            out.append(f"<h{len(m[1])}>{html.escape(m[2])}</h{len(m[1])}>")
        elif line.startswith("- "):
            out.append(f"<li>{html.escape(line[2:])}</li>")
        elif line:
            out.append(f"<p>{html.escape(line)}</p>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>\n" + "\n".join(out + (["</table>"] if table else [])) + "\n</body></html>\n"


def report(directory: str, name: str, tables: dict[str, DataFrame], info: dict, *, order: dict[str, list] | None = None, tabular: bool = False) -> list[str]:
    """One CSV per table (or, with tabular, a Parquet folder), and JSON, Markdown and HTML of all; the paths written."""
    paths = []
    for key, df in tables.items():
        path = os.path.join(directory, f"{key}.{'parquet' if tabular else 'csv'}")
        if tabular:
            frame_table(df, path)
        else:
            frame_csv(df, path, order=(order or {}).get(key))
        paths.append(path)
    heads = {k: [r.asDict(recursive=True) for r in df.limit(25).collect()] for k, df in tables.items()}
    text = markdown(name, {"Summary": info, **heads})
    for suffix, write in (("json", lambda p: write_json(p, {"name": name, **info, "tables": heads})), ("md", lambda p: write_text(p, text)), ("html", lambda p: write_text(p, page(text, name)))):
        path = os.path.join(directory, f"report.{suffix}")
        write(path)
        paths.append(path)
    return paths


def described(v) -> str:
    """One line on a script's value."""
    if v.kind in ("graph", "counterfactual"):
        s = matrices.graph_summary(v.graph).first()
        extra = "" if v.kind == "graph" else ", " + json.dumps(plain(v.info), sort_keys=True)
        return f"{v.kind} of {s.nodes} nodes, {s.edges} edges, volume {s.volume:.6g}{extra}" if s else f"{v.kind}, empty"
    if v.kind in ("signal", "diffusion"):
        s = v.data.agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
        return f"{v.kind} of {s.n} values, sum {s.s:.6g}, from {s.lo:.6g} to {s.hi:.6g}"
    if v.kind == "spectrum":
        return f"spectrum of {v.data.select('graph_id', 'mode').distinct().count()} modes"
    return json.dumps(plain(v.data))


# What a value's format is if the path's suffix doesn't say.
SUFFIXES = {".json": "json", ".npz": "npz", ".md": "markdown", ".parquet": "parquet"}


def export(v, path: str, fmt: str | None = None) -> None:
    """A script's value as csv, json, npz (graphs), markdown or parquet, by FORMAT or suffix (csv by default)."""
    fmt = (fmt or SUFFIXES.get(os.path.splitext(path)[1].lower(), "csv")).lower()
    is_graph = v.kind in ("graph", "counterfactual")
    if fmt == "npz":
        if not is_graph:
            raise GraphError("only graphs can be written as npz")
        write_npz(v.graph, prepared(path))
    elif fmt == "parquet":
        write_tables(v.graph, path) if is_graph else frame_table(v.data, path)
    elif fmt == "json":
        write_json(path, {"kind": v.kind, "info": v.info, "value": edges_rows(v.graph) if is_graph else [r.asDict() for r in v.data.collect()] if isinstance(v.data, DataFrame) else v.data})
    elif fmt in ("markdown", "md"):
        write_text(path, markdown(v.kind, {"Summary": described(v)}))
    elif fmt == "csv":
        export_csv(v, path)
    else:
        raise GraphError(f"unknown format {fmt!r}")


def edges_rows(g: Graph) -> list[dict]:
    return [r.asDict() for r in g.edges.where("src < dst").select("src", "dst", "weight").orderBy("src", "dst").collect()]


def export_csv(v, path: str) -> None:
    if v.kind in ("graph", "counterfactual"):
        np.savetxt(prepared(path), v.graph.to_matrix(), delimiter=",")
    elif v.kind in ("signal", "diffusion"):
        frame_csv(v.data.select("node", F.col("value").alias("signal" if v.kind == "signal" else "state")), path, order=["node"])
    elif v.kind == "spectrum":
        frame_csv(v.data.select("mode", "eigenvalue").distinct(), path, order=["mode"])
    elif isinstance(v.data, dict):
        write_csv(path, [{"key": k, "value": x} for k, x in v.data.items()])
    else:
        write_csv(path, [{"value": x} for x in (v.data if isinstance(v.data, list) else [v.data])])


def vector_csv(signals: DataFrame, path: str) -> None:
    """Values in the order of nodes, without a header."""
    with open(prepared(path), "w") as f:
        for r in signals.orderBy("node").select("value").toLocalIterator():
            f.write(f"{r[0]!r}\n")
