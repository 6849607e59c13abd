"""A small declarative language over graphs: LOAD, GRAPH, SEED, DIFFUSE, SPECTRAL, COUNTERFACTUAL, EXPORT, LET, SHOW, DESCRIBE, HELP."""

from .interpreter import Hooks, Interpreter, run_script
from .syntax import ScriptError, format_script, parse, tokenize

__all__ = ["Hooks", "Interpreter", "ScriptError", "format_script", "parse", "run_script", "tokenize"]
