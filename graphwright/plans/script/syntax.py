"""Tokens, statements and the formatter of the script language.

Statements end at a line's end or a semicolon. Keywords are case-insensitive. A value is a string, number, true or false, a name, or a bracketed list.
The clauses of each statement are a table, so that the parser and the formatter read the same grammar.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<comment>\#[^\n]*|//[^\n]*)|(?P<end>[\n;])|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)(?![\w.])|(?P<name>[A-Za-z_](?:[\w.-]*\w)?)|(?P<mark>[\[\](),:])"""
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}


class ScriptError(ValueError):
    """A fault in a script, with the place where it is."""

    def __init__(self, message: str, line: int = 0, column: int = 0, source: str = ""):
        self.message, self.line, self.column = message, line, column
        rows = source.split("\n")
        shown = f"\n  {rows[line - 1]}\n  {' ' * (column - 1)}^" if 0 < line <= len(rows) else ""
        super().__init__(f"line {line}, column {column}: {message}{shown}" if line else message)


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    line: int
    column: int


@dataclass(frozen=True)
class Name:
    text: str


@dataclass
class Statement:
    verb: str
    target: str | None = None
    source: object = None
    clauses: dict = field(default_factory=dict)
    line: int = 0


def tokenize(source: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(source):
        m = TOKEN.match(source, at)
        column = at - start + 1
        if m is None:
            what = "string without an end" if source[at] in "\"'" else f"unexpected character {source[at]!r}"
            raise ScriptError(what, line, column, source)
        kind, text = m.lastgroup, m.group()
        if kind == "string":
            if bad := re.search(r"\\([^ntr\\\"'])", text):
                raise ScriptError(f"unknown escape \\{bad[1]}", line, column, source)
            out.append(Token(kind, re.sub(r"\\(.)", lambda e: ESCAPES[e[1]], text[1:-1]), line, column))
        elif kind == "number":
            out.append(Token(kind, float(text) if re.search("[.eE]", text) else int(text), line, column))
        elif kind in ("name", "mark", "end"):
            out.append(Token(kind, text, line, column))
        at = m.end()
        if text == "\n":
            line, start = line + 1, at
    return [*out, Token("end", "", line, len(source) - start + 1)]


# Clause -> how its operand is read: value, list, pair, word or flag
LOADS = {"CUTOFF": "value", "CHAIN": "value", "WEIGHT": "word", "MODE": "word", "CONTACT": "word", "NODES": "value", "SEED": "value"}
GRAMMAR: dict[str, dict[str, str]] = {
    "LOAD": LOADS,
    "GRAPH": {k: v for k, v in LOADS.items() if k not in ("NODES", "SEED")},
    "SEED": {"NODE": "value", "NODES": "list", "STRENGTH": "value", "VALUES": "from", "FILE": "value"},
    "DIFFUSE": {"STEPS": "value", "DT": "value", "MODEL": "word", "MODE": "word"},
    "SPECTRAL": {"MODES": "value", "NORMALIZED": "flag", "LAPLACIAN": "word", "MODE": "word"},
    "COUNTERFACTUAL": {"REMOVE_NODE": "value", "MUTATE_NODE": "value", "REMOVE_EDGE": "pair", "REWEIGHT_EDGE": "pair", "BLOCK_PATH": "list", "FACTOR": "value", "TARGET": "value", "COMPARE": "word"},
    "EXPORT": {"TO": "value", "FORMAT": "word"},
}
OPERATIONS = ("REMOVE_NODE", "MUTATE_NODE", "REMOVE_EDGE", "REWEIGHT_EDGE", "BLOCK_PATH")
FORMATS = ("PDB", "NPZ", "CSV", "DEMO")
NAMED = ("LOAD", "GRAPH", "SEED", "DIFFUSE", "SPECTRAL", "COUNTERFACTUAL")


class Parser:
    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, tokenize(source), 0

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str) -> ScriptError:
        return ScriptError(message, self.token.line, self.token.column, self.source)

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def is_word(self, *words: str) -> bool:
        return self.token.kind == "name" and str(self.token.value).upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.take()
            return True
        return False

    def name(self) -> str:
        if self.token.kind != "name":
            raise self.fail("a name is expected")
        return str(self.take().value)

    def mark(self, text: str) -> bool:
        if self.token.kind == "mark" and self.token.value == text:
            self.take()
            return True
        return False

    def value(self) -> object:
        t = self.token
        if t.kind in ("string", "number"):
            return self.take().value
        if self.mark("["):
            items = []
            while not self.mark("]"):
                items.append(self.value())
                if not self.mark(",") and not (self.token.kind == "mark" and self.token.value == "]"):
                    raise self.fail("a comma or ] is expected")
            return items
        if t.kind == "name":
            text = str(self.take().value)
            return {"true": True, "false": False}.get(text.lower(), Name(text))
        raise self.fail("a value is expected")

    def items(self) -> list:
        if self.token.kind == "mark" and self.token.value == "[":
            return list(self.value())
        out = [self.value()]
        while self.mark(","):
            out.append(self.value())
        return out

    def operand(self, how: str) -> object:
        if how == "flag":
            return True
        if how == "list":
            return self.items()
        if how == "from":
            if not self.word("FROM"):
                raise self.fail("FROM is expected")
            return self.value()
        if how == "pair":
            closed = self.mark("(")
            u = self.value()
            self.mark(",")
            v = self.value()
            if closed and not self.mark(")"):
                raise self.fail(") is expected")
            return (u, v)
        x = self.value()
        return x.text if how == "word" and isinstance(x, Name) else x

    def statement(self) -> Statement:
        line, verb = self.token.line, self.name().upper()
        if verb in GRAMMAR:
            s = Statement(verb, line=line)
            if verb == "LOAD":
                kind = str(self.take().value).lower() if self.is_word(*FORMATS) else None
                s.source = None if kind == "demo" and (self.is_word("AS", *LOADS) or self.token.kind == "end") else self.value()
                if kind:
                    s.clauses["KIND"] = kind
            else:
                s.source = self.name()
            while self.token.kind != "end":
                if verb != "EXPORT" and self.word("AS"):
                    s.target = self.name()
                    break
                here = self.fail(f"{verb} has no clause {self.token.value!r}")
                clause = str(self.token.value).upper() if self.token.kind == "name" else ""
                if clause not in GRAMMAR[verb]:
                    raise here
                self.take()
                s.clauses[clause] = self.operand(GRAMMAR[verb][clause])
            self.check(s)
            return s
        if verb == "LET":
            target = self.name()
            if not self.word("AS", "TO"):
                raise self.fail("AS or TO is expected")
            return Statement(verb, target, self.value(), line=line)
        if verb in ("SHOW", "DESCRIBE", "HELP"):
            if self.token.kind == "end":
                if verb == "DESCRIBE":
                    raise self.fail("a name is expected")
                return Statement(verb, line=line)
            return Statement(verb, source=self.name(), line=line)
        self.at -= 1
        raise self.fail(f"unknown statement {verb}")

    def check(self, s: Statement) -> None:
        if s.verb in NAMED and s.target is None:
            raise self.fail("AS and a name are expected")
        if s.verb == "SEED" and not {"NODE", "NODES", "VALUES", "FILE"} & set(s.clauses):
            raise self.fail("SEED needs NODE, NODES, VALUES FROM or FILE")
        if s.verb == "COUNTERFACTUAL" and sum(o in s.clauses for o in OPERATIONS) != 1:
            raise self.fail("COUNTERFACTUAL needs one operation")
        if s.verb == "EXPORT" and "TO" not in s.clauses:
            raise self.fail("EXPORT needs TO")

    def program(self) -> list[Statement]:
        out = []
        while self.at < len(self.tokens):
            if self.token.kind == "end":
                self.take()
                continue
            out.append(self.statement())
            if self.token.kind != "end":
                raise self.fail("the end of the statement is expected")
        return out


def parse(source: str) -> list[Statement]:
    return Parser(source).program()


def literal(x: object) -> str:
    if isinstance(x, Name):
        return x.text
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int | float):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, tuple):
        return "(" + ", ".join(map(literal, x)) + ")"
    text = str(x)
    for k, v in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = text.replace(k, v)
    return f'"{text}"'


def format_script(program: list[Statement] | str) -> str:
    """The script anew; parse() of it gives the same statements."""
    rows = []
    for s in parse(program) if isinstance(program, str) else program:
        if s.verb == "LET":
            rows.append(f"LET {s.target} AS {literal(s.source)}")
            continue
        parts = [s.verb]
        if "KIND" in s.clauses:
            parts.append(str(s.clauses["KIND"]).upper())
        if s.source is not None:
            parts.append(literal(s.source) if s.verb == "LOAD" else str(s.source))
        for k, v in s.clauses.items():
            how = GRAMMAR[s.verb].get(k) if s.verb in GRAMMAR else None
            if k == "KIND":
                continue
            if how == "flag":
                parts.append(k)
            elif how == "from":
                parts += [k, "FROM", literal(v)]
            elif how == "word" and isinstance(v, str) and k == "COMPARE":
                parts += [k, v]
            else:
                parts += [k, literal(v)]
        if s.target:
            parts += ["AS", s.target]
        rows.append(" ".join(parts))
    return "\n".join(rows) + ("\n" if rows else "")
