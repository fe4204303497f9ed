"""Expression trees: one frozen node type, written back as XPath by ``to_xpath``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Ex:
    """An expression: its operator, a value that depends on it, and its operands."""

    op: str
    val: Any = None
    args: tuple[Ex, ...] = ()

    def walk(self) -> Iterator[Ex]:
        yield self
        for a in self.args:
            yield from a.walk()

    def dump(self) -> str:
        """The tree as nested parentheses."""
        inner = " ".join(x for x in [*([repr(self.val)] if self.val is not None else []), *(a.dump() for a in self.args)])
        return f"({self.op}{' ' + inner if inner else ''})"


@dataclass(frozen=True)
class Test:
    """A node test: kind, and names; None in a name stands for a wildcard."""

    kind: str
    ns: str | None = None
    local: str | None = None
    type: str | None = None


@dataclass(frozen=True)
class SeqType:
    """A sequence type: an item type name, its arguments, and an occurrence sign."""

    name: str
    args: tuple = ()
    occurs: str = ""

    def __str__(self) -> str:
        inside = f"({', '.join(map(str, self.args))})" if self.args else "()" if self.name in KIND_TESTS else ""
        return f"{self.name}{inside}{self.occurs}"


KIND_TESTS = frozenset(
    "node text comment processing-instruction document-node element attribute schema-element schema-attribute"
    " namespace-node item empty-sequence map array function".split()
)
_BINARY = {"or": "or", "and": "and", "range": "to", "concat": "||", "union": "|", "intersect": "intersect", "except": "except", "map": "!"}


def _step(e: Ex) -> str:
    axis, test = e.val
    if test.kind == "name":
        name = f"Q{{{test.ns}}}{test.local or '*'}" if test.ns else ("*" if test.local is None else ("*:" if test.ns is None else "") + test.local)
    else:
        name = f"{test.kind}({test.local or ''})"
    return f"{axis}::{name}" + "".join(f"[{to_xpath(p)}]" for p in e.args)


def to_xpath(e: Ex) -> str:
    """The expression as text that parses to an equal tree."""
    a = [to_xpath(x) for x in e.args]
    match e.op:
        case "lit":
            kind, value = e.val
            return '"' + value.replace('"', '""') + '"' if kind == "string" else value
        case "var":
            return f"${e.val}"
        case "ctx":
            return "."
        case "placeholder":
            return "?"
        case "step":
            return _step(e)
        case "path":
            return {"/": "/", "": ""}[e.val] + "/".join(a)
        case "filter":
            return f"({a[0]})" + "".join(f"[{p}]" for p in a[1:])
        case "call":
            return f"{e.val}({', '.join(a)})"
        case "seq":
            return f"({', '.join(a)})"
        case "gcmp" | "vcmp" | "ncmp" | "arith":
            return f"({a[0]} {e.val} {a[1]})"
        case "neg" | "pos":
            return f"({'-' if e.op == 'neg' else '+'}{a[0]})"
        case "if":
            return f"(if ({a[0]}) then {a[1]} else {a[2]})"
        case "for" | "let" | "some" | "every":
            sign = ":=" if e.op == "let" else "in"
            binds = ", ".join(f"${n} {sign} {x}" for n, x in zip(e.val, a))
            return f"({e.op} {binds} {'satisfies' if e.op in ('some', 'every') else 'return'} {a[-1]})"
        case "instance" | "treat" | "castable" | "cast":
            return f"({a[0]} {e.op} {'of' if e.op == 'instance' else 'as'} {e.val})"
        case "lookup" | "ulookup":
            key = {"name": lambda: str(e.val[1]), "int": lambda: str(e.val[1]), "all": lambda: "*", "expr": lambda: f"({a[-1]})"}[e.val[0]]()
            return (f"({a[0]})" if e.op == "lookup" else "") + f"?{key}"
        case "funcref":
            return f"{e.val[0]}#{e.val[1]}"
        case "inline":
            names, types, result = e.val
            return f"function({', '.join(f'${n}' + (f' as {t}' if t else '') for n, t in zip(names, types))}){f' as {result}' if result else ''} {{{a[0]}}}"
        case "mapctor":
            return "map{" + ", ".join(f"{k}:{v}" for k, v in zip(a[::2], a[1::2])) + "}"
        case "sqarray":
            return f"[{', '.join(a)}]"
        case "cuarray":
            return f"array{{{', '.join(a)}}}"
        case "dyncall":
            return f"({a[0]})({', '.join(a[1:])})"
        case _:
            return f"({f' {_BINARY[e.op]} '.join(a)})"
