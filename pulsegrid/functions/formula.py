"""The metric formula language: text to syntax tree to Column.

Operators by strength: ``**``, then ``* / //``, then ``+ - & | ^``, then
``> < = >= <= == !=``, then ``c ? x : y``; those of one strength group to the
left.  ``[a, b].max`` and ``[a, b].min`` are null if an operand is.  Round,
curly and square brackets group.  An index after a name is read and ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numeric as N


class FormulaError(ValueError):
    pass


TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z_$][\w.$]*)|(?P<op>\*\*|//|>=|<=|==|!=|[-+*/&|^<>=?:,(){}\[\].]))")
BINARY = {"**": 16, "*": 8, "/": 8, "//": 8, "+": 4, "-": 4, "&": 4, "|": 4, "^": 4, ">": 2, "<": 2, "=": 2, ">=": 2, "<=": 2, "==": 2, "!=": 2}
CLOSE = {"(": ")", "{": "}", "[": "]"}


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple


Node = Number | Name | Call


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at:at + 10]!r} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.items, self.at = text, tokens(text), 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] == "op" else None

    def take(self, op: str) -> None:
        if self.peek() != op:
            raise FormulaError(f"expected {op!r} in {self.text!r}")
        self.at += 1

    def parse(self) -> Node:
        node = self.choice()
        if self.at < len(self.items):
            raise FormulaError(f"unexpected {self.items[self.at][1]!r} in {self.text!r}")
        return node

    def choice(self) -> Node:
        node = self.binary(0)
        if self.peek() != "?":
            return node
        self.at += 1
        yes = self.choice()
        self.take(":")
        return Call("?", (node, yes, self.choice()))

    def binary(self, least: int) -> Node:
        left = self.unary()
        while (op := self.peek()) in BINARY and BINARY[op] > least:
            self.at += 1
            left = Call({"=": "=="}.get(op, op), (left, self.binary(BINARY[op])))
        return left

    def unary(self) -> Node:
        if self.peek() == "-":
            self.at += 1
            return Call("neg", (self.binary(BINARY["*"] - 1),))
        return self.atom()

    def atom(self) -> Node:
        if self.at >= len(self.items):
            raise FormulaError(f"{self.text!r} ends early")
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "number":
            return Number(float(text))
        if kind == "name":
            return Name(self.indexed(text))
        if text not in CLOSE:
            raise FormulaError(f"unexpected {text!r} in {self.text!r}")
        args = [self.choice()]
        while self.peek() == ",":
            self.at += 1
            args.append(self.choice())
        self.take(CLOSE[text])
        if text == "[" and self.peek() == ".":
            self.at += 1
            how = self.items[self.at][1] if self.at < len(self.items) else ""
            self.at += 1
            if how not in ("max", "min") or len(args) != 2:
                raise FormulaError(f"[a, b].max or [a, b].min expected in {self.text!r}")
            return Call(how, tuple(args))
        if len(args) > 1:
            raise FormulaError(f"unexpected ',' in {self.text!r}")
        return args[0]

    def indexed(self, name: str) -> str:
        while self.peek() == "[":
            start = self.at
            if [k for k, _ in self.items[start + 1 : start + 2]] != ["number"] or self.items[start + 2 : start + 3] != [("op", "]")]:
                raise FormulaError(f"a number is expected as the index of {name!r} in {self.text!r}")
            self.at += 3
            if self.peek() == "." and self.items[self.at + 1 : self.at + 2] and self.items[self.at + 1][0] == "name":
                name += f"[{self.items[start + 1][1]}].{self.items[self.at + 1][1]}"
                self.at += 2
        return name


def parse(text: str) -> Node:
    return _Parser(text).parse()


def names(node: Node) -> set[str]:
    if isinstance(node, Name):
        return {node.text}
    return set().union(*map(names, node.args)) if isinstance(node, Call) else set()


def to_column(node: Node, resolve: Callable[[str], Column]) -> Column:
    if isinstance(node, Number):
        return F.lit(node.value)
    if isinstance(node, Name):
        return resolve(node.text)
    a = [to_column(x, resolve) for x in node.args]
    match node.op:
        case "+": return a[0] + a[1]
        case "-": return a[0] - a[1]
        case "*": return a[0] * a[1]
        case "/": return N.ieee_div(*a)
        case "//": return N.floor_div(*a)
        case "**": return F.pow(*a)
        case "&": return N.as_bits(a[0]).bitwiseAND(N.as_bits(a[1])).cast("double")
        case "|": return N.as_bits(a[0]).bitwiseOR(N.as_bits(a[1])).cast("double")
        case "^": return N.as_bits(a[0]).bitwiseXOR(N.as_bits(a[1])).cast("double")
        case "neg": return -a[0]
        case "max": return N.strict_max(*a)
        case "min": return N.strict_min(*a)
        case ">": return a[0] > a[1]
        case "<": return a[0] < a[1]
        case ">=": return a[0] >= a[1]
        case "<=": return a[0] <= a[1]
        case "==": return a[0] == a[1]
        case "!=": return a[0] != a[1]
        case "?": return F.when(a[0], a[1]).otherwise(a[2])
    raise FormulaError(node.op)


def compile_formula(text: str, resolve: Callable[[str], Column] = N.col) -> Column:
    return to_column(parse(text), resolve)
