"""A small safe formula language for KPIs: one parsed tree, read as a Column, as SQL, as a value, as text.

Numbers, allowed names, + - * / (also × and ÷), a sign, one comparison (also ≤ and ≥), and/or/not, min/max/abs. Division by zero is unknown, and
so is min or max with an unknown argument; and/or are three-valued.
"""

from __future__ import annotations

import ast
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from partlake.functions.semantics import greatest_known, least_known

MOST_CHARACTERS = 300
MOST_NODES = 80
ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}
COMPARISON = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}
DO = {"+": operator.add, "-": operator.sub, "*": operator.mul, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "<>": operator.ne}
CALLS = {"min": 2, "max": 2, "abs": 1}
#: Signs that people write, and what they stand for; the largest constant.
WRITTEN = {"×": "*", "÷": "/", "≤": "<=", "≥": ">="}
MOST_CONSTANT = 1e12


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """op: number, name, a sign, neg, a comparison, and, or, not, min, max, abs."""

    op: str
    args: tuple = ()

    @property
    def condition(self) -> bool:
        return self.op in ("and", "or", "not", *COMPARISON.values())

    def names(self) -> set[str]:
        return {self.args[0]} if self.op == "name" else set().union(*(a.names() for a in self.args if isinstance(a, Node)))


def parse(source: str, allowed: set[str], expect: str = "number") -> Node:
    """The checked tree of a formula; ``expect`` is number or condition."""
    if len(source) > MOST_CHARACTERS:
        raise FormulaError(f"more than {MOST_CHARACTERS} characters")
    for sign, plain in WRITTEN.items():
        source = source.replace(sign, plain)
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as error:
        raise FormulaError(f"not a formula: {error.msg}") from None
    except (ValueError, RecursionError, MemoryError):  # a NUL character; brackets nested too deeply
        raise FormulaError("not a formula") from None
    if sum(not isinstance(n, (ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.expr_context)) for n in ast.walk(tree)) > MOST_NODES:
        raise FormulaError(f"more than {MOST_NODES} parts")

    def number(n: ast.AST) -> Node:
        out = read(n)
        if out.condition:
            raise FormulaError("a condition stands where a number is needed")
        return out

    def condition(n: ast.AST) -> Node:
        out = read(n)
        if not out.condition:
            raise FormulaError("a number stands where a condition is needed")
        return out

    def read(n: ast.AST) -> Node:
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            if not n.value <= MOST_CONSTANT:
                raise FormulaError(f"a number is above {MOST_CONSTANT:g}")
            return Node("number", (n.value,))
        if isinstance(n, ast.Name):
            if n.id not in allowed:
                raise FormulaError(f"unknown name {n.id}")
            return Node("name", (n.id,))
        if isinstance(n, ast.BinOp) and type(n.op) in ARITHMETIC:
            return Node(ARITHMETIC[type(n.op)], (number(n.left), number(n.right)))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return Node("neg", (number(n.operand),))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd):
            return number(n.operand)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return Node("not", (condition(n.operand),))
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in COMPARISON:
            return Node(COMPARISON[type(n.ops[0])], (number(n.left), number(n.comparators[0])))
        if isinstance(n, ast.BoolOp):
            return Node("and" if isinstance(n.op, ast.And) else "or", tuple(condition(v) for v in n.values))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in CALLS and not n.keywords:
            if len(n.args) != CALLS[n.func.id]:
                raise FormulaError(f"wrong number of arguments for {n.func.id}")
            return Node(n.func.id, tuple(number(a) for a in n.args))
        raise FormulaError(f"{type(n).__name__} is not allowed")

    out = read(tree)
    if out.condition != (expect == "condition"):
        raise FormulaError(f"a {expect} is needed")
    return out


def to_column(node: Node, columns: dict[str, Column]) -> Column:
    a = [to_column(x, columns) if isinstance(x, Node) else x for x in node.args]
    if node.op == "number":
        return F.lit(float(a[0]))
    if node.op == "name":
        return columns[a[0]].cast("double")
    if node.op == "/":
        return F.when(a[1] != 0, a[0] / a[1])
    if node.op in DO:
        return DO[node.op](a[0], a[1])
    if node.op == "neg":
        return -a[0]
    if node.op == "not":
        return ~a[0]
    if node.op in ("and", "or"):
        out = a[0]
        for x in a[1:]:
            out = out & x if node.op == "and" else out | x
        return out
    return {"min": least_known, "max": greatest_known, "abs": F.abs}[node.op](*a)


def to_sql(node: Node, columns: dict[str, str]) -> str:
    a = [to_sql(x, columns) if isinstance(x, Node) else x for x in node.args]
    if node.op == "number":
        return f"CAST({a[0]!r} AS DOUBLE)"
    if node.op == "name":
        return f"CAST({columns[a[0]]} AS DOUBLE)"
    if node.op == "/":
        return f"({a[0]} / NULLIF({a[1]}, 0))"
    if node.op in DO:
        return f"({a[0]} {node.op} {a[1]})"
    if node.op in ("neg", "not"):
        return f"({'-' if node.op == 'neg' else 'NOT '}{a[0]})"
    if node.op in ("and", "or"):
        return "(" + f" {node.op.upper()} ".join(a) + ")"
    if node.op == "abs":
        return f"abs({a[0]})"
    known = " AND ".join(f"({x}) IS NOT NULL" for x in a)
    return f"(CASE WHEN {known} THEN {'least' if node.op == 'min' else 'greatest'}({', '.join(a)}) END)"


def evaluate(node: Node, values: dict[str, float | None]) -> float | bool | None:
    a = [evaluate(x, values) if isinstance(x, Node) else x for x in node.args]
    if node.op == "number":
        return float(a[0])
    if node.op == "name":
        return None if values[a[0]] is None else float(values[a[0]])
    if node.op == "and":
        return False if False in a else None if None in a else True
    if node.op == "or":
        return True if True in a else None if None in a else False
    if None in a:
        return None
    if node.op == "/":
        return a[0] / a[1] if a[1] else None
    if node.op in DO:
        return DO[node.op](a[0], a[1])
    return {"neg": operator.neg, "not": operator.not_, "min": min, "max": max, "abs": abs}[node.op](*a)


def to_text(node: Node, labels: dict[str, str] | None = None) -> str:
    """The formula in words, names by their labels."""
    a = [to_text(x, labels) if isinstance(x, Node) else x for x in node.args]
    if node.op == "number":
        return f"{a[0]:g}"
    if node.op == "name":
        return (labels or {}).get(a[0], a[0])
    if node.op in ("neg", "not"):
        return f"-{a[0]}" if node.op == "neg" else f"not ({a[0]})"
    if node.op in CALLS:
        return f"{node.op}({', '.join(a)})"
    if node.op in ("and", "or"):
        return f" {node.op} ".join(f"({x})" for x in a)
    inner = [f"({t})" if isinstance(x, Node) and x.op in ARITHMETIC.values() and node.op in ARITHMETIC.values() else t for x, t in zip(node.args, a)]
    return f" {node.op} ".join(inner)
