"""The selection language: pandas-style strings become Catalyst expressions.

The text is tokenised, so that string literals are never touched; `&`, `|` and
`~` bind like `and`, `or` and `not`. Python's parser gives the tree, of which
only known nodes are accepted. Nothing is evaluated; what can't be compiled
raises QueryError.
"""

from __future__ import annotations

import ast
import io
import math
import tokenize
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar


class QueryError(ValueError):
    """A selection that can't be compiled."""


_WORDS = {"&": "and", "|": "or", "~": "not", "&&": "and", "||": "or"}
_CONSTANTS = {"pi": math.pi, "e": math.e}
_VARIABLE = "__variable_"

_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Gt: lambda a, b: a > b,
    ast.Lt: lambda a, b: a < b,
    ast.GtE: lambda a, b: a >= b,
    ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}
_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: scalar.safe_div,
    ast.FloorDiv: scalar.floor_div,
    ast.Mod: scalar.floor_mod,
    ast.Pow: lambda a, b: F.pow(a, b),
}
_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "round": lambda x, n=None: F.round(x, _literal(n) if n is not None else 0),
    "floor": F.floor,
    "ceil": F.ceil,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": F.ln,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "min": lambda *x: F.least(*x),
    "max": lambda *x: F.greatest(*x),
}
_METHODS: dict[str, Callable[..., Column]] = {
    "contains": lambda c, p: c.rlike(p),
    "startswith": lambda c, p: c.startswith(p),
    "endswith": lambda c, p: c.endswith(p),
    "lower": F.lower,
    "upper": F.upper,
    "strip": F.trim,
    "len": F.length,
    "slice": lambda c, start, size=None: F.substring(c, start + 1, size if size is not None else 1 << 30),
    "replace": lambda c, old, new: F.regexp_replace(c, old, new),
    "isna": lambda c: c.isNull(),
    "isnull": lambda c: c.isNull(),
    "notna": lambda c: c.isNotNull(),
    "notnull": lambda c: c.isNotNull(),
}


def _literal(value):
    return value


def _rewritten(text: str) -> str:
    out, variable = [], False
    try:
        for t in tokenize.generate_tokens(io.StringIO(text.strip()).readline):
            if t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT):
                continue
            if t.string == "@":
                variable = True
                continue
            if variable:
                if t.type != tokenize.NAME:
                    raise QueryError(f"a name is missing after @ in {text!r}")
                out.append(_VARIABLE + t.string)
                variable = False
            else:
                out.append(_WORDS.get(t.string, t.string) if t.type == tokenize.OP else t.string)
    except (tokenize.TokenError, SyntaxError) as error:
        raise QueryError(f"{text!r}: {error}") from error
    return " ".join(out)


def parse(text: str) -> ast.expr:
    source = _rewritten(text)
    try:
        return ast.parse(source, mode="eval").body
    except SyntaxError as error:
        raise QueryError(f"{text!r}: {error.msg}") from error


class _Compiler:
    def __init__(self, text: str, columns: Iterable[str] | None, variables: Mapping[str, object]):
        self.text, self.variables = text, variables
        self.columns = None if columns is None else set(columns)

    def fail(self, node: ast.AST, why: str = "isn't supported") -> QueryError:
        return QueryError(f"{ast.unparse(node)!r} {why} in {self.text!r}")

    def constant(self, node: ast.expr):
        """The Python value of a literal, a variable or a signed number."""
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool, type(None))):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.constant(node.operand)
        if isinstance(node, ast.Name) and node.id.startswith(_VARIABLE):
            name = node.id.removeprefix(_VARIABLE)
            if name not in self.variables:
                raise QueryError(f"no value for @{name} in {self.text!r}")
            return self.variables[name]
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return [self.constant(x) for x in node.elts]
        raise self.fail(node, "is no literal")

    def __call__(self, node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            name = node.id
            if name.startswith(_VARIABLE):
                return F.lit(self.constant(node))
            if name in _CONSTANTS and (self.columns is None or name not in self.columns):
                return F.lit(_CONSTANTS[name])
            if self.columns is not None and name not in self.columns:
                raise KeyError(name)
            return F.col(f"`{name}`")
        if isinstance(node, ast.Constant):
            return F.lit(self.constant(node))
        if isinstance(node, ast.BoolOp):
            both = (lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b)
            return reduce(both, map(self, node.values))
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.Not):
                return ~self(node.operand)
            if isinstance(node.op, ast.USub):
                return -self(node.operand)
            if isinstance(node.op, ast.UAdd):
                return self(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](self(node.left), self(node.right))
        if isinstance(node, ast.Compare):
            return self.comparison(node)
        if isinstance(node, ast.Call) and not node.keywords:
            return self.call(node)
        if isinstance(node, ast.Attribute) and node.attr in _METHODS:  # a predicate without parentheses
            return _METHODS[node.attr](self(self.owner(node)))
        raise self.fail(node)

    def comparison(self, node: ast.Compare) -> Column:
        pairs, left = [], node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                found = self(left).isin(list(self.constant(right)))
                pairs.append(found if isinstance(op, ast.In) else ~found)
            elif isinstance(op, (ast.Is, ast.IsNot, ast.Eq, ast.NotEq)) and isinstance(right, ast.Constant) and right.value is None:
                pairs.append(self(left).isNull() if isinstance(op, (ast.Is, ast.Eq)) else self(left).isNotNull())
            elif type(op) in _COMPARE:
                pairs.append(_COMPARE[type(op)](self(left), self(right)))
            else:
                raise self.fail(node)
            left = right
        return reduce(lambda a, b: a & b, pairs)

    @staticmethod
    def owner(node: ast.Attribute) -> ast.expr:
        """The column before a method, with or without `.str` between."""
        value = node.value
        return value.value if isinstance(value, ast.Attribute) and value.attr == "str" else value

    def call(self, node: ast.Call) -> Column:
        if isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS:
            if node.func.id == "round" and len(node.args) == 2:
                return F.round(self(node.args[0]), self.constant(node.args[1]))
            return _FUNCTIONS[node.func.id](*map(self, node.args))
        if isinstance(node.func, ast.Attribute) and node.func.attr in _METHODS:
            return _METHODS[node.func.attr](self(self.owner(node.func)), *map(self.constant, node.args))
        raise self.fail(node)


def compile_query(text: str, columns: Iterable[str] | None = None, /, **variables: object) -> Column:
    """The Column that a selection string stands for.

    With `columns`, an unknown name raises KeyError, and `pi` and `e` are
    constants only where no column has that name. @name takes the keyword's value.
    """
    return _Compiler(text, columns, variables)(parse(text))


def query_columns(text: str) -> list[str]:
    """Names that a selection refers to, in order, constants and functions left out."""
    tree, called = parse(text), set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            called.add(id(node.func))
    names = [n for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called]
    names.sort(key=lambda n: (n.lineno, n.col_offset))
    return list(dict.fromkeys(n.id for n in names if not n.id.startswith(_VARIABLE) and n.id not in _CONSTANTS))


def conjuncts(text: str) -> list[str]:
    """The conditions that a selection joins by `and` at its top."""

    def split(node: ast.expr) -> list[ast.expr]:
        if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
            return [x for v in node.values for x in split(v)]
        return [node]

    return [ast.unparse(n).replace(_VARIABLE, "@") for n in split(parse(text))]


def complexity(text: str) -> dict[str, object]:
    """A score of a selection's size, and what it says about the cost."""
    nodes = list(ast.walk(parse(text)))
    count = lambda kind: sum(isinstance(n, kind) for n in nodes)
    score = 0.1 * len(nodes) + count(ast.Compare) + 1.5 * count(ast.BoolOp) + 2 * count(ast.Call) + 0.5 * count(ast.Constant)
    return {"score": score, "level": "high" if score > 50 else "medium" if score > 20 else "low", "columns": query_columns(text)}


def suggestions(text: str) -> list[str]:
    """Hints for a faster selection."""
    found, parts = [], conjuncts(text)
    nodes = list(ast.walk(parse(text)))
    if len(parts) > 1 and any("(" in p for p in parts[:-1]):
        found.append("put plain comparisons with literals first; only they reach the file scan")
    if any(isinstance(n, ast.Call) for n in nodes):
        found.append("functions of columns aren't pushed down to the files; compare the bare column where possible")
    if any(isinstance(n, ast.BoolOp) and isinstance(n.op, ast.Or) and len(n.values) > 3 for n in nodes):
        found.append("use `in [...]` for many alternatives of one column")
    return found
