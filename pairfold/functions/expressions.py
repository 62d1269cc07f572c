"""Expressions as text: Columns and derivatives of them.

``k/2*(r - r0)^2; r0 = 1.2*s`` holds sums, products, signs, powers and calls, and definitions after
semicolons, which may use each other in any order. A sign binds less than a power before it and may
stand behind one: ``-a^-b`` is ``-(a^(-b))``, and powers group from the right. Python's own parser
reads the text; what comes out is an ordinary Column, so that Catalyst folds and pushes it down.

Functions: sqrt exp log sin cos tan sec csc cot asin acos atan sinh cosh tanh abs floor ceil erf erfc
step delta square cube recip min max atan2 select, with the meaning of pairfold.functions.scalars, and
those that are given by name, such as tabulated ones or distance, angle and dihedral of points.
"""

from __future__ import annotations

import ast
import copy
import math
import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairfold.functions import geometry, scalars

FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "sqrt": (1, scalars.sqrt), "exp": (1, F.exp), "log": (1, scalars.log), "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "sec": (1, scalars.sec), "csc": (1, scalars.csc), "cot": (1, scalars.cot),
    "asin": (1, F.asin), "acos": (1, F.acos), "atan": (1, F.atan), "sinh": (1, F.sinh), "cosh": (1, F.cosh), "tanh": (1, F.tanh), "abs": (1, F.abs), "floor": (1, scalars.floor), "ceil": (1, scalars.ceil),
    "erf": (1, scalars.erf), "erfc": (1, scalars.erfc), "step": (1, scalars.step), "delta": (1, scalars.delta), "square": (1, scalars.square), "cube": (1, scalars.cube), "recip": (1, scalars.recip),
    "min": (2, scalars.minimum), "max": (2, scalars.maximum), "atan2": (2, F.atan2), "select": (3, scalars.select),
}

#: The derivative of a function of x, y, z by each of them. Where it jumps, the side that ``step`` takes counts.
SLOPES = {
    "sqrt": ["1/(2*sqrt(x))"], "exp": ["exp(x)"], "log": ["1/x"], "sin": ["cos(x)"], "cos": ["-sin(x)"], "tan": ["1+square(tan(x))"], "sec": ["sec(x)*tan(x)"], "csc": ["-csc(x)*cot(x)"], "cot": ["-square(csc(x))"],
    "asin": ["1/sqrt(1-x*x)"], "acos": ["-1/sqrt(1-x*x)"], "atan": ["1/(1+x*x)"], "sinh": ["cosh(x)"], "cosh": ["sinh(x)"], "tanh": ["1-square(tanh(x))"], "abs": ["2*step(x)-1"], "floor": ["0"], "ceil": ["0"],
    "erf": [f"{2 / math.sqrt(math.pi)!r}*exp(-x*x)"], "erfc": [f"-{2 / math.sqrt(math.pi)!r}*exp(-x*x)"], "step": ["0"], "delta": ["0"], "square": ["2*x"], "cube": ["3*x*x"], "recip": ["-1/(x*x)"],
    "min": ["step(y-x)", "1-step(y-x)"], "max": ["step(x-y)", "1-step(x-y)"], "atan2": ["y/(x*x+y*y)", "-x/(x*x+y*y)"], "select": ["0", "select(x,1,0)", "select(x,0,1)"],
}

_OPERATIONS = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow)


def _tree(text: str) -> ast.expr:
    if re.search(r"[^\w\s.+\-*/^(),]|\*\*|//", text):
        raise ValueError(f"not an expression: {text!r}")
    marked = re.sub(r"(?<![\w.])([A-Za-z_]\w*)", r"v_\1", text.replace("^", "**"))  # no name is a word of Python's
    try:
        tree = ast.parse(" ".join(marked.split()), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            node.id = node.id.removeprefix("v_")
        known = (
            isinstance(node, (ast.Name, ast.Load, ast.operator, ast.unaryop))
            or isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool)
            or isinstance(node, ast.BinOp) and isinstance(node.op, _OPERATIONS)
            or isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd))
            or isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords
        )
        if not known:
            raise ValueError(f"not an expression: {text!r}")
    return tree


class _Replaced(ast.NodeTransformer):
    """Names by trees; ``deep``: also the names in these trees."""

    def __init__(self, values: dict[str, ast.expr], deep: bool = True, open_: tuple[str, ...] = ()) -> None:
        self.values, self.deep, self.open = values, deep, open_

    def visit_Call(self, node: ast.Call) -> ast.Call:
        return ast.Call(node.func, [self.visit(a) for a in node.args], [])

    def visit_Name(self, node: ast.Name) -> ast.expr:
        if node.id in self.open:
            raise ValueError(f"{node.id} is defined by itself")
        if node.id not in self.values:
            return node
        value = self.values[node.id]
        return _Replaced(self.values, True, (*self.open, node.id)).visit(copy.deepcopy(value)) if self.deep else value


def _number(node: ast.expr) -> float | None:
    return float(node.value) if isinstance(node, ast.Constant) else None


def _times(a: ast.expr, b: ast.expr) -> ast.expr:
    if 0 in (_number(a), _number(b)):
        return ast.Constant(0)
    return b if _number(a) == 1 else a if _number(b) == 1 else ast.BinOp(a, ast.Mult(), b)


def _plus(a: ast.expr, b: ast.expr, minus: bool = False) -> ast.expr:
    if _number(b) == 0:
        return a
    if _number(a) == 0:
        return ast.UnaryOp(ast.USub(), b) if minus else b
    return ast.BinOp(a, ast.Sub() if minus else ast.Add(), b)


def _call(name: str, *args: ast.expr) -> ast.expr:
    return ast.Call(ast.Name(name), list(args), [])


def _slope(node: ast.expr, name: str) -> ast.expr:
    """The derivative of a tree by a name."""
    if isinstance(node, ast.Constant):
        return ast.Constant(0)
    if isinstance(node, ast.Name):
        return ast.Constant(int(node.id == name))
    if isinstance(node, ast.UnaryOp):
        inner = _slope(node.operand, name)
        return inner if isinstance(node.op, ast.UAdd) or _number(inner) == 0 else ast.UnaryOp(ast.USub(), inner)
    if isinstance(node, ast.Call):
        if node.func.id not in SLOPES:
            raise ValueError(f"{node.func.id} has no derivative")
        out = ast.Constant(0)
        for rule, arg in zip(SLOPES[node.func.id], node.args, strict=True):
            inner = _slope(arg, name)
            if _number(inner) != 0:
                out = _plus(out, _times(_Replaced(dict(zip("xyz", node.args)), False).visit(_tree(rule)), inner))
        return out
    a, b = node.left, node.right
    da, db = _slope(a, name), _slope(b, name)
    if isinstance(node.op, (ast.Add, ast.Sub)):
        return _plus(da, db, isinstance(node.op, ast.Sub))
    if isinstance(node.op, ast.Mult):
        return _plus(_times(da, b), _times(a, db))
    if isinstance(node.op, ast.Div):
        first = ast.BinOp(da, ast.Div(), b) if _number(da) != 0 else da
        second = _times(ast.BinOp(a, ast.Div(), _call("square", b)), db)
        return _plus(first, second, True)
    power = _times(_times(b, ast.BinOp(a, ast.Pow(), ast.BinOp(b, ast.Sub(), ast.Constant(1)))), da)
    return _plus(power, _times(_times(node, _call("log", a)), db))


class Expression:
    """A parsed expression."""

    def __init__(self, tree: ast.expr) -> None:
        self.tree = tree

    @classmethod
    def parse(cls, text: str) -> Expression:
        first, *rest = text.split(";")
        definitions = {}
        for part in filter(str.strip, rest):
            name, equals, value = part.partition("=")
            if not equals or not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name) or name.strip() in definitions:
                raise ValueError(f"not a definition: {part!r}")
            definitions[name.strip()] = _tree(value)
        return cls(_Replaced(definitions).visit(_tree(first)))

    @cached_property
    def names(self) -> list[str]:
        """Free names in the order of their first use."""
        found: dict[str, None] = {}

        def look(node: ast.expr) -> None:
            if isinstance(node, ast.Name):
                found[node.id] = None
            for child in node.args if isinstance(node, ast.Call) else ast.iter_child_nodes(node):
                look(child)

        look(self.tree)
        return list(found)

    def derivative(self, name: str) -> Expression:
        return Expression(_slope(self.tree, name))

    def column(self, values: dict[str, Column | float] | None = None, functions: dict[str, Callable[..., Column]] | None = None) -> Column:
        """The Column; names that ``values`` does not give are columns of the table."""
        values, own = values or {}, functions or {}

        def make(node: ast.expr) -> Column:
            if isinstance(node, ast.Constant):
                return F.lit(float(node.value))
            if isinstance(node, ast.Name):
                x = values.get(node.id, None)
                return F.col(node.id).cast("double") if x is None else x if isinstance(x, (Column, tuple)) else F.lit(float(x))
            if isinstance(node, ast.UnaryOp):
                return -make(node.operand) if isinstance(node.op, ast.USub) else make(node.operand)
            if isinstance(node, ast.Call):
                name, args = node.func.id, [make(a) for a in node.args]
                if name in own:
                    return own[name](*args)
                if name not in FUNCTIONS:
                    raise ValueError(f"unknown function {name!r}")
                arity, fn = FUNCTIONS[name]
                if len(args) != arity:
                    raise ValueError(f"{name!r} takes {arity} arguments, not {len(args)}")
                return fn(*args)
            a, b = make(node.left), make(node.right)
            match node.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return a / b if _number(node.right) else scalars.divide(a, b)
            return F.pow(a, b)

        return make(self.tree)


#: Coordinates of points, whose names are bound to vectors of Columns.
COORDINATES = {"distance": lambda a, b: geometry.norm(geometry.minus(a, b)), "angle": geometry.angle, "dihedral": geometry.dihedral}


def parsed(text: str, values: dict[str, Column | float] | None = None, functions: dict[str, Callable[..., Column]] | None = None) -> Column:
    """The Column of an expression."""
    return Expression.parse(text).column(values, functions)


def derivative(text: str, name: str, values: dict[str, Column | float] | None = None, functions: dict[str, Callable[..., Column]] | None = None) -> Column:
    """The Column of an expression's derivative by a name."""
    return Expression.parse(text).derivative(name).column(values, functions)
