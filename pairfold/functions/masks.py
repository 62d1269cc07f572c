"""Row selections as Columns: numbers by ranges, names by patterns, two levels, set operations by & | ~.

A selection is an ordinary predicate, so that it reaches the scan.

``parsed`` reads selections as text: ``:`` and the numbers or names of a group, ``@`` and those of an
item, ``:group@item`` for both, ``*`` for everything, and ``!``, ``&``, ``|`` and parentheses, of which
``!`` binds most and ``|`` least.
"""

from __future__ import annotations

import ast
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(column: str | Column, ranges: str) -> Column:
    """``"1-10,15"``: 1-based inclusive ranges; each must run upwards."""
    c = F.col(column) if isinstance(column, str) else column
    parts = []
    for part in ranges.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", part)
        if not m:
            raise ValueError(f"not a number or range: {part!r}")
        first, last = int(m[1]), int(m[2] or m[1])
        if first < 1 or last < first:
            raise ValueError(f"a range runs from 1 or more upwards: {part!r}")
        parts.append(c.between(first, last) if last > first else c == first)
    return reduce(Column.__or__, parts)


def names(column: str | Column, *patterns: str) -> Column:
    """Names, with * for any run of characters and ? for one."""
    c = F.col(column) if isinstance(column, str) else column
    if not patterns:
        raise ValueError("a selection by name needs a name")
    plain = [p for p in patterns if not re.search(r"[*?]", p)]
    globs = ["^" + "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in p) + "$" for p in patterns if re.search(r"[*?]", p)]
    parts = ([c.isin(*plain)] if plain else []) + [c.rlike(g) for g in globs]
    return reduce(Column.__or__, parts)


def everything() -> Column:
    return F.lit(True)


#: A list of numbers, ranges and patterns, and a level or two of them.
_ITEMS = r"[^,&|!()@:\s]+(?:\s*,\s*[^,&|!()@:\s]+)*"
_LEVELS = re.compile(rf":\s*(?P<group>{_ITEMS})\s*(?:@\s*(?P<item>{_ITEMS}))?|@\s*(?P<only>{_ITEMS})")


def _listed(number: str | Column, name: str | Column, items: str) -> Column:
    parts = []
    for item in re.split(r"\s*,\s*", items):
        parts.append(numbers(number, item) if item[0].isdigit() else names(name, item))
    return reduce(Column.__or__, parts)


def parsed(text: str, group: tuple[str | Column, str | Column], item: tuple[str | Column, str | Column]) -> Column:
    """The predicate of a selection; ``group`` and ``item`` are the columns of numbers and names of the two levels."""
    found: list[Column] = []

    def level(m: re.Match) -> str:
        parts = [_listed(*columns, items) for columns, items in ((group, m["group"]), (item, m["item"] or m["only"])) if items]
        found.append(reduce(Column.__and__, parts))
        return f" s{len(found)} "

    if not re.fullmatch(r"[\s*!&|()]*", _LEVELS.sub("", text)):
        raise ValueError(f"not a selection: {text!r}")
    rest = _LEVELS.sub(level, text)
    try:
        tree = ast.parse(" ".join(rest.replace("*", " s0 ").replace("!", "~").split()), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not a selection: {text!r}") from e

    def make(node: ast.expr) -> Column:
        match node:
            case ast.Name(id=name):
                return found[int(name[1:]) - 1] if name != "s0" else everything()
            case ast.UnaryOp(op=ast.Invert(), operand=inner):
                return ~make(inner)
            case ast.BinOp(left=a, op=ast.BitAnd(), right=b):
                return make(a) & make(b)
            case ast.BinOp(left=a, op=ast.BitOr(), right=b):
                return make(a) | make(b)
        raise ValueError(f"not a selection: {text!r}")

    return make(tree)


def chosen(default, *cases: tuple[Column, object]) -> Column:
    """Per-row parameters by selection; later cases win over earlier ones."""
    out = F.lit(default)
    for mask, value in cases:
        out = F.when(mask, F.lit(value)).otherwise(out)
    return out
