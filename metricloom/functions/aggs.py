"""Measure expressions: builders that return SQL text, and the aggregate calls inside such text.

A measure is SQL over a group, such as `SUM(amount) FILTER (WHERE s = 'A') / NULLIF(COUNT(1), 0)`.
`lift` separates the aggregate calls from the arithmetic around them. Each call can then be kept as
partial values at a fine grain and merged later: over a coarser group, a window or after a join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------- builders


def sum_(col: str) -> str:
    return f"SUM({col})"


def count_(col: str) -> str:
    return f"COUNT({col})"


def count_rows() -> str:
    return "COUNT(1)"


def distinct_count(col: str) -> str:
    return f"COUNT(DISTINCT {col})"


def approx_distinct(col: str) -> str:
    """Approximate distinct count, for plain queries; windows and subtotals count exactly."""
    return f"APPROX_COUNT_DISTINCT({col})"


def avg_(col: str) -> str:
    return f"AVG({col})"


def min_(col: str) -> str:
    return f"MIN({col})"


def max_(col: str) -> str:
    return f"MAX({col})"


sumx, avgx, minx, maxx = sum_, avg_, min_, max_


def measure(name: str) -> str:
    """Reference to another measure of the same view."""
    return f"[{name}]"


def case_when(branches: Sequence[tuple[str, str]], default: str = "NULL") -> str:
    """Nested IF: the first true condition wins."""
    arms = " ".join(f"WHEN {cond} THEN {value}" for cond, value in branches)
    return f"CASE {arms} ELSE {default} END"


switch = case_when


def kpi_status(value: str, steps: Sequence[tuple[float, str]], default: str) -> str:
    """Traffic light over a measure: label of the first threshold it exceeds."""
    branches = [(f"({value}) > {limit}", quoted(label)) for limit, label in steps]
    return case_when(branches, quoted(default))


def quoted(value: object) -> str:
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def divide(num: str, den: str, alternate: str | None = None) -> str:
    """Safe ratio: NULL (or the alternate) when the denominator is zero."""
    ratio = f"CAST(({num}) AS DOUBLE) / NULLIF(CAST(({den}) AS DOUBLE), 0)"
    return ratio if alternate is None else f"COALESCE({ratio}, {alternate})"


def ratio(num: str, den: str, else_: str | None = None) -> str:
    """`IIF(den > 0, num / den, else)`; without `else_` a plain safe ratio."""
    if else_ is None:
        return divide(num, den)
    return f"CASE WHEN ({den}) > 0 THEN {divide(num, den)} ELSE {else_} END"


def diff(a: str, b: str) -> str:
    return f"({a}) - ({b})"


def margin(a: str, b: str) -> str:
    """`(a - b) / a`."""
    return divide(diff(a, b), a)


def weighted_avg(value: str, weight: str) -> str:
    return divide(sum_(f"({value}) * ({weight})"), sum_(weight))


def let(variables: Mapping[str, str], expr: str) -> str:
    """VAR ... RETURN: named sub-expressions used in a final one."""
    for name, value in variables.items():
        expr = re.sub(rf"\b{re.escape(name)}\b", lambda _: f"({value})", expr)
    return expr


# ---------------------------------------------------------------- aggregate calls in text

_CALL = re.compile(r"\b(SUM|COUNT|AVG|MIN|MAX|APPROX_COUNT_DISTINCT)\s*\(", re.IGNORECASE)
_DISTINCT = re.compile(r"\s*DISTINCT\b", re.IGNORECASE)
_FILTER = re.compile(r"\s*FILTER\s*\(\s*WHERE\b", re.IGNORECASE)
_QUOTED = re.compile(r"'(?:[^']|'')*'|`[^`]*`")
_OVER = re.compile(r"\bOVER\s*\(", re.IGNORECASE)
REFERENCE = re.compile(r"\[Measures\]\.\[([^\]]+)\]|(?<![\w'\].])\[([^\]]+)\]")


@dataclass(frozen=True)
class Agg:
    """One aggregate call: function, argument, DISTINCT flag and filter conditions."""

    fn: str
    arg: str
    distinct: bool = False
    where: tuple[str, ...] = ()

    def sql(self) -> str:
        call = f"{self.fn}({'DISTINCT ' if self.distinct else ''}{self.arg})"
        return f"{call} FILTER (WHERE {' AND '.join(self.where)})" if self.where else call

    def input(self) -> str:
        """Row-level value the call aggregates; NULL where its filter does not hold."""
        arg = "1" if self.arg.strip() == "*" else self.arg
        if not self.where:
            return arg
        return f"CASE WHEN {' AND '.join(f'({w})' for w in self.where)} THEN {arg} END"

    @property
    def mergeable(self) -> bool:
        return not self.distinct and self.fn != "APPROX_COUNT_DISTINCT"

    def partials(self, col: Column) -> dict[str, Column]:
        """Values kept at a fine grain, from the input column."""
        if not self.mergeable:
            raise ValueError(f"{self.sql()} cannot be merged from parts")
        if self.fn == "AVG":
            return {"s": F.sum(col), "n": F.count(col)}
        return {{"SUM": "s", "COUNT": "n", "MIN": "lo", "MAX": "hi"}[self.fn]: self.direct(col)}

    def merge(self, part: str, col: Column) -> Column:
        return {"s": F.sum, "n": F.sum, "lo": F.min, "hi": F.max}[part](col)

    def finish(self, cols: Mapping[str, Column]) -> Column:
        """Value of the call from its merged parts."""
        if self.fn == "AVG":
            return F.try_divide(cols["s"].cast("double"), cols["n"])
        if self.fn == "COUNT" or not self.mergeable:
            return F.coalesce(next(iter(cols.values())), F.lit(0))
        return next(iter(cols.values()))

    def direct(self, col: Column) -> Column:
        """The call evaluated in a single aggregation."""
        if self.fn == "COUNT":
            return F.count_distinct(col) if self.distinct else F.count(col)
        if self.fn == "APPROX_COUNT_DISTINCT":
            return F.approx_count_distinct(col)
        if self.distinct:
            raise ValueError(f"DISTINCT is supported for COUNT only: {self.sql()}")
        if self.fn == "AVG":
            return F.try_divide(F.sum(col).cast("double"), F.count(col))
        return {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[self.fn](col)


def _closing(text: str, start: int) -> int:
    """Position of the parenthesis that closes the one before `start`."""
    depth = 1
    for i in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return i
    raise ValueError(f"unbalanced parentheses: {text}")


def lift(expr: str) -> list[str | Agg]:
    """Split an expression into plain text and the aggregate calls in it."""
    bare = _QUOTED.sub(lambda m: "_" * len(m.group()), expr)
    parts: list[str | Agg] = []
    pos = 0
    while call := _CALL.search(bare, pos):
        parts.append(expr[pos : call.start()])
        end = _closing(bare, call.end())
        mark = _DISTINCT.match(bare, call.end())
        arg = expr[mark.end() if mark else call.end() : end].strip()
        pos = end + 1
        where: tuple[str, ...] = ()
        if cond := _FILTER.match(bare, pos):
            end = _closing(bare, cond.end())
            where = (expr[cond.end() : end].strip(),)
            pos = end + 1
        parts.append(Agg(call.group(1).upper(), arg, bool(mark), where))
    parts.append(expr[pos:])
    return [p for p in parts if p != ""]


_OPERAND = re.compile(r"\s*[+-]?\s*(?:`[^`]*`|[\w.]+)?")


def guard_division(expr: str) -> str:
    """Every plain division by NULLIF(divisor, 0): a zero divisor gives NULL and never an error."""
    bare = _QUOTED.sub(lambda m: "_" * len(m.group()), expr)
    out, pos = [], 0
    while (at := bare.find("/", pos)) >= 0:
        end = _OPERAND.match(bare, at + 1).end()
        if bare[end : end + 1] == "(":
            end = _closing(bare, end + 1) + 1
        divisor = expr[at + 1 : end].strip()
        number = re.fullmatch(r"[0-9.]*[1-9][0-9.]*", divisor)
        safe = divisor if number or re.match(r"(?i)NULLIF\s*\(", divisor) else f"NULLIF({guard_division(divisor)}, 0)"
        out += [expr[pos:at], "/ ", safe]
        pos = end
    return "".join([*out, expr[pos:]])


def aggregates(expr: str) -> list[Agg]:
    return [p for p in lift(expr) if isinstance(p, Agg)]


def has_aggregate(expr: str) -> bool:
    return bool(aggregates(expr))


def has_over(expr: str) -> bool:
    return bool(_OVER.search(_QUOTED.sub("''", expr)))


def filtered(expr: str, *conditions: str) -> str:
    """Add conditions to every aggregate call; conditions already there are kept (AND).

    A reference `[M]` becomes `[M] FILTER (WHERE ...)`, applied once the reference is inlined.
    """
    clause = " AND ".join(_wrapped(c) for c in conditions)
    out = []
    for part in lift(expr):
        if isinstance(part, Agg):
            part = replace(part, where=(*part.where, clause)).sql()
        else:
            part = REFERENCE.sub(lambda m: f"{m.group()} FILTER (WHERE {clause})", part)
        out.append(part)
    return "".join(out)


def _wrapped(condition: str) -> str:
    """The condition in one pair of parentheses."""
    bare = _QUOTED.sub(lambda m: "_" * len(m.group()), condition)
    if bare.startswith("(") and _closing(bare, 1) == len(bare) - 1:
        return condition
    return f"({condition})"


def inline(expr: str, lookup: Callable[[str], str]) -> str:
    """Replace references by `(expression)`, filtered where the reference is."""
    out, pos = [], 0
    for ref in REFERENCE.finditer(expr):
        inner = lookup(ref.group(1) or ref.group(2))
        out.append(expr[pos : ref.start()])
        pos = ref.end()
        while cond := _FILTER.match(expr, pos):
            end = _closing(_QUOTED.sub(lambda m: "_" * len(m.group()), expr), cond.end())
            inner = filtered(inner, expr[cond.end() : end].strip())
            pos = end + 1
        out.append(f"({inner})")
    return "".join([*out, expr[pos:]])


def tuple_filter(expr: str, members: Mapping[str, object]) -> str:
    """`([Col].&[member], ..., measure)`: one equality per column."""
    return filtered(expr, *[f"{col} = {quoted(value)}" for col, value in members.items()])


def member_filter(expr: str, col: str, member: object) -> str:
    return tuple_filter(expr, {col: member})


def share(condition: str, expr: str) -> str:
    """Part of a measure that satisfies a condition, as a ratio."""
    return divide(filtered(expr, condition), expr)
