"""Declarations: dimensions, measures, joins, windows and the metric view that holds them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession

from metricloom.functions import aggs
from metricloom.functions.text import WINDOW_UNITS

Source = str | DataFrame
Condition = str | Column

_RANGE = re.compile(
    r"(current|cumulative|all)|(trailing|leading) (\d+) (" + "|".join(WINDOW_UNITS) + ")"
)


@dataclass(frozen=True)
class Dimension:
    """A group column: any expression over the joined row, without aggregates.

    `period_of` names the dimension this one is a period of (year of a date). It is found by itself
    when both come from the same join or the expression contains the other one.
    """

    name: str
    expr: str
    comment: str | None = None
    period_of: str | None = None


@dataclass(frozen=True)
class Window:
    """Window entry of a measure: current, cumulative, all, trailing/leading N unit."""

    order: str
    range: str
    semiadditive: str = "last"
    include_anchor: bool = False

    @property
    def normal_range(self) -> str:
        text = self.range.strip().replace("_", " ")
        for unit in WINDOW_UNITS:
            text = re.sub(rf"\b{unit}s\b", unit, text)
        if not _RANGE.fullmatch(text):
            raise ValueError(f"unknown window range: {self.range}")
        return text

    @property
    def span(self) -> tuple[str, int, str] | None:
        """(trailing or leading, N, unit)."""
        _, side, n, unit = _RANGE.fullmatch(self.normal_range).groups()
        return (side, int(n), unit) if side else None


@dataclass(frozen=True)
class Measure:
    name: str
    expr: str
    comment: str | None = None
    window: tuple[Window, ...] = ()


@dataclass(frozen=True)
class Join:
    """Many-to-one left join. `on` speaks of `source` and join names.

    `alternates` holds further named conditions for the same dimension. `large` tells whether the
    dimension is too large for a broadcast; by default Spark's size estimate decides. Facts are
    aggregated before they meet a large dimension, see `plans.cells`.
    """

    name: str
    source: Source
    on: str | None = None
    using: tuple[str, ...] = ()
    alternates: Mapping[str, str] = field(default_factory=dict)
    large: bool | None = None

    def condition(self, relationship: str | None = None) -> str:
        if relationship in self.alternates:
            return self.alternates[relationship]
        if self.on:
            return self.on
        if not self.using:
            raise ValueError(f"join {self.name} has neither `on` nor `using`")
        return " AND ".join(f"source.`{k}` = {self.name}.`{k}`" for k in self.using)

    @classmethod
    def from_keys(cls, table: str, join_key: str, dim_key: str, **kw) -> Join:
        alias = table.split(".")[-1]
        return cls(alias, table, f"source.{join_key} = {alias}.{dim_key}", **kw)


@dataclass(frozen=True)
class Warning:
    measure_name: str
    expression: str
    warning_type: str
    message: str


def mentions(text: str, name: str) -> bool:
    """The text uses the name as an identifier (outside string literals)."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    plain = rf"(?<![\w.`]){re.escape(name)}(?![\w`(])"
    return f"`{name}`" in bare or bool(re.search(plain, bare, re.IGNORECASE))


def qualifiers(text: str) -> set[str]:
    """Names that stand before a dot (`customer.name`), outside string literals."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    return set(re.findall(r"(?<![\w.])(\w+)`?\.", bare.replace("`", "")))


def hierarchy(name: str, levels: Sequence[tuple[str, str]]) -> list[Dimension]:
    """One dimension per level (Q8); `shares.hierarchy_rollup` gives their subtotals."""
    return [Dimension(level, expr, comment=f"{name} level {i + 1}") for i, (level, expr) in enumerate(levels)]


@dataclass(frozen=True)
class MetricView:
    name: str
    source: Source
    joins: tuple[Join, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    measures: tuple[Measure, ...] = ()
    filter: str | None = None
    comment: str | None = None
    declared_version: str | None = None

    # ------------------------------------------------------------ lookups

    def dim(self, d: str | Dimension) -> Dimension:
        if isinstance(d, Dimension):
            return d
        found = [x for x in self.dimensions if x.name == d]
        if not found:
            raise KeyError(f"view {self.name} has no dimension {d}")
        return found[0]

    def measure(self, m: str | Measure) -> Measure:
        """Measure with references inlined and window entries resolved."""
        if isinstance(m, str):
            found = [x for x in self.measures if x.name == m]
            if not found:
                raise KeyError(f"view {self.name} has no measure {m}")
            m = found[0]
        windows = tuple(replace(w, order=self.order_name(w.order)) for w in m.window)
        return replace(m, expr=self.inline(m.expr, (m.name,)), window=windows)

    def inline(self, expr: str, path: tuple[str, ...] = ()) -> str:
        """Replace measure references by the expressions they name (Q9)."""
        known = {m.name: m.expr for m in self.measures}

        def lookup(name: str) -> str:
            if name not in known:
                raise KeyError(f"unknown measure reference [{name}]")
            if name in path:
                raise ValueError(f"circular measure reference: {' -> '.join((*path, name))}")
            return self.inline(known[name], (*path, name))

        return aggs.inline(expr, lookup)

    def order_name(self, order: str) -> str:
        """Dimension meant by a window's `order`: by name, by expression, by containment (Q12)."""
        names = [d.name for d in self.dimensions]
        if order in names:
            return order
        by_expr = [d.name for d in self.dimensions if d.expr == order]
        if by_expr:
            return by_expr[0]
        low = order.lower()
        near = [n for n in names if n.lower() in low or low in n.lower()]
        return min(near, key=lambda n: (-len(n), n)) if near else order

    # ------------------------------------------------------------ checks

    @property
    def version(self) -> str:
        """`0.1` as soon as a measure has a window, else the declared version or `1.1`."""
        if any(m.window for m in self.measures):
            return "0.1"
        return self.declared_version or "1.1"

    def validate(self) -> tuple[MetricView, list[Warning], str]:
        """View without measures that use OVER, the warnings, and the status."""
        for d in self.dimensions:
            if aggs.has_aggregate(d.expr):
                raise ValueError(f"dimension {d.name} must not aggregate: {d.expr}")
        warnings = [
            Warning(m.name, m.expr, "unsupported_dax", "measure uses a SQL window (OVER) and was left out")
            for m in self.measures
            if aggs.has_over(m.expr)
        ]
        kept = tuple(m for m in self.measures if not aggs.has_over(m.expr))
        clean = replace(self, measures=kept)
        for m in kept:
            if not aggs.has_aggregate(clean.inline(m.expr, (m.name,))):
                raise ValueError(f"measure {m.name} must aggregate: {m.expr}")
        return clean, warnings, "partial" if warnings else "success"

    # ------------------------------------------------------------ evaluation

    def query(
        self,
        spark: SparkSession,
        measures: Sequence[str | Measure],
        dims: Sequence[str | Dimension] = (),
        where: Condition | Iterable[Condition] | None = None,
        limit: int | None = None,
        use_relationship: str | None = None,
    ) -> DataFrame:
        """Measures by dimensions, as a DataFrame (Q1-Q6, Q16)."""
        from metricloom.plans.query import run

        return run(self, spark, measures, dims, where, limit, use_relationship)

    # ------------------------------------------------------------ definition documents

    def definition(self) -> dict:
        """The view as a document of plain values (keys as in rendered YAML)."""
        comments = self.version != "0.1"

        def entry(**fields) -> dict:
            return {k: v for k, v in fields.items() if v and (comments or k != "comment")}

        doc = entry(version=self.version, comment=self.comment, source=self.source, filter=self.filter)
        doc["joins"] = [entry(name=j.name, source=j.source, on=j.on, using=list(j.using)) for j in self.joins]
        doc["dimensions"] = [entry(name=d.name, expr=d.expr, comment=d.comment) for d in self.dimensions]
        doc["measures"] = [
            entry(
                name=m.name,
                expr=m.expr,
                comment=m.comment,
                window=[{"order": w.order, "range": w.normal_range, "semiadditive": w.semiadditive} for w in m.window],
            )
            for m in self.measures
        ]
        return {k: v for k, v in doc.items() if v}

    @classmethod
    def from_definition(
        cls, name: str, doc: Mapping, tables: Mapping[str, Source] | None = None, fact: Source | None = None
    ) -> MetricView:
        """View of a definition document; `tables` may stand in for named tables.

        Where the document leaves its source blank, `fact` is the source (Q14).
        """
        if not doc.get("source") and fact is None:
            raise ValueError(f"{name} has no source")
        place = lambda t: (tables or {}).get(t, t)
        joins = [
            Join(j["name"], place(j["source"]), j.get("on"), tuple(j.get("using") or ()))
            for j in doc.get("joins") or ()
        ]
        measures = [
            Measure(
                m["name"],
                m["expr"],
                m.get("comment"),
                tuple(Window(w["order"], w["range"], w.get("semiadditive") or "last") for w in m.get("window") or ()),
            )
            for m in doc["measures"]
        ]
        dims = unique(Dimension(d["name"], d["expr"], d.get("comment")) for d in doc.get("dimensions") or ())
        return cls(
            name, place(doc["source"]) if doc.get("source") else fact, tuple(joins), dims, tuple(measures), doc.get("filter"), doc.get("comment"),
            doc.get("version"),
        )

    # ------------------------------------------------------------ construction from models

    @classmethod
    def from_model(cls, model: Mapping) -> MetricView:
        """View of a tabular model: relationships become joins, attributes become dimensions (Q17).

        `model`: name, fact_table, tables [{name, table, columns}], relationships
        [{from_table, from_column, to_table, to_column}], measures [{name, expr, comment}].
        """
        tables = {t["name"]: t for t in model["tables"]}
        fact = tables[model["fact_table"]]
        joins, dims = [], [Dimension(snake(c), snake(c)) for c in fact.get("columns", ())]
        for rel in model.get("relationships", ()):
            if rel["from_table"] != model["fact_table"] or rel["to_table"] not in tables:
                continue
            to = tables[rel["to_table"]]
            alias = dimension_alias(to["name"])
            on = f"source.{snake(rel['from_column'])} = {alias}.{snake(rel['to_column'])}"
            joins.append(Join(alias, to["table"], on))
            dims += [Dimension(f"{alias}_{snake(c)}", f"{alias}.{snake(c)}") for c in to.get("columns", ())]
        measures = tuple(Measure(**m) for m in model.get("measures", ()))
        source = model.get("source") or fact["table"]
        return cls(f"mv_{model['name']}", source, tuple(joins), unique(dims), measures)

    @classmethod
    def from_cube(cls, cube: Mapping) -> MetricView:
        """View of a cube: attributes and hierarchy levels become dimensions (Q8, Q17).

        `cube`: name, fact {table, columns}, dimensions [{name, table, join_key, dim_key, attributes,
        hierarchies [{name, levels}]}], measures [{name, expr}].
        """
        joins, dims = [], []
        for d in cube.get("dimensions", ()):
            prefix = ""
            alias = dimension_alias(d["name"])
            if d.get("table"):
                joins.append(Join(alias, d["table"], f"source.{d['join_key']} = {alias}.{d['dim_key']}"))
                prefix = f"{alias}."
            levels = [level for h in d.get("hierarchies", ()) for level in h["levels"]]
            for attr in [*d.get("attributes", ()), *levels]:
                name = f"{alias}_{snake(attr)}" if prefix else snake(attr)
                dims.append(Dimension(name, prefix + snake(attr)))
        measures = tuple(Measure(**m) for m in cube.get("measures", ()))
        name = "mv_" + cube["name"].lower().replace(" ", "_")
        return cls(name, cube["fact"]["table"], tuple(joins), unique(dims), measures)


def snake(name: str) -> str:
    edges = r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])"
    return re.sub(edges, "_", name).lower().replace(" ", "_")


def dimension_alias(table: str) -> str:
    """`DimCustomer` -> `customer`."""
    return snake(re.sub(r"^Dim(?=[A-Z])", "", table))


def unique(dims: Iterable[Dimension]) -> tuple[Dimension, ...]:
    """First dimension of each name."""
    return tuple({d.name: d for d in reversed(list(dims))}.values())[::-1]
