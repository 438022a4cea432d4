"""Cells: aggregate calls kept as mergeable parts at some grain.

Every operator starts from one pass over the facts that yields cells at the finest grain it needs;
coarser groups, windows and totals are merged from those cells and never read the facts again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.functions.aggs import Agg, guard_division, lift
from metricloom.plans import star
from metricloom.plans.model import Condition, Dimension, Measure, MetricView, mentions, qualifiers
from metricloom.plans.settle import salted_join, settle


def conditions(where: Condition | Iterable[Condition] | None) -> list[Condition]:
    if where is None:
        return []
    return [where] if isinstance(where, (str, Column)) else list(where)


def condition_text(cond: Condition) -> str:
    return cond if isinstance(cond, str) else re.sub(r"^Column<'|'>$", "", str(cond))


def as_column(cond: Condition) -> Column:
    return F.expr(cond) if isinstance(cond, str) else cond


def same(left: Column | str, right: Column | str) -> Column:
    """Null-safe equality."""
    left = F.col(left) if isinstance(left, str) else left
    return left.eqNullSafe(right if isinstance(right, Column) else F.col(right))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join on equally named columns; the left keys are kept.

    Without keys the right side is a one-row total, read as scalar values.
    """
    if not keys:
        return left.withColumns({c: right.select(F.col(f"`{c}`")).scalar() for c in right.columns})
    taken = {k: f"__r_{k}" for k in keys}
    right = right.select(
        *[F.col(f"`{k}`").alias(r) for k, r in taken.items()],
        *[F.col(f"`{c}`") for c in right.columns if c not in taken],
    )
    cond = F.lit(True)
    for k, r in taken.items():
        cond = cond & same(F.col(f"`{k}`"), F.col(f"`{r}`"))
    return left.join(right, cond, how).drop(*taken.values())


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`join_on` for a settled left side of which a few keys may hold most rows.

    The right side has one row per key. Keys are packed into one struct, which is never NULL, and
    hot ones are split over tasks.
    """
    if not keys:
        return join_on(left, right, keys)
    pack = F.struct(*[F.col(f"`{k}`") for k in keys])
    rest = [F.col(f"`{c}`") for c in right.columns if c not in keys]
    joined = salted_join(left.withColumn("__keys", pack), right.select(pack.alias("__keys"), *rest), ["__keys"], "left")
    return joined.drop("__keys")


@dataclass(frozen=True)
class Cells:
    """`df` holds the dimension columns and one column per part of each aggregate call."""

    df: DataFrame
    dims: tuple[str, ...]
    leaves: tuple[Agg, ...]
    measures: tuple[Measure, ...]

    def part_names(self, i: int) -> dict[str, str]:
        leaf = self.leaves[i]
        if not leaf.mergeable:
            return {"v": f"__{i}v"}
        return {p: f"__{i}{p}" for p in leaf.partials(F.lit(None))}

    def _merged(self, i: int) -> dict[str, Column]:
        leaf = self.leaves[i]
        if not leaf.mergeable:
            raise ValueError(f"{leaf.sql()} cannot be merged from finer groups")
        return {name: leaf.merge(p, F.col(name)) for p, name in self.part_names(i).items()}

    def merged(self) -> list[Column]:
        """Aggregations that merge all parts."""
        return [c.alias(n) for i in range(len(self.leaves)) for n, c in self._merged(i).items()]

    @property
    def mergeable(self) -> bool:
        return all(leaf.mergeable for leaf in self.leaves)

    def regroup(self, dims: Sequence[str], extra: Sequence[Column] = ()) -> Cells:
        """Merge to a coarser grain."""
        cols = [*self.merged(), *extra]
        grouped = [F.col(f"`{d}`") for d in dims]
        df = self.df.groupBy(*grouped).agg(*cols) if cols else self.df.select(*grouped).distinct()
        return replace(self, df=df, dims=tuple(dims))

    def _framed(self, i: int, frame: str) -> dict[str, Column]:
        functions = {"s": "sum", "n": "sum", "lo": "min", "hi": "max"}
        self._merged(i)
        return {
            name: F.expr(f"{functions[p]}({name}) OVER ({frame})")
            for p, name in self.part_names(i).items()
        }

    def only(self, measures: Sequence[Measure]) -> Cells:
        """The same cells for some of the measures."""
        return replace(self, measures=tuple(measures))

    def settled(self) -> Cells:
        """Written once, so that several branches of a plan read cells and not the facts again."""
        return replace(self, df=settle(self.df))

    def over(self, frame: str, leaves: Iterable[int] | None = None) -> Cells:
        """Merge over a window frame (SQL text); rows stay."""
        chosen = range(len(self.leaves)) if leaves is None else leaves
        cols = {n: c for i in chosen for n, c in self._framed(i, frame).items()}
        return replace(self, df=self.df.withColumns(cols)) if cols else self

    def value(self, measure: Measure) -> Column:
        """Value of a measure from the parts."""
        text = "".join(
            p if isinstance(p, str) else f"__{self.leaves.index(p)}" for p in lift(measure.expr)
        )
        return F.expr(guard_division(text))

    def values(self, keep: Sequence[str] = ()) -> DataFrame:
        """Dimension columns and measure values."""
        used = set(leaves_of(self.measures))
        finished = {
            f"__{i}": leaf.finish({p: F.col(n) for p, n in self.part_names(i).items()})
            for i, leaf in enumerate(self.leaves)
            if leaf in used
        }
        cols = [F.col(f"`{d}`") for d in (*self.dims, *keep)]
        return self.df.withColumns(finished).select(
            *cols, *[self.value(m).alias(m.name) for m in self.measures]
        )


def leaves_of(measures: Sequence[Measure]) -> tuple[Agg, ...]:
    """The different aggregate calls, those that merge first."""
    found = dict.fromkeys(p for m in measures for p in lift(m.expr) if isinstance(p, Agg))
    return tuple(sorted(found, key=lambda leaf: not leaf.mergeable))


def with_filtered_dims(
    mv: MetricView, dims: Sequence[Dimension], where: Sequence[Condition]
) -> list[Dimension]:
    """The dimensions and those that only the conditions name."""
    names = {d.name for d in dims}
    texts = [condition_text(c) for c in where]
    return [*dims, *[d for d in mv.dimensions if d.name not in names and any(mentions(t, d.name) for t in texts)]]


def project(
    mv: MetricView,
    spark: SparkSession,
    leaves: Sequence[Agg],
    dims: Sequence[Dimension],
    relationship: str | None = None,
    only: Sequence[Column] = (),
) -> DataFrame:
    """Fact rows reduced to the dimensions and the inputs `__a0, __a1, ...` of the calls."""
    inputs = [leaf.input() for leaf in leaves]
    df = star.base(mv, spark, [*(d.expr for d in dims), *inputs], relationship, only)
    return df.select(
        *[F.expr(d.expr).alias(d.name) for d in dims],
        *[F.expr(text).alias(f"__a{i}") for i, text in enumerate(inputs)],
    )


def part_columns(leaves: Sequence[Agg]) -> list[Column]:
    cols = []
    for i, leaf in enumerate(leaves):
        col = F.col(f"__a{i}")
        parts = leaf.partials(col) if leaf.mergeable else {"v": leaf.direct(col)}
        cols += [c.alias(f"__{i}{p}") for p, c in parts.items()]
    return cols


def build(
    mv: MetricView,
    spark: SparkSession,
    measures: Sequence[str | Measure],
    dims: Sequence[str | Dimension],
    where: Condition | Iterable[Condition] | None = None,
    relationship: str | None = None,
    leaves: tuple[Agg, ...] | None = None,
) -> Cells:
    """Cells of the measures at the grain of the dimensions, under the conditions.

    `leaves` restricts the aggregate calls that are kept.
    """
    resolved = tuple(mv.measure(m) for m in measures)
    leaves = leaves_of(resolved) if leaves is None else leaves
    grain = [mv.dim(d) for d in dims]
    where = conditions(where)
    shown = with_filtered_dims(mv, grain, where)
    names = tuple(d.name for d in grain)
    only = star.key_conditions(mv, spark, [(c, _named(mv, shown, c)) for c in where], relationship)
    early = _before_large_joins(mv, spark, leaves, shown, where, relationship, only)
    if early is not None:
        additive = tuple(leaf for leaf in leaves if leaf.mergeable)
        counted = [leaf.direct(F.col(f"__a{i}")).alias(f"__{i}v") for i, leaf in enumerate(leaves) if not leaf.mergeable]
        cells = Cells(early, tuple(d.name for d in shown), additive, resolved).regroup(names, counted)
        return replace(cells, leaves=leaves)
    df = project(mv, spark, leaves, shown, relationship, only)
    for cond in where:
        df = df.where(as_column(cond))
    if _same_distinct(leaves):
        return Cells(_dedupe_first(mv, spark, leaves, shown, names, where, relationship, only), names, leaves, resolved)
    grouped = [F.col(f"`{n}`") for n in names]
    df = df.groupBy(*grouped).agg(*part_columns(leaves)) if leaves else df.select(*grouped).distinct()
    return Cells(df, names, leaves, resolved)


def _named(mv: MetricView, shown: Sequence[Dimension], cond: Condition) -> list[Dimension]:
    """The dimensions a condition names."""
    return [d for d in shown if mentions(condition_text(cond), d.name)]


def _same_distinct(leaves: Sequence[Agg]) -> bool:
    """Several distinct counts of the same expression under different filters."""
    counted = [leaf for leaf in leaves if leaf.distinct]
    return len(counted) > 1 and len({leaf.arg for leaf in counted}) == 1 and all(
        leaf.distinct or leaf.mergeable for leaf in leaves
    )


def _dedupe_first(mv, spark, leaves, shown, names, where, relationship, only) -> DataFrame:
    """Group by the counted value first, with a flag per filter, then count the flags.

    Otherwise every row would be expanded once per distinct count.
    """
    additive = [leaf for leaf in leaves if leaf.mergeable]
    flags = [f"__{i}v" for i in range(len(additive), len(leaves))]
    key = Dimension("__key", leaves[-1].arg)
    df = project(mv, spark, leaves, [*shown, key], relationship, only)
    for cond in where:
        df = df.where(as_column(cond))
    grouped = [F.col(f"`{n}`") for n in names]
    seen = [F.max(F.col(f"__a{i}").isNotNull()).alias(f"__{i}v") for i in range(len(additive), len(leaves))]
    by_value = df.groupBy(*grouped, "__key").agg(*part_columns(additive), *seen)
    cells = Cells(by_value, tuple(names), tuple(additive), ())
    return cells.regroup(names, [F.count_if(f).alias(f) for f in flags]).df


def _before_large_joins(
    mv: MetricView,
    spark: SparkSession,
    leaves: Sequence[Agg],
    dims: Sequence[Dimension],
    where: Sequence[Condition],
    relationship: str | None,
    only: Sequence[Column] = (),
) -> DataFrame | None:
    """Aggregate the facts by foreign key first when a dimension is too large to broadcast.

    The facts are then shuffled once, after map-side aggregation, so that a hot key travels as one
    row per task; the join sees one row per key (and value of a distinct count). Possible when the
    calls read source columns only. Returns None when it does not apply.
    """
    texts = [d.expr for d in dims]
    joins = star.needed_joins(mv, [*texts, mv.filter or ""], relationship)
    names = {j.name for j in joins}
    inputs = [leaf.input() for leaf in leaves]
    if not any(star.is_large(spark, j) for j in joins):
        return None
    if any(qualifiers(t) & {j.name for j in mv.joins} for t in [*inputs, mv.filter or ""]):
        return None
    joined = [d for d in dims if qualifiers(d.expr) & names]
    if any(not _only_joins(d.expr, names) for d in joined):
        return None
    own = [d for d in dims if d not in joined]
    on = " ".join(j.condition(relationship).replace("`", "") for j in joins)
    keys = sorted(set(re.findall(r"\bsource\.(\w+)", on)))
    source = star.load(spark, mv.source)
    for cond in only:
        source = source.alias("source").where(cond)
    if mv.filter:
        source = source.where(mv.filter)
    rows = source.alias("source").select(
        *[F.col(f"source.{k}").alias(k) for k in keys],
        *[F.expr(d.expr).alias(f"__d{i}") for i, d in enumerate(own)],
        *[F.expr(t).alias(f"__a{i}") for i, t in enumerate(inputs)],
    )
    additive = [leaf for leaf in leaves if leaf.mergeable]
    counted = [f"__a{i}" for i in range(len(additive), len(leaves))]
    by_key = rows.groupBy(*keys, *[f"__d{i}" for i in range(len(own))], *counted)
    by_key = by_key.agg(*part_columns(additive)) if additive else by_key.agg(F.lit(1).alias("__1"))
    df = star.join_dimensions(spark, by_key, joins, relationship)
    parts = [*counted, *[c for c in by_key.columns if re.fullmatch(r"__\d+[a-z]+", c)]]
    df = df.select(
        *[F.col(f"__d{i}").alias(d.name) for i, d in enumerate(own)],
        *[F.expr(d.expr).alias(d.name) for d in joined],
        *parts,
    )
    for cond in where:
        df = df.where(as_column(cond))
    return df


def _only_joins(expr: str, names: set[str]) -> bool:
    """A plain attribute of a joined dimension."""
    return bool(re.fullmatch(r"(\w+)\.`?\w+`?", expr)) and expr.split(".")[0] in names
