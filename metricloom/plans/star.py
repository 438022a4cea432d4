"""The joined base of a view: its source and the dimensions a query really names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.plans.model import Condition, Dimension, Join, MetricView, Source, qualifiers

# Up to this many keys a condition on a dimension becomes a list for the facts, beyond it a range.
LISTED_KEYS = 32


def load(spark: SparkSession, ref: Source) -> DataFrame:
    if isinstance(ref, DataFrame):
        return ref
    return spark.read.parquet(ref) if "/" in ref else spark.table(ref)


def is_large(spark: SparkSession, join: Join) -> bool:
    """The dimension exceeds the size up to which Spark broadcasts a join side.

    Where the session gives no estimate (a remote one), a dimension is large if it is declared so.
    """
    if join.large is not None:
        return join.large
    frame = load(spark, join.source)
    if not hasattr(frame, "_jdf"):
        return False
    plan = frame._jdf.queryExecution().optimizedPlan()
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(plan.stats().sizeInBytes()) > limit


def needed_joins(mv: MetricView, texts: Iterable[str], relationship: str | None = None) -> list[Join]:
    """Joins named by the texts, and joins those depend on, in an order that resolves."""
    by_name = {j.name: j for j in mv.joins}
    ordered: list[Join] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name not in by_name or by_name[name] in ordered:
            return
        if name in path:
            raise ValueError(f"joins depend on each other: {path}")
        for other in sorted(qualifiers(by_name[name].condition(relationship)) - {name}):
            visit(other, (*path, name))
        ordered.append(by_name[name])

    named = set().union(*(qualifiers(t) for t in texts)) if texts else set()
    for j in mv.joins:
        if j.name in named:
            visit(j.name, ())
    return ordered


def join_dimensions(
    spark: SparkSession, source: DataFrame, joins: list[Join], relationship: str | None = None
) -> DataFrame:
    """Left joins; each dimension arrives as one struct column named after its join.

    So `customer.name` means the dimension and a bare name always the source. No hints: the size of
    each side is checked by Spark (statistics, then run-time sizes), and skew is split by AQE.
    """
    clash = {j.name for j in joins} & set(source.columns)
    if clash:
        raise ValueError(f"join names equal source columns: {sorted(clash)}")
    df = source.alias("source")
    for j in joins:
        df = df.join(load(spark, j.source).alias(j.name), F.expr(j.condition(relationship)), "left")
    structs = [F.struct(F.col(f"{j.name}.*")).alias(j.name) for j in joins]
    return df.select("source.*", *structs).alias("source")


def base(
    mv: MetricView,
    spark: SparkSession,
    texts: Iterable[str],
    relationship: str | None = None,
    only: Sequence[Column] = (),
) -> DataFrame:
    """Joined rows under the view's own filter (S9, Q4). `only` are conditions on the source, see `key_conditions`."""
    texts = [*texts, mv.filter or ""]
    source = load(spark, mv.source)
    for cond in only:
        source = source.alias("source").where(cond)
    df = join_dimensions(spark, source, needed_joins(mv, texts, relationship), relationship)
    return df.where(mv.filter) if mv.filter else df


def key_conditions(
    mv: MetricView,
    spark: SparkSession,
    conditions: Sequence[tuple[Condition, Sequence[Dimension]]],
    relationship: str | None = None,
) -> list[Column]:
    """What conditions on dimensions say about the foreign keys of the facts (Q3).

    A condition that names attributes of one joined dimension only, and that a fact without a partner
    fails, leaves a set of keys of that dimension. The facts get it as a list of at most
    `LISTED_KEYS` keys, or as a range, so that their scan can pass over files and row groups. The
    conditions themselves still apply after the join. The driver gets at most that many keys of a
    dimension. Large dimensions are not read for it.
    """
    found: list[Column] = []
    for j in mv.joins:
        own = [c for c, named in conditions if named and all(_attribute_of(d.expr, j.name) for d in named)]
        named = {d.name: d for c, ds in conditions if any(c is o for o in own) for d in ds}
        links = _links(j, relationship) if own else []
        if not links or is_large(spark, j):
            continue
        dim = load(spark, j.source)
        missing = spark.sql("SELECT 1").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in dim.schema.fields])

        def kept(rows: DataFrame) -> DataFrame:
            rows = rows.alias(j.name).select("*", *[F.expr(d.expr).alias(f"__n_{n}") for n, d in named.items()])
            rows = rows.select(*[F.col(f"{j.name}.`{c}`").alias(f"__k_{c}") for c in dim.columns], *[F.col(f"`__n_{n}`").alias(n) for n in named])
            for cond in own:
                rows = rows.where(F.expr(cond) if isinstance(cond, str) else cond)
            return rows

        if not kept(missing).isEmpty():
            continue
        source = load(spark, mv.source)
        for fact_key, dim_key in links:
            kind = dict(dim.dtypes)[dim_key]
            if not re.fullmatch(r"tinyint|smallint|int|bigint|date|string|decimal.*", kind):
                continue
            if source.alias("source").select(F.expr(fact_key).alias("k")).dtypes[0][1] != kind:
                continue
            keys = kept(dim).select(F.col(f"`__k_{dim_key}`").alias("k")).where("k IS NOT NULL")
            few = [r.k for r in keys.distinct().limit(LISTED_KEYS + 1).collect()]
            if len(few) <= LISTED_KEYS:
                found.append(F.expr(fact_key).isin(sorted(few)) if few else F.lit(False))
            else:
                least, most = keys.agg(F.min("k"), F.max("k")).first()
                found.append(F.expr(fact_key).between(F.lit(least), F.lit(most)))
    return found


def _attribute_of(expr: str, join: str) -> bool:
    """The expression is a plain attribute of the joined dimension."""
    return bool(re.fullmatch(rf"{re.escape(join)}\.`?\w+`?", expr))


def _links(j: Join, relationship: str | None) -> list[tuple[str, str]]:
    """Expressions over the source, each with the column of the dimension that the join sets it equal to."""
    parts = re.split(r"\s+AND\s+", j.condition(relationship), flags=re.IGNORECASE)
    if any(re.search(r"\b(OR|NOT|BETWEEN|CASE)\b|[<>!]|'", p, re.IGNORECASE) or p.count("=") != 1 for p in parts):
        return []
    links = []
    for sides in (p.split("=") for p in parts):
        for fact, dim in (sides, sides[::-1]):
            fact, dim = fact.strip(), dim.strip()
            if _attribute_of(dim, j.name) and qualifiers(fact) == {"source"}:
                links.append((fact, dim.split(".", 1)[1].strip("`")))
    return links


def check_one_side(dim: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once on the one-side of a join (J11); must be empty."""
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
