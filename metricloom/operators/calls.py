"""Measure texts that stand for operators: scopes, ranks, lists, running and shifted values.

Such texts have no form as one SQL aggregate, but an operator of this package computes them. They
become calls: which operator, the measure it works on, and its arguments as columns. What matches no
pattern as a whole is no call.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from metricloom.functions.text import without_comments
from metricloom.operators import members, ranking, rules, shares, timeline
from metricloom.plans.model import Dimension, Measure, MetricView, Window
from metricloom.plans.settle import settle

TABLE = r"(?:'[^']+'|\w+)"
COLUMN = rf"{TABLE}\[[^\]]+\]"
LEVEL = r"(?:\[[^\]]+\]\.)*\[[^\]]+\]"
NOW = r"\s*(?:,\s*(?:0|BLANK\(\s*\))\s*)?"

# Kind, mode, pattern and the groups that hold base measure, columns, number, unit and further text.
# A measure that is named twice must be the same both times.
PATTERNS: list[tuple[str, str, str, dict[str, int]]] = [
    ("pct_of_total", "dax", rf"DIVIDE\((.+?),\s*CALCULATE\(\1,\s*ALL\(\s*{TABLE}\s*\)\s*\){NOW}\)", {"base": 1}),
    ("pct_of_selected", "dax", rf"DIVIDE\((.+?),\s*CALCULATE\(\1,\s*ALLSELECTED\(\s*{TABLE}?\s*\)\s*\){NOW}\)", {"base": 1}),
    ("pct_keep", "dax", rf"DIVIDE\((.+?),\s*CALCULATE\(\1,\s*ALLEXCEPT\(\s*{TABLE}\s*,([^()]+)\)\s*\){NOW}\)", {"base": 1, "columns": 2}),
    ("pct_remove", "dax", rf"DIVIDE\((.+?),\s*CALCULATE\(\1((?:,\s*ALL\(\s*{COLUMN}\s*\)\s*)+)\){NOW}\)", {"base": 1, "columns": 2}),
    ("pct_remove", "mdx", rf"(\[Measures\]\.\[[^\]]+\])\s*/\s*\(\s*\1\s*,\s*({LEVEL})\.\[All\]\s*\)", {"base": 1, "columns": 2}),
    ("running_total", "dax", rf"CALCULATE\((.+?),\s*FILTER\(\s*ALL\(\s*{TABLE}(?:\[[^\]]+\])?\s*\)\s*,\s*({COLUMN})\s*<=\s*MAX\(\s*\2\s*\)\s*\)\s*\)", {"base": 1, "columns": 2}),
    ("running_total", "mdx", rf"SUM\(\s*NULL\s*:\s*({LEVEL})\.CURRENTMEMBER\s*,\s*(.+)\)", {"columns": 1, "base": 2}),
    ("yoy", "dax", rf"VAR (\w+) ?= ?(.+?) VAR (\w+) ?= ?CALCULATE\(\2,\s*SAMEPERIODLASTYEAR\(\s*({COLUMN})\s*\)\s*\) RETURN DIVIDE\(\s*\1\s*-\s*\3\s*,\s*\3\s*{NOW}\)", {"base": 2, "columns": 4}),
    ("rolling", "dax", rf"AVERAGEX\(\s*DATESINPERIOD\(\s*({COLUMN})\s*,\s*MAX\(\s*\1\s*\)\s*,\s*-(\d+)\s*,\s*(\w+)\s*\)\s*,(.+)\)", {"columns": 1, "n": 2, "unit": 3, "base": 4}),
    ("topn_sum", "dax", rf"SUMX\(\s*TOPN\(\s*(\d+)\s*,\s*(?:VALUES|ALL)\(\s*({COLUMN})\s*\)\s*,\s*(.+?)\s*\)\s*,\s*\3\s*\)", {"n": 1, "columns": 2, "base": 3}),
    ("rankx", "dax", rf"RANKX\(\s*ALL\(\s*({COLUMN})\s*\)\s*,(.+)\)", {"columns": 1, "base": 2}),
    ("rankx", "mdx", rf"RANK\(\s*({LEVEL})\.CURRENTMEMBER\s*,\s*ORDER\(\s*\1\.MEMBERS\s*,(.+?),\s*BDESC\s*\)\s*\)", {"columns": 1, "base": 2}),
    ("concatenatex", "dax", rf'CONCATENATEX\(\s*VALUES\(\s*({COLUMN})\s*\)\s*,\s*\1\s*,\s*"([^"]*)"\s*\)', {"columns": 1, "argument": 2}),
    ("relationship", "dax", rf"CALCULATE\((.+?),\s*USERELATIONSHIP\(\s*({COLUMN}\s*,\s*{COLUMN})\s*\)\s*\)", {"base": 1, "columns": 2}),
    ("new_members", "dax", rf"COUNTROWS\(\s*FILTER\(\s*VALUES\(\s*({COLUMN})\s*\)\s*,\s*CALCULATE\(\s*MIN\(\s*({COLUMN})\s*\)\s*\)\s*>=\s*MIN\(\s*({COLUMN})\s*\)\s*&&\s*CALCULATE\(\s*MIN\(\s*\2\s*\)\s*\)\s*<=\s*MAX\(\s*\3\s*\)\s*\)\s*\)", {"columns": 1, "argument": 2}),
    ("cumulative_pct", "dax", rf"COUNTROWS\(\s*FILTER\(\s*({TABLE})\s*,\s*EARLIER\(\s*({COLUMN})\s*\)\s*>=\s*\2\s*\)\s*\)\s*/\s*COUNTROWS\(\s*\1\s*\)", {"columns": 2}),
    ("count_members", "mdx", rf"COUNT\(\s*FILTER\(\s*({LEVEL})\.MEMBERS\s*,\s*(.+?)\s*((?:>=|<=|<>|=|<|>)\s*-?[0-9.]+)\s*\)\s*\)", {"columns": 1, "base": 2, "argument": 3}),
    ("over_members", "mdx", rf"(MAX|MIN|AVG)\(\s*({LEVEL})\.MEMBERS\s*,(.+)\)", {"argument": 1, "columns": 2, "base": 3}),
]


def find_calls(staging: DataFrame) -> DataFrame:
    """Pending rows that stand for an operator: model, measure_name, kind, expr, columns, n, unit, argument.

    `expr` is the SQL of the base measure, null for operators that need none; rows whose base measure
    no rule covers are left out. Columns are physical names, `alias.column` for joined tables.
    """
    df = staging.where("final_status = 'pending'")
    text = F.regexp_replace(F.trim(without_comments(F.coalesce("resolved_expr", "measure_expr"))), r"\s+", " ")
    mdx = F.col("mode") == "mdx"
    found = F.when(F.lit(False), F.struct(*[F.lit("").alias(k) for k in ("kind", "base", "columns", "n", "unit", "argument")]))
    for kind, mode, pattern, groups in PATTERNS:
        whole = rf"(?is)^\s*{pattern}\s*$"
        part = lambda k: (F.regexp_extract(text, whole, groups[k]) if k in groups else F.lit("")).alias(k)  # noqa: E731, B023
        here = (mdx if mode == "mdx" else ~mdx) & text.rlike(whole)
        found = found.when(here, F.struct(F.lit(kind).alias("kind"), *[part(k) for k in ("base", "columns", "n", "unit", "argument")]))
    # Written, as the patterns would be repeated in every expression that uses their groups.
    df = settle(df.withColumn("__call", found).where("__call IS NOT NULL"))
    refs = F.regexp_extract_all(F.col("__call.columns"), F.lit(rf"{COLUMN}|{LEVEL}"), F.lit(0))
    last = lambda r: rules.snake_case(F.regexp_extract(r, r"\[([^\]]+)\][^\[\]]*$", 1))
    physical = F.when(mdx, F.transform(refs, last)).otherwise(F.transform(refs, rules._dax_columns))
    argument = F.col("__call.argument")
    df = df.withColumns({"__columns": physical, "__argument": F.when(argument.rlike(COLUMN), rules._dax_columns(argument)).otherwise(argument)})
    kept = ["model", "measure_name", "mode", "fact_table_fqn"]
    based = df.withColumns({"resolved_expr": F.when(F.col("__call.base") != "", F.col("__call.base")).otherwise(F.lit("COUNTROWS(T)")), "mode": F.when(F.col("__call.base") != "", F.col("mode")).otherwise("dax")})
    translated = rules.translate_rules(settle(based.withColumn("position", F.struct("position", "__call", "__columns", "__argument"))))
    # Written as well: conditions on the translated text would repeat all rules in the plan, which the driver's memory has to hold.
    done = settle(translated.select("model", "measure_name", "fact_table_fqn", "position", "class", "expr"))
    call = F.col("position.__call")
    return done.where((F.col("class") == "supported") & F.col("expr").isNotNull()).select(
        *[c for c in kept if c != "mode"], call["kind"].alias("kind"), F.when(call["base"] != "", F.col("expr")).alias("expr"),
        F.col("position.__columns").alias("columns"), call["n"].try_cast("int").alias("n"), F.lower(call["unit"]).alias("unit"), F.col("position.__argument").alias("argument"),
    )


def _relationship(mv: MetricView, columns: Sequence[str]) -> str | None:
    """Name of the alternate relationship that joins the columns; none if the usual one does."""
    same = lambda text: all(c.rpartition(".")[2] in text.replace(".", " ").split() for c in columns)
    if any(same(j.condition()) for j in mv.joins):
        return None
    found = [name for j in mv.joins for name, text in j.alternates.items() if same(text)]
    if not found:
        raise ValueError(f"no relationship between {' and '.join(columns)}")
    return found[0]


def evaluate(call: Row, mv: MetricView, spark: SparkSession, dims: Sequence[str] = (), date: str | None = None, where=None) -> DataFrame:
    """The result of one call over a view, by the operator it stands for.

    Columns of the call are dimensions of the view by their expression. `dims` groups, `date` is the
    date dimension of calls over time.
    """
    measure = Measure(call["measure_name"], call["expr"]) if call["expr"] else None
    known = {d.expr.removeprefix("source."): d for d in mv.dimensions}
    columns = [known.get(c) or Dimension(c.replace(".", "_"), c) for c in call["columns"]]
    mv = replace(mv, dimensions=(*mv.dimensions, *[d for d in columns if d not in mv.dimensions]))
    first = columns[0].name if columns else None
    names = [d.name for d in columns]
    kind, n = call["kind"], call["n"]
    if kind == "pct_of_total":
        return shares.pct_of_total(mv, spark, measure, dims, where)
    if kind == "pct_of_selected":
        return shares.pct_of_selected(mv, spark, measure, dims, where)
    if kind == "pct_keep":
        return shares.pct_of(mv, spark, measure, dims, keep=names, where=where)
    if kind == "pct_remove":
        return shares.pct_of(mv, spark, measure, dims, remove=names, where=where)
    if kind == "running_total":
        return mv.query(spark, [replace(measure, window=(Window(date, "cumulative"),))], [*dims, date], where)
    if kind == "yoy":
        return timeline.yoy(mv, spark, measure, date, dims=dims, where=where, alternate=0)
    if kind == "rolling":
        return timeline.rolling(mv, spark, measure, date, n, call["unit"], dims=dims, where=where)
    if kind == "topn_sum":
        return ranking.topn_sum(mv, spark, measure, first, n, dims, where)
    if kind == "rankx":
        return ranking.rankx(mv, spark, measure, first, dims, where=where)
    if kind == "concatenatex":
        return members.concatenatex(mv, spark, first, dims, sep=call["argument"], where=where)
    if kind == "relationship":
        return mv.query(spark, [measure], dims, where, use_relationship=_relationship(mv, call["columns"]))
    if kind == "new_members":
        return members.new_members(mv, spark, first, date, where=where)
    if kind == "cumulative_pct":
        return ranking.cumulative_pct(mv, spark, first, where)
    if kind == "count_members":
        return members.count_members_where(mv, spark, measure, first, f"value {call['argument']}", dims, where)
    if kind == "over_members":
        return members.over_members(mv, spark, measure, first, f"{call['argument']}(value)", dims, where)
    raise ValueError(f"no operator {kind}")
