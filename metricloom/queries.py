"""Registered queries and, where SQL can say it, the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from metricloom import examples as X
from metricloom.functions import aggs as A
from metricloom.functions import text as TX
from metricloom.operators import members, ranking, shares, timeline
from metricloom.operators import validate as V
from metricloom.plans import settle, star
from metricloom.plans.cells import join_on
from metricloom.plans.model import Dimension, Join, Measure, MetricView, Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Shared fragments of the SQL side.
AMT = "CAST(o_totalprice AS DECIMAL(18,2))"
PRC = "CAST(l_extendedprice AS DECIMAL(12,2))"
KEEP = "CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2))"
TAX = "CAST(1 + CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(4,2))"
QTY = "CAST(l_quantity AS DECIMAL(12,2))"
OC = "orders LEFT JOIN customer ON o_custkey = c_custkey"
OCNR = f"{OC} LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
MONTHLY = f"m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, SUM({AMT}) AS v FROM orders GROUP BY 1)"
DAILY = f"dd AS (SELECT CAST(o_orderdate AS DATE) AS day, SUM({AMT}) AS v FROM orders GROUP BY 1)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def query(name: str, sql: str | None = None, dates: str = ""):
    """Register a query; decimals of the result become doubles, dates ISO texts.

    `dates` names the date columns of the SQL side.
    """

    def plain(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        return c.cast("string").alias(field.name) if isinstance(field.dataType, T.DateType) else c

    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = fn(spark, sf)
            return df.select(*[plain(f) for f in df.schema.fields])

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            texts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates.split())
            ORACLE[name] = f"SELECT * REPLACE ({texts}) FROM ({sql}) AS q" if texts else sql
        return fn

    return register


# ================================================================ plain aggregates


@query(
    "q_flagship",
    f"""SELECT c_mktsegment AS segment, {dbl(f'SUM({AMT})')} AS total,
    {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F')")} AS active_total,
    COUNT(DISTINCT o_custkey) AS customers, {dbl(f'SUM({AMT})')} / COUNT(o_totalprice) AS avg_order,
    {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F')")} / NULLIF({dbl(f'SUM({AMT})')}, 0) AS active_share
    FROM {OC} GROUP BY 1""",
)
def flagship(spark, sf):
    """Composite, filtered, distinct and ratio measures of one view in one aggregation."""
    mv = X.orders_view(spark, sf)
    return mv.query(spark, ["total", "active_total", "customers", "avg_order", "active_share"], ["segment"])


@query(
    "q_simple_aggs",
    f"""SELECT l_returnflag AS flag, {dbl(f'SUM({PRC})')} AS total, COUNT(l_orderkey) AS n, COUNT(*) AS rows_n,
    COUNT(DISTINCT l_partkey) AS parts, {dbl(f'SUM({PRC})')} / COUNT(l_extendedprice) AS mean,
    MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY 1""",
)
def simple_aggs(spark, sf):
    mv = X.lines_view(spark, sf)
    ms = [
        Measure("total", A.sum_(X.PRICE)),
        Measure("n", A.count_("l_orderkey")),
        Measure("rows_n", A.count_rows()),
        Measure("parts", A.distinct_count("l_partkey")),
        Measure("mean", A.avg_(X.PRICE)),
        Measure("lo", A.min_("l_extendedprice")),
        Measure("hi", A.max_("l_extendedprice")),
    ]
    return mv.query(spark, ms, ["flag"])


def _filtered(name: str, cond: str):
    @query(
        name,
        f"""SELECT l_linestatus AS linestatus, {dbl(f'SUM({PRC}) FILTER (WHERE {cond})')} AS total,
        COUNT(*) FILTER (WHERE {cond}) AS n, COUNT(DISTINCT l_partkey) FILTER (WHERE {cond}) AS parts
        FROM lineitem GROUP BY 1""",
    )
    def run(spark, sf):
        conds = cond.split(" AND ")
        mv = X.lines_view(spark, sf)
        ms = [
            Measure("total", A.filtered(A.sum_(X.PRICE), *conds)),
            Measure("n", A.filtered(A.count_rows(), *conds)),
            Measure("parts", A.filtered(A.distinct_count("l_partkey"), *conds)),
        ]
        return mv.query(spark, ms, ["linestatus"])


_filtered("q_filtered_single", "l_returnflag = 'R'")
_filtered("q_filtered_multi", "l_returnflag = 'A' AND l_linestatus = 'F' AND l_discount = 0.05")
_filtered("q_filtered_numeric", "l_quantity > 30 AND l_extendedprice <= 50000")
_filtered("q_filtered_not_equal", "l_returnflag <> 'N'")


@query(
    "q_filtered_distincts",
    f"""SELECT c_mktsegment AS segment, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS active,
    COUNT(DISTINCT o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000) AS urgent, {dbl(f'SUM({AMT})')} AS total,
    {dbl(f'SUM({AMT})')} / COUNT({AMT}) AS avg_order, MAX(o_totalprice) AS best FROM {OC} GROUP BY 1""",
)
def filtered_distincts(spark, sf):
    """Distinct counts of one column under several filters, beside other measures."""
    n = A.distinct_count("o_custkey")
    ms = [
        "customers",
        Measure("active", A.filtered(n, "o_orderstatus = 'F'")),
        Measure("urgent", A.filtered(n, "o_orderpriority = '1-URGENT'", "o_totalprice > 300000")),
        "total",
        "avg_order",
        Measure("best", A.max_("o_totalprice")),
    ]
    return X.orders_view(spark, sf).query(spark, ms, ["segment"])


@query("q_sumx_product", f"SELECT l_returnflag AS flag, {dbl(f'SUM({PRC} * {QTY})')} AS v FROM lineitem GROUP BY 1")
def sumx_product(spark, sf):
    return X.lines_view(spark, sf).query(spark, [Measure("v", A.sumx(f"{X.PRICE} * {X.QTY}"))], ["flag"])


@query("q_sumx_difference", f"SELECT l_returnflag AS flag, {dbl(f'SUM({PRC} - {QTY})')} AS v FROM lineitem GROUP BY 1")
def sumx_difference(spark, sf):
    return X.lines_view(spark, sf).query(spark, [Measure("v", A.sumx(f"{X.PRICE} - {X.QTY}"))], ["flag"])


@query(
    "q_sumx_three_factor",
    f"""SELECT l_returnflag AS flag, {dbl(f'SUM({PRC} * {KEEP})')} AS net, {dbl(f'SUM({PRC} * {KEEP} * {TAX})')} AS taxed
    FROM lineitem GROUP BY 1""",
)
def sumx_three_factor(spark, sf):
    return X.lines_view(spark, sf).query(spark, ["net", "taxed"], ["flag"])


@query(
    "q_avgx",
    f"SELECT l_returnflag AS flag, {dbl(f'SUM({PRC} * {KEEP})')} / COUNT({PRC} * {KEEP}) AS v FROM lineitem GROUP BY 1",
)
def avgx(spark, sf):
    return X.lines_view(spark, sf).query(spark, [Measure("v", A.avgx(f"{X.PRICE} * {X.KEEP}"))], ["flag"])


@query(
    "q_minx_maxx",
    f"""SELECT l_returnflag AS flag, {dbl(f'MIN({PRC} * {KEEP})')} AS lo, {dbl(f'MAX({PRC} * {KEEP})')} AS hi
    FROM lineitem GROUP BY 1""",
)
def minx_maxx(spark, sf):
    e = f"{X.PRICE} * {X.KEEP}"
    return X.lines_view(spark, sf).query(spark, [Measure("lo", A.minx(e)), Measure("hi", A.maxx(e))], ["flag"])


@query(
    "q_measure_product",
    f"""SELECT p_brand AS brand, {dbl(f'SUM(CAST(p_retailprice AS DECIMAL(12,2)) * {QTY})')} AS line_total
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def measure_product(spark, sf):
    """Product of a dimension's unit price and the quantity, per row."""
    m = Measure("line_total", A.sumx(f"CAST(part.p_retailprice AS DECIMAL(12,2)) * {X.QTY}"))
    return X.lines_view(spark, sf).query(spark, [m], ["brand"])


# ================================================================ conditional dimensions


@query(
    "q_if_dimension",
    f"""SELECT CASE WHEN l_quantity > 25 THEN 'Large' ELSE 'Small' END AS size, {dbl(f'SUM({PRC})')} AS gross
    FROM lineitem GROUP BY 1""",
)
def if_dimension(spark, sf):
    d = Dimension("size", A.case_when([("l_quantity > 25", "'Large'")], "'Small'"))
    return X.lines_view(spark, sf).query(spark, ["gross"], [d])


@query(
    "q_nested_if_dimension",
    f"""SELECT CASE WHEN l_quantity > 40 THEN 'Large' WHEN l_quantity > 15 THEN 'Mid' ELSE 'Small' END AS size_class,
    COUNT(*) AS lines FROM lineitem GROUP BY 1""",
)
def nested_if_dimension(spark, sf):
    return X.lines_view(spark, sf).query(spark, ["lines"], ["size_class"])


@query(
    "q_switch_dimension",
    f"""SELECT CASE WHEN o_orderstatus = 'F' THEN 'High' WHEN o_orderstatus = 'O' THEN 'Medium' ELSE 'Low' END AS urgency,
    COUNT(*) AS orders FROM orders GROUP BY 1""",
)
def switch_dimension(spark, sf):
    d = Dimension("urgency", A.switch([("o_orderstatus = 'F'", "'High'"), ("o_orderstatus = 'O'", "'Medium'")], "'Low'"))
    return X.orders_view(spark, sf).query(spark, ["orders"], [d])


@query(
    "q_kpi_status",
    f"""SELECT o_custkey AS custkey, {dbl(f'SUM({AMT})')} AS total,
    CASE WHEN SUM({AMT}) > 3000000 THEN 'Green' WHEN SUM({AMT}) > 1000000 THEN 'Yellow' ELSE 'Red' END AS status_label
    FROM orders GROUP BY 1""",
)
def kpi_status(spark, sf):
    m = Measure("status_label", A.kpi_status(A.measure("total"), [(3000000, "Green"), (1000000, "Yellow")], "Red"))
    return X.orders_view(spark, sf).query(spark, ["total", m], ["custkey"])


# ================================================================ ratios and composites


@query(
    "q_divide",
    f"""SELECT o_custkey AS custkey,
    {dbl(f"SUM({AMT}) FILTER (WHERE o_orderpriority = '1-URGENT')")} /
    NULLIF({dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'P')")}, 0) AS v FROM orders GROUP BY 1""",
)
def divide(spark, sf):
    """Groups without a denominator yield NULL."""
    n = A.filtered(A.sum_(X.AMOUNT), "o_orderpriority = '1-URGENT'")
    d = A.filtered(A.sum_(X.AMOUNT), "o_orderstatus = 'P'")
    return X.orders_view(spark, sf).query(spark, [Measure("v", A.divide(n, d))], ["custkey"])


@query(
    "q_divide_alternate",
    """SELECT o_custkey AS custkey, COALESCE(CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) /
    NULLIF(CAST(COUNT(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS DOUBLE), 0), -1) AS v FROM orders GROUP BY 1""",
)
def divide_alternate(spark, sf):
    n = A.filtered(A.count_rows(), "o_orderstatus = 'F'")
    d = A.filtered(A.count_rows(), "o_orderpriority = '2-HIGH'")
    return X.orders_view(spark, sf).query(spark, [Measure("v", A.divide(n, d, "-1"))], ["custkey"])


@query(
    "q_translated_division",
    f"""WITH g AS (SELECT o_custkey AS custkey, {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F')")} AS f, {dbl(f"SUM({AMT})")} AS t,
      COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p, COUNT(*) AS n FROM orders GROUP BY 1)
    SELECT custkey, CAST(n AS DOUBLE) / NULLIF(p, 0) AS plain, CAST(n AS DOUBLE) / NULLIF(n - p, 0) AS grouped, COALESCE(CAST(n AS DOUBLE) / NULLIF(p, 0), 1) AS alternate FROM g""",
)
def translated_division(spark, sf):
    """Plain divisions of translated texts: groups with a zero divisor yield NULL, or the alternate."""
    texts = {
        "open_orders": 'CALCULATE(COUNTROWS(Sales), Sales[Status]="P")',
        "plain": "COUNTROWS(Sales) / [open_orders]",
        "grouped": "COUNTROWS(Sales) / (COUNTROWS(Sales) - [open_orders])",
        "alternate": "DIVIDE(COUNTROWS(Sales), [open_orders], 1)",
    }
    mv = _translated_orders(spark, sf, texts)
    df = mv.query(spark, ["plain", "grouped", "alternate"], ["custkey"])
    return df.select("custkey", *[F.col(c).cast("double").alias(c) for c in ("plain", "grouped", "alternate")])


@query(
    "q_ratio_else_zero",
    f"""SELECT o_custkey AS custkey,
    CASE WHEN SUM({AMT}) FILTER (WHERE o_orderstatus = 'P') > 0
    THEN {dbl(f'SUM({AMT})')} / {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'P')")} ELSE 0 END AS v
    FROM orders GROUP BY 1""",
)
def ratio_else_zero(spark, sf):
    d = A.filtered(A.sum_(X.AMOUNT), "o_orderstatus = 'P'")
    return X.orders_view(spark, sf).query(spark, [Measure("v", A.ratio(A.sum_(X.AMOUNT), d, "0"))], ["custkey"])


@query(
    "q_margin",
    f"""SELECT l_returnflag AS flag, {dbl(f'SUM({PRC}) - SUM({PRC} * {KEEP})')} AS rebate,
    {dbl(f'SUM({PRC}) - SUM({PRC} * {KEEP})')} / NULLIF({dbl(f'SUM({PRC})')}, 0) AS margin FROM lineitem GROUP BY 1""",
)
def margin(spark, sf):
    """Difference of measures and its share of the first."""
    a, b = A.measure("gross"), A.measure("net")
    ms = [Measure("rebate", A.diff(a, b)), Measure("margin", A.margin(a, b))]
    return X.lines_view(spark, sf).query(spark, ms, ["flag"])


@query(
    "q_composite_inline",
    f"""SELECT o_orderpriority AS priority, {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000)")} AS big_active,
    {dbl(f'SUM({AMT})')} / NULLIF(CAST(COUNT(DISTINCT o_custkey) AS DOUBLE), 0) AS per_customer FROM orders GROUP BY 1""",
)
def composite_inline(spark, sf):
    """Measures that name measures; a filter on a filtered measure keeps both conditions."""
    ms = [
        Measure("big_active", A.filtered(A.measure("active_total"), "o_totalprice > 100000")),
        Measure("per_customer", A.divide("[Measures].[total]", "[customers]")),
    ]
    return X.orders_view(spark, sf).query(spark, ms, ["priority"])


@query(
    "q_var_return",
    f"""SELECT l_returnflag AS flag, CASE WHEN SUM({PRC}) > 0 THEN {dbl(f'SUM({PRC} * {KEEP})')} / NULLIF({dbl(f'SUM({PRC})')}, 0)
    ELSE 0 END AS v FROM lineitem GROUP BY 1""",
)
def var_return(spark, sf):
    e = A.let({"TotalGross": A.measure("gross"), "TotalNet": A.measure("net")}, A.ratio("TotalNet", "TotalGross"))
    e = A.let({"TotalGross": A.measure("gross")}, f"CASE WHEN TotalGross > 0 THEN {e} ELSE 0 END")
    return X.lines_view(spark, sf).query(spark, [Measure("v", e)], ["flag"])


@query(
    "q_tuple_filter",
    f"""SELECT c_mktsegment AS segment, {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")} AS v,
    COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders FROM {OC} GROUP BY 1""",
)
def tuple_filter(spark, sf):
    ms = [
        Measure("v", A.tuple_filter(A.measure("total"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})),
        Measure("open_orders", A.member_filter(A.measure("orders"), "o_orderstatus", "O")),
    ]
    return X.orders_view(spark, sf).query(spark, ms, ["segment"])


@query(
    "q_share",
    f"""SELECT c_mktsegment AS segment,
    {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F')")} / NULLIF({dbl(f'SUM({AMT})')}, 0) AS active_share,
    CAST(COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS urgent_rate
    FROM {OC} GROUP BY 1""",
)
def share(spark, sf):
    ms = [
        Measure("active_share", A.share("o_orderstatus = 'F'", A.measure("total"))),
        Measure("urgent_rate", A.share("o_orderpriority = '1-URGENT'", A.count_rows())),
    ]
    return X.orders_view(spark, sf).query(spark, ms, ["segment"])


@query(
    "q_weighted_avg",
    f"""SELECT l_returnflag AS flag, {dbl(f'SUM(({PRC}) * ({QTY}))')} / NULLIF({dbl(f'SUM({QTY})')}, 0) AS v
    FROM lineitem GROUP BY 1""",
)
def weighted_avg(spark, sf):
    return X.lines_view(spark, sf).query(spark, [Measure("v", A.weighted_avg(X.PRICE, X.QTY))], ["flag"])


# ================================================================ joins


@query(
    "q_star_join",
    f"""SELECT p_brand AS brand, l_returnflag AS flag, {dbl(f'SUM({PRC} * {KEEP})')} AS net
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def star_join(spark, sf):
    return X.lines_view(spark, sf).query(spark, ["net"], ["brand", "flag"])


@query(
    "q_multi_star",
    f"""SELECT p_type AS type, year(l_shipdate) AS ship_year, 'Q' || quarter(l_shipdate) AS ship_quarter,
    {dbl(f'SUM({PRC})')} AS gross, COUNT(*) AS lines
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
)
def multi_star(spark, sf):
    return X.lines_view(spark, sf).query(spark, ["gross", "lines"], ["type", "ship_year", "ship_quarter"])


@query(
    "q_using_join",
    f"""SELECT p_brand AS brand, {dbl(f'SUM({QTY})')} AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def using_join(spark, sf):
    lines = X.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "partkey")
    part = X.table(spark, sf, "part").withColumnRenamed("p_partkey", "partkey")
    mv = MetricView(
        "mv_using", lines, (Join("part", part, using=("partkey",)),), (Dimension("brand", "part.p_brand"),),
        (Measure("quantity", A.sum_(X.QTY)),),
    )
    return mv.query(spark, ["quantity"], ["brand"])


@query(
    "q_snowflake_join",
    f"""SELECT r_name AS region_name, n_name AS nation_name, {dbl(f'SUM({AMT})')} AS total, COUNT(DISTINCT o_custkey) AS customers
    FROM {OCNR} GROUP BY 1, 2""",
)
def snowflake_join(spark, sf):
    return X.orders_view(spark, sf).query(spark, ["total", "customers"], ["region_name", "nation_name"])


@query(
    "q_large_dimension_join",
    f"""SELECT c_mktsegment AS segment, o_orderpriority AS order_priority, l_returnflag AS flag, {dbl(f'SUM({PRC})')} AS gross,
    {dbl(f'SUM({PRC})')} / COUNT({PRC}) AS mean, COUNT(*) AS lines, COUNT(DISTINCT l_partkey) AS parts
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    GROUP BY 1, 2, 3""",
)
def large_dimension_join(spark, sf):
    """Facts are aggregated by foreign key before they meet a dimension too large to broadcast."""
    mv = X.lines_view(spark, sf, large=True)
    return mv.query(spark, ["gross", Measure("mean", A.avg_(X.PRICE)), "lines", "parts"], ["segment", "order_priority", "flag"])


@query(
    "q_alt_relationship",
    f"""WITH ship AS (SELECT year(l_shipdate) AS y, SUM({PRC}) AS v FROM lineitem GROUP BY 1),
    ordered AS (SELECT year(o_orderdate) AS y, SUM({PRC}) AS v FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT s.y AS year, {dbl('s.v')} AS shipped, {dbl('o.v')} AS ordered FROM ship s LEFT JOIN ordered o ON s.y = o.y""",
)
def alt_relationship(spark, sf):
    mv = X.lines_view(spark, sf)
    shipped = mv.query(spark, [Measure("shipped", A.sum_(X.PRICE))], ["ship_year"])
    ordered = mv.query(spark, [Measure("ordered", A.sum_(X.PRICE))], ["ship_year"], use_relationship="order_date")
    return join_on(shipped, ordered, ["ship_year"]).withColumnRenamed("ship_year", "year")


@query(
    "q_from_keys",
    f"""SELECT c_mktsegment AS segment, COUNT(*) AS orders FROM {OC} GROUP BY 1""",
)
def from_keys(spark, sf):
    """Join built from key names; its alias is the last part of the table name."""
    j = Join.from_keys("customer", "o_custkey", "c_custkey")
    j = Join(j.name, X.table(spark, sf, "customer"), j.on)
    mv = MetricView("mv_keys", X.table(spark, sf, "orders"), (j,), (Dimension("segment", "customer.c_mktsegment"),),
                    (Measure("orders", "COUNT(*)"),))
    return mv.query(spark, ["orders"], ["segment"])


@query(
    "q_from_model",
    f"""SELECT l_return_flag AS l_return_flag, {dbl('SUM(p)')} AS total, COUNT(DISTINCT k) AS parts, part_brand
    FROM (SELECT l_returnflag AS l_return_flag, p_brand AS part_brand, {PRC} AS p, l_partkey AS k
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) GROUP BY 1, 4""",
)
def from_model(spark, sf):
    """A view built from a tabular model: relationships become joins, columns become dimensions."""
    lines = X.table(spark, sf, "lineitem").selectExpr("l_partkey AS part_key", "l_returnflag AS l_return_flag", f"{X.PRICE} AS amount")
    part = X.table(spark, sf, "part").selectExpr("p_partkey AS part_key", "p_brand AS brand")
    mv = MetricView.from_model(
        {
            "name": "sales",
            "fact_table": "Sales",
            "tables": [
                {"name": "Sales", "table": "unused", "columns": ["PartKey", "LReturnFlag"]},
                {"name": "DimPart", "table": part, "columns": ["PartKey", "Brand"]},
            ],
            "source": lines,
            "relationships": [
                {"from_table": "Sales", "from_column": "PartKey", "to_table": "DimPart", "to_column": "PartKey"}
            ],
            "measures": [{"name": "total", "expr": "SUM(amount)"}, {"name": "parts", "expr": "COUNT(DISTINCT part_key)"}],
        }
    )
    return mv.query(spark, ["total", "parts"], ["l_return_flag", "part_brand"])


@query(
    "q_from_cube",
    f"""SELECT CAST(year(o_orderdate) AS INT) AS date_year, CAST(month(o_orderdate) AS INT) AS date_month, {dbl(f'SUM({AMT})')} AS total
    FROM orders GROUP BY 1, 2""",
)
def from_cube(spark, sf):
    """A view built from a cube: hierarchy levels become dimensions."""
    orders = X.table(spark, sf, "orders").selectExpr("CAST(o_orderdate AS DATE) AS date_key", f"{X.AMOUNT} AS amount")
    calendar = X.calendar_of(X.table(spark, sf, "orders"), "o_orderdate")
    mv = MetricView.from_cube(
        {
            "name": "Sales Cube",
            "fact": {"table": orders},
            "dimensions": [
                {
                    "name": "Date", "table": calendar, "join_key": "date_key", "dim_key": "date",
                    "attributes": ["Date"], "hierarchies": [{"name": "Calendar", "levels": ["Year", "Month", "Date"]}],
                }
            ],
            "measures": [{"name": "total", "expr": "SUM(amount)"}],
        }
    )
    return mv.query(spark, ["total"], ["date_year", "date_month"])


@query("q_check_one_side", "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def check_one_side(spark, sf):
    return star.check_one_side(X.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "q_cross_members",
    f"""SELECT c_mktsegment AS segment, o_orderdate::DATE AS day, {dbl(f'SUM({AMT})')} AS total FROM {OC} WHERE o_orderstatus = 'P' GROUP BY 1, 2""",
    dates="day",
)
def cross_members(spark, sf):
    """Cells of segment and day members; empty cells are not made."""
    return members.cross_members(X.orders_view(spark, sf), spark, ["segment", "day"], ["total"], where="status = 'P'")


# ================================================================ members


@query("q_members", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_members(spark, sf):
    return members.members(X.table(spark, sf, "part"), "p_brand", "p_type")


@query(
    "q_members_where",
    f"""SELECT o_custkey AS custkey, {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F')")} AS value FROM orders
    GROUP BY 1 HAVING SUM({AMT}) FILTER (WHERE o_orderstatus = 'F') > 1000000""",
)
def members_where(spark, sf):
    return members.members_where(X.orders_view(spark, sf), spark, "custkey", "active_total", "value > 1000000")


@query(
    "q_query_members_where",
    f"""WITH c AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING SUM({AMT}) > 3000000)
    SELECT o_orderstatus AS status, {dbl(f'SUM({AMT})')} AS total, COUNT(*) AS orders FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM c) GROUP BY 1""",
)
def query_members_where(spark, sf):
    mv = X.orders_view(spark, sf)
    return members.query_members_where(mv, spark, ["total", "orders"], ["status"], "custkey", "total", "value > 3000000")


@query(
    "q_count_members_where",
    f"""WITH v AS (SELECT c_mktsegment AS segment, o_custkey, SUM({AMT}) AS value FROM {OC} GROUP BY 1, 2)
    SELECT segment, COUNT(*) FILTER (WHERE value > 2500000) AS result FROM v GROUP BY 1""",
)
def count_members_where(spark, sf):
    return members.count_members_where(X.orders_view(spark, sf), spark, "total", "custkey", "value > 2500000", ["segment"])


@query(
    "q_over_members_max",
    f"""WITH v AS (SELECT c_mktsegment AS segment, o_custkey, SUM({AMT}) AS value FROM {OC} GROUP BY 1, 2)
    SELECT segment, {dbl('MAX(value)')} AS result FROM v GROUP BY 1""",
)
def over_members_max(spark, sf):
    return members.over_members(X.orders_view(spark, sf), spark, "total", "custkey", "MAX(value)", ["segment"])


@query(
    "q_over_periods_avg",
    f"""WITH v AS (SELECT c_mktsegment AS segment, date_trunc('month', o_orderdate) AS mo, SUM({AMT}) AS value FROM {OC} GROUP BY 1, 2)
    SELECT segment, {dbl('SUM(value)')} / COUNT(value) AS result FROM v GROUP BY 1""",
)
def over_periods_avg(spark, sf):
    """Average over months of the monthly total."""
    return members.over_members(
        X.orders_view(spark, sf), spark, "total", "month", "CAST(SUM(value) AS DOUBLE) / COUNT(value)", ["segment"]
    )


@query(
    "q_new_members",
    """WITH f AS (SELECT o_custkey, MIN(o_orderdate) AS first_day FROM orders GROUP BY 1)
    SELECT CAST(date_trunc('month', first_day) AS DATE) AS period, COUNT(*) AS new_members FROM f GROUP BY 1""",
    dates="period",
)
def new_members(spark, sf):
    return members.new_members(X.orders_view(spark, sf), spark, "custkey", "day", "month")


@query(
    "q_concatenatex",
    """SELECT p_brand AS brand, 0 AS part, 1 AS parts, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS members FROM part GROUP BY 1""",
)
def concatenatex(spark, sf):
    mv = MetricView("mv_part", X.table(spark, sf, "part"), (), (Dimension("brand", "p_brand"), Dimension("type", "p_type")))
    return members.concatenatex(mv, spark, "type", ["brand"])


@query(
    "q_concatenatex_parts",
    """WITH m AS (SELECT DISTINCT p_brand AS brand, p_type AS type FROM part),
    n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY brand ORDER BY type) - 1) / 4) AS INT) AS part,
      CAST(ceil(COUNT(*) OVER (PARTITION BY brand) / 4) AS INT) AS parts FROM m)
    SELECT brand, part, parts, string_agg(type, '; ' ORDER BY type) AS members FROM n GROUP BY 1, 2, 3""",
)
def concatenatex_parts(spark, sf):
    """Lists in parts of four members."""
    mv = MetricView("mv_part", X.table(spark, sf, "part"), (), (Dimension("brand", "p_brand"), Dimension("type", "p_type")))
    return members.concatenatex(mv, spark, "type", ["brand"], sep="; ", size=4)


# ================================================================ shares


@query(
    "q_pct_of_total",
    f"""WITH t AS (SELECT SUM({AMT}) AS v FROM orders), g AS (SELECT c_mktsegment AS segment, SUM({AMT}) AS v FROM {OC}
    WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT g.segment, {dbl('g.v')} AS total, {dbl('t.v')} AS scope_total, {dbl('g.v')} / {dbl('t.v')} AS pct FROM g, t""",
)
def pct_of_total(spark, sf):
    """The grand total does not see the condition."""
    return shares.pct_of_total(X.orders_view(spark, sf), spark, "total", ["segment"], where="status = 'F'")


@query(
    "q_pct_of_total_distinct",
    f"""WITH t AS (SELECT COUNT(DISTINCT o_custkey) AS v FROM orders), g AS (SELECT o_orderpriority AS priority,
    COUNT(DISTINCT o_custkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT g.priority, g.v AS customers, t.v AS scope_total, {dbl('g.v')} / {dbl('t.v')} AS pct FROM g, t""",
)
def pct_of_total_distinct(spark, sf):
    return shares.pct_of_total(X.orders_view(spark, sf), spark, "customers", ["priority"], where="status = 'F'")


@query(
    "q_pct_allexcept",
    f"""WITH g AS (SELECT p_type AS type, p_brand AS brand, SUM({PRC}) AS v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT type, brand, {dbl('v')} AS gross, {dbl('SUM(v) OVER (PARTITION BY type)')} AS scope_total,
    {dbl('v')} / {dbl('SUM(v) OVER (PARTITION BY type)')} AS pct FROM g""",
)
def pct_allexcept(spark, sf):
    return shares.pct_of(X.lines_view(spark, sf), spark, "gross", ["type", "brand"], keep=["type"])


@query(
    "q_pct_remove_cols",
    f"""WITH g AS (SELECT p_type AS type, p_brand AS brand, l_partkey AS partkey, SUM({PRC}) AS v
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
    SELECT type, brand, partkey, {dbl('v')} AS gross, {dbl('SUM(v) OVER (PARTITION BY type)')} AS scope_total,
    {dbl('v')} / {dbl('SUM(v) OVER (PARTITION BY type)')} AS pct FROM g""",
)
def pct_remove_cols(spark, sf):
    return shares.pct_of(X.lines_view(spark, sf), spark, "gross", ["type", "brand", "partkey"], remove=["brand", "partkey"])


@query(
    "q_pct_selected",
    f"""WITH g AS (SELECT c_mktsegment AS segment, SUM({AMT}) AS v FROM {OC} WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT segment, {dbl('v')} AS total, {dbl('SUM(v) OVER ()')} AS scope_total, {dbl('v')} / {dbl('SUM(v) OVER ()')} AS pct FROM g""",
)
def pct_selected(spark, sf):
    return shares.pct_of_selected(X.orders_view(spark, sf), spark, "total", ["segment"], "status = 'F'")


@query(
    "q_pct_parent",
    f"""WITH g AS (SELECT r_name AS region_name, n_name AS nation_name, SUM({AMT}) AS v FROM {OCNR} GROUP BY 1, 2)
    SELECT region_name, nation_name, {dbl('v')} AS total, {dbl('SUM(v) OVER (PARTITION BY region_name)')} AS scope_total,
    {dbl('v')} / {dbl('SUM(v) OVER (PARTITION BY region_name)')} AS pct FROM g""",
)
def pct_parent(spark, sf):
    return shares.pct_of_parent(X.orders_view(spark, sf), spark, "total", ["region_name", "nation_name"])


@query(
    "q_hierarchy_rollup",
    f"""SELECT r_name AS region_name, n_name AS nation_name, c_mktsegment AS segment,
    CAST(3 - GROUPING(r_name) - GROUPING(n_name) - GROUPING(c_mktsegment) AS INT) AS level,
    {dbl(f'SUM({AMT})')} AS total, COUNT(DISTINCT o_custkey) AS customers, {dbl(f'SUM({AMT})')} / COUNT({AMT}) AS avg_order
    FROM {OCNR} GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
)
def hierarchy_rollup(spark, sf):
    return shares.hierarchy_rollup(
        X.orders_view(spark, sf), spark, ["region_name", "nation_name", "segment"], ["total", "customers", "avg_order"]
    )


@query(
    "q_custom_rollup",
    f"""SELECT c_mktsegment AS segment, {dbl(f"SUM(CASE o_orderstatus WHEN 'F' THEN {AMT} WHEN 'O' THEN -{AMT} ELSE 0 END)")} AS rollup
    FROM {OC} GROUP BY 1""",
)
def custom_rollup(spark, sf):
    return shares.custom_rollup(
        X.orders_view(spark, sf), spark, "total", "status", {"F": "+", "O": "-", "P": "~"}, ["segment"]
    )


# ================================================================ query surface


@query(
    "q_global_filter",
    f"SELECT o_orderpriority AS priority, {dbl(f'SUM({AMT})')} AS total FROM {OC} WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 50000 GROUP BY 1",
)
def global_filter(spark, sf):
    import dataclasses

    mv = dataclasses.replace(X.orders_view(spark, sf), filter="customer.c_mktsegment = 'BUILDING' AND o_totalprice > 50000")
    return mv.query(spark, ["total"], ["priority"])


@query(
    "q_where_dimension",
    f"""SELECT r_name AS region_name, {dbl(f'SUM({AMT})')} AS total FROM {OCNR}
    WHERE o_orderstatus = 'O' AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""",
)
def where_dimension(spark, sf):
    return X.orders_view(spark, sf).query(
        spark, ["total"], ["region_name"], where=["status = 'O'", "segment IN ('BUILDING', 'MACHINERY')"]
    )


@query(
    "q_global_agg",
    f"SELECT {dbl(f'SUM({AMT})')} AS total, COUNT(*) AS orders, COUNT(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderstatus = 'none'",
)
def global_agg(spark, sf):
    """No dimensions: one row, also for an empty selection."""
    return X.orders_view(spark, sf).query(spark, ["total", "orders", "customers"], where="status = 'none'")


@query(
    "q_limit_ordered",
    f"SELECT o_custkey AS custkey, {dbl(f'SUM({AMT})')} AS total FROM orders GROUP BY 1 ORDER BY 1 LIMIT 100",
)
def limit_ordered(spark, sf):
    return X.orders_view(spark, sf).query(spark, ["total"], ["custkey"], limit=100)


@query(
    "q_order_members",
    f"SELECT c_mktsegment AS segment, {dbl(f'SUM({AMT})')} AS total FROM {OC} GROUP BY 1 ORDER BY 2 DESC",
)
def order_members(spark, sf):
    return ranking.order_members(X.orders_view(spark, sf).query(spark, ["total"], ["segment"]), "total")


@query(
    "q_mixed_windows",
    f"""WITH {DAILY}, y AS (SELECT day, SUM(v) OVER (PARTITION BY year(day) ORDER BY day) AS ytd, SUM(v) OVER () AS total_all FROM dd),
    p AS (SELECT o_orderdate::DATE AS day, SUM({AMT}) AS total, COUNT(*) AS orders FROM orders GROUP BY 1)
    SELECT p.day, {dbl('total')} AS total, orders, {dbl('ytd')} AS ytd, {dbl('total_all')} AS total_all FROM p JOIN y ON p.day = y.day""",
    dates="day",
)
def mixed_windows(spark, sf):
    """Plain measures and measures of two window kinds in one query."""
    return X.orders_view(spark, sf).query(spark, ["total", "orders", "ytd", "total_all"], ["day"])


# ================================================================ time


@query(
    "q_running_total",
    f"""WITH g AS (SELECT c_mktsegment AS segment, o_orderdate::DATE AS day, SUM({AMT}) AS v FROM {OC} GROUP BY 1, 2)
    SELECT segment, day, {dbl('SUM(v) OVER (PARTITION BY segment ORDER BY day)')} AS total FROM g""",
    dates="day",
)
def running_total(spark, sf):
    return timeline.running_total(X.orders_view(spark, sf), spark, "total", "day", ["segment"])


@query(
    "q_ytd",
    f"""WITH g AS (SELECT c_mktsegment AS segment, o_orderdate::DATE AS day, SUM({AMT}) AS v FROM {OC} GROUP BY 1, 2),
    y AS (SELECT *, SUM(v) OVER (PARTITION BY segment, year(day) ORDER BY day) AS ytd FROM g)
    SELECT segment, CAST(date_trunc('month', day) AS DATE) AS month, {dbl('max_by(ytd, day)')} AS ytd FROM y GROUP BY 1, 2""",
    dates="month",
)
def ytd(spark, sf):
    """A window over days within years, asked for by month: the last day of each month."""
    return X.orders_view(spark, sf).query(spark, ["ytd"], ["segment", "month"])


@query(
    "q_ytd_time_filter",
    f"""WITH {DAILY}, y AS (SELECT day, SUM(v) OVER (PARTITION BY year(day) ORDER BY day) AS ytd FROM dd)
    SELECT day, {dbl('ytd')} AS ytd FROM y WHERE day >= DATE '1997-06-15' AND day < DATE '1997-09-01'""",
    dates="day",
)
def ytd_time_filter(spark, sf):
    """A condition on the order dimension does not cut the days before it out of the window."""
    return X.orders_view(spark, sf).query(
        spark, ["ytd"], ["day"], where=["day >= DATE'1997-06-15'", "day < DATE'1997-09-01'"]
    )


@query(
    "q_qtd_mtd",
    f"""WITH {DAILY} SELECT day, {dbl("SUM(v) OVER (PARTITION BY date_trunc('quarter', day) ORDER BY day)")} AS qtd,
    {dbl("SUM(v) OVER (PARTITION BY date_trunc('month', day) ORDER BY day)")} AS mtd FROM dd""",
    dates="day",
)
def qtd_mtd(spark, sf):
    mv = X.orders_view(spark, sf)
    q = timeline.period_to_date(mv, spark, "total", "day", "quarter").withColumnRenamed("total", "qtd")
    m = timeline.period_to_date(mv, spark, "total", "day", "month").withColumnRenamed("total", "mtd")
    return join_on(q, m, ["day"])


def _trail(name: str, bounds: str, range_: str, anchor: bool):
    @query(
        name,
        f"""WITH g AS (SELECT o_orderstatus AS status, o_orderdate::DATE AS day, SUM({AMT}) AS v, COUNT(*) AS n FROM orders GROUP BY 1, 2)
        SELECT status, day, {dbl(f'SUM(v) OVER w')} AS total,
        CAST(COALESCE(SUM(n) OVER w, 0) AS BIGINT) AS orders,
        {dbl('SUM(v) OVER w')} / SUM(n) OVER w AS avg_order
        FROM g WINDOW w AS (PARTITION BY status ORDER BY day RANGE BETWEEN {bounds})""",
        dates="day",
    )
    def run(spark, sf):
        mv = X.orders_view(spark, sf)
        w = (Window("day", range_, include_anchor=anchor),)
        ms = [Measure(n, mv.measure(n).expr, window=w) for n in ("total", "orders", "avg_order")]
        return mv.query(spark, ms, ["status", "day"])


_trail("q_trailing_days", "INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING", "trailing 7 day", False)
_trail("q_trailing_days_anchor", "INTERVAL 6 DAY PRECEDING AND CURRENT ROW", "trailing 7 day", True)
_trail("q_trailing_90_days", "INTERVAL 89 DAY PRECEDING AND CURRENT ROW", "trailing 90 day", True)
_trail("q_trailing_months", "INTERVAL 2 MONTH PRECEDING AND INTERVAL 1 DAY PRECEDING", "trailing_2_months", False)


@query(
    "q_leading_month_anchor",
    f"""WITH {DAILY} SELECT a.day, {dbl('SUM(b.v)')} AS total, {dbl('MAX(b.v)')} AS best FROM dd a JOIN dd b
    ON b.day >= a.day AND b.day < CAST(a.day + INTERVAL 1 MONTH AS DATE) GROUP BY 1""",
    dates="day",
)
def leading_month_anchor(spark, sf):
    mv = X.orders_view(spark, sf)
    daily = mv.query(spark, ["total"], ["day"])
    days = MetricView("mv_days", daily, (), (Dimension("day", "day"),), ())
    w = (Window("day", "leading 1 month", include_anchor=True),)
    ms = [Measure("total", "SUM(total)", window=w), Measure("best", "MAX(total)", window=w)]
    return days.query(spark, ms, ["day"])


_trail("q_leading_days", "INTERVAL 1 DAY FOLLOWING AND INTERVAL 14 DAY FOLLOWING", "leading 2 week", False)


@query(
    "q_trailing_month_anchor",
    f"""WITH {DAILY} SELECT a.day, {dbl('SUM(b.v)')} AS total FROM dd a JOIN dd b
    ON b.day > CAST(a.day - INTERVAL 1 MONTH AS DATE) AND b.day <= a.day GROUP BY 1""",
    dates="day",
)
def trailing_month_anchor(spark, sf):
    return timeline.trailing(X.orders_view(spark, sf), spark, "total", "day", 1, "month", include_anchor=True)


def _events(spark, sf) -> MetricView:
    cents = "CAST(value AS DECIMAL(12,2))"
    return MetricView(
        "mv_events", f"{sf}/events.parquet", (),
        (Dimension("kind", "event_type"), Dimension("at", "ts"), Dimension("hour", "date_trunc('HOUR', ts)")),
        (Measure("value", A.sum_(cents)), Measure("events", A.count_rows()), Measure("top", A.max_(cents))),
    )


def _hours(name: str, bounds: str, range_: str, anchor: bool):
    @query(
        name,
        f"""WITH e AS (SELECT event_type AS kind, ts, CAST(value AS DECIMAL(12,2)) AS v FROM events)
        SELECT kind, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, {dbl('SUM(v) OVER w')} AS value, COUNT(*) OVER w AS events, {dbl('MAX(v) OVER w')} AS top
        FROM e WINDOW w AS (PARTITION BY kind ORDER BY ts RANGE BETWEEN {bounds})""",
    )
    def run(spark, sf):
        """Hours over raw timestamps; a busy group is cut into slices of time."""
        mv = _events(spark, sf)
        w = (Window("at", range_, include_anchor=anchor),)
        df = mv.query(spark, [Measure(m.name, m.expr, window=w) for m in mv.measures], ["kind", "at"])
        return df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_hours("q_trailing_hours", "INTERVAL 3 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING", "trailing 3 hours", False)
_hours("q_leading_hours", "CURRENT ROW AND INTERVAL 107999999999 MICROSECOND FOLLOWING", "leading 30 hour", True)


@query(
    "q_running_total_timestamps",
    f"""WITH e AS (SELECT event_type AS kind, ts, CAST(value AS DECIMAL(12,2)) AS v FROM events)
    SELECT kind, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, {dbl('SUM(v) OVER w')} AS value, COUNT(*) OVER w AS events, {dbl('MAX(v) OVER w')} AS top
    FROM e WINDOW w AS (PARTITION BY kind ORDER BY ts)""",
)
def running_total_timestamps(spark, sf):
    mv = _events(spark, sf)
    w = (Window("at", "cumulative"),)
    df = mv.query(spark, [Measure(m.name, m.expr, window=w) for m in mv.measures], ["kind", "at"])
    return df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "q_cumulative_distinct_timestamps",
    """WITH e AS (SELECT event_type AS kind, ts, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts) AS n FROM events)
    SELECT kind, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, CAST(SUM(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY ts) AS BIGINT) AS users
    FROM e""",
)
def cumulative_distinct_timestamps(spark, sf):
    """Users seen so far at every event of a kind."""
    mv = _events(spark, sf)
    m = Measure("users", A.distinct_count("user_id"), window=(Window("at", "cumulative"),))
    df = mv.query(spark, [m], ["kind", "at"])
    return df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "q_trailing_month_timestamps",
    f"""WITH e AS (SELECT event_type AS kind, ts, CAST(value AS DECIMAL(12,2)) AS v FROM events)
    SELECT kind, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, {dbl('SUM(v) OVER w')} AS value, COUNT(*) OVER w AS events
    FROM e WINDOW w AS (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL '1 month -1 microsecond' PRECEDING AND CURRENT ROW)""",
)
def trailing_month_timestamps(spark, sf):
    """Sums over a calendar month up to every event."""
    mv = _events(spark, sf)
    w = (Window("at", "trailing 1 month", include_anchor=True),)
    df = mv.query(spark, [Measure(m.name, m.expr, window=w) for m in mv.measures if m.name in ("value", "events")], ["kind", "at"])
    return df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "q_extremes_month_timestamps",
    f"""WITH e AS (SELECT event_type AS kind, ts, CAST(value AS DECIMAL(12,2)) AS v FROM events), a AS (SELECT DISTINCT kind, ts FROM e)
    SELECT a.kind, strftime(a.ts, '%Y-%m-%d %H:%M:%S.%f') AS at, {dbl('MIN(e.v)')} AS low, {dbl('MAX(e.v)')} AS high, {dbl('SUM(e.v)')} AS value
    FROM a LEFT JOIN e ON e.kind = a.kind AND e.ts >= a.ts - INTERVAL 2 MONTH AND e.ts < a.ts GROUP BY a.kind, a.ts""",
)
def extremes_month_timestamps(spark, sf):
    """Extremes, and a sum beside them, over the two months before every event."""
    mv, w = _events(spark, sf), (Window("at", "trailing 2 month"),)
    cents = "CAST(value AS DECIMAL(12,2))"
    ms = [Measure(n, fn(cents), window=w) for n, fn in (("low", A.min_), ("high", A.max_), ("value", A.sum_))]
    return mv.query(spark, ms, ["kind", "at"]).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "q_extremes_months",
    f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, MIN({AMT}) AS lo, MAX({AMT}) AS hi FROM orders GROUP BY 1)
    SELECT a.day, {dbl('MIN(b.lo)')} AS low, {dbl('MAX(b.hi)')} AS high FROM d a
    LEFT JOIN d b ON b.day > a.day AND b.day <= CAST(a.day + INTERVAL 3 MONTH AS DATE) GROUP BY 1""",
    dates="day",
)
def extremes_months(spark, sf):
    """Extremes over the three months after every day."""
    w = (Window("day", "leading 3 month"),)
    ms = [Measure("low", A.min_(X.AMOUNT), window=w), Measure("high", A.max_(X.AMOUNT), window=w)]
    return X.orders_view(spark, sf).query(spark, ms, ["day"])


@query(
    "q_trailing_days_without_groups",
    f"""WITH e AS (SELECT ts, SUM(CAST(value AS DECIMAL(12,2))) AS v, COUNT(*) AS n, MAX(CAST(value AS DECIMAL(12,2))) AS m FROM events GROUP BY 1)
    SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, {dbl('SUM(v) OVER w')} AS value, CAST(SUM(n) OVER w AS BIGINT) AS events, {dbl('MAX(m) OVER w')} AS top
    FROM e WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 7775999999999 MICROSECOND PRECEDING AND CURRENT ROW)""",
)
def trailing_days_without_groups(spark, sf):
    """Ninety days up to every event, all kinds together: blocks of any number of rows are cut into ranges."""
    mv, w = _events(spark, sf), (Window("at", "trailing 90 day", include_anchor=True),)
    df = mv.query(spark, [Measure(m.name, m.expr, window=w) for m in mv.measures], ["at"])
    return df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "q_trailing_distinct_timestamps",
    """WITH e AS (SELECT DISTINCT event_type AS kind, ts FROM events)
    SELECT e.kind, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS at, COUNT(DISTINCT b.user_id) AS users FROM e
    LEFT JOIN events b ON b.event_type = e.kind AND b.ts > e.ts - INTERVAL 3 DAY AND b.ts <= e.ts GROUP BY e.kind, e.ts""",
)
def trailing_distinct_timestamps(spark, sf):
    """Users of the last three days at every event."""
    mv = _events(spark, sf)
    m = Measure("users", A.distinct_count("user_id"), window=(Window("at", "trailing 3 day", include_anchor=True),))
    return mv.query(spark, [m], ["kind", "at"]).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "q_trailing_distinct_month_timestamps",
    """WITH e AS (SELECT DISTINCT event_type AS kind, ts FROM events)
    SELECT e.kind, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS at, COUNT(DISTINCT b.user_id) AS users FROM e
    LEFT JOIN events b ON b.event_type = e.kind AND b.ts >= e.ts - INTERVAL 1 MONTH AND b.ts < e.ts GROUP BY e.kind, e.ts""",
)
def trailing_distinct_month_timestamps(spark, sf):
    """Users of the calendar month before every event."""
    mv = _events(spark, sf)
    m = Measure("users", A.distinct_count("user_id"), window=(Window("at", "trailing 1 month"),))
    return mv.query(spark, [m], ["kind", "at"]).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "q_two_frames",
    f"""WITH c AS (SELECT l_returnflag AS flag, CAST(o_orderdate AS DATE) AS ordered, CAST(l_shipdate AS DATE) AS shipped, SUM({PRC}) AS v, COUNT(*) AS n, MAX({PRC}) AS m
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT a.flag, a.ordered, a.shipped, {dbl('SUM(b.v)')} AS gross, CAST(COALESCE(SUM(b.n), 0) AS BIGINT) AS lines, {dbl('MAX(b.m)')} AS top FROM c a
    LEFT JOIN c b ON a.flag = b.flag AND b.ordered >= CAST(a.ordered - INTERVAL 3 MONTH AS DATE) AND b.ordered < a.ordered AND b.shipped <= a.shipped
    GROUP BY 1, 2, 3""",
    dates="ordered shipped",
)
def two_frames(spark, sf):
    """What was ordered in the three months before a line's order and shipped by the day the line was."""
    w = (Window("ordered", "trailing 3 month"), Window("shipped", "cumulative"))
    orders = Join("orders", f"{sf}/orders.parquet", "source.l_orderkey = orders.o_orderkey")
    mv = MetricView(
        "mv_lines", f"{sf}/lineitem.parquet", (orders,),
        (Dimension("flag", "l_returnflag"), Dimension("ordered", "CAST(orders.o_orderdate AS DATE)"), Dimension("shipped", "CAST(l_shipdate AS DATE)")),
        tuple(Measure(n, e, window=w) for n, e in (("gross", A.sum_(PRC)), ("lines", A.count_rows()), ("top", A.max_(PRC)))),
    )
    return mv.query(spark, ["gross", "lines", "top"], ["flag", "ordered", "shipped"])


@query(
    "q_rolling_month_avg",
    f"""WITH {MONTHLY} SELECT month AS day, {dbl('v')} AS total,
    {dbl('SUM(v) OVER w')} / COUNT(v) OVER w AS rolling FROM m WINDOW w AS (ORDER BY month RANGE BETWEEN INTERVAL 5 MONTH PRECEDING AND CURRENT ROW)""",
    dates="day",
)
def rolling_month_avg(spark, sf):
    return timeline.rolling(X.orders_view(spark, sf), spark, "total", "day", 6, "month", "avg")


def _distinct(name: str, cond: str, range_: str, anchor: bool = False, dims=("priority",)):
    key = "o_orderpriority AS priority, " if dims else ""
    on = " AND a.priority = b.priority" if dims else ""
    out = "a.priority, " if dims else ""

    @query(
        name,
        f"""WITH g AS (SELECT DISTINCT {key}o_orderdate::DATE AS day FROM orders),
        k AS (SELECT DISTINCT {key}o_orderdate::DATE AS day, o_custkey FROM orders)
        SELECT {out}a.day, COUNT(DISTINCT b.o_custkey) AS customers FROM g a LEFT JOIN k b ON {cond}{on} GROUP BY ALL""",
        dates="day",
    )
    def run(spark, sf):
        mv = X.orders_view(spark, sf)
        m = Measure("customers", A.distinct_count("o_custkey"), window=(Window("day", range_, include_anchor=anchor),))
        return mv.query(spark, [m], [*dims, "day"])


_distinct("q_trailing_distinct", "b.day >= a.day - INTERVAL 7 DAY AND b.day < a.day", "trailing 7 day")
_distinct("q_trailing_distinct_anchor", "b.day > a.day - INTERVAL 30 DAY AND b.day <= a.day", "trailing 30 day", True)
_distinct(
    "q_trailing_distinct_months",
    "b.day >= CAST(a.day - INTERVAL 1 MONTH AS DATE) AND b.day < a.day", "trailing 1 month", False, ())
_distinct("q_leading_distinct", "b.day > a.day AND b.day <= a.day + INTERVAL 10 DAY", "leading 10 day")


@query(
    "q_cumulative_distinct",
    """WITH f AS (SELECT o_custkey, MIN(o_orderdate)::DATE AS day FROM orders GROUP BY 1),
    d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
    SELECT d.day, COUNT(f.o_custkey) AS customers_to_date FROM d LEFT JOIN f ON f.day <= d.day GROUP BY 1""",
    dates="day",
)
def cumulative_distinct(spark, sf):
    return X.orders_view(spark, sf).query(spark, ["customers_to_date"], ["day"])


@query(
    "q_window_all",
    f"""WITH g AS (SELECT o_orderstatus AS status, o_orderdate::DATE AS day, SUM({AMT}) AS v FROM orders GROUP BY 1, 2)
    SELECT status, day, {dbl('SUM(v) OVER (PARTITION BY status)')} AS total_all FROM g""",
    dates="day",
)
def window_all(spark, sf):
    return X.orders_view(spark, sf).query(spark, ["total_all"], ["status", "day"])


@query(
    "q_window_current",
    f"""SELECT o_orderstatus AS status, o_orderdate::DATE AS day, {dbl(f'SUM({AMT})')} AS closing FROM orders GROUP BY 1, 2""",
    dates="day",
)
def window_current(spark, sf):
    """The range `current` at its own grain is the plain value."""
    return X.orders_view(spark, sf).query(spark, ["closing"], ["status", "day"])


@query(
    "q_trailing_ratio",
    f"""WITH g AS (SELECT o_orderpriority AS priority, o_orderdate::DATE AS day, SUM({AMT}) AS v, SUM({AMT}) FILTER (WHERE o_orderstatus = 'F') AS f,
    COUNT(o_totalprice) AS n FROM orders GROUP BY 1, 2)
    SELECT priority, day, {dbl('SUM(f) OVER w')} / NULLIF({dbl('SUM(v) OVER w')}, 0) AS active_share, {dbl('SUM(v) OVER w')} / SUM(n) OVER w AS avg_order
    FROM g WINDOW w AS (PARTITION BY priority ORDER BY day RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW)""",
    dates="day",
)
def trailing_ratio(spark, sf):
    """Numerator and denominator of a ratio run through the window separately."""
    mv = X.orders_view(spark, sf)
    w = (Window("day", "trailing 4 weeks", include_anchor=True),)
    ms = [Measure(n, mv.measure(n).expr, window=w) for n in ("active_share", "avg_order")]
    return mv.query(spark, ms, ["priority", "day"])


@query(
    "q_same_period_last_year",
    f"""WITH g AS (SELECT c_mktsegment AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, SUM({AMT}) AS v FROM {OC} GROUP BY 1, 2)
    SELECT a.segment, a.day, {dbl('a.v')} AS total, {dbl('b.v')} AS total_prior FROM g a
    LEFT JOIN g b ON a.segment = b.segment AND b.day = CAST(a.day - INTERVAL 12 MONTH AS DATE) WHERE a.day >= DATE '1996-01-01'""",
    dates="day",
)
def same_period_last_year(spark, sf):
    """The condition on the date applies after the lookup, so 1996 finds 1995."""
    return timeline.same_period_last_year(
        X.orders_view(spark, sf), spark, "total", "day", "month", ["segment"], where="day >= DATE'1996-01-01'"
    )


@query(
    "q_same_day_last_year",
    f"""WITH {DAILY} SELECT a.day, {dbl('a.v')} AS total, {dbl('b.v')} AS total_prior FROM dd a
    LEFT JOIN dd b ON b.day = CAST(a.day - INTERVAL 12 MONTH AS DATE)""",
    dates="day",
)
def same_day_last_year(spark, sf):
    return timeline.same_period_last_year(X.orders_view(spark, sf), spark, "total", "day", "day")


@query(
    "q_date_shift_month",
    f"""WITH {MONTHLY} SELECT a.month AS day, {dbl('a.v')} AS total, {dbl('b.v')} AS total_prior FROM m a
    LEFT JOIN m b ON b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE)""",
    dates="day",
)
def date_shift_month(spark, sf):
    return timeline.date_shift(X.orders_view(spark, sf), spark, "total", "day", -1, "month")


@query(
    "q_date_shift_week",
    f"""WITH {DAILY} SELECT a.day, {dbl('a.v')} AS total, {dbl('b.v')} AS total_prior FROM dd a
    LEFT JOIN dd b ON b.day = CAST(a.day + INTERVAL 14 DAY AS DATE)""",
    dates="day",
)
def date_shift_week(spark, sf):
    return timeline.date_shift(X.orders_view(spark, sf), spark, "total", "day", 2, "week", grain="day")


@query(
    "q_yoy",
    f"""WITH {MONTHLY} SELECT a.month AS day, {dbl('a.v')} AS total, {dbl('b.v')} AS total_prior,
    ({dbl('a.v')} - {dbl('b.v')}) / NULLIF({dbl('b.v')}, 0) AS growth FROM m a
    LEFT JOIN m b ON b.month = CAST(a.month - INTERVAL 12 MONTH AS DATE)""",
    dates="day",
)
def yoy(spark, sf):
    return timeline.yoy(X.orders_view(spark, sf), spark, "total", "day", "month")


@query(
    "q_ytd_vs_prior",
    f"""WITH {MONTHLY}, y AS (SELECT month, SUM(v) OVER (PARTITION BY year(month) ORDER BY month) AS ytd FROM m)
    SELECT a.month AS day, {dbl('a.ytd')} AS total, {dbl('b.ytd')} AS total_prior, {dbl('a.ytd - b.ytd')} AS difference FROM y a
    LEFT JOIN y b ON b.month = CAST(a.month - INTERVAL 12 MONTH AS DATE)""",
    dates="day",
)
def ytd_vs_prior(spark, sf):
    return timeline.ytd_vs_py(X.orders_view(spark, sf), spark, "total", "day")


@query(
    "q_closing_month",
    f"""WITH g AS (SELECT c_mktsegment AS segment, o_orderdate::DATE AS day, SUM({AMT}) AS v FROM {OC} GROUP BY 1, 2)
    SELECT segment, CAST(date_trunc('month', day) AS DATE) AS period, MAX(day) AS closing_date, {dbl('max_by(v, day)')} AS total
    FROM g GROUP BY 1, 2""",
    dates="period closing_date",
)
def closing_month(spark, sf):
    return timeline.closing(X.orders_view(spark, sf), spark, "total", "day", "month", ["segment"])


@query(
    "q_semi_additive_last",
    f"""WITH g AS (SELECT c_mktsegment AS segment, o_orderdate::DATE AS day, SUM({AMT}) AS v FROM {OC} GROUP BY 1, 2),
    l AS (SELECT segment, max_by(v, day) AS last_v, min_by(v, day) AS first_v FROM g GROUP BY 1)
    SELECT segment, {dbl('last_v')} AS closing, {dbl('first_v')} AS opening FROM l""",
)
def semi_additive_last(spark, sf):
    mv = X.orders_view(spark, sf)
    last = mv.query(spark, ["closing"], ["segment"])
    first = timeline.semi_additive(mv, spark, "total", "day", ["segment"], how="first")
    return join_on(last, first.withColumnRenamed("total", "opening"), ["segment"])


@query(
    "q_lag_lead",
    f"""WITH g AS (SELECT o_orderpriority AS priority, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, SUM({AMT}) AS v
    FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2),
    x AS (SELECT MIN(day) AS lo, MAX(day) AS hi FROM g),
    ax AS (SELECT p.priority, CAST(u.t AS DATE) AS day FROM (SELECT DISTINCT priority FROM g) p, x, unnest(generate_series(x.lo::TIMESTAMP, x.hi::TIMESTAMP, INTERVAL 1 MONTH)) AS u(t))
    SELECT ax.priority, ax.day, {dbl('g.v')} AS total, {dbl('LAG(g.v, 2) OVER w')} AS total_lag, {dbl('LEAD(g.v, 1) OVER w')} AS total_lead
    FROM ax LEFT JOIN g ON g.priority = ax.priority AND g.day = ax.day WINDOW w AS (PARTITION BY ax.priority ORDER BY ax.day)""",
    dates="day",
)
def lag_lead(spark, sf):
    mv = X.orders_view(spark, sf)
    back = timeline.lag(mv, spark, "total", "day", 2, "month", ["priority"], where="status = 'P'")
    ahead = timeline.lead(mv, spark, "total", "day", 1, "month", ["priority"], where="status = 'P'")
    return join_on(back, ahead.drop("total"), ["priority", "day"])


@query(
    "q_densify",
    f"""WITH g AS (SELECT o_custkey AS custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, SUM({AMT}) AS v FROM orders GROUP BY 1, 2),
    x AS (SELECT MIN(quarter) AS lo, MAX(quarter) AS hi FROM g),
    ax AS (SELECT c.custkey, CAST(u.t AS DATE) AS quarter FROM (SELECT DISTINCT custkey FROM g) c, x, unnest(generate_series(x.lo::TIMESTAMP, x.hi::TIMESTAMP, INTERVAL 3 MONTH)) AS u(t))
    SELECT ax.custkey, ax.quarter, {dbl('g.v')} AS total FROM ax LEFT JOIN g ON g.custkey = ax.custkey AND g.quarter = ax.quarter""",
    dates="quarter",
)
def densify(spark, sf):
    values = X.orders_view(spark, sf).query(spark, ["total"], ["custkey", "quarter"])
    return timeline.densify(values, "quarter", "quarter", ["custkey"])


@query(
    "q_date_dim",
    """WITH r AS (SELECT date_trunc('year', MIN(l_shipdate)) AS lo, date_trunc('year', MAX(l_shipdate)) AS hi FROM lineitem),
    d AS (SELECT CAST(u.t AS DATE) AS date FROM r, unnest(generate_series(r.lo::TIMESTAMP, (r.hi + INTERVAL 12 MONTH - INTERVAL 1 DAY)::TIMESTAMP, INTERVAL 1 DAY)) AS u(t))
    SELECT date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, 'Q' || quarter(date) AS quarter,
    CAST(date_trunc('month', date) AS DATE) AS month_start FROM d""",
    dates="date month_start",
)
def date_dim(spark, sf):
    return X.calendar_of(X.table(spark, sf, "lineitem"), "l_shipdate")


# ================================================================ ranking


@query(
    "q_rank",
    f"""WITH g AS (SELECT l_partkey AS partkey, SUM({PRC}) AS v FROM lineitem GROUP BY 1)
    SELECT partkey, {dbl('v')} AS gross, CAST(RANK() OVER (ORDER BY v DESC) AS BIGINT) AS rank FROM g""",
)
def rank(spark, sf):
    return ranking.rankx(X.lines_view(spark, sf), spark, "gross", "partkey")


@query(
    "q_rank_distributed",
    """WITH g AS (SELECT l_partkey AS partkey, COUNT(*) AS v FROM lineitem GROUP BY 1)
    SELECT partkey, v AS lines, CAST(RANK() OVER (ORDER BY v) AS BIGINT) AS rank FROM g""",
)
def rank_distributed(spark, sf):
    """The plan for member sets beyond one window, ascending and with many ties."""
    return ranking.rankx(X.lines_view(spark, sf), spark, "lines", "partkey", descending=False, window_rows=0)


@query(
    "q_rank_within",
    f"""WITH g AS (SELECT c_mktsegment AS segment, o_custkey AS custkey, COUNT(*) AS v FROM {OC} GROUP BY 1, 2)
    SELECT segment, custkey, v AS orders, CAST(DENSE_RANK() OVER (PARTITION BY segment ORDER BY v DESC) AS BIGINT) AS rank FROM g""",
)
def rank_within(spark, sf):
    return ranking.rankx(X.orders_view(spark, sf), spark, "orders", "custkey", ["segment"], ties="dense")


@query(
    "q_topn_sum",
    f"""WITH g AS (SELECT c_mktsegment AS segment, o_custkey, SUM({AMT}) AS v FROM {OC} GROUP BY 1, 2),
    r AS (SELECT *, RANK() OVER (PARTITION BY segment ORDER BY v DESC) AS r FROM g)
    SELECT segment, {dbl('SUM(v)')} AS top_sum FROM r WHERE r <= 10 GROUP BY 1""",
)
def topn_sum(spark, sf):
    return ranking.topn_sum(X.orders_view(spark, sf), spark, "total", "custkey", 10, ["segment"])


@query(
    "q_topn_ties",
    """WITH g AS (SELECT o_custkey AS custkey, COUNT(*) AS v FROM orders GROUP BY 1), r AS (SELECT *, CAST(RANK() OVER (ORDER BY v DESC) AS BIGINT) AS rank FROM g)
    SELECT custkey, v AS orders, rank FROM r WHERE rank <= 5""",
)
def topn_ties(spark, sf):
    """All members tied at the last place are kept."""
    return ranking.topn(X.orders_view(spark, sf), spark, "orders", "custkey", 5)


@query(
    "q_topn_large",
    """WITH g AS (SELECT l_orderkey AS orderkey, COUNT(*) AS v FROM lineitem GROUP BY 1), r AS (SELECT *, CAST(RANK() OVER (ORDER BY v DESC) AS BIGINT) AS rank FROM g)
    SELECT orderkey, v AS lines, rank FROM r WHERE rank <= 5000""",
)
def topn_large(spark, sf):
    """More members than Spark keeps per task in a rank window, most of them tied."""
    mv = MetricView("mv", X.table(spark, sf, "lineitem"), (), (Dimension("orderkey", "l_orderkey"),), (Measure("lines", A.count_rows()),))
    return ranking.topn(mv, spark, "lines", "orderkey", 5000)


@query(
    "q_topn_strict",
    f"""WITH g AS (SELECT c_mktsegment AS segment, o_custkey AS custkey, COUNT(*) AS v FROM {OC} GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY v DESC, custkey) AS rank FROM g)
    SELECT segment, custkey, v AS orders, rank FROM r WHERE rank <= 20""",
)
def topn_strict(spark, sf):
    """Exactly twenty customers per segment; ties go by name."""
    return ranking.topn(X.orders_view(spark, sf), spark, "orders", "custkey", 20, ["segment"], strict=True)


@query(
    "q_bottomn_sum",
    f"""WITH g AS (SELECT p_type AS type, l_partkey, SUM({PRC}) AS v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY type ORDER BY v, l_partkey) AS r FROM g)
    SELECT type, {dbl('SUM(v)')} AS top_sum FROM r WHERE r <= 5 GROUP BY 1""",
)
def bottomn_sum(spark, sf):
    return ranking.bottomn_sum(X.lines_view(spark, sf), spark, "gross", "partkey", 5, ["type"], strict=True)


@query(
    "q_cumulative_pct",
    f"""WITH g AS (SELECT {AMT} AS value, COUNT(*) AS rows FROM orders GROUP BY 1)
    SELECT {dbl('value')} AS value, rows, {dbl('SUM(rows) OVER (ORDER BY value)')} / SUM(rows) OVER () AS cumulative_pct FROM g""",
)
def cumulative_pct(spark, sf):
    return ranking.cumulative_pct(X.orders_view(spark, sf), spark, "price")


# ================================================================ validation


@query(
    "q_validate_all",
    f"""WITH g AS (SELECT c_mktsegment AS segment, SUM({AMT}) AS total, COUNT(*) AS orders, COUNT(DISTINCT o_custkey) AS customers,
      SUM({AMT}) FILTER (WHERE o_orderstatus = 'F') AS active FROM {OC} GROUP BY 1),
    u AS (SELECT segment, unnest([{{'n': 'total', 'v': {dbl('total')}}}, {{'n': 'orders', 'v': {dbl('orders')}}}, {{'n': 'customers', 'v': {dbl('customers')}}},
      {{'n': 'avg_order', 'v': {dbl('total')} / orders}}, {{'n': 'active_total', 'v': {dbl('active')}}}, {{'n': 'active_share', 'v': {dbl('active')} / {dbl('total')}}}]) AS m FROM g)
    SELECT m.n AS measure_name, segment, round(m.v, 4) AS metric_view_value, round(m.v, 4) AS expected_value, TRUE AS passed, CAST(NULL AS VARCHAR) AS error FROM u""",
)
def validate_all(spark, sf):
    """Every group of every measure without a window against direct SQL."""
    checked = V.validate_all(X.orders_view(spark, sf), spark, ["segment"])
    return checked.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("metric_view_value", "expected_value")})


@query(
    "q_compare_frames",
    f"""WITH g AS (SELECT o_custkey AS custkey, SUM({AMT}) AS v FROM orders GROUP BY 1),
    l AS (SELECT * FROM g WHERE custkey % 11 <> 0), r AS (SELECT custkey, CASE WHEN custkey % 7 = 0 THEN v * 2 WHEN custkey % 5 = 0 THEN v * CAST(1.005 AS DECIMAL(4,3)) ELSE v END AS v FROM g WHERE custkey % 13 <> 0)
    SELECT 'total' AS measure_name, COALESCE(l.custkey, r.custkey) AS custkey,
    l.custkey IS NOT NULL AND r.custkey IS NOT NULL AND COALESCE(l.custkey, r.custkey) % 7 <> 0 AS passed,
    CASE WHEN l.custkey IS NULL THEN 'view has no row for this group' WHEN r.custkey IS NULL THEN 'direct SQL has no row for this group' END AS error
    FROM l FULL JOIN r ON l.custkey = r.custkey""",
)
def compare_frames(spark, sf):
    """Planted differences: doubled values fail, half a percent passes, missing sides are named."""
    g = X.orders_view(spark, sf).query(spark, ["total"], ["custkey"])
    planted = F.expr("CASE WHEN custkey % 7 = 0 THEN total * 2 WHEN custkey % 5 = 0 THEN total * 1.005 ELSE total END")
    left = g.where("custkey % 11 <> 0")
    right = g.where("custkey % 13 <> 0").select("custkey", planted.alias("result"))
    df = V.compare_frames(left, right, ["custkey"], {"total": "result"})
    return df.select("measure_name", "custkey", "passed", "error")


# ================================================================ text functions


@query(
    "q_text_functions",
    """SELECT p_partkey, replace(p_name, ' ', '_') || '_unit_price_id_' || p_partkey AS snake,
    'mv_' || lower(p_type) || '_' || p_partkey AS safe_view, 'mv_batch_fact_' || p_size AS batch_view,
    CASE WHEN p_size % 2 = 0 THEN 'c' || p_size ELSE 'main' END AS catalog, 'n' || p_partkey AS pair_name, 'SUM(a:b)' AS pair_expr,
    'trailing ' || p_size || ' month' AS range, left(p_name, 4) AS clipped, p_name AS decoded, p_size % 3 = 0 AS has_over,
    'Q' || ((p_partkey % 4) + 1) AS quarter
    FROM part""",
)
def text_functions(spark, sf):
    """Naming, splitting, clipping and matching functions over every part."""
    p = X.table(spark, sf, "part")
    name = F.initcap("p_name")
    size = F.col("p_size").cast("string")
    key = F.col("p_partkey").cast("string")
    three = F.concat(F.lit("c"), size, F.lit(".s.t"))
    pair = TX.split_pair(F.concat(F.lit("n"), key, F.lit(": SUM(a:b)")))
    over = F.when(F.col("p_size") % 3 == 0, F.lit("sum(x) over (order by y)")).otherwise(F.lit("rollOVER(x)"))
    return p.select(
        "p_partkey",
        TX.snake_case(F.concat(name, F.lit(" UnitPriceID "), key)).alias("snake"),
        TX.safe_view_name(F.concat(F.lit("main.s."), F.lower("p_type"), F.lit("-"), key)).alias("safe_view"),
        TX.view_name(F.concat(F.lit("main.s.fact_"), size), "batch").alias("batch_view"),
        TX.split_name(F.when(F.col("p_size") % 2 == 0, three).otherwise(F.lit("t")), "main", "sales")["catalog"].alias("catalog"),
        pair["name"].alias("pair_name"),
        pair["expr"].alias("pair_expr"),
        TX.normalize_range(F.concat(F.lit(" trailing_"), size, F.lit("_months"))).alias("range"),
        TX.clip(F.col("p_name"), 4).alias("clipped"),
        TX.b64_text(F.base64(F.col("p_name").cast("binary"))).alias("decoded"),
        TX.uses_over(over).alias("has_over"),
        F.concat(F.lit("Q"), (F.col("p_partkey") % 4 + 1).cast("string")).alias("quarter"),
    )


@query(
    "q_snake_case",
    """SELECT p_partkey, replace(p_name, ' ', '_') || '_part_id' AS snake, lower(p_type) || '_' || lower(replace(p_brand, '#', '')) AS path FROM part""",
)
def snake_case(spark, sf):
    """`Small RingPartID` to `small_ring_part_id`."""
    p = X.table(spark, sf, "part")
    pascal = F.concat(F.initcap("p_name"), F.lit("PartID"))
    path = F.concat(F.initcap(F.lower("p_type")), F.translate("p_brand", "#", ""))
    return p.select("p_partkey", TX.snake_case(pascal).alias("snake"), TX.snake_case(path).alias("path"))


@query(
    "q_format_measure",
    f"""WITH g AS (SELECT r_name AS region_name, SUM({AMT}) AS total, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM {OCNR} GROUP BY 1)
    SELECT region_name, region_name || ' - $' || format('{{:,}}', CAST(round(total, 0) AS BIGINT)) AS label, '$' || format('{{:,.2f}}', CAST(total AS DOUBLE)) AS money,
    format('{{:,}}', n) AS count_text FROM g""",
)
def format_measure(spark, sf):
    df = X.orders_view(spark, sf).query(spark, ["total", "orders"], ["region_name"])
    return df.select(
        "region_name",
        TX.member_label(F.col("region_name"), F.col("total"), "$#,#").alias("label"),
        TX.format_measure(F.col("total"), "$#,#.00").alias("money"),
        TX.format_measure(F.col("orders"), "#,##0").alias("count_text"),
    )


# ================================================================ catalog of measure texts

CATALOG = f"""cat AS ({X.CATALOG_SQL}),
fx AS (SELECT c.*, concat('main.sales.fact_', CAST(b % 7 AS VARCHAR)) AS fact,
  (r = 11) OR (b % 3 = 1 AND r = 12) OR (b % 3 = 2 AND r IN (12, 13)) AS cyclic,
  (b % 3 = 1 AND r = 13) AS dependant, p3.p_brand AS brand3, p5.p_brand AS brand5, p0.p_brand AS brand0, p0.p_size AS size0, p0.p_name AS name0
  FROM cat c LEFT JOIN part p0 ON p0.p_partkey = c.k LEFT JOIN part p3 ON p3.p_partkey = c.k - 3 LEFT JOIN part p5 ON p5.p_partkey = c.k - 5),
tr AS (SELECT *, CASE
  WHEN r = 0 THEN 'SUM(amount)' WHEN r = 1 THEN 'COUNT(1)' WHEN r = 2 THEN 'COUNT(DISTINCT customer_id)'
  WHEN r = 3 THEN 'SUM(amount) FILTER (WHERE brand = ''' || brand0 || ''')'
  WHEN r = 4 THEN 'SUM(amount) FILTER (WHERE brand = ''' || brand0 || ''' AND size > ' || size0 || ')'
  WHEN r = 5 THEN 'SUM(quantity * unit_price)'
  WHEN r = 6 THEN 'SUM(amount) FILTER (WHERE brand = ''' || brand3 || ''') / NULLIF(SUM(amount), 0)'
  WHEN r = 7 THEN 'SUM(amount) / COUNT(DISTINCT customer_id)'
  WHEN r = 8 THEN '(SUM(amount) FILTER (WHERE brand = ''' || brand5 || ''') / NULLIF(SUM(amount), 0)) * 100'
  WHEN r = 9 THEN 'SUM(amount)' WHEN r = 12 THEN 'AVG(amount)' WHEN r = 13 THEN 'MAX(amount)'
  WHEN r = 14 THEN 'CASE WHEN SUM(amount) > 1000 THEN ''' || name0 || ' (a, b)'' ELSE ''No'' END' END AS expr,
  CASE WHEN r = 10 THEN 'unsupported' WHEN r = 9 THEN 'window' ELSE 'supported' END AS class,
  CASE WHEN r = 10 THEN 'unsupported_dax' END AS warning_type
  FROM fx WHERE NOT cyclic AND NOT dependant)"""


def _catalog_modules():
    from metricloom.operators import assembly, references, rules

    return assembly, references, rules


def _translated(spark, sf):
    _, references, rules = _catalog_modules()
    return settle.settle(rules.translate_rules(references.resolve_composites(X.catalog(spark, sf))))


@query(
    "q_measure_edges",
    f"""WITH {CATALOG}, e AS (SELECT DISTINCT model, measure_name, unnest(regexp_extract_all(measure_expr, '\\[(M[0-9]+)\\]', 1)) AS ref FROM cat)
    SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM cat c WHERE c.model = e.model AND c.measure_name = e.ref)""",
)
def measure_edges(spark, sf):
    return _catalog_modules()[1].measure_edges(X.catalog(spark, sf))


@query("q_cycles", f"WITH {CATALOG} SELECT model, measure_name FROM fx WHERE cyclic")
def cycles(spark, sf):
    """Every member of a cycle of length one, two or three; dependants of cycles are not."""
    _, references, _ = _catalog_modules()
    return references.cycles(references.measure_edges(X.catalog(spark, sf)))


@query(
    "q_levels",
    f"""WITH {CATALOG} SELECT model, measure_name, CASE WHEN r = 8 THEN 2 WHEN r IN (6, 7, 10, 14) THEN 1 ELSE 0 END AS level
    FROM fx WHERE NOT cyclic AND NOT dependant""",
)
def levels(spark, sf):
    return _catalog_modules()[1].levels(X.catalog(spark, sf))


@query(
    "q_resolve_composites",
    f"""WITH {CATALOG} SELECT measure_name, CASE WHEN cyclic OR dependant THEN NULL
    WHEN r = 6 THEN 'DIVIDE((CALCULATE(SUM(Sales[Amount]), Sales[Brand]="' || brand3 || '")), (SUM(Sales[Amount])), 0)'
    WHEN r = 7 THEN '(SUM(Sales[Amount])) / (DISTINCTCOUNT(Sales[CustomerID]))'
    WHEN r = 8 THEN '(DIVIDE((CALCULATE(SUM(Sales[Amount]), Sales[Brand]="' || brand5 || '")), (SUM(Sales[Amount])), 0)) * 100'
    WHEN r = 10 THEN 'RANKX(ALL(Sales), (SUM(Sales[Amount])))'
    WHEN r = 14 THEN 'IF((SUM(Sales[Amount])) > 1000, "' || name0 || ' (a, b)", "No")' END AS resolved_expr,
    CASE WHEN cyclic OR dependant THEN 'error' ELSE 'pending' END AS final_status,
    CASE WHEN cyclic THEN 'Circular measure reference: ' || measure_name WHEN dependant THEN 'Depends on a circular measure reference' END AS error_message
    FROM fx""",
)
def resolve_composites(spark, sf):
    df = _catalog_modules()[1].resolve_composites(X.catalog(spark, sf))
    return df.select("measure_name", "resolved_expr", "final_status", "error_message")


@query(
    "q_resolve_growth",
    """WITH n AS (SELECT p_partkey, unnest(range(0, 6)) AS i, length(p_name) + 12 AS base FROM part),
    l AS (SELECT *, CAST((base + 7) * power(2, i) AS BIGINT) - 7 AS len FROM n)
    SELECT 'g' || p_partkey AS model, 'm' || i AS measure_name, CASE WHEN i > 0 AND len <= 400 THEN len ELSE 0 END AS chars,
    CASE WHEN i > 0 AND len > 400 THEN 'error' ELSE 'pending' END AS final_status,
    CASE WHEN i > 0 AND len > 400 THEN 'Expanded text exceeds 400 characters' END AS error_message FROM l""",
)
def resolve_growth(spark, sf):
    """Measures that name the one before twice: texts double until they would be too long."""
    from metricloom.sources import exports as E

    rows = X.table(spark, sf, "part").select("p_partkey", "p_name", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    before = F.concat(F.lit("[m"), (F.col("i") - 1).cast("string"), F.lit("]"))
    staging = E._staged(
        rows, model=F.concat(F.lit("g"), "p_partkey"), position=F.col("i"), measure_name=F.concat(F.lit("m"), "i"),
        measure_expr=F.when(F.col("i") == 0, F.concat(F.lit("SUM(Sales["), "p_name", F.lit("])"))).otherwise(F.concat(before, F.lit(" + "), before)),
        source_format=F.lit("csv"), source_table=F.lit("Sales"), description=F.lit(""), mode=F.lit("dax"),
        fact_table_fqn=F.lit("main.sales.fact"), fact_columns=F.lit(None), dim_tables=F.lit(None), col_map=F.lit(None),
    )
    df = _catalog_modules()[1].resolve_composites(staging, 400)
    return df.select(
        "model", "measure_name", F.coalesce(F.length("resolved_expr"), F.lit(0)).cast("bigint").alias("chars"), "final_status", "error_message"
    )


@query(
    "q_classify",
    f"""WITH {CATALOG} SELECT measure_name, CASE WHEN r = 10 THEN 'unsupported' WHEN r = 9 THEN 'window' ELSE 'supported' END AS class FROM cat""",
)
def classify(spark, sf):
    rules = _catalog_modules()[2]
    return X.catalog(spark, sf).select("measure_name", rules.classify(F.col("measure_expr")).alias("class"))


@query(
    "q_translate_rules",
    f"""WITH {CATALOG} SELECT measure_name, class, expr, r = 9 AS needs_window, warning_type,
    CASE WHEN r = 9 THEN 'date cumulative,year current' ELSE '' END AS windows,
    CASE WHEN r = 9 THEN 'date:calendar.date,year:calendar.year' ELSE '' END AS dims,
    CASE WHEN r = 9 THEN 'source.date_key = calendar.date' ELSE '' END AS joins FROM tr""",
)
def translate_rules(spark, sf):
    df = _translated(spark, sf)
    windows = F.transform(
        F.coalesce("window", F.array().cast(TX.WINDOW_TYPE)), lambda w: F.concat_ws(" ", w["order"], w["range"])
    )
    return df.select(
        "measure_name", "class", "expr", "needs_window", "warning_type",
        F.array_join(windows, ",").alias("windows"),
        F.array_join("dimensions_needed", ",").alias("dims"),
        F.array_join(F.transform("joins_needed", lambda j: j["on"]), ",").alias("joins"),
    )


@query(
    "q_translate_mdx",
    f"""WITH cat AS ({X.CUBE_SQL}), c AS (SELECT cat.*, p.p_brand, p.p_size, p3.p_brand AS brand3, p3.p_size AS size3
      FROM cat JOIN part p ON p.p_partkey = k LEFT JOIN part p3 ON p3.p_partkey = k - 3)
    SELECT measure_name, CASE r WHEN 0 THEN 'SUM(amount)' WHEN 1 THEN 'COUNT(order_id)' WHEN 2 THEN 'COUNT(DISTINCT customer_id)'
    WHEN 3 THEN 'SUM(amount) FILTER (WHERE brand = ''' || p_brand || ''' AND size = ''' || p_size || ''')'
    WHEN 4 THEN 'SUM(amount) / NULLIF(COUNT(order_id), 0)' WHEN 5 THEN 'SUM(amount) FILTER (WHERE type = ''(a, b)'')'
    WHEN 6 THEN 'CASE WHEN SUM(amount) > 0 THEN SUM(amount) FILTER (WHERE brand = ''' || brand3 || ''' AND size = ''' || size3 || ''') / NULLIF(SUM(amount), 0) ELSE 0 END'
    WHEN 7 THEN 'SUM(amount)' WHEN 8 THEN 'SUM(amount)' END AS expr,
    CASE WHEN r < 7 THEN 'supported' WHEN r = 7 THEN 'window' WHEN r = 8 THEN 'time_intelligence' ELSE 'unsupported' END AS class,
    CASE r WHEN 7 THEN 'cumulative,current' WHEN 8 THEN 'trailing 1 year' ELSE '' END AS ranges,
    CASE r WHEN 8 THEN 'time_intelligence' WHEN 9 THEN 'unsupported_dax' END AS warning_type FROM c""",
)
def translate_mdx(spark, sf):
    """Cube members: tuples, member tests, safe divisions, periods to date, parallel periods."""
    _, references, rules = _catalog_modules()
    df = rules.translate_rules(references.resolve_composites(X.cube_catalog(spark, sf)))
    ranges = F.transform(F.coalesce("window", F.array().cast(TX.WINDOW_TYPE)), lambda w: w["range"])
    return df.select("measure_name", "expr", "class", F.array_join(ranges, ",").alias("ranges"), "warning_type")


@query(
    "q_over_guard",
    f"""WITH {CATALOG} SELECT measure_name, CASE WHEN r <> 1 THEN expr END AS expr,
    CASE WHEN r = 1 THEN 'unsupported_dax' ELSE warning_type END AS warning_type FROM tr""",
)
def over_guard(spark, sf):
    _, _, rules = _catalog_modules()
    planted = F.when(F.col("position") % 15 == 1, "SUM(amount) over (ORDER BY day)").otherwise(F.col("expr"))
    df = rules.guard_over(_translated(spark, sf).withColumn("expr", planted))
    return df.select("measure_name", "expr", "warning_type")


@query(
    "q_parse_answers",
    f"""WITH {CATALOG} SELECT measure_name, CASE WHEN k % 4 < 2 THEN expr END AS expr, k % 4 < 2 AND r = 9 AS needs_window,
    CASE WHEN k % 4 >= 2 THEN 'translation_error' ELSE warning_type END AS warning_type,
    CASE WHEN k % 4 >= 2 THEN 'failed' WHEN r = 10 THEN 'warning' ELSE 'success' END AS status FROM tr""",
)
def parse_answers(spark, sf):
    """Stored answers: plain, fenced, failed and cut off."""
    assembly, _, _ = _catalog_modules()
    df = _translated(spark, sf)
    text = F.to_json(F.struct("expr", "needs_window", "window", "warning_type", "dimensions_needed", "joins_needed"))
    kind = F.col("position") % 4
    answer = (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(kind == 2, "Error: no answer")
        .otherwise(F.substring(text, F.lit(1), F.length(text) - 5))
    )
    got = assembly.parse_answers(df.withColumn("ai_result", answer))
    status = assembly.status(F.col("warning_type"), F.col("expr")).alias("status")
    return got.select("measure_name", "expr", "needs_window", "warning_type", status)


@query(
    "q_assemble_views",
    f"""WITH {CATALOG} SELECT concat('main.marts.mv_batch_fact_', CAST(b % 7 AS VARCHAR)) AS view_name, fact AS source,
    CASE WHEN bool_or(r = 9) THEN '0.1' ELSE '1.1' END AS version, CAST(bool_or(r = 9) AS INT)::BIGINT AS join_count,
    CASE WHEN bool_or(r = 9) THEN 2 ELSE 1 END::BIGINT AS dimension_count, COUNT(*) AS measure_count FROM tr WHERE expr IS NOT NULL GROUP BY 1, 2""",
)
def assemble_views(spark, sf):
    return _catalog_modules()[0].assemble_views(_translated(spark, sf), "main", "marts")


@query(
    "q_view_stats",
    f"""WITH {CATALOG} SELECT fact AS source_table, COUNT(*) AS measures_total, COUNT(*) FILTER (WHERE expr IS NOT NULL) AS measures_success,
    COUNT(*) FILTER (WHERE expr IS NULL) AS measures_warning, 0::BIGINT AS measures_failed,
    CASE WHEN COUNT(*) FILTER (WHERE expr IS NULL) = 0 THEN 'success' ELSE 'partial' END AS status FROM tr GROUP BY 1""",
)
def view_stats(spark, sf):
    return _catalog_modules()[0].view_stats(_translated(spark, sf))


@query(
    "q_measure_details",
    f"""WITH {CATALOG} SELECT fact AS source_table, measure_name, CASE WHEN expr IS NULL THEN 'warning' ELSE 'success' END AS status,
    expr, r = 9 AS needs_window, warning_type FROM tr""",
)
def measure_details(spark, sf):
    return _catalog_modules()[0].measure_details(_translated(spark, sf))


@query(
    "q_warnings",
    f"""WITH {CATALOG} SELECT fact AS source_table, measure_name, measure_expr AS expression, warning_type,
    'no metric-view form' AS message, expr AS approximation FROM tr WHERE warning_type IS NOT NULL""",
)
def warning_rows(spark, sf):
    return _catalog_modules()[0].warnings(_translated(spark, sf))


@query(
    "q_render_views",
    f"""WITH {CATALOG}, kept AS (SELECT * FROM tr WHERE expr IS NOT NULL),
    v AS (SELECT fact, concat('main.marts.mv_batch_', split_part(fact, '.', 3)) AS view_name, bool_or(r = 9) AS win FROM kept GROUP BY 1),
    items AS (
      SELECT view_name, 0 AS s, -1 AS p, '' AS i, 'version: "' || CASE WHEN win THEN '0.1' ELSE '1.1' END || '"' || chr(10) || 'source: "' || fact || '"' AS t FROM v
      UNION ALL SELECT view_name, 1, -1, '', 'joins:' FROM v WHERE win
      UNION ALL SELECT view_name, 1, 0, 'calendar', '- name: "calendar"' || chr(10) || '  source: "main.sales.dim_date"' || chr(10) || '  "on": "source.date_key = calendar.date"' FROM v WHERE win
      UNION ALL SELECT view_name, 2, -1, '', 'dimensions:' FROM v
      UNION ALL SELECT view_name, 2, 0, 'date', '- name: "date"' || chr(10) || '  expr: "calendar.date"' FROM v WHERE win
      UNION ALL SELECT view_name, 2, 1, 'year', '- name: "year"' || chr(10) || '  expr: "calendar.year"' FROM v WHERE win
      UNION ALL SELECT view_name, 2, 0, 'status', '- name: "status"' || chr(10) || '  expr: "status"' FROM v WHERE NOT win
      UNION ALL SELECT view_name, 3, -1, '', 'measures:' FROM v
      UNION ALL SELECT v.view_name, 3, k, measure_name, '- name: "' || measure_name || '"' || chr(10) || '  expr: "' || expr || '"' ||
        CASE WHEN r = 9 THEN chr(10) || '  window:' || chr(10) || '  - order: "date"' || chr(10) || '    range: "cumulative"' || chr(10) || '    semiadditive: "last"'
        || chr(10) || '  - order: "year"' || chr(10) || '    range: "current"' || chr(10) || '    semiadditive: "last"' ELSE '' END FROM kept JOIN v USING (fact)),
    n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY view_name ORDER BY s, p, i) - 1) / 50) AS INT) AS part,
      CAST(ceil(COUNT(*) OVER (PARTITION BY view_name) / 50) AS INT) AS parts FROM items),
    y AS (SELECT view_name, part, parts, string_agg(t, chr(10) ORDER BY s, p, i) AS yaml FROM n GROUP BY 1, 2, 3)
    SELECT view_name, part, parts, yaml, CASE WHEN part = 0 THEN 'CREATE OR REPLACE VIEW ' || view_name || chr(10) || 'WITH METRICS' || chr(10) || 'LANGUAGE YAML' || chr(10) || 'AS $$' || chr(10) ELSE '' END
    || '  ' || replace(yaml, chr(10), chr(10) || '  ') || CASE WHEN part = parts - 1 THEN chr(10) || '$$' ELSE '' END AS ddl FROM y""",
)
def render_views(spark, sf):
    """View texts in parts of fifty blocks."""
    return _catalog_modules()[0].render_views(_translated(spark, sf), "main", "marts", part=50)


@query(
    "q_dedupe_first",
    "SELECT p_brand, min_by(p_partkey, p_partkey) AS p_partkey, min_by(p_name, p_partkey) AS p_name FROM part GROUP BY 1",
)
def dedupe_first(spark, sf):
    df = X.table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return _catalog_modules()[0].dedupe_first(df, ["p_brand"], ["p_partkey"])


# ================================================================ exports, audit, registry


def _export_texts(spark, sf, model: bool) -> DataFrame:
    """One export text per block of fifteen measures of the derived catalog."""
    rows = X.catalog(spark, sf).withColumn("b", F.floor(F.col("position") / 15)).withColumn("r", F.col("position") % 15)
    if model:
        item = F.struct("r", F.col("measure_name").alias("name"), F.col("measure_expr").alias("expression"))
        listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["name"], x["expression"]))
        ms = F.to_json(listed)
        partition = F.concat(F.lit('Source{[Item=\\"fact_'), (F.col("b") % 7).cast("string"), F.lit('\\"]}[Data]'))
        sales = F.concat(
            F.lit('{"name":"Sales","columns":[{"name":"Amount","sourceColumn":"amt"},{"name":"DateKey"}],"partitions":[{"name":"p","source":{"type":"m","expression":"'),
            partition, F.lit('"}}],"measures":'), F.col("ms"), F.lit("}"),
        )
        rest = F.lit(
            ',{"name":"Calendar","columns":[{"name":"Date"},{"name":"MonthStart"}]}],"relationships":'
            '[{"fromTable":"Sales","fromColumn":"DateKey","toTable":"Calendar","toColumn":"Date"}]'
        )
        body = F.concat(F.lit('"tables":['), sales, rest)
        text = F.when(F.col("b") % 2 == 0, F.concat(F.lit('{"name":"x","model":{'), body, F.lit("}}"))).otherwise(
            F.concat(F.lit("{"), body, F.lit("}"))
        )
        df = rows.groupBy("b").agg(ms.alias("ms"))
    else:
        member = F.concat(
            F.lit("-- member\nCREATE MEMBER CURRENTCUBE.[Measures].["), F.col("measure_name"), F.lit("]\nAS "), F.col("measure_expr"),
            F.when(F.col("r") % 2 == 0, F.lit(',\nFORMAT_STRING = "#,##0",\nVISIBLE = 1;\n')).otherwise(F.lit(" ;\n")),
        )
        df = rows.withColumn("t", member).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("ts"))
        text = F.concat(F.lit("CALCULATE;\n"), F.array_join(F.transform("ts", lambda x: x["t"]), ""))
    return df.select(F.concat(F.lit("block_"), F.col("b").cast("string")).alias("path"), text.alias("value"))


@query(
    "q_read_bim",
    f"""WITH {CATALOG} SELECT 'block_' || b AS model, r AS position, 'Sales' AS source_table, measure_name, measure_expr, 'dax' AS mode,
    'main.dw.fact_' || (b % 7) AS fact_table_fqn, 'amt,date_key' AS fact_columns, 'calendar main.dw.calendar date_key date date,month_start' AS dims FROM cat""",
)
def read_bim(spark, sf):
    """Wrapped and bare model texts: fact by its measures, physical names, relationships to joins."""
    from metricloom.sources import exports as E

    df = E.parse_bim(_export_texts(spark, sf, True), "main", "dw")
    dims = F.transform(
        "dim_tables",
        lambda d: F.concat_ws(" ", d["alias"], d["table"], d["join_key"], d["dim_key"], F.array_join(d["columns"], ",")),
    )
    return df.select(
        "model", "position", "source_table", "measure_name", "measure_expr", "mode", "fact_table_fqn",
        F.array_join("fact_columns", ",").alias("fact_columns"), F.array_join(dims, ";").alias("dims"),
    )


@query(
    "q_read_mdx_scripts",
    f"""WITH {CATALOG} SELECT 'block_' || b AS model, r AS position, measure_name, measure_expr, 'mdx' AS mode, 'main.s.fact' AS fact_table_fqn FROM cat""",
)
def read_mdx_scripts(spark, sf):
    from metricloom.sources import exports as E

    mapping = {"fact_table": "main.s.fact", "dimension_tables": []}
    df = E.parse_mdx_scripts(_export_texts(spark, sf, False), mapping)
    return df.select("model", "position", "measure_name", "measure_expr", "mode", "fact_table_fqn")


@query(
    "q_read_measure_csv",
    f"""WITH {CATALOG} SELECT 'Sales' AS source_table, measure_name, measure_expr, 'line 1' || chr(10) || 'line "2"' AS description, 'dax' AS mode FROM cat""",
)
def read_measure_csv(spark, sf):
    """Quoted cells with doubled quotes and line breaks, written to the shared folder and read back."""
    from metricloom.sources import exports as E

    path = settle.scratch(spark, "measures")
    rows = X.catalog(spark, sf).select(
        F.col("source_table").alias("TableName"), F.col("measure_name").alias("MeasureName"),
        F.col("measure_expr").alias("Expression"), F.lit('line 1\nline "2"').alias("Description"),
    )
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    df = E.read_measure_csv(spark, path, {"fact_table": "main.s.fact"})
    return df.select("source_table", "measure_name", "measure_expr", "description", "mode")


@query(
    "q_stage_all",
    f"""WITH {CATALOG} SELECT f AS source_format, CASE WHEN f = 'mdx_script' THEN 'mdx' ELSE 'dax' END AS mode, COUNT(*) AS measures,
    COUNT(DISTINCT measure_name) AS names FROM cat, (VALUES ('bim'), ('mdx_script')) AS t(f) GROUP BY ALL""",
)
def stage_all(spark, sf):
    """Rows of two export formats in one staging frame."""
    from metricloom.sources import exports as E

    both = E.stage_all(
        [
            E.parse_bim(_export_texts(spark, sf, True), "main", "dw"),
            E.parse_mdx_scripts(_export_texts(spark, sf, False), {"fact_table": "main.s.fact"}),
        ]
    )
    return both.groupBy("source_format", "mode").agg(
        F.count(F.lit(1)).alias("measures"), F.count_distinct("measure_name").alias("names")
    )


@query(
    "q_enrich_columns",
    f"""WITH {CATALOG} SELECT measure_name, CASE WHEN b % 7 < 4 THEN 'amount,date_key,f' || (b % 7) ELSE '' END AS fact_columns FROM cat""",
)
def enrich_columns(spark, sf):
    """Column lists from the catalog for fact tables whose export has none."""
    from metricloom.sources import exports as E

    staging = X.catalog(spark, sf)
    known = staging.select("fact_table_fqn").distinct().withColumn("n", F.substring("fact_table_fqn", -1, 1))
    columns = known.where("n < 4").select(
        F.col("fact_table_fqn").alias("table"),
        F.array(F.lit("amount"), F.lit("date_key"), F.concat(F.lit("f"), "n")).alias("columns"),
    )
    return E.enrich_columns(staging, columns).select("measure_name", F.array_join("fact_columns", ",").alias("fact_columns"))


AUDIT_EVENTS = """ev AS (SELECT 'a' || p_partkey AS id, p_partkey AS k, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * p_partkey AS ts FROM part)"""


def _audit_events(spark, sf) -> DataFrame:
    from metricloom.sources import audit

    p = settle.spread(X.table(spark, sf, "part"), "p_partkey")  # a row becomes a text of many times its size
    minutes = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("p_partkey") * 60)
    key = F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("id")
    done = p.select(
        key, minutes.alias("timestamp"), F.lit("dax").alias("mode"), F.lit("success").alias("status"),
        F.repeat("p_name", 1000).alias("measures_input"),
        F.when(F.col("p_partkey") % 5 == 0, "bad input").otherwise("").alias("error_message"), F.lit("ann").alias("user_name"),
    )
    third = p.where("p_partkey % 3 = 0")
    tries = [
        third.select(
            key, (minutes + F.expr(f"INTERVAL {n} HOUR")).alias("timestamp"), F.lit(f"v{n}").alias("deployed_view"),
            F.lit(s).alias("deploy_status"), F.lit(e).alias("error_message"), F.lit("bob").alias("user_name"),
        )
        for n, s, e in ((1, "success", ""), (2, "failed", "no rights"))
    ]
    frames = [audit.audit_rows(done), *[audit.audit_rows(t, "deploy") for t in tries]]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "q_audit_current",
    f"""WITH {AUDIT_EVENTS} SELECT id, 'success' AS status, CASE WHEN k % 3 = 0 THEN 'v2' ELSE '' END AS deployed_view,
    CASE WHEN k % 3 = 0 THEN 'failed' ELSE '' END AS deploy_status,
    CASE WHEN k % 5 = 0 THEN 'bad input' WHEN k % 3 = 0 THEN 'no rights' ELSE '' END AS error_message,
    CASE WHEN k % 3 = 0 THEN 'bob' ELSE 'ann' END AS user_name, 1000 * length(p.p_name) AS kept
    FROM ev JOIN part p ON p.p_partkey = ev.k""",
)
def audit_current(spark, sf):
    """Latest deployment per entry; an error of the entry itself is kept, texts stay whole."""
    from metricloom.sources import audit

    df = audit.audit_current(_audit_events(spark, sf))
    return df.select(
        "id", "status", "deployed_view", "deploy_status", "error_message", "user_name",
        F.length("measures_input").cast("bigint").alias("kept"),
    )


@query(
    "q_audit_history",
    f"""WITH {AUDIT_EVENTS} SELECT id, CAST(ts AS VARCHAR) AS at, CASE WHEN k % 3 = 0 THEN 'failed' ELSE '' END AS deploy_status
    FROM ev ORDER BY ts DESC, id DESC LIMIT 50""",
)
def audit_history(spark, sf):
    from metricloom.sources import audit

    df = audit.audit_history(audit.audit_current(_audit_events(spark, sf)))
    return df.select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "deploy_status")


@query(
    "q_audit_of_batch",
    f"""WITH {CATALOG}, i AS (SELECT fact, measure_name AS n, '{{"name":"' || measure_name || '","type":"unsupported_dax","msg":"no metric-view form"}}' AS i FROM tr WHERE expr IS NULL),
    w AS (SELECT *, SUM(length(i) + 1) OVER (PARTITION BY fact ORDER BY n) AS upto FROM i)
    SELECT 'b1/' || fact AS id, 'batch_bim' AS mode, fact AS source_table,
    CASE WHEN bool_or(expr IS NULL) THEN 'partial' ELSE 'success' END AS status, CASE WHEN bool_or(r = 9) THEN '0.1' ELSE '1.1' END AS version,
    CAST(COUNT(expr) AS INT) AS measure_count, COUNT(*) FILTER (WHERE expr IS NULL) AS warning_count,
    (SELECT '[' || coalesce(string_agg(i, ',' ORDER BY n), '') || ']' FROM w WHERE w.fact = tr.fact AND upto + 1 <= 4000) AS warnings
    FROM tr GROUP BY fact""",
)
def audit_of_batch(spark, sf):
    from metricloom.sources import audit

    df = audit.audit_of_batch(_translated(spark, sf), "b1")
    return df.select(
        "id", "mode", "source_table", "status", "version", F.col("measure_count").cast("int").alias("measure_count"),
        "warning_count", "warnings",
    )


@query(
    "q_registry",
    """WITH l AS (SELECT 'v' || p_size AS view_name, max_by(p_partkey, p_partkey) AS k, max_by(p_name, p_partkey) AS definition FROM part GROUP BY 1)
    SELECT view_name, definition FROM l WHERE k % 4 <> 0""",
)
def registry(spark, sf):
    """Newest definition of each view; a name whose newest event is a drop is gone."""
    from metricloom.sources import audit

    events = X.table(spark, sf, "part").select(
        F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("view_name"),
        F.timestamp_seconds(F.col("p_partkey")).alias("changed_at"),
        F.lit("1.1").alias("version"),
        F.col("p_name").alias("definition"),
        (F.col("p_partkey") % 4 == 0).alias("dropped"),
    )
    return audit.published(events).select("view_name", "definition")


@query(
    "q_translated_view",
    f"""SELECT o_orderpriority AS priority, {dbl(f'SUM({AMT})')} AS "Total Sales", {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F')")} AS "Active Sales",
    round({dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F')")} / NULLIF({dbl(f'SUM({AMT})')}, 0), 6) AS "Active Share",
    COUNT(DISTINCT o_custkey) AS "Unique Customers" FROM orders GROUP BY 1""",
)
def translated_view(spark, sf):
    """Measure texts translated by rules and evaluated on the order table."""
    texts = {
        "Total Sales": "SUM(Sales[Amount])",
        "Active Sales": 'CALCULATE([Total Sales], Sales[Status]="F")',
        "Active Share": "DIVIDE([Active Sales], [Total Sales], 0)",
        "Unique Customers": "DISTINCTCOUNT(Sales[CustomerID])",
    }
    mv = _translated_orders(spark, sf, texts)
    share = F.round(F.col("Active Share").cast("double"), 6)
    return mv.query(spark, list(texts), ["priority"]).withColumn("Active Share", share)


def _order_facts(spark, sf) -> DataFrame:
    return X.table(spark, sf, "orders").selectExpr(
        f"{X.AMOUNT} AS amount", "o_orderstatus AS status", "o_custkey AS customer_id", "o_orderpriority AS priority", "CAST(o_orderdate AS DATE) AS date"
    )


def _translated_orders(spark, sf, texts: dict[str, str]) -> MetricView:
    """A view of the orders whose measures are texts translated by rules."""
    from metricloom.sources import exports as E

    rows = spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(texts.items())], "position long, measure_name string, measure_expr string")
    staging = E._staged(
        rows, model=F.lit("m"), source_format=F.lit("csv"), source_table=F.lit("Sales"), description=F.lit(""),
        mode=F.lit("dax"), fact_table_fqn=F.lit("orders"), fact_columns=F.lit(None), dim_tables=F.lit(None), col_map=F.lit(None),
    )
    _, references, rules = _catalog_modules()
    done = rules.translate_rules(references.resolve_composites(staging)).select("measure_name", "expr")
    measures = {r["measure_name"]: r["expr"] for r in done.collect()}  # the few declared texts
    dims = (Dimension("priority", "priority"), Dimension("custkey", "customer_id"))
    return MetricView("mv_translated", _order_facts(spark, sf), (), dims, tuple(Measure(n, measures[n]) for n in texts))


@query(
    "q_translate_nested",
    """SELECT p_partkey AS k, CASE p_partkey % 6
      WHEN 0 THEN 'SUM(amount) FILTER (WHERE (brand = ''' || p_brand || ''' OR size = ' || p_size || ') AND type <> ''a, b'')'
      WHEN 1 THEN 'COALESCE(SUM(amount) / NULLIF(SUM(cost), 0), ' || p_size || ')'
      WHEN 2 THEN 'SUM(amount) FILTER (WHERE brand IN (''' || p_brand || ''', ''x, y'') AND size IN (1, ' || p_size || '))'
      WHEN 3 THEN 'CASE WHEN SUM(amount) > ' || p_size || ' THEN ''High'' WHEN SUM(amount) > 0 THEN ''' || p_brand || ''' ELSE ''Low'' END'
      WHEN 4 THEN repeat('CASE WHEN ', 1 + p_size % 20) || 'SUM(amount)' || repeat(' > 1 THEN 1 ELSE 0 END', 1 + p_size % 20)
      END AS expr, CASE WHEN p_partkey % 6 = 5 THEN 'untranslated' END AS warning_type FROM part""",
)
def translate_nested(spark, sf):
    """Texts with OR beside AND, alternates, lists, SWITCH, nesting up to twenty, and free commas."""
    from metricloom.sources import exports as E

    text = """CASE p_partkey % 6
      WHEN 0 THEN concat('CALCULATE(SUM(Sales[Amount]), Sales[Brand]="', p_brand, '" || Sales[Size]=', p_size, ', Sales[Type]<>"a, b")')
      WHEN 1 THEN concat('DIVIDE(SUM(Sales[Amount]), SUM(Sales[Cost]), ', p_size, ')')
      WHEN 2 THEN concat('CALCULATE(SUM(Sales[Amount]), Sales[Brand] IN {"', p_brand, '", "x, y"}, Sales[Size] IN {1, ', p_size, '})')
      WHEN 3 THEN concat('SWITCH(TRUE(), SUM(Sales[Amount]) > ', p_size, ', "High", SUM(Sales[Amount]) > 0, "', p_brand, '", "Low")')
      WHEN 4 THEN concat(repeat('IF(', 1 + p_size % 20), 'SUM(Sales[Amount])', repeat(' > 1, 1, 0)', 1 + p_size % 20))
      ELSE concat('SUM(Sales[Amount]), SUM(Sales[', p_brand, '])') END"""
    rows = X.table(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.col("p_partkey").cast("string").alias("measure_name"), F.expr(text).alias("measure_expr"))
    staging = E._staged(
        rows, model=F.lit("m"), source_format=F.lit("csv"), source_table=F.lit("Sales"), description=F.lit(""),
        mode=F.lit("dax"), fact_table_fqn=F.lit("orders"), fact_columns=F.lit(None), dim_tables=F.lit(None), col_map=F.lit(None),
    )
    return _catalog_modules()[2].translate_rules(staging).select(F.col("position").alias("k"), "expr", "warning_type")


@query(
    "q_translate_precedence",
    """SELECT p_partkey AS k, CASE p_partkey % 12
      WHEN 0 THEN '(SUM(amount) - SUM(cost)) / NULLIF(SUM(amount) + ' || p_size || ', 0)'
      WHEN 1 THEN 'SUM(x) / ((SUM(c) + ' || p_size || ') / NULLIF(2, 0))'
      WHEN 2 THEN 'SUM(amount) + SUM(cost) FILTER (WHERE brand = ''' || p_brand || ' -- no // comment'')'
      WHEN 3 THEN 'SUM(amount) > ' || p_size || ' OR SUM(cost) > 0 AND SUM(amount) IS NOT NULL'
      WHEN 4 THEN 'CASE WHEN SUM(amount) IS NULL THEN ' || p_size || ' ELSE SUM(amount) END'
      WHEN 5 THEN 'SUM(amount) FILTER (WHERE size = ' || p_size || ' AND brand IS NOT NULL)'
      WHEN 6 THEN 'SUM(`amount_(' || p_size || ')`) / SUM(`' || p_size || '%_net`)'
      WHEN 7 THEN 'SUM(amount * cost) FILTER (WHERE size > ' || p_size || ' AND brand = ''x'')'
      WHEN 8 THEN 'SUM(CASE WHEN size > ' || p_size || ' THEN amount ELSE 0 END)'
      END AS expr, CASE WHEN p_partkey % 12 >= 9 THEN 'untranslated' END AS warning_type FROM part""",
)
def translate_precedence(spark, sf):
    """Texts whose operators bind or mean otherwise in SQL, comments, blanks, names with marks, and operators without a form."""
    from metricloom.sources import exports as E

    text = """CASE p_partkey % 12
      WHEN 0 THEN concat('DIVIDE(SUM(Sales[Amount]) - SUM(Sales[Cost]), SUM(Sales[Amount]) + ', p_size, ')')
      WHEN 1 THEN concat('SUM(Sales[X]) / DIVIDE(SUM(Sales[C]) + ', p_size, ', 2)')
      WHEN 2 THEN concat('SUM(Sales[Amount]) -- gross, (all)\\n + /* and */ CALCULATE(SUM(Sales[Cost]), Sales[Brand]="', p_brand, ' -- no // comment") // ', p_brand)
      WHEN 3 THEN concat('SUM(Sales[Amount]) > ', p_size, ' || SUM(Sales[Cost]) > 0 && SUM(Sales[Amount]) <> BLANK()')
      WHEN 4 THEN concat('IF(SUM(Sales[Amount]) = BLANK(), ', p_size, ', SUM(Sales[Amount]))')
      WHEN 5 THEN concat('CALCULATE(CALCULATE(SUM(Sales[Amount]), Sales[Size] = ', p_size, '), Sales[Size] = 0, Sales[Brand] <> BLANK())')
      WHEN 6 THEN concat('SUM(Sales[Amount (', p_size, ')]) / SUM(Sales[', p_size, '% Net])')
      WHEN 7 THEN concat('SUMX(FILTER(Sales, Sales[Size] > ', p_size, ' && Sales[Brand] = "x"), Sales[Amount] * Sales[Cost])')
      WHEN 8 THEN concat('SUMX(Sales, IF(Sales[Size] > ', p_size, ', Sales[Amount], 0))')
      WHEN 9 THEN concat('SUM(Sales[Amount])^', p_size)
      WHEN 10 THEN concat('SUM(Sales[Amount]) & "', p_brand, '"')
      ELSE concat('SUM(Sales[Amount]) SUM(Sales[', p_brand, '])') END"""
    rows = X.table(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.col("p_partkey").cast("string").alias("measure_name"), F.expr(text).alias("measure_expr"))
    staging = E._staged(
        rows, model=F.lit("m"), source_format=F.lit("csv"), source_table=F.lit("Sales"), description=F.lit(""),
        mode=F.lit("dax"), fact_table_fqn=F.lit("orders"), fact_columns=F.lit(None), dim_tables=F.lit(None), col_map=F.lit(None),
    )
    return _catalog_modules()[2].translate_rules(staging).select(F.col("position").alias("k"), "expr", "warning_type")


@query(
    "q_translated_margin",
    f"""WITH g AS (SELECT o_custkey AS custkey, {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F')")} AS f, {dbl(f"SUM({AMT})")} AS t,
      {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'O')")} AS o, {dbl(f"SUM(CASE WHEN o_orderstatus = 'P' THEN {AMT} ELSE 0 END)")} AS p, COUNT(*) AS n,
      COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS nf, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS n_o FROM orders GROUP BY 1)
    SELECT custkey, round((t - f) / NULLIF(t, 0), 9) AS margin, CAST(n AS DOUBLE) / NULLIF((nf + n_o) / 2.0, 0) AS halves,
      CASE WHEN f IS NULL OR o > f THEN 1 ELSE 0 END AS none_or_less, round(p, 2) AS pending FROM g""",
)
def translated_margin(spark, sf):
    """Compound numerators, logical operators and rows under a condition, translated and evaluated."""
    texts = {
        "total": "SUM(Sales[Amount]) -- all of it",
        "done": 'CALCULATE([total], Sales[Status]="F")',
        "open": 'SUMX(FILTER(Sales, Sales[Status]="O"), Sales[Amount])',
        "margin": "DIVIDE([total] - [done], [total])",
        "halves": 'COUNTROWS(Sales) / DIVIDE(CALCULATE(COUNTROWS(Sales), Sales[Status]="F") + COUNTROWS(FILTER(Sales, Sales[Status]="O")), 2)',
        "none_or_less": "IF([done] = BLANK() || [open] > [done], 1, 0)",
        "pending": 'SUMX(Sales, IF(Sales[Status]="P", Sales[Amount], 0))',
    }
    df = _translated_orders(spark, sf, texts).query(spark, ["margin", "halves", "none_or_less", "pending"], ["custkey"])
    number = lambda c, places: F.round(F.col(c).cast("double"), places).alias(c)
    return df.select("custkey", number("margin", 9), F.col("halves").cast("double").alias("halves"), "none_or_less", number("pending", 2))


@query(
    "q_salted_join",
    """SELECT p_brand, COUNT(*) AS lines, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem LEFT JOIN part ON l_partkey % 3 = p_partkey GROUP BY 1""",
)
def salted(spark, sf):
    """A join on three keys that hold all rows, split into pieces."""
    lines = X.table(spark, sf, "lineitem").select((F.col("l_partkey") % 3).alias("k"), "l_orderkey", "l_linenumber")
    parts = X.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    joined = settle.salted_join(settle.settle(lines), parts, ["k"], "left", plain_rows=0)
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_orderkey").alias("orders"))


@query(
    "q_audit_append",
    f"""WITH {CATALOG} SELECT 'b1/' || fact AS id, 'batch_bim' AS mode, CAST(COUNT(expr) AS INT) AS measure_count, 'translation' AS event,
    '["main.sales.dim_date"]' AS dimension_tables, CAST(NULL AS VARCHAR) AS note FROM tr GROUP BY fact""",
)
def audit_append(spark, sf):
    """Rows appended to a table that has its columns in another order, and one more."""
    import uuid

    from metricloom.sources import audit

    name = f"audit_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (note STRING, measure_count INT, mode STRING, id STRING) USING parquet")
    try:
        audit.audit_append(audit.audit_of_batch(_translated(spark, sf), "b1"), name)
        return settle.settle(spark.table(name).select("id", "mode", "measure_count", "event", "dimension_tables", "note"))
    finally:
        spark.sql(f"DROP TABLE {name}")


@query(
    "q_audit_entries",
    f"""WITH {CATALOG} SELECT 'b1/' || fact AS audit_id, 'measure' AS kind, row_number() OVER (PARTITION BY fact ORDER BY model, k) - 1 AS position,
    CAST(json_object('name', measure_name, 'expression', measure_expr) AS VARCHAR) AS content FROM tr
    UNION ALL SELECT 'b1/' || fact, 'warning', row_number() OVER (PARTITION BY fact ORDER BY measure_name) - 1,
    '{{"name":"' || measure_name || '","type":"unsupported_dax","msg":"no metric-view form"}}' FROM tr WHERE expr IS NULL""",
)
def audit_entries(spark, sf):
    """Every measure and warning of a batch, written twice to the table of entries and read back as one."""
    import uuid

    from metricloom.sources import audit

    name = f"entries_{uuid.uuid4().hex}"
    entries = settle.settle(audit.entries_of_batch(_translated(spark, sf), "b1"))
    try:
        audit.entries_append(entries.withColumn("content", F.lit("old")), name)
        audit.entries_append(entries, name)
        return settle.settle(audit.entries_current(spark.table(name)).select("audit_id", "kind", "position", "content"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(
    "q_batch_roundtrip",
    f"""SELECT o_orderpriority AS priority, {dbl(f'SUM({AMT})')} AS "Total", {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'F')")} AS "In F",
    {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'O')")} AS "In O", {dbl(f"SUM({AMT}) FILTER (WHERE o_orderstatus = 'P')")} AS "In P" FROM orders GROUP BY 1""",
)
def batch_roundtrip(spark, sf):
    """An export file written from the order states, read, translated, published, loaded and queried."""
    import uuid

    from metricloom import batch
    from metricloom.sources import audit

    tag = uuid.uuid4().hex
    facts, views = f"order_facts_{tag}", f"views_{tag}"
    _order_facts(spark, sf).createOrReplaceTempView(facts)
    states = X.table(spark, sf, "orders").select("o_orderstatus").distinct()
    name, expr = F.concat(F.lit("In "), "o_orderstatus"), F.concat(F.lit('CALCULATE([Total], Sales[Status]="'), "o_orderstatus", F.lit('")'))
    total = spark.range(1).select(F.lit("Total").alias("n"), F.lit("SUM(Sales[Amount])").alias("e"))
    rows = states.select(name.alias("n"), expr.alias("e")).unionByName(total)
    path = settle.scratch(spark, "exports") + ".csv"
    lines = rows.select(F.lit("Sales").alias("TableName"), F.col("n").alias("MeasureName"), F.col("e").alias("Expression"), F.lit("").alias("Description"))
    lines.coalesce(1).write.option("header", True).option("escape", '"').csv(path)  # one export file is one model
    try:
        batch.run_files(spark, [path, "notes.txt"], tag, {"fact_table": facts}, registry_table=views)
        loaded = audit.load_view(spark, f"main.sales.mv_batch_{facts}", views)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {views}")
    declared = MetricView("mv_loaded", _order_facts(spark, sf), (), (Dimension("priority", "priority"),), loaded.measures)
    return declared.query(spark, ["Total", "In F", "In O", "In P"], ["priority"])


def _called(spark, sf, texts: dict[str, str], dims=(), date: str | None = None) -> dict[str, DataFrame]:
    """Results of texts that stand for operators, over a view of the orders."""
    from metricloom.operators import calls
    from metricloom.sources import exports as E

    rows = spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(texts.items())], "position long, measure_name string, measure_expr string")
    staging = E._staged(
        rows, model=F.lit("m"), source_format=F.lit("csv"), source_table=F.lit("Sales"), description=F.lit(""),
        mode=F.lit("dax"), fact_table_fqn=F.lit("orders"), fact_columns=F.lit(None), dim_tables=F.lit(None), col_map=F.lit(None),
    )
    found = {r["measure_name"]: r for r in calls.find_calls(_catalog_modules()[1].resolve_composites(staging)).collect()}  # the few declared texts
    named = {"priority": "priority", "status": "status", "custkey": "customer_id", "date": "date"}
    view = MetricView("mv_called", _order_facts(spark, sf), (), tuple(Dimension(n, e) for n, e in named.items()), ())
    return {name: calls.evaluate(found[name], view, spark, dims, date) for name in texts if name != "Total Sales"}


@query(
    "q_migrated_shares",
    f"""WITH g AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, {dbl(f'SUM({AMT})')} AS v FROM orders GROUP BY 1, 2),
    t AS (SELECT *, SUM(v) OVER () AS a, SUM(v) OVER (PARTITION BY status) AS s FROM g)
    SELECT 'all' AS measure, status, priority, round(v / a, 9) AS pct FROM t UNION ALL SELECT 'selected', status, priority, round(v / a, 9) FROM t
    UNION ALL SELECT 'kept', status, priority, round(v / s, 9) FROM t UNION ALL SELECT 'removed', status, priority, round(v / s, 9) FROM t""",
)
def migrated_shares(spark, sf):
    """Shares of the total, of what is selected, of kept and without removed columns, from measure texts."""
    texts = {
        "Total Sales": "SUM(Sales[Amount])",
        "all": "DIVIDE([Total Sales], CALCULATE([Total Sales], ALL(Sales)), 0)",
        "selected": "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALLSELECTED(Sales)), 0)",
        "kept": "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALLEXCEPT(Sales, Sales[Status])))",
        "removed": "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALL(Sales[Priority])), 0)",
    }
    frames = [
        df.select(F.lit(name).alias("measure"), "status", "priority", F.round("pct", 9).alias("pct"))
        for name, df in _called(spark, sf, texts, ["status", "priority"]).items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(
    "q_migrated_ranks",
    f"""WITH g AS (SELECT o_custkey AS k, {dbl(f'SUM({AMT})')} AS v FROM orders GROUP BY 1), r AS (SELECT *, RANK() OVER (ORDER BY v DESC) AS r FROM g)
    SELECT 'rank' AS measure, CAST(k AS VARCHAR) AS key, CAST(r AS DOUBLE) AS value FROM r
    UNION ALL SELECT 'top', 'all', round(SUM(v), 2) FROM r WHERE r <= 10
    UNION ALL SELECT 'list', (SELECT string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) FROM orders), 1.0""",
)
def migrated_ranks(spark, sf):
    """Ranks, the sum of the first ten and a list, from measure texts."""
    texts = {
        "rank": "RANKX(ALL(Sales[CustomerID]), CALCULATE(SUM(Sales[Amount])))",
        "top": "SUMX(TOPN(10, VALUES(Sales[CustomerID]), CALCULATE(SUM(Sales[Amount]))), CALCULATE(SUM(Sales[Amount])))",
        "list": 'CONCATENATEX(VALUES(Sales[Priority]), Sales[Priority], "; ")',
    }
    got = _called(spark, sf, texts)
    shape = lambda name, key, value: got[name].select(F.lit(name).alias("measure"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    top = shape("top", F.lit("all"), F.round(F.col("top_sum").cast("double"), 2))
    return shape("rank", F.col("custkey"), F.col("rank")).unionByName(top).unionByName(shape("list", F.col("members"), F.col("parts")))


@query(
    "q_migrated_time",
    f"""WITH {DAILY}, {MONTHLY}, p AS (SELECT a.month, {dbl('a.v')} AS v, {dbl('b.v')} AS b FROM m a LEFT JOIN m b ON b.month = CAST(a.month - INTERVAL 12 MONTH AS DATE))
    SELECT 'running' AS measure, CAST(day AS VARCHAR) AS date, round({dbl('SUM(v) OVER (ORDER BY day)')}, 2) AS value FROM dd
    UNION ALL SELECT 'growth', CAST(month AS VARCHAR), round(COALESCE((v - b) / NULLIF(b, 0), 0), 9) FROM p
    UNION ALL SELECT 'rolling', CAST(month AS VARCHAR), round({dbl('AVG(v) OVER (ORDER BY month RANGE BETWEEN INTERVAL 6 MONTH PRECEDING AND CURRENT ROW)')}, 2) FROM m""",
)
def migrated_time(spark, sf):
    """Running total, growth over the prior year and a rolling average of seven months, from measure texts."""
    texts = {
        "running": "CALCULATE(SUM(Sales[Amount]), FILTER(ALL(Calendar), Calendar[Date] <= MAX(Calendar[Date])))",
        "growth": "VAR a = SUM(Sales[Amount]) VAR b = CALCULATE(SUM(Sales[Amount]), SAMEPERIODLASTYEAR(Calendar[Date])) RETURN DIVIDE(a - b, b, 0)",
        "rolling": "AVERAGEX(DATESINPERIOD(Calendar[Date], MAX(Calendar[Date]), -7, MONTH), CALCULATE(SUM(Sales[Amount])))",
    }
    got = _called(spark, sf, texts, (), "date")
    column = {"running": ("running", 2), "growth": ("growth", 9), "rolling": ("rolling", 2)}
    frames = [
        df.select(F.lit(n).alias("measure"), F.col("date").cast("string").alias("date"), F.round(F.col(column[n][0]).cast("double"), column[n][1]).alias("value"))
        for n, df in got.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "q_staging_batches",
    f"""WITH {CATALOG}, s AS (SELECT 'b1' AS batch_id, k, 'first' AS note FROM cat WHERE k % 2 = 0 UNION ALL SELECT 'b2', k, 'again' FROM cat WHERE k % 5 = 0)
    SELECT batch_id, CASE WHEN note = 'again' THEN 'again' END AS note, 'batch_bim' AS batch_mode, COUNT(*) AS rows, COUNT(*) FILTER (WHERE k % 15 = 9) AS windows FROM s GROUP BY ALL""",
)
def staging_batches(spark, sf):
    """A batch written again, with one more column, replaces itself; the pending rows of both are translated."""
    import uuid

    from metricloom.sources import audit

    assembly, _, rules = _catalog_modules()
    staging = X.catalog(spark, sf)
    batch = lambda b, n: assembly.with_batch(staging.where(F.col("position") % n == 0), b)
    name = f"staging_{uuid.uuid4().hex}"
    try:
        audit.write_staging(batch("b1", 2), name)
        audit.write_staging(batch("b2", 3), name)
        audit.write_staging(batch("b2", 5).withColumn("note", F.lit("again")), name)
        frames = []
        for b in ("b1", "b2"):
            done = audit.translate_batch(spark.table(name), b, f"{name}_{b}", rules.translate_rules)
            frames.append(done.groupBy("batch_id", "note", "batch_mode").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("class") == "window").alias("windows")))
        return settle.settle(frames[0].unionByName(frames[1]))
    finally:
        for table in (name, f"{name}_b1", f"{name}_b2"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


@query("q_mapping_file", "SELECT 'main.s.fact_sales' AS fact_table, 'main.s.dim_' || lower(replace(r_name, ' ', '_')) AS \"table\", 'k' || r_regionkey AS join_key, 'id' AS dim_key FROM region")
def mapping_file(spark, sf):
    """A mapping file written to the shared folder and read back."""
    from metricloom.sources import exports as E

    name = F.concat(F.lit("main.s.dim_"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))))
    entry = F.concat(F.lit("- table: "), name, F.lit("\n  join_key: k"), F.col("r_regionkey").cast("string"), F.lit("\n  dim_key: id"))
    listed = X.table(spark, sf, "region").agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("e"))
    path = settle.scratch(spark, "mapping")
    listed.select(F.concat(F.lit("fact_table: main.s.fact_sales\ndimension_tables:\n"), "e")).coalesce(1).write.text(path)
    mapping = E.load_mapping(spark, path)
    dims = spark.createDataFrame([(d["table"], d["join_key"], d["dim_key"]) for d in mapping["dimension_tables"]], "table string, join_key string, dim_key string")
    return dims.select(F.lit(mapping["fact_table"]).alias("fact_table"), "*")


@query(
    "q_guarded_view",
    f"""SELECT o_orderpriority AS priority, {dbl(f'SUM({AMT})')} AS total, 'partial' AS status, 'bad' AS left_out FROM orders GROUP BY 1""",
)
def guarded_view(spark, sf):
    """A measure with a SQL window is left out with a warning, the others stay."""
    view = X.orders_view(spark, sf)
    mv = MetricView("mv", view.source, (), view.dimensions[:2], (Measure("total", A.sum_(X.AMOUNT)), Measure("bad", f"SUM(SUM({X.AMOUNT})) OVER ()")))
    clean, warnings, status = mv.validate()
    df = clean.query(spark, [m.name for m in clean.measures], ["priority"])
    return df.withColumns({"status": F.lit(status), "left_out": F.lit(",".join(w.measure_name for w in warnings))})


@query(
    "q_order_resolution",
    f"""WITH {DAILY} SELECT day, {dbl('SUM(v) OVER (ORDER BY day)')} AS by_name, {dbl('SUM(v) OVER (ORDER BY day)')} AS by_expression, {dbl('SUM(v) OVER (ORDER BY day)')} AS by_part FROM dd""",
    dates="day",
)
def order_resolution(spark, sf):
    """Windows whose order is the name, the expression, or a text that contains the name of a dimension."""
    view = X.orders_view(spark, sf)
    orders = {"by_name": "day", "by_expression": view.dim("day").expr, "by_part": "order_day"}
    dims = tuple(d for d in view.dimensions if d.name == "day")
    mv = MetricView("mv", view.source, (), dims, tuple(Measure(n, A.sum_(X.AMOUNT), window=(Window(o, "cumulative"),)) for n, o in orders.items()))
    return mv.query(spark, list(orders), ["day"])


@query(
    "q_source_fallback",
    f"""SELECT o_orderstatus AS status, COUNT(*) AS orders, {dbl(f'SUM({AMT})')} AS total FROM orders GROUP BY 1""",
)
def source_fallback(spark, sf):
    """A definition without a source is one over the model's fact table."""
    doc = {
        "source": "", "dimensions": [{"name": "status", "expr": "o_orderstatus"}],
        "measures": [{"name": "orders", "expr": "COUNT(1)"}, {"name": "total", "expr": A.sum_(X.AMOUNT)}],
    }
    mv = MetricView.from_definition("mv", doc, fact=f"{sf}/orders.parquet")
    return mv.query(spark, ["orders", "total"], ["status"])


@query(
    "q_format_percent",
    f"""WITH g AS (SELECT o_orderpriority AS priority, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
    SELECT priority, format('{{:,.2f}}', round(100.0 * f / n, 2)) || '%' AS share, priority || ' - ' || format('{{:,.2f}}', round(100.0 * f / n, 2)) || '%' AS label FROM g""",
)
def format_percent(spark, sf):
    """Percent formats of tabular models and cubes."""
    share = Measure("share", A.divide(A.filtered("COUNT(1)", "o_orderstatus = 'F'"), "COUNT(1)"))
    df = X.orders_view(spark, sf).query(spark, [share], ["priority"])
    part = F.round("share", 4)
    return df.select("priority", TX.format_measure(part, "Percent").alias("share"), TX.member_label(F.col("priority"), part, "0.00%").alias("label"))
