"""Views over the order tables and a catalog of measure texts derived from the parts table.

Amounts have two decimals and are summed as decimals, so that results do not depend on the order of
additions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from metricloom.functions import aggs as A
from metricloom.plans.model import Dimension, Join, Measure, MetricView, Window
from metricloom.sources.calendar import calendar_of, date_dim  # noqa: F401

AMOUNT = "CAST(o_totalprice AS DECIMAL(18,2))"
PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"
KEEP = "CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2))"
TAXED = "CAST(1 + CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(4,2))"
QTY = "CAST(l_quantity AS DECIMAL(12,2))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders_view(spark: SparkSession, sf: str) -> MetricView:
    """Order grain: customers, nations and regions as a snowflake."""
    path = lambda t: f"{sf}/{t}.parquet"
    return MetricView(
        "mv_orders",
        path("orders"),
        joins=(
            Join("customer", path("customer"), "source.o_custkey = customer.c_custkey"),
            Join("nation", path("nation"), "customer.c_nationkey = nation.n_nationkey"),
            Join("region", path("region"), "nation.n_regionkey = region.r_regionkey"),
        ),
        dimensions=(
            Dimension("status", "o_orderstatus"),
            Dimension("priority", "o_orderpriority"),
            Dimension("custkey", "o_custkey"),
            Dimension("price", AMOUNT),
            Dimension("segment", "customer.c_mktsegment"),
            Dimension("customer_name", "customer.c_name"),
            Dimension("nation_name", "nation.n_name"),
            Dimension("region_name", "region.r_name"),
            Dimension("day", "CAST(o_orderdate AS DATE)"),
            Dimension("month", "CAST(date_trunc('MONTH', o_orderdate) AS DATE)", period_of="day"),
            Dimension("quarter", "CAST(date_trunc('QUARTER', o_orderdate) AS DATE)", period_of="day"),
            Dimension("year", "CAST(year(o_orderdate) AS INT)", period_of="day"),
        ),
        measures=(
            Measure("total", A.sum_(AMOUNT)),
            Measure("orders", A.count_rows()),
            Measure("customers", A.distinct_count("o_custkey")),
            Measure("avg_order", A.avg_(AMOUNT)),
            Measure("active_total", A.filtered(A.measure("total"), "o_orderstatus = 'F'")),
            Measure("active_share", A.divide(A.measure("active_total"), A.measure("total"))),
            Measure("ytd", A.sum_(AMOUNT), window=(Window("day", "cumulative"), Window("year", "current"))),
            Measure("customers_7d", A.distinct_count("o_custkey"), window=(Window("day", "trailing_7_days"),)),
            Measure("customers_to_date", A.distinct_count("o_custkey"), window=(Window("day", "cumulative"),)),
            Measure("total_all", A.sum_(AMOUNT), window=(Window("day", "all"),)),
            Measure("closing", A.sum_(AMOUNT), window=(Window("day", "current"),)),
        ),
    )


# The calendar's range is declared: reading it off the facts would take a scan.
CALENDAR = ("1990-01-01", "2029-12-31")


def lines_view(spark: SparkSession, sf: str, large: bool | None = None) -> MetricView:
    """Line grain: two dates to one calendar, orders as a (possibly large) dimension."""
    path = lambda t: f"{sf}/{t}.parquet"
    calendar = date_dim(spark, *CALENDAR)
    return MetricView(
        "mv_lines",
        path("lineitem"),
        joins=(
            Join("orders", path("orders"), "source.l_orderkey = orders.o_orderkey", large=large),
            Join("part", path("part"), "source.l_partkey = part.p_partkey"),
            Join("supplier", path("supplier"), "source.l_suppkey = supplier.s_suppkey"),
            Join("customer", path("customer"), "orders.o_custkey = customer.c_custkey", large=large),
            Join(
                "calendar",
                calendar,
                "CAST(source.l_shipdate AS DATE) = calendar.date",
                alternates={"order_date": "CAST(orders.o_orderdate AS DATE) = calendar.date"},
            ),
        ),
        dimensions=(
            Dimension("flag", "l_returnflag"),
            Dimension("linestatus", "l_linestatus"),
            Dimension("partkey", "l_partkey"),
            Dimension("brand", "part.p_brand"),
            Dimension("type", "part.p_type"),
            Dimension("segment", "customer.c_mktsegment"),
            Dimension("order_priority", "orders.o_orderpriority"),
            Dimension("ship_date", "calendar.date"),
            Dimension("ship_year", "calendar.year"),
            Dimension("ship_quarter", "calendar.quarter"),
            Dimension("size_class", A.case_when([("l_quantity > 40", "'Large'"), ("l_quantity > 15", "'Mid'")], "'Small'")),
        ),
        measures=(
            Measure("gross", A.sum_(PRICE)),
            Measure("net", A.sumx(f"{PRICE} * {KEEP}")),
            Measure("taxed", A.sumx(f"{PRICE} * {KEEP} * {TAXED}")),
            Measure("quantity", A.sum_(QTY)),
            Measure("lines", A.count_rows()),
            Measure("parts", A.distinct_count("l_partkey")),
        ),
    )


# ---------------------------------------------------------------- a catalog of measure texts

# SQL that Spark and other engines read alike. Fifteen texts per block of parts; blocks are spread
# over seven models. Composites name their neighbours, and every block holds a cycle in two of three
# cases.
CATALOG_SQL = """
SELECT p_partkey AS k, b, r,
  concat('model_', CAST(b % 7 AS VARCHAR(9))) AS model,
  concat('M', CAST(p_partkey AS VARCHAR(20))) AS measure_name,
  CASE
    WHEN r = 0 THEN 'SUM(Sales[Amount])'
    WHEN r = 1 THEN 'COUNTROWS(Sales)'
    WHEN r = 2 THEN 'DISTINCTCOUNT(Sales[CustomerID])'
    WHEN r = 3 THEN concat('CALCULATE(SUM(Sales[Amount]), Sales[Brand]="', p_brand, '")')
    WHEN r = 4 THEN concat('CALCULATE(SUM(Sales[Amount]), Sales[Brand]="', p_brand, '", Sales[Size]>', CAST(p_size AS VARCHAR(9)), ')')
    WHEN r = 5 THEN 'SUMX(Sales, Sales[Quantity] * Sales[UnitPrice])'
    WHEN r = 6 THEN concat('DIVIDE([M', CAST(p_partkey - 3 AS VARCHAR(20)), '], [M', CAST(p_partkey - 6 AS VARCHAR(20)), '], 0)')
    WHEN r = 7 THEN concat('[M', CAST(p_partkey - 7 AS VARCHAR(20)), '] / [M', CAST(p_partkey - 5 AS VARCHAR(20)), ']')
    WHEN r = 8 THEN concat('[M', CAST(p_partkey - 2 AS VARCHAR(20)), '] * 100')
    WHEN r = 9 THEN 'TOTALYTD(SUM(Sales[Amount]), Calendar[Date])'
    WHEN r = 10 THEN concat('RANKX(ALL(Sales), [M', CAST(p_partkey - 10 AS VARCHAR(20)), '])')
    WHEN r = 11 THEN CASE b % 3
      WHEN 0 THEN concat('[M', CAST(p_partkey AS VARCHAR(20)), '] + 1')
      ELSE concat('[M', CAST(p_partkey + 1 AS VARCHAR(20)), '] - 1') END
    WHEN r = 12 THEN CASE b % 3
      WHEN 0 THEN 'AVERAGE(Sales[Amount])'
      WHEN 1 THEN concat('[M', CAST(p_partkey - 1 AS VARCHAR(20)), '] * 2')
      ELSE concat('[M', CAST(p_partkey + 1 AS VARCHAR(20)), '] * 2') END
    WHEN r = 13 THEN CASE b % 3
      WHEN 0 THEN 'MAX(Sales[Amount])'
      WHEN 1 THEN concat('[M', CAST(p_partkey - 1 AS VARCHAR(20)), '] + 5')
      ELSE concat('[M', CAST(p_partkey - 2 AS VARCHAR(20)), ']') END
    ELSE concat('IF([M', CAST(p_partkey - 14 AS VARCHAR(20)), '] > 1000, "', p_name, ' (a, b)", "No")')
  END AS measure_expr
FROM (
  SELECT *, p_partkey % 15 AS r, CAST(floor(p_partkey / 15) AS BIGINT) AS b FROM part
) AS blocks
"""


# Ten cube members per block, in the same way.
CUBE_SQL = """
SELECT p_partkey AS k, r, concat('cube_', CAST(b % 7 AS VARCHAR(9))) AS model, concat('C', CAST(p_partkey AS VARCHAR(20))) AS measure_name,
  CASE r
    WHEN 0 THEN 'SUM([Measures].[Amount])'
    WHEN 1 THEN 'COUNT([Measures].[Order Id])'
    WHEN 2 THEN 'DISTINCTCOUNT([Customer].[Customer Id].[Customer Id].MEMBERS)'
    WHEN 3 THEN concat('([Brand].&[', p_brand, '], [Size].&[', CAST(p_size AS VARCHAR(9)), '], [Measures].[Amount])')
    WHEN 4 THEN concat('[Measures].[C', CAST(p_partkey - 4 AS VARCHAR(20)), '] / [Measures].[C', CAST(p_partkey - 3 AS VARCHAR(20)), ']')
    WHEN 5 THEN concat('IIF([Type].CURRENTMEMBER IS [Type].&[(a, b)], [Measures].[C', CAST(p_partkey - 5 AS VARCHAR(20)), '], NULL)')
    WHEN 6 THEN concat('IIF([Measures].[Amount] > 0, [Measures].[C', CAST(p_partkey - 3 AS VARCHAR(20)), '] / [Measures].[Amount], 0)')
    WHEN 7 THEN concat('AGGREGATE(PERIODSTODATE([Date].[Calendar].[Year], [Date].[Calendar].CURRENTMEMBER), [Measures].[C', CAST(p_partkey - 7 AS VARCHAR(20)), '])')
    WHEN 8 THEN concat('(PARALLELPERIOD([Date].[Calendar].[Year], 1, [Date].[Calendar].CURRENTMEMBER), [Measures].[C', CAST(p_partkey - 8 AS VARCHAR(20)), '])')
    ELSE concat('RANK([P].[N].CURRENTMEMBER, ORDER([P].[N].MEMBERS, [Measures].[C', CAST(p_partkey - 9 AS VARCHAR(20)), '], BDESC))')
  END AS measure_expr
FROM (
  SELECT *, p_partkey % 10 AS r, CAST(floor(p_partkey / 10) AS BIGINT) AS b FROM part
) AS blocks
"""


def cube_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Staging rows of the derived cube members."""
    return _catalog(spark, sf, CUBE_SQL, "mdx").withColumn("fact_columns", F.array(*map(F.lit, ("amount", "order_id"))))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Staging rows of the derived catalog."""
    return _catalog(spark, sf, CATALOG_SQL, "dax")


def _catalog(spark: SparkSession, sf: str, sql: str, mode: str) -> DataFrame:
    from metricloom.sources.exports import DIM_TABLE, _staged

    rows = spark.sql(sql.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    calendar = F.array(
        F.struct(
            F.lit("calendar").alias("alias"),
            F.lit("main.sales.dim_date").alias("table"),
            F.lit("date_key").alias("join_key"),
            F.lit("date").alias("dim_key"),
            F.array(F.lit("date"), F.lit("year")).alias("columns"),
        )
    ).cast(T.ArrayType(DIM_TABLE))
    return _staged(
        rows,
        position=F.col("k"),
        source_format=F.lit("bim" if mode == "dax" else "mdx_script"),
        source_table=F.lit("Sales" if mode == "dax" else "Cube"),
        description=F.lit(""),
        mode=F.lit(mode),
        fact_table_fqn=F.concat(F.lit("main.sales.fact_"), F.substring_index("model", "_", -1)),
        fact_columns=F.array().cast("array<string>"),
        dim_tables=calendar,
        col_map=F.lit(None),
    )
