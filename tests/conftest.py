import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from metricloom import Dimension, Join, Measure, MetricView, Window  # noqa: E402
from metricloom.functions import aggs as A  # noqa: E402
from star_fixture import sample_dims, sample_fact  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(root / "shared"))
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    """The sales star with every join and a set of measures."""
    fact = sample_fact(spark).cache()
    dims = sample_dims(spark)
    return MetricView(
        "mv_sales",
        fact,
        joins=(
            Join("customer", dims["dim_customer"], "source.customer_id = customer.customer_id"),
            Join("product", dims["dim_product"], using=("product_id",)),
            Join("calendar", dims["dim_date"], "source.date_key = calendar.date"),
        ),
        dimensions=(
            Dimension("Region", "region"),
            Dimension("Status", "status"),
            Dimension("Segment", "customer.segment"),
            Dimension("Customer Name", "customer.name"),
            Dimension("Category", "product.category"),
            Dimension("Date", "calendar.date"),
            Dimension("Month", "calendar.month_start"),
            Dimension("Year", "calendar.year"),
            Dimension("Customer", "customer_id"),
            Dimension("Order Size", A.case_when([("amount > 1000", "'Large'")], "'Small'")),
        ),
        measures=(
            Measure("Total Sales", "SUM(amount)"),
            Measure("Order Count", "COUNT(order_id)"),
            Measure("Unique Customers", "COUNT(DISTINCT customer_id)"),
            Measure("Avg Order", "AVG(amount)"),
            Measure("Active Sales", "SUM(amount) FILTER (WHERE status = 'Active')"),
            Measure("Active West", "SUM(amount) FILTER (WHERE status = 'Active' AND region = 'West')"),
            Measure("Line Total", "SUM(quantity * unit_price)"),
            Measure("Premium Sales", A.filtered("[Total Sales]", "status = 'Active'", "tier = 'Premium'")),
            Measure("Premium Ratio", A.divide("[Premium Sales]", "[Total Sales]")),
            Measure("Sales per Customer", A.divide("[Measures].[Total Sales]", "[Unique Customers]")),
            Measure("YTD", "SUM(amount)", window=(Window("Date", "cumulative"), Window("Year", "current"))),
            Measure("Closing Balance", "SUM(amount)", window=(Window("Date", "current"),)),
        ),
    )


@pytest.fixture(scope="session")
def sales(star):
    """The star's joined rows as pandas."""
    import pandas as pd

    df = star.source.toPandas()
    for c in ("amount", "profit", "revenue", "unit_price"):
        df[c] = df[c].astype(float)
    df["date_key"] = pd.to_datetime(df["date_key"])
    customers = star.joins[0].source.toPandas()
    products = star.joins[1].source.toPandas()
    return df.merge(customers, on="customer_id").merge(products, on="product_id")


def rows(df):
    """Rows as a set of tuples with decimals as floats."""
    import decimal

    return sorted(
        (tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r) for r in df.collect()), key=repr
    )
