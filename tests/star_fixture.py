"""A small sales star with gaps between dates, ties and uneven groups."""

from pyspark.sql import functions as F

from metricloom.sources.calendar import date_dim

SHOPS = "Alder Birch Cedar Dogwood Elm Fir Ginkgo Hazel Ivy Juniper Katsura Larch".split()
GOODS = "Kettle Lamp Mirror Needle Oven Pillow Quilt Rug".split()


def sample_fact(spark, n=120):
    """Orders 1..n; every attribute is a polynomial of the number."""
    i = F.col("order_id")
    one_of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    cents = lambda c: c.cast("decimal(18,2)")
    amount = F.lit(50) + (i * i * 17 + i * 29) % 6000
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("order_id")).select(
        i,
        ((i * i + i * 3) % 12 + 1).alias("customer_id"),
        ((i * 5 + 2) % 8 + 1).alias("product_id"),
        F.date_add(F.lit("2023-02-03").cast("date"), (i * i * 3 + i * 11) % 1000).alias("date_key"),
        cents(amount).alias("amount"),
        (i * 3 % 9 + 1).alias("quantity"),
        cents(F.lit(5) + i * 31 % 250).alias("unit_price"),
        cents(F.round(amount * 0.21, 2)).alias("profit"),
        cents(amount + i % 4).alias("revenue"),
        F.when(i * 7 % 5 < 2, "Inactive").otherwise("Active").alias("status"),
        one_of(["West", "East", "North", "South"], i + F.floor(i / 4)).alias("region"),
        one_of(["Basic", "Premium", "Plus"], i * i + 1).alias("tier"),
    )


def sample_dims(spark):
    customers = [(k, name, ["Retail", "Wholesale", "Online"][k * k % 3], ["Peru", "Chile"][k % 2]) for k, name in enumerate(SHOPS, 1)]
    products = [(k, name, ["Kitchen", "Bedroom", "Hall"][k % 3]) for k, name in enumerate(GOODS, 1)]
    return {
        "dim_customer": spark.createDataFrame(customers, "customer_id int, name string, segment string, country string"),
        "dim_product": spark.createDataFrame(products, "product_id int, product_name string, category string"),
        "dim_date": date_dim(spark, "2023-01-01", "2025-12-31"),
    }
