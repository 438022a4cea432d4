"""A batch from staging to registry, and plans that scans and shuffles should keep."""

import yaml
from conftest import rows
from test_catalog import staging

from metricloom import Measure, MetricView
from metricloom import examples as X
from metricloom.batch import run_batch
from metricloom.functions import aggs as A
from metricloom.operators import assembly
from metricloom.sources import audit
from pyspark.sql import functions as F

TEXTS = [("Total", "SUM(Sales[Amount])"), ("Twice", "[Total] * 2"), ("Loop", "[Loop] + 1"), ("Rank", "RANKX(ALL(Sales), [Total])")]


def test_batch(spark):
    out = run_batch(staging(spark, TEXTS), "b7", "c", "s", staging_table="bt_staging", audit_table="bt_audit", entries_table="bt_entries", registry_table="bt_views")
    assert rows(spark.table("bt_staging").select("measure_name", "final_status")) == [
        ("Loop", "error"), ("Rank", "pending"), ("Total", "pending"), ("Twice", "pending")
    ]
    assert rows(out["views"]) == [("main.s.fact_sales", 3, 2, 1, 0, "partial")]
    stored = audit.published(spark.table("bt_views")).first()
    assert stored.view_name == "c.s.mv_batch_fact_sales" and stored.version == "1.1"
    doc = yaml.safe_load(stored.definition)
    assert [m["expr"] for m in doc["measures"]] == ["SUM(amount)", "SUM(amount) * 2"]
    entry = audit.audit_current(spark.table("bt_audit")).first()
    assert (entry.mode, entry.status, entry.measure_count, entry.warning_count) == ("batch_csv", "partial", 2, 1)
    kinds = audit.entries_current(spark.table("bt_entries")).groupBy("kind").count()
    assert rows(kinds) == [("ddl", 1), ("measure", 3), ("warning", 1), ("yaml", 1)]
    fact = spark.createDataFrame([("x", 3), ("y", 4)], "status string, amount int")
    mv = MetricView.from_definition("v", doc, {"main.s.fact_sales": fact})
    assert rows(mv.query(spark, ["Twice"], ["status"])) == [("x", 6), ("y", 8)]


def test_batch_with_stored_answers(spark):
    def answers(pending):
        text = F.when(F.col("measure_name") == "Total", '{"expr": "SUM(amount)", "dimensions_needed": ["Region:region"]}').otherwise("no")
        return assembly.parse_answers(pending.withColumn("ai_result", text))

    out = run_batch(staging(spark, TEXTS), "b8", translate=answers)
    assert rows(out["views"]) == [("main.s.fact_sales", 3, 1, 0, 2, "partial")]
    assert yaml.safe_load(out["texts"].first().yaml)["dimensions"] == [{"name": "Region", "expr": "region"}]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SF = "/root/testdata/sf0.001"


def test_scans_read_what_they_need(spark):
    mv = X.orders_view(spark, SF)
    text = plan(mv.query(spark, ["total", "active_share"], ["priority"], where="status = 'F'"))
    assert text.count("FileScan") == 1 and "Join" not in text
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in text


def test_many_filtered_measures_share_one_scan_and_one_shuffle(spark):
    mv = X.orders_view(spark, SF)
    ms = [Measure(f"m{i}", A.filtered("[total]", f"o_orderpriority LIKE '{i}%'")) for i in range(1, 6)]
    text = plan(mv.query(spark, ms, ["status"]))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_filtered_distinct_counts_do_not_expand_rows(spark):
    mv = X.orders_view(spark, SF)
    ms = [Measure(f"m{i}", A.filtered(A.distinct_count("o_custkey"), f"o_orderpriority LIKE '{i}%'")) for i in range(1, 6)]
    assert "Expand" not in plan(mv.query(spark, ms, ["status"]))


def test_facts_are_aggregated_before_large_joins(spark):
    text = plan(X.lines_view(spark, SF, large=True).query(spark, ["gross", "parts"], ["order_priority"]))
    join = text.index("Join")
    assert "HashAggregate(keys=[l_orderkey" in text[join:]


def test_window_counts_join_nothing(spark):
    text = plan(X.orders_view(spark, SF).query(spark, ["customers_7d"], ["status", "day"]))
    assert "Join" not in text and text.count("FileScan") == 1


def test_large_dimensions_are_found_by_size(spark):
    mv = X.orders_view(spark, SF)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    small = plan(mv.query(spark, ["total"], ["segment"]))
    try:
        spark.conf.set(limit, "1000")
        large = plan(mv.query(spark, ["total"], ["segment"]))
    finally:
        spark.conf.set(limit, before)
    assert "HashAggregate(keys=[o_custkey" not in small
    assert "HashAggregate(keys=[o_custkey" in large[large.index("Join"):]
