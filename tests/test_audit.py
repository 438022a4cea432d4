"""Append-only tables."""

from conftest import rows
from pyspark.sql import functions as F
from test_catalog import staging

from metricloom.operators import assembly, rules
from metricloom.sources import audit


def test_staging_batches(spark):
    st = staging(spark, [("A", "SUM(Sales[x])"), ("B", "RANKX(Sales, 1)")])
    one, two = assembly.with_batch(st, "b1"), assembly.with_batch(st.where("measure_name = 'A'"), "b2")
    audit.write_staging(one, "staging_t")
    audit.write_staging(two, "staging_t")
    audit.write_staging(one.where("measure_name = 'B'").withColumn("note", F.lit("again")), "staging_t")
    got = spark.table("staging_t").select("batch_id", "measure_name", "note", "batch_mode")
    assert rows(got) == [("b1", "B", "again", "batch_csv"), ("b2", "A", None, "batch_csv")]
    assert audit.pending(spark.table("staging_t"), "b2").count() == 1
    out = audit.translate_batch(spark.table("staging_t"), "b2", "raw_t", rules.translate_rules)
    assert out.first().expr == "SUM(x)"


def test_audit_events(spark):
    spark.sql("CREATE TABLE audit_t (id STRING, event STRING, timestamp TIMESTAMP, mode STRING) USING parquet")
    audit.ensure_audit(spark, "audit_t")
    assert spark.table("audit_t").columns == list(audit.AUDIT_COLUMNS)
    tr = rules.translate_rules(staging(spark, [("A", "SUM(Sales[x])"), ("B", "RANKX(Sales, 1)")]))
    audit.audit_append(audit.audit_of_batch(tr, "b1"), "audit_t")
    audit.audit_append(spark.createDataFrame([("x" * 5000,)], "measures_input string"), "audit_t")
    audit.audit_deploy(spark, "audit_t", "b1/main.s.fact_sales", "v", False, "denied", "ann")
    current = audit.audit_current(spark.table("audit_t"))
    r = current.where("id LIKE 'b1/%'").first()
    assert (r.status, r.deploy_status, r.error_message, r.deployed_view, r.warning_count) == ("partial", "failed", "denied", "v", 1)
    assert r.warnings == '[{"name":"B","type":"unsupported_dax","msg":"no metric-view form"}]'
    audit.audit_deploy(spark, "audit_t", "b1/main.s.fact_sales", "v", True)
    r = audit.audit_current(spark.table("audit_t")).where("id LIKE 'b1/%'").first()
    assert (r.deploy_status, r.error_message) == ("success", "")
    assert max(len(r.measures_input) for r in current.collect()) == 5000
    assert audit.audit_history(current, 1).count() == 1


def test_entries_of_a_large_view_are_whole(spark):
    """5,000 measures, texts in three parts, a view without warnings; a batch that is written again."""
    import json

    import yaml

    texts = [(f"M{i:04}", f"SUM(Sales[c{i}])" if i % 2 else f'RANKX(Sales, "\\{i}")') for i in range(5000)]
    tr = rules.translate_rules(staging(spark, texts))
    small = tr.where("measure_name = 'M0001'").withColumn("fact_table_fqn", F.lit("main.s.fact_one"))
    both = tr.unionByName(small)
    views = assembly.render_views(both, part=1000)
    for _ in range(2):
        audit.entries_append(audit.entries_of_batch(both, "b9", views), "entries_t")
    now = audit.entries_current(spark.table("entries_t")).orderBy("audit_id", "kind", "position", "part").collect()
    kept = {}
    for r in now:
        kept.setdefault((r.audit_id, r.kind), []).append(r)
    large = "b9/main.s.fact_sales"
    assert sorted(kept) == [("b9/main.s.fact_one", k) for k in ("ddl", "measure", "yaml")] + [(large, k) for k in ("ddl", "measure", "warning", "yaml")]
    assert [r.position for r in kept[large, "measure"]] == list(range(5000))
    assert [tuple(json.loads(r.content).values()) for r in kept[large, "measure"]] == texts
    assert [json.loads(r.content)["name"] for r in kept[large, "warning"]] == [n for n, _ in texts[::2]]
    assert [r.part for r in kept[large, "yaml"]] == [0, 1, 2]
    whole = yaml.load("\n".join(r.content for r in kept[large, "yaml"]), yaml.CSafeLoader)
    assert [m["name"] for m in whole["measures"]] == [n for n, _ in texts[1::2]]
    history = audit.audit_rows(audit.audit_of_batch(both, "b9", views=views)).unionByName(audit.audit_rows(spark.createDataFrame([("other",)], "id string")))
    shown = {r.id: r for r in audit.with_entries(history, spark.table("entries_t"), 3).collect()}
    assert [json.loads(t)["name"] for t in shown[large].first_measures] == ["M0000", "M0001", "M0002"]
    assert [json.loads(t)["name"] for t in shown[large].first_warnings] == ["M0000", "M0002", "M0004"]
    assert (shown["b9/main.s.fact_one"].first_warnings, shown["other"].first_measures) == ([], [])


def test_registry(spark):
    views = spark.createDataFrame([("a", "1.1", "one"), ("b", "0.1", "two")], "view_name string, version string, definition string")
    audit.publish(views, "registry_t")
    audit.publish(views.where("view_name = 'a'").withColumn("definition", F.lit("new")), "registry_t")
    audit.drop(spark, "b", "registry_t")
    assert rows(audit.published(spark.table("registry_t")).select("view_name", "definition")) == [("a", "new")]


def test_declared_view_round_trip(spark, star):
    from metricloom import Dimension, Join, Measure, MetricView, Window

    star.source.write.mode("overwrite").saveAsTable("fact_sales_t")
    star.joins[2].source.write.mode("overwrite").saveAsTable("dim_date_t")
    mv = MetricView(
        "mv_round", "fact_sales_t", (Join("calendar", "dim_date_t", "source.date_key = calendar.date"),),
        (Dimension("Date", "calendar.date", "day"), Dimension("Year", "calendar.year")),
        (Measure("Total", "SUM(amount)", "all"), Measure("YTD", "SUM(amount)", window=(Window("Date", "cumulative"), Window("Year", "current")))),
        filter="status = 'Active'", comment="sales",
    )
    assert "comment" not in str(mv.definition())
    audit.publish_view(spark, mv, "registry_t")
    again = audit.load_view(spark, "mv_round", "registry_t")
    assert rows(again.query(spark, ["Total", "YTD"], ["Year"])) == rows(mv.query(spark, ["Total", "YTD"], ["Year"]))
    audit.drop(spark, "mv_round", "registry_t")
    try:
        audit.load_view(spark, "mv_round", "registry_t")
        raise AssertionError("dropped views must be gone")
    except KeyError:
        pass


def test_current_state_of_ids_with_equal_times_without_ids_and_without_either_event(spark):
    rows = [
        ("a", "translation", 1, "x", ""), ("a", "translation", 1, "x", ""), ("a", "deploy", 2, "", "v1"), ("a", "deploy", 3, "", "v2"),
        ("b", "translation", 5, "old", ""), ("b", "translation", 6, "new", ""), ("c", "deploy", 1, "", "v3"), (None, "translation", 1, "none", ""),
        ("d", "translation", None, "never", ""),
    ]
    given = spark.createDataFrame(rows, "id string, event string, at long, measures_input string, deployed_view string")
    events = audit.audit_rows(given.withColumn("timestamp", F.timestamp_seconds("at")))
    got = audit.audit_current(events).select("id", "measures_input", "deployed_view").collect()
    want = [("a", "x", "v2"), ("b", "new", ""), ("c", None, "v3"), (None, "none", ""), ("d", None, "")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_texts_of_the_audit_are_neither_sorted_nor_held(spark):
    """Texts pass by the rows that are wanted: before, every task sorted whole rows by id."""
    events = audit.audit_rows(spark.range(100).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), 100).alias("yaml_body")))
    plan = audit.audit_current(events)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") >= 2
