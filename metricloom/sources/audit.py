"""Append-only tables: staging batches, audit history, view registry.

Tables are parquet tables of the session catalog. Every change is an appended event and the current
state is the newest event per key, so concurrent writers never touch each other's rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.operators.assembly import assemble_views, view_stats, warnings
from metricloom.plans.model import MetricView
from metricloom.plans.settle import prefix_sums, settle

# Columns of the audit table.
AUDIT_COLUMNS = {
    "id": "string",
    "event": "string",
    "timestamp": "timestamp",
    "mode": "string",
    "model": "string",
    "source_table": "string",
    "dimension_tables": "string",
    "measures_input": "string",
    "status": "string",
    "version": "string",
    "measure_count": "int",
    "dimension_count": "int",
    "warning_count": "int",
    "warnings": "string",
    "yaml_body": "string",
    "sql_output": "string",
    "deployed_view": "string",
    "deploy_status": "string",
    "error_message": "string",
    "user_name": "string",
}


# ---------------------------------------------------------------- staging


def write_staging(df: DataFrame, table: str) -> None:
    """Write batches; a batch written again replaces itself, other batches stay."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        df.write.partitionBy("batch_id").saveAsTable(table)
        return
    known = spark.table(table).columns
    added = [f for f in df.schema.fields if f.name not in known]
    if added:
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({cols})")
        spark.catalog.refreshTable(table)
    target = spark.table(table)
    rows = df.select(
        *[
            F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)


def pending(staging: DataFrame, batch_id: str) -> DataFrame:
    """Rows of one batch that still wait for a translation."""
    return staging.where((F.col("batch_id") == batch_id) & (F.col("final_status") == "pending"))


def translate_batch(staging: DataFrame, batch_id: str, table: str, translate) -> DataFrame:
    """Translate the pending rows of a batch into a result table."""
    translate(pending(staging, batch_id)).write.mode("overwrite").saveAsTable(table)
    return staging.sparkSession.table(table)


# ---------------------------------------------------------------- audit


def ensure_audit(spark: SparkSession, table: str) -> None:
    """Create the audit table, or add the columns an older one lacks."""
    if not spark.catalog.tableExists(table):
        cols = ", ".join(f"`{n}` {t}" for n, t in AUDIT_COLUMNS.items())
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet")
        return
    have = spark.table(table).columns
    added = ", ".join(f"`{n}` {t}" for n, t in AUDIT_COLUMNS.items() if n not in have)
    if added:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({added})")


def audit_rows(df: DataFrame, event: str = "translation") -> DataFrame:
    """Rows in the shape of the audit table: ids and times given, texts whole."""
    def column(name: str, kind: str) -> Column:
        if name in df.columns:
            c = F.col(f"`{name}`")
        elif name == "event":
            c = F.lit(event)
        elif name == "id":
            c = F.uuid() if hasattr(F, "uuid") else F.expr("uuid()")
        elif name == "timestamp":
            c = F.current_timestamp()
        else:
            c = F.lit("") if kind == "string" else F.lit(0)
        return c.cast(kind).alias(name)

    return df.select(*[column(n, t) for n, t in AUDIT_COLUMNS.items()])


def audit_append(df: DataFrame, table: str, event: str = "translation") -> None:
    """Append outcomes, successes and failures alike."""
    spark = df.sparkSession
    ensure_audit(spark, table)
    spark.catalog.refreshTable(table)
    rows, have = audit_rows(df, event), spark.table(table).schema.fields
    # Tables are written by position: the columns come in the table's own order.
    rows.select(
        *[F.col(f"`{f.name}`") if f.name in AUDIT_COLUMNS else F.lit(None).cast(f.dataType).alias(f.name) for f in have]
    ).write.mode("append").insertInto(table)


def audit_of_batch(
    translated: DataFrame, batch_id: str, model: str = "rules", views: DataFrame | None = None, user: str = "",
    catalog: str = "main", schema: str = "sales",
) -> DataFrame:
    """One audit row per view of a batch: what went in, what came out, its warnings as JSON.

    `views` are the rendered texts of the batch (`view_name`, `part`, `yaml`, `ddl`); the first part
    stands for a view whose text comes in several. Measures and warnings are listed up to `LISTED`
    characters of whole entries, their numbers are given beside; all of them, and all parts, are rows
    of `entries_of_batch`.
    """
    translated = settle(translated)
    stats = view_stats(translated)
    names = assemble_views(translated, catalog, schema)
    about = names.select(F.col("source").alias("source_table"), "view_name", "version", "measure_count", "dimension_count")
    listed = warnings_json(warnings(translated), "source_table")
    given = json_list(
        translated.select(F.col("fact_table_fqn").alias("source_table"), "model", "position", measure_json().alias("item")),
        "source_table", ["model", "position", "item"], "measures_input",
    )
    tables = F.to_json(F.transform("dim_tables", lambda d: d["table"]))
    formats = translated.groupBy(F.col("fact_table_fqn").alias("source_table")).agg(
        F.min("source_format").alias("fmt"), F.min(tables).alias("dimension_tables")
    )
    df = stats.join(about, "source_table", "left").join(listed, "source_table", "left").join(given, "source_table", "left")
    df = df.join(formats, "source_table")
    if views is not None:
        first = views.where("part = 0").select("view_name", F.col("yaml").alias("yaml_body"), F.col("ddl").alias("sql_output"))
        df = df.join(first, "view_name", "left")
    else:
        df = df.withColumns({"yaml_body": F.lit(None).cast("string"), "sql_output": F.lit(None).cast("string")})
    text = lambda c, none="": F.coalesce(c, F.lit(none)).alias(c)
    return df.select(
        audit_id(batch_id, F.col("source_table")).alias("id"),
        F.concat(F.lit("batch_"), F.col("fmt")).alias("mode"),
        F.lit(model).alias("model"),
        "source_table",
        text("dimension_tables", "[]"),
        text("measures_input", "[]"),
        "status",
        text("version"),
        F.coalesce("measure_count", F.lit(0)).alias("measure_count"),
        F.coalesce("dimension_count", F.lit(0)).alias("dimension_count"),
        (F.col("measures_warning") + F.col("measures_failed")).alias("warning_count"),
        text("warnings", "[]"),
        text("yaml_body"),
        text("sql_output"),
        F.lit(user).alias("user_name"),
    )


def audit_id(batch_id: str, source_table: Column) -> Column:
    return F.concat(F.lit(batch_id), F.lit("/"), source_table)


def measure_json() -> Column:
    return F.to_json(F.struct(F.col("measure_name").alias("name"), F.col("measure_expr").alias("expression")))


def warning_json() -> Column:
    return F.to_json(F.struct(F.col("measure_name").alias("name"), F.col("warning_type").alias("type"), F.col("message").alias("msg")))


# Characters of a JSON list in the audit table.
LISTED = 4000


def json_list(rows: DataFrame, key: str, order: list[str], name: str, limit: int = LISTED) -> DataFrame:
    """JSON array of the first entries (`item`, JSON texts) per key whose text stays within `limit`.

    The array is always valid JSON: entries are whole or absent. Spark keeps the first rows of each
    key in every task before the shuffle; an entry has ten characters at least, so rows after
    `limit / 10` could never show.
    """
    from pyspark.sql import Window as W

    by = W.partitionBy(key).orderBy(*order)
    first = rows.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= limit // 10)
    upto = F.sum(F.length("item") + 1).over(by.rowsBetween(W.unboundedPreceding, 0))
    fitting = first.withColumn("__upto", upto).where(F.col("__upto") + 1 <= limit)
    items = F.transform(F.array_sort(F.collect_list(F.struct("__n", "item"))), lambda x: x["item"])
    listed = fitting.groupBy(key).agg(items.alias("__items"))
    return listed.select(key, F.concat(F.lit("["), F.array_join("__items", ","), F.lit("]")).alias(name))


def warnings_json(warned: DataFrame, key: str, limit: int = LISTED) -> DataFrame:
    """JSON array of the warnings per key, whole entries up to `limit` characters."""
    rows = warned.select(key, "measure_name", "warning_type", "message", warning_json().alias("item"))
    return json_list(rows, key, ["measure_name", "warning_type", "message"], "warnings", limit)


ENTRIES = "audit_id string, written_at timestamp, kind string, position bigint, part int, content string"


def entries_of_batch(
    translated: DataFrame, batch_id: str, views: DataFrame | None = None, catalog: str = "main", schema: str = "sales"
) -> DataFrame:
    """All that the audit rows of a batch stand for, nothing cut: audit_id, kind, position, part, content.

    Kinds are `measure` and `warning` (a JSON object each, `position` from 0 in the order of the
    lists of `audit_of_batch`) and, where `views` are given, `yaml` and `ddl` (`part` from 0; the
    parts joined by newlines are the whole text). Entries are numbered by range-partitioned running
    counts, so a view may own any share of the batch.
    """
    translated = settle(translated)
    none, kind = F.lit(""), lambda name: F.lit(name).alias("kind")
    measures = translated.select(
        audit_id(batch_id, F.col("fact_table_fqn")).alias("audit_id"), kind("measure"),
        F.struct(F.col("model").alias("a"), F.col("position").alias("b"), measure_json().alias("c"), none.alias("d")).alias("at"),
        measure_json().alias("content"),
    )
    warned = warnings(translated).select(
        audit_id(batch_id, F.col("source_table")).alias("audit_id"), kind("warning"),
        F.struct(
            F.col("measure_name").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("warning_type").alias("c"), F.col("message").alias("d")
        ).alias("at"),
        warning_json().alias("content"),
    )
    listed = measures.unionByName(warned).withColumn("one", F.lit(1).cast("bigint"))
    numbered = prefix_sums(listed, ["audit_id", "kind"], "at", {"n": "one"})
    out = numbered.select("audit_id", "kind", (F.col("n") - 1).alias("position"), F.lit(0).alias("part"), "content")
    if views is None:
        return out
    owners = assemble_views(translated, catalog, schema).select("view_name", audit_id(batch_id, F.col("source")).alias("audit_id"))
    texts = views.select("view_name", "part", F.explode(F.create_map(F.lit("yaml"), "yaml", F.lit("ddl"), "ddl")).alias("kind", "content"))
    parts = texts.join(owners, "view_name")
    return out.unionByName(parts.select("audit_id", "kind", F.lit(0).cast("bigint").alias("position"), F.col("part").cast("int").alias("part"), "content"))


def entries_append(entries: DataFrame, table: str) -> None:
    """Append the entries of a batch; a batch written again replaces what it wrote before, see `entries_current`."""
    entries.sparkSession.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ENTRIES}) USING parquet")
    rows = entries.withColumn("written_at", F.current_timestamp())
    rows.select("audit_id", "written_at", "kind", "position", "part", "content").write.mode("append").insertInto(table)


def entries_current(entries: DataFrame) -> DataFrame:
    """The entries each audit id wrote last."""
    latest = entries.groupBy("audit_id").agg(F.max("written_at").alias("written_at"))
    return entries.join(latest, ["audit_id", "written_at"])


def with_entries(history: DataFrame, entries: DataFrame, n: int = 10) -> DataFrame:
    """Audit rows with their first `n` measures and warnings as lists of JSON objects, for display.

    The lists are empty where an audit id has none; `entries_current` has the rest.
    """
    shown = entries.join(history.select(F.col("id").alias("audit_id")), "audit_id", "left_semi")
    first = entries_current(shown).where((F.col("position") < n) & F.col("kind").isin("measure", "warning"))

    def listed(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("position", "content"))))
        return F.transform(rows, lambda x: x["content"])

    lists = first.groupBy(F.col("audit_id").alias("id")).agg(
        listed("measure").alias("first_measures"), listed("warning").alias("first_warnings")
    )
    empty = F.array().cast("array<string>")
    df = history.join(lists, "id", "left")
    return df.withColumns({c: F.coalesce(c, empty) for c in ("first_measures", "first_warnings")})


def audit_deploy(spark: SparkSession, table: str, audit_id: str, view: str, ok: bool, message: str = "", user: str = ""):
    """Append the outcome of a deployment (S16); the audit id says which entry it belongs to."""
    row = spark.createDataFrame(
        [(audit_id, view, "success" if ok else "failed", "" if ok else message, user)],
        "id string, deployed_view string, deploy_status string, error_message string, user_name string",
    )
    audit_append(row, table, "deploy")


def audit_current(events: DataFrame) -> DataFrame:
    """One row per audit id: the translation with its latest deployment.

    An error of the translation itself is kept over a deployment's. Texts can be long and many: which
    rows are the latest is found out from numbers of rows, and texts only pass by the rows that were
    found, so that no task sorts or holds them.
    """
    kept = [c for c in AUDIT_COLUMNS if c not in ("id", "event", "deployed_view", "deploy_status", "user_name")]
    numbered = settle(events.select(*AUDIT_COLUMNS).withColumn("__row", F.monotonically_increasing_id()))
    base = F.col("event") != "deploy"
    latest = numbered.groupBy("id").agg(
        F.max_by(F.when(base, F.col("__row")), F.when(base, F.col("timestamp"))).alias("__t"),
        F.max_by(F.when(~base, F.col("__row")), F.when(~base, F.col("timestamp"))).alias("__d"),
    )
    # An id without one of them gets a number that no row has: missing ones would all meet in one task.
    latest = latest.select("id", F.coalesce("__t", -1 - F.col("__d")).alias("__t"), F.coalesce("__d", -1 - F.col("__t")).alias("__d"))
    own = numbered.where(base).select(F.col("__row").alias("__t"), F.struct(*kept, F.col("user_name").alias("own_user")).alias("t"))
    deploy = F.struct("deployed_view", "deploy_status", F.col("error_message").alias("deploy_error"), "user_name")
    deployed = numbered.where(~base).select(F.col("__row").alias("__d"), deploy.alias("d"))
    # The side that is hashed is the one with the numbers.
    df = deployed.join(latest.hint("shuffle_hash"), "__d", "right")
    df = own.join(df.hint("shuffle_hash"), "__t", "right")
    error = F.when(F.coalesce("t.error_message", F.lit("")) == "", F.coalesce("d.deploy_error", F.lit(""))).otherwise(
        F.col("t.error_message")
    )
    return df.select(
        "id",
        *[F.col(f"t.{c}").alias(c) for c in kept if c != "error_message"],
        F.coalesce("d.deployed_view", F.lit("")).alias("deployed_view"),
        F.coalesce("d.deploy_status", F.lit("")).alias("deploy_status"),
        error.alias("error_message"),
        F.coalesce("d.user_name", "t.own_user").alias("user_name"),
    )


def audit_history(current: DataFrame, n: int = 50) -> DataFrame:
    """Newest entries first (S17); every task keeps its own first `n`."""
    return current.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


# ---------------------------------------------------------------- registry


REGISTRY = "view_name string, changed_at timestamp, version string, part int, definition string, dropped boolean"


def publish(definitions: DataFrame, table: str) -> None:
    """Create or replace views (S19): rows (view_name, version, definition) appended to the registry.

    Definitions are YAML texts. One that comes in parts has a row for each, numbered by `part`.
    """
    _register(definitions.withColumn("dropped", F.lit(False)), table)


def publish_view(spark: SparkSession, mv: MetricView, table: str) -> None:
    """Create or replace one declared view; its source and joins must be table names or paths."""
    row = spark.createDataFrame(
        [(mv.name, mv.version, json.dumps(mv.definition()))], "view_name string, version string, definition string"
    )
    publish(row, table)


def load_view(spark: SparkSession, name: str, table: str) -> MetricView:
    """A published view, ready to be queried: its parts in order are one YAML text (JSON is YAML)."""
    import yaml

    rows = published(spark.table(table).where(F.col("view_name") == name)).orderBy("part").collect()
    if not rows:
        raise KeyError(f"no view {name}")
    return MetricView.from_definition(name, yaml.safe_load("\n".join(r["definition"] for r in rows)))


def drop(spark: SparkSession, name: str, table: str) -> None:
    gone = spark.createDataFrame([(name, None, None, True)], "view_name string, version string, definition string, dropped boolean")
    _register(gone, table)


def _register(df: DataFrame, table: str) -> None:
    spark = df.sparkSession
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({REGISTRY}) USING parquet")
    part = F.col("part").cast("int") if "part" in df.columns else F.lit(0)
    df.select("view_name", F.current_timestamp().alias("changed_at"), "version", part.alias("part"), "definition", "dropped").write.mode(
        "append"
    ).insertInto(table)


def published(registry: DataFrame) -> DataFrame:
    """The views that exist now: the rows of each name's newest event, unless that is a drop.

    An event replaces all parts of the ones before it.
    """
    if "part" not in registry.columns:
        registry = registry.withColumn("part", F.lit(0))
    latest = registry.groupBy("view_name").agg(F.max("changed_at").alias("changed_at"))
    rows = registry.join(latest, ["view_name", "changed_at"])
    return rows.where("NOT dropped").select("view_name", "changed_at", "version", "part", "definition")
