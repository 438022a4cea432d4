"""From translated measures to view definitions, warnings, reports and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from metricloom.functions.text import normalize_range, parse_answer_json, split_pair, view_name
from metricloom.operators.rules import guard_over
from metricloom.plans import settle as S

# Definition blocks per text part of a view, see `render_views`.
PART = 1000


def with_batch(df: DataFrame, batch_id: str) -> DataFrame:
    """Tag rows with a batch id and its mode."""
    return df.withColumns(
        {"batch_id": F.lit(batch_id), "batch_mode": F.concat(F.lit("batch_"), F.col("source_format"))}
    )


def _tidy_windows(window: Column, dimensions: Column) -> Column:
    """Window entries with normal ranges and with orders that name one of the measure's dimensions.

    An order is looked for by name, then by expression, then by containment (longest name first).
    """
    dims = F.transform(dimensions, split_pair)

    def order(text: Column) -> Column:
        low = F.lower(text)
        near = F.array_sort(
            F.filter(dims, lambda d: F.lower(d["name"]).contains(low) | low.contains(F.lower(d["name"]))),
            lambda a, b: F.when(F.length(a["name"]) != F.length(b["name"]), F.length(b["name"]) - F.length(a["name"]))
            .when(a["name"] < b["name"], -1)
            .when(a["name"] > b["name"], 1)
            .otherwise(0),
        )
        by_expr = F.get(F.filter(dims, lambda d: d["expr"] == text), F.lit(0))["name"]
        by_name = F.when(F.exists(dims, lambda d: d["name"] == text), text)
        return F.coalesce(by_name, by_expr, F.get(near, F.lit(0))["name"], text)

    return F.transform(
        window,
        lambda w: F.struct(
            order(w["order"]).alias("order"),
            normalize_range(w["range"]).alias("range"),
            F.coalesce(w["semiadditive"], F.lit("last")).alias("semiadditive"),
        ),
    )


def parse_answers(answered: DataFrame) -> DataFrame:
    """Typed answer columns from the text column `ai_result` (B7); broken texts become warnings."""
    df = answered.withColumn("__a", parse_answer_json(F.col("ai_result")))
    failed = F.col("__a").isNull()
    shown = F.substring(F.coalesce(F.col("ai_result"), F.lit("")), 1, 200)
    empty = F.array().cast("array<string>")
    no_joins = F.array().cast("array<struct<name:string,source:string,on:string>>")
    return df.withColumns(
        {
            "expr": F.col("__a.expr"),
            "needs_window": F.coalesce("__a.needs_window", F.lit(False)),
            "window": _tidy_windows(F.col("__a.window"), F.coalesce("__a.dimensions_needed", empty)),
            "warning_type": F.when(failed, "translation_error").otherwise(F.col("__a.warning_type")),
            "warning_message": F.when(
                failed, F.concat(F.lit("answer cannot be read: "), shown)
            ).otherwise(F.col("__a.warning_message")),
            "dimensions_needed": F.coalesce("__a.dimensions_needed", empty),
            "joins_needed": F.coalesce("__a.joins_needed", no_joins),
        }
    ).drop("__a")


def status(warning: Column, expr: Column) -> Column:
    """failed, warning, partial or success of one measure."""
    return (
        F.when(warning == "translation_error", "failed")
        .when(expr.isNull(), "warning")
        .when(warning.isNotNull(), "partial")
        .otherwise("success")
    )


def measure_details(translated: DataFrame) -> DataFrame:
    """One line per measure."""
    df = guard_over(translated)
    return df.select(
        F.col("fact_table_fqn").alias("source_table"),
        "measure_name",
        status(F.col("warning_type"), F.col("expr")).alias("status"),
        "expr",
        F.col("needs_window") & F.col("expr").isNotNull() if "needs_window" in df.columns else F.lit(False),
        "warning_type",
    ).toDF("source_table", "measure_name", "status", "expr", "needs_window", "warning_type")


def warnings(translated: DataFrame) -> DataFrame:
    """One line per warning, with the approximation where one was kept."""
    return guard_over(translated).where("warning_type IS NOT NULL").select(
        F.col("fact_table_fqn").alias("source_table"),
        "measure_name",
        F.col("measure_expr").alias("expression"),
        "warning_type",
        F.coalesce("warning_message", F.lit("")).alias("message"),
        F.col("expr").alias("approximation"),
    )


def view_stats(translated: DataFrame) -> DataFrame:
    """Counts and overall status per view; every measure counts once."""
    df = measure_details(translated).groupBy("source_table").agg(
        F.count(F.lit(1)).alias("measures_total"),
        F.count_if(F.col("status") == "success").alias("measures_success"),
        F.count_if(F.col("status").isin("warning", "partial")).alias("measures_warning"),
        F.count_if(F.col("status") == "failed").alias("measures_failed"),
    )
    clean = (F.col("measures_warning") == 0) & (F.col("measures_failed") == 0)
    overall = F.when(clean, "success").when(F.col("measures_success") > 0, "partial").otherwise("failed")
    return df.withColumn("status", overall)


def batch_report(translated: DataFrame) -> dict[str, DataFrame]:
    """The three reports of a batch."""
    return {"views": view_stats(translated), "measures": measure_details(translated), "warnings": warnings(translated)}


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in an order (U3), by aggregation, so that a frequent key is merged early."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__row")
    )
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


ORDER = ["model", "position"]


def _kept(translated: DataFrame) -> DataFrame:
    return guard_over(translated).where("expr IS NOT NULL")


def view_joins(translated: DataFrame) -> DataFrame:
    """Joins of each view, the first of a name: fact_table_fqn, name, source, on."""
    df = _kept(translated).select("fact_table_fqn", *ORDER, F.posexplode("joins_needed").alias("k", "j"))
    df = df.select("fact_table_fqn", F.col("j.name").alias("name"), F.col("j.source").alias("source"),
                   F.col("j.on").alias("on"), *ORDER, "k")
    return dedupe_first(df.where("name <> ''"), ["fact_table_fqn", "name"], [*ORDER, "k"])


def view_dimensions(translated: DataFrame) -> DataFrame:
    """Dimensions of each view, the first of a name; `status` where no measure needs one."""
    kept = _kept(translated)
    df = kept.select("fact_table_fqn", *ORDER, F.posexplode("dimensions_needed").alias("k", "d"))
    df = df.withColumn("p", split_pair(F.col("d"))).select(
        "fact_table_fqn", F.col("p.name").alias("name"), F.col("p.expr").alias("expr"), *ORDER, "k"
    )
    named = dedupe_first(df, ["fact_table_fqn", "name"], [*ORDER, "k"])
    bare = kept.select("fact_table_fqn").distinct().join(named.select("fact_table_fqn"), "fact_table_fqn", "left_anti")
    default = bare.select(
        "fact_table_fqn", F.lit("status").alias("name"), F.lit("status").alias("expr"),
        F.lit("").alias("model"), F.lit(0).cast("bigint").alias("position"), F.lit(0).alias("k"),
    )
    return named.unionByName(default)


def view_measures(translated: DataFrame) -> DataFrame:
    """Measures of each view."""
    kept = _kept(translated)
    window = F.when(F.col("needs_window") & (F.size("window") > 0), F.col("window"))
    return kept.select("fact_table_fqn", F.col("measure_name").alias("name"), "expr", window.alias("window"), *ORDER)


def assemble_views(translated: DataFrame, catalog: str = "main", schema: str = "sales") -> DataFrame:
    """One line per view: name, source, version and sizes (B10). Views without measures are left out.

    The definitions themselves stay rows of `view_joins`, `view_dimensions` and `view_measures`, as
    one fact table may own any number of measures.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("fact_table_fqn").agg(F.count(F.lit(1)).alias(name))

    measures = view_measures(translated).groupBy("fact_table_fqn").agg(
        F.count(F.lit(1)).alias("measure_count"),
        F.when(F.max(F.col("window").isNotNull()), "0.1").otherwise("1.1").alias("version"),
    )
    df = measures.join(counted(view_dimensions(translated), "dimension_count"), "fact_table_fqn")
    df = df.join(counted(view_joins(translated), "join_count"), "fact_table_fqn", "left")
    return df.select(
        qualified_view(catalog, schema),
        F.col("fact_table_fqn").alias("source"),
        "version",
        F.coalesce("join_count", F.lit(0)).alias("join_count"),
        "dimension_count",
        "measure_count",
    )


def qualified_view(catalog: str, schema: str) -> Column:
    name = view_name(F.col("fact_table_fqn"), "batch")
    return F.concat_ws(".", F.lit(catalog), F.lit(schema), name).alias("view_name")


def yaml_text(c: Column) -> Column:
    """A scalar in double quotes, valid in JSON and YAML."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _entry(**fields: Column) -> Column:
    """`- name: ...` block; absent values leave their line out."""
    lines = [F.concat(F.lit(f"  {k}: "), yaml_text(v)) for k, v in fields.items()]
    lines[0] = F.concat(F.lit("- "), F.substring(lines[0], F.lit(3), F.length(lines[0])))
    return F.concat_ws("\n", *lines)


def _window_block(window: Column) -> Column:
    entries = F.transform(
        window,
        lambda w: F.concat(
            F.lit("  - order: "), yaml_text(w["order"]),
            F.lit("\n    range: "), yaml_text(w["range"]),
            F.lit("\n    semiadditive: "), yaml_text(w["semiadditive"]),
        ),
    )
    return F.when(window.isNotNull(), F.concat(F.lit("  window:\n"), F.array_join(entries, "\n")))


def view_blocks(translated: DataFrame, catalog: str = "main", schema: str = "sales") -> DataFrame:
    """Definition blocks of all views in long form: view_name, sort key, text."""
    translated = S.settle(translated)
    views = S.settle(assemble_views(translated, catalog, schema))
    none = F.lit("").alias("model"), F.lit(-1).cast("bigint").alias("position"), F.lit(-1).alias("k")

    def section(n: int, rows: DataFrame, text: Column) -> DataFrame:
        k = F.col("k") if "k" in rows.columns else F.lit(0)
        return rows.select(
            qualified_view(catalog, schema), F.lit(n).alias("section"), *ORDER, k.alias("k"), F.col("name").alias("item"), text.alias("text")
        )

    def heading(n: int, rows: DataFrame, text: Column) -> DataFrame:
        return rows.select("view_name", F.lit(n).alias("section"), *none, F.lit("").alias("item"), text.alias("text"))

    head = F.concat(F.lit("version: "), yaml_text(F.col("version")), F.lit("\nsource: "), yaml_text(F.col("source")))
    measure = F.concat_ws(
        "\n", _entry(name=F.col("name"), expr=F.col("expr")), _window_block(F.col("window"))
    )
    parts = [
        heading(0, views, head),
        heading(1, views.where("join_count > 0"), F.lit("joins:")),
        # `on` is a truth value in YAML 1.1, hence the quotes around the key.
        section(1, view_joins(translated), _entry(name=F.col("name"), source=F.col("source"), **{'"on"': F.col("on")})),
        heading(2, views, F.lit("dimensions:")),
        section(2, view_dimensions(translated), _entry(name=F.col("name"), expr=F.col("expr"))),
        heading(3, views, F.lit("measures:")),
        section(3, view_measures(translated), measure),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def render_views(translated: DataFrame, catalog: str = "main", schema: str = "sales", part: int = PART) -> DataFrame:
    """YAML and DDL of every view (B14): view_name, part, parts, yaml, ddl.

    A view of up to `part` blocks is one row with the whole text. A larger one comes in numbered
    parts whose texts, joined by newlines in order, are the whole: no row and no task ever holds
    more than `part` blocks, whichever share of the catalog one view owns. Blocks are numbered by
    range-partitioned running counts.
    """
    blocks = view_blocks(translated, catalog, schema)
    keyed = blocks.select(
        "view_name",
        F.struct("section", "position", "model", "k", "item").alias("at"),
        "text",
        F.lit(1).cast("bigint").alias("one"),
    )
    numbered = S.settle(S.prefix_sums(keyed, ["view_name"], "at", {"n": "one"}))
    sizes = numbered.groupBy("view_name").agg(F.max("n").alias("blocks"))
    split = numbered.withColumn("part", F.floor((F.col("n") - 1) / F.lit(part)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    df = split.groupBy("view_name", "part").agg(text.alias("yaml")).join(sizes, "view_name")
    df = df.withColumn("parts", F.ceil(F.col("blocks") / F.lit(part)).cast("int"))
    opening = F.concat(
        F.lit("CREATE OR REPLACE VIEW "), F.col("view_name"), F.lit("\nWITH METRICS\nLANGUAGE YAML\nAS $$\n")
    )
    indented = F.regexp_replace("yaml", r"(?m)^", "  ")
    ddl = F.concat(
        F.when(F.col("part") == 0, opening).otherwise(F.lit("")),
        indented,
        F.when(F.col("part") == F.col("parts") - 1, F.lit("\n$$")).otherwise(F.lit("")),
    )
    return df.select("view_name", "part", "parts", "yaml", ddl.alias("ddl"))
