"""Readers of exported measure definitions: tabular-model JSON, measure CSV, cube scripts.

All three give the same staging rows, one per measure. The parsers work on frames of file texts, so
a whole catalog of exports is one job; nothing passes through the driver but the mapping file.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from metricloom.functions.text import last_part, snake_case
from metricloom.plans.settle import salted_join, settle

S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TABLE = _struct(
    name=S,
    columns=T.ArrayType(_struct(name=S, dataType=S, sourceColumn=S)),
    measures=T.ArrayType(_struct(name=S, expression=S, description=S)),
    partitions=T.ArrayType(_struct(name=S, source=_struct(type=S, expression=S))),
)
RELATIONSHIP = _struct(name=S, fromTable=S, fromColumn=S, toTable=S, toColumn=S)
MODEL_FIELDS = {"tables": T.ArrayType(TABLE), "relationships": T.ArrayType(RELATIONSHIP)}
BIM = _struct(name=S, model=_struct(**MODEL_FIELDS), **MODEL_FIELDS)

DIM_TABLE = _struct(alias=S, table=S, join_key=S, dim_key=S, columns=T.ArrayType(S))

# Columns of the staging table.
STAGING = _struct(
    model=S,
    position=T.LongType(),
    source_format=S,
    source_table=S,
    measure_name=S,
    measure_expr=S,
    description=S,
    mode=S,
    fact_table_fqn=S,
    fact_columns=T.ArrayType(S),
    dim_tables=T.ArrayType(DIM_TABLE),
    col_map=T.MapType(S, S),
    resolved_expr=S,
    final_status=S,
    error_message=S,
    needs_window=T.BooleanType(),
)


def detect_format(path: Column) -> Column:
    """Format by file extension; NULL when unknown."""
    low = F.lower(path)
    return (
        F.when(low.endswith(".bim"), "bim")
        .when(low.endswith(".csv"), "csv")
        .when(low.endswith(".mdx"), "mdx_script")
    )


def split_known(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files with a known format, and the others with the reason."""
    tagged = files.withColumn("source_format", detect_format(F.col(path)))
    known = tagged.where("source_format IS NOT NULL")
    message = F.concat(F.lit("cannot detect the format of "), F.col(path))
    return known, tagged.where("source_format IS NULL").withColumn("error_message", message)


def _staged(df: DataFrame, **given: Column) -> DataFrame:
    """Complete rows to the staging shape."""
    empty = {
        "resolved_expr": F.lit(None),
        "final_status": F.lit("pending"),
        "error_message": F.lit(None),
        "needs_window": F.lit(False),
    }
    values = {**empty, **given}
    return df.select(
        *[values.get(f.name, F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in STAGING.fields]
    )


# ---------------------------------------------------------------- tabular models


# Fixed value: how a partition expression names its table.
PARTITION_ITEM = 'Item="(\\w+)"'


def infer_table_fqn(table: Column, catalog: str, schema: str) -> Column:
    """Physical name: `Item="x"` of the first partition that has one, else the snake-cased name."""
    items = F.transform(
        F.coalesce(table["partitions"], F.array().cast(TABLE["partitions"].dataType)),
        lambda p: F.regexp_extract(F.coalesce(p["source"]["expression"], F.lit("")), PARTITION_ITEM, 1),
    )
    found = F.get(F.filter(items, lambda x: x != ""), F.lit(0))
    return F.concat_ws(".", F.lit(catalog), F.lit(schema), F.coalesce(found, snake_case(table["name"])))


def _column_map(table: Column) -> Column:
    """Model column name -> physical name; a source column, where given, wins."""
    cols = F.coalesce(table["columns"], F.array().cast(TABLE["columns"].dataType))
    return F.map_from_entries(
        F.transform(cols, lambda c: F.struct(c["name"], F.coalesce(c["sourceColumn"], snake_case(c["name"]))))
    )


def dim_alias(name: Column) -> Column:
    """`DimCustomer` -> `customer`, `dim_customer` -> `customer`."""
    return F.regexp_replace(snake_case(F.regexp_replace(name, "^Dim(?=[A-Z])", "")), "^dim_", "")


def model_relationships(models: DataFrame, catalog: str, schema: str) -> DataFrame:
    """Fact table and joined dimensions of each model (S3).

    The fact is the first table with measures; dimensions are the one-sides of relationships that
    start at the fact. A model is one document, so this stays within its row.
    """
    with_measures = F.filter("tables", lambda t: F.size(F.coalesce(t["measures"], F.array())) > 0)
    df = models.withColumn("fact", F.get(with_measures, F.lit(0)))
    edges = F.filter(
        F.coalesce(F.col("relationships"), F.array().cast(MODEL_FIELDS["relationships"])),
        lambda r: (r["fromTable"] == F.col("fact.name"))
        & F.exists("tables", lambda t: t["name"] == r["toTable"]),
    )

    def dimension(r: Column) -> Column:
        to = F.get(F.filter(F.col("tables"), lambda t: t["name"] == r["toTable"]), F.lit(0))
        own, other = _column_map(F.col("fact")), _column_map(to)
        return F.struct(
            dim_alias(r["toTable"]).alias("alias"),
            infer_table_fqn(to, catalog, schema).alias("table"),
            F.coalesce(own[r["fromColumn"]], snake_case(r["fromColumn"])).alias("join_key"),
            F.coalesce(other[r["toColumn"]], snake_case(r["toColumn"])).alias("dim_key"),
            F.map_values(other).alias("columns"),
        )

    return (
        df.withColumn("dim_tables", F.transform(edges, dimension))
        .withColumn("fact_table_fqn", infer_table_fqn(F.col("fact"), catalog, schema))
        .withColumn("fact_columns", F.map_values(_column_map(F.col("fact"))))
    )


def parse_bim(texts: DataFrame, catalog: str, schema: str) -> DataFrame:
    """Staging rows of model texts (columns `path`, `value`); wrapped or bare models."""
    doc = texts.withColumn("doc", F.from_json("value", BIM))
    models = doc.select(
        "path",
        F.coalesce(F.col("doc.model.tables"), F.col("doc.tables")).alias("tables"),
        F.coalesce(F.col("doc.model.relationships"), F.col("doc.relationships")).alias("relationships"),
    )
    df = model_relationships(models, catalog, schema)
    pairs = F.transform(
        "tables",
        lambda t: F.transform(
            _column_entries(t), lambda e: F.struct(F.concat(t["name"], F.lit("."), e["key"]), e["value"])
        ),
    )
    measures = F.transform(
        "tables",
        lambda t: F.transform(
            F.coalesce(t["measures"], F.array().cast(TABLE["measures"].dataType)),
            lambda m: F.struct(
                t["name"].alias("source_table"),
                m["name"].alias("measure_name"),
                m["expression"].alias("measure_expr"),
                F.coalesce(m["description"], F.lit("")).alias("description"),
            ),
        ),
    )
    df = df.withColumn("col_map", F.map_from_entries(F.flatten(pairs)))
    df = df.withColumn("all_measures", F.flatten(measures)).drop("tables", "relationships", "fact")
    rows = df.select("*", F.posexplode("all_measures").alias("position", "m")).select("*", "m.*")
    return _staged(rows, model=F.col("path"), source_format=F.lit("bim"), mode=F.lit("dax"))


def _column_entries(table: Column) -> Column:
    return F.map_entries(_column_map(table))


def read_bim(spark: SparkSession, path: str | list[str], catalog: str = "main", schema: str = "sales") -> DataFrame:
    return parse_bim(read_texts(spark, path), catalog, schema)


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: `path`, `value`."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


# ---------------------------------------------------------------- CSV and cube scripts


def load_mapping(spark: SparkSession, path: str) -> dict:
    """Mapping of an export to physical tables (S6): fact_table, dimension_tables."""
    import yaml

    return check_mapping(yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"]))


def check_mapping(mapping: Mapping | None) -> dict:
    if not mapping or not mapping.get("fact_table"):
        raise ValueError("this format needs a mapping with fact_table and dimension_tables")
    return {"dimension_tables": [], **mapping}


def _mapped(mapping: Mapping) -> dict[str, Column]:
    """Constant staging columns given by a mapping."""
    mapping = check_mapping(mapping)
    dims = [
        F.struct(
            dim_alias(last_part(F.lit(d["table"]))).alias("alias"),
            F.lit(d["table"]).alias("table"),
            F.lit(d["join_key"]).alias("join_key"),
            F.lit(d["dim_key"]).alias("dim_key"),
            F.array(*[F.lit(c) for c in d.get("columns", ())]).cast("array<string>").alias("columns"),
        )
        for d in mapping["dimension_tables"]
    ]
    return {
        "fact_table_fqn": F.lit(mapping["fact_table"]),
        "fact_columns": F.array().cast("array<string>"),
        "dim_tables": F.array(*dims) if dims else F.lit(None),
        "col_map": F.lit(None),
    }


def read_measure_csv(spark: SparkSession, path: str | list[str], mapping: Mapping) -> DataFrame:
    """Staging rows of measure CSV files."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)

    def cell(*names: str, default: str = "") -> Column:
        present = [F.col(f"`{n}`") for n in names if n in raw.columns]
        return F.coalesce(*present, F.lit(default))

    rows = raw.select(
        F.col("_metadata.file_path").alias("model"),
        F.monotonically_increasing_id().alias("position"),
        cell("TableName", default="Unknown").alias("source_table"),
        cell("MeasureName", "Name").alias("measure_name"),
        cell("Expression").alias("measure_expr"),
        cell("Description").alias("description"),
    )
    return _staged(rows, source_format=F.lit("csv"), mode=F.lit("dax"), **_mapped(mapping))


# Keywords of the cube script language.
CREATE_MEMBER = r"(?i)CREATE\s+MEMBER\s+CURRENTCUBE\."
MEMBER_NAME = r"^\s*\[Measures\]\.\[([^\]]+)\]"
MEMBER_PROPERTY = r"(?i),\s*(?:FORMAT_STRING|VISIBLE|NON_EMPTY_BEHAVIOR|ASSOCIATED_MEASURE_GROUP)\s*="


def parse_mdx_scripts(texts: DataFrame, mapping: Mapping) -> DataFrame:
    """Staging rows of cube script texts (columns `path`, `value`), one per created member."""
    blocks = texts.select(F.col("path").alias("model"), F.posexplode(F.split("value", CREATE_MEMBER)).alias("position", "block"))
    named = blocks.where("position > 0").withColumn("measure_name", F.regexp_extract("block", MEMBER_NAME, 1))
    body = F.regexp_replace("block", MEMBER_NAME + r"\s*(?i:AS\s+)?", "")
    expr = F.get(F.split(body, MEMBER_PROPERTY, 2), F.lit(0))
    # A member without properties ends at its semicolon; comment lines after it belong to the next one.
    expr = F.regexp_replace(expr, r";\s*(?:(?:--|//)[^\n]*\s*)*$", "")
    rows = named.where("measure_name <> ''").withColumn("measure_expr", F.regexp_replace(expr, r"[,;\s]+$", ""))
    rows = rows.withColumn("position", F.col("position") - 1)
    return _staged(
        rows,
        source_format=F.lit("mdx_script"),
        source_table=F.lit("Cube"),
        description=F.lit(""),
        mode=F.lit("mdx"),
        **_mapped(mapping),
    )


def read_mdx_scripts(spark: SparkSession, path: str | list[str], mapping: Mapping) -> DataFrame:
    return parse_mdx_scripts(read_texts(spark, path), mapping)


def stage_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Staging rows of several exports in one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---------------------------------------------------------------- schema enrichment


def named_tables(staging: DataFrame) -> list[str]:
    """Fact and dimension tables that staging rows name: as many as the catalog has tables."""
    listed = F.concat(F.array("fact_table_fqn"), F.transform(F.coalesce("dim_tables", F.array().cast(T.ArrayType(DIM_TABLE))), lambda d: d["table"]))
    names = staging.select("fact_table_fqn", "dim_tables").distinct().select(F.explode(listed).alias("name")).distinct()
    return [r.name for r in names.where("name <> ''").orderBy("name").collect()]


def table_columns(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """Columns of the named tables, in order: `table`, `columns`, which is null for unknown tables."""
    rows = [(t, spark.table(t).columns if spark.catalog.tableExists(t) else None) for t in tables]
    return spark.createDataFrame(rows, "table string, columns array<string>")


def enrich_columns(staging: DataFrame, catalog_columns: DataFrame) -> DataFrame:
    """Fill in missing column lists of fact and dimension tables.

    `catalog_columns` has one row per table: `table`, `columns`. The dimension lists differ between
    models only, so they are completed once per distinct list and joined back.
    """
    empty = F.size(F.coalesce("fact_columns", F.array().cast("array<string>"))) == 0
    facts = catalog_columns.select(F.col("table").alias("fact_table_fqn"), F.col("columns").alias("__fact"))
    settled = settle(staging)
    df = salted_join(settled, facts, ["fact_table_fqn"], "left")
    df = df.withColumn("fact_columns", F.when(empty, F.coalesce("__fact", "fact_columns")).otherwise(F.col("fact_columns")))
    key = F.to_json("dim_tables")
    lists = settled.select(key.alias("__key"), "dim_tables").where("dim_tables IS NOT NULL").dropDuplicates(["__key"])
    tables = lists.select("__key", F.posexplode("dim_tables").alias("__pos", "d"))
    known = catalog_columns.select(F.col("table").alias("__table"), F.col("columns").alias("__columns"))
    tables = tables.join(known, F.col("d.table") == F.col("__table"), "left")
    missing = F.size(F.coalesce("d.columns", F.array().cast("array<string>"))) == 0
    full = F.col("d").withField(
        "columns", F.when(missing, F.coalesce("__columns", "d.columns")).otherwise(F.col("d.columns"))
    )
    filled = tables.groupBy("__key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__pos", full.alias("d")))), lambda x: x["d"]).alias("__dims")
    )
    df = salted_join(settle(df.withColumn("__key", key)), filled, ["__key"], "left")
    df = df.withColumn("dim_tables", F.coalesce("__dims", "dim_tables"))
    return df.select(*staging.columns)
