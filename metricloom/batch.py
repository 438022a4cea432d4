"""A whole migration batch: staged definitions to rendered, published and audited views."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricloom.operators import assembly, references, rules
from metricloom.plans.settle import settle
from metricloom.sources import audit, exports


def run_batch(
    staging: DataFrame,
    batch_id: str,
    catalog: str = "main",
    schema: str = "sales",
    translate: Callable[[DataFrame], DataFrame] = rules.translate_rules,
    staging_table: str | None = None,
    audit_table: str | None = None,
    entries_table: str | None = None,
    registry_table: str | None = None,
    user: str = "",
) -> dict[str, DataFrame]:
    """Resolve, translate, assemble, render and record one batch.

    `translate` turns pending rows into answer columns; `assembly.parse_answers` takes stored answers
    in place of the rules. Tables that are named are written: the batch to the staging table, one
    audit row per view, all that these rows stand for to the table of entries, and the view texts to
    the registry. Each stage is written once and read by the next; nothing is collected.
    """
    staged = settle(assembly.with_batch(references.resolve_composites(staging), batch_id))
    if staging_table:
        audit.write_staging(staged, staging_table)
    translated = settle(translate(audit.pending(staged, batch_id)))
    views = settle(assembly.render_views(translated, catalog, schema))
    if audit_table:
        audit.audit_append(audit.audit_of_batch(translated, batch_id, views=views, user=user, catalog=catalog, schema=schema), audit_table)
    if entries_table:
        audit.entries_append(audit.entries_of_batch(translated, batch_id, views, catalog, schema), entries_table)
    if registry_table:
        audit.publish(texts(translated, views, catalog, schema), registry_table)
    return {"staged": staged, "translated": translated, "texts": views, **assembly.batch_report(translated)}


def texts(translated: DataFrame, views: DataFrame, catalog: str, schema: str) -> DataFrame:
    """Registry rows of rendered views, one per part."""
    versions = assembly.assemble_views(translated, catalog, schema).select("view_name", "version")
    return views.join(versions, "view_name").select("view_name", "version", "part", F.col("yaml").alias("definition"))


def run_files(
    spark: SparkSession,
    files: Sequence[str],
    batch_id: str,
    mapping: Mapping | None = None,
    **batch,
) -> dict[str, DataFrame]:
    """A batch from export files: read by extension, staged together, enriched from the catalog, run.

    `mapping` is what CSV files and scripts need to know of their tables. Files of an unknown format
    are returned as `rejected`, with the reason; `batch` is passed on to `run_batch`.
    """
    named = spark.createDataFrame([(f,) for f in files], "path string")
    known, rejected = exports.split_known(named)
    paths: dict[str, list[str]] = {}
    for r in known.orderBy("path").collect():  # the file names given
        paths.setdefault(r.source_format, []).append(r.path)
    readers = {
        "bim": lambda some: exports.read_bim(spark, some),
        "csv": lambda some: exports.read_measure_csv(spark, some, exports.check_mapping(mapping)),
        "mdx_script": lambda some: exports.read_mdx_scripts(spark, some, exports.check_mapping(mapping)),
    }
    frames = [readers[kind](some) for kind, some in sorted(paths.items())]
    if not frames:
        raise ValueError("no file of a known format")
    staging = settle(exports.stage_all(frames))
    staging = exports.enrich_columns(staging, exports.table_columns(spark, exports.named_tables(staging)))
    return {"rejected": rejected, **run_batch(staging, batch_id, **batch)}
