"""Materialised intermediates and skew: what keeps iterative and global operators safe at scale."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: the one the session names, else (single machine only) a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="metricloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, in a folder of the application.

    That folder may be deleted once the application has ended.
    """
    return f"{shared_dir(spark)}/metricloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Delete what this application has written to the shared folder; its results must have been read or saved."""
    root = f"{shared_dir(spark)}/metricloom/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from the files.

    Cuts lineage, survives the loss of executors, and makes values that depend on the physical
    layout (partition numbers) safe to use in several branches of a plan. The row count of the
    result is cheap to ask for.
    """
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all tasks by a hash of some columns, whatever number of files they were read from.

    For rows that are small in a file and take much time or memory later: tables are cut into tasks
    by bytes, and one task would get them all. The number of partitions is fixed, so that adaptive
    execution does not join them again by their bytes.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def settle_counting(df: DataFrame, *conditions: Column) -> tuple[DataFrame, list[int]]:
    """`settle`, and how many rows met each condition, counted while they were written."""
    seen = Observation()
    counts = [F.count_if(c).alias(f"n{i}") for i, c in enumerate(conditions)]
    out = settle(df.observe(seen, *counts))
    return out, [seen.get[f"n{i}"] or 0 for i in range(len(conditions))]


def running(
    df: DataFrame,
    group: list[str],
    order: str,
    parts: dict[str, tuple[str, str]],
    descending: bool = False,
) -> DataFrame:
    """Running aggregates over rows that are too many for one task.

    `df` has one row per (group, order) value; `parts` maps output names to (sum, min or max, input
    column) and may overwrite inputs. Rows are range-partitioned by (group, order), each range is
    aggregated, earlier ranges of a group give its offset, and the running value inside a range is
    local. A group of any size is spread over many tasks; what a window sees in one partition is a
    range, and at most one row per range when offsets are made.
    """
    functions = {"sum": F.sum, "min": F.min, "max": F.max}
    by = F.col(f"`{order}`").desc() if descending else F.col(f"`{order}`").asc()
    key = [F.col(f"`{g}`") for g in group]
    ranged = settle(df.repartitionByRange(*key, by).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*key, "__range").agg(*[functions[fn](c).alias(f"__t_{k}") for k, (fn, c) in parts.items()])
    before = W.partitionBy(*key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[c.alias(f"__g_{g}") for c, g in zip(key, group)],
        F.col("__range").alias("__r"),
        *[functions[fn](f"__t_{k}").over(before).alias(f"__o_{k}") for k, (fn, _) in parts.items()],
    )
    cond = F.col("__range") == F.col("__r")
    for g in group:
        cond = cond & F.col(f"`{g}`").eqNullSafe(F.col(f"`__g_{g}`"))
    local = W.partitionBy(*key, "__range").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    joined = ranged.join(offsets, cond, "left")

    def value(k: str, fn: str, c: str) -> Column:
        before_range, inside = F.col(f"__o_{k}"), functions[fn](c).over(local)
        if fn == "sum":
            return F.coalesce(before_range + inside, before_range, inside)
        return F.least(before_range, inside) if fn == "min" else F.greatest(before_range, inside)

    kept = [F.col(f"`{c}`") for c in df.columns if c not in parts]
    return joined.select(*kept, *[value(k, fn, c).alias(k) for k, (fn, c) in parts.items()])


def prefix_sums(df: DataFrame, group: list[str], order: str, sums: dict[str, str], descending: bool = False):
    """Inclusive running sums, see `running`."""
    return running(df, group, order, {k: ("sum", c) for k, c in sums.items()}, descending)


def neighbours(df: DataFrame, group: list[str], order: str, out: str, ahead: bool = True) -> DataFrame:
    """The next (or, not `ahead`, the previous) value of `order` within each row's group, as column `out`.

    Groups may hold more rows than one task can sort. Rows are range-partitioned by (group, order);
    a row's neighbour is in its range, or it is the outermost row of the nearest range. One such row
    per range is all that is exchanged.
    """
    key, by = [F.col(f"`{g}`") for g in group], F.col(f"`{order}`")
    ranged = settle(df.repartitionByRange(*key, by.asc()).withColumn("__range", F.spark_partition_id()))
    outer = F.struct(F.struct(*[c.alias(f"g{i}") for i, c in enumerate(key)], F.lit(0).alias("g")).alias("g"), by.alias("o"))
    edges = ranged.groupBy("__range").agg((F.min if ahead else F.max)(outer).alias("__e"))
    step = F.lead if ahead else F.lag
    beyond = edges.select("__range", step("__e").over(W.orderBy("__range")).alias("__edge"))
    local = W.partitionBy(*key, "__range").orderBy(by.asc())
    joined = ranged.withColumn(out, step(by).over(local)).join(F.broadcast(beyond), "__range", "left")
    meets = F.col("__edge").isNotNull()
    for i, c in enumerate(key):
        meets = meets & c.eqNullSafe(F.col(f"__edge.g.g{i}"))
    return joined.withColumn(out, F.coalesce(out, F.when(meets, F.col("__edge.o")))).drop("__range", "__edge")


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.001) -> DataFrame:
    """Keys that hold more than `share` of all rows, with the number of pieces to split them into.

    There can be at most 1/share of them, so the frame may be broadcast whatever the input size.
    """
    limit = max(int(df.count() * share), 1)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > limit).select(
        *keys, F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__pieces")
    )


# Up to this many rows one sorted window is used; beyond it running values are range-partitioned.
WINDOW_ROWS = 1_000_000


def within(df: DataFrame, rows: int) -> bool:
    """A settled frame has at most so many rows; the count comes from the file footers."""
    return df.count() <= rows


# Up to this many rows no single key can overload a task, and a plain join is used.
PLAIN_ROWS = 1_000_000


def many(df: DataFrame) -> bool:
    """A settled frame has more rows than a broadcast should.

    Spark goes by the bytes of the files, and rows that compress well take a hundred times as many in memory.
    """
    return not within(df, PLAIN_ROWS)


def keyed(df: DataFrame) -> DataFrame:
    """A settled frame as one side of a join, which sorts it instead of broadcasting if it has `many` rows."""
    return df.hint("merge") if many(df) else df


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    share: float = 0.001,
    plain_rows: int = PLAIN_ROWS,
    large: bool = False,
) -> DataFrame:
    """Equi-join whose hot left keys are split over several tasks.

    Left rows of a hot key get a piece number from a hash of the row, right rows of that key are
    copied once per piece; other keys stay as they are. `left` should be settled, it is read for
    the counts as well. `how` is inner or left. A `large` right side is not broadcast, see `many`.
    """
    if within(left, plain_rows):
        return left.join(right.hint("merge") if large else right, keys, how)
    hot = F.broadcast(hot_keys(left, keys, share))
    hashable = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    row_hash: Column = F.xxhash64(*[F.col(f"`{c}`") for c in hashable])
    pieces = F.coalesce(F.col("__pieces"), F.lit(1))
    salted = left.join(hot, keys, "left").withColumn("__salt", F.pmod(row_hash, pieces)).drop("__pieces")
    copies = (
        right.join(hot, keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces.cast("bigint") - 1)))
        .drop("__pieces")
    )
    return salted.join(copies.hint("merge") if large else copies, [*keys, "__salt"], how).drop("__salt")
