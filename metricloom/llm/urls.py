"""URL filters by temporal list join.

Dated entries (a key is put on a list, or taken off) become validity intervals; an as-of join finds, for the day of every
capture, the intervals of its keys that hold that day. Keys of a URL are its host, all parent domains of two labels at
least, and host/first path segment. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.settle import salted_join, settle

FOREVER = "9999-12-31"
ALLOW = "allow"


def host(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; null where there is none."""
    found = F.regexp_extract(F.trim(url), r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.+$", ""), F.lit(""))


def segment(url: Column) -> Column:
    """First path segment, empty where there is none."""
    return F.coalesce(F.regexp_extract(F.trim(url), r"^(?:[^/?#]*:)?//[^/?#]*/([^/?#]+)", 1), F.lit(""))


def keys(host: Column, segment: Column) -> Column:
    """Distinct keys of a URL with their rank: the more specific the higher (labels of a domain, 1000 for a path)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array(F.lit(1)))
    domains = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("rank")))
    path = F.array(F.struct(F.concat(host, F.lit("/"), segment).alias("key"), F.lit(1000).alias("rank")))
    return F.when(segment != "", F.concat(domains, path)).otherwise(domains)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals `list`, `key`, `since`, `until` (exclusive) of entries (`list`, `key`, `action`, `day`).

    Of several entries of one list and key on a day an addition wins. Consecutive additions and removals count once, a
    removal without an addition has no effect. Entries with a null, or with another action than add or remove, are ignored.
    """
    known = entries.select(
        F.col("list").cast("string"), F.lower("key").alias("key"), (F.col("action") == "add").alias("added"), F.col("day").cast("date")
    ).where(F.col("action").isin("add", "remove") & F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("day").isNotNull())
    daily = known.groupBy("list", "key", "day").agg(F.max("added").alias("added"))
    order = W.partitionBy("list", "key").orderBy("day")
    before = F.coalesce(F.lag("added").over(order), F.lit(False))
    turns = daily.withColumn("before", before).where(F.col("added") != F.col("before"))
    until = F.coalesce(F.lead("day").over(order), F.lit(FOREVER).cast("date"))
    return turns.withColumn("until", until).where("added").select("list", "key", F.col("day").alias("since"), "until")


def judged(captures: DataFrame, url: str, day: str, entries: DataFrame) -> DataFrame:
    """`row` (struct of all columns of `captures`), `host`, `blocked`, `lists` (of the intervals in force, sorted).

    A capture is blocked if on its day a list other than `allow` holds one of its keys, and `allow` holds none that is at
    least as specific as the most specific of those. URLs without a host, null URLs and null days are on no list and not
    blocked. Repeated rows are judged alike; an empty table gives no rows, and without entries nothing is blocked.

    Captures are first reduced to their distinct (host, segment, day), so that a host with any share of the rows meets the
    lists once per day and segment; the verdicts go back with hot keys split.
    """
    u, d = F.col(f"`{url}`").cast("string"), F.col(f"`{day}`").cast("date")
    base = settle(captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"), host(u).alias("host"), segment(u).alias("segment"), d.alias("day")))
    places = base.where("host IS NOT NULL AND day IS NOT NULL").select("host", "segment", "day").distinct()
    asked = places.withColumn("asked", F.explode(keys(F.col("host"), F.col("segment")))).select("host", "segment", "day", "asked.key", "asked.rank")
    listed = salted_join(settle(asked), intervals(entries), ["key"], plain_rows=0).where("day >= since AND day < until")
    best = lambda on: F.max(F.when(on, F.col("rank")))
    verdict = listed.groupBy("host", "segment", "day").agg(
        best(F.col("list") != ALLOW).alias("denied"), best(F.col("list") == ALLOW).alias("allowed"), F.sort_array(F.collect_set("list")).alias("lists")
    )
    joined = salted_join(base, verdict, ["host", "segment", "day"], how="left", plain_rows=0)
    blocked = F.col("denied").isNotNull() & (F.coalesce("allowed", F.lit(-1)) < F.col("denied"))
    return joined.select("row", "host", blocked.alias("blocked"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"))
