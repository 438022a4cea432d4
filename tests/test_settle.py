"""Plans for skewed and very large inputs give the same rows as the plain ones."""

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import Window as W, functions as F

from metricloom.operators import ranking
from metricloom.plans import settle as S


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    return S.settle(
        spark.range(9000).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), (F.col("id") * 7919 % 1000).alias("v"), "id"
        )
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, skewed, how):
    right = spark.range(250).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = skewed.join(right, "k", how).select("k", "id", "w")
    salted = S.salted_join(skewed, right, ["k"], how, share=0.01, plain_rows=0).select("k", "id", "w")
    assert rows(plain) == rows(salted)


def test_hot_keys_are_bounded(skewed):
    hot = S.hot_keys(skewed, ["k"], share=0.01).collect()
    assert [(r.k, r["__pieces"]) for r in hot] == [(0, 34)]


@pytest.mark.parametrize("group", [[], ["k"]])
@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums(skewed, group, descending):
    df = skewed.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    got = S.prefix_sums(df, group, "v", {"upto": "n"}, descending)
    order = F.col("v").desc() if descending else F.col("v")
    want = df.withColumn("upto", F.sum("n").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("ties", ["skip", "dense"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_with_nulls(skewed, ties, descending):
    df = S.settle(skewed.select("id", (F.col("k") % 4).alias("g"), F.when(F.col("v") > 20, F.col("v")).alias("v")))
    small = ranking.rank_rows(df, "v", ["g"], ties, descending)
    large = ranking.rank_rows(df, "v", ["g"], ties, descending, window_rows=0)
    assert rows(small.select("id", "g", "v", "rank")) == rows(large.select("id", "g", "v", "rank"))


def test_shared_dir_is_the_sessions(spark):
    assert S.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_top_n_is_limited_before_the_shuffle(spark, star):
    plan = ranking.topn_sum(star, spark, "Total Sales", "Customer Name", 5, ["Region"])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("group", [[], ["k"]])
def test_running_extremes_and_missing_values(skewed, group):
    v = F.when(F.col("id") % 4 != 0, F.col("id") * 7919 % 1000)
    df = skewed.select(*group, "id", v.alias("v"))
    parts = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    got = S.running(df, group, "id", parts).select(*group, "id", *parts)
    w = W.partitionBy(*group).orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    want = df.select(*group, "id", *[getattr(F, fn)("v").over(w).alias(k) for k, (fn, _) in parts.items()])
    assert rows(got) == rows(want)


def test_running_total_beyond_one_window(spark, skewed, monkeypatch):
    from metricloom import Dimension, Measure, MetricView, Window
    from metricloom.functions import aggs as A

    df = skewed.select("k", F.timestamp_seconds(F.col("id") * 61).alias("ts"), "v")
    w = (Window("ts", "cumulative"),)
    exprs = [A.sum_("v"), A.avg_("v"), A.min_("v"), A.max_("v"), A.distinct_count("v % 50")]
    ms = [Measure(f"m{i}", e, window=w) for i, e in enumerate(exprs)]
    mv = MetricView("m", df, (), (Dimension("k", "k"), Dimension("ts", "ts")), tuple(ms))
    plain = rows(mv.query(spark, ms, ["k", "ts"]))
    data = skewed.where("k = 0").orderBy("id").select("v").toPandas().v
    seen = [r[6] for r in plain if r[0] == 0]
    assert sorted(seen) == [len(set((data[: i + 1] % 50).tolist())) for i in range(len(data))]
    zero = sorted((r for r in plain if r[0] == 0), key=lambda r: r[1])
    assert [r[2] for r in zero] == data.cumsum().tolist() and [r[5] for r in zero] == data.cummax().tolist()


SPANS = [("trailing 2 month", False), ("trailing 1 month", True), ("leading 1 month", False), ("leading 2 month", True)]
SPANS += [("trailing 3 day", False), ("trailing 2 day", True), ("leading 5 hour", False), ("leading 1 week", True)]


@pytest.mark.parametrize("span,anchor", SPANS)
def test_months_and_distinct_counts_over_timestamps(spark, span, anchor):
    import pandas as pd

    from metricloom import Dimension, Measure, MetricView, Window

    data = [(1_700_000_000 + (i * i * 40_009) % (200 * 86_400) // 10_800 * 10_800, i * 7 % 5, i % 2) for i in range(140)]
    df = spark.createDataFrame(data, "t long, v int, g int").select(F.timestamp_seconds("t").alias("ts"), "v", "g")
    side, n, unit = span.split()
    exprs = ["SUM(v)", "COUNT(1)", "AVG(v)"] if unit == "month" else ["COUNT(DISTINCT v)", "SUM(v)"]
    ms = [Measure(f"m{i}", e, window=(Window("ts", span, include_anchor=anchor),)) for i, e in enumerate(exprs)]
    mv = MetricView("m", df, (), (Dimension("ts", "ts"), Dimension("g", "g")), tuple(ms))
    step = pd.DateOffset(**{unit + "s": int(n)})
    times = [(pd.Timestamp(t, unit="s"), v, g) for t, v, g in data]
    inside = {
        ("trailing", False): lambda x, a: a - step <= x < a,
        ("trailing", True): lambda x, a: a - step < x <= a,
        ("leading", False): lambda x, a: a < x <= a + step,
        ("leading", True): lambda x, a: a <= x < a + step,
    }[side, anchor]
    got = {(pd.Timestamp(r[0], unit="s"), r[1]): tuple(r)[2:] for r in mv.query(spark, ms, ["ts", "g"]).withColumn("ts", F.unix_seconds("ts")).collect()}
    assert len(got) == len({(t, g) for t, _, g in times})
    for (a, g), values in got.items():
        seen = [v for x, v, h in times if h == g and inside(x, a)]
        if unit == "month":
            assert values == ((sum(seen), len(seen), sum(seen) / len(seen)) if seen else (None, 0, None)), a
        else:
            assert values == (len(set(seen)), sum(seen) if seen else None), a


@pytest.mark.parametrize("group", [[], ["k"], ["k", "g"]])
@pytest.mark.parametrize("ahead", [True, False])
def test_neighbours_across_ranges(spark, skewed, group, ahead):
    """One key, or one group, has a third of the rows or all; keys may be null."""
    df = skewed.select(F.when(F.col("k") != 7, F.col("k")).alias("k"), (F.col("id") % 2).alias("g"), F.col("id").alias("at"))
    step = F.lead if ahead else F.lag
    want = df.withColumn("near", step("at").over(W.partitionBy(*group).orderBy("at")))
    got = S.neighbours(df, group, "at", "near", ahead)
    assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("side", ["trailing", "leading"])
@pytest.mark.parametrize("n,unit", [(1, "month"), (2, "month"), (1, "quarter"), (1, "year")])
@pytest.mark.parametrize("anchor", [False, True])
def test_distinct_counts_over_months_of_timestamps(spark, side, n, unit, anchor):
    """Month ends and a leap day at all times of day, equal times a month apart, one value with a third of the rows."""
    from metricloom import Dimension, Measure, MetricView, Window

    days = [d for d in pd.date_range("2023-11-26", "2025-03-31") if d.day > 26 or d.day < 2]
    moments = [d + pd.Timedelta(hours=h) for i, d in enumerate(days) for h in {0, (5 * i) % 24, 12}]
    values = [0 if i % 3 == 0 else 1 + (i * 37) % 23 for i in range(len(moments))]
    data = [(str(t), v, i % 2) for i, (t, v) in enumerate(zip(moments, values))]
    df = spark.createDataFrame(data, "t string, v int, g int").selectExpr("CAST(t AS TIMESTAMP) AS t", "v", "g")
    w = (Window("t", f"{side} {n} {unit}", include_anchor=anchor),)
    ms = [Measure("d", "COUNT(DISTINCT v)", window=w), Measure("s", "SUM(v)", window=w)]
    mv = MetricView("m", df, (), (Dimension("t", "t"), Dimension("g", "g")), tuple(ms))
    months = {"month": 1, "quarter": 3, "year": 12}[unit] * n
    want = []
    for i, a in enumerate(moments):
        far = a + pd.DateOffset(months=months if side == "leading" else -months)
        inside = {
            ("trailing", False): lambda x: far <= x < a, ("trailing", True): lambda x: far < x <= a,
            ("leading", False): lambda x: a < x <= far, ("leading", True): lambda x: a <= x < far,
        }[side, anchor]
        seen = [v for k, (x, v) in enumerate(zip(moments, values)) if k % 2 == i % 2 and inside(x)]
        want.append((i % 2, a.to_pydatetime(), len(set(seen)), sum(seen) if seen else None))
    assert sorted(tuple(r) for r in mv.query(spark, ms, ["g", "t"]).collect()) == sorted(want)


FRAMES = ["cumulative", "all", "trailing 1 month", "leading 2 month", "trailing 10 day", "leading 3 week", "trailing 50 hour"]


SECOND = [("cumulative", "date"), ("trailing 1 month", "timestamp"), ("leading 9 day", "date"), ("all", "date"), ("leading 1 month", "date")]
PAIRS = [(f, *SECOND[i % 5]) for i, f in enumerate(FRAMES)] + [("trailing 1 month", "cumulative", "date"), ("cumulative", "trailing 70 hour", "timestamp")]


@pytest.mark.parametrize("first,second,kind", PAIRS)
def test_two_framed_entries(spark, first, second, kind):
    """Rows count that lie in the frames of both dates, for every pair of dates that has facts; against brute force."""
    from metricloom import Dimension, Measure, MetricView, Window

    start = pd.Timestamp("2024-01-28")
    data = [(i % 2, start + pd.Timedelta(days=i * i * 7 % 41), start + pd.Timedelta(days=i * 13 % 60), i * 37 % 101) for i in range(60)]
    df = spark.createDataFrame([(g, str(a), str(b), v) for g, a, b, v in data], "g int, a string, b string, v int")
    df = df.selectExpr("g", "CAST(CAST(a AS TIMESTAMP) AS DATE) AS a", f"CAST(CAST(b AS TIMESTAMP) AS {kind}) AS b", "v")
    anchored = len(first) % 2 == 0
    w = (Window("a", first, include_anchor=anchored), Window("b", second, include_anchor=not anchored))
    exprs = {"s": "SUM(v)", "n": "COUNT(1)", "lo": "MIN(v)", "hi": "MAX(v)"}
    ms = [Measure(k, e, window=w) for k, e in exprs.items()]
    mv = MetricView("m", df, (), (Dimension("a", "a"), Dimension("b", "b"), Dimension("g", "g")), tuple(ms))

    def inside(x, at, text, anchor):
        if text in ("all", "cumulative"):
            return text == "all" or x <= at
        side, n, unit = text.split()
        step = pd.DateOffset(**{f"{unit}s": int(n)})
        if side == "trailing":
            return at - step < x <= at if anchor else at - step <= x < at
        return at <= x < at + step if anchor else at < x <= at + step

    want = {}
    for g, a, b, _ in data:
        seen = [v for h, x, y, v in data if h == g and inside(x, a, first, anchored) and inside(y, b, second, not anchored)]
        want[g, str(a)[:10], str(b)[:10]] = (sum(seen), len(seen), min(seen), max(seen)) if seen else (None, 0, None, None)
    got = mv.query(spark, ms, ["g", "a", "b"]).collect()
    assert {(r.g, str(r.a)[:10], str(r.b)[:10]): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_two_framed_entries_without_their_dates(spark):
    """The last pair of dates stands for a group; conditions on a date come after the frames; dates may be missing."""
    from metricloom import Dimension, Measure, MetricView, Window

    data = [(i % 2, i * 5 % 17, None if i % 9 == 4 else i * 11 % 23, i) for i in range(80)]
    df = spark.createDataFrame(data, "g int, a int, b int, v int")
    df = df.selectExpr("g", "date_add(DATE'2024-02-20', a) AS a", "date_add(DATE'2024-02-20', b) AS b", "v")
    w = (Window("a", "trailing 7 day", include_anchor=True), Window("b", "cumulative"))
    mv = MetricView("m", df, (), (Dimension("a", "a"), Dimension("b", "b"), Dimension("g", "g")), (Measure("s", "SUM(v)", window=w),))
    got = {r.g: r.s for r in mv.query(spark, ["s"], ["g"], where="a <= DATE'2024-03-01'").collect()}
    for g in (0, 1):
        mine = [(a, b, v) for h, a, b, v in data if h == g]
        a0 = max(a for a, _, _ in mine if a <= 10)
        b0 = max((b for a, b, _ in mine if a == a0 and b is not None))
        assert got[g] == sum(v for a, b, v in mine if a0 - 7 < a <= a0 and (b is None or b <= b0))
    with pytest.raises(ValueError, match="distinct"):
        mv.query(spark, [Measure("x", "COUNT(DISTINCT v)", window=w)], ["g"])


def test_distinct_counts_over_hours_of_dates(spark):
    from metricloom import Dimension, Measure, MetricView, Window

    df = spark.range(60).selectExpr("date_add(DATE'2024-02-20', CAST(id * 7 % 20 AS INT)) AS day", "id % 7 AS v")
    data = [(r.day, r.v) for r in df.collect()]
    w = (Window("day", "trailing 36 hour", include_anchor=True),)
    mv = MetricView("m", df, (), (Dimension("day", "day"),), ())
    got = {r.day: r.n for r in mv.query(spark, [Measure("n", "COUNT(DISTINCT v)", window=w)], ["day"]).collect()}
    assert got == {a: len({v for x, v in data if 0 <= (a - x).days <= 1}) for a, _ in data}


def test_join_on_hot_and_missing_keys(spark, monkeypatch):
    from metricloom.plans import cells as C

    left = S.settle(spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"), (F.col("id") % 2).alias("g"), "id"))
    right = left.groupBy("k", "g").agg(F.count(F.lit(1)).alias("n"))
    plain = rows(C.join_on(left, right, ["k", "g"]).select("k", "g", "id", "n"))
    assert len(plain) == 3000 and all(r[3] is not None for r in plain)
    assert rows(C.join_hot(left, right, ["k", "g"]).select("k", "g", "id", "n")) == plain
    monkeypatch.setattr(C, "salted_join", lambda *a: S.salted_join(*a, share=0.01, plain_rows=0))
    assert rows(C.join_hot(left, right, ["k", "g"]).select("k", "g", "id", "n")) == plain


@pytest.mark.parametrize("span,anchor", [("trailing 2 hour", False), ("trailing 1 hour", True), ("leading 3 hour", False), ("leading 2 hour", True), ("trailing 1 day", True)])
def test_hours_over_timestamps(spark, span, anchor):
    """Timestamps on block borders, before 1970 and with gaps, against brute force."""
    from metricloom import Dimension, Measure, MetricView, Window

    step = 1800
    ticks = sorted({(i * i * 7919) % 200 * step - 60 * step for i in range(90)})
    data = [(t, (t // step) % 17, (t // step) % 2) for t in ticks]
    df = spark.createDataFrame(data, "t long, v int, g int").select(F.timestamp_seconds("t").alias("ts"), "v", "g", "t")
    w = (Window("ts", span, include_anchor=anchor),)
    ms = [Measure(f"m{i}", e, window=w) for i, e in enumerate(["SUM(v)", "MIN(v)", "MAX(v)", "COUNT(1)", "AVG(v)"])]
    mv = MetricView("m", df, (), (Dimension("ts", "ts"), Dimension("g", "g")), tuple(ms))
    side, n, unit = span.split()
    width = int(n) * (86400 if unit == "day" else 3600)
    inside = {
        ("trailing", False): lambda x, a: a - width <= x < a,
        ("trailing", True): lambda x, a: a - width < x <= a,
        ("leading", False): lambda x, a: a < x <= a + width,
        ("leading", True): lambda x, a: a <= x < a + width,
    }[side, anchor]
    got = mv.query(spark, ms, ["ts", "g"]).select(F.unix_seconds("ts"), "g", *[m.name for m in ms]).collect()
    want = []
    for t, _, g in data:
        seen = [v for x, v, h in data if h == g and inside(x, t)]
        if seen:
            want.append((t, g, sum(seen), min(seen), max(seen), len(seen), sum(seen) / len(seen)))
        else:
            want.append((t, g, None, None, None, 0, None))
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("side", ["trailing", "leading"])
@pytest.mark.parametrize("n,unit", [(1, "month"), (2, "month"), (1, "year")])
@pytest.mark.parametrize("anchor", [False, True])
def test_month_extremes_over_timestamps(spark, side, n, unit, anchor):
    """Times on both sides of the anchors' time of day around month ends and the leap day, against brute force."""
    from metricloom import Dimension, Measure, MetricView, Window

    moments = [d + pd.Timedelta(hours=(7 * i) % 24) for i, d in enumerate(pd.date_range("2023-12-20", "2025-03-31")) if i % 6 != 3]
    values = [(i * 37) % 101 for i in range(len(moments))]
    rows_ = [(str(t), v, i % 2) for i, (t, v) in enumerate(zip(moments, values))]
    df = spark.createDataFrame(rows_, "t string, v int, g int").selectExpr("CAST(t AS TIMESTAMP) AS t", "v", "g")
    w = (Window("t", f"{side} {n} {unit}", include_anchor=anchor),)
    ms = [Measure("lo", "MIN(v)", window=w), Measure("hi", "MAX(v)", window=w), Measure("s", "SUM(v)", window=w)]
    mv = MetricView("m", df, (), (Dimension("t", "t"), Dimension("g", "g")), tuple(ms))
    step = pd.DateOffset(**{f"{unit}s": n if side == "leading" else -n})
    want = []
    for i, a in enumerate(moments):
        far = a + step
        inside = {
            ("trailing", False): lambda x: far <= x < a, ("trailing", True): lambda x: far < x <= a,
            ("leading", False): lambda x: a < x <= far, ("leading", True): lambda x: a <= x < far,
        }[side, anchor]
        seen = [v for k, (x, v) in enumerate(zip(moments, values)) if k % 2 == i % 2 and inside(x)]
        want.append((i % 2, a.to_pydatetime(), *((min(seen), max(seen), sum(seen)) if seen else (None,) * 3)))
    assert sorted(tuple(r) for r in mv.query(spark, ms, ["g", "t"]).collect()) == sorted(want)


def test_clear_deletes_the_files_of_the_application(spark):
    import os

    frame = S.settle(spark.range(10))
    files = frame.inputFiles()
    assert files and all(os.path.exists(f.removeprefix("file://")) for f in files)
    assert S.clear(spark)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert S.settle(spark.range(3)).count() == 3
