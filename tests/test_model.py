"""Declarations: references, windows, versions, checks and aggregate calls in text."""

import pytest

from metricloom import Dimension, Join, Measure, MetricView, Window
from metricloom.functions import aggs as A
from metricloom.functions import text as TX
from metricloom.plans.star import needed_joins


def view(*measures, dims=()):
    return MetricView("v", "t", (), tuple(dims), measures)


def test_lift_finds_calls_and_filters():
    parts = A.lift("SUM(a * (b + 1)) FILTER (WHERE s = 'x) (' AND t IN (1, 2)) / NULLIF(count(DISTINCT c), 0)")
    calls = [p for p in parts if isinstance(p, A.Agg)]
    assert calls[0] == A.Agg("SUM", "a * (b + 1)", False, ("s = 'x) (' AND t IN (1, 2)",))
    assert calls[1] == A.Agg("COUNT", "c", True)
    assert A.aggregates("'SUM(x)'") == []
    with pytest.raises(ValueError):
        A.lift("SUM((a)")


def test_filters_are_added_to_every_call():
    got = A.filtered("SUM(a) FILTER (WHERE x = 1) / COUNT(1)", "y = 2", "z = 3")
    assert got == "SUM(a) FILTER (WHERE x = 1 AND (y = 2) AND (z = 3)) / COUNT(1) FILTER (WHERE (y = 2) AND (z = 3))"


def test_inline_nested_and_filtered_references():
    mv = view(
        Measure("A", "SUM(a)"),
        Measure("B", "[A] - [Measures].[C D]"),
        Measure("C D", A.filtered("[A]", "s = 'x'")),
        Measure("E", A.filtered("[B]", "t = 1")),
    )
    assert mv.measure("B").expr == "(SUM(a)) - ((SUM(a) FILTER (WHERE (s = 'x'))))"
    assert mv.measure("E").expr == "((SUM(a) FILTER (WHERE (t = 1))) - ((SUM(a) FILTER (WHERE (s = 'x') AND (t = 1)))))"


def test_circular_and_unknown_references():
    mv = view(Measure("A", "[B] + 1"), Measure("B", "[A] - 1"), Measure("C", "[nope]"))
    with pytest.raises(ValueError, match="circular"):
        mv.measure("A")
    with pytest.raises(KeyError):
        mv.measure("C")


def test_column_of_a_table_is_no_reference():
    mv = view(Measure("A", "SUM(a)"), Measure("X", "SUM(arr[A])"))
    assert mv.measure("X").expr == "SUM(arr[A])"


def test_version():
    assert view(Measure("a", "SUM(a)")).version == "1.1"
    assert view(Measure("a", "SUM(a)"), Measure("w", "SUM(a)", window=(Window("d", "all"),))).version == "0.1"


def test_validate():
    clean, warnings, status = view(Measure("a", "SUM(a)"), Measure("o", "SUM(a) over (ORDER BY b)")).validate()
    assert [m.name for m in clean.measures] == ["a"] and status == "partial"
    assert warnings[0].warning_type == "unsupported_dax"
    assert view(Measure("a", "SUM(rollOVER)")).validate()[2] == "success"
    with pytest.raises(ValueError):
        view(Measure("a", "b + 1")).validate()
    with pytest.raises(ValueError):
        view(Measure("a", "SUM(a)"), dims=[Dimension("d", "MAX(x)")]).validate()


def test_order_names():
    mv = view(dims=[Dimension("Order Date", "calendar.date"), Dimension("Date", "d2"), Dimension("Year", "calendar.year")])
    assert mv.order_name("Year") == "Year"
    assert mv.order_name("calendar.date") == "Order Date"
    assert mv.order_name("order date_dim") == "Order Date"
    assert mv.order_name("year_dim") == "Year"


def test_window_ranges():
    assert Window("d", "trailing_3_months").span == ("trailing", 3, "month")
    assert Window("d", " cumulative ").normal_range == "cumulative"
    with pytest.raises(ValueError):
        Window("d", "sideways 3 day").normal_range


def test_join_order_and_need():
    mv = MetricView(
        "v", "t",
        (Join("c", "c", "b.x = c.x"), Join("b", "b", "a.x = b.x"), Join("a", "a", "source.x = a.x"), Join("z", "z", "source.z = z.z")),
    )
    assert [j.name for j in needed_joins(mv, ["c.name"])] == ["a", "b", "c"]
    assert needed_joins(mv, ["'a.b'", "x"]) == []
    loop = MetricView("v", "t", (Join("a", "a", "b.x = a.x"), Join("b", "b", "a.x = b.x")))
    with pytest.raises(ValueError):
        needed_joins(loop, ["a.x"])


def test_join_name_must_differ_from_source_columns(spark):
    fact = spark.createDataFrame([(1, 2)], "region int, v int")
    dim = spark.createDataFrame([(1, "x")], "id int, name string")
    mv = MetricView("v", fact, (Join("region", dim, "source.region = region.id"),), (Dimension("n", "region.name"),), (Measure("s", "SUM(v)"),))
    with pytest.raises(ValueError, match="join names"):
        mv.query(spark, ["s"], ["n"])


def test_dimension_may_hide_a_source_column(spark):
    """Conditions speak of dimensions, measures of source columns, also when names are equal."""
    fact = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "s string, v int")
    mv = MetricView("v", fact, (), (Dimension("s", "CASE WHEN s = 'a' THEN 'x' ELSE 'y' END"),), (Measure("m", "SUM(v) FILTER (WHERE s <> 'b')"),))
    assert [tuple(r) for r in mv.query(spark, ["m"], ["s"], where="s = 'y'").collect()] == [("y", 4)]


def test_text_columns(spark):
    from pyspark.sql import functions as F

    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(TX.snake_case(F.lit("UnitPriceID"))) == "unit_price_id"
    assert one(TX.snake_case(F.lit("Order Date2Key"))) == "order_date2_key"
    assert one(TX.safe_view_name(F.lit("a.b.my-fact"))) == "mv_my_fact"
    assert one(TX.view_name(F.lit("Adventure Works"), "cube")) == "mv_adventure_works"
    assert one(TX.normalize_range(F.lit("trailing_3_months"))) == "trailing 3 month"
    assert one(TX.split_name(F.lit("a.b.c"), "x", "y")) == ("a", "b")
    assert one(TX.split_name(F.lit("c"), "x", "y")) == ("x", "y")
    assert one(TX.split_pair(F.lit("n: a:b"))) == ("n", "a:b")
    assert one(TX.split_pair(F.lit("n"))) == ("n", "n")
    assert one(TX.format_measure(F.lit(0.1234), "Percent")) == "12.34%"
    assert one(TX.format_measure(F.lit(1234.5), "$#,##0.00")) == "$1,234.50"
    assert one(TX.member_label(F.lit("East"), F.lit(1234.4), "$#,#")) == "East - $1,234"


@pytest.mark.parametrize(
    "text,ok",
    [('{"expr": "SUM(a)"}', True), ('  \n {"expr": "SUM(a)"} \n', True), ('```json\n{"expr": "SUM(a)"}\n```', True),
     ('```\n{"expr": "SUM(a)"}\n```', True), ('{"expr": "SUM(a)"', False), ("Error: x", False), ("", False),
     ("QUERY_EXECUTION_ERROR {}", False), ("{not json}", False)],
)
def test_answers(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(TX.parse_answer_json(df.t).alias("a")).first()["a"]
    assert (got is not None and got["expr"] == "SUM(a)") == ok


def test_approximate_distinct(spark):
    df = spark.range(1000).selectExpr("id % 10 AS k", "id % 2 AS g")
    mv = MetricView("v", df, (), (Dimension("g", "g"),), (Measure("a", A.approx_distinct("k")), Measure("n", "COUNT(1)")))
    assert sorted(tuple(r) for r in mv.query(spark, ["a", "n"], ["g"]).collect()) == [(0, 5, 500), (1, 5, 500)]


@pytest.mark.parametrize(
    "text, guarded",
    [
        ("a / b", "a / NULLIF(b, 0)"),
        ("a / (b - c) * 2", "a / NULLIF((b - c), 0) * 2"),
        ("a / NULLIF(b, 0) / 100", "a / NULLIF(b, 0) / 100"),
        ("a / -b + 'x/y' / `c/d`", "a / NULLIF(-b, 0) + 'x/y' / NULLIF(`c/d`, 0)"),
        ("(a / (b / c)) / 0", "(a / NULLIF((b / NULLIF(c, 0)), 0)) / NULLIF(0, 0)"),
        ("a / COALESCE(b / c, 0)", "a / NULLIF(COALESCE(b / NULLIF(c, 0), 0), 0)"),
    ],
)
def test_division_is_guarded(text, guarded):
    from metricloom.functions.aggs import guard_division

    assert guard_division(text) == guarded
