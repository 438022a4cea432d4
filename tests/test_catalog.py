"""Exports, references, rules, assembly and validation on small texts."""

import pytest
import yaml
from conftest import rows
from pyspark.sql import functions as F

from metricloom.operators import assembly, references, rules, validate
from metricloom.sources import exports as E

DIMS = [
    {"table": "main.s.dim_customer", "join_key": "customer_id", "dim_key": "customer_id"},
    {"table": "main.s.dim_date", "join_key": "date_key", "dim_key": "date"},
]
MAPPING = {"fact_table": "main.s.fact_sales", "dimension_tables": DIMS}


def staging(spark, texts, mode="dax", model="m", columns=()):
    data = [(model, i, n, e) for i, (n, e) in enumerate(texts)]
    df = spark.createDataFrame(data, "model string, position long, measure_name string, measure_expr string")
    given = E._mapped(MAPPING) | {"fact_columns": F.array(*map(F.lit, columns)).cast("array<string>")}
    return E._staged(df, source_format=F.lit("csv"), source_table=F.lit("Sales"), description=F.lit(""), mode=F.lit(mode), **given)


def names(df):
    return sorted(r.measure_name for r in df.collect())


# ---------------------------------------------------------------- references


def test_cycles_and_paths(spark):
    """Two cycles, a path between them, a loop, dependants before and after."""
    edges = {"a": "b", "b": "a", "p": "q", "x": "y", "y": "z", "z": "x", "s": "s", "d": "s", "e": "a", "t": "u"}
    texts = [(k, f"[{v}] + 1") for k, v in edges.items()]
    texts = [(k, e + " + [p]" if k == "b" else e) for k, e in texts]
    texts += [("q", "[x] * 2"), ("u", "SUM(Sales[A])")]
    st = staging(spark, texts)
    e = references.measure_edges(st)
    assert names(references.cycles(e)) == ["a", "b", "s", "x", "y", "z"]
    lv = {r.measure_name: r.level for r in references.levels(st).collect()}
    assert lv == {"u": 0, "t": 1}
    done = references.resolve_composites(st).select("measure_name", "final_status", "error_message", "resolved_expr").collect()
    errors = {r.measure_name: r.error_message.split(":")[0] for r in done if r.final_status == "error"}
    assert set(errors) == {"a", "b", "s", "x", "y", "z", "d", "e", "p", "q"}
    assert {n for n, m in errors.items() if m.startswith("Circular")} == {"a", "b", "s", "x", "y", "z"}
    assert {r.measure_name: r.resolved_expr for r in done}["t"] == "(SUM(Sales[A])) + 1"


def test_long_cycle_and_dense_component(spark):
    ring = [(f"r{i}", f"[r{(i + 1) % 200}]") for i in range(200)]
    clique = [(f"c{i}", " + ".join(f"[c{j}]" for j in range(4) if j != i)) for i in range(4)]
    e = references.measure_edges(staging(spark, ring + clique))
    assert names(references.cycles(e)) == sorted(n for n, _ in ring + clique)


def test_models_do_not_mix(spark):
    one = staging(spark, [("A", "[B]"), ("B", "SUM(Sales[x])")], model="m1")
    two = staging(spark, [("A", "[B]"), ("C", "SUM(Sales[y])")], model="m2")
    e = references.measure_edges(E.stage_all([one, two]))
    assert rows(e) == [("m1", "A", "B")]


def test_inlining_leaves_columns_alone(spark):
    texts = [("A", "SUM(Sales[x])"), ("C", r"[A] / Sales[A] + 'My T'[A] - [A]"), ("D", r"[C] & '$1\2'"), ("x", "1")]
    got = {r.measure_name: r.resolved_expr for r in references.resolve_composites(staging(spark, texts)).collect()}
    assert got["C"] == "(SUM(Sales[x])) / Sales[A] + 'My T'[A] - (SUM(Sales[x]))"
    assert got["D"] == "((SUM(Sales[x])) / Sales[A] + 'My T'[A] - (SUM(Sales[x]))) & '$1\\2'"
    assert got["A"] is None


def test_replacement_text_is_literal(spark):
    texts = [("Cost ($)", r'CALCULATE(SUM(Sales[x]), Sales[n]="a\$1")'), ("B", "[Cost ($)] * 2")]
    got = {r.measure_name: r.resolved_expr for r in references.resolve_composites(staging(spark, texts)).collect()}
    assert got["B"] == r'(CALCULATE(SUM(Sales[x]), Sales[n]="a\$1")) * 2'


def test_deep_chain_is_resolved(spark):
    texts = [("m0", "SUM(Sales[x])")] + [(f"m{i}", f"[m{i - 1}] + {i}") for i in range(1, 14)]
    got = {r.measure_name: r.resolved_expr for r in references.resolve_composites(staging(spark, texts)).collect()}
    assert got["m13"].count("(") == 14 and "[m" not in got["m13"]


def test_doubling_texts_are_reported(spark):
    """Each measure names the one before twice: 40 levels would make 10^13 characters."""
    texts = [("m0", "SUM(Sales[x])")] + [(f"m{i}", f"[m{i - 1}] + [m{i - 1}]") for i in range(1, 41)]
    texts += [("after", "[m40] * 2"), ("loop", "[loop] + [m40]"), ("null", None), ("of null", "[null] + 1")]
    got = {r.measure_name: r for r in references.resolve_composites(staging(spark, texts)).collect()}
    length = len("SUM(Sales[x])")
    for i in range(1, 41):
        length = 2 * (length + 2) + 3
        r = got[f"m{i}"]
        if length <= references.LONGEST:
            assert (len(r.resolved_expr), r.final_status) == (length, "pending")
        else:
            assert (r.resolved_expr, r.final_status, r.error_message) == (None, "error", "Expanded text exceeds 200000 characters")
    assert got["after"].error_message == "Expanded text exceeds 200000 characters"
    assert got["loop"].error_message == "Circular measure reference: loop"
    assert got["null"].error_message == got["of null"].error_message == references.UNDEFINED


def test_length_of_expanded_texts_is_exact(spark):
    texts = [("a$", r"SUM([Measures].[x]) + 'a\$1'"), ("b", "[Measures].[a$] / [Measures].[a$] - [Measures].[c]"), ("c", "1")]
    st = staging(spark, texts, mode="mdx")
    whole = {r.measure_name: r.resolved_expr for r in references.resolve_composites(st).collect()}["b"]
    for longest, kept in ((len(whole), whole), (len(whole) - 1, None)):
        got = {r.measure_name: r.resolved_expr for r in references.resolve_composites(st, longest).collect()}
        assert got["b"] == kept


# ---------------------------------------------------------------- rules

# Measure texts and the SQL they stand for.
DAX = [
    ("SUM(Sales[Amount])", "SUM(amount)"),
    ("COUNT(Sales[OrderID])", "COUNT(order_id)"),
    ("DISTINCTCOUNT(Sales[CustomerID])", "COUNT(DISTINCT customer_id)"),
    ("AVERAGE(Sales[Amount])", "AVG(amount)"),
    ("MIN(Sales[Amount])", "MIN(amount)"),
    ("MAX('Sales'[Amount])", "MAX(amount)"),
    ("COUNTROWS(Sales)", "COUNT(1)"),
    ('CALCULATE(SUM(Sales[Amount]), Sales[Status]="Active")', "SUM(amount) FILTER (WHERE status = 'Active')"),
    (
        'CALCULATE(SUM(Sales[Amount]), Sales[Status]="Active", Sales[Region]="West")',
        "SUM(amount) FILTER (WHERE status = 'Active' AND region = 'West')",
    ),
    ("CALCULATE(COUNTROWS(Sales), Sales[Amount] > 1000, Sales[Status]<>\"It's\")",
     "COUNT(1) FILTER (WHERE amount > 1000 AND status <> 'It''s')"),
    ('CALCULATE(SUM(Sales[A]), Sales[B] = 1 || Sales[C] = 2)', "SUM(a) FILTER (WHERE (b = 1 OR c = 2))"),
    ("CALCULATE(SUM(S[A]), S[B]=1 || S[C]=2, S[D]=3)", "SUM(s.a) FILTER (WHERE (s.b = 1 OR s.c = 2) AND s.d = 3)"),
    ("CALCULATE(SUM(Sales[A]), Sales[B]=1 && Sales[C]=2 || Sales[D]=3, Sales[E]<>4)", "SUM(a) FILTER (WHERE (b = 1 AND c = 2 OR d = 3) AND e <> 4)"),
    ('CALCULATE(SUM(Sales[A]), Sales[B] IN {"x, y", "z"}, Sales[C] IN {1, 2})', "SUM(a) FILTER (WHERE b IN ('x, y', 'z') AND c IN (1, 2))"),
    ("DIVIDE(SUM(Sales[A]), SUM(Sales[B]), 1)", "COALESCE(SUM(a) / NULLIF(SUM(b), 0), 1)"),
    ("DIVIDE(SUM(Sales[A]), SUM(Sales[B]), BLANK())", "SUM(a) / NULLIF(SUM(b), 0)"),
    ("IF(SUM(Sales[A]) > 10, 1)", "CASE WHEN SUM(a) > 10 THEN 1 END"),
    ('SWITCH(TRUE(), SUM(Sales[A]) > 10, "High, or so", SUM(Sales[A]) > 5, "Mid", "Low")', "CASE WHEN SUM(a) > 10 THEN 'High, or so' WHEN SUM(a) > 5 THEN 'Mid' ELSE 'Low' END"),
    ("SWITCH(MAX(Sales[A]), 1, SUM(Sales[B]), 2, SUM(Sales[C]))", "CASE MAX(a) WHEN 1 THEN SUM(b) WHEN 2 THEN SUM(c) END"),
    ("(" * 30 + "SUM(Sales[A])" + ")" * 30, "SUM(a)"),
    ("IF(" * 20 + "SUM(Sales[A])" + " > 1, 1, 0)" * 20, "CASE WHEN " * 20 + "SUM(a)" + " > 1 THEN 1 ELSE 0 END" * 20),
    ('CALCULATE(DISTINCTCOUNT(Sales[CustomerID]), Sales[Status]="Active")', "COUNT(DISTINCT customer_id) FILTER (WHERE status = 'Active')"),
    ('CALCULATE(CALCULATE(SUM(Sales[A]), Sales[B]="(x, y)"), Sales[C]=3)', "SUM(a) FILTER (WHERE b = '(x, y)' AND c = 3)"),
    ("SUMX(Sales, Sales[Quantity]*Sales[UnitPrice])", "SUM(quantity*unit_price)"),
    ("SUMX(Sales, Sales[Amount] * (1 - Sales[Discount]))", "SUM(amount * (1 - discount))"),
    ("AVERAGEX(Sales, Sales[Amount] - Sales[Cost])", "AVG(amount - cost)"),
    ("DIVIDE(SUM(Sales[Profit]), SUM(Sales[Revenue]), 0)", "SUM(profit) / NULLIF(SUM(revenue), 0)"),
    ("SUM(Sales[A]) / DISTINCTCOUNT(Sales[B])", "SUM(a) / COUNT(DISTINCT b)"),
    ("IF(SUM(Sales[A]) > 10, 1, 0)", "CASE WHEN SUM(a) > 10 THEN 1 ELSE 0 END"),
    (
        "VAR TotalRevenue = SUM(Sales[Revenue]) VAR Cost = SUM(Sales[Profit]) VAR Both = TotalRevenue - Cost RETURN IF(TotalRevenue > 0, Both / TotalRevenue, 0)",
        "CASE WHEN SUM(revenue) > 0 THEN (SUM(revenue) - SUM(profit)) / SUM(revenue) ELSE 0 END",
    ),
    ("MAX(RELATED(DimCustomer[Name]))", "MAX(customer.name)"),
]
# Texts whose operators bind differently, or mean something else, in SQL.
TOKENS = [
    ("DIVIDE(SUM(Sales[A]) - SUM(Sales[B]), SUM(Sales[A]))", "(SUM(a) - SUM(b)) / NULLIF(SUM(a), 0)"),
    ("SUM(Sales[X]) / DIVIDE(SUM(Sales[C]) + SUM(Sales[D]), 2)", "SUM(x) / ((SUM(c) + SUM(d)) / NULLIF(2, 0))"),
    ("DIVIDE(SUM(Sales[A]) * 100, SUM(Sales[B]) + 1, 5)", "COALESCE((SUM(a) * 100) / NULLIF(SUM(b) + 1, 0), 5)"),
    ("DIVIDE(DIVIDE(SUM(Sales[A]), 2) + 1, SUM(Sales[B]))", "((SUM(a) / NULLIF(2, 0)) + 1) / NULLIF(SUM(b), 0)"),
    ("SUM(Sales[A]) -- gross\n + SUM(Sales[B])", "SUM(a) + SUM(b)"),
    ("SUM(Sales[A]) // gross", "SUM(a)"),
    ("SUM(Sales[A]) /* gross (no, net) */ - 1", "SUM(a) - 1"),
    ('CALCULATE(SUM(Sales[A]), Sales[B] = "--x // y") -- z', "SUM(a) FILTER (WHERE b = '--x // y')"),
    ("SUM(Sales[A])^2", None),
    ('SUM(Sales[A]) & "x"', None),
    ("SUM(Sales[A]) % 2", None),
    ("SUM(Sales[A]) SUM(Sales[B])", None),
    ("SUM(Sales[A]) > 0 || SUM(Sales[B]) > 0", "SUM(a) > 0 OR SUM(b) > 0"),
    ("IF(SUM(Sales[A])>0 && SUM(Sales[B])>0, 1, 0)", "CASE WHEN SUM(a)>0 AND SUM(b)>0 THEN 1 ELSE 0 END"),
    ("IF(SUM(Sales[A]) = BLANK(), 0, SUM(Sales[A]))", "CASE WHEN SUM(a) IS NULL THEN 0 ELSE SUM(a) END"),
    ("CALCULATE(SUM(Sales[A]), Sales[B] <> BLANK())", "SUM(a) FILTER (WHERE b IS NOT NULL)"),
    ("CALCULATE(SUM(Sales[A]), Sales[B] == BLANK() || Sales[C] = 1)", "SUM(a) FILTER (WHERE (b IS NULL OR c = 1))"),
    ("SUM(Sales[A]) + BLANK()", None),
    ("CALCULATE(CALCULATE(SUM(Sales[A]), Sales[C] = 1), Sales[C] = 2)", "SUM(a) FILTER (WHERE c = 1)"),
    ("CALCULATE(CALCULATE(SUM(Sales[A]), Sales[C] = 1) / SUM(Sales[B]), Sales[C] = 2, Sales[D] > 3)", "(SUM(a) FILTER (WHERE c = 1 AND d > 3) / SUM(b) FILTER (WHERE c = 2 AND d > 3))"),
    ("CALCULATE(CALCULATE(SUM(Sales[A]), Sales[C] = 1), Sales[C] = 2 || Sales[D] = 3)", None),
    ("CALCULATE(SUM(Sales[A]), Sales[B] > 1, Sales[B] < 5)", "SUM(a) FILTER (WHERE b > 1 AND b < 5)"),
    ("SUM(Sales[Amount (USD)]) / SUM(Sales[Profit %])", "SUM(`amount_(usd)`) / SUM(`profit_%`)"),
    ('CALCULATE(SUM(Sales[Net-Sales]), Sales[Type, old] = "x")', "SUM(`net-sales`) FILTER (WHERE `type,_old` = 'x')"),
    ("SUMX(FILTER(Sales, Sales[B] > 1), Sales[A] * Sales[C])", "SUM(a * c) FILTER (WHERE b > 1)"),
    ("COUNTROWS(FILTER(Sales, Sales[B] > 1 && Sales[C] = 2)) * 2", "COUNT(1) FILTER (WHERE b > 1 AND c = 2) * 2"),
    ("SUMX(Sales, IF(Sales[B] > 1, Sales[A], 0))", "SUM(CASE WHEN b > 1 THEN a ELSE 0 END)"),
    ("AVERAGEX(Sales, 2 * IF(Sales[B] > 1 || Sales[C] = 1, Sales[A]))", "AVG(2 * CASE WHEN b > 1 OR c = 1 THEN a END)"),
]
MDX = [
    ("SUM([Measures].[Amount])", "SUM(amount)"),
    ("[Measures].[Amount]", "SUM(amount)"),
    ("DISTINCTCOUNT([Customer].[Customer Id].[Customer Id].MEMBERS)", "COUNT(DISTINCT customer_id)"),
    ("([Status].&[Active], [Measures].[Amount])", "SUM(amount) FILTER (WHERE status = 'Active')"),
    ("([Status].&[Active], [Tier].&[Pre (m)], [Measures].[Amount])", "SUM(amount) FILTER (WHERE status = 'Active' AND tier = 'Pre (m)')"),
    ("IIF([Status].CURRENTMEMBER IS [Status].&[Active], [Measures].[Amount], NULL)", "SUM(amount) FILTER (WHERE status = 'Active')"),
    ("[Measures].[Amount] * [Measures].[Profit]", "SUM(amount * profit)"),
    ("[Measures].[Profit] / [Measures].[Revenue]", "SUM(profit) / NULLIF(SUM(revenue), 0)"),
    ("([Measures].[Revenue] - [Measures].[Amount]) / [Measures].[Revenue]", "(SUM(revenue) - SUM(amount)) / NULLIF(SUM(revenue), 0)"),
    (
        "IIF([Measures].[Revenue] > 0, [Measures].[Profit] / [Measures].[Revenue], 0)",
        "CASE WHEN SUM(revenue) > 0 THEN SUM(profit) / NULLIF(SUM(revenue), 0) ELSE 0 END",
    ),
    (
        'IIF([Measures].[Amount] > 3000, "Green", IIF([Measures].[Amount] > 1000, "Yellow", "Red"))',
        "CASE WHEN SUM(amount) > 3000 THEN 'Green' ELSE CASE WHEN SUM(amount) > 1000 THEN 'Yellow' ELSE 'Red' END END",
    ),
]
# Texts no rule may touch.
OPEN = [
    "VAR x = SUM(Sales[A]) VAR y = FILTER(Sales, Sales[B] > 1) RETURN x + COUNTROWS(y)",
    "CALCULATE(SUM(Sales[A]), ALL(Sales))",
    "SUM(Sales[A]), SUM(Sales[B])",
    "CALCULATE(SUM(Sales[A]), Sales[Flag])",
    "SWITCH(Sales[A], 1, 2, 3)",
    "COUNTROWS(FILTER(VALUES(Sales[A]), Sales[A] > 1))",
    "CALCULATE(SUM(Sales[A]), Sales[B] > MAX(Sales[C]))",
    "SOMETHING(Sales[A])",
    "Sales[A]",
]


def translated(spark, texts, mode, **kw):
    df = rules.translate_rules(staging(spark, [(f"M{i}", t) for i, t in enumerate(texts)], mode, **kw))
    return df.orderBy("position").collect()


def test_dax_rules(spark):
    got = translated(spark, [t for t, _ in DAX], "dax")
    assert [r.expr for r in got] == [e for _, e in DAX]
    assert {r.warning_type for r in got} == {None}
    assert got[-1].joins_needed[0].on == "source.customer_id = customer.customer_id"


def test_tokens_and_precedence(spark):
    got = translated(spark, [t for t, _ in TOKENS], "dax")
    assert [(t, r.expr, r.warning_type) for (t, _), r in zip(TOKENS, got)] == [(t, e, None if e else "untranslated") for t, e in TOKENS]


def test_comments_end_where_they_are_put_in(spark):
    texts = [("A", "SUM(Sales[x]) -- it's gross"), ("B", "[A] /* twice */ * 2 // done")]
    got = {r.measure_name: (r.expr, r.warning_type) for r in rules.translate_rules(references.resolve_composites(staging(spark, texts))).collect()}
    assert got == {"A": ("SUM(x)", None), "B": ("SUM(x) * 2", None)}


def test_mdx_rules(spark):
    columns = ["amount", "profit", "revenue", "customer_id"]
    got = translated(spark, [t for t, _ in MDX], "mdx", columns=columns)
    assert [r.expr for r in got] == [e for _, e in MDX]
    assert translated(spark, ["[Measures].[Unknown]"], "mdx", columns=columns)[0].warning_type == "untranslated"


def test_texts_without_a_rule_are_reported(spark):
    got = translated(spark, OPEN, "dax")
    assert [(r.expr, r.warning_type) for r in got] == [(None, "untranslated")] * len(OPEN)


# Texts with their class and approximated window.
TIMED = [
    ("dax", "CALCULATE(SUM(Sales[Amount]), DATEADD(Calendar[Date], 2, QUARTER))", "time_intelligence", ["date leading 2 quarter"]),
    ("mdx", "(ParallelPeriod([Date].[Calendar].[Month], 3, [Date].[Calendar].CurrentMember), [Measures].[Amount])", "time_intelligence", ["date trailing 3 month"]),
    ("dax", "TOTALYTD(SUM(Sales[Amount]), Calendar[Date])", "window", ["date cumulative", "year current"]),
    ("dax", "TOTALQTD(SUM(Sales[Amount]), Calendar[Date])", "window", ["date cumulative", "quarter current"]),
    ("dax", "CALCULATE(SUM(Sales[Amount]), SAMEPERIODLASTYEAR(Calendar[Date]))", "time_intelligence", ["date trailing 1 year"]),
    ("dax", "CALCULATE(SUM(Sales[Amount]), DATEADD(Calendar[Date], -1, MONTH))", "time_intelligence", ["date trailing 1 month"]),
    ("dax", "CALCULATE(SUM(Sales[Amount]), LASTDATE(Calendar[Date]))", "time_intelligence", ["date current"]),
    ("mdx", "AGGREGATE(PeriodsToDate([Date].[Calendar].[Year], [Date].[Calendar].CurrentMember), [Measures].[Amount])", "window", ["date cumulative", "year current"]),
    ("mdx", "SUM(YTD(), [Measures].[Amount])", "window", ["date cumulative", "year current"]),
    ("mdx", "(ParallelPeriod([Date].[Calendar].[Year], 1, [Date].[Calendar].CurrentMember), [Measures].[Amount])", "time_intelligence", ["date trailing 1 year"]),
    ("mdx", "AVG(LastPeriods(6, [Date].[Calendar].CurrentMember), [Measures].[Amount])", "time_intelligence", ["date trailing 6 month"]),
    ("mdx", "(ClosingPeriod([Date].[Calendar].[Month], [Date].[Calendar].CurrentMember), [Measures].[Amount])", "time_intelligence", ["date current"]),
]


def test_time_rules(spark):
    for mode, text, kind, spans in TIMED:
        r = translated(spark, [text], mode, columns=["amount"])[0]
        expr = "AVG(amount)" if text.startswith("AVG") else "SUM(amount)"
        assert (r["class"], r.expr, [f"{w.order} {w.range}" for w in r.window]) == (kind, expr, spans), text
        assert r.dimensions_needed[0] == "date:date.date"


def test_time_functions_with_conditions(spark):
    texts = [
        'TOTALYTD(SUM(Sales[Amount]), Calendar[Date], Sales[Status]="Active")',
        'CALCULATE(SUM(Sales[Amount]), Sales[Status]="Active", SAMEPERIODLASTYEAR(Calendar[Date]))',
        'CALCULATE(SUM(Sales[Amount]), DATEADD(Calendar[Date], -1, MONTH), Sales[Status]="Active")',
    ]
    got = translated(spark, texts, "dax")
    assert {r.expr for r in got} == {"SUM(amount) FILTER (WHERE status = 'Active')"}
    assert [r.window[0].range for r in got] == ["cumulative", "trailing 1 year", "trailing 1 month"]


def test_time_functions_without_a_window(spark):
    """A fiscal year end, two time functions at once, none that a window stands for, no calendar."""
    texts = [
        'TOTALYTD(SUM(Sales[Amount]), Calendar[Date], "06-30")',
        'TOTALYTD(SUM(Sales[Amount]), Calendar[Date], Sales[Status]="Active", "06-30")',
        "TOTALYTD(CALCULATE(SUM(Sales[Amount]), SAMEPERIODLASTYEAR(Calendar[Date])), Calendar[Date])",
        "CALCULATE(SUM(Sales[Amount]), DATESINPERIOD(Calendar[Date], MAX(Calendar[Date]), -3, MONTH))",
        "TOTALYTD(SUM(Sales[Amount]), Calendar[Date]) + 0 * TOTALYTD(SUM(Sales[B]), Calendar[Date])",
    ]
    got = translated(spark, texts, "dax")
    assert [(r.expr, r.window) for r in got] == [(None, None)] * len(texts)
    assert all(r.warning_type in ("untranslated", "time_intelligence") for r in got)
    assert not any("approximated" in r.warning_message for r in got)
    one = staging(spark, [("A", TIMED[4][1])]).withColumn("dim_tables", F.expr("filter(dim_tables, d -> d.alias = 'customer')"))
    assert tuple(rules.translate_rules(one).select("expr", "warning_message").first()) == (None, "no window stands for this expression")


def test_unknown_columns_are_not_guessed(spark):
    assert translated(spark, ["[Measures].[Distinct Customer Count]"], "mdx")[0].warning_type == "untranslated"


# Texts of the class unsupported.
@pytest.mark.parametrize(
    "text",
    ["RANKX(ALL(Sales), [T])", "CALCULATE(SUM(S[a]), USERELATIONSHIP(S[a], C[b]))", "DIVIDE(1, CALCULATE(SUM(S[a]), ALLSELECTED(S)))",
     "SUMX(TOPN(10, S), S[a])", "RANK([P].CurrentMember, S)", "SUM(TopCount([C].Members, 5), 1)", "SUM(Generate([R].Members, {1}))",
     "[Measures].[x] / ([Measures].[x], [P].[C].Parent)", "[Date].PrevMember", "[Date].Lag(2)", "COUNTROWS(FILTER(S, EARLIER(S[a]) > 1))",
     "CONCATENATEX(VALUES(S[r]), S[r])", "[R].Name + FORMAT(1, '#')", "[M] * [P].CurrentMember.Properties('UNARY_OPERATOR')"],
)
def test_unsupported(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(rules.classify(df.t)).first()[0] == "unsupported"


# ---------------------------------------------------------------- readers


def test_detect_format(spark):
    df = spark.createDataFrame([("A.BIM",), ("b.csv",), ("c.mdx",), ("d.txt",)], "path string")
    known, other = E.split_known(df)
    assert rows(known) == [("A.BIM", "bim"), ("b.csv", "csv"), ("c.mdx", "mdx_script")]
    assert other.first().error_message == "cannot detect the format of d.txt"


def test_script_without_properties(spark):
    text = "CALCULATE;\ncreate member CURRENTCUBE.[Measures].[A]\nAS SUM([Measures].[x]) ;\n-- next; one\nCREATE MEMBER CURRENTCUBE.[Measures].[B] AS 1,\nVISIBLE = 1;\nCREATE MEMBER CURRENTCUBE.[Other].[C] AS 2;"
    df = spark.createDataFrame([("p", text)], "path string, value string")
    got = E.parse_mdx_scripts(df, MAPPING).select("position", "measure_name", "measure_expr")
    assert rows(got) == [(0, "A", "SUM([Measures].[x])"), (1, "B", "1")]


def test_mapping_is_required(spark, tmp_path):
    with pytest.raises(ValueError):
        E.check_mapping({})
    path = tmp_path / "m.yaml"
    path.write_text(yaml.dump(MAPPING))
    assert E.load_mapping(spark, str(path)) == MAPPING


def test_csv_with_name_column(spark, tmp_path):
    (tmp_path / "m.csv").write_text('TableName,Name,Expression\nSales,A,"CALCULATE(SUM(S[a]), S[b]=""x"")"\n')
    got = E.read_measure_csv(spark, str(tmp_path), MAPPING).select("measure_name", "measure_expr", "description").first()
    assert tuple(got) == ("A", 'CALCULATE(SUM(S[a]), S[b]="x")', "")


def test_enrich_dimension_columns(spark):
    st = staging(spark, [("A", "SUM(Sales[x])")])
    cols = spark.createDataFrame([("main.s.fact_sales", ["x"]), ("main.s.dim_date", ["date", "year"])], "table string, columns array<string>")
    r = E.enrich_columns(st, cols).first()
    assert r.fact_columns == ["x"]
    assert [(d.alias, d.columns) for d in r.dim_tables] == [("customer", []), ("date", ["date", "year"])]


# ---------------------------------------------------------------- assembly


def test_rendered_text_parses_back(spark):
    texts = [("Total", "SUM(Sales[Amount])"), ('Odd: "name" #1', 'CALCULATE(SUM(Sales[Amount]), Sales[S]="a: \'b\'")'),
             ("YTD", "TOTALYTD(SUM(Sales[Amount]), Calendar[Date])"), ("Rank", "RANKX(ALL(Sales), [Total])"),
             ("Seg", "MAX(RELATED(DimCustomer[Segment]))")]
    tr = rules.translate_rules(references.resolve_composites(staging(spark, texts)))
    doc = assembly.render_views(tr, "c", "s").collect()
    assert len(doc) == 1
    view = yaml.safe_load(doc[0].yaml)
    assert list(view) == ["version", "source", "joins", "dimensions", "measures"]
    assert view["version"] == "0.1"
    assert view["joins"][0] == {"name": "customer", "source": "main.s.dim_customer", "on": "source.customer_id = customer.customer_id"} or len(view["joins"]) == 2
    assert [m["name"] for m in view["measures"]] == ["Total", 'Odd: "name" #1', "YTD", "Seg"]
    assert view["measures"][1]["expr"] == "SUM(amount) FILTER (WHERE s = 'a: ''b''')"
    assert view["measures"][2]["window"][1] == {"order": "year", "range": "current", "semiadditive": "last"}
    assert "comment" not in doc[0].yaml
    assert doc[0].ddl.startswith("CREATE OR REPLACE VIEW c.s.mv_batch_fact_sales\nWITH METRICS\nLANGUAGE YAML\nAS $$\n  version")
    parts = assembly.render_views(tr, "c", "s", part=3).orderBy("part").collect()
    assert len(parts) > 2 and "\n".join(p.yaml for p in parts) == doc[0].yaml


def test_default_dimension_and_no_empty_views(spark):
    tr = rules.translate_rules(staging(spark, [("A", "SUM(Sales[x])")]))
    assert rows(assembly.view_dimensions(tr).select("name", "expr")) == [("status", "status")]
    none = rules.translate_rules(staging(spark, [("A", "RANKX(Sales, 1)")]))
    assert assembly.assemble_views(none).count() == 0
    assert assembly.view_stats(none).first().status == "failed"


# ---------------------------------------------------------------- comparison


def test_compare_values(spark):
    data = [("1", "1.005", True), ("1", "1.02", False), ("100", "100.9", True), ("100", "102", False), (None, None, True),
            (None, "0", False), (" x", "x ", True), ("x", "y", False), ("0.001", "0.009", True)]
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b, _) in enumerate(data)], "k string, a string, b string")
    got = validate.compare_frames(df.select("k", "a"), df.select("k", "b"), ["k"], {"a": "b"})
    assert {r.k: r.passed for r in got.collect()} == {str(i): ok for i, (_, _, ok) in enumerate(data)}


def test_compare_without_keys_and_with_an_empty_side(spark):
    one = spark.createDataFrame([(1.0,)], "v double")
    assert validate.compare_frames(one, one, [], ["v"]).first().passed
    got = validate.compare_frames(one, one.where("v > 5"), [], ["v"]).collect()
    assert [(r.passed, r.error) for r in got] == [(False, "direct SQL has no row for this group")]


# ---------------------------------------------------------------- stored answers


def test_answer_windows_are_tidied(spark):
    answer = (
        '{"expr": "SUM(amount)", "needs_window": true, "window": [{"order": "calendar.date", "range": "trailing_3_months"},'
        ' {"order": "year_dim", "range": "current", "semiadditive": "first"}, {"order": "Nothing", "range": " all "}],'
        ' "dimensions_needed": ["Date:calendar.date", "Year:calendar.year", "Yea:y"], "joins_needed": []}'
    )
    st = staging(spark, [("A", "x")]).withColumn("ai_result", F.lit(answer))
    r = assembly.parse_answers(st).first()
    assert [tuple(w) for w in r.window] == [
        ("Date", "trailing 3 month", "last"), ("Year", "current", "first"), ("Nothing", "all", "last")
    ]


def test_reports(spark):
    st = staging(spark, [("A", "x"), ("B", "y"), ("C", "z"), ("D", "w")])
    answers = {"A": '{"expr": "SUM(a)"}', "B": '{"expr": "SUM(b)", "warning_type": "time_intelligence", "warning_message": "m"}',
               "C": '{"expr": null, "warning_type": "unsupported_dax"}', "D": "no"}
    text = F.create_map(*[F.lit(x) for kv in answers.items() for x in kv])[F.col("measure_name")]
    report = assembly.batch_report(assembly.parse_answers(st.withColumn("ai_result", text)))
    assert rows(report["views"]) == [("main.s.fact_sales", 4, 1, 2, 1, "partial")]
    assert {r.measure_name: r.status for r in report["measures"].collect()} == {"A": "success", "B": "partial", "C": "warning", "D": "failed"}
    assert {r.measure_name: r.approximation for r in report["warnings"].collect()} == {"B": "SUM(b)", "C": None, "D": None}


# ---------------------------------------------------------------- from export to result


def test_export_to_result(spark, star, sales, tmp_path):
    """A cube script and a CSV export, translated, rendered, read back and evaluated on the star."""
    from metricloom import MetricView

    (tmp_path / "m.csv").write_text(
        "TableName,MeasureName,Expression,Description\n"
        "Sales,Total Sales,SUM(Sales[Amount]),x\n"
        'Sales,Active,"CALCULATE([Total Sales], Sales[Status]=""Active"")",x\n'
        'Sales,Share,"DIVIDE([Active], [Total Sales], 0)",x\n'
        'Sales,Best,"MAX(RELATED(DimCustomer[Name]))",x\n'
        'Sales,YTD Sales,"TOTALYTD([Total Sales], Calendar[Date])",x\n'
        'Sales,Rank,"RANKX(ALL(Sales), [Total Sales])",x\n'
    )
    st = E.read_measure_csv(spark, str(tmp_path), MAPPING)
    tr = rules.translate_rules(references.resolve_composites(st))
    text = assembly.render_views(tr).first().yaml
    tables = {"main.s.fact_sales": star.source, "main.s.dim_customer": star.joins[0].source, "main.s.dim_date": star.joins[2].source}
    mv = MetricView.from_definition("mv", yaml.safe_load(text), tables)
    assert [m.name for m in mv.measures] == ["Total Sales", "Active", "Share", "Best", "YTD Sales"]
    got = mv.query(spark, ["Total Sales", "Active", "Share", "Best"]).first()
    total, active = sales.amount.sum(), sales[sales.status == "Active"].amount.sum()
    assert (float(got[0]), float(got[1]), got[3]) == (total, active, sales.name.max())
    assert float(got[2]) == pytest.approx(active / total)
    by_year = {r.year: float(r["YTD Sales"]) for r in mv.query(spark, ["YTD Sales"], ["year"]).collect()}
    assert by_year == sales.groupby(sales.date_key.dt.year).amount.sum().to_dict()
    checked = validate.validate_all(mv, spark, [], ["YTD Sales"])
    assert checked.count() == 4 and checked.where("NOT passed").count() == 0


# ---------------------------------------------------------------- calls


# Texts, the operator they stand for, and its columns.
CALLS = [
    ("dax", "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALL(Sales)), 0)", "pct_of_total", []),
    ("dax", "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALLEXCEPT(Sales, DimProduct[Category])), 0)", "pct_keep", ["product.category"]),
    ("dax", "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALL(DimProduct[Name]), ALL(DimProduct[ID])), 0)", "pct_remove", ["product.name", "product.id"]),
    ("dax", "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALLSELECTED(Sales)), 0)", "pct_of_selected", []),
    ("dax", "CALCULATE(SUM(Sales[Amount]), FILTER(ALL(Calendar), Calendar[Date] <= MAX(Calendar[Date])))", "running_total", ["calendar.date"]),
    ("dax", "CALCULATE(SUM(Sales[Amount]), USERELATIONSHIP(Sales[ShipKey], Calendar[Date]))", "relationship", ["ship_key", "calendar.date"]),
    ("dax", "RANKX(ALL(DimProduct[Name]), CALCULATE(SUM(Sales[Amount])))", "rankx", ["product.name"]),
    ("dax", "COUNTROWS(FILTER(Sales, EARLIER(Sales[Amount]) >= Sales[Amount])) / COUNTROWS(Sales)", "cumulative_pct", ["amount"]),
    ("mdx", "COUNT(FILTER([Status].Members, [Measures].[Amount] > 1000))", "count_members", ["status"]),
    ("mdx", "SUM(NULL:[Date].[Calendar].CurrentMember, [Measures].[Amount])", "running_total", ["calendar"]),
    ("mdx", "[Measures].[Amount] / ([Measures].[Amount], [Product].[Category].[All])", "pct_remove", ["category"]),
    ("mdx", "MAX([Customer].[Name].Members, [Measures].[Amount])", "over_members", ["name"]),
]
# Another measure below than above, a rank of an unknown measure, a sum beside a call.
NO_CALLS = [
    "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Cost]), ALL(Sales)), 0)",
    "RANKX(ALL(DimProduct[Name]), SOMETHING(Sales[Amount]))",
    "1 + RANKX(ALL(DimProduct[Name]), SUM(Sales[Amount]))",
]


def test_texts_that_stand_for_operators(spark):
    from metricloom.operators import calls

    for mode in ("dax", "mdx"):
        texts = [(str(i), t) for i, (m, t, _, _) in enumerate(CALLS) if m == mode]
        got = {r.measure_name: (r.kind, r.columns) for r in calls.find_calls(staging(spark, texts, mode, columns=["amount"])).collect()}
        assert got == {str(i): (k, c) for i, (m, _, k, c) in enumerate(CALLS) if m == mode}
    assert calls.find_calls(staging(spark, [(str(i), t) for i, t in enumerate(NO_CALLS)])).count() == 0


# Calls by operator, with what is left of the texts once they are calls: kind and expression.
PLANNED = {
    "ranks": {
        "RANKX(ALL(Sales[CustomerID]), CALCULATE(SUM(Sales[Amount])))": ("rankx", "SUM(amount)"),
        "SUMX(TOPN(10, VALUES(Sales[CustomerID]), CALCULATE(SUM(Sales[Amount]))), CALCULATE(SUM(Sales[Amount])))": ("topn_sum", "SUM(amount)"),
        'CONCATENATEX(VALUES(Sales[Priority]), Sales[Priority], "; ")': ("concatenatex", None),
        "RANKX(ALL(Sales[CustomerID]), Sales[Amount] ^ 2)": None,
    },
    "shares": {
        "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALL(Sales)), 0)": ("pct_of_total", "SUM(amount)"),
        "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALLSELECTED(Sales)), 0)": ("pct_of_selected", "SUM(amount)"),
        "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALLEXCEPT(Sales, Sales[Status])))": ("pct_keep", "SUM(amount)"),
        "DIVIDE(SUM(Sales[Amount]), CALCULATE(SUM(Sales[Amount]), ALL(Sales[Priority])), 0)": ("pct_remove", "SUM(amount)"),
    },
    "time": {
        "CALCULATE(SUM(Sales[Amount]), FILTER(ALL(Calendar), Calendar[Date] <= MAX(Calendar[Date])))": ("running_total", "SUM(amount)"),
        "VAR a = SUM(Sales[Amount]) VAR b = CALCULATE(SUM(Sales[Amount]), SAMEPERIODLASTYEAR(Calendar[Date])) RETURN DIVIDE(a - b, b, 0)": ("yoy", "SUM(amount)"),
        "AVERAGEX(DATESINPERIOD(Calendar[Date], MAX(Calendar[Date]), -7, MONTH), CALCULATE(SUM(Sales[Amount])))": ("rolling", "SUM(amount)"),
    },
}


@pytest.mark.parametrize("kind", PLANNED)
def test_plan_of_calls_is_small(spark, kind):
    """The driver holds the plan of the calls, which must not repeat the rules of the translation."""
    from metricloom.operators import calls

    found = calls.find_calls(staging(spark, [(str(i), t) for i, t in enumerate(PLANNED[kind])]))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    got = {r.measure_name: (r.kind, r.expr) for r in found.collect()}
    assert got == {str(i): c for i, c in enumerate(PLANNED[kind].values()) if c}


def test_calls_are_evaluated(spark, star, sales):
    from pyspark.sql import Row

    from metricloom.operators import calls

    def call(kind, expr="SUM(amount)", columns=(), n=None, unit=None, argument=None):
        return Row(measure_name="v", kind=kind, expr=expr, columns=list(columns), n=n, unit=unit, argument=argument)

    by = sales.groupby(["region", "customer_id"]).amount.sum()
    got = calls.evaluate(call("count_members", columns=["customer_id"], argument="> 5000"), star, spark, ["Region"])
    assert {r[0]: r[1] for r in got.collect()} == (by > 5000).groupby("region").sum().to_dict()
    got = calls.evaluate(call("pct_keep", columns=["region"]), star, spark, ["Region", "Status"])
    total = sales.groupby("region").amount.sum()
    for r in got.collect():
        assert float(r.scope_total) == total[r.Region]
    got = calls.evaluate(call("over_members", columns=["customer_id"], argument="MAX"), star, spark, ["Region"])
    assert {r[0]: float(r[1]) for r in got.collect()} == by.groupby("region").max().to_dict()
    got = calls.evaluate(call("new_members", None, ["customer_id"]), star, spark, date="Date")
    assert sum(r.new_members for r in got.collect()) == sales.customer_id.nunique()
    with pytest.raises(ValueError):
        calls.evaluate(call("relationship", columns=["other_key", "calendar.date"]), star, spark, ["Region"])


def test_rows_of_one_file_are_translated_and_resolved_by_many_tasks(spark):
    """A catalog is few bytes: one task read it, and did all of the work as well."""
    st = staging(spark, [("A", "sum(Sales[x])"), ("B", 'calculate(Sum(Sales[x]), Sales[y]="if(divide(")')]).coalesce(1)
    got = rules.translate_rules(st)
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert rows(got.select("measure_name", "expr")) == [("A", "SUM(x)"), ("B", "SUM(x) FILTER (WHERE y = 'if(divide(')")]
    assert "REPARTITION_BY_NUM" in references.definitions(st)._jdf.queryExecution().executedPlan().toString()


def test_large_catalogs_are_not_broadcast(spark, monkeypatch):
    """A frame whose files are small may have many rows: broadcasts went by the bytes."""
    texts = [("A", "SUM(Sales[x])"), ("B", "[A] + [A]"), ("C", "[B] / [A]"), ("D", "[D] + 1"), ("E", "[D] * 2")]
    plain = rows(references.resolve_composites(staging(spark, texts)).select("measure_name", "resolved_expr", "error_message"))
    monkeypatch.setattr(references.S, "PLAIN_ROWS", 0)
    made, settled = [], references.S.settle
    monkeypatch.setattr(references.S, "settle", lambda df: made.append(df) or settled(df))
    got = references.resolve_composites(staging(spark, texts)).select("measure_name", "resolved_expr", "error_message")
    assert rows(got) == plain
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    edges = next(df for df in made if df.columns == ["model", "measure_name", "ref"] and "Join" in plan(df))
    assert "SortMergeJoin" in plan(edges) and "BroadcastHashJoin" not in plan(got)
