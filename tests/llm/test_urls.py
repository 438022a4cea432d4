import datetime as dt

import duckdb
from pyspark.sql import functions as F

from metricloom.llm import urls
from metricloom.llm.queries import ORACLE, QUERIES

D = dt.date


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    want = con.execute(ORACLE["op9_url_filters"])
    names = [d[0] for d in want.description]
    got = QUERIES["op9_url_filters"](spark, "/root/testdata/sf0.01").select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_plan_is_native(spark):
    plan = QUERIES["op9_url_filters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


def test_intervals(spark):
    entries = [
        ("spam", "A.com", "add", D(2023, 1, 5)), ("spam", "a.com", "add", D(2023, 1, 9)), ("spam", "a.com", "remove", D(2023, 2, 1)),
        ("spam", "a.com", "remove", D(2023, 3, 1)), ("spam", "a.com", "add", D(2023, 4, 1)), ("spam", "a.com", "remove", D(2023, 4, 1)),
        ("spam", "b.com", "remove", D(2023, 1, 1)), ("spam", None, "add", D(2023, 1, 1)), (None, "c.com", "add", D(2023, 1, 1)),
        ("spam", "d.com", "none", D(2023, 1, 1)), ("spam", "e.com", "add", None),
    ]
    frame = spark.createDataFrame(entries, "list string, key string, action string, day date")
    got = sorted(map(tuple, urls.intervals(frame).collect()))
    assert got == [("spam", "a.com", D(2023, 1, 5), D(2023, 2, 1)), ("spam", "a.com", D(2023, 4, 1), D(9999, 12, 31))]


def test_judged(spark):
    entries = [
        ("spam", "bad.com", "add", D(2023, 1, 10)), ("spam", "bad.com", "remove", D(2023, 1, 20)), ("allow", "ok.bad.com", "add", D(2023, 1, 1)),
        ("adult", "ok.bad.com/x", "add", D(2023, 1, 1)), ("adult", "localhost", "add", D(2023, 1, 1)),
    ]
    captures = [
        (1, "http://bad.com/", D(2023, 1, 9)), (2, "http://bad.com/", D(2023, 1, 10)), (3, "HTTPS://u:p@Bad.COM.:8080?q", D(2023, 1, 19)),
        (4, "//sub.bad.com/p/q", D(2023, 1, 20)), (5, "http://ok.bad.com/y", D(2023, 1, 15)), (6, "http://ok.bad.com/x?z", D(2023, 1, 15)),
        (7, None, D(2023, 1, 15)), (8, "no url", D(2023, 1, 15)), (9, "http://bad.com/", None), (10, "http://localhost/", D(2023, 1, 15)),
        (11, "http://notbad.com/", D(2023, 1, 15)), (2, "http://bad.com/", D(2023, 1, 10)),
    ]
    frame = spark.createDataFrame(captures, "id int, url string, day date").withColumns({"host": F.lit(1), "key": F.lit(2), "row": F.lit(3)})
    lists = spark.createDataFrame(entries, "list string, key string, action string, day date")
    got = urls.judged(frame, "url", "day", lists)
    by = {r.row.id: (r.host, r.blocked, r.lists) for r in got.collect()}
    assert got.count() == len(captures)
    assert [i for i in by if by[i][1]] and sorted(i for i in by if by[i][1]) == [2, 3, 6, 10]
    assert by[5] == ("ok.bad.com", False, ["allow", "spam"]) and by[6][2] == ["adult", "allow", "spam"]
    assert by[3][0] == "bad.com" and by[7] == (None, False, []) == by[8] and by[4][2] == []
    assert urls.judged(frame.limit(0), "url", "day", lists).count() == 0
    assert urls.judged(frame, "url", "day", lists.limit(0)).where("blocked").count() == 0
