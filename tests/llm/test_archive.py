"""Archived records against plain digests, and their exact bytes."""

import base64
import glob
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from metricloom.llm import archive
from metricloom.llm.queries import ORACLE, QUERIES

ROWS = [
    (5, "http://a\r\nX: y", "hé"),
    (2, None, "hé"),
    (2, "u", "hé"),
    (None, "n", "hé"),
    (7, "e", None),
    (9, "e2", ""),
    (11, "b", "x\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n"),
    (12, "long", "z" * 300_000),
]


def written(spark, tmp_path, rows=ROWS, **options):
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("number", F.lit("clash"))
    archive.write(docs, str(tmp_path / "archive"), "page_id", "url", "html", **options)
    return archive.read(spark, str(tmp_path / "archive"))


def test_payloads_digests_and_types(spark, tmp_path):
    rows = written(spark, tmp_path).collect()
    assert len(rows) == len(ROWS)
    payloads = {(r["id"], r["uri"]): bytes(r["payload"]).decode() for r in rows}
    assert payloads == {(None if i is None else str(i), u and u.replace("\r\n", "%0D%0A")): t or "" for i, u, t in ROWS}
    for r in rows:
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()
        assert r["payload_bytes"] == len(bytes(r["payload"]))
    kinds = sorted((r["record_type"], r["id"] or "", r["refers_to"] or "") for r in rows)
    assert kinds == sorted(
        [("response", "2", ""), ("revisit", "2", "2"), ("revisit", "5", "2"), ("revisit", "", "2")]
        + [("response", "7", ""), ("revisit", "9", "7"), ("response", "11", ""), ("response", "12", "")]
    )
    assert spark.read.parquet(str(tmp_path / "archive/payloads")).count() == 4


def test_records_are_well_formed(spark, tmp_path):
    records = written(spark, tmp_path)
    archive.export(records, str(tmp_path / "files"))
    raw = b"".join(open(f, "rb").read() for f in sorted(glob.glob(str(tmp_path / "files/part-*"))))
    found = []
    while raw:  # what a reader of the format does: header, length, block, two line feeds
        head, rest = raw.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"(?m)^Content-Length: (\d+)", head).group(1))
        assert head.startswith(b"WARC/1.1\r\n") and rest[length : length + 4] == b"\r\n\r\n"
        found.append(head + b"\r\n\r\n" + rest[: length + 4])
        raw = rest[length + 4 :]
    assert sorted(found) == sorted(bytes(r["record"]) for r in records.collect())


def test_small_payloads_are_responses(spark, tmp_path):
    rows = written(spark, tmp_path, least=1).collect()
    assert {r["record_type"] for r in rows if r["id"] in ("7", "9")} == {"response"}


def test_damage_is_noticed(spark, tmp_path):
    written(spark, tmp_path)
    payloads = spark.read.parquet(str(tmp_path / "archive/payloads"))
    payloads.withColumn("payload", F.concat("payload", F.lit("!").cast("binary"))).write.parquet(str(tmp_path / "other/payloads"))
    spark.read.parquet(str(tmp_path / "archive/headers")).write.parquet(str(tmp_path / "other/headers"))
    with pytest.raises(Exception, match="damaged payload"):
        archive.read(spark, str(tmp_path / "other")).select("payload_bytes").collect()


def test_empty_table(spark, tmp_path):
    assert written(spark, tmp_path, rows=[]).collect() == []


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.execute(ORACLE["op12_archive"]).fetchall()
    assert sorted(map(tuple, QUERIES["op12_archive"](spark, sf_dir).collect())) == sorted(want)
