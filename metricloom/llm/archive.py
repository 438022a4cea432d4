"""A content-addressed web archive.

An archive is two tables. `payloads` holds the bytes of every different payload once, under its SHA-256 digest together with
its SHA-1 digest and length. `headers` holds the exact bytes of every record's headers (those of the record and those of the
HTTP answer) and the address of its payload. Records are put together again by a join; what is read is held against the
address it was read by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.settle import salted_join, settle

ADDRESS = ["sha256", "sha1", "bytes"]
# The alphabet of base32 digests, the marks and names of the record format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RADIX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
LINE = "\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1 digest: five hexadecimal digits are four of base 32."""
    fives = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32) for i in range(8)]
    return F.translate(F.concat(*[F.lpad(f, 4, "0") for f in fives]), RADIX32, BASE32)


def _address(payload: Column) -> list[Column]:
    return [F.sha2(payload, 256).alias("sha256"), base32(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("bigint").alias("bytes")]


def _lines(*lines: Column | str) -> Column:
    """Lines of a header, null ones left out, and the empty line after them."""
    given = [F.concat(F.lit(x) if isinstance(x, str) else x, F.lit(LINE)) for x in lines]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in given], F.lit(LINE))


def _named(id_: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))


def write(captures: DataFrame, path: str, id_: str, url: str, payload: str, date: str | None = None, least: int = 0) -> None:
    """Archive every capture as a record below `path`.

    Payloads are bytes or texts (in UTF-8); a null one is empty. Of records with equal payloads of at least `least` bytes the
    one with the smallest id is a response, the others are revisits of it; smaller payloads are all responses. Null ids come
    last; of repeated smallest ids one row is the response. Line feeds in addresses are escaped, a null address has no line.
    `date` names a column of texts; captures without one are dated 1970. Other columns are not archived.

    Payloads travel once per task that has them. Records of one payload, however many, are split over tasks.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    kept = captures.select(*_address(body), body.alias("payload")).dropDuplicates(ADDRESS)
    kept.write.option("compression", "zstd").parquet(f"{path}/payloads")
    address = F.replace(F.replace(F.col(f"`{url}`").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    dated = F.coalesce(F.col(f"`{date}`").cast("string") if date else F.lit(None), F.lit("1970-01-01T00:00:00Z"))
    rows = captures.select(F.col(f"`{id_}`").alias("id"), address.alias("uri"), dated.alias("date"), *_address(body))
    rows = settle(rows.withColumn("number", F.monotonically_increasing_id()))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "number")
    first = rows.groupBy(*ADDRESS).agg(F.min(order).alias("first"))
    joined = salted_join(rows, first, ADDRESS, plain_rows=0)
    revisit = (F.col("number") != F.col("first.number")) & (F.col("bytes") >= least)
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), "bytes"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = _lines(
        "WARC/1.1",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _named(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), "uri"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _named(F.col("first.id")))),
        F.when(revisit, f"WARC-Profile: {IDENTICAL}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), length),
    )
    joined.select("number", F.concat(header, http).cast("binary").alias("header"), *ADDRESS).write.parquet(f"{path}/headers")


def _value(name: str) -> Column:
    """Value of a line of the record's header; null where there is no such line."""
    top = F.substring_index(F.col("header").cast("string"), LINE + LINE, 1)
    found = F.regexp_extract(top, rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _id(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "<urn:capture:(.*)>", 1), F.lit(""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive, whole.

    `header` and `record` are its exact bytes, `payload` what was captured, also where the record is a revisit and refers to
    another one. `payload_bytes` and `payload_digest` are taken from the payload as read. A payload that doesn't have the
    digests it is stored under, or a record whose header names another one, fails the job. An empty archive has no rows.
    Columns that aren't used aren't read: payloads are only moved where they are asked for.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    right = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("bytes"))
    checked = F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    stored = stored.select(*ADDRESS, checked.alias("payload"))
    stored = stored.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": base32(F.sha1("payload"))})
    joined = salted_join(spark.read.parquet(f"{path}/headers"), stored, ADDRESS, "left", plain_rows=0)
    named = F.concat(F.lit("sha1:"), F.col("payload_digest")) == _value("WARC-Payload-Digest")
    broken = F.raise_error(F.concat(F.lit("no payload of record "), F.col("number"))).cast("string")
    end = F.lit(LINE + LINE).cast("binary")
    empty = F.lit("").cast("binary")
    kind = _value("WARC-Type")
    return joined.select(
        "number",
        "header",
        "payload",
        F.concat("header", F.when(kind == "response", F.col("payload")).otherwise(empty), end).alias("record"),
        "payload_bytes",
        F.when(named, F.col("payload_digest")).otherwise(broken).alias("payload_digest"),
        kind.alias("record_type"),
        _id(_value("WARC-Record-ID")).alias("id"),
        _id(_value("WARC-Refers-To")).alias("refers_to"),
        _value("WARC-Target-URI").alias("uri"),
        _value("WARC-Date").alias("date"),
    )


def export(records: DataFrame, path: str) -> None:
    """Records of `read` as files of the record format: whole records one after the other."""
    line = F.substring(F.col("record"), F.lit(1), F.octet_length("record") - len(LINE))  # the writer ends each line
    records.select(line.cast("string").alias("value")).write.option("lineSep", LINE).text(path)
