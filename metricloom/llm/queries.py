"""The registered queries of this package, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.settle import scratch
from . import alignment, archive, fingerprints, jaccard, language, mixing, packing, quality, sharding, topk, toxicity, urls, whitening
from .text import labelled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("held_out", labelled(docs)[0]), model, ["doc_id", "held_out"])
    return scored.select("row.doc_id", "row.held_out", "score", "predicted")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs.withColumn("held_out", labelled(docs)[0]), language.fit(docs), ["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shards(docs, ["doc_id", "text_crc32", "size"], 24)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.withColumn("held_out", labelled(docs)[0]), model, ["doc_id", "held_out"])
    return scored.select("row.doc_id", "row.held_out", "score", "predicted")


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


ORACLE["op10_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words().alias("size"))
    mix = mixing.mix(docs, F.col("size"), "source")
    return mix.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries made from the pages: every site's digest says on which lists it was, and when."""
    site = F.regexp_extract(urls.host(F.col("url")), r"([^.]+\.[^.]+)$", 1)
    whole = urls.host(F.col("url"))
    path = F.concat(whole, F.lit("/"), urls.segment(F.col("url")))
    named = [pages.select(key.alias("key")).where(F.col("key").isNotNull() & (F.col("key") != "")) for key in (site, whole, path)]
    known = named[0].union(named[1]).union(named[2]).distinct()
    number = lambda at: F.conv(F.substring(F.md5("key"), at, 4), 16, 10).cast("int")
    drawn = known.withColumns({"a": number(1), "b": number(5), "c": number(9)}).where("a % 3 = 0")
    name = F.element_at(F.array(F.lit("spam"), F.lit("adult"), F.lit("malware"), F.lit("allow")), F.col("b") % 4 + 1)
    day = lambda days: F.date_add(F.lit("2023-01-01").cast("date"), days.cast("int"))
    added, removed = F.col("b") % 300, F.col("b") % 300 + 30 + F.col("c") % 200
    events = F.array(
        F.struct(F.lit("add").alias("action"), day(added).alias("day")),
        F.struct(F.lit("remove").alias("action"), day(removed).alias("day")),
        F.struct(F.when(F.col("c") % 2 == 0, "add").otherwise("none").alias("action"), day(removed + 40).alias("day")),
    )
    return drawn.select(name.alias("list"), "key", F.explode(events).alias("event")).select("list", "key", "event.action", "event.day")


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages were fetched one after the other in 2023 and 2024; lists as in `list_entries`."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") % 730).cast("int"))
    found = urls.judged(pages.withColumn("fetched", fetched), "url", "fetched", list_entries(pages))
    return found.select("row.page_id", F.col("row.fetched").cast("string").alias("fetched"), "host", "blocked", F.array_join("lists", ",").alias("lists"))


ORACLE["op9_url_filters"] = r"""
WITH p AS (
  SELECT page_id, DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS fetched,
    nullif(regexp_replace(lower(regexp_extract(trim(url), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
    coalesce(regexp_extract(trim(url), '^(?:[^/?#]*:)?//[^/?#]*/([^/?#]+)', 1), '') AS segment FROM pages),
k AS (
  SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS key FROM p WHERE host IS NOT NULL
  UNION SELECT host FROM p WHERE host IS NOT NULL UNION SELECT host || '/' || segment FROM p WHERE host IS NOT NULL),
n AS (
  SELECT key, CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) AS a, CAST('0x' || substr(md5(key), 5, 4) AS INTEGER) AS b,
    CAST('0x' || substr(md5(key), 9, 4) AS INTEGER) AS c FROM k WHERE key <> ''),
spans AS (
  SELECT ['spam', 'adult', 'malware', 'allow'][b % 4 + 1] AS list, key, DATE '2023-01-01' + b % 300 AS since,
    DATE '2023-01-01' + (b % 300 + 30 + c % 200) AS until FROM n WHERE a % 3 = 0
  UNION ALL
  SELECT ['spam', 'adult', 'malware', 'allow'][b % 4 + 1], key, DATE '2023-01-01' + (b % 300 + 70 + c % 200), DATE '9999-12-31'
  FROM n WHERE a % 3 = 0 AND c % 2 = 0),
asked AS (
  SELECT page_id, fetched, array_to_string(list_slice(l, i, len(l)), '.') AS key, len(l) - i + 1 AS rank
  FROM (SELECT *, string_split(host, '.') AS l, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM p WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, fetched, host || '/' || segment, 1000 FROM p WHERE host IS NOT NULL AND segment <> ''),
hit AS (
  SELECT page_id, max(rank) FILTER (WHERE list <> 'allow') AS denied, max(rank) FILTER (WHERE list = 'allow') AS allowed,
    array_to_string(list_sort(list_distinct(list(list))), ',') AS lists
  FROM asked JOIN spans USING (key) WHERE fetched >= since AND fetched < until GROUP BY page_id)
SELECT page_id, strftime(fetched, '%Y-%m-%d') AS fetched, host, denied IS NOT NULL AND coalesce(allowed, -1) < denied AS blocked, coalesce(lists, '') AS lists
FROM p LEFT JOIN hit USING (page_id)
"""


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"]))
    return packed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return made.select("row.doc_id", *[c for c in made.columns if c != "row"])


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("row.doc_id", *[c for c in joined.columns if c != "row"])


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, "embedding", 32)
    made = whitening.whiten(vectors, model, "embedding", ["vec_id"], 32)
    share = F.array(*[F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values[:32]]).cast("array<double>")
    each = made.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@query
def op12_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    archive.write(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    records = archive.read(spark, path)
    number = lambda c: F.col(c).cast("bigint")
    return records.select(
        number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


ORACLE["op12_archive"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, payload_bytes, first, list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS fives
  FROM p JOIN f USING (html))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    made = alignment.aligned(table(spark, sf_dir, "documents"), *paths, ["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return made.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)
