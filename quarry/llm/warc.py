"""WARC: resolution of not-modified revisits.

Method: an as-of join by canonical URL.  Each revisit looks for the latest full response captured before it; its validators
are checked against that response's (entity tags first, weakly compared, else Last-Modified), and where they hold the headers
that a not-modified answer may change (UPDATES) replace the response's.

Scale: the join runs inside (URL, time block) windows, and each block gets the latest response of the blocks before it from a
window over block maxima; so a URL that holds a third of all records is spread over its blocks.  Payloads stay where they
are: the result names the response and its digest.

Defined results: status is ``resolved``, ``changed`` (validators differ), ``unchecked`` (none to compare; not merged) or
``missing`` (no earlier full response; so for null or bad URLs and null times); of responses of one time the larger
record_id counts, and only strictly earlier times do; repeated records each give a row; empty tables give none; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import known_to_arrow, table
from .urls import _PARTS_SQL, canonical

#: Header fields that a 304 answer may update, lower case.
UPDATES = ("cache-control", "content-location", "date", "etag", "expires", "vary")
BLOCK = 100_000
#: Bytes of records that a reading task hands on at a time.
BATCH_BYTES = 1 << 24


def records(stream) -> Iterator[dict]:
    """The records of one WARC file, plain or gzipped, one after the other: headers by lower-case name, and body."""
    stream = io.BufferedReader(stream)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "0")
        yield {"headers": headers, "body": stream.read(int(size) if size.isdigit() else 0)}


def _framed(files: Iterator[tuple], batch_bytes: int) -> Iterator:
    """Rows of (path, stream) in frames of some batch_bytes each."""
    import pandas as pd

    rows, held = [], 0
    for path, stream in files:
        with stream:
            for nr, r in enumerate(records(stream)):
                rows.append((path, nr, r["headers"], r["body"]))
                held += len(r["body"]) + sum(len(k) + len(v) for k, v in r["headers"].items())
                if held >= batch_bytes:
                    yield pd.DataFrame(rows, columns=["file", "nr", "headers", "body"])
                    rows, held = [], 0
    yield pd.DataFrame(rows, columns=["file", "nr", "headers", "body"])


def read_warc(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(file, nr, headers, body) of the records of the WARC files under path.

    A file is one task's work, as members of a gzipped one have no index, but is read through Arrow's file systems record by
    record, so a task holds some batch_bytes and one record.  Where Arrow does not know the scheme, Spark reads whole files
    (each below 2 GB).  A damaged gzip file raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def opened(batches: Iterator) -> Iterator:
        from pyarrow import fs

        for pdf in batches:
            for name in pdf["path"]:
                store, at = fs.FileSystem.from_uri(name)
                yield name, store.open_input_stream(at, compression=None)

    held = lambda batches: ((name, io.BytesIO(data)) for pdf in batches for name, data in zip(pdf["path"], pdf["content"]))
    known = known_to_arrow(path)
    source = opened if known else held
    return files.select("path", *([] if known else ["content"])).mapInPandas(lambda batches: _framed(source(batches), batch_bytes), "file string, nr int, headers map<string,string>, body binary")


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """From (record_id, kind 'response' or 'revisit', url, ts long, etag, last_modified, headers map, digest): a row per revisit.

    (record_id, canon, refers_to, status, digest, headers): headers are merged where resolved, else the revisit's own.
    """
    entries = F.coalesce(F.map_entries("headers"), F.array().cast("array<struct<key:string,value:string>>"))
    r = records.select("record_id", "kind", canonical(F.col("url")).alias("canon"), F.col("ts").cast("long").alias("ts"), "etag", "last_modified", entries.alias("own"), "digest")
    able = (F.col("canon") != "") & F.col("ts").isNotNull()
    # without a URL or a time there is nothing to find, and all such records would share one window
    lost = r.where((F.col("kind") == "revisit") & ~able)
    r = r.where(able).withColumn("blk", F.floor(F.col("ts") / block)).withColumn("full", F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "own")))
    inside = Window.partitionBy("canon", "blk").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("near", F.max("full").over(inside))
    latest = r.where("full is not null").groupBy("canon", "blk").agg(F.max("full").alias("latest"))
    # every block with a record gets the latest response of earlier blocks
    blocks = r.select("canon", "blk").distinct().join(latest, ["canon", "blk"], "left")
    earlier = Window.partitionBy("canon").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("far", F.max("latest").over(earlier)).where("far is not null").drop("latest")
    v = r.where(F.col("kind") == "revisit").join(blocks, ["canon", "blk"], "left").withColumn("base", F.coalesce("near", "far"))
    tags = F.col("etag").isNotNull() & F.col("base.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull()
    held = F.when(tags, _weak(F.col("etag")) == _weak(F.col("base.etag"))).when(dates, F.col("last_modified") == F.col("base.last_modified"))
    status = F.when(F.col("base").isNull(), "missing").when(held.isNull(), "unchecked").when(held, "resolved").otherwise("changed")
    may = lambda e: F.lower(e["key"]).isin(*UPDATES)
    stays = F.filter("base.own", lambda e: ~F.exists("own", lambda o: (F.lower(o["key"]) == F.lower(e["key"])) & may(o)))
    merged = F.when(F.col("status") == "resolved", F.concat(stays, F.filter("own", may))).otherwise(F.col("own"))
    found = v.withColumn("status", status).select("record_id", "canon", F.col("base.record_id").alias("refers_to"), "status", F.when(F.col("status") == "resolved", F.col("base.digest")).alias("digest"), merged.alias("headers"))
    none = lambda c: F.lit(None).cast(found.schema[c].dataType).alias(c)
    return found.unionByName(lost.select("record_id", "canon", none("refers_to"), F.lit("missing").alias("status"), none("digest"), F.col("own").alias("headers")))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records as a crawl of ``pages`` would give: each page in full, and a later or earlier not-modified visit to its URL, with an entity tag, a date or neither."""
    body = F.md5(F.coalesce("html", F.lit("")))
    tag, date = F.concat(F.lit('"'), F.substring(body, 1, 8), F.lit('"')), F.concat(F.lit("day "), F.floor(F.col("page_id") / 7).cast("string"))
    header = lambda kind, ts: F.map_from_arrays(F.array(F.lit("Content-Type"), F.lit("Date"), F.lit("Server")), F.array(F.lit(kind), F.concat(F.lit("t"), ts.cast("string")), F.lit(kind)))
    seen = F.col("page_id") * 10
    again = seen + F.when(F.col("page_id") % 3 == 0, 5).when(F.col("page_id") % 3 == 1, 5_000_000).otherwise(-5)
    first = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", seen.alias("ts"), tag.alias("etag"), date.alias("last_modified"), header("text/html", seen).alias("headers"), body.alias("digest"))
    kind = F.col("page_id") % 5
    later = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", again.alias("ts"), F.when(kind > 1, F.concat(F.lit("W/"), tag)).alias("etag"),
        F.when(kind > 0, date).alias("last_modified"), header("none", again).alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return first.unionByName(later)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified visit of a crawl of all pages, resolved."""
    found = resolve(captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform("headers", lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))), "\n")
    return found.select("record_id", F.expr("(record_id - 1) div 2").alias("page_id"), "canon", "refers_to", "status", "digest", headers.alias("headers"))


SQL = (
    "WITH "
    + _PARTS_SQL
    + r""",
b AS (SELECT n.page_id, n.canon, md5(coalesce(p.html, '')) AS body, n.page_id * 10 AS seen,
             n.page_id * 10 + CASE n.page_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 5000000 ELSE -5 END AS again,
             'day ' || CAST(n.page_id // 7 AS VARCHAR) AS day FROM n JOIN pages p USING (page_id)),
f AS (SELECT page_id * 2 AS record_id, canon, seen AS ts, substr(body, 1, 8) AS etag, day, body FROM b WHERE canon <> ''),
v AS (SELECT page_id * 2 + 1 AS record_id, page_id, canon, again AS ts, CASE WHEN page_id % 5 > 1 THEN substr(body, 1, 8) END AS etag, CASE WHEN page_id % 5 > 0 THEN day END AS day FROM b),
j AS (SELECT v.*, f.record_id AS refers_to, f.etag AS f_etag, f.day AS f_day, f.body AS f_body, f.ts AS f_ts FROM v ASOF LEFT JOIN f ON v.canon = f.canon AND v.ts > f.ts),
s AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'missing' WHEN etag IS NOT NULL THEN CASE WHEN etag = f_etag THEN 'resolved' ELSE 'changed' END
                     WHEN day IS NOT NULL THEN CASE WHEN day = f_day THEN 'resolved' ELSE 'changed' END ELSE 'unchecked' END AS status FROM j)
SELECT record_id, page_id, canon, refers_to, status, CASE WHEN status = 'resolved' THEN f_body END AS digest,
       CASE WHEN status = 'resolved' THEN 'content-type=text/html' || chr(10) || 'date=t' || CAST(ts AS VARCHAR) || chr(10) || 'server=text/html'
            ELSE 'content-type=none' || chr(10) || 'date=t' || CAST(ts AS VARCHAR) || chr(10) || 'server=none' END AS headers
FROM s
"""
)
