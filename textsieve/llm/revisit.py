"""Not-modified revisit records of web archives, resolved to full responses.

A revisit is joined, by canonical URL, to the latest full response before it in the
order of (ts, record_id).  If its validators agree, it takes that response's payload,
and the response's headers updated by those of its own that a 304 may change.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textsieve.llm.staging import Staged, partitions
from textsieve.shipping import ensure

#: Headers that describe the stored payload or one connection, so a 304 doesn't update them.
FIXED_HEADERS = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without a leading www. and a default port, path without trailing slashes, and sorted parameters but utm_ ones; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#[\\s\\S]*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    base = F.regexp_extract(bare, "^[^?]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(base, "^[^/]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(base, "^[^/]*([\\s\\S]*)$", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, "^[^?]*\\??([\\s\\S]*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def resolve(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, verdict, refers_to, digest and headers of every record.

    records: record_id, url, ts, kind ('response', 'revisit' or 'damaged'), etag, last_modified, digest
    and headers, a map with lower-case names, and maybe status; other columns aren't read.  Responses
    with a status other than 200 to 299 are not referred to.  Records of one ts are in the order of
    record_id, digest and etag, and repeated rows give repeated rows.  verdict: 'damaged' for damaged
    ones, 'full' for responses and whatever else isn't a revisit; 'unresolved' for a revisit without an earlier response, or without
    a URL or ts; 'mismatch' if its etag (weakly compared), or without one its last_modified, isn't
    the response's; else 'resolved'.  A revisit without validators takes the latest response.  Only
    resolved revisits have refers_to; others keep their own headers and digest.

    Time is cut into ranges of about as many records each, so that a URL with a third of all
    records is many groups: each is searched by itself, and the last response of a range is
    carried to later ones, of which a URL has as many as there are ranges.
    """
    spark = records.sparkSession
    staged = Staged(spark)
    status = F.col("status") if "status" in records.columns else F.lit(None)
    ok = F.coalesce(status.cast("int").between(200, 299), F.lit(True))
    own = records.select("record_id", canonical_url(F.col("url").cast("string")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", "digest", "headers", ok.alias("ok"))
    own = staged.put(own.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>"))), "records")
    n = 2 * partitions(spark)
    cuts = own.agg(F.percentile_approx(F.col("ts").cast("double"), [k / n for k in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.col("ts").cast("double")
    chunk = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at)) if cuts else F.lit(0)
    answers = (F.col("kind") == "response") & F.col("ok")
    full = F.when(answers, F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    own = own.withColumn("chunk", chunk).withColumn("full", full)
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    place = F.struct("ts", "record_id", "digest", "etag")
    last = own.where(usable & answers).groupBy("canonical_url", "chunk").agg(F.max_by("full", place).alias("last"))
    # a row for each range of a URL, whether or not it has a response
    seen = own.where(usable).groupBy("canonical_url", "chunk").agg(F.count("*").alias("n")).join(last, ["canonical_url", "chunk"], "left")
    before = W.partitionBy("canonical_url").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = seen.select("canonical_url", "chunk", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = W.partitionBy("canonical_url", "chunk").orderBy("ts", "record_id", "digest", "etag").rowsBetween(W.unboundedPreceding, -1)
    near = own.where(usable).withColumn("near", F.last("full", ignorenulls=True).over(within)).join(carried, ["canonical_url", "chunk"], "left").withColumn("of", F.coalesce("near", "carried"))
    rows = near.drop("near", "carried").unionByName(own.where(~usable).withColumn("of", F.lit(None).cast(near.schema["of"].dataType)))
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    agrees = F.when(F.col("etag").isNotNull(), F.coalesce(strong(F.col("etag")) == strong(F.col("of.etag")), F.lit(False))).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("of.last_modified"), F.lit(False))).otherwise(True)
    verdict = F.when(F.col("kind") == "damaged", "damaged").when(F.coalesce(F.col("kind") != "revisit", F.lit(True)), "full").when(F.col("of").isNull(), "unresolved").when(agrees, "resolved").otherwise("mismatch")
    update = F.map_filter("headers", lambda k, v: ~k.isin(FIXED_HEADERS))
    merged = F.map_concat(F.map_filter("of.headers", lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    done = F.col("verdict") == "resolved"
    return rows.withColumn("verdict", verdict).select(
        "record_id",
        "canonical_url",
        "verdict",
        F.when(done, F.col("of.record_id")).alias("refers_to"),
        F.when(done, F.col("of.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(done, merged).otherwise(F.col("headers")).alias("headers"),
    )


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, compressed or not.

    A record whose length can't be read, or that the file ends in, and a stream that can't be
    decompressed any further, end the file with a record of type "damaged" with the headers found.
    """
    headers: dict[str, str] = {}
    try:
        stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers = {}
            while (line := stream.readline()) and line.strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = headers.get("content-length", "0")
            block = stream.read(int(size)) if size.isascii() and size.isdigit() else None
            if block is None or len(block) < int(size):
                yield {**headers, "warc-type": "damaged"}, b""
                return
            yield headers, block
            headers = {}
    except (EOFError, OSError, zlib.error):
        yield {**headers, "warc-type": "damaged"}, b""


def record_of(warc: dict[str, str], block: bytes) -> dict | None:
    """A row of read_warc() of a record; None for other types.  A status that isn't a number is null."""
    kind = warc.get("warc-type")
    if kind not in ("response", "revisit", "damaged"):
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    http = {}
    for line in lines:
        name, _, value = line.decode("latin-1").partition(":")
        http[name.strip().lower()] = value.strip()
    status = first.split(b" ")[1:2]
    full = kind == "response"
    return {
        "record_id": warc.get("warc-record-id"), "url": warc.get("warc-target-uri"), "ts": warc.get("warc-date"), "kind": kind,
        "status": int(status[0]) if status and status[0].isdigit() and len(status[0]) == 3 else None,
        "etag": http.get("etag"), "last_modified": http.get("last-modified"), "digest": hashlib.sha1(body).hexdigest() if full else None,
        "headers": list(http.items()), "payload": body if full else None,
    }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files in the form that resolve() takes, and the payload.

    A file is read by one task, and may have 2 GB at most, Spark's limit for a value.  A damaged file
    gives the records before the damage and one row of kind "damaged".  A date that isn't one is a
    null ts.  An empty file gives no rows.
    """
    ensure(spark)
    text = pa.string()
    schema = pa.schema([("record_id", text), ("url", text), ("ts", text), ("kind", text), ("status", pa.int32()), ("etag", text), ("last_modified", text), ("digest", text), ("headers", pa.map_(text, text)), ("payload", pa.binary())])

    def work(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for warc, block in parse_warc(data.as_py()):
                    if row := record_of(warc, block):
                        rows.append(row)
                        size += len(block)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    raw = spark.read.format("binaryFile").load(path).select("content")
    rows = raw.mapInArrow(work, "record_id string, url string, ts string, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, payload binary")
    return rows.withColumn("ts", F.try_to_timestamp("ts"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as records in the order of page_id: each third is a revisit that was sent the validator of an earlier state of its URL."""
    url = canonical_url(F.col("url"))
    revisit = F.col("page_id") % 3 == 1
    etag = F.concat(F.when(F.col("page_id") % 7 == 0, "W/").otherwise(""), F.lit('"'), F.substring(F.md5(url.cast("binary")), 1, 8), F.when(F.col("page_id") % 5 == 0, "-b").otherwise("-a"), F.lit('"'))
    both = [F.lit("etag"), etag, F.lit("date"), F.col("page_id").cast("string"), F.lit("content-length")]
    headers = F.when(revisit, F.create_map(*both, F.lit("0"), F.lit("cache-control"), F.lit("max-age=120"))).otherwise(F.create_map(*both, F.octet_length("html").cast("string"), F.lit("content-type"), F.lit("text/html")))
    digest = F.when(~revisit, F.sha1(F.col("html").cast("binary")))
    return pages.select(F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("ts"), F.when(revisit, "revisit").otherwise("response").alias("kind"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), digest.alias("digest"), headers.alias("headers"))


def page_report(pages: DataFrame) -> DataFrame:
    """page_id, canonical_url, verdict, refers_to, digest and headers, as one text, of every page; a null url is unresolved or full, a null page_id stays."""
    out = resolve(captures(pages))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";")
    return out.select(F.col("record_id").alias("page_id"), "canonical_url", "verdict", F.col("refers_to").alias("refers_to"), "digest", flat.alias("headers"))


ORACLE = """
WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#(.|\\n)*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare FROM pages),
b AS (SELECT page_id, html, regexp_extract(bare, '^[^?]*') AS base, list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\\??(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS q FROM a),
c AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(base, '^[^/]*')), '^www\\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(base, '^[^/]*(.*)$', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM b),
r AS (SELECT *, page_id % 3 = 1 AS revisit, substring(md5(canonical_url), 1, 8) || CASE WHEN page_id % 5 = 0 THEN '-b' ELSE '-a' END AS tag, CASE WHEN page_id % 7 = 0 THEN 'W/' ELSE '' END AS weak FROM c),
f AS (SELECT *, max(CASE WHEN NOT revisit THEN page_id END) OVER (PARTITION BY canonical_url ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM r),
j AS (SELECT f.*, CASE WHEN NOT f.revisit THEN 'full' WHEN s.page_id IS NULL THEN 'unresolved' WHEN f.tag = s.tag THEN 'resolved' ELSE 'mismatch' END AS verdict, s.page_id AS sid, s.html AS shtml FROM f LEFT JOIN r s ON s.page_id = f.o)
SELECT page_id, canonical_url, verdict, CASE WHEN verdict = 'resolved' THEN sid END AS refers_to,
  CASE WHEN verdict = 'resolved' THEN sha1(shtml) WHEN NOT revisit THEN sha1(html) END AS digest,
  CASE WHEN verdict = 'resolved' THEN 'cache-control=max-age=120;content-length=' || octet_length(encode(shtml)) || ';content-type=text/html;date=' || page_id || ';etag=' || weak || '"' || tag || '"'
       WHEN revisit THEN 'cache-control=max-age=120;content-length=0;date=' || page_id || ';etag=' || weak || '"' || tag || '"'
       ELSE 'content-length=' || octet_length(encode(html)) || ';content-type=text/html;date=' || page_id || ';etag=' || weak || '"' || tag || '"' END AS headers
FROM j
"""
