"""WARC revisits: each not-modified record is resolved to the full response it stands for.

An as-of join finds the latest earlier response of the same canonical url. Times are cut into ranges at
quantiles of all records; within a url and range a window carries the last response on, and the last
responses of the ranges, one row each, are carried on from range to range. So a url with a third of all
records is split over as many tasks as there are ranges.

Then validators decide: two entity tags must agree (weakly); else two dates of last modification; a
revisit without validators is taken as it is; one whose validator the response lacks is unverified. A
resolved record gets the response's headers, with those that a 304 may renew from the revisit.

Defined results: a null url, time or record id matches nothing (``no_response``); records of one time are in order of
their id; repeated revisits are each resolved; only responses with status 200 and type response count as full;
header names are compared in lower case, the last of a repeated name counts; null headers are
empty; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm._common import table
from lattiq.llm.url_filter import host_and_path

# Headers that a not-modified answer may renew (HTTP semantics), and parameters that track visits.
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = "^(?:utm_[a-z]+|ref|fbclid|gclid|msclkid)(?:=|$)"
#: Ranges that all times are cut into.
RANGES = 128

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def canonical_url(url: Column) -> Column:
    """Host without www. and default port, path without a closing slash, other than tracking parameters sorted; no scheme or fragment."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def lower_names(headers: Column) -> Column:
    """The headers with lower-case names; of one name the last."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(low, lambda e, k: ~F.exists(F.slice(low, k + 2, F.size(low)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, renewed by what a 304 may renew; names are in lower case."""
    renewed = F.map_filter(revisit, lambda k, v: k.isin(RENEWED) & v.isNotNull())
    return F.map_concat(F.map_filter(response, lambda k, _: ~F.map_contains_key(renewed, k)), renewed)


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolution(response: Column, headers: Column) -> Column:
    """no_response, resolved, mismatch or unverified."""
    tag, other = headers["etag"], response["headers"]["etag"]
    date, other_date = headers["last-modified"], response["headers"]["last-modified"]
    decide = lambda same: F.when(same, "resolved").otherwise("mismatch")
    return (
        F.when(response.isNull(), "no_response")
        .when(tag.isNotNull() & other.isNotNull(), decide(_opaque(tag) == _opaque(other)))
        .when(date.isNotNull() & other_date.isNotNull(), decide(F.trim(date) == F.trim(other_date)))
        .when(tag.isNull() & date.isNull(), "resolved")
        .otherwise("unverified")
    )


def resolve_revisits(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Each revisit of records(record_id, record_type, url, time, status, headers) with its response.

    Gives record_id, canonical_url, time, refers_to (the response's record_id), resolution and headers (merged if
    resolved, else the revisit's own).
    """
    kind = F.col("record_type")
    full = (kind == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    own = records.where((kind == "revisit") | full).select(
        "record_id",
        (kind == "revisit").alias("revisit"),
        canonical_url(F.col("url")).alias("canonical_url"),
        "time",
        lower_names(F.col("headers")).alias("headers"),
    )
    usable = F.col("canonical_url").isNotNull() & F.col("time").isNotNull() & F.col("record_id").isNotNull()
    joinable, alone = own.where(usable), own.where(F.col("revisit") & ~usable)
    cuts = joinable.agg(F.percentile_approx(F.col("time").cast("double"), [k / ranges for k in range(1, ranges)], 10_000)).first()[0]
    edges = F.array(*[F.lit(x) for x in sorted(set(cuts or []))]).cast("array<double>")
    placed = joinable.withColumn("part", F.size(F.filter(edges, lambda x: x < F.col("time").cast("double"))))
    answer = F.struct("record_id", "time", "headers")
    response = F.when(~F.col("revisit"), answer)
    order = [F.col("time").asc(), F.col("record_id").asc()]
    inside = Window.partitionBy("canonical_url", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("revisit")
    lasts = placed.where("NOT revisit").groupBy("canonical_url", "part").agg(F.max_by(answer, F.struct("time", "record_id")).alias("ahead"))
    # a row for each url and range that holds anything; what came last in earlier ranges is carried on
    spans = placed.where("revisit").select("canonical_url", "part").distinct().join(lasts, ["canonical_url", "part"], "full")
    before = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("canonical_url", "part", F.last("ahead", ignorenulls=True).over(before).alias("far"))
    joined = near.join(carried, ["canonical_url", "part"], "left").withColumn("found", F.coalesce("near", "far"))
    decided = joined.withColumn("resolution", resolution(F.col("found"), F.col("headers")))
    merged = F.when(F.col("resolution") == "resolved", merge_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers"))
    result = decided.select("record_id", "canonical_url", "time", F.col("found.record_id").alias("refers_to"), "resolution", merged.alias("headers"))
    nothing = alone.select(
        "record_id", "canonical_url", "time", F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"), F.lit("no_response").alias("resolution"), "headers"
    )
    return result.unionByName(nothing)


def parse_warc(data: bytes) -> Iterator[tuple]:
    """The records of a WARC file, gzipped as a whole or by record; a broken tail ends it."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    while True:
        try:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line.startswith(b"WARC/"):
                return
            names = _header_lines(stream)
            body = stream.read(int(names.get("content-length") or 0))
        except (EOFError, OSError, ValueError):
            return
        status, headers, payload = None, {}, body
        if names.get("content-type", "").startswith("application/http") and body[:5] == b"HTTP/":
            inner = io.BufferedReader(io.BytesIO(body))
            first = inner.readline().split()
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            headers, payload = _header_lines(inner), inner.read()
        yield (names.get("warc-record-id"), names.get("warc-type"), names.get("warc-target-uri"), names.get("warc-date"), status, headers, payload)


def _header_lines(stream: io.BufferedReader) -> dict[str, str]:
    found: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files under a path (RECORD's columns); Spark reads the files."""
    files = spark.read.format("binaryFile").load(path).select("content")
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name == "time" else f.dataType) for f in RECORD.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(raw)
        for batch in batches:
            for content in batch.column("content"):
                for record in parse_warc(content.as_py() or b""):
                    arrays = [pa.array([list(v.items()) if isinstance(v, dict) else v], f.type) for v, f in zip(record, schema)]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return files.mapInArrow(run, raw).withColumn("time", F.try_to_timestamp("time"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Capture records of pages(page_id, url, html): a response and two revisits each, by rule, of the url up to the last slash of its path, so that pages
    of one folder are captures of one url over time.

    The first revisit has the page's entity tag (every fifth a stale one) and comes just after the response (every ninth
    before it); the second, of an http url with a port, comes later and has no validators.
    """
    n = F.col("page_id")
    tag = F.concat(F.lit('"'), F.left(F.md5("html"), F.lit(8)), F.lit('"'))
    text = lambda c: c.cast("string")
    headers = lambda **own: F.map_from_entries(F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in own.items()]))
    time = n * 10
    seen = time + F.when(n % 9 == 0, -5).otherwise(5)
    later = time + 7000
    other = F.regexp_replace(F.col("url"), "^https?://([^/?#]*)", "http://$1:80")
    record = lambda k, kind, url, at, status, own: F.struct(
        (n * 4 + k).alias("record_id"), F.lit(kind).alias("record_type"), url.alias("url"), at.alias("time"), F.lit(status).alias("status"), own.alias("headers")
    )
    each = F.array(
        record(0, "response", F.col("url"), time, 200, headers(Content_Type=F.lit("text/html"), ETag=tag, Date=text(time), X_Cache=F.lit("miss"))),
        record(1, "revisit", F.col("url"), seen, 304, headers(ETag=F.when(n % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag)), Date=text(seen), Cache_Control=F.concat(F.lit("max-age="), text(n % 100)), X_Cache=F.lit("hit"))),
        record(2, "revisit", other, later, 304, headers(Date=text(later), X_Cache=F.lit("hit"))),
    )
    folders = pages.withColumn("url", F.regexp_extract("url", "^[^?#]*/", 0))
    return folders.select(F.explode(each).alias("r")).select("r.*")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the captures of all pages."""
    records = page_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = resolve_revisits(records)
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return found.select("record_id", "canonical_url", "time", "refers_to", "resolution", F.array_join(lines, ";").alias("headers"))


ORACLE = r"""
WITH p AS (SELECT page_id AS n, regexp_extract(url, '^[^?#]*/') AS url, '"' || substr(md5(html), 1, 8) || '"' AS tag, page_id * 10 AS t FROM pages),
r AS (
 SELECT n * 4 AS record_id, false AS rev, url, t AS time, tag, t AS d, CAST(NULL AS BIGINT) AS age FROM p
 UNION ALL SELECT n * 4 + 1, true, url, t + CASE WHEN n % 9 = 0 THEN -5 ELSE 5 END, CASE WHEN n % 5 = 0 THEN '"stale"' ELSE 'W/' || tag END,
   t + CASE WHEN n % 9 = 0 THEN -5 ELSE 5 END, n % 100 FROM p
 UNION ALL SELECT n * 4 + 2, true, regexp_replace(url, '^https?://([^/?#]*)', 'http://\1:80'), t + 7000, NULL, t + 7000, NULL FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '') AS host,
   regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
   list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|msclkid)(=|$)'))) AS q FROM r),
k AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM c),
j AS (SELECT v.record_id, v.canonical_url, v.time, v.tag, v.d, v.age, f.record_id AS fid, f.tag AS ftag,
   row_number() OVER (PARTITION BY v.record_id ORDER BY f.time DESC NULLS LAST, f.record_id DESC) AS o
   FROM k v LEFT JOIN k f ON f.canonical_url = v.canonical_url AND NOT f.rev AND (f.time < v.time OR (f.time = v.time AND f.record_id < v.record_id)) WHERE v.rev),
x AS (SELECT *, CASE WHEN fid IS NULL THEN 'no_response' WHEN tag IS NULL THEN 'resolved' WHEN replace(tag, 'W/', '') = ftag THEN 'resolved' ELSE 'mismatch' END AS resolution FROM j WHERE o = 1)
SELECT record_id, canonical_url, time, fid AS refers_to, resolution,
  CASE WHEN resolution = 'resolved' THEN coalesce('cache-control=max-age=' || age || ';', '') || 'content-type=text/html;date=' || d || ';etag=' || coalesce(tag, ftag) || ';x-cache=miss'
  ELSE coalesce('cache-control=max-age=' || age || ';', '') || 'date=' || d || coalesce(';etag=' || tag, '') || ';x-cache=hit' END AS headers
FROM x
"""
