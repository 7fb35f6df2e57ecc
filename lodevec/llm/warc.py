"""WARC: captures, and revisits that a server answered with "not modified".

A revisit record of the not-modified profile holds only a status line and some headers. It's resolved by
an as-of join: among the full responses of the same canonical URL, the latest one that is earlier. The
validators must agree: the entity tag by weak comparison if the revisit has one, else the date of last
modification. The stored headers are then updated with those of the revisit, but for the ones that
describe the body that the revisit doesn't have.

The as-of join is one window over URL and time (one shuffle of full responses and revisits without their
bodies, sorted, so that memory doesn't grow with a URL's captures); a response keeps its own body without a
shuffle, and bodies are joined to the resolved revisits alone.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec.runtime import read_table

#: Headers that a not-modified answer may not replace: they belong to the stored body or to the connection.
KEPT = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that don't tell pages apart.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid|phpsessid|sid)(=|$)"
PROFILE = "server-not-modified"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, "www." and standard port; no fragment, tracking parameters or
    final slash; the other parameters in order. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*[?](.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of repeated names the last counts."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.transform(pairs, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def _tag(headers: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(headers["etag"]), "^[Ww]/", ""), F.lit(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each record: record_id, kind, url, canonical, captured, outcome, source_id, source_captured, headers, body.

    ``records``: record_id, kind ("response" or "revisit"), url, captured (timestamp), status (int), profile,
    headers (map), body. A full response has the kind response and the status 200. ``outcome`` is

    * ``full``: the record is such a response; source_id is its own id;
    * ``resolved``: a not-modified revisit with agreeing validators; headers are merged, the body is the source's;
    * ``mismatch``: the latest earlier response has other validators, or there is none to compare;
    * ``missing``: no earlier response of that URL, or the record has no URL or time;
    * ``other``: any other record (another status, kind or profile).

    Only strictly earlier responses count; of several at the same time the one of the greatest id. Header
    names are compared in lower case and null headers are none. Repeated record_ids each give a row, with
    their own bodies; a revisit takes the greatest body of its source's id. Rows with a null record_id are
    sources of none. Bodies may be text or binary, of any length, and are empty or null as they were stored.
    An empty table gives an empty result; other columns of any name are neither read nor returned.
    """
    names = ("record_id", "kind", "url", "canonical", "captured")
    r = records.select("record_id", "kind", "url", canonical_url(F.col("url")).alias("canonical"), "captured", "status", "profile", _lower_keys(F.col("headers")).alias("headers"), "body")
    r = r.withColumn("is_full", F.coalesce((F.col("kind") == "response") & (F.col("status") == 200) & F.col("canonical").isNotNull() & F.col("captured").isNotNull() & F.col("record_id").isNotNull(), F.lit(False)))
    r = r.withColumn("is_revisit", F.coalesce((F.col("kind") == "revisit") & (F.lower("profile").contains(PROFILE)), F.lit(False)))
    placed = F.col("canonical").isNotNull() & F.col("captured").isNotNull()
    # what needs no source is told by the record alone
    alone = r.where(~F.col("is_revisit") | ~placed)
    full = F.col("is_full")
    outcome = F.when(full, "full").when(F.col("is_revisit"), "missing").otherwise("other")
    alone = alone.select(*names, outcome.alias("outcome"), F.when(full, F.col("record_id")).alias("source_id"), F.when(full, F.col("captured")).alias("source_captured"), "headers", F.when(full, F.col("body")).alias("body"))

    source = F.when(full, F.struct(F.col("record_id").alias("id"), F.col("captured").alias("at"), F.col("headers")))
    order = Window.partitionBy("canonical").orderBy("captured", "is_full", "record_id")
    asked = r.where(full | (F.col("is_revisit") & placed)).drop("body").withColumn("source", F.last(source, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    asked = asked.where("is_revisit")
    src = F.col("source")
    stored, own = src["headers"], F.col("headers")
    agree = F.when(_tag(own).isNotNull(), _tag(own) == _tag(stored)).otherwise(own["last-modified"] == stored["last-modified"])
    asked = asked.withColumn("outcome", F.when(src.isNull(), "missing").when(F.coalesce(agree, F.lit(False)), "resolved").otherwise("mismatch"))
    fresh = F.map_filter(own, lambda k, v: ~k.isin(*KEPT))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    done = F.col("outcome") == "resolved"
    asked = asked.select(*names, "outcome", F.when(done, src["id"]).alias("source_id"), F.when(done, src["at"]).alias("source_captured"), F.when(done, merged).otherwise(own).alias("headers"))
    stored_ones = records.where((F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull())
    bodies = stored_ones.groupBy(F.col("record_id").alias("__source")).agg(F.max("body").alias("body"))
    found = asked.join(bodies, asked["source_id"] == bodies["__source"], "left").drop("__source")
    return alone.unionByName(found)


class _Members(io.RawIOBase):
    """The bytes of a file of gzip members one after another, or of a plain one; what is damaged or cut off ends it."""

    def __init__(self, file):
        self.file, self.left, self.member = file, b"", None
        self.head = file.read(2)
        self.packed = self.head == b"\x1f\x8b"

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left:
            raw, self.head = self.head + self.file.read(1 << 16), b""
            if not raw and not (self.member and self.member.unused_data):
                return 0
            if not self.packed:
                self.left = raw
                continue
            if self.member is None or self.member.eof:
                raw = (self.member.unused_data if self.member else b"") + raw
                raw = raw.lstrip(b"\0")  # fill between members
                if not raw:
                    continue
                self.member = zlib.decompressobj(31)
            try:
                self.left = self.member.decompress(raw)
            except zlib.error:
                return 0
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def parse_records(data) -> Iterator[dict]:
    """The records of a WARC file (bytes or a binary file object), plain or gzipped by record or as a whole.

    The file is read as a stream; a record at a time is held. What isn't a record is skipped up to the next
    line that begins one: a record without a length, or whose length isn't a number, is left out, and so is
    one that the file's end cuts off. Bodies are bytes as they are stored, empty ones included.
    """
    file = io.BufferedReader(_Members(io.BytesIO(data) if isinstance(data, bytes) else data), 1 << 16)
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines = []
        while (line := file.readline()) and line.strip():
            lines.append(line.rstrip(b"\r\n"))
        head = _headers(lines)
        size = head.get("content-length", "")
        if not size.isdecimal():
            continue
        block = file.read(int(size))
        if len(block) < int(size):
            return
        status, http, body = None, {}, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            first, *rest = top.split(b"\r\n")
            parts = first.split()
            status = int(parts[1]) if len(parts) > 1 and re.fullmatch(rb"[0-9]{1,9}", parts[1]) else None
            http = _headers(rest)
        yield {"record_id": head.get("warc-record-id"), "kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "status": status, "profile": head.get("warc-profile"), "headers": list(http.items()), "body": body}


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (*.warc, *.warc.gz) as ``resolve_revisits`` takes them, with binary bodies.

    Only the files' names go through the plan: each is one task's, which opens it where it lies (any file
    system that Arrow knows) and reads it as a stream, so that neither a file nor what it unpacks to is held.
    """
    kind = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("profile", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])

    def parse(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with system.open_input_stream(at, compression=None) as file:
                    rows, held = [], 0
                    for record in parse_records(file):
                        rows.append(record)
                        held += len(record["body"])
                        if len(rows) == 256 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").load(path).select("path")
    files = files.repartition(max(1, min(files.count(), 20_000)))
    rows = files.mapInArrow(parse, "record_id string, kind string, url string, date string, status int, profile string, headers map<string,string>, body binary")
    return rows.withColumn("captured", F.try_to_timestamp("date")).drop("date")


def page_records(pages: DataFrame) -> DataFrame:
    """Captures made of the table of pages, which holds no headers: each page is fetched and asked for again.

    A page's times, validators and answers follow from its id by arithmetic: the first fetch is a full
    response (one in seven answers 404), the second says "not modified", with an entity tag, with a weak
    one, with a date only, or with a tag that is outdated.
    """
    n = F.col("page_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(start) + s)
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    changed = F.concat(F.lit("day "), n % 28 + 1)
    first = pages.select(
        (n * 2).alias("record_id"), F.lit("response").alias("kind"), "url", at(n % 1000 * 60).alias("captured"), F.when(n % 7 == 3, 404).otherwise(200).alias("status"), F.lit(None).cast("string").alias("profile"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("ETag"), tag, F.lit("Last-Modified"), changed, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), F.col("html").alias("body"),
    )
    empty = F.create_map().cast("map<string,string>")
    validators = F.when(n % 5 == 0, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))).when(n % 5 == 1, F.create_map(F.lit("last-modified"), changed)).when(n % 5 == 2, F.create_map(F.lit("etag"), F.lit('"old"'))).otherwise(F.create_map(F.lit("ETag"), tag))
    second = pages.select(
        (n * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", at(n % 1000 * 60 + n % 3 * 86400).alias("captured"), F.lit(304).alias("status"), F.lit("http://netpreserve.org/warc/1.1/revisit/server-not-modified").alias("profile"),
        F.map_concat(F.coalesce(validators, empty), F.create_map(F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), F.concat(F.lit("day "), n % 3))).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return first.unionByName(second)


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """All captures of the pages, revisits resolved; headers as "name: value" lines in order, times as text."""
    out = resolve_revisits(page_records(read_table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("record_id", "kind", "url", "canonical", text("captured"), "outcome", "source_id", text("source_captured"), lines.alias("headers"), "body")


_BARE = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_HOST = f"regexp_replace(regexp_replace(lower(regexp_extract({_BARE}, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '')"
_PATH = f"regexp_replace(regexp_extract({_BARE}, '^[^/?]*([^?]*)', 1), '/+$', '')"
_QUERY = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({_BARE}, '^[^?]*[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{TRACKING}'))), '&')"
OP7_SQL = f"""
WITH k AS (SELECT page_id AS n, url, html, {_HOST} || {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS canonical, '"' || md5(html) || '"' AS tag, 'day ' || (page_id % 28 + 1) AS changed FROM pages),
responses AS (SELECT n * 2 AS record_id, n, url, canonical, TIMESTAMP '2024-01-01' + to_seconds(n % 1000 * 60) AS taken, n % 7 <> 3 AS good, tag, changed, html FROM k),
full_ones AS (SELECT canonical, taken, arg_max(record_id, record_id) AS id, arg_max(tag, record_id) AS tag, arg_max(changed, record_id) AS changed, arg_max(html, record_id) AS html FROM responses WHERE good AND canonical IS NOT NULL GROUP BY 1, 2),
revisits AS (SELECT n * 2 + 1 AS record_id, n, url, canonical, TIMESTAMP '2024-01-01' + to_seconds(n % 1000 * 60 + n % 3 * 86400) AS taken,
  CASE n % 5 WHEN 0 THEN tag WHEN 1 THEN NULL WHEN 2 THEN '"old"' ELSE tag END AS etag, CASE n % 5 WHEN 1 THEN changed END AS modified,
  CASE n % 5 WHEN 0 THEN 'W/' || tag WHEN 2 THEN '"old"' WHEN 1 THEN NULL ELSE tag END AS raw_tag FROM k),
met AS (SELECT r.*, f.id, f.taken AS source_at, f.tag, f.changed, f.html,
  CASE WHEN f.id IS NULL THEN 'missing' WHEN CASE WHEN r.etag IS NOT NULL THEN r.etag = f.tag ELSE r.modified = f.changed END THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM revisits r ASOF LEFT JOIN full_ones f ON r.canonical = f.canonical AND r.taken > f.taken)
SELECT record_id, 'response' AS kind, url, canonical, strftime(taken, '%Y-%m-%d %H:%M:%S') AS captured, CASE WHEN good THEN 'full' ELSE 'other' END AS outcome,
  CASE WHEN good THEN record_id END AS source_id, CASE WHEN good THEN strftime(taken, '%Y-%m-%d %H:%M:%S') END AS source_captured,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || length(html) || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || tag || chr(10) || 'last-modified: ' || changed AS headers,
  CASE WHEN good THEN html END AS body FROM responses
UNION ALL
SELECT record_id, 'revisit', url, canonical, strftime(taken, '%Y-%m-%d %H:%M:%S'), outcome, CASE WHEN outcome = 'resolved' THEN id END, CASE WHEN outcome = 'resolved' THEN strftime(source_at, '%Y-%m-%d %H:%M:%S') END,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || length(html) || chr(10) || 'content-type: text/html' || chr(10) || 'date: day ' || (n % 3) || chr(10) || 'etag: ' || tag || chr(10) || 'last-modified: ' || coalesce(modified, changed)
  ELSE 'cache-control: max-age=600' || chr(10) || 'content-length: 0' || chr(10) || 'date: day ' || (n % 3) || coalesce(chr(10) || 'etag: ' || raw_tag, '') || coalesce(chr(10) || 'last-modified: ' || modified, '') END,
  CASE WHEN outcome = 'resolved' THEN html END FROM met"""
