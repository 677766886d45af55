"""Operator 8: WARC archives of pages, read back and merged into capture histories.

Archives are text files whose records end as WARC records do, compressed, written by Spark's own writer
to any store.  A payload of at least ``MIN_REVISIT`` bytes that other pages have too is stored once, with
the smallest id; the others are revisit records that refer to it and keep the HTTP header, with the
payload's length.

Reading back, a task sorts the captures of its archives by URL key and time: one run.  Runs are cut into
ranges of the key space (time, id and place included, so that a much captured URL is cut too), and each
range merges its parts of all runs with a loser tree.  Ranges follow each other, so that their rows are
one global order; ``capture_no`` is a capture's place in the history of its URL key.

Cases: null html is an empty payload; a null URL is left out and its key is empty; null ids count as
larger than any other and are never referred to, unless no page has one: then all are responses; rows that
share the smallest id are all responses; line breaks in a URL are percent-encoded; an empty table gives an
empty result; other columns are ignored.  A payload whose digest differs from its record's is an error.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventbook.session import cut_lineage, run_folder

MIN_REVISIT = 100
#: Records of an archive file, and captures that one task merges.
FILE_RECORDS, RANGE_ROWS = 2_000, 200_000
END = "\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Tables without capture times: seconds after this moment, by id.
FIRST_CAPTURE = "2024-01-01 00:00:00"

CAPTURE = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("url_key", pa.string()), ("captured_at", pa.string()), ("file", pa.string()), ("place", pa.int64()),
])
CAPTURE_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string, file string, place long"


def capture_time(page_id: Column) -> Column:
    """A stand-in for the time of capture, as text."""
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**9))
    moment = F.lit(FIRST_CAPTURE).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame) -> DataFrame:
    """``value``: one WARC record for each row of ``page_id, url, html``."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    same = base.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that the planner knows how small it is before html is moved.
    same = cut_lineage(same.where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    known = base.join(same, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes"), F.lit(END + END))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"{END}WARC-Date: "), capture_time(F.col("page_id")),
        F.coalesce(F.concat(F.lit(f"{END}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{END}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Refers-To: "), name(F.col("first")), F.lit(f"{END}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "),
        F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes")), F.lit(END + END),
    )
    return known.select(F.concat(lines, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    out = records(pages).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS)
    out.text(folder)


def header_of(stream: io.BufferedIOBase) -> dict[str, str]:
    """The header fields up to the empty line, names in lower case; the first line under an empty name."""
    fields: dict[str, str] = {}
    while True:
        line = stream.readline()
        if not line:
            raise ValueError("a record ends within its header")
        line = line.rstrip(b"\r\n").decode()
        if not line:
            return fields
        name, _, value = line.partition(": ") if fields else ("", "", line)
        fields[name.lower()] = value


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Number, header and block of each record; one block is held at a time."""
    number = 0
    while stream.peek(1):
        header = header_of(stream)
        if not header[""].startswith("WARC/"):
            raise ValueError(f"no record begins with {header['']!r}")
        block = stream.read(int(header["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield number, header, block
        number += 1


_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)")


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then path and query; other texts as they are."""
    found = _URL.match(url)
    if not found:
        return url
    host = re.sub(r":(80|443)$", "", re.sub(r"^www\.", "", found[1].lower()))
    return ",".join(reversed(host.split("."))) + ")" + (found[2] or "/")


def page_of(name: str | None) -> int | None:
    number = name[len("<urn:page:") : -1] if name else "null"
    return None if number == "null" else int(number)


def captures(file: str, content: bytes) -> Iterator[tuple]:
    """The captures of an archive file, payloads checked against their digests."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as unpacked, io.BufferedReader(unpacked) as stream:
        for number, header, block in read_records(stream):
            body = io.BytesIO(block)
            http = header_of(body)
            digest = header["warc-payload-digest"].removeprefix("sha256:")
            size = int(http["content-length"])
            if header["warc-type"] == "response":
                payload = block[body.tell() :]
                if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{file}: the payload of {header['warc-record-id']} is damaged")
            key = url_key(header.get("warc-target-uri", ""))
            yield page_of(header["warc-record-id"]), size, digest, header["warc-type"], page_of(header.get("warc-refers-to")), key, header["warc-date"], file, number


def order_of(c: tuple) -> tuple:
    """URL key, time, id (null last), place."""
    return c[5].encode(), c[6], c[0] is None, c[0] or 0, c[7], c[8]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(CAPTURE.names, r, strict=True)) for r in rows], CAPTURE)


def read_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run from the archive files of a task."""
    rows = []
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows += captures(path.as_py().rpartition("/")[2], content.as_py())
    rows.sort(key=order_of)
    run = TaskContext.get().partitionId()
    for i in range(0, len(rows), 10_000):
        batch = batch_of(rows[i : i + 10_000])
        yield batch.append_column("run", pa.array([run] * len(batch), pa.int32()))


class LoserTree:
    """Merges sorted sequences; an inner place holds the loser of the match played there."""

    def __init__(self, sequences: list[Iterable[tuple]], key):
        self.key, self.sources = key, [iter(s) for s in sequences]
        self.heads: list[tuple | None] = [None] * len(self.sources)
        self.keys: list = [None] * len(self.sources)
        for i in range(len(self.sources)):
            self.advance(i)
        self.losers = [-1] * max(1, len(self.sources))
        for i in range(len(self.sources)):
            self.play(i)

    def advance(self, i: int) -> None:
        self.heads[i] = next(self.sources[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def beats(self, i: int, j: int) -> bool:
        """Whether source i goes before source j; ended sources go last."""
        if self.keys[i] is None or self.keys[j] is None:
            return self.keys[i] is not None
        return (self.keys[i], i) < (self.keys[j], j)

    def play(self, i: int) -> None:
        """Carry source i up to the root; at an empty place it waits for its opponent."""
        winner, at = i, (i + len(self.sources)) // 2
        while at:
            other = self.losers[at]
            if other < 0:
                self.losers[at] = winner
                return
            if self.beats(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.sources and self.heads[self.losers[0]] is not None:
            first = self.losers[0]
            yield self.heads[first]
            self.advance(first)
            self.play(first)


def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a range's runs (rows come run by run) and number the captures of each URL key."""
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        for run, row in zip(batch.column("run").to_pylist(), zip(*(batch.column(n).to_pylist() for n in CAPTURE.names), strict=True), strict=True):
            runs.setdefault(run, []).append(row)
    number, last, rows, numbers = 0, None, [], []
    range_no = TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        batch = batch_of(rows).append_column("number", pa.array(numbers, pa.int64()))
        return batch.append_column("range_no", pa.array([range_no] * len(rows), pa.int32()))

    for row in LoserTree(list(runs.values()), order_of):
        number = number + 1 if row[5] == last else 1
        last = row[5]
        rows.append(row)
        numbers.append(number)
        if len(rows) == 10_000:
            yield out()
            rows, numbers = [], []
    if rows:
        yield out()


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of the archives in a folder in global order (``range_no``, then the rows' order)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    runs = cut_lineage(files.mapInArrow(read_run, CAPTURE_DDL + ", run int"))
    order = [F.encode("url_key", "UTF-8"), F.col("captured_at"), F.col("page_id").isNull(), F.col("page_id"), F.col("file"), F.col("place")]
    dealt = runs.repartitionByRange(max(1, math.ceil(runs.count() / RANGE_ROWS)), *order).sortWithinPartitions("run", *order)
    merged = cut_lineage(dealt.mapInArrow(merge_range, CAPTURE_DDL + ", number long, range_no int"))
    # A URL key that goes over several ranges counts on from the ranges before.
    counts = merged.groupBy("url_key", "range_no").agg(F.count("*").alias("n"))
    before = Window.partitionBy("url_key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("url_key", "range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")).where("begin > 0")
    numbered = merged.join(cut_lineage(begins), ["url_key", "range_no"], "left")
    return numbered.withColumn("capture_no", F.col("number") + F.coalesce("begin", F.lit(0))).drop("begin", "number")


def archive(pages: DataFrame) -> DataFrame:
    """Write archives of the pages to the shared folder, read them back and return their histories."""
    folder = run_folder(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return histories(pages.sparkSession, folder)


#: For DuckDB.
ORACLE = r"""
WITH base AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM {pages}
), keyed AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_,
         replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS u
  FROM base
), parts AS (
  SELECT *, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)', 1)) AS host,
         regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)', 2) AS rest,
         payload_bytes >= 100 AND first_ IS NOT NULL AND page_id IS DISTINCT FROM first_ AS revisit
  FROM keyed
), named AS (
  SELECT *, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
    array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', ''), '.')), ',')
    || ')' || coalesce(nullif(rest, ''), '/') ELSE u END AS url_key
  FROM parts
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first_ END AS refers_to,
       row_number() OVER (PARTITION BY url_key ORDER BY ((coalesce(page_id, 0) % 1000000000) + 1000000000) % 1000000000, page_id NULLS LAST)::BIGINT AS capture_no
FROM named
"""
