"""WARC archives: writing, reading back, and an index in order of URL and time.

Records are made by Spark: of equal payloads of at least ``REVISIT_BYTES`` bytes one is a response and the others
are revisits that refer to it. Archives are written to the shared folder, each record as a gzip member of its own, and
read back as bytes by their content lengths. The index has the first byte of a capture's member in its archive, so a
record can be read from its place. Archives of others are read the same way, whatever their members hold.

The capture index is an external merge. Each archive gives one run: its captures, sorted by URL key, time
and page, with their places in the run. Spark samples the keys of all runs and cuts the key space into ranges, and so
each run into segments. A range's segments, put in the order of their places again, are merged by a loser tree, k
ways at once, in one task. Ranges follow each other, so the merged runs are capture histories in global order.
Ranges are of the whole key, archive and place included, so a URL with very many captures, or one capture
that stands there very often, is cut as well.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scribeprint.llm.scratch import folder, importable, map_rows, written

REVISIT_BYTES = 100
#: Most records of one archive, and the payload bytes it is meant to hold: what a task reads at once.
RECORDS = 2_000
ARCHIVE_BYTES = 64 << 20
#: Captures of one range of the index, about: what a merging task holds.
RANGE_CAPTURES = 20_000
#: Second 0 of pages that come without a time; a page's own time is so many seconds later as its id says.
START = datetime(2020, 1, 1, tzinfo=timezone.utc)
END_MARK = "\r\n\r\n"
#: Payloads that are archived alone.
LONG_BYTES = 256 << 10
#: Bytes of an archive that are unpacked at a time, and of members that are handed on together.
READ_BYTES, WRITE_BYTES = 4 << 10, 1 << 20
#: A gzip member of no bytes.
_NO_RECORD = gzip.compress(b"", mtime=0)

CAPTURE = ("url_key string, time string, page_id long, url string, record_type string, payload_bytes long, "
           "payload_digest string, refers_to long, archive string, offset long, within long")


def url_key(url: str | None) -> str:
    """Sortable key: host parts from the top, then path and query; scheme, ``www.``, port and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host, query = (parts.hostname or ""), parts.query
        path = parts.path
    except ValueError:  # not a URL; its own text is the key
        return (url or "").lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (path or "/").lower() + (f"?{query.lower()}" if query else "")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``: one row a page.

    Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the smallest id is a response and
    the others revisit it. Rows of equal id and payload are all what the first is. A null id is only a
    response if no other page has the payload. A null payload is empty, and shorter ones are always responses.
    """
    own = F.coalesce(F.col(html), F.lit(""))
    told = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), own.alias("payload"),
                        F.octet_length(own).cast("long").alias("payload_bytes"),
                        F.sha2(own, 256).alias("payload_digest"))
    # Written: of a join of two tables Spark splits a hot key, of one with sums it does not.
    first = (told.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(F.col("payload_digest").alias("digest_"))
             .agg(F.min("page_id").alias("first_"), F.count(F.lit(1)).alias("n_"))
             .filter((F.col("n_") > 1) & F.col("first_").isNotNull()))
    first = written(first.select("digest_", "first_"), "warc-firsts")
    joined = told.join(first, told["payload_digest"] == first["digest_"], "left")
    again = F.col("first_").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first_")).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    """A header line; none without a value. Line breaks in values would end the line, so they are spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]", " "),
                               F.lit("\r\n")), F.lit(""))


def record_text() -> Column:
    """A WARC record of a row of ``records``, without its end mark."""
    id_ = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    time = F.date_format(F.timestamp_seconds(F.lit(int(START.timestamp())) + F.coalesce("page_id", F.lit(0))),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), id_, F.lit(">"))), _header("WARC-Date", time),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
            _header("X-Payload-Length", F.col("payload_bytes")))).otherwise(""),
        _header("Content-Type", F.lit("text/html")), _header("Content-Length", F.octet_length(body)),
        F.lit("\r\n"), body)


def archive_sizes(pages: DataFrame, html: str = "html") -> tuple[int, int]:
    """Records of an archive, so that it has about ``ARCHIVE_BYTES`` by the mean payload; and the longest payload."""
    size = F.coalesce(F.octet_length(html), F.lit(0))
    mean, most = pages.agg(F.avg(size), F.max(size)).first()
    return max(1, min(RECORDS, int(ARCHIVE_BYTES / max(mean or 0, 1)))), most or 0


def _zipped(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Input: records. Output: a gzip member for each."""
    held, size = [], 0

    def closed():
        nonlocal held, size
        rows, held, size = held, [], 0
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], schema=schema)

    for batch in batches:
        for record in batch.column(0):
            member = zlib.compressobj(wbits=31)
            held.append(member.compress(record.as_buffer()) + member.compress(END_MARK.encode()) + member.flush())
            size += len(held[-1])
            if size >= WRITE_BYTES:
                yield closed()
    if held:
        yield closed()


def write_archives(recorded: DataFrame, path: str, n_records: int = RECORDS, longest: int = 0) -> list[str]:
    """Archives of at most ``n_records`` records, as gzip files with a member for each record; the folders they are in.

    What Spark's writer puts between rows is an empty member. Payloads beyond ``LONG_BYTES`` (if the ``longest`` one is)
    have archives of their own, so that none grows beyond what can be read at once.
    """
    parts = [(path, recorded, n_records)]
    if longest > LONG_BYTES:
        is_long = F.col("payload_bytes") > LONG_BYTES
        parts = [(path, recorded.filter(~is_long), n_records), (f"{path}-long", recorded.filter(is_long), 1)]
    for folder_, rows, most in parts:
        zipped = map_rows(rows.select(record_text().alias("record")), _zipped, StructType.fromDDL("member binary"))
        (zipped.select(F.col("member").cast("string")).write.option("lineSep", _NO_RECORD.decode("latin-1"))
         .option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", most).text(folder_))
    return [p[0] for p in parts]


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers and payload of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        yield at, headers, data[begin:end]
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        at = end + 4


def _page(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def _records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """First byte of the member, place in it, headers and payload of every record of an archive."""
    for begin, content in members(data):
        for at, headers, payload in parse(content):
            yield begin, at, headers, payload


def read_record(data: bytes, offset: int, place: int = 0) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record at ``offset`` and ``place`` of an index; nothing before it is unpacked."""
    _, content = next(members(data[offset:]))
    _, headers, payload = next(parse(content[place:]))
    return headers, payload


def _captures(name: str, data: bytes) -> list[dict]:
    """The run of an archive: its captures in order."""
    out = []
    for begin, at, headers, payload in _records(data):
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        response = headers["WARC-Type"] == "response"
        if response and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload and digest differ in {name} at byte {begin}, {at}")
        url = headers.get("WARC-Target-URI")
        out.append({
            "url_key": url_key(url), "time": headers["WARC-Date"], "page_id": _page(headers["WARC-Record-ID"]),
            "url": url, "record_type": headers["WARC-Type"],
            "payload_bytes": len(payload) if response else int(headers["X-Payload-Length"]),
            "payload_digest": digest, "refers_to": None if response else _page(headers["WARC-Refers-To"]),
            "archive": name, "offset": begin, "within": at})
    out.sort(key=order)
    return out


def order(capture: dict) -> tuple:
    page = capture["page_id"]
    return capture["url_key"], capture["time"], page is not None, page or 0, capture["archive"], capture["offset"], capture["within"]


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The gzip members of an archive, each with its first byte in the file; a plain archive is one.

    Archives commonly have a member for each record, so that a record can be read from its place; others are one member.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at:at + 2] != b"\x1f\x8b":
            if at and not data[at:].strip(b"\0"):  # padding behind the last member
                return
            yield at, data[at:]
            return
        member, parts, end = zlib.decompressobj(wbits=31), [], at
        while not member.eof and end < len(data):  # what is read too far is handed back, so it is kept short
            parts.append(member.decompress(view[end:end + READ_BYTES]))
            end = min(end + READ_BYTES, len(data))
        if not member.eof:
            raise ValueError(f"the gzip member at byte {at} is cut off")
        yield at, b"".join(parts)
        at = end - len(member.unused_data)


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Input: path and content of archives. One row a capture, with its place in the run of its archive."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            run = _captures(path.rsplit("/", 1)[-1], content.as_py())
            for place, capture in enumerate(run):
                capture["place"] = place
            if run:
                yield pa.RecordBatch.from_pylist(run, schema=schema)


def read_runs(spark, path: str | list[str]) -> DataFrame:
    """Captures of all archives in some folders; those of one archive are a sorted run."""
    importable(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = CAPTURE + ", place long"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    return files.mapInArrow(lambda b: _runs(b, schema), kind)


class LoserTree:
    """Merges sorted runs, comparing each capture with as few others as the tree is high."""

    def __init__(self, runs: list[Iterator[tuple[tuple, dict]]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        n = max(len(runs), 1)
        self.losers = [-1] * n
        winners = [0] * n + list(range(len(runs))) + [-1] * (n - len(runs))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if n > 1 else winners[n]

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or self.heads[a] is None:
            return False
        return b < 0 or self.heads[b] is None or self.heads[a][0] <= self.heads[b][0]

    def __iter__(self):
        n = len(self.losers)
        while self.winner >= 0 and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run][1]
            self.heads[run] = next(self.runs[run], None)
            node, best = (run + n) // 2, run
            while node:
                if not self._before(best, self.losers[node]):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: the segments of one range. Output: its captures in order, ``place`` counted anew."""
    segments: dict[str, list[dict]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for capture in batch.to_pylist():
            segments.setdefault(capture["archive"], []).append(capture)
    # A shuffle may hand over the blocks of a run in any order.
    ordered = [sorted(s, key=lambda c: c["place"]) for s in segments.values()]
    rows, place = [], 0
    for capture in LoserTree([((order(c), c) for c in s) for s in ordered]):
        rows.append(capture | {"place": place})
        place += 1
        if len(rows) == 4096:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def merged_index(runs: DataFrame, captures: int = RANGE_CAPTURES) -> DataFrame:
    """The captures with ``range`` and ``place``: global order is by range, then place.

    Spark samples the keys and cuts them into ranges; a task merges the segments of its range.
    """
    n_ranges = max(1, -(-runs.count() // captures))
    ranged = runs.repartitionByRange(n_ranges, "url_key", "time", "page_id", "archive", "offset", "within")
    return ranged.mapInArrow(_merge, runs.schema).withColumn("range", F.spark_partition_id())


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
               captures: int = RANGE_CAPTURES) -> DataFrame:
    """Writes ``pages`` as archives, reads them back, and returns the merged index of all captures.

    Null URLs have no target header and sort first; null ids come back as null. Payloads may hold anything, blank
    lines and record headers included, since lengths decide. Repeated rows are records of their own. An empty
    table gives an empty index. Other columns of ``pages`` are not archived.
    """
    spark = pages.sparkSession
    importable(spark)
    path = write_archives(records(pages, page_id, url, html), folder(spark, "warc"), *archive_sizes(pages, html))
    runs = written(read_runs(spark, path), "warc-runs")
    return merged_index(runs, captures)
