"""Web archives: WARC files, their sorted index runs, and the merge of the runs into capture histories.

:func:`write_archives` writes a record for each page, a gzip member each, one file for a task. Of records with equal
payloads of ``LEAST`` bytes or more, the one with the largest page_id holds the payload (response), the others refer to
it (revisit). :func:`read_archives` reads the files again, a task each; each gives a run of captures sorted by URL key
and time, and the runs are written. :func:`merge_runs` range-partitions the captures by sampled splitters of (URL key,
time, page), and in each range merges the slices of all runs by a tournament tree of losers, so the ranges, in order, are
one globally sorted index, in which :func:`histories` numbers the captures of each URL key. A task holds a range of some
``RANGE_ROWS`` index entries as Arrow batches, whatever the size of a history, and decoded only the heads of its runs.

Pages carry no time: a capture's is ``EPOCH`` plus its page_id in seconds.

Defined results: a null html counts as an empty payload; a null url has the empty URL key and no target URI; a null
page_id counts as the smallest (its time is ``EPOCH``); rows that share the largest page_id and the payload are all
responses; one page must fit in a task's memory a few times over; columns other than page_id, url and html, whatever
their names, are not read; an empty table gives no archives and no captures.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import pieces
from .store import materialize, new_path

#: Index entries of a range of the merge, and entries decoded at once from a run.
RANGE_ROWS, HEAD_ROWS = 200_000, 256
LEAST, EPOCH = 1000, datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
_CAPTURE = "page_id long, url string, urlkey string, timestamp string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]
_KINDS = [pa.int64() if x.endswith("long") else pa.string() for x in _CAPTURE.split(", ")]


def url_key(url: str | None) -> str:
    """A sort-friendly form: host reversed, lower-cased, without "www." and default ports; path; sorted query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    at = "" if port in (None, 80, 443) else f":{port}"
    query = "&".join(sorted(x for x in parts.query.lower().split("&") if x))
    return f"{','.join(reversed(host.split('.')))}{at}){parts.path.lower() or '/'}{'?' + query if query else ''}"


def moment(page_id: int | None) -> datetime.datetime:
    """The time of a capture; ids that no calendar holds wrap around."""
    return EPOCH + datetime.timedelta(seconds=(page_id or 0) % (1 << 35) if not -(1 << 30) < (page_id or 0) < 1 << 35 else page_id or 0)


def iso(page_id: int | None) -> str:
    return moment(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")


def sha1_base32(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """A WARC 1.1 record; a revisit has the HTTP headers of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {iso(page_id)}",
        *([f"WARC-Target-URI: {quote(url, safe=_URI)}"] if url else []),
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Date: {iso(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "!#$%&'()*+,/:;=?@[]~"


def files(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI that all executors reach (a shared mount, HDFS or an object store)."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to and revisit of each page. Payloads are compared by length, SHA-1 and a second hash."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("key", F.when(F.octet_length("payload") >= LEAST, F.concat_ws(":", F.sha1("payload"), F.octet_length("payload"), F.xxhash64("payload"))))
    low = -(1 << 63)
    rank = F.coalesce(F.col("page_id"), F.lit(low))
    shared = own.filter("key is not null").groupBy("key").agg(F.max(rank).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("shared"), "keep")
    # Payloads that can't be shared get keys of their own, so that a join by key does not send all of them to one task.
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "payload").cast("string"))
    joined = own.withColumn("key", F.coalesce("key", alone)).join(shared, F.col("key") == F.col("shared"), "left")
    revisit = F.col("keep").isNotNull() & (rank < F.col("keep"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("keep")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, level: int = 1) -> DataFrame:
    """Write ``*.warc.gz`` files; a row for each: archive (URI), records. A task that is run again writes a new file, and only listed files count."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = files(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        count, out = 0, None
        for batch in pieces(batches, "payload"):
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(z.compress(record(page_id, url, payload, refers_to, revisit, sha1_base32(payload))) + z.flush())
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], ["archive", "records"])

    return materialize(planned(pages).mapInArrow(run, "archive string, records long"), "warc-list")


def members(stream: BinaryIO, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    at, begun, z, parts = 0, 0, zlib.decompressobj(31), []
    while chunk := stream.read(block):
        while chunk:
            parts.append(z.decompress(chunk))
            rest = z.unused_data
            at += len(chunk) - len(rest)
            chunk = rest
            if z.eof:
                yield begun, at - begun, b"".join(parts)
                begun, z, parts = at, zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, lower-case names; HTTP headers; payload) of a record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size + 4 or rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def page_of(ident: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", ident)
    return int(found[1]) if found and found[1] else None


def capture(data: bytes, archive: str, offset: int, length: int) -> tuple:
    """An index entry; a response's payload is checked against its digest."""
    from urllib.parse import unquote

    fields, http, payload = parse_record(data)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    size = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"{archive} at {offset}: the payload doesn't match its digest")
    url = unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None
    return (page_of(fields["warc-record-id"]), url, url_key(url), re.sub(r"\D", "", fields["warc-date"]), size, digest, fields["warc-type"], page_of(fields["warc-refers-to"]) if revisit else None, archive, offset, length)


def order_of(row: tuple) -> tuple:
    """URL key, time, page."""
    return row[2], row[3], row[0] is not None, row[0] or 0


def read_archives(archives: DataFrame) -> DataFrame:
    """The captures of the listed files, written: from each file, a task of its own, a run sorted by URL key, time and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, path = files(archive)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows = sorted((capture(data, os.path.basename(archive), at, n) for at, n, data in members(stream)), key=order_of)
                for at in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000]), _KINDS)], _NAMES)

    return materialize(archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, _CAPTURE), "warc-runs")


class LoserTree:
    """Merges sorted runs: a tree in which each inner node keeps the loser of its match, so the next winner costs one path."""

    def __init__(self, runs: Iterable[Iterable[tuple]], key=order_of):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.head = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return a is not None and (b is None or a[:2] < b[:2])

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            rival = self.losers[node]
            if rival < 0:  # the rival has not come yet
                self.losers[node] = i
                return
            if self._beats(rival, i):
                self.losers[node], i = i, rival
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (found := self.head[self.losers[0]]) is not None:
            yield found[2]
            self.head[found[1]] = self._next(found[1])
            self._play(found[1])


def decoded(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run's slice, a few at a time; batches that are done are let go."""
    while batches:
        batch = batches.pop(0)
        for at in range(0, batch.num_rows, HEAD_ROWS):
            yield from zip(*(batch.column(c).slice(at, HEAD_ROWS).to_pylist() for c in _NAMES))


_ORDERED = _CAPTURE + ", range int, number long"


def merge_runs(captures: DataFrame) -> DataFrame:
    """All captures in global order of URL key, time and page: by ``range``, and within each; ``number`` counts those of a URL key in a range.

    A range of the key space is a task's; a URL with very many captures is cut by time like any other range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:  # one archive's captures follow another's
            name = batch.column("archive")
            cuts = [0, *[i for i in range(1, batch.num_rows) if name[i] != name[i - 1]], batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    runs.setdefault(name[a].as_py(), []).append(batch.slice(a, b - a))
        here, last, number = TaskContext.get().partitionId(), None, 0
        merged: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*merged), [*_KINDS, pa.int32(), pa.int64()])], [*_NAMES, "range", "number"])

        for row in LoserTree(decoded(r) for r in runs.values()):
            number = number + 1 if row[2] == last else 0
            last = row[2]
            merged.append((*row, here, number))
            if len(merged) == 5000:
                yield out()
                merged = []
        if merged:
            yield out()

    order = ["urlkey", "timestamp", "page_id"]
    ranges = max(captures.sparkSession.sparkContext.defaultParallelism, -(-captures.count() // RANGE_ROWS))
    return captures.repartitionByRange(ranges, *order, "archive", "offset").sortWithinPartitions("archive", *order, "offset").mapInArrow(run, _ORDERED)


def histories(captures: DataFrame) -> DataFrame:
    """Captures with ``capture_no``, the 0-based position in their URL key's history, in the merged order.

    Only the first and the last URL key of a range can go on in others: their counts, two rows a range, carry over.
    """
    merged = materialize(merge_runs(captures), "warc-index")
    ends = merged.groupBy("range").agg(F.min("urlkey").alias("lo"), F.max("urlkey").alias("hi")).select("range", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("urlkey"))
    counts = merged.groupBy("range", "urlkey").agg(F.count(F.lit(1)).alias("n")).join(ends, ["range", "urlkey"])
    before = Window.partitionBy("urlkey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("range", "urlkey", F.sum("n").over(before).alias("before")).filter("before > 0")
    return merged.join(carried, ["range", "urlkey"], "left").select(*_NAMES, (F.col("number") + F.coalesce("before", F.lit(0))).alias("capture_no"))
