"""WARC archives with a two-level capture index.

Writing: every page becomes a record, gzipped on its own, in archive files of bounded size in the shared folder; equal payloads
after the first become revisit records.  Index: captures are sorted by their reversed-host key, ``LINES`` to a compressed block; a shard file
holds blocks in order and, beside it, a sparse directory with the first and last key of each block.  Lookup: binary search
over the shards (as many as the index has partitions), then over a shard's directory, then over the block's lines, and only then
ranges of the archives are read.

The unit of work is a block, not a key: a key with very many captures spans many blocks, which are read apart.  Files get new
names in every attempt of a task, and only the names that Spark commits with the rows are ever read, so a lost executor leaves
files behind that nobody looks at, and no half-written record.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, new_folder

#: Index lines in a block, bytes in an archive file before the next is begun, and the least payload that is told apart.
LINES, ARCHIVE, LEAST = 3000, 256 << 20, 100
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id bigint, archive string, at bigint, length bigint"


def capture_key(url: str | None) -> str:
    """``http://a.example.com:80/x?y`` as ``com,example,a)/x?y``; what is no such address stands as it is."""
    text = (url or "").strip()
    found = re.match(r"(?is)(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)(:\d*)?(.*)", text)
    if not found:
        return text
    host, port, rest = found.groups()
    port = "" if port in (None, ":", ":80", ":443") else port
    return ",".join(reversed(host.lower().rstrip(".").split("."))) + port + ")" + (rest.split("#")[0] or "/")


def open_folder(folder: str):
    """The file system of a folder's address, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzipped record; a revisit has the payload's length and digest, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        # every character beyond printable ASCII is escaped, so a header stays one line
        f"WARC-Target-URI: {quote(url or '', safe='!#$&()*+,/:;=?@[]~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parsed(data: bytes) -> dict:
    """Headers and payload of one gzipped record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda name: (lambda x: int(x) if x else None)(fields.get(name, "")[len("<urn:page:") : -1])
    return {
        "page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
        "url": unquote(fields["WARC-Target-URI"]), "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "length": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload": payload,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id, url, payload, digest, refers_to, revisit)
                out.write(data)
                rows.append((capture_key(url), page_id, name, at, len(data)))
                at += len(data)
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["key", "page_id", "archive", "at", "length"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """A record per row of ``page_id, url, html``; returns the captures ``key, page_id, archive, at, length``.

    Of records with equal payloads of at least ``least`` bytes, that of the smallest page_id is a response and the others revisit
    it; rows that repeat that page_id are all responses, as are payloads whose page_ids are all null.  Null html is an empty payload,
    a null url an empty key.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    firsts = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = rows.join(firsts.drop("n"), "digest", "left").select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"))
    return keep(typed.mapInArrow(_writer(folder), CAPTURE), "captures")


def _index_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        name, out, at, lines, directory = uuid.uuid4().hex, None, 0, [], []

        def flush():
            nonlocal at, lines
            block = zlib.compress(json.dumps(lines).encode(), 6)
            out.write(block)
            directory.append([lines[0][0], lines[-1][0], at, len(block)])
            at += len(block)
            lines = []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}.blocks", compression=None)
                lines.append(line)
                if len(lines) == LINES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with system.open_output_stream(f"{path}/{name}.directory", compression=None) as beside:
            beside.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (directory[0][0], directory[-1][1], name)], names=["first", "last", "shard"])

    return run


def write_index(captures: DataFrame, folder: str, shards: int | None = None) -> list[tuple[str, str, str]]:
    """The index of ``captures``; returns its top level, (first key, last key, name) of each of at most ``shards`` shards, in order."""
    spark = captures.sparkSession
    number = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "archive", "at"]
    ordered = captures.repartitionByRange(number, *order).sortWithinPartitions(*order)
    top = keep(ordered.mapInArrow(_index_writer(folder), "first string, last string, shard string"), "shards")
    # as many rows as shards, which the caller bounds
    return sorted((r["first"], r["last"], r["shard"]) for r in top.collect())


def overlapping(spans: list, key: str) -> Iterator:
    """The spans (first, last, ...) that may hold ``key``, of spans in order, by binary search on their last keys."""
    at = bisect.bisect_left(spans, key, key=lambda s: s[1])
    while at < len(spans) and spans[at][0] <= key:
        yield spans[at]
        at += 1


def _find_blocks(top, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        held: dict[str, list] = {}
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for _, _, shard in overlapping(top, key):
                    if shard not in held:
                        if len(held) >= 8:
                            held.clear()
                        with system.open_input_stream(f"{path}/{shard}.directory", compression=None) as directory:
                            held[shard] = json.loads(directory.read())
                    rows += [(key, shard, at, length) for _, _, at, length in overlapping(held[shard], key)]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "shard", "block", "size"])

    return run


def _read_blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        last, lines = None, []
        for batch in batches:
            rows = []
            for key, shard, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if last != (shard, at):
                    with system.open_input_file(f"{path}/{shard}.blocks") as blocks:
                        lines = json.loads(zlib.decompress(blocks.read_at(size, at)))
                    last = (shard, at)
                low = bisect.bisect_left(lines, key, key=lambda line: line[0])
                while low < len(lines) and lines[low][0] == key:
                    rows.append(tuple(lines[low]))
                    low += 1
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["key", "page_id", "archive", "at", "length"])

    return run


def find_captures(keys: DataFrame, top: list, folder: str) -> DataFrame:
    """The captures of all keys in a column ``key``: each distinct key is searched once."""
    spark = keys.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = keys.select("key").where("key is not null").distinct().mapInArrow(_find_blocks(top, folder), "key string, shard string, block bigint, size bigint")
    return wanted.repartition(number, "shard", "block").sortWithinPartitions("shard", "block", "key").mapInArrow(_read_blocks(folder), CAPTURE)


def _read_records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        last, archive = None, None
        for batch in batches:
            rows = []
            for name, at, length in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if name != last:
                    if archive is not None:
                        archive.close()
                    last, archive = name, system.open_input_file(f"{path}/{name}")
                found = parsed(archive.read_at(length, at))
                revisit = found["record_type"] == "revisit"
                size = found["length"] if revisit else len(found["payload"])
                digest = found["digest"] if revisit else hashlib.sha256(found["payload"]).hexdigest()
                if digest != found["digest"] or size != found["length"]:
                    raise ValueError(f"record at {at} of {name} is damaged")
                rows.append((found["page_id"], size, digest, found["record_type"], found["refers_to"], found["url"], None if revisit else found["payload"]))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return run


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of ``captures``, read by ranges in the order of the archives; a damaged record is an error."""
    spark = captures.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = captures.repartitionByRange(number, "archive", "at").sortWithinPartitions("archive", "at")
    return order.mapInArrow(
        _read_records(folder),
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary",
    )


def capture_keys(pages: DataFrame, url: str = "url") -> DataFrame:
    """``key`` of each page's url."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(capture_key, batch.column(0).to_pylist()), pa.string())], names=["key"])

    return pages.select(F.col(url).cast("string")).mapInArrow(run, "key string")


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages``, indexes them, looks every url up and reads the records back: a row per page.

    An empty table gives no rows; columns other than page_id, url and html are not read.
    """
    folder = new_folder(spark, "warc")
    captures = write_archives(pages, folder)
    top = write_index(captures, folder)
    found = keep(find_captures(capture_keys(pages), top, folder), "found")
    return read_records(found, folder)
