"""WARC archives of pages, with an index of captures in global order.

``write`` finds equal payloads by their SHA-256 over all pages: the page with the largest id holds the payload in a ``response``
record, the others ``revisit`` it. Tasks write archives of bounded size, each record a gzip member of its own, below a shared folder; a
file is known by the rows that a successful task returns, so that files of lost attempts are never read. Each task sorts its captures into
runs of bounded length. ``merge`` deals the runs out by ranges of (URL key, time, id, place), which split the history of a
frequent URL as well, and each range merges its pieces of runs with a loser tree. ``read`` fetches every record of the index by its place.

Edge cases: a null payload is empty, a null URL has an empty key, a null time is the Unix epoch. Rows that share the largest id
and the payload are all responses; a null id is below all others. Payloads below ``least_bytes`` are responses. Control
characters and spaces of a URL are percent-encoded in the record. Payloads may hold record headers, line ends and any other text: lengths decide where a record ends. Batches
are of bounded bytes, so that very long payloads do not gather. Other columns of any name are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, prepare, shared_folder, text_of, written

#: Bytes after which a new archive begins, captures of a run, captures of a range of the index.
FILE_BYTES, RUN, RANGE = 64 << 20, 50_000, 100_000
EPOCH = "1970-01-01T00:00:00Z"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEYS = ("url_key", "captured", "page_id", "file", "offset")


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query: pages of a domain are neighbours. Null has an empty key."""
    host = F.lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_replace(url, "(?s)^.*?://[^/?#]*", "")
    return F.coalesce(F.concat(F.concat_ws(",", F.reverse(F.split(host, "[.]"))), F.lit(")"), rest), F.lit(""))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:page:{digest}>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}:{digest}>"


def page_name(identifier: str | None) -> str | None:
    """The id of a page in a record's identifier; null has none."""
    parts = (identifier or "").split(":")
    return unquote(parts[2]) if len(parts) == 4 else None


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (the type under its own name) and block of a record; raises ValueError if its lengths disagree."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not found or not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def encoded_uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def squeezed(data: bytes) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


class Archive:
    """Archives of one task; ``add`` returns file, offset and length of a record."""

    def __init__(self, folder: str, most: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.most, self.out = most, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.most:
            self.close()
            self.store.create_dir(self.folder, recursive=True)
            self.file, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.file}", compression=None)
            self._put(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": EPOCH, "Content-Type": "application/warc-fields"}, b"format: WARC/1.1\r\n"))
        return self.file, *self._put(data)

    def _put(self, data: bytes) -> tuple[int, int]:
        member, at = squeezed(data), self.at
        self.out.write(member)
        self.at += len(member)
        return at, len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def page_record(page_id: str | None, url: str | None, date: str, payload: bytes, refers: str | None, revisits: bool) -> tuple[bytes, str]:
    """The record of a page and its digest; a revisit holds the HTTP header alone."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        fields["WARC-Target-URI"] = encoded_uri(url)
    if revisits:
        return record("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers, digest)}, block), digest
    return record("response", fields, block + payload), digest


def page_of(data: bytes) -> tuple[str | None, int, str, str, str | None, bytes | None]:
    """Id, payload bytes, digest, type, id referred to and payload (null for a revisit) of a page's record; the digest is verified."""
    fields, block = parsed(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return page_name(fields["WARC-Record-ID"]), size, digest, kind, page_name(fields.get("WARC-Refers-To")), payload if kind == "response" else None


def revisited(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, same, refers_to) of the pages that revisit another one; ``pages`` has page_id, same (a digest) and size."""
    pages = written(pages)  # texts are read and digested once
    best = written(pages.where(F.col("size") >= least_bytes).groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    narrow = pages.select("page_id", "same")
    met = narrow.join(F.broadcast(best) if best.count() <= BROADCAST_ROWS else best, "same")
    return written(met.where("refers_to > page_id or (page_id is null and refers_to is not null)").select("page_id", "same", "refers_to").distinct())


def write(pages: DataFrame, folder: str, captured: Column, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, run: int = RUN, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives of all rows below ``folder`` and returns the captures as sorted runs (run, seq).

    A capture has url_key, captured, page_id, file, offset and length. ``captured`` is a timestamp.
    """
    prepare(pages.sparkSession)
    date = F.coalesce(F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(EPOCH))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), url_key(F.col(url)).alias("url_key"), date.alias("captured"), text_of(payload).alias("text"))
    rows = rows.withColumn("same", F.unhex(F.sha2("text", 256)))
    again = revisited(rows.select("page_id", "same", F.octet_length("text").alias("size")), least_bytes).withColumnRenamed("page_id", "id").withColumnRenamed("same", "digest")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["id"]) & (rows["same"] == again["digest"]), "left")
    rows = rows.select("page_id", "url_key", "captured", "url", F.col("text").cast("binary").alias("payload"), F.col("refers_to").cast("string").alias("refers_to"),
                       F.col("page_id").cast("string").alias("name"), F.col("digest").isNotNull().alias("revisits"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, runs, held = Archive(folder, file_bytes), 0, []

        def sorted_run() -> pa.RecordBatch:
            nonlocal runs
            held.sort(key=order)
            number, columns = (TaskContext.get().partitionId() << 32) + runs, list(zip(*held, strict=True))
            runs += 1
            made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), ids, pa.string(), pa.int64(), pa.int64()), strict=True)]
            out = pa.RecordBatch.from_arrays([*made, pa.array([number] * len(held), pa.int64()), pa.array(range(len(held)), pa.int64())], names=[*KEYS, "length", "run", "seq"])
            held.clear()
            return out

        try:
            for batch in batches:
                ids = batch.schema.field("page_id").type
                for page, key, when, address, body, refers, name, revisits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data, _ = page_record(name, address, when, body, refers, revisits)
                    held.append((key, when, page, *archive.add(data)))
                    if len(held) >= run:
                        yield sorted_run()
            if held:
                yield sorted_run()
        finally:
            archive.close()

    shape = f"url_key string, captured string, page_id {kind}, file string, offset bigint, length bigint, run bigint, seq bigint"
    return written(rows.mapInArrow(records, shape))


def order(capture: tuple) -> tuple:
    """Sort key of a capture (url_key, captured, page_id, file, offset, ...); a null id comes first."""
    return (*capture[:2], capture[2] is not None, 0 if capture[2] is None else capture[2], *capture[3:5])


class LoserTree:
    """Merges sorted sequences: inner nodes hold the losers of their matches, so that the next item costs one match on each level."""

    def __init__(self, runs: list[list], key: Callable) -> None:
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.heads = [self._head(k) for k in range(len(runs))]
        self.losers = [0] * len(runs)
        self.best = self._play(1) if runs else None

    def _head(self, k: int) -> tuple:
        """Exhausted runs lose against all others; equal heads go by run."""
        run, at = self.runs[k], self.at[k]
        return (0, self.key(run[at]), k) if at < len(run) else (1, (), k)

    def _play(self, node: int) -> int:
        """The winner below ``node``; leaves follow the inner nodes 1 to n - 1."""
        n = len(self.runs)
        if node >= n:
            return node - n
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.losers[node] = (a, b) if self.heads[a] < self.heads[b] else (b, a)
        return win

    def __iter__(self) -> Iterator:
        n = len(self.runs)
        while n and self.heads[self.best][0] == 0:
            k = self.best
            yield self.runs[k][self.at[k]]
            self.at[k] += 1
            self.heads[k] = self._head(k)
            node = (k + n) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[k]:
                    k, self.losers[node] = self.losers[node], k
                node //= 2
            self.best = k


def merge(captures: DataFrame, most: int = RANGE) -> DataFrame:
    """The captures in global order: by ``part``, then ``position`` within it. Columns url_key, captured, page_id, file, offset, length, part, position.

    A range holds about ``most`` captures, so that the pieces of its runs fit in memory.
    """
    parts = max(1, -(-captures.count() // most))
    kind = captures.schema["page_id"].dataType.simpleString()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        rows = list(zip(*(table.column(c).to_pylist() for c in (*KEYS, "run", "seq")), range(len(table)), strict=True))
        runs: dict[int, list] = {}
        for row in rows:
            piece = runs.setdefault(row[5], [])
            piece.append(row)
        for piece in runs.values():
            if any(a[6] > b[6] for a, b in zip(piece, piece[1:])):  # blocks of a run came out of order
                piece.sort(key=lambda r: r[6])
        taken = [row[7] for row in LoserTree(list(runs.values()), order)]
        out = table.select([*KEYS, "length"]).take(taken)
        out = out.append_column("part", pa.array([TaskContext.get().partitionId()] * len(taken), pa.int32())).append_column("position", pa.array(range(len(taken)), pa.int64()))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    shape = f"url_key string, captured string, page_id {kind}, file string, offset bigint, length bigint, part int, position bigint"
    return written(captures.repartitionByRange(parts, *KEYS).mapInArrow(merged, shape))


def histories(index: DataFrame) -> DataFrame:
    """(url_key, captures, first, last) of every URL key."""
    return index.groupBy("url_key").agg(F.count(F.lit(1)).alias("captures"), F.min("captured").alias("first"), F.max("captured").alias("last"))


def read(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of the index, read from the archives below ``folder``: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url_key, captured and, if asked for, payload (null for revisits). Digests of payloads are verified."""
    kind = index.schema["page_id"].dataType.simpleString()
    files = index.select("file").distinct().count()
    # Archives are of bounded size and far larger than their rows here, so their number gives the number of tasks.
    placed = index.select("url_key", "captured", "file", "offset", "length").repartition(max(1, files), "file").sortWithinPartitions("file", "offset")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            found = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    name, source = file, store.open_input_file(f"{base}/{file}")
                source.seek(offset)
                found.append(page_of(zlib.decompress(source.read(length), 31))[: 6 if payload else 5])
                if payload:  # one row at a time: payloads may be long
                    yield batch_of(batch.slice(len(found) - 1, 1), found[-1:])
            if not payload:
                yield batch_of(batch, found)

    def batch_of(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in found], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, batch.column("url_key"), batch.column("captured")], names=names)

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if payload else [])]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else []), "url_key", "captured"]
    shape = f"page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, {'payload binary, ' if payload else ''}url_key string, captured string"
    rows = placed.mapInArrow(records, shape)
    return rows.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archived(pages: DataFrame, captured: Column, least_bytes: int = 0) -> DataFrame:
    """Writes, indexes and reads back archives of ``pages`` in a new shared folder."""
    folder = shared_folder(pages.sparkSession)
    return read(merge(write(pages, folder, captured, least_bytes=least_bytes)), folder)
