"""WARC records in ZIP archives: written, located through the ZIP directories, read by range.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (each
record a gzip member of its own) and ``indexes/index.jsonl`` (offset and length of each record).
The reader takes the end of the file, follows the ZIP64 locator where there is one, parses the
central directory, finds the two members' data behind their local headers and then reads the index
and single records by range; nothing is extracted.

Files go to the shared folder through pyarrow's file systems. A task's archives count only if the
task's manifest rows are committed, so attempts that were lost leave nothing that is read.

Defined cases: a null payload is empty; equal payloads of at least ``min_bytes`` are one response,
that of the largest page_id, and revisits of it (rows that repeat that page_id are responses too);
a null page_id never names a response unless all are null; repeated rows each give a record; a very
long page is one record, held in memory once packed; further columns are ignored, whatever their
names; an empty table gives no archive. Archives stay in the shared folder until their reader has
been run and the caller removes the folder (``remove_archives``).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm._shared import discard, materialize, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Signatures and layouts of the ZIP format (fixed values).
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_LAYOUT, END64_LAYOUT, CENTRAL_LAYOUT, LOCAL_LAYOUT = "<4s4H2LH", "<4sQ2H2L4Q", "<4s6H3L5H2L", "<4s5H3L2H"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and path of a URI; a bare path is local."""
    if urlsplit(uri).scheme in ("", "file"):
        return arrow_fs.LocalFileSystem(), urlsplit(uri).path
    return arrow_fs.FileSystem.from_uri(uri)


# --- records --------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisit else http + payload
    pairs = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "2024-01-01T00:00:00Z")]
    if url:
        pairs.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    pairs.append(("WARC-Payload-Digest", "sha1:" + digest_of(payload)))
    if revisit:
        pairs += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _urn(refers_to))]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _headers(pairs) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, Any]:
    """Fields of a record; checks its length and, where the payload is there, its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    size = int(field["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ", 1)[1] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")))
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if field["WARC-Type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError("payload does not match its digest")

    def number(urn: str | None) -> int | None:
        found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found else None

    return {
        "page_id": number(field["WARC-Record-ID"]),
        "url": field.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": field["WARC-Type"],
        "refers_to": number(field.get("WARC-Refers-To")),
        "payload": payload if field["WARC-Type"] == "response" else None,
    }


# --- ZIP ------------------------------------------------------------------------------------


class ZipArchive:
    """A ZIP file read by range. ``file``: seekable, readable; size: its bytes."""

    def __init__(self, file: Any, size: int):
        self.file, self.size = file, size
        self.members = self._directory()

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("archive is cut short")
        return data

    def _directory(self) -> dict[str, dict[str, int]]:
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        at = len(tail)
        while True:
            at = tail.rfind(END, 0, at)
            if at < 0:
                raise ValueError("no end of central directory")
            # the record ends with a comment, which may hold the signature itself
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        _, _, _, _, count, length, offset, _ = struct.unpack_from(END_LAYOUT, tail, at)
        where = tail_at + at
        if where >= 20 and (count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF or self.read(where - 20, 4) == LOCATOR):
            mark, _, end64, _ = struct.unpack("<4sLQL", self.read(where - 20, 20))
            if mark == LOCATOR:
                found = struct.unpack(END64_LAYOUT, self.read(end64, 56))
                if found[0] != END64:
                    raise ValueError("no ZIP64 end of central directory")
                count, length, offset = found[7], found[8], found[9]
        data, members, k = self.read(offset, length), {}, 0
        for _ in range(count):
            (mark, _, _, flags, method, _, _, crc, packed, size, n, extra_n, note_n, _, _, _, local) = struct.unpack_from(CENTRAL_LAYOUT, data, k)
            if mark != CENTRAL:
                raise ValueError("bad central directory")
            k += struct.calcsize(CENTRAL_LAYOUT)
            name = data[k : k + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[k + n : k + n + extra_n]
            k += n + extra_n + note_n
            # ZIP64 values stand in this order, each only where the field is full
            while len(extra) >= 4:
                tag, m = struct.unpack_from("<2H", extra)
                if tag == 1:
                    values = iter(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                    size = next(values) if size == 0xFFFFFFFF else size
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    local = next(values) if local == 0xFFFFFFFF else local
                extra = extra[4 + m :]
            members[name] = {"method": method, "crc": crc, "packed": packed, "size": size, "local": local}
        return members

    def stored(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data."""
        m = self.members[name]
        if m["method"] != 0:
            raise ValueError(f"{name} is compressed, not stored")
        head = struct.unpack(LOCAL_LAYOUT, self.read(m["local"], 30))
        if head[0] != LOCAL:
            raise ValueError("bad local header")
        return m["local"] + 30 + head[9] + head[10], m["size"]


def write_archive(uri: str, records: list[bytes]) -> None:
    body, index = io.BytesIO(), []
    for r in records:
        packed = gzip.compress(r, 1, mtime=0)
        index.append(json.dumps({"offset": body.tell(), "length": len(packed)}))
        body.write(packed)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA), body.getvalue())
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(held.getvalue())


def read_archive(uri: str) -> Iterator[dict[str, Any]]:
    """The records of an archive, each by one range read."""
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        z = ZipArchive(file, file.size())
        at, size = z.stored(DATA)
        for line in z.read(*z.stored(INDEX)).decode().split("\n"):
            if line:
                x = json.loads(line)
                if x["offset"] + x["length"] > size:
                    raise ValueError("index points beyond the archive")
                yield parse_record(gzip.decompress(z.read(at + x["offset"], x["length"])))


# --- DataFrames -----------------------------------------------------------------------------


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``html`` and the response's page (``owner``) where payloads repeat."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha1(F.col("html").cast("binary")))))
    again = p.filter("sha is not null").groupBy("sha").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return p.join(again.select("sha", "owner"), "sha", "left").select("page_id", "url", "html", "owner")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes archives below folder; returns their manifest (``path``, ``records``)."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0

        def flush() -> pd.DataFrame:
            uri = f"{folder}/{uuid.uuid4().hex}.zip"
            write_archive(uri, held)
            return pd.DataFrame({"path": [uri], "records": [len(held)]})

        for b in batches:
            for page, url, text, owner in zip(b["page_id"], b["url"], b["html"], b["owner"], strict=True):
                revisit = owner is not None and owner != page
                held.append(record(None if page is None else int(page), url, text.encode("utf-8", "surrogatepass"), int(owner) if revisit else None, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    plan = plan_records(pages, min_bytes)
    # ids go through Python as text: a null among longs would turn them into floats
    plan = plan.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("owner").cast("string").alias("owner"))
    return materialize(plan.mapInPandas(write, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives in a manifest."""
    spark = manifest.sparkSession
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                rows = []
                for r in read_archive(path):
                    rows.append([None if r[n] is None else str(r[n]) for n in names])
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    n = max(1, manifest.count())
    spread = manifest.select("path").repartition(min(n, 4 * max(1, spark.sparkContext.defaultParallelism)), "path")
    out = spread.mapInPandas(read, ", ".join(f"{n} string" for n in names))
    return out.select(*[F.col(c).cast("long").alias(c) if c in ("page_id", "payload_bytes", "refers_to") else F.col(c) for c in names])


def remove_archives(pages: DataFrame, folder: str) -> None:
    """Removes a folder of archives."""
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder, reads the records back and removes the archives."""
    folder = new_path(pages.sparkSession, "archives")
    manifest = write_archives(pages, folder, min_bytes)
    out = materialize(read_archives(manifest), "records")
    remove_archives(pages, folder)
    discard(pages.sparkSession, manifest)
    return out
