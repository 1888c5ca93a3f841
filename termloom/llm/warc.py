"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

:func:`write` makes such archives of a table of pages, one file per partition, in a folder of any file system that Arrow knows;
:func:`read` reads them: it loads the dictionary from the first frame (magic 0x184D2A5D; plain or itself compressed), decodes
frame by frame without holding more than one record, and validates each record: version line, mandatory headers, a
Content-Length that equals the block's length, the closing blank lines, and the block's digest.

Defined cases: each record, good or bad, is a row, with null ``error`` if it is valid; a record that fails has the reason there, and
the next frame is read as usual; after a damaged or truncated frame the rest of the file is one row of error; an empty file gives no
row, a file without a dictionary frame is decoded without one; a frame with several records or none is an error; pages with a null url or html have the headers
``X-Null``, so that they come back as null; empty blocks are valid; repeated rows are separate records; records up to the
memory of a worker are supported, there is no limit of length; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DICTIONARY, SKIPPABLE = 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
SAMPLE_ROWS, DICTIONARY_BYTES, LEVEL = 400, 64 << 10, 3  #: the dictionary is trained on about so many pages, drawn by hash, twice as many at most
READ, PIECE = 1 << 20, 16 << 10
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
SCHEMA = "file string, offset bigint, length bigint, record_type string, record_id string, target_uri string, content_length bigint, nulls string, block binary, error string"
DATE = "2024-01-01T00:00:00Z"


def record(page_id: Any, url: str | None, html: str | None) -> bytes:
    """One resource record; its id follows from the page's."""
    block = (html or "").encode()
    nulls = ",".join(n for n, v in (("page_id", page_id), ("url", url), ("html", html)) if v is None)
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"X-Page-ID: {page_id}", "Content-Type: text/html; charset=utf-8"]
    head += [f"X-Null: {nulls}"] if nulls else []
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on the samples, empty if they are too few."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def head_frame(trained: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(trained)
    return struct.pack("<II", DICTIONARY, len(packed)) + packed


def _fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(pages: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Archives of all pages: file, records and bytes of each. A partition that is retried writes its file again, under the same name."""
    rate = min(1.0, SAMPLE_ROWS / max(1, pages.count()))
    drawn = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("page_id", "url", "html").limit(2 * SAMPLE_ROWS)
    sample = sorted(record(r["page_id"], r["url"], r["html"]) for r in drawn.collect())
    trained = dictionary(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, root = _fs(folder)
        where.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/pages-{task.partitionId():06d}.warc.zst"
        own = f"{root}/_{task.partitionId():06d}-{task.taskAttemptId()}"
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
        n = size = 0
        with where.open_output_stream(own, compression=None) as f:
            if trained:
                size += f.write(head_frame(trained)) or 0
            for b in batches:
                for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    f.write(packer.compress(record(page_id, url, html)))
                    n += 1
        where.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "records"])

    return pages.select("page_id", "url", "html").mapInArrow(common.lean(run), "file string, records bigint")


class _Bytes:
    """A stream of which bytes can be looked at before, and given back after, they are taken."""

    def __init__(self, f: Any):
        self.f, self.buffer, self.place, self.at = f, b"", 0, 0

    def need(self, n: int) -> bytes:
        while len(self.buffer) - self.place < n and (more := self.f.read(max(READ, n - len(self.buffer) + self.place))):
            self.buffer, self.place = self.buffer[self.place :] + more, 0
        return self.buffer[self.place : self.place + n]

    def take(self, n: int) -> bytes:
        out = self.need(n)
        self.place += len(out)
        self.at += len(out)
        return out

    def back(self, n: int) -> None:
        self.place -= n
        self.at -= n


def _rest(s: _Bytes) -> int:
    n = 0
    while piece := s.take(READ):
        n += len(piece)
    return n


def frames(f: Any) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """(offset, length, content, error) of each data frame of an archive."""
    s = _Bytes(f)
    held: zstandard.ZstdCompressionDict | None = None
    first = True
    while head := s.need(4):
        start = s.at
        if len(head) < 4:
            yield start, len(head), None, "truncated frame"
            return
        magic = struct.unpack("<I", head)[0]
        if magic in SKIPPABLE:
            size = s.need(8)[4:8]
            body = s.take(8 + struct.unpack("<I", size)[0])[8:] if len(size) == 4 else b""
            if len(size) < 4 or len(body) < struct.unpack("<I", size)[0]:
                yield start, s.at - start, None, "truncated frame"
                return
            if first and magic == DICTIONARY:
                try:
                    held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(body) if body[:4] == struct.pack("<I", FRAME) else body)
                except zstandard.ZstdError as e:
                    yield start, s.at - start, None, f"bad dictionary: {e}"
                    return
            first = False
            continue
        first = False
        if magic != FRAME:
            yield start, _rest(s), None, "no frame here"
            return
        d, parts = zstandard.ZstdDecompressor(dict_data=held).decompressobj(), []
        try:
            while not d.eof:
                piece = s.take(PIECE)
                if not piece:
                    yield start, s.at - start, None, "truncated frame"
                    return
                parts.append(d.decompress(piece))
        except zstandard.ZstdError as e:
            yield start, s.at - start, None, f"bad frame: {e}"
            return
        s.back(len(d.unused_data))
        yield start, s.at - start, b"".join(parts), None


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def parse(raw: bytes) -> tuple[dict[str, str], bytes | None, str | None]:
    """Headers (last value of each), block and what is wrong with a decoded record."""
    if not _VERSION.match(raw):
        return {}, None, "bad version line"
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return {}, None, "headers don't end"
    headers: dict[str, str] = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            return headers, None, "bad header line"
        headers[name.decode("utf-8", "replace").title()] = value.strip().decode("utf-8", "replace")
    for m in MANDATORY:
        if m.title() not in headers:
            return headers, None, f"no {m}"
    if not re.fullmatch(r"\d+", headers["Content-Length"]):
        return headers, None, "bad Content-Length"
    size, body = int(headers["Content-Length"]), raw[end + 4 :]
    if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        return headers, None, f"Content-Length {size}, but {max(0, len(body) - 4)} bytes" if len(body) != size + 4 else "record doesn't end in two line ends"
    block = body[:size]
    kind, _, digest = headers.get("Warc-Block-Digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        return headers, None, "digest differs"
    return headers, block, None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the folder's ``*.warc.zst`` files. A file is read by one task, record by record, as WARC files are about 1 GB."""
    where, root = _fs(folder)
    found = [f for f in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.path.endswith(".warc.zst")]
    files = spark.createDataFrame([(f.path,) for f in found], "path string").repartition(max(1, len(found)), "path") if found else spark.createDataFrame([], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _fs(folder)
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with own.open_input_stream(path, compression=None) as f:
                    for offset, length, raw, error in frames(f):
                        headers, block = {}, None
                        if raw is not None:
                            headers, block, error = parse(raw)
                        size = headers.get("Content-Length", "")
                        rows.append((path.rsplit("/", 1)[-1], offset, length, headers.get("Warc-Type"), headers.get("Warc-Record-Id"), headers.get("Warc-Target-Uri"), int(size) if size.isdigit() else None, headers.get("X-Null", "") + "|" + headers.get("X-Page-Id", ""), block, error))
                        held += len(block or b"")
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(common.lean(run), SCHEMA)


def pages(records: DataFrame) -> DataFrame:
    """page_id, url and html of the records of archives that :func:`write` made, with the record's error."""
    nulls, page = F.split(F.split("nulls", r"\|")[0], ","), F.split("nulls", r"\|")[1]
    has = lambda n: F.array_contains(nulls, n)
    return records.select(
        F.when(~has("page_id"), page.try_cast("bigint")).alias("page_id"),
        F.when(~has("url"), F.col("target_uri")).alias("url"),
        F.when(~has("html"), F.decode("block", "UTF-8")).alias("html"),
        "record_type", "content_length", "error",
    )


def op(spark, sf_dir: str) -> DataFrame:
    """All pages, archived and read back: id, url, block length and digest of each record, and its error if it has one."""
    folder = common.fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder).agg(F.sum("records")).collect()
    return pages(read(spark, folder)).select("page_id", "url", "record_type", "content_length", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), "error")


SQL = """
SELECT page_id, url, 'resource' AS record_type, octet_length(encode(coalesce(html, '')))::BIGINT AS content_length, sha256(html) AS digest, NULL::VARCHAR AS error
FROM pages
"""
