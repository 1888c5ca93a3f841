"""Secret scans with a recursive decoding worklist.

Each text is layer 0 of its document. A layer is scanned for secrets; its percent-encoded, ``\\u`` / ``\\x`` / ``&#`` escaped and
base64 (plain or URL-safe) runs are decoded, runs wrapped over lines also as one, and runs with ``/`` also from each ``/`` on and part by part, base64 that holds gzip, zlib, bzip2, xz or zstandard data is unpacked as well, and what a
run gives is a new layer on the worklist, until no layer is new. A layer that the document has had before (by digest) isn't
scanned again, so cycles and repeated blobs end. Every finding is reported with its span in its own layer and with the span of the
layer-0 characters it came from.

Defined cases: null and empty texts have no findings; rows are scanned one by one, so rows repeated under one id give their findings
once per distinct text; a null id is reported as null; texts and layers of any length are scanned whole; bytes that aren't UTF-8 are
replaced; a decoded layer with too many control or (but for percent-encoding) replaced characters, or that is empty, is no layer; damaged or truncated compressed data gives what can be unpacked of it, never an error; a layer longer than ``BOMB`` characters per character of
the run is reported as a finding of kind ``decompression bomb``, and the text it unpacks to is scanned to its end in overlapping windows, whose own encoded runs aren't decoded; overlapping findings are all reported; other columns are
ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from . import common

BOMB, MARGIN, WINDOW, OVERLAP = 200, 1 << 20, 1 << 20, 1 << 14  #: an unpacked run may have so many bytes per character, and so many besides
KINDS = {
    "aws access key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github token": r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b",
    "slack token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google key": r"\bAIza[0-9A-Za-z_-]{35}",
    "api key": r"\bsk[-_](?:live_|test_|proj-)?[A-Za-z0-9]{20,}\b",
    "web token": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "bearer": r"\b[Bb]earer +[A-Za-z0-9._~+/-]{20,}",
    "assigned secret": r"(?i)\b(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[^\s\"'<>,;]{8,}",
    "url password": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{4,64}@",
}
_SCAN = {k: re.compile(v) for k, v in KINDS.items()}
#: Literals without which no kind can match, for the vectorised test of whole texts (RE2 reads a text once). Up to four characters of any
#: kind stand for a quote and white space, of which RE2 knows only ASCII's.
_ANY = r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|sk[-_]|eyJ|-----BEGIN|[Bb]earer|(?i:password|passwd|pwd|secret|token|key|auth)(?s:.{0,4})[:=]|://"
_PERCENT = re.compile(r"[A-Za-z0-9._~+/=:@&?%-]+")
_ESCAPED = re.compile(r"[!-~]+")
_HEX = re.compile(r"%[0-9A-Fa-f]{2}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{16,}+|[A-Za-z0-9_-]{16,}+)={0,2}+(?![A-Za-z0-9+/_=-])")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2}(?=[ \t]*(?:\r?\n|\Z)))+")
_WIDE = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}+")
_ENCODED = r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[x0-9]|[A-Za-z0-9+/]{16,}|[A-Za-z0-9_-]{16,}"
SCHEMA = "doc_id bigint, kind string, layer int, path string, layer_start int, layer_end int, start int, end int, digest string"


class Layer(NamedTuple):
    text: str
    path: str  #: how it was decoded, outermost first
    depth: int
    start: int  #: characters of layer 0 that it came from
    end: int


def _unescape(m: re.Match) -> str:
    s = m.group(0)
    if s[0] == "&":
        return html.unescape(s)
    n = int(s[2:].strip("{}"), 16)
    return chr(n) if n < 0x110000 else s


_ONE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#\d{1,7};|&#x[0-9A-Fa-f]{1,6};")


def _codec(raw: bytes) -> str:
    """UTF-16 if the bytes begin with its mark, or if zeros are two fifths of those at even or of those at odd places; else UTF-8."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    if len(raw) >= 8:
        for first, name in ((1, "utf-16-le"), (0, "utf-16-be")):
            part = raw[first::2]
            if part.count(0) * 5 >= len(part) * 2:
                return name
    return "utf-8"


def _text(raw: bytes, replaced: float = 0.2) -> str | None:
    s = raw.decode(_codec(raw), errors="replace")
    if not s or s.count("\ufffd") > replaced * len(s):
        return None
    return s if sum(c < " " and c not in "\t\n\r" for c in s) * 20 <= len(s) else None


class Bomb(Exception):
    pass


_DAMAGE = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def unpacker(raw: bytes) -> tuple | None:
    """Name of compressed data and what decompresses it; None if it isn't such data."""
    if raw[:2] == b"\x1f\x8b":
        return "gzip", zlib.decompressobj(31)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", zstandard.ZstdDecompressor().decompressobj()
    if raw[:3] == b"BZh":
        return "bzip2", bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\0":
        return "xz", lzma.LZMADecompressor()
    if len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return "zlib", zlib.decompressobj()
    return None


def windows(raw: bytes) -> Iterator[tuple[int, str, bool]]:
    """(place, text, whether it is the last) of overlapping windows of what compressed data unpacks to."""
    _, d = unpacker(raw)
    read, held, at = None, "", 0
    try:
        for i in range(0, len(raw), 512):
            part = d.decompress(raw[i : i + 512])
            if read is None and part:
                read = codecs.getincrementaldecoder(_codec(part))("replace")
            held += read.decode(part) if read else ""
            if len(held) >= WINDOW:
                yield at, held, False
                at += len(held) - OVERLAP
                held = held[-OVERLAP:]
            if getattr(d, "eof", False):
                break
    except _DAMAGE:
        pass
    yield at, held, True


def unpack(raw: bytes, most: int) -> tuple[str, bytes] | None:
    """Name and content of compressed data, as far as it can be unpacked; None if it isn't such data."""
    if not (known := unpacker(raw)):
        return None
    name, d = known
    out = bytearray()
    try:
        for i in range(0, len(raw), 512):  # piece by piece, so that a bomb is noticed early
            out += d.decompress(raw[i : i + 512])
            if len(out) > most:
                raise Bomb(name)
            if getattr(d, "eof", False):
                break
    except _DAMAGE:
        pass
    return (name, bytes(out)) if out else None


def decoded(text: str) -> Iterator[tuple[str, int, int, str | bytes]]:
    """(how, start, end, content) of each encoded run of a layer; content bytes, still packed, for a decompression bomb."""
    if "%" in text:
        for m in _PERCENT.finditer(text):
            if _HEX.search(m.group(0)) and (s := _text(unquote_to_bytes(m.group(0)), 1)):
                yield "url", *m.span(), s
    if "\\" in text or "&#" in text:
        for m in _ESCAPED.finditer(text):
            s, n = _ONE.subn(_unescape, m.group(0))
            if n:
                yield "unicode", *m.span(), s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    for a, b, run in base64_runs(text):
        try:
            raw = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        how = "base64"
        try:
            for _ in range(64):  # compressed within compressed
                packed = unpack(raw, BOMB * len(run) + MARGIN)
                if not packed:
                    break
                how += "+" + packed[0]
                raw = packed[1]
        except Bomb as e:
            yield f"{how}+{e}", a, b, raw
            continue
        if s := _text(raw):
            yield how, a, b, s


def base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of what may be base64: runs, runs wrapped over lines, what follows each ``/`` of a run and its parts."""
    for m in _BASE64.finditer(text):
        run = m.group(0).rstrip("=")
        if not (len(run) % 4 == 1 or run.isalpha() and (run.islower() or run.isupper() or run.istitle())):
            yield *m.span(), run
    for m in _WRAPPED.finditer(text):
        lines = list(re.finditer(r"[A-Za-z0-9+/_-]+(={0,2})", m.group(0)))
        last = next((k for k, x in enumerate(lines) if x.group(1) or k > 1 and len(x.group(0)) < len(lines[1].group(0))), len(lines) - 1)
        for n in {last + 1, len(lines)}:
            run = "".join(x.group(0).rstrip("=") for x in lines[:n])
            yield m.start(), m.start() + lines[n - 1].end(), run[: len(run) - (len(run) % 4 == 1)]
    for m in _WIDE.finditer(text):
        run = m.group(0).rstrip("=")
        cut = [i for i, c in enumerate(run) if c == "/"]
        for i, end in zip(cut, [*cut[1:], len(run)]):
            if len(run) - i > 16:
                head = base64.b64decode(run[i + 1 : i + 65].replace("-", "+").replace("_", "/")[: (min(64, len(run) - i - 1)) // 4 * 4])
                if unpacker(head) or _text(head, 0.5):
                    for stop in {end, len(run)}:
                        if stop - i > 16:
                            part = run[i + 1 : stop]
                            yield m.start() + i + 1, m.start() + stop, part[: len(part) - (len(part) % 4 == 1)]


def scan(text: str) -> list[tuple]:
    """(kind, layer, path, span in the layer, span in the text, digest of the secret), all layers; the worklist's order is breadth first."""
    out: dict[tuple, None] = {}
    work, seen = [Layer(text, "", 0, 0, len(text))], {hashlib.sha256(text.encode("utf-8", "replace")).digest()}
    for layer in work:  # grows while it is read
        outer = layer.depth == 0
        for kind, pattern in _SCAN.items():
            for m in pattern.finditer(layer.text):
                where = m.span() if outer else (layer.start, layer.end)
                out[(kind, layer.depth, layer.path, *m.span(), *where, hashlib.sha256(m.group(0).encode("utf-8", "replace")).hexdigest()[:16])] = None
        for how, a, b, content in decoded(layer.text):
            where = (a, b) if outer else (layer.start, layer.end)
            path = f"{layer.path}/{how}" if layer.path else how
            if isinstance(content, bytes):
                out[("decompression bomb", layer.depth, path, a, b, *where, "")] = None
                for place, part, end in windows(content):
                    for kind, pattern in _SCAN.items():
                        for m in pattern.finditer(part):
                            if (m.start() or not place) and (end or m.end() < len(part)):  # else cut: whole in another window
                                out[(kind, layer.depth + 1, path, *(min(place + x, (1 << 31) - 1) for x in m.span()), *where, hashlib.sha256(m.group(0).encode("utf-8", "replace")).hexdigest()[:16])] = None
                continue
            digest = hashlib.sha256(content.encode("utf-8", "replace")).digest()
            if digest not in seen:
                seen.add(digest)
                work.append(Layer(content, path, layer.depth + 1, *where))
    return list(out)


def find(docs: DataFrame) -> DataFrame:
    """All findings of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.string()]
        names = ["doc_id", "kind", "layer", "path", "layer_start", "layer_end", "start", "end", "digest"]
        for b in batches:
            text = pc.fill_null(b.column("text").cast(pa.large_string()), "")
            maybe = pc.or_(pc.match_substring_regex(text, _ANY), pc.match_substring_regex(text, _ENCODED))
            at = np.flatnonzero(maybe.to_numpy(zero_copy_only=False))
            ids = b.column("doc_id").cast(pa.int64())
            rows = [(ids[i].as_py(), *f) for i in at.tolist() for f in scan(text[i].as_py())]
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 50_000]), types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), SCHEMA).distinct()


def op(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
