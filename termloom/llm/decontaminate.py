"""Benchmark decontamination by pigeonhole edit matching.

Both sides are normalised (lower case; each run of other than word characters is one space). An item of m characters may occur
with up to k = floor(m * rate) edits. It is cut into k + 1 pieces, so an occurrence holds at least one piece unchanged: the texts'
windows are looked up among the pieces by rolling hash, and each hit's surroundings are verified with Myers' bit-parallel distance.
The result has every (doc_id, item_id) with such an occurrence and its least distance; no hit is dropped.

Defined cases: null texts, and texts without word characters, match nothing on either side; items repeated under one id count as
one item (the least distance of its texts); documents repeated under one id likewise; rows whose id is null are no documents or
items; texts of any length are searched whole; empty tables give no rows; other columns are ignored. An item that repeats a
phrase is verified at each of its hits. A document that occurs inside an item, but isn't the whole of it, is not a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import words as W

RATE = 0.06  #: edits allowed per character of an item
WINDOW = 14  #: bytes of a piece, at most, that are looked up; verification compares the rest
ITEMS_BYTES = 256 << 20  #: of benchmark text that one table of pieces may hold; more is searched in further passes
SCHEMA = "doc_id bigint, item_id bigint, distance int"
_RUN = re.compile(r"[^\w\x80-\U0010ffff]+", re.ASCII)


def normalise(text: str | None) -> str:
    return _RUN.sub(" ", (text or "").lower()).strip()


def myers(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance of the pattern to any substring of the text, None beyond ``most``; the bit vectors are whole integers."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score = mask, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & mask  # a match may begin anywhere: no 1 comes in
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return best if best <= most else None


def pieces(text: str, rate: float) -> list[tuple[int, str]]:
    """Offset (in characters) and text of the k + 1 pieces."""
    m = len(text)
    k = int(m * rate)
    cuts = [i * m // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pieces:
    """Tables of piece hashes, by the number of bytes that are hashed."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.rate = items, rate
        by: dict[int, list[tuple[int, int, int]]] = {}
        for n, (_, text) in enumerate(items):
            for at, p in pieces(text, rate):
                raw = p.encode()
                q = min(len(raw), WINDOW)
                by.setdefault(q, []).append((int(W.hash_bytes(raw[:q])), n, len(text[:at].encode())))
        self.tables = []
        for q, rows in sorted(by.items()):
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            self.tables.append((q, h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), seen))

    def hits(self, t: W.Text) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, items and where the items would begin, for the exact hits of pieces."""
        c = W.prefix(t.data)
        for q, h, item, off, seen in self.tables:
            if len(t.data) < q:
                continue
            starts = np.arange(len(t.data) - q + 1)
            got = W.spans(c, starts, starts + q)
            at = np.flatnonzero(seen[got >> np.uint64(44)])
            lo = np.searchsorted(h, got[at], "left")
            n = np.searchsorted(h, got[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if not len(at):
                continue
            row = np.searchsorted(t.offsets, at, "right") - 1
            ok = at + q <= t.offsets[row + 1]
            at, lo, n, row = at[ok], lo[ok], n[ok], row[ok]
            which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield np.repeat(row, n), item[which], np.repeat(at, n) - off[which]

    def matches(self, t: W.Text) -> Iterator[tuple[int, int, int]]:
        """(row, number of the item, least distance) of each pair that is within the budget."""
        found = list(self.hits(t))
        if not found:
            return
        row, item, begin = (np.concatenate(x) for x in zip(*found))
        wide = 32  # hits that begin within so many bytes of each other are verified by one window
        for r, i, b in np.unique(np.stack([row, item, begin // wide], 1), axis=0).tolist():
            text = self.items[i][1]
            k = int(len(text) * self.rate)
            lo = max(int(t.offsets[r]), b * wide - 4 * k)
            hi = min(int(t.offsets[r + 1]), (b + 1) * wide + len(text.encode()) + 4 * k)
            d = myers(text, t.data[lo:hi].tobytes().decode(errors="ignore"), k)
            if d is not None:
                yield r, i, d


def _search(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    table: list[Pieces] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not table:
            table.append(Pieces(items, rate))
        p = table[0]
        for b in batches:
            ids, rows = b.column("doc_id").cast(pa.int64()), []
            for t in W.squeezed(b.column("text")):
                rows += [(t.lo + r, p.items[i][0], d) for r, i, d in p.matches(t)]
            if rows:
                at, item, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(d, pa.int32())], names=["doc_id", "item_id", "distance"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(common.lean(run), SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, items_bytes: int = ITEMS_BYTES) -> DataFrame:
    """(doc_id, item_id, distance) of every item that occurs in a document within its budget.

    The benchmark is read by the driver; its size is that of evaluation sets, not of the corpus, and is checked: beyond
    ``items_bytes`` the documents are searched in several passes, each with a part of the items.
    """
    bench = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    passes: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in bench.toLocalIterator():
        if text := normalise(r["text"]):
            size += len(text)
            if size > items_bytes:
                passes.append([])
                size = len(text)
            passes[-1].append((r["item_id"], text))
    out = None
    for items in passes:
        part = _search(docs, sorted(items), rate)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Documents that hold no benchmark item; rows with a null id are kept."""
    return docs.join(matches(docs, benchmark, rate).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
