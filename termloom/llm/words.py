"""Vectorised words and windows of Arrow text columns: 64-bit hashes from prefix sums, so that a word costs no Python object.

A word is a run of letters, digits, ``_`` and non-ASCII characters of the lower-cased text. Hashes are polynomial in the bytes
(modulo 2**64, with random 64-bit values for the bytes) and then mixed; they are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64

CHUNK = 400_000  #: bytes that are hashed at once; results don't depend on it
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
WORDY = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, CHUNK + 1), base, np.uint64)
        p[0] = 1
        _powers[base] = p = np.cumprod(p, dtype=np.uint64)
    return p[:n]


class Text(NamedTuple):
    lo: int  #: first row of the chunk
    hi: int
    data: np.ndarray  #: its bytes
    offsets: np.ndarray  #: hi - lo + 1 offsets into them


def chunks(col: pa.Array, lower: bool = True, limit: int = CHUNK) -> Iterator[Text]:
    """Whole rows of a text column, nulls as empty texts, in chunks of about ``limit`` bytes (a longer text is a chunk of its own)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))])
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + limit, "right")) - 1)
        part = pc.fill_null(col.slice(lo, hi - lo).cast(pa.large_string()), "")
        if lower:
            part = pc.utf8_lower(part)
        part = pa.concat_arrays([part, pa.array([], pa.large_string())]) if part.offset else part
        _, off, buf = part.buffers()
        offsets = np.frombuffer(off, np.int64)[part.offset : part.offset + hi - lo + 1]
        data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        yield Text(lo, hi, data, offsets - offsets[0])
        lo = hi


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`spans` takes the hash of any run of bytes."""
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=c[1:])
    return c


def spans(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64((c[ends] - c[starts]) * powers(UNBASE, len(c))[starts])


def hash_bytes(raw: bytes) -> np.uint64:
    """The hash of one run of bytes, as :func:`spans` gives it."""
    c = prefix(np.frombuffer(raw, np.uint8))
    return spans(c, np.array([0]), np.array([len(raw)]))[0]


def squeezed(col: pa.Array) -> Iterator[Text]:
    """Lower-cased texts in which each run of other than word characters is one space."""
    for t in chunks(col):
        wordy = WORDY[t.data]
        keep = wordy.copy()
        keep[1:] |= wordy[:-1]
        kept = np.concatenate([[0], np.cumsum(keep)])
        yield Text(t.lo, t.hi, np.where(wordy, t.data, np.uint8(32))[keep], kept[t.offsets])


class Words(NamedTuple):
    lo: int
    hi: int
    hash: np.ndarray
    row: np.ndarray  #: of each word, counted from lo, ascending
    start: np.ndarray  #: byte offsets of each word
    end: np.ndarray
    data: np.ndarray


def bounds(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word spans two texts."""
    w = np.zeros(len(t.data) + 1, np.int8)
    w[:-1] = WORDY[t.data]
    edge = np.diff(w, prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.unique(t.offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(t.data))]
    cuts = cuts[(w[cuts] == 1) & (w[cuts - 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def words(col: pa.Array, limit: int = CHUNK) -> Iterator[Words]:
    """Hashes of all words of a text column."""
    for t in chunks(col, limit=limit):
        starts, ends = bounds(t)
        h = spans(prefix(t.data), starts, ends) if len(starts) else np.empty(0, np.uint64)
        yield Words(t.lo, t.hi, h, np.searchsorted(t.offsets, starts, "right") - 1, starts, ends, t.data)


def sorted_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often (or with what weight) they occur."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in an ascending table, -1 where they are not in it."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)
