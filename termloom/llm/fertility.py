"""Quality rules by tokeniser fertility: characters per token, byte-fallback share and token entropy under public vocabularies.

Defined cases: a null, empty or blank text holds no tokens and is rejected as ``empty``; texts of any length are encoded whole;
spaces at the end of a text hold no token;
documents repeated under one id are judged one by one; a null or unknown language is judged by its script's band; other columns
of the input are ignored by :func:`measure` and kept as they are by :func:`keep`.
"""

from __future__ import annotations

import itertools
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

VOCABULARIES = "/opt/tokenizers"  #: folder of the public vocabularies
MODEL = "piece_bpe_32k.model"
CACHE = 150_000  #: words whose tokens a worker remembers within a task; a speed setting, results don't depend on it
SHORT = 24  #: texts under so many tokens are judged by their byte share alone
#: Rejection bands by language, else by script, else "*": least and most characters per token, most byte share, least and most entropy
#: as a part of the most that so many tokens could have.
BANDS = {
    "en": (1.75, 7.0, 0.10, 0.45, 0.97),
    "de": (1.75, 7.0, 0.10, 0.45, 0.97),
    "fr": (1.60, 7.0, 0.10, 0.45, 0.97),
    "es": (1.60, 7.0, 0.10, 0.45, 0.97),
    "Latn": (1.5, 7.0, 0.15, 0.40, 0.99),
    "*": (0.4, 8.0, 0.9, 0.30, 1.0),
}
SCHEMA = "doc_id bigint, lang string, n_chars bigint, n_tokens bigint, chars_per_token double, byte_share double, entropy double, keep boolean, reason string"


class Encoder:
    """Tokens of whole texts. No piece of this vocabulary spans a space that follows another character, so words are encoded once and remembered."""

    def __init__(self, folder: str = VOCABULARIES, model: str = MODEL):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, model))
        self.words: dict[str, tuple[int, ...]] = {}
        white = {self.sp.piece_to_id(f"<0x{b:02X}>") for b in (9, 10, 13)}
        self.byte = np.array([self.sp.is_byte(i) and i not in white for i in range(self.sp.get_piece_size())])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [_words(t) for t in texts]
        new = list(set(itertools.chain.from_iterable(parts)).difference(self.words))
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = list(set(itertools.chain.from_iterable(parts)))
        self.words.update(zip(new, map(tuple, self.sp.encode(new, num_threads=1))))
        get = self.words.__getitem__
        return [np.fromiter(itertools.chain.from_iterable(map(get, p)), np.int32) for p in parts]


_SEGMENT = re.compile(" *[^ ]+| +")


def _words(text: str) -> list[str]:
    text = text.rstrip(" ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        parts = _SEGMENT.findall(text)
        return [p[1:] if p[0] == " " and i else p for i, p in enumerate(parts)]
    return text.split(" ") if text else []


_SCRIPTS = re.compile("[A-Za-zÀ-ɏ]")


def script(text: str) -> str:
    letters = sum(map(str.isalpha, text))
    return "Latn" if letters and 2 * len(_SCRIPTS.findall(text)) > letters else "other"


def judge(ids: np.ndarray, text: str, lang: str | None, byte: np.ndarray, bands: dict) -> tuple:
    n = len(ids)
    if not n or not text.strip():
        return len(text), n, None, None, None, False, "empty"
    counts = np.bincount(ids)
    counts = counts[counts > 0]
    entropy = max(0.0, math.log2(n) - float((counts * np.log2(counts)).sum()) / n)
    cpt, share = len(text) / n, float(byte[ids].sum()) / n
    low, high, most, least, peak = bands.get(lang) or bands.get(script(text)) or bands["*"]
    rate = entropy / math.log2(n) if n > 1 else 0.0
    reason = "byte share" if share > most else None
    if reason is None and n >= SHORT:
        reason = "short tokens" if cpt < low else "long tokens" if cpt > high else "low entropy" if rate < least else "high entropy" if rate > peak and n >= 200 else None
    return len(text), n, cpt, share, entropy, reason is None, reason


def _chunks(texts: list, limit: int = 2_000_000) -> Iterator[range]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > limit:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


_encoders: dict[tuple[str, str], Encoder] = {}


def _forget() -> None:
    """The worker waits for other tasks after this one: what it remembers of words goes."""
    for e in _encoders.values():
        e.words = {}


def _judged(batch: pa.RecordBatch, folder: str, model: str, bands: dict) -> Iterator[tuple]:
    enc = _encoders.get((folder, model)) or _encoders.setdefault((folder, model), Encoder(folder, model))
    texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
    for r in _chunks(texts):
        part = [texts[i] or "" for i in r]
        for i, t, ids in zip(r, part, enc.encode(part)):
            yield judge(ids, t, langs[i], enc.byte, bands)


def measure(docs: DataFrame, folder: str = VOCABULARIES, model: str = MODEL, bands: dict = BANDS) -> DataFrame:
    """Fertility of every document and whether its language's band keeps it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*_judged(b, folder, model, bands))) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("lang").cast(pa.string()), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", "lang", "n_chars", "n_tokens", "chars_per_token", "byte_share", "entropy", "keep", "reason"])
        _forget()

    return docs.select("doc_id", "lang", "text").mapInArrow(common.lean(run), SCHEMA)


def keep(docs: DataFrame, folder: str = VOCABULARIES, model: str = MODEL, bands: dict = BANDS) -> DataFrame:
    """The documents that their bands keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([j[5] for j in _judged(b, folder, model, bands)], pa.bool_()))
        _forget()

    return docs.mapInArrow(common.lean(run), docs.schema)


def op(spark, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
