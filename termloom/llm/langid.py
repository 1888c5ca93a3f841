"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (2 to 4 bytes of the lower-cased text, runs of other than word characters as
one space) that both hold, divided by the root of the product of the numbers that each holds: a blended-spectrum presence
kernel. Landmarks are drawn by seeded hash from a bounded, stratified sample of documents whose language is given; the Nyström map
K(x, L) K(L, L)^(-1/2) feeds one-versus-rest kernel ridge regression on the sample. As the kernel is linear in presence, the
classes' scores of a batch are the product of its presence matrix with one (n-grams x classes) matrix.

Defined cases: a null or empty text has no n-grams and no predicted language (null, score null); ties go to the lesser language
code; documents with a null language are no training rows but are scored; each row is scored, whatever its id (rows repeated or with a null id
too); texts of any length are read whole; an empty table, or one without given languages, gives null predictions; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import words as W

PER_LANGUAGE = 300  #: training documents per language, at most
LANDMARKS = 64  #: of these, per language
RIDGE, SEED, ORDERS = 1e-3, 29, (2, 3, 4)
SCHEMA = "doc_id bigint, lang string, predicted string, score double, margin double, n_grams bigint"


def grams(t: W.Text, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of each distinct n-gram of each text of a chunk, in this order; n-grams are numbers below 2**35."""
    if t.hi - t.lo > 1 << 28:
        raise ValueError("too many rows in a chunk")
    out = []
    row = np.repeat(np.arange(t.hi - t.lo, dtype=np.uint64), np.diff(t.offsets))
    v = t.data.astype(np.uint64)
    key = row << np.uint64(35) | v
    for n in range(2, max(orders) + 1):
        if len(key) < 2:
            break
        same = row[: len(key) - 1] == row[n - 1 :]
        key = (key[:-1] & ~np.uint64(0xFFFFFFFF)) | ((key[:-1] << np.uint64(8)) & np.uint64(0xFFFFFFFF)) | v[n - 1 :]
        if n in orders:
            out.append(key[same] | np.uint64(n - 2) << np.uint64(32))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    keys = np.sort(np.concatenate(out))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys >> np.uint64(35)).astype(np.int64), keys & np.uint64((1 << 35) - 1)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = SEED) -> DataFrame:
    """lang, h and the n-grams of at most ``per_language`` documents of each given language, by seeded hash."""
    given = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in given.groupBy("lang").count().collect()}
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):  # about twice as many as are wanted, so that hardly a language gets fewer
        chosen |= (F.col("lang") == lang) & (h < int(min(1.0, (2 * per_language + 50) / n) * (1 << 30)))
    few = given.where(chosen).withColumn("h", h).withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))).where(F.col("_r") <= per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in W.squeezed(b.column("text")):
                row, g = grams(t)
                cuts = np.searchsorted(row, np.arange(t.hi - t.lo + 1))
                part = b.slice(t.lo, t.hi - t.lo)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("_r").cast(pa.int64()), pa.array([g[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())], names=["lang", "place", "grams"])

    return few.select("lang", "_r", "text").mapInArrow(common.lean(run), "lang string, place bigint, grams binary")


class Model:
    """languages, the landmarks' n-grams in order, and the weights of each for each language."""

    def __init__(self, rows: list[tuple[str, int, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        rows = sorted((r for r in rows if len(r[2])), key=lambda r: (r[0], r[1]))
        self.languages = sorted({r[0] for r in rows})
        marks = [r for r in rows if r[1] <= landmarks] or rows
        self.grams = np.unique(np.concatenate([r[2] for r in marks])) if marks else np.empty(0, np.uint64)
        if not rows:
            self.weights = np.empty((0, 0), np.float32)
            return
        m = np.zeros((len(self.grams), len(marks)), np.float32)  # presence in the landmarks, by n-gram
        for j, r in enumerate(marks):
            m[np.searchsorted(self.grams, r[2]), j] = 1 / np.sqrt(len(r[2]))
        k = np.empty((len(rows), len(marks)))
        for i, r in enumerate(rows):
            at = W.find(self.grams, r[2])
            k[i] = m[at[at >= 0]].sum(0) / np.sqrt(len(r[2]))
        values, vectors = np.linalg.eigh(m.T.astype(np.float64) @ m)
        good = values > 1e-9 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good]) @ vectors[:, good].T
        phi = k @ root
        y = np.where(np.array([r[0] for r in rows])[:, None] == np.array(self.languages)[None], 1.0, -1.0)
        w = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
        self.weights = (m @ (root @ w)).astype(np.float32)

    def scores(self, row: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of n texts: the classes' scores (presence matrix times weights) and the numbers of n-grams."""
        size = np.bincount(row, minlength=n)
        at = W.find(self.grams, gram)
        ok = at >= 0
        row, at = row[ok], at[ok]
        out = np.zeros((n, len(self.languages)))
        if len(row) and self.languages:
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[starts]] = np.add.reduceat(self.weights[at], starts, axis=0)
        return out / np.sqrt(np.maximum(size, 1))[:, None], size


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = SEED) -> Model:
    rows = sample(docs, per_language, seed).collect()
    return Model([(r["lang"], r["place"], np.frombuffer(r["grams"], np.uint64)) for r in rows], landmarks, ridge)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Every document's predicted language, its score and its margin to the next."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.grams, model.weights))  # bounded by the landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.languages, own.grams, own.weights = shared.value
        names = np.array([*own.languages, None], object)
        for b in batches:
            best, score, margin, size = [], [], [], []
            for t in W.squeezed(b.column("text")):
                s, n = own.scores(*grams(t), t.hi - t.lo)
                if len(own.languages):
                    top = s.argmax(1)
                    ordered = np.sort(s, 1)
                    best.append(np.where(n > 0, top, len(own.languages)))
                    score.append(np.where(n > 0, ordered[:, -1], np.nan))
                    margin.append(np.where(n > 0, ordered[:, -1] - ordered[:, -2], np.nan) if len(own.languages) > 1 else np.full(len(n), np.nan))
                else:
                    best.append(np.zeros(len(n), int))
                    score.append(np.full(len(n), np.nan))
                    margin.append(np.full(len(n), np.nan))
                size.append(n)
            if not best:
                continue
            doubles = [pa.array(np.concatenate(x), pa.float64(), from_pandas=True) for x in (score, margin)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("lang").cast(pa.string()), pa.array(names[np.concatenate(best)], pa.string()), *doubles, pa.array(np.concatenate(size), pa.int64())], names=["doc_id", "lang", "predicted", "score", "margin", "n_grams"])

    return docs.select("doc_id", "lang", "text").mapInArrow(common.lean(run), SCHEMA)


def op(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs))
