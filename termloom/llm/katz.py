"""Katz backoff language model: trigram counts with Good-Turing discounts, exactly normalised backoff weights, in partitioned tables.

Words are those of :mod:`words`. The vocabulary has the words whose share of all tokens is at least ``SHARE`` (so it has at most
1 / SHARE words at any size of corpus); others are <unk>. A document is <s> <s> w1 ... wn </s>. All trigrams of the corpus are
counted; bigrams and trigrams that occur ``CUT`` times or more are held. Counts r up to ``K`` are discounted by Katz's formula from the
counts of counts of their order; where that isn't between 0 and 1 (few or odd counts) by absolute discounting. The mass that discounts and
the n-grams not held leave is given to the lower order by the weight alpha(h) = (1 - sum of P(w|h)) / (1 - sum of P(w|h')) over the
held w, so that every context's probabilities add up to 1. Unigrams have their relative frequency (<unk> counts once at least).

Everything of a middle word w2 of (w1, w2, w3) is in one partition: counts, weights and the probabilities of (w2, w3); frequent
middle words are spread over as many partitions as their share asks for, by w1, with a copy of their bigrams each. So a token's
recursive evaluation P3, else alpha P2, else alpha alpha P1, takes one exchange.

Defined cases: null and empty texts have no tokens: they count for nothing and have no row; rows with a null id count for the
model, but have no row of their own; rows repeated under one id are scored together; texts of any length are read whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import words as W

SHARE, CUT, K, SPREAD = 1e-6, 2, 5, 4
UNK, START, END, FIRST = 0, 1, 2, 3
BITS = np.uint64(20)
LOW = np.uint64((1 << 20) - 1)
TABLE = "part string, pid int, k binary, v0 binary, v1 binary"
COUNTS = np.dtype([("tokens", np.uint32), ("two", np.uint32), ("one", np.uint32)])
_TYPES = [pa.string(), pa.int32(), *[pa.binary()] * 3]


class Vocabulary(NamedTuple):
    hash: np.ndarray  #: ascending; the word of hash[i] has the number i + FIRST
    count: np.ndarray  #: by number, with <unk> and </s>; <s> is never predicted
    total: int
    parts: int

    @property
    def splits(self) -> np.ndarray:
        """Partitions over which each word's contexts are spread."""
        c = self.count.astype(np.float64)
        c[START] = 2 * c[END]
        return 1 + np.floor(c * SPREAD * self.parts / max(1, self.total)).astype(np.int64)

    def log(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.count / self.total)

    def pid(self, w1: np.ndarray, w2: np.ndarray, splits: np.ndarray) -> np.ndarray:
        own = common.mix64(w1 + np.uint64(11)) % splits[w2.astype(np.int64)].astype(np.uint64)
        return common.spread(w2 << BITS | own, self.parts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*r, *[None] * (5 - len(r))) for r in rows]), _TYPES)], names=["part", "pid", "k", "v0", "v1"])


def _pieces(part: str, pid: np.ndarray, n: int, key: np.ndarray, others: list[np.ndarray]) -> list[tuple]:
    """Rows of one partition each, keys as differences."""
    order = np.lexsort((key, pid))
    cuts = np.searchsorted(pid[order], np.arange(n + 1))
    key, others = key[order], [o[order] for o in others]
    return [(part, p, common.planes(np.diff(key[a:b], prepend=np.uint64(0))), *[common.planes(o[a:b]) for o in others]) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def vocabulary(docs: DataFrame, share: float = SHARE) -> Vocabulary:
    spark = docs.sparkSession
    n = common.n_parts(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n_docs = [], 0
            for w in W.words(b.column("text")):
                held.append(W.sorted_counts(w.hash))
                n_docs += len(np.unique(w.row))
                if sum(len(k) for k, _ in held) > 1_500_000:
                    held = [W.sorted_counts(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
            if n_docs:
                k, c = W.sorted_counts(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                yield _batch(_pieces("word", common.spread(k, n), n, k, [c.astype(np.uint32)]) + [("docs", 0, common.planes(np.array([n_docs])))])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, n_docs = [], [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["part"] == "docs":
                    n_docs += int(common.unplanes(r["k"], np.int64)[0])
                else:
                    keys.append(common.unpack_keys(r["k"]))
                    counts.append(common.unplanes(r["v0"], np.uint32).astype(np.int64))
        if keys:
            k, c = W.sorted_counts(np.concatenate(keys), np.concatenate(counts))
            # a word of the vocabulary has more than share of this partition's tokens, too
            often = c >= share * c.sum()
            yield _batch([("word", None, common.planes(k[often]), common.planes(c[often])), ("total", None, common.planes(np.array([c.sum()])), common.planes(np.array([n_docs])))])
        elif n_docs:
            yield _batch([("total", None, common.planes(np.array([0])), common.planes(np.array([n_docs])))])

    counted = common.materialize(common.by_pid(docs.select("text").mapInArrow(common.lean(count), TABLE), n).mapInArrow(common.lean(total), TABLE), "words")
    common.release(spark)
    tokens = n_docs = 0
    for r in counted.where("part = 'total'").collect():
        tokens += int(common.unplanes(bytes(r["k"]), np.int64)[0])
        n_docs += int(common.unplanes(bytes(r["v0"]), np.int64)[0])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column("k"), b.column("v0")):
                k, c = common.unplanes(k.as_py(), np.uint64), common.unplanes(c.as_py(), np.int64)
                ok = c >= share * tokens
                yield pa.RecordBatch.from_arrays([pa.array(k[ok].view(np.int64)), pa.array(c[ok])], names=["k", "c"])

    got = counted.where("part = 'word'").select("k", "v0").mapInArrow(common.lean(often), "k bigint, c bigint").toArrow()
    common.drop(counted)
    h, c = got.column("k").to_numpy().view(np.uint64), got.column("c").to_numpy()
    if len(h) + FIRST > int(LOW):
        raise ValueError(f"{len(h)} words have no numbers of {int(BITS)} bits: raise the share")
    order = np.argsort(h)
    h, c = h[order], c[order]
    count_ = np.concatenate([[max(1, tokens - int(c.sum())), 0, n_docs], c]).astype(np.int64)
    return Vocabulary(h, count_, int(count_.sum()), n)


def trigrams(w: W.Words, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Key (three words of 20 bits) and row of each token's trigram, the closing </s> too."""
    n = np.bincount(w.row, minlength=w.hi - w.lo)
    has = n > 0
    begin = np.cumsum(np.where(has, n + 3, 0)) - np.where(has, n + 3, 0)
    seq = np.full(int((n[has] + 3).sum()), START, np.uint64)
    ids = (W.find(vocab.hash, w.hash) + FIRST).astype(np.uint64)
    ids[ids == FIRST - 1] = UNK
    first = np.cumsum(n) - n
    seq[begin[w.row] + 2 + np.arange(len(ids)) - first[w.row]] = ids
    seq[begin[has] + n[has] + 2] = END
    row = np.repeat(np.flatnonzero(has), n[has] + 3)
    if len(seq) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key = seq[:-2] << np.uint64(40) | seq[1:-1] << BITS | seq[2:]
    ok = row[:-2] == row[2:]
    return key[ok], row[2:][ok]


def discounts(counts_of_counts: np.ndarray, k: int = K) -> np.ndarray:
    """d[r] for r = 0..k (d[0] unused): Katz's Good-Turing ratio, or absolute discounting where that isn't in (0, 1]."""
    n = np.maximum(counts_of_counts.astype(float), 0)
    d = np.ones(k + 1)
    top = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    for r in range(1, k + 1):
        ratio = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        value = (ratio - top) / (1 - top) if top < 1 else 0.0
        d[r] = value if 0 < value <= 1 else (r - absolute) / r
    return d


def _hist(c: np.ndarray) -> bytes:
    return common.planes(np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 3].astype(np.int64))


def _hists(df: DataFrame) -> np.ndarray:
    out = np.zeros(K + 3, np.int64)
    for r in df.select("k").toLocalIterator():
        out += common.unplanes(bytes(r["k"]), np.int64)
    return out


def _gather(batches: Iterator[pa.RecordBatch], kinds: dict[str, tuple]) -> dict[str, list[np.ndarray]]:
    held: dict[str, list[list[np.ndarray]]] = {p: [[] for _ in range(1 + len(t))] for p, t in kinds.items()}
    for b in batches:
        for r in b.to_pylist():
            own = held[r["part"]]
            own[0].append(common.unpack_keys(r["k"]))
            for i, t in enumerate(kinds[r["part"]]):
                own[1 + i].append(common.unplanes(r[f"v{i}"], t))
    return {p: [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(cols, (np.uint64, *kinds[p]))] for p, cols in held.items()}


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def train(docs: DataFrame, vocab: Vocabulary, cut: int = CUT) -> DataFrame:
    """The model: rows of TABLE, partitioned by ``part``: ``tri`` and ``bi`` have n-grams and the logarithms of their probabilities,
    ``alpha2`` and ``alpha1`` contexts of two words and of one and the logarithms of their weights; ``pid`` is the partition they belong to."""
    spark = docs.sparkSession
    n = vocab.parts
    shared = spark.sparkContext.broadcast(vocab)  # at most 1 / SHARE words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        splits = v.splits
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            k, c = W.sorted_counts(np.concatenate(held))
            return _batch(_pieces("tri", v.pid(k >> np.uint64(40), k >> BITS & LOW, splits), n, k, [c.astype(np.uint32)]))

        for b in batches:
            for w in W.words(b.column("text")):
                held.append(trigrams(w, v)[0])
                if sum(map(len, held)) > 2_500_000:
                    yield out()
                    held = []
        if sum(map(len, held)):
            yield out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = _gather(batches, {"tri": (np.uint32,)})["tri"]
        if not len(k):
            return
        k, c = W.sorted_counts(k, c.astype(np.int64))
        at = _starts(k >> BITS)
        whole = np.repeat(np.add.reduceat(c, at), np.diff(np.append(at, len(k))))
        held = c >= cut
        yield _batch([("hist3", None, _hist(c))])
        if held.any():
            pid = np.full(held.sum(), int(vocab_pid(k[:1])[0]))
            yield _batch(_pieces("tri", pid, n, k[held], [c[held], whole[held].astype(np.int64)]))
        b, c = W.sorted_counts(k & np.uint64((1 << 40) - 1), c)
        yield _batch(_pieces("bi", common.spread(b >> BITS, n), n, b, [c]))

    def vocab_pid(k: np.ndarray) -> np.ndarray:
        v = shared.value
        return v.pid(k >> np.uint64(40), k >> BITS & LOW, v.splits)

    counted = common.materialize(common.by_pid(docs.select("text").mapInArrow(common.lean(count), TABLE), n).mapInArrow(common.lean(total), TABLE), "trigrams", ("part",))
    common.release(spark)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = _gather(batches, {"bi": (np.int64,)})["bi"]
        if not len(k):
            return
        k, c = W.sorted_counts(k, c)
        at = _starts(k >> BITS)
        whole = np.repeat(np.add.reduceat(c, at), np.diff(np.append(at, len(k))))
        held = c >= cut
        yield _batch([("hist2", None, _hist(c))])
        if held.any():
            yield _batch(_pieces("bi", np.full(held.sum(), int(common.spread(k[:1] >> BITS, n)[0])), n, k[held], [c[held], whole[held].astype(np.int64)]))

    columns = ["part", "pid", "k", "v0", "v1"]
    bigrams = common.materialize(common.by_pid(counted.where("part = 'bi'").select(columns), n).mapInArrow(common.lean(sums), TABLE), "bigrams", ("part",))
    d3, d2 = discounts(_hists(counted.where("part = 'hist3'"))), discounts(_hists(bigrams.where("part = 'hist2'")))

    def probabilities(c: np.ndarray, whole: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(c <= K, d[np.minimum(c, K)], 1.0) * c / whole

    def weights(p: np.ndarray, lower: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p, made to add up to 1 where nothing is left for the lower order, and the contexts' weights."""
        mass, rest = np.add.reduceat(p, at), 1 - np.add.reduceat(lower, at)
        full = rest < 1e-12
        sizes = np.diff(np.append(at, len(p)))
        p = np.where(np.repeat(full, sizes), p / np.repeat(mass, sizes), p)
        return p, np.where(full, 0.0, np.maximum(1 - mass, 0) / np.where(full, 1, rest))

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bigrams and their contexts' weights, to each partition that holds contexts of theirs."""
        v = shared.value
        k, c, whole = _gather(batches, {"bi": (np.int64, np.int64)})["bi"]
        if not len(k):
            return
        order = np.argsort(k)
        k, c, whole = k[order], c[order].astype(np.int64), whole[order]
        at = _starts(k >> BITS)
        p, alpha = weights(probabilities(c, whole, d2), np.exp(v.log())[(k & LOW).astype(np.int64)], at)
        with np.errstate(divide="ignore"):
            p, alpha = np.log(p), np.log(alpha)
        first = k[at] >> BITS
        splits = v.splits[first.astype(np.int64)]
        sizes = np.diff(np.append(at, len(k)))
        for s in range(int(splits.max())):
            own = splits > s
            pid = common.spread(first[own] << BITS | np.uint64(s), n)
            rows = np.repeat(own, sizes)
            yield _batch(_pieces("bi", np.repeat(pid, sizes[own]), n, k[rows], [p[rows]]) + _pieces("alpha1", pid, n, first[own], [alpha[own]]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches, {"tri": (np.int64, np.int64), "bi": (np.float64,), "alpha1": (np.float64,)})
        rows = []
        for part in ("bi", "alpha1"):
            k, p = got[part]
            if len(k):
                k, first = np.unique(k, return_index=True)  # several splits of a word may be in one partition
                got[part] = [k, p[first]]
                rows += _pieces(part, np.zeros(len(k), np.int64), 1, k, [p[first]])
        k, c, whole = got["tri"]
        if len(k):
            order = np.argsort(k)
            k, c, whole = k[order], c[order].astype(np.int64), whole[order]
            at = _starts(k >> BITS)
            where = W.find(got["bi"][0], k & np.uint64((1 << 40) - 1))  # a trigram that is held has a bigram that is
            p, alpha = weights(probabilities(c, whole, d3), np.exp(got["bi"][1][where]), at)
            with np.errstate(divide="ignore"):
                rows += _pieces("tri", np.zeros(len(k), np.int64), 1, k, [np.log(p)]) + _pieces("alpha2", np.zeros(len(at), np.int64), 1, k[at] >> BITS, [np.log(alpha)])
        if rows:
            own = int(vocab_pid(got["tri"][0][:1])[0]) if len(k) else None
            if own is None:
                from pyspark import TaskContext

                own = TaskContext.get().partitionId()
            yield _batch([(r[0], own, *r[2:]) for r in rows])

    both = common.by_pid(bigrams.where("part = 'bi'").select(columns), n).mapInArrow(common.lean(copies), TABLE).unionByName(counted.where("part = 'tri'").select(columns))
    model = common.materialize(common.by_pid(both, n).mapInArrow(common.lean(finish), TABLE), "katz", ("part",))
    common.drop(counted)
    common.drop(bigrams)
    common.release(spark)
    return model


def score(docs: DataFrame, vocab: Vocabulary, model: DataFrame) -> DataFrame:
    """doc_id, n_tokens (with the closing one), how many of them backed off to bigrams and to unigrams, log_prob, perplexity."""
    spark = docs.sparkSession
    n = vocab.parts
    shared = spark.sparkContext.broadcast(vocab)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        splits = v.splits
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            k, d = np.concatenate(keys), np.concatenate(ids)
            return _batch(_pieces("token", v.pid(k >> np.uint64(40), k >> BITS & LOW, splits), n, k, [d]))

        for b in batches:
            doc = b.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            for w in W.words(b.column("text")):
                k, row = trigrams(w, v)
                keys.append(k)
                ids.append(doc[w.lo + row])
                if sum(map(len, keys)) > 1_500_000:
                    yield out()
                    keys, ids = [], []
        if sum(map(len, keys)):
            yield out()

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = (np.float64,)
        got = _gather(batches, {"token": (np.int64,), "tri": one, "bi": one, "alpha2": one, "alpha1": one})
        k, doc = got.pop("token")
        if not len(k):
            return
        tables = {}
        for part, (x, p) in got.items():
            order = np.argsort(x)
            tables[part] = x[order], p[order]

        def look(part: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x, p = tables[part]
            at = W.find(x, key)
            return at >= 0, p[at] if len(p) else np.zeros(len(key))

        unigram = shared.value.log()

        def lower(key: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
            """Logarithm of the probability of the last word after the order - 1 before it, and the order that gave it, recursively."""
            if order == 1:
                return unigram[(key & LOW).astype(np.int64)], np.ones(len(key), np.int64)
            found, p = look("tri" if order == 3 else "bi", key)
            level = np.full(len(key), order)
            rest = np.flatnonzero(~found)
            if len(rest):
                has, alpha = look(f"alpha{order - 1}", key[rest] >> BITS)
                q, used = lower(key[rest] & np.uint64((1 << 20 * (order - 1)) - 1), order - 1)
                p = p.copy()
                p[rest], level[rest] = q + np.where(has, alpha, 0.0), used
            return p, level

        each, times = W.sorted_counts(k)
        p, level = lower(each, 3)
        order = np.argsort(k, kind="stable")
        p, level, doc = np.repeat(p, times), np.repeat(level, times), doc[order]
        ids, at = np.unique(doc, return_inverse=True)
        counts = np.zeros(len(ids), COUNTS)
        counts["tokens"], counts["two"], counts["one"] = np.bincount(at), np.bincount(at, level == 2), np.bincount(at, level == 1)
        yield _batch(_pieces("doc", common.spread(ids.view(np.uint64), n), n, ids.view(np.uint64), [np.bincount(at, p), counts]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, s, c = _gather(batches, {"doc": (np.float64, COUNTS)})["doc"]
        if not len(k):
            return
        ids, at = np.unique(k, return_inverse=True)
        counts = [np.bincount(at, c[x]).astype(np.int64) for x in COUNTS.names]
        total = np.bincount(at, s)
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), *[pa.array(c) for c in counts], pa.array(np.round(total, 4)), pa.array(np.round(np.exp(-total / counts[0]), 3))], names=["doc_id", "n_tokens", "n_bigram", "n_unigram", "log_prob", "perplexity"])

    both = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(common.lean(tokens), TABLE).unionByName(model.select("part", "pid", "k", "v0", "v1"))
    summed = common.materialize(common.by_pid(both, n).mapInArrow(common.lean(evaluate), TABLE), "katz-sums")
    common.release(spark)
    return common.by_pid(summed, n).mapInArrow(common.lean(add), "doc_id bigint, n_tokens bigint, n_bigram bigint, n_unigram bigint, log_prob double, perplexity double")


def fit_score(docs: DataFrame) -> DataFrame:
    vocab = vocabulary(docs)
    return score(docs, vocab, train(docs, vocab))


def op(spark, sf_dir: str) -> DataFrame:
    return fit_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_discount(order: int) -> str:
    n = [f"(SELECT coalesce(sum(n), 0) FROM hist{order} WHERE r = {r})::DOUBLE" for r in range(K + 2)]
    rows = []
    for r in range(1, K + 1):
        ratio = f"CASE WHEN {n[r]} > 0 THEN ({r + 1} * {n[r + 1]} / {n[r]}) / {r} ELSE 0 END"
        top = f"CASE WHEN {n[1]} > 0 THEN {K + 1} * {n[K + 1]} / {n[1]} ELSE 0 END"
        absolute = f"CASE WHEN {n[1]} > 0 THEN {n[1]} / ({n[1]} + 2 * {n[2]}) ELSE 0 END"
        rows.append(f"SELECT {r} AS r, CASE WHEN top < 1 AND (ratio - top) / (1 - top) > 0 AND (ratio - top) / (1 - top) <= 1 THEN (ratio - top) / (1 - top) ELSE ({r} - a) / {r} END AS d FROM (SELECT {ratio} AS ratio, {top} AS top, {absolute} AS a)")
    return " UNION ALL ".join(rows)


SQL = f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
u AS MATERIALIZED (SELECT r, doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
total AS MATERIALIZED (SELECT count(*) AS n, count(DISTINCT r) AS docs FROM u),
vocab AS MATERIALIZED (SELECT w, count(*) AS c FROM u GROUP BY w HAVING count(*) >= {SHARE} * (SELECT n FROM total)),
uni0 AS (SELECT w, c FROM vocab UNION ALL SELECT '</s>', docs FROM total UNION ALL SELECT '<unk>', greatest(1, (SELECT n FROM total) - (SELECT coalesce(sum(c), 0) FROM vocab))),
uni AS MATERIALIZED (SELECT w, c::DOUBLE / (SELECT sum(c) FROM uni0)::DOUBLE AS p FROM uni0),
s AS (SELECT r, doc_id, i, CASE WHEN v.w IS NULL THEN '<unk>' ELSE u.w END AS w FROM u LEFT JOIN vocab v ON u.w = v.w
      UNION ALL SELECT r, doc_id, len(w) + 1, '</s>' FROM w WHERE len(w) > 0),
t AS MATERIALIZED (SELECT doc_id, lag(w, 2, '<s>') OVER o AS a, lag(w, 1, '<s>') OVER o AS b, w AS c FROM s WINDOW o AS (PARTITION BY r ORDER BY i)),
tri0 AS MATERIALIZED (SELECT a, b, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY a, b) AS whole FROM t GROUP BY a, b, c),
bi0 AS MATERIALIZED (SELECT b, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY b) AS whole FROM t GROUP BY b, c),
hist3 AS MATERIALIZED (SELECT n AS r, count(*) AS n FROM tri0 GROUP BY ALL), hist2 AS MATERIALIZED (SELECT n AS r, count(*) AS n FROM bi0 GROUP BY ALL),
d3 AS MATERIALIZED ({_sql_discount(3)}), d2 AS MATERIALIZED ({_sql_discount(2)}),
bi1 AS (SELECT b, bi0.c, coalesce(d, 1.0::DOUBLE) * n / whole::DOUBLE AS p, uni.p AS q FROM bi0 LEFT JOIN d2 ON n = d2.r JOIN uni ON uni.w = bi0.c WHERE n >= {CUT}),
mass1 AS MATERIALIZED (SELECT b, sum(p) AS m, 1 - sum(q) AS rest FROM bi1 GROUP BY b),
bi AS MATERIALIZED (SELECT b, c, CASE WHEN rest < 1e-12 THEN p / m ELSE p END AS p FROM bi1 JOIN mass1 USING (b)),
tri1 AS (SELECT a, tri0.b, tri0.c, coalesce(d, 1.0::DOUBLE) * n / whole::DOUBLE AS p, bi.p AS q FROM tri0 LEFT JOIN d3 ON n = d3.r JOIN bi ON bi.b = tri0.b AND bi.c = tri0.c WHERE n >= {CUT}),
mass2 AS MATERIALIZED (SELECT a, b, sum(p) AS m, 1 - sum(q) AS rest FROM tri1 GROUP BY a, b),
tri AS MATERIALIZED (SELECT a, b, c, CASE WHEN rest < 1e-12 THEN p / m ELSE p END AS p FROM tri1 JOIN mass2 USING (a, b)),
e AS (
  SELECT t.doc_id, CASE WHEN tri.p IS NOT NULL THEN 3 WHEN bi.p IS NOT NULL THEN 2 ELSE 1 END AS level,
         CASE WHEN tri.p IS NOT NULL THEN ln(tri.p) ELSE coalesce(ln(CASE WHEN mass2.rest < 1e-12 THEN 0 ELSE greatest(1 - mass2.m, 0) / mass2.rest END), 0)
           + CASE WHEN bi.p IS NOT NULL THEN ln(bi.p) ELSE coalesce(ln(CASE WHEN mass1.rest < 1e-12 THEN 0 ELSE greatest(1 - mass1.m, 0) / mass1.rest END), 0) + ln(uni.p) END END AS l
  FROM t LEFT JOIN tri ON t.a = tri.a AND t.b = tri.b AND t.c = tri.c LEFT JOIN bi ON t.b = bi.b AND t.c = bi.c LEFT JOIN mass2 ON t.a = mass2.a AND t.b = mass2.b
  LEFT JOIN mass1 ON t.b = mass1.b JOIN uni ON t.c = uni.w WHERE t.doc_id IS NOT NULL)
SELECT doc_id, count(*) AS n_tokens, (count(*) FILTER (WHERE level = 2))::BIGINT AS n_bigram, (count(*) FILTER (WHERE level = 1))::BIGINT AS n_unigram,
       round(sum(l), 4) AS log_prob, round(exp(-sum(l) / count(*)), 3) AS perplexity
FROM e GROUP BY doc_id
"""
