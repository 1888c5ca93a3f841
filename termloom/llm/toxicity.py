"""Toxicity by lexicon induction.

1. Vocabulary: the words that at least ``least`` documents hold, at any size of corpus, counted over every document.
2. Seeds: words whose log-odds between the toxic and the clean of a bounded sample of labelled documents are at least ``odds``, with
   a likelihood ratio of at least ``ratio``, by documents and by distinct neighbourhoods (so that copies of one document count
   once) are toxic seeds; words that two or more clean documents hold, with log-odds under a third of ``odds``, are clean seeds.
3. Graph of the vocabulary: co-occurrence counts within ``window`` words over all documents, less two standard deviations, positive pointwise mutual
   information (contexts smoothed by the power 0.75), and each word's ``near`` strongest neighbours, made symmetric.
4. Polarity: the chance that a random walk from a word meets a toxic seed first, less the chance that it meets a clean one first
   (the seeds' own are 1 and -1). Words with a polarity of at least ``cut`` are the lexicon.
5. Score: the sum of the lexicon's polarities over a document's words; the threshold is the one of best F1 on the labelled sample.

The vocabulary, thus the graph with ``near`` edges a word, is what the driver holds and grows with the corpus as distinct words do;
counts are made by the executors.

Defined cases: a null or empty text has no words, the score 0 and is not toxic; every row is scored, whatever its id; labels of a
null id or with a null verdict are left out, contrary labels of one id count as toxic; without labels of both kinds, or without
seeds, the lexicon is empty and nothing is toxic; ties between neighbours go to the lesser hash; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import words as W

LABELLED = 100_000  #: labelled documents that seeds and threshold are fitted on, at most
LEAST, WINDOW, NEAR, ODDS, RATIO, STEPS, CUT, PAIRS, SEED = 8, 5, 25, 1.5, 25.0, 200, 0.5, 5, 41
ROUNDS = 2  #: rounds in which pairs are counted, each those of its share of the words, so that less is exchanged at once; results don't depend on it
SCHEMA = "doc_id bigint, n_words bigint, n_hits bigint, toxicity double"


def labelled(labels: DataFrame, most: int = LABELLED, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids (ascending) and verdicts of a sample of labels, by seeded hash."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if (n := one.count()) > most:  # a little fewer than the bound are drawn by hash, so that no task sends rows that aren't wanted
        one = one.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(0.97 * most / n * (1 << 30))).limit(most)
    rows = one.collect()
    ids, verdict = np.array([r["doc_id"] for r in rows], np.int64), np.array([r["toxic"] for r in rows], np.int64)
    order = np.argsort(ids)
    return ids[order], verdict[order]


def frequencies(docs: DataFrame, ids: np.ndarray, verdict: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (ascending) of the vocabulary, and how many of all, toxic and clean documents hold each."""
    n = common.n_parts(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            known = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            at = W.find(ids, doc)
            kind = np.where((at >= 0) & known, verdict[at] if len(ids) else 0, -1)
            keys, parts = [], []
            for w in W.words(b.column("text")):
                own = kind[w.lo + w.row]
                order = np.lexsort((w.hash, w.row))  # rows ascend already: sorts the words of each
                h, r, own = w.hash[order], w.row[order], own[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                keys.append(h[first])
                parts.append(1 + (own[first] == 1) * (1 << 20) + (own[first] == 0) * (1 << 40))
            if keys:
                k, c = W.sorted_counts(np.concatenate(keys), np.concatenate(parts).astype(np.int64))
                for a in range(0, len(k), 1 << 20):  # counts of a batch stay under 2**20
                    part = slice(a, a + (1 << 20))
                    yield common.pack(common.spread(k[part], n), n, k[part], [(c[part] & 0xFFFFF).astype(np.uint32), (c[part] >> 20 & 0xFFFFF).astype(np.uint32), (c[part] >> 40).astype(np.uint32)])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, *cols = common.unpacked(batches, (np.uint32,) * 3)
        if len(k):
            order = np.argsort(k)
            k = k[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sums = [np.add.reduceat(c[order].astype(np.int64), first) for c in cols]
            ok = sums[0] >= least
            yield pa.RecordBatch.from_arrays([pa.array(k[first][ok].view(np.int64)), *[pa.array(s[ok]) for s in sums]], names=["word", "df", "toxic", "clean"])

    packed = docs.select("doc_id", "text").mapInArrow(common.lean(count), common.packed_schema(3))
    got = common.by_pid(packed, n).mapInArrow(common.lean(total), "word bigint, df bigint, toxic bigint, clean bigint").toArrow()
    word = got.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], *(got.column(c).to_numpy()[order] for c in ("df", "toxic", "clean"))


def evidence(toxic: np.ndarray, clean: np.ndarray, verdict: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds between toxic and clean, and Dunning's likelihood ratio of the two counts against the sample's shares."""
    n1, n0 = int((verdict == 1).sum()), int((verdict == 0).sum())
    odds = np.log((toxic + 0.5) / (n1 + 0.5)) - np.log((clean + 0.5) / (n0 + 0.5))
    both = np.maximum(toxic + clean, 1e-9)
    part = n1 / max(1, n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (both * part)), 0) + np.where(clean > 0, clean * np.log(clean / (both * (1 - part))), 0))
    return odds, g


def contexts(docs: DataFrame, ids: np.ndarray, verdict: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """(toxic, clean) numbers of distinct neighbourhoods (word before and word after) of the candidates in the sample: copies of a document count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = W.find(ids, b.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False))
            keep = (at >= 0) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            b, at = b.filter(pa.array(keep)), at[keep]
            rows = []
            for w in W.words(b.column("text")):
                k = W.find(candidates, w.hash)
                near = np.zeros(len(k) + 2, np.uint64)
                near[1:-1] = w.hash
                around = common.mix64(near[:-2] * common.MIX + near[2:])
                rows.append(np.stack([k, around.view(np.int64), verdict[at[w.lo + w.row]]], 1)[k >= 0])
            if rows:
                r = np.unique(np.concatenate(rows), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(r[:, c]) for c in range(3)], names=["k", "around", "verdict"])

    out = np.zeros((2, len(candidates)))
    for r in docs.select("doc_id", "text").mapInArrow(common.lean(run), "k bigint, around bigint, verdict bigint").groupBy("k", "verdict").agg(F.countDistinct("around").alias("n")).toArrow().to_pylist():
        out[0 if r["verdict"] else 1, r["k"]] = r["n"]
    return out


def seeds(docs: DataFrame, ids: np.ndarray, verdict: np.ndarray, vocabulary: np.ndarray, toxic: np.ndarray, clean: np.ndarray, odds: float = ODDS, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the vocabulary are toxic, which are clean seeds."""
    delta, g = evidence(toxic, clean, verdict)
    pos = (delta >= odds) & (g >= ratio)
    if pos.any():
        n = contexts(docs, ids, verdict, vocabulary[pos])
        delta2, g2 = evidence(n[0], n[1], verdict)
        pos[pos] = (delta2 >= odds) & (g2 >= ratio)
    return pos, (delta < odds / 3) & (clean >= 2) & ~pos


def graph(docs: DataFrame, vocabulary: np.ndarray, window: int = WINDOW, near: int = NEAR, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, weight) to each word's strongest neighbours by positive pointwise mutual information."""
    spark = docs.sparkSession
    n, v = common.n_parts(spark), len(vocabulary)
    shared = spark.sparkContext.broadcast(vocabulary)

    def counting(own: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, held, size = shared.value, [], 0
            mine = common.mix64(np.arange(v, dtype=np.uint64) + np.uint64(5)) % np.uint64(ROUNDS) == own

            def out() -> pa.RecordBatch:
                k, c = W.sorted_counts(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
                return common.pack(common.spread(k // np.uint64(v), n), n, k, [c])

            for b in batches:
                for w in W.words(b.column("text")):
                    ids = W.find(table, w.hash)
                    keys = []
                    for d in range(1, window + 1):
                        i, j = ids[:-d], ids[d:]
                        ok = (i >= 0) & (j >= 0) & (w.row[:-d] == w.row[d:])
                        i, j = np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])
                        ok = mine[i]
                        keys.append((i[ok] * v + j[ok]).astype(np.uint64))
                    k, c = W.sorted_counts(np.concatenate(keys))
                    held.append((k, c.astype(np.uint32)))
                    size += len(held[-1][0])
                    if size > 600_000:
                        merged = W.sorted_counts(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
                        held, size = [merged], 0
                        if len(merged[0]) > 2_000_000:
                            yield out()
                            held = []
            if held:
                yield out()

        return count

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that occur often enough, in both directions, and (pid null) words and their counts in all pairs."""
        k, c = common.unpacked(batches, (np.uint32,))
        k, c = W.sorted_counts(k, c.astype(np.int64))
        i, j = (k // v).astype(np.int64), (k % v).astype(np.int64)
        sums = np.bincount(i, c, v) + np.bincount(j[i != j], c[i != j], v) if len(k) else np.zeros(v)
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([common.planes(own)], pa.binary()), pa.array([common.planes(sums[own].astype(np.int64))], pa.binary())], names=["pid", "k", "v0"])
        often = (c >= pairs) & (i != j)
        i, j, c = i[often], j[often], c[often]
        i, j, c = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([c, c])
        yield common.pack(common.spread(i.astype(np.uint64), n), n, (i * v + j).astype(np.uint64), [c.astype(np.int64)])

    rounds = []
    for own in range(ROUNDS):
        counted = common.by_pid(docs.select("text").mapInArrow(common.lean(counting(own)), common.packed_schema(1)), n).mapInArrow(common.lean(total), common.packed_schema(1))
        rounds.append(common.materialize(counted, "pairs"))
        common.release(spark)
    counted = rounds[0]
    for more in rounds[1:]:
        counted = counted.unionByName(more)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(v)
        for b in batches:
            for k, c in zip(b.column("k"), b.column("v0")):
                sums[common.unplanes(k.as_py(), np.int64)] += common.unplanes(c.as_py(), np.int64)
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums[own])], names=["i", "c"])

    sums = np.zeros(v)
    got = counted.where("pid IS NULL").mapInArrow(common.lean(margins), "i bigint, c double").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    sums[got.column("i").to_numpy()] = got.column("c").to_numpy()
    shares = spark.sparkContext.broadcast((np.log(np.maximum(sums, 1) / max(1.0, sums.sum())), np.log(np.maximum(sums, 1) ** 0.75 / max(1.0, (sums**0.75).sum())), float(np.log(max(1.0, sums.sum())))))

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = common.unpacked(batches, (np.int64,))
        k, c = W.sorted_counts(k, c.astype(np.float64))  # a pair comes from one place
        i, j = (k // v).astype(np.int64), (k % v).astype(np.int64)
        own, context, whole = shares.value
        w = np.round(np.log(np.maximum(c - 2 * np.sqrt(c), 1e-9)) - whole - own[i] - context[j], 9)
        i, j, w = i[w > 0], j[w > 0], w[w > 0]
        order = np.lexsort((j, -w, i))
        i, j, w = i[order], j[order], w[order]
        top = np.arange(len(i)) - np.searchsorted(i, i, "left") < near
        yield pa.RecordBatch.from_arrays([pa.array(i[top]), pa.array(j[top]), pa.array(w[top])], names=["i", "j", "w"])

    top = common.by_pid(counted.where("pid IS NOT NULL"), n).mapInArrow(common.lean(strongest), "i bigint, j bigint, w double").toArrow()
    for r in rounds:
        common.drop(r)
    return tuple(top.column(x).to_numpy() for x in ("i", "j", "w"))


def polarity(n: int, edges: tuple[np.ndarray, np.ndarray, np.ndarray], toxic: np.ndarray, clean: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Polarity of each of n words: a random walk from the word over the graph ends at the first seed it meets; the chance that it
    is a toxic one less the chance that it is a clean one. Walks that meet no seed within ``steps`` count for neither."""
    i, j, w = edges
    key, first = np.unique(np.minimum(i, j) * np.int64(n) + np.maximum(i, j), return_index=True)
    i, j, w = np.concatenate([key // n, key % n]), np.concatenate([key % n, key // n]), np.concatenate([w[first]] * 2)
    out = np.bincount(i, w, n)
    step = w / out[i]
    value = toxic * 1.0 - clean * 1.0
    fixed, start = toxic | clean, value
    for _ in range(steps):
        new = np.where(fixed, start, np.bincount(i, value[j] * step, n))
        done = np.abs(new - value).max(initial=0) < 1e-9
        value = new
        if done:
            break
    return value


def score(docs: DataFrame, lexicon: np.ndarray, weights: np.ndarray) -> DataFrame:
    """n_words, n_hits and the summed polarity of every document."""
    order = np.argsort(lexicon)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon[order], weights[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weight = shared.value
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], []]
            for w in W.words(b.column("text")):
                at = W.find(table, w.hash)
                hit = at >= 0
                n = w.hi - w.lo
                cols[0].append(np.bincount(w.row, minlength=n))
                cols[1].append(np.bincount(w.row[hit], minlength=n))
                cols[2].append(np.bincount(w.row[hit], weight[at[hit]] if len(table) else None, n).astype(float))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(np.concatenate(c)) for c in cols]], names=["doc_id", "n_words", "n_hits", "toxicity"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), SCHEMA)


def threshold(scores: np.ndarray, verdict: np.ndarray) -> float:
    """The cut of best F1: halfway between the least score that is caught and the next lower one."""
    if not (verdict == 1).any() or not (scores > 0).any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(verdict[order] == 1)
    last = np.append(s[1:] != s[:-1], True) & (s > 0)
    f1 = np.where(last, 2 * hit / (np.arange(1, len(s) + 1) + (verdict == 1).sum()), -1)
    best = int(f1.argmax())
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else 0)) / 2)


def induce(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lexicon and weights, and the labelled sample."""
    ids, verdict = labelled(labels)
    vocabulary, _, toxic, clean = frequencies(docs, ids, verdict)
    pos, neg = seeds(docs, ids, verdict, vocabulary, toxic, clean)
    if not pos.any() or not neg.any():
        return np.empty(0, np.uint64), np.empty(0), ids, verdict
    p = polarity(len(vocabulary), graph(docs, vocabulary), pos, neg)
    return vocabulary[p >= cut], p[p >= cut], ids, verdict


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hits, toxicity and the verdict ``toxic`` of every document."""
    lexicon, weights, ids, verdict = induce(docs, labels)
    scored = common.materialize(score(docs, lexicon, weights), "toxicity")
    sample = docs.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(ids, verdict)], "doc_id bigint, verdict bigint")
    known = scored.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxicity").alias("s"), F.max("verdict").alias("v")).toArrow()  # bounded by the sample
    cut = threshold(known.column("s").to_numpy(), known.column("v").to_numpy())
    return scored.withColumn("toxic", F.col("toxicity") >= F.lit(cut))


def op(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
