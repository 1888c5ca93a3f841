"""Helpers shared by the training-data operators: durable tables in the cluster's shared folder and packed exchanges."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); one of our own only in local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="termloom-shared-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/termloom-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, tag)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._termloom_path = path  # noqa: SLF001
    return out


def drop(df: DataFrame, part: str = "") -> None:
    """Delete a table made by :func:`materialize`, or that one of its parts."""
    path = getattr(df, "_termloom_path", None)
    if path:
        path = f"{path}/{part}".rstrip("/")
        jvm = df.sparkSession.sparkContext._jvm  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps, whose frames are garbage by now."""
    for _ in range(2):  # the first round frees the frames that hold the shuffles
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # noqa: SLF001
        time.sleep(0.5)


def n_parts(spark: SparkSession) -> int:
    """Partitions of an exchange: the session's setting, which the cluster sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


@functools.cache
def _freeze() -> None:
    """Once in a worker, leave the modules' objects out of its collections, each of which would go through all of them."""
    gc.freeze()


def lean(run):
    """``run`` for mapInArrow, after which the worker, which waits for other tasks, gives its free memory back."""

    def own(batches):
        _freeze()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return own


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def planes(a: np.ndarray) -> bytes:
    """Bytes of a fixed-width array, plane by plane, so that block compression finds the equal high bytes."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, len(b) // size).T).view(dtype).ravel() if b else np.empty(0, dtype)


def pack(pid: np.ndarray, n: int, key: np.ndarray, others: list[np.ndarray]) -> pa.RecordBatch:
    """One row per partition id: the keys, sorted and as differences, and the other columns in the same order, as bytes."""
    order = np.lexsort((key, pid))
    cuts = np.searchsorted(pid[order], np.arange(n + 1))
    key, others = key[order], [o[order] for o in others]
    rows = [p for p in range(n) if cuts[p] < cuts[p + 1]]
    cols: list[list[bytes]] = [[] for _ in range(1 + len(others))]
    for p in rows:
        s = slice(cuts[p], cuts[p + 1])
        k = key[s]
        d = np.empty_like(k)
        d[0] = k[0]
        np.subtract(k[1:], k[:-1], out=d[1:])
        cols[0].append(planes(d))
        for c, o in zip(cols[1:], others):
            c.append(planes(o[s]))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["pid", "k", *[f"v{i}" for i in range(len(others))]])


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def packed_schema(n_others: int) -> str:
    return "pid int, k binary" + "".join(f", v{i} binary" for i in range(n_others))


def spread(key: np.ndarray, n: int) -> np.ndarray:
    """Partition of each key."""
    return (mix64(key + MIX) % np.uint64(n)).astype(np.int64)


def by_pid(packed: DataFrame, n: int) -> DataFrame:
    """Rows of one partition id in one partition, and each id's rows in the partition of that number."""
    return packed.repartitionById(n, "pid")


def unpacked(batches, dtypes: tuple, size: int = 1) -> list[np.ndarray]:
    """The keys and other columns of all packed rows of a partition, end to end."""
    out: list[list[np.ndarray]] = [[] for _ in range(1 + len(dtypes))]
    for b in batches:
        for k in b.column("k"):
            out[0].append(unpack_keys(k.as_py()))
        for i, t in enumerate(dtypes):
            for v in b.column(f"v{i}"):
                out[1 + i].append(unplanes(v.as_py(), t))
    return [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.uint64, *dtypes))]


BINARY = ["k", *[f"v{i}" for i in range(8)]]
ROW_SCHEMA = "kind int, pid int, " + ", ".join(f"{c} binary" for c in BINARY)  #: rows of arrays as bytes


def row(kind: int, pid: int, *values: bytes) -> tuple:
    return (kind, pid, *values, *[None] * (len(BINARY) - len(values)))


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * len(BINARY)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "pid", *BINARY])


def runs(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of columns begin."""
    if not len(cols[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def numbered(ids: np.ndarray, n: int) -> np.ndarray:
    """Partition of ids that begin with its number."""
    return (ids >> np.uint64(40)).astype(np.int64)


def numbers(pid: int, seq: int, n: int) -> np.ndarray:
    """Ids of the n (at most 2**16) members of a partition's row of number seq."""
    return np.uint64(pid << 40 | seq << 16) + np.arange(n, dtype=np.uint64)


PAIR_SCHEMA = "pid int, kind int, k binary, v0 binary, v1 binary, v2 binary, v3 binary"
PAYLOAD, PAIRS, NEEDED, REQUEST = range(4)


def pair_row(pid: int, kind: int, k: np.ndarray, *rest: bytes) -> tuple:
    d = np.diff(k, prepend=np.uint64(0)) if kind == PAIRS else k
    return (pid, kind, planes(d), *rest, *[None] * (4 - len(rest)))


def pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["pid", "kind", "k", "v0", "v1", "v2", "v3"])


def squash(data: list[bytes], level: int = 2) -> bytes:
    """Payloads end to end, compressed together: those of one row are often alike."""
    return zstandard.compress(b"".join(data), level)


def payload_rows(ids: np.ndarray, data: list[bytes], n: int, to=spread) -> list[tuple]:
    """Rows that take each id's payload to its partition."""
    pid = to(ids, n)
    out = []
    for p in np.unique(pid).tolist():
        at = np.flatnonzero(pid == p)
        own = [data[i] for i in at]
        out.append(pair_row(p, PAYLOAD, ids[at], planes(np.array([len(x) for x in own], np.uint32)), squash(own)))
    return out


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending; np.unique hashes them first, which takes many times as long where most are different."""
    a = np.sort(a)
    return a[runs(a)]


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, ascending; places among the ids, not rows of two columns, are what is sorted."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    both = distinct(at[: len(a)].astype(np.uint64) << np.uint64(32) | at[len(a) :].astype(np.uint64))
    return ids[(both >> np.uint64(32)).astype(np.int64)], ids[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def pair_rows(a: np.ndarray, b: np.ndarray, n: int, to=spread) -> list[tuple]:
    """Rows that take pairs (a, b) to a's partition."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    pid, out = to(a, n), []
    for p in np.unique(pid).tolist():
        at = pid == p
        out.append(pair_row(p, PAIRS, a[at], planes(b[at])))
    return out


def found_rows(a: np.ndarray, b: np.ndarray, n: int, to=spread) -> list[tuple]:
    """Rows that take pairs (a, b) to a's partition, and the fact that b is needed to b's."""
    need = distinct(b)
    pid = to(need, n)
    return pair_rows(a, b, n, to) + [pair_row(p, NEEDED, need[pid == p]) for p in np.unique(pid).tolist()]


class _Payloads:
    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.data: list[bytes] = []

    def add(self, row: dict) -> None:
        sizes = unplanes(row["v0"], np.uint32)
        ends = np.cumsum(sizes).tolist()
        self.ids.append(unplanes(row["k"], np.uint64))
        data = zstandard.decompress(row["v1"])
        self.data += [data[e - s : e] for e, s in zip(ends, sizes.tolist())]

    def done(self) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.uint64)
        self.table, self.place = np.unique(ids, return_index=True)

    def take(self, keys: np.ndarray) -> list[bytes]:
        return [self.data[i] for i in self.place[np.searchsorted(self.table, keys)].tolist()]


def _rows(batches):
    for b in batches:
        yield from b.to_pylist()


def verify_pairs(found: DataFrame, payloads: DataFrame, verify, schema: str, n: int, to=spread) -> DataFrame:
    """What ``verify`` makes of the pairs. It is called with the payloads that a partition holds and gives an object with add(ids, payloads,
    i, partners, j), for pairs of each id's place i and a partner's place j, and end(); both give batches of ``schema``. ``to`` gives
    ids' partitions.

    ``found`` and ``payloads`` have PAIR_SCHEMA. A payload travels once to its own partition, from there only if it is in a pair, and
    then once to each partition that holds a partner, however many partners those are.
    """

    def route(batches):
        held, a, b, need = _Payloads(), [], [], []
        for r in _rows(batches):
            if r["kind"] == PAYLOAD:
                held.add(r)
            elif r["kind"] == PAIRS:
                a.append(np.cumsum(unplanes(r["k"], np.uint64), dtype=np.uint64))
                b.append(unplanes(r["v0"], np.uint64))
            else:
                need.append(unplanes(r["k"], np.uint64))
        held.done()
        if need:
            ids = distinct(np.concatenate(need))
            yield pair_batch(payload_rows(ids, held.take(ids), n, to))
        if not a:
            return
        a, b = np.concatenate(a), np.concatenate(b)
        at = to(b, n)
        order = np.lexsort((b, a, at))
        a, b, at = a[order], b[order], at[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b, at = a[new], b[new], at[new]
        for p in np.unique(at).tolist():
            mine = slice(*np.searchsorted(at, [p, p + 1]))
            ids, first = np.unique(a[mine], return_index=True)
            counts = np.diff(np.append(first, len(a[mine]))).astype(np.uint32)
            for i in range(0, len(ids), 2000):
                part = ids[i : i + 2000]
                own = held.take(part)
                lo, hi = int(first[i]), int(first[i]) + int(counts[i : i + 2000].sum())
                yield pair_batch([pair_row(p, REQUEST, part, planes(np.array([len(x) for x in own], np.uint32)), squash(own), planes(counts[i : i + 2000]), planes(b[mine][lo:hi]))])

    def check(batches):
        held, requests = _Payloads(), []
        for r in _rows(batches):
            held.add(r) if r["kind"] == PAYLOAD else requests.append(r)
        held.done()
        own = verify(held.data)
        for r in requests:
            ask = _Payloads()
            ask.add(r)
            counts, partners = unplanes(r["v2"], np.uint32), unplanes(r["v3"], np.uint64)
            yield from own.add(ask.ids[0], ask.data, np.repeat(np.arange(len(counts)), counts), partners, held.place[np.searchsorted(held.table, partners)])
        yield from own.end()

    routed = by_pid(found.unionByName(payloads), n).mapInArrow(lean(route), PAIR_SCHEMA)
    return by_pid(routed, n).mapInArrow(lean(check), schema)


def run_pairs(counts: np.ndarray, starts: np.ndarray, limit: int = 1_000_000):
    """Places (i, j), i < j, of all pairs within runs of equal keys, in arrays of about ``limit`` pairs."""
    for size in np.unique(counts[counts > 1]).tolist():
        at = starts[counts == size]
        if size * (size - 1) // 2 <= limit:
            i, j = np.triu_indices(size, 1)
            step = max(1, limit // len(i))
            for x in range(0, len(at), step):
                base = at[x : x + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            for s in at.tolist():
                for i in range(size - 1):
                    j = np.arange(i + 1, size)
                    yield np.full(len(j), s + i), s + j


ALONE = 2_000_000  #: edges up to which one task finds their components


def _least_connected(batches):
    """(node, root) of all edges (a, b) of the batches: roots' places are lowered to their least neighbour's until no edge joins two."""
    held = [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], 1) for b in batches]
    if not held:
        return
    ids, at = np.unique(np.concatenate(held), return_inverse=True)
    x, y = at.reshape(-1, 2).T
    root = np.arange(len(ids))
    while len(x):
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, hi, lo)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    for i in range(0, len(ids), 500_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 500_000]), pa.array(ids[root[i : i + 500_000]])], names=["node", "root"])


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, root): the least node that is connected with each node of the edges (a, b), by large and small stars.

    Each round joins neighbourhoods to their least node; rounds grow with the logarithm of the longest chain, and each is written
    to the shared folder. Up to ``alone`` edges are left to one task.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if dict(now.dtypes) == {"a": "bigint", "b": "bigint"} and now.count() <= alone:
        out = materialize(now.coalesce(1).mapInArrow(lean(_least_connected), "node bigint, root bigint"), "roots")
        drop(now)
        return out
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = materialize(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = new
        if mark == last:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())
        last = mark
