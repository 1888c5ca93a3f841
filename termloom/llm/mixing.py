"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Documents of one (shard, source) are laid end to end in order of a seeded hash and cut into blocks of ``block_tokens``
tokens; a document belongs to the block in which it starts. The budget of blocks is dealt to sources by the highest quotients
``w / (2 i + 1)``, i counting the blocks a source has got, never beyond the blocks it has; ties go to the lesser source name.
Each source's quota is dealt to its shards the same way by the blocks each shard has, ties to the lesser shard. Within a
(shard, source) blocks are taken in seeded order up to the quota.

Defined cases: null or blank texts hold no tokens and are never selected; a null source is a source of its own, named
``(none)``; null ids are kept and hashed as -1; rows repeated under one id are separate documents (their order within a block
follows id, then length, then text digest); empty tables give no rows; columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_TOKENS, SHARD_TOKENS, SHARE, SEED, MANY = 8192, 1 << 30, 0.8, 17, 100_000
NONE = "(none)"


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats per claimant (ties to the earlier one): the ``seats`` highest quotients w/(2i+1), i < cap, without a list of them."""
    got = [0] * len(weights)
    seats = min(seats, sum(caps))
    if seats <= 0:
        return got

    def count(w: float, cap: int, q: float) -> int:
        return min(cap, max(0, int((w / q + 1) / 2 + 1e-9))) if w > 0 else 0

    lo, hi = 0.0, max(max(weights), 1e-300)
    if sum(c for w, c in zip(weights, caps) if w > 0) > seats:
        for _ in range(200):  # the largest divisor that still leaves seats to deal one by one
            q = (lo + hi) / 2
            if not lo < q < hi:
                break
            lo, hi = (q, hi) if sum(count(w, c, q) for w, c in zip(weights, caps)) >= seats else (lo, q)
        # a little less than the last seat's quotient is dealt at once, the rest exactly in order
        got = [max(0, count(w, c, hi * (1 + 1e-12)) - 1) for w, c in zip(weights, caps)]
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps)) if g < c]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _hash(c, seed: int):
    x = F.pmod(F.coalesce(c, F.lit(-1)).cast("bigint"), F.lit(2147483647)) + 1
    x = F.pmod(x * 1103515245 + seed * 12345, F.lit(2147483648))
    return F.pmod(F.shiftrightunsigned(x, 7) * 69069 + x * 1664525 + 1013904223, F.lit(2147483648))


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """doc_id, source, shard, block, n_tokens and a row digest for every document that holds a token."""
    spark = docs.sparkSession
    trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source"), F.lit(NONE)).alias("source"),
        F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("bigint").alias("n_tokens"),
        F.length("text").alias("_len"),
        F.xxhash64("text").alias("_digest"),
    ).where("n_tokens > 0")
    base = common.materialize(base, "mixing")
    total = base.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    w = Window.partitionBy("shard", "source").orderBy(_hash(F.col("doc_id"), seed + 1), "doc_id", "_len", "_digest").rowsBetween(Window.unboundedPreceding, -1)
    return base.withColumn("shard", F.pmod(_hash(F.col("doc_id"), seed), F.lit(shards))).withColumn("block", F.floor(F.coalesce(F.sum("n_tokens").over(w), F.lit(0)) / block_tokens))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, share: float = SHARE, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """Selected documents: doc_id, source, shard, block, n_tokens (and the digest ``_digest`` of the text).

    ``weights`` are the target weights by source (absent sources weigh nothing); by default each source weighs the whole part of the
    square root of its tokens. ``share`` is the part of all blocks that is taken.
    """
    spark = docs.sparkSession
    cut = common.materialize(blocks(docs, block_tokens, shard_tokens, seed), "blocks")
    avail = cut.groupBy("source", "shard").agg(F.countDistinct("block").alias("avail"), F.sum("n_tokens").alias("tokens"))
    avail = common.materialize(avail, "avail")
    per = avail.groupBy("source").agg(F.sum("avail").alias("avail"), F.sum("tokens").alias("tokens"))
    if (n := per.count()) > MANY * 100:
        raise ValueError(f"{n} sources: name coarser sources; quotas are dealt in one place")
    rows = sorted(per.collect(), key=lambda r: r["source"].encode())
    targets = [float(weights.get(r["source"], 0)) if weights is not None else float(int(r["tokens"] ** 0.5)) for r in rows]
    quota = sainte_lague(targets, int(sum(r["avail"] for r in rows) * share), [r["avail"] for r in rows])
    quotas = spark.createDataFrame([(r["source"], q) for r, q in zip(rows, quota)], "source string, quota bigint")

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        caps = [int(x) for x in part["avail"]]
        return pd.DataFrame({"source": part["source"], "shard": part["shard"], "quota": sainte_lague([float(c) for c in caps], int(part["quota"].iloc[0]), caps)})

    dealt = avail.join(quotas, "source").groupBy("source").applyInPandas(deal, "source string, shard bigint, quota bigint")
    chosen = cut.select("source", "shard", "block").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("source", "shard").orderBy(_hash(F.col("block"), seed + 2), "block")))
    chosen = chosen.join(dealt, ["source", "shard"]).where("_r <= quota").select("source", "shard", "block")
    return cut.join(chosen, ["source", "shard", "block"], "left_semi").select("doc_id", "source", "shard", "block", "n_tokens", "_len", "_digest")


def op(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("_digest", "_len")


def _sql_hash(c: str, seed: int) -> str:
    x = f"((((({c})::BIGINT % 2147483647 + 2147483647) % 2147483647 + 1) * 1103515245 + {seed * 12345}) % 2147483648)"
    return f"((({x} >> 7) * 69069 + {x} * 1664525 + 1013904223) % 2147483648)"


def sql(docs: str = "documents") -> str:
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, len([x for x in regexp_split_to_array(text, '\\s+') if x <> ''])::BIGINT AS n_tokens,
         text FROM {docs}
), held AS (SELECT * FROM base WHERE n_tokens > 0),
sharded AS (SELECT *, {_sql_hash("coalesce(doc_id, -1)", SEED)} % greatest(1, ceil((SELECT sum(n_tokens) FROM held) / {SHARD_TOKENS}.0)::BIGINT) AS shard FROM held),
cut AS (
  SELECT doc_id, source, shard, n_tokens, (coalesce(sum(n_tokens) OVER (PARTITION BY shard, source ORDER BY {_sql_hash("coalesce(doc_id, -1)", SEED + 1)}, doc_id, length(text)
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BLOCK_TOKENS})::BIGINT AS block FROM sharded
),
avail AS (SELECT source, shard, count(DISTINCT block) AS avail, sum(n_tokens) AS tokens FROM cut GROUP BY ALL),
per AS (SELECT source, sum(avail)::BIGINT AS avail, floor(sqrt(sum(tokens)::BIGINT)) AS w FROM avail GROUP BY source),
seats AS (SELECT source, row_number() OVER (ORDER BY w / (2 * i + 1) DESC, source) AS r FROM (SELECT source, w, unnest(range(avail)) AS i FROM per)),
quota AS (SELECT source, count(*) AS q FROM seats WHERE r <= (SELECT floor(sum(avail) * {SHARE}::DOUBLE) FROM per) GROUP BY source),
shard_seats AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY avail / (2.0::DOUBLE * i + 1) DESC, shard) AS r
  FROM (SELECT source, shard, avail, unnest(range(avail)) AS i FROM avail)
),
dealt AS (SELECT s.source, s.shard, count(*) AS q FROM shard_seats s JOIN quota USING (source) WHERE s.r <= quota.q GROUP BY ALL),
ranked AS (
  SELECT source, shard, block, row_number() OVER (PARTITION BY source, shard ORDER BY {_sql_hash("block", SEED + 2)}, block) AS r
  FROM (SELECT DISTINCT source, shard, block FROM cut)
)
SELECT c.doc_id, c.source, c.shard::BIGINT AS shard, c.block, c.n_tokens
FROM cut c JOIN ranked k USING (source, shard, block) JOIN dealt d USING (source, shard) WHERE k.r <= d.q
"""
