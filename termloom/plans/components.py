"""Connected components and cycles by DataFrame fixpoints; every round is cut with a reliable checkpoint."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in local sessions that name none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="termloom-checkpoint-"))
        named = _own[0]
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in that folder."""
    context, named = df.sparkSession.sparkContext, _folder(df.sparkSession)
    if not context._jsc.sc().getCheckpointDir().isDefined():  # noqa: SLF001
        context.setCheckpointDir(named)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in that folder. Whoever reads it again gets the very same rows; columns are read singly and compressed."""
    path = f"{_folder(df.sparkSession)}/termloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b) of one comparable type: each node's least connected node, by pointer jumping."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node")
    now, last = checkpointed(now), None
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("n"))
        step = now.join(near, "node").select("node", F.least("root", "n").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = checkpointed(step.join(jump, "root").select("node", F.col("over").alias("root")))
        mark = new.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()[0]
        if mark == last:
            return new
        now, last = new, mark


def cyclic(edges: DataFrame) -> DataFrame:
    """(node) of every node that reaches itself along edges (child, parent): ends are peeled off, then reachability inside the rest."""
    now = checkpointed(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct())
    count = now.count()
    while count:
        new = now.join(now.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(now.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        new = checkpointed(new.select("child", "parent"))
        left = new.count()
        now = new
        if left == count:
            break
        count = left
    reach = now
    while count:
        new = reach.unionByName(reach.join(reach.select(F.col("child").alias("parent"), F.col("parent").alias("over")), "parent").select("child", F.col("over").alias("parent"))).distinct()
        new = checkpointed(new)
        grown = new.count()
        reach = new
        if grown == count:
            break
        count = grown
    return reach.where("child = parent").select(F.col("child").alias("node"))
