"""Continuous snapshots: statements that arrive as a stream, applied batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import snapshot


def apply_snapshots(stream: DataFrame, folder: str, checkpoint: str, today: str):
    """Each micro-batch is a snapshot: its subjects' dates are dealt against the previous one in ``folder`` and it becomes the next.

    A batch that is run again after a failure writes the same path again, so the effect is once only."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        now = batch.persist()
        old = spark.read.schema(now.schema).parquet(f"{folder}/batch={n - 1}") if n else now.limit(0)
        snapshot.dated(now, old, today).write.mode("overwrite").parquet(f"{folder}/dates={n}")
        now.write.mode("overwrite").parquet(f"{folder}/batch={n}")
        now.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
