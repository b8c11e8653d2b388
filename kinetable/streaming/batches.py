"""Streams that are written batch by batch.

The output of a micro-batch is written under its number and overwritten when the batch is replayed, which
makes a restart after a lost executor or driver exact. State is never kept here: that is the state
store's part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame], DataFrame]


def start(stream: DataFrame, path: str, step: Step | None = None, *, mode: str = "append", **trigger) -> StreamingQuery:
    """Write the rows of every micro-batch, or ``step`` of them, below ``path/out``.

    ``path`` is in shared storage. In ``update`` mode a batch writes the keys that it changed; ``newest``
    reads the last row of each.
    """

    def handle(batch: DataFrame, number: int) -> None:
        (step(batch) if step else batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", f"{path}/progress")
    return (writer.trigger(**trigger) if trigger else writer).start()


def drain(stream: DataFrame, path: str, step: Step | None = None, *, mode: str = "append") -> None:
    """Process what is available and stop."""
    start(stream, path, step, mode=mode, availableNow=True).awaitTermination()


def output(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/out").drop("batch")


def newest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last row written for each key."""
    rows = spark.read.parquet(f"{path}/out")
    rest = [F.col(c) for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")
