"""Frame tables: episodes, positions and offsets from raw rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.plans.segments import broadcast_rows, group_sizes, note_bound, null_safe_join, number_rows, running, spread_join


@dataclass
class EpisodicDataset:
    """The tables of a dataset; every member is a lazy DataFrame."""

    frames: DataFrame
    episodes: DataFrame
    tasks: DataFrame | None = None
    subtasks: DataFrame | None = None
    stats: DataFrame | None = None
    info: DataFrame | None = None


def episode_offsets(
    episodes: DataFrame, length: str = "length", start: str = "dataset_from_index", end: str = "dataset_to_index",
    keys: Sequence[str] = (), pos: str = "episode_index",
) -> DataFrame:
    """Running ``[from, to)`` of each episode, in ``pos`` order (per ``keys`` when given)."""
    out = running(episodes, list(keys), pos, {end: ("sum", F.col(length))})
    return out.withColumn(start, F.col(end) - F.col(length))


def index_frames(
    rows: DataFrame, key: str, order: Sequence[str], *, fps: float | None = None, episode_aggs: Sequence = ()
) -> tuple[DataFrame, DataFrame]:
    """Number raw rows: dense ``episode_index``, ``frame_index``, global ``index``, ``timestamp``.

    Returns (frames, episodes). Episodes are ordered by ``key``, rows without one are the first; ``timestamp`` is
    ``frame_index / fps`` when ``fps`` is given and no ``timestamp`` column exists.
    """
    longest, total, count = group_sizes(rows, [key])
    frames = number_rows(rows, [key], order, "frame_index", at_most=longest, total=total)
    episodes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("length"), *episode_aggs)
    episodes = number_rows(episodes, [], [key], "episode_index", at_most=count, sums={"dataset_to_index": "length"})
    episodes = episodes.withColumn("dataset_from_index", F.col("dataset_to_index") - F.col("length"))
    if count <= broadcast_rows(rows):
        out = null_safe_join(frames, F.broadcast(episodes), [key])
    else:
        out = spread_join(frames, episodes, key, "frame_index", "length")
    out = out.withColumn("index", F.col("dataset_from_index") + F.col("frame_index"))
    out = note_bound(out, "index", total)
    if fps and "timestamp" not in rows.columns:
        out = out.withColumn("timestamp", F.col("frame_index") / F.lit(float(fps)))
    return out, episodes


def _read(spark: SparkSession, root: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet").select(*columns)


def event_frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """One episode per user; the event type is the task; seconds since the first event."""
    events = _read(spark, root, "events", "event_id", "user_id", "ts", "event_type", "value")
    events = events.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    frames, episodes = index_frames(
        events, "user_id", ["micros", "event_id"], episode_aggs=[F.min("micros").alias("start_micros")]
    )
    frames = frames.withColumn("timestamp", (F.col("micros") - F.col("start_micros")) / F.lit(1e6))
    return frames.withColumnRenamed("event_type", "task").drop("start_micros"), episodes


LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


def line_frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """One episode per order; the return flag is the task; 10 frames per second."""
    lines = _read(spark, root, "lineitem", "l_orderkey", *LINE_ORDER)
    frames, episodes = index_frames(lines, "l_orderkey", LINE_ORDER, fps=10)
    return frames.withColumnRenamed("l_returnflag", "task"), episodes


def turn_frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """One episode per conversation; the role is the subtask."""
    turns = _read(spark, root, "conversations", "conv_id", "turn", "role", "text")
    return index_frames(turns, "conv_id", ["turn"], fps=1)


def vector_frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """One episode per label; each frame holds a vector."""
    vectors = _read(spark, root, "embeddings", "vec_id", "label", "embedding")
    vectors = vectors.withColumn("state", F.col("embedding").cast("array<double>")).drop("embedding")
    return index_frames(vectors, "label", ["vec_id"], fps=10)
