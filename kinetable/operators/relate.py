"""Joins of frames to tasks, episodes, files, times and annotations.

Task tables are broadcast after a check of their rows, so that frames stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.plans.segments import group_bound, join_small, number_rows, running


def with_task(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add the task text of ``task_index``; frames with a null or unknown id keep a null task."""
    return join_small(frames, tasks.select("task_index", "task"), ["task_index"], "left", at_most=group_bound(tasks, "task_index"))


def with_task_index(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add the id of the task text; frames with a null or unknown text keep a null id."""
    return join_small(frames, tasks.select("task", "task_index"), ["task"], "left", at_most=group_bound(tasks, "task_index"))


def with_subtask(frames: DataFrame, subtasks: DataFrame | None) -> DataFrame:
    """Add ``subtask``; frames without a known one keep null. No-op without column or table."""
    if subtasks is None or "subtask_index" not in frames.columns:
        return frames
    known = subtasks.select("subtask_index", "subtask")
    return join_small(frames, known, ["subtask_index"], "left", at_most=group_bound(subtasks, "subtask_index"))


def register_tasks(frames: DataFrame, existing: DataFrame | None = None, text: str = "task", order: str = "index") -> DataFrame:
    """All tasks with dense ids: known ones keep theirs, new ones follow in first-seen order. Null is no task."""
    seen = frames.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("task")).agg(F.min(order).alias("_first"))
    if existing is None:
        return number_rows(seen, [], ["_first"], "task_index", derived=True).select("task", "task_index")
    fresh = number_rows(seen.join(existing, "task", "left_anti"), [], ["_first"], "_no", derived=True)
    top = existing.agg(F.coalesce(F.max("task_index") + 1, F.lit(0)).alias("_base"))
    fresh = fresh.crossJoin(top).select("task", (F.col("_base") + F.col("_no")).alias("task_index"))
    return existing.select("task", "task_index").unionByName(fresh)


def duplicate_tasks(names: DataFrame) -> DataFrame:
    """Task texts given more than once; registering such a list is an error."""
    return names.groupBy("task").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def remap_tasks(frames: DataFrame, source: DataFrame, target: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Old task id to text to the id in the merged table; a null or unknown id becomes null."""
    texts = source.select(*keys, F.col("task_index"), "task")
    ids = target.select("task", F.col("task_index").alias("_new"))
    mapping = texts.join(ids, "task").select(*keys, "task_index", "_new")
    at_most = None if keys else group_bound(source, "task_index")
    return join_small(frames, mapping, [*keys, "task_index"], "left", at_most=at_most).drop("task_index").withColumnRenamed("_new", "task_index")


def locate_episode(points: DataFrame, episodes: DataFrame, at: str) -> DataFrame:
    """Add the episode with ``dataset_from_index <= at < dataset_to_index``.

    Episode starts and points are laid on one line and each point takes the last start
    before it, so no point meets more than one episode.
    """
    starts = episodes.select(
        F.col("dataset_from_index").alias("_at"), F.lit(0).alias("_side"),
        F.struct("episode_index", "dataset_from_index", "dataset_to_index").alias("_episode"),
    )
    wanted = points.select(F.col(at).alias("_at"), F.lit(1).alias("_side")).distinct()
    line = number_rows(starts.unionByName(wanted, allowMissingColumns=True), [], ["_at", "_side"], "_pos")
    line = running(line, [], "_pos", {"_hit": ("last", F.col("_episode"))})
    found = line.filter((F.col("_side") == 1) & (F.col("_at") < F.col("_hit.dataset_to_index")))
    found = found.select(F.col("_at").alias(at), F.col("_hit.episode_index").alias("episode_index"),
                         (F.col("_at") - F.col("_hit.dataset_from_index")).alias("frame_index"))
    return points.join(found, at, "left")


def join_nearest(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], tolerance: float
) -> DataFrame:
    """Add the right row of the same key closest in time (the earlier of two equally close).

    ``gap`` is its distance; ``is_pad`` marks rows beyond the tolerance, ``is_error`` those
    among them that lie strictly inside the time range of the right side.
    """
    rows = left.withColumn("_t", F.col(left_time).cast("double")).withColumn("_side", F.lit(1))
    rows = rows.withColumn("_id", F.xxhash64(*left.columns))
    there = F.struct(F.col(right_time).cast("double").alias("t"), *[F.col(v) for v in values])
    marks = right.select(key, F.col(right_time).cast("double").alias("_t"), F.lit(0).alias("_side"), there.alias("_mark"))
    marks = marks.withColumn("_id", F.xxhash64("_mark"))
    line = rows.unionByName(marks, allowMissingColumns=True)
    line = number_rows(line, [key], ["_t", "_side", "_id"], "_pos")
    line = running(line, [key], "_pos", {"_before": ("last", F.col("_mark"))})
    line = running(line, [key], "_pos", {"_after": ("last", F.col("_mark"))}, following=True)
    before, after = F.col("_before"), F.col("_after")
    nearest = F.when(before.isNull(), after).when(after.isNull(), before).when(
        F.col("_t") - before["t"] <= after["t"] - F.col("_t"), before).otherwise(after)
    out = line.filter("_side = 1").withColumn("_near", nearest)
    out = out.withColumn("gap", F.abs(F.col("_t") - F.col("_near.t")))
    out = out.withColumn("is_pad", F.coalesce(F.col("gap") > tolerance, F.lit(True)))
    out = out.withColumn("is_error", F.col("is_pad") & before.isNotNull() & after.isNotNull())
    return out.select(*left.columns, "gap", "is_pad", "is_error", *[F.col(f"_near.{v}").alias(f"nearest_{v}") for v in values])


def join_frame_number(queries: DataFrame, frames: DataFrame, time: str, fps: float) -> DataFrame:
    """Match a time to the frame number ``round(time * fps)`` (half to even)."""
    wanted = queries.withColumn("frame_index", F.bround(F.col(time) * F.lit(float(fps))).cast("bigint"))
    return wanted.join(frames, ["episode_index", "frame_index"])


def remap_files(episodes: DataFrame, mapping: DataFrame, default_chunk: Column, default_file: Column) -> DataFrame:
    """Move episodes to new files: ``mapping`` has old and new (chunk, file) and a time offset."""
    moved = episodes.join(mapping, ["chunk_index", "file_index"], "left")
    shift = F.coalesce(F.col("time_offset"), F.lit(0.0))
    out = moved.withColumns({
        "chunk_index": F.coalesce("new_chunk", default_chunk), "file_index": F.coalesce("new_file", default_file),
        "from_timestamp": F.col("from_timestamp") + shift, "to_timestamp": F.col("to_timestamp") + shift,
    })
    return out.drop("new_chunk", "new_file", "time_offset")


def exclude_episodes(frames: DataFrame, unwanted: DataFrame) -> DataFrame:
    return join_small(frames, unwanted.select("episode_index").distinct(), ["episode_index"], "left_anti")


def join_annotations(frames: DataFrame, notes: DataFrame, key: str, values: dict[str, list[str]]) -> DataFrame:
    """Left join by frame index or episode; each value takes the first of its column names that is set."""
    picked = {name: F.coalesce(*[F.col(c) for c in columns if c in notes.columns]) for name, columns in values.items()}
    return join_small(frames, notes.select(key, *[c.alias(n) for n, c in picked.items()]), [key], "left")
