"""Whole-dataset edits: merge, split, delete, re-task, pack.

Frames have ``episode_index, frame_index, index`` and a task text or ``task_index``; episodes
have ``episode_index, length, dataset_from_index, dataset_to_index``. New numbers are computed
on the episodes and spread to the frames by segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.operators.relate import remap_tasks
from kinetable.operators.stats import merge_stats
from kinetable.plans.frames import EpisodicDataset
from kinetable.plans.segments import MAX_GROUP_ROWS, group_bound, join_small, note_bound, number_rows, running, spread_join
from kinetable.session import materialize, scratch_path


def _renumber(frames: DataFrame, mapping: DataFrame) -> DataFrame:
    """Give frames the new episode and index of ``mapping(episode_index, _new_episode, _new_from, length)``."""
    slim = mapping.select("episode_index", "_new_episode", "_new_from", F.col("length").alias("_length"))
    rows = spread_join(frames, slim, "episode_index", "frame_index", "_length")
    return rows.withColumns({
        "episode_index": F.col("_new_episode"), "index": F.col("_new_from") + F.col("frame_index")
    }).drop("_new_episode", "_new_from", "_length")


def reindex(dataset: EpisodicDataset, chosen: DataFrame) -> EpisodicDataset:
    """The dataset with only the chosen of its episode rows, all numbers dense again."""
    placed = number_rows(
        chosen, [], ["episode_index"], "_new_episode", at_most=group_bound(chosen, "episode_index"), sums={"_new_to": "length"})
    placed = placed.withColumn("_new_from", F.col("_new_to") - F.col("length"))
    frames = _renumber(dataset.frames, placed)
    episodes = placed.withColumns({
        "episode_index": F.col("_new_episode"), "dataset_from_index": F.col("_new_from"), "dataset_to_index": F.col("_new_to")
    }).drop("_new_episode", "_new_from", "_new_to")
    tasks = dataset.tasks
    if tasks is not None and "task_index" in frames.columns:
        tasks = used_tasks(frames, dataset.tasks)
        frames = remap_tasks(frames, dataset.tasks, tasks)
    stats = None if dataset.stats is None else reindex_stats(dataset.stats, placed)
    return EpisodicDataset(frames, episodes, tasks, dataset.subtasks, stats, dataset.info)


def used_tasks(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks that still occur, renumbered in first-seen order."""
    seen = frames.groupBy("task_index").agg(F.min("index").alias("_first")).join(tasks, "task_index")
    return number_rows(seen.drop("task_index"), [], ["_first"], "task_index", derived=True).select("task", "task_index")


def reindex_stats(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per-episode statistics rows under their new episode numbers; dropped episodes go."""
    moved = stats.join(mapping.select("episode_index", "_new_episode"), "episode_index")
    return moved.withColumn("episode_index", F.col("_new_episode")).drop("_new_episode")


def reindex_episodes(episodes: DataFrame, stats: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episode rows under ``mapping(episode_index, new_episode)``, and the merged statistics of those kept."""
    moved = episodes.join(mapping, "episode_index").withColumn("episode_index", F.col("new_episode")).drop("new_episode")
    kept = stats.join(mapping.select("episode_index"), "episode_index", "left_semi")
    return moved, merge_stats(kept)


def delete_episodes(dataset: EpisodicDataset, unwanted: DataFrame) -> EpisodicDataset:
    """Drop the given episodes and close the gaps; see ``check_deletion`` for what is refused."""
    check_deletion(dataset, unwanted)
    return reindex(dataset, dataset.episodes.join(unwanted.select("episode_index"), "episode_index", "left_anti"))


def check_deletion(dataset: EpisodicDataset, unwanted: DataFrame) -> None:
    """Raise when nothing, everything or an unknown episode is to be deleted."""
    ids = unwanted.select("episode_index").distinct()
    total, asked, known = dataset.episodes.count(), ids.count(), ids.join(dataset.episodes, "episode_index", "left_semi").count()
    if not asked:
        raise ValueError("no episodes to delete")
    if known < asked:
        raise ValueError(f"{asked - known} episodes to delete do not exist")
    if known == total:
        raise ValueError("all episodes would be deleted")


def split_bounds(total: int, fractions: dict[str, float]) -> dict[str, tuple[int, int]]:
    """Episode ranges of named shares; empty ones are skipped, the last named runs to the end."""
    if not fractions:
        raise ValueError("no splits given")
    if sum(fractions.values()) > 1.0:
        raise ValueError("fractions add up to more than 1")
    out, start, last = {}, 0, list(fractions)[-1]
    for name, share in fractions.items():
        size = int(total * share)
        if size:
            end = total if name == last else start + size
            out[name] = (start, end)
            start = end
    return out


def split_dataset(dataset: EpisodicDataset, splits: dict[str, float] | DataFrame) -> EpisodicDataset:
    """Frames and episodes with a ``split`` column, numbered densely within each split.

    ``splits`` names fractions, or is a table ``(split, episode_index)`` without overlaps. Each split has
    its own tasks ``(split, task, task_index)``, those its frames have in their old order, its
    descriptor (``descriptors``), and, of statistics per episode, those of its episodes merged.
    """
    if isinstance(splits, dict):
        bounds = split_bounds(dataset.episodes.count(), splits)
        name = F.lit(None).cast("string")
        for split, (start, end) in bounds.items():
            name = F.when(F.col("episode_index").between(start, end - 1), split).otherwise(name)
        assigned = dataset.episodes.withColumn("split", name).filter(F.col("split").isNotNull())
    else:
        if not splits.limit(1).count():
            raise ValueError("no splits given")
        twice = splits.groupBy("episode_index").count().filter("count > 1")
        if twice.limit(1).count():
            raise ValueError("an episode is in more than one split")
        if splits.join(dataset.episodes, "episode_index", "left_anti").limit(1).count():
            raise ValueError("a split names an episode that does not exist")
        assigned = dataset.episodes.join(splits.select("episode_index", "split"), "episode_index")
    placed = number_rows(
        assigned, ["split"], ["episode_index"], "_new_episode", at_most=group_bound(assigned, "episode_index"), sums={"_new_to": "length"})
    placed = placed.withColumn("_new_from", F.col("_new_to") - F.col("length"))
    frames = spread_join(dataset.frames, placed.select("episode_index", F.col("length").alias("_length"), "split", "_new_episode", "_new_from"), "episode_index", "frame_index", "_length")
    frames = frames.withColumns({
        "episode_index": F.col("_new_episode"), "index": F.col("_new_from") + F.col("frame_index")}).drop("_new_episode", "_new_from", "_length")
    episodes = placed.withColumns({
        "episode_index": F.col("_new_episode"), "dataset_from_index": F.col("_new_from"), "dataset_to_index": F.col("_new_to")
    }).drop("_new_episode", "_new_from", "_new_to")
    tasks = dataset.tasks
    if tasks is not None and "task_index" in frames.columns:
        used = frames.filter(F.col("task_index").isNotNull()).select("split", "task_index").distinct()
        used = materialize(number_rows(used, ["split"], ["task_index"], "_new", derived=True))
        frames = join_small(frames, used, ["split", "task_index"], "left").drop("task_index").withColumnRenamed("_new", "task_index")
        tasks = used.join(tasks.select("task_index", "task"), "task_index").select("split", "task", F.col("_new").alias("task_index"))
    stats = dataset.stats
    if stats is not None and "episode_index" in stats.columns:
        stats = merge_stats(stats.join(assigned.select("episode_index", "split"), "episode_index"), ["split"], derived=True)
    else:
        stats = None
    return EpisodicDataset(frames, episodes, tasks, dataset.subtasks, stats, descriptors(episodes, tasks, ["split"]))


def descriptors(episodes: DataFrame, tasks: DataFrame | None, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per ``keys``): total_episodes, total_frames, total_tasks and ``splits``, the ranges of episodes by name.

    All episodes of a dataset are its ``train`` split; one that was split off has the split's name.
    """
    out = episodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_frames"))
    if tasks is not None:
        counted = tasks.groupBy(*[k for k in keys if k in tasks.columns]).agg(F.count(F.lit(1)).alias("total_tasks"))
        on = [k for k in keys if k in tasks.columns]
        out = out.join(counted, on, "left") if on else out.crossJoin(counted)  # one row
        out = out.withColumn("total_tasks", F.coalesce("total_tasks", F.lit(0)))
    name = F.col(keys[0]).cast("string") if keys else F.lit("train")
    return out.withColumn("splits", F.create_map(name, F.concat(F.lit("0:"), F.col("total_episodes").cast("string"))))


def _tagged(tables: Sequence[DataFrame], tag: str) -> DataFrame:
    """Union with the number of the table; a bound noted on a column becomes the sum of the tables' bounds, or goes."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(tag, F.lit(i).cast("bigint")) for i, t in enumerate(tables)])
    for column in out.columns:
        bounds = [group_bound(t, column) for t in tables]
        if any(b is not None for b in bounds):
            out = note_bound(out, column, sum(bounds)) if all(b is not None for b in bounds) else out.withMetadata(column, {})
    return out


def union_tasks(sources: Sequence[DataFrame], text: str = "task", number: str = "task_index") -> DataFrame:
    """Distinct task (or sub-task) texts in the order of (source, id), renumbered."""
    every = _tagged([t.select(text, number) for t in sources], "_source")
    first = every.groupBy(text).agg(F.min(F.struct("_source", number)).alias("_first"))
    return number_rows(first, [], ["_first"], number, derived=True).select(text, number)


def source_offsets(sources: Sequence[EpisodicDataset]) -> DataFrame:
    """First episode number and first index of each source in the merged dataset."""
    episodes = _tagged([s.episodes.select("length") for s in sources], "_source")
    sizes = episodes.groupBy("_source").agg(F.count(F.lit(1)).alias("_episodes"), F.sum("length").alias("_rows"))
    return running(sizes, [], "_source", {"_e0": ("sum", F.col("_episodes")), "_i0": ("sum", F.col("_rows"))}).select(
        "_source", (F.col("_e0") - F.col("_episodes")).alias("_e0"), (F.col("_i0") - F.col("_rows")).alias("_i0"))


def merge_datasets(sources: Sequence[EpisodicDataset]) -> EpisodicDataset:
    """One after another: episode, index, task and sub-task numbers shifted, statistics merged.

    The descriptor has the totals of the merged dataset, whose episodes are all its ``train`` split.
    Sub-tasks are merged where all sources have them.
    """
    offsets = source_offsets(sources)  # one row per source
    tasks = union_tasks([s.tasks for s in sources])
    old_tasks = _tagged([s.tasks.select("task", "task_index") for s in sources], "_source")

    def shift(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        joined = join_small(rows, offsets, ["_source"], at_most=len(sources))
        return joined.withColumns({c: F.col(c) + F.col(o) for c, o in columns.items() if c in rows.columns}).drop("_e0", "_i0")

    frames = remap_tasks(_tagged([s.frames for s in sources], "_source"), old_tasks, tasks, keys=("_source",))
    subtasks = None
    if all(s.subtasks is not None for s in sources):
        subtasks = union_tasks([s.subtasks for s in sources], "subtask", "subtask_index")
        if "subtask_index" in frames.columns:
            old = _tagged([s.subtasks.select("subtask", "subtask_index") for s in sources], "_source")
            mapping = old.join(subtasks.withColumnRenamed("subtask_index", "_new"), "subtask").drop("subtask")
            frames = join_small(frames, mapping, ["_source", "subtask_index"], "left").drop("subtask_index").withColumnRenamed("_new", "subtask_index")
    frames = shift(frames, {"episode_index": "_e0", "index": "_i0"}).drop("_source")
    episodes = shift(_tagged([s.episodes for s in sources], "_source"), {
        "episode_index": "_e0", "dataset_from_index": "_i0", "dataset_to_index": "_i0"}).drop("_source")
    stats = None
    if all(s.stats is not None for s in sources):
        stats = merge_stats(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.stats for s in sources]))
    return EpisodicDataset(frames, episodes, tasks, subtasks, stats, descriptors(episodes, tasks))


def concat_common(sources: Sequence[DataFrame]) -> DataFrame:
    """Union on the columns all sources share, with ``dataset_index``."""
    common = [c for c in sources[0].columns if all(c in s.columns for s in sources)]
    if not common:
        raise ValueError("the datasets have no feature in common")
    return _tagged([s.select(*common) for s in sources], "dataset_index")


def concat_stats(stats: Sequence[DataFrame], features: Sequence[str]) -> DataFrame:
    """Merged statistics of concatenated datasets, of the features that all of them share."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stats)
    return merge_stats(every.filter(F.col("feature").isin(*features)), derived=True)


def modify_tasks(dataset: EpisodicDataset, default: str | None = None, overrides: DataFrame | None = None) -> EpisodicDataset:
    """One task per episode: its override, else the default, else its first task; ids in text order.

    ``overrides`` has ``episode_index, new_task``; episodes carry their ``tasks`` list. Overrides
    of unknown episodes and episodes left without a task are refused.
    """
    if default is None and overrides is None:
        raise ValueError("give a default task or overrides")
    rows = dataset.episodes
    choices = []
    if overrides is not None:
        unknown = overrides.join(rows, "episode_index", "left_anti").count()
        if unknown:
            raise ValueError(f"{unknown} overrides are of episodes that do not exist")
        rows = rows.join(overrides.select("episode_index", "new_task"), "episode_index", "left")
        choices.append(F.col("new_task"))
    choices.append(F.lit(default) if default is not None else F.get("tasks", F.lit(0)))
    rows = rows.withColumn("_task", F.coalesce(*choices))
    bare = rows.filter(F.col("_task").isNull()).count()
    if bare:
        raise ValueError(f"{bare} episodes would have no task")
    texts = rows.select(F.col("_task").alias("task")).distinct()
    tasks = number_rows(texts, [], ["task"], "task_index", derived=True)
    named = rows.join(tasks.withColumnRenamed("task", "_task"), "_task")
    ids = named.select("episode_index", F.col("length").alias("_length"), F.col("task_index").alias("_id"))
    frames = spread_join(dataset.frames.drop("task_index"), ids, "episode_index", "frame_index", "_length")
    frames = frames.withColumn("task_index", F.col("_id")).drop("_id", "_length")
    episodes = named.withColumn("tasks", F.array("_task")).drop("_task", "task_index", "new_task")
    return EpisodicDataset(frames, episodes, tasks, dataset.subtasks, dataset.stats, dataset.info)


#: Rounds in which all parts of a fold are tried at once, before they are settled one after the other.
_TRIALS = 3


def pack_greedy(
    items: DataFrame, pos: str, size: str, limit: float, *, count: str | None = None,
    max_items: int | None = None, max_count: int | None = None, part: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``bin``: consecutive items share a bin until the next one would reach a limit.

    A bin closes when its size plus the next reaches ``limit``, when it holds ``max_items``, or when
    its ``count`` plus the next exceeds ``max_count``. The result is that of one fold over all items;
    a task folds ``part`` positions (see ``_entries``).
    """
    slim = items.select(F.col(pos).alias("p"), F.col(size).cast("double").alias("s"), (F.col(count) if count else F.lit(0)).cast("double").alias("c"))
    slim = slim.where(F.col("p").isNotNull()).withColumn("block", F.floor(F.col("p") / part))

    def fold(pdf: pd.DataFrame, entry: tuple[float, int, float]) -> tuple[pd.DataFrame, tuple[float, int, float], list[int]]:
        pdf = pdf.sort_values("p")
        bins, at, (filled, held, counted) = [], 0, entry
        for s, c in zip(pdf["s"], pdf["c"]):
            full = filled > 0 and filled + s >= limit
            full |= max_items is not None and held >= max_items
            full |= max_count is not None and counted + c > max_count
            if held and full:
                at, filled, held, counted = at + 1, 0.0, 0, 0.0
            filled, held, counted = filled + s, held + 1, counted + c
            bins.append(at)
        return pdf, (filled, held, counted), bins

    entries, first = {}, {}
    blocks = sorted(r[0] for r in slim.select("block").distinct().collect())
    if len(blocks) > 1:
        path = scratch_path(items.sparkSession, "packing")
        slim.write.partitionBy("block").parquet(path)
        slim = items.sparkSession.read.schema(slim.schema).parquet(path)
        entries, first = _entries(slim, blocks, fold)

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["block"].iloc[0])
        pdf, _, bins = fold(pdf, entries.get(at, _EMPTY))
        return pd.DataFrame({"block": pdf["block"], "p": pdf["p"], "b": [b + first.get(at, 0) for b in bins]})

    packed = slim.groupBy("block").applyInPandas(numbered, "block bigint, p bigint, b bigint")
    return items.join(packed.select(F.col("p").alias(pos), F.col("b").alias("bin")), pos)


_EMPTY = (0.0, 0, 0.0)


def _entries(slim: DataFrame, blocks: list[int], fold) -> tuple[dict[int, tuple], dict[int, int]]:
    """What the open bin holds where each block starts, and the number of that bin.

    All blocks are folded at once, at first as if a bin started with each; those whose entry is
    not the exit of the block before are folded again. Folds with different entries mostly meet
    within a block. Where they do not, the first unsettled block is folded alone, so every block
    is folded a few times at most. One row a block comes to the driver.
    """
    entries = {at: _EMPTY for at in blocks}
    exits: dict[int, tuple] = {}
    tops: dict[int, int] = {}
    turn, todo = 0, blocks
    while todo:
        tried = dict(entries)

        def ended(pdf: pd.DataFrame) -> pd.DataFrame:
            at = int(pdf["block"].iloc[0])
            _, (filled, held, counted), bins = fold(pdf, tried[at])
            return pd.DataFrame({"block": [at], "filled": [filled], "held": [held], "counted": [counted], "top": [bins[-1]]})

        asked = slim.where(F.col("block").isin(todo[:1] if turn >= _TRIALS else todo))
        for r in asked.groupBy("block").applyInPandas(ended, "block bigint, filled double, held bigint, counted double, top bigint").collect():
            exits[r["block"]], tops[r["block"]] = (r["filled"], r["held"], r["counted"]), r["top"]
        stale = {at for at in todo[1:]} if turn >= _TRIALS else set()
        for before, at in zip(blocks, blocks[1:]):
            if entries[at] != exits[before]:
                entries[at] = exits[before]
                stale.add(at)
        todo, turn = sorted(stale), turn + 1
    first, total = {}, 0
    for at in blocks:
        first[at] = total
        total += tops[at]
    return entries, first


def batch_episodes(episodes: DataFrame, mb_per_frame: float, limit_mb: float, max_episodes: int | None = None, max_frames: int | None = None) -> DataFrame:
    """Consecutive episodes in batches bounded by size, episodes and frames."""
    sized = episodes.withColumn("_mb", F.col("length") * F.lit(float(mb_per_frame)))
    out = pack_greedy(sized, "episode_index", "_mb", limit_mb, count="length", max_items=max_episodes, max_count=max_frames)
    return out.withColumnRenamed("bin", "batch").drop("_mb")


def chunk_and_file(bin_no: Column, chunk_size: int) -> tuple[Column, Column]:
    """Running file number to (chunk, file in chunk)."""
    return F.floor(bin_no / chunk_size), bin_no % chunk_size


def assign_files(episodes: DataFrame, size: str, limit: float, chunk_size: int = 1000) -> DataFrame:
    """``chunk_index`` and ``file_index`` of each episode; a file rotates before it reaches the limit."""
    out = pack_greedy(episodes, "episode_index", size, limit)
    chunk, file = chunk_and_file(F.col("bin"), chunk_size)
    return out.withColumns({"chunk_index": chunk, "file_index": file}).drop("bin")
