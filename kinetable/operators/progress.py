"""Subtask intervals, progress labels and progress-based weights.

Intervals are rows ``(episode_index, position, name, start_frame, end_frame)``, closed on both
ends, in list order of the episode's annotation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions.numbers import clip
from kinetable.operators.windows import EPISODE, FRAME
from kinetable.plans.segments import bounded, group_bound, note_bound, null_safe_join, number_rows, running, salted_join, segment_rows
from kinetable.session import materialize

AFTER_LAST = 0.999


def label_runs(frames: DataFrame, label: str, keep: Column | None = None, time: str | None = None) -> DataFrame:
    """Maximal runs of one label as intervals; ``keep`` leaves other frames uncovered.

    With a ``time`` column the intervals get the ``start`` and ``end`` of their first and last frame.
    """
    def edge(w):
        return {"_starts": ~F.col(label).eqNullSafe(F.lag(label, 1).over(w)) | (F.col(FRAME) == 0)}

    rows = bounded(frames.select("episode_index", FRAME, label, *([time] if time else [])), EPISODE, FRAME, 1, 0, edge)
    rows = running(rows, EPISODE, FRAME, {"_run": ("sum", F.col("_starts").cast("bigint"))})
    rows = rows if keep is None else rows.filter(keep)
    times = [F.min_by(time, FRAME).alias("start"), F.max_by(time, FRAME).alias("end")] if time else []
    runs = rows.groupBy("episode_index", "_run").agg(
        F.first(label).alias("name"), F.min(FRAME).alias("start_frame"), F.max(FRAME).alias("end_frame"), *times)
    return runs.withColumnRenamed("_run", "position")


def stage_of(name: Column, names: Sequence[str], unknown: Column) -> Column:
    """Index of a subtask name in the global list."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(at > 0, at - 1).otherwise(unknown).cast("bigint")


def stage_and_tau(frames: DataFrame, intervals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``stage`` and ``tau``: the first interval that holds the frame, and how far through it.

    A frame between two intervals has the earlier one's stage and tau 1; before the first,
    stage 0 and tau 0; after the last, the last stage and 0.999. With one global name tau is
    the share of the episode. Intervals and gaps are cut at all their ends into pieces with one
    answer each (``first_covers``), and each frame takes the last piece that starts at or before
    it, a running value, so the frames are moved once and nothing is listed frame by frame.
    """
    stages = len(names)
    if stages == 1:
        tau = clip(F.col(FRAME) / F.greatest(F.col("length") - 1, F.lit(1)), 0.0, 1.0)
        return frames.withColumns({"stage": F.lit(0).cast("bigint"), "tau": tau})
    lists = number_rows(intervals, EPISODE, ["position"], "_slot", at_most=group_bound(frames, FRAME))
    lists = bounded(lists, EPISODE, "_slot", 0, 1, lambda w: {"_next": F.lead("start_frame", 1).over(w)})
    lists = materialize(lists)  # one row per interval, read several times below
    inside = lists.select(
        "episode_index", F.struct(F.lit(0).alias("kind"), "position").alias("rank"), F.col("start_frame").alias("lo"), F.col("end_frame").alias("hi"),
        F.col("start_frame").alias("s"), F.col("end_frame").alias("e"), stage_of(F.col("name"), names, F.lit(0)).alias("stage"))
    gaps = lists.filter(F.col("_next") - F.col("end_frame") > 1).select(
        "episode_index", F.struct(F.lit(1).alias("kind"), "position").alias("rank"), (F.col("end_frame") + 1).alias("lo"), (F.col("_next") - 1).alias("hi"),
        F.col("start_frame").alias("s"), F.col("start_frame").alias("e"), stage_of(F.col("name"), names, F.col("_slot")).alias("stage"))
    known, facts = group_bound(frames, FRAME), ["s", "e", "stage"]
    covers = inside.unionByName(gaps)
    if lists.filter((F.col("_next") <= F.col("end_frame")) | (F.col("end_frame") < F.col("start_frame"))).isEmpty():
        # Intervals in order and apart: each starts a piece of its own, and the last one's end starts the rest.
        rest = lists.filter(F.col("_next").isNull()).select("episode_index", (F.col("end_frame") + 1).alias("at"))
        pieces = covers.select("episode_index", F.col("lo").alias("at"), F.struct(*facts).alias("cover")).unionByName(rest, allowMissingColumns=True)
    else:  # no interval needs blocks longer than the longest episode
        pieces = first_covers(covers, facts, min(segment_rows(frames), known or segment_rows(frames)))
    ends = lists.groupBy("episode_index").agg(
        F.min_by("start_frame", "position").alias("first"), F.max_by("end_frame", "position").alias("last"))
    pieces = null_safe_join(pieces, ends, EPISODE)
    piece = F.struct((F.col("at") < F.col("first")).alias("before"), (F.col("at") > F.col("last")).alias("after"), "cover").alias("_piece")
    starts = pieces.select("episode_index", (F.col("at") * 2).alias("_at"), piece)
    # A frame looks up the last piece that starts at or before it: pieces stand on even places.
    rows = frames.withColumn("_at", F.col(FRAME) * 2 + 1).unionByName(starts, allowMissingColumns=True)
    rows = note_bound(rows, "_at", None if known is None else 2 * known + 1)
    rows = running(rows, EPISODE, "_at", {"_held": ("last", F.col("_piece"))}).filter(F.col("_at") % 2 == 1)
    cover = F.col("_held.cover")
    span = cover["e"] - cover["s"]
    share = F.when(span <= 0, 1.0).otherwise(clip((F.col(FRAME) - cover["s"]) / span, 0.0, 1.0))
    outside = F.col("_held").isNull() | F.col("_held.before")
    stage = F.when(outside, 0).when(F.col("_held.after"), stages - 1).when(cover.isNotNull(), cover["stage"]).otherwise(0)
    tau = F.when(outside, 0.0).when(F.col("_held.after"), AFTER_LAST).when(cover.isNotNull(), share).otherwise(0.0)
    out = rows.withColumns({"stage": stage.cast("bigint"), "tau": tau}).drop("_at", "_piece", "_held")
    return note_bound(out, FRAME, known)


def first_covers(covers: DataFrame, facts: Sequence[str], reach: int) -> DataFrame:
    """``(episode_index, at, cover)``: from frame ``at`` to the next one the covering interval of least rank.

    ``covers`` has episode_index, lo, hi, rank and the ``facts`` that ``cover`` holds; it is null where no
    interval covers. Intervals may overlap in any number. Each is cut into aligned blocks of a power of
    two of frames, at most two of a size below ``reach``, and each end point asks the blocks it lies in, so
    neither frames nor pairs of intervals are listed.
    """
    levels = max(0, int(math.log2(reach)))
    size = 1 << levels
    pieces = covers.filter("hi >= lo").withColumn("_seg", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    pieces = pieces.withColumns({"l": F.greatest(F.col("lo"), F.col("_seg") * size), "r": F.least(F.col("hi") + 1, (F.col("_seg") + 1) * size)})
    none = "cast(array() AS array<struct<level: int, block: bigint>>)"
    blocks = F.expr(
        f"aggregate(sequence(0, {levels}), named_struct('l', l, 'r', r, 'out', {none}), (a, k) -> named_struct("
        "'l', if(a.l < a.r, a.l + a.l % 2, a.l) div 2, 'r', if(a.l < a.r, a.r - a.r % 2, a.r) div 2, 'out', concat(a.out, "
        f"if(a.l < a.r AND a.l % 2 = 1, array(named_struct('level', k, 'block', a.l)), {none}), "
        f"if(a.l < a.r AND a.r % 2 = 1, array(named_struct('level', k, 'block', a.r - 1)), {none}))), a -> a.out)")
    blocks = pieces.select("episode_index", "rank", F.struct(*facts).alias("cover"), F.explode(blocks).alias("b"))
    best = blocks.groupBy("episode_index", "b.level", "b.block").agg(F.min("rank").alias("rank"), F.min_by("cover", "rank").alias("cover"))
    points = covers.select("episode_index", F.explode(F.array("lo", F.col("hi") + 1)).alias("at")).distinct()
    asked = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("block", F.expr("shiftright(at, level)"))
    found = null_safe_join(asked, best, ["episode_index", "level", "block"], "left")
    return found.groupBy("episode_index", "at").agg(F.min_by("cover", "rank").alias("cover"))


def combined_progress(stage: Column, tau: Column, stages: int) -> Column:
    """Stage plus tau, held below the number of stages."""
    return F.when((stage >= stages - 1) & (tau >= 1.0), stages - 1 + AFTER_LAST).otherwise(stage + tau)


def breakpoints(proportions: Sequence[float]) -> list[float]:
    """Cumulative shares from 0 to 1."""
    total = sum(proportions)
    scale = total if total > 0 and abs(total - 1.0) > 1e-6 else 1.0
    out = [0.0]
    for share in proportions:
        out.append(out[-1] + share / scale)
    out[-1] = 1.0
    return out


def stage_progress(combined: Column, points: Column) -> Column:
    """Stage + tau to [0, 1] along an array of breakpoints."""
    stages = F.size(points) - 1
    stage = F.least(F.greatest(F.floor(combined).cast("int"), F.lit(0)), stages - 1)
    low, high = F.get(points, stage), F.get(points, stage + 1)
    inside = low + (combined - stage) * (high - low)
    return F.when(combined < 0, 0.0).when(combined >= stages, 1.0).otherwise(inside)


def temporal_proportions(intervals: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Mean over episodes of each subtask's share of the annotated time, scaled to sum to 1.

    ``intervals`` has ``start`` and ``end`` in seconds. A name repeated in one episode counts its
    last duration, while the episode total counts every one.
    """
    spans = intervals.withColumn("_d", F.col("end") - F.col("start"))
    per_name = spans.groupBy("episode_index", "name").agg(F.max_by("_d", "position").alias("_d"), F.sum("_d").alias("_all"))
    totals = per_name.groupBy("episode_index").agg(F.sum("_all").alias("_total"))
    shares = per_name.join(totals, "episode_index").filter("_total > 0")
    means = shares.groupBy("name").agg(F.avg(F.col("_d") / F.col("_total")).alias("mean_share"))
    out = means.crossJoin(means.agg(F.sum("mean_share").alias("_sum")))  # one row
    out = out.withColumn("proportion", F.when(F.col("_sum") > 0, F.col("mean_share") / F.col("_sum")).otherwise(F.col("mean_share")))
    out = out.select("name", "mean_share", "proportion")
    if names is not None:
        out = out.filter(F.col("name").isin(*names)).withColumn("stage", stage_of(F.col("name"), names, F.lit(-1)))
    return out


def progress_targets(labels: DataFrame, windows: DataFrame, indices: str) -> DataFrame:
    """Label of every frame a window asks for: ``labels(index, target)`` at ``windows.<indices>``."""
    asked = windows.select("index", F.posexplode(indices).alias("slot", "_at"))
    return asked.join(labels.select(F.col("index").alias("_at"), "target"), "_at").drop("_at")


def progress_weights(deltas: DataFrame, delta: str, kappa: float = 0.01, eps: float = 1e-6, fallback: float = 1.0) -> DataFrame:
    """Weight of each frame from its progress delta.

    1 above ``kappa``, 0 below 0, between them a ramp over mean - 2 std .. mean + 2 std of all
    deltas; a missing delta takes the fallback. The mean is at least 0, the std at least ``eps``.
    """
    value = F.when(~F.isnan(delta), F.col(delta))
    moments = deltas.agg(
        F.greatest(F.coalesce(F.avg(value), F.lit(0.0)), F.lit(0.0)).alias("_mean"),
        F.greatest(F.coalesce(F.stddev_pop(value), F.lit(eps)), F.lit(eps)).alias("_std"))
    ramp = clip((F.col(delta) - (F.col("_mean") - 2 * F.col("_std"))) / (4 * F.col("_std") + eps), 0.0, 1.0)
    weight = F.when(F.col(delta).isNull() | F.isnan(delta), fallback).when(F.col(delta) > kappa, 1.0).when(F.col(delta) >= 0, ramp).otherwise(0.0)
    return deltas.crossJoin(moments).withColumn("weight", weight).drop("_mean", "_std")  # one row


def batch_normalise_weights(rows: DataFrame, batch: str, weight: str, eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Weights scaled to sum to the batch size, and per batch the raw mean and zero / full counts."""
    summary = rows.groupBy(batch).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(weight).alias("raw_mean_weight"), F.sum((F.col(weight) == 0).cast("bigint")).alias("num_zero_weight"),
        F.sum((F.col(weight) == 1.0).cast("bigint")).alias("num_full_weight"), F.sum(weight).alias("_sum"))
    factors = summary.select(batch, (F.col("rows") / (F.col("_sum") + eps)).alias("_factor"))
    scaled = salted_join(rows, factors, [batch]).withColumn("normalised", F.col(weight) * F.col("_factor")).drop("_factor")
    return scaled, summary.drop("_sum")


def auto_annotate(episodes: DataFrame, fps: float, name: str = "task") -> DataFrame:
    """One interval per episode, over its whole length."""
    return episodes.select(
        "episode_index", F.lit(0).cast("bigint").alias("position"), F.lit(name).alias("name"), F.lit(0).cast("bigint").alias("start_frame"),
        (F.col("length") - 1).alias("end_frame"), F.lit(0.0).alias("start"), ((F.col("length") - 1) / F.lit(float(fps))).alias("end"))


def upsert_annotations(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Intervals of the annotated episodes replace the old ones; others stay."""
    return existing.join(fresh.select("episode_index").distinct(), "episode_index", "left_anti").unionByName(fresh)


# Names of the parallel lists in episode metadata.
LIST_COLUMNS = {"subtask_names": "name", "subtask_start_times": "start", "subtask_end_times": "end",
                "subtask_start_frames": "start_frame", "subtask_end_frames": "end_frame"}


def annotation_lists(intervals: DataFrame, prefix: str) -> DataFrame:
    """The stored form: parallel lists per episode, with unprefixed copies for ``sparse``."""
    entry = F.struct("position", *LIST_COLUMNS.values())
    rows = intervals.groupBy("episode_index").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    names = {f"{prefix}_{c}": v for c, v in LIST_COLUMNS.items()}
    if prefix == "sparse":
        names |= LIST_COLUMNS
    return rows.select("episode_index", *[F.col(f"_l.{v}").alias(c) for c, v in names.items()])


def annotation_rows(episodes: DataFrame, prefix: str) -> DataFrame:
    """Stored lists back to intervals; unprefixed columns serve where prefixed ones are absent."""
    def stored(column: str) -> Column:
        options = [F.col(c) for c in (f"{prefix}_{column}", column) if c in episodes.columns]
        return F.coalesce(*options)

    zipped = F.arrays_zip(*[stored(c).alias(v) for c, v in LIST_COLUMNS.items()])
    rows = episodes.select("episode_index", F.posexplode(zipped).alias("position", "e"))
    return rows.select("episode_index", F.col("position").cast("bigint").alias("position"), "e.*")


def progress_table(frames: DataFrame, values: dict[str, str]) -> DataFrame:
    """``index, episode_index, frame_index`` and each sampled value interpolated to every frame, as 32-bit."""
    from kinetable.operators.windows import interpolate

    out = frames
    for name, column in values.items():
        out = interpolate(out, column, name).withColumn(name, F.col(name).cast("float"))
    return out.select("index", "episode_index", FRAME, *values)
