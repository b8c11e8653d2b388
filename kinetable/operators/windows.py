"""Temporal windows over frames; none crosses an episode boundary.

Frames carry ``episode_index``, a dense ``frame_index`` and the global ``index``; the
operators that need the end of an episode also read its ``length`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.names import named
from kinetable.plans.segments import bounded, decaying, group_bound, note_bound, null_safe_join, number_rows, running, spread_join

EPISODE = ["episode_index"]
FRAME = "frame_index"
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


# --- delta configuration -------------------------------------------------------------


def check_deltas(deltas: dict[str, Sequence[float]], fps: float, tolerance: float) -> list[str]:
    """Names of the keys with a delta (seconds) that is no multiple of 1/fps within tolerance."""
    return [
        key for key, seconds in deltas.items()
        if any(abs(s * fps - round(s * fps)) / fps > tolerance for s in seconds)
    ]


def deltas_to_frames(deltas: dict[str, Sequence[float]], fps: float) -> dict[str, list[int]]:
    """Seconds to frame offsets, rounding half to even."""
    return {key: [round(s * fps) for s in seconds] for key, seconds in deltas.items()}


def resolve_deltas(indices: dict[str, Sequence[int] | None], features: Sequence[str], fps: float) -> dict[str, list[float]]:
    """Frame offsets declared per feature class (``action``, ``reward``, ``observation``) to seconds."""
    out = {}
    for name in features:
        kind = {"next.reward": "reward", "action": "action"}.get(name, "observation" if name.startswith("observation.") else None)
        wanted = indices.get(kind) if kind else None
        if wanted is not None:
            out[name] = [i / fps for i in wanted]
    return out


# --- delta windows -------------------------------------------------------------------


def _at(column: Column | str, delta: int, window) -> Column:
    column = named(column) if isinstance(column, str) else column
    return F.lead(column, delta).over(window) if delta > 0 else F.lag(column, -delta).over(window)


def delta_window(frames: DataFrame, deltas: dict[str, Sequence[int]], pad: str = "clamp") -> DataFrame:
    """Add ``<key>_window`` and ``<key>_is_pad`` arrays with the values at each offset.

    ``clamp`` repeats the boundary frame of the episode. ``last_valid`` repeats the value of
    the nearest offset of the same sign that exists, or the current value.
    """
    every = [d for offsets in deltas.values() for d in offsets]
    back, ahead = max(0, -min(every)), max(0, max(every))

    def build(w):
        out = {}
        for key, offsets in deltas.items():
            exists = {d: F.lit(True) if d == 0 else _at(FRAME, d, w).isNotNull() for d in offsets}
            if pad == "clamp":
                low = F.first(named(key)).over(w.rowsBetween(Window.unboundedPreceding, 0))
                high = F.last(named(key)).over(w.rowsBetween(*ALL))
                value = {
                    d: named(key) if d == 0 else F.when(exists[d], _at(key, d, w)).otherwise(low if d < 0 else high)
                    for d in offsets
                }
            elif pad == "last_valid":
                value = {0: named(key)}
                for side in (sorted([d for d in offsets if d < 0], reverse=True), sorted(d for d in offsets if d > 0)):
                    fallback = named(key)
                    for d in side:
                        value[d] = fallback = F.when(exists[d], _at(key, d, w)).otherwise(fallback)
            else:
                raise ValueError(f"unknown pad {pad!r}")
            out[f"{key}_window"] = F.array(*[value[d] for d in offsets])
            out[f"{key}_is_pad"] = F.array(*[~exists[d] for d in offsets])
        return out

    return bounded(frames, EPISODE, FRAME, back, ahead, build)


def delta_join(frames: DataFrame, key: str, deltas: Sequence[int]) -> DataFrame:
    """The clamped window as rows ``(index, delta, value, is_pad)``.

    For long offset lists: one equi-join on the global row position instead of one
    lead or lag per offset.
    """
    wanted = frames.select(
        "index", "dataset_from_index", "length", F.explode(F.array(*[F.lit(int(d)) for d in deltas])).alias("delta")
    )
    target = F.col("index") + F.col("delta")
    last = F.col("dataset_from_index") + F.col("length") - 1
    wanted = wanted.select(
        "index", "delta", F.least(F.greatest(target, F.col("dataset_from_index")), last).alias("at"),
        ((target < F.col("dataset_from_index")) | (target > last)).alias("is_pad"),
    )
    values = frames.select(F.col("index").alias("at"), named(key).alias("value"))
    return wanted.join(values, "at").drop("at")


def action_chunks(frames: DataFrame, key: str, horizon: int, out: str = "chunk") -> DataFrame:
    """Add the next ``horizon`` values as an array; only frames with a full window remain."""

    def build(w):
        return {out: F.collect_list(F.struct(named(key).alias("v"))).over(w.rowsBetween(0, horizon - 1))}

    chunks = bounded(frames, EPISODE, FRAME, 0, horizon - 1, build).filter(F.size(out) == horizon)
    return chunks.withColumn(out, F.transform(out, lambda s: s["v"]))


def relative_actions(chunk: Column, state: Column, dims: Sequence[int] | None = None) -> Column:
    """Subtract the state from every step of a chunk of vectors, on the chosen dimensions."""
    def shift(x: Column, d: Column) -> Column:
        moved = x - F.get(state, d)
        return moved if dims is None else F.when(d.isin(*[int(i) for i in dims]), moved).otherwise(x)

    return F.transform(chunk, lambda step: F.transform(step, shift))


def bidirectional_indices(frames: DataFrame, steps: int, gap: int) -> DataFrame:
    """Add ``window_index`` and ``window_out_of_bounds``: steps/2 past, now, steps/2 future, clamped."""
    half = steps // 2
    offsets = F.array(*[F.lit(gap * i).cast("bigint") for i in range(-half, half + 1)])
    low, high = F.col("dataset_from_index"), F.col("dataset_from_index") + F.col("length") - 1
    at = F.transform(offsets, lambda o: F.col("index") + o)
    return frames.withColumns({
        "window_index": F.transform(at, lambda i: F.least(F.greatest(i, low), high)),
        "window_out_of_bounds": F.transform(at, lambda i: (i < low) | (i > high)),
    })


def rewind_indices(frames: DataFrame, steps: int, gap: int, max_rewind: int, rewind: Column | int) -> DataFrame:
    """Add ``rewind_index``: up to ``rewind`` frames backwards from before the window."""
    earliest = F.col("index") - (steps // 2) * gap
    history = F.floor((earliest - F.col("dataset_from_index")) / gap)
    allowed = F.when(earliest <= F.col("dataset_from_index"), 0).otherwise(F.least(F.lit(max_rewind), history))
    wanted = rewind if isinstance(rewind, Column) else F.lit(rewind)
    taken = F.least(wanted, allowed).cast("int")
    back = F.when(taken > 0, F.sequence(F.lit(1), taken)).otherwise(F.array().cast("array<int>"))
    return frames.withColumns({
        "rewind_step": taken,
        "rewind_index": F.transform(back, lambda i: F.greatest(F.col("dataset_from_index"), earliest - i * gap)),
    })


# --- episodes and transitions --------------------------------------------------------


def episode_bounds(frames: DataFrame) -> DataFrame:
    """First and one-past-last global index of each episode."""
    return frames.groupBy("episode_index").agg(
        F.min("index").alias("from"), (F.max("index") + 1).alias("to")
    )


def infer_done(frames: DataFrame, done: str | None = None) -> DataFrame:
    """``done`` from the given column, else true on the last frame of the episode."""
    if done and done in frames.columns:
        return frames.withColumn("done", F.coalesce(named(done).cast("boolean"), F.lit(False)))
    return frames.withColumn("done", F.col(FRAME) == F.col("length") - 1)


def to_transitions(frames: DataFrame, state: Sequence[str], done: str | None = None) -> DataFrame:
    """Add ``done`` and ``next_<state>``; a done or last frame keeps its own state."""

    def build(w):
        following = _at(FRAME, 1, w).isNotNull()
        return {
            f"next_{s}": F.when(F.col("done") | ~following, named(s)).otherwise(_at(s, 1, w)) for s in state
        }

    return bounded(infer_done(frames, done), EPISODE, FRAME, 0, 1, build)


def episodes_from_done(log: DataFrame, source: str, pos: str, done: Column) -> DataFrame:
    """Cut a transition log into ``episode_no`` and ``step`` after each done or truncated row.

    The log has a dense ``pos`` per source.
    """
    cut = log.withColumn("_done", F.coalesce(done, F.lit(False)).cast("bigint"))
    cut = running(cut, [source], pos, {
        "_no": ("sum", F.col("_done")), "_start": ("max", F.when(F.col("_done") == 1, F.col(pos) + 1))
    }, strict=True)
    return cut.withColumns({
        "episode_no": F.coalesce(F.col("_no"), F.lit(0)), "step": F.col(pos) - F.coalesce(F.col("_start"), F.lit(0))
    }).drop("_done", "_no", "_start")


def joint_velocity(frames: DataFrame, state: str, dt: float) -> DataFrame:
    """Add ``velocity`` (0 on the first frame) and append it to the state."""

    def build(w):
        previous = F.coalesce(F.lag(state, 1).over(w), F.col(state))
        return {"velocity": F.zip_with(F.col(state), previous, lambda x, y: (x - y) / F.lit(dt))}

    out = bounded(frames, EPISODE, FRAME, 1, 0, build)
    return out.withColumn(state, F.concat(state, "velocity"))


def append_to_state(frames: DataFrame, state: str, columns: Sequence[str]) -> DataFrame:
    """Append scalar or vector columns to the state vector."""
    kinds = dict(frames.dtypes)
    parts = [named(c) if kinds[c].startswith("array") else F.array(named(c).cast("double")) for c in columns]
    return frames.withColumn(state, F.concat(named(state), *parts))


def time_limit(frames: DataFrame, steps: int) -> DataFrame:
    """``truncated`` once the step count reaches the limit."""
    return frames.withColumn("truncated", F.col(FRAME) + 1 >= steps)


def mask_after_done(frames: DataFrame, done: Column, steps_after: int = 1) -> DataFrame:
    """Add ``mask`` (true up to ``steps_after`` past the first done) and ``ever_done``.

    An episode that is never done counts frame 0 as its first done.
    """
    firsts = frames.groupBy("episode_index").agg(
        F.min(F.when(done, F.col(FRAME))).alias("_first_done"), F.max(FRAME).alias("_last")
    )
    firsts = firsts.withColumn("_length", F.col("_last") + 1)
    out = spread_join(frames, firsts, "episode_index", FRAME, "_length")
    out = out.withColumn("mask", F.col(FRAME) <= F.coalesce("_first_done", F.lit(0)) + steps_after)
    return out.withColumn("ever_done", F.col("_first_done").isNotNull()).drop("_first_done", "_last", "_length")


def pad_last_frame(frames: DataFrame) -> DataFrame:
    """Add one copy of the last frame of each episode, one position later."""
    copies = frames.filter(F.col(FRAME) == F.col("length") - 1).withColumn(FRAME, F.col(FRAME) + 1)
    return frames.withColumn("is_copy", F.lit(False)).unionByName(copies.withColumn("is_copy", F.lit(True)))


def progress_delta(frames: DataFrame, progress: str, chunk: int) -> DataFrame:
    """Add ``delta``: progress ``chunk`` frames later (or at the last frame) minus progress now."""

    def build(w):
        later = F.when(_at(FRAME, chunk, w).isNotNull(), _at(progress, chunk, w))
        return {"delta": later.otherwise(F.last(progress).over(w.rowsBetween(*ALL))) - F.col(progress)}

    return bounded(frames, EPISODE, FRAME, 0, chunk, build)


def interpolate(frames: DataFrame, value: str, out: str) -> DataFrame:
    """Fill gaps linearly between finite samples; flat outside them; all missing stays missing."""
    x = named(value)
    sample = F.when(x.isNotNull() & ~F.isnan(x), F.struct(F.col(FRAME).alias("p"), x.cast("double").alias("v")))
    filled = running(frames.withColumn("_sample", sample), EPISODE, FRAME, {"_before": ("last", F.col("_sample"))})
    filled = running(filled, EPISODE, FRAME, {"_after": ("last", F.col("_sample"))}, following=True)
    before, after = F.col("_before"), F.col("_after")
    slope = (after["v"] - before["v"]) / (after["p"] - before["p"])
    line = F.when(after["p"] == before["p"], before["v"]).otherwise(before["v"] + slope * (F.col(FRAME) - before["p"]))
    return filled.withColumn(out, F.coalesce(line, before["v"], after["v"])).drop("_sample", "_before", "_after")


# --- filters and limits over a command stream ----------------------------------------


def weighted_moving_filter(frames: DataFrame, value: str, weights: Sequence[float], out: str) -> DataFrame:
    """Weighted sum of the latest distinct readings, newest times the first weight.

    A reading equal to the one before is skipped and repeats the filtered value; until
    the window fills the reading passes through.
    """
    changed = bounded(
        frames, EPISODE, FRAME, 1, 0,
        lambda w: {"_new": ~named(value).eqNullSafe(F.lag(named(value), 1).over(w)) | (F.col(FRAME) == 0)},
    )
    placed = running(changed, EPISODE, FRAME, {"_count": ("sum", F.col("_new").cast("bigint"))})
    kept = placed.filter("_new").withColumn("_pos", F.col("_count") - 1)
    kept = note_bound(kept, "_pos", group_bound(frames, FRAME))

    def build(w):
        total = sum((F.lag(named(value), k).over(w) if k else named(value)) * F.lit(float(c)) for k, c in enumerate(weights))
        return {out: F.when(F.col("_pos") >= len(weights) - 1, total).otherwise(named(value))}

    kept = bounded(kept, EPISODE, "_pos", len(weights) - 1, 0, build)
    kept = kept.select("episode_index", F.col("_count"), F.col(out))
    return placed.join(kept, ["episode_index", "_count"]).drop("_new", "_count")


def latch_reference(frames: DataFrame, pose: str, enabled: str, delta: str, out: str = "command") -> DataFrame:
    """Command = pose latched at the rising edge + delta while enabled; else the last command.

    Before the first enabled frame the command is the pose of the first frame.
    """
    edged = bounded(
        frames, EPISODE, FRAME, 1, 0,
        lambda w: {"_edge": F.col(enabled) & ~F.coalesce(F.lag(enabled, 1).over(w), F.lit(False))},
    )
    latched = running(edged, EPISODE, FRAME, {
        "_ref": ("last", F.when(F.col("_edge"), F.col(pose))),
        "_start": ("last", F.when(F.col(FRAME) == 0, F.col(pose))),
    })
    desired = F.when(F.col(enabled), F.zip_with("_ref", delta, lambda r, d: r + d))
    held = running(latched, EPISODE, FRAME, {"_held": ("last", desired)})
    return held.withColumn(out, F.coalesce("_held", "_start")).drop("_edge", "_ref", "_start", "_held")


def clip_and_check_jump(frames: DataFrame, pos: str, low: Sequence[float], high: Sequence[float], max_step: float) -> DataFrame:
    """Clip a vector to bounds and flag steps longer than ``max_step``."""
    lows, highs = F.array(*[F.lit(float(x)) for x in low]), F.array(*[F.lit(float(x)) for x in high])
    clipped = F.transform(F.col(pos), lambda x, i: F.least(F.greatest(x, F.get(lows, i)), F.get(highs, i)))

    def build(w):
        moved = F.zip_with("clipped", F.lag("clipped", 1).over(w), lambda a, b: (a - b) * (a - b))
        return {"step_norm": F.coalesce(F.sqrt(F.aggregate(moved, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0))}

    out = bounded(frames.withColumn("clipped", clipped), EPISODE, FRAME, 1, 0, build)
    return out.withColumn("is_jump", F.col("step_norm") > max_step)


def cap_relative_target(goal: Column, present: Column, caps: Sequence[float] | float) -> tuple[Column, Column]:
    """Goal vector held within ``caps`` of the present one, and whether anything moved by > 1e-4."""
    limit = (lambda i: F.lit(float(caps))) if isinstance(caps, (int, float)) else (
        lambda i: F.get(F.array(*[F.lit(float(c)) for c in caps]), i))
    safe = F.transform(
        F.arrays_zip(goal.alias("g"), present.alias("p")),
        lambda s, i: s["p"] + F.greatest(F.least(s["g"] - s["p"], limit(i)), -limit(i)),
    )
    return safe, F.exists(F.zip_with(safe, goal, lambda a, b: F.abs(a - b) > 1e-4), lambda x: x)


def ema(frames: DataFrame, value: str, span: float, out: str) -> DataFrame:
    """Exponential moving average, alpha = 2 / (span + 1), seeded with the first value.

    It is the recurrence ``(1 - alpha) * before + alpha * value`` of ``decaying``, with the first value whole.
    """
    alpha = 2.0 / (span + 1.0)
    x = named(value).cast("double")
    if alpha >= 1.0:
        return frames.withColumn(out, x)
    return decaying(frames, EPISODE, FRAME, F.when(F.col(FRAME) == 0, x).otherwise(x * alpha), 1.0 - alpha, out)


# --- chunk streams -------------------------------------------------------------------


def expand_chunk(chunks: DataFrame, chunk: str, start: str, start_time: str, dt: float) -> DataFrame:
    """Chunk rows to one row per action, with its step and time."""
    kept = [c for c in chunks.columns if c != chunk]
    out = chunks.select(*kept, F.posexplode(chunk).alias("offset", "action"))
    return out.withColumns({
        "step": F.col(start) + F.col("offset"), "action_time": F.col(start_time) + F.col("offset") * F.lit(dt)
    })


def ensemble_chunks(actions: DataFrame, decay: float) -> DataFrame:
    """Weighted mean of all predictions for one step; weight exp(-decay * i), i = 0 for the oldest.

    A step is covered by at most one prediction per chunk that reaches it.
    """
    by_age = Window.partitionBy("episode_index", "step").orderBy("chunk_start")
    weighted = actions.withColumn("_w", F.exp(-F.lit(float(decay)) * (F.row_number().over(by_age) - 1)))
    return weighted.groupBy("episode_index", "step").agg(
        (F.sum(F.col("_w") * F.col("action")) / F.sum("_w")).alias("action"), F.count(F.lit(1)).alias("predictions")
    )


# Share of the old and of the new prediction in each named fold.
FOLDS = {"weighted_average": (0.3, 0.7), "latest_only": (0.0, 1.0), "average": (0.5, 0.5), "conservative": (0.7, 0.3)}


def fold_function(name: str):
    """A named binary fold of (old, new) columns."""
    if name not in FOLDS:
        raise KeyError(f"unknown fold {name!r}; known: {sorted(FOLDS)}")
    old_share, new_share = FOLDS[name]
    return lambda old, new: old * old_share + new * new_share


def merge_chunks(actions: DataFrame, fold: str, executed: str | None = None) -> DataFrame:
    """Queue value of each (chunk, step): predictions folded over the unbroken run of chunks.

    ``actions`` has ``episode_index, chunk_no, step, action``; ``executed`` names a column with
    the latest executed step when the chunk arrived: steps up to it are dropped. A new chunk
    replaces the queue, so a step missing from one chunk starts afresh.
    """
    combine = fold_function(fold)
    live = actions.filter(F.col("step") > F.col(executed)) if executed else actions
    per_step = Window.partitionBy("episode_index", "step").orderBy("chunk_no")
    fresh = F.coalesce(F.col("chunk_no") - F.lag("chunk_no").over(per_step) != 1, F.lit(True))
    live = live.withColumn("_run", F.sum(fresh.cast("int")).over(per_step))
    run = Window.partitionBy("episode_index", "step", "_run").orderBy("chunk_no")
    seen = F.collect_list("action").over(run.rowsBetween(Window.unboundedPreceding, 0))
    live = live.withColumn("_seen", seen)
    folded = F.aggregate(F.slice("_seen", 2, F.size("_seen")), F.element_at("_seen", 1), combine)
    return live.withColumn("queued", folded).drop("_seen", "_run")


def splice_chunks(chunks: DataFrame, chunk: str, mode: str, delay: str | None = None, consumed: str | None = None) -> DataFrame:
    """Queue after each chunk (dense ``chunk_no`` per episode).

    ``replace`` keeps the chunk without its first ``delay`` steps. ``append`` adds the chunk to
    the steps not yet consumed: the queue is the range ``[queue_from, queue_to)`` of the stream of
    all appended steps, ``consumed`` being the steps used since the previous chunk.
    """
    if mode == "replace":
        skip = F.least(F.col(delay), F.size(chunk))
        return chunks.withColumn("queue", F.slice(F.col(chunk), skip + 1, F.size(chunk)))
    if mode != "append":
        raise ValueError(f"unknown mode {mode!r}")
    used = F.when(F.col("chunk_no") > 0, F.col(consumed)).otherwise(0)
    return running(chunks, EPISODE, "chunk_no", {
        "queue_to": ("sum", F.size(chunk).cast("bigint")), "queue_from": ("sum", used.cast("bigint"))
    })


def queued_actions(spliced: DataFrame, chunk: str) -> DataFrame:
    """The queue after each appended chunk, one row per action: ``episode_index, chunk_no, slot, action``.

    ``spliced`` is the result of ``splice_chunks`` in append mode. The appended chunks of an episode are one
    stream, each step at its place; a queue asks for the places of its range, so the join is on
    (episode, place) and a long episode is dealt by place.
    """
    start = (F.col("queue_to") - F.size(chunk)).alias("_start")
    steps = spliced.select("episode_index", start, F.posexplode(chunk).alias("_k", "action"))
    steps = steps.select("episode_index", (F.col("_start") + F.col("_k")).alias("_place"), "action")
    asked = spliced.filter("queue_from < queue_to").select(
        "episode_index", "chunk_no", "queue_from", F.explode(F.sequence(F.col("queue_from"), F.col("queue_to") - 1)).alias("_place"))
    joined = null_safe_join(asked, steps, ["episode_index", "_place"])
    return joined.select("episode_index", "chunk_no", (F.col("_place") - F.col("queue_from")).alias("slot"), "action")


# --- running measures ----------------------------------------------------------------


def latency_window(log: DataFrame, key: str, pos: str, latency: str, size: int, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles of the last ``size`` latencies and the all-time maximum; negatives are dropped.

    A quantile of 1 or more is the all-time maximum, of 0 or less the window minimum.
    """
    kept = number_rows(log.filter(F.col(latency) >= 0), [key], [pos], "_pos", at_most=group_bound(log, pos))

    def build(w):
        recent = w.rowsBetween(-(size - 1), 0)
        out = {name: F.percentile(latency, q).over(recent) for name, q in quantiles.items() if 0 < q < 1}
        out |= {name: F.min(latency).over(recent) for name, q in quantiles.items() if q <= 0}
        return out | {"window_rows": F.count(F.lit(1)).over(recent)}

    out = running(bounded(kept, [key], "_pos", size - 1, 0, build), [key], "_pos", {"latency_max": ("max", F.col(latency))})
    for name, q in quantiles.items():
        if q >= 1:
            out = out.withColumn(name, F.col("latency_max"))
    return out.drop("_pos")


def achieved_fps(frames: DataFrame, time: str) -> DataFrame:
    """Average rate since the first frame of the episode; 0 when no time has passed."""
    out = running(frames, EPISODE, FRAME, {"_t0": ("last", F.when(F.col(FRAME) == 0, F.col(time)))})
    spent = F.col(time) - F.col("_t0")
    return out.withColumn("achieved_fps", F.when(spent > 1e-6, F.col(FRAME) / spent).otherwise(0.0)).drop("_t0")
