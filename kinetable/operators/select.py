"""Selecting, ordering and sampling frames.

Random choices hash the row's own id with a seed, so they do not depend on how the rows
are partitioned and repeat after a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions.numbers import hash_int, hash_order
from kinetable.plans.segments import group_bound, join_small, number_rows, spread_join


def select_episodes(frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """Frames of the chosen episodes (``episode_index, length``) with a dense ``relative_index``."""
    kept = chosen.select("episode_index", F.col("length").alias("_length"))
    kept = number_rows(kept, [], ["episode_index"], "_no", at_most=group_bound(kept, "episode_index"), sums={"_to": "_length"})
    kept = kept.withColumn("_from", F.col("_to") - F.col("_length")).drop("_no", "_to")
    out = spread_join(frames, kept, "episode_index", "frame_index", "_length")
    return out.withColumn("relative_index", F.col("_from") + F.col("frame_index")).drop("_from", "_length")


def sample_frames(frames: DataFrame, drop_first: int = 0, drop_last: int = 0, episodes: DataFrame | None = None) -> DataFrame:
    """Drop the first and last frames of each episode; optionally keep only some episodes."""
    out = frames.filter((F.col("frame_index") >= drop_first) & (F.col("frame_index") < F.col("length") - drop_last))
    return out if episodes is None else join_small(out, episodes.select("episode_index").distinct(), ["episode_index"], "left_semi", at_most=group_bound(episodes, "episode_index"))


def shuffle_frames(frames: DataFrame, seed: int, out: str = "position") -> DataFrame:
    """Add the place of each frame in a repeatable random permutation."""
    mixed = frames.withColumn("_mix", hash_order(seed, "index"))
    return number_rows(mixed, [], ["_mix", "index"], out, at_most=group_bound(frames, "index")).drop("_mix")


def shuffle_sharded(frames: DataFrame, shards: int, buffer: int, seed: int) -> DataFrame:
    """Approximate shuffle: a hashed shard, then a place at most ``buffer`` from that of arrival.

    Adds ``shard`` and ``position`` (place in the shard's output). A frame that arrives as number n of its
    shard takes the slot n + hash mod ``buffer``, and the shard goes out in order of slots, equal ones by
    the hash and then by index: what a bounded buffer does that each frame leaves after a random wait.
    A large shard is numbered by ranges, so there can be more tasks than shards.
    """
    if shards < 1 or buffer < 1:
        raise ValueError("shards and buffer must be positive")
    placed = frames.withColumn("shard", (hash_int(seed, "index") % shards).cast("int"))
    placed = number_rows(placed, ["shard"], ["index"], "_arrival")
    placed = placed.withColumns({"_mix": hash_int(seed + 1, "index")}).withColumn("_slot", F.col("_arrival") + F.col("_mix") % buffer)
    out = number_rows(placed, ["shard"], ["_slot", "_mix", "index"], "position", at_most=group_bound(placed, "_arrival"), total=group_bound(frames, "index"))
    return out.drop("_arrival", "_mix", "_slot")


def sample_count(length: Column, low: int = 100, high: int = 10_000, power: float = 0.75) -> Column:
    """How many frames to sample from an episode of this length."""
    grown = F.least(F.floor(F.pow(length.cast("double"), F.lit(power))), F.lit(high))
    return F.greatest(F.least(length, F.lit(low)), grown).cast("bigint")


def is_even_pick(position: Column, length: Column, count: Column, rounded: bool = True) -> Column:
    """Whether ``position`` is one of ``count`` evenly spaced places in ``0..length-1``.

    The place of pick k is ``k * (length-1) / (count-1)``, rounded half to even or cut down; a
    position is tested against the only picks that can land on it, so nothing is joined.
    """
    step = (length - 1) / F.greatest(count - 1, F.lit(1))
    nearest = F.floor(position / step)
    place = F.bround if rounded else F.floor

    def lands(pick: Column) -> Column:
        spot = F.when(pick == count - 1, length - 1).otherwise(place(pick * step).cast("bigint"))
        return (pick >= 0) & (pick < count) & (spot == position)

    hits = [lands(nearest + d) for d in (-1, 0, 1)]
    return F.when(count >= length, position < length).when(count == 1, position == 0).otherwise(hits[0] | hits[1] | hits[2])


def sample_evenly(frames: DataFrame, low: int = 100, high: int = 10_000, power: float = 0.75) -> DataFrame:
    """Evenly spaced frames of each episode, fewer in proportion as the episode grows."""
    count = sample_count(F.col("length"), low, high, power)
    return frames.filter(is_even_pick(F.col("frame_index"), F.col("length"), count))


def sampler_weights(
    offline: DataFrame, online: DataFrame | None, online_ratio: float | None, drop_offline: int = 0, drop_online: int = 0,
    columns: Sequence[str] = ("episode_index", "frame_index"),
) -> DataFrame:
    """Probability of each frame when a share of the draws is online; dropped tails get 0.

    Without online frames every share is 0, and the weights fall back to uniform over all.
    """
    if (online is None) != (online_ratio is None):
        raise ValueError("give the online frames and their ratio together")
    kept = [*dict.fromkeys([*columns, "frame_index", "length"])]
    rows = offline.select(*kept, F.lit("offline").alias("source"), F.lit(drop_offline).alias("_drop"))
    if online is not None:
        rows = rows.unionByName(online.select(*kept, F.lit("online").alias("source"), F.lit(drop_online).alias("_drop")))
    rows = rows.withColumn("_live", F.col("frame_index") < F.col("length") - F.col("_drop"))
    online_share = float(online_ratio or 0.0)
    offline_share = 0.0 if online_ratio is None else 1.0 - online_share
    is_online, live = F.col("source") == "online", F.col("_live").cast("bigint")
    counts = rows.agg(
        F.sum(F.when(is_online, live)).alias("_on"), F.sum(F.when(~is_online, live)).alias("_off"), F.count(F.lit(1)).alias("_all"))
    total = F.when(F.col("_on") > 0, online_share).otherwise(0.0) + F.when(F.col("_off") > 0, offline_share).otherwise(0.0)
    raw = F.when(is_online, F.lit(online_share) / F.col("_on")).otherwise(F.lit(offline_share) / F.col("_off"))
    rows = rows.crossJoin(counts)  # one row
    weight = F.when(total > 0, F.when(F.col("_live"), raw).otherwise(0.0) / total).otherwise(1.0 / F.col("_all"))
    return rows.select(*kept, "source", weight.alias("weight"))


def mix_batches(online: DataFrame, offline: DataFrame, key: str, batch: int, seed: int) -> DataFrame:
    """Whole batches with half online and half offline rows, each row used at most once.

    Columns of either side are kept; ``batch_no`` runs until one side has no full half left.
    """
    half = batch // 2
    sides = []
    for name, side, size in (("online", online, half), ("offline", offline, batch - half)):
        mixed = number_rows(side.withColumn("_mix", hash_order(f"{seed}:{name}", key)), [], ["_mix", key], "_pos")
        mixed = mixed.withColumn("batch_no", F.floor(F.col("_pos") / size)).withColumn("origin", F.lit(name))
        sides.append((mixed.drop("_mix", "_pos"), side.agg(F.floor(F.count(F.lit(1)) / size).alias("n"))))
    (left, left_n), (right, right_n) = sides
    full = left_n.unionByName(right_n).agg(F.min("n").alias("_batches"))
    rows = left.unionByName(right, allowMissingColumns=True).crossJoin(full)  # one row
    return rows.filter(F.col("batch_no") < F.col("_batches")).drop("_batches")


def sample_transitions(rows: DataFrame, index: str, draws: Column | int, seed: int) -> DataFrame:
    """Uniform draws with replacement from rows with a dense ``index``; at most as many as rows."""
    spark = rows.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("_size"))
    picks = spark.range(int(draws)).select(F.col("id").alias("draw")).crossJoin(size)  # one row
    picks = picks.filter(F.col("draw") < F.col("_size"))
    picks = picks.withColumn(index, hash_int(seed, "draw") % F.col("_size")).drop("_size")
    return picks.join(rows, index)


def sample_chunks(chunks: DataFrame, key: str, pos: str, fraction: float, seed: int, max_episodes: int | None = None) -> DataFrame:
    """A share of the chunks of each episode, at least one, chosen by hash."""
    rows = chunks if max_episodes is None else chunks.filter(F.col(key) < max_episodes)
    mixed = rows.withColumn("_mix", hash_order(seed, key, pos))
    placed = number_rows(mixed, [key], ["_mix", pos], "_rank", at_most=group_bound(rows, pos))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out = spread_join(placed, sizes, key, "_rank", "_n")
    return out.filter(F.col("_rank") < F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).drop("_mix", "_rank", "_n")


def stride_position(frame: Column, length: Column, gap: int) -> Column:
    """Place of a frame when frames are visited by ``frame % gap``, then by frame."""
    turn = frame % gap
    return turn * F.floor(length / gap) + F.least(turn, length % gap) + F.floor(frame / gap)


# Frame offsets of the named query patterns.
PATTERNS = {"1_frame": [0], "2_frames": [-1, 0], "2_frames_4_space": [-5, 0], "6_frames": [-5, -4, -3, -2, -1, 0]}


def frame_patterns(frames: DataFrame, sampled: DataFrame, patterns: Sequence[str] = tuple(PATTERNS)) -> DataFrame:
    """Rows ``(pattern, index, slot, value columns)`` for each pattern around each sampled frame.

    Patterns look back five frames, so only samples from frame 5 on are asked for.
    """
    sets = F.array(*[F.struct(F.lit(p).alias("pattern"), F.array(*[F.lit(o).cast("bigint") for o in PATTERNS[p]]).alias("offsets")) for p in patterns])
    asked = sampled.filter("frame_index >= 5").select("index", F.explode(sets).alias("p"))
    asked = asked.select("index", "p.pattern", F.posexplode("p.offsets").alias("slot", "offset"))
    asked = asked.withColumn("_at", F.col("index") + F.col("offset"))
    values = frames.withColumnRenamed("index", "_at")
    return asked.join(values, "_at").drop("_at")


def _between(ordered: str, q: float) -> Column:
    """Quantile of an ordered array between its two nearest values, which it never leaves by rounding."""
    at = (F.size(ordered) - 1) * F.lit(float(q))
    under, over = (F.get(ordered, f(at).cast("int")) for f in (F.floor, F.ceil))
    return under + (over - under) * (at - F.floor(at))


def trim_outliers(points: DataFrame, key: str, pos: str, size: str, x: str, y: str, recent: int, low: float, high: float, cap: int) -> DataFrame:
    """Recent points whose radius lies between two quantiles, thinned evenly to ``cap`` per key.

    ``pos`` is dense per key and ``size`` its number of points. With fewer than 20 recent points none is trimmed.
    """
    latest = points.filter(F.col(pos) >= F.col(size) - recent)
    latest = latest.withColumn("_r", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    radii = latest.groupBy(key).agg(F.array_sort(F.collect_list("_r")).alias("_radii"), F.count(F.lit(1)).alias("_n"))  # at most ``recent`` points per key
    bounds = radii.select(key, "_n", _between("_radii", low).alias("_lo"), _between("_radii", high).alias("_hi"))
    kept = latest.join(bounds, key).filter((F.col("_n") < 20) | F.col("_r").between(F.col("_lo"), F.col("_hi")))
    kept = number_rows(kept, [key], [pos], "_rank", at_most=recent)
    sizes = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_m"))
    out = kept.join(sizes, key).filter(
        (F.col("_m") <= cap) | is_even_pick(F.col("_rank"), F.col("_m"), F.lit(cap), rounded=False))
    return out.drop("_r", "_lo", "_hi", "_n", "_rank", "_m")
