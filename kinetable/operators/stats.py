"""Feature statistics: per dimension, mergeable, with quantiles.

The tall form has one row per value: ``(keys..., feature, dim, value)``; statistics have one
row per ``(keys..., feature, dim)``. Every aggregate has a map-side partial, so a hot
episode is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.names import named
from kinetable.plans.segments import group_bound, join_small, number_rows, segment_rows
from kinetable.session import materialize

QUANTILES = (0.01, 0.10, 0.50, 0.90, 0.99)
BINS = 5000
EDGE = 1e-10
#: Size of the sketches; 800 keeps ranks to about a quarter of a hundredth.
SKETCH_K = 800
#: Half the width of a bracket around a quantile, in units of 1 / k: several times the rank error.
SKETCH_REACH = 8.0
#: Values of short episodes that one task sorts, about.
TASK_VALUES = 500_000
SERIES = ["feature", "dim"]


def quantile_name(q: float) -> str:
    return f"q{int(q * 100):02d}"


def to_series(frames: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Scalar and vector columns to tall rows; text columns are skipped."""
    kinds = dict(frames.dtypes)
    vectors = [n for n in features if kinds[n].startswith("array")]
    scalars = [n for n in features if n not in vectors and kinds[n] != "string"]
    parts = [F.transform(named(n), _entry(n)) for n in vectors]
    if scalars:  # no lambda, so that they stay in generated code
        parts.append(F.array(*[
            F.struct(F.lit(n).alias("feature"), F.lit(0).alias("dim"), named(n).cast("double").alias("value")) for n in scalars]))
    return frames.select(*keys, F.inline(parts[0] if len(parts) == 1 else F.concat(*parts)))


def _entry(name: str):
    return lambda v, i: F.struct(F.lit(name).alias("feature"), i.alias("dim"), v.cast("double").alias("value"))


def feature_stats(tall: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, min, max, mean and population std."""
    return tall.groupBy(*keys, *SERIES).agg(
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )


def frame_stats(frames: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``feature_stats`` straight from the frames: scalars are aggregated side by side, vectors as tall rows."""
    kinds = dict(frames.dtypes)
    scalars = [f for f in features if kinds[f] != "string" and not kinds[f].startswith("array")]
    vectors = [f for f in features if kinds[f].startswith("array")]
    parts = []
    if scalars:
        entries = []
        for f in scalars:
            x = named(f).cast("double")
            entries.append(F.struct(
                F.lit(f).alias("feature"), F.lit(0).alias("dim"), F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"),
                F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")))
        wide = frames.groupBy(*keys).agg(F.array(*entries).alias("_s")) if keys else frames.agg(F.array(*entries).alias("_s"))
        parts.append(wide.select(*keys, F.inline("_s")))
    if vectors:
        parts.append(feature_stats(to_series(frames, keys, vectors), keys))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def histogram_quantiles(
    tall: DataFrame, keys: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES, bins: int = BINS, at_most: int | None = None
) -> DataFrame:
    """``feature_stats`` plus quantiles read from a histogram of ``bins`` equal bins.

    The bins span min - 1e-10 to max + 1e-10; a quantile is interpolated inside the first bin
    whose cumulated count reaches it. With one row every quantile is the mean.

    ``at_most`` is a known bound on the rows of a group. Groups of at most one segment are
    binned and cumulated where one shuffle has put them. Otherwise counts per bin are
    aggregated on the map side first, whatever the size of a group.
    """
    group = [*keys, *SERIES]
    if keys and at_most is not None and at_most <= segment_rows(tall):
        return _small_group_quantiles(tall, group, quantiles, bins)
    stats = materialize(feature_stats(tall, keys))  # read twice below
    edges = stats.select(*group, "count", (F.col("min") - EDGE).alias("_lo"), (F.col("max") + EDGE).alias("_hi"))
    known = tall.filter(F.col("value").isNotNull())
    placed = join_small(known, edges, group).withColumn("_bin", _bin_of(bins))
    counts = placed.groupBy(*group, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.first("count").alias("_total"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    filled = counts.withColumn("_sum", F.sum("_n").over(Window.partitionBy(*group).orderBy("_bin")))
    found = filled.groupBy(*group).agg(*_quantile_picks(quantiles, bins))
    out = stats.join(found, group)
    return out.withColumns({
        quantile_name(q): F.when(F.col("count") < 2, F.col("mean")).otherwise(F.col(quantile_name(q))) for q in quantiles
    })


def _bin_of(bins: int) -> Column:
    """Bin of ``value`` between ``_lo`` and ``_hi``."""
    raw = F.floor((F.col("value") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))
    return F.when(F.col("_hi") > F.col("_lo"), F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))).otherwise(0)


def _quantile_picks(quantiles: Sequence[float], bins: int) -> list[Column]:
    """Aggregates over rows ``(_bin, _n in the bin, _sum up to the bin, _total, _lo, _hi)``."""
    width = (F.col("_hi") - F.col("_lo")) / bins
    picks = []
    for q in quantiles:
        target = F.lit(float(q)) * F.col("_total")
        inside = F.col("_lo") + (F.col("_bin") + (target - (F.col("_sum") - F.col("_n"))) / F.col("_n")) * width
        value = F.when(F.col("_bin") == 0, F.col("_lo")).otherwise(inside)
        first = F.min(F.when(F.col("_sum") >= target, F.struct(F.col("_bin"), value.alias("v"))))
        picks.append(first["v"].alias(quantile_name(q)))
    return picks


def _small_group_quantiles(tall: DataFrame, group: list[str], quantiles: Sequence[float], bins: int) -> DataFrame:
    whole = Window.partitionBy(*group)
    rows = tall.filter(F.col("value").isNotNull()).withColumns({
        "_total": F.count("value").over(whole), "_lo": F.min("value").over(whole) - EDGE, "_hi": F.max("value").over(whole) + EDGE})
    rows = rows.withColumn("_bin", _bin_of(bins))
    upto = whole.orderBy("_bin").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = whole.orderBy("_bin").rangeBetween(Window.currentRow, Window.currentRow)
    rows = rows.withColumns({"_sum": F.count(F.lit(1)).over(upto), "_n": F.count(F.lit(1)).over(same)})
    out = rows.groupBy(*group).agg(
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), *_quantile_picks(quantiles, bins))
    return out.withColumns({
        quantile_name(q): F.when(F.col("count") < 2, F.col("mean")).otherwise(F.col(quantile_name(q))) for q in quantiles
    })


def exact_quantiles(tall: DataFrame, keys: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Linearly interpolated quantiles from the sorted position of each value."""
    group = [*keys, *SERIES]
    placed = number_rows(tall.filter(F.col("value").isNotNull()), group, ["value"], "_pos")
    sizes = tall.groupBy(*group).agg(F.count("value").alias("_n"))
    wanted = sizes.withColumn("_q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    at = F.col("_q") * (F.col("_n") - 1)
    ends = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    wanted = wanted.withColumn("_at", at).withColumn("_pos", F.explode(ends))
    hits = placed.join(wanted, [*group, "_pos"])
    share = F.when(F.floor("_at") == F.ceil("_at"), 1.0).otherwise(1.0 - F.abs(F.col("_at") - F.col("_pos")))
    values = hits.groupBy(*group, "_q").agg(F.sum(share * F.col("value")).alias("v"))
    return values.groupBy(*group).agg(*[
        F.max(F.when(F.col("_q") == float(q), F.col("v"))).alias(quantile_name(q)) for q in quantiles
    ])


def sketch_stats(tall: DataFrame, keys: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """``feature_stats`` and a KLL ``sketch`` of each group, which is stored with them and merges (``merge_stats``).

    A sketch has a few KB whatever the group's size; larger ``k`` gives smaller rank errors, about 2 / k.
    A group without values has a null sketch.
    """
    base = [
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")]
    sketch = F.kll_sketch_agg_double(F.col("value"), k)
    return tall.groupBy(*keys, *SERIES).agg(*base, F.when(F.count("value") > 0, sketch).alias("sketch"))


def sketch_quantiles(stats: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Statistics with the quantiles of their sketches; null without values."""
    picks = {quantile_name(q): F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))) for q in quantiles}
    return stats.withColumns(picks)


def selected_quantiles(tall: DataFrame, keys: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES, k: int = SKETCH_K) -> DataFrame:
    """The quantiles of ``exact_quantiles`` without sorting all values.

    A sketch brackets each quantile between two values, the values below the bracket are counted, and
    only those inside, a few in a hundred, are sorted. A bracket that the count finds beside its
    quantile, which is rare, has its group sorted whole.
    """
    group = [*keys, *SERIES]
    known = tall.filter(F.col("value").isNotNull())
    sketched = sketch_stats(known, keys, k)
    parts = []
    for i, q in enumerate(quantiles):
        low, high = q - SKETCH_REACH / k, q + SKETCH_REACH / k
        at = lambda x: F.kll_sketch_get_quantile_double("sketch", F.lit(float(x)))
        parts.append(F.struct(
            F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("count") - 1)).alias("at"),
            (F.col("min") if low <= 0 else at(low)).alias("lo"), (F.col("max") if high >= 1 else at(high)).alias("hi")))
    brackets = materialize(sketched.select(*group, F.array(*parts).alias("_wanted")))  # read several times below
    placed = join_small(known, brackets, group)
    below = placed.groupBy(*group).agg(
        *[F.count_if(F.col("value") < F.col("_wanted")[i]["lo"]).alias(f"_below{i}") for i in range(len(quantiles))],
        *[F.count_if(F.col("value").between(F.col("_wanted")[i]["lo"], F.col("_wanted")[i]["hi"])).alias(f"_in{i}") for i in range(len(quantiles))])
    counted = brackets.join(below, group).select(*group, F.inline(F.array(*[
        F.struct(F.col("_wanted")[i]["i"].alias("i"), F.col("_wanted")[i]["at"].alias("at"), F.col(f"_below{i}").alias("below"), F.col(f"_in{i}").alias("inside"))
        for i in range(len(quantiles))])))
    counted = materialize(counted.withColumn("hit", (F.floor("at") >= F.col("below")) & (F.ceil("at") < F.col("below") + F.col("inside"))))
    inside = placed.select(*group, "value", F.explode(F.filter("_wanted", lambda b: F.col("value").between(b["lo"], b["hi"]))).alias("b")).select(*group, "value", "b.i")
    sorted_ = number_rows(inside, [*group, "i"], ["value"], "_pos", derived=True)
    ends = counted.filter("hit").withColumn("_end", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    ends = ends.withColumn("_pos", F.col("_end") - F.col("below"))
    share = F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1.0 - F.abs(F.col("at") - F.col("_end")))
    values = sorted_.join(ends, [*group, "i", "_pos"]).groupBy(*group, "i").agg(F.sum(share * F.col("value")).alias("v"))
    found = values.groupBy(*group).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(quantile_name(q)) for i, q in enumerate(quantiles)])
    missed = counted.filter("NOT hit").select(*group).distinct()
    if missed.isEmpty():
        return found
    whole = exact_quantiles(join_small(known, missed, group), keys, quantiles)
    return found.join(missed, group, "left_anti").unionByName(whole.select(*found.columns))


def merge_stats(stats: DataFrame, keys: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES, derived: bool = False) -> DataFrame:
    """Combine statistics rows: weighted mean, parallel variance, min / max, count-weighted quantiles.

    A quantile appears only where every merged row has it; rows with sketches get the quantiles of the
    merged sketch instead of a mean of theirs. The variance is centred, which takes
    two passes over the statistics; ``derived`` marks rows that come from a scan of the frames
    and writes them once, so that the frames are not read twice.
    """
    stats = materialize(stats) if derived else stats
    group = [*keys, *SERIES]
    sketched = "sketch" in stats.columns
    names = [quantile_name(q) for q in quantiles if quantile_name(q) in stats.columns and not sketched]
    merged = [F.when(F.sum("count") > 0, F.kll_merge_agg_double("sketch")).alias("sketch")] if sketched else []
    centre = stats.groupBy(*group).agg((F.sum(F.col("count") * F.col("mean")) / F.sum("count")).alias("_centre"))
    rows = join_small(stats, centre, group, derived=True)
    off = F.col("mean") - F.col("_centre")
    variance = F.sum(F.col("count") * (F.col("std") * F.col("std") + off * off)) / F.sum("count")
    out = rows.groupBy(*group).agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.first("_centre", ignorenulls=True).alias("mean"), F.sqrt(variance).alias("std"),
        *[F.when(F.count(n) == F.count(F.lit(1)), F.sum(F.col(n) * F.col("count")) / F.sum("count")).alias(n) for n in names], *merged,
    )
    return sketch_quantiles(out, quantiles) if sketched else out


def update_stats(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merge the statistics of added episodes into the ones already there."""
    return merge_stats(old.unionByName(new, allowMissingColumns=True), keys)


def has_quantiles(stats: DataFrame, quantiles: Sequence[float] = QUANTILES) -> bool:
    return all(quantile_name(q) in stats.columns for q in quantiles)


def augment_quantiles(frames: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Statistics with quantiles: unchanged if present, else recomputed per episode and merged."""
    if has_quantiles(stats):
        return stats
    return merge_stats(episode_quantiles(frames, features), derived=True)


def episode_quantiles(frames: DataFrame, features: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Statistics with quantiles of every episode.

    Short episodes are moved as frames, before their values become rows, and dealt into so many tasks
    that a task sorts about ``TASK_VALUES`` values whatever the size of the table.
    """
    at_most, total = group_bound(frames, "frame_index"), group_bound(frames, "index")
    if at_most is not None and at_most <= segment_rows(frames):
        frames = frames.select("episode_index", *[named(f) for f in features])
        tasks = -(-(total or 0) * len(features) // TASK_VALUES)
        most = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        frames = frames.repartition(tasks, "episode_index") if tasks > most else frames.repartition("episode_index")
    return histogram_quantiles(to_series(frames, ["episode_index"], features), ["episode_index"], quantiles, at_most=at_most)


def stats_by_axis(frames: DataFrame, column: str, axis: str, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of a vector column per dimension (``rows``), per row (``dims``) or over all (``all``)."""
    if axis == "dims":
        v, n = named(column), F.size(named(column))
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
        return frames.select(
            *keys, n.cast("bigint").alias("count"), F.array_min(v).alias("min"), F.array_max(v).alias("max"),
            mean.alias("mean"), F.sqrt(spread).alias("std"))
    tall = to_series(frames, keys, [column])
    if axis == "rows":
        return feature_stats(tall, keys)
    if axis == "all":
        return feature_stats(tall.withColumn("dim", F.lit(-1)), keys)
    raise ValueError(f"unknown axis {axis!r}")


def stats_to_tall(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per statistic: ``(keys..., feature, dim, stat, value)``."""
    names = [c for c in stats.columns if c not in (*keys, *SERIES)]
    doubles = stats.select(*keys, *SERIES, *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot([*keys, *SERIES], names, "stat", "value")


def tall_to_stats(tall: DataFrame, keys: Sequence[str] = (), names: Sequence[str] = ("count", "min", "max", "mean", "std")) -> DataFrame:
    """Inverse of ``stats_to_tall``; the statistics are named, so no pass finds them."""
    return tall.groupBy(*keys, *SERIES).pivot("stat", list(names)).agg(F.first("value"))


def _field(name: str):
    return lambda entry: entry[name]


def stats_to_wide(stats: DataFrame, features: Sequence[str], names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key with ``stats/<feature>/<stat>`` vector columns, as episode metadata stores them."""
    entry = F.struct("dim", *names)
    picks = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col("feature") == f, entry))), _field(n)).alias(f"stats/{f}/{n}")
        for f in features for n in names
    ]
    return stats.groupBy(*keys).agg(*picks)


def wide_to_stats(episodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stats/<feature>/<stat>`` vector columns back to rows ``(keys..., feature, dim, stat, value)``."""
    entries = []
    for column in (c for c in episodes.columns if c.startswith("stats/")):
        feature, stat = column[len("stats/"):].rsplit("/", 1)
        entries.append(F.struct(F.lit(feature).alias("feature"), F.lit(stat).alias("stat"), F.col(f"`{column}`").cast("array<double>").alias("v")))
    rows = episodes.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.feature", "e.stat", F.posexplode("e.v").alias("dim", "value"))
    return rows.select(*keys, "feature", "dim", "stat", "value")


def image_stats(images: DataFrame, keys: Sequence[str], pixels: str, height: int, width: int, channels: int, *, stride: int = 1) -> DataFrame:
    """Per-channel statistics in [0, 1] of raw interleaved 8-bit images; ``count`` counts images.

    All pixels count; a ``stride`` above 1 is a choice of the caller. Images without pixels are
    left out. One image is in memory at a time beside its batch.
    """
    schema = images.select(*keys).schema.simpleString()[7:-1]
    schema += (", " if keys else "") + "dim int, n bigint, s double, ss double, lo double, hi double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf[pixels].notna()]
            if not len(pdf):
                continue
            parts = []
            for raw in pdf[pixels]:
                image = np.frombuffer(raw, np.uint8).reshape(height, width, channels)[::stride, ::stride].reshape(-1, channels).astype(np.int64)
                parts.append((image.sum(0), (image * image).sum(0), image.min(0), image.max(0), len(image)))
            sums = [np.concatenate([p[i] for p in parts]).astype(np.float64) for i in range(4)]
            out = pd.DataFrame({
                "dim": np.tile(np.arange(channels, dtype=np.int32), len(pdf)), "n": np.repeat([p[4] for p in parts], channels).astype(np.int64),
                "s": sums[0], "ss": sums[1], "lo": sums[2], "hi": sums[3],
            })
            for i, key in enumerate(keys):
                out.insert(i, key, np.repeat(pdf[key].to_numpy(), channels))
            yield out

    rows = images.select(*keys, pixels).mapInPandas(partial, schema)
    mean = F.sum("s") / F.sum("n")
    variance = F.greatest(F.sum("ss") / F.sum("n") - mean * mean, F.lit(0.0))
    return rows.groupBy(*keys, "dim").agg(
        F.count(F.lit(1)).alias("count"), (F.min("lo") / 255).alias("min"), (F.max("hi") / 255).alias("max"),
        (mean / 255).alias("mean"), (F.sqrt(variance) / 255).alias("std"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)
