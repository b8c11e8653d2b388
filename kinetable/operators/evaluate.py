"""Episode scores, roll-ups and running metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions.names import named
from kinetable.operators.windows import mask_after_done
from kinetable.plans.segments import running


def episode_returns(frames: DataFrame, reward: str, success: Column, done: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per episode: sum and maximum of the masked reward and any success, up to one step past done.

    Masked steps count as reward 0. ``by`` names columns constant in an episode, kept for grouping.
    """
    rows = mask_after_done(frames.withColumn("_success", success), done)
    gained = F.when(F.col("mask"), F.col(reward)).otherwise(0.0)
    return rows.groupBy("episode_index", *by).agg(
        F.sum(gained).alias("sum_reward"), F.max(gained).alias("max_reward"),
        F.bool_or(F.col("_success") & F.col("mask")).alias("success"), F.bool_or("ever_done").alias("ever_done"))


def eval_rollup(episodes: DataFrame, group: str, task: str) -> DataFrame:
    """Mean scores and percent success per task, per group and over all; NaN is left out of means."""
    def mean(column: Column) -> Column:
        return F.avg(F.when(~F.isnan(column), column))

    out = episodes.groupingSets([[group, task], [group], []], group, task).agg(
        F.grouping_id().cast("bigint").alias("level"), mean(F.col("sum_reward")).alias("avg_sum_reward"), mean(F.col("max_reward")).alias("avg_max_reward"),
        (mean(F.col("success").cast("double")) * 100).alias("pc_success"), F.count(F.lit(1)).alias("n_episodes"))
    return out.select(
        F.when(F.col("level") < 3, F.col(group).cast("string")).otherwise("ALL").alias(group),
        F.when(F.col("level") < 1, F.col(task).cast("string")).otherwise("ALL").alias(task),
        "avg_sum_reward", "avg_max_reward", "pc_success", "n_episodes")


def running_meter(log: DataFrame, key: str, pos: str, value: str, weight: str, interval: int) -> DataFrame:
    """Weighted average since the last reset, every ``interval`` steps, and the weight seen so far."""
    rows = log.withColumn("_interval", F.floor(F.col(pos) / interval))
    rows = running(rows, [key, "_interval"], pos, {"_vw": ("sum", named(value) * named(weight)), "_w": ("sum", named(weight).cast("double"))})
    rows = running(rows, [key], pos, {"samples": ("sum", named(weight))})
    return rows.withColumn("meter_avg", F.col("_vw") / F.col("_w")).drop("_vw", "_w", "_interval")


def training_counters(samples: Column, frames_per_episode: Column | float, total_frames: Column | float) -> dict[str, Column]:
    """Episodes and epochs that a number of samples amounts to."""
    return {"episodes": samples / frames_per_episode, "epochs": samples / total_frames}


def joint_limits(tall: DataFrame, time: str, warm_up: float) -> DataFrame:
    """Per dimension minimum and maximum after the warm-up, to four places."""
    rows = tall.filter(F.col(time) >= warm_up)
    return rows.groupBy("feature", "dim").agg(F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"))


def reconstruction_quality(pairs: DataFrame, original: str, decoded: str, config: Sequence[str], peak: float, sizes: tuple[str, str] | None = None) -> DataFrame:
    """Mean squared error and PSNR of each pair, averaged per configuration; optional mean size ratio."""
    squares = F.zip_with(original, decoded, lambda a, b: (a - b) * (a - b))
    rows = pairs.withColumn("_mse", F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(original))
    psnr = F.when(F.col("_mse") > 0, F.log10(F.lit(peak * peak) / F.col("_mse")) * 10)
    extra = [] if sizes is None else [F.avg(F.col(sizes[0]) / F.col(sizes[1])).alias("size_ratio")]
    return rows.groupBy(*config).agg(F.avg("_mse").alias("avg_mse"), F.avg(psnr).alias("avg_psnr"), F.count(F.lit(1)).alias("pairs"), *extra)


def token_length_stats(rows: DataFrame, tokens: str, input_size: int) -> DataFrame:
    """Length statistics and compression ratio over all rows; a null list is not counted.

    The percentile is exact: it merges how often each length occurs.
    """
    n = F.when(F.col(tokens).isNotNull(), F.size(tokens))
    return rows.agg(
        (F.lit(float(input_size)) / F.avg(n)).alias("compression_ratio"), F.avg(n).alias("mean_token_length"),
        F.percentile(n, 0.99).alias("p99_token_length"),
        F.min(n).cast("double").alias("min_token_length"), F.max(n).cast("double").alias("max_token_length"))


def per_dim_summary(tall: DataFrame, sample_std: bool = False) -> DataFrame:
    """Mean, std (population, or of a sample), min and max of each dimension."""
    spread = F.stddev_samp if sample_std else F.stddev_pop
    return tall.groupBy("feature", "dim").agg(
        F.avg("value").alias("mean"), spread("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def intervention_summary(frames: DataFrame, reward: str, intervening: Column) -> DataFrame:
    """Per episode: return, whether anyone intervened, and the share of intervened steps."""
    flag = F.coalesce(intervening, F.lit(False))
    return frames.groupBy("episode_index").agg(
        F.sum(reward).alias("episodic_reward"), F.bool_or(flag).cast("bigint").alias("episode_intervention"),
        F.avg(flag.cast("double")).alias("intervention_rate"), F.count(F.lit(1)).alias("steps"))
