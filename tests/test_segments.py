"""The same results when every episode is cut into many segments and every group counts as hot."""

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from kinetable.plans.segments import SEG, bounded, number_rows, running, segment_of

QUERIES, SQL = contract.queries(), contract.oracle_sql()
CUT = [
    "e02_delta_window_clamp", "e03_delta_window_last_valid", "e04_action_chunks", "e09_index_frames", "e10_episode_offsets", "e11_to_transitions",
    "e13_episodes_from_done", "e14_joint_velocity", "e17_mask_after_done", "e19_progress_delta", "e20_interpolate", "e21_weighted_moving_filter",
    "e22_latch_reference", "e23_clip_and_check_jump", "e27_splice_append", "e28_latency_window", "e29_achieved_fps", "e30_ema",
    "c01_select_episodes", "c03_shuffle_frames", "c09_sample_chunks", "c12_trim_outliers", "d05_locate_episode", "d06_stage_and_tau", "d07_join_nearest",
    "f15_running_meter", "f02_exact_quantiles", "i01_merge_datasets", "i02_split_dataset", "i03_delete_episodes", "i05_modify_tasks", "j05_drop_late_actions",
    "j01_stream_assemble_episodes", "j10_read_frames_stream", "d01_with_task", "d04_remap_tasks", "f03_small_group_fallback", "f04_merge_stats",
    "f02_histogram_quantiles", "g07_progress_targets",
]


@pytest.mark.parametrize("name", CUT)
def test_cut_query(spark, data, duck, small_segments, name):
    got = QUERIES[name](spark, data).toPandas()
    assert oracle.difference(got, duck.execute(SQL[name]).fetchdf()) is None


@pytest.fixture
def hot(spark):
    """900 rows of which one episode holds a third."""
    rows = spark.range(900).withColumn("key", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1))
    return rows.withColumn("x", (F.col("id") * 37 % 101).cast("double"))


def test_hot_group_is_split(spark, hot, small_segments):
    placed = number_rows(hot, ["key"], ["id"], "pos")
    sizes = placed.withColumn(SEG, segment_of(placed, "pos")).groupBy("key", SEG).count()
    assert sizes.agg(F.max("count")).first()[0] <= 7
    pdf = placed.toPandas().sort_values(["key", "id"])
    assert (pdf["pos"] == pdf.groupby("key").cumcount()).all()


def test_running_and_bounded_on_hot_group(spark, hot, small_segments):
    placed = number_rows(hot, ["key"], ["id"], "pos")
    out = running(placed, ["key"], "pos", {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))})
    out = running(out, ["key"], "pos", {"rest": ("sum", F.col("x"))}, following=True, strict=True)
    out = bounded(out, ["key"], "pos", 9, 12, lambda w: {"back": F.lag("x", 9).over(w), "ahead": F.lead("x", 12).over(w)})
    pdf = out.toPandas().sort_values(["key", "pos"])
    by = pdf.groupby("key")["x"]
    assert (pdf["s"] == by.cumsum()).all() and (pdf["m"] == by.cummax()).all()
    rest = by.transform("sum") - by.cumsum()
    assert (pdf["rest"].fillna(0) == rest).all()
    assert (pdf["back"].fillna(-1) == by.shift(9).fillna(-1)).all() and (pdf["ahead"].fillna(-1) == by.shift(-12).fillna(-1)).all()


def test_ema_of_long_episodes(spark):
    from kinetable.operators.windows import ema

    rows = spark.range(3000).select(
        (F.col("id") % 2).alias("episode_index"), F.floor(F.col("id") / 2).alias("frame_index"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    for span in (1, 3, 50, 5000):
        pdf = ema(rows, "x", span, "y").toPandas().sort_values(["episode_index", "frame_index"])
        want = pdf.groupby("episode_index")["x"].transform(lambda s, a=2 / (span + 1): s.ewm(alpha=a, adjust=False).mean())
        assert abs(pdf["y"] - want).max() < 1e-9


def test_quantiles_agree_between_plans(spark, hot):
    from kinetable.operators import stats as S

    tall = S.to_series(hot, ["key"], ["x"])
    few = S.histogram_quantiles(tall, ["key"], at_most=900).toPandas().sort_values("key").reset_index(drop=True)
    many = S.histogram_quantiles(tall, ["key"]).toPandas().sort_values("key").reset_index(drop=True)
    for column in ("count", "min", "max", "mean", "std", "q01", "q10", "q50", "q90", "q99"):
        assert abs(few[column] - many[column]).max() < 1e-9
