"""Rows and values that must not get lost: nulls, merged tables, whole images and texts, refused edits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import edit, relate
from kinetable.operators import select as C
from kinetable.operators import stats as S
from kinetable.operators.evaluate import token_length_stats
from kinetable.operators.windows import ema
from kinetable.plans.frames import EpisodicDataset, index_frames
from kinetable.plans.segments import group_bound


@pytest.mark.parametrize("at_most", [None, 1000])
def test_quantiles_leave_nulls_out(spark, at_most):
    rows = spark.range(1000).select(F.lit(1).alias("key"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("x"))
    got = S.histogram_quantiles(S.to_series(rows, ["key"], ["x"]), ["key"], at_most=at_most).first()
    assert got["count"] == 500
    assert abs(got["q10"] - 98) < 1 and abs(got["q50"] - 498) < 1 and abs(got["q90"] - 898) < 1


def _dataset(spark, n, task="t"):
    rows = spark.range(n).select(F.lit(1).alias("key"), "id", (F.col("id") * 37 % 101).cast("double").alias("x"), F.lit(0).cast("bigint").alias("task_index"))
    frames, episodes = index_frames(rows, "key", ["id"])
    frames, episodes = frames.drop("key", "length", "dataset_from_index", "dataset_to_index"), episodes.drop("key")
    return EpisodicDataset(frames, episodes, spark.createDataFrame([(task, 0)], "task string, task_index bigint"))


def test_average_after_a_merge(spark):
    merged = edit.merge_datasets([_dataset(spark, 5), _dataset(spark, 500, "u")])
    noted = group_bound(merged.frames, "frame_index")
    assert noted is None or noted >= 500
    pdf = ema(merged.frames, "x", 3, "y").toPandas().sort_values(["episode_index", "frame_index"])
    want = pdf.groupby("episode_index")["x"].transform(lambda s: s.ewm(alpha=0.5, adjust=False).mean())
    assert len(pdf) == 505 and abs(pdf["y"] - want).max() < 1e-9


def test_frames_without_a_task_or_key_stay(spark):
    tasks = spark.createDataFrame([("a", 0), ("b", 1)], "task string, task_index bigint")
    frames = spark.createDataFrame([(0, 0), (1, 1), (2, None), (3, 9)], "id bigint, task_index bigint")
    assert {(r["id"], r["task"]) for r in relate.with_task(frames, tasks).collect()} == {(0, "a"), (1, "b"), (2, None), (3, None)}
    moved = relate.remap_tasks(frames, tasks, spark.createDataFrame([("b", 5)], "task string, task_index bigint"))
    assert {(r["id"], r["task_index"]) for r in moved.collect()} == {(0, None), (1, 5), (2, None), (3, None)}
    texts = spark.createDataFrame([(0, "a"), (1, None)], "index bigint, task string")
    assert [r["task"] for r in relate.register_tasks(texts).collect()] == ["a"]
    assert relate.with_task_index(texts, tasks).count() == 2
    rows = spark.createDataFrame([("k", 0), ("k", 1), (None, 2), (None, 3), ("l", 4), ("l", 5)], "key string, id bigint")
    for broadcast in ("100000", "0"):
        spark.conf.set("spark.kinetable.broadcastRows", broadcast)
        numbered, episodes = index_frames(rows, "key", ["id"])
        got = {(r["id"], r["episode_index"], r["frame_index"], r["index"]) for r in numbered.collect()}
        assert got == {(2, 0, 0, 0), (3, 0, 1, 1), (0, 1, 0, 2), (1, 1, 1, 3), (4, 2, 0, 4), (5, 2, 1, 5)}
        assert episodes.count() == 3
    spark.conf.unset("spark.kinetable.broadcastRows")


def test_refused_edits(spark):
    dataset = _dataset(spark, 5)
    for unwanted in ([], [0], [0, 7]):
        with pytest.raises(ValueError):
            edit.delete_episodes(dataset, spark.createDataFrame([(e,) for e in unwanted], "episode_index bigint"))
    overrides = spark.createDataFrame([(7, "x")], "episode_index bigint, new_task string")
    with pytest.raises(ValueError):
        edit.modify_tasks(dataset, "d", overrides)
    bare = EpisodicDataset(dataset.frames, dataset.episodes.withColumn("tasks", F.array().cast("array<string>")), dataset.tasks)
    with pytest.raises(ValueError):
        edit.modify_tasks(bare, None, spark.createDataFrame([], "episode_index bigint, new_task string"))


def test_every_pixel_and_text_counts(spark):
    image = np.random.default_rng(1).integers(0, 256, (400, 310, 3)).astype(np.uint8)
    rows = spark.createDataFrame([(0, bytearray(image.tobytes())), (0, None)], "k int, pixels binary")
    for r in S.image_stats(rows, ["k"], "pixels", 400, 310, 3).collect():
        assert r["count"] == 1 and abs(r["mean"] - image[:, :, r["dim"]].mean() / 255) < 1e-9
        assert abs(r["std"] - image[:, :, r["dim"]].std() / 255) < 1e-9
    lengths = spark.range(5000).select(F.sequence(F.lit(0), F.col("id").cast("int")).alias("tokens"))
    got = token_length_stats(lengths, "tokens", 10).first()
    assert (got["max_token_length"], got["mean_token_length"]) == (5000.0, 2500.5)


def test_names_with_dots(spark):
    from kinetable.functions.scaling import normalize, stats_row
    from kinetable.functions.vectors import pack_vector
    from kinetable.operators import validate, windows

    rows = spark.range(8).select(
        F.floor(F.col("id") / 4).alias("key"), "id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("observation.state"), F.col("id").cast("double").alias("next.reward"))
    plain = rows.withColumnsRenamed({"observation.state": "state", "next.reward": "reward"})
    dotted, same = (index_frames(r, "key", ["id"])[0] for r in (rows, plain))

    def both(build):
        left, right = build(dotted, "observation.state", "next.reward").toPandas(), build(same, "state", "reward").toPandas()
        assert [c.replace("observation.", "").replace("next.", "") for c in left.columns] == list(right.columns)
        shown = [[str(v).replace("observation.", "").replace("next.", "") for v in f.to_numpy().ravel()] for f in (left, right)]
        assert sorted(shown[0]) == sorted(shown[1])

    both(lambda d, s, r: windows.delta_window(d, {s: [-1, 0, 2], r: [1]}))
    both(lambda d, s, r: windows.delta_window(d, {s: [-1, 0, 2]}, pad="last_valid"))
    both(lambda d, s, r: windows.action_chunks(d, s, 2))
    both(lambda d, s, r: windows.to_transitions(d, [s]))
    both(lambda d, s, r: S.frame_stats(d, [], [s, r]))
    both(lambda d, s, r: S.feature_stats(S.to_series(d, [], [s, r])))
    both(lambda d, s, r: normalize(d, stats_row(S.feature_stats(S.to_series(d, [], [s])), {s: [(s, 0), (s, 1)]}), {s: "MEAN_STD"}))
    both(lambda d, s, r: validate.feature_report(d.select(f"`{s}`", f"`{r}`")))
    both(lambda d, s, r: d.select("id", pack_vector([r, "id"]).alias("packed")))
    errors = validate.validate_frames(rows.drop("key", "id"), {"observation.state": {"dtype": "float64", "shape": (2,)}, "next.reward": {"dtype": "float64", "shape": (1,)}})
    assert {tuple(r["errors"]) for r in errors.collect()} == {("task: missing",)}


def test_trimming_keeps_points_on_the_bound(spark):
    """Two radii one rounding step apart, with the bound 45 hundredths of the way between them."""
    values = [0.65, 0.78, 3.15, 3.1500000000000004, *[float(n) for n in range(4, 50)]]
    points = spark.createDataFrame([(0, i, 50, v, 0.0) for i, v in enumerate(values)], "key long, pos long, size long, x double, y double")
    kept = {r["x"] for r in C.trim_outliers(points, "key", "pos", "size", "x", "y", 50, 0.05, 0.95, 50).collect()}
    assert kept == set(values[2:47])
