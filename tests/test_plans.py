"""Sketches, interval covers, recurrences and hashed slots against brute force, and what their plans move."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.operators import progress as P
from kinetable.operators import select as C
from kinetable.operators import stats as S
from kinetable.operators import windows as W
from kinetable.plans.frames import index_frames
from kinetable.plans.segments import decaying, note_bound, number_rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


@pytest.fixture
def segments(spark):
    def cut(rows):
        spark.conf.set("spark.kinetable.segmentRows", str(rows))

    yield cut
    spark.conf.unset("spark.kinetable.segmentRows")


# Quantiles


@pytest.fixture(scope="module")
def tall(spark):
    """Values with ties and a hot group, tails, one group of equal values, one without any."""
    rows = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("key"), F.lit("x").alias("feature"), F.lit(0).alias("dim"),
        F.when(F.col("id") % 5 == 0, 1.0).otherwise(F.exp(F.rand(3) * 9) - 40).alias("value"))
    odd = spark.createDataFrame([(90, "x", 0, 2.5)] * 9 + [(91, "x", 0, None)] * 3 + [(92, "x", 0, -1.0)], "key int, feature string, dim int, value double")
    return rows.unionByName(odd).cache()


def test_sketches_merge_with_small_rank_error(tall):
    data = {k: np.sort(v["value"].dropna().to_numpy()) for k, v in tall.toPandas().groupby("key")}
    each = S.sketch_stats(tall, ["key"])
    merged = S.merge_stats(each, derived=True).toPandas()
    assert set(S.QUANTILES) and len(merged) == 1
    whole = np.sort(np.concatenate(list(data.values())))
    for frame, values in [(merged.iloc[0], whole)] + [(r, data[r["key"]]) for _, r in S.sketch_quantiles(each).toPandas().iterrows() if r["key"] != 91]:
        assert frame["count"] == len(values) and frame["min"] == values[0] and frame["max"] == values[-1]
        for q in S.QUANTILES:
            low, high = np.searchsorted(values, frame[S.quantile_name(q)], "left"), np.searchsorted(values, frame[S.quantile_name(q)], "right")
            assert low / len(values) - 0.005 <= q <= high / len(values) + 0.005
    empty = S.sketch_quantiles(each).filter("key = 91").first()
    assert empty["count"] == 0 and empty["sketch"] is None and empty["q50"] is None


def test_sketches_are_stored_with_statistics(spark, tall, tmp_path):
    S.sketch_stats(tall, ["key"]).write.parquet(str(tmp_path / "s"))
    old, new = (spark.read.parquet(str(tmp_path / "s")).filter(c) for c in ("key < 3", "key >= 3"))
    both = S.update_stats(old, new).first()
    assert both["count"] == tall.filter("value IS NOT NULL").count()
    assert abs(both["mean"] - tall.agg(F.avg("value")).first()[0]) < 1e-9


@pytest.mark.parametrize("k", [800, 8])
def test_selected_quantiles_are_exact(tall, k):
    """Also where the sketch is so coarse that brackets miss."""
    got = S.selected_quantiles(tall, ["key"], (0.0, 0.01, 0.1, 0.5, 0.99, 1.0), k).toPandas().set_index("key")
    want = tall.toPandas().dropna().groupby("key")["value"]
    assert set(got.index) == set(want.groups)
    for key, values in want:
        for q in (0.0, 0.01, 0.1, 0.5, 0.99, 1.0):
            assert got.loc[key, S.quantile_name(q)] == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_a_missed_bracket_sorts_the_group(tall, monkeypatch):
    monkeypatch.setattr(S, "SKETCH_REACH", -20.0)
    few = tall.filter("key < 3")
    got = S.selected_quantiles(few, ["key"], (0.1, 0.5)).toPandas().set_index("key")
    for key, values in few.toPandas().groupby("key")["value"]:
        assert got.loc[key, "q10"] == pytest.approx(np.quantile(values, 0.1)) and got.loc[key, "q50"] == pytest.approx(np.quantile(values, 0.5))


# Intervals


def plain_stage(frame, spans, names):
    """The rule, interval by interval."""
    if not spans:
        return 0, 0.0
    for i, (name, s, e) in enumerate(spans):
        if s <= frame <= e:
            stage = names.index(name) if name in names else 0
            return stage, 1.0 if e <= s else (frame - s) / (e - s)
    if frame < spans[0][1]:
        return 0, 0.0
    if frame > spans[-1][2]:
        return len(names) - 1, 0.999
    for i, (a, b) in enumerate(zip(spans, spans[1:])):
        if a[2] < frame < b[1]:
            return names.index(a[0]) if a[0] in names else i, 1.0
    return 0, 0.0


@pytest.mark.parametrize("size,apart", [(65536, False), (16, False), (5, False), (65536, True), (5, True)])
def test_stages_of_intervals(spark, segments, size, apart):
    segments(size)
    rng, names = random.Random(size), ["a", "b", "c"]
    spans = {e: [] for e in range(30)}
    for e in range(28):
        at = rng.randrange(5)
        for _ in range(rng.randrange(1, 9)):
            end = at + rng.randrange(0, 20)
            spans[e].append((rng.choice([*names, "other"]), at, end))
            at = end + rng.randrange(1, 9) if apart else max(0, at + rng.randrange(-6, 25))
    lengths = {e: rng.randrange(1, 120) for e in spans}
    frames = spark.createDataFrame([(e, f, n) for e, n in lengths.items() for f in range(n)], "episode_index long, frame_index long, length long")
    rows = [(e, p, *s) for e, v in spans.items() for p, s in enumerate(v)]
    intervals = spark.createDataFrame(rows, "episode_index long, position long, name string, start_frame long, end_frame long")
    got = P.stage_and_tau(frames, intervals, names).collect()
    assert len(got) == sum(lengths.values())
    for r in got:
        outside = not spans[r.episode_index] or r.frame_index < spans[r.episode_index][0][1]
        after = bool(spans[r.episode_index]) and r.frame_index > spans[r.episode_index][-1][2]
        want = (0, 0.0) if outside else (len(names) - 1, 0.999) if after else plain_stage(r.frame_index, spans[r.episode_index], names)
        assert (r.stage, round(r.tau, 9)) == (want[0], round(want[1], 9)), (r, spans[r.episode_index])


def test_frames_are_not_exploded_by_intervals(spark):
    frames = spark.range(1000).select(F.lit(0).cast("long").alias("episode_index"), F.col("id").alias("frame_index"), F.lit(1000).cast("long").alias("length"))
    frames = note_bound(frames, "frame_index", 1000)
    intervals = spark.createDataFrame([(0, 0, "a", 0, 400), (0, 1, "b", 300, 999)], "episode_index long, position long, name string, start_frame long, end_frame long")
    out = P.stage_and_tau(frames, intervals, ["a", "b"])
    out.collect()
    plan = plan_of(out)
    assert plan.count("Range (0, 1000") == 1  # read once, moved once


# Recurrences


@pytest.mark.parametrize("span,size", [(2, 65536), (2, 200), (10, 2000), (10, 64), (400, 300), (400, 65536)])
def test_decaying_recurrence(spark, segments, span, size):
    segments(size)
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 3 + 1).cast("long").alias("episode_index"), F.col("id"), ((F.col("id") * 37) % 101).cast("double").alias("x.y"))
    rows = number_rows(rows, ["episode_index"], ["id"], "frame_index", at_most=3000)
    rows = rows.withMetadata("frame_index", {}) if size < 65536 else rows
    out = W.ema(rows, "x.y", span, "y").toPandas().sort_values(["episode_index", "frame_index"])
    want = out.groupby("episode_index")["x.y"].transform(lambda s: s.ewm(alpha=2 / (span + 1), adjust=False).mean())
    assert len(out) == 3000 and abs(out["y"] - want).max() < 1e-9


def test_ema_moves_the_frames_once(spark, segments):
    segments(4000)
    rows = spark.range(20000).select((F.col("id") % 2).alias("episode_index"), F.floor(F.col("id") / 2).alias("frame_index"), F.col("id").cast("double").alias("x"))
    out = W.ema(rows, "x", 10, "y")
    out.collect()
    assert plan_of(out).count("Exchange") == 1
    assert {r[0] for r in decaying(rows, ["episode_index"], "frame_index", F.lit(0.0), 0.5, "z").select("z").distinct().collect()} == {0.0}


# Shards


def test_sharded_shuffle_splits_a_large_shard(spark):
    frames = spark.range(4000).withColumnRenamed("id", "index")
    want = C.shuffle_sharded(frames, 3, 40, 9).toPandas().sort_values(["shard", "position"]).reset_index(drop=True)
    spark.conf.set("spark.kinetable.maxGroupRows", "200")
    try:
        out = C.shuffle_sharded(frames, 3, 40, 9)
        got = out.toPandas().sort_values(["shard", "position"]).reset_index(drop=True)
        assert "Scan ExistingRDD" in plan_of(out)  # numbered by ranges, which were written
    finally:
        spark.conf.unset("spark.kinetable.maxGroupRows")
    pd.testing.assert_frame_equal(got[want.columns], want)
    for _, part in got.groupby("shard"):
        arrival = part["index"].rank().to_numpy() - 1
        assert abs(arrival - part["position"].to_numpy()).max() < 40
    with pytest.raises(ValueError):
        C.shuffle_sharded(frames, 0, 4, 1)


# Names and joins


def test_names_with_dots(spark):
    from kinetable.operators import evaluate as E

    rows = spark.createDataFrame([(0, i, float(i), [1.0], None if i % 3 == 1 else float(i)) for i in range(9)], "episode_index long, frame_index long, `a.b` double, `s.t` array<double>, `g.h` double")
    assert W.append_to_state(rows, "s.t", ["a.b"]).filter("frame_index = 4").select("`s.t`").first()[0] == [1.0, 4.0]
    assert [r[0] for r in W.interpolate(rows, "g.h", "full").orderBy("frame_index").select("full").collect()][:8] == [float(i) for i in range(8)]
    assert W.weighted_moving_filter(rows, "a.b", [0.5, 0.5], "m").filter("frame_index = 4").select("m").first()[0] == 3.5
    assert E.running_meter(rows, "episode_index", "frame_index", "a.b", "a.b", 4).count() == 9


@pytest.mark.parametrize("limit", ["0", "100000"])
def test_episode_lists_split_a_hot_episode(spark, limit):
    from kinetable.operators import relate as R

    frames = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("episode_index"), F.col("id").alias("frame_index"), F.lit(600).alias("length"))
    chosen = spark.createDataFrame([(0,), (0,), (3,), (99,)], "episode_index long")
    spark.conf.set("spark.kinetable.broadcastRows", limit)
    try:
        inside = frames.filter("episode_index IN (0, 3)").count()
        assert C.sample_frames(frames, episodes=chosen).count() == inside
        assert R.exclude_episodes(frames, chosen).count() == 600 - inside
        notes = spark.createDataFrame([(0, 0.5), (3, None)], "episode_index long, p double")
        got = R.join_annotations(frames, notes, "episode_index", {"progress": ["p"]})
        assert got.count() == 600 and got.filter("progress = 0.5").count() == frames.filter("episode_index = 0").count()
    finally:
        spark.conf.unset("spark.kinetable.broadcastRows")


@pytest.mark.parametrize("size", [65536, 4000])
def test_ema_stays_on_a_rounding_tie(spark, segments, size):
    segments(size)
    rows = spark.range(20000).select((F.col("id") % 20).alias("episode_index"), F.floor(F.col("id") / 20).alias("frame_index"))
    rows = rows.withColumn("x", F.when(F.col("episode_index") == 0, F.col("frame_index") % 7 + 0.25).otherwise(F.col("episode_index") + 0.5).cast("double"))
    rows = note_bound(rows, "frame_index", 1000) if size > 4000 else rows
    got = W.ema(rows, "x", 10, "y").toPandas().sort_values(["episode_index", "frame_index"])
    want, alpha = [], 2.0 / 11
    for at, x in zip(got["frame_index"], got["x"]):
        want.append(x if at == 0 else alpha * x + (1 - alpha) * want[-1])
    assert got["y"].tolist() == want


def test_quantiles_of_short_episodes_are_sorted_in_bounded_tasks(spark, monkeypatch):
    rows = spark.range(3000).select(F.floor(F.col("id") / 5).alias("key"), "id", (F.col("id") % 97).cast("double").alias("x"), F.col("id").cast("double").alias("y.z"))
    frames = index_frames(rows, "key", ["id"])[0]
    whole = S.episode_quantiles(frames, ["x", "y.z"])
    monkeypatch.setattr(S, "TASK_VALUES", 300)
    cut = S.episode_quantiles(frames, ["x", "y.z"])
    order = ["episode_index", "feature", "dim"]
    pd.testing.assert_frame_equal(cut.orderBy(order).toPandas(), whole.orderBy(order).toPandas())
    cut.collect()
    assert "hashpartitioning(episode_index" in plan_of(cut) and ", 20), REPARTITION_BY_NUM" in plan_of(cut)  # 3000 rows of two values in tasks of 300
