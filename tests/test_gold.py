"""Hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from kinetable.operators import progress as P
from kinetable.operators import select as C
from kinetable.operators import stats as S
from kinetable.operators import windows as W
from kinetable.plans.frames import index_frames
from kinetable.streaming.operators import retain_last_n


def frames_of(spark, lengths):
    rows = [(e, i) for e, n in enumerate(lengths) for i in range(n)]
    raw = spark.createDataFrame(rows, "key bigint, at bigint")
    return index_frames(raw, "key", ["at"], fps=10)[0]


def test_sample_count(spark):
    lengths = [1, 10, 100, 200, 1000, 2000, 5000, 10000, 20000, 50000, 500000]
    want = [1, 10, 100, 100, 177, 299, 594, 1000, 1681, 3343, 10000]
    rows = spark.createDataFrame([(n,) for n in lengths], "n bigint")
    assert [r[0] for r in rows.orderBy("n").select(C.sample_count(F.col("n"))).collect()] == want


def stats_rows(spark, *rows):
    return spark.createDataFrame([("f", 0, *r) for r in rows], "feature string, dim int, min double, max double, mean double, std double, count bigint")


def test_merge_stats(spark):
    one = S.merge_stats(stats_rows(spark, (1.0, 10.0, 5.0, 2.0, 1), (2.0, 12.0, 6.0, 2.5, 1))).first()
    assert (one["min"], one["max"], one["mean"], one["count"]) == (1.0, 12.0, 5.5, 2)
    assert one["std"] == pytest.approx(2.318405, abs=1e-6)
    two = S.merge_stats(stats_rows(spark, (1.0, 10.0, 5.5, 2.87, 10), (1.0, 12.0, 8.5, 3.42, 15))).first()
    assert (two["mean"], two["count"]) == (pytest.approx(7.3), 25) and two["std"] == pytest.approx(3.5317, abs=1e-4)


@pytest.mark.parametrize("first,last,episodes,want", [(1, 0, None, [1, 4, 5]), (0, 1, None, [0, 3, 4]), (0, 0, [0, 2], [0, 1, 3, 4, 5])])
def test_sample_frames(spark, first, last, episodes, want):
    frames = frames_of(spark, [2, 1, 3])
    chosen = None if episodes is None else spark.createDataFrame([(e,) for e in episodes], "episode_index bigint")
    assert sorted(r["index"] for r in C.sample_frames(frames, first, last, chosen).collect()) == want


@pytest.mark.parametrize("offline,drop_off,drop_on,ratio,want_off,want_on", [
    ([2, 2], 0, 0, 0.8, [0.05] * 4, [0.1] * 8), ([2, 2], 0, 1, 0.8, [0.05] * 4, [0.2, 0] * 4), ([2], 1, 1, 0.5, [0.5, 0], [0.125, 0] * 4)])
def test_sampler_weights(spark, offline, drop_off, drop_on, ratio, want_off, want_on):
    rows = C.sampler_weights(frames_of(spark, offline), frames_of(spark, [2] * 4), ratio, drop_off, drop_on).collect()
    for source, want in (("offline", want_off), ("online", want_on)):
        got = [r["weight"] for r in sorted((r for r in rows if r["source"] == source), key=lambda r: (r["episode_index"], r["frame_index"]))]
        assert got == pytest.approx(want)


def test_sampler_weights_without_online(spark):
    rows = C.sampler_weights(frames_of(spark, [3, 1]), None, None, drop_offline=1).collect()
    assert [r["weight"] for r in rows] == pytest.approx([0.25] * 4)


def test_retain_last_n(spark):
    rows = spark.range(125)
    assert sorted(r["id"] for r in retain_last_n(rows, [], ["id"], 100).collect()) == list(range(25, 125))


@pytest.mark.parametrize("spans,want", [
    ([(0, 0, "a", 0, 80), (0, 1, "b", 80, 100), (1, 0, "a", 0, 40), (1, 1, "b", 40, 200)], {"a": 0.5, "b": 0.5}),
    ([(0, 0, "a", 0, 30), (0, 1, "b", 30, 50), (0, 2, "c", 50, 100)], {"a": 0.3, "b": 0.2, "c": 0.5})])
def test_temporal_proportions(spark, spans, want):
    rows = spark.createDataFrame(spans, "episode_index bigint, position bigint, name string, start bigint, end bigint")
    assert {r["name"]: r["proportion"] for r in P.temporal_proportions(rows).collect()} == pytest.approx(want)


def test_bidirectional_window(spark):
    row = spark.createDataFrame([(0, 300, 300, 0, 1000)], "episode_index bigint, frame_index bigint, index bigint, dataset_from_index bigint, length bigint")
    got = W.bidirectional_indices(row, 8, 30).first()
    assert got["window_index"] == [180, 210, 240, 270, 300, 330, 360, 390, 420] and not any(got["window_out_of_bounds"])


@pytest.mark.parametrize("times,want", [([0, 0.5, 1, 1.5, 2], 2.0), ([0, 0.1, 0.5, 2, 3], 4 / 3)])
def test_achieved_fps(spark, times, want):
    rows = spark.createDataFrame([(0, i, float(t)) for i, t in enumerate(times)], "episode_index bigint, frame_index bigint, t double")
    assert W.achieved_fps(rows, "t").orderBy(F.desc("frame_index")).first()["achieved_fps"] == pytest.approx(want)


def test_deltas():
    deltas = {"a": [i / 30 for i in range(-10, 10)]}
    assert W.deltas_to_frames(deltas, 30)["a"] == list(range(-10, 10))
    assert W.check_deltas(deltas, 30, 1e-4) == []
    for share, bad in ((0.9, []), (1.1, ["a"])):
        assert W.check_deltas({"a": [*deltas["a"], 10 / 30 + 1e-4 * share]}, 30, 1e-4) == bad
    assert W.resolve_deltas({"action": [0, 3], "observation": [-1, 0], "reward": None}, ["action", "observation.state", "next.reward"], 10) == {
        "action": [0.0, 0.3], "observation.state": [-0.1, 0.0]}


def test_episode_bounds(spark):
    rows = spark.createDataFrame([(e, i) for i, e in enumerate([0] * 3 + [1] * 4 + [2] * 5)], "episode_index bigint, index bigint")
    got = W.episode_bounds(rows).orderBy("episode_index").collect()
    assert [r["from"] for r in got] == [0, 3, 7] and [r["to"] for r in got] == [3, 7, 12]


def test_stage_rules(spark):
    frames = spark.createDataFrame([(0, i, i, 14) for i in range(14)], "episode_index bigint, frame_index bigint, index bigint, length bigint")
    spans = spark.createDataFrame([(0, 0, "a", 2, 4), (0, 1, "b", 4, 6), (0, 2, "c", 9, 9), (0, 3, "?", 10, 11)],
                                  "episode_index bigint, position bigint, name string, start_frame bigint, end_frame bigint")
    rows = P.stage_and_tau(frames, spans, ["a", "b", "c"]).orderBy("frame_index").collect()
    want = [(0, 0.0)] * 2 + [(0, 0.0), (0, 0.5), (0, 1.0), (1, 0.5), (1, 1.0), (1, 1.0), (1, 1.0), (2, 1.0), (0, 0.0), (0, 1.0), (2, 0.999), (2, 0.999)]
    assert [(r["stage"], r["tau"]) for r in rows] == want


def test_breakpoints():
    assert P.breakpoints([2, 2, 4]) == [0.0, 0.25, 0.5, 1.0]


def test_progress_weights_of_missing_deltas(spark):
    rows = spark.createDataFrame([(0, None), (1, float("nan")), (2, 0.5), (3, -0.5), (4, 0.0)], "index bigint, delta double")
    got = {r["index"]: r["weight"] for r in P.progress_weights(rows, "delta", fallback=0.3).collect()}
    assert (got[0], got[1], got[2], got[3]) == (0.3, 0.3, 1.0, 0.0) and 0 < got[4] < 1


def test_quantiles_of_one_row_and_constant(spark):
    tall = spark.createDataFrame([("a", 0, 7.0), ("b", 0, 3.0), ("b", 0, 3.0)], "feature string, dim int, value double")
    got = {r["feature"]: r for r in S.histogram_quantiles(tall).collect()}
    assert got["a"]["q50"] == 7.0 and math.isclose(got["b"]["q50"], 3.0, abs_tol=1e-9)


def test_ensemble_weights(spark):
    rows = spark.createDataFrame([(0, 5, 3, 1.0), (0, 5, 4, 2.0)], "episode_index bigint, step bigint, chunk_start bigint, action double")
    w = math.exp(-0.5)
    assert W.ensemble_chunks(rows, 0.5).first()["action"] == pytest.approx((1.0 + 2.0 * w) / (1 + w))


def test_fold_starts_afresh_after_a_gap(spark):
    rows = spark.createDataFrame([(0, n, 5, float(v)) for n, v in ((0, 1), (1, 2), (3, 10), (4, 20))], "episode_index bigint, chunk_no bigint, step bigint, action double")
    got = [r["queued"] for r in W.merge_chunks(rows, "average").orderBy("chunk_no").collect()]
    assert got == [1.0, 1.5, 10.0, 15.0]
    with pytest.raises(KeyError):
        W.fold_function("nope")
