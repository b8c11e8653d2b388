"""Streams in several batches against the same operators on all rows at once."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.streaming import batches as M
from kinetable.streaming import operators as J

SCHEMA = "source bigint, at bigint, tag bigint, value double, done boolean"
BIG = 2**60


def _parts():
    """Three batches: one source with most rows, one that comes late, one key that is null, nulls beside large whole numbers."""
    rng = np.random.default_rng(5)
    rows = []
    for at in range(90):
        for source in (1, 1, 1, 2 if at > 40 else 1, None):
            n = len(rows)
            rows.append((source, n, None if n % 7 == 0 else BIG + n, None if n % 11 == 0 else float(rng.integers(0, 100)), None if n % 13 == 0 else n % 17 == 0))
    return rows, [rows[:100], rows[100:280], rows[280:]]


def _run(spark, tmp_path, work, mode="append"):
    """Drain each batch after it has come; the query resumes from its checkpoint."""
    source, path = str(tmp_path / "in"), str(tmp_path / "stream")
    with J.rocksdb_state(spark):
        for part in _parts()[1]:
            spark.createDataFrame(part[::-1], SCHEMA).repartition(2).write.mode("append").parquet(source)
            M.drain(work(spark.readStream.schema(SCHEMA).parquet(source)), path, mode=mode)
    return path


def _by_source():
    found = {}
    for row in _parts()[0]:
        found.setdefault(row[0], []).append(row)
    return found


def test_assembled_episodes_keep_large_numbers_beside_nulls(spark, tmp_path):
    path = _run(spark, tmp_path, lambda s: J.assemble_episodes(s, "source", ["at"], F.col("done")))
    want = set()
    for rows in _by_source().values():
        episode = frame = 0
        for row in rows:
            want.add((*row, episode, frame))
            episode, frame = (episode + 1, 0) if row[4] else (episode, frame + 1)
    assert {tuple(r) for r in M.output(spark, path).select("source", "at", "tag", "value", "done", "episode_no", "frame_index").collect()} == want


def test_ring_over_all_rows_and_per_key(spark, tmp_path):
    rows, _ = _parts()
    for name, keys, capacity in (("all", [], 60), ("key", ["source"], 25)):
        path = _run(spark, tmp_path / name, lambda s: J.retain_stream(s, keys, ["at"], capacity))
        kept = J.retained(spark, f"{path}/progress", spark.createDataFrame([], SCHEMA).schema, keys, ["at"], capacity)
        want = rows[-capacity:] if not keys else [r for group in _by_source().values() for r in group[-capacity:]]
        assert {tuple(r) for r in kept.select("source", "at", "tag", "value", "done").collect()} == set(want)


def test_windows_wait_for_their_look_ahead(spark, tmp_path):
    def work(stream):
        rows = stream.select(F.lit(1).cast("bigint").alias("episode_index"), F.col("at").alias("frame_index"), "tag", "value", (F.col("at") < 0).alias("is_last"))
        return J.read_frames_stream(rows, {"value": [-2, 0, 3], "tag": [1]}, "clamp")

    path = _run(spark, tmp_path, work)
    rows = _parts()[0]
    got = {r["frame_index"]: r for r in M.output(spark, path).collect()}
    assert sorted(got) == [r[1] for r in rows[:-3]]  # the last ones still wait, as the episode is open
    for i, row in enumerate(rows[:-3]):
        r = got[row[1]]
        assert r["value_window"] == [rows[max(0, i - 2)][3], row[3], rows[i + 3][3]] and r["value_is_pad"] == [i < 2, False, False]
        assert r["tag"] == row[2] and r["tag_window"] == [rows[i + 1][2]]
    with pytest.raises(ValueError):
        J.read_frames_stream(spark.createDataFrame([], SCHEMA), {"value": [0]}, "other")


def test_running_statistics_and_newest_items(spark, tmp_path):
    path = _run(spark, tmp_path / "stats", lambda s: J.stream_stats(s, ["value"]), "update")
    values = [r[3] for r in _parts()[0] if r[3] is not None]
    (r,) = M.newest(spark, path, ["feature", "dim"]).collect()
    assert r["count"] == len(values) and (r["min"], r["max"]) == (min(values), max(values))
    assert np.isclose(r["mean"], np.mean(values)) and np.isclose(r["std"], np.std(values))
    path = _run(spark, tmp_path / "latest", lambda s: J.latest(s, "source", "at", ["at", "tag"]), "update")
    got = {r["source"]: tuple(r["latest"]) for r in M.newest(spark, path, ["source"]).collect()}
    assert got == {source: rows[-1][1:3] for source, rows in _by_source().items()}


def test_latency_windows_of_any_size():
    rng = np.random.default_rng(8)
    values = rng.random(50)
    for size in (1, 4, 80):
        found = J.Latency(["at"], "x", size, {"p": 0.9, "low": 0.0})._recent(values, 7)
        for i in range(7, 50):
            recent = values[max(0, i - size + 1) : i + 1]
            assert np.isclose(found["p"][i - 7], np.quantile(recent, 0.9)) and found["low"][i - 7] == recent.min()


def test_gate_asks_its_state_for_distant_rows_only():
    asked = []
    gate = J.Gate("v", "step", ["at"], "must", 1.0)
    gate.last = SimpleNamespace(exists=lambda: True, get=lambda: ([0.0],), update=lambda value: None)
    gate.seen = SimpleNamespace(containsKey=lambda key: asked.append(key) or key == (3,), getValue=lambda key: (0,), updateValue=lambda key, value: None)
    rows = pd.DataFrame({"v": [[0.5], [2.0], [2.5], [9.0], [9.5]], "step": [1, 2, 2, 3, 5], "at": range(5), "must": [False] * 5})
    out = pd.concat(gate.handleInputRows(("a",), iter([rows]), None))
    assert out["at"].tolist() == [1, 4] and asked == [(2,), (3,), (5,)]
