"""Files: images, stored layouts, descriptors, missing files."""

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinetable.operators import edit as I
from kinetable.operators import stats as S
from kinetable.operators import validate as X
from kinetable.plans.frames import EpisodicDataset, event_frames
from kinetable.sources import images as M
from kinetable.sources import layout as L


def png(path, cube):
    height, width, _ = cube.shape
    raw = b"".join(b"\0" + cube[y].tobytes() for y in range(height))

    def block(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + block(b"IHDR", head) + block(b"IDAT", zlib.compress(raw)) + block(b"IEND", b""))


def test_read_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    cubes = {f"frame-{i}.png": rng.integers(0, 256, (5, 7, 3), dtype=np.uint8) for i in range(3)}
    for name, cube in cubes.items():
        png(tmp_path / name, cube)
    rows = M.read_images(spark, str(tmp_path))
    for row in rows.collect():
        want = cubes[row["path"].rsplit("/", 1)[1]]
        assert (np.frombuffer(row["pixels"], np.uint8).reshape(5, 7, 3) == want).all()
    first = M.scaled_pixels(rows.filter(F.col("path").endswith("frame-0.png"))).first()
    assert np.allclose(first["values"], (cubes["frame-0.png"].transpose(2, 0, 1) / 255).ravel(), atol=1e-6)


def test_stored_layout(spark, tmp_path):
    for d in ("data/chunk-000", "meta/episodes/chunk-000"):
        (tmp_path / d).mkdir(parents=True)
    for f in range(2):
        pd.DataFrame({"episode_index": [f, f], "frame_index": [0, 1], "index": [2 * f, 2 * f + 1], "task_index": [0, 1]}).to_parquet(tmp_path / f"data/chunk-000/file-{f:03d}.parquet")
    pd.DataFrame({"episode_index": [0, 1], "length": [2, 2], "stats/a/mean": [1.0, 2.0]}).to_parquet(tmp_path / "meta/episodes/chunk-000/file-000.parquet")
    pd.DataFrame({"task_index": [0, 1]}, index=["pick", "place"]).to_parquet(tmp_path / "meta/tasks.parquet")
    dataset = L.read_stored_dataset(spark, str(tmp_path))
    assert dataset.frames.count() == 4 and "stats/a/mean" not in dataset.episodes.columns
    assert {r["task"]: r["task_index"] for r in dataset.tasks.collect()} == {"pick": 0, "place": 1}
    chosen = L.read_frames(spark, f"{tmp_path}/data/chunk-*/file-*.parquet", episodes=[1])
    assert [r["index"] for r in chosen.orderBy("index").collect()] == [2, 3]
    assert "In(episode_index" in chosen._jdf.queryExecution().toString() or "EqualTo(episode_index" in chosen._jdf.queryExecution().toString()


def test_missing_files(spark, tmp_path, data):
    frames, episodes = event_frames(spark, data)
    placed = I.assign_files(episodes.withColumn("bytes", F.col("length") * 48.0), "bytes", 6000.0, chunk_size=4)
    expected = L.files_for_episodes(placed)
    paths = sorted(r["path"] for r in expected.collect())
    for path in paths[:-1]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x")
    assert [r["path"] for r in X.check_files(expected, str(tmp_path)).collect()] == paths[-1:]


def test_info_and_stats(spark, tmp_path):
    info = L.new_info("v3.0", 30, {"state": {"dtype": "float32", "shape": (2,)}}, "arm")
    L.write_info(spark, info, str(tmp_path / "info.json"))
    assert L.read_info(spark, str(tmp_path / "info.json")) == info
    (tmp_path / "stats.json").write_text(json.dumps({"state": {"mean": [0.5, 1.5], "count": [10]}, "img": {"mean": [[[0.1]], [[0.2]]]}}))
    rows = {(r["feature"], r["stat"], r["dim"]): r["value"] for r in L.read_stats_json(spark, str(tmp_path / "stats.json")).collect()}
    assert rows[("state", "mean", 1)] == 1.5 and rows[("state", "count", 0)] == 10 and rows[("img", "mean", 1)] == 0.2


def test_stats_forms(spark, tmp_path, data):
    frames, _ = event_frames(spark, data)
    stats = S.feature_stats(S.to_series(frames, ["episode_index"], ["value", "timestamp"]), ["episode_index"])
    wide = S.stats_to_wide(stats, ["value", "timestamp"], ["mean", "max"], ["episode_index"])
    back = S.wide_to_stats(wide, ["episode_index"])
    want = S.stats_to_tall(stats, ["episode_index"]).filter("stat in ('mean', 'max')").select(*back.columns)
    assert back.count() == want.count() and back.exceptAll(want).count() == 0
    whole = S.stats_to_tall(S.feature_stats(S.to_series(frames, [], ["value"]))).select("feature", "dim", "stat", "value")
    L.write_stats_json(whole, str(tmp_path / "s.json"))
    again = L.read_stats_json(spark, str(tmp_path / "s.json"))
    assert {tuple(r) for r in again.select(*whole.columns).collect()} == {tuple(r) for r in whole.collect()}


def test_shards_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(12).withColumn("shard", F.col("id") % 4)
    L.write_shards(rows.filter("shard < 3"), "shard", path)
    L.write_shards(rows.filter("shard = 1"), "shard", path)
    done = L.completed_shards(spark, path, "shard")
    assert {(r["shard"], r["rows"]) for r in done.collect()} == {(0, 3), (1, 3), (2, 3)}
    todo = L.resume_shards(spark.range(4).withColumnRenamed("id", "shard"), done, "shard", F.col("rows") == 3)
    assert [r["shard"] for r in todo.collect()] == [3]


def test_sharded_shuffle(spark):
    from kinetable.operators.select import shuffle_sharded

    frames = spark.range(2000).withColumnRenamed("id", "index")
    out = shuffle_sharded(frames, 4, 50, 3).toPandas().sort_values(["shard", "position"])
    assert sorted(out["index"]) == list(range(2000))
    for _, part in out.groupby("shard"):
        assert list(part["position"]) == list(range(len(part)))
        rank = part["index"].rank().to_numpy() - 1
        assert (rank <= part["position"].to_numpy() + 50).all() and list(part["index"]) != sorted(part["index"])
    again = shuffle_sharded(frames.repartition(3), 4, 50, 3).toPandas().sort_values(["shard", "position"])
    assert list(again["index"]) == list(out["index"])


def test_round_trip_keeps_rows(spark, tmp_path, data):
    frames, episodes = event_frames(spark, data)
    placed = I.assign_files(episodes.withColumn("bytes", F.col("length") * 48.0), "bytes", 6000.0)
    path = str(tmp_path / "d")
    L.write_dataset(EpisodicDataset(frames, placed, frames.select("task").distinct().withColumn("task_index", F.lit(0).cast("bigint"))), path)
    back = L.read_dataset(spark, path)
    assert back.frames.exceptAll(frames.select(*back.frames.columns)).count() == 0 and back.frames.count() == frames.count()


def test_greedy_parts_are_one_fold(spark):
    import random

    rng = random.Random(12)
    for sizes in ([3.0] * 100, [rng.random() * 4 for _ in range(200)], [0.1] * 150, [0.0, 20.0, 0.0, 9.9] * 20):
        rows = spark.createDataFrame([(i, s, i % 5) for i, s in enumerate(sizes)], "episode_index long, size double, n long").repartition(3)
        for limits in ({}, {"max_items": 7}, {"count": "n", "max_count": 11}, {"max_items": 40}):
            want, at, filled, held, counted = [], 0, 0.0, 0, 0
            for i, s in enumerate(sizes):
                n = i % 5 if "count" in limits else 0
                if held and (filled > 0 and filled + s >= 10.0 or held >= limits.get("max_items", 10**9) or counted + n > limits.get("max_count", 10**9)):
                    at, filled, held, counted = at + 1, 0.0, 0, 0
                filled, held, counted = filled + s, held + 1, counted + n
                want.append(at)
            found = I.pack_greedy(rows, "episode_index", "size", 10.0, part=16, **limits).orderBy("episode_index").collect()
            assert [r["bin"] for r in found] == want
