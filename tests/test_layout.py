"""Pruned reading, torn shards, old layouts and results by name; retained rows and the gate's bounded state."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.operators import edit as I
from kinetable.plans.frames import EpisodicDataset, event_frames
from kinetable.sources import layout as L
from kinetable.streaming import operators as J


@pytest.fixture(scope="module")
def written(spark, data, tmp_path_factory):
    frames, episodes = event_frames(spark, data)
    placed = I.assign_files(episodes.withColumn("bytes", F.col("length") * 48.0), "bytes", 6000.0, chunk_size=2)
    tasks = frames.select("task").distinct().withColumn("task_index", F.lit(0).cast("bigint"))
    path = str(tmp_path_factory.mktemp("dataset") / "d")
    L.write_dataset(EpisodicDataset(frames, placed, tasks), path)
    return path, frames, placed.cache()


def files_read(spark, df):
    """Files that the scan of the frames opened."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select(*df.columns)
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if "FileScan" in leaves.apply(i).toString()]
    return [s.metrics().get("numFiles").get().value() for s in scans], plan.toString()


def test_listed_episodes_read_only_their_files(spark, written):
    path, frames, placed = written
    got = L.read_dataset(spark, path, [1, 4, 10**6])
    want = frames.filter("episode_index IN (1, 4)")
    assert got.frames.exceptAll(want.select(*got.frames.columns)).count() == 0 and got.frames.count() == want.count()
    assert {r["episode_index"] for r in got.episodes.select("episode_index").collect()} == {1, 4}
    folders = {r["path"] for r in L.files_for_episodes(placed, got.episodes.select("episode_index"), partitioned=True).collect()}
    assert all(os.path.isdir(f"{path}/{f}") for f in folders)
    held = sum(n.endswith(".parquet") for f in folders for n in os.listdir(f"{path}/{f}"))
    every = sum(n.endswith(".parquet") for _, _, names in os.walk(f"{path}/data") for n in names)
    numbers, plan = files_read(spark, got.frames)
    assert numbers == [held] and held < every
    assert "PartitionFilters: [" in plan and "file_index" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert L.read_dataset(spark, path, []).frames.count() == 0


def test_table_of_episodes_prunes_files(spark, written):
    path, frames, placed = written
    wanted = spark.createDataFrame([(2,), (2,), (7,)], "episode_index bigint")
    got = L.read_dataset(spark, path, wanted)
    want = frames.filter("episode_index IN (2, 7)")
    assert got.frames.exceptAll(want.select(*got.frames.columns)).count() == 0 and got.frames.count() == want.count()
    folders = [r["path"] for r in L.files_for_episodes(placed, wanted, partitioned=True).collect()]
    held = sum(n.endswith(".parquet") for f in folders for n in os.listdir(f"{path}/{f}"))
    numbers, plan = files_read(spark, got.frames)
    assert "dynamicpruning" in plan and held in numbers
    spark.conf.set("spark.kinetable.broadcastRows", "0")
    try:
        assert L.read_dataset(spark, path, wanted).frames.count() == want.count()
    finally:
        spark.conf.unset("spark.kinetable.broadcastRows")


def test_torn_shards_are_found(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(40).select((F.col("id") % 4).alias("shard"), F.col("id").alias("v"), F.col("id").cast("string").alias("t"))
    assert L.completed_shards(spark, path, "shard").collect() == []
    rows.filter("shard = 3").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    assert L.completed_shards(spark, path, "shard").collect() == []  # no entry yet
    L.write_shards(rows.filter("shard < 3"), "shard", path)
    changed = rows.filter("shard = 1").withColumn("t", F.lit("other"))
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    assert {r["shard"] for r in L.completed_shards(spark, path, "shard").collect()} == {0, 2}
    todo = L.resume_shards(rows.select("shard").distinct(), L.completed_shards(spark, path, "shard"), "shard", F.lit(True))
    L.write_shards(rows.join(todo, "shard"), "shard", path)
    assert {(r["shard"], r["rows"]) for r in L.completed_shards(spark, path, "shard").collect()} == {(i, 10) for i in range(4)}
    assert spark.read.parquet(path).select("shard", "v", "t").exceptAll(rows.select(F.col("shard").cast("int"), "v", "t")).count() == 0


def test_legacy_statistics_of_any_shape(spark, tmp_path):
    lines = [
        {"episode_index": 0, "stats": {"a": {"min": [1, 2], "max": [3, 4.5], "mean": [2, 3], "std": [1, 0.5], "count": [10]},
                                       "image": {"min": [[[0.0]], [[0.1]]], "max": [[[1.0]], [[0.9]]], "mean": [[[0.5]], [[0.5]]], "std": [[[0.1]], [[0.2]]], "count": [10]}}},
        {"episode_index": 1, "stats": {"a": {"min": [0, 2], "max": [3, 4], "mean": [1, 3], "std": [1, 0], "count": [30]}}}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = L.read_legacy_stats(spark, str(tmp_path / "s.jsonl")).collect()
    got = {(r["episode_index"], r["feature"], r["dim"]): (r["count"], r["min"], r["max"], r["mean"], r["std"]) for r in rows}
    assert got == {
        (0, "a", 0): (10, 1, 3, 2, 1), (0, "a", 1): (10, 2, 4.5, 3, 0.5), (1, "a", 0): (30, 0, 3, 1, 1), (1, "a", 1): (30, 2, 4, 3, 0),
        (0, "image", 0): (10, 0, 1, 0.5, 0.1), (0, "image", 1): (10, 0.1, 0.9, 0.5, 0.2)}


def test_results_go_by_column_name(spark, tmp_path):
    for name, text in {"x y/a.csv": "run,config,pairs\n1,one,5\n2,one,6\n", "b.csv": "config,extra,run\ntwo,9,7\n", "c.csv": "pairs,run,config\n"}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(text)
    out = L.collect_results(spark, str(tmp_path), "config string, run bigint, pairs bigint")
    assert {tuple(r) for r in out.collect()} == {("one", 1, 5), ("one", 2, 6), ("two", 7, None)}


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("capacity", [1, 5, 400])
def test_retained_rows(spark, keys, capacity):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("key"), (F.col("id") * 7919 % 5003).alias("at"), "id")
    out = J.retain_last_n(rows, keys, ["at", "id"], capacity)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and out.columns == rows.columns
    pdf = rows.toPandas().sort_values(["at", "id"])
    want = (pdf.groupby("key").tail(capacity) if keys else pdf.tail(capacity))["id"]
    assert sorted(r["id"] for r in out.collect()) == sorted(want)
    spark.conf.set("spark.kinetable.segmentRows", "3")
    try:
        assert sorted(r["id"] for r in J.retain_last_n(rows, keys, ["at", "id"], capacity).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.kinetable.segmentRows")


def test_gate_forgets_old_steps(spark, tmp_path):
    """Twelve batches: the state holds the steps of the last ones only, and a forgotten step may pass again."""
    sizes, source = [], str(tmp_path / "in")
    schema = "user bigint, at bigint, step bigint, v array<double>, must boolean"
    before = spark.conf.get(J.STATE_STORE)
    for batch in range(12):
        rows = [(u, batch * 100 + i, batch * 10 + i, [float(batch * 10 + i)], False) for u in (1, 2) for i in range(10)]
        rows += [(1, batch * 100 + 50, (batch - 6) * 10, [1e6 * (batch % 2)], False)] if batch >= 6 else []
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        with J.rocksdb_state(spark):
            stream = J.stream_gate(spark.readStream.schema(schema).parquet(source), "user", "v", "step", ["at"], "must", 0.5, time="at", remember=250)
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(60)
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert spark.conf.get(J.STATE_STORE) == before
    assert max(sizes[4:]) <= max(sizes[:4]) + 4 and sizes[-1] < 12 * 20
    passed = pd.DataFrame([r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).collect()])
    again = passed[(passed["user"] == 1) & (passed["at"] % 100 == 50)]
    assert len(again) >= 5 and np.isin(again["step"], passed[(passed["at"] % 100 < 50)]["step"]).all()
    with pytest.raises(ValueError):
        J.stream_gate(stream, "user", "v", "step", ["at"], "must", remember=5)
