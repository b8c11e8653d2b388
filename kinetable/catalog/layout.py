"""Queries over sources and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, LINES, query
from kinetable.functions.numbers import tidy
from kinetable.functions.text import path_flag
from kinetable.model import features_from_schema
from kinetable.operators import edit as I
from kinetable.operators import stats as S
from kinetable.operators.relate import register_tasks, with_task, with_task_index
from kinetable.plans.frames import EpisodicDataset, event_frames, line_frames
from kinetable.session import scratch_path
from kinetable.sources import layout as L
from kinetable.sources.nested import flatten_nested_episodes


@query("a01_read_frames", f"""WITH {EVENTS} SELECT event_id, value, user_id AS episode_index FROM fe WHERE user_id IN (SELECT user_id FROM fe GROUP BY 1 HAVING count(*) >= 66)""")
def read_frames(spark, root):
    """Frames of the episodes of 66 frames or more, read with a semi-join."""
    path = f"{root}/events.parquet"
    schema = "event_id bigint, user_id bigint, value double"
    rows = L.read_frames(spark, path, schema).withColumnRenamed("user_id", "episode_index")
    long_ones = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n")).filter("n >= 66")
    return rows.join(long_ones, "episode_index", "left_semi").select("event_id", "value", "episode_index")


def _written(spark, root):
    """The event frames written as a dataset directory; returns its path and the episode table."""
    frames, episodes = event_frames(spark, root)
    frames = frames.select("episode_index", "frame_index", "index", "timestamp", "task", "value")
    tasks = register_tasks(frames)
    frames = with_task_index(frames, tasks).drop("task")
    episodes = episodes.withColumn("bytes", F.col("length") * 48.0)
    placed = I.assign_files(episodes, "bytes", 12000.0, chunk_size=10).drop("bytes")
    stats = S.feature_stats(S.to_series(frames, ["episode_index"], ["value"]), ["episode_index"])
    placed = placed.join(S.stats_to_wide(stats, ["value"], ["mean", "min", "max"], ["episode_index"]), "episode_index")
    path = scratch_path(spark, "dataset")
    L.write_dataset(EpisodicDataset(frames, placed, tasks), path)
    return path


@query("a01_write_and_read", f"""WITH {EVENTS}, tk AS (SELECT task, row_number() OVER (ORDER BY min("index")) - 1 AS task_index FROM fe GROUP BY 1) SELECT "index", episode_index, frame_index, task, value FROM fe JOIN tk USING (task)""")
def write_and_read(spark, root):
    dataset = L.read_dataset(spark, _written(spark, root))
    return with_task(dataset.frames, dataset.tasks).select("index", "episode_index", "frame_index", "task", "value")


@query("a01_read_chosen_episodes", f"""WITH {EVENTS} SELECT "index", episode_index, frame_index, value FROM fe WHERE length >= 66""")
def read_chosen_episodes(spark, root):
    """The episodes of 66 frames or more, from the files that hold them."""
    path = _written(spark, root)
    wanted = L.read_episodes(spark, f"{path}/meta/episodes").filter("length >= 66").select("episode_index")
    return L.read_dataset(spark, path, wanted).frames.select("index", "episode_index", "frame_index", "value")


@query("a08_read_listed_episodes", f"""WITH {EVENTS} SELECT "index", episode_index, frame_index, value FROM fe WHERE episode_index IN (1, 5, 8)""")
def read_listed_episodes(spark, root):
    return L.read_dataset(spark, _written(spark, root), [1, 5, 8]).frames.select("index", "episode_index", "frame_index", "value")


@query("a02_read_episodes", f"""WITH {EVENTS} SELECT episode_index, user_id, count(*) AS length, min("index") AS dataset_from_index, max("index") + 1 AS dataset_to_index FROM fe GROUP BY 1, 2""")
def read_episodes(spark, root):
    episodes = L.read_episodes(spark, f"{_written(spark, root)}/meta/episodes")
    if any(c.startswith("stats/") for c in episodes.columns):
        raise ValueError("statistics columns were read")
    return episodes.select("episode_index", "user_id", "length", "dataset_from_index", "dataset_to_index")


@query("a03_write_and_read_info", f"""WITH {LINES} SELECT count(*) AS total_frames, count(DISTINCT episode_index) AS total_episodes, 10::BIGINT AS fps, '0:' || count(DISTINCT episode_index) AS train FROM fl""")
def write_and_read_info(spark, root):
    """The descriptor of the line frames, written as JSON and read back as a dict and as a variant."""
    frames, _ = line_frames(spark, root)
    totals = L.describe(frames).first()
    info = L.new_info("v3.0", 10, features_from_schema(frames.select("l_quantity", "l_tax").schema))
    info |= {"total_frames": totals["total_frames"], "total_episodes": totals["total_episodes"], "splits": {"train": totals["splits"]}}
    path = scratch_path(spark, "info")
    L.write_info(spark, info, path)
    if L.read_info(spark, path) != info:
        raise ValueError("the descriptor changed on the way")
    at = lambda field, kind: F.variant_get("info", f"$.{field}", kind)
    return L.read_info_row(spark, path).select(
        at("total_frames", "bigint").alias("total_frames"), at("total_episodes", "bigint").alias("total_episodes"), at("fps", "bigint").alias("fps"), at("splits.train", "string").alias("train"))


@query("a05_read_tasks", f"""WITH {LINES} SELECT task, row_number() OVER (ORDER BY min("index")) - 1 AS task_index FROM fl GROUP BY 1""")
def read_tasks(spark, root):
    frames, _ = line_frames(spark, root)
    path = scratch_path(spark, "tasks")
    L.write_tasks(register_tasks(frames), path)
    return L.read_tasks(spark, path)


@query("a07_compact_legacy", f"""WITH {EVENTS}, tk AS (SELECT task, row_number() OVER (ORDER BY min("index")) - 1 AS task_index FROM fe GROUP BY 1)
  SELECT "index", episode_index, frame_index, task, value, min("index") OVER (PARTITION BY episode_index) AS dataset_from_index, length FROM fe JOIN tk USING (task)""")
def compact_legacy(spark, root):
    """The event frames in the old layout (a directory per episode, JSON lines), then compacted."""
    frames, episodes = event_frames(spark, root)
    tasks = register_tasks(frames)
    path = scratch_path(spark, "legacy")
    names = frames.groupBy("episode_index").agg(F.array_sort(F.collect_set("task")).alias("tasks"))
    old = with_task_index(frames, tasks).select("episode_index", "frame_index", "value", "task_index", F.col("episode_index").alias("episode"))
    old.repartition("episode", F.floor(F.col("frame_index") / 65536)).write.partitionBy("episode").parquet(f"{path}/data")
    episodes.join(names, "episode_index").select("episode_index", "tasks", "length").write.json(f"{path}/meta/episodes.jsonl")
    tasks.write.json(f"{path}/meta/tasks.jsonl")
    dataset = L.compact_legacy(spark, path)
    rows = with_task(dataset.frames, dataset.tasks).join(dataset.episodes.drop("tasks"), "episode_index")
    return rows.select("index", "episode_index", "frame_index", "task", "value", "dataset_from_index", "length")


@query("a07_legacy_stats", """SELECT 'value' AS feature, 0::BIGINT AS dim, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS std FROM events""")
def legacy_stats(spark, root):
    """Statistics of episodes stored as JSON lines in the old layout, merged on conversion."""
    frames, episodes = event_frames(spark, root)
    path = scratch_path(spark, "legacy")
    frames.select("episode_index", "frame_index", "value").write.parquet(f"{path}/data")
    episodes.select("episode_index", F.array(F.lit("any")).alias("tasks"), "length").write.json(f"{path}/meta/episodes.jsonl")
    spark.createDataFrame([(0, "any")], "task_index bigint, task string").write.json(f"{path}/meta/tasks.jsonl")
    each = S.frame_stats(frames, ["episode_index"], ["value"])
    vectors = F.struct(*[F.array(n).alias(n) for n in ("min", "max", "mean", "std", "count")])
    each.select("episode_index", F.struct(vectors.alias("value")).alias("stats")).write.json(f"{path}/meta/episodes_stats.jsonl")
    L.write_info(spark, {"fps": 30, "robot_type": None}, f"{path}/meta/info.json")
    stats = L.compact_legacy(spark, path).stats
    return stats.select("feature", F.col("dim").cast("bigint").alias("dim"), "count", "min", "max", tidy("mean", 7).alias("mean"), tidy("std", 7).alias("std"))


@query("a09_flatten_nested_episodes", """WITH s AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents), e AS (SELECT doc_id, lang, source, len(parts) AS n, unnest(parts) AS line, unnest(range(len(parts))) AS frame_index FROM s)
  SELECT doc_id, lang, frame_index, line AS task, length(line)::FLOAT::DOUBLE AS state0, length(replace(line, ' ', ''))::FLOAT::DOUBLE AS state1, frame_index = 0 AS is_first, frame_index = n - 1 AS is_last,
  contains(source, 'src1') AS is_episode_successful, (frame_index = n - 1 AND contains(source, 'src1')) AS done, (frame_index = n - 1 AND contains(source, 'src1'))::INT::DOUBLE AS reward FROM e""")
def flatten_nested(spark, root):
    """Documents as episodes whose steps are their lines."""
    docs = spark.read.parquet(f"{root}/documents.parquet")
    size = lambda c: F.length(c).cast("double")
    step = lambda line: F.struct(
        line.alias("instruction"), F.array(size(line)).alias("chars"), size(F.replace(line, F.lit(" "), F.lit(""))).alias("letters"))
    nested = docs.select("doc_id", "lang", "source", F.transform(F.split("text", "\n"), step).alias("steps"))
    rows = flatten_nested_episodes(nested, "steps", ["doc_id", "lang"], {"state": ["chars", "letters"]}, path_flag(F.col("source"), "src1"), "instruction")
    state = [F.get("state", F.lit(i)).cast("double").alias(f"state{i}") for i in range(2)]
    return rows.select("doc_id", "lang", "frame_index", "task", *state, "is_first", "is_last", "is_episode_successful", "done", F.col("reward").cast("double").alias("reward"))


@query("a11_describe_dataset", f"""WITH {EVENTS} SELECT count(*) AS total_frames, count(DISTINCT episode_index) AS total_episodes, count(DISTINCT task) AS total_tasks, '0:' || count(DISTINCT episode_index) AS splits FROM fe""")
def describe_dataset(spark, root):
    frames, _ = event_frames(spark, root)
    return L.describe(frames).drop("features")


@query("a13_resume_shards", """SELECT c_custkey AS shard FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)""")
def resume_shards(spark, root):
    """Customers are the shards; an expensive finished order is a valid result of one."""
    expected = spark.read.parquet(f"{root}/customer.parquet").select(F.col("c_custkey").alias("shard"))
    done = spark.read.parquet(f"{root}/orders.parquet").withColumnRenamed("o_custkey", "shard")
    return L.resume_shards(expected, done, "shard", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))


@query("a13_resume_torn_shard", """SELECT o_orderpriority AS shard, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def resume_torn_shard(spark, root):
    """Orders by priority are the shards: three are written, one of them is torn, and the rest is done on resuming."""
    orders = spark.read.parquet(f"{root}/orders.parquet").select(F.col("o_orderpriority").alias("shard"), "o_orderkey", "o_totalprice")
    path = scratch_path(spark, "shards")
    L.write_shards(orders.filter("shard IN ('1-URGENT', '2-HIGH', '5-LOW')"), "shard", path)
    torn = orders.filter("shard = '2-HIGH' AND o_orderkey % 2 = 0")
    torn.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    todo = L.resume_shards(orders.select("shard").distinct(), L.completed_shards(spark, path, "shard"), "shard", F.lit(True))
    L.write_shards(orders.join(F.broadcast(todo), "shard"), "shard", path)  # one row a shard
    done = spark.read.parquet(path).join(F.broadcast(L.completed_shards(spark, path, "shard").select("shard")), "shard")
    return done.groupBy("shard").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("t")).select("shard", "orders", tidy("t", 2).alias("total"))


@query("a14_collect_results", """SELECT o_orderpriority AS config, o_custkey AS run, count(*) AS pairs, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def collect_results(spark, root):
    """One CSV table per order priority, then their union."""
    orders = spark.read.parquet(f"{root}/orders.parquet")
    results = orders.groupBy("o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("o_totalprice").alias("total"))
    path = scratch_path(spark, "results")
    results = results.select(F.col("o_orderpriority").alias("config"), F.col("o_custkey").alias("run"), "pairs", "total", F.col("o_orderpriority").alias("part"))
    results.write.option("header", "true").partitionBy("part").csv(path)
    out = L.collect_results(spark, path, "config string, run bigint, pairs bigint, total double")
    return out.withColumn("total", tidy("total", 2))
