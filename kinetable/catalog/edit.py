"""Queries over whole-dataset edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, LINES, query
from kinetable.functions.numbers import tidy
from kinetable.operators import edit as I
from kinetable.operators import stats as S
from kinetable.operators.relate import register_tasks, with_task_index
from kinetable.plans.frames import LINE_ORDER, EpisodicDataset, event_frames, index_frames, line_frames

FEATURES = ["l_quantity", "l_tax"]


def _dataset(frames, episodes):
    tasks = register_tasks(frames)
    frames = with_task_index(frames, tasks).drop("task")
    return EpisodicDataset(frames, episodes, tasks)


def _lines(spark, root):
    frames, episodes = line_frames(spark, root)
    frames = frames.select("episode_index", "frame_index", "index", "l_orderkey", "task", *FEATURES)
    return _dataset(frames, episodes.select("episode_index", "length", "dataset_from_index", "dataset_to_index", "l_orderkey"))


def _statuses(spark, root):
    """Two datasets: the lines of finished orders and of the others."""
    lines = spark.read.parquet(f"{root}/lineitem.parquet").select("l_orderkey", *LINE_ORDER)
    orders = spark.read.parquet(f"{root}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    lines = lines.join(orders, "l_orderkey")
    out = []
    for part in (lines.filter("o_orderstatus = 'F'"), lines.filter("o_orderstatus <> 'F'")):
        frames, episodes = index_frames(part, "l_orderkey", LINE_ORDER)
        frames = frames.select("episode_index", "frame_index", "index", "l_orderkey", F.col("l_returnflag").alias("task"), *FEATURES)
        dataset = _dataset(frames, episodes.select("episode_index", "length", "dataset_from_index", "dataset_to_index", "l_orderkey"))
        dataset.stats = S.feature_stats(S.to_series(frames, [], FEATURES))
        out.append(dataset)
    return out


_TWO = f"""{LINES}, ss AS (SELECT fl.*, (o_orderstatus <> 'F')::INT AS src FROM fl JOIN orders ON o_orderkey = l_orderkey),
  mm AS (SELECT *, dense_rank() OVER (ORDER BY src, l_orderkey) - 1 AS ep, row_number() OVER (ORDER BY src, l_orderkey, frame_index) - 1 AS ix FROM ss),
  ft AS (SELECT src, task, min(ix) AS f FROM mm GROUP BY 1, 2), ut AS (SELECT task, row_number() OVER (ORDER BY min(f)) - 1 AS tid FROM ft GROUP BY 1)"""


@query("i01_merge_datasets", f"""WITH {_TWO} SELECT ix AS "index", ep AS episode_index, frame_index, tid AS task_index, l_quantity FROM mm JOIN ut USING (task)""")
def merge_datasets(spark, root):
    merged = I.merge_datasets(_statuses(spark, root))
    return merged.frames.select("index", "episode_index", "frame_index", "task_index", "l_quantity")


@query("i01_merge_episodes", f"""WITH {_TWO} SELECT ep AS episode_index, l_orderkey, count(*) AS length, min(ix) AS dataset_from_index, max(ix) + 1 AS dataset_to_index FROM mm GROUP BY 1, 2""")
def merge_episodes(spark, root):
    return I.merge_datasets(_statuses(spark, root)).episodes.select("episode_index", "l_orderkey", "length", "dataset_from_index", "dataset_to_index")


@query("i01_merge_stats", """SELECT f AS feature, count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std FROM (SELECT 'l_quantity' AS f, l_quantity AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT 'l_tax', l_tax FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""")
def merged_stats(spark, root):
    stats = I.merge_datasets(_statuses(spark, root)).stats
    return stats.select("feature", "count", "min", "max", tidy("mean", 7).alias("mean"), tidy("std", 7).alias("std"))


@query("i01_merge_info", f"""WITH {_TWO} SELECT count(DISTINCT ep) AS total_episodes, count(*) AS total_frames, count(DISTINCT task) AS total_tasks, '0:' || count(DISTINCT ep) AS train FROM mm""")
def merged_info(spark, root):
    info = I.merge_datasets(_statuses(spark, root)).info
    return info.select("total_episodes", "total_frames", "total_tasks", F.col("splits")["train"].alias("train"))


_SPLIT = f"""{LINES}, nn AS (SELECT max(episode_index) + 1 AS n FROM fl), sp AS (SELECT fl.*, CASE WHEN episode_index < floor(n * 0.7::DOUBLE) THEN 'train' WHEN episode_index < floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM fl, nn)"""


@query("i02_split_dataset", f"""WITH {_SPLIT} SELECT split, l_orderkey, frame_index, dense_rank() OVER (PARTITION BY split ORDER BY l_orderkey) - 1 AS episode_index, row_number() OVER (PARTITION BY split ORDER BY l_orderkey, frame_index) - 1 AS "index" FROM sp""")
def split_dataset(spark, root):
    out = I.split_dataset(_lines(spark, root), {"train": 0.7, "val": 0.2, "test": 0.05})
    return out.frames.select("split", "l_orderkey", "frame_index", "episode_index", "index")


@query("i02_split_by_list", f"""WITH {LINES}, sp AS (SELECT fl.*, o_orderpriority AS split FROM fl JOIN orders ON o_orderkey = l_orderkey)
  SELECT split, l_orderkey, count(*) AS length, dense_rank() OVER (PARTITION BY split ORDER BY l_orderkey) - 1 AS episode_index FROM sp GROUP BY 1, 2""")
def split_by_list(spark, root):
    """Episodes split by the priority of their order."""
    dataset = _lines(spark, root)
    priority = spark.read.parquet(f"{root}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("split"))
    splits = dataset.episodes.join(priority, "l_orderkey").select("episode_index", "split")
    return I.split_dataset(dataset, splits).episodes.select("split", "l_orderkey", "length", "episode_index")


_PARTS = {"train": 0.7, "val": 0.2, "test": 0.05}


@query("i02_split_tasks", f"""WITH {_SPLIT}, tk AS (SELECT task, row_number() OVER (ORDER BY min("index")) - 1 AS old FROM fl GROUP BY 1),
  st AS (SELECT DISTINCT split, task, old FROM sp JOIN tk USING (task)), nw AS (SELECT split, task, row_number() OVER (PARTITION BY split ORDER BY old) - 1 AS task_index FROM st)
  SELECT split, task, task_index, count(*) AS frames FROM sp JOIN nw USING (split, task) GROUP BY ALL""")
def split_tasks(spark, root):
    out = I.split_dataset(_lines(spark, root), _PARTS)
    return out.frames.groupBy("split", "task_index").agg(F.count(F.lit(1)).alias("frames")).join(out.tasks, ["split", "task_index"]).select("split", "task", "task_index", "frames")


@query("i02_split_stats", f"""WITH {_SPLIT}, v AS (SELECT split, 'l_quantity' AS feature, l_quantity AS x FROM sp UNION ALL SELECT split, 'l_tax', l_tax FROM sp)
  SELECT split, feature, count(*) AS count, min(x) AS min, max(x) AS max, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS std FROM v GROUP BY ALL""")
def split_stats(spark, root):
    dataset = _lines(spark, root)
    dataset.stats = S.frame_stats(dataset.frames, ["episode_index"], FEATURES)
    stats = I.split_dataset(dataset, _PARTS).stats
    return stats.select("split", "feature", "count", "min", "max", tidy("mean", 7).alias("mean"), tidy("std", 7).alias("std"))


@query("i02_split_info", f"""WITH {_SPLIT} SELECT split, count(DISTINCT l_orderkey) AS total_episodes, count(*) AS total_frames, count(DISTINCT task) AS total_tasks, '0:' || count(DISTINCT l_orderkey) AS range FROM sp GROUP BY 1""")
def split_info(spark, root):
    info = I.split_dataset(_lines(spark, root), _PARTS).info
    return info.select("split", "total_episodes", "total_frames", "total_tasks", F.element_at("splits", F.col("split")).alias("range"))


def _unwanted(spark, root, episodes):
    late = spark.read.parquet(f"{root}/orders.parquet").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return episodes.join(late, "l_orderkey", "left_semi")


_KEPT = f"""{LINES}, kp AS (SELECT fl.*, dense_rank() OVER (ORDER BY l_orderkey) - 1 AS ep, row_number() OVER (ORDER BY l_orderkey, frame_index) - 1 AS ix FROM fl
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')), kt AS (SELECT task, row_number() OVER (ORDER BY min(ix)) - 1 AS tid FROM kp GROUP BY 1)"""


@query("i03_delete_episodes", f"""WITH {_KEPT} SELECT ep AS episode_index, ix AS "index", frame_index, l_orderkey, tid AS task_index FROM kp JOIN kt USING (task)""")
def delete_episodes(spark, root):
    dataset = _lines(spark, root)
    out = I.delete_episodes(dataset, _unwanted(spark, root, dataset.episodes))
    return out.frames.select("episode_index", "index", "frame_index", "l_orderkey", "task_index")


@query("i04_reindex_episodes", f"""WITH {_KEPT} SELECT ep AS episode_index, l_orderkey, count(*) AS length FROM kp GROUP BY 1, 2""")
def reindex_episodes(spark, root):
    dataset = _lines(spark, root)
    mapping = _mapping(spark, root, dataset)
    stats = S.feature_stats(S.to_series(dataset.frames, ["episode_index"], FEATURES), ["episode_index"])
    episodes, _ = I.reindex_episodes(dataset.episodes, stats, mapping)
    return episodes.select("episode_index", "l_orderkey", "length")


@query("i04_reindex_stats", f"""WITH {_KEPT} SELECT f AS feature, count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std FROM (SELECT 'l_quantity' AS f, l_quantity AS v FROM kp UNION ALL SELECT 'l_tax', l_tax FROM kp) GROUP BY 1""")
def reindex_stats(spark, root):
    dataset = _lines(spark, root)
    stats = S.feature_stats(S.to_series(dataset.frames, ["episode_index"], FEATURES), ["episode_index"])
    _, merged = I.reindex_episodes(dataset.episodes, stats, _mapping(spark, root, dataset))
    return merged.select("feature", "count", "min", "max", tidy("mean", 7).alias("mean"), tidy("std", 7).alias("std"))


def _mapping(spark, root, dataset):
    from kinetable.plans.segments import number_rows

    kept = dataset.episodes.join(_unwanted(spark, root, dataset.episodes).select("episode_index"), "episode_index", "left_anti")
    return number_rows(kept.select("episode_index"), [], ["episode_index"], "new_episode")


_TASKED = f"""{EVENTS}, fi AS (SELECT episode_index, user_id, arg_min(task, frame_index) AS first_task FROM fe GROUP BY 1, 2),
  ch AS (SELECT episode_index, CASE WHEN c_mktsegment = 'BUILDING' THEN 'build for ' || c_mktsegment ELSE first_task END AS task FROM fi JOIN customer ON c_custkey = user_id),
  ct AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS task_index FROM (SELECT DISTINCT task FROM ch))"""


@query("i05_modify_tasks", f"""WITH {_TASKED} SELECT fe."index", task_index, ct.task FROM fe JOIN ch USING (episode_index) JOIN ct ON ct.task = ch.task""")
def modify_tasks(spark, root):
    """Users of one market segment get a new task, others keep their first one."""
    frames, episodes = event_frames(spark, root)
    firsts = frames.groupBy("episode_index").agg(F.min_by("task", "frame_index").alias("t")).select("episode_index", F.array("t").alias("tasks"))
    episodes = episodes.join(firsts, "episode_index")
    customer = spark.read.parquet(f"{root}/customer.parquet").filter("c_mktsegment = 'BUILDING'")
    overrides = episodes.join(customer, F.col("user_id") == F.col("c_custkey")).select("episode_index", F.concat(F.lit("build for "), "c_mktsegment").alias("new_task"))
    out = I.modify_tasks(EpisodicDataset(frames.drop("task"), episodes), overrides=overrides)
    return out.frames.join(out.tasks, "task_index").select("index", "task_index", "task")


@query("i06_concat_common", """SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status, 0::BIGINT AS dataset_index FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, l_linestatus, 1 FROM lineitem""")
def concat_common(spark, root):
    orders = spark.read.parquet(f"{root}/orders.parquet").withColumnsRenamed({"o_orderkey": "k", "o_totalprice": "price", "o_orderstatus": "status"})
    lines = spark.read.parquet(f"{root}/lineitem.parquet").withColumnsRenamed({"l_orderkey": "k", "l_extendedprice": "price", "l_linestatus": "status"})
    return I.concat_common([orders, lines])


@query("i06_concat_stats", """SELECT 'price' AS feature, count(*) AS count, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
  FROM (SELECT o_totalprice AS x FROM orders UNION ALL SELECT l_extendedprice FROM lineitem)""")
def concat_stats(spark, root):
    """Statistics of two tables, each with features of its own, merged for the one they share."""
    orders = spark.read.parquet(f"{root}/orders.parquet").select(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    lines = spark.read.parquet(f"{root}/lineitem.parquet").select(F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    common = [c for c in orders.columns if c in lines.columns]
    stats = I.concat_stats([S.frame_stats(t, [], t.columns) for t in (orders, lines)], common)
    return stats.select("feature", "count", "min", "max", tidy("mean", 6).alias("mean"), tidy("std", 6).alias("std"))


@query("i07_union_tasks", """WITH a AS (SELECT p_name AS task, 0 AS src, min(p_partkey) AS f FROM part WHERE p_size > 25 GROUP BY 1 UNION ALL SELECT p_name, 1, min(p_partkey) FROM part GROUP BY 1 UNION ALL SELECT s_name, 2, min(s_suppkey) FROM supplier GROUP BY 1)
  SELECT task, row_number() OVER (ORDER BY min((src, f))) - 1 AS task_index FROM a GROUP BY 1""")
def union_tasks(spark, root):
    parts = spark.read.parquet(f"{root}/part.parquet")
    suppliers = spark.read.parquet(f"{root}/supplier.parquet")
    return I.union_tasks([
        register_tasks(parts.filter("p_size > 25"), text="p_name", order="p_partkey"), register_tasks(parts, text="p_name", order="p_partkey"),
        register_tasks(suppliers, text="s_name", order="s_suppkey")])


# The greedy fold, one episode at a time.
_FOLD = f"""{EVENTS}, ep AS (SELECT episode_index, count(*) AS length FROM fe GROUP BY 1)"""


@query("i08_batch_episodes", f"""WITH RECURSIVE {_FOLD}, b AS (SELECT episode_index, length, 0::BIGINT AS batch, length * 0.25::DOUBLE AS mb, 1 AS held, length AS frames FROM ep WHERE episode_index = 0
  UNION ALL SELECT e.episode_index, e.length, CASE WHEN f THEN batch + 1 ELSE batch END, CASE WHEN f THEN 0 ELSE mb END + e.length * 0.25::DOUBLE, CASE WHEN f THEN 0 ELSE held END + 1, CASE WHEN f THEN 0 ELSE frames END + e.length
  FROM (SELECT b.*, e.episode_index AS ne, e.length AS nl, mb + e.length * 0.25::DOUBLE >= 90 OR held >= 5 OR frames + e.length > 340 AS f FROM b JOIN ep e ON e.episode_index = b.episode_index + 1) x JOIN ep e ON e.episode_index = x.ne)
  SELECT episode_index, batch FROM b""")
def batch_episodes(spark, root):
    _, episodes = event_frames(spark, root)
    return I.batch_episodes(episodes, 0.25, 90.0, max_episodes=5, max_frames=340).select("episode_index", "batch")


_FILES = f"""{_FOLD}, b AS (SELECT episode_index, length, 0::BIGINT AS bin, length * 48.0::DOUBLE AS bytes FROM ep WHERE episode_index = 0
  UNION ALL SELECT e.episode_index, e.length, CASE WHEN bytes + e.length * 48.0::DOUBLE >= 12000 THEN bin + 1 ELSE bin END, CASE WHEN bytes + e.length * 48.0::DOUBLE >= 12000 THEN 0 ELSE bytes END + e.length * 48.0::DOUBLE FROM b JOIN ep e ON e.episode_index = b.episode_index + 1),
  af AS (SELECT episode_index, bin // 10 AS chunk_index, bin % 10 AS file_index FROM b)"""


def _files(spark, root):
    frames, episodes = event_frames(spark, root)
    return frames, I.assign_files(episodes.withColumn("bytes", F.col("length") * 48.0), "bytes", 12000.0, chunk_size=10)


@query("a06_assign_files", f"WITH RECURSIVE {_FILES} SELECT episode_index, chunk_index, file_index FROM af")
def assign_files(spark, root):
    _, placed = _files(spark, root)
    return placed.select("episode_index", "chunk_index", "file_index")


@query("a08_files_for_episodes", f"""WITH RECURSIVE {_FILES} SELECT DISTINCT format('data/chunk-{{:03d}}/file-{{:03d}}.parquet', chunk_index, file_index) AS path FROM af
  WHERE episode_index IN (SELECT episode_index FROM fe WHERE value > 150)""")
def files_for_episodes(spark, root):
    from kinetable.sources.layout import files_for_episodes as files

    frames, placed = _files(spark, root)
    return files(placed, frames.filter("value > 150"))


@query("b20_check_files", f"""WITH RECURSIVE {_FILES}, w AS (SELECT DISTINCT chunk_index, file_index FROM af WHERE episode_index IN (SELECT episode_index FROM fe WHERE value > 300))
  SELECT DISTINCT format('data/chunk_index={{}}/file_index={{}}', chunk_index, file_index) AS path FROM af WHERE (chunk_index, file_index) NOT IN (SELECT (chunk_index, file_index) FROM w)""")
def check_files(spark, root):
    """Only episodes with a value above 300 are written; the files that hold none of them are missing."""
    from kinetable.operators.validate import check_files as check
    from kinetable.session import scratch_path
    from kinetable.sources.layout import write_frames

    frames, placed = _files(spark, root)
    slim = frames.select("episode_index", "frame_index", "index", "value")
    written = slim.join(frames.filter("value > 300").select("episode_index").distinct(), "episode_index", "left_semi")
    path = scratch_path(spark, "files")
    write_frames(written, placed, f"{path}/data")
    expected = placed.select(F.format_string("data/chunk_index=%d/file_index=%d", "chunk_index", "file_index").alias("path"))
    return check(expected, path, r"(data/chunk_index=\d+/file_index=\d+)/")


@query("a10_append_episodes", f"""WITH {_TWO} SELECT l_orderkey, ep AS episode_index, count(*) AS length, min(ix) AS dataset_from_index, max(ix) + 1 AS dataset_to_index, src::BIGINT AS file_index FROM mm GROUP BY ALL""")
def append_episodes(spark, root):
    from kinetable.sources.layout import append_episodes as append

    old, new = _statuses(spark, root)
    start = old.episodes.withColumn("file_index", F.lit(0).cast("bigint"))
    out = append(start, new.episodes.select("episode_index", "length", "l_orderkey"))
    return out.select("l_orderkey", "episode_index", "length", "dataset_from_index", "dataset_to_index", "file_index")
