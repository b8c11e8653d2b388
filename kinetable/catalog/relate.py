"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, LINES, TURNS, query
from kinetable.functions.calibration import calibrate, uncalibrate
from kinetable.functions.numbers import tidy
from kinetable.operators import relate as R
from kinetable.plans.frames import event_frames, line_frames, turn_frames
from kinetable.plans.segments import join_small

TASKS = """tk AS (SELECT task, row_number() OVER (ORDER BY min("index")) - 1 AS task_index FROM fe GROUP BY task)"""


@query("d01_with_task", f"""WITH {EVENTS}, {TASKS} SELECT "index", task_index, task FROM fe JOIN tk USING (task)""")
def with_task(spark, root):
    frames, _ = event_frames(spark, root)
    tasks = R.register_tasks(frames)
    plain = R.with_task_index(frames, tasks).select("index", "task_index")
    return R.with_task(plain, tasks)


@query("d02_with_subtask", f"""WITH {TURNS}, s AS (SELECT role, row_number() OVER (ORDER BY min("index")) - 1 AS subtask_index FROM fc WHERE role <> 'system' GROUP BY role)
  SELECT "index", coalesce(subtask_index, -1) AS subtask_index, s.role AS subtask FROM fc LEFT JOIN s ON s.role = fc.role""")
def with_subtask(spark, root):
    frames, _ = turn_frames(spark, root)
    known = R.register_tasks(frames.filter("role <> 'system'"), text="role")
    known = known.withColumnsRenamed({"task": "subtask", "task_index": "subtask_index"})
    ids = frames.join(known.withColumnRenamed("subtask", "role"), "role", "left")
    ids = ids.select("index", F.coalesce("subtask_index", F.lit(-1).cast("bigint")).alias("subtask_index"))
    return R.with_subtask(ids, known)


@query("d03_register_tasks", """WITH a AS (SELECT p_name AS task, min(p_partkey) AS f FROM part WHERE p_size <= 10 GROUP BY 1),
  e AS (SELECT task, row_number() OVER (ORDER BY f) - 1 AS task_index FROM a),
  n AS (SELECT p_name AS task, min(p_partkey) AS f FROM part WHERE p_name NOT IN (SELECT task FROM e) GROUP BY 1)
  SELECT * FROM e UNION ALL SELECT task, (SELECT count(*) FROM e) + row_number() OVER (ORDER BY f) - 1 FROM n""")
def register_tasks(spark, root):
    parts = spark.read.parquet(f"{root}/part.parquet")
    existing = R.register_tasks(parts.filter("p_size <= 10"), text="p_name", order="p_partkey")
    return R.register_tasks(parts, existing, text="p_name", order="p_partkey")


@query("d03_duplicate_tasks", """SELECT p_name AS task, count(*) AS times FROM part GROUP BY 1 HAVING count(*) > 1""")
def duplicate_tasks(spark, root):
    return R.duplicate_tasks(spark.read.parquet(f"{root}/part.parquet").select(F.col("p_name").alias("task")))


@query("d04_remap_tasks", f"""WITH {LINES}, m AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS task_index FROM (SELECT DISTINCT task FROM fl))
  SELECT "index", task_index FROM fl JOIN m USING (task)""")
def remap_tasks(spark, root):
    """Ids by first appearance become ids in text order."""
    frames, _ = line_frames(spark, root)
    old = R.register_tasks(frames)
    new = R.register_tasks(frames, order="task")
    return R.remap_tasks(R.with_task_index(frames, old).select("index", "task_index"), old, new).select("index", "task_index")


@query("d05_locate_episode", f"""WITH {LINES}, e AS (SELECT episode_index, min("index") AS lo, max("index") + 1 AS hi FROM fl GROUP BY 1)
  SELECT o_orderkey, (o_orderkey * 3 + o_custkey) AS at, coalesce(episode_index, -1) AS episode_index, coalesce((o_orderkey * 3 + o_custkey) - lo, -1) AS frame_index
  FROM orders LEFT JOIN e ON (o_orderkey * 3 + o_custkey) >= lo AND (o_orderkey * 3 + o_custkey) < hi""")
def locate_episode(spark, root):
    _, episodes = line_frames(spark, root)
    points = spark.read.parquet(f"{root}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 3 + F.col("o_custkey")).alias("at"))
    out = R.locate_episode(points, episodes, "at")
    return out.fillna(-1, ["episode_index", "frame_index"])


@query("d07_join_nearest", """WITH l AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'),
  r AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'purchase'),
  b AS (SELECT l.*, r.t AS bt, r.event_id AS be FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t),
  c AS (SELECT b.*, r.t AS nt, r.event_id AS ae FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t <= r.t),
  n AS (SELECT *, CASE WHEN bt IS NULL THEN ae WHEN nt IS NULL THEN be WHEN t - bt <= nt - t THEN be ELSE ae END AS near,
   CASE WHEN bt IS NULL THEN nt - t WHEN nt IS NULL THEN t - bt ELSE least(t - bt, nt - t) END AS gap FROM c)
  SELECT event_id, coalesce(near, -1) AS nearest_event, round(gap, 4) AS gap, coalesce(gap > 36000, true) AS is_pad,
  coalesce(gap > 36000, true) AND bt IS NOT NULL AND nt IS NOT NULL AS is_error FROM n""")
def join_nearest(spark, root):
    events = spark.read.parquet(f"{root}/events.parquet")
    events = events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    clicks = events.filter("event_type = 'click'").select("user_id", "event_id", "t")
    bought = events.filter("event_type = 'purchase'").select("user_id", "event_id", "t")
    out = R.join_nearest(clicks, bought, "user_id", "t", "t", ["event_id"], 36000.0)
    return out.select("event_id", F.coalesce("nearest_event_id", F.lit(-1)).alias("nearest_event"), tidy("gap", 4).alias("gap"), "is_pad", "is_error")


@query("d08_join_frame_number", f"""WITH {LINES}, q AS (SELECT episode_index, l_partkey, round_even(l_discount * 10, 0)::BIGINT AS frame_index, l_discount AS t FROM fl)
  SELECT q.l_partkey, q.t, f."index", f.l_quantity FROM q JOIN fl f USING (episode_index, frame_index)""")
def join_frame_number(spark, root):
    frames, _ = line_frames(spark, root)
    wanted = frames.select("episode_index", "l_partkey", F.col("l_discount").alias("t"))
    return R.join_frame_number(wanted, frames.select("episode_index", "frame_index", "index", "l_quantity"), "t", 10).select("l_partkey", "t", "index", "l_quantity")


@query("d09_remap_files", """WITH e AS (SELECT o_orderkey AS episode_index, o_custkey // 100 AS chunk_index, o_custkey % 100 AS file_index,
   (o_orderkey % 7)::DOUBLE AS from_timestamp, (o_orderkey % 7 + 5)::DOUBLE AS to_timestamp FROM orders),
  m AS (SELECT c_custkey // 100 AS chunk_index, c_custkey % 100 AS file_index, c_nationkey AS new_chunk, c_custkey AS new_file, c_acctbal AS time_offset FROM customer WHERE c_acctbal > 0)
  SELECT episode_index, coalesce(new_chunk, 0)::BIGINT AS chunk_index, coalesce(new_file, 0) AS file_index,
  round(from_timestamp + coalesce(time_offset, 0), 6) AS from_timestamp, round(to_timestamp + coalesce(time_offset, 0), 6) AS to_timestamp FROM e LEFT JOIN m USING (chunk_index, file_index)""")
def remap_files(spark, root):
    orders = spark.read.parquet(f"{root}/orders.parquet")
    episodes = orders.select(
        F.col("o_orderkey").alias("episode_index"), F.floor(F.col("o_custkey") / 100).alias("chunk_index"), (F.col("o_custkey") % 100).alias("file_index"),
        (F.col("o_orderkey") % 7).cast("double").alias("from_timestamp"), (F.col("o_orderkey") % 7 + 5).cast("double").alias("to_timestamp"))
    mapping = spark.read.parquet(f"{root}/customer.parquet").filter("c_acctbal > 0").select(
        F.floor(F.col("c_custkey") / 100).alias("chunk_index"), (F.col("c_custkey") % 100).alias("file_index"),
        F.col("c_nationkey").cast("bigint").alias("new_chunk"), F.col("c_custkey").alias("new_file"), F.col("c_acctbal").alias("time_offset"))
    out = R.remap_files(episodes, mapping, F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return out.select("episode_index", "chunk_index", "file_index", tidy("from_timestamp").alias("from_timestamp"), tidy("to_timestamp").alias("to_timestamp"))


@query("d10_exclude_episodes", f"""WITH {LINES} SELECT "index", episode_index FROM fl WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def exclude_episodes(spark, root):
    frames, episodes = line_frames(spark, root)
    closed = spark.read.parquet(f"{root}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    unwanted = episodes.join(closed, "l_orderkey", "left_semi")
    return R.exclude_episodes(frames, unwanted).select("index", "episode_index")


# Calibration per supplier: range from its prices, mode and flip from its nation.
_CAL_SQL = """c AS (SELECT l_suppkey, min(l_extendedprice) + 500 AS lo, max(l_extendedprice) - 500 AS hi FROM lineitem GROUP BY 1),
  s AS (SELECT c.*, CASE s_nationkey % 3 WHEN 0 THEN 'RANGE_M100_100' WHEN 1 THEN 'RANGE_0_100' ELSE 'DEGREES' END AS mode, s_nationkey % 2 = 1 AS flip FROM c JOIN supplier ON s_suppkey = l_suppkey)"""


@query("d11_apply_calibration", f"""WITH {_CAL_SQL}, j AS (SELECT l.*, s.*, (least(hi, greatest(lo, l_extendedprice)) - lo) / (hi - lo) AS share FROM lineitem l JOIN s USING (l_suppkey))
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE mode WHEN 'RANGE_M100_100' THEN CASE WHEN flip THEN -(share * 200 - 100) ELSE share * 200 - 100 END
   WHEN 'RANGE_0_100' THEN CASE WHEN flip THEN 100 - share * 100 ELSE share * 100 END ELSE (l_extendedprice - (lo + hi) / 2) * 360 / 4095 END, 6) + 0.0 AS calibrated FROM j""")
def apply_calibration(spark, root):
    lines, spec = _calibrated_lines(spark, root)
    cal = calibrate(F.col("l_extendedprice"), *spec)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tidy(cal).alias("calibrated"))


@query("d11_undo_calibration", f"""WITH {_CAL_SQL}, j AS (SELECT l.*, s.*, l_quantity * 5.0::DOUBLE - 120.5::DOUBLE AS v FROM lineitem l JOIN s USING (l_suppkey)),
  u AS (SELECT *, least(100, greatest(-100, CASE WHEN flip THEN -v ELSE v END)) AS c1, least(100, greatest(0, CASE WHEN flip THEN 100 - v ELSE v END)) AS c2 FROM j)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(CASE mode WHEN 'RANGE_M100_100' THEN (c1 + 100) / 200 * (hi - lo) + lo
   WHEN 'RANGE_0_100' THEN c2 / 100 * (hi - lo) + lo ELSE v * 4095 / 360 + (lo + hi) / 2 END)::BIGINT AS reading FROM u""")
def undo_calibration(spark, root):
    lines, spec = _calibrated_lines(spark, root)
    reading = uncalibrate(F.col("l_quantity") * 5.0 - 120.5, *spec)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reading.alias("reading"))


def _calibrated_lines(spark, root):
    lines = spark.read.parquet(f"{root}/lineitem.parquet")
    ranges = lines.groupBy("l_suppkey").agg((F.min("l_extendedprice") + 500).alias("lo"), (F.max("l_extendedprice") - 500).alias("hi"))
    nation = spark.read.parquet(f"{root}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    mode = F.when(F.col("s_nationkey") % 3 == 0, "RANGE_M100_100").when(F.col("s_nationkey") % 3 == 1, "RANGE_0_100").otherwise("DEGREES")
    ranges = ranges.join(nation, "l_suppkey").select("l_suppkey", "lo", "hi", mode.alias("mode"), (F.col("s_nationkey") % 2 == 1).alias("flip"), F.lit(4096.0).alias("res"))
    return join_small(lines, ranges, ["l_suppkey"], derived=True), [F.col(c) for c in ("lo", "hi", "mode", "flip", "res")]


@query("d12_join_progress", f"""WITH {EVENTS}, p AS (SELECT "index", CASE WHEN task = 'click' THEN value END AS sparse, CASE WHEN task <> 'error' THEN value / 2 END AS dense FROM fe WHERE task <> 'view')
  SELECT fe."index", round(coalesce(sparse, dense), 6) AS progress FROM fe LEFT JOIN p ON p."index" = fe."index" """)
def join_progress(spark, root):
    frames, _ = event_frames(spark, root)
    notes = frames.filter("task <> 'view'").select(
        "index", F.when(F.col("task") == "click", F.col("value")).alias("progress_sparse"), F.when(F.col("task") != "error", F.col("value") / 2).alias("progress_dense"))
    out = R.join_annotations(frames.select("index"), notes, "index", {"progress": ["progress_sparse", "progress_dense", "progress"]})
    return out.select("index", tidy("progress").alias("progress"))
