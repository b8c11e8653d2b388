"""Queries over streams (J01-J10), each drained from files that arrive in three parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, query
from kinetable.functions.numbers import tidy
from kinetable.plans.frames import event_frames
from kinetable.session import scratch_path
from kinetable.streaming import batches as M
from kinetable.streaming import operators as J

PARTS = 3
DAY = 86_400_000_000  # in microseconds
ORDER = ["micros", "event_id"]


def _events(spark, root):
    events = spark.read.parquet(f"{root}/events.parquet")
    return events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_type", "value")


def _arrivals(rows, at="micros"):
    """The rows cut into parts by time, in order of arrival."""
    ends = rows.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    cut = rows.crossJoin(ends).withColumn("_part", F.least(F.floor((F.col(at) - F.col("_lo")) * PARTS / (F.col("_hi") - F.col("_lo"))), F.lit(PARTS - 1)))
    return [cut.filter(F.col("_part") == i).drop("_lo", "_hi", "_part") for i in range(PARTS)]


def _feed(spark, rows, run, at="micros"):
    """Write each part and run the stream on it; the stream resumes from its checkpoint each time."""
    path = scratch_path(spark, "arrivals")
    for part in _arrivals(rows, at):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        run(stream)


def _drain(spark, rows, work, mode="append", at="micros"):
    """Run the stream that ``work`` makes of the arrivals; its batches collect below the path returned."""
    path = scratch_path(spark, "stream")
    with J.rocksdb_state(spark):
        _feed(spark, rows, lambda stream: M.drain(work(stream), path, mode=mode), at)
    return path


_CUT = f"""{EVENTS}, d AS (SELECT *, (task = 'purchase')::INT AS cut FROM fe), n AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS no FROM d)"""


@query("j01_stream_assemble_episodes", f"WITH {_CUT} SELECT event_id, no AS episode_no, row_number() OVER (PARTITION BY episode_index, no ORDER BY frame_index) - 1 AS frame_index FROM n")
def stream_assemble_episodes(spark, root):
    path = _drain(spark, _events(spark, root), lambda stream: J.assemble_episodes(stream, "user_id", ORDER, F.col("event_type") == "purchase"))
    return M.output(spark, path).select("event_id", "episode_no", "frame_index")


@query("j02_stream_gate", f"""WITH RECURSIVE {EVENTS}, r AS (SELECT episode_index, frame_index, event_id, value AS last, true AS passed FROM fe WHERE frame_index = 0
  UNION ALL SELECT f.episode_index, f.frame_index, f.event_id, CASE WHEN f.task = 'error' OR abs(f.value - r.last) >= 25 THEN f.value ELSE r.last END, f.task = 'error' OR abs(f.value - r.last) >= 25
  FROM r JOIN fe f ON f.episode_index = r.episode_index AND f.frame_index = r.frame_index + 1) SELECT event_id FROM r WHERE passed""")
def stream_gate(spark, root):
    path = scratch_path(spark, "gate")
    rows = _events(spark, root).withColumns({"state": F.array("value"), "step": F.col("event_id"), "must_go": F.col("event_type") == "error"})

    def run(stream):
        passed = J.stream_gate(stream, "user_id", "state", "step", ORDER, "must_go", 25.0, time="micros", remember=DAY)
        passed.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()

    with J.rocksdb_state(spark):
        _feed(spark, rows, run)
    return spark.read.parquet(f"{path}/out").select("event_id")


@query("j03_stream_latest", f"WITH {EVENTS} SELECT user_id, arg_max(event_id, frame_index) AS event_id, arg_max(value, frame_index) AS value FROM fe GROUP BY 1")
def stream_latest(spark, root):
    rows = _events(spark, root).withColumn("at", F.struct(*ORDER))
    path = _drain(spark, rows, lambda stream: J.latest(stream, "user_id", "at", ["event_id", "value"]), "update")
    return M.newest(spark, path, ["user_id"]).select("user_id", "latest.event_id", "latest.value")


@query("j04_retain_last_n", f"WITH {EVENTS} SELECT event_id, value FROM fe WHERE frame_index >= length - 20")
def retain_last_n(spark, root):
    return J.retain_last_n(_events(spark, root), ["user_id"], ORDER, 20).select("event_id", "value")


@query("j04_stream_retain", "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 500")
def stream_retain(spark, root):
    """A ring buffer of 500 rows over all sources."""
    rows = _events(spark, root)
    path = _drain(spark, rows, lambda stream: J.retain_stream(stream, [], ORDER, 500))
    return J.retained(spark, f"{path}/progress", rows.schema, [], ORDER, 500).select("event_id", "value")


# A click's value is an executed step; a row's step is its place plus its value.
_LATE = f"""{EVENTS}, x AS (SELECT *, CASE WHEN task = 'click' THEN floor(value)::BIGINT ELSE -1 END AS executed, frame_index + floor(value * 2)::BIGINT AS step FROM fe),
  y AS (SELECT *, max(executed) OVER (PARTITION BY episode_index ORDER BY frame_index) AS latest FROM x)"""


def _late_rows(spark, root):
    frames, _ = event_frames(spark, root)
    return frames.select("user_id", "event_id", "micros", "frame_index", F.when(F.col("task") == "click", F.floor("value")).otherwise(-1).cast("bigint").alias("executed"),
                         (F.col("frame_index") + F.floor(F.col("value") * 2)).cast("bigint").alias("step"))


@query("j05_drop_late_actions", f"WITH {_LATE} SELECT event_id, step FROM y WHERE step > latest")
def drop_late_actions(spark, root):
    return J.drop_late_actions(_late_rows(spark, root), "user_id", "frame_index", "step", "executed").select("event_id", "step")


@query("j05_stream_drop_late", f"WITH {_LATE} SELECT event_id, step FROM y WHERE step > latest")
def stream_drop_late(spark, root):
    path = _drain(spark, _late_rows(spark, root), lambda stream: J.drop_late_stream(stream, "user_id", ORDER, "step", "executed"))
    return M.output(spark, path).select("event_id", "step")


@query("j06_stream_velocity", f"""WITH {EVENTS} SELECT event_id, round((value - coalesce(lag(value) OVER (PARTITION BY episode_index ORDER BY frame_index), value)) / 0.1::DOUBLE, 6) + 0.0 AS velocity, frame_index + 1 >= 40 AS truncated FROM fe""")
def stream_velocity(spark, root):
    path = _drain(spark, _events(spark, root), lambda stream: J.velocity_and_limit(stream, "user_id", ORDER, "value", 0.1, 40))
    return M.output(spark, path).select("event_id", tidy("velocity").alias("velocity"), "truncated")


@query("j07_route_interventions", """SELECT event_id, 'online' AS "table" FROM events WHERE value >= 20 UNION ALL SELECT event_id, 'offline' FROM events WHERE value >= 20 AND event_type = 'error'""")
def route_interventions(spark, root):
    rows = _events(spark, root).withColumn("state", F.array(F.when(F.col("value") < 20, F.lit(float("nan"))).otherwise(F.col("value"))))
    path = _drain(spark, rows, lambda stream: J.route_interventions(stream, ["state"], F.col("event_type") == "error"))
    return M.output(spark, path).select("event_id", "table")


@query("j08_stream_stats", "SELECT 'value' AS feature, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS std FROM events")
def stream_stats(spark, root):
    path = _drain(spark, _events(spark, root), lambda stream: J.stream_stats(stream, ["value"]), "update")
    return M.newest(spark, path, ["feature", "dim"]).select("feature", "count", "min", "max", tidy("mean", 7).alias("mean"), tidy("std", 7).alias("std"))


@query("j09_stream_latency", """WITH k AS (SELECT user_id, event_id, value - 20 AS lat, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value >= 20),
  r AS (SELECT *, list(lat) OVER w AS recent, max(lat) OVER (PARTITION BY user_id ORDER BY n) AS top FROM k WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT event_id, round(list_aggregate(recent, 'quantile_cont', 0.95), 4) AS p95, round(top, 4) AS p100, len(recent) AS window_rows FROM r""")
def stream_latency(spark, root):
    rows = _events(spark, root).withColumn("latency", F.col("value") - 20)
    path = _drain(spark, rows, lambda stream: J.stream_latency(stream, "user_id", ORDER, "latency", 10, {"p95": 0.95, "p100": 1}))
    return M.output(spark, path).select("event_id", tidy("p95", 4).alias("p95"), tidy("p100", 4).alias("p100"), "window_rows")


@query("j09_stream_fps", f"""WITH {EVENTS} SELECT event_id, round(CASE WHEN "timestamp" > 1e-6 THEN frame_index / "timestamp" ELSE 0 END, 9) AS fps FROM fe""")
def stream_fps(spark, root):
    path = _drain(spark, _events(spark, root), lambda stream: J.stream_fps(stream, "user_id", ORDER, "micros", 1e6))
    return M.output(spark, path).select("event_id", tidy("achieved_fps", 9).alias("fps"))


_AT = "PARTITION BY episode_index ORDER BY frame_index"


@query("j10_read_frames_stream", f"""WITH {EVENTS} SELECT event_id, CASE WHEN frame_index >= 2 THEN lag(value, 2) OVER ({_AT}) ELSE value END AS v_m2,
  CASE WHEN frame_index + 3 < length THEN lead(value, 3) OVER ({_AT}) WHEN frame_index + 1 < length THEN lead(value, 1) OVER ({_AT}) ELSE value END AS v_p3, frame_index < 2 AS pad_m2, frame_index + 3 >= length AS pad_p3 FROM fe""")
def read_frames_stream(spark, root):
    frames, _ = event_frames(spark, root)
    rows = frames.select("episode_index", "frame_index", "event_id", "micros", "value", (F.col("frame_index") == F.col("length") - 1).alias("is_last"))
    path = _drain(spark, rows, lambda stream: J.read_frames_stream(stream, {"value": [-2, 0, 1, 3]}))
    out = M.output(spark, path)
    at = lambda c, i: F.get(c, F.lit(i))
    return out.select("event_id", at("value_window", 0).alias("v_m2"), at("value_window", 3).alias("v_p3"), at("value_is_pad", 0).alias("pad_m2"), at("value_is_pad", 3).alias("pad_p3"))
