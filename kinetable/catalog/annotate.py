"""Queries over subtask intervals and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, query
from kinetable.functions.numbers import tidy
from kinetable.functions.text import format_mmss, parse_mmss
from kinetable.operators import progress as P
from kinetable.operators import windows as W
from kinetable.plans.frames import event_frames

NAMES = ["click", "view", "purchase"]
# Runs of one event type are the subtask intervals; error and signup frames stay uncovered.
RUNS = f"""rn AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY episode_index ORDER BY frame_index) AS position FROM
   (SELECT *, task IS DISTINCT FROM lag(task) OVER (PARTITION BY episode_index ORDER BY frame_index) OR frame_index = 0 AS fresh FROM fe)),
  iv AS (SELECT episode_index, position, first(task) AS name, min(frame_index) AS s, max(frame_index) AS e FROM rn
   WHERE task IN ('click', 'view', 'purchase') GROUP BY 1, 2)"""
STAGES = f"""{RUNS}, nx AS (SELECT *, lead(s) OVER (PARTITION BY episode_index ORDER BY position) AS nxt FROM iv),
  bd AS (SELECT episode_index, min(s) AS first_s, max(e) AS last_e FROM iv GROUP BY 1),
  sg AS (SELECT fe.*, CASE WHEN first_s IS NULL OR frame_index < first_s THEN 0 WHEN frame_index > last_e THEN 2 ELSE list_position(['click', 'view', 'purchase'], nx.name) - 1 END::BIGINT AS stage,
   CASE WHEN first_s IS NULL OR frame_index < first_s THEN 0 WHEN frame_index > last_e THEN 0.999 WHEN frame_index > nx.e OR nx.e = nx.s THEN 1 ELSE (frame_index - nx.s) / (nx.e - nx.s) END::DOUBLE AS tau
   FROM fe LEFT JOIN bd USING (episode_index) LEFT JOIN nx ON nx.episode_index = fe.episode_index AND frame_index >= nx.s AND frame_index < coalesce(nx.nxt, length)),
  cm AS (SELECT *, CASE WHEN stage >= 2 AND tau >= 1 THEN 2.999 ELSE stage + tau END::DOUBLE AS target FROM sg)"""


def _intervals(frames):
    return P.label_runs(frames, "task", F.col("task").isin(*NAMES))


def _labelled(spark, root):
    frames, _ = event_frames(spark, root)
    rows = P.stage_and_tau(frames, _intervals(frames), NAMES)
    return rows.withColumn("target", P.combined_progress(F.col("stage"), F.col("tau"), len(NAMES)))


@query("d06_stage_and_tau", f"""WITH {EVENTS}, {STAGES} SELECT "index", stage, round(tau, 6) AS tau, round(target, 6) AS target FROM cm""")
def stage_and_tau(spark, root):
    return _labelled(spark, root).select("index", "stage", tidy("tau").alias("tau"), tidy("target").alias("target"))


@query("d06_single_stage", f"""WITH {EVENTS} SELECT "index", 0::BIGINT AS stage, round(frame_index / greatest(length - 1, 1), 6) AS tau FROM fe""")
def single_stage(spark, root):
    frames, episodes = event_frames(spark, root)
    rows = P.stage_and_tau(frames, P.auto_annotate(episodes, 10.0), ["task"])
    return rows.select("index", "stage", tidy("tau").alias("tau"))


# Interval times: the timestamps of the first and last frame of a run, as MM:SS.
_PROPORTIONS = f"""{RUNS}, tm AS (SELECT iv.*, floor(a."timestamp")::BIGINT AS t0, floor(b."timestamp")::BIGINT AS t1 FROM iv
   JOIN fe a ON a.episode_index = iv.episode_index AND a.frame_index = s JOIN fe b ON b.episode_index = iv.episode_index AND b.frame_index = e),
  tt AS (SELECT episode_index, sum(t1 - t0) AS total FROM tm GROUP BY 1),
  nm AS (SELECT episode_index, name, arg_max(t1 - t0, position) AS d FROM tm GROUP BY 1, 2),
  ms AS (SELECT name, avg(d / total) AS mean_share FROM nm JOIN tt USING (episode_index) WHERE total > 0 GROUP BY 1),
  pp AS (SELECT name, mean_share, mean_share / (SELECT sum(mean_share) FROM ms) AS proportion FROM ms)"""


def _timed_intervals(spark, root):
    frames, _ = event_frames(spark, root)
    runs = P.label_runs(frames, "task", F.col("task").isin(*NAMES), time="timestamp")
    return runs.withColumns({c: parse_mmss(format_mmss(F.col(c))) for c in ("start", "end")})


@query("f10_temporal_proportions", f"""WITH {EVENTS}, {_PROPORTIONS} SELECT name, round(mean_share, 9) AS mean_share, round(proportion, 9) AS proportion, list_position(['click', 'view', 'purchase'], name)::BIGINT - 1 AS stage FROM pp""")
def temporal_proportions(spark, root):
    out = P.temporal_proportions(_timed_intervals(spark, root), NAMES)
    return out.select("name", tidy("mean_share", 9).alias("mean_share"), tidy("proportion", 9).alias("proportion"), "stage")


_DELTA = """dl AS (SELECT *, CASE WHEN frame_index + 5 < length THEN lead(progress, 5) OVER (PARTITION BY episode_index ORDER BY frame_index)
   ELSE last_value(progress) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END - progress AS delta
  FROM (SELECT *, frame_index / 100.0::DOUBLE + value / 1000 AS progress FROM fe)),
  mo AS (SELECT greatest(avg(delta), 0) AS m, greatest(stddev_pop(delta), 1e-6) AS sd FROM dl),
  wt AS (SELECT dl.*, CASE WHEN delta > 0.05 THEN 1 WHEN delta >= 0 THEN least(greatest((delta - (m - 2 * sd)) / (4 * sd + 1e-6::DOUBLE), 0), 1) ELSE 0 END::DOUBLE AS weight FROM dl, mo)"""


def _weights(spark, root):
    frames, _ = event_frames(spark, root)
    frames = frames.withColumn("progress", F.col("frame_index") / 100 + F.col("value") / 1000)
    return P.progress_weights(W.progress_delta(frames, "progress", 5), "delta", kappa=0.05)


@query("f11_progress_weights", f"""WITH {EVENTS}, {_DELTA} SELECT "index", round(delta, 6) + 0.0 AS delta, round(weight, 6) AS weight FROM wt""")
def progress_weights(spark, root):
    return _weights(spark, root).select("index", tidy("delta").alias("delta"), tidy("weight").alias("weight"))


@query("f12_batch_normalise_weights", f"""WITH {EVENTS}, {_DELTA} SELECT "index", round(weight * count(*) OVER (PARTITION BY "index" // 64) / (sum(weight) OVER (PARTITION BY "index" // 64) + 1e-6::DOUBLE), 6) AS normalised FROM wt""")
def batch_normalise_weights(spark, root):
    rows = _weights(spark, root).withColumn("batch", F.floor(F.col("index") / 64))
    scaled, _ = P.batch_normalise_weights(rows, "batch", "weight")
    return scaled.select("index", tidy("normalised").alias("normalised"))


@query("f12_batch_weight_summary", f"""WITH {EVENTS}, {_DELTA} SELECT "index" // 64 AS batch, count(*) AS rows, round(avg(weight), 6) AS raw_mean_weight, sum((weight = 0)::INT)::BIGINT AS num_zero_weight, sum((weight = 1)::INT)::BIGINT AS num_full_weight FROM wt GROUP BY 1""")
def batch_weight_summary(spark, root):
    rows = _weights(spark, root).withColumn("batch", F.floor(F.col("index") / 64))
    _, summary = P.batch_normalise_weights(rows, "batch", "weight")
    return summary.withColumn("raw_mean_weight", tidy("raw_mean_weight"))


@query("g06_stage_progress", f"""WITH {EVENTS}, {STAGES}, {_PROPORTIONS.split(RUNS + ', ')[1]},
  bp AS (SELECT coalesce(max(proportion) FILTER (name = 'click'), 0) AS p0, coalesce(max(proportion) FILTER (name = 'view'), 0) AS p1 FROM pp)
  SELECT "index", round(CASE floor(target) WHEN 0 THEN target * p0 WHEN 1 THEN p0 + (target - 1) * p1 ELSE p0 + p1 + (target - 2) * (1 - p0 - p1) END, 6) AS progress FROM cm, bp""")
def stage_progress(spark, root):
    rows = _labelled(spark, root)
    shares = P.temporal_proportions(_timed_intervals(spark, root), NAMES)
    share = [F.coalesce(F.max(F.when(F.col("name") == n, F.col("proportion"))), F.lit(0.0)) for n in NAMES]
    points = F.array(F.lit(0.0), share[0], share[0] + share[1], F.lit(1.0))
    rows = rows.crossJoin(shares.agg(points.alias("points")))  # one row
    return rows.select("index", tidy(P.stage_progress(F.col("target"), F.col("points"))).alias("progress"))


@query("g07_progress_targets", f"""WITH {EVENTS}, {STAGES}, o AS (SELECT unnest(generate_series(-2, 2)) AS o),
  a AS (SELECT c."index", o + 2 AS slot, c.episode_index, least(greatest(frame_index + o * 3, 0), length - 1) AS f FROM cm c CROSS JOIN o
   UNION ALL SELECT "index", 4 + i, episode_index, frame_index - 6 - i * 3 FROM cm, LATERAL (SELECT unnest(generate_series(1, CASE WHEN frame_index <= 6 THEN 0 ELSE least(2, (frame_index - 6) // 3) END)) AS i))
  SELECT a."index", slot, round(b.target, 6) AS target FROM a JOIN cm b ON b.episode_index = a.episode_index AND b.frame_index = a.f""")
def progress_targets(spark, root):
    labels = _labelled(spark, root)
    windows = W.bidirectional_indices(labels, 4, 3)
    windows = W.rewind_indices(windows, 4, 3, 2, 2)
    windows = windows.withColumn("asked", F.concat("window_index", "rewind_index"))
    out = P.progress_targets(labels, windows, "asked")
    return out.select("index", F.col("slot").cast("bigint").alias("slot"), tidy("target").alias("target"))


@query("i09_upsert_annotations", f"""WITH {EVENTS}, {RUNS}, hot AS (SELECT episode_index FROM fe GROUP BY 1 HAVING max(value) > 300),
  u AS (SELECT episode_index, position::BIGINT AS position, name, s AS start_frame, e AS end_frame FROM iv WHERE episode_index NOT IN (SELECT episode_index FROM hot)
   UNION ALL SELECT episode_index, 0, 'task', 0, max(length) - 1 FROM fe WHERE episode_index IN (SELECT episode_index FROM hot) GROUP BY 1)
  SELECT * FROM u""")
def upsert_annotations(spark, root):
    """Episodes with a value above 300 get one whole-episode annotation in place of their runs."""
    frames, episodes = event_frames(spark, root)
    old = _intervals(frames).withColumns({"start": F.col("start_frame") / 10, "end": F.col("end_frame") / 10})
    hot = frames.groupBy("episode_index").agg(F.max("value").alias("top")).filter("top > 300")
    fresh = P.auto_annotate(episodes.join(hot, "episode_index", "left_semi"), 10.0)
    return P.upsert_annotations(old, fresh).drop("start", "end")


@query("i09_annotation_lists", f"""WITH {EVENTS}, {RUNS} SELECT episode_index, row_number() OVER (PARTITION BY episode_index ORDER BY position) - 1 AS position, name, s AS start_frame, e AS end_frame, round(s / 10.0::DOUBLE, 6) AS "start" FROM iv""")
def annotation_lists(spark, root):
    """Intervals to the stored parallel lists and back."""
    frames, _ = event_frames(spark, root)
    rows = _intervals(frames).withColumns({"start": F.col("start_frame") / 10, "end": F.col("end_frame") / 10})
    back = P.annotation_rows(P.annotation_lists(rows, "sparse"), "sparse")
    return back.select("episode_index", "position", "name", "start_frame", "end_frame", tidy("start").alias("start"))


@query("i10_auto_annotate", f"""WITH {EVENTS} SELECT episode_index, 'task' AS name, 0::BIGINT AS start_frame, max(length) - 1 AS end_frame, round((max(length) - 1) / 30.0::DOUBLE, 6) AS "end" FROM fe GROUP BY 1""")
def auto_annotate(spark, root):
    _, episodes = event_frames(spark, root)
    out = P.auto_annotate(episodes, 30.0)
    return out.select("episode_index", "name", "start_frame", "end_frame", tidy("end").alias("end"))


_AT = "PARTITION BY episode_index ORDER BY frame_index"


@query("i11_progress_table", f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN frame_index % 7 = 0 OR frame_index = length - 1 THEN value END AS v, CASE WHEN frame_index % 7 = 0 OR frame_index = length - 1 THEN frame_index END AS p FROM fe),
  w AS (SELECT *, last_value(v IGNORE NULLS) OVER ({_AT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0, last_value(p IGNORE NULLS) OVER ({_AT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0,
   first_value(v IGNORE NULLS) OVER ({_AT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1, first_value(p IGNORE NULLS) OVER ({_AT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM s)
  SELECT "index", episode_index, frame_index, round(CASE WHEN p0 = p1 THEN v0 ELSE v0 + (v1 - v0) / (p1 - p0) * (frame_index - p0) END::FLOAT::DOUBLE, 3) AS progress_sparse FROM w""")
def progress_table(spark, root):
    """Values kept at every 7th frame and the last one, filled in between."""
    frames, _ = event_frames(spark, root)
    kept = (F.col("frame_index") % 7 == 0) | (F.col("frame_index") == F.col("length") - 1)
    out = P.progress_table(frames.withColumn("sampled", F.when(kept, F.col("value"))), {"progress_sparse": "sampled"})
    return out.withColumn("progress_sparse", tidy("progress_sparse", 3))
