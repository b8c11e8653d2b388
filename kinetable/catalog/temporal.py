"""Queries over temporal windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, LINES, query
from kinetable.functions.numbers import clip, hash_int, tidy
from kinetable.operators import windows as W
from kinetable.plans.frames import event_frames, line_frames
from kinetable.plans.segments import number_rows

KEYS = ["episode_index", "frame_index"]
_AT = "PARTITION BY episode_index ORDER BY frame_index"


def _sql_at(column: str, delta: int, view_length: str = "length") -> str:
    """The value ``delta`` frames away, clamped to the episode."""
    edge = f"first_value({column}) OVER ({_AT})" if delta < 0 else (
        f"last_value({column}) OVER ({_AT} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    moved = f"lag({column}, {-delta}) OVER ({_AT})" if delta < 0 else f"lead({column}, {delta}) OVER ({_AT})"
    if delta == 0:
        return column
    inside = f"frame_index >= {-delta}" if delta < 0 else f"frame_index + {delta} < {view_length}"
    return f"CASE WHEN {inside} THEN {moved} ELSE {edge} END"


_SPAN = [-0.2, -0.1, 0.0, 0.1, 0.4]


@query("e01_deltas_to_frames", f"""WITH {LINES} SELECT episode_index, frame_index, delta,
  least(greatest(frame_index + delta, 0), length - 1) AS target
  FROM fl CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 4]) AS delta)""")
def deltas(spark, root):
    frames, _ = line_frames(spark, root)
    offsets = W.deltas_to_frames({"state": _SPAN}, fps=10)["state"]
    bad = W.check_deltas({"state": _SPAN}, fps=10, tolerance=1e-4)
    if bad:
        raise ValueError(f"deltas are no multiples of 1/fps: {bad}")
    spread = frames.withColumn("delta", F.explode(F.array(*[F.lit(d) for d in offsets])))
    target = clip(F.col("frame_index") + F.col("delta"), 0, F.col("length") - 1).cast("bigint")
    return spread.select(*KEYS, "delta", target.alias("target"))


_OFFSETS = [-2, -1, 0, 1, 4]


def _window_columns(key="value", offsets=_OFFSETS):
    out = []
    for i, d in enumerate(offsets):
        name = f"m{-d}" if d < 0 else f"p{d}"
        out += [F.get(f"{key}_window", F.lit(i)).alias(f"v_{name}"), F.get(f"{key}_is_pad", F.lit(i)).alias(f"pad_{name}")]
    return out


def _sql_window(values):
    parts = []
    for d in _OFFSETS:
        name = f"m{-d}" if d < 0 else f"p{d}"
        pad = f"frame_index < {-d}" if d < 0 else f"frame_index + {d} >= length"
        parts.append(f"{values(d)} AS v_{name}, {pad} AS pad_{name}")
    return ", ".join(parts)


@query("e02_delta_window_clamp", f"WITH {EVENTS} SELECT episode_index, frame_index, {_sql_window(lambda d: _sql_at('value', d))} FROM fe")
def delta_window_clamp(spark, root):
    frames, _ = event_frames(spark, root)
    frames = frames.select(*KEYS, "value")
    return W.delta_window(frames, {"value": _OFFSETS}).select(*KEYS, *_window_columns())


@query("e02_delta_window_long", f"""WITH {EVENTS} SELECT a."index", d.delta, b.value,
  (a.frame_index + d.delta < 0 OR a.frame_index + d.delta >= a.length) AS is_pad
  FROM fe a CROSS JOIN (SELECT unnest(generate_series(-32, 32)) AS delta) d
  JOIN fe b ON b.episode_index = a.episode_index
   AND b.frame_index = least(greatest(a.frame_index + d.delta, 0), a.length - 1)""")
def delta_window_long(spark, root):
    frames, _ = event_frames(spark, root)
    out = W.delta_join(frames, "value", list(range(-32, 33)))
    return out.withColumn("delta", F.col("delta").cast("bigint"))


def _last_valid(d):
    if d == 0:
        return "value"
    near = {-2: "-1", 4: "1"}.get(d)
    inside = f"frame_index >= {-d}" if d < 0 else f"frame_index + {d} < length"
    moved = f"lag(value, {-d}) OVER ({_AT})" if d < 0 else f"lead(value, {d}) OVER ({_AT})"
    return f"CASE WHEN {inside} THEN {moved} ELSE {_last_valid(int(near)) if near else 'value'} END"


@query("e03_delta_window_last_valid", f"WITH {EVENTS} SELECT episode_index, frame_index, {_sql_window(_last_valid)} FROM fe")
def delta_window_last_valid(spark, root):
    frames, _ = event_frames(spark, root)
    frames = frames.select(*KEYS, "value")
    return W.delta_window(frames, {"value": _OFFSETS}, pad="last_valid").select(*KEYS, *_window_columns())


@query("e04_action_chunks", f"""WITH {EVENTS}, w AS (SELECT episode_index, frame_index, length,
  list(value) OVER ({_AT} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS chunk FROM fe)
  SELECT episode_index, frame_index, round(list_sum(chunk), 6) AS total, chunk[1] AS first_action, chunk[16] AS last_action
  FROM w WHERE len(chunk) = 16""")
def action_chunks(spark, root):
    frames, _ = event_frames(spark, root)
    chunks = W.action_chunks(frames.select(*KEYS, "value"), "value", 16)
    total = F.aggregate("chunk", F.lit(0.0), lambda a, x: a + x)
    return chunks.select(
        *KEYS, F.round(total, 6).alias("total"), F.element_at("chunk", 1).alias("first_action"), F.element_at("chunk", -1).alias("last_action")
    )


@query("e05_relative_actions", f"""WITH {LINES}, s AS (SELECT episode_index, frame_index, length, [l_quantity, l_extendedprice, l_discount] AS st FROM fl)
  SELECT a.episode_index, a.frame_index, b.frame_index - a.frame_index AS step, round(b.st[1] - a.st[1], 6) + 0.0 AS d0,
  round(b.st[2], 6) + 0.0 AS d1, round(b.st[3] - a.st[3], 6) + 0.0 AS d2
  FROM s a JOIN s b ON a.episode_index = b.episode_index AND b.frame_index BETWEEN a.frame_index AND a.frame_index + 2
  WHERE a.frame_index + 2 < a.length""")
def relative_actions(spark, root):
    frames, _ = line_frames(spark, root)
    frames = frames.select(*KEYS, F.array("l_quantity", "l_extendedprice", "l_discount").alias("state"))
    chunks = W.action_chunks(frames, "state", 3)
    moved = chunks.withColumn("chunk", W.relative_actions(F.col("chunk"), F.col("state"), [0, 2]))
    steps = moved.select(*KEYS, F.posexplode("chunk").alias("step", "a"))
    return steps.select(*KEYS, F.col("step").cast("bigint").alias("step"), *[tidy(F.get("a", F.lit(i))).alias(f"d{i}") for i in range(3)])


_STEPS, _GAP = 8, 5


@query("e06_bidirectional_window", f"""WITH {EVENTS} SELECT episode_index, frame_index, d.o + 4 AS slot,
  "index" - frame_index + least(greatest(frame_index + d.o * 5, 0), length - 1) AS at_index,
  (frame_index + d.o * 5 < 0 OR frame_index + d.o * 5 >= length) AS out_of_bounds
  FROM fe CROSS JOIN (SELECT unnest(generate_series(-4, 4)) AS o) d""")
def bidirectional_window(spark, root):
    frames, _ = event_frames(spark, root)
    out = W.bidirectional_indices(frames, _STEPS, _GAP)
    out = out.select(*KEYS, F.posexplode(F.arrays_zip("window_index", "window_out_of_bounds")).alias("slot", "w"))
    return out.select(
        *KEYS, F.col("slot").cast("bigint").alias("slot"),
        F.col("w.window_index").alias("at_index"), F.col("w.window_out_of_bounds").alias("out_of_bounds"),
    )


@query("e07_rewind_window", f"""WITH {EVENTS}, r AS (SELECT *, CASE WHEN frame_index - 20 <= 0 THEN 0
   ELSE least(4, (frame_index - 20) // 5) END AS allowed,
   1 + ('0x' || md5('7:' || "index")[1:8])::BIGINT % 4 AS wanted FROM fe)
  SELECT "index", least(wanted, allowed) AS rewind_step, i AS slot, "index" - 20 - i * 5 AS at_index
  FROM r, LATERAL (SELECT unnest(generate_series(1, least(wanted, allowed))) AS i)""")
def rewind_window(spark, root):
    frames, _ = event_frames(spark, root)
    wanted = (hash_int(7, "index") % 4 + 1).cast("int")
    out = W.rewind_indices(frames, _STEPS, _GAP, 4, wanted)
    out = out.select("index", F.col("rewind_step").cast("bigint").alias("rewind_step"), F.posexplode("rewind_index").alias("p", "at_index"))
    return out.select("index", "rewind_step", (F.col("p") + 1).cast("bigint").alias("slot"), "at_index")


@query("e08_episode_bounds", f"""WITH {LINES} SELECT episode_index, min("index") AS "from", max("index") + 1 AS "to" FROM fl GROUP BY 1""")
def episode_bounds(spark, root):
    frames, _ = line_frames(spark, root)
    return W.episode_bounds(frames)


@query("e09_index_frames", f"""WITH {EVENTS} SELECT event_id, episode_index, frame_index, "index", round("timestamp", 6) AS "timestamp" FROM fe""")
def index_frames(spark, root):
    frames, _ = event_frames(spark, root)
    return frames.select("event_id", *KEYS, "index", tidy("timestamp").alias("timestamp"))


@query("e10_episode_offsets", """WITH o AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS length FROM orders
   JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM o)
  SELECT o_custkey, o_orderkey, pos, length,
  coalesce(sum(length) OVER (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / 10 AS from_timestamp,
  sum(length) OVER (PARTITION BY o_custkey ORDER BY pos)::DOUBLE / 10 AS to_timestamp FROM n""")
def episode_offsets(spark, root):
    """Episodes (orders) placed one after another in one file per customer, in seconds at 10 fps."""
    from kinetable.plans.frames import episode_offsets as offsets

    orders = spark.read.parquet(f"{root}/orders.parquet").select("o_custkey", "o_orderkey")
    lines = spark.read.parquet(f"{root}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("length"))
    episodes = number_rows(orders.join(lines, "o_orderkey"), ["o_custkey"], ["o_orderkey"], "pos")
    out = offsets(episodes, keys=["o_custkey"], pos="pos")
    return out.select(
        "o_custkey", "o_orderkey", "pos", "length",
        (F.col("dataset_from_index") / 10).alias("from_timestamp"), (F.col("dataset_to_index") / 10).alias("to_timestamp"),
    )


@query("e11_to_transitions", f"""WITH {EVENTS} SELECT "index", value AS reward, (task = 'purchase') AS done,
  CASE WHEN task = 'purchase' OR frame_index = length - 1 THEN value ELSE lead(value) OVER ({_AT}) END AS next_value FROM fe""")
def to_transitions(spark, root):
    frames, _ = event_frames(spark, root)
    frames = frames.withColumn("next_done", F.col("task") == "purchase")
    out = W.to_transitions(frames, ["value"], done="next_done")
    return out.select("index", F.col("value").alias("reward"), "done", F.col("next_value"))


@query("e12_infer_done", f"WITH {LINES} SELECT \"index\", frame_index = length - 1 AS done FROM fl")
def infer_done(spark, root):
    frames, _ = line_frames(spark, root)
    return W.infer_done(frames).select("index", "done")


@query("e13_episodes_from_done", f"""WITH {EVENTS}, d AS (SELECT *, (task = 'purchase' OR value > 400)::INT AS cut FROM fe),
  n AS (SELECT *, coalesce(sum(cut) OVER ({_AT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode_no FROM d)
  SELECT event_id, user_id, episode_no, row_number() OVER (PARTITION BY user_id, episode_no ORDER BY frame_index) - 1 AS step FROM n""")
def episodes_from_done(spark, root):
    frames, _ = event_frames(spark, root)
    out = W.episodes_from_done(frames, "user_id", "frame_index", (F.col("task") == "purchase") | (F.col("value") > 400))
    return out.select("event_id", "user_id", "episode_no", "step")


@query("e14_joint_velocity", f"""WITH {LINES} SELECT "index", l_quantity AS s0, l_discount AS s1,
  round((l_quantity - coalesce(lag(l_quantity) OVER ({_AT}), l_quantity)) / 0.1::DOUBLE, 6) + 0.0 AS s2,
  round((l_discount - coalesce(lag(l_discount) OVER ({_AT}), l_discount)) / 0.1::DOUBLE, 6) + 0.0 AS s3 FROM fl""")
def joint_velocity(spark, root):
    frames, _ = line_frames(spark, root)
    out = W.joint_velocity(frames.withColumn("state", F.array("l_quantity", "l_discount")), "state", 0.1)
    return out.select("index", *[(tidy(F.get("state", F.lit(i))) if i > 1 else F.get("state", F.lit(i))).alias(f"s{i}") for i in range(4)])


@query("e15_append_to_state", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS s0, l_extendedprice AS s1, l_tax AS s2, l_discount AS s3 FROM lineitem""")
def append_to_state(spark, root):
    lines = spark.read.parquet(f"{root}/lineitem.parquet")
    out = W.append_to_state(lines.withColumn("state", F.array("l_quantity", "l_extendedprice")), "state", ["l_tax", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.get("state", F.lit(i)).alias(f"s{i}") for i in range(4)])


@query("e16_time_limit", f"""WITH {LINES} SELECT "index", frame_index + 1 >= 4 AS truncated FROM fl""")
def time_limit(spark, root):
    frames, _ = line_frames(spark, root)
    return W.time_limit(frames, 4).select("index", "truncated")


@query("e17_mask_after_done", f"""WITH {EVENTS}, d AS (SELECT *, min(CASE WHEN task = 'purchase' THEN frame_index END) OVER (PARTITION BY episode_index) AS fd FROM fe)
  SELECT "index", frame_index <= coalesce(fd, 0) + 1 AS mask, fd IS NOT NULL AS ever_done FROM d""")
def mask_after_done(spark, root):
    frames, _ = event_frames(spark, root)
    return W.mask_after_done(frames, F.col("task") == "purchase").select("index", "mask", "ever_done")


@query("e18_pad_last_frame", f"""WITH {LINES} SELECT episode_index, frame_index, l_extendedprice, false AS is_copy FROM fl
  UNION ALL SELECT episode_index, frame_index + 1, l_extendedprice, true FROM fl WHERE frame_index = length - 1""")
def pad_last_frame(spark, root):
    frames, _ = line_frames(spark, root)
    return W.pad_last_frame(frames).select(*KEYS, "l_extendedprice", "is_copy")


@query("e19_progress_delta", f"""WITH {EVENTS}, p AS (SELECT *, frame_index / greatest(length - 1, 1) + value / 1000 AS progress FROM fe)
  SELECT "index", round(({_sql_at('progress', 10)}) - progress, 6) + 0.0 AS delta FROM p""")
def progress_delta(spark, root):
    frames, _ = event_frames(spark, root)
    frames = frames.withColumn("progress", F.col("frame_index") / F.greatest(F.col("length") - 1, F.lit(1)) + F.col("value") / 1000)
    return W.progress_delta(frames, "progress", 10).select("index", tidy("delta").alias("delta"))


_BEFORE = f"OVER ({_AT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AFTER = f"OVER ({_AT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("e20_interpolate", f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN task = 'click' THEN value END AS v, CASE WHEN task = 'click' THEN frame_index END AS p FROM fe),
  w AS (SELECT *, last_value(v IGNORE NULLS) {_BEFORE} AS v0, last_value(p IGNORE NULLS) {_BEFORE} AS p0,
   first_value(v IGNORE NULLS) {_AFTER} AS v1, first_value(p IGNORE NULLS) {_AFTER} AS p1 FROM s)
  SELECT "index", round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN p0 = p1 THEN v0
   ELSE v0 + (v1 - v0) / (p1 - p0) * (frame_index - p0) END, 6) AS filled FROM w""")
def interpolate(spark, root):
    frames, _ = event_frames(spark, root)
    frames = frames.withColumn("sample", F.when(F.col("task") == "click", F.col("value")))
    return W.interpolate(frames, "sample", "filled").select("index", tidy("filled").alias("filled"))


@query("e21_weighted_moving_filter", f"""WITH {LINES}, c AS (SELECT *, (lag(l_returnrank) OVER ({_AT})) IS DISTINCT FROM l_returnrank OR frame_index = 0 AS fresh
   FROM (SELECT *, CASE WHEN l_discount < 0.05 THEN 1.0::DOUBLE ELSE l_tax END AS l_returnrank FROM fl)),
  k AS (SELECT *, sum(fresh::INT) OVER ({_AT}) AS n FROM c),
  f AS (SELECT episode_index, n, l_returnrank AS v, lag(l_returnrank, 1) OVER (PARTITION BY episode_index ORDER BY n) AS v1,
   lag(l_returnrank, 2) OVER (PARTITION BY episode_index ORDER BY n) AS v2 FROM k WHERE fresh)
  SELECT k."index", round(CASE WHEN f.n >= 3 THEN v * 0.5 + v1 * 0.25 + v2 * 0.25 ELSE v END, 6) AS filtered
  FROM k JOIN f ON k.episode_index = f.episode_index AND k.n = f.n""")
def weighted_moving_filter(spark, root):
    frames, _ = line_frames(spark, root)
    frames = frames.withColumn("reading", F.when(F.col("l_discount") < 0.05, F.lit(1.0)).otherwise(F.col("l_tax")))
    out = W.weighted_moving_filter(frames, "reading", [0.5, 0.25, 0.25], "filtered")
    return out.select("index", tidy("filtered").alias("filtered"))


@query("e22_latch_reference", f"""WITH {EVENTS}, s AS (SELECT *, task IN ('click', 'view') AS en FROM fe),
  e AS (SELECT *, en AND NOT coalesce(lag(en) OVER ({_AT}), false) AS edge FROM s),
  r AS (SELECT *, last_value(CASE WHEN edge THEN value END IGNORE NULLS) {_BEFORE} AS ref, first_value(value) OVER ({_AT}) AS v0 FROM e),
  d AS (SELECT *, CASE WHEN en THEN ref + frame_index * 0.5::DOUBLE END AS want FROM r)
  SELECT "index", round(coalesce(last_value(want IGNORE NULLS) {_BEFORE}, v0), 6) AS command FROM d""")
def latch_reference(spark, root):
    frames, _ = event_frames(spark, root)
    frames = frames.withColumns({
        "pose": F.array("value"), "delta": F.array(F.col("frame_index") * F.lit(0.5)), "enabled": F.col("task").isin("click", "view"),
    })
    out = W.latch_reference(frames, "pose", "enabled", "delta")
    return out.select("index", tidy(F.get("command", F.lit(0))).alias("command"))


@query("e23_clip_and_check_jump", f"""WITH {LINES}, c AS (SELECT *, least(greatest(l_quantity, 5), 45) AS x, least(greatest(l_discount * 100, 1), 8) AS y FROM fl),
  n AS (SELECT *, coalesce(sqrt((x - lag(x) OVER ({_AT})) ** 2 + (y - lag(y) OVER ({_AT})) ** 2), 0) AS step FROM c)
  SELECT "index", round(x, 6) AS x, round(y, 6) AS y, round(step, 6) AS step_norm, step > 20 AS is_jump FROM n""")
def clip_and_check_jump(spark, root):
    frames, _ = line_frames(spark, root)
    frames = frames.withColumn("pos", F.array(F.col("l_quantity"), F.col("l_discount") * 100))
    out = W.clip_and_check_jump(frames, "pos", [5, 1], [45, 8], 20.0)
    return out.select("index", tidy(F.get("clipped", F.lit(0))).alias("x"), tidy(F.get("clipped", F.lit(1))).alias("y"),
                      tidy("step_norm").alias("step_norm"), "is_jump")


# Predicted chunks: the chunk of frame i predicts value[i + k] * (1 + k / 100) for step i + k.
_HORIZON = 6
_PREDICTED = f"""pr AS (SELECT a.episode_index, a.frame_index AS chunk_start, b.frame_index AS step, a."timestamp" AS t0, a.length,
  b.value * (1 + (b.frame_index - a.frame_index) / 100.0::DOUBLE) AS action FROM fe a JOIN fe b ON a.episode_index = b.episode_index
  AND b.frame_index BETWEEN a.frame_index AND a.frame_index + {_HORIZON - 1} WHERE a.frame_index + {_HORIZON - 1} < a.length)"""


def _predicted(spark, root):
    frames, _ = event_frames(spark, root)
    chunks = W.action_chunks(frames.select(*KEYS, "timestamp", "value"), "value", _HORIZON)
    chunks = chunks.withColumn("chunk", F.transform("chunk", lambda v, k: v * (1 + k / F.lit(100.0))))
    return chunks.withColumnRenamed("frame_index", "chunk_start")


def _actions(spark, root):
    out = W.expand_chunk(_predicted(spark, root), "chunk", "chunk_start", "timestamp", 0.1)
    return out.select("episode_index", "chunk_start", "step", "action", "action_time")


@query("e24_ensemble_chunks", f"""WITH {EVENTS}, {_PREDICTED}, w AS (SELECT *, exp(-0.1::DOUBLE * (row_number() OVER (PARTITION BY episode_index, step ORDER BY chunk_start) - 1)) AS wt FROM pr)
  SELECT episode_index, step, round(sum(wt * action) / sum(wt), 6) AS action, count(*) AS predictions FROM w GROUP BY 1, 2""")
def ensemble_chunks(spark, root):
    out = W.ensemble_chunks(_actions(spark, root), 0.1)
    return out.withColumn("action", tidy("action"))


def _fold_sql(old, new):
    return f"""WITH {EVENTS}, {_PREDICTED}, l AS (SELECT episode_index, chunk_start, step, list(action) OVER (PARTITION BY episode_index, step ORDER BY chunk_start) AS seen FROM pr WHERE step > chunk_start - 1)
  SELECT episode_index, chunk_start, step, round(list_reduce(seen, lambda a, x: a * {old} + x * {new}), 9) AS queued FROM l"""


@query("e25_merge_chunks_weighted", _fold_sql(0.3, 0.7))
def merge_chunks_weighted(spark, root):
    return _merged(spark, root, "weighted_average")


@query("e25_merge_chunks_average", _fold_sql(0.5, 0.5))
def merge_chunks_average(spark, root):
    return _merged(spark, root, "average")


@query("e25_merge_chunks_conservative", _fold_sql(0.7, 0.3))
def merge_chunks_conservative(spark, root):
    return _merged(spark, root, "conservative")


@query("e25_merge_chunks_latest", _fold_sql(0.0, 1.0))
def merge_chunks_latest(spark, root):
    return _merged(spark, root, "latest_only")


def _merged(spark, root, fold):
    actions = _actions(spark, root).withColumn("chunk_no", F.col("chunk_start")).withColumn("executed", F.col("chunk_start") - 1)
    out = W.merge_chunks(actions, fold, executed="executed")
    return out.select("episode_index", "chunk_start", "step", tidy("queued", 9).alias("queued"))


@query("e26_expand_chunk", f"""WITH {EVENTS}, {_PREDICTED} SELECT episode_index, chunk_start, step, round(action, 6) AS action,
  round(t0 + (step - chunk_start) * 0.1::DOUBLE, 6) AS action_time FROM pr""")
def expand_chunk(spark, root):
    return _actions(spark, root).withColumns({"action": tidy("action"), "action_time": tidy("action_time")})


@query("e27_splice_replace", f"""WITH {EVENTS}, {_PREDICTED} SELECT episode_index, chunk_start, step - chunk_start - chunk_start % 3 AS slot, round(action, 6) AS action
  FROM pr WHERE step - chunk_start >= chunk_start % 3""")
def splice_replace(spark, root):
    chunks = _predicted(spark, root).withColumn("delay", (F.col("chunk_start") % 3).cast("int"))
    out = W.splice_chunks(chunks, "chunk", "replace", delay="delay")
    out = out.select("episode_index", "chunk_start", F.posexplode("queue").alias("slot", "action"))
    return out.withColumns({"slot": F.col("slot").cast("bigint"), "action": tidy("action")})


@query("e27_splice_append", f"""WITH {EVENTS}, {_PREDICTED}, c AS (SELECT DISTINCT episode_index, chunk_start FROM pr)
  SELECT episode_index, chunk_start AS chunk_no, (sum(CASE WHEN chunk_start > 0 THEN 2 + chunk_start % 3 ELSE 0 END) OVER (PARTITION BY episode_index ORDER BY chunk_start))::BIGINT AS queue_from,
  (sum({_HORIZON}) OVER (PARTITION BY episode_index ORDER BY chunk_start))::BIGINT AS queue_to FROM c""")
def splice_append(spark, root):
    chunks = _predicted(spark, root).withColumnRenamed("chunk_start", "chunk_no")
    chunks = chunks.withColumn("used", F.col("chunk_no") % 3 + 2)
    return W.splice_chunks(chunks, "chunk", "append", consumed="used").select("episode_index", "chunk_no", "queue_from", "queue_to")


@query("e27_append_queue", f"""WITH {EVENTS}, {_PREDICTED}, c AS (SELECT DISTINCT episode_index, chunk_start AS chunk_no FROM pr),
  r AS (SELECT episode_index, chunk_no, sum(CASE WHEN chunk_no > 0 THEN 5 + chunk_no % 2 ELSE 0 END) OVER w AS a, sum({_HORIZON}) OVER w AS b FROM c WINDOW w AS (PARTITION BY episode_index ORDER BY chunk_no)),
  s AS (SELECT episode_index, row_number() OVER (PARTITION BY episode_index ORDER BY chunk_start, step) - 1 AS place, action FROM pr)
  SELECT episode_index, chunk_no, (place - a)::BIGINT AS slot, round(action, 6) AS action FROM r JOIN s USING (episode_index) WHERE place >= a AND place < b""")
def append_queue(spark, root):
    """What is in the queue when a chunk of six actions is appended for every five or six used."""
    chunks = _predicted(spark, root).withColumnRenamed("chunk_start", "chunk_no")
    spliced = W.splice_chunks(chunks.withColumn("used", F.col("chunk_no") % 2 + 5), "chunk", "append", consumed="used")
    return W.queued_actions(spliced, "chunk").select("episode_index", "chunk_no", "slot", tidy("action").alias("action"))


@query("e28_latency_window", """WITH k AS (SELECT user_id, event_id, value - 20 AS lat, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value >= 20),
  r AS (SELECT *, list(lat) OVER w AS recent, max(lat) OVER (PARTITION BY user_id ORDER BY n) AS top, min(lat) OVER w AS low, count(*) OVER w AS cnt
   FROM k WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT event_id, round(list_aggregate(recent, 'quantile_cont', 0.95), 4) AS p95, round(list_aggregate(recent, 'quantile_cont', 0.5), 4) AS p50,
  round(low, 4) AS p00, round(top, 4) AS p100, cnt AS window_rows FROM r""")
def latency_window(spark, root):
    events = spark.read.parquet(f"{root}/events.parquet").withColumn("latency", F.col("value") - 20)
    events = number_rows(events, ["user_id"], ["ts", "event_id"], "pos")
    out = W.latency_window(events, "user_id", "pos", "latency", 10, {"p00": 0, "p50": 0.5, "p95": 0.95, "p100": 1})
    return out.select("event_id", *[tidy(p, 4).alias(p) for p in ("p00", "p50", "p95", "p100")], "window_rows")


@query("e29_achieved_fps", f"""WITH {EVENTS} SELECT "index", round(CASE WHEN "timestamp" > 1e-6 THEN frame_index / "timestamp" ELSE 0 END, 9) AS fps FROM fe""")
def achieved_fps(spark, root):
    frames, _ = event_frames(spark, root)
    return W.achieved_fps(frames, "timestamp").select("index", tidy("achieved_fps", 9).alias("fps"))


@query("e30_ema", f"""WITH RECURSIVE {EVENTS}, r AS (SELECT episode_index, frame_index, value AS ema FROM fe WHERE frame_index = 0
  UNION ALL SELECT f.episode_index, f.frame_index, (2.0::DOUBLE / 11) * f.value + (1 - 2.0::DOUBLE / 11) * r.ema FROM r JOIN fe f
  ON f.episode_index = r.episode_index AND f.frame_index = r.frame_index + 1) SELECT episode_index, frame_index, round(ema, 6) AS ema, round_even(ema, 0)::BIGINT AS ema_int FROM r""")
def ema(spark, root):
    frames, _ = event_frames(spark, root)
    out = W.ema(frames.select(*KEYS, "value"), "value", 10, "ema")
    return out.select(*KEYS, tidy("ema").alias("ema"), F.bround("ema").cast("bigint").alias("ema_int"))


@query("e31_cap_relative_target", f"""WITH {LINES}, c AS (SELECT "index", l_quantity + greatest(least(l_tax * 100 - l_quantity, 10), -10) AS g0,
  l_discount + greatest(least(l_tax - l_discount, 0.02), -0.02) AS g1, l_tax * 100 AS w0, l_tax AS w1 FROM fl)
  SELECT "index", round(g0, 6) AS g0, round(g1, 6) AS g1, abs(g0 - w0) > 1e-4 OR abs(g1 - w1) > 1e-4 AS capped FROM c""")
def cap_relative_target(spark, root):
    frames, _ = line_frames(spark, root)
    goal, present = F.array(F.col("l_tax") * 100, F.col("l_tax")), F.array("l_quantity", "l_discount")
    safe, capped = W.cap_relative_target(goal, present, [10.0, 0.02])
    return frames.select("index", tidy(F.get(safe, F.lit(0))).alias("g0"), tidy(F.get(safe, F.lit(1))).alias("g1"), capped.alias("capped"))


@query("flagship_window_normalized", f"""WITH {EVENTS}, t AS (SELECT task, row_number() OVER (ORDER BY min("index")) - 1 AS task_index FROM fe GROUP BY 1),
  s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM fe),
  w AS (SELECT fe.*, {_sql_at('value', -2)} AS a, {_sql_at('value', -1)} AS b,
   {_sql_at('value', 1)} AS c, {_sql_at('value', 4)} AS d FROM fe)
  SELECT w."index", w.episode_index, task_index, round((a - m) / (sd + 1e-8), 6) + 0.0 AS n_m2, round((b - m) / (sd + 1e-8), 6) + 0.0 AS n_m1,
  round((value - m) / (sd + 1e-8), 6) + 0.0 AS n_0, round((c - m) / (sd + 1e-8), 6) + 0.0 AS n_p1, round((d - m) / (sd + 1e-8), 6) + 0.0 AS n_p4
  FROM w JOIN t USING (task) CROSS JOIN s""")
def flagship(spark, root):
    """Index, window, statistics, normalise, and task join in one plan."""
    from kinetable.operators.relate import register_tasks, with_task, with_task_index

    frames, _ = event_frames(spark, root)
    tasks = register_tasks(frames)
    frames = with_task_index(frames, tasks)
    out = W.delta_window(frames.select(*KEYS, "index", "task_index", "value"), {"value": _OFFSETS})
    moments = frames.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    out = with_task(out, tasks).crossJoin(moments)  # one row of statistics
    names = ["n_m2", "n_m1", "n_0", "n_p1", "n_p4"]
    scaled = [tidy((F.get("value_window", F.lit(i)) - F.col("mean")) / (F.col("std") + 1e-8)).alias(n) for i, n in enumerate(names)]
    return out.select("index", "episode_index", "task_index", *scaled)
