"""Queries over selection, order and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, LINES, query
from kinetable.functions.numbers import tidy
from kinetable.operators import select as C
from kinetable.plans.frames import event_frames, line_frames


def _hash(seed, *columns):
    return f"md5('{seed}:' || " + " || ':' || ".join(columns) + ")"


def _hash_int(seed, *columns):
    return f"('0x' || {_hash(seed, *columns)}[1:8])::BIGINT"


@query("c01_select_episodes", f"""WITH {LINES} SELECT "index", episode_index, row_number() OVER (ORDER BY "index") - 1 AS relative_index
  FROM fl WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def select_episodes(spark, root):
    frames, episodes = line_frames(spark, root)
    urgent = spark.read.parquet(f"{root}/orders.parquet").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    chosen = episodes.join(urgent, "l_orderkey", "left_semi")
    return C.select_episodes(frames, chosen).select("index", "episode_index", "relative_index")


@query("c02_sample_frames", f"""WITH {EVENTS} SELECT "index" FROM fe WHERE frame_index >= 3 AND frame_index < length - 5
  AND user_id IN (SELECT user_id FROM events WHERE value > 450)""")
def sample_frames(spark, root):
    frames, episodes = event_frames(spark, root)
    chosen = frames.filter("value > 450").select("episode_index").distinct()
    return C.sample_frames(frames, 3, 5, chosen).select("index")


@query("c03_shuffle_frames", f"""WITH {LINES} SELECT "index", row_number() OVER (ORDER BY {_hash(11, '"index"')}, "index") - 1 AS position FROM fl""")
def shuffle_frames(spark, root):
    frames, _ = line_frames(spark, root)
    return C.shuffle_frames(frames, 11).select("index", "position")


@query("c04_shuffle_sharded", f"""WITH {LINES}, a AS (SELECT "index", episode_index, ({_hash_int(5, '"index"')} % 8)::INT AS shard, {_hash_int(6, '"index"')} AS mix FROM fl),
  s AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY "index") - 1 + mix % 256 AS slot FROM a)
  SELECT "index", episode_index, shard, row_number() OVER (PARTITION BY shard ORDER BY slot, mix, "index") - 1 AS position FROM s""")
def shuffle_sharded(spark, root):
    frames, _ = line_frames(spark, root)
    return C.shuffle_sharded(frames.select("index", "episode_index"), 8, 256, 5)


_COUNT = "greatest(least(length, {lo}), least(floor(pow(length, 0.75::DOUBLE)), 10000))::BIGINT"


@query("c05_sample_evenly", f"""WITH {EVENTS}, e AS (SELECT episode_index, max(length) AS length FROM fe GROUP BY 1),
  n AS (SELECT *, {_COUNT.format(lo=20)} AS n FROM e),
  p AS (SELECT DISTINCT episode_index, CASE WHEN k = n - 1 THEN length - 1 ELSE round_even(k * ((length - 1)::DOUBLE / (n - 1)), 0)::BIGINT END AS frame_index
   FROM n, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS k))
  SELECT fe."index", fe.episode_index, fe.frame_index FROM fe JOIN p USING (episode_index, frame_index)""")
def sample_evenly(spark, root):
    frames, _ = event_frames(spark, root)
    return C.sample_evenly(frames, low=20).select("index", "episode_index", "frame_index")


@query("c06_sampler_weights", f"""WITH {LINES}, t AS (SELECT fl.*, CASE WHEN o_orderstatus = 'O' THEN 'online' ELSE 'offline' END AS source FROM fl JOIN orders ON o_orderkey = l_orderkey),
  v AS (SELECT *, frame_index < length - CASE source WHEN 'online' THEN 1 ELSE 2 END AS live FROM t),
  w AS (SELECT *, CASE WHEN live THEN CASE source WHEN 'online' THEN 0.8::DOUBLE ELSE 1 - 0.8::DOUBLE END / sum(live::INT) OVER (PARTITION BY source) ELSE 0 END AS raw FROM v)
  SELECT "index", source, round(raw / sum(raw) OVER () * 1e6, 4) AS weight FROM w""")
def sampler_weights(spark, root):
    """Open orders are the online source."""
    frames, _ = line_frames(spark, root)
    orders = spark.read.parquet(f"{root}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    frames = frames.join(orders, "l_orderkey")
    online, offline = frames.filter("o_orderstatus = 'O'"), frames.filter("o_orderstatus <> 'O'")
    out = C.sampler_weights(offline, online, 0.8, drop_offline=2, drop_online=1, columns=["index"])
    return out.select("index", "source", tidy(F.col("weight") * 1e6, 4).alias("weight"))


@query("c07_mix_batches", f"""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_hash('3:online', 'o_orderkey')}, o_orderkey) - 1 AS p FROM orders WHERE o_orderstatus = 'O'),
  b AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_hash('3:offline', 'o_orderkey')}, o_orderkey) - 1 AS p FROM orders WHERE o_orderstatus <> 'O'),
  n AS (SELECT least((SELECT count(*) FROM a) // 16, (SELECT count(*) FROM b) // 17) AS n)
  SELECT o_orderkey, p // 16 AS batch_no, 'online' AS origin FROM a, n WHERE p // 16 < n
  UNION ALL SELECT o_orderkey, p // 17, 'offline' FROM b, n WHERE p // 17 < n""")
def mix_batches(spark, root):
    orders = spark.read.parquet(f"{root}/orders.parquet").select("o_orderkey", "o_orderstatus")
    out = C.mix_batches(orders.filter("o_orderstatus = 'O'"), orders.filter("o_orderstatus <> 'O'"), "o_orderkey", 33, 3)
    return out.select("o_orderkey", "batch_no", "origin")


@query("c08_sample_transitions", f"""WITH {EVENTS}, d AS (SELECT event_id AS draw, {_hash_int(9, 'event_id')} % (SELECT count(*) FROM fe) AS "index" FROM events)
  SELECT draw, d."index", value FROM d JOIN fe ON fe."index" = d."index" """)
def sample_transitions(spark, root):
    """As many draws as there are events."""
    frames, _ = event_frames(spark, root)
    draws = spark.read.parquet(f"{root}/events.parquet").count()
    return C.sample_transitions(frames.select("index", "value"), "index", draws, 9).select("draw", "index", "value")


@query("c09_sample_chunks", f"""WITH {EVENTS}, c AS (SELECT *, length - 7 AS n FROM fe WHERE frame_index + 7 < length),
  r AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY {_hash(4, 'episode_index', 'frame_index')}, frame_index) - 1 AS k FROM c)
  SELECT episode_index, frame_index FROM r WHERE k < greatest(1, floor(n * 0.1::DOUBLE))""")
def sample_chunks(spark, root):
    from kinetable.operators.windows import action_chunks

    frames, _ = event_frames(spark, root)
    chunks = action_chunks(frames.select("episode_index", "frame_index", "value"), "value", 8)
    return C.sample_chunks(chunks, "episode_index", "frame_index", 0.1, 4).select("episode_index", "frame_index")


@query("c10_stride_order", f"""WITH {EVENTS} SELECT "index", row_number() OVER (PARTITION BY episode_index ORDER BY frame_index % 30, frame_index) - 1 AS position FROM fe""")
def stride_order(spark, root):
    frames, _ = event_frames(spark, root)
    place = C.stride_position(F.col("frame_index"), F.col("length"), 30)
    return frames.select("index", place.cast("bigint").alias("position"))


@query("c11_frame_patterns", f"""WITH {EVENTS}, p AS (SELECT '1_frame' AS pattern, 0 AS slot, 0 AS o UNION ALL SELECT '2_frames', unnest([0, 1]), unnest([-1, 0])
   UNION ALL SELECT '2_frames_4_space', unnest([0, 1]), unnest([-5, 0]) UNION ALL SELECT '6_frames', unnest([0, 1, 2, 3, 4, 5]), unnest([-5, -4, -3, -2, -1, 0]))
  SELECT a."index", pattern, slot::BIGINT AS slot, b.value FROM fe a CROSS JOIN p JOIN fe b ON b."index" = a."index" + o WHERE a.frame_index >= 5""")
def frame_patterns(spark, root):
    frames, _ = event_frames(spark, root)
    out = C.frame_patterns(frames.select("index", "value"), frames)
    return out.select("index", "pattern", F.col("slot").cast("bigint").alias("slot"), "value")


@query("c12_trim_outliers", f"""WITH {EVENTS}, x AS (SELECT *, value * cos(frame_index) AS x, value * sin(frame_index) AS y FROM fe),
  r AS (SELECT *, sqrt(x * x + y * y) AS r, count(*) OVER (PARTITION BY episode_index) AS n FROM x WHERE frame_index >= length - 50),
  b AS (SELECT episode_index, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM r GROUP BY 1),
  k AS (SELECT r.*, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS j, count(*) OVER (PARTITION BY episode_index) AS m
   FROM r JOIN b USING (episode_index) WHERE n < 20 OR r BETWEEN lo AND hi),
  p AS (SELECT DISTINCT episode_index, CASE WHEN i = 29 THEN m - 1 ELSE floor(i * ((m - 1)::DOUBLE / 29))::BIGINT END AS j FROM (SELECT DISTINCT episode_index, m FROM k), LATERAL (SELECT unnest(generate_series(0, 29)) AS i))
  SELECT "index" FROM k WHERE m <= 30 OR EXISTS (SELECT 1 FROM p WHERE p.episode_index = k.episode_index AND p.j = k.j)""")
def trim_outliers(spark, root):
    frames, _ = event_frames(spark, root)
    points = frames.withColumns({"x": F.col("value") * F.cos("frame_index"), "y": F.col("value") * F.sin("frame_index")})
    out = C.trim_outliers(points, "episode_index", "frame_index", "length", "x", "y", 50, 0.05, 0.95, 30)
    return out.select("index")
