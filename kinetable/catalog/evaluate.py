"""Queries over evaluation and running metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, LINES, VECTORS, query
from kinetable.functions.numbers import tidy
from kinetable.operators import evaluate as V
from kinetable.operators import stats as S
from kinetable.plans.frames import event_frames, line_frames, vector_frames

_RETURNS = """mk AS (SELECT *, frame_index <= coalesce(min(CASE WHEN task = 'purchase' AND value > 100 THEN frame_index END) OVER (PARTITION BY episode_index), 0) + 1 AS mask FROM fe),
  rt AS (SELECT episode_index, any_value(user_id) AS user_id, sum(CASE WHEN mask THEN value ELSE 0 END) AS sum_reward, max(CASE WHEN mask THEN value ELSE 0 END) AS max_reward, bool_or(task = 'signup' AND mask) AS success FROM mk GROUP BY 1)"""


def _returns(spark, root, by=()):
    frames, _ = event_frames(spark, root)
    return V.episode_returns(frames, "value", F.col("task") == "signup", (F.col("task") == "purchase") & (F.col("value") > 100), by)


@query("f13_episode_returns", f"WITH {EVENTS}, {_RETURNS} SELECT episode_index, round(sum_reward, 6) AS sum_reward, max_reward, success FROM rt")
def episode_returns(spark, root):
    return _returns(spark, root).select("episode_index", tidy("sum_reward").alias("sum_reward"), "max_reward", "success")


@query("f13_eval_summary", f"WITH {EVENTS}, {_RETURNS} SELECT round(avg(sum_reward), 6) AS avg_sum_reward, round(avg(max_reward), 6) AS avg_max_reward, round(avg(success::INT) * 100, 6) AS pc_success, count(*) AS n_episodes FROM rt")
def eval_summary(spark, root):
    out = _returns(spark, root).agg(
        tidy(F.avg("sum_reward")).alias("avg_sum_reward"), tidy(F.avg("max_reward")).alias("avg_max_reward"),
        tidy(F.avg(F.col("success").cast("double")) * 100).alias("pc_success"), F.count(F.lit(1)).alias("n_episodes"))
    return out


@query("f14_eval_rollup", f"""WITH {EVENTS}, {_RETURNS}, g AS (SELECT rt.*, c_mktsegment AS grp, n_name AS task FROM rt JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey)
  SELECT CASE WHEN grouping(grp) = 0 THEN grp ELSE 'ALL' END AS grp, CASE WHEN grouping(task) = 0 THEN task ELSE 'ALL' END AS task, round(avg(sum_reward), 5) AS avg_sum_reward, round(avg(max_reward), 5) AS avg_max_reward,
  round(avg(success::INT) * 100, 6) AS pc_success, count(*) AS n_episodes FROM g GROUP BY GROUPING SETS ((grp, task), (grp), ())""")
def eval_rollup(spark, root):
    """Episodes scored by market segment (group) and nation (task) of their user."""
    customer = spark.read.parquet(f"{root}/customer.parquet")
    nation = spark.read.parquet(f"{root}/nation.parquet")
    who = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("grp"), F.col("n_name").alias("task"))
    out = V.eval_rollup(_returns(spark, root, by=["user_id"]).join(who, "user_id"), "grp", "task")
    return out.select("grp", "task", tidy("avg_sum_reward", 5).alias("avg_sum_reward"), tidy("avg_max_reward", 5).alias("avg_max_reward"), tidy("pc_success").alias("pc_success"), "n_episodes")


@query("f14_label_rollup", """WITH g AS (SELECT lang, source, quality, toxic FROM labels JOIN documents USING (doc_id))
  SELECT CASE WHEN grouping(lang) = 0 THEN lang ELSE 'ALL' END AS lang, CASE WHEN grouping(source) = 0 THEN source ELSE 'ALL' END AS source, round(avg(quality), 6) AS avg_sum_reward, round(avg(toxic), 6) AS avg_max_reward,
  round(avg(quality) * 100, 6) AS pc_success, count(*) AS n_episodes FROM g GROUP BY GROUPING SETS ((lang, source), (lang), ())""")
def label_rollup(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang", "source")
    rows = spark.read.parquet(f"{root}/labels.parquet").join(docs, "doc_id").select(
        "lang", "source", F.col("quality").cast("double").alias("sum_reward"), F.col("toxic").cast("double").alias("max_reward"), F.col("quality").alias("success"))
    out = V.eval_rollup(rows, "lang", "source")
    return out.select("lang", "source", *[tidy(c).alias(c) for c in ("avg_sum_reward", "avg_max_reward", "pc_success")], "n_episodes")


@query("f15_running_meter", f"""WITH {EVENTS}, r AS (SELECT *, 1 + event_id % 4 AS n FROM fe),
  m AS (SELECT "index", sum(value * n) OVER (PARTITION BY episode_index, frame_index // 10 ORDER BY frame_index) / sum(n) OVER (PARTITION BY episode_index, frame_index // 10 ORDER BY frame_index) AS a,
   (sum(n) OVER (PARTITION BY episode_index ORDER BY frame_index))::BIGINT AS samples FROM r)
  SELECT "index", round(a, 6) AS meter_avg, samples, round(samples / 66.5::DOUBLE, 6) AS episodes, round(samples / 10000.0::DOUBLE, 6) AS epochs FROM m""")
def running_meter(spark, root):
    frames, _ = event_frames(spark, root)
    out = V.running_meter(frames.withColumn("n", F.col("event_id") % 4 + 1), "episode_index", "frame_index", "value", "n", 10)
    counters = V.training_counters(F.col("samples"), 66.5, 10000.0)
    return out.select("index", tidy("meter_avg").alias("meter_avg"), "samples", *[tidy(c).alias(n) for n, c in counters.items()])


@query("f16_joint_limits", f"""WITH {LINES} SELECT feature, 0::BIGINT AS dim, round(min(value), 4) AS min, round(max(value), 4) AS max FROM
  (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM fl WHERE "timestamp" >= 0.2) ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE value) GROUP BY 1""")
def joint_limits(spark, root):
    frames, _ = line_frames(spark, root)
    tall = S.to_series(frames, ["timestamp"], ["l_quantity", "l_extendedprice", "l_discount"])
    return V.joint_limits(tall, "timestamp", 0.2).withColumn("dim", F.col("dim").cast("bigint"))


@query("f17_reconstruction_quality", f"""WITH {VECTORS}, c AS (SELECT unnest([8, 32, 128]) AS levels), p AS (SELECT levels, list_avg(list_transform(state, lambda x: (x - round_even(x * levels, 0) / levels) ** 2)) AS mse FROM fv CROSS JOIN c)
  SELECT levels::BIGINT AS levels, round(avg(mse) * 1000, 6) AS avg_mse, round(avg(10 * log10(1 / mse)), 6) AS avg_psnr, count(*) AS pairs, round(levels / 256.0::DOUBLE, 6) AS size_ratio FROM p GROUP BY levels""")
def reconstruction_quality(spark, root):
    """Vectors against copies stored at 8, 32 and 128 levels."""
    frames, _ = vector_frames(spark, root)
    pairs = frames.select("state", F.explode(F.array(F.lit(8), F.lit(32), F.lit(128)).cast("array<bigint>")).alias("levels"))
    decoded = F.transform("state", lambda x: F.bround(x * F.col("levels")) / F.col("levels"))
    pairs = pairs.withColumns({"decoded": decoded, "full": F.lit(256.0)})
    out = V.reconstruction_quality(pairs, "state", "decoded", ["levels"], 1.0, ("levels", "full"))
    return out.select("levels", tidy(F.col("avg_mse") * 1000).alias("avg_mse"), tidy("avg_psnr").alias("avg_psnr"), "pairs", tidy("size_ratio").alias("size_ratio"))


@query("f18_token_length_stats", """WITH s AS (SELECT len(string_split(text, ' ')) AS n FROM documents)
  SELECT round(2048 / avg(n), 6) AS compression_ratio, round(avg(n), 6) AS mean_token_length, round(quantile_cont(n, 0.99), 6) AS p99_token_length, min(n)::DOUBLE AS min_token_length, max(n)::DOUBLE AS max_token_length FROM s""")
def token_length_stats(spark, root):
    """Words of the documents as tokens."""
    docs = spark.read.parquet(f"{root}/documents.parquet").select(F.split("text", " ").alias("tokens"))
    out = V.token_length_stats(docs, "tokens", 2048)
    return out.select(*[tidy(c).alias(c) for c in out.columns])


@query("f19_per_dim_summary", f"""WITH {VECTORS}, t AS (SELECT d - 1 AS dim, state[d] AS v FROM fv CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS d)),
  s AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM t GROUP BY 1), n AS (SELECT dim, 2 * (v - lo) / (hi - lo) - 1 AS v FROM t JOIN s USING (dim))
  SELECT dim, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM n GROUP BY 1""")
def per_dim_summary(spark, root):
    from kinetable.functions.scaling import normalize, stats_row

    frames, _ = vector_frames(spark, root)
    stats = stats_row(S.feature_stats(S.to_series(frames, [], ["state"])), {"state": [("state", d) for d in range(64)]})
    scaled = normalize(frames, stats, {"state": "MIN_MAX"})
    out = V.per_dim_summary(S.to_series(scaled, [], ["state"]))
    return out.select(F.col("dim").cast("bigint").alias("dim"), *[tidy(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("f19_progress_summary", f"""WITH {EVENTS} SELECT 'progress' AS feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max FROM fe""")
def progress_summary(spark, root):
    frames, _ = event_frames(spark, root)
    tall = S.to_series(frames.withColumnRenamed("value", "progress"), [], ["progress"])
    out = V.per_dim_summary(tall, sample_std=True)
    return out.select("feature", tidy("mean").alias("mean"), tidy("std").alias("std"), "min", "max")


@query("f20_intervention_summary", f"""WITH {EVENTS} SELECT episode_index, round(sum(value), 6) AS episodic_reward, bool_or(task = 'error' AND value > 100)::BIGINT AS episode_intervention,
  round(avg((task = 'error' AND value > 100)::INT), 6) AS intervention_rate, count(*) AS steps FROM fe GROUP BY 1""")
def intervention_summary(spark, root):
    frames, _ = event_frames(spark, root)
    out = V.intervention_summary(frames, "value", (F.col("task") == "error") & (F.col("value") > 100))
    return out.select("episode_index", tidy("episodic_reward").alias("episodic_reward"), "episode_intervention", tidy("intervention_rate").alias("intervention_rate"), "steps")
