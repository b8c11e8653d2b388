"""Queries over chains of steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, LINES, query
from kinetable.functions import scaling as G
from kinetable.functions.numbers import tidy
from kinetable.operators import shape as B
from kinetable.operators import stats as S
from kinetable.operators.windows import fold_function
from kinetable.plans.frames import event_frames, line_frames
from kinetable.session import scratch_path
from kinetable.steps import Chain, Step, on_slot

_AT = "PARTITION BY episode_index ORDER BY frame_index"
_CHAIN_SQL = f"""WITH {LINES}, v AS (SELECT *, (l_quantity - coalesce(lag(l_quantity) OVER ({_AT}), l_quantity)) / 0.1::DOUBLE AS vel FROM fl), s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem)
  SELECT "index", round((l_quantity - m) / (sd + 1e-8::DOUBLE), 6) + 0.0 AS s0, round(vel, 6) + 0.0 AS s1, frame_index + 1 >= 3 AS truncated FROM v, s"""


def _chain(stats):
    return Chain([
        Step("rename", {"names": {"l_quantity": "q"}}), Step("normalize", {"modes": {"state": "MEAN_STD"}}, {"stats": stats}),
        Step("joint_velocity", {"state": "speed", "dt": 0.1}), Step("time_limit", {"steps": 3}),
    ])


def _input(spark, root):
    frames, _ = line_frames(spark, root)
    frames = frames.select("episode_index", "frame_index", "index", "l_quantity", F.array("l_quantity").alias("state"), F.array("l_quantity").alias("speed"))
    stats = S.feature_stats(S.to_series(spark.read.parquet(f"{root}/lineitem.parquet"), [], ["l_quantity"]))
    return frames, G.stats_row(stats, {"state": [("l_quantity", 0)]})


def _output(rows):
    return rows.select("index", tidy(F.get("state", F.lit(0))).alias("s0"), tidy(F.get("velocity", F.lit(0))).alias("s1"), "truncated")


@query("k02_step_chain", _CHAIN_SQL)
def step_chain(spark, root):
    frames, stats = _input(spark, root)
    return _output(_chain(stats)(frames))


@query("k03_save_and_load_chain", _CHAIN_SQL.replace("frame_index + 1 >= 3", "frame_index + 1 >= 5"))
def save_and_load_chain(spark, root):
    """A saved chain, loaded with another time limit."""
    frames, stats = _input(spark, root)
    path = scratch_path(spark, "chain")
    _chain(stats).save(spark, path)
    return _output(Chain.load(spark, path, {"time_limit": {"steps": 5}})(frames))


@query("k05_single_slot", f"""WITH {EVENTS} SELECT "index", value * 2 AS reward, user_id + 1 AS who, task = 'error' OR value > 200 AS done FROM fe""")
def single_slot(spark, root):
    frames, _ = event_frames(spark, root)
    flat = frames.select("index", F.col("user_id").alias("observation.who"), F.col("value").alias("action"), F.col("value").alias("next.reward"), (F.col("task") == "error").alias("next.done"))
    rows = B.to_transition(flat).transform(on_slot("reward", None, lambda c: c * 2))
    rows = rows.transform(on_slot("observation", "observation.who", lambda c: c + 1))
    rows = rows.transform(on_slot("done", None, lambda c: c | (F.col("action") > 200)))
    return rows.select("complementary.index", "reward", F.col("observation")["observation.who"].alias("who"), "done")


@query("k06_row_callable", f"""WITH {EVENTS} SELECT "index", length(task) + episode_index * 10 + frame_index AS score FROM fe""")
def row_callable(spark, root):
    frames, _ = event_frames(spark, root)
    score = B.row_callable(lambda row, episode, frame: len(row["task"]) + episode * 10 + frame, "bigint", ["task", "value"])
    return frames.select("index", score.alias("score"))


@query("k07_fold_functions", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 0.3::DOUBLE + l_tax * 0.7::DOUBLE, 9) AS weighted, l_tax AS latest, round(l_quantity * 0.5::DOUBLE + l_tax * 0.5::DOUBLE, 9) AS mean, round(l_quantity * 0.7::DOUBLE + l_tax * 0.3::DOUBLE, 9) AS cautious FROM lineitem""")
def fold_functions(spark, root):
    rows = spark.read.parquet(f"{root}/lineitem.parquet")
    names = {"weighted": "weighted_average", "latest": "latest_only", "mean": "average", "cautious": "conservative"}
    folded = [tidy(fold_function(f)(F.col("l_quantity"), F.col("l_tax")), 9).alias(n) for n, f in names.items()]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *folded)
