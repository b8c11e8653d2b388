"""Queries over actions and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, VECTORS, query
from kinetable.functions import actions as A
from kinetable.functions.numbers import tidy
from kinetable.plans.frames import event_frames, vector_frames

_LKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(_LKEYS)


def _lines(spark, root):
    return spark.read.parquet(f"{root}/lineitem.parquet")


@query("g08_gripper_penalty", f"""SELECT {_K}, CASE WHEN (l_quantity / 50 < 0.5 AND l_discount * 500 / 50 > 0.5) OR (l_quantity / 50 > 0.75 AND l_discount * 500 / 50 < 0.5) THEN -0.01 ELSE 0 END::DOUBLE AS penalty FROM lineitem""")
def gripper_penalty(spark, root):
    penalty = A.gripper_penalty(F.col("l_quantity"), F.col("l_discount") * 500, top=50.0)
    return _lines(spark, root).select(*_LKEYS, penalty.alias("penalty"))


@query("g09_apply_intervention", f"""WITH {EVENTS} SELECT "index", CASE WHEN task IN ('click', 'view') AND value > 20 THEN value / 2 ELSE value END AS a0, CASE WHEN task IN ('click', 'view') AND value > 20 THEN 0 ELSE value * 3 END AS a1,
  task = 'error' OR value > 300 AS done, (value > 300)::INT::DOUBLE AS reward FROM fe""")
def apply_intervention(spark, root):
    frames, _ = event_frames(spark, root)
    teleop = F.when(F.col("value") > 20, A.teleop_vector(F.col("value") / 2, F.lit(None).cast("double"), F.lit(0.0)))
    out = frames.withColumns(A.apply_intervention(
        F.array(F.col("value"), F.col("value") * 3, F.lit(1.0)), teleop, F.col("task").isin("click", "view"), F.col("task") == "error", F.col("value") > 300))
    return out.select("index", F.get("action", F.lit(0)).alias("a0"), F.get("action", F.lit(1)).alias("a1"), "done", "reward")


@query("g10_label_success", """SELECT event_id, CASE WHEN abs(value / 100 - 1) <= 0.01 THEN 1 ELSE value END::DOUBLE AS reward, event_type = 'error' OR abs(value / 100 - 1) <= 0.01 AS done FROM events""")
def label_success(spark, root):
    events = spark.read.parquet(f"{root}/events.parquet")
    out = A.label_success(F.col("value") / 100, F.col("value"), F.col("event_type") == "error")
    return events.select("event_id", out["reward"].alias("reward"), out["done"].alias("done"))


@query("g11_vector_to_delta", f"""WITH {VECTORS} SELECT vec_id, sqrt(state[1] ** 2 + state[2] ** 2 + state[3] ** 2) > 0.2 AS enabled, round(state[1] * 0.5, 8) + 0.0 AS target_x, round(state[2] * 0.5, 8) + 0.0 AS target_y,
  round(state[3] * 0.5, 8) + 0.0 AS target_z, 0::DOUBLE AS target_wx, round(state[4], 8) + 0.0 AS gripper_vel FROM fv""")
def vector_to_delta(spark, root):
    frames, _ = vector_frames(spark, root)
    gated = frames.select("vec_id", A.vector_to_delta(F.col("state")).alias("d")).select("vec_id", A.gate_delta(F.col("d"), 0.5, 0.2).alias("g"))
    return gated.select("vec_id", "g.enabled", *[tidy(f"g.{c}", 8).alias(c) for c in ("target_x", "target_y", "target_z", "target_wx", "gripper_vel")])


@query("g12_integrate_gripper", f"""SELECT {_K}, round(least(greatest(l_quantity + (l_tax - 0.04) * 400, 0), 45), 6) + 0.0 AS smooth, least(greatest(l_quantity + (l_linenumber % 3 - 1) * 45 * 0.2::DOUBLE, 0), 45)::DOUBLE AS stepped FROM lineitem""")
def integrate_gripper(spark, root):
    smooth = A.integrate_gripper(F.col("l_quantity"), F.col("l_tax") - 0.04, 400.0, 0.0, 45.0)
    stepped = A.integrate_gripper(F.col("l_quantity"), F.col("l_linenumber") % 3, 0.2, 0.0, 45.0, discrete=True)
    return _lines(spark, root).select(*_LKEYS, tidy(smooth).alias("smooth"), stepped.alias("stepped"))


@query("g13_remap_axes", f"""WITH {VECTORS}, e AS (SELECT *, state[7] > 0 AS en FROM fv) SELECT vec_id, en AS enabled, CASE WHEN en THEN round(-state[2], 8) ELSE 0 END + 0.0 AS target_x, CASE WHEN en THEN round(state[1], 8) ELSE 0 END + 0.0 AS target_y,
  CASE WHEN en THEN round(state[3], 8) ELSE 0 END + 0.0 AS target_z, CASE WHEN en THEN round(state[5], 8) ELSE 0 END + 0.0 AS target_wx, CASE WHEN en THEN round(state[4], 8) ELSE 0 END + 0.0 AS target_wy,
  CASE WHEN en THEN round(-state[6], 8) ELSE 0 END + 0.0 AS target_wz, round(state[8] - state[9], 8) + 0.0 AS gripper_vel FROM e""")
def remap_axes(spark, root):
    frames, _ = vector_frames(spark, root)
    s = lambda i: F.get("state", F.lit(i))
    out = frames.select("vec_id", A.remap_axes(F.slice("state", 1, 3), F.slice("state", 4, 3), s(6) > 0, (s(7), s(8))).alias("r"))
    names = ("target_x", "target_y", "target_z", "target_wx", "target_wy", "target_wz", "gripper_vel")
    return out.select("vec_id", "r.enabled", *[tidy(f"r.{c}", 8).alias(c) for c in names])


@query("g14_pose_to_state", f"""WITH {VECTORS}, q AS (SELECT vec_id, state, least(greatest(state[4] * 4, -1), 1) AS w FROM fv), a AS (SELECT *, sqrt(greatest(1 - w * w, 0)) AS den, 2 * acos(w) AS ang FROM q)
  SELECT vec_id, round(state[9], 8) + 0.0 AS s0, {', '.join(f'round(CASE WHEN den > 1e-10 THEN state[{i}] * 4 / den * ang ELSE 0 END, 8) + 0.0 AS s{i + 2}' for i in (1, 2, 3))}, round(state[13], 8) + 0.0 AS s7 FROM a""")
def pose_to_state(spark, root):
    frames, _ = vector_frames(spark, root)
    quat = F.transform(F.slice("state", 1, 4), lambda v: v * 4)
    state = A.pose_to_state(F.slice("state", 9, 3), quat, F.slice("state", 12, 2))
    out = frames.select("vec_id", state.alias("s"))
    return out.select("vec_id", *[tidy(F.get("s", F.lit(i)), 8).alias(f"s{i}") for i in (0, 3, 4, 5, 7)])


_ROT = f"""{VECTORS}, a AS (SELECT vec_id, state, state[4:6] AS a1, state[7:9] AS a2 FROM fv),
  b AS (SELECT *, list_transform(a1, lambda x: x / (sqrt(list_inner_product(a1, a1)) + 1e-6::DOUBLE)) AS b1 FROM a),
  c AS (SELECT *, list_transform(range(1, 4), lambda i: a2[i] - list_inner_product(b1, a2) * b1[i]) AS o FROM b),
  d AS (SELECT *, list_transform(o, lambda x: x / (sqrt(list_inner_product(o, o)) + 1e-6::DOUBLE)) AS b2 FROM c),
  e AS (SELECT *, [b1[2] * b2[3] - b1[3] * b2[2], b1[3] * b2[1] - b1[1] * b2[3], b1[1] * b2[2] - b1[2] * b2[1]] AS b3 FROM d),
  k AS (SELECT *, [[1 + b1[1] - b2[2] - b3[3], b2[1] + b1[2], b3[1] + b1[3], b2[3] - b3[2]], [b2[1] + b1[2], 1 + b2[2] - b1[1] - b3[3], b3[2] + b2[3], b3[1] - b1[3]],
   [b3[1] + b1[3], b3[2] + b2[3], 1 + b3[3] - b1[1] - b2[2], b1[2] - b2[1]], [b2[3] - b3[2], b3[1] - b1[3], b1[2] - b2[1], 1 + b1[1] + b2[2] + b3[3]]] AS k FROM e),
  s AS (SELECT *, CASE greatest(k[1][1], k[2][2], k[3][3], k[4][4]) WHEN k[1][1] THEN k[1] WHEN k[2][2] THEN k[2] WHEN k[3][3] THEN k[3] ELSE k[4] END AS c FROM k),
  v AS (SELECT *, list_transform(k, lambda r: list_inner_product(r, c)) AS v FROM s),
  q AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)) * CASE WHEN v[4] < 0 THEN -1 ELSE 1 END) AS q FROM v)"""


@query("g15_rot6d_to_axis_angle", f"""WITH {_ROT} SELECT vec_id, {', '.join(f'round(q[{i}] * 2 * acos(least(q[4], 1)) / sqrt(1 - q[4] * q[4]), 6) + 0.0 AS r{i}' for i in (1, 2, 3))}, CASE WHEN state[10] > 0.5 THEN 1 ELSE -1 END::DOUBLE AS gripper FROM q""")
def rot6d_to_axis_angle(spark, root):
    frames, _ = vector_frames(spark, root)
    out = frames.select("vec_id", A.rot6d_action(F.slice("state", 1, 10)).alias("a"))
    return out.select("vec_id", *[tidy(F.get("a", F.lit(i + 2))).alias(f"r{i}") for i in (1, 2, 3)], F.get("a", F.lit(6)).alias("gripper"))
