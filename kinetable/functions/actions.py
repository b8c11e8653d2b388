"""Action and reward columns: penalties, overrides, deltas, poses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.functions.numbers import clip


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gripper_penalty(state: Column, action: Column, penalty: float = -0.01, top: float = 30.0) -> Column:
    """The penalty when a closed gripper is closed further or an open one opened; else 0."""
    at, goal = state / top, action / top
    wasted = ((at < 0.5) & (goal > 0.5)) | ((at > 0.75) & (goal < 0.5))
    return F.when(wasted, F.lit(float(penalty))).otherwise(0.0)


def apply_intervention(action: Column, teleop: Column, intervening: Column, terminate: Column, success: Column, terminate_on_success: bool = True) -> dict[str, Column]:
    """Action, done and reward of a step a human may override."""
    on = F.coalesce(intervening, F.lit(False))
    won = F.coalesce(success, F.lit(False))
    ended = F.coalesce(terminate, F.lit(False))
    return {
        "action": F.when(on & teleop.isNotNull(), teleop).otherwise(action),
        "done": (ended | won) if terminate_on_success else ended,
        "reward": won.cast("double"),
    }


def teleop_vector(x: Column, y: Column, z: Column, gripper: Column | None = None) -> Column:
    """Named teleoperation deltas to a vector; a missing delta is 0, a missing gripper 1."""
    parts = [F.coalesce(c, F.lit(0.0)) for c in (x, y, z)]
    return F.array(*parts, *([] if gripper is None else [F.coalesce(gripper, F.lit(1.0))]))


def label_success(score: Column, reward: Column, done: Column, success_reward: float = 1.0, terminate: bool = True) -> dict[str, Column]:
    """Reward and done of a step whose predicted success is within 1e-2 of 1."""
    hit = F.abs(score - 1) <= F.greatest(F.lit(1e-2), F.greatest(F.abs(score), F.lit(1.0)) * 1e-9)
    return {"reward": F.when(hit, success_reward).otherwise(reward), "done": (done | hit) if terminate else done}


def vector_to_delta(action: Column, gripper: bool = True) -> Column:
    """The first components of an action vector, by name."""
    names = ["delta_x", "delta_y", "delta_z", *(["gripper"] if gripper else [])]
    return F.struct(*[F.get(action, F.lit(i)).alias(n) for i, n in enumerate(names)])


def gate_delta(delta: Column, scale: float = 1.0, threshold: float = 1e-3) -> Column:
    """Scaled targets; enabled when the position delta is longer than the threshold."""
    x, y, z = delta["delta_x"], delta["delta_y"], delta["delta_z"]
    zero = F.lit(0.0)
    return F.struct(
        (F.sqrt(x * x + y * y + z * z) > threshold).alias("enabled"), (x * scale).alias("target_x"), (y * scale).alias("target_y"), (z * scale).alias("target_z"),
        zero.alias("target_wx"), zero.alias("target_wy"), zero.alias("target_wz"), delta["gripper"].cast("double").alias("gripper_vel"))


def integrate_gripper(position: Column, velocity: Column, speed: float = 20.0, low: float = 0.0, high: float = 100.0, discrete: bool = False) -> Column:
    """Position moved by velocity and clipped; a discrete velocity 0, 1, 2 means open, stay, close at full range."""
    rate = (velocity - 1) * high if discrete else velocity
    return clip(position + rate * speed, low, high)


def remap_axes(pos: Column, rot: Column, enabled: Column, buttons: tuple[Column, Column] | None = None, analog: Column | None = None) -> Column:
    """Tracker axes to robot axes, zero while disabled; gripper speed from an axis or two buttons."""
    def held(value: Column) -> Column:
        return F.when(enabled, value).otherwise(0.0)

    def at(v: Column, i: int) -> Column:
        return F.get(v, F.lit(i))

    speed = F.coalesce(analog, F.lit(0.0)) if analog is not None else F.coalesce(buttons[0], F.lit(0.0)) - F.coalesce(buttons[1], F.lit(0.0))
    return F.struct(
        enabled.alias("enabled"), held(-at(pos, 1)).alias("target_x"), held(at(pos, 0)).alias("target_y"), held(at(pos, 2)).alias("target_z"),
        held(at(rot, 1)).alias("target_wx"), held(at(rot, 0)).alias("target_wy"), held(-at(rot, 2)).alias("target_wz"), speed.alias("gripper_vel"))


def quaternion_to_axis_angle(quat: Column, floor: float = 1e-10) -> Column:
    """(x, y, z, w) to axis times angle; no rotation gives zeros."""
    def turn(q: Column) -> Column:
        w = clip(F.get(q, F.lit(3)), -1.0, 1.0)
        length = F.sqrt(F.greatest(1.0 - w * w, F.lit(0.0)))
        angle = F.acos(w) * 2.0
        return F.transform(F.slice(q, 1, 3), lambda x: F.when(length > floor, x / length * angle).otherwise(0.0))

    return let(quat, turn)


def pose_to_state(pos: Column, quat: Column, gripper: Column) -> Column:
    """Position, rotation vector and gripper as one state vector."""
    return F.concat(pos, quaternion_to_axis_angle(quat), gripper)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column, pad: float) -> Column:
    return let(v, lambda u: let(F.sqrt(dot(u, u)) + pad, lambda n: F.transform(u, lambda x: x / n)))


def _cross(a: Column, b: Column) -> Column:
    def g(v, i):
        return F.get(v, F.lit(i))

    return F.array(*[g(a, (i + 1) % 3) * g(b, (i + 2) % 3) - g(a, (i + 2) % 3) * g(b, (i + 1) % 3) for i in range(3)])


def _quaternion(x: Column, y: Column, z: Column) -> Column:
    """Quaternion (x, y, z, w), w >= 0, of the rotation whose matrix has the given columns.

    The symmetric matrix below is (4/3) q q' - I/3 for a rotation, so with I/3 added each of
    its columns is a multiple of q: the longest column, multiplied once more, is q.
    """
    def m(i, j):
        return F.get((x, y, z)[j], F.lit(i))

    xx, yy, zz = m(0, 0), m(1, 1), m(2, 2)
    xy, xz, yz = m(0, 1) + m(1, 0), m(0, 2) + m(2, 0), m(1, 2) + m(2, 1)
    wx, wy, wz = m(2, 1) - m(1, 2), m(0, 2) - m(2, 0), m(1, 0) - m(0, 1)
    one = F.lit(1.0)
    rows = F.array(
        F.array(one + xx - yy - zz, xy, xz, wx), F.array(xy, one + yy - xx - zz, yz, wy),
        F.array(xz, yz, one + zz - xx - yy, wz), F.array(wx, wy, wz, one + xx + yy + zz))

    def solve(k: Column) -> Column:
        diagonal = F.transform(k, lambda row, i: F.get(row, i))
        start = F.get(k, F.array_position(diagonal, F.array_max(diagonal)).cast("int") - 1)
        return let(start, lambda s: F.transform(k, lambda row: dot(row, s)))

    return let(_unit(let(rows, solve), 0.0), lambda q: F.when(F.get(q, F.lit(3)) < 0, F.transform(q, lambda c: -c)).otherwise(q))


def rot6d_to_axis_angle(rot: Column, pad: float = 1e-6) -> Column:
    """Two 3-vectors made orthonormal, as a rotation vector."""
    first, second = F.slice(rot, 1, 3), F.slice(rot, 4, 3)

    def frame(b1: Column) -> Column:
        rest = let(dot(b1, second), lambda d: F.zip_with(second, b1, lambda s, b: s - d * b))
        return let(_unit(rest, pad), lambda b2: quaternion_to_axis_angle(_quaternion(b1, b2, _cross(b1, b2)), 0.0))

    return let(_unit(first, pad), frame)


def rot6d_action(action: Column, threshold: float = 0.5) -> Column:
    """Action (position 3, rotation 6, gripper) to position, rotation vector, and gripper as 1 or -1."""
    gripper = F.when(F.get(action, F.lit(9)) > threshold, 1.0).otherwise(-1.0)
    return F.concat(F.slice(action, 1, 3), rot6d_to_axis_angle(F.slice(action, 4, 6)), F.array(gripper))
