"""Raw readings to calibrated units and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.functions.numbers import clip

CENTERED, PERCENT, DEGREES = "RANGE_M100_100", "RANGE_0_100", "DEGREES"


def calibrate(raw: Column, low: Column, high: Column, mode: Column, flipped: Column, resolution: Column) -> Column:
    """Reading to [-100, 100], [0, 100] or degrees around mid range, by mode; a flip mirrors the ranges."""
    share = (clip(raw, low, high) - low) / (high - low)
    centered, percent = share * 200 - 100, share * 100
    degrees = (raw - (low + high) / 2) * 360 / (resolution - 1)
    return (
        F.when(mode == CENTERED, F.when(flipped, -centered).otherwise(centered))
        .when(mode == PERCENT, F.when(flipped, 100 - percent).otherwise(percent))
        .when(mode == DEGREES, degrees)
    )


def uncalibrate(value: Column, low: Column, high: Column, mode: Column, flipped: Column, resolution: Column) -> Column:
    """Inverse of ``calibrate``, cut to a whole reading."""
    centered = clip(F.when(flipped, -value).otherwise(value), -100.0, 100.0)
    percent = clip(F.when(flipped, 100 - value).otherwise(value), 0.0, 100.0)
    raw = (
        F.when(mode == CENTERED, (centered + 100) / 200 * (high - low) + low)
        .when(mode == PERCENT, percent / 100 * (high - low) + low)
        .when(mode == DEGREES, value * (resolution - 1) / 360 + (low + high) / 2)
    )
    return raw.cast("bigint")
