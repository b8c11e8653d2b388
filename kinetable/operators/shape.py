"""Projections: renaming, selecting, adding and nesting columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions.names import named
from kinetable.model import MANDATORY

# Prefixes taken off selected feature names.
PREFIXES = ("action.", "observation.state.", "state.", "observation.images.", "images.")


def rename_features(frames: DataFrame, names: dict[str, str]) -> DataFrame:
    return frames.withColumnsRenamed(names)


def rename_stats(stats: DataFrame, names: dict[str, str]) -> DataFrame:
    """The same renaming for a statistics table."""
    renamed = F.col("feature")
    for old, new in names.items():
        renamed = F.when(F.col("feature") == old, new).otherwise(renamed)
    return stats.withColumn("feature", renamed)


def select_features(frames: DataFrame, keep: Sequence[str] | None, images: bool = True, always: Sequence[str] = ()) -> DataFrame:
    """Columns that match a pattern, with the group prefix taken off; ``images`` keeps image columns."""
    out = [F.col(c) for c in always]
    for name in frames.columns:
        if name in always:
            continue
        is_image = re.search(r"(^|\.)images\.", name) is not None
        if images if is_image else keep is None or any(re.search(p, name) for p in keep):
            prefix = next((p for p in PREFIXES if name.startswith(p)), "")
            out.append(F.col(f"`{name}`").alias(name[len(prefix):]))
    return frames.select(*out)


COMPLEMENTARY = ("task", "subtask", "index", "task_index", "episode_index")


def to_transition(frames: DataFrame) -> DataFrame:
    """Flat rows to ``observation, action, reward, done, truncated, info, complementary`` columns.

    Missing reward is 0.0 and missing flags are false; ``*_is_pad`` and the task and index
    columns travel in ``complementary``.
    """
    have = frames.columns

    def pack(names: Sequence[str]) -> Column:
        return F.struct(*[F.col(f"`{n}`").alias(n) for n in names]) if names else F.lit(None).cast("struct<>")

    def first(name: str, default: Column) -> Column:
        return F.coalesce(F.col(f"`{name}`"), default) if name in have else default

    extra = [n for n in have if n.endswith("_is_pad") or n in COMPLEMENTARY]
    return frames.select(
        pack([n for n in have if n.startswith("observation") and n not in extra]).alias("observation"),
        (F.col("action") if "action" in have else F.lit(None).cast("double")).alias("action"),
        first("next.reward", F.lit(0.0)).alias("reward"), first("next.done", F.lit(False)).alias("done"),
        first("next.truncated", F.lit(False)).alias("truncated"),
        F.create_map().cast("map<string,string>").alias("info"), pack(extra).alias("complementary"),
    )


def from_transition(rows: DataFrame) -> DataFrame:
    """Inverse of ``to_transition``."""
    return rows.select(
        "observation.*", "action", F.col("reward").alias("next.reward"), F.col("done").alias("next.done"),
        F.col("truncated").alias("next.truncated"), "complementary.*")


def add_domain_id(frames: DataFrame, mapping: dict[str, int] | int, by: str | None = None, default: int = 0, out: str = "domain_id") -> DataFrame:
    """A constant id, or the id of the value of ``by`` with a default."""
    if isinstance(mapping, int):
        return frames.withColumn(out, F.lit(mapping))
    value = F.lit(default)
    for key, number in mapping.items():
        value = F.when(F.col(by) == key, number).otherwise(value)
    return frames.withColumn(out, value)


def row_callable(fn: Callable, kind: str, columns: Sequence[str]) -> Column:
    """A Python ``fn(row, episode_index, frame_index)`` as a vectorized column; rows arrive in Arrow batches."""

    @F.pandas_udf(kind)
    def apply(rows: pd.DataFrame, episode: pd.Series, frame: pd.Series) -> pd.Series:
        records = rows.to_dict("records")
        return pd.Series([fn(r, e, f) for r, e, f in zip(records, episode, frame)])

    return apply(F.struct(*[named(c).alias(c) for c in columns]), F.col("episode_index"), F.col("frame_index"))


def add_features(frames: DataFrame, features: dict[str, tuple[object, dict]]) -> DataFrame:
    """New columns ``{name: (source, {"dtype", "shape"})}``.

    A source is a Column, a DataFrame with ``index`` and the named column, or a callable
    ``(row, episode_index, frame_index)``. Names must be new.
    """
    from kinetable.model import schema_from_features

    for name, (source, spec) in features.items():
        if name in frames.columns:
            raise ValueError(f"feature {name!r} exists already")
        if "dtype" not in spec or "shape" not in spec:
            raise ValueError(f"feature {name!r} needs a dtype and a shape")
        kind = schema_from_features({name: spec})[0].dataType.simpleString()
        if isinstance(source, Column):
            frames = frames.withColumn(name, source.cast(kind))
        elif isinstance(source, DataFrame):
            frames = frames.join(source.select("index", F.col(name).cast(kind).alias(name)), "index")
        else:
            frames = frames.withColumn(name, row_callable(source, kind, frames.columns))
    return frames


def remove_features(frames: DataFrame, names: Sequence[str], stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Drop columns and their statistics; the mandatory columns stay."""
    held = [n for n in names if n in MANDATORY]
    if held:
        raise ValueError(f"mandatory columns cannot be removed: {held}")
    missing = [n for n in names if n not in frames.columns]
    if missing:
        raise ValueError(f"no such features: {missing}")
    return frames.drop(*names), None if stats is None else stats.filter(~F.col("feature").isin(*names))


def modify_features(frames: DataFrame, add: dict | None = None, remove: Sequence[str] = ()) -> DataFrame:
    """Add and remove columns in one plan."""
    out = add_features(frames, add) if add else frames
    return remove_features(out, remove)[0] if remove else out
