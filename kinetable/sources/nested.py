"""Nested episodes (one row with an array of steps) to frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_nested_episodes(
    episodes: DataFrame, steps: str, meta: Sequence[str] = (), vectors: dict[str, Sequence[str]] | None = None,
    success: Column | None = None, task: str | None = None,
) -> DataFrame:
    """One row per step with the episode's columns repeated.

    ``vectors`` maps a new column to the step fields joined into it, in order. ``success`` is
    an expression over the episode that ends as the reward and done of its last step.
    64-bit floats become 32-bit.
    """
    flagged = episodes.withColumn("_success", F.lit(False) if success is None else success)
    rows = flagged.select(*meta, "_success", F.size(steps).alias("_length"), F.posexplode(steps).alias("frame_index", "_step"))
    fields = rows.schema["_step"].dataType
    out = [F.col(m) for m in meta] + [F.col("frame_index").cast("bigint").alias("frame_index")]
    for field in fields.fields:
        name = "task" if field.name == task else field.name
        out.append(_narrow(F.col(f"_step.`{field.name}`"), field.dataType).alias(name))
    for name, parts in (vectors or {}).items():
        pieces = []
        for part in parts:
            kind = fields[part].dataType
            value = F.col(f"_step.`{part}`")
            pieces.append(_narrow(value, kind) if isinstance(kind, T.ArrayType) else F.array(value.cast("float")))
        out.append(F.concat(*pieces).alias(name))
    last = F.col("frame_index") == F.col("_length") - 1
    out += [
        (F.col("frame_index") == 0).alias("is_first"), last.alias("is_last"), F.col("_success").alias("is_episode_successful"),
        (last & F.col("_success")).alias("done"), (last & F.col("_success")).cast("float").alias("reward"),
    ]
    return rows.select(*out)


def _narrow(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType):
        return value.cast("float")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType):
        return value.cast("array<float>")
    return value
