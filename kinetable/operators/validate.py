"""Checks over rows, episodes and datasets; each returns a report, none raises on data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.names import named
from kinetable.model import MANDATORY, SCALARS, features_from_schema


def _rules(frames: DataFrame, features: dict) -> list[Column]:
    """One message column per rule; null where the rule holds."""
    have = {f.name: f.dataType for f in frames.schema.fields}
    wanted = [n for n in features if n not in MANDATORY]
    rules: list[Column] = []
    if "task" not in have:
        rules.append(F.lit("task: missing"))
    rules += [F.lit(f"{n}: missing") for n in wanted if n not in have]
    rules += [F.lit(f"{n}: not expected") for n in have if n not in features and n != "task"]
    for name in (n for n in wanted if n in have):
        spec, kind, value = features[name], have[name], named(name)
        shape = tuple(spec["shape"])
        if spec["dtype"] == "string":
            rules.append(F.lit(f"{name}: not text") if not isinstance(kind, T.StringType) else F.when(value.isNull(), f"{name}: not text"))
            continue
        if spec["dtype"] in ("image", "video"):
            if isinstance(kind, T.StructType) and {"height", "width", "nChannels"} <= set(kind.names):
                c, h, w = shape
                size = F.struct(value["height"].alias("a"), value["width"].alias("b"), value["nChannels"].alias("c"))
                fits = (size["a"] == h) & (size["b"] == w) & (size["c"] == c)
                rules.append(F.when(~F.coalesce(fits, F.lit(False)), f"{name}: not of shape {shape}"))
            continue
        rank, element = 0, kind
        while isinstance(element, T.ArrayType):
            rank, element = rank + 1, element.elementType
        if element != SCALARS.get(spec["dtype"]):
            rules.append(F.lit(f"{name}: {element.simpleString()} is not {spec['dtype']}"))
        if rank != (0 if shape == (1,) else len(shape)):
            rules.append(F.lit(f"{name}: rank {rank} is not that of {shape}"))
            continue
        rules.append(F.when(value.isNull(), f"{name}: null"))
        rules.append(F.when(~_fits(value, shape[:rank]), f"{name}: not of shape {shape}"))
    return rules


def _fits(value: Column, shape: tuple[int, ...]) -> Column:
    """Whether a nested array has the given size at every level."""
    if not shape:
        return F.lit(True)
    here = F.size(value) == shape[0]
    return here if len(shape) == 1 else here & F.forall(value, lambda inner: _fits(inner, shape[1:]))


def validate_frames(frames: DataFrame, features: dict) -> DataFrame:
    """Add ``errors``: every broken rule of the row against the declared features."""
    return frames.withColumn("errors", F.array_distinct(F.array_compact(F.array(*_rules(frames, features), F.lit(None).cast("string")))))


def validate_episodes(frames: DataFrame, key: str, frame: str, total_episodes: int | None = None) -> DataFrame:
    """Per episode: frames, first, last and distinct positions, and whether they run 0..n-1.

    With ``total_episodes`` the key must also continue the episodes already there.
    """
    per_frame = frames.groupBy(key, frame).agg(F.count(F.lit(1)).alias("_n"))
    out = per_frame.groupBy(key).agg(
        F.sum("_n").alias("frames"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"),
        F.count(F.lit(1)).alias("distinct_frames"))
    good = (F.col("first_frame") == 0) & (F.col("last_frame") == F.col("frames") - 1) & (F.col("distinct_frames") == F.col("frames"))
    if total_episodes is not None:
        good = good & (F.col(key) >= total_episodes)
    return out.withColumn("contiguous", good)


def feature_report(frames: DataFrame) -> DataFrame:
    """Each column's dtype, rank and number of set values, in one pass."""
    features = features_from_schema(frames.schema)
    entries = [
        F.struct(F.lit(n).alias("feature"), F.lit(s["dtype"]).alias("dtype"),
                 F.lit(0 if s["shape"] == (1,) else len(s["shape"])).cast("bigint").alias("rank"), F.count(named(n)).alias("set_values"))
        for n, s in features.items()
    ]
    return frames.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def check_names(names: DataFrame, column: str) -> DataFrame:
    """Distinct feature names and whether each is allowed."""
    return names.select(F.col(column).alias("name")).distinct().withColumn("allowed", ~F.contains("name", F.lit("/")))


def drop_nan_rows(frames: DataFrame, vectors: Sequence[str]) -> DataFrame:
    """Rows without a NaN in any element of the vectors."""
    broken = F.lit(False)
    for name in vectors:
        broken = broken | F.coalesce(F.exists(name, lambda x: F.isnan(x)), F.lit(False))
    return frames.filter(~broken)


def check_mergeable(infos: DataFrame) -> DataFrame:
    """One row: distinct fps, robot types and feature lists over the datasets, and whether each is one."""
    out = infos.agg(
        F.countDistinct("fps").alias("n_fps"), F.countDistinct("robot_type").alias("n_robot_types"), F.countDistinct("features").alias("n_features"))
    return out.withColumn("mergeable", (F.col("n_fps") <= 1) & (F.col("n_robot_types") <= 1) & (F.col("n_features") <= 1))


def check_files(expected: DataFrame, root: str, pattern: str = r"((?:data|videos)/.*)$") -> DataFrame:
    """Expected relative paths that are not under ``root``; only names are listed, no content is read.

    ``pattern`` cuts the relative path out of a listed one.
    """
    listing = expected.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = listing.select(F.regexp_extract("path", pattern, 1).alias("path"))
    return expected.select("path").distinct().join(found, "path", "left_anti")
