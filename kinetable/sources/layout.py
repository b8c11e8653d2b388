"""Reading and writing a dataset directory.

``data/`` holds the frames, ``meta/episodes/`` the episode rows, ``meta/tasks.parquet`` and
``meta/subtasks.parquet`` the texts, ``meta/info.json`` and ``meta/stats.json`` the descriptor and
statistics. Frames and episodes are read from ``chunk-*/file-*.parquet`` files or from
directories partitioned by chunk and file.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.plans.frames import EpisodicDataset, episode_offsets
from kinetable.operators.stats import merge_stats, tall_to_stats
from kinetable.plans.segments import SEG, broadcast_rows, note_bound, running, segment_of, spread_join
from kinetable.session import materialize

IN_LIST = 1000
# Path templates of the stored files.
DATA_PATH = "data/chunk-%03d/file-%03d.parquet"
DATA_PARTITION = "data/chunk_index=%d/file_index=%d"
VIDEO_PATH = "videos/%s/chunk-%03d/file-%03d.mp4"


def read_frames(spark: SparkSession, path: str, schema: T.StructType | None = None, episodes: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Frames under ``path``; a short episode list is pushed into the scan, a table semi-joined."""
    reader = spark.read.option("recursiveFileLookup", "false")
    frames = (reader.schema(schema) if schema is not None else reader).parquet(path)
    if episodes is None:
        return frames
    if isinstance(episodes, DataFrame):
        return frames.join(episodes.select("episode_index").distinct(), "episode_index", "left_semi")
    if len(episodes) <= IN_LIST:
        return frames.filter(F.col("episode_index").isin([int(e) for e in episodes]))
    wanted = spark.createDataFrame([(int(e),) for e in set(episodes)], "episode_index bigint")
    return frames.join(wanted, "episode_index", "left_semi")


FEW_SPLITS = 4


def spread_splits(df: DataFrame) -> DataFrame:
    """Spread an input of at most four splits over the cores; any larger input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= min(FEW_SPLITS, cores // 2) else df


def without_stats(episodes: DataFrame) -> DataFrame:
    """Episode rows without the ``stats/...`` columns, which the scan then never reads."""
    return episodes.select(*[F.col(f"`{c}`") for c in episodes.columns if not c.startswith("stats/")])


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    return without_stats(spark.read.parquet(path))


def read_tasks(spark: SparkSession, path: str, text: str = "task", number: str = "task_index") -> DataFrame:
    """Task or subtask texts and ids; the text may be stored as an unnamed index column."""
    rows = spark.read.parquet(path)
    if text not in rows.columns and "__index_level_0__" in rows.columns:
        rows = rows.withColumnRenamed("__index_level_0__", text)
    return rows.select(text, F.col(number).cast("bigint").alias(number))


def write_tasks(tasks: DataFrame, path: str) -> None:
    tasks.write.mode("overwrite").parquet(path)


def read_info(spark: SparkSession, path: str) -> dict:
    """The descriptor: one small JSON file."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_info(spark: SparkSession, info: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def new_info(version: str, fps: float, features: dict, robot_type: str | None = None, chunk_size: int = 1000, data_mb: int = 100, video_mb: int = 200) -> dict:
    """Descriptor of an empty dataset."""
    return {
        "codebase_version": version, "robot_type": robot_type, "total_episodes": 0, "total_frames": 0, "total_tasks": 0,
        "chunks_size": chunk_size, "data_files_size_in_mb": data_mb, "video_files_size_in_mb": video_mb, "fps": fps, "splits": {},
        "data_path": "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet",
        "video_path": "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4" if any(f["dtype"] == "video" for f in features.values()) else None,
        "features": {k: {**v, "shape": list(v["shape"])} for k, v in features.items()},
    }


def describe(frames: DataFrame, fps: float | None = None) -> DataFrame:
    """One row: frames, episodes, tasks, rate, features, and the split over all episodes."""
    per_pair = frames.groupBy("episode_index", "task").agg(F.count(F.lit(1)).alias("n"))
    out = per_pair.agg(F.sum("n").alias("total_frames"), F.countDistinct("episode_index").alias("total_episodes"), F.countDistinct("task").alias("total_tasks"))
    out = out.withColumn("splits", F.concat(F.lit("0:"), F.col("total_episodes").cast("string")))
    out = out.withColumn("features", F.lit(",".join(sorted(frames.columns))))
    return out if fps is None else out.withColumn("fps", F.lit(float(fps)))


def data_path(chunk: Column, file: Column) -> Column:
    return F.format_string(DATA_PATH, chunk, file)


def video_path(key: str, chunk: Column, file: Column) -> Column:
    return F.format_string(VIDEO_PATH, F.lit(key), chunk, file)


def files_for_episodes(episodes: DataFrame, wanted: DataFrame | None = None, video_key: str | None = None, *, partitioned: bool = False) -> DataFrame:
    """Distinct files that hold the wanted episodes; ``partitioned`` names the folders that ``write_dataset`` makes."""
    rows = episodes if wanted is None else episodes.join(wanted.select("episode_index").distinct(), "episode_index", "left_semi")
    place = (F.col("chunk_index"), F.col("file_index"))
    data = F.format_string(DATA_PARTITION, *place) if partitioned else data_path(*place)
    return rows.select((data if video_key is None else video_path(video_key, *place)).alias("path")).distinct()


def append_episodes(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing episode rows and new ones that continue their numbers, offsets and files."""
    tail = existing.agg(
        (F.max("episode_index") + 1).alias("_e"), F.max("dataset_to_index").alias("_i"), (F.max("file_index") + 1).alias("_f"))
    placed = episode_offsets(fresh, "length", "dataset_from_index", "dataset_to_index").crossJoin(tail)  # one row
    placed = placed.withColumns({
        "episode_index": F.col("episode_index") + F.coalesce("_e", F.lit(0)), "dataset_from_index": F.col("dataset_from_index") + F.coalesce("_i", F.lit(0)),
        "dataset_to_index": F.col("dataset_to_index") + F.coalesce("_i", F.lit(0)), "file_index": F.coalesce("_f", F.lit(0).cast("bigint")),
    }).drop("_e", "_i", "_f")
    return existing.unionByName(placed, allowMissingColumns=True)


def write_frames(frames: DataFrame, placed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Frames into their episodes' files: ``placed`` has ``episode_index, length, chunk_index, file_index``.

    Rows are spread by file and segment, so a file of one huge episode is written by many tasks.
    """
    slim = placed.select("episode_index", F.col("length").alias("_length"), "chunk_index", "file_index")
    rows = spread_join(frames, slim, "episode_index", "frame_index", "_length").drop("_length")
    rows = rows.withMetadata("frame_index", {}).withMetadata("index", {})  # later appends may hold longer episodes
    rows = rows.withColumn(SEG, segment_of(rows, "frame_index"))
    rows = rows.repartition("chunk_index", "file_index", SEG).sortWithinPartitions("chunk_index", "file_index", "index").drop(SEG)
    rows.write.mode(mode).partitionBy("chunk_index", "file_index").parquet(path)


def write_dataset(dataset: EpisodicDataset, root: str, mode: str = "overwrite") -> None:
    """All tables of a dataset whose episodes have chunk and file numbers."""
    write_frames(dataset.frames, dataset.episodes, f"{root}/data", mode)
    dataset.episodes.write.mode(mode).parquet(f"{root}/meta/episodes")
    if dataset.tasks is not None:
        write_tasks(dataset.tasks, f"{root}/meta/tasks.parquet")
    if dataset.subtasks is not None:
        write_tasks(dataset.subtasks, f"{root}/meta/subtasks.parquet")
    if dataset.stats is not None:
        dataset.stats.write.mode("overwrite").parquet(f"{root}/meta/stats.parquet")


def noted(frames: DataFrame, episodes: DataFrame) -> EpisodicDataset:
    """Frames and episodes with the group sizes the episode rows tell, which pick the window plans."""
    longest, total, count = episodes.agg(F.max("length"), F.sum("length"), F.count(F.lit(1))).first()
    frames = note_bound(note_bound(frames, "frame_index", longest), "index", total)
    return EpisodicDataset(frames, note_bound(episodes, "episode_index", count))


def read_dataset(spark: SparkSession, root: str, episodes: Sequence[int] | DataFrame | None = None) -> EpisodicDataset:
    """A dataset written by ``write_dataset``, or those of its episodes that are asked for.

    The episode rows tell the files of the episodes, and only those are read: a list of episodes
    becomes a filter on the file numbers, a table (``episode_index``) prunes them when the query runs.
    Episodes keep their numbers; unknown ones are passed over.
    """
    frames, rows = spark.read.parquet(f"{root}/data"), read_episodes(spark, f"{root}/meta/episodes")
    if episodes is not None and not isinstance(episodes, DataFrame) and len(episodes) > IN_LIST:
        episodes = spark.createDataFrame([(int(e),) for e in set(episodes)], "episode_index bigint")
    if isinstance(episodes, DataFrame):
        rows = materialize(rows.join(episodes.select("episode_index").distinct(), "episode_index", "left_semi"))
        frames = _frames_in_files(frames, rows)
        frames = spread_join(frames, rows.select("episode_index", F.col("length").alias("_length")), "episode_index", "frame_index", "_length").drop("_length")
    elif episodes is not None:
        chosen = F.col("episode_index").isin([int(e) for e in episodes])
        rows = rows.filter(chosen)
        places: dict[int, list[int]] = {}
        for chunk, file in rows.select("chunk_index", "file_index").distinct().collect():  # at most one for each listed episode
            places.setdefault(chunk, []).append(file)
        held = F.lit(False)
        for chunk, files in sorted(places.items()):
            held = held | ((F.col("chunk_index") == chunk) & F.col("file_index").isin(sorted(files)))
        frames = frames.filter(held & chosen)
    dataset = noted(frames.drop("chunk_index", "file_index"), rows)
    dataset.tasks = read_tasks(spark, f"{root}/meta/tasks.parquet")
    return dataset


def _frames_in_files(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """Frames of the files that hold the episode rows. The files' numbers prune the scan while they are few enough to be broadcast."""
    # The comparison marks the numbers as a selection, which the planner asks for before it prunes by them.
    places = rows.select("chunk_index", "file_index").filter(F.col("file_index") >= 0).distinct()
    if places.limit(broadcast_rows(frames) + 1).count() > broadcast_rows(frames):
        return frames
    return frames.join(F.broadcast(places), ["chunk_index", "file_index"], "left_semi")


def read_stored_dataset(spark: SparkSession, root: str) -> EpisodicDataset:
    """A dataset stored as numbered files under ``chunk-*`` directories."""
    frames = read_frames(spark, f"{root}/data/chunk-*/file-*.parquet")
    dataset = noted(frames, read_episodes(spark, f"{root}/meta/episodes/chunk-*/file-*.parquet"))
    dataset.tasks = read_tasks(spark, f"{root}/meta/tasks.parquet")
    return dataset


def write_stats_json(stats: DataFrame, path: str) -> None:
    """Rows ``(feature, dim, stat, value)`` as one nested JSON object, vectors in dimension order."""
    vectors = stats.groupBy("feature", "stat").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("e"))
    per_stat = vectors.select("feature", F.struct("stat", F.col("e.value").alias("v")).alias("s"))
    per_feature = per_stat.groupBy("feature").agg(F.map_from_entries(F.collect_list("s")).alias("stats"))
    whole = per_feature.agg(F.map_from_entries(F.collect_list(F.struct("feature", "stats"))).alias("m"))  # one entry per feature
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested ``{feature: {stat: vector}}`` JSON to rows ``(feature, dim, stat, value)``."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "map<string,map<string,string>>")
    rows = text.select(F.explode(nested).alias("feature", "stats")).select("feature", F.explode("stats").alias("stat", "v"))
    flat = F.regexp_replace("v", r"[\[\]\s]", "")
    return rows.select("feature", "stat", F.posexplode(F.split(flat, ",")).alias("dim", "x")).select("feature", "dim", "stat", F.col("x").cast("double").alias("value"))


def compact_legacy(spark: SparkSession, root: str) -> EpisodicDataset:
    """One file per episode with JSON-lines metadata to the consolidated tables.

    ``meta/episodes.jsonl`` has ``episode_index, tasks, length``, ``meta/tasks.jsonl`` has
    ``task_index, task``; offsets follow from the lengths. Where they are stored, the episodes'
    statistics (``meta/episodes_stats.jsonl``) are merged and ``meta/info.json`` becomes the
    descriptor, as one row with a variant.
    """
    listed = spark.read.schema("episode_index bigint, tasks array<string>, length bigint").json(f"{root}/meta/episodes.jsonl")
    tasks = spark.read.schema("task_index bigint, task string").json(f"{root}/meta/tasks.jsonl")
    # Files of any depth: chunk-000/episode_000000.parquet has no key=value folders to infer from.
    frames = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
    episodes = episode_offsets(listed)
    frames = spread_join(frames, episodes.select("episode_index", F.col("length").alias("_length"), "dataset_from_index"), "episode_index", "frame_index", "_length")
    frames = frames.withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).drop("dataset_from_index", "_length")
    stored = {p for p in ("episodes_stats.jsonl", "info.json") if _exists(spark, f"{root}/meta/{p}")}
    stats = merge_stats(read_legacy_stats(spark, f"{root}/meta/episodes_stats.jsonl"), derived=True) if "episodes_stats.jsonl" in stored else None
    info = read_info_row(spark, f"{root}/meta/info.json") if "info.json" in stored else None
    return EpisodicDataset(frames, episodes, tasks, None, stats, info)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_info_row(spark: SparkSession, path: str) -> DataFrame:
    """The descriptor as one row ``info``, a variant, so that fields of any shape are kept."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("info"))


def read_legacy_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of episodes, one JSON object a line, as rows ``(episode_index, feature, dim, count, min, max, mean, std)``.

    ``stats`` maps a feature to its statistics, each a vector or, of images, vectors in vectors, which are
    numbered in order; ``count`` is one number for the whole feature.
    """
    lines = spark.read.text(path).select(F.parse_json("value").alias("v"))
    number = F.try_variant_get("v", "$.episode_index", "bigint").alias("episode_index")
    features = lines.select(number, F.explode(F.try_variant_get("v", "$.stats", "map<string,variant>")).alias("feature", "s"))
    each = features.select("episode_index", "feature", F.explode(F.try_variant_get("s", "$", "map<string,variant>")).alias("stat", "x"))
    flat = F.split(F.regexp_replace(F.to_json("x"), r"[\[\]\s]", ""), ",")
    rows = each.select("episode_index", "feature", "stat", F.posexplode(flat).alias("dim", "t"))
    rows = rows.select("episode_index", "feature", "dim", "stat", F.col("t").try_cast("double").alias("value"))
    counts = rows.filter("stat = 'count'").groupBy("episode_index", "feature").agg(F.max("value").cast("bigint").alias("count"))
    wide = tall_to_stats(rows.filter("stat <> 'count'"), ["episode_index"], ("min", "max", "mean", "std"))
    return wide.join(counts, ["episode_index", "feature"]).select("episode_index", "feature", "dim", "count", "min", "max", "mean", "std")


def resume_shards(expected: DataFrame, completed: DataFrame, key: str, valid: Column) -> DataFrame:
    """Shards still to do: those without a valid completed entry."""
    return expected.join(completed.filter(valid).select(key).distinct(), key, "left_anti")


SHARD_ENTRIES = "_shards"  # a name that readers of the data pass over


def write_shards(rows: DataFrame, shard: str, path: str) -> None:
    """Write the shards at hand, each replacing only its own earlier output, so a retry is harmless.

    When all are written, each gets an entry with its rows and fingerprint as they are read back. A
    writer that dies before that leaves shards without one, which count as torn (``completed_shards``).
    """
    ids = materialize(rows.select(shard).distinct())
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(shard).parquet(path)
    written = rows.sparkSession.read.parquet(path)
    written = written.withColumn(shard, F.col(shard).cast(rows.schema[shard].dataType)).join(ids, shard, "left_semi")
    shard_entries(written, shard).write.mode("append").parquet(f"{path}/{SHARD_ENTRIES}")


def shard_entries(rows: DataFrame, shard: str) -> DataFrame:
    """``(shard, rows, fingerprint)``: the number of rows of each shard and the sum of their hashes, in any order of rows."""
    columns = sorted(c for c, kind in rows.dtypes if c != shard and "map<" not in kind and "variant" not in kind)
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")
    return rows.groupBy(shard).agg(F.count(F.lit(1)).alias("rows"), F.sum(mixed).alias("fingerprint"))


def completed_shards(spark: SparkSession, path: str, shard: str) -> DataFrame:
    """Shards that were written whole, and their rows: what is read now is what an entry says."""
    if not _exists(spark, f"{path}/{SHARD_ENTRIES}"):
        return shard_entries(spark.read.parquet(path), shard).filter(F.lit(False)).drop("fingerprint") if _exists(spark, path) else spark.createDataFrame([], f"{shard} bigint, rows bigint")
    entries = spark.read.parquet(f"{path}/{SHARD_ENTRIES}").distinct()
    return shard_entries(spark.read.parquet(path), shard).join(entries, [shard, "rows", "fingerprint"], "left_semi").drop("fingerprint")


def collect_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Union of the CSV result tables under a directory, columns matched by the names in each file's header.

    A file without one of the columns has null there; its other columns are passed over.
    """
    wanted = spark.createDataFrame([], schema).schema
    reader = spark.read.option("header", "true").option("recursiveFileLookup", "true")
    # The header of each file is its first line; files with the same header are read together.
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("at", "n")).alias("header"))
    headers = first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()  # one name a file, as the reader lists them
    parts = []
    for header, files in headers:
        table = reader.csv(sorted(unquote(f) for f in files))
        by_name = {c.strip(): c for c in table.columns}
        parts.append(table.select(*[
            (F.col(f"`{by_name[f.name]}`") if f.name in by_name else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def segment_times(episodes: DataFrame, fps: float, keys: Sequence[str] = ("chunk_index", "file_index")) -> DataFrame:
    """Where each episode starts and ends, in seconds, inside its media file."""
    out = running(episodes, list(keys), "episode_index", {"to_timestamp": ("sum", F.col("length") / F.lit(float(fps)))})
    return out.withColumn("from_timestamp", F.col("to_timestamp") - F.col("length") / F.lit(float(fps)))
