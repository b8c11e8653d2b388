"""Queries over task texts, prompts and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, VECTORS, query
from kinetable.functions import text as H
from kinetable.functions.scaling import discretize
from kinetable.plans.frames import event_frames, vector_frames
from kinetable.sources.layout import spread_splits

_WS = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"


def _clean(column):
    return rf"translate(regexp_replace({column}, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '_' || chr(10), '  ')"



def _documents(spark, root):
    return spread_splits(spark.read.parquet(f"{root}/documents.parquet"))


@query("h01_clean_task", f"SELECT doc_id, {_clean('text')} AS task FROM documents")
def clean_task(spark, root):
    return _documents(spark, root).select("doc_id", H.clean_task(F.col("text")).alias("task"))


@query("h02_formalize_task", rf"SELECT doc_id, regexp_replace(lower(CASE WHEN length(text) > 0 THEN text ELSE 'Perform the task.' END), '[^\p{{L}}\p{{N}}{_WS}]', '', 'g') AS task FROM documents")
def formalize_task(spark, root):
    return _documents(spark, root).select("doc_id", H.formalize_task(F.col("text")).alias("task"))


@query("h03_ensure_newline", "SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END AS task FROM documents")
def ensure_newline(spark, root):
    return _documents(spark, root).select("doc_id", H.ensure_newline(F.col("text")).alias("task"))


@query("h04_build_prompt", f"""WITH {VECTORS}, t AS (SELECT label, min(p_name || '_' || p_type) AS task FROM part JOIN (SELECT DISTINCT label FROM embeddings) ON p_partkey % 10 = label GROUP BY 1)
  SELECT vec_id, 'Task: ' || {_clean('task')} || ', State: ' || array_to_string(list_transform(state[1:8], lambda x: least(255, greatest(-1, floor((x + 1) * 128)))::BIGINT), ' ') || ';' || chr(10) || 'Action: ' AS prompt FROM fv JOIN t USING (label)""")
def build_prompt(spark, root):
    frames, _ = vector_frames(spark, root)
    parts = spark.read.parquet(f"{root}/part.parquet")
    tasks = parts.groupBy((F.col("p_partkey") % 10).cast("int").alias("label")).agg(F.min(F.concat_ws("_", "p_name", "p_type")).alias("task"))
    prompt = H.build_prompt(F.col("task"), discretize(F.slice("state", 1, 8)))
    return frames.join(tasks, "label").select("vec_id", prompt.alias("prompt"))


@query("h05_pack_tokens", f"""WITH {VECTORS}, n AS (SELECT vec_id, list_transform(state[1:1 + vec_id % 60], lambda x: least(255, greatest(-1, floor((x + 1) * 128)))::BIGINT) AS t FROM fv),
  p AS (SELECT vec_id, [2, 4022, 235292] || list_transform(t, lambda x: 257152 - 1 - 128 - x) || [235371] AS t FROM n)
  SELECT vec_id, i AS place, coalesce(t[i + 1], 0) AS token, i < len(t) AS mask FROM p CROSS JOIN (SELECT unnest(generate_series(0, 47)) AS i)""")
def pack_tokens(spark, root):
    """The bins of a vector prefix, whose length depends on the vector, as its tokens."""
    frames, _ = vector_frames(spark, root)
    bins = discretize(F.slice("state", F.lit(1), (F.col("vec_id") % 60 + 1).cast("int"))).cast("array<bigint>")
    ids, mask = H.pack_tokens(bins, 2, [4022, 235292], [235371], 257152, 128, 48)
    out = frames.select("vec_id", F.posexplode(F.arrays_zip(ids.alias("t"), mask.alias("m"))).alias("place", "e"))
    return out.select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("e.t").alias("token"), F.col("e.m").alias("mask"))


@query("h06_format_and_parse_mmss", f"""WITH {EVENTS} SELECT "index", lpad((s // 60)::VARCHAR, greatest(2, length((s // 60)::VARCHAR))::INTEGER, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS label, s AS seconds
  FROM (SELECT "index", floor("timestamp")::BIGINT AS s FROM fe)""")
def format_and_parse_mmss(spark, root):
    frames, _ = event_frames(spark, root)
    out = frames.select("index", H.format_mmss(F.col("timestamp")).alias("label"))
    return out.withColumn("seconds", H.parse_mmss(F.col("label")))


@query("h07_path_flag", "SELECT page_id, contains(url, '/fr/') AS flagged FROM pages")
def path_flag(spark, root):
    return spark.read.parquet(f"{root}/pages.parquet").select("page_id", H.path_flag(F.col("url"), "/fr/").alias("flagged"))
