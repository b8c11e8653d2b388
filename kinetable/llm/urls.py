"""URL rules: a blocked Bloom filter, then an exact hash join.

A rule is a host and the start of a path. A url asks for each suffix of its host, with the start
of its path cut to each length that the rules have, whether a rule lists it: exactly the rules
that fit have one of these strings as their text. The strings go through a blocked Bloom filter
of the rules (one block of eight 32-bit words per string, one bit in each word), and those that
pass are joined exactly. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm.bloom import KEYS_PER_BLOCK, bloom_blocks, passes
from kinetable.llm.tables import small_enough

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://`` and for null."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table: verdict, host and path; the key is host followed by path."""
    return spark.createDataFrame([(v, h + p, p) for v, h, p in rules], "verdict string, key string, path string")


def judge(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", *, otherwise: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has verdict, key (host and path put together) and path. A rule fits its host and all
    subdomains when the url's path starts with the rule's; the longest key wins. Where none fits,
    rule is null and the verdict ``otherwise``. A null or empty url, or one without ``://``, has an
    empty host and path, which no rule fits. Repeated rows stay; an empty table of pages gives an
    empty one, an empty table of rules fits nothing. Other columns of ``pages`` are not read.

    Distinct pairs of host and path are judged, so a host that holds a third of the pages is
    reduced before anything is joined. The filter and the rules are broadcast when their size is
    proven small, and joined by a shuffle otherwise.
    """
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    count = max(1, rules.count())
    blocks = -(-count // KEYS_PER_BLOCK)
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # at most the longest path's length
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None)]), lambda p: p.isNotNull()))
    places = split.select("host", "path").distinct()
    keys = places.withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(starts))
    keys = keys.select("host", "path", F.concat("suffix", "start").alias("key"))
    table = rules.select("key", "verdict")
    maybe = passes(keys, "key", bloom_blocks(table.select("key").distinct(), "key", blocks), blocks)
    listed = F.broadcast(table) if small_enough(table, 512) else table
    fits = maybe.join(listed, "key").groupBy("host", "path").agg(
        F.max(F.struct(F.length("key").alias("size"), F.col("key").alias("rule"), F.col("verdict").alias("verdict"))).alias("best"))
    fits = fits.select("host", "path", "best.rule", "best.verdict")
    return split.join(fits, ["host", "path"], "left").select(
        F.col("page_id").alias(page_id), "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
