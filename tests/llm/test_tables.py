"""Row keys, the anti join in all its sizes, and steps that remove their tables."""

import os

import pytest
from pyspark.sql import functions as F

from kinetable.llm import bloom, tables


@pytest.mark.parametrize("limit,way", [(8 << 20, "BroadcastHashJoin"), (20_000, "Union"), (200, "SortMergeJoin")])
def test_unlisted_in_every_size(llm_spark, monkeypatch, limit, way):
    """A broadcast list, its filter with an exact join of the rest, and a plain join give the same rows."""
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", limit)
    rows = llm_spark.range(5000).select((F.col("id") % 2500).alias("key"), F.lit("wide text").alias("text"), F.lit(1).alias("_w0"))
    rows = rows.drop("_w0").unionByName(llm_spark.createDataFrame([(None, "bare")], "key long, text string"))
    listed = llm_spark.range(0, 3000, 3).withColumnRenamed("id", "key")
    llm_spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = bloom.unlisted(rows, "key", listed)
        assert way in out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["key"] is None, r["key"] or 0) for r in out.collect())
    finally:
        llm_spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.columns == ["key", "text"]
    assert got == sorted([(False, k % 2500) for k in range(5000) if k % 2500 % 3] + [(True, 0)])


def test_row_keys_repeat(llm_spark, tmp_path):
    llm_spark.range(1000).select((F.col("id") % 7).alias("doc_id"), F.lit("same").alias("text")).repartition(5).write.parquet(str(tmp_path / "t"))
    read = llm_spark.read.parquet(str(tmp_path / "t"))
    keyed = tables.row_keyed(read, "k")
    assert keyed.columns == ["doc_id", "text", "k"] and keyed.select("k").distinct().count() == 1000
    first = {tuple(r) for r in keyed.select("k", "doc_id").collect()}
    llm_spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        again = tables.row_keyed(llm_spark.read.parquet(str(tmp_path / "t")), "k")
        assert {tuple(r) for r in again.select("k", "doc_id").collect()} == first
    finally:
        llm_spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made = tables.row_keyed(llm_spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string"), "k")
    assert made.select("k").distinct().count() == 3
    assert tables.row_keyed(llm_spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_steps_remove_their_tables(llm_spark):
    def folder(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    outside = folder(tables.stored(llm_spark.range(5), "outside"))
    with tables.step(llm_spark):
        inside = folder(tables.stored(llm_spark.range(5), "inside"))
    result = folder(tables.stored(llm_spark.range(5), "result"))
    assert all(map(os.path.isdir, (outside, inside, result)))
    with pytest.raises(ZeroDivisionError), tables.step(llm_spark):
        later = folder(tables.stored(llm_spark.range(5), "later"))
        raise ZeroDivisionError
    assert not os.path.exists(inside) and all(map(os.path.isdir, (outside, result, later)))
    with tables.step(llm_spark):
        pass
    assert not os.path.exists(later) and os.path.isdir(outside)
