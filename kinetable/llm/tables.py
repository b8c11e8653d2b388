"""Tables between the steps of an operator, and connected components."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetable.session import scratch_path

#: Spark's own option: a query's shuffle files go when it has ended, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bits of a row key that say the row's place in its file.
ROW_BITS = 40
_made = threading.local()

#: Links in a file between the steps of ``components``, about.
LINKS_PER_FILE = 200_000


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that start here leave no shuffle files; the session's setting is put back afterwards."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there.

    Nothing reads the shuffles of that query again, so they are removed with it.
    """
    path = scratch_path(df.sparkSession, label)
    schema = df.schema
    if getattr(_made, "noting", False):
        _made.paths.append(path)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads again, once what was made of it has been written too."""
    spark = table.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """A step of a chain: removes the tables that ``stored`` wrote in the step before, in this thread.

    The result of the step before must have been written by then. A step without work ends a chain.
    """
    for path in getattr(_made, "paths", []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.paths, _made.noting = [], True
    try:
        yield
    finally:
        _made.noting = False


def row_keyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a number of its own for each row, the same whenever the rows are read again.

    Rows read from files are numbered by file and place in it, so nothing is written. Files are
    numbered in a table of one row each, which is no longer than the list that a read has anyway.
    Other rows are written with a number.
    """
    try:
        at = df.withColumns({"_in_file": F.col("_metadata.file_path"), "_at_row": F.col("_metadata.row_index")})
    except AnalysisException:  # not rows of files
        return stored(df.withColumn(key, F.monotonically_increasing_id()), "keyed")
    files = df.select(F.col("_metadata.file_path").alias("_in_file")).distinct()
    files = stored(files.withColumn("_file", F.row_number().over(Window.orderBy("_in_file")).cast("long")), "files")
    numbered = at.join(F.broadcast(files), "_in_file")
    return numbered.withColumn(key, F.shiftleft("_file", ROW_BITS) + F.col("_at_row")).select(*df.columns, key)


def small_enough(df: DataFrame, row_bytes: int, limit: int = 8 << 20) -> bool:
    """Whether the table is proven to stay under ``limit`` bytes, counting at most the rows that fit."""
    most = limit // max(1, row_bytes)
    return df.limit(most + 1).count() <= most


def nonempty(spark: SparkSession, df: DataFrame) -> bool:
    return not df.isEmpty()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every node on a link; the component is its smallest node.

    Alternating large-star and small-star steps: every step sends each node's larger, then smaller
    neighbours to its smallest one, so the links become stars after about log(n) steps. No step
    holds a component in one task: the minimum has map-side partials and the links are joined.
    Each step's links are written to the shared folder.
    """
    x, y = F.col(left), F.col(right)
    edges = stored(
        links.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").where(F.col("v") != F.col("m"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A step makes no more links than it had, so few links need few files.
        edges = stored(moved.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(-(-mark[0] // LINKS_PER_FILE)), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    with shuffles_removed(edges.sparkSession):
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
