"""Windows that survive a hot episode.

A window partitioned by episode sends one episode to one task. Frames carry a dense
position, so an episode is cut into segments of a fixed number of positions and every
window partitions by ``(episode, segment)``:

* a look-back / look-ahead of bounded reach copies the rows near a cut into the
  neighbouring segment (``bounded``);
* a running value adds the carry of the earlier segments, which is a window over one
  row per segment (``running``).

``number_rows`` makes the dense position in the first place, and notes the size of the largest
group in the metadata of the position column. Where that size is at most one segment, the
operators plan an ordinary window or join, which is then bounded already. The note only picks
the plan: results do not depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from kinetable.functions.names import named
from kinetable.session import materialize, setting

SEG = "_segment"
_OWN = "_own"
SEGMENT_ROWS = 65_536
MAX_GROUP_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
GROUP_ROWS = "groupRows"


def segment_rows(df: DataFrame) -> int:
    return setting(df.sparkSession, "segmentRows", SEGMENT_ROWS)


def max_group_rows(df: DataFrame) -> int:
    return setting(df.sparkSession, "maxGroupRows", MAX_GROUP_ROWS)


def broadcast_rows(df: DataFrame) -> int:
    return setting(df.sparkSession, "broadcastRows", BROADCAST_ROWS)


def group_bound(df: DataFrame, *positions: str) -> int | None:
    """Largest group size noted on any of the position columns."""
    noted = [df.schema[p].metadata.get(GROUP_ROWS) for p in positions if p in df.columns]
    noted = [n for n in noted if n is not None]
    return min(noted) if noted else None


def note_bound(df: DataFrame, position: str, rows: int | None) -> DataFrame:
    return df if rows is None else df.withMetadata(position, {GROUP_ROWS: int(rows)})


def in_one_segment(df: DataFrame, position: str | Column) -> bool:
    """Whether every group is known to fit one segment."""
    known = group_bound(df, position) if isinstance(position, str) else None
    return known is not None and known <= segment_rows(df)


def segment_of(df: DataFrame, pos: str | Column) -> Column:
    position = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(position / F.lit(segment_rows(df))).cast("bigint")


def bounded(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    back: int,
    ahead: int,
    build: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Add window columns that look at most ``back`` rows behind and ``ahead`` rows ahead.

    ``pos`` is dense from 0 inside ``keys``. Inside the window handed to ``build`` every
    row of the segment finds its neighbours up to the reach, or the true end of the group.
    """
    if in_one_segment(df, pos):
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(pos)))
    size = segment_rows(df)
    first = F.floor(F.greatest(F.lit(0), F.col(pos) - ahead) / size)
    last = F.floor((F.col(pos) + back) / size)
    spread = df.withColumn(SEG, F.explode(F.sequence(first, last)))
    spread = spread.withColumn(_OWN, F.col(SEG) == segment_of(df, pos))
    window = Window.partitionBy(*keys, SEG).orderBy(pos)
    return spread.withColumns(build(window)).filter(_OWN).drop(SEG, _OWN)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str | Column,
    values: dict[str, tuple[str, Column]],
    *,
    following: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Add running values from the start of each group to the current row.

    ``values`` maps a new column to ``(kind, column)`` with kind one of ``sum``, ``max``,
    ``min`` and ``last`` (latest non-null). ``following`` runs from the end instead;
    ``strict`` leaves the current row out.
    """
    if in_one_segment(df, pos):
        order = F.col(pos).desc() if following else F.col(pos).asc()
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        return df.withColumns({name: _fold(kind, column, whole) for name, (kind, column) in values.items()})
    position = F.col(pos) if isinstance(pos, str) else pos
    source = df.withColumn("_run_at", position).withColumn(SEG, segment_of(df, F.col("_run_at")))
    source = source.withColumns({f"_in_{n}": c for n, (_, c) in values.items()})
    rank = F.col("_run_at") if following else -F.col("_run_at")
    totals = []
    for name, (kind, _) in values.items():
        value = F.col(f"_in_{name}")
        if kind == "last":
            total = F.max_by(value, F.when(value.isNotNull(), -rank))
        else:
            total = getattr(F, kind)(value)
        totals.append(total.alias(f"_carry_{name}"))
    by_segment = F.col(SEG).desc() if following else F.col(SEG).asc()
    earlier = Window.partitionBy(*keys).orderBy(by_segment).rowsBetween(Window.unboundedPreceding, -1)
    carries = source.groupBy(*keys, SEG).agg(*totals)
    carries = carries.select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)],
        F.col(SEG).alias("_k_seg"),
        *[_fold(kind, F.col(f"_carry_{n}"), earlier).alias(f"_carry_{n}") for n, (kind, _) in values.items()],
    )
    match = F.col(SEG) == F.col("_k_seg")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{i}"))
    joined = source.join(carries, match, "left")
    order = F.col("_run_at").desc() if following else F.col("_run_at").asc()
    here = Window.partitionBy(*keys, SEG).orderBy(order)
    here = here.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    out = {}
    for name, (kind, _) in values.items():
        local, carry = _fold(kind, F.col(f"_in_{name}"), here), F.col(f"_carry_{name}")
        if kind == "sum":
            both = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
            out[name] = F.when(local.isNull() & carry.isNull(), None).otherwise(both)
        elif kind == "max":
            out[name] = F.greatest(local, carry)
        elif kind == "min":
            out[name] = F.least(local, carry)
        else:
            out[name] = F.coalesce(local, carry)
    helpers = ["_run_at", SEG, "_k_seg", *[f"_k_{i}" for i in range(len(keys))]]
    helpers += [f"{p}_{n}" for n in values for p in ("_in", "_carry")]
    return joined.withColumns(out).drop(*[h for h in helpers if h not in out])


#: Decimal digits to which what is left of an earlier row may fade before it is left out.
FADED_DIGITS = 40


def decaying(df: DataFrame, keys: Sequence[str], pos: str, term: Column, keep: float, out: str) -> DataFrame:
    """Add the linear recurrence ``y = keep * y before + term``, y before the first row being 0; 0 < keep < 1.

    Rows go through a task in order and y is carried from one to the next in just these two steps,
    so values on a rounding tie stay there. A null term adds nothing; y is null before the first term.
    A segment starts as many rows early as it takes a row to fade to 1e-40, twice, so the rows are moved
    once. Where that would outgrow a segment, the maps of the blocks are chained.
    """
    wanted = math.ceil(FADED_DIGITS / -math.log10(keep))
    whole = in_one_segment(df, pos)
    if not whole and 2 * wanted > segment_rows(df):
        return _chained(df, keys, pos, term, keep, out, min(wanted, segment_rows(df)))
    rows = df.withColumn("_term", term.cast("double"))
    if whole:
        spread, parts = rows.withColumn(_OWN, F.lit(True)), [*keys]
    else:
        ahead = F.floor((F.col(pos) + 2 * wanted) / segment_rows(df))
        spread = rows.withColumn(SEG, F.explode(F.sequence(segment_of(df, pos), ahead))).withColumn(_OWN, F.col(SEG) == segment_of(df, pos))
        parts = [*keys, SEG]
    # The first row of a part is marked by a window, which finds the rows placed and sorted as it needs them.
    spread = spread.withColumn("_starts", F.row_number().over(Window.partitionBy(*parts).orderBy(pos)) == 1)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = None
        for batch in batches:
            ys = []
            for starts, x in zip(batch.column(n - 1).to_pylist(), batch.column(n).to_pylist()):
                if starts:
                    y = x
                elif x is not None:
                    y = x if y is None else x + keep * y
                elif y is not None:
                    y = keep * y
                ys.append(y)
            made = pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(ys, pa.float64())], [*kept, out])
            yield made.filter(batch.column(n - 2))

    kept = [c for c in df.columns if c != out]
    n = len(kept) + 2
    numbered = spread.select(*[named(c).alias(f"_{i}") for i, c in enumerate(kept)], _OWN, "_starts", "_term")  # names with dots cannot be handed over
    placed = numbered.mapInArrow(carried, StructType([*[StructField(c, df.schema[c].dataType) for c in kept], StructField(out, DoubleType())]))
    return placed.select(*[named(c).alias(c, metadata=df.schema[c].metadata) for c in kept], named(out))


def _chained(df: DataFrame, keys: Sequence[str], pos: str, term: Column, keep: float, out: str, size: int) -> DataFrame:
    """``decaying`` with one row per block chained in order: the map of a block is ``y -> keep**size * y + its sum``."""
    rows = df.withColumns({"_block": F.floor(F.col(pos) / size), "_term": term.cast("double")})
    rows = rows.withColumn("_w", F.pow(F.lit(keep), F.col(pos) - F.col("_block") * size))
    block = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_z", F.sum(F.col("_term") / F.col("_w")).over(block) * F.col("_w"))
    ends = rows.groupBy(*keys, "_block").agg(F.max_by("_z", pos).alias("_end"))
    fade = keep**size

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        state, states = 0.0, []
        for end in pdf["_end"]:
            states.append(state)
            state = end + fade * state
        return pdf.assign(_carry=states).drop(columns="_end")

    schema = StructType([*[df.schema[k] for k in keys], StructField("_block", LongType()), StructField("_carry", DoubleType())])
    carry = ends.groupBy(*keys).applyInPandas(chain, schema)
    joined = null_safe_join(rows, carry, [*keys, "_block"])
    return joined.withColumn(out, F.col("_z") + F.col("_w") * keep * F.col("_carry")).drop("_block", "_term", "_w", "_z", "_carry")


def _fold(kind: str, column: Column, window: WindowSpec) -> Column:
    if kind == "last":
        return F.last(column, ignorenulls=True).over(window)
    if kind in ("sum", "max", "min"):
        return getattr(F, kind)(column).over(window)
    raise ValueError(f"unknown running kind {kind!r}")


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int, int]:
    """Rows of the largest group, rows in all, and number of groups; one job over the keys."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    biggest, total, groups = sizes.agg(F.max("n"), F.sum("n"), F.count("n")).first()
    return biggest or 0, total or 0, groups or 0


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, *,
    at_most: int | None = None, total: int | None = None, derived: bool = False, sums: dict[str, str] | None = None,
) -> DataFrame:
    """Add the 0-based position of each row inside ``keys`` under ``order`` (a total order).

    When every group is small a window does it. Otherwise rows are range-partitioned by
    key and order, so a hot group spreads over many tasks, and each row's place in its
    partition is shifted by the rows of the same group in earlier partitions.

    ``at_most`` is a known bound on the group size and saves the job that measures it; ``total``
    is the number of rows in all, if known, and sets the number of ranges.
    ``derived`` marks a small result of a large plan: it is written once, then measured.
    ``sums`` maps new columns to columns summed up to and including each row.
    """
    limit = max_group_rows(df)
    if at_most is not None:
        biggest = at_most
    else:
        df = materialize(df) if derived else df
        biggest, total, _ = group_sizes(df, keys)
    if biggest <= limit:
        window = Window.partitionBy(*keys).orderBy(*order)
        so_far = window.rowsBetween(Window.unboundedPreceding, 0)
        columns = {out: F.row_number().over(window).cast("bigint") - 1}
        columns |= {name: F.sum(column).over(so_far) for name, column in (sums or {}).items()}
        return note_bound(df.withColumns(columns), out, biggest)
    numbered = note_bound(_number_by_range(df, keys, order, out, -(-(total or 1) // limit)), out, biggest)
    if sums:
        numbered = running(numbered, keys, out, {name: ("sum", F.col(column)) for name, column in sums.items()})
    return numbered


def _number_by_range(df: DataFrame, keys, order, out: str, parts: int) -> DataFrame:
    parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # The id is partition << 33 | row; the checkpoint freezes it against recomputation.
    placed = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    runs = placed.groupBy("_part", *keys).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_rp"),
        *[F.col(k).alias(f"_rk_{i}") for i, k in enumerate(keys)],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    match = F.col("_part") == F.col("_rp")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_rk_{i}"))
    numbered = placed.join(runs, match).withColumn(out, F.col("_place") + F.col("_shift"))
    return numbered.drop("_place", "_part", "_rp", "_shift", *[f"_rk_{i}" for i in range(len(keys))])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null matching null; the left keys stay."""
    renamed = {key: f"_right_{i}" for i, key in enumerate(keys)}
    match = F.lit(True)
    for key, name in renamed.items():
        match = match & F.col(key).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(renamed), match, how).drop(*renamed.values())


def spread_join(frames: DataFrame, groups: DataFrame, key: str, pos: str, length: str, how: str = "inner") -> DataFrame:
    """Join one row per group to its frames, cut by segment so that a hot group is split.

    ``groups`` has one row per ``key`` with its ``length``; it is repeated once per segment,
    which is one row per ``segment_rows`` frames. When ``key`` is an episode number whose noted
    range is small, the groups are few and are broadcast.
    """
    few = group_bound(groups, key)
    if few is not None and few <= broadcast_rows(frames):
        return null_safe_join(frames, F.broadcast(groups), [key], how)
    if in_one_segment(frames, pos):
        return null_safe_join(frames, groups, [key], how)
    size = segment_rows(frames)
    last = F.floor(F.greatest(F.col(length) - 1, F.lit(0)) / size)
    pieces = groups.withColumn(SEG, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return null_safe_join(frames.withColumn(SEG, segment_of(frames, pos)), pieces, [key, SEG], how).drop(SEG)


def salted_join(facts: DataFrame, small: DataFrame, keys: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Join a keyed table to facts with hot keys: the keyed side is repeated once per salt.

    Rows without a dense position use this; a frame table uses ``spread_join``.
    """
    mixable = [name for name, kind in facts.dtypes if "map<" not in kind]
    mixed = facts.withColumn("_salt", F.pmod(F.xxhash64(*mixable), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return mixed.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_small(
    facts: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", *, at_most: int | None = None, derived: bool = False
) -> DataFrame:
    """Join a keyed table that is expected to be small without moving the facts.

    Its rows are counted, unless ``at_most`` bounds them; ``derived`` marks the result of a large
    plan, which is written once before it is counted. Up to ``broadcast_rows`` it is broadcast,
    beyond that the join is salted.
    """
    if at_most is None:
        small = materialize(small) if derived else small
        at_most = small.count()
    if at_most <= broadcast_rows(facts):
        return facts.join(F.broadcast(small), list(keys), how)
    return salted_join(facts, small, keys, how=how)
