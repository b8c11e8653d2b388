"""Stateful operators over live frames; each equals its batch twin on the whole input.

Rows of one source arrive in order: no batch holds a row older than an earlier batch. State is kept
by Spark in its state store, one small value or a short list a source, so the streams need the
RocksDB store (``rocksdb_state``). A task sorts the rows of one source in one batch, so bound the
batch with the trigger options of the source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kinetable.functions.names import named
from kinetable.operators import stats as S
from kinetable.operators.validate import drop_nan_rows
from kinetable.plans.segments import number_rows, running, segment_rows

POS = "_pos"


def _plain(value):
    """A value of a pandas row as the state store takes it."""
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    return None if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value) else value


def _whole(rows: Iterator[pd.DataFrame], columns: Sequence[str]) -> pd.DataFrame:
    """The rows of a key in one frame, with their column names, which computed columns do not keep on the way."""
    return pd.concat([pdf.iloc[:, : len(columns)].set_axis(columns, axis=1) for pdf in rows], ignore_index=True)


def _keyed(stream: DataFrame, keys: Sequence[str], *more: Column) -> GroupedData:
    """Groups by a text of the keys, in which null is a key like any other."""
    key = F.to_json(F.struct(*[named(k).alias(f"k{i}") for i, k in enumerate(keys)], *more))
    return stream.withColumn("_key", key).groupBy("_key")


def _as_text(stream: DataFrame, read: Sequence[str]) -> tuple[DataFrame, dict[str, T.DataType]]:
    """Whole numbers that a processor does not read as text, as pandas rounds those beside nulls; and their types."""
    kinds = {f.name: f.dataType for f in stream.schema.fields if isinstance(f.dataType, T.IntegralType) and f.name not in read}
    return stream.withColumns({n: named(n).cast("string") for n in kinds}), kinds


def _typed(rows: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    return rows.withColumns({n: named(n).cast(kind) for n, kind in kinds.items()})


class InOrder(StatefulProcessor):
    """Works on the rows of one source in order, with one value that it keeps from batch to batch.

    ``work`` takes the rows and the kept value, None at the start, and gives the output and the value
    to keep. ``state`` is the value's schema and ``read`` are the columns it reads beside the order.
    Whole numbers among those are exact up to 2^53 where a batch holds nulls.
    """

    state = ""
    read: tuple[str, ...] = ()
    columns: list[str] = []

    def __init__(self, order: Sequence[str]) -> None:
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", self.state)

    def work(self, pdf: pd.DataFrame, kept: tuple | None) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _whole(rows, self.columns).sort_values(self.order, kind="stable", na_position="first", ignore_index=True)
        out, kept = self.work(pdf, tuple(self.kept.get()) if self.kept.exists() else None)
        self.kept.update(tuple(_plain(v) for v in kept))
        yield out

    def close(self) -> None:
        pass


def _processed(stream: DataFrame, keys: Sequence[str], processor: InOrder, added: str = "", *, dropped: Sequence[str] = ()) -> DataFrame:
    """Rows of each key through a processor that adds columns and leaves out others."""
    processor.columns = stream.columns
    stream, kinds = _as_text(stream, [*keys, *processor.order, *processor.read])
    fields = [f for f in stream.schema.fields if f.name not in dropped] + (T._parse_datatype_string(added).fields if added else [])
    out = _keyed(stream, keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType(fields), outputMode="Append", timeMode="None")
    return _typed(out, kinds)


class Assemble(InOrder):
    state = "next_episode bigint, next_frame bigint"

    def work(self, pdf, kept):
        episode, frame = kept or (0, 0)
        end = pdf.pop("_end").to_numpy(bool)
        place = np.arange(len(pdf))
        number = np.cumsum(end) - end  # ends before the row
        starts = np.r_[0, np.flatnonzero(end) + 1][number]
        pdf["episode_no"] = episode + number
        pdf["frame_index"] = place - starts + np.where(number == 0, frame, 0)
        return pdf, (episode + int(end.sum()), 0 if end[-1] else int(pdf["frame_index"].iloc[-1]) + 1)


def assemble_episodes(stream: DataFrame, source: str, order: Sequence[str], end: Column) -> DataFrame:
    """Number live frames: ``episode_no`` and ``frame_index`` per source; an end flag closes the episode."""
    flagged = stream.withColumn("_end", F.coalesce(end, F.lit(False)))
    return _processed(flagged, [source], Assemble(order), "episode_no bigint, frame_index bigint", dropped=["_end"])


def latest(stream: DataFrame, source: str, step: str, columns: Sequence[str]) -> DataFrame:
    """The newest item of each source; write the changed sources of a batch with ``batches.update``."""
    return stream.groupBy(source).agg(F.max_by(F.struct(*columns), step).alias("latest"))


#: Parts of a key whose last rows are found apart.
RETAIN_SALTS = 32


def retain_last_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], capacity: int) -> DataFrame:
    """The last ``capacity`` rows of each key (of all rows without keys), in ``order``.

    Each key is dealt to parts, of which only the last rows go on, before the shuffle as well as after
    it, so a hot key costs no more than ``capacity`` rows a part. A capacity beyond a segment is
    counted over numbered rows instead.
    """
    if capacity <= segment_rows(rows):
        back = [F.col(c).desc() for c in order]
        part = F.pmod(F.xxhash64(*order), F.lit(RETAIN_SALTS))
        last = rows.withColumn("_salt", part)
        for group in ([*keys, "_salt"], list(keys)):
            last = last.withColumn("_back", F.row_number().over(Window.partitionBy(*group).orderBy(*back))).filter(F.col("_back") <= capacity)
        return last.drop("_salt", "_back")
    placed = number_rows(rows, keys, order, POS)
    if keys:
        sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        placed = placed.join(sizes, [*keys])
    else:
        placed = placed.crossJoin(placed.agg(F.count(F.lit(1)).alias("_n")))  # one row
    return placed.filter(F.col(POS) >= F.col("_n") - capacity).drop(POS, "_n")


class Ring(StatefulProcessor):
    """The last rows of a part of a key, kept as a list."""

    def __init__(self, schema: str, columns: Sequence[str], order: Sequence[str], capacity: int) -> None:
        self.schema, self.columns, self.order, self.capacity = schema, list(columns), list(order), capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for pdf in rows:  # at most the capacity and one Arrow batch at once
            held += [tuple(map(_plain, r)) for r in _whole([pdf], self.columns).astype(object).itertuples(index=False, name=None)]
            held = self._last(held)
        self.rows.put(held)
        yield pd.DataFrame({"kept": [len(held)]})

    def _last(self, held: list[tuple]) -> list[tuple]:
        at = [self.columns.index(c) for c in self.order]
        return sorted(held, key=lambda r: [(r[i] is not None, r[i]) for i in at])[-self.capacity :]

    def close(self) -> None:
        pass


def retain_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], capacity: int) -> DataFrame:
    """Keep the last ``capacity`` rows of each key (of all rows without keys) in the state store.

    A key is dealt to parts that keep ``capacity`` rows each, so a hot key, or no key at all, is not one
    task. The stream tells how many rows the touched parts hold; ``retained`` reads the rows.
    """
    stream, _ = _as_text(stream, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    salt = F.pmod(F.xxhash64(*order), F.lit(RETAIN_SALTS)).alias("salt")
    return _keyed(stream, keys, salt).transformWithStateInPandas(
        statefulProcessor=Ring(schema, stream.columns, order, capacity), outputStructType="kept bigint", outputMode="Append", timeMode="None")


def retained(spark: SparkSession, checkpoint: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], capacity: int) -> DataFrame:
    """The rows that ``retain_stream`` keeps of a stream of ``schema``, read from the state of its checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint).select("list_element.*")
    return retain_last_n(_typed(rows, {f.name: f.dataType for f in schema.fields}), keys, order, capacity)


def drop_late_actions(rows: DataFrame, source: str, pos: str, step: str, executed: str) -> DataFrame:
    """Actions whose step is not past the latest executed one known when they arrive."""
    known = running(rows, [source], pos, {"_latest": ("max", F.col(executed))})
    return known.filter(F.coalesce(F.col(step) > F.col("_latest"), F.lit(True))).drop("_latest")


class DropLate(InOrder):
    state = "latest bigint"

    def __init__(self, order: Sequence[str], step: str, executed: str) -> None:
        super().__init__(order)
        self.step, self.executed, self.read = step, executed, (step, executed)

    def work(self, pdf, kept):
        told = pdf[self.executed].fillna(-1).to_numpy(np.int64)
        known = np.maximum.accumulate(np.r_[kept[0] if kept else -1, told])[1:]
        step = pdf[self.step]
        return pdf[(step.notna() & (step.fillna(0).to_numpy(np.int64) > known)).to_numpy()], (known[-1],)


def drop_late_stream(stream: DataFrame, source: str, order: Sequence[str], step: str, executed: str) -> DataFrame:
    """``drop_late_actions`` on a stream; actions without a step go."""
    return _processed(stream, [source], DropLate(order, step, executed))


class Velocity(InOrder):
    state = "last_value double, seen bigint"

    def __init__(self, order: Sequence[str], value: str, dt: float, steps: int) -> None:
        super().__init__(order)
        self.value, self.dt, self.steps, self.read = value, dt, steps, (value,)

    def work(self, pdf, kept):
        last, seen = kept or (None, 0)
        value = pdf[self.value].to_numpy(float)
        before = np.r_[np.nan if last is None else last, value[:-1]]
        speed = (value - np.where(np.isnan(before), value, before)) / self.dt
        pdf["velocity"] = pd.Series(speed).astype(object).where(~np.isnan(speed), None)
        pdf["truncated"] = seen + np.arange(1, len(pdf) + 1) >= self.steps
        return pdf, (value[-1], seen + len(pdf))


def velocity_and_limit(stream: DataFrame, source: str, order: Sequence[str], value: str, dt: float, steps: int) -> DataFrame:
    """Add ``velocity`` (0 at the start) and ``truncated`` (once the step count reaches ``steps``)."""
    return _processed(stream, [source], Velocity(order, value, dt, steps), "velocity double, truncated boolean")


def route_interventions(stream: DataFrame, vectors: Sequence[str], intervening: Column) -> DataFrame:
    """NaN rows go; every other row lands in the online table, intervened ones in the offline table too."""
    tables = F.when(intervening, F.array(F.lit("online"), F.lit("offline"))).otherwise(F.array(F.lit("online")))
    return drop_nan_rows(stream, vectors).withColumn("table", F.explode(tables))


def stream_stats(stream: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, extremes, mean and deviation of each feature and dimension over all batches; a running aggregate."""
    value = F.col("value")
    return S.to_series(stream, [], features).groupBy("feature", "dim").agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


class Latency(InOrder):
    state = "recent array<double>, top double"

    def __init__(self, order: Sequence[str], latency: str, size: int, quantiles: dict[str, float]) -> None:
        super().__init__(order)
        self.latency, self.size, self.quantiles, self.read = latency, size, quantiles, (latency,)

    def _recent(self, values: np.ndarray, first: int) -> dict[str, np.ndarray]:
        """Window quantiles of the values from place ``first`` on."""
        inner = {n: max(q, 0.0) for n, q in self.quantiles.items() if q < 1}
        out = {n: np.empty(len(values) - first) for n in inner}
        short = min(len(values), self.size - 1)
        for at in range(first, short):
            for n, q in inner.items():
                out[n][at - first] = np.quantile(values[: at + 1], q)
        step = max(1, (1 << 21) // self.size)
        for low in range(max(first, short), len(values), step):
            high = min(len(values), low + step)
            view = np.lib.stride_tricks.sliding_window_view(values[low - self.size + 1 : high], self.size)
            for n, q in inner.items():
                out[n][low - first : high - first] = np.quantile(view, q, axis=1)
        return out

    def work(self, pdf, kept):
        recent, top = kept or ([], -np.inf)
        values = np.r_[np.asarray(recent, float), pdf[self.latency].to_numpy(float)]
        first = len(values) - len(pdf)
        tops = np.maximum.accumulate(np.r_[top, values[first:]])[1:]
        found = self._recent(values, first)
        for name, q in self.quantiles.items():
            pdf[name] = tops if q >= 1 else found[name]
        pdf["window_rows"] = np.minimum(np.arange(first, len(values)) + 1, self.size)
        pdf["latency_max"] = tops
        return pdf, (values[max(0, len(values) - self.size + 1) :], tops[-1])


def stream_latency(stream: DataFrame, source: str, order: Sequence[str], latency: str, size: int, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles over the last ``size`` latencies and the all-time maximum; negatives are dropped.

    A quantile of 1 or more is the maximum, of 0 or less the window minimum. The state is the last latencies.
    """
    added = ", ".join([*[f"`{n}` double" for n in quantiles], "window_rows bigint", "latency_max double"])
    return _processed(stream.filter(F.col(latency) >= 0), [source], Latency(order, latency, size, quantiles), added)


class Fps(InOrder):
    state = "t0 double, seen bigint"

    def __init__(self, order: Sequence[str], time: str, per_second: float) -> None:
        super().__init__(order)
        self.time, self.per_second, self.read = time, per_second, (time,)

    def work(self, pdf, kept):
        t0, seen = kept or (float(pdf[self.time].iloc[0]), 0)
        spent = (pdf[self.time].to_numpy(float) - t0) / self.per_second
        before = seen + np.arange(len(pdf))
        pdf["achieved_fps"] = np.where(spent > 1e-6, before / np.where(spent > 1e-6, spent, 1.0), 0.0)
        return pdf, (t0, seen + len(pdf))


def stream_fps(stream: DataFrame, source: str, order: Sequence[str], time: str, per_second: float = 1.0) -> DataFrame:
    """Add ``achieved_fps`` since the first row of the source; ``time`` counts ``per_second`` units a second."""
    return _processed(stream, [source], Fps(order, time, per_second), "achieved_fps double")


class Windows(InOrder):
    """Delta windows of one episode: the state is the frames that wait and the look-back they need."""

    def __init__(self, deltas: dict[str, Sequence[int]], schema: str, pad: str) -> None:
        super().__init__(["frame_index"])
        self.deltas, self.schema, self.pad = deltas, schema, pad
        every = [d for offsets in deltas.values() for d in offsets]
        self.back, self.ahead = max(0, -min(every)), max(0, max(every))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getListState("frames", self.schema)

    def _from(self, at: np.ndarray, offsets: Sequence[int], count: int) -> tuple[np.ndarray, np.ndarray]:
        """For each frame and offset the place whose value is taken, and whether it stands in for a missing one."""
        places = at[:, None] + np.asarray(offsets)[None, :]
        missing = (places < 0) | (places >= count)
        if self.pad == "clamp":
            return np.clip(places, 0, count - 1), missing
        for side in (sorted((d for d in offsets if d < 0), reverse=True), sorted(d for d in offsets if d > 0)):
            before = at
            for d in side:
                k = list(offsets).index(d)
                before = np.where(missing[:, k], before, places[:, k])
                places[:, [i for i, o in enumerate(offsets) if o == d]] = before[:, None]
        return places, missing

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = _whole(rows, self.columns)
        held = [tuple(r) for r in self.frames.get()] if self.frames.exists() else []
        pdf = pd.DataFrame(held, columns=[*self.columns, "_sent"]).astype(object)
        pdf = pd.concat([pdf, fresh.assign(_sent=False).astype(object)], ignore_index=True).sort_values("frame_index", kind="stable", ignore_index=True)
        number, sent = pdf["frame_index"].to_numpy(np.int64), pdf["_sent"].to_numpy(bool)
        closed = any(v is True or v == 1 for v in map(_plain, pdf["is_last"]))
        ready = closed | (number + self.ahead <= number[-1])
        at = np.flatnonzero(ready & ~sent)
        out = pdf.loc[at, self.columns].reset_index(drop=True)
        for name, offsets in self.deltas.items():
            places, missing = self._from(at, offsets, len(pdf))
            values = [_plain(v) for v in pdf[name]]
            out[f"{name}_window"] = [[values[i] for i in row] for row in places.tolist()]
            out[f"{name}_is_pad"] = missing.tolist()
        pdf["_sent"] = sent | ready
        left = pdf[(number > number[-1] - self.ahead - self.back) & (not closed)]
        if len(left):
            self.frames.put([tuple(map(_plain, r)) for r in left.itertuples(index=False, name=None)])
        else:
            self.frames.clear()
        yield out


def read_frames_stream(stream: DataFrame, deltas: dict[str, Sequence[int]], pad: str = "last_valid") -> DataFrame:
    """Delta windows over a live frame stream, each frame once its look-ahead is there.

    A frame is ready when the frame ``ahead`` places later has come, or its episode has closed:
    ``is_last`` marks the last frame, after which an episode's state is empty.
    """
    if pad not in ("clamp", "last_valid"):
        raise ValueError(f"unknown pad {pad!r}")
    stream, kinds = _as_text(stream, ["episode_index", "frame_index"])
    held = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join([*[f"`{n}` {k}" for n, k in held.items()], "_sent boolean"])
    added = ", ".join(f"`{n}_window` array<{held[n]}>, `{n}_is_pad` array<boolean>" for n in deltas)
    out = _processed(stream, ["episode_index"], Windows(deltas, schema, pad), added)
    return _typed(out, kinds | {f"{n}_window": T.ArrayType(kinds[n]) for n in deltas if n in kinds})


class Gate(StatefulProcessor):
    """Per source: pass an observation unless its step was passed before or it is too close to the last one passed.

    A decision depends on the one before it, so a source is one ordered sequence; its rows of
    a batch are sorted in Arrow and only the accepted step numbers and vector are kept. With ``time`` and
    ``remember`` a step number is forgotten once the source's rows are that much later than the row
    that passed it, whatever the batches are, so the state of a source stays bounded.
    """

    def __init__(self, vector: str, step: str, order: Sequence[str], must_go: str, tolerance: float, time: str | None = None, remember: int | None = None) -> None:
        self.vector, self.step, self.order, self.must_go, self.tolerance = vector, step, list(order), must_go, tolerance
        self.time, self.remember = time, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "v array<double>")
        self.seen = handle.getMapState("seen", "step bigint", "at bigint")

    def _remembered(self, step: int, now: int) -> bool:
        if not self.seen.containsKey((step,)):
            return False
        return self.remember is None or now - self.seen.getValue((step,))[0] <= self.remember

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order)
        last = np.asarray(self.last.get()[0]) if self.last.exists() else None
        passed = []
        times = pdf[self.time] if self.time else [0] * len(pdf)
        for vector, step, forced, now in zip(pdf[self.vector], pdf[self.step], pdf[self.must_go], times):
            vector = np.asarray(vector, dtype=float)
            ok = bool(forced) or last is None
            if not ok and np.linalg.norm(vector - last) >= self.tolerance:  # the state is asked, a call each, only for rows far enough
                ok = not self._remembered(int(step), int(now))
            if ok:
                last = vector
                self.seen.updateValue((int(step),), (int(now),))
            passed.append(ok)
        if last is not None:
            self.last.update((last.tolist(),))
        if self.remember is not None and len(pdf):
            gone = [step for step, at in self.seen.iterator() if int(now) - at[0] > self.remember]
            for step in gone:
                self.seen.removeKey(step)
        yield pdf[passed]

    def close(self) -> None:
        pass


def stream_gate(
    stream: DataFrame, source: str, vector: str, step: str, order: Sequence[str], must_go: str, tolerance: float = 1.0, *,
    time: str | None = None, remember: int | None = None,
) -> DataFrame:
    """Observations worth processing; needs the RocksDB state store, which the caller sets (``rocksdb_state``).

    ``remember``, in units of the whole numbers in ``time``, bounds the state: older passed step numbers
    are forgotten. None keeps them for good.
    """
    if remember is not None and time is None:
        raise ValueError("remember needs a time column")
    gate = Gate(vector, step, order, must_go, tolerance, time, remember)
    return stream.groupBy(source).transformWithStateInPandas(
        statefulProcessor=gate, outputStructType=stream.schema, outputMode="Append", timeMode="None")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB; the session's setting is put back afterwards."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)
