"""Named steps, chains of steps, and their saved form.

A step is a function ``DataFrame -> DataFrame``. A chain applies its steps in order and stays
one lazy plan.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


class StepRegistry:
    """Step factories by name."""

    def __init__(self) -> None:
        self._factories: dict[str, Callable[..., Transform]] = {}

    def register(self, name: str):
        def add(factory):
            if name in self._factories:
                raise ValueError(f"step {name!r} is registered already")
            self._factories[name] = factory
            return factory

        return add

    def get(self, name: str) -> Callable[..., Transform]:
        if name not in self._factories:
            raise KeyError(f"no step {name!r}; known: {self.names()}")
        return self._factories[name]

    def unregister(self, name: str) -> None:
        self._factories.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._factories)

    def clear(self) -> None:
        self._factories.clear()


STEPS = StepRegistry()


@dataclass
class Step:
    """A factory name with its settings; ``state`` holds tables the step needs, such as statistics."""

    name: str
    config: dict = field(default_factory=dict)
    state: dict[str, DataFrame] = field(default_factory=dict)

    def build(self, registry: StepRegistry = STEPS) -> Transform:
        return registry.get(self.name)(**self.config, **self.state)


class Chain:
    """Ordered steps over a frame table."""

    def __init__(self, steps: Sequence[Step], name: str = "chain", registry: StepRegistry = STEPS) -> None:
        self.steps, self.name, self.registry = list(steps), name, registry
        self._before: list[Callable[[int, DataFrame], None]] = []
        self._after: list[Callable[[int, DataFrame], None]] = []

    def __call__(self, frames: DataFrame) -> DataFrame:
        for frames in self.step_through(frames):
            pass
        return frames

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, key):
        return Chain(self.steps[key], self.name, self.registry) if isinstance(key, slice) else self.steps[key]

    def step_through(self, frames: DataFrame) -> Iterator[DataFrame]:
        """The table before the first step and after each one."""
        yield frames
        for i, step in enumerate(self.steps):
            for hook in self._before:
                hook(i, frames)
            frames = frames.transform(step.build(self.registry))
            for hook in self._after:
                hook(i, frames)
            yield frames

    def before_each(self, hook: Callable[[int, DataFrame], None]) -> None:
        self._before.append(hook)

    def after_each(self, hook: Callable[[int, DataFrame], None]) -> None:
        self._after.append(hook)

    def remove_hook(self, hook) -> None:
        for hooks in (self._before, self._after):
            if hook in hooks:
                hooks.remove(hook)
                return
        raise ValueError("hook is not registered")

    def output_features(self, frames: DataFrame) -> dict[str, str]:
        """Columns and types after the chain; no data is read."""
        return dict(self(frames).dtypes)

    # --- saved form ----------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        """A JSON list of steps, and each state table as parquet beside it."""
        spec = []
        for i, step in enumerate(self.steps):
            for key, table in step.state.items():
                table.write.mode("overwrite").parquet(f"{path}/state/{i}-{key}")
            spec.append({"name": step.name, "config": step.config, "state": sorted(step.state)})
        rows = [(json.dumps({"name": self.name, "steps": spec}),)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/chain")

    @classmethod
    def load(cls, spark: SparkSession, path: str, overrides: dict[str, dict] | None = None, registry: StepRegistry = STEPS) -> Chain:
        """The saved chain; ``overrides`` maps a step name to settings or state that replace saved ones."""
        spec = json.loads(spark.read.text(f"{path}/chain").first()[0])
        unused = set(overrides or {}) - {s["name"] for s in spec["steps"]}
        if unused:
            raise KeyError(f"overrides for steps that are not in the chain: {sorted(unused)}")
        steps = []
        for i, entry in enumerate(spec["steps"]):
            state = {k: spark.read.parquet(f"{path}/state/{i}-{k}") for k in entry["state"]}
            config = dict(entry["config"])
            accepted = inspect.signature(registry.get(entry["name"])).parameters
            for key, value in (overrides or {}).get(entry["name"], {}).items():
                if key not in accepted:
                    raise KeyError(f"step {entry['name']!r} has no setting {key!r}")
                if isinstance(value, DataFrame):
                    state[key] = value
                else:
                    config[key] = value
            steps.append(Step(entry["name"], config, state))
        return cls(steps, spec["name"], registry)


def observed(step: Transform, metrics: Observation) -> Transform:
    """The step with its output rows counted while the plan runs, at no extra pass."""
    return lambda frames: step(frames).observe(metrics, F.count(F.lit(1)).alias("rows"))


def on_slot(slot: str, field_name: str | None, fn: Callable[[Column], Column]) -> Transform:
    """Apply a column function to one slot of a transition table, or to one field of a struct slot."""
    if slot not in ("observation", "action", "reward", "done", "truncated", "info", "complementary"):
        raise ValueError(f"unknown slot {slot!r}")

    def apply(rows: DataFrame) -> DataFrame:
        if slot not in rows.columns:
            raise ValueError(f"the table has no slot {slot!r}")
        if field_name is None:
            return rows.withColumn(slot, fn(F.col(slot)))
        return rows.withColumn(slot, F.col(slot).withField(f"`{field_name}`", fn(F.col(slot)[field_name])))

    return apply


# --- the steps of the engine ---------------------------------------------------------


@STEPS.register("rename")
def _rename(names: dict[str, str]) -> Transform:
    return lambda frames: frames.withColumnsRenamed(names)


@STEPS.register("normalize")
def _normalize(modes: dict[str, str], stats: DataFrame, eps: float = 1e-8) -> Transform:
    from kinetable.functions.scaling import normalize

    return lambda frames: normalize(frames, stats, modes, eps=eps)


@STEPS.register("unnormalize")
def _unnormalize(modes: dict[str, str], stats: DataFrame, eps: float = 1e-8) -> Transform:
    from kinetable.functions.scaling import unnormalize

    return lambda frames: unnormalize(frames, stats, modes, eps=eps)


@STEPS.register("joint_velocity")
def _joint_velocity(state: str, dt: float) -> Transform:
    from kinetable.operators.windows import joint_velocity

    return lambda frames: joint_velocity(frames, state, dt)


@STEPS.register("time_limit")
def _time_limit(steps: int) -> Transform:
    from kinetable.operators.windows import time_limit

    return lambda frames: time_limit(frames, steps)


@STEPS.register("pad_vector")
def _pad_vector(column: str, size: int) -> Transform:
    from kinetable.functions.vectors import pad_or_trim

    return lambda frames: frames.withColumn(column, pad_or_trim(F.col(column), size))


@STEPS.register("clean_task")
def _clean_task(column: str = "task") -> Transform:
    from kinetable.functions.text import clean_task

    return lambda frames: frames.withColumn(column, clean_task(F.col(column)))


@STEPS.register("domain_id")
def _domain_id(number: int) -> Transform:
    from kinetable.operators.shape import add_domain_id

    return lambda frames: add_domain_id(frames, number)
