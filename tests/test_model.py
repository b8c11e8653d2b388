"""Feature specifications, steps, edits: errors and small rules."""

import pytest
from pyspark.sql import functions as F

from kinetable import model as M
from kinetable.functions import actions as A
from kinetable.functions import vectors as V
from kinetable.functions.scaling import normalize
from kinetable.functions.text import format_mmss, parse_mmss
from kinetable.operators import edit as I
from kinetable.operators import shape as B
from kinetable.operators import validate as X
from kinetable.operators.progress import stage_progress
from kinetable.plans.frames import EpisodicDataset, line_frames
from kinetable.steps import STEPS, Chain, Step, StepRegistry, observed


def test_schema_round_trip():
    features = {"a": {"dtype": "float32", "shape": (3,), "names": ["x", "y", "z"]}, "b": {"dtype": "int64", "shape": (1,), "names": None},
                "c": {"dtype": "uint8", "shape": (2, 4), "names": None}, "v": {"dtype": "video", "shape": (4, 4, 3), "names": None}}
    schema = M.schema_from_features(features)
    assert schema.simpleString() == "struct<a:array<float>,b:bigint,c:array<array<smallint>>>"
    back = M.features_from_schema(schema)
    assert back["a"] == features["a"] and back["c"]["shape"] == (2, 4)
    with pytest.raises(ValueError):
        M.schema_from_features({"x": {"dtype": "float32", "shape": (1, 2, 3, 4, 5, 6)}})


def test_names_classes_and_merge():
    assert M.bad_feature_names(["a.b", "a/b"]) == ["a/b"]
    kinds = M.classify_features({
        "observation.images.top": {"dtype": "video", "shape": (48, 64, 3), "names": ["height", "width", "channels"]},
        "observation.environment_state": {"dtype": "float32", "shape": (2,)}, "observation.state": {"dtype": "float32", "shape": (6,)},
        "action": {"dtype": "float32", "shape": (6,)}, "index": {"dtype": "int64", "shape": (1,)}})
    assert kinds == {"observation.images.top": ("VISUAL", (3, 48, 64)), "observation.environment_state": ("ENV", (2,)), "observation.state": ("STATE", (6,)), "action": ("ACTION", (6,))}
    one = {"s": {"dtype": "float32", "shape": (2,), "names": ["x", "y"]}}
    two = {"s": {"dtype": "float32", "shape": (2,), "names": ["y", "z"]}, "t": {"dtype": "string", "shape": (1,)}}
    merged = M.merge_feature_specs(one, two)
    assert merged["s"]["names"] == ["x", "y", "z"] and merged["s"]["shape"] == (3,) and "t" in merged
    with pytest.raises(ValueError):
        M.merge_feature_specs(one, {"s": {"dtype": "int64", "shape": (1,), "names": ["q"]}})


def test_versions():
    assert M.check_version("v3.0", "v3.0") is None and "behind" in M.check_version("v3.0", "v3.1")
    with pytest.raises(ValueError):
        M.check_version("v2.1", "v3.0")


def test_registry_and_chain(spark):
    registry = StepRegistry()
    registry.register("double")(lambda column: lambda df: df.withColumn(column, F.col(column) * 2))
    with pytest.raises(ValueError):
        registry.register("double")(None)
    with pytest.raises(KeyError):
        registry.get("nope")
    chain = Chain([Step("double", {"column": "id"}), Step("double", {"column": "id"})], registry=registry)
    seen = []
    chain.before_each(lambda i, df: seen.append(("before", i)))
    hook = lambda i, df: seen.append(("after", i))
    chain.after_each(hook)
    assert [r["id"] for r in chain(spark.range(3)).collect()] == [0, 4, 8]
    assert seen == [("before", 0), ("after", 0), ("before", 1), ("after", 1)]
    chain.remove_hook(hook)
    with pytest.raises(ValueError):
        chain.remove_hook(hook)
    assert len(chain[:1]) == 1 and len(list(chain.step_through(spark.range(1)))) == 3
    assert chain.output_features(spark.range(1)) == {"id": "bigint"}
    registry.unregister("double")
    assert registry.names() == []


def test_saved_chain_rejects_unknown_overrides(spark, tmp_path):
    path = str(tmp_path / "c")
    Chain([Step("time_limit", {"steps": 3})]).save(spark, path)
    assert Chain.load(spark, path).steps[0].config == {"steps": 3}
    for wrong in ({"nope": {}}, {"time_limit": {"nope": 1}}):
        with pytest.raises(KeyError):
            Chain.load(spark, path, wrong)
    assert "normalize" in STEPS.names()


def test_observed_step(spark):
    from pyspark.sql import Observation

    counts = Observation("rows")
    observed(lambda df: df.filter("id > 3"), counts)(spark.range(10)).collect()
    assert counts.get["rows"] == 6


def test_edit_errors(spark, data):
    frames, episodes = line_frames(spark, data)
    dataset = EpisodicDataset(frames, episodes)
    ids = lambda *e: spark.createDataFrame([(x,) for x in e], "episode_index bigint")
    for wrong in (ids(), ids(10**9), episodes):
        with pytest.raises(ValueError):
            I.check_deletion(dataset, wrong)
    I.check_deletion(dataset, ids(0))
    with pytest.raises(ValueError):
        I.split_bounds(10, {"a": 0.8, "b": 0.3})
    assert I.split_bounds(10, {"a": 0.5, "b": 0.01, "c": 0.2}) == {"a": (0, 5), "c": (5, 10)}
    twice = spark.createDataFrame([("a", 0), ("b", 0)], "split string, episode_index bigint")
    for wrong in (twice, spark.createDataFrame([("a", 10**9)], "split string, episode_index bigint")):
        with pytest.raises(ValueError):
            I.split_dataset(dataset, wrong)
    with pytest.raises(ValueError):
        I.modify_tasks(dataset)
    with pytest.raises(ValueError):
        I.concat_common([spark.range(1), spark.createDataFrame([(1,)], "x int")])


def test_feature_edit_errors(spark):
    rows = spark.range(1).withColumn("index", F.lit(0))
    for wrong in ({"id": (F.lit(1), {"dtype": "int64", "shape": (1,)})}, {"new": (F.lit(1), {"dtype": "int64"})}):
        with pytest.raises(ValueError):
            B.add_features(rows, wrong)
    for wrong in (["index"], ["missing"]):
        with pytest.raises(ValueError):
            B.remove_features(rows, wrong)
    with pytest.raises(ValueError):
        normalize(rows, spark.range(1).select(F.array(F.lit(1.0)).alias("id__mean")), {"id": "MEAN_STD"})


def test_validate_shapes(spark):
    rows = spark.createDataFrame([("a", [[1.0, 2.0]], 1), ("b", [[1.0], [2.0, 3.0]], None)], "task string, m array<array<double>>, n bigint")
    spec = {"m": {"dtype": "float64", "shape": (2, 2)}, "n": {"dtype": "int64", "shape": (1,)}, "gone": {"dtype": "string", "shape": (1,)}}
    got = {r["task"]: set(r["errors"]) for r in X.validate_frames(rows, spec).collect()}
    assert got["a"] == {"gone: missing", "m: not of shape (2, 2)"} and got["b"] == {"gone: missing", "m: not of shape (2, 2)", "n: null"}


def test_rotations(spark):
    half = 2**0.5 / 2
    row = spark.range(1).select(
        A.quaternion_to_axis_angle(F.array(*[F.lit(x) for x in (0.0, 0.0, half, half)])).alias("q"),
        A.rot6d_to_axis_angle(F.array(*[F.lit(x) for x in (0.0, 1.0, 0.0, -1.0, 0.0, 0.0)])).alias("r"),
        A.rot6d_to_axis_angle(F.array(*[F.lit(x) for x in (-1.0, 0.0, 0.0, 0.0, -1.0, 0.0)])).alias("turn")).first()
    assert row["q"] == pytest.approx([0, 0, 1.5707963], abs=1e-6) and row["r"] == pytest.approx([0, 0, 1.5707963], abs=1e-5)
    assert [abs(x) for x in row["turn"]] == pytest.approx([0, 0, 3.1415926], abs=1e-5)


def test_small_functions(spark):
    row = spark.range(1).select(
        V.slice_dims(F.array(*[F.lit(float(i)) for i in range(8)]), "0:2,5:7").alias("s"),
        format_mmss(F.lit(6125.9)).alias("long"), parse_mmss(F.lit("102:05")).alias("back"), parse_mmss(F.lit("45")).alias("plain"),
        stage_progress(F.lit(1.5), F.array(F.lit(0.0), F.lit(0.2), F.lit(1.0))).alias("p")).first()
    assert row["s"] == [0.0, 1.0, 5.0, 6.0] and row["long"] == "102:05" and (row["back"], row["plain"]) == (6125, 45) and row["p"] == pytest.approx(0.6)
