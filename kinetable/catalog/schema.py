"""Queries over schema, projection and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, LINES, VECTORS, query
from kinetable.functions import vectors as V
from kinetable.functions.numbers import tidy
from kinetable.model import classify
from kinetable.operators import shape as B
from kinetable.operators import stats as S
from kinetable.operators import validate as X
from kinetable.plans.frames import event_frames, line_frames, vector_frames

_LKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lines(spark, root):
    return spark.read.parquet(f"{root}/lineitem.parquet")


# Dtypes and ranks of the columns of two tables.
_REPORTED = {"orders": {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "string", "o_totalprice": "float64", "o_orderpriority": "string"},
             "embeddings": {"vec_id": "int64", "embedding": "float32", "label": "int32"}}


def _report_sql(table):
    return " UNION ALL ".join(
        f"SELECT '{table}' AS source, '{c}' AS feature, '{k}' AS dtype, {int(c == 'embedding')}::BIGINT AS rank, count({c}) AS set_values FROM {table}" for c, k in _REPORTED[table].items())


@query("b01_features_from_schema", f"{_report_sql('orders')} UNION ALL {_report_sql('embeddings')}")
def features_from_schema(spark, root):
    parts = []
    for table, columns in _REPORTED.items():
        rows = spark.read.parquet(f"{root}/{table}.parquet").select(*columns)
        parts.append(X.feature_report(rows).select(F.lit(table).alias("source"), "feature", "dtype", "rank", "set_values"))
    return parts[0].unionByName(parts[1])


@query("b02_check_feature_names", "SELECT DISTINCT url AS name, NOT contains(url, '/') AS allowed FROM pages UNION SELECT DISTINCT p_name, NOT contains(p_name, '/') FROM part")
def check_feature_names(spark, root):
    names = spark.read.parquet(f"{root}/pages.parquet").select(F.col("url").alias("n"))
    names = names.unionByName(spark.read.parquet(f"{root}/part.parquet").select(F.col("p_name").alias("n")))
    return X.check_names(names, "n")


@query("b03_pack_vector", f"""SELECT {', '.join(_LKEYS)}, round(l_quantity::FLOAT::DOUBLE, 4) AS s0, round(l_discount::FLOAT::DOUBLE, 8) AS s1, round(l_tax::FLOAT::DOUBLE, 8) AS s2 FROM lineitem""")
def pack_vector(spark, root):
    packed = _lines(spark, root).withColumn("state", V.pack_vector(["l_quantity", "l_discount", "l_tax"]))
    digits = (4, 8, 8)
    return packed.select(*_LKEYS, *[tidy(F.get("state", F.lit(i)), digits[i]).alias(f"s{i}") for i in range(3)])


@query("b04_unpack_vector", f"WITH {VECTORS} SELECT vec_id, d - 1 AS dim, round(state[d], 8) AS value FROM fv CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS d)")
def unpack_vector(spark, root):
    frames, _ = vector_frames(spark, root)
    tall = S.to_series(frames, ["vec_id"], ["state"])
    return tall.select("vec_id", F.col("dim").cast("bigint").alias("dim"), tidy("value", 8).alias("value"))


@query("b04_to_series", f"""WITH {LINES} SELECT episode_index, frame_index, "timestamp", feature, round(value, 6) AS value FROM
  (UNPIVOT (SELECT episode_index, frame_index, "timestamp", l_quantity, l_extendedprice, l_tax FROM fl) ON l_quantity, l_extendedprice, l_tax INTO NAME feature VALUE value)""")
def to_series(spark, root):
    frames, _ = line_frames(spark, root)
    keys = ["episode_index", "frame_index", "timestamp"]
    return S.to_series(frames, keys, ["l_quantity", "l_extendedprice", "l_tax"]).select(*keys, "feature", tidy("value").alias("value"))


@query("b05_classify_features", """SELECT 'observation.state' AS feature, 'STATE' AS class, count(l_quantity) AS set_values FROM lineitem UNION ALL SELECT 'observation.environment_state', 'ENV', count(l_tax) FROM lineitem
  UNION ALL SELECT 'action', 'ACTION', count(l_discount) FROM lineitem UNION ALL SELECT 'task', 'NONE', count(l_returnflag) FROM lineitem""")
def classify_features(spark, root):
    rows = B.rename_features(_lines(spark, root).select("l_quantity", "l_tax", "l_discount", "l_returnflag"), {
        "l_quantity": "observation_state", "l_tax": "observation_environment_state", "l_discount": "action", "l_returnflag": "task"})
    report = X.feature_report(rows)
    named = F.when(F.col("feature") == "observation_state", "observation.state").when(
        F.col("feature") == "observation_environment_state", "observation.environment_state").otherwise(F.col("feature"))
    kinds = {n: classify(n, "float64") or "NONE" for n in ("observation.state", "observation.environment_state", "action", "task")}
    kind = F.lit("NONE")
    for name, label in kinds.items():
        kind = F.when(F.col("feature") == name, label).otherwise(kind)
    return report.withColumn("feature", named).select("feature", kind.alias("class"), "set_values")


_SPEC = {
    "index": {"dtype": "int64", "shape": (1,)}, "episode_index": {"dtype": "int64", "shape": (1,)}, "frame_index": {"dtype": "int64", "shape": (1,)},
    "chunk": {"dtype": "float64", "shape": (4,)}, "value": {"dtype": "float64", "shape": (1,)}, "gap": {"dtype": "float64", "shape": (1,)},
}


@query("b07_validate_frames", f"""WITH {EVENTS}, n AS (SELECT *, least(4, length - frame_index) AS size, lag(value) OVER (PARTITION BY episode_index ORDER BY frame_index) AS gap FROM fe)
  SELECT "index", concat_ws(';', 'user_id: not expected', CASE WHEN size <> 4 THEN 'chunk: not of shape (4,)' END, CASE WHEN gap IS NULL THEN 'gap: null' END) AS errors
  FROM n""")
def validate_frames(spark, root):
    from kinetable.plans.segments import bounded
    from pyspark.sql import Window

    frames, _ = event_frames(spark, root)
    rows = bounded(frames.select("index", "episode_index", "frame_index", "user_id", "task", "value"), ["episode_index"], "frame_index", 1, 3, lambda w: {
        "chunk": F.collect_list("value").over(w.rowsBetween(Window.currentRow, 3)), "gap": F.lag("value", 1).over(w)})
    out = X.validate_frames(rows, _SPEC)
    return out.select("index", F.array_join("errors", ";").alias("errors"))


@query("b08_validate_episodes", """SELECT l_orderkey, count(*) AS frames, min(l_linenumber - 1)::BIGINT AS first_frame, max(l_linenumber - 1)::BIGINT AS last_frame, count(DISTINCT l_linenumber) AS distinct_frames,
  min(l_linenumber - 1) = 0 AND max(l_linenumber - 1) = count(*) - 1 AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1""")
def validate_episodes(spark, root):
    rows = _lines(spark, root).select("l_orderkey", (F.col("l_linenumber") - 1).cast("bigint").alias("frame"))
    return X.validate_episodes(rows, "l_orderkey", "frame")


@query("b09_rename_features", "SELECT l_orderkey AS episode, l_linenumber::BIGINT AS line, l_quantity AS state, l_tax AS action FROM lineitem")
def rename_features(spark, root):
    rows = _lines(spark, root).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity", "l_tax")
    return B.rename_features(rows, {"l_orderkey": "episode", "l_linenumber": "line", "l_quantity": "state", "l_tax": "action"})


@query("b09_rename_stats", """SELECT f AS feature, count(*) AS count, round(avg(v), 7) AS mean FROM (SELECT 'state' AS f, l_quantity AS v FROM lineitem UNION ALL SELECT 'action', l_tax FROM lineitem) GROUP BY 1""")
def rename_stats(spark, root):
    stats = S.feature_stats(S.to_series(_lines(spark, root), [], ["l_quantity", "l_tax"]))
    out = B.rename_stats(stats, {"l_quantity": "state", "l_tax": "action"})
    return out.select("feature", "count", tidy("mean", 7).alias("mean"))


@query("b10_select_features", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS quantity_pos, l_discount AS discount_pos FROM lineitem")
def select_features(spark, root):
    rows = _lines(spark, root).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("l_quantity").alias("observation.state.quantity_pos"),
                                      F.col("l_discount").alias("action.discount_pos"), F.col("l_tax").alias("action.tax_vel"), F.col("l_returnflag").alias("observation.images.top"))
    return B.select_features(rows, [r"_pos$"], images=False, always=["l_orderkey", "l_linenumber"])


@query("b11_to_transition", f"""WITH {EVENTS} SELECT "index", task, value AS action, coalesce(CASE WHEN task <> 'view' THEN value END, 0) AS reward, false AS done, task = 'error' AS truncated, user_id AS who FROM fe""")
def to_transition(spark, root):
    frames, _ = event_frames(spark, root)
    flat = frames.select("index", "task", F.col("user_id").alias("observation.who"), F.col("value").alias("action"),
                         F.when(F.col("task") != "view", F.col("value")).alias("next.reward"), (F.col("task") == "error").alias("next.truncated"))
    rows = B.to_transition(flat)
    return rows.select("complementary.index", "complementary.task", "action", "reward", "done", "truncated", F.col("observation")["observation.who"].alias("who"))


@query("b11_from_transition", f"""WITH {EVENTS} SELECT "index", task, user_id AS "observation.who", value AS action, coalesce(CASE WHEN task <> 'view' THEN value END, 0) AS "next.reward", false AS "next.done", false AS "next.truncated" FROM fe""")
def from_transition(spark, root):
    frames, _ = event_frames(spark, root)
    flat = frames.select("index", "task", F.col("user_id").alias("observation.who"), F.col("value").alias("action"), F.when(F.col("task") != "view", F.col("value")).alias("next.reward"))
    return B.from_transition(B.to_transition(flat))


@query("b12_add_domain_id", f"""SELECT {', '.join(_LKEYS)}, (CASE l_returnflag WHEN 'A' THEN 31 WHEN 'N' THEN 17 ELSE 5 END)::BIGINT AS domain_id, 9::BIGINT AS fixed_id FROM lineitem""")
def add_domain_id(spark, root):
    out = B.add_domain_id(_lines(spark, root), {"A": 31, "N": 17}, by="l_returnflag", default=5)
    out = B.add_domain_id(out, 9, out="fixed_id")
    return out.select(*_LKEYS, F.col("domain_id").cast("bigint").alias("domain_id"), F.col("fixed_id").cast("bigint").alias("fixed_id"))


@query("b13_pad_or_trim_vector", f"""WITH {VECTORS}, s AS (SELECT unnest([40, 80])::BIGINT AS size) SELECT vec_id, size, d AS place, coalesce(round(state[d + 1], 8), 0) AS value, d < 64 AS valid FROM fv CROSS JOIN s, LATERAL (SELECT unnest(generate_series(0, size - 1)) AS d)""")
def pad_or_trim_vector(spark, root):
    frames, _ = vector_frames(spark, root)
    parts = [
        frames.select("vec_id", F.lit(n).alias("size"), F.posexplode(F.arrays_zip(V.pad_or_trim(F.col("state"), n).alias("v"), V.validity_mask(F.col("state"), n).alias("m"))).alias("place", "e"))
        for n in (40, 80)
    ]
    out = parts[0].unionByName(parts[1])
    return out.select("vec_id", F.col("size").cast("bigint").alias("size"), F.col("place").cast("bigint").alias("place"), tidy("e.v", 8).alias("value"), F.col("e.m").alias("valid"))


@query("b14_fit_horizon", f"""WITH {VECTORS}, h AS (SELECT unnest([5, 12])::BIGINT AS steps) SELECT vec_id, steps, step, round(state[least(step, 7) * 8 + 1], 8) AS first_value, round(state[least(step, 7) * 8 + 8], 8) AS last_value
  FROM fv CROSS JOIN h, LATERAL (SELECT unnest(generate_series(0, steps - 1)) AS step)""")
def fit_horizon(spark, root):
    """Each vector of 64 taken as a chunk of 8 steps of 8 values."""
    frames, _ = vector_frames(spark, root)
    chunk = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("state", i * 8 + 1, 8))
    frames = frames.withColumn("chunk", chunk)
    parts = [frames.select("vec_id", F.lit(h).cast("bigint").alias("steps"), F.posexplode(V.fit_horizon(F.col("chunk"), h)).alias("step", "v")) for h in (5, 12)]
    out = parts[0].unionByName(parts[1])
    return out.select("vec_id", "steps", F.col("step").cast("bigint").alias("step"), tidy(F.element_at("v", 1), 8).alias("first_value"), tidy(F.element_at("v", -1), 8).alias("last_value"))


@query("b15_add_features", f"""WITH {EVENTS} SELECT "index", round(value * 2, 6) AS doubled, c_acctbal AS balance, user_id * 1000 + frame_index AS tag FROM fe JOIN customer ON c_custkey = user_id""")
def add_features(spark, root):
    """One column from an expression, one from an aligned table, one from a Python callable."""
    frames, _ = event_frames(spark, root)
    customer = spark.read.parquet(f"{root}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"))
    aligned = frames.select("index", "user_id").join(customer, "user_id").select("index", "balance")
    scalar = {"dtype": "float64", "shape": (1,)}
    out = B.add_features(frames.select("index", "episode_index", "frame_index", "user_id", "value"), {
        "doubled": (F.col("value") * 2, scalar), "balance": (aligned, scalar),
        "tag": (lambda row, episode, frame: row["user_id"] * 1000 + frame, {"dtype": "int64", "shape": (1,)}),
    })
    return out.select("index", tidy("doubled").alias("doubled"), "balance", "tag")


@query("b16_remove_features", f"""SELECT {', '.join(_LKEYS)}, l_quantity FROM lineitem""")
def remove_features(spark, root):
    rows = _lines(spark, root).select(*_LKEYS, "l_quantity", "l_tax", "l_returnflag")
    return B.modify_features(rows, {"extra": (F.col("l_tax") * 2, {"dtype": "float64", "shape": (1,)})}, ["l_tax", "l_returnflag", "extra"])


@query("b18_check_mergeable", """WITH i AS (SELECT o_orderpriority, round(avg(o_totalprice) / 1e7) AS fps, min(o_orderstatus) AS robot_type, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS features FROM orders GROUP BY 1)
  SELECT count(DISTINCT fps) AS n_fps, count(DISTINCT robot_type) AS n_robot_types, count(DISTINCT features) AS n_features, count(DISTINCT fps) <= 1 AND count(DISTINCT robot_type) <= 1 AND count(DISTINCT features) <= 1 AS mergeable FROM i""")
def check_mergeable(spark, root):
    """Each order priority is taken as a dataset of its own."""
    orders = spark.read.parquet(f"{root}/orders.parquet")
    infos = orders.groupBy("o_orderpriority").agg(
        F.round(F.avg("o_totalprice") / 1e7).alias("fps"), F.min("o_orderstatus").alias("robot_type"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("features"))
    return X.check_mergeable(infos)


@query("b19_drop_nan_rows", "SELECT event_id, value FROM events WHERE value >= 50 AND value <> 100")
def drop_nan_rows(spark, root):
    events = spark.read.parquet(f"{root}/events.parquet").select("event_id", "value")
    state = F.array(F.col("value"), F.when(F.col("value") < 50, F.lit(float("nan"))).otherwise(F.col("value")))
    action = F.array(F.when(F.col("value") == 100, F.lit(float("nan"))).otherwise(F.col("value")))
    return X.drop_nan_rows(events.withColumns({"state": state, "action": action}), ["state", "action"]).select("event_id", "value")


@query("b21_slice_dims", f"""WITH {VECTORS}, k AS (SELECT unnest(range(0, 6) || range(7, 23)) AS src, unnest(range(0, 22)) AS place) SELECT vec_id, place, round(state[src + 1], 8) AS value FROM fv CROSS JOIN k""")
def slice_dims(spark, root):
    frames, _ = vector_frames(spark, root)
    out = frames.select("vec_id", F.posexplode(V.slice_dims(F.col("state"), "0:6,7:23")).alias("place", "value"))
    return out.select("vec_id", F.col("place").cast("bigint").alias("place"), tidy("value", 8).alias("value"))


