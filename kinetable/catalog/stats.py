"""Queries over statistics and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.catalog import EVENTS, LINES, VECTORS, query
from kinetable.functions import scaling as G
from kinetable.functions.numbers import tidy
from kinetable.operators import stats as S
from kinetable.plans.frames import event_frames, line_frames, vector_frames
from kinetable.session import materialize
from kinetable.sources.layout import spread_splits

BASE = ("count", "min", "max", "mean", "std")
QN = ("q01", "q10", "q50", "q90", "q99")
_LKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _shown(stats, keys=(), names=BASE):
    columns = [tidy(n, 7).alias(n) if n != "count" else F.col(n).cast("bigint").alias(n) for n in names]
    return stats.select(*keys, "feature", F.col("dim").cast("bigint").alias("dim"), *columns)


def _agg_sql(value="value"):
    return f"""count({value}) AS count, round(min({value}), 7) + 0.0 AS min, round(max({value}), 7) + 0.0 AS max,
  round(avg({value}), 7) + 0.0 AS mean, round(stddev_pop({value}), 7) + 0.0 AS std"""


LINE_TALL = "lt AS (" + " UNION ALL ".join(
    f"SELECT episode_index, \"index\", '{f}' AS feature, 0::BIGINT AS dim, {f} AS value FROM fl" for f in LINE_FEATURES) + ")"
VECTOR_TALL = """vt AS (SELECT episode_index, frame_index, length, 'state' AS feature, d - 1 AS dim, state[d] AS value
  FROM fv CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS d))"""


def _hist_sql(source: str, keys: str) -> str:
    """Histogram quantiles of tall rows ``source`` per ``keys, feature, dim``."""
    g = f"{keys}feature, dim"
    pick = ", ".join(
        f"min(CASE WHEN cum >= {q}::DOUBLE * total THEN {{'bin': bin, 'v': CASE WHEN bin = 0 THEN lo ELSE lo + (bin + ({q}::DOUBLE * total - (cum - n)) / n) * ((hi - lo) / 5000) END}} END).v AS {name}"
        for q, name in zip(S.QUANTILES, QN))
    return f"""st AS (SELECT {g}, count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std FROM {source} GROUP BY ALL),
  ed AS (SELECT {g}, count AS total, min - 1e-10::DOUBLE AS lo, max + 1e-10::DOUBLE AS hi FROM st),
  bn AS (SELECT {g}, total, lo, hi, least(greatest(floor((value - lo) * 5000 / (hi - lo)), 0), 4999) AS bin, count(*) AS n FROM {source} JOIN ed USING ({g}) GROUP BY ALL),
  cu AS (SELECT *, sum(n) OVER (PARTITION BY {g} ORDER BY bin)::DOUBLE AS cum FROM bn),
  pk AS (SELECT {g}, {pick} FROM cu GROUP BY ALL),
  hq AS (SELECT st.*, {', '.join(f'CASE WHEN count < 2 THEN mean ELSE {n} END AS {n}' for n in QN)} FROM st JOIN pk USING ({g}))"""


_SHOW_Q = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in QN)
_SHOW_Q8 = ", ".join(f"round({n}, 8) + 0.0 AS {n}" for n in QN)
_SHOW_B = "count, round(min, 7) + 0.0 AS min, round(max, 7) + 0.0 AS max, round(mean, 7) + 0.0 AS mean, round(std, 7) + 0.0 AS std"


def _shown_q(stats, keys=(), digits=6):
    base = [tidy(n, 7).alias(n) if n != "count" else F.col(n).cast("bigint").alias(n) for n in BASE]
    return stats.select(*keys, "feature", F.col("dim").cast("bigint").alias("dim"), *base, *[tidy(n, digits).alias(n) for n in QN])


@query("f01_feature_stats_episode", f"WITH {LINES}, {LINE_TALL} SELECT episode_index, feature, dim, {_agg_sql()} FROM lt GROUP BY 1, 2, 3")
def feature_stats_episode(spark, root):
    frames, _ = line_frames(spark, root)
    return _shown(S.frame_stats(frames, ["episode_index"], LINE_FEATURES), ["episode_index"])


@query("f01_feature_stats_vector", f"WITH {VECTORS}, {VECTOR_TALL} SELECT episode_index, feature, dim, {_agg_sql()} FROM vt GROUP BY 1, 2, 3")
def feature_stats_vector(spark, root):
    frames, _ = vector_frames(spark, root)
    return _shown(S.feature_stats(S.to_series(frames, ["episode_index"], ["state"]), ["episode_index"]), ["episode_index"])


@query("f02_histogram_quantiles", f"WITH {LINES}, {LINE_TALL}, {_hist_sql('lt', '')} SELECT feature, dim, {_SHOW_B}, {_SHOW_Q8} FROM hq")
def histogram_quantiles(spark, root):
    lines = spread_splits(spark.read.parquet(f"{root}/lineitem.parquet").select(*_LKEYS, *LINE_FEATURES, "l_returnflag", "l_linestatus"))
    return _shown_q(S.histogram_quantiles(S.to_series(lines, [], LINE_FEATURES)), digits=8)


@query("f02_exact_quantiles", f"""WITH {EVENTS} SELECT episode_index, 'value' AS feature, 0::BIGINT AS dim,
  {', '.join(f'round(quantile_cont(value, {q}), 6) + 0.0 AS {n}' for q, n in zip(S.QUANTILES, QN))} FROM fe GROUP BY 1""")
def exact_quantiles(spark, root):
    frames, _ = event_frames(spark, root)
    out = S.exact_quantiles(S.to_series(frames, ["episode_index"], ["value"]), ["episode_index"])
    return out.select("episode_index", "feature", F.col("dim").cast("bigint").alias("dim"), *[tidy(n).alias(n) for n in QN])


_RANKS = f"""WITH {LINES}, {LINE_TALL}, q AS (SELECT unnest([{', '.join(map(str, S.QUANTILES))}]::DOUBLE[]) AS q)
  SELECT feature, dim, q, count(value) AS count, round(min(value), 7) + 0.0 AS min, round(max(value), 7) + 0.0 AS max, true AS near FROM lt, q GROUP BY ALL"""


def _near_ranks(stats, tall):
    """Each quantile of a sketch and whether its rank among all values is within a hundredth of what it should be."""
    wanted = stats.select("feature", "dim", "count", "min", "max", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(n).alias("at")) for q, n in zip(S.QUANTILES, QN)])).alias("s"))
    placed = tall.join(F.broadcast(wanted.select("feature", "dim", "s.q", "s.at")), ["feature", "dim"])
    ranks = placed.groupBy("feature", "dim", "q").agg(F.avg((F.col("value") < F.col("at")).cast("int")).alias("under"), F.avg((F.col("value") <= F.col("at")).cast("int")).alias("upto"))
    out = wanted.select("feature", "dim", "count", "min", "max", "s.q").join(ranks, ["feature", "dim", "q"])
    near = (F.col("q") >= F.col("under") - 0.01) & (F.col("q") <= F.col("upto") + 0.01)
    return out.select("feature", F.col("dim").cast("bigint").alias("dim"), "q", "count", tidy("min", 7).alias("min"), tidy("max", 7).alias("max"), near.alias("near"))


@query("f02_sketch_quantiles", _RANKS)
def sketch_quantiles(spark, root):
    lines = spread_splits(spark.read.parquet(f"{root}/lineitem.parquet").select(*_LKEYS, *LINE_FEATURES))
    tall = S.to_series(lines, [], LINE_FEATURES)
    return _near_ranks(materialize(S.sketch_quantiles(S.sketch_stats(tall))), tall)


@query("f04_merge_sketches", _RANKS)
def merge_sketches(spark, root):
    """Sketches per supplier, merged to those of all lines."""
    lines = spread_splits(spark.read.parquet(f"{root}/lineitem.parquet").select(*_LKEYS, *LINE_FEATURES))
    tall = S.to_series(lines, ["l_suppkey"], LINE_FEATURES)
    merged = S.merge_stats(S.sketch_stats(tall, ["l_suppkey"]), derived=True)
    return _near_ranks(materialize(merged), tall)


@query("f02_selected_quantiles", f"""WITH {LINES}, {LINE_TALL} SELECT feature, dim,
  {', '.join(f'round(quantile_cont(value, {q}), 6) + 0.0 AS {n}' for q, n in zip(S.QUANTILES, QN))} FROM lt GROUP BY ALL""")
def selected_quantiles(spark, root):
    lines = spread_splits(spark.read.parquet(f"{root}/lineitem.parquet").select(*_LKEYS, *LINE_FEATURES))
    out = S.selected_quantiles(S.to_series(lines, [], LINE_FEATURES))
    return out.select("feature", F.col("dim").cast("bigint").alias("dim"), *[tidy(n).alias(n) for n in QN])


@query("f03_small_group_fallback", f"WITH {LINES}, {LINE_TALL}, {_hist_sql('lt', 'episode_index, ')} SELECT episode_index, feature, dim, {_SHOW_B}, {_SHOW_Q8} FROM hq")
def small_group_fallback(spark, root):
    """Per-episode quantiles; episodes of one frame take the mean."""
    frames, _ = line_frames(spark, root)
    return _shown_q(S.episode_quantiles(frames, LINE_FEATURES), ["episode_index"], digits=8)


_MERGED = f"""m AS (SELECT feature, dim, sum(count) AS count, min(min) AS min, max(max) AS max, sum(count * mean) / sum(count) AS mean,
  {', '.join(f'sum(count * {n}) / sum(count) AS {n}' for n in QN)} FROM hq GROUP BY 1, 2),
  v AS (SELECT feature, dim, sqrt(sum(hq.count * (hq.std ** 2 + (hq.mean - m.mean) ** 2)) / sum(hq.count)) AS std FROM hq JOIN m USING (feature, dim) GROUP BY 1, 2)
  SELECT feature, dim, count::BIGINT AS count, round(min, 7) + 0.0 AS min, round(max, 7) + 0.0 AS max, round(mean, 7) + 0.0 AS mean, round(std, 7) + 0.0 AS std, {_SHOW_Q} FROM m JOIN v USING (feature, dim)"""


@query("f04_merge_stats", f"WITH {LINES}, {LINE_TALL}, {_hist_sql('lt', 'episode_index, ')}, {_MERGED}")
def merge_stats(spark, root):
    frames, _ = line_frames(spark, root)
    return _shown_q(S.merge_stats(S.episode_quantiles(frames, LINE_FEATURES), derived=True))


@query("f05_stats_by_axis_dim", f"WITH {VECTORS}, {VECTOR_TALL} SELECT feature, dim, {_agg_sql()} FROM vt GROUP BY 1, 2")
def stats_by_dim(spark, root):
    frames, _ = vector_frames(spark, root)
    return _shown(S.stats_by_axis(frames, "state", "rows"))


@query("f05_stats_by_axis_row", f"WITH {VECTORS}, {VECTOR_TALL} SELECT episode_index, frame_index, {_agg_sql()} FROM vt GROUP BY 1, 2")
def stats_by_row(spark, root):
    frames, _ = vector_frames(spark, root)
    out = S.stats_by_axis(frames, "state", "dims", ["episode_index", "frame_index"])
    return out.select("episode_index", "frame_index", "count", *[tidy(n, 7).alias(n) for n in BASE[1:]])


@query("f05_stats_by_axis_all", f"WITH {VECTORS}, {VECTOR_TALL} SELECT 'state' AS feature, -1::BIGINT AS dim, {_agg_sql()} FROM vt")
def stats_by_all(spark, root):
    frames, _ = vector_frames(spark, root)
    return _shown(S.stats_by_axis(frames, "state", "all"))


_PIXEL = "least(255, greatest(0, floor((value + 1) * 128)))"


@query("f06_image_stats", f"""WITH {VECTORS}, {VECTOR_TALL}, p AS (SELECT *, {_PIXEL} AS px FROM vt WHERE true), c AS (SELECT episode_index, (dim % 2) AS dim, px, frame_index FROM p)
  SELECT episode_index, dim, count(DISTINCT frame_index) AS count, round(min(px) / 255, 7) AS min, round(max(px) / 255, 7) AS max, round(avg(px) / 255, 7) AS mean, round(stddev_pop(px) / 255, 7) AS std FROM c GROUP BY 1, 2""")
def image_stats(spark, root):
    """Each vector of 64 taken as a 4 x 8 image of two 8-bit channels."""
    frames, _ = vector_frames(spark, root)
    level = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 1) * 128)))
    raw = F.unhex(F.array_join(F.transform("state", lambda v: F.lpad(F.hex(level(v)), 2, "0")), ""))
    images = frames.select("episode_index", raw.alias("pixels"))
    out = S.image_stats(images, ["episode_index"], "pixels", 4, 8, 2)
    return out.select("episode_index", F.col("dim").cast("bigint").alias("dim"), "count", *[tidy(n, 7).alias(n) for n in BASE[1:]])


@query("f07_augment_quantiles", f"WITH {VECTORS}, {VECTOR_TALL}, {_hist_sql('vt', 'episode_index, ')}, {_MERGED}")
def augment_quantiles(spark, root):
    frames, _ = vector_frames(spark, root)
    plain = S.feature_stats(S.to_series(frames, [], ["state"]))
    return _shown_q(S.augment_quantiles(frames, plain, ["state"]))


@query("f08_update_stats", f"""WITH {LINES}, {LINE_TALL} SELECT feature, dim, {_agg_sql()} FROM lt GROUP BY 1, 2""")
def update_stats(spark, root):
    """Statistics of finished lines, updated by those of open ones, equal the statistics of all."""
    lines = spread_splits(spark.read.parquet(f"{root}/lineitem.parquet").select(*_LKEYS, *LINE_FEATURES, "l_returnflag", "l_linestatus"))
    old = S.frame_stats(lines.filter("l_linestatus = 'F'"), [], LINE_FEATURES)
    new = S.frame_stats(lines.filter("l_linestatus <> 'F'"), [], LINE_FEATURES)
    return _shown(S.update_stats(old, new))


@query("f09_episode_tasks", f"""WITH {EVENTS} SELECT episode_index, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks, count(DISTINCT task) AS n_tasks, count(*) AS length FROM fe GROUP BY 1""")
def episode_tasks(spark, root):
    frames, _ = event_frames(spark, root)
    per_task = frames.groupBy("episode_index", "task").agg(F.count(F.lit(1)).alias("n"))
    out = per_task.groupBy("episode_index").agg(F.array_sort(F.collect_set("task")).alias("t"), F.sum("n").alias("length"))
    return out.select("episode_index", F.array_join("t", ",").alias("tasks"), F.size("t").cast("bigint").alias("n_tasks"), "length")


@query("a04_stats_to_tall", f"""WITH {VECTORS}, {VECTOR_TALL}, s AS (SELECT episode_index, feature, dim, count(value)::DOUBLE AS count, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std FROM vt GROUP BY 1, 2, 3)
  SELECT episode_index, feature, dim, stat, round(value, 6) + 0.0 AS value FROM (UNPIVOT s ON count, min, max, mean, std INTO NAME stat VALUE value)""")
def stats_to_tall(spark, root):
    frames, _ = vector_frames(spark, root)
    stats = S.feature_stats(S.to_series(frames, ["episode_index"], ["state"]), ["episode_index"])
    out = S.stats_to_tall(stats, ["episode_index"])
    return out.select("episode_index", "feature", F.col("dim").cast("bigint").alias("dim"), "stat", tidy("value").alias("value"))


@query("a04_tall_to_stats", f"WITH {LINES}, {LINE_TALL} SELECT episode_index, feature, dim, {_agg_sql()} FROM lt GROUP BY 1, 2, 3")
def tall_to_stats(spark, root):
    frames, _ = line_frames(spark, root)
    keys = ["episode_index"]
    stats = S.frame_stats(frames, keys, LINE_FEATURES)
    return _shown(S.tall_to_stats(S.stats_to_tall(stats, keys), keys), keys)


# --- scaling -------------------------------------------------------------------------

_LSTAT = ", ".join(
    f"""avg({f}) AS {f}_mean, stddev_pop({f}) AS {f}_std, min({f}) AS {f}_min, max({f}) AS {f}_max,
  quantile_cont({f}, 0.01) AS {f}_q01, quantile_cont({f}, 0.1) AS {f}_q10, quantile_cont({f}, 0.9) AS {f}_q90, quantile_cont({f}, 0.99) AS {f}_q99""" for f in LINE_FEATURES)
_LN = f"""s AS (SELECT {_LSTAT} FROM lineitem), l AS (SELECT * FROM lineitem CROSS JOIN s)"""


def _line_stats(lines, quantiles):
    stats = S.frame_stats(lines, [], LINE_FEATURES)
    return stats.join(S.selected_quantiles(S.to_series(lines, [], LINE_FEATURES)), ["feature", "dim"]) if quantiles else stats


def _state(lines):
    return lines.select(*_LKEYS, F.array(*LINE_FEATURES).alias("state"))


def _four(values, digits=6):
    return [tidy(F.get(values, F.lit(i)), digits).alias(f"s{i}") for i in range(4)]


def _four_sql(fn, digits=6):
    return ", ".join(f"round({fn(f)}, {digits}) + 0.0 AS s{i}" for i, f in enumerate(LINE_FEATURES))


def _vector_stats(lines, quantiles=False):
    """The statistics of the four features as one row of vectors."""
    return G.stats_row(_line_stats(lines, quantiles), {"state": [(f, 0) for f in LINE_FEATURES]})


@query("g01_normalize_mean_std", f"WITH {_LN} SELECT {', '.join(_LKEYS)}, {_four_sql(lambda f: f'({f} - {f}_mean) / ({f}_std + 1e-8::DOUBLE)')} FROM l")
def normalize_mean_std(spark, root):
    return _normalized(spark, root, "MEAN_STD")


@query("g01_normalize_min_max", f"WITH {_LN} SELECT {', '.join(_LKEYS)}, {_four_sql(lambda f: f'2 * ({f} - {f}_min) / ({f}_max - {f}_min) - 1')} FROM l")
def normalize_min_max(spark, root):
    return _normalized(spark, root, "MIN_MAX")


@query("g01_normalize_quantiles", f"WITH {_LN} SELECT {', '.join(_LKEYS)}, {_four_sql(lambda f: f'2 * ({f} - {f}_q01) / ({f}_q99 - {f}_q01) - 1')} FROM l")
def normalize_quantiles(spark, root):
    return _normalized(spark, root, "QUANTILES")


@query("g01_normalize_quantile10", f"WITH {_LN} SELECT {', '.join(_LKEYS)}, {_four_sql(lambda f: f'2 * ({f} - {f}_q10) / ({f}_q90 - {f}_q10) - 1')} FROM l")
def normalize_quantile10(spark, root):
    return _normalized(spark, root, "QUANTILE10")


def _normalized(spark, root, mode):
    lines = spread_splits(spark.read.parquet(f"{root}/lineitem.parquet").select(*_LKEYS, *LINE_FEATURES, "l_returnflag", "l_linestatus"))
    out = G.normalize(_state(lines), _vector_stats(lines, mode.startswith("QUANTILE")), {"state": mode})
    return out.select(*_LKEYS, *_four(F.col("state")))


@query("g01_unnormalize", f"SELECT {', '.join(_LKEYS)}, {_four_sql(lambda f: f, 4)} FROM lineitem")
def unnormalize(spark, root):
    lines = spread_splits(spark.read.parquet(f"{root}/lineitem.parquet").select(*_LKEYS, *LINE_FEATURES, "l_returnflag", "l_linestatus"))
    stats = _vector_stats(lines, True)
    out = G.unnormalize(G.normalize(_state(lines), stats, {"state": "QUANTILES"}), stats, {"state": "QUANTILES"})
    return out.select(*_LKEYS, *_four(F.col("state"), 4))


@query("g02_normalize_clipped", f"WITH {_LN} SELECT {', '.join(_LKEYS)}, {_four_sql(lambda f: f'2 * (least(greatest({f}, {f}_q01), {f}_q99) - {f}_q01) / greatest({f}_q99 - {f}_q01, 1e-8::DOUBLE) - 1')} FROM l")
def normalize_clipped(spark, root):
    lines = spread_splits(spark.read.parquet(f"{root}/lineitem.parquet").select(*_LKEYS, *LINE_FEATURES, "l_returnflag", "l_linestatus"))
    out = G.normalize(_state(lines), _vector_stats(lines, True), {"state": "QUANTILES"}, clipped=True)
    return out.select(*_LKEYS, *_four(F.col("state")))


_ORDER_RANGE = """r AS (SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1), j AS (SELECT * FROM lineitem JOIN r USING (l_orderkey))"""


@query("g03_minmax_zero_safe", f"""WITH {_ORDER_RANGE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN hi = lo THEN 0 ELSE 2 * (l_quantity - lo) / (hi - lo) - 1 END, 6) + 0.0 AS scaled,
  round(CASE WHEN hi = lo THEN lo ELSE l_quantity END, 6) + 0.0 AS restored FROM j""")
def minmax_zero_safe(spark, root):
    frames, _ = line_frames(spark, root)
    ranges = frames.groupBy("l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count(F.lit(1)).alias("rows"))
    from kinetable.plans.segments import spread_join

    rows = spread_join(frames, ranges, "l_orderkey", "frame_index", "rows")
    scaled = G.minmax_zero_safe(F.array("l_quantity"), F.array("lo"), F.array("hi"))
    rows = rows.withColumn("v", scaled)
    restored = G.minmax_zero_safe_inverse(F.col("v"), F.array("lo"), F.array("hi"))
    return rows.select(*_LKEYS, tidy(F.get("v", F.lit(0))).alias("scaled"), tidy(F.get(restored, F.lit(0))).alias("restored"))


@query("g04_swap_stats", f"""WITH s AS (SELECT {_LSTAT} FROM lineitem WHERE l_returnflag = 'A'), l AS (SELECT * FROM lineitem CROSS JOIN s)
  SELECT {', '.join(_LKEYS)}, {_four_sql(lambda f: f'({f} - {f}_mean) / ({f}_std + 1e-8::DOUBLE)')} FROM l""")
def swap_stats(spark, root):
    """The step of g01 with the statistics of another dataset."""
    lines = spread_splits(spark.read.parquet(f"{root}/lineitem.parquet").select(*_LKEYS, *LINE_FEATURES, "l_returnflag", "l_linestatus"))
    step = lambda frames, stats: G.normalize(frames, stats, {"state": "MEAN_STD"})
    other = _vector_stats(lines.filter("l_returnflag = 'A'"))
    return step(_state(lines), other).select(*_LKEYS, *_four(F.col("state")))


@query("g05_discretize", f"""WITH {VECTORS}, {VECTOR_TALL} SELECT episode_index, frame_index, dim, least(255, greatest(-1, floor((value * 4 + 1) * 128)))::BIGINT AS bin FROM vt""")
def discretize(spark, root):
    frames, _ = vector_frames(spark, root)
    bins = G.discretize(F.transform("state", lambda v: v * 4))
    out = frames.select("episode_index", "frame_index", F.posexplode(bins).alias("dim", "bin"))
    return out.withColumns({"dim": F.col("dim").cast("bigint"), "bin": F.col("bin").cast("bigint")})
