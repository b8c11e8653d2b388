"""Registered queries, each beside the SQL it must equal."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, root)``; ``sql`` is the same result over the raw tables."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The frame views of kinetable.plans.frames, as SQL.
EVENTS = """fe AS (SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS episode_index,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
  row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS "index",
  count(*) OVER (PARTITION BY user_id) AS length, user_id, event_id, event_type AS task, value,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS "timestamp",
  epoch_us(ts) AS micros FROM events)"""
_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
LINES = f"""fl AS (SELECT dense_rank() OVER (ORDER BY l_orderkey) - 1 AS episode_index,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1 AS frame_index,
  row_number() OVER (ORDER BY l_orderkey, {_LINE}) - 1 AS "index",
  count(*) OVER (PARTITION BY l_orderkey) AS length, l_orderkey, l_returnflag AS task, {_LINE},
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1) / 10.0::DOUBLE AS "timestamp" FROM lineitem)"""
TURNS = """fc AS (SELECT dense_rank() OVER (ORDER BY conv_id) - 1 AS episode_index,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_index,
  row_number() OVER (ORDER BY conv_id, turn) - 1 AS "index",
  count(*) OVER (PARTITION BY conv_id) AS length, conv_id, turn, role, text FROM conversations)"""
VECTORS = """fv AS (SELECT dense_rank() OVER (ORDER BY label) - 1 AS episode_index,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index,
  row_number() OVER (ORDER BY label, vec_id) - 1 AS "index",
  count(*) OVER (PARTITION BY label) AS length, vec_id, label, embedding::DOUBLE[] AS state FROM embeddings)"""


def load() -> None:
    """Import the modules that register queries."""
    from kinetable.catalog import (  # noqa: F401
        actions, annotate, edit, evaluate, layout, live, relate, schema, select, stats, steps, temporal, text,
    )
