"""A blocked Bloom filter as a table, with DataFrame functions only.

A key picks one block by its hash and sets one bit in each of the block's eight 32-bit words, so a
look-up touches one row of the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
KEYS_PER_BLOCK = 16  # 256 bits for 16 keys: about one false positive in 300
ROW_BYTES = 80
KEY_BYTES = 32
BROADCAST_BYTES = 8 << 20


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: str, word: int) -> Column:
    """The bit of ``key`` in a word: five bits of a second hash choose one of 32 masks."""
    masks = F.array(*[F.lit(1 << b) for b in range(32)])
    place = F.shiftright(F.xxhash64(key, F.lit("bits")), word * 5).bitwiseAND(F.lit(31)).cast("int")
    return F.element_at(masks, place + 1).cast("long")


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per block in use: block and its words, built with partial aggregates."""
    words = [F.bit_or(_mask(key, w)).alias(f"_w{w}") for w in range(WORDS)]
    return listed.groupBy(_block(key, blocks).alias("_block")).agg(*words)


def _hit(key: str) -> Column:
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.col(f"_w{w}").bitwiseAND(_mask(key, w)) != 0)
    return hit


def passes(rows: DataFrame, key: str, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be listed; the filter is broadcast when its blocks are few enough."""
    table = F.broadcast(filter_blocks) if blocks * ROW_BYTES <= BROADCAST_BYTES else filter_blocks
    hit = _hit(key)
    return rows.withColumn("_block", _block(key, blocks)).join(table, "_block").where(hit).select(*rows.columns)


def listed_only(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Inner join of wide rows with a table of distinct keys, without moving most of the others.

    While the filter of the listed keys is proven to be small it is broadcast first, so that the
    shuffle of the exact join carries the listed rows and a few more; beyond that it is a plain join.
    """
    most = BROADCAST_BYTES // ROW_BYTES * KEYS_PER_BLOCK
    count = listed.select(key).limit(most + 1).count()
    if count <= most:
        blocks = max(1, -(-count // KEYS_PER_BLOCK))
        rows = passes(rows, key, bloom_blocks(listed, key, blocks), blocks)
    return rows.join(listed, key)


def unlisted(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Anti join of wide rows with a table of distinct keys, without moving most of them.

    A short list is broadcast. A longer one goes out as its filter while that is proven to be small, and
    only rows that it does not clear are shuffled to the exact join; beyond that it is a plain join.
    """
    listed = listed.select(key)
    most = BROADCAST_BYTES // ROW_BYTES * KEYS_PER_BLOCK
    count = listed.limit(most + 1).count()
    if count * KEY_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(listed), key, "left_anti")
    if count > most:
        return rows.join(listed, key, "left_anti")
    blocks = max(1, -(-count // KEYS_PER_BLOCK))
    table = F.broadcast(bloom_blocks(listed, key, blocks))
    looked = rows.withColumn("_block", _block(key, blocks)).join(table, "_block", "left").withColumn("_maybe", F.coalesce(_hit(key), F.lit(False)))
    clear, maybe = (looked.where(c).select(*rows.columns) for c in ("NOT _maybe", "_maybe"))
    return clear.unionByName(maybe.join(listed, key, "left_anti"))
