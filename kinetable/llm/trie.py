"""Prefix trie of conversations by ROLLUP over columns of turn ids.

A conversation is cut into blocks of ``BLOCK`` turns, one row each with a column per turn. ROLLUP over
the columns, grouped by the node at which the block begins, aggregates the prefixes of all lengths, of
all blocks and conversations together; ``grouping_id`` says how many turns a row stands for. A node is
named by its depth and the sum of an 88-bit digest of each (place, role, text) on the way to it, so the
node at which a block begins is a running sum, and no block waits for the one before it.

Sums over subtrees need no walk either. A node's smallest member is a member of all its ancestors, so
what is to be counted once per node can be charged to a conversation and summed over members: a leaf
counts at its smallest member. And let ``shared`` be the bytes of a conversation's turns before the first
depth at which it is the smallest member of its node. Bytes saved in a subtree are, over the top's members
without the smallest one, ``shared`` less the bytes before the top's own turn. So a second ROLLUP that sums
these two numbers gives both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.tables import stored
from kinetable.plans.segments import number_rows, running, spread_join

BLOCK = 8
#: Parents with more than one in so many of all links are joined apart, by broadcast: there are fewer than this.
HOT_PARENTS = 1000
IDS_PER_RUN = 1 << 16


def crc32_of(number: Column) -> Column:
    """The unsigned crc32 of a number written in decimal."""
    return F.crc32(number.cast("string").cast("binary"))


def rebuilt_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, family: int = 5, most: int = 9) -> DataFrame:
    """``(conv, pos, role, text)`` of conversations that begin with turns of the first of their family.

    Conversation c takes the first h turns of conversation c - c % family, then its own after its first
    h, where h is the crc32 of c in decimal modulo ``most``. Turns go by turn (null first), then role and
    text; null roles and texts count as empty; repeated rows are turns of their own. ``pos`` is dense
    from 0. Rows without a conv_id belong to no conversation and are left out. A conversation with no
    turns left has one row with null pos.
    """
    said = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = stored(number_rows(said, ["conv"], ["turn", "role", "text"], "pos"), "turns")
    sizes = stored(placed.groupBy("conv").agg(F.count(F.lit(1)).alias("size")), "sizes")
    heads = sizes.select("conv", "size", (F.col("conv") - F.col("conv") % family).alias("base"), (crc32_of(F.col("conv")) % most).alias("h"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    heads = heads.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    heads = stored(heads.select("conv", "size", "base", "h", "taken"), "heads")
    lead = placed.where(F.col("pos") < most - 1).select(F.col("conv").alias("base"), "pos", "role", "text")
    taken = heads.where("taken > 0").select("conv", "base", "taken").join(lead, "base").where("pos < taken")
    own = spread_join(placed, heads.select("conv", "size", "h", "taken"), "conv", "pos", "size").where("pos >= h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    bare = heads.where((F.col("taken") == 0) & (F.col("size") <= F.col("h")))
    nothing = bare.select("conv", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return taken.select("conv", "pos", "role", "text").unionByName(own).unionByName(nothing)


def _digest(*parts: Column) -> Column:
    """The first 88 bits of the SHA-256 of the parts, as a decimal whose sums over 10**11 rows still fit."""
    whole = F.sha2(F.concat_ws(":", *parts), 256)
    high, low = (F.conv(F.substring(whole, at, 11), 16, 10).cast("decimal(14,0)") for at in (1, 12))
    return (high * F.lit(16**11).cast("decimal(14,0)") + low).cast("decimal(38,0)")


def _added(parts: list[Column], kind: str) -> Column:
    total = F.lit(0).cast(kind)
    for part in parts:
        total = (total + F.coalesce(part, F.lit(0).cast(kind))).cast(kind)
    return total


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: a struct (id, bytes) per turn, the sums of both inside and before the block."""
    turn = F.struct(
        _digest(F.col("pos").cast("string"), F.octet_length("role").cast("string"), F.col("role"), F.col("text")).alias("id"),
        F.octet_length("text").cast("long").alias("bytes"))
    items = turns.select(
        "conv", F.coalesce(F.floor(F.col("pos") / block), F.lit(0)).cast("long").alias("block"), (F.col("pos") % block).alias("slot"), "pos",
        F.when(F.col("pos").isNotNull(), turn).alias("turn"))
    slots = [f"t{i}" for i in range(block)]
    rows = items.groupBy("conv", "block").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("turn"))).alias(s) for i, s in enumerate(slots)], F.count("pos").alias("turns"))
    rows = stored(rows.withColumns({
        "ids": _added([F.col(f"{s}.id") for s in slots], "decimal(38,0)"), "bytes": _added([F.col(f"{s}.bytes") for s in slots], "long")}), "blocks")
    summed = running(rows, ["conv"], "block", {"prior": ("sum", F.col("ids")), "before": ("sum", F.col("bytes"))}, strict=True)
    zero = {"prior": _added([F.col("prior")], "decimal(38,0)"), "before": _added([F.col("before")], "long")}
    return stored(summed.withColumns(zero), "blocks")


def _rolled(blocks: DataFrame, block: int, sums: str) -> DataFrame:
    """The aggregates ``sums`` of each node: depth, key, parent_key, prior_bytes (before its last turn), bytes (of it)."""
    slots = [f"t{i}" for i in range(block)]
    rolled = blocks.sparkSession.sql(
        f"SELECT block, prior, before, {', '.join(slots)}, {block} - bit_count(grouping_id()) AS level, {sums} "
        f"FROM {{blocks}} GROUP BY block, prior, before, ROLLUP ({', '.join(slots)})", blocks=blocks)
    level, last = F.col("level"), F.coalesce(*[F.when(F.col("level") == i + 1, F.col(s)) for i, s in enumerate(slots)])
    rolled = rolled.withColumn("last", last)
    # A row that has no turn in its last column stands for conversations that ended before; the node
    # at which a later block begins is also the last one of the block before.
    rolled = rolled.where(F.col("last").isNotNull() | ((level == 0) & (F.col("block") == 0)))
    key = _added([F.col("prior"), *[F.col(f"{s}.id") for s in slots]], "decimal(38,0)")
    upto = _added([F.col("before"), *[F.col(f"{s}.bytes") for s in slots]], "long")
    last_id, last_bytes = (F.coalesce(F.col(f"last.{f}"), F.lit(0).cast(k)) for f, k in (("id", "decimal(38,0)"), ("bytes", "long")))
    return rolled.withColumns({
        "depth": (F.col("block") * block + level).cast("long"), "key": key, "parent_key": (key - last_id).cast("decimal(38,0)"),
        "prior_bytes": upto - last_bytes, "bytes": last_bytes}).drop("block", "prior", "before", "level", "last", *slots)


_NODE = ["depth", "key"]


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, key, ends_sha256)`` of the conversations that end at each node.

    Ids are sorted by ranges, so a node with very many of them is written out as text by many tasks;
    the hash itself, which must see them in order, reads those texts one after the other.
    """

    def text_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows = None, [], []

        def close() -> None:
            if ids:
                rows.append((*at, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for depth, key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, key) != at or len(ids) >= IDS_PER_RUN:
                    close()
                    at = (depth, key)
                ids.append(conv)
            if rows:
                yield _record(rows, _RUN)
                rows.clear()
        close()
        if rows:
            yield _record(rows, _RUN)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, rows = None, None, []
        for batch in batches:
            for depth, key, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, key) != at:
                    if at is not None:
                        rows.append((*at, state.hexdigest()))
                    at, state = (depth, key), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if rows:
                yield _record(rows, _HASHED)
                rows.clear()
        if at is not None:
            yield _record([(*at, state.hexdigest())], _HASHED)

    order = [*_NODE, "conv"]
    named = ends.select("depth", F.col("key").cast("string").alias("key"), "conv")
    runs = named.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(text_runs, "depth long, key string, conv long, ids string")
    runs = runs.repartition(*_NODE).sortWithinPartitions(*order)
    found = runs.mapInArrow(hashed, "depth long, key string, ends_sha256 string")
    return found.withColumn("key", F.col("key").cast("decimal(38,0)"))


_RUN = pa.schema([("depth", pa.int64()), ("key", pa.string()), ("conv", pa.int64()), ("ids", pa.string())])
_HASHED = pa.schema([("depth", pa.int64()), ("key", pa.string()), ("ends_sha256", pa.string())])


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _parents(tops: DataFrame, nodes: DataFrame, links: int) -> DataFrame:
    """``tops`` (depth, key, parent_key) with the conv_id of the parent; a parent may have any number of them."""
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.where(F.col("n_children") * HOT_PARENTS > links).drop("n_children")
    cold = parents.where(F.col("n_children") * HOT_PARENTS <= links).drop("n_children")
    on = ["depth", "parent_key"]
    return tops.join(F.broadcast(hot), on).unionByName(tops.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def prefix_trie(turns: DataFrame, conv_id: str = "conv", pos: str = "pos", role: str = "role", text: str = "text", *, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node of depth d is a distinct sequence of the first d turns (role, text) of a conversation, its
    members are the conversations that begin with it, and the root, of depth 0, has all. ``pos`` is dense
    from 0 in a conversation; a row with null pos stands for a conversation without turns. Null roles
    and texts count as empty. saved_tokens sums over the subtree each node's members less one times the
    UTF-8 bytes of its last text; n_leaves counts the nodes without children in it; ends_sha256 is
    over the conv_ids of the members that end at the node, ascending, joined by commas. conv_id and
    depth name a node. An empty table gives an empty one; other columns are not read.
    """
    said = turns.select(F.col(conv_id).alias("conv"), F.col(pos).alias("pos"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = _blocks(said, block)
    found = stored(_rolled(blocks, block, "min(conv) AS conv_id, count(1) AS n_convs"), "nodes")
    links = found.where("depth > 0")
    children = links.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(found.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    # Of each conversation the first node whose smallest member it is, and whether its last one is a leaf.
    first = F.min(F.struct("depth", "key", "parent_key", "prior_bytes"))
    tops = stored(nodes.groupBy(F.col("conv_id").alias("conv")).agg(first.alias("top"), F.max_by(F.col("n_children") == 0, "depth").alias("leaf")), "tops")
    whole = blocks.groupBy("conv").agg(
        F.sum("ids").cast("decimal(38,0)").alias("key"), F.sum("turns").alias("depth"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_blocks"))
    whole = stored(whole.join(tops, "conv", "left").select(
        "conv", "key", "depth", "n_blocks", F.coalesce("top.prior_bytes", "bytes").alias("shared"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf")), "ends")
    charged = spread_join(blocks, whole.select("conv", "n_blocks", "shared", "leaf"), "conv", "block", "n_blocks")
    sums = _rolled(charged, block, "sum(shared) - min_by(shared, conv) AS shared, sum(leaf) AS n_leaves").select(*_NODE, "shared", "n_leaves")
    above = _parents(tops.select("top.depth", "top.key", "top.parent_key").where("depth > 0"), nodes, links.count()).select(*_NODE, "parent_conv_id")
    out = nodes.join(sums, _NODE).join(above, _NODE, "left").join(_end_digests(whole), _NODE, "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("shared") - (F.col("n_convs") - 1) * F.col("prior_bytes")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
