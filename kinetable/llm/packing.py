"""Vector best-fit packing of token pieces into sequences.

A document's tokens are cut into pieces of at most the sequence length, the first of which may be
shorter. A sequence has three capacities: tokens, documents, and attention cost (the sum of
squared lengths). Pieces are placed from long to short; of the open sequences that fit under every
capacity, the one with the smallest weighted norm of what would remain (or the largest weighted
dot product of demand and residual) is taken. Pieces are dealt to groups of bounded size by hash,
and each group is packed by itself, which leaves at most a few open sequences in each.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.tables import stored
from kinetable.llm.tokens import byte_symbols, vocabulary
from kinetable.llm.words import texts

#: Pieces of a group that is packed by itself, on average.
GROUP_PIECES = 8192
# The pattern of byte-level pre-tokenisation, a fixed value of the vocabulary's format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(definition: str) -> tiktoken.Encoding:
    """An encoder for a byte-level ``tokenizers`` file.

    The merges of such a file make the vocabulary in order of rank, so ids are ranks.
    """
    parsed = json.loads(definition)
    places = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
    ranks = {bytes(places[c] for c in token): rank for token, rank in parsed["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


_ENCODERS: dict[int, tiktoken.Encoding] = {}


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", *, tokens: int = 1024, end: int = 2) -> DataFrame:
    """The pieces of each document: node, piece, start, length, ids_crc32."""
    definition = vocabulary(docs, path)
    key = xxhash.xxh3_64_intdigest(definition.value)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:  # kept from task to task in a Python worker
            _ENCODERS.clear()
            _ENCODERS[key] = encoding(definition.value)
        encoder = _ENCODERS[key]
        names = ["node", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows: list[tuple] = []
            for node, value in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = np.append(encoder.encode_to_numpy(value, allowed_special="all"), end).astype("<u4")
                first = len(ids) % tokens or tokens
                bounds = [0, *range(first, len(ids) + 1, tokens)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((node, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    slim = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    return slim.mapInArrow(make, "node long, piece int, start long, length long, ids_crc32 long")


def best_fit(
    lengths: np.ndarray, *, tokens: int = 1024, documents: int = 1024, attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02), rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, given in the order of placing.

    ``rule`` is ``norm`` (smallest weighted norm of the residual left) or ``dot`` (largest weighted
    dot product of demand and residual). Equal choices take the sequence opened first.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    capacity = np.array([tokens, documents, tokens * tokens if attention is None else attention], np.float64)
    scale = np.asarray(weights) / capacity**2
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    residual = np.empty((3, max(1, n)))  # of open sequences, in order of opening
    number = np.empty(max(1, n), np.int64)
    opened = live = 0
    for i, length in enumerate(lengths.tolist()):
        demand = np.array([length, 1.0, float(length) * length])
        if (demand > capacity).any():
            raise ValueError(f"a piece of {length} tokens is over the capacities")
        left = residual[:, :live] - demand[:, None]
        fits = np.flatnonzero((left >= 0).all(axis=0))
        if len(fits):
            if rule == "norm":
                at = fits[np.argmin(scale @ (left[:, fits] ** 2))]
            else:
                at = fits[np.argmax((scale * demand) @ residual[:, fits])]
        else:
            at = live
            residual[:, at], number[at] = capacity, opened
            opened, live = opened + 1, live + 1
        sequence[i], offset[i] = number[at], tokens - residual[0, at]
        residual[:, at] -= demand
        if (residual[:, at] < 1).any():  # nothing fits any more
            residual[:, at : live - 1] = residual[:, at + 1 : live].copy()
            number[at : live - 1] = number[at + 1 : live].copy()
            live -= 1
    return sequence, offset


def pack(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", *, tokens: int = 1024, end: int = 2,
    documents: int = 1024, attention: int | None = None, group_pieces: int = GROUP_PIECES, rule: str = "norm",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of the vocabulary file, then ``end``; null and empty texts are the
    one token ``end``. Offsets in a sequence are gapless from 0. Repeated rows are packed as often
    as they occur, a null doc_id stays null, an empty table gives an empty one. Other columns are
    not read.
    """
    made = stored(token_pieces(docs, path, doc_id, text, tokens=tokens, end=end), "pieces")
    groups = max(1, -(-made.count() // group_pieces))
    dealt = made.withColumn("bin_group", F.pmod(F.xxhash64("node", "piece", "length", "ids_crc32"), F.lit(groups)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "node", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        sequence, offset = best_fit(group["length"].to_numpy(np.int64), tokens=tokens, documents=documents, attention=attention, rule=rule)
        return group.assign(sequence_id=(group["bin_group"].to_numpy(np.int64) << 32) + sequence, offset=offset).drop(columns="bin_group")

    schema = "node long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("bin_group").applyInPandas(packed, schema).withColumnRenamed("node", doc_id)
