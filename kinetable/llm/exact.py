"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison.

A text is normalised (each run of white space becomes one space) and read as a polynomial in a
fixed base with its UTF-8 bytes as coefficients, modulo two primes. Chunks are hashed on their
own and composed: ``hash(left + right) = hash(left) * base**len(right) + hash(right)``, so a huge
text needs one chunk in memory beside itself. Texts of equal length and fingerprints are then
compared chunk by chunk with the text of the smallest id, and what differs is grouped anew, so a
collision never merges two texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.bloom import listed_only
from kinetable.llm.tables import stored
from kinetable.llm.words import texts

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 69_069_069)
CHUNK = 1 << 16
MEMBERS_PER_SALT = 1024
# A run that is more than a single space; single spaces stay as they are.
_RUN = re.compile(rb"[\t-\r][ \t-\r]*| [ \t-\r]+")


def normalised(text: str | None) -> bytes:
    return _RUN.sub(b" ", (text or "").encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=16)
def _powers(base: int, prime: int, length: int = CHUNK) -> np.ndarray:
    powers = np.ones(length, np.uint64)
    filled = 1
    while filled < length:  # doubling: the next run is the first one shifted
        step = min(filled, length - filled)
        powers[filled : filled + step] = powers[:step] * np.uint64(pow(base, filled, prime)) % np.uint64(prime)
        filled += step
    return powers[::-1].copy()


def chunk_fingerprint(chunk: bytes, primes=PRIMES, bases=BASES) -> tuple[int, ...]:
    """The polynomial of at most ``CHUNK`` bytes, once per prime."""
    data = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    return tuple(
        int((data * _powers(base, prime)[CHUNK - len(data) :]).sum() % np.uint64(prime)) if len(data) else 0
        for prime, base in zip(primes, bases))


def compose(left: tuple[int, ...], right: tuple[int, ...], right_length: int, primes=PRIMES, bases=BASES) -> tuple[int, ...]:
    """The fingerprint of two texts put together, from theirs and the length of the second."""
    return tuple((a * pow(base, right_length, prime) + b) % prime for a, b, prime, base in zip(left, right, primes, bases))


def fingerprint(data: bytes, primes=PRIMES, bases=BASES) -> tuple[int, ...]:
    total = (0,) * len(primes)
    for start in range(0, len(data), CHUNK):
        chunk = data[start : start + CHUNK]
        part = chunk_fingerprint(chunk, primes, bases)
        total = compose(total, part, len(chunk), primes, bases) if start else part
    return total


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, primes=PRIMES, bases=BASES) -> DataFrame:
    """One row per document: ``node``, ``n_bytes``, ``f1``, ``f2`` and ``sha`` of the normalised text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in texts(batch.column(1)):
                data = normalised(value)
                rows.append((len(data), *fingerprint(data, primes, bases), hashlib.sha256(data).hexdigest()))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["node", "n_bytes", "f1", "f2", "sha"])

    slim = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    return slim.mapInArrow(make, "node long, n_bytes long, f1 long, f2 long, sha string")


_KEY = ["n_bytes", "f1", "f2"]


def _chunks(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, primes, bases) -> DataFrame:
    """The chunks of the texts in ``wanted`` (node and fingerprint): node, fingerprint, number, bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.drop_columns(["text"]).to_pylist()
            for key, value in zip(keys, texts(batch.column("text"))):
                data = normalised(value)
                if len(data) != key["n_bytes"] or fingerprint(data, primes, bases) != (key["f1"], key["f2"]):
                    continue  # another text under the same id
                parts = [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)] or [b""]
                same = [pa.array([key[c]] * len(parts), pa.int64()) for c in ("node", *_KEY)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["node", *_KEY, "number", "bytes"])

    slim = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    joined = listed_only(slim, "node", stored(wanted.select("node", *_KEY).distinct(), "wanted")).select("node", *_KEY, "text")
    return joined.mapInArrow(make, "node long, n_bytes long, f1 long, f2 long, number long, bytes binary")


def _unequal(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Members whose chunks differ from those of their group's ``keep``.

    The chunks of ``keep`` are repeated once per 1024 members, so that a group of any size is
    compared by many tasks.
    """
    salts = F.ceil(F.col("size") / MEMBERS_PER_SALT)
    member = chunks.join(groups, _KEY).where(F.col("node") != F.col("keep")).withColumn("salt", F.pmod(F.xxhash64("node"), salts))
    model = chunks.join(groups.withColumnRenamed("keep", "node"), [*_KEY, "node"])
    model = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    model = model.select(*_KEY, "number", "salt", F.col("bytes").alias("model")).distinct()
    paired = member.join(model, [*_KEY, "number", "salt"], "left")
    # Equal lengths: every chunk of a member has its counterpart.
    return paired.groupBy("node", *_KEY).agg(F.min(F.coalesce(F.col("bytes") == F.col("model"), F.lit(False))).alias("equal")).where(~F.col("equal")).select("node", *_KEY)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, primes=PRIMES, bases=BASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of space, tab, newline, vertical tab,
    form feed and carriage return became one space; null counts as empty, and empty texts are
    equal to each other. The row with the smallest doc_id of a group is kept. Repeated rows count
    in group_size and are kept or dropped together. A null doc_id comes after every other: such a
    row is kept only where no row of its group has an id, keep_id is null then, and it is grouped
    by fingerprint and length alone. An empty table gives an empty one; other columns are not read.
    """
    every = stored(fingerprints(docs, doc_id, text, primes=primes, bases=bases), "fingerprints")
    groups = every.groupBy(*_KEY).agg(F.min("node").alias("keep"), F.count(F.lit(1)).alias("size"))
    named = every.where(F.col("node").isNotNull())
    several = named.groupBy(*_KEY).agg(F.min("node").alias("keep"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("keep < last").drop("last")
    members = named.select("node", *_KEY).join(several.select(*_KEY), _KEY, "left_semi")
    chunks = stored(_chunks(docs, members, doc_id, text, primes, bases), "chunks")
    variants = None
    unequal = stored(_unequal(chunks, several), "unequal")
    turn = 0
    while not unequal.isEmpty():  # collisions: what differs from the first text is grouped anew
        turn += 1
        regrouped = unequal.groupBy(*_KEY).agg(F.min("node").alias("keep"), F.count(F.lit(1)).alias("size"))
        differ = stored(_unequal(chunks.join(unequal, ["node", *_KEY], "left_semi"), regrouped), "unequal")
        found = unequal.join(differ, ["node", *_KEY], "left_anti").withColumn("variant", F.lit(turn))
        variants = found if variants is None else variants.union(found)
        unequal = differ
    if variants is not None:
        key = [*_KEY, "variant"]
        every = every.join(variants, ["node", *_KEY], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
        groups = every.groupBy(*key).agg(F.min("node").alias("keep"), F.count(F.lit(1)).alias("size"))
    else:
        key = _KEY
    return every.join(groups, key).select(
        F.col("node").alias(doc_id), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("node").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
