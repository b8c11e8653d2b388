"""Token ids in compressed files that can be searched: one wavelet matrix per shard.

A shard holds the ids of whole documents. Bit-plane by bit-plane, from the highest bit, the ids are
sorted stably by that bit, and the bits before each sort are kept. A directory counts the ones before
each chunk of 4 KiB of bits, and every chunk is compressed on its own. So an id at a place, the number
of an id's occurrences up to a place (rank), and the place of its k-th occurrence (select) each read a
few chunks per plane, and the whole shard is got back by undoing the sorts.

File, little-endian: ``MAGIC``; tokens (u64), documents (u64), planes (u32), bytes of the document part (u32);
for each plane its zeros (u64); for each plane and chunk the ones before it (u64) and its place (u64), with
one more for the end; then the document part and the chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetable.llm.packing import encoding
from kinetable.llm.tables import shuffles_removed
from kinetable.llm.tokens import vocabulary
from kinetable.llm.words import texts

MAGIC = b"KWVLMTX1"
CHUNK_BITS = 1 << 15
SHARD_TOKENS = 1 << 23
SHARDS_PER_TASK = 16
BATCH_BYTES = 8 << 20
_HEAD = struct.Struct("<8sQQII")


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: ``ids`` of its documents one after the other."""
    n = len(ids)
    planes = max(1, int(ids.max(initial=0)).bit_length())
    rows = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    chunks = -(-n // CHUNK_BITS)
    press = zstandard.ZstdCompressor(level=3)
    zeros = np.zeros(planes, "<u8")
    ones = np.zeros((planes, chunks + 1), "<u8")
    sizes = np.zeros((planes, chunks), "<u8")
    body: list[bytes] = []
    for plane in range(planes):
        bit = (rows >> (planes - 1 - plane) & 1).astype(bool)
        zeros[plane] = n - int(np.count_nonzero(bit))
        packed = np.zeros(chunks * CHUNK_BITS // 8, np.uint8)
        filled = np.packbits(bit, bitorder="little")
        packed[: len(filled)] = filled
        parts = packed.reshape(chunks, CHUNK_BITS // 8)
        ones[plane, 1:] = np.cumsum(np.bitwise_count(parts).sum(axis=1, dtype=np.uint64))
        for at, part in enumerate(parts):
            pressed = press.compress(part.tobytes())
            sizes[plane, at] = len(pressed)
            body.append(pressed)
        rows = np.concatenate([rows[~bit], rows[bit]])
    named = np.array([i is not None for i in doc_ids], np.uint8).tobytes()
    numbers = np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    documents = press.compress(named + numbers + np.array(lengths, "<u8").tobytes())
    head = _HEAD.pack(MAGIC, n, len(doc_ids), planes, len(documents))
    start = len(head) + zeros.nbytes + ones.nbytes + 8 * planes * (chunks + 1) + len(documents)
    ends = start + np.cumsum(sizes.reshape(-1)).astype("<u8")
    places = np.zeros((planes, chunks + 1), "<u8")
    if chunks:
        flat = np.concatenate([[start], ends]).astype("<u8")
        for plane in range(planes):
            places[plane] = flat[plane * chunks : (plane + 1) * chunks + 1]
    return b"".join([head, zeros.tobytes(), ones.tobytes(), places.tobytes(), documents, *body])


class TokenShard:
    """One shard's file, opened from its bytes or from a function ``read(start, size)``."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self._read = source if callable(source) else lambda start, size: source[start : start + size]
        magic, self.n, self.n_docs, self.planes, doc_bytes = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.chunks = -(-self.n // CHUNK_BITS)
        each = 8 * self.planes * (self.chunks + 1)
        table = self._read(_HEAD.size, 8 * self.planes + 2 * each + doc_bytes)
        at = 8 * self.planes
        self.zeros = np.frombuffer(table, "<u8", self.planes).astype(np.int64)
        shape = (self.planes, self.chunks + 1)
        self.ones = np.frombuffer(table, "<u8", each // 8, at).reshape(shape).astype(np.int64)
        self.places = np.frombuffer(table, "<u8", each // 8, at + each).reshape(shape).astype(np.int64)
        self._documents = table[at + 2 * each :]
        self._open = zstandard.ZstdDecompressor()
        self._last: tuple[int, int, np.ndarray] | None = None

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The ids of the documents, and where each starts in the shard, with the end as the last."""
        raw = self._open.decompress(self._documents)
        named = np.frombuffer(raw, np.uint8, self.n_docs)
        numbers = np.frombuffer(raw, "<i8", self.n_docs, self.n_docs).tolist()
        lengths = np.frombuffer(raw, "<u8", self.n_docs, 9 * self.n_docs).astype(np.int64)
        return [i if known else None for i, known in zip(numbers, named)], np.concatenate([[0], np.cumsum(lengths)])

    def _chunk(self, plane: int, chunk: int) -> np.ndarray:
        if self._last is None or self._last[:2] != (plane, chunk):
            start, end = self.places[plane, chunk : chunk + 2].tolist()
            self._last = (plane, chunk, np.frombuffer(self._open.decompress(self._read(start, end - start)), np.uint8))
        return self._last[2]

    def _rank(self, plane: int, at: int) -> int:
        """Ones of a plane before ``at``."""
        chunk, rest = divmod(at, CHUNK_BITS)
        before = int(self.ones[plane, chunk])
        if rest:
            bits = self._chunk(plane, chunk)
            before += int(np.bitwise_count(bits[: rest >> 3]).sum(dtype=np.int64))
            before += int(bits[rest >> 3] & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else 0
        return before

    def _ranks(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each of the places and the ones before it."""
        bits, before = np.empty(len(at), bool), np.empty(len(at), np.int64)
        where = at // CHUNK_BITS
        for chunk in np.unique(where).tolist():
            mine = where == chunk
            row = np.unpackbits(self._chunk(plane, chunk), bitorder="little")
            upto = np.cumsum(row, dtype=np.int64)
            rest = at[mine] - chunk * CHUNK_BITS
            bits[mine] = row[rest]
            before[mine] = self.ones[plane, chunk] + upto[rest] - row[rest]
        return bits, before

    def _selects(self, plane: int, bit: int, ks: np.ndarray) -> np.ndarray:
        """The places of the given occurrences (from 0, ascending) of ``bit`` in a plane."""
        upto = self.ones[plane] if bit else np.minimum(np.arange(self.chunks + 1) * CHUNK_BITS, self.n) - self.ones[plane]
        where = np.searchsorted(upto, ks, side="right") - 1
        out = np.empty(len(ks), np.int64)
        for chunk in np.unique(where).tolist():
            mine = where == chunk
            row = np.unpackbits(self._chunk(plane, chunk), bitorder="little")
            out[mine] = chunk * CHUNK_BITS + np.flatnonzero(row == bit)[ks[mine] - upto[chunk]]
        return out

    def _bit(self, token: int, plane: int) -> int:
        return token >> (self.planes - 1 - plane) & 1

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among places ``low`` to ``high`` lie after the last sort."""
        if token < 0 or token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._rank(plane, low), self._rank(plane, high)
            zeros = int(self.zeros[plane])
            low, high = (zeros + a, zeros + b) if self._bit(token, plane) else (low - a, high - b)
            if low >= high:
                return low, low
        return low, high

    def access(self, at: int) -> int:
        """The id at a place."""
        return int(self.take(np.array([at]))[0])

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the shard")
        out = np.zeros(len(at), np.uint32)
        for plane in range(self.planes):
            bits, before = self._ranks(plane, at)
            at = np.where(bits, self.zeros[plane] + before, at - before)
            out = out << np.uint32(1) | bits
        return out

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id among places ``low`` to ``high``, the end not included."""
        low, high = max(0, low), self.n if high is None else min(self.n, high)
        a, b = self._range(token, low, high) if low < high else (0, 0)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, ascending."""
        low, high = self._range(token, 0, self.n) if self.n else (0, 0)
        at = np.arange(low, high)
        for plane in reversed(range(self.planes)):
            bit = self._bit(token, plane)
            at = self._selects(plane, bit, at - self.zeros[plane] if bit else at) if len(at) else at
        return at

    def select(self, token: int, k: int) -> int:
        """The place of the occurrence number ``k`` (from 0)."""
        low, high = self._range(token, 0, self.n) if self.n else (0, 0)
        if not 0 <= k < high - low:
            raise IndexError("no such occurrence")
        at = np.array([low + k])
        for plane in reversed(range(self.planes)):
            bit = self._bit(token, plane)
            at = self._selects(plane, bit, at - self.zeros[plane] if bit else at)
        return int(at[0])

    def ids(self) -> np.ndarray:
        """All ids in order: the sorts undone from the lowest plane up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        rows = np.zeros(self.n, kind)
        for plane in reversed(range(self.planes)):
            packed = np.concatenate([self._chunk(plane, c) for c in range(self.chunks)]) if self.chunks else np.zeros(0, np.uint8)
            bit = np.unpackbits(packed, count=self.n, bitorder="little").astype(bool)
            zeros = int(self.zeros[plane])
            before = np.empty(self.n, kind)
            before[~bit] = rows[:zeros]
            before[bit] = rows[zeros:] | kind(1 << (self.planes - 1 - plane))
            rows = before
        return rows


_MANIFEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_MANIFEST_DDL = "part int, shard int, file string, n_docs long, n_tokens long, n_bytes long"
_ENCODERS: dict[int, tiktoken.Encoding] = {}


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as every executor sees it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all: a task that runs twice puts the same bytes there."""
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    context = TaskContext.get()
    draft = f"{root}/.{name}.{context.taskAttemptId() if context else 0}"
    with system.open_output_stream(draft) as file:
        file.write(data)
    system.move(draft, f"{root}/{name}")


def write_token_shards(
    docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text", *,
    end: int = 0, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None,
) -> DataFrame:
    """Write the ids of all documents below ``folder``; returns one row per shard (``read_manifest``).

    Ids are those of the ``tokenizers`` file ``path`` (made by ``packing.encoding``, whose ids are equal
    at less than half the time), then ``end``. Documents go by ascending doc_id,
    null first, and rows of one id by a hash of their text; shards in the order of their names hold
    them in that order. A shard is closed once it holds ``shard_tokens``, and never cuts a document.
    Null and empty texts are the one id ``end``; repeated rows are written as often as they occur;
    an empty table has no shards; other columns are not read. ``partitions`` is the number of ranges
    of doc_id, that of the session's shuffle partitions unless given; rows of one id are dealt to
    several of them.
    """
    spark = docs.sparkSession
    definition = vocabulary(docs, path)
    key = xxhash.xxh3_64_intdigest(definition.value)
    folder = _qualified(spark, folder)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:  # kept from task to task in a Python worker
            _ENCODERS.clear()
            _ENCODERS[key] = encoding(definition.value)
        encoder = _ENCODERS[key]
        part, shard = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        total = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            held.clear()
            data = encode_shard(ids, names, sizes)
            file = f"part-{part:06d}-{shard:06d}.kwm"
            _put(f"{folder}/shards", file, data)
            return pa.RecordBatch.from_pylist([dict(part=part, shard=shard, file=file, n_docs=len(names), n_tokens=total, n_bytes=len(data))], _MANIFEST)

        for batch in batches:
            for node, value in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = np.append(encoder.encode_to_numpy(value, allowed_special="all"), np.uint32(end))
                held.append(ids)
                names.append(node)
                sizes.append(len(ids))
                total += len(ids)
                if total >= shard_tokens:
                    yield close()
                    shard, total = shard + 1, 0
                    names.clear()
                    sizes.clear()
        if names:
            yield close()

    slim = docs.select(
        F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"),
        F.xxhash64(F.col(text)).alias("mixed"), F.monotonically_increasing_id().alias("row"))
    order = ["node", "mixed", "row"]
    ranged = slim.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    made = ranged.select("node", "text").mapInArrow(make, _MANIFEST_DDL)
    with shuffles_removed(spark):
        made.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard: folder, part, shard, file, n_docs, n_tokens, n_bytes and ``base``, the ids of all shards before it.

    Parts are summed first, so the window over all rows sees one row per part.
    """
    folder = _qualified(spark, folder)
    shards = spark.read.schema(_MANIFEST_DDL).parquet(f"{folder}/manifest")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.join(parts, "part").withColumn("base", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.drop("_before").withColumn("folder", F.lit(folder))


def _each_shard(manifest: DataFrame, schema: str, read: Callable[[TokenShard, int], Iterator[dict]], whole: bool) -> DataFrame:
    """Open the shard of each row of the manifest in a task and give what ``read`` makes of it, in batches of bounded size."""
    spark = manifest.sparkSession
    shards = manifest.count()
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // SHARDS_PER_TASK))
    fields = spark.createDataFrame([], schema).schema
    kinds = {f.name: {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.dataType.simpleString()] for f in fields}

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, root = pafs.FileSystem.from_uri(f"{row['folder']}/shards/{row['file']}")
                with system.open_input_file(root) as file:
                    shard = TokenShard(file.read_at(row["n_bytes"], 0)) if whole else TokenShard(lambda start, size: file.read_at(size, start))
                    for columns in read(shard, row["base"]):
                        yield pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in kinds.items()], names=list(kinds))

    return manifest.select("folder", "file", "n_bytes", "base").repartition(max(1, tasks)).mapInArrow(opened, schema)


def read_tokens(manifest: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document, read back from the shards: doc_id, start, n_tokens, ids.

    ``start`` is the number of ids of all documents before it; ``ids`` are unsigned little-endian
    numbers of 4 bytes, the end included. A task holds one shard.
    """

    def read(shard: TokenShard, base: int) -> Iterator[dict]:
        names, starts = shard.documents()
        ids = shard.ids().astype("<u4")
        done = 0
        while done < len(names):
            upto = max(done + 1, int(np.searchsorted(starts, starts[done] + BATCH_BYTES // 4, side="right")) - 1)
            bounds = starts[done : upto + 1].tolist()
            yield {
                "node": names[done:upto], "start": [base + a for a in bounds[:-1]], "n_tokens": np.diff(bounds),
                "ids": [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]}
            done = upto

    return _each_shard(manifest, "node long, start long, n_tokens long, ids binary", read, True).withColumnRenamed("node", doc_id)


def count_token(manifest: DataFrame, token: int) -> DataFrame:
    """One row: ``n``, the occurrences of an id in all shards; each shard reads two chunks a plane at most."""
    counted = _each_shard(manifest, "n long", lambda shard, base: iter([{"n": [shard.count(token)]}]), False)
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def find_token(manifest: DataFrame, token: int, doc_id: str = "doc_id") -> DataFrame:
    """One row per occurrence of an id: doc_id, position in the document, place among all ids."""

    def read(shard: TokenShard, base: int) -> Iterator[dict]:
        names, starts = shard.documents()
        at = shard.occurrences(token)
        owner = np.searchsorted(starts, at, side="right") - 1
        yield {"node": [names[i] for i in owner.tolist()], "position": at - starts[owner], "place": base + at}

    return _each_shard(manifest, "node long, position long, place long", read, False).withColumnRenamed("node", doc_id)
