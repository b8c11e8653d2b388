"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

A window has as many words as the item it is held against. Its fingerprint has the sign of each
bit's sum over its word shingles, each as often as it occurs. Two fingerprints within ``radius``
bits agree in one of ``radius + 1`` blocks, so looking up the blocks of a window finds every item
within the radius; the rest is dropped by the full distance, and what is left is verified by the
exact weighted similarity of the shingles, the sum of the smaller counts over that of the larger.

Blocks of six or seven bits leave a tenth or so of the items, but a window just similar enough is often
further away than they reach. Such a window holds many shingles of the item, so it is looked up by
them: items that own enough of the shingles around are compared up to ``reach`` bits. A window
without a shingle of an item has similarity 0 with it, so only windows that hold one are
fingerprinted; nothing that could be verified is left out by that. The items are the stated query
set: they are taken in blocks of proven size, each sent to all tasks, and the documents are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.words import mix, shingle_hashes, texts, word_hashes, words

BITS = 64
#: Bytes of item texts that are held in a task at once.
BLOCK_BYTES = 4 << 20
_SLOTS = 1 << 20


def fingerprints(shingles: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of ``width`` shingles."""
    bits = ((mix(shingles)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    signs = (sums[width:] - sums[:-width] > 0).astype(np.uint64)
    return (signs << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of two shingle lists."""
    both, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(counts[: len(a)], minlength=len(both)), np.bincount(counts[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum()) if len(both) else 0.0


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges ``low`` to ``high``: which range, and the place, of each of their places."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]


class Items:
    """Items of one size, with their Hamming blocks: keys in order, and the items in that order."""

    def __init__(self, ids: list[int], shingles: list[np.ndarray], radius: int):
        self.ids, self.shingles, self.radius = ids, shingles, radius
        self.prints = np.array([fingerprints(s, len(s))[0] for s in shingles], np.uint64)
        edges = np.linspace(0, BITS, min(BITS, radius + 1) + 1).astype(int)
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            mask = np.uint64((1 << int(high - low)) - 1)
            keys = (self.prints >> np.uint64(low)) & mask
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.uint64(low), mask, keys[order], order))

    def candidates(self, prints: np.ndarray) -> np.ndarray:
        """Windows and items that agree in a block, as ``window * items + item``, each pair once."""
        found = []
        for low, mask, keys, order in self.blocks:
            wanted = (prints >> low) & mask
            windows, at = _ranges(np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right"))
            found.append(windows * len(self.ids) + order[at])
        return np.unique(np.concatenate(found))

    def near(self, prints: np.ndarray, owners: np.ndarray | None = None, reach: int = 0) -> list[tuple[int, int, int]]:
        """(window, item, distance) of all pairs within the radius, and of those with ``owners`` within ``reach``."""
        pairs = self.candidates(prints)
        windows, items = pairs // len(self.ids), pairs % len(self.ids)
        distance = hamming(prints[windows], self.prints[items])
        close = distance <= self.radius
        found = set(zip(windows[close].tolist(), items[close].tolist(), distance[close].tolist()))
        if owners is not None and len(owners):
            apart = hamming(prints[:, None], self.prints[owners][None, :])
            window, at = np.nonzero(apart <= reach)
            found.update(zip(window.tolist(), owners[at].tolist(), apart[window, at].tolist()))
        return sorted(found)


class Index:
    """One block of items: their shingles to find windows by, and their fingerprints by size."""

    def __init__(self, rows: list[tuple[int, str]], size: int, radius: int, reach: int):
        self.size, self.reach = size, reach
        by_words: dict[int, tuple[list, list]] = {}
        keys, lengths, places = [], [], []
        for item, text in rows:
            hashes = word_hashes(words(text))
            if not len(hashes):
                continue
            shingles = shingle_hashes(hashes, size)
            ids, lists = by_words.setdefault(len(hashes), ([], []))
            keys.append(np.unique(shingles))
            lengths.append(np.full(len(keys[-1]), len(hashes)))
            places.append(np.full(len(keys[-1]), len(ids)))
            ids.append(item)
            lists.append(shingles)
        self.sizes = {n: Items(ids, lists, radius) for n, (ids, lists) in by_words.items()}
        none = np.zeros(0, np.int64)
        self.keys, self.lengths, self.items = (np.concatenate([none.astype(t), *v]) for v, t in ((keys, np.uint64), (lengths, np.int64), (places, np.int64)))
        order = np.lexsort((self.items, self.lengths, self.keys))
        self.keys, self.lengths, self.items = self.keys[order], self.lengths[order], self.items[order]
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.short = sorted(n for n in self.sizes if n < size)

    def _places(self, shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each item size, the places of shingles and the items of that size that own them, by place."""
        maybe = np.flatnonzero(self.slots[(shingles >> np.uint64(44)).astype(np.int64)])
        at, row = _ranges(*(np.searchsorted(self.keys, shingles[maybe], side) for side in ("left", "right")))
        places, lengths, items = maybe[at], self.lengths[row], self.items[row]
        for n in np.unique(lengths).tolist():
            yield n, places[lengths == n], items[lengths == n]

    def search(self, text: str, similarity: float) -> list[tuple[int, int, int, int, float]]:
        """The best window for each item in a text: item, first word, words, distance, similarity."""
        hashes = word_hashes(words(text))
        best: dict[int, tuple] = {}
        # Items below the shingle size are one shingle of their own length.
        runs = [(n, shingle_hashes(hashes, n)) for n in self.short if len(hashes) >= n]
        for size, shingles in [(self.size, shingle_hashes(hashes, self.size)), *runs]:
            if not len(shingles):
                continue
            for n, places, owners in self._places(shingles):
                if (n < self.size) != (size < self.size) and len(hashes) >= self.size:
                    continue
                listed = self.sizes[n]
                full = max(1, n - self.size + 1)
                width = min(full, len(shingles))
                # The smaller counts of a window and an item sum up to this at least if they are similar.
                need = max(1, int(np.ceil(similarity * (width + full) / (1 + similarity) - 1e-9)))
                cuts = np.flatnonzero(np.diff(places) > width) + 1
                for cluster, owning in zip(np.split(places, cuts), np.split(owners, cuts)):
                    first = max(0, int(cluster[0]) - width + 1)
                    last = min(len(shingles) - width, int(cluster[-1]))
                    part = shingles[first : last + width]
                    items, met = np.unique(owning, return_counts=True)
                    for window, item, distance in listed.near(fingerprints(part, width), items[met >= need], self.reach):
                        got = weighted_similarity(part[window : window + width], listed.shingles[item])
                        row = (-got, first + window, min(n, len(hashes)), distance)
                        name = listed.ids[item]
                        if got >= similarity and (name not in best or row < best[name]):
                            best[name] = row
        return [(name, at, n, distance, -score) for name, (score, at, n, distance) in sorted(best.items())]


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *,
    size: int = 5, similarity: float = 0.75, radius: int = 9, reach: int = 24, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start_word, n_words, distance, similarity.

    The row tells the best window, the first of equals. Windows have the item's number of words,
    or the whole text where it is shorter. A reach of 24 of 64 bits leaves out a window of
    similarity 0.75 with a chance of about one in a hundred thousand. Null and empty texts and
    items match nothing; rows without a doc_id or item_id are left out; an item or document that
    repeats is reported once for each repeat of the document. Empty tables give an empty one. Other
    columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text")).where(F.col("node").isNotNull())
    listed = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    schema = "doc_id long, item_id long, start_word long, n_words long, distance long, similarity double"
    names = ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"]
    kinds = [*[pa.int64()] * 5, pa.float64()]

    def searching(shared):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, size, radius, reach)
            for batch in batches:
                rows = []
                for node, value in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                    rows += [(node, *hit) for hit in index.search(value, similarity)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        return make

    out = None
    for block in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        found = slim.mapInArrow(searching(spark.sparkContext.broadcast([tuple(r) for r in rows])), schema)
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})
