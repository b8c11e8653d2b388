"""Grouping of spelling variants: words at one inserted, deleted or replaced letter, by bit-sliced sets.

For a block of words there is a bitset for each position and letter: the words that have that letter
there. A word is read letter by letter against all words of the block at once. One set holds the words
with no error so far; three more hold those with one error: replaced (same position), an extra letter in
the word read (position one back) and one missing from it (one ahead). Each step is a few operations on
machine words of 64 members, for every word of the block side by side.

Words meet in a block by an exact rule, not by chance: if two words are one error apart, then of the
shorter one's letters either the first half or the rest is unchanged. A group of words that share such a
part is split further by the same rule on the letters in doubt, until it fits a block, so a group of any
size is compared without pairs of blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.tables import stored
from kinetable.llm.words import texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task gathers before it hands its counts on.
GATHERED = 200_000
#: Words of a group and, on average, of a block. A group with one letter in doubt is not split: it holds
#: as many words as there are letters, and of the longer words as many as there are pairs of letters.
BLOCK_WORDS = 2048
BLOCKS_PER_TASK = 64
#: Longer words are compared with those of their length and one more, so that one of them does not widen all.
LONG_WORD = 48
STORED_SETS = 1 << 23


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, typo_every: int | None = None) -> DataFrame:
    """``(word, n)``: how often each run of letters occurs in all texts, lower-cased for A-Z only.

    With ``typo_every``, let h be the unsigned crc32 of ``<doc_id>:<run>``; where that number divides
    h, the run's letter at h modulo its length is deleted first. A null doc_id is written as nothing.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for node, value in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found = Counter(RUN.findall(value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if typo_every:
                    start = zlib.crc32(f"{'' if node is None else node}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        counts[word] += n
                else:
                    counts.update(found)
                if len(counts) >= GATHERED:
                    yield flush()
        yield flush()

    slim = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    return slim.mapInArrow(make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """Bitsets over a block of distinct words, one per position and letter; the end counts as a letter."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = len(words)
        self.length = max(map(len, words), default=0)
        points = np.zeros((self.size, self.length + 3), np.uint32)
        for row, word in enumerate(words):
            points[row, 1 : len(word) + 1] = np.frombuffer(word.encode("utf-32-le"), "<u4")
        letters, codes = np.unique(points, return_inverse=True)
        #: Letter numbers; column 0 and the columns behind a word hold the end, which is 0.
        self.codes = codes.reshape(points.shape)
        self.letters, self.lanes = len(letters), -(-self.size // 64)
        every = (self.length + 3) * self.letters * self.lanes
        self.set = lru_cache(maxsize=None if every <= STORED_SETS else 4)(self._set)

    def _set(self, at: int) -> np.ndarray:
        """The bitset of each letter at a position."""
        member = np.zeros((self.letters, self.lanes * 64), bool)
        member[self.codes[:, at], np.arange(self.size)] = True
        return np.packbits(member, axis=1, bitorder="little").view("<u8")

    def near(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, other) of places in the block, one error apart, for the words ``start`` to ``stop``."""
        read = self.codes[start:stop]
        none = np.full((len(read), self.lanes), ~np.uint64(0))
        replaced, extra, missing = (np.zeros_like(none) for _ in range(3))
        for at in range(1, self.length + 2):
            letter = read[:, at]
            here = self.set(at)[letter]
            replaced = (replaced & here) | (none & ~here)
            # ``extra``: the word read is one letter ahead; ``missing``: it is one letter behind.
            extra = (extra & self.set(at - 1)[letter]) | none
            missing = (missing | none) & self.set(at + 1)[letter]
            none &= here
        # The last step read the end, so what is left differs by one letter or not at all.
        bits = np.unpackbits((replaced | extra | missing).view(np.uint8), axis=1, bitorder="little", count=self.size)
        word, other = np.nonzero(bits)
        word += start
        apart = word != other
        return word[apart], other[apart]


def near_pairs(words: list[str], lanes_at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs of places of distinct words that are one error apart; memory is bounded."""
    lengths = np.array([len(word) for word in words], np.int64)
    bands = [(0, LONG_WORD), *((n, n + 1) for n in np.unique(lengths[lengths >= LONG_WORD]).tolist())]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for low, high in bands:
        members = np.flatnonzero((lengths >= low) & (lengths <= high))
        if len(members) > 1:
            index = PositionIndex([words[i] for i in members.tolist()])
            step = max(1, lanes_at_once // index.lanes)
            for at in range(0, index.size, step):
                word, other = index.near(at, min(at + step, index.size))
                found.append((members[word], members[other]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _grouped(words: DataFrame, limit: int) -> DataFrame:
    """Rows (word, n, key): any two words one error apart share a key, and at most ``limit`` words do.

    ``span`` is the length of the shorter word of a pair, so a word is in two spans. ``head`` first
    and ``tail`` last letters are unchanged; the letters between are halved while the group is large.
    """
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("span"))
    rows = _halved(rows.withColumns({"head": F.lit(0), "tail": F.lit(0)}))
    done = None
    while True:
        rows = stored(rows, "spelling_groups")
        key = ["span", "head", "tail", "key"]
        large = stored(rows.where("span - head - tail > 1").groupBy(*key).count().where(F.col("count") > limit).drop("count"), "large_groups")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fits = rows.join(large, key, "left_anti")
        done = fits if done is None else done.unionByName(fits)
        rows = _halved(rows.join(large, key, "left_semi"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: the first half of the letters in doubt unchanged, or the rest of them."""
    half = F.floor((F.col("span") - F.col("head") - F.col("tail")) / 2).cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"))
    rest = F.struct(F.col("head").alias("head"), (F.col("span") - F.col("head") - half).alias("tail"))
    both = rows.select("word", "n", "span", F.explode(F.array(first, rest)).alias("kept")).select("word", "n", "span", "kept.head", "kept.tail")
    return both.withColumn("key", F.concat(F.left("word", F.col("head")), F.lit("\n"), F.right("word", F.col("tail"))))


def near_words(words: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(word, n, near, near_n)`` for each ordered pair of distinct words one error apart; ``words`` has word and n."""
    rows = stored(_grouped(words, block_words).withColumn("key", F.xxhash64("span", "head", "tail", "key")).select("word", "n", "key"), "spelling_keys")
    blocks = max(1, -(-rows.count() // block_words))
    # Blocks are much work for little data, so their tasks are counted by blocks and not by bytes.
    tasks = min(blocks, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // BLOCKS_PER_TASK))
    dealt = rows.select(F.pmod("key", F.lit(blocks)).alias("block"), "word", "n").repartition(tasks, "block").sortWithinPartitions("block")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _runs(batches):
            names, counts = pa.array(members, pa.string()), pa.array(members.values(), pa.int64())
            word, other = map(pa.array, near_pairs(list(members)))
            yield pa.RecordBatch.from_arrays([names.take(word), counts.take(word), names.take(other), counts.take(other)], names=["word", "n", "near", "near_n"])

    return dealt.mapInArrow(make, "word string, n long, near string, near_n long").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, int]]:
    """The distinct words of each block with their counts; rows come block by block."""
    current, members = None, {}
    for batch in batches:
        for block, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if block != current and members:
                yield members
                members = {}
            current = block
            members[word] = n
    if members:
        yield members


def spelling_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least_letters: int = 6, least_count: int = 5,
    factor: int = 5, typo_every: int | None = None, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the distinct runs of letters (``word_counts``) of at least ``least_letters`` code points
    that occur at least ``least_count`` times in all texts. Two are near if they differ by exactly one
    inserted, deleted or replaced code point; ``n_near`` counts them. ``form`` is the near word that
    occurs most often (ties: the smallest in code-point order) if it does so at least ``factor`` times
    as often as the word, else null; ``form_n`` is its count. ``root`` is the last of the forms of forms,
    the word itself if it has none. Null and empty texts have no words; repeated rows count again; an
    empty table gives an empty one; other columns are not read.
    """
    if least_letters < 2 or factor < 2:
        raise ValueError("words need two letters at least, and the factor must be 2 or more")
    counted = word_counts(docs, doc_id, text, typo_every=typo_every)
    words = stored(counted.where((F.length("word") >= least_letters) & (F.col("n") >= least_count)), "words")
    best = near_words(words, block_words=block_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near"))).alias("best"))
    found = words.join(best, "word", "left")
    form_n = -F.col("best.rank")
    fits = form_n >= factor * F.col("n")
    found = stored(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, form_n).alias("form_n")), "forms")
    return found.join(_roots(found), "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for each word with a form. A form is ``factor`` times as frequent, so chains are short; each turn doubles the reach."""
    reach = stored(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(reach.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        reach = moved.drop("moved")
