"""Token counts by byte-pair merging with a heap and a linked list.

The vocabulary is a ``tokenizers`` file of word-wise pairs: text is normalised (composed, white
space to one space, lower-cased), cut by the file's pattern, and each word starts as its bytes,
the last with the end-of-word mark. The lowest-ranked adjacent pair is merged until none is
left; a word has as many tokens as it had bytes less the merges done. No ids are made.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

CACHED_WORDS = 500_000


def byte_symbols() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for extra, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + extra)
    return [names[b] for b in range(256)]


class PairCounter:
    """Counts the tokens of texts; holds a bounded cache of words."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        model = parsed["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner, self.final = symbols, [s + self.suffix for s in symbols]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        split = parsed["pre_tokenizer"]["pretokenizers"][0]
        # Python's \s also takes the separators 1C to 1F, which are no white space to the library.
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", r"\p{White_Space}"))
        specials = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.wide = regex.compile(r"[^\x00-ʯ]")
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Symbols of one word less the merges done in it."""
        data = word.encode("utf-8", "surrogatepass")
        symbols: list[str | None] = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        count = len(symbols)
        ranks = self.ranks
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= count or symbols[j] != right:
                continue  # one of the two was merged meanwhile
            merges += 1
            symbols[i], symbols[j] = left + right, None
            after[i] = after[j]
            if after[j] < count:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < count:
                    pair = (symbols[a], symbols[b])
                    if pair in ranks:
                        heapq.heappush(heap, (ranks[pair], a, *pair))
        return count - merges

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if self.wide.search(text):
            text = self.library.normalize_str(text)
        else:
            text = text.lower()  # below U+02B0 nothing composes, and no letter depends on its neighbours
        known, total = self.known, 0
        for word, times in Counter(self.pattern.findall(text)).items():
            n = known.get(word)
            if n is None:
                n = self.word(word)
                if len(word) <= 64:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = n
            total += n * times
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token."""
        if self.specials is None or "<|" not in text:
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_COUNTERS: dict[int, PairCounter] = {}


def token_count(text: Column, definition) -> Column:
    """Tokens of each whole text. ``definition`` is a broadcast of the vocabulary file's content."""

    key = xxhash.xxh3_64_intdigest(definition.value)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _COUNTERS:  # kept from task to task in a Python worker
            _COUNTERS.clear()
            _COUNTERS[key] = PairCounter(definition.value)
        counter = _COUNTERS[key]
        for batch in batches:
            yield pd.Series([counter.count(t or "") for t in batch], dtype="int64")

    return counted(text)


def vocabulary(docs: DataFrame, path: str):
    """The vocabulary file (1 to 2 MB) as a broadcast, so that executors need no copy of the file."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", *, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated rows give
    repeated rows; an empty table gives an empty one. Other columns are not read.
    """
    counted = docs.select(
        F.col(doc_id).alias(doc_id), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col(text), vocabulary(docs, path)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
