"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, all
hashed into buckets; a document's vector is the mean over its words; a linear softmax scores it.
Embeddings and softmax are trained together in numpy on a bounded sample of labelled documents, so
a misspelling that was never seen shares most n-gram vectors with the word it hides. After
training a bucket is worth one number, its embedding times the softmax weights, and so is a word.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is trained on, about; those whose hash falls into one of as many parts as it takes.
SAMPLE_DOCUMENTS = 5_000
BUCKETS = 1 << 17
CACHED_WORDS = 500_000
_ENTRIES = 1 << 18


def subwords(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word: the word in marks, and its n-grams of 3 to 5 characters."""
    marked = f"<{word.decode('utf-8', 'replace')}>"
    size = len(marked)
    grams = dict.fromkeys([marked, *[marked[i : i + n] for n in (3, 4, 5) for i in range(size - n + 1)]])
    digest = xxhash.xxh32_intdigest
    return [digest(g) % buckets for g in grams]


def bag(text: str | None) -> Counter:
    return Counter((text or "").encode("utf-8", "surrogatepass").lower().split())


@dataclass
class Model:
    """Worth of each bucket and the bias, on the log-odds scale."""

    worth: list[float]
    bias: float

    def __post_init__(self):
        self.worth = [float(x) for x in self.worth]  # look-ups of a few numbers are faster in a list

    def word(self, word: bytes) -> float:
        worth = self.worth
        buckets = len(worth)
        if len(word) > 256:  # a run without blanks is scored in pieces
            pieces = [self.word(word[i : i + 256]) for i in range(0, len(word), 256)]
            return sum(pieces) / len(pieces)
        found = subwords(word, buckets)
        return sum([worth[b] for b in found]) / len(found)

    def score(self, text: str | None, known: dict[bytes, float]) -> float:
        total, n = 0.0, 0
        for word, times in bag(text).items():
            worth = known.get(word)
            if worth is None:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                worth = known[word] = self.word(word)
            total += worth * times
            n += times
        odds = self.bias + (total / n if n else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(odds, -60.0, 60.0))))


def _sums(to: np.ndarray, size: int, weight) -> np.ndarray:
    """``bincount`` in slices, so that its copies stay small; ``weight`` gives the weights of a slice."""
    out = np.zeros(size)
    for at in range(0, len(to), _ENTRIES):
        part = slice(at, at + _ENTRIES)
        out += np.bincount(to[part], weight(part), size)
    return out


class _Gather:
    """``out[r] = sum(weight * rows[c])`` over fixed (r, c, weight), and its transpose."""

    def __init__(self, r: np.ndarray, c: np.ndarray, weight: np.ndarray, shape: tuple[int, int]):
        self.r, self.c, self.weight, self.shape = r, c, weight, shape

    def _run(self, to, frm, values, size):
        return np.stack([_sums(to, size, lambda part, v=v: self.weight[part] * v[frm[part]]) for v in np.ascontiguousarray(values.T)], axis=1)

    def __call__(self, values):
        return self._run(self.r, self.c, values, self.shape[0])

    def transposed(self, values):
        return self._run(self.c, self.r, values, self.shape[1])


def train(
    texts: Iterable[str | None], labels: Sequence[int], *, buckets: int = BUCKETS, width: int = 2, epochs: int = 50, rate: float = 0.2, scale: float = 32.0, decay: float = 1e-6,
    least: int = 8, favour: float = 0.5, seed: int = 3
) -> Model:
    """Fit embeddings and softmax together by gradient steps with momentum on whole texts.

    A step is scaled by the root mean square of its whole matrix, not of each entry, so that what
    many documents tell moves far and what one document tells hardly at all.

    A mean over a long text is small, so it is multiplied by ``scale``, and one telling word in
    sixty moves the score.

    Without texts every score is 0; with one class only, scores follow its share.

    Texts are read one after the other and not kept; the labels are read after them.
    """
    number: dict[bytes, int] = {}
    r, c, weight = array("i"), array("i"), array("f")
    for d, text in enumerate(texts):
        found = bag(text)
        total = sum(found.values())
        for word, times in found.items():
            r.append(d)
            c.append(number.setdefault(word, len(number)))
            weight.append(scale * times / total)
    if not len(labels):
        return Model(np.zeros(1, np.float32), -60.0)
    y = np.asarray(labels, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    prior = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Model(np.zeros(1, np.float32), prior)
    pooled = _Gather(np.frombuffer(r, np.int32), np.frombuffer(c, np.int32), np.frombuffer(weight, np.float32), (len(y), max(1, len(number))))
    flat, lengths = array("i"), array("i")
    for word in number:
        found = subwords(word, buckets)
        flat.extend(found)
        lengths.append(len(found))
    del number
    flat, lengths = np.frombuffer(flat, np.int32), np.frombuffer(lengths, np.int32)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    # A bucket that few documents hold says nothing of others: its vector stays zero.
    documents = np.bincount(pooled.c, minlength=len(lengths))
    common = _sums(flat, buckets, lambda part: documents[owner[part]]) >= min(least, 1 + len(y) // 50)
    used, place = np.flatnonzero(common), (np.cumsum(common) - 1).astype(np.int32)
    kept = common[flat]
    owner = owner[kept]
    flat = place[flat[kept]]
    del kept
    share_of_word = (1.0 / np.maximum(lengths, 1)).astype(np.float32)
    # Frequent n-grams vary more from text to text: each bucket is weighted by one over the root of its rate.
    rate_of_word = _sums(pooled.c, len(lengths), lambda part: pooled.weight[part]) / len(y) / scale
    rate_of = _sums(flat, max(1, len(used)), lambda part: share_of_word[owner[part]] * rate_of_word[owner[part]])
    evened = 1.0 / np.sqrt(np.maximum(rate_of, 1e-9) * max(1, len(used)))
    spread = share_of_word[owner]
    spread *= evened.astype(np.float32)[flat]
    spelled = _Gather(owner, flat, spread, (max(1, len(lengths)), max(1, len(used))))
    generator = np.random.default_rng(seed)
    params = [generator.normal(0, 0.1, (max(1, len(used)), width)), generator.normal(0, 0.1, (width, 2))]
    bias = np.array([-prior / 2, prior / 2])  # fixed: a text without words has the share of its class
    moments = [(np.zeros_like(p), np.zeros(1)) for p in params]
    target = np.eye(2)[y]
    weigh = np.where(y == 1, ((1 - share) / share) ** favour, 1.0)
    weigh = (weigh / weigh.sum())[:, None]
    for step in range(1, epochs + 1):
        table, softmax = params
        document = pooled(spelled(table))
        logits = document @ softmax + bias
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        wrong = (odds / odds.sum(axis=1, keepdims=True) - target) * weigh
        grads = [spelled.transposed(pooled.transposed(wrong @ softmax.T)) + decay * table, document.T @ wrong + decay * softmax]
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (np.mean(g * g) - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    table, softmax = params
    worth = np.zeros(buckets, np.float32)
    worth[used] = scale * (table * evened[:, None])[: len(used)] @ (softmax[:, 1] - softmax[:, 0])
    return Model(worth, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", *, sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Train on about ``sample`` labelled documents that are not held out.

    The labels are dealt by the hash of their id into parts of about that size, and one part is the
    sample. It is bounded, so it is broadcast to the documents, and its texts are read by the
    driver one after the other to train. A row without a label or an
    id is not learnt from, an id with several labels counts as the largest, and of several texts of an
    id the smallest is learnt from.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = usable.groupBy(F.col(doc_id).alias("node")).agg(F.max(label).alias("label"))
    parts = max(1, -(-chosen.count() // sample))
    chosen = chosen.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == 0)
    slim = docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text"))
    rows = slim.join(F.broadcast(chosen), "node").groupBy("node").agg(F.min("label").alias("label"), F.min("text").alias("text")).orderBy("node")
    known: list[int] = []

    def texts() -> Iterator[str | None]:
        for row in rows.toLocalIterator():
            known.append(int(row["label"]))
            yield row["text"]

    return train(texts(), known)


_WORDS: dict[int, dict[bytes, float]] = {}


def toxicity(text: Column, model) -> Column:
    """Score of each whole text from 0 to 1; ``model`` is a broadcast of a :class:`Model` (about a megabyte)."""

    key = xxhash.xxh3_64_intdigest(np.asarray([*model.value.worth, model.value.bias]).tobytes())

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _WORDS:  # kept from task to task in a Python worker
            _WORDS.clear()
        known = _WORDS.setdefault(key, {})
        fitted = model.value
        for batch in batches:
            yield pd.Series([fitted.score(t, known) for t in batch], dtype="float64")

    return scored(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", *, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a document without words, a null doc_id is not held out,
    repeated rows give repeated rows and an empty table an empty one. Without any usable label all
    scores are 0. Only the text is scored; labels, ids and other columns are no inputs.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label, sample=sample))
    scored = docs.select(F.col(doc_id).alias(doc_id), held_out(F.col(doc_id)).alias("held_out"), toxicity(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
