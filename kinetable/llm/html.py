"""Main text of a page by the maximum-scoring subsequence of its words and tags.

A page is read as a sequence of words and tags. Words score by the innermost region they stand in
(``article``, ``nav``, ``div.ad`` ...) and tags by their name; tags are never positive. The scores
are log odds of lying inside the main text, counted on pages that mark it. One linear scan finds
the contiguous run with the greatest sum; the blocks of that run are the text, without the parts
that are no main text wherever they stand.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are counted on, about; those whose hash falls into one of as many parts as it takes.
SAMPLE_PAGES = 5_000
#: Words or tags of a name in the sample, from which on the name has a learned weight.
LEAST_SEEN = 5

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed", "xmp")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
FLOW = frozenset("p br h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption hr html center".split())
MAIN = frozenset(("article", "main"))
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg button select option textarea input dialog menu object canvas noembed xmp title".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement banner cookie cookies notice notices promo sponsored sponsor sidebar comment comments menu nav navbar navigation breadcrumb breadcrumbs "
    "footer related share sharing social newsletter subscribe popup modal".split())
# A paragraph ends where one of these begins.
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[^\W_]+")


@dataclass
class Element:
    name: str
    region: str
    dropped: bool
    main: bool


@dataclass
class Weights:
    """Scores of words by region and of tags by name."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, region: str, dropped: bool, main: bool) -> float:
        if dropped:
            return 0.0 if main else -3.0  # inside the main text a dropped part must not cut it in two
        learned = self.words.get(region, 1.0 if main or region in ("", "body") else 0.5)
        return max(1.0, learned) if main else learned

    def tag(self, name: str, main: bool = False) -> float:
        """Inside marked main text a tag costs nothing: no list, table or heading there may cut it."""
        return 0.0 if main else min(-0.05, self.tags.get(name, -0.5))


@dataclass
class Piece:
    """A run of text or a tag, in page order."""

    text: str = ""
    tag: str = ""
    region: str = ""
    dropped: bool = False
    main: bool = False
    breaks: bool = False


def pieces(page: str) -> Iterator[Piece]:
    """Texts and tags of a page with the region they stand in."""
    open_elements: list[Element] = [Element("", "", False, False)]
    opened: Counter = Counter()  # names of open elements, so that an end tag without a start looks no further

    def close(name: str, over: frozenset | None = None) -> None:
        """Close the innermost element of a name and all in it; with ``over`` only if all in it are of those."""
        if opened[name]:
            depth = next(d for d in range(len(open_elements) - 1, 0, -1) if open_elements[d].name == name)
            if over is None or all(e.name in over for e in open_elements[depth + 1 :]):
                opened.subtract(e.name for e in open_elements[depth:])
                del open_elements[depth:]

    def run(text: str) -> Piece:
        top = open_elements[-1]
        return Piece(text=html.unescape(text), region=top.region, dropped=top.dropped, main=top.main)

    at = 0
    for found in _TOKEN.finditer(page):
        if found.start() > at:
            yield run(page[at : found.start()])
        at = found.end()
        if found["name"] is None:
            continue  # a comment, a declaration or an element whose content is no text
        name = found["name"].lower()
        breaks = name not in INLINE
        if found["close"]:
            close(name)
        elif name not in VOID and not found["rest"].endswith("/"):
            if name in ENDS_PARAGRAPH:
                close("p", INLINE)
            above = open_elements[-1]
            marks = {w for m in _NAMES.finditer(found["rest"] or "") for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())}
            bad = name in DROPPED or bool(marks & DROPPED_NAMES) or (name == "header" and not above.main)
            main = above.main or (name in MAIN and not above.dropped)
            region = above.region
            if name not in INLINE and name not in FLOW:
                region = ".".join([name, *sorted(marks & DROPPED_NAMES)])
            open_elements.append(Element(name, region, above.dropped or bad, main))
            opened[name] += 1
        top = open_elements[-1]
        yield Piece(tag=name, region=top.region, dropped=top.dropped, main=top.main, breaks=breaks)
    if at < len(page):
        yield run(page[at:])


def count_page(page: str | None) -> Counter:
    """How often words of each region and tags of each name lie inside and outside the marked main text."""
    counts: Counter = Counter()
    inside = False
    for piece in pieces(page or ""):
        inside = piece.main and not piece.dropped
        if piece.tag:
            counts["tag", piece.tag, inside] += 1
        elif n := len(_WORDS.findall(piece.text)):
            counts["word", piece.region, inside] += n
    return counts


def learn(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Log odds of lying inside, at most 5 either way."""

    def odds(kind: str) -> dict[str, float]:
        names = {n for k, n, _ in counts if k == kind}
        raw = {n: math.log((counts.get((kind, n, True), 0) + 1) / (counts.get((kind, n, False), 0) + 1)) for n in names}
        return {n: max(-5.0, min(5.0, x)) for n, x in raw.items()}

    return Weights(odds("word"), odds("tag"))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Half-open bounds of the contiguous run with the greatest positive sum; the first of equals."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best run: white space in a block is one space, blocks are joined by a newline."""
    found = list(pieces(page or ""))
    if not found:
        return ""
    scores = [weights.tag(p.tag, p.main) if p.tag else weights.word(p.region, p.dropped, p.main) * len(p.text.split()) for p in found]
    first, last = best_run(scores)
    if first == last:
        return ""
    while first > 0 and not found[first - 1].breaks:  # whole blocks
        first -= 1
    while last < len(found) and not found[last].breaks:
        last += 1
    blocks, block = [], []
    for piece in found[first:last]:
        if piece.breaks:
            blocks.append(" ".join("".join(block).split()))
            block = []
        elif not piece.tag and not piece.dropped:
            block.append(piece.text)
    blocks.append(" ".join("".join(block).split()))
    return "\n".join(b for b in blocks if b)


def fit(pages: DataFrame, page_id: str = "page_id", markup: str = "html", *, sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from about ``sample`` pages that mark their main text with article or main.

    The pages are counted by tasks; what the driver reads is one row per region and tag name.
    """
    labelled = pages.where(F.lower(F.col(markup)).rlike("<(article|main)[ >]"))
    parts = max(1, -(-labelled.count() // sample))
    chosen = labelled.where(F.pmod(F.xxhash64(page_id, markup), F.lit(parts)) == 0).select(F.col(markup).alias("html"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(count_page(value.as_py()))
        rows = [(*key, n) for key, n in counts.items()]
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "name", "inside", "n"])

    counted = chosen.mapInArrow(make, "kind string, name string, inside boolean, n long")
    # Names are element names and marks of a fixed list, but a page may invent elements: rare names keep the fixed scores.
    summed = counted.groupBy("kind", "name").agg(*[F.coalesce(F.sum(F.when(F.col("inside") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in ((True, "within"), (False, "beside"))])
    rows = summed.where(F.col("within") + F.col("beside") >= LEAST_SEEN).collect()
    return learn({(r["kind"], r["name"], inside): r[c] for r in rows for inside, c in ((True, "within"), (False, "beside"))})


def extracted(markup: Column, weights: Weights) -> Column:
    """Main text of each whole page."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, weights) for page in batch], dtype="object")

    return text(markup)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", *, sample: int = SAMPLE_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page, and one without a run of positive score, has an empty text. Without any
    labelled page fixed scores are used. Null ids and urls stay null, repeated rows give repeated
    rows, an empty table an empty one. Other columns are not read.
    """
    weights = fit(pages, page_id, markup, sample=sample)
    done = pages.select(F.col(page_id).alias(page_id), F.col(url).alias(url), extracted(F.col(markup), weights).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
