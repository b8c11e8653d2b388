"""Near-duplicates by MinHash signatures whose coordinates are posted and merged.

A document's set is its distinct word shingles. Its signature has one minimum for each of
``coordinates`` hash functions; a coordinate with its value is a *token*, and two documents
collide once for each token they share. Pairs that can reach the similarity collide in at least
``matches`` tokens, but for a chance of about one in a million for the defaults (binomial tail of
64 trials at 0.75 below 30), so:

* documents with the same set form a class; only its smallest id goes on;
* tokens of one class only are dropped, and a class with fewer than ``matches`` shared tokens;
* *prefix*: with tokens ordered from rare to frequent, two classes that share ``matches`` of them
  share one among their first ``coordinates - matches + 1``; only those are posted;
* *stars*: each class counts its collisions with the first class of each of its lists, and its
  best partner is compared on full sets, which gives components;
* *families*: components whose members collide often enough with a leader are one family. In a
  family the members outside its largest component are held against all others on full sets, in
  pairs of blocks of bounded size, and only links that join components are returned. So a group of
  copies costs its stars and never its pairs;
* *skip merging*: in the lists that span several families, the members outside the largest one
  merge their posting lists, skip the members that an earlier list has counted, and pairs with
  enough collisions are compared on full sets. A long list is cut into blocks too.

All links are confirmed on the full sets. Links inside a component that is known already are not
needed for the components and are not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.bloom import listed_only
from kinetable.llm.tables import components, stored
from kinetable.llm.words import odd_multipliers, shingle_set, texts

_CHUNK = 1024


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the minimum of each hash function over a set."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _CHUNK):
        np.minimum(low, (shingles[start : start + _CHUNK, None] * multipliers[None, :]).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, size: int = 5, coordinates: int = 64) -> DataFrame:
    """One row per document: ``node``, ``n_shingles``, ``digest`` of the set and ``sig`` (null without shingles)."""
    multipliers = odd_multipliers(coordinates, 17)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sigs = [], [], []
            for value in texts(batch.column(1)):
                shingles = shingle_set(value, size)
                counts.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                sigs.append(signature(shingles, multipliers) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                names=["node", "n_shingles", "digest", "sig"])

    slim = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    return slim.mapInArrow(make, "node long, n_shingles long, digest binary, sig array<int>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``(node, shingles)`` of the documents in ``wanted`` (``node``, ``digest``), from their texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, digest, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                shingles = shingle_set(value, size)
                if xxhash.xxh3_128_digest(shingles.tobytes()) == digest:
                    nodes.append(node)
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    slim = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text")).where(F.col("node").isNotNull())
    joined = listed_only(slim, "node", stored(wanted.select("node", "digest"), "wanted")).select("node", "digest", "text")
    return joined.mapInArrow(make, "node long, shingles array<long>")


def skip_merge(
    token: int, labels: np.ndarray, flat: np.ndarray, starts: np.ndarray, prefix: np.ndarray, needed: int
) -> Iterator[tuple[int, int]]:
    """Pairs of members of one token's list, with different labels, that share ``needed`` tokens or more.

    Member ``i`` has the tokens ``flat[starts[i]:starts[i + 1]]``, the first ``prefix[i]`` of them
    posted. Only members outside the list's largest component probe, as pairs inside one component
    are not wanted. A probe first merges the lists of its posted tokens below ``token``: a member
    met there shares an earlier list, which counts the pair, and is skipped. Only if some member is
    left are all lists merged and the collisions counted.
    """
    n = len(labels)
    names, sizes = np.unique(labels, return_counts=True)
    if len(names) < 2:
        return
    probing = labels != names[np.argmax(sizes)]
    owner = np.repeat(np.arange(n), np.diff(starts))
    posted = np.arange(len(flat)) - starts[owner] < prefix[owner]

    def lists(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(flat[of], kind="stable")
        return flat[of][order], owner[of][order]

    heads, tails = lists(np.flatnonzero(posted)), lists(np.flatnonzero(~posted))

    def hits(index: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(index[0], tokens, "left"), np.searchsorted(index[0], tokens, "right")
        found = [index[1][i:j] for i, j in zip(low.tolist(), high.tolist()) if j > i]
        return np.bincount(np.concatenate(found), minlength=n) if found else np.zeros(n, np.int64)

    for probe in np.flatnonzero(probing).tolist():
        wanted = labels != labels[probe]
        wanted[:probe] &= ~probing[:probe]  # two probes meet once
        row = flat[starts[probe] : starts[probe + 1]]
        own = row[: prefix[probe]]
        earlier = own[own < token]
        if len(earlier):
            wanted &= hits(heads, earlier) == 0
        if not wanted.any():
            continue
        count = hits(heads, row) + hits(tails, row)
        for other in np.flatnonzero(wanted & (count >= needed)).tolist():
            yield probe, other


def joining_links(labels: np.ndarray, flat: np.ndarray, starts: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between members of different labels that connect what no earlier one connected.

    Member ``i`` has the set ``flat[starts[i]:starts[i + 1]]``. Members outside the largest label
    probe; a probe merges the posting lists of its whole set, which gives its exact overlaps.
    """
    n = len(labels)
    names, label, counts = np.unique(labels, return_inverse=True, return_counts=True)
    order = np.argsort(flat, kind="stable")
    keys, holders = flat[order], np.repeat(np.arange(n), np.diff(starts))[order]
    sizes = np.diff(starts)
    group = label.copy()  # of each member, as links join them
    for probe in np.flatnonzero(label != np.argmax(counts)).tolist():
        if (group == group[probe]).all():
            continue
        row = flat[starts[probe] : starts[probe + 1]]
        low, high = np.searchsorted(keys, row, "left"), np.searchsorted(keys, row, "right")
        common = np.bincount(np.concatenate([holders[i:j] for i, j in zip(low.tolist(), high.tolist())]), minlength=n)
        linked = (100 * common >= percent * (sizes + sizes[probe] - common)) & (group != group[probe])
        for other in np.flatnonzero(linked).tolist():
            if group[other] != group[probe]:
                yield probe, other
                group[group == group[other]] = group[probe]


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
    size: int = 5, percent: int = 75, coordinates: int = 64, matches: int = 30, block: int = 256,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have ``100 * intersection >= percent * union`` are linked; the
    component is the smallest id that links reach. Empty and null texts have no shingles, are
    linked with nothing and are kept. Rows that repeat a doc_id are one document and get one
    component; a null doc_id is linked with nothing, has a null component and is kept. An empty
    table gives an empty one. Other columns of ``docs`` are not read.
    """
    every = stored(signatures(docs, doc_id, text, size=size, coordinates=coordinates), "signatures")
    known = every.where(F.col("node").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(known.groupBy("digest").agg(F.min("node").alias("node"), F.first("sig").alias("sig")), "classes")

    place = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    tokens = classes.select("node", F.posexplode("sig").alias("pos", "value")).select("node", place.alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    ranked = ranked.where(F.size("ranked") >= matches)
    # The tokens of one class only come first in the order, so they take their part of the prefix.
    alive = stored(ranked.select(
        "node", F.col("ranked.token").alias("tokens"),
        F.slice(F.col("ranked.token"), F.lit(1), F.size("ranked") - matches + 1).alias("prefix")), "prefixes")
    sets = stored(shingle_sets(docs, alive.join(classes.select("node", "digest"), "node"), doc_id, text, size), "sets")
    labels = alive.select("node", F.col("node").alias("component"))
    alone = alive.select("node", F.col("node").alias("component"))
    links = stored(_confirmed(_star(alive, alone, matches, 0), sets, percent), "links")
    labels = _labels(alive, links)
    families = _labels(alive, labels.where("node != component").toDF("a", "b").union(_star(alive, labels, matches, 1)))
    links = links.union(stored(_within(labels, families, sets, percent, block), "within"))
    links = stored(links.union(_confirmed(_across(alive, families, matches, 4 * block), sets, percent)), "links")
    labels = _labels(alive, links)
    again = known.groupBy("node").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").select("node")
    leads = classes.select("digest", F.col("node").alias("lead"))
    same = known.join(again, "node").join(leads, "digest").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    if not same.isEmpty():  # an id that repeats with another text
        labels = components(links.union(same))
    return _members(every, classes, labels, doc_id)


def _labels(alive: DataFrame, links: DataFrame) -> DataFrame:
    reached = components(links).withColumnRenamed("component", "reached")
    found = alive.select("node").join(reached.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    return stored(found.select("node", F.coalesce("reached", "node").alias("component")), "labels")


def _open_posts(alive: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts with their component, and the tokens whose list spans more than one component."""
    posts = alive.join(labels, "node").select("node", "component", F.explode("prefix").alias("token"))
    spans = posts.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    return posts, spans.where("low < high").select("token", "members")


def _star(alive: DataFrame, labels: DataFrame, matches: int, turn: int) -> DataFrame:
    """Each class with its best partner among the leaders of its lists."""
    posts, spans = _open_posts(alive, labels)
    posts = posts.join(spans.select("token"), "token")
    order = F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "node")
    lead = posts.groupBy("token").agg(F.min(F.struct(order.alias("rank"), F.col("node").alias("leader"), F.col("component").alias("to"))).alias("first"))
    lead = lead.select("token", "first.leader", "first.to")
    pairs = posts.join(lead, "token").where("component != to").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("hits"))
    own = alive.select("node", F.col("tokens").alias("own"))
    other = alive.select(F.col("node").alias("leader"), F.col("tokens").alias("other"))
    counted = pairs.join(own, "node").join(other, "leader")
    counted = counted.select("node", "leader", F.size(F.array_intersect("own", "other")).alias("collisions")).where(F.col("collisions") >= matches)
    best = counted.groupBy("node").agg(F.max(F.struct("collisions", (-F.col("leader")).alias("minus"))).alias("best"))
    return best.select(F.col("node").alias("a"), (-F.col("best.minus")).alias("b"))


def _within(labels: DataFrame, families: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between the components of each family, found on the full sets.

    Members outside a family's largest component are held against all others, in pairs of blocks.
    A pair of blocks returns links that join components it has not joined yet, not all its links.
    """
    member = labels.join(families.withColumnRenamed("component", "family"), "node")
    sizes = member.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("family").agg(
        F.max(F.struct("n", F.col("component").alias("at"))).alias("main"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    shape = shape.select("family", F.col("main.at").alias("main"), F.ceil((F.col("total") - F.col("main.n")) / block).alias("asking"), F.ceil(F.col("main.n") / block).alias("asked"))
    placed = member.join(shape, "family").withColumn("hash", F.xxhash64("node"))
    own = F.when(F.col("component") == F.col("main"), F.col("asking") + F.pmod("hash", "asked")).otherwise(F.pmod("hash", "asking"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("asking") + F.col("asked") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    spread = placed.select("family", "node", "component", F.explode(F.filter(every, lambda p: p["i"] < F.col("asking"))).alias("part"))
    held = spread.join(sets, "node").select("family", "part.i", "part.j", F.struct("node", "component", "shingles").alias("member"))
    groups = held.groupBy("family", "i", "j").agg(F.collect_list("member").alias("members"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for members in batch.column(0):
                node, component, shingles = members.values.flatten()
                ids, flat = node.to_numpy(), shingles.flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(pc.list_value_length(shingles).to_numpy())])
                pairs += [(ids[x], ids[y]) for x, y in joining_links(component.to_numpy(), flat, starts, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return groups.select("members").mapInArrow(make, "a long, b long").distinct()


def _across(alive: DataFrame, labels: DataFrame, matches: int, block: int) -> DataFrame:
    """Pairs from different families that collide often enough, by skip merging of every open list."""
    posts, spans = _open_posts(alive, labels)
    cut = posts.join(spans, "token").withColumn("blocks", F.ceil(F.col("members") / block))
    own = F.pmod(F.xxhash64("node"), "blocks")
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    spread = cut.select("token", "node", "component", F.explode(others).alias("part"))
    member = F.struct("node", "component", "tokens", F.size("prefix").alias("posted"))
    held = spread.join(alive.select("node", "tokens", "prefix"), "node")
    groups = held.groupBy("token", "part.i", "part.j").agg(F.array_sort(F.collect_list(member)).alias("members"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for token, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                node, component, tokens, posted = members.values.flatten()
                ids, flat = node.to_numpy(), tokens.flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])
                for x, y in skip_merge(token, component.to_numpy(), flat, starts, posted.to_numpy(), matches):
                    left.append(ids[x])
                    right.append(ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return groups.select("token", "members").mapInArrow(make, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the similarity on their full sets."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    sized = pairs.join(first, "a").join(second, "b").select(
        "a", "b", F.size(F.array_intersect("one", "two")).cast("long").alias("common"), (F.size("one") + F.size("two")).cast("long").alias("both"))
    return sized.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b").distinct()


def _members(every: DataFrame, classes: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    """The component of each row; an id that repeats with another text joins its components."""
    to = classes.select("digest", F.col("node").alias("lead"))
    to = to.join(labels.select(F.col("node").alias("lead"), "component").distinct(), "lead", "left")
    to = to.select(F.col("digest").alias("set"), F.coalesce("component", "lead").alias("component"))
    placed = every.select("node", "n_shingles", "digest").join(to, F.col("digest") == F.col("set"), "left")
    found = F.when(F.col("node").isNotNull(), F.coalesce("component", "node"))
    return placed.select(
        F.col("node").alias(doc_id), "n_shingles", found.alias("component_id"), F.col("node").eqNullSafe(found).alias("kept"))
