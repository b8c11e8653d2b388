"""Token shards, spelling variants and the prefix trie against brute force and on awkward tables."""

import glob
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetable.llm import spelling, trie, wavelet

BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, node long, mixed long, row long, word string, n long, ids binary"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "w", 4, b"x") for i, t in rows], DOCS)


# Token shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=300), st.integers(0, 70000))
def test_shard_holds_ids(ids, token):
    data = np.array(ids, np.uint32)
    shard = wavelet.TokenShard(wavelet.encode_shard(data, [7], [len(ids)]))
    assert shard.ids().tolist() == ids
    assert shard.take(np.arange(len(ids))).tolist() == ids
    for t in {token, *ids[:5]}:
        places = [i for i, x in enumerate(ids) if x == t]
        assert shard.occurrences(t).tolist() == places
        assert shard.count(t, 3, 200) == sum(3 <= i < 200 for i in places)
        assert [shard.select(t, k) for k in range(len(places))] == places
    with pytest.raises(IndexError):
        shard.access(len(ids))


def test_shard_of_many_chunks_reads_few():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 300_000), 50_000).astype(np.uint32)
    data = wavelet.encode_shard(ids, [1, None], [100_000, 200_000])
    seen = []

    def read(start, size):
        seen.append(size)
        return data[start : start + size]

    shard = wavelet.TokenShard(read)
    assert shard.documents()[0] == [1, None] and shard.documents()[1].tolist() == [0, 100_000, 300_000]
    seen.clear()
    assert shard.count(17, 1000, 250_000) == int((ids[1000:250_000] == 17).sum())
    assert len(seen) <= 2 * shard.planes and sum(seen) < len(data) // 2
    places = np.flatnonzero(ids == 17)
    assert (shard.occurrences(17) == places).all() and shard.select(17, 5) == places[5]
    assert (shard.take(places) == 17).all() and (shard.ids() == ids).all()
    assert len(data) < 2 * len(ids)
    with pytest.raises(ValueError):
        wavelet.TokenShard(b"x" * 64)


def library_ids(text):
    return [*Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids, 0]


def test_token_shards_round_trip(llm_spark, tmp_path):
    rng = random.Random(4)
    rows = [(i * 3, " ".join(rng.choice(["alpha", "béta", "12", "\n\n", "  ", "<|endoftext|>", "y's"]) for _ in range(rng.randrange(60)))) for i in range(50)]
    rows += [(None, "no id"), (None, None), (4, ""), (4, "twice"), (4, "twice"), (10**12, "long " * 30000), (-5, "first")]
    table = docs(llm_spark, rows).repartition(5)
    manifest = wavelet.write_token_shards(table, BYTES, str(tmp_path / "shards"), shard_tokens=400, partitions=6)
    got = wavelet.read_tokens(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = Counter((i, tuple(library_ids(t))) for i, t in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == starts[:-1].tolist() and all(len(r.ids) == 4 * r.n_tokens for r in got)
    shards = manifest.orderBy("base").collect()
    assert [s.file for s in shards] == sorted(s.file for s in shards) and len(shards) > 6
    assert len(glob.glob(f"{tmp_path}/shards/shards/*.kwm")) == len(shards)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    token = library_ids("alpha")[0]
    assert wavelet.count_token(manifest, token).first().n == int((whole == token).sum())
    found = wavelet.find_token(manifest, token).orderBy("place").collect()
    assert [r.place for r in found] == np.flatnonzero(whole == token).tolist()
    owner = {r.start: r.doc_id for r in got}
    assert all(owner[r.place - r.position] == r.doc_id for r in found)


def test_token_shards_of_nothing(llm_spark, tmp_path):
    manifest = wavelet.write_token_shards(docs(llm_spark, []), BYTES, str(tmp_path / "none"))
    assert wavelet.read_tokens(manifest).collect() == [] and wavelet.count_token(manifest, 5).first().n == 0


def test_one_id_goes_to_several_parts(llm_spark, tmp_path):
    table = docs(llm_spark, [(7, "same text")] * 4000 + [(8, "other")]).repartition(8)
    manifest = wavelet.write_token_shards(table, BYTES, str(tmp_path / "hot"), partitions=8)
    assert manifest.agg(F.max("n_docs")).first()[0] < 2000
    assert wavelet.read_tokens(manifest).count() == 4001


# Spelling variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=6, count=5, factor=5, every=None):
    n = Counter()
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        word = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                word += c
                continue
            if word:
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                if every and h % every == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                n[word] += 1
            word = ""
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    out, form = {}, {}
    for w in n:
        near = [x for x in n if x != w and one_apart(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
        out[w] = [n[w], len(near), n.get(form[w])]
    for w in n:
        last = w
        while form[last]:
            last = form[last]
        out[w] = (w, form[w], last, *out[w])
    return set(out.values())


def misspelt(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcé") + word[at:], word[:at] + rng.choice("abcé") + word[at + 1 :]])


def word_rows(rng):
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 10))) for _ in range(25)] + ["Élan" * 14, "x" * 47, "x" * 48, "x" * 49]
    rows = []
    for i in range(120):
        words = [rng.choice(base) for _ in range(30)]
        words = [misspelt(rng, w) if rng.random() < 0.25 else w for w in words]
        rows.append((i, rng.choice([" ", ", ", "9", "_"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words)))
    long = "tail" * 3000
    return rows + [(None, "stray words " * 9), (3, None), (4, ""), (5, " \n"), (6, "12 ÷÷÷÷÷÷ ××××××"), (7, long), (8, " ".join([long, long[:-1]] * 6)), rows[0], rows[0]]


@pytest.mark.parametrize("every,block", [(None, 2048), (3, 2048), (3, 6)])
def test_spelling_variants(llm_spark, every, block):
    rows = word_rows(random.Random(every or 1))
    got = spelling.spelling_variants(docs(llm_spark, rows).repartition(5), typo_every=every, block_words=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = plain_variants(rows, every=every)
    assert len(got) == len(want) and {(w, f, r, n, k, fn) for w, f, r, n, k, fn in got} == want
    assert sum(r[1] is not None for r in got) > 5


def test_spelling_of_nothing(llm_spark):
    assert spelling.spelling_variants(docs(llm_spark, [])).collect() == []
    assert spelling.spelling_variants(docs(llm_spark, [(1, None), (2, "few words")])).collect() == []


def test_large_groups_are_split(llm_spark):
    """Words that share their first half are compared without a block that holds them all."""
    rng = random.Random(2)
    words = sorted({"commonstart" + "".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(1500)})
    words = sorted({*words, *(misspelt(rng, w) for w in words)})
    table = llm_spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    groups = spelling._grouped(table, 100).groupBy("span", "head", "tail", "key").count()
    assert groups.agg(F.max("count")).first()[0] <= 100
    left, right = spelling.near_pairs(words)
    want = {(words[a], words[b]) for a, b in zip(left.tolist(), right.tolist())}
    assert {(r.word, r.near) for r in spelling.near_words(table, block_words=100).collect()} == want


# Prefix trie

TURNS = "conv_id long, turn long, role string, text string, block long, depth long, key string, h long, size long, base long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4, 5) for r in rows], TURNS)


def plain_trie(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = set()
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in below if x}
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        out.add((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(x) == len(node) + 1 for x in below),
            sum(x not in parents for x in below), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def plain_paths(rows, family=5, most=9):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % most for c in own}
    return {c: own.get(c - int(np.fmod(c, family)), [])[: h[c]] + own[c][h[c] :] for c in own}


def chat_rows(rng):
    rows = []
    for c in [*range(60), 1007, 1008, 1009, -3, -7]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "é:1", "", None])))
    rows += [(70, t, "user", str(t % 3)) for t in range(45)] + [(71, t, "user", str(t % 3)) for t in range(44)]
    rows += [(75, None, None, None), (75, None, "b", "z"), (75, 1, "b", "z"), (75, 1, "b", "z"), (None, 1, "user", "lost"), (80, 0, "user", "x" * 50000)]
    return rows


@pytest.mark.parametrize("block", [8, 1, 3])
def test_prefix_trie(llm_spark, block):
    rows = chat_rows(random.Random(6))
    got = trie.prefix_trie(trie.rebuilt_turns(turns(llm_spark, rows).repartition(5)), block=block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in got.collect()]
    want = plain_trie(plain_paths(rows))
    assert len(got) == len(want) and set(got) == want


def test_trie_in_small_segments(llm_spark, small_segments):
    rows = chat_rows(random.Random(7))
    got = trie.prefix_trie(trie.rebuilt_turns(turns(llm_spark, rows)), block=2).collect()
    assert {tuple(r) for r in got} == plain_trie(plain_paths(rows))


def test_trie_of_nothing(llm_spark):
    assert trie.prefix_trie(trie.rebuilt_turns(turns(llm_spark, []))).collect() == []


def test_trie_runs_of_ends(llm_spark, monkeypatch):
    """A node at which very many conversations end is written out in several runs."""
    monkeypatch.setattr(trie, "IDS_PER_RUN", 7)
    rows = [(c, t, "user", "same") for c in range(0, 500, 5) for t in range(9)]
    got = {tuple(r) for r in trie.prefix_trie(trie.rebuilt_turns(turns(llm_spark, rows))).collect()}
    assert got == plain_trie(plain_paths(rows))
