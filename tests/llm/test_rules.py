"""The small functions that run inside tasks, against plain definitions."""

import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinetable.llm import decontaminate, exact, html, minhash, packing, substring, tokens, toxicity, words

ODD = [
    "", "a", "<|endoftext|>", "x<|endoftext|> y<|startoftext|><|endoftext|", "Σας ΣΑΣ Ὀδυσσεύς İstanbul", "日本語 한국어 😀👍🏽 naïve é ½ ² x\x1cy\x85z q",
    "it's we'll DON'T 12345 a1b2", "!!!???...&&&%%%", "\x00\x01\x7f", "ﬁ ß ẞ Å", "مرحبا بالعالم १२३", "a" * 3000, "ab" * 2000, "'S 'T İ'm", " \t\n\x0b\x0c\r "]


def plain_set(text, size=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


@pytest.mark.parametrize("text", [*ODD, "one two", "a b c d e", "A b C d e f a b c d e", None])
def test_shingle_sets_have_the_size_of_the_plain_ones(text):
    assert len(words.shingle_set(text)) == len(plain_set(text or ""))


def test_shingles_of_different_length_do_not_meet():
    assert not set(words.shingle_set("a b c d").tolist()) & set(words.shingle_set("a b c d e").tolist())


@pytest.mark.parametrize("seed", range(4))
def test_skip_merge_and_joining_links_against_all_pairs(seed):
    rng = random.Random(seed)
    rows = [sorted(rng.sample(range(40), rng.randint(8, 20))) for _ in range(60)]
    labels = np.array([rng.choice([0, 0, 1, 2, i + 10]) for i in range(60)])
    flat, starts = np.concatenate([np.array(r) for r in rows]), np.cumsum([0, *map(len, rows)])
    needed = 7
    prefix = np.array([len(r) - needed + 1 for r in rows])
    found = set()
    for token in range(40):
        inside = [i for i, r in enumerate(rows) if token in r[: prefix[i]]]
        if inside:
            part = np.concatenate([np.array(rows[i]) for i in inside])
            for x, y in minhash.skip_merge(token, labels[inside], part, np.cumsum([0, *[len(rows[i]) for i in inside]]), prefix[inside], needed):
                pair = tuple(sorted((inside[x], inside[y])))
                assert pair not in found
                found.add(pair)
    shared = {(i, j): len(set(rows[i]) & set(rows[j])) for i, j in itertools.combinations(range(60), 2)}
    assert found == {p for p, n in shared.items() if n >= needed and labels[p[0]] != labels[p[1]]}

    def closure(links):
        group = {i: labels[i] for i in range(60)}
        for i, j in links:
            old, new = group[i], group[j]
            group = {k: new if v == old else v for k, v in group.items()}
        return sorted(sorted(k for k in group if group[k] == g) for g in set(group.values()))

    similar = [p for p, n in shared.items() if 100 * n >= 50 * (len(rows[p[0]]) + len(rows[p[1]]) - n)]
    assert closure(minhash.joining_links(labels, flat, starts, 50)) == closure(similar)


def test_signature_estimates_the_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(251, 1251, dtype=np.uint64)
    many = words.odd_multipliers(512, 17)
    one, two = (minhash.signature(words.mix(x), many) for x in (a, b))
    assert abs((one == two).mean() - 0.6) < 0.1


@pytest.mark.parametrize("size", [0, 1, 10, exact.CHUNK - 1, exact.CHUNK, exact.CHUNK + 1, 3 * exact.CHUNK + 7])
def test_fingerprints_compose(size):
    data = random.Random(size).randbytes(size)
    for prime, base, got in zip(exact.PRIMES, exact.BASES, exact.fingerprint(data)):
        plain = 0
        for byte in data:
            plain = (plain * base + byte) % prime
        assert got == plain
    for cut in (0, size // 3, size):
        if max(cut, size - cut) <= exact.CHUNK:
            left, right = exact.chunk_fingerprint(data[:cut]), exact.chunk_fingerprint(data[cut:])
            assert exact.compose(left, right, size - cut) == exact.fingerprint(data)


def test_normalised():
    assert exact.normalised(" a\t\tb \r\nc\x0b\x0c ") == b" a b c "
    assert exact.normalised("a  b") == "a  b".encode()
    assert exact.normalised(None) == b""


@pytest.mark.parametrize("text", ODD)
def test_token_counts_equal_the_library(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = tokens.PairCounter(open(path, encoding="utf-8").read())
    assert counter.count(text) == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_packing_ids_equal_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.encoding(open(path, encoding="utf-8").read())
    assert encoder.encode_to_numpy(text, allowed_special="all").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 71, 400))[::-1]
    sequence, offset = packing.best_fit(lengths, tokens=100, documents=3, attention=5000, rule=rule, weights=(1, 1, 1))
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 5000
        order = np.argsort(offset[sequence == s])
        assert offset[sequence == s][order].tolist() == [0, *np.cumsum(own[order])[:-1].tolist()]


def test_best_fit_is_best_fit_and_refuses_too_long():
    sequence, _ = packing.best_fit(np.array([60, 50, 48, 40]), tokens=100)
    assert sequence.tolist() == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), tokens=100)
    assert packing.best_fit(np.zeros(0, np.int64))[0].tolist() == []


@pytest.mark.parametrize("seed", range(5))
def test_best_run_against_all_runs(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3.0, -1.0, 0.5, 2.0]) for _ in range(30)]
    first, last = html.best_run(scores)
    assert sum(scores[first:last]) == max(0.0, max(sum(scores[i:j]) for i in range(30) for j in range(i + 1, 31)))


def test_main_text():
    page = (
        "<!DOCTYPE html><html><head><title>T &amp</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href='/x'>menu one</a></nav>"
        "<article><h1>A &amp;amp; B</h1><p>one\n two <b>th</b>ree<br>four &lt;p&gt;<aside>note</aside><form><p>mail</p></form><div class='comments'>bad</div><p>last</article>"
        "<footer>&copy; me</footer>")
    weights = html.learn(html.count_page(page))
    assert html.main_text(page, weights) == "A &amp; B\none two three\nfour <p>\nlast"
    for empty in (None, "", "<html></html>", "<article></article>", "<!-- open", "<script>x"):
        assert html.main_text(empty, weights) == ""
    assert html.main_text("no markup at all", html.Weights()) == "no markup at all"


def test_toxicity_learns_and_meets_misspellings():
    rng = random.Random(2)
    good = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        body = [rng.choice(good) for _ in range(rng.randint(5, 80))]
        if i % 4 == 0:
            body[rng.randrange(len(body))] = rng.choice(["disgusting", "worthless", "pathetic"])
        texts.append(" ".join(body))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels)
    scores = np.array([model.score(t, {}) for t in texts])
    assert ((scores >= 0.5) == np.array(labels)).mean() > 0.95
    clean = " ".join(good[:20])
    assert model.score(clean + " worthlesss", {}) > model.score(clean + " " + good[21], {})
    assert toxicity.train([], []).score("x", {}) < 1e-9
    assert toxicity.train(["a", "b"], [1, 1]).score("a", {}) > 0.5
    assert 0 <= model.score("", {}) <= 1 and 0 <= model.score("x" * 5000, {}) <= 1


def test_toxicity_is_trained_in_little_memory():
    labels = [d % 2 for d in range(200)]
    texts = (" ".join(f"{('bad', 'good')[d % 2]}word{(d * 7919 + w * 104729) % 60000}x{w}" for w in range(150)) for d in range(200))
    tracemalloc.start()
    toxicity.train(texts, labels, epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36e6  # 30000 words of 18 n-grams on average


def test_simhash_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 2**63, 12).astype(np.uint64) for _ in range(40)]
    items = decontaminate.Items(list(range(40)), lists, 9)
    prints = np.concatenate([items.prints ^ np.uint64((1 << k) - 1) for k in range(0, 20, 3)])
    plain = {(w, i) for w, p in enumerate(prints.tolist()) for i, q in enumerate(items.prints.tolist()) if (p ^ q).bit_count() <= 9}
    assert {(w, i) for w, i, _ in items.near(prints)} == plain
    owners = np.array([3, 17])
    further = {(w, i) for w, p in enumerate(prints.tolist()) for i in (3, 17) if (p ^ items.prints.tolist()[i]).bit_count() <= 24}
    assert {(w, i) for w, i, _ in items.near(prints, owners, 24)} == plain | further


def test_simhash_blocks_leave_few_of_many_items():
    """Of thousands of items of one size a window is compared with a tenth or so."""
    rng = np.random.default_rng(6)
    items = decontaminate.Items(list(range(4000)), list(rng.integers(0, 2**63, (4000, 20)).astype(np.uint64)), 9)
    prints = decontaminate.fingerprints(rng.integers(0, 2**63, 319).astype(np.uint64), 20)
    share = len(items.candidates(prints)) / (len(prints) * 4000)
    assert share < 0.2
    assert len(decontaminate.Items([0], [np.ones(3, np.uint64)], 9).near(np.zeros(0, np.uint64))) == 0


def test_leaks_among_many_items_of_one_size():
    """Thousands of items that begin alike: each planted one is found, changed ones too, as by comparing all."""
    rng = random.Random(61)
    start = [f"b{i}" for i in range(10)]
    items = [(i, " ".join(start + [f"w{rng.randrange(10**6)}" for _ in range(30)])) for i in range(2000)]
    index = decontaminate.Index(items, 5, 9, 24)
    for case in range(60):
        item = items[31 * case][1].split()
        for at in rng.sample(range(12, 35), case % 2):
            item[at] = "other"
        text = [f"x{rng.randrange(10**6)}" for _ in range(30)] + item + start + [f"y{rng.randrange(10**6)}" for _ in range(30)]
        (got,) = index.search(" ".join(text), 0.75)
        assert got[:3] == (31 * case, 30, 40) and (got[4] == 1) == (case % 2 == 0)


def test_fenwick_and_chains():
    rng = random.Random(3)
    tree, plain = substring.Fenwick(20), [(-np.inf, -1)] * 20
    for k in range(100):
        at, value = rng.randrange(20), (rng.random(), k)
        tree.put(at, value)
        plain[at] = max(plain[at], value)
        place = rng.randrange(21)
        assert tree.upto(place) == max(plain[:place], default=(-np.inf, -1))
    found = substring.chains([(0, 100), (10, 110), (20, 121), (15, 3), (200, 300), (210, 310)], gain=8.0, skip=0.5, split=48)
    assert [(0, 100), (10, 110), (20, 121)] in found and [(200, 300), (210, 310)] in found
