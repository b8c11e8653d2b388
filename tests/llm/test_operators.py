"""Operators on awkward tables, against brute force, and the pipeline's stages."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinetable.llm import chat, decontaminate, exact, html, minhash, packing, substring, tables, tokens, toxicity, urls

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASH = "doc_id long, text string, node long, digest string, bytes string, _block int, component string, keep int"


def sentence(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def family(seed=5):
    """Texts with copies, near copies, a chain of copies, empties, nulls and a very long one."""
    rng = random.Random(seed)
    rows, base = [], sentence(rng, 120)
    for i in range(40):
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(120)] = "x" + str(rng.randrange(10**6))
        rows.append(" ".join(copy))
    chain = sentence(rng, 100)
    for i in range(12):
        chain = chain[4:] + sentence(rng, 4)
        rows.append(" ".join(chain))
    rows += [" ".join(sentence(rng, 60)) for _ in range(30)]
    rows += [None, "", " \t\n", "one two", "ONE\ttwo", "a b c d e", "A  B c\nd e", " ".join(sentence(rng, 20000)), "z " * 3000]
    return [(i, t) for i, t in enumerate(rows)]


def frame(spark, rows):
    """Rows with extra columns of clashing names and an id and row that repeat, and a null id."""
    rows = [*rows, (None, "stray text of no id here"), rows[3]]
    return spark.createDataFrame([(i, t, 7, "d", "b", 1, "c", 2) for i, t in rows], CLASH)


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in w).split(" ") if x]
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    return group


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(llm_spark, block):
    rows = family()
    found = minhash.near_duplicates(frame(llm_spark, rows), block=block).collect()
    assert len(found) == len(rows) + 2
    want, sets = plain_components(rows), plain_sets(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_an_id_with_two_texts(llm_spark):
    rng = random.Random(1)
    one, two = " ".join(sentence(rng, 50)), " ".join(sentence(rng, 50))
    docs = llm_spark.createDataFrame([(1, one), (5, one), (5, two), (9, two)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()} == {(1, 1), (5, 1), (9, 1)}


def test_components_of_paths_and_stars(llm_spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(50, 60)] + [(7, 7), (None, 3)]
    found = dict(tables.components(llm_spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(21)} | {i: 50 for i in [*range(50, 60), 100]}


@pytest.mark.parametrize("primes", [exact.PRIMES, (3, 5)])
def test_exact_duplicates_also_with_collisions(llm_spark, primes):
    rows = family()
    found = exact.exact_duplicates(frame(llm_spark, rows), primes=primes, bases=(2, 3)).collect()
    groups = collections.defaultdict(list)
    for i, t in [*rows, rows[3]]:
        groups[exact.normalised(t)].append(i)
    assert len(found) == len(rows) + 2
    for r in found:
        if r["doc_id"] is None:
            continue
        text = exact.normalised(dict(rows)[r["doc_id"]])
        assert r["keep_id"] == min(groups[text]) and r["text_sha256"] == hashlib.sha256(text).hexdigest()
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
        if primes == exact.PRIMES:
            assert r["group_size"] == len(groups[text])
    if primes == exact.PRIMES:
        assert [(r["keep_id"], r["group_size"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, 1, True)]


def test_pack_round_trip(llm_spark):
    rows = family()
    found = packing.pack(frame(llm_spark, rows), BYTES, group_pieces=50).toPandas()
    library = Tokenizer.from_file(BYTES)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = found[found.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids) and own.length[1:].eq(1024).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 1024 and own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    assert (found.doc_id == 3).sum() == 2 and found.doc_id.isna().sum() == 1


def test_token_counts(llm_spark):
    rows = family()
    library = Tokenizer.from_file(WORDS)
    for r in tokens.token_counts(frame(llm_spark, rows), WORDS, limit=100).collect():
        if r["doc_id"] is not None:
            text = dict(rows)[r["doc_id"]] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)


def test_passages(llm_spark):
    rng = random.Random(8)
    shared = sentence(rng, 90)
    fuzzy = [w if i % 30 != 15 else "changed" for i, w in enumerate(shared)]
    rows = [(i, " ".join(sentence(rng, 200))) for i in range(20)]
    rows[4] = (4, " ".join(sentence(rng, 70) + shared + sentence(rng, 20)))
    rows[9] = (9, " ".join(fuzzy + sentence(rng, 100)))
    rows[15] = (15, " ".join(sentence(rng, 100) + shared))
    rows[17] = (17, " ".join(sentence(rng, 10) + shared[:30] + sentence(rng, 50)))
    rows += [(50, None), (51, ""), (52, "z " * 500), (53, " ".join(sentence(rng, 20000)))]
    found = substring.repeated_passages(frame(llm_spark, rows)).collect()
    pairs = {(r["doc_id"], r["other_id"]): r for r in found}
    assert {x for p in pairs for x in p} == {4, 9, 15}
    assert {(4, 9), (4, 15)} <= set(pairs)
    r = pairs[4, 15]
    assert (r["start"], r["n_words"], r["other_start"], r["other_words"], r["agreeing"]) == (70, 90, 100, 90, 90)
    r = pairs[4, 9]
    assert (r["start"], r["n_words"], r["other_start"], r["agreeing"]) == (70, 90, 0, 87)


def test_leaks_against_all_windows(llm_spark):
    rng = random.Random(9)
    items = [(i, " ".join(sentence(rng, n))) for i, n in enumerate((3, 12, 12, 30, 45))] + [(90, None), (91, ""), (None, "q w e r t")]
    rows = [(i, " ".join(sentence(rng, 80))) for i in range(12)] + [(40, None), (41, ""), (42, "z " * 3000)]
    for at, (_, item) in enumerate(items[:5]):
        body, part = rows[at][1].split(), item.split()
        if at == 4:
            part[20] = "other"
        rows[at] = (at, " ".join(body[: 10 * at] + part + body[10 * at :]))
    rows[7] = (7, items[1][1])
    listed = llm_spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for blocks in (1 << 20, 300):  # one block of items, and several
        found = decontaminate.contaminated(frame(llm_spark, rows), listed, block_bytes=blocks).collect()
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in found}
        want = {}
        for i, t in rows:
            w = (t or "").split()
            for item, x in items[:5]:
                v = x.split()
                k = min(5, len(v))
                own = collections.Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
                for s in range(max(1, len(w) - len(v) + 1)):
                    part = w[s : s + len(v)]
                    seen = collections.Counter(tuple(part[j : j + k]) for j in range(len(part) - k + 1))
                    both = sum((own & seen).values()) / max(1, sum((own | seen).values()))
                    if both >= 0.75:
                        want[i, item] = max(want.get((i, item), 0), round(both, 6))
        assert got == want
    assert {(i, i) for i in range(5)} | {(7, 1)} == set(got)


def test_urls(llm_spark):
    rules = urls.rule_table(llm_spark, [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.org", "/x")])
    given = {
        "http://EXAMPLE.net/en/1": "example.net/en/", "https://w.example.net/de/": "net/", "http://example.net": None, "http://badexample.net/en/": "net/",
        "http://a.org/xyz?q#f": "a.org/x", "http://b.a.org/x": "a.org/x", "http://ba.org/x": None, "http://net/": "net/", "no scheme": None, "": None, None: None,
        "x://y://net/": None, "http://É.NET/": "net/", "http://?net/": None}
    pages = llm_spark.createDataFrame([(i, u, "h", "p", "k", "v") for i, u in enumerate([*given, "http://net/"])], "page_id long, url string, host string, path string, key string, verdict string")
    found = {r["page_id"]: r for r in urls.judge(pages, rules, otherwise="allow").collect()}
    assert len(found) == len(given) + 1
    for i, (u, rule) in enumerate(given.items()):
        assert found[i]["rule"] == rule, u
        assert found[i]["verdict"] == ("allow" if rule in (None, "example.net/en/") else "block")
    assert (found[0]["host"], found[0]["path"], found[10]["host"], found[4]["path"]) == ("example.net", "/en/1", "", "/xyz")
    assert {r["rule"] for r in urls.judge(pages, rules.limit(0)).collect()} == {None}


def test_chat_windows_round_trip(llm_spark):
    rng = random.Random(6)
    rows, told = [], {}
    for c in range(8):
        turns = [("system", "be kind & <turn user>")] if c % 2 else []
        turns += [(("user", "assistant")[k % 2], rng.choice(["&lt;", "</turn>\n<turn user>", "é😀", "", None]) if k % 5 == 0 else "x" * rng.randrange(400)) for k in range(c * 6)]
        told[c] = turns
        rows += [(c, k, r, t, 1, "w") for k, (r, t) in enumerate(turns)]
    rows += [(100, 0, None, None, 1, "w"), (None, 0, "user", "q", 1, "w"), (None, 0, "user", "q", 1, "w"), (101, 0, "assistant", "y" * 9000, 1, "w")]
    turns = llm_spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, window string")
    windows = chat.format_chats(turns, budget=300, history=80)
    read = chat.read_turns(windows).collect()
    for c, said in told.items():
        own = [r for r in read if r["conv_id"] == c]
        fresh = sorted((t["turn"], t["role"], t["text"]) for r in own for t in r["turns"])
        assert fresh == [(k, r, t or "") for k, (r, t) in enumerate(said)]
        learnt = sorted((t["turn"], t["text"]) for r in own for t in r["learnt"])
        assert learnt == [(k, t or "") for k, (r, t) in enumerate(said) if r == "assistant"]
        assert all(r["n_tokens"] <= 300 or r["over_budget"] for r in own)
        assert not any(r["over_budget"] for r in own)
        if c % 2 and said:
            assert all(r["text"].startswith("<turn system>") for r in own)
    assert max(len({r["window"] for r in read if r["conv_id"] == c}) for c in told) > 3
    digest = {r["conv_id"]: r for r in chat.chat_digest(windows).collect()}
    assert digest[None]["n_turns"] == 2 and digest[100]["n_turns"] == 1 and digest[101]["loss_chars"] == 9000
    assert digest[7]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for r, t in told[7]).encode()).hexdigest()


def test_pages(llm_spark):
    body = "<html><nav>a b c</nav><article><p>x{} y</p></article><footer>f</footer></html>"
    rows = [(i, "u", body.format(i), "t") for i in range(5)] + [(9, None, None, "t"), (None, "u", "", "t"), (1, "u", body.format(1), "t")]
    found = html.extract_pages(llm_spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["text"], r["n_chars"]) for r in found) == sorted([("", 0)] * 2 + [(f"x{i} y", 4) for i in [0, 1, 1, 2, 3, 4]])


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(llm_spark):
    docs = llm_spark.createDataFrame([], EMPTY)
    items = llm_spark.createDataFrame([], "item_id long, text string")
    labels = llm_spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = llm_spark.createDataFrame([], "page_id long, url string, html string")
    turns = llm_spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for made in (
        minhash.near_duplicates(docs), exact.exact_duplicates(docs), packing.pack(docs, BYTES), tokens.token_counts(docs, WORDS), substring.repeated_passages(docs),
        decontaminate.contaminated(docs, items), toxicity.score_toxicity(docs, labels), html.extract_pages(pages),
        urls.judge(pages, urls.rule_table(llm_spark, [("block", "net", "/")])), chat.chat_digest(chat.format_chats(turns)),
    ):
        assert made.count() == 0
    some = llm_spark.createDataFrame([(1, "a b", "en", "s", 3)], EMPTY)
    assert decontaminate.contaminated(some, items).count() == 0
    assert toxicity.score_toxicity(some, labels).first()["score"] < 1e-9


def test_toxicity_never_learns_from_held_out_rows(llm_spark):
    rows = [(i, ("scum " if i % 3 == 0 else "fine ") + f"w{i % 50} is here", i % 3 == 0) for i in range(300)]
    docs = llm_spark.createDataFrame([(i, t, "d") for i, t, _ in rows] + [(None, "x", "d"), (7, None, "d")], "doc_id long, text string, label string")
    labels = llm_spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(docs, x).collect()} for x in (labels, flipped))
    assert one == two
    found = toxicity.score_toxicity(docs, labels).where("doc_id IS NOT NULL").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in found]) > 0.95


def test_pipeline_stages(llm_spark, data, tmp_path):
    docs = llm_spark.read.parquet(f"{data}/documents.parquet")
    extra = docs.limit(3).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    docs = docs.unionByName(extra)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = tables.stored(docs, "before")
        docs = tables.stored(stage(llm_spark, before, data), name)
        if name == "packing":
            ids = {r[0] for r in before.select("doc_id").collect()}
            assert {r[0] for r in docs.select("doc_id").collect()} == ids
            continue
        assert docs.columns == columns
        rows = [tuple(r) for r in before.collect()]
        kept = [tuple(r) for r in docs.collect()]
        assert not collections.Counter(kept) - collections.Counter(rows)
        if name == "exact_dedup":
            first = {}
            for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
                first.setdefault(exact.normalised(r[1]), r)
            assert sorted(r for r in kept if r[0] is not None) == sorted(first.values())
        if name == "near_dedup":
            want = plain_components([(r[0], r[1]) for r in rows if r[0] is not None])
            assert {r[0] for r in kept if r[0] is not None} == {i for i, c in want.items() if i == c}
    empty = llm_spark.createDataFrame([], EMPTY)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(llm_spark, empty, data).count() == 0


def test_passage_whose_parts_stand_elsewhere(llm_spark):
    """Each half of what two documents share is also in a lower and in a higher document."""
    rng = random.Random(21)
    rows, want = [], set()
    for case in range(40):
        n = 52 + case
        shared = [f"s{case}_{i}" for i in range(n)]
        first, rest = shared[: n // 2], shared[n // 2 :]
        for at, part in enumerate((first, rest, shared, shared, first, rest)):
            rows.append((100 * at + case, " ".join(sentence(rng, 30) + part + sentence(rng, 30))))
        want.add((200 + case, 300 + case))
    found = substring.repeated_passages(frame(llm_spark, rows)).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == want
    assert all(r["start"] == r["other_start"] == 30 and r["n_words"] == r["agreeing"] == 52 + r["doc_id"] % 100 for r in found)


def changed(rng, shared, kind):
    """The passage with words changed: after every 20, or at random places inside it."""
    n = len(shared)
    places = range(20, n, 21) if kind == "every 20" else rng.sample(range(1, n - 1), round((1 - kind) * n - 0.5 + 1e-9))
    out = list(shared)
    for place in places:
        out[place] = f"c{rng.randrange(10**9)}"
    return out


def test_recall_of_short_passages(llm_spark):
    """Passages of 50 to 60 words, exact and with changes, in texts that share nothing else."""
    rng = random.Random(31)
    kinds, each, rows, case = (1.0, "every 20", 0.95, 0.9, 0.85, 0.75), 150, [], 0
    for kind in kinds:
        for _ in range(each):
            shared = [f"u{rng.randrange(10**9)}" for _ in range(50 + case % 11)]
            rows.append((2 * case, " ".join(sentence(rng, 40) + shared + sentence(rng, 40))))
            rows.append((2 * case + 1, " ".join(sentence(rng, 25) + changed(rng, shared, kind) + sentence(rng, 60))))
            case += 1
    found = {(r["doc_id"], r["other_id"]) for r in substring.repeated_passages(frame(llm_spark, rows)).collect()}
    got = {kind: sum((2 * c, 2 * c + 1) in found for c in range(i * each, (i + 1) * each)) / each for i, kind in enumerate(kinds)}
    print(got)
    assert got[1.0] == got["every 20"] == got[0.95] == 1
    assert got[0.9] >= 0.99 and got[0.85] >= 0.95 and got[0.75] >= 0.8


def shifted(rng, shared, kind, every):
    """The passage with a word left out or put in after every so many words, (7, 9) meaning either at random."""
    out, left = [], None
    for word in shared:
        left = (rng.choice(every) if isinstance(every, tuple) else every) if left is None else left
        if left == 0:
            left = None
            if kind == "out" or kind == "both" and rng.random() < 0.5:
                continue
            out += [f"c{rng.randrange(10**9)}", word]
        else:
            out.append(word)
            left -= 1
    return out


def agreement(one, two):
    """The most words that agree in order, by the plain table of all prefixes."""
    row = [0] * (len(two) + 1)
    for word in one:
        last = row
        row = [0]
        for j, other in enumerate(two):
            row.append(last[j] + 1 if word == other else max(row[j], last[j + 1]))
    return row[-1]


def test_recall_of_shifted_passages(llm_spark):
    """Passages with words left out, put in, or both: recall against a plain alignment, kind by kind."""
    rng = random.Random(61)
    kinds = [(kind, every) for kind in ("out", "in", "both") for every in (6, 8, 10, (7, 9))]
    each, rows, case, want = 60, [], 0, set()
    for kind, every in kinds:
        for _ in range(each):
            shared = [f"u{rng.randrange(10**9)}" for _ in range(70 + case % 31)]
            other = shifted(rng, shared, kind, every)
            if min(len(shared), len(other)) >= 50 and agreement(shared, other) >= 0.75 * max(len(shared), len(other)):
                want.add(case)
            rows.append((2 * case, " ".join(sentence(rng, 40) + shared + sentence(rng, 40))))
            rows.append((2 * case + 1, " ".join(sentence(rng, 25) + other + sentence(rng, 60))))
            case += 1
    found = {(r["doc_id"], r["other_id"]) for r in substring.repeated_passages(frame(llm_spark, rows)).collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in found)
    for i, kind in enumerate(kinds):
        cases = [c for c in range(i * each, (i + 1) * each) if c in want]
        assert len(cases) == each and sum((2 * c, 2 * c + 1) in found for c in cases) >= 0.95 * each, kind


def test_copies_within_a_document(llm_spark):
    rng = random.Random(41)
    shared, line, pattern = ([f"{c}{i}" for i in range(n)] for c, n in (("p", 60), ("l", 64), ("t", 30)))
    rows = [
        (1, " ".join(sentence(rng, 20) + shared + sentence(rng, 30) + shared + sentence(rng, 10))),
        (2, " ".join(shared + sentence(rng, 15) + shared + sentence(rng, 15) + shared)),
        (3, " ".join(line[10:26] + sentence(rng, 40) + line[30:44] + sentence(rng, 40) + line)),
        (4, " ".join(sentence(rng, 5) + line)),
        (5, " ".join(pattern * 8)),
        (6, " ".join(["z"] * 400)),
    ]
    found = [tuple(r) for r in substring.repeated_passages(frame(llm_spark, rows)).collect()]
    places = collections.defaultdict(set)
    for a, x, n, b, y, m, _ in found:
        places[a].update(range(x, x + n))
        places[b].update(range(y, y + m))
    assert (1, 20, 60, 1, 110, 60, 60) in found and (3, 110, 64, 4, 5, 64, 64) in found
    assert places[1] >= {*range(20, 80), *range(110, 170)} and places[2] >= {*range(60), *range(75, 135), *range(150, 210)}
    assert places[5] == set(range(240)) and 6 not in places


def test_stages_decide_by_row(llm_spark, tmp_path):
    """Ids that repeat with other texts keep them; copies and leaks without an id go."""
    rng = random.Random(51)
    one, two, three, four, leak = (sentence(rng, 80) for _ in range(5))
    near = list(two)
    near[40] = "other"
    text = {n: " ".join(w) for n, w in {"one": one, "two": two, "three": three, "four": four, "near": near, "leak": sentence(rng, 20) + leak[:40] + sentence(rng, 20)}.items()}
    llm_spark.createDataFrame([(1, " ".join(leak[:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, text["one"]), (7, text["one"]), (7, text["three"]), (8, text["two"]), (8, text["four"]), (None, text["one"]), (None, text["near"]),
            (9, text["near"]), (9, text["leak"]), (None, text["leak"]), (None, "only here " * 9), (None, "only here " * 9)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    want = [(1, text["one"]), (7, text["three"]), (8, text["two"]), (8, text["four"]), (9, text["near"]), (9, text["leak"]), (None, "only here " * 9)]
    for name in ("exact_dedup", "near_dedup", "decontamination"):
        docs = tables.stored(stages[name](llm_spark, docs, str(tmp_path)).select("doc_id", "text"), name)
        if name == "near_dedup":
            want.remove((9, text["near"]))
        if name == "decontamination":
            want.remove((9, text["leak"]))
        assert collections.Counter((r["doc_id"], r["text"]) for r in docs.collect()) == collections.Counter(want), name


def test_long_texts_with_many_changes(llm_spark):
    """Two documents of 9000 words that differ in two words out of seven: their chain is cut again and again."""
    rng = random.Random(31)
    first = sentence(rng, 9000)
    second = [f"y{i}" if i % 7 in (2, 5) else w for i, w in enumerate(first)]
    shared = [f"q{i}" for i in range(80)]
    rows = [(1, " ".join(first + shared)), (2, " ".join(second + ["z"] * 9 + shared))]
    found = substring.repeated_passages(frame(llm_spark, [*rows, (3, None), (4, "")])).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} <= {(1, 2), (2, 1)} and found
    assert any(r["n_words"] >= 80 and r["agreeing"] >= 80 for r in found)


MENU_PAGE = "<html><body><nav><ul>" + "<li><a href='/x'>Menu entry</a></li>" * 9 + "</ul></nav><article><p>" + "word " * 30 + "</p></article><table><tr><td>x</td></tr></table><h2>y</h2></body></html>"
PARTS = {
    "<ul><li>One</li><li>Two</li></ul>": ["One", "Two"],
    "<table><tr><td>a</td><td></td><td>b c</td></tr></table>": ["a", "b c"],
    "<blockquote>said</blockquote>": ["said"],
    "<pre><code>x = 1</code></pre>": ["x = 1"],
    "<h2>Head</h2><h3>Low</h3>": ["Head", "Low"],
    "<section><div>deep</div></section>": ["deep"],
    "<div></div>" * 500 + "<ol><li><a href='/l'>link</a></li></ol>": ["link"],
}


def test_nothing_in_an_article_cuts_it():
    """Weights from pages whose menus are lists: parts in such tags stay at both ends and in the middle of an article."""
    weights = html.learn(html.count_page(MENU_PAGE * 20))
    assert weights.tags["li"] < -3
    for markup, lines in PARTS.items():
        for page, want in (
            (f"{markup}<p>one two three</p>", [*lines, "one two three"]), (f"<h1>Title</h1><p>one</p>{markup}", ["Title", "one", *lines]),
            (f"<p>one</p>{markup}<p>two</p>", ["one", *lines, "two"]), (markup, lines),
        ):
            page = f"<html><body><nav><ul><li>Menu</li></ul></nav><article>{page}</article><footer>end</footer></body></html>"
            assert html.main_text(page, weights).split("\n") == want, page


def test_long_and_deep_pages():
    """End tags without a start and deep nesting take time in proportion to the page."""
    weights = html.Weights()
    page = "<article>" + "<div>" * 3000 + "text here" + "</span>" * 200_000 + "</div>" * 3000 + "</article>"
    assert html.main_text(page, weights) == "text here"
    assert html.main_text("<article>" + "<p>word " * 50_000 + "</article>", weights).count("word") == 50_000


def test_rare_names_keep_fixed_scores(llm_spark):
    pages = [(i, f"<article><p>some words here</p><made-up-{i}>text</made-up-{i}></article>") for i in range(40)]
    weights = html.fit(llm_spark.createDataFrame(pages, "page_id long, html string"))
    assert "p" in weights.tags and not any(name.startswith("made-up") for name in weights.tags)


def test_bits_of_a_chunk_equal_those_packed_one_by_one():
    rng = np.random.default_rng(3)
    for count, before, width in ((1, 0, 1), (300, 45, 95), (301, 7, 16)):
        words = rng.integers(0, 1 << 32, count).astype("<u4")
        chunk = substring.Chunk(np.array([1]), words, np.array([count]))
        at = rng.permutation(count)
        padded = np.r_[np.zeros(before, np.uint8), (words & 1).astype(np.uint8), np.zeros(width, np.uint8)]
        assert (chunk.bits(at, before, width) == np.packbits([padded[i : i + width] for i in at], axis=1)).all()


def test_rows_of_one_seed_travel_in_one_part_of_a_task():
    """Parts are the upper bits of a seed, by which a task's rows are sorted, so a part is one piece a task."""
    sent = []

    class Table:
        def mapInArrow(self, make, schema):
            words = np.random.default_rng(4).integers(0, 50, 4000).astype("<u4")
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([words[:2000].tobytes(), words[2000:].tobytes()], pa.binary())], names=["node", "words"])
            sent.extend(row for made in make(iter([batch])) for row in made.to_pylist() if row["size"] < 0)
            raise StopIteration

    for exact, kind in ((True, 20), (False, 40)):
        sent.clear()
        with pytest.raises(StopIteration):
            substring.seed_links(Table(), 4000, 5, exact=exact, least=50, similarity=0.75, buckets=4)
        assert len({row["bucket"] for row in sent}) == len(sent) > 100
        seeds = [np.frombuffer(row["packed"], "u1").reshape(-1, kind)[:, :8].copy().view("<u8").ravel() for row in sent]
        assert len(np.unique(np.concatenate([np.unique(s) for s in seeds]))) == sum(len(np.unique(s)) for s in seeds)


def test_changed_passages_of_common_words(llm_spark):
    """Every run of nine words of a passage also stands in a hundred other documents, so each seed two documents share is common."""
    rng = random.Random(71)
    kinds, rows, wanted, windows = ("changed", "out", "in"), [], set(), []
    for case in range(9):
        shared = [f"p{case}_{i}" for i in range(70)]
        if kinds[case % 3] == "changed":
            other = [f"c{rng.randrange(10**9)}" if i % 10 == 9 else w for i, w in enumerate(shared)]
        else:
            other = shifted(rng, shared, kinds[case % 3], 9)
        rows += [(2 * case, " ".join(sentence(rng, 40) + shared + sentence(rng, 40))), (2 * case + 1, " ".join(sentence(rng, 25) + other + sentence(rng, 60)))]
        wanted.add((2 * case, 2 * case + 1))
        windows += [shared[i : i + 9] for i in range(62)] * 100
    rng.shuffle(windows)
    for at in range(0, len(windows), 20):
        parts = [[*part, *(f"d{rng.randrange(10**12)}" for _ in range(9))] for part in windows[at : at + 20]]
        rows.append((1000 + at, " ".join(w for part in parts for w in part)))
    found = {(r["doc_id"], r["other_id"]) for r in substring.repeated_passages(frame(llm_spark, rows)).collect()}
    assert found & {(a, b) for a in range(18) for b in range(18)} == wanted


def test_all_places_of_a_seed_are_compared():
    seed, node = np.repeat(np.arange(3, dtype=np.uint64), (2, 40, 7)), np.r_[1, 1, np.arange(40) // 2, np.arange(7)]
    order = np.random.default_rng(1).permutation(len(seed))
    context, bits = np.zeros(len(seed), np.uint16), np.zeros((len(seed), 12), np.uint8)
    i, j, _ = substring.neighbours(seed[order], node[order], np.arange(len(seed)), context, context, bits, least=50, k=5, similarity=0.75)
    pairs = {frozenset(p) for p in zip(order[i].tolist(), order[j].tolist())}
    assert len(pairs) == len(i) and pairs == {frozenset((a, b)) for a in range(49) for b in range(a) if seed[a] == seed[b] and node[a] != node[b]}


@pytest.mark.parametrize("direct", [1024, 60])
def test_common_places_against_all_pairs(monkeypatch, direct):
    """Each place that shares a passage by a run that begins or ends there has a partner, and all partners do share one."""
    monkeypatch.setattr(substring.Common, "DIRECT", direct)
    rng = np.random.default_rng(5)
    k, least, similarity, side, count = 5, 20, 0.75, 25, 160
    families = rng.integers(1, 60000, (6, 2 * side + k))
    words = families[rng.integers(6, size=count)]
    changed = rng.random(words.shape) < rng.choice([0.05, 0.15, 0.25, 0.4, 0.9], (count, 1))
    words = np.where(changed, rng.integers(1, 60000, words.shape), words)
    words[:, side : side + k] = np.arange(1, k + 1)
    words[::7, : side // 2], words[3::9, -side // 2 :] = 0, 0
    words, node = words.astype(np.uint16), np.sort(rng.integers(0, 60, count))
    common = substring.Common(words, node, k=k, least=least, similarity=similarity)
    found = set(zip(*(v.tolist() for v in common.found())))
    near, want = words[:, side - least : side + k + least], set()
    for a in range(count):
        for b in range(a + 1, count):
            if node[a] == node[b] or not any(words[a, c] != words[b, c] or not words[a, c] for c in (side - 1, side + k)):
                continue
            equal = ((near[a] == near[b]) & (near[a] != 0)).tolist()
            if any(equal[s] and equal[e - 1] and sum(equal[s:e]) >= similarity * (e - s) for s in range(least + 1) for e in range(max(least + k, s + least), len(equal) + 1)):
                want.add((a, b))
    partners = {x for pair in want for x in pair}
    assert found <= want and {x for pair in found for x in pair} == partners and set(np.flatnonzero(~common.open)) == partners and len(want) > 100
