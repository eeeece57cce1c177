"""Each operator against a plain version, on small tables with nulls, ties, repeats, odd texts and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from meterframe.llm import components, fingerprints, katz, language, mixing, neighbours, packing, quality, sharding, simhash, transducer, trigrams
from meterframe.llm.blocks import BLOCK_BYTES, blocks

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(300_000))
BASE = " ".join(f"alpha{i * 7 % 53} beta{i * 3 % 41}" for i in range(60))
DOCS = [
    (1, "The cat sat on the mat and looked at the dog", "en", "a.org", 44),
    (2, "The cat sat on the mat and looked at the dog", "en", "a.org", 44),
    (2, "The cat sat on the mat and looked at the dog", "en", "a.org", 44),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (5, "   \n\t ", "de", "b", 5),
    (6, "Él está aquí — 漢字 😀 it's <|endoftext|> we're  x", "es", "b", 9),
    (None, "no id at all here", "en", None, 3),
    (8, BASE, "en", "a.org", 1),
    (9, BASE + " extra", "en", "c", 1),
    (10, "one", "en", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("row", "key", "part", "score", "shard", "page", "bits", "size", "target", "range", "cell")


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([*DOCS, (11, LONG, "en", "c", 1)], SCHEMA).repartition(3)
    return frame.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def every():
    return [*DOCS, (11, LONG, "en", "c", 1)]


def test_blocks_hold_all_words_however_long():
    found = [b.text for b in blocks(enumerate([LONG.encode(), b"", b" A  b "]))]
    assert b"".join(found).split() == words(LONG).__class__(w.encode() for w in words(LONG + " a b"))
    assert max(map(len, found)) < 3 * BLOCK_BYTES
    huge = b"x" * (3 * BLOCK_BYTES)
    assert sum(b.counts.sum() for b in blocks([(0, huge + b" y")])) == 2


def test_fingerprints_and_edits(docs, none):
    rows = fingerprints.edited_fingerprints(docs).collect()
    assert len(rows) == len(every()) and fingerprints.edited_fingerprints(none).count() == 0
    by_id = defaultdict(set)
    for d, t, *_ in every():
        by_id[d].add(t or "")
    order = sorted((d for d in by_id if d is not None), reverse=True) + [None]
    sign = fingerprints.signatures
    for r in rows:
        (text,) = by_id[r.doc_id]
        (after,) = by_id[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        own, edit, following = sign([t.encode() for t in (text, text[: len(text) - half] + after[:half], after)])
        assert (r.near_edited, r.near_next) == ((own == edit).mean(), (own == following).mean())
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[2] and prints[3] == prints[4] == prints[5] != prints[1]


def test_likeness_estimates_jaccard():
    a, b = [" ".join(f"w{i}" for i in range(at, at + 400)).encode() for at in (0, 50)]
    sign = fingerprints.signatures([a, b], permutations=512)
    assert abs(fingerprints.likeness(sign[:1], sign[1:])[0] - (346 / 446)) < 0.06


def test_signatures_are_minima_of_permutations():
    text = " ".join(f"w{i % 50} v{i}" for i in range(200))
    (block,) = blocks([(0, text.encode())])
    from meterframe.llm.blocks import shingle_hashes

    hashes = shingle_hashes(block, 5)[0].tolist()
    a, b = (x.tolist() for x in fingerprints._permutations(128))
    plain = [min((x * h + y) % (1 << 64) for h in hashes) & 0xFFFF for x, y in zip(a, b)]
    assert fingerprints.signatures([text.encode()])[0].tolist() == plain
    assert len(hashes) == len(words(text)) - 4 and len(set(hashes)) == len({tuple(words(text)[i : i + 5]) for i in range(len(hashes))})


def test_near_duplicates_keep_every_link(spark, docs, none):
    found = {}
    for r in fingerprints.near_duplicates(docs).collect():
        found.setdefault(r.doc_id, r.class_id)
    assert found[1] == found[2] == 1 and found[3] == found[4] == 3 and found[9] == found[8] == 8 and found[10] == 10 and found[None] is None
    assert fingerprints.near_duplicates(none).count() == 0
    assert {(r.doc_id, r.class_id) for r in fingerprints.edited_fingerprints(docs).collect()} == set(found.items())


@pytest.mark.parametrize("marks", [8, 1 << 20])
def test_asked_texts_are_found_by_a_filter(spark, monkeypatch, marks):
    """However coarse the filter, no text that is asked for is lost; a fine one lets few others through."""
    monkeypatch.setattr(fingerprints, "MARKS", marks)
    ids = np.random.default_rng(11).integers(-(1 << 62), 1 << 62, 400).tolist()
    texts = spark.createDataFrame([(i, f"text {i}") for i in ids], "h1 long, text string").repartition(3)
    keys = spark.createDataFrame([(i,) for i in ids[:40]], "h1 long")
    found = fingerprints.matching(texts, "h1", keys).collect()
    import zstandard

    assert set(ids[:40]) <= {r.h1 for r in found} and all(zstandard.decompress(bytes(r.text)).decode() == f"text {r.h1}" for r in found)
    assert marks == 8 or len(found) < 45
    assert fingerprints.matching(texts, "h1", keys.limit(0)).count() == 0


def test_scratch_tables_can_be_cleared(spark):
    import os

    from meterframe.llm import shared

    kept = shared.written(spark.range(3))
    folder = shared.scratch_dir(spark).removeprefix("file:")
    assert kept.count() == 3 and os.path.isdir(folder)
    shared.clear(spark)
    assert not os.path.exists(folder)


def reached(texts):
    """The least place that each text reaches over pairs of Jaccard 0.8 or more, by trying all of them."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    near = [[j for j, b in enumerate(sets) if not a | b or len(a & b) >= 0.8 * len(a | b)] for a in sets]
    least = list(range(len(sets)))
    for _ in sets:
        least = [min(least[j] for j in n) for n in near]
    return least


@pytest.mark.parametrize("sizes", [(10_000, 2048), (5, 8)])
def test_banded_classes_against_all_pairs(spark, monkeypatch, sizes):
    """Chains, stars, dense groups, texts that share half, with and without parts and tiles."""
    monkeypatch.setattr(fingerprints, "PART", sizes[0])
    monkeypatch.setattr(fingerprints, "TILE", sizes[1])
    base = [f"w{i}" for i in range(400)]
    change = lambda ws, at: " ".join(f"new{at[0]}x{k}" if k in set(at) else w for k, w in enumerate(ws))
    chain = [change(base, range(0, 70 * k + 1, 10)) for k in range(5)]
    a = [f"a{i}" for i in range(300)]  # a-b and b-c alike, a-c not
    triple = [" ".join(a), change(a, range(0, 30, 7)), change(a, [*range(0, 30, 7), *range(100, 160, 9)])]
    dense = [change([f"d{i}" for i in range(400)], [(11 * k + 37 * m) % 400 for m in range(6 + k % 5)]) for k in range(40)]
    half = [" ".join([*base[:200], *(f"h{k}x{i}" for i in range(150))]) for k in range(20)]
    texts = [*chain, *triple, *dense, *half, "", " one ", "one"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in fingerprints.near_duplicates(frame).collect()} == dict(enumerate(reached(texts)))


@pytest.mark.parametrize("hot", [1, 1000])
def test_components_match_union_find(spark, monkeypatch, hot):
    from meterframe.llm import shared

    monkeypatch.setattr(shared, "HOT", hot)
    monkeypatch.setattr(components, "FEW", hot)  # with 1, every join goes both ways; with 1000, these few links are joined plainly
    rng = np.random.default_rng(3)
    chain = 40 if hot > 1 else 4
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(chain)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    linked = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {x: find(x) for x in linked}


def plain_simhash(text):
    w = words(text)
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    bits = Counter(i for s in runs for i in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> i & 1)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(runs))


def test_simhash_components(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(every()) and simhash.near_duplicates(none).count() == 0
    plain = {d: plain_simhash(t) for d, t, *_ in every()}
    ids = [d for d in plain if d is not None]
    reach = {d: {e for e in ids if bin(plain[d] ^ plain[e]).count("1") <= 4} for d in plain}
    for _ in ids:
        reach = {d: set().union(r, *[reach[e] for e in r]) for d, r in reach.items()}
    for r in rows:
        assert r.bits & (1 << 64) - 1 == plain[r.doc_id]
        assert r.component_id == min(reach[r.doc_id], default=None)


def test_tiles_lose_no_component(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)) for b in base for _ in range(4)], np.uint64)
    values = np.unique(np.concatenate([base, near])).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in values], "bits long")
    got = {r.node: r.root for r in components.connected_components(simhash.links(frame, tile=64)).collect()}
    label = {v: v for v in values}
    array = np.array(values).view(np.uint64)
    for _ in range(6):
        for i, v in enumerate(values):
            close = np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4)
            low = min(label[values[j]] for j in close)
            for j in close:
                label[values[j]] = min(label[values[j]], low)
    assert {v: r for v, r in label.items() if list(label.values()).count(r) > 1} == got


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_matches_a_plain_model(docs, none, order):
    rows = katz.score(docs, order).collect()
    assert len(rows) == len(every()) and katz.score(none, order).count() == 0
    tokens = [(d, [*words(t), None]) for d, t, *_ in every()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    levels, contexts = [Counter() for _ in range(order)], [Counter() for _ in range(order)]

    def grams(ts, k):
        padded = ["<s>"] * (k - 1) + ts
        return [tuple(padded[i : i + k]) for i in range(len(ts))]

    for d, ts in tokens:
        if not held(d):
            for k in range(order):
                levels[k].update(grams(ts, k + 1))
    for k in range(order):
        for g, c in levels[k].items():
            contexts[k][g[:-1]] += c
    n = sum(levels[0].values())
    factors = [katz.discounts(np.array([sum(x == r for x in c.values()) for r in range(1, 7)])) for c in levels]
    cut = lambda k, c: c * (factors[k][c] if c <= 5 else 1.0)
    unknown = (0.5 + sum(c - cut(0, c) for c in levels[0].values())) / (n + 0.5)
    lost, mass = [Counter() for _ in range(order)], [Counter() for _ in range(order)]

    def score(g):
        """The definition, from the whole counts."""
        k = len(g) - 1
        if not k:
            return cut(0, levels[0][g]) / (n + 0.5) if levels[0][g] else unknown
        h = g[:-1]
        if levels[k][g]:
            return cut(k, levels[k][g]) / (contexts[k][h] + 0.5)
        return score(g[1:]) * ((0.5 + lost[k][h]) / (contexts[k][h] + 0.5) / (1 - mass[k][h]) if contexts[k][h] else 1)

    for k in range(1, order):
        for g, c in levels[k].items():
            lost[k][g[:-1]] += c - cut(k, c)
            mass[k][g[:-1]] += score(g[1:])
    for h in [h for h in list(contexts[-1])[:40] if order > 1]:
        assert math.isclose(sum(score((*h, *w)) for w in levels[0]) + score((*h, "unseen!")), 1, rel_tol=1e-9)
    base = lambda t: math.log10((levels[0][t,] + 0.1) / (n + 0.1 * (len(levels[0]) + 1)))
    want = sorted((str(d), len(ts), sum(levels[0][t,] > 0 for t in ts), round(sum(map(base, ts)), 4), round(sum(math.log10(score(g)) for g in grams(ts, order)), 4)) for d, ts in tokens)
    assert want == sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in rows)
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) for r in rows)


def thue_morse(n):
    """Two strings that polynomial hashes modulo 2 ** 64 hold as one."""
    text = "a"
    while len(text) < n:
        text = text.translate({97: "ae", 101: "ea"})
    return text, text.translate({97: "e", 101: "a"})


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_are_told_apart_by_their_bytes(spark, n):
    from tokenizers import Tokenizer

    pair = thue_morse(n)
    library = Tokenizer.from_file(BPE)
    assert transducer.count_tokens(list(pair), BPE).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in pair]
    rows = katz.score(spark.createDataFrame([(1, pair[0]), (2, pair[1])], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 4 and math.isclose(r.base_score, math.log10(1.1 / 4.4) + math.log10(2.1 / 4.4)) for r in rows)
    signed = fingerprints.signatures([t.encode() for t in pair])
    assert (signed[0] != signed[1]).any()


def test_distinct_spans_compare_bytes(monkeypatch):
    from meterframe.llm import blocks as module

    texts = [b"one", b"two", b"one", b"", b"x" * 300, b"x" * 299 + b"y", b"x" * 300, b"eightbyt", b"eightbyte"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    for _ in range(2):  # with real hashes, then with one hash for all
        first, number = module.distinct_spans(data, starts, ends)
        assert [texts[first[k]] for k in number] == texts and len(first) == len(set(texts))
        monkeypatch.setattr(module, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))


def test_transducer_counts_like_the_library(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rows = transducer.token_counts(docs, BPE).collect()
    text = {d: t or "" for d, t, *_ in every()}
    assert transducer.token_counts(none, BPE).count() == 0 and len(rows) == len(every())
    for r in rows:
        n = len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text[r.doc_id].encode()), n > 512)
    rng = np.random.default_rng(1)
    bits = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", " ", "a", "Z", "é", "漢", "1", "²", "!", "...", "😀", "﻿", "<|endoftext|>", "<|end", "\x85", "\x1c", "\x00", "'ve", "\U0001f9ff", "Ᲊ"]
    odd = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(1500)]
    assert transducer.count_tokens(odd, BPE).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in odd]


def test_chunk_maps_compose():
    classes = np.random.default_rng(2).integers(0, 11, 5000).astype(np.uint8)
    marks, state = [], transducer.OPEN
    for c, n in zip(classes.tolist(), [*classes[1:].tolist(), transducer.END]):
        state, mark = transducer._step(state, c, n)
        marks.append(mark)
    assert transducer.split_marks(classes).tolist() == marks


def test_packing_is_whole_and_tight(spark, docs, none):
    from tokenizers import Tokenizer

    blank = [(20, "a " + " " * 1_000_000), (21, "\n" * 1_000_000), (22, "x" * 30_000 + "\x1c!" * 9000)]  # runs that are too long for the faster library
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(blank, "doc_id long, text string"))
    rows = packing.pack(frame, BPE).collect()
    assert packing.pack(none, BPE).count() == 0
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    library = Tokenizer.from_file(BPE)
    want, total = Counter(), 0
    for d, t in [(d, t) for d, t, *_ in every()] + blank:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        want.update((d, k, a, e - a, zlib.crc32(ids[a:e].tobytes())) for k, (a, e) in enumerate(zip(starts, [*starts[1:], len(ids)])))
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert len(bins) <= -(-total // 2048) + 1


def test_local_search_empties_bins():
    sizes = [7, 6, 2, 5, 3, 4, 2]
    start = [[0], [1, 2], [3, 4], [5, 6]]
    found = packing.improve(start, sizes, 10)
    assert len(found) == 3 and sorted(i for b in found for i in b) == list(range(7))
    assert all(sum(sizes[i] for i in b) <= 10 for b in found)
    sizes = np.random.default_rng(0).integers(500, 1000, 3000).tolist()
    start = packing.best_fit(sizes, 2048)
    found = packing.improve(start, sizes, 2048)
    assert sorted(i for b in found for i in b) == list(range(3000)) and all(sum(sizes[i] for i in b) <= 2048 for b in found)
    assert len(start) == 1230 and len(found) <= 1184


def test_every_kind_of_step():
    """Each start has one step that fills a bin: a move, one for one, two for one, one for two."""
    for start, fills in (([[5, 4], [3, 1]], {10, 3}), ([[6, 2], [4, 1]], {10, 3}), ([[3, 2, 3], [7]], {10, 5}), ([[4, 4], [3, 3]], {10, 4})):
        sizes = [x for b in start for x in b]
        places = iter(range(len(sizes)))
        search = packing._Search([[next(places) for _ in b] for b in start], sizes, 10)
        search.exchange(0, *search.step(0))
        assert set(search.fill) == fills


def test_mix_meets_targets(docs, none):
    mixed = mixing.mix(docs)
    rows = mixing.taken(mixed).collect()
    assert len(rows) == len(every()) and mixing.taken(mixing.mix(none)).count() == 0
    size = Counter()
    for _, t, _, s, _ in every():
        size[s] += len(words(t))
    order = [*sorted(s for s in size if s is not None), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, {s for s in order}
    while True:
        left = 1.5 * sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * size[s] for s in over}
        open_ -= over
    took = Counter()
    for r in rows:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        took[r.source] += r.taken
    assert all(abs(took[s] - target[s]) <= mixing.BLOCK for s in order)
    assert Counter(str(r.doc_id) for r in rows) == Counter(str(d) for d, *_ in every())
    key = lambda found: sorted((str(r.doc_id), r.size, r.taken) for r in found)
    assert key(rows) == key(mixing.taken(mixing.mix(docs.repartition(5))).collect())
    drawn, shards = Counter(), defaultdict(Counter)
    held = defaultdict(list)
    for r in mixing.slots(mixed, shard_slots=64).collect():
        drawn[r.src] += r.words
        shards[r.shard][r.src] += 1
        held[r.src].append((r.slot, r.block, r.turn))
    src = {r.source: r.src for r in mixed.sources.collect()}
    assert all(drawn[src[s]] == took[s] for s in order)
    for slots in held.values():  # gapless slots, each pass a permutation of the blocks
        assert sorted(s for s, _, _ in slots) == list(range(len(slots)))
        assert len({(t, b) for _, b, t in slots}) == len(slots)
    assert len(shards) > 100 and len({tuple(sorted(c.items())) for c in shards.values()}) > 10


def test_shard_counts_are_a_multinomial_draw(spark):
    found = defaultdict(dict)
    for r in mixing.shard_counts(spark.createDataFrame([(1, 100_000), (2, 0), (3, 70_000)], "src int, n_slots long"), 50).collect():
        found[r.src][r.shard] = r.slots
    assert {s: sum(c.values()) for s, c in found.items()} == {1: 100_000, 3: 70_000}
    for s, n in ((1, 100_000), (3, 70_000)):
        counts = np.array([found[s].get(k, 0) for k in range(50)])
        assert 20 < ((counts - n / 50) ** 2 / (n / 50)).sum() < 100  # chi-square, 49 degrees
    assert found[1] != found[3]


def test_slots_are_joined_by_a_shuffle_however_few_rows_they_come_from(docs):
    """Spark takes the slots to be as few as the (source, shard) rows that they are numbered from; a broadcast holds them all in the driver."""
    found = mixing.slots(mixing.mix(docs), shard_slots=64)
    assert len(found.collect()) > 10_000
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = [line for line in plan.splitlines() if "Join" in line and "rank" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert plan.count("REPARTITION_BY_NUM") == 2  # draws and slots are made by all tasks


def test_mixed_texts_hold_what_is_taken(docs):
    took = {}
    for r in mixing.taken(mixing.mix(docs)).collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + r.taken
    held = Counter()
    for r in mixing.mixed_texts(docs).collect():
        held[r.doc_id] += len(words(r.text))
    assert {d: n for d, n in took.items() if n} == {d: n for d, n in held.items() if n}
    text = {d: t or "" for d, t, *_ in every()}
    for r in mixing.mixed_texts(docs).collect():
        assert r.text and r.n_chars == len(r.text) and (r.text == text[r.doc_id] or all(w in text[r.doc_id] for w in words(r.text)))


def plain_jump(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump_hash_and_slots(docs, none):
    keys = np.random.default_rng(4).integers(0, 1 << 63, 500).astype(np.uint64)
    for n in (1, 2, 24, 25):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(every()) and sharding.assign(none).count() == 0
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {d: t or "" for d, t, *_ in every()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode())) for r in rows)


def test_neighbours_against_brute_force(spark, none):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((40, 24))
    vectors = (centre[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 24))).astype(np.float32)
    vectors[100:400] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] * 24), (5004, []), (None, [1.0] * 24), (5005, [1.0, 2.0])]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1))
    old = neighbours.CELL
    neighbours.CELL = 512
    try:
        got = neighbours.nearest(frame, F.col("vec_id") % 100 == 0).collect()
        assert neighbours.nearest(frame.limit(0), F.col("vec_id") == 0).count() == 0
    finally:
        neighbours.CELL = old
    found, score = defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.vec_id)
        score[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    hits = 0
    for q in range(0, 3000, 100):
        away = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        away[q] = np.inf
        best = np.lexsort((np.arange(3000), away))[:10]
        hits += len(set(best.tolist()) & set(found[q]))
        if q == 100:
            assert found[q] == best.tolist()
        assert all(math.isclose(s, away[v], rel_tol=1e-12, abs_tol=1e-12) for v, s in score[q])
        assert score[q] == sorted(score[q], key=lambda x: (x[1], x[0]))
    assert hits >= 0.9 * 300 and all(len(f) == 10 for f in found.values()) and set(found) == set(range(0, 3000, 100))
    assert abs(neighbours.chi_square(np.array(neighbours.quantile(0.95)))[()] - 0.95) < 1e-9


@pytest.mark.parametrize(("spread", "most"), [(0.35, 0.1), (10.0, 0.6)])
def test_the_stopping_test_spares_vectors(spread, most):
    """Recall and the share of vectors that are verified, around 100 centres and without any."""
    rng = np.random.default_rng(13)
    centre = rng.standard_normal((100, 64))
    vectors = centre[rng.integers(0, 100, 8000)] + spread * rng.standard_normal((8000, 64))
    tree = neighbours.Tree(np.arange(8000), vectors, 10)
    stop, hits = neighbours.quantile(neighbours.CONFIDENCE), 0
    for q in range(0, 8000, 100):
        away = ((vectors - vectors[q]) ** 2).sum(axis=1)
        away[q] = np.inf
        _, names = tree.search(q, vectors[q], vectors[q] @ neighbours.directions(64), np.inf, 10, stop)
        hits += len(set(np.argsort(away)[:10].tolist()) & set(names.tolist()))
    assert hits >= 0.93 * 800 and tree.met <= most * 80 * 8000


def test_neighbours_of_every_length(spark):
    rows = [(2 * n + i, [float(i + 1) + 0.1 * j for j in range(n)]) for n in range(1, 71) for i in range(2)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), neighbours.F.lit(True)).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(2 * n + i, 2 * n + 1 - i) for n in range(1, 71) for i in range(2)}
    big = [(1, [1e150, 2.0]), (2, [1e150, 2.0 + 2**-40]), (3, [1e-300, 0.0])]  # doubles that no float holds
    got = neighbours.nearest(spark.createDataFrame(big, "vec_id long, embedding array<double>"), neighbours.F.lit(True)).collect()
    assert {(r.query_id, r.vec_id): r.score for r in got if r.rank == 1} == {(1, 2): 2**-40, (2, 1): 2**-40, (3, 1): 1e150}


def test_query_blocks_copy_their_own_cell_only(spark, monkeypatch):
    """The copies of one cell's vectors do not grow with the queries of another."""
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    vectors = spark.createDataFrame([(2, c, 0, 100 * c + i, [1.0, float(i)]) for c in range(2) for i in range(10)], "size int, cell int, part int, vec_id long, embedding array<float>")
    copies = []
    for many in (4, 400):
        rows = [(2, 0, 0, i, i, [1.0, 0.5], 9.0) for i in range(4)] + [(2, 1, 0, 1000 + i, i, [1.0, 0.5], 9.0) for i in range(many)]
        asked = spark.createDataFrame(rows, "size int, cell int, part int, row long, query_id long, embedding array<float>, bound double")
        held, dealt = neighbours._blocks(vectors, asked)
        copies.append({r.cell: r["count"] for r in held.groupBy("cell").count().collect()})
        assert dealt.count() == 4 + many
    assert copies == [{0: 10, 1: 10}, {0: 10, 1: 1000}]


SPOKEN = {
    "en": "the cat and the dog sat on the mat while they looked at the river and the old house of the man",
    "es": "el perro y la casa de los hombres que estaban en el camino con las flores del otro lado",
    "de": "der hund und die katze sitzen auf der matte und sehen den alten fluss mit dem haus des mannes",
}


EVIDENCE = "doc_id long, text string, declared string, suffix string, domain string, host string"


def plain_posterior(rows, model):
    """{doc_id: (language, probability)} by the definition, from (doc_id, text, declared, suffix, domain, host)."""
    names, logs = model
    table = np.vstack([logs, np.full((1, language.BUCKETS), -math.log(language.BUCKETS) - language.MARGIN)])
    text_logs, softs = [], []
    for _, text, *_ in rows:
        counts = trigrams.counts([(text or "").encode()], np.zeros(1, int), 1, language.BUCKETS, language._FOLD)[0]
        found = language.TEMPER * (table @ counts)
        found[-1] += math.log(language.UNKNOWN_PRIOR)
        if not (text or "").encode().translate(language._FOLD).strip():
            found[:-1] = -1e9
        found -= found.max()
        text_logs.append(found)
        softs.append(np.exp(found) / np.exp(found).sum())
    n = len(names)
    total = sum(softs)[:n]
    base = (total + 1) / (total.sum() + n)
    seen = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    for row, soft in zip(rows, softs):
        for k, value in enumerate(row[2:]):
            if value is not None:
                seen[k][value] += soft[:n]
    s, out = language.STRENGTH, {}
    for row, log in zip(rows, text_logs):
        fused = log.copy()
        for k in (0, 1):
            if row[2 + k] is not None:
                share = (seen[k][row[2 + k]].sum() + language.LEAST) / max(1, total.sum())
                fused[:n] += np.log((seen[k][row[2 + k]] + s * share) / (total + s) / share)
        prior = base
        for k in (2, 3):
            if row[2 + k] is not None:
                prior = (seen[k][row[2 + k]] + s * prior) / (seen[k][row[2 + k]].sum() + s)
        fused[:n] += np.log(prior * n)
        best = int(np.argmax(fused))
        out[row[0]] = ([*names, "und"][best], 1 / np.exp(fused - fused[best]).sum())
    return out


def test_language_evidence(spark, docs, none):
    evidence = language.document_evidence(docs)
    train = spark.createDataFrame([(t, lang) for lang, t in SPOKEN.items() for _ in range(5)], "text string, declared string")
    found = language.identify(evidence, language.fit(train)).collect()
    rows = {r.doc_id: r for r in found}
    assert len(found) == len(every()) and rows[1].language == "en" and rows[1].kept
    assert rows[3].language == "und" and not rows[4].kept and not rows[5].kept
    assert language.identify(language.document_evidence(none), language.fit(language.document_evidence(none))).count() == 0
    pages = spark.createDataFrame([(1, "http://x.example.de/a", '<html lang="de-AT"><body>und der die das</body></html>'), (2, None, None), (3, "junk", "<p>the of and</p>")], "page_id long, url string, html string")
    parts = {r.page_id: r for r in language.page_evidence(pages).collect()}
    assert (parts[1].declared, parts[1].suffix, parts[1].domain, parts[1].host) == ("de", "de", "example.de", "x.example.de") and "der die" in parts[1].text
    assert parts[2].text is None and parts[3].declared is None and parts[3].host is None
    found = language.identify(language.page_evidence(pages), language.fit(train), ("page_id",))
    assert {r.page_id: r.language for r in found.collect()} == {1: "de", 2: "und", 3: "en"}


@pytest.mark.parametrize("hot", [1, 1000])
def test_posterior_against_a_plain_one(spark, monkeypatch, hot):
    from meterframe.llm import shared

    monkeypatch.setattr(shared, "HOT", hot)
    rng = np.random.default_rng(12)
    hosts = [("en.a.com", "a.com", "com"), ("es.a.com", "a.com", "com"), ("b.de", "b.de", "de"), ("c.org", "c.org", "org"), (None, None, None)]
    rows = []
    for i in range(200):
        lang = ("en", "es", "de")[i % 3]
        host, domain, suffix = hosts[int(rng.integers(0, 5))]
        text = " ".join(rng.choice(SPOKEN[lang].split(), int(rng.integers(0, 12)))) if i % 11 else None
        rows.append((i, text, lang if i % 4 else None, suffix, domain, host))
    frame = spark.createDataFrame(rows, EVIDENCE).repartition(3)
    model = language.fit(frame)
    want = plain_posterior(rows, model)
    found = language.identify(frame, model).collect()
    assert len(found) == 200 and {r.doc_id: r.language for r in found} == {d: n for d, (n, _) in want.items()}
    assert all(math.isclose(r.probability, want[r.doc_id][1], rel_tol=1e-9) and r.kept == (r.language != "und") for r in found)


def test_host_and_declaration_tip_the_balance(spark):
    known = [(i, t, lang, None, None, h) for i in range(60) for t, lang, h in (("the cat and the dog sat on the old mat", "en", "e"), ("el perro y la casa de los hombres", "es", "s"))]
    train = spark.createDataFrame(known, EVIDENCE)
    model = language.fit(train)
    alike = "casa the "  # as much of one as of the other
    asked = [(1001, alike, "en", None, None, "e"), (1002, alike, "es", None, None, "s"), (1003, alike, None, None, None, "e"), (1004, alike, None, None, None, "s"), (1005, alike, "en", None, None, None), (1006, alike, "es", None, None, None)]
    both = train.unionByName(spark.createDataFrame(asked, EVIDENCE))
    rows = {r.doc_id: r.language for r in language.identify(both, model).where("doc_id > 1000").collect()}
    assert rows == {1001: "en", 1002: "es", 1003: "en", 1004: "es", 1005: "en", 1006: "es"}


def test_every_declared_language_is_told_apart(spark):
    """Seventy languages, each of its own letters, and texts alike in two: the first by name stands."""
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    texts = {n: " ".join(f"{n}{n[::-1]}{k}q" for k in "xyz") * 8 for n in names}
    rows = [(i, texts[n], n, None, None, None) for i, n in enumerate(names)]
    frame = spark.createDataFrame([*rows, (500, None, None, None, None, None)], EVIDENCE)
    found = {r.doc_id: r for r in language.identify(frame, language.fit(frame)).collect()}
    assert [found[i].language for i in range(70)] == names and all(found[i].kept for i in range(70)) and not found[500].kept
    same = spark.createDataFrame([(1, "one text of two names " * 9, "bb", None, None, None), (2, "one text of two names " * 9, "aa", None, None, None)], EVIDENCE)
    assert {r.text_language for r in language.identify(same, language.fit(same)).collect()} == {"aa"}


def test_quality_separates_junk(spark, none):
    rng = np.random.default_rng(8)
    clean = [" ".join(rng.choice(["river", "stone", "walks", "over", "green", "hills", "and", "sleeps"], 80)) + ".\nThe end of it." for _ in range(120)]
    junk = [" ".join(w.upper() + "!!" for w in rng.choice(["buy", "now", "cheap", "deal"], 60)) for _ in range(20)] + ["| a$$$ | b%%% " * 40] * 10
    rows = [(i, t) for i, t in enumerate(clean + junk)] + [(900, None), (901, ""), (None, clean[0])]
    found = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].kept for i in range(120)) and not any(found[i].kept for i in range(120, 150)) and found[None].kept
    assert not found[900].kept and not found[901].kept and quality.classify(none).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(9)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9])
    cast = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    cast[rng.random(cast.shape) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    share, tables, _ = quality.estimate(patterns, counts)
    assert abs(share - 0.7) < 0.03 and np.abs(tables[1, :, quality.GOOD] - right).max() < 0.04


def test_estimate_and_scorer_against_plain_ones():
    rng = np.random.default_rng(10)
    patterns = rng.integers(0, 3, (30, 4))
    counts = rng.integers(1, 50, 30)
    share, tables, good = quality.estimate(patterns, counts, rounds=7)
    plain = [0.95 if not b else 0.5 if b == 1 else 0.05 for b in (patterns == quality.BAD).sum(axis=1)]
    for _ in range(7):
        weight = [[(1 - g) * c for g, c in zip(plain, counts)], [g * c for g, c in zip(plain, counts)]]
        prior = (sum(weight[1]) + 1) / (counts.sum() + 2)
        table = [[[sum(w for w, p in zip(weight[c], patterns) if p[j] == v) + (2 if v == c else 1) for v in (0, 1)] for j in range(4)] for c in (0, 1)]
        plain = []
        for p in patterns:
            odds = [1 - prior, prior]
            for c in (0, 1):
                for j, v in enumerate(p):
                    odds[c] *= table[c][j][v] / sum(table[c][j]) if v != quality.ABSTAIN else 1
            plain.append(odds[1] / sum(odds))
    assert math.isclose(share, prior) and np.allclose(good, plain)
    x = rng.random((50, 3)).astype(np.float32)
    y = (x[:, 0] > x[:, 1]).astype(float)
    model = quality.fit_scorer(x, y, rounds=2000)
    score = 1 / (1 + np.exp(-(x @ model[:3] + model[3])))
    slope = ((score - y)[:, None] * x).mean(axis=0) + 1e-4 * model[:3]
    assert ((score > 0.5) == (y > 0.5)).mean() > 0.95 and np.abs(slope).max() < 0.02  # near the minimum of the loss


def test_quality_of_long_texts_and_clashing_columns(spark, docs):
    found = {r.doc_id: r for r in quality.classify(docs.withColumns({c: quality.F.lit("clash") for c in ("pattern", "posterior", "kept", "features")})).collect()}
    assert len(found) == len({d for d, *_ in every()}) and not found[3].kept and not found[4].kept and not found[5].kept
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(1)).collect()}
    assert all(math.isclose(again[d], r.score, rel_tol=1e-6) for d, r in found.items())


def test_trigram_sums_are_whole():
    texts = [b"abc", b"", ("xyz " * 400_000).encode()]
    n, total = trigrams.sums(texts, np.ones((1, 64)))
    assert n.tolist() == total[:, 0].tolist() and n[0] == 3 and n[2] > 1_000_000
