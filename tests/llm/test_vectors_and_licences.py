"""Vector codes, hard negatives and licence scans against plain versions, on small tables with every odd case."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meterframe.llm import codes, integers, licences, negatives

VECTORS = "vec_id long, embedding array<float>, label int"
CLASH = ("row", "part", "block", "vector", "code", "kept", "change", "name", "n", "anchor", "score", "asked")


def vector_rows(seed, count=240, size=16, wide=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, size))
    rows = [(i, [float(np.float32(x)) for x in (centres[rng.integers(0, 6)] + rng.normal(0, 0.05, size)) * wide], int(rng.integers(0, 4)) if i % 17 else None) for i in range(count)]
    rows += [rows[3], rows[7], rows[100], (None, rows[5][1], 2), (None, rows[6][1], None), (300, rows[0][1][:5], 1), (301, [], 1), (302, [0.0] * size, 0)]
    bad = [(310, None, 1), (311, [math.nan] * size, 1), (312, [math.inf] + [0.0] * (size - 1), 1), (313, [None] + [0.0] * (size - 1), 1), (314, [-math.inf], None)]
    return rows, bad


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * x) for x in r[1]]))
    width = max(1, -(-max((len(r[1]) for r in rows), default=0) // parts))
    vectors = [[math.floor(4096 * x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in rows]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(p, c[p])[1]].append(c[p])
            for e, held in groups.items():
                books[p][e] = [sum(x) // len(held) for x in zip(*held)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for r, e in zip(rows, errors):
        labels[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{e:02x}" for _, e in f), error, labels[r[2]], sha) for r, f, error in zip(rows, found, errors))


@pytest.mark.parametrize("wide", [1.0, 3e5])
@pytest.mark.parametrize("count", [240, 5])
def test_codes_against_plain_lloyd(spark, wide, count):
    rows, bad = vector_rows(1, wide=wide) if count == 240 else ([(i, [0.5 * i, -0.25], None) for i in range(count)], [])
    frame = spark.createDataFrame([*rows, *bad], VECTORS).repartition(3)
    frame = frame.select("*", *[codes.F.lit("clash").alias(c) for c in CLASH])
    found = codes.compress(frame).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == plain_codes(rows)


def test_codes_of_empty_and_far_tables(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    far = [(i, [x, -x, 1.0], 0) for i, x in enumerate([1e30, 1e300, 5.0, -1e20])]
    rows = codes.compress(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int"), entries=1).collect()
    assert {r.vec_id for r in rows if r.error is None} == {0, 1, 2, 3} and {r.label_error for r in rows} == {None}


def test_only_moved_entries_are_compared(monkeypatch):
    """The result of the short comparison is that of the whole one, ties included, and its work is less."""
    rng = np.random.default_rng(2)
    part = rng.integers(-3, 4, (500, 2))
    before = rng.integers(-3, 4, (8, 2))
    own, kept = codes.assigned(part, before, np.ones(8, bool), np.full(500, -1), np.zeros(500, np.int64))
    work = []
    whole = integers.distances
    monkeypatch.setattr(codes, "distances", lambda a, b: work.append(len(a) * len(b)) or whole(a, b))
    after = before.copy()
    after[[2, 5]] += 1
    found, away = codes.assigned(part, after, (after != before).any(axis=1), own, kept)
    plain = [min(((x - c) @ (x - c), e) for e, c in enumerate(after)) for x in part]
    assert [(int(a), int(e)) for a, e in zip(away, found)] == [(int(a), e) for a, e in plain]
    assert sum(work) < 500 * 8
    codes.assigned(part, after, np.zeros(8, bool), found, away)
    assert len(work) == 2


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for bits in (8, 28, 50):
        a, b = (rng.integers(-(1 << bits), 1 << bits, (5, 6)) for _ in range(2))
        assert integers.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert integers.distances(a, b).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, s)) for s in b] for r in a]


def plain_negatives(rows, positives=5, count=10):
    size = max((len(r[1]) for r in rows), default=0)
    vectors = [[math.floor(256 * x) for x in r[1]] + [0] * (size - len(r[1])) for r in rows]
    labels = [None if r[2] is None else (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2] for r in rows]
    out = []
    for i, r in enumerate(rows):
        if labels[i] is None or r[0] is None or r[0] % 100:
            continue
        order = sorted((-sum(a * b for a, b in zip(vectors[i], vectors[j])), rows[j][0] is None, rows[j][0] or 0, j) for j in range(len(rows)) if j != i and labels[j] is not None)
        for p in [x for x in order if labels[x[3]] == labels[i]][:positives]:
            within = [x for x in order if labels[x[3]] != labels[i] and -30 * p[0] <= -100 * x[0] <= -90 * p[0]][:count]
            out += [(r[0], rows[p[3]][0], k + 1, rows[x[3]][0], -p[0], -x[0]) for k, x in enumerate(within)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_of_a_task", [65_536, 40])
@pytest.mark.parametrize("wide", [1.0, 0.0, 1e6])
def test_negatives_against_all_pairs(spark, monkeypatch, rows_of_a_task, wide):
    monkeypatch.setattr(negatives, "ROWS", rows_of_a_task)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "FEW", 50)
    rows, bad = vector_rows(4, wide=wide)
    rows += [(100 * k, rows[k][1], k % 3) for k in range(1, 12)] + [rows[100]]
    frame = spark.createDataFrame([*rows, *bad], VECTORS).repartition(3).select("*", *[negatives.F.lit("clash").alias(c) for c in CLASH])
    label = negatives.F.when(negatives.F.col("vec_id") % 7 == 0, (negatives.F.col("label") + 1) % 10).otherwise(negatives.F.col("label"))
    found = negatives.mine(frame, negatives.F.col("vec_id") % 100 == 0, label).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_negatives(rows) and (found or not wide)


def test_negatives_of_small_tables(spark):
    asked, label = negatives.F.col("vec_id") % 100 == 0, negatives.F.col("label")
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [1.0], 1), (1, [1.0], 1)], [(5, [1.0], 1)]):
        assert negatives.mine(spark.createDataFrame(rows, VECTORS), asked, label).count() == 0
    edge = [(0, [1.0], 1), (1, [1.0], 1), *[(k, [k / 256], 2) for k in (231, 230, 77, 76)], (500, [230 / 256], 3)]
    found = negatives.mine(spark.createDataFrame(edge, VECTORS), asked, label).where("anchor_id = 0").collect()
    assert [(r.positive_id, r.rank, r.negative_id) for r in found] == [(1, 1, 230), (1, 2, 500), (1, 3, 77)]


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licence_words(text):
    return LICENCE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    own = licence_words(text)
    places = [(i, label) for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")) for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(own), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


MIT, GPL = (next(t.text for t in licences.NOTICES if t.text.startswith(start)) for start in ("Permission is hereby", "This program is"))
LICENSED = [
    (1, "released under the MIT License.", "mit"),
    (2, "is licensed under the GNU General Public License, version 3. See it.", "gpl,gpl-3.0"),
    (3, "Licensed under the Apache\n * License,\tVersion 2.0.", "apache,apache-2.0"),
    (4, "licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc,cc-by-nc-4.0"),
    (5, "mit der license, apache; license of the gnu public general license, cc, by: ccby", "apache,cc-by"),
    (6, None, ""),
    (7, "", ""),
    (8, " \x00\x7f--", ""),
    (9, "Copyright (c) 2020 A B\n" + MIT.replace("software and", "software (c) A. Person and its"), "mit"),
    (10, "# " + "\n# ".join(GPL.split(" ")), "gpl"),
    (11, "Permission is hereby granted, free of charge, to deal in nothing; sublicense and or sell copies, to deal in the Software without restriction", ""),
    (12, "cc by cc by cc by émit license mit license", "cc-by,mit"),
    (13, "GNU Lesser General Public License and the GNU AFFERO General public license", "agpl,lgpl"),
    (14, "the end of Apache License", "apache"),
    (14, "the end of Apache License", "apache"),
    (None, "SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
]


def test_licences_of_texts(spark):
    wordy = " ".join(f"apache license{i} cc" for i in range(200_000)) + " by the MIT license"
    rows = [*LICENSED, (20, wordy, "cc-by,mit")]
    frame = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(3)
    frame = frame.select("*", *[licences.F.lit("clash").alias(c) for c in ("n_words", "matches", "word", "label", "base")])
    found = licences.digest(licences.scan(frame)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in found), key=str)
    assert got == sorted(((d, *plain_base(t), labels) for d, t, labels in rows), key=str)
    assert all((r.score == 0) == (r.labels == "") and 0 <= r.score <= 1 for r in found)
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    counts = licences.word_documents(frame)
    plain = Counter(w for _, t, _ in rows for w in set(licence_words(t)))
    assert counts == {w: plain[w.decode()] for t in licences.TEMPLATES for w in t.words if plain[w.decode()]}


def test_places_do_not_depend_on_pieces_or_rarity(monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = "gnu general public license apache cc by mit the of version 2 0".split()
    text = " ".join(rng.choice(vocabulary, 4000)) + " " + MIT + " " + " ".join(rng.choice(vocabulary, 500))
    found = []
    for piece, held in ((1 << 20, {}), (50, {b"gnu": 9}), (997, {b"license": 5, b"general": 4})):
        monkeypatch.setattr(licences, "PIECE", piece)
        index = licences.Index(licences.TEMPLATES, held)
        n, matches = index.matches(text.encode())
        base = sorted((first, licences.TEMPLATES[t].label) for t, first, _, _ in matches if licences.TEMPLATES[t].base)
        assert (n, len(base), base[0][0], base[-1][0]) == plain_base(text)[:4]
        found.append({(licences.TEMPLATES[t].label) for t, *_ in matches} | {len(base)})
    assert found[0] == found[1] == found[2]


def test_templates_must_hold_their_key_phrases():
    with pytest.raises(ValueError):
        licences.Template("x", "some words", ("other words",))
