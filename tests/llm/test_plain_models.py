"""Counts, models and votes behind language and quality, against versions written out by their definitions."""

import math
from collections import Counter

import numpy as np

from meterframe.llm import language, quality, trigrams

TEXTS = ["The cat, the dog!", "", "   ", "a", "Ab  cd\tef\n", "Él está aquí — ça va", "x" * 50, "AAAA BBBB!! $$$ || ..", "a,b;c: d? e!", "word " * 30, "line one.\nline one.\nline two.\nline one.\nline one.", "\x00\x7f é  z"]


def plain_trigrams(text, count, table=None):
    data = text.encode()
    data = b" " + (data.translate(table) if table else data) + b" "
    found = Counter()
    for a, b, c in zip(data, data[1:], data[2:]):
        if not (a == b == 32 or b == c == 32):
            found[((a << 16 | b << 8 | c) * 2654435769 % (1 << 32)) >> (32 - int(math.log2(count)))] += 1
    return found


def test_trigram_counts(monkeypatch):
    long = " ".join(f"w{i % 37}é{i % 11}" for i in range(4000))
    for block in (1 << 20, 100):
        monkeypatch.setattr(trigrams, "BLOCK_BYTES", block)
        for table in (None, language._FOLD):
            texts = [*TEXTS, long]
            found = trigrams.counts([t.encode() for t in texts], np.arange(len(texts)), len(texts), 4096, table)
            for row, text in zip(found, texts):
                assert {i: n for i, n in enumerate(row.tolist()) if n} == plain_trigrams(text, 4096, table)
    grouped = trigrams.counts([t.encode() for t in TEXTS], np.array([0, -1] * (len(TEXTS) // 2)), 1, 64)
    assert grouped.sum() == sum(plain_trigrams(t, 64).total() for t in TEXTS[::2])


def test_language_model(spark):
    rows = [(t, lang) for i, t in enumerate(TEXTS * 3) for lang in (("en", "de", "es", None)[i % 4],)] + [(None, "en"), ("only text", "zz")]
    names, logs = language.fit(spark.createDataFrame(rows, "text string, declared string").repartition(3))
    assert names == ["de", "en", "es", "zz"]
    counts = {n: Counter() for n in names}
    for text, lang in rows:
        if lang:
            counts[lang] += plain_trigrams(text or "", language.BUCKETS, language._FOLD)
    every = sum((c.total() for c in counts.values()))
    for name, row in zip(names, logs):
        for bucket in [0, 17, *list(counts[name])[:200]]:
            pooled = (sum(c[bucket] for c in counts.values()) + language.SMOOTH) / (every + language.SMOOTH * language.BUCKETS)
            want = math.log((counts[name][bucket] + language.POOLED * pooled) / (counts[name].total() + language.POOLED))
            assert math.isclose(row[bucket], want, rel_tol=1e-12)
        assert math.isclose(np.exp(row).sum(), 1.0, rel_tol=1e-9)


def plain_votes(text):
    """The votes of all labellers, character by character."""
    data = text.encode()
    space = {9, 10, 11, 12, 13, 32}
    letter = lambda b: b >= 128 or chr(b).isalpha()
    symbol = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    words, held = [], bytearray()
    for b in [*data, 32]:
        if b in space:
            if held:
                words.append(bytes(held))
            held = bytearray()
        else:
            held.append(b)
    n, size = len(words), max(1, len(data))
    letters, solid = sum(map(letter, data)), max(1, sum(map(len, words)))
    upper, marks = sum(65 <= b <= 90 for b in data), sum(chr(b) in "*#$%&@~^=<>\\{}[]+_" for b in data if b < 128)
    plain = 0
    for w in words:
        w = w[:-1] if chr(w[-1]) in ".,;:!?" else w
        plain += all(map(letter, w))
    runs = at = 0
    while at + 1 < len(data):
        b = data[at]
        if b == data[at + 1] and b < 128 and b not in space and not chr(b).isalnum() and chr(b) not in "_.":
            runs, at = runs + 1, at + 2
        else:
            at += 1
    bare = sum(all(map(symbol, w)) for w in words)
    lines = [x for x in data.split(b"\n") if any(b not in space for b in x)]
    repeated = len(lines) - len(set(lines))
    shouted = len(data.split(b"!!")) - 1
    cells, mean = sum(b in (9, 124) for b in data), size / max(1, n)
    again = sum(a == b for a, b in zip(words, words[1:]))
    none = n == 0

    def vote(bad, good):
        return quality.BAD if none or bad else quality.GOOD if good else quality.ABSTAIN

    return (
        vote(marks > 0.06 * size, marks < 0.02 * size), vote(plain < 0.6 * n, plain > 0.8 * n), vote(runs > 0.2 * n, runs < 0.03 * n), vote(bare > 0.15 * n, bare < 0.03 * n),
        vote(upper > 0.4 * max(1, letters), upper < 0.2 * max(1, letters)), vote(shouted > 0.05 * n, shouted <= 0.01 * n), vote(cells > 0.15 * n, cells <= 0.02 * n), vote(mean > 25, 3 < mean < 14),
        vote(letters < 0.78 * solid, letters > 0.88 * solid), vote(len(lines) > 3 and repeated > 0.5 * len(lines), len(lines) > 1 and repeated <= 0.2 * len(lines)),
        vote(n > 40 and len(set(words)) < 0.2 * n, n > 20 and len(set(words)) > 0.3 * n), vote(n > 10 and again > 0.1 * n, n > 10 and again < 0.02 * n),
    )


def made_up(rng, count):
    pools = [list("abcdefgh ") + ["the ", "and "], list("AB!? ") + ["!!", "$$ "], list("ab.|\t\n# "), ["word ", "word ", "other, ", "é—ü ", "line\n"]]
    return ["".join(rng.choice(pools[rng.integers(0, 4)], int(rng.integers(0, 120)))) for _ in range(count)]


def test_votes_of_texts():
    for text in [*TEXTS, *made_up(np.random.default_rng(21), 400)]:
        assert quality.votes(text.encode()) == plain_votes(text), text


def test_quality_of_whole_rows(spark):
    rng = np.random.default_rng(22)
    rows = [(int(i), t) for i, t in enumerate(made_up(rng, 150))] + [(900, None), (None, "some text of no id"), (3, "the id of another")]
    found = quality.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    texts = [t or "" for _, t in rows]
    patterns = np.array([plain_votes(t) for t in texts])
    codes = patterns @ 3 ** np.arange(quality.LABELLERS)
    each, counts = np.unique(codes, return_counts=True)
    _, _, good = quality.estimate(np.array([patterns[codes.tolist().index(c)] for c in each]), counts)
    weak = dict(zip(each.tolist(), good.tolist()))
    features = np.zeros((len(texts), quality.BUCKETS))
    totals = np.zeros(len(texts))
    for i, t in enumerate(texts):
        grams = plain_trigrams(t, quality.BUCKETS)
        totals[i] = grams.total()
        for bucket, n in grams.items():
            features[i, bucket] = quality.SCALE * n / (totals[i] + quality.SHORT)
    shapes = np.concatenate([patterns == quality.BAD, patterns == quality.GOOD], axis=1)
    fitted = np.concatenate([features.astype(np.float16), shapes], axis=1).astype(np.float32)
    model = quality.fit_scorer(fitted, np.array([weak[c] for c in codes.tolist()]))
    score = 1 / (1 + np.exp(-(np.concatenate([features, shapes], axis=1) @ model[:-1] + model[-1])))
    want = sorted((str(d), int(c), round(weak[int(c)], 6), round(float(s), 2)) for (d, _), c, s in zip(rows, codes, score))
    got = sorted((str(r.doc_id), r.pattern, round(r.posterior, 6), round(r.score, 2)) for r in found)
    assert len(got) == len(want) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 0.03 for a, b in zip(got, want))
    blank = {str(d) for d, t in rows if not (t or "").strip()}
    assert all(r.kept == (r.score >= quality.KEEP and str(r.doc_id) not in blank) or str(r.doc_id) == "3" for r in found)
