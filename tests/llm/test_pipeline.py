"""The stages of the pipeline on a small folder: what each keeps, and what comes out at the end."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, SPOKEN, words


def make(spark, folder):
    rows = []
    for i in range(60):
        lang = ("en", "es", "de")[i % 3]
        text = " ".join(f"{w}{'x' * (i // 3 % 7)}" if (k + i) % 5 == 0 else w for k, w in enumerate((SPOKEN[lang] + " ").split() * 4))
        rows.append((i, text + ".", lang, f"s{i % 4}" if i % 9 else None, len(text)))
    rows += [(100 + i, rows[0][1], "en", "s0", 1) for i in range(5)] + [(100, rows[0][1], "en", "s0", 1)]
    rows += [(200, None, "en", "s1", 0), (201, "", "en", "s1", 0), (202, " ".join(w.upper() + "!!" for w in SPOKEN["en"].split() * 4), "en", "s1", 1), (None, rows[4][1] + " tail of it", "es", "s2", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[name] = docs.collect()
    ids = [Counter(r.doc_id for r in k) for k in kept.values()]
    assert ids[0] == Counter(r[0] for r in rows if r[0] not in (200, 201))
    assert 0 in ids[2] and ids[2][0] == 1 and not any(d in ids[2] for d in range(100, 105))
    assert all(n == 1 for n in ids[2].values()) and set(ids[3]) <= set(ids[2])
    total = sum(len(words(r.text)) for r in kept["SimHash near-dedup"])
    assert abs(sum(len(words(r.text)) for r in kept["mixing sources to target weights"]) - 1.5 * total) <= 5 * 32
    bins = defaultdict(int)
    for r in kept["best-fit packing"]:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048


def test_long_texts_clashing_columns_and_one_source(spark, tmp_path):
    """A very long text goes whole through every stage; columns of the stages' own names and a single source change nothing."""
    from pyspark.sql import functions as F

    long = " ".join(f"{w}{i % 97}" if i % 5 == 0 else w for i, w in enumerate((SPOKEN["en"] + " ").split() * 6000))
    rows = [(i, f"{SPOKEN['en']} and {i} more of the same river house {'x' * i}.", "en", "s", 1) for i in range(12)] + [(50, long + ".", "en", "s", 1), (51, None, None, "s", None)]
    clash = ["k1", "k2", "key", "node", "bits", "row", "at", "src", "size", "piece", "grp", "kept", "range"]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in clash])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 3:
            assert {r.doc_id: r.text for r in docs.where("doc_id = 50").collect()} == {50: long + "."}
            docs = docs.select("*", *[F.lit("clash").alias(c) for c in clash])
    pieces = docs.where("doc_id = 50").collect()
    assert sum(r.length for r in pieces) > 100_000 and max(r.length for r in pieces) == 2048


def test_empty_folder(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}


def edited(text, at):
    """``text`` with its words at these places replaced."""
    return " ".join(f"new{k}" if k in at else w for k, w in enumerate(text.split(" ")))


def test_edited_copies_are_dropped(spark):
    base = " ".join(f"w{i}" for i in range(400))
    other = " ".join(f"v{i}" for i in range(400))
    chain = [edited(base, range(0, 70 * k, 10)) for k in range(4)]  # neighbours in the chain alike, its ends not
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*chain, other, edited(other, range(0, 400, 60)), edited(other, range(0, 400, 12)), base.upper(), "", None])]
    shingled = [set(zip(*(t.split()[k:] for k in range(5)))) for t in (r[1] or "" for r in rows)]

    def alike(a, b):
        return not a | b or len(a & b) >= 0.8 * len(a | b)

    assert alike(shingled[4], shingled[5]) and not alike(shingled[4], shingled[6]) and not alike(shingled[0], shingled[3])
    least = list(range(len(rows)))
    sets = shingled[:7] + [shingled[0]] + shingled[8:]
    for _ in rows:
        for i in range(len(rows)):
            least[i] = min(least[j] for j in range(len(rows)) if alike(sets[i], sets[j]))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least))


def test_dense_candidates_lose_no_verified_link(spark):
    """Many candidates of one centre: only those of a spanning forest are verified at first, and the others if still apart."""
    from meterframe.llm import simhash

    base = " ".join(f"w{i}" for i in range(400))
    texts = [edited(base, {(11 * k + 37 * m) % 400 for m in range(8)}) for k in range(40)] + [edited(base, set(range(k % 5, 400, 14))) for k in range(20)]
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(texts))]
    shingled = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    bits = simhash.simhashes([t.encode() for _, t in rows], 5)
    near = [[len(a & b) >= 0.8 * len(a | b) and bin(int(x ^ y)).count("1") <= 14 for b, y in zip(shingled, bits)] for a, x in zip(shingled, bits)]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[j] for j in range(len(rows)) if near[i][j]) for i in range(len(rows))]
    found = {r.key: r.class_id for r in simhash.verified_near_duplicates(spark.createDataFrame(rows, "key long, text string")).collect()}
    assert len({(least[k], c) for k, c in found.items()}) == len(set(least)) == len(set(found.values()))


def test_the_mix_does_not_pass_its_slots_through_the_driver(spark, tmp_path):
    """what is broadcast is joined by source, or by source and range, never slots by the rank of their block."""
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert found.count() and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = [line for line in plan.splitlines() if "Join" in line and "rank" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
