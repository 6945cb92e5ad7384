import random

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import components as components_of
from lexiloom.llm import ngram_join
from lexiloom.llm.common import materialise
from lexiloom.llm.components import components
from tests.llm.odd import none, odd, rows


def by_hand(docs):
    memo = ngram_join._WordHash()
    sets = {i: set(ngram_join.shingles((t or "").encode().split(), memo).tolist()) for i, t in docs}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    root = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            if (j := todo.pop()) not in root:
                root[j] = i
                todo += links[j]
    return {i: (root[i], len(links[i])) for i in sets}


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(rng.choice([1, 2, 3, 40])):  # groups too large to compare all their members by signature
            c = list(b)
            for _ in range(rng.randrange(5)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    docs = list(enumerate(texts))
    found = ngram_join.query(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == by_hand(docs)


def test_large_group_in_blocks(spark):
    rng = random.Random(3)
    base = [f"v{k}" for k in range(100)]
    docs = [(i, " ".join(w if rng.random() > 0.012 else f"x{rng.randrange(9)}" for w in base)) for i in range(300)]
    found = ngram_join.query(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == by_hand(docs)


def test_depth():
    assert ngram_join.depth_needed(0.99) == ngram_join.DEPTH and ngram_join.depth_needed(0.8) < ngram_join.DEPTH
    for t in (0.7, 0.8, 0.9):
        d = ngram_join.depth_needed(t)
        assert 1 - (1 - t**d) ** ngram_join.TREES >= ngram_join.TARGET_RECALL


def test_odd(spark):
    found = ngram_join.ngram_join(odd(spark, "class_id", "n_links", "rep", "root")).collect()
    assert len(found) == len(rows())
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.class_id, r.n_links))
    assert got[1] == [(1, 3)] and got[2] == [(1, 3), (1, 3)] and got[3] == [(3, 0)] and got[4] == [(4, 0)] and got[5] == [(5, 0)]
    # A null id is no text's name: the row links by its text, like others.
    assert got[6][0][0] == got[7][0][0] == 6 and sorted(got[None], key=repr) == [(1, 3), (None, 0)] and got[2**60 + 1] == [(2**60 + 1, 0)]
    assert ngram_join.query(none(spark)).count() == 0


def near_copies(n):
    rng = random.Random(3)
    base = [f"v{k}" for k in range(100)]
    return [(i, " ".join(w if rng.random() > 0.012 else f"x{rng.randrange(9)}" for w in base)) for i in range(n)]


def test_packs_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PACK", 70)  # several packs, which meet two by two
    docs = near_copies(300) + [(1000 + i, f"a text of its own number {i} " * 3) for i in range(20)]
    found = ngram_join.query(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == by_hand(docs)


def test_rows_grow_with_the_group(spark, monkeypatch):
    """What is written between the steps for 2,000 near copies is at most some four times that for 500."""
    written = {}

    def keep(df, tag):
        out = materialise(df, tag)
        written[tag] = written.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialise", keep)
    monkeypatch.setattr(components_of, "materialise", keep)
    sizes = []
    for n in (500, 2000):
        written.clear()
        assert ngram_join.query(spark.createDataFrame(near_copies(n), "doc_id long, text string")).where("n_links > 0").count() > 0.8 * n
        sizes.append(dict(written))
    assert all(sizes[1].get(tag, 0) <= 4.4 * k + 50 for tag, k in sizes[0].items()), sizes


def test_common_counts(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(23)]
    want = np.array([[np.intersect1d(x, y).size for y in sets] for x in sets])
    for dense in (0, 3, 10**9):  # pair by pair, mixed, all in columns
        monkeypatch.setattr(ngram_join, "DENSE", dense)
        assert (ngram_join._common(sets[:9], sets[9:]) == want[:9, 9:]).all()
        got = ngram_join._common(sets)
        assert (got - np.diag(np.diag(got)) == want - np.diag(np.diag(want))).all()


def test_ids_that_repeat_or_are_null(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = [(1, a), (1, b), (2, b + " more"), (None, a), (None, a + " more"), (None, b), (3, None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.text_id) for r in ngram_join.query(df.repartition(3)).collect()), key=repr)
    want = [(1, 1, 2, 1), (1, 1, 2, 1), (2, 1, 2, 2), (None, 1, 2, 1), (None, 1, 2, None), (None, 1, 2, 1), (3, 3, 0, 3), (None, None, 0, None)]
    assert got == sorted(want, key=repr)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.first_of_classes(df.repartition(3)).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (3, None), (None, "")], key=repr)


def test_many_null_ids(spark):
    text = " ".join(f"a{k}" for k in range(30))
    df = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.col("id").alias("other"))
    kept = ngram_join.first_of_classes(df)
    assert kept.columns == ["doc_id", "text", "other"] and kept.count() == 1
    assert [tuple(r) for r in ngram_join.query(df).distinct().collect()] == [(None, None, 9_999, None)]


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = spark.range(1, 500).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(star).where("root <> 0").count() == 0


def test_components_of_long_shuffled_paths(spark):
    rng = random.Random(8)
    ids = [rng.sample(range(k * 10**6, (k + 1) * 10**6), n) for k, n in enumerate((3_000, 1_000))]
    edges = [(p[i], p[i + h]) for p, most in zip(ids, (3, 1)) for h in range(1, most + 1) for i in range(len(p) - h)]
    rng.shuffle(edges)
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: min(p) for p in ids for v in p}
