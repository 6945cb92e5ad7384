import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate as d
from lexiloom.llm.common import sampled_texts
from tests.llm.odd import none, odd, rows


def corpus():
    rng = random.Random(4)
    ends = ("a", "en", "ing", "or", "ul", "ish")
    words = [f"{a}{b}{c}{d}" for a in "bcdfghklmnprst" for b in ends for c in "dlnt" for d in ends] + ["the", "of", "and"] * 250
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(15, 50)))) for i in range(30)]
    docs, truth = [], {}
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 300))]
        if i % 4 == 0:
            item, own = rng.choice(items), []
            for w in item[1].split():  # a paraphrase: some words go, some come, some change
                u = rng.random()
                own += [] if u < 0.06 else [w, rng.choice(words)] if u < 0.12 else [rng.choice(words)] if u < 0.2 else [w]
            if i % 8 == 0:
                own = item[1].split()
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
            truth[i] = item[0]
        docs.append((i, " ".join(text).capitalize()))
    return docs, items, truth


def test_leaks_and_paraphrases(spark):
    docs, items, truth = corpus()
    found = d.query(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: r.item_ids for r in found if r.contaminated}
    words = {i: d.words_of(t) for i, t in docs}
    brute = {i for i, j in truth.items() if d.is_leak(d.words_of(dict(items)[j]), words[i])[0]}
    assert len(brute) > 50 and all(truth[i] in got.get(i, []) for i in brute)
    assert set(got) <= set(truth)


def test_lcs():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert d.lcs(a, b) == table[-1][-1]


def test_answer_must_be_there():
    item = [f"w{k}" for k in range(20)]
    assert d.is_leak(item, item)[0] and not d.is_leak(item, item[:14])[0] and d.is_leak(item, item[:10] + ["x"] * 4 + item[13:])[0]


def test_odd(spark):
    own = spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, "too short"), (3, "zebra yak walrus viper urial tapir snake raven quail"), (3, "zebra yak walrus viper urial tapir snake raven quail")], "item_id long, text string")
    found = d.contaminated(odd(spark, "item_ids", "coverage"), own).collect()
    assert len(found) == len(rows()) and all(r.item_ids == [] for r in found)
    assert all(r.item_ids == [] for r in d.contaminated(odd(spark), own.where("item_id = 2")).collect())
    assert d.query(none(spark), own).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    docs, items, truth = corpus()
    monkeypatch.setattr(d, "ITEMS_AT_ONCE", 16)
    docs = [x for x in docs if x[0] % 8 == 0]
    found = d.query(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(truth[r.doc_id] in r.item_ids for r in found) and len(found) == len(docs)


def test_short_items_at_a_start(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}{e}" for a in "bdfgklmnprst" for b in "aeiou" for c in "dlnt" for e in "aeiou"]
    items = [(i, " ".join(rng.sample(words, 5 + i % 8))) for i in range(120)]
    docs = []
    for i, text in items:
        before = [f"x{rng.randrange(900)}" for _ in range(rng.randrange(30))]  # shifts what comes after in the batch
        rest = [f"x{rng.randrange(900)}" for _ in range(rng.randrange(60))]
        docs += [(3 * i, " ".join(before)), (3 * i + 1, text), (3 * i + 2, " ".join([text, *rest]))]
    own = spark.createDataFrame(items, "item_id long, text string")
    for n in (1, 3, 7):
        found = d.query(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), own).collect()
        got = {r.doc_id: r.item_ids for r in found}
        assert all(i in got[3 * i + 1] and i in got[3 * i + 2] and not got[3 * i] for i, _ in items)


def test_items_of_few_words(spark):
    own = spark.createDataFrame([(1, "Zebra yak?"), (2, "漢字の文です。"), (3, "walrus viper urial tapir"), (4, "..."), (5, "a longer item of seven words here")], "item_id long, text string")
    docs = [(1, "a zebra, Yak came"), (2, "zebra or yak"), (3, "x 漢字の文です"), (4, "walrus viper urial tapir"), (5, "walrus viper"), (6, "urial tapir"), (7, "yak zebra"), (8, "..."), (9, "zebra")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for items in (own, own.where("item_id < 5")):
        got = {r.doc_id: (r.item_ids, r.coverage) for r in d.query(df.repartition(3), items).collect()}
        assert {i: x[0] for i, x in got.items() if x[0]} == {1: [1], 3: [2], 4: [3]} and got[1][1] == 1.0


def test_benchmarks_of_any_size(spark, monkeypatch):
    """A few items are found as well as many, and results don't depend on how many are compared at a time."""
    docs, items, truth = corpus()
    df, words = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), {i: d.words_of(t) for i, t in docs}
    for low, high in ((0, 1), (4, 6), (10, 14), (0, 8), (14, 30)):
        some = dict(items[low:high])
        own = spark.createDataFrame(list(some.items()), "item_id long, text string")
        brute = {i for i, j in truth.items() if j in some and d.is_leak(d.words_of(some[j]), words[i])[0]}
        got = {r.doc_id: r.item_ids for r in d.query(df, own).collect() if r.contaminated}
        assert all(truth[i] in got.get(i, []) for i in brute) and set(got) <= {i for i, j in truth.items() if j in some}, (low, high)
    own, runs = spark.createDataFrame(items, "item_id long, text string"), []
    for n in (4, 16, 5000):
        monkeypatch.setattr(d, "ITEMS_AT_ONCE", n)
        runs.append(sorted(map(repr, d.query(df, own).collect())))
    assert runs[0] == runs[1] == runs[2]


def test_a_benchmark_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_ITEM_WORDS", 5)
    with pytest.raises(ValueError):
        d.query(none(spark), spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string"))


def test_sample_of_copies_is_bounded(spark):
    copies = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    assert sampled_texts(copies, 100, 3).count() <= 1


def passage_rows(texts, vocab):
    """Every window of every text, as counts of the vocabulary's words."""
    for text in texts:
        words = [vocab.get(w, -1) for w in d.words_of(text)]
        for at in range(-d.WINDOW, len(words) + d.WINDOW, d.STRIDE):
            own = [w for w in words[max(0, at) : max(0, at + d.WINDOW)] if w >= 0]
            if own:
                yield np.bincount(own, minlength=len(vocab))


def test_basis_is_of_all_documents(spark, monkeypatch):
    """The latent space is that of every passage of every document, whatever their number, and of all items."""
    monkeypatch.setattr(d, "RANK", 4)
    monkeypatch.setattr(d, "EXTRA", 20)  # as many vectors as words: the largest singular vectors are found exactly
    rng = random.Random(8)
    vocab = {f"w{k}": k for k in range(20)}
    texts = [" ".join(rng.choices([*vocab, "other"], weights=[1 + (k + i // 2000) % 7 for k in range(21)], k=rng.randrange(4, 30))) for i in range(8000)]
    idf, items = 1 + np.arange(20) / 10, [np.array([1, 2, 3, 5, 5, 8]), np.array([0, 19, 18, 7, 11])]
    a = np.array(list(passage_rows(texts, vocab))) * idf
    b = np.array([np.bincount(i, minlength=20) * idf for i in items])
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    best = np.linalg.eigh(a.T @ a / (a * a).sum() + b.T @ b / (b * b).sum())[1][:, -4:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (1, 40):
        found = d.latent_basis(docs.repartition(n), vocab, idf, items)
        assert found.shape == (20, 4) and np.abs(found @ found.T - best @ best.T).max() < 1e-9


def test_basis_with_few_vectors(spark):
    """With fewer vectors than words the space holds nearly as much of the passages and items as the best of its rank."""
    docs, items, _ = corpus()
    vocab = {w: k for k, w in enumerate(sorted({w for _, t in items for w in d.words_of(t)}))}
    ids = [np.array([vocab[w] for w in d.words_of(t)]) for _, t in items]
    a = np.array(list(passage_rows([t for _, t in docs], vocab)), float)
    b = np.array([np.bincount(i, minlength=len(vocab)) for i in ids], float)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    whole = a.T @ a / (a * a).sum() + b.T @ b / (b * b).sum()
    found = d.latent_basis(spark.createDataFrame(docs, "doc_id long, text string"), vocab, np.ones(len(vocab)), ids)
    assert len(vocab) > d.RANK + d.EXTRA and np.abs(found.T @ found - np.eye(d.RANK)).max() < 1e-9
    assert np.trace(found.T @ whole @ found) > 0.9 * np.linalg.eigvalsh(whole)[-d.RANK :].sum()


def test_words():
    rng = random.Random(9)
    every = [chr(k) for k in range(128)]
    for text in ("".join(every), *("".join(rng.choices(every, k=60)) for _ in range(300)), "Straße_1 漢字\u3000ok", ""):
        assert d.words_of(text) == re.findall(r"\w+", text.lower())


def test_words_are_looked_up_at_once():
    """The lookup gives each text's words the ids that a dict gives words_of, whatever signs, scripts and lengths."""
    rng = random.Random(12)
    signs = list("abAB01_ \t\n.,'\x00\x1c\x85\xa0éßİΣσςẞ漢字、。がमाी́ 　😀𝐀\ud800²½Ⅷª")
    for run in range(60):
        pool = ["".join(rng.choices(signs[: 6 if rng.random() < 0.5 else None], k=rng.randrange(40))) for _ in range(60)]
        pool += ["x" * k + end for k in (7, 8, 9, 15, 16, 17, 24) for end in ("", "a", "b")]
        known = sorted({w for t in pool for w in d.words_of(t)})
        vocab = {w: k for k, w in enumerate(rng.sample(known, rng.randrange(1, len(known) + 1)))}
        texts = [rng.choice((" ", ".", "Σ", "")).join(rng.choices(pool, k=rng.randrange(5))) for _ in range(30)]
        ids, sizes = d.Lookup(vocab)(texts)
        words = [d.words_of(t) for t in texts]
        assert sizes.tolist() == [len(w) for w in words], run
        assert ids.tolist() == [vocab.get(w, -1) for own in words for w in own], run
