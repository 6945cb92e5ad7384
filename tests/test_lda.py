import hashlib

import numpy as np
import pytest

from lexiloom.operators import bow, lda, tfidf
from lexiloom.sources import corpus


def test_counts_are_conserved_and_topics_found(spark):
    made = corpus.topic_corpus(spark, n_docs=40, n_words=600)
    terms = bow.doc_terms(made.select("doc_id", "word"))
    vocab = bow.vocabulary(terms).cache()
    matrix = terms.join(vocab, "word").select("doc_id", "word_idx", "cnt").cache()
    state = lda.fit(matrix, vocab.count(), k=10, iterations=20, seed=3, parts=2)
    n = lda.long_counts(state, "word_idx").groupBy("word_idx").sum("n").collect()
    assert {r[0]: r[1] for r in n} == {r.word_idx: r.occ for r in vocab.collect()}
    assert lda.long_counts(state).count() == 10  # no topic is empty
    best = lda.top_words(lda.phi(state, vocab, 10), vocab).collect()
    decades = [{int(r.word) // 10 for r in best if r.topic == t and r["rank"] <= 5} for t in range(1, 11)]
    assert sum(len(d) == 1 for d in decades) >= 5


def test_modes_and_reruns(spark):
    matrix = spark.createDataFrame([(d, w, 1 + (d + w) % 3) for d in range(6) for w in range(5)], "doc_id long, word_idx int, cnt long")
    for mode in ("serial", "ad", "block", "bundles"):
        runs = [sorted((r.doc_id, r.word_idx, tuple(r.z)) for r in lda.fit(matrix, 5, 3, 2, 7, mode, 2).collect()) for _ in range(2)]
        assert runs[0] == runs[1] and all(len(z) == 1 + (d + w) % 3 and set(z) <= {0, 1, 2} for d, w, z in runs[0])


def test_phi_and_theta_are_distributions(spark):
    matrix = spark.createDataFrame([(d, w, 1 + (d + w) % 3) for d in range(6) for w in range(5)], "doc_id long, word_idx int, cnt long")
    state = lda.initial_topics(matrix, 3, "doc_id", "word_idx")
    vocab = spark.createDataFrame([(w, f"w{w}") for w in range(6)], "word_idx int, word string")
    assert all(abs(r[1] - 1) < 1e-9 for r in lda.phi(state, vocab, 3).groupBy("k").sum("phi").collect())
    assert all(abs(r[1] - 1) < 1e-9 for r in lda.theta(state, 3).groupBy("doc_id").sum("theta").collect())


def test_bundles_find_topics_and_conserve_counts(spark):
    made = corpus.topic_corpus(spark, n_docs=30, n_words=500)
    terms = bow.doc_terms(made.select("doc_id", "word"))
    vocab = bow.vocabulary(terms).cache()
    matrix = terms.join(vocab, "word").select("doc_id", "word_idx", "cnt").cache()
    state = lda.fit(matrix, vocab.count(), k=10, iterations=4, seed=3, mode="bundles", parts=2, rounds=2)
    n = lda.long_counts(state, "doc_id").groupBy("doc_id").sum("n").collect()
    assert {r[0]: r[1] for r in n} == {i: 500 for i in range(30)}
    # Words of a decade come together: topics are far less even over decades than at the start, where each is a tenth.
    counts = lda.long_counts(state, "word_idx").join(vocab, "word_idx").selectExpr("int(word) div 10 as decade", "k", "n").groupBy("decade", "k").sum("n").toPandas()
    share = counts.groupby("k")["sum(n)"].max() / counts.groupby("k")["sum(n)"].sum()
    assert share.mean() > 0.25


def test_each_word_has_one_round_a_sweep():
    words = np.arange(500)
    for parts, rounds in ((1, 1), (3, 4), (8, 5)):
        own = [lda.bundle_round(words, p, parts, rounds) for p in range(parts)]
        assert all(set(o) <= set(range(rounds)) for o in own)
        if parts <= rounds:  # no two workers draw a word in the same round
            assert all(len({o[w] for o in own}) == parts for w in words)


def test_a_serial_sweep_by_hand():
    rng = np.random.default_rng(1)
    docs, words, cnts = np.repeat(np.arange(4), 3), np.tile(np.arange(3, dtype=np.int32), 4), np.full(12, 2, np.int32)
    part = lda._Part(docs, words, cnts, rng.integers(0, 3, 24))
    z, u = part.z.copy(), rng.random(24)
    n_w = np.stack([np.bincount(z[words[part.row] == w], minlength=3) for w in range(3)])
    part.swept(np.arange(3), n_w, np.bincount(z, minlength=3), 3, 3, 1.0, 1.0, u, 1)
    for i in range(24):  # one token after the other, all counts counted anew
        rest = np.arange(24) != i
        d, w = docs[part.row] == docs[part.row[i]], words[part.row] == words[part.row[i]]
        n = [np.bincount(z[rest & at], minlength=3) for at in (d, w, np.ones(24, bool))]
        c = np.cumsum((n[0] + 1) * (n[1] + 1) / (n[2] + 3))
        z[i] = min(2, int((c < u[i] * c[-1]).sum()))
    assert (part.z == z).all()


def test_settings_are_checked(spark):
    matrix = spark.createDataFrame([(1, 0, 1)], "doc_id long, word_idx int, cnt long")
    for bad in ({"mode": "none"}, {"k": 0}, {"iterations": -1}, {"rounds": 0}):
        with pytest.raises(ValueError):
            lda.fit(matrix, 1, **bad)


def test_md5_of_many_at_once():
    docs, words = [0, 7, -12, None, 2**62, 123456], [b"a", b"it's", b"x" * 27, b"w", b"y" * 27, b"zz"]
    cnts = np.array([1, 12, 3, 2, 101, 1001])
    for tag in (b"", b"|1"):
        want = [
            int.from_bytes(hashlib.md5((b"" if d is None else b"%d|" % d) + w + b"|%d" % i + tag).digest()[:4], "big")
            for d, w, c in zip(docs, words, cnts, strict=True) for i in range(1, c + 1)
        ]
        assert lda.md5_numbers(docs, words, cnts, tag).tolist() == want
    assert len(lda.md5_numbers([], [], np.array([], np.int64))) == 0


def test_counts_of_hashed_topics(spark):
    """As of the topics themselves, with null ids and ids that repeat, and from texts as from terms."""
    for ids in ((0, 1, 2, None), (0, 1, 1, None, None)):
        docs = spark.createDataFrame([(i, "a b a é b 9 a don't") for i in ids], "doc_id long, text string")
        terms = bow.text_terms(docs)
        state = lda.initial_topics(terms, 3, "doc_id", "word")
        for by in ((), ("doc_id",), ("word",)):
            want = sorted(map(repr, lda.long_counts(state, *by).collect()))
            assert sorted(map(repr, lda.hashed_counts(terms, 3, *by).collect())) == want
            found = lda.hashed_counts_of_texts(docs, 3, *by)
            assert sorted(map(repr, found.collect())) == want


def test_parts_rise_with_the_corpus(spark, monkeypatch):
    """A part's size, and so an executor's memory, is bounded; the counts are whole."""
    terms = spark.createDataFrame([(d, f"w{d * i % 7}", 1 + i) for d in range(60) for i in range(5)], "doc_id long, word string, cnt long")
    terms = terms.groupBy("doc_id", "word").sum("cnt").withColumnRenamed("sum(cnt)", "cnt")
    monkeypatch.setattr(lda, "PART_TOKENS", 30)
    for mode in ("block", "bundles"):
        state = lda.fit_parts(terms, 7, 3, 1, mode=mode)
        assert state.where("bucket < 0").count() > 20  # 4 with a part for each partition of a shuffle
        got = {r.word: r.n for r in lda.part_counts(state, 3, "word").groupBy("word").sum("n").toDF("word", "n").collect()}
        assert got == {r.word: r.n for r in terms.groupBy("word").sum("cnt").toDF("word", "n").collect()}


def test_scores_join_without_sorting_the_terms(spark):
    scored = tfidf.tfidf(bow.text_terms(spark.createDataFrame([(1, "a b a"), (2, "a c")], "doc_id long, text string"), places=True), 2)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Window" not in plan
