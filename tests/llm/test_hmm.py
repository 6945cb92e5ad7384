import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import hmm
from tests.llm.odd import none, odd, rows


def model(n=6, seed=1):
    rng = np.random.default_rng(seed)
    return hmm.Hmm(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(n), hmm.STATES).T)


def test_forward_sums_over_all_paths():
    m, x = model(), np.array([2, 0, 5])
    want = sum(
        m.start[p[0]] * m.emit[x[0], p[0]] * math.prod(m.move[p[t - 1], p[t]] * m.emit[x[t], p[t]] for t in range(1, 3))
        for p in itertools.product(range(hmm.STATES), repeat=3)
    )
    assert math.isclose(m.likelihoods([x, np.array([1])])[0], math.log(want))


def test_long_texts_in_segments(monkeypatch):
    m, rng = model(), np.random.default_rng(2)
    xs = [rng.integers(0, 6, n) for n in (1, 700, 37, 129, 64)]
    whole = m.likelihoods(xs)
    monkeypatch.setattr(hmm, "STRAIGHT", 30)
    monkeypatch.setattr(hmm, "SEGMENT", 16)
    assert np.allclose(m.likelihoods(xs), whole)


def test_counts_raise_the_likelihood():
    m, rng = model(), np.random.default_rng(3)
    xs = [rng.choice([0, 1, 2], 30) if k % 2 else rng.choice([3, 4, 5], 25) for k in range(20)]
    before = m.likelihoods(xs).sum()
    for _ in range(4):
        start, move, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((6, hmm.STATES))
        m.counts(xs, np.tile(m.start, (len(xs), 1)), start, move, emit)
        assert math.isclose(emit.sum(), sum(map(len, xs))) and math.isclose(move.sum(), sum(len(x) - 1 for x in xs)) and math.isclose(start.sum(), len(xs))
        m = hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        after = m.likelihoods(xs).sum()
        assert after >= before - 1e-9
        before = after


def by_hand(docs):
    train = Counter(w for _, t, learn in docs if learn for w in [*hmm.tokens(t), None])
    n, v = sum(train.values()), len(train)
    return sorted(
        (i if i is not None else -1, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))
        for i, t, _ in docs for w in [[*hmm.tokens(t), None]]
    )


def found(df, train):
    got = hmm.score_texts(df, train).collect()
    assert all(r.score < 0 for r in got)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_base_scores(spark):
    docs = [(r[0], r[1], r[0] is not None and r[0] % 2 == 1) for r in rows()]
    assert found(odd(spark, "key", "train", "bucket"), F.pmod("doc_id", F.lit(2)) == 1) == by_hand(docs)


def test_without_training_rows(spark):
    docs = [(r[0], r[1], False) for r in rows()]
    assert found(odd(spark), F.lit(False)) == by_hand(docs)
    assert hmm.query(none(spark)).count() == 0


def test_probabilities_of_one_word_texts_sum_to_at_most_one(spark):
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "a", "c d", "a b"])], "doc_id long, text string")
    single = docs.unionByName(spark.createDataFrame([(9, ""), (10, "c"), (11, "d"), (12, "never")], docs.schema))
    got = {r.doc_id: 10**r.score for r in hmm.score_texts(single, F.col("doc_id") < 9).collect()}
    assert sum(got[i] for i in (0, 1, 9, 10, 11, 12)) <= 1


def test_frequent_words_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 40)
    monkeypatch.setattr(hmm, "SEED_DOCS", 30)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 30) % 500) for _ in range(3_300)]
    texts[0] = " ".join(["own"] * 2_500 + ["late"] * 2_500)  # common in one long text only
    want = sorted(Counter(w for t in texts for w in hmm.tokens(t)).items(), key=lambda x: (-x[1], x[0]))[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [hmm.frequent_words(docs.repartition(n)) for n in (2, 5)]
    assert found[0][:2] == found[1][:2] and (found[0][2] == found[1][2]).all() and found[0][0] == {w: k + 1 for k, (w, _) in enumerate(want)}
    assert b"late" in found[0][0] and len(found[0][1]) == 30


def test_seed_texts_count_whole(spark):
    docs = spark.createDataFrame([(i, "a b " * (3_000 if i == 3 else 15)) for i in (1, 2, 3, 3)] + [(4, "a short one")], "doc_id long, text string")
    frequent, hashes, times = hmm.frequent_words(docs)
    rows = docs.selectExpr("cast(doc_id as string) as doc_id", "text", "true as train").withColumn("h", hmm._seed_hash())
    hashes = hmm.frequent_words(rows)[1]
    schema = "kind int, doc_id string, train boolean, h long, key long, codes binary, bucket long, blob binary"
    counts = hmm.seed_counts(rows.repartition(3).mapInPandas(hmm._encoded(frequent, 4), schema).where("kind = 0"), hashes)
    assert times[frequent[b"b"]] == 15 + 15 + 3_000 + 3_000 and times[hmm.END] == 0
    assert sorted(counts[:, frequent[b"b"]].tolist()) == [15, 15, 3_000] and (counts[:, hmm.END] == 1).all()


def test_score_by_hand(spark):
    """The whole score again, from counts, classes and a forward recursion over plain numbers: without rounds, so that the
    model is the one that Baum-Welch would start from."""
    n_own = hmm.FREQUENT
    texts = [" ".join(f"w{k}" for k in range(9_000)) + " w7 w8999 w8999", "a b a c", "b b a d e", "a a f", "c d a b g h", "z a", "", "b y y x"]
    learn = [i for i in range(len(texts)) if i != 4 and i != 6]  # the first text has more words than have classes of their own
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.base_score, r.score) for r in hmm.score_texts(df, ~F.col("doc_id").isin(4, 6), rounds=0).collect()}
    split = [[*hmm.tokens(t), None] for t in texts]
    train = Counter(w for i in learn for w in split[i])
    best = sorted((w for w in train if w), key=lambda w: (-train[w], w))[:n_own]
    place = {w: k + 1 for k, w in enumerate(best)}
    divisor = sum(train.values()) + 0.1 * (len(train) + 1)

    def of(w):
        return 0 if w is None else place.get(w) or 1 + n_own + hmm.zlib.crc32(w[-2:]) % hmm.RARE

    counts, kinds = Counter(), Counter()
    for w, n in train.items():
        counts[of(w)] += n
        kinds[of(w)] += 1
    mass = np.array([(counts[k] + 0.1 * max(1, kinds[k]) + 0.1 * (k > n_own)) / divisor for k in range(1 + n_own + hmm.RARE)])
    m = hmm.initial(mass / mass.sum(), np.zeros((0, len(mass)), np.float32))
    for i, words in enumerate(split):
        weights, log = [m.start[s] * m.emit[of(words[0]), s] for s in range(hmm.STATES)], 0.0
        for w in words[1:]:
            log += math.log10(sum(weights))
            weights = [x / sum(weights) for x in weights]
            weights = [sum(weights[r] * m.move[r, s] for r in range(hmm.STATES)) * m.emit[of(w), s] for s in range(hmm.STATES)]
        share = [math.log10((train[w] + 0.1) / divisor / mass[of(w)]) for w in words]
        base = sum(math.log10((train[w] + 0.1) / divisor) for w in words)
        assert math.isclose(got[i][0], base, rel_tol=1e-9) and math.isclose(got[i][1], log + math.log10(sum(weights)) + sum(share), rel_tol=1e-9)
