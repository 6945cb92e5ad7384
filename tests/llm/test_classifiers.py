import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import langid, quality, toxicity
from lexiloom.llm.common import labelled_texts
from tests.llm.odd import none, odd, rows

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    q = f"SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM '{DATA}/documents.parquet' d LEFT JOIN '{DATA}/labels.parquet' l USING (doc_id) ORDER BY doc_id"
    return duckdb.sql(q).fetchall()


def part(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 1), (8, 0, 0), (8, 0, 0), (9, 0, None), (None, 1, 1), (99, 1, 1), (2, None, 1), (10, 7, 9)], "doc_id long, quality int, toxic int")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_quality_held_out(tables):
    learn = [(i, t, y) for i, t, _, y, _ in tables if y is not None and part(i, 3) != 1]
    weights, bias = quality.fit(learn)
    held = [(t, y) for i, t, _, y, _ in tables if y is not None and part(i, 3) == 1]
    hashes, ends = quality.NGramHasher()([t for t, _ in held])
    z = [weights[hashes[a:b]].sum() / max(1, b - a) ** 0.5 + bias for a, b in zip([0, *ends[:-1]], ends)]
    assert np.mean([(v >= 0) == y for v, (_, y) in zip(z, held)]) > 0.95


def test_toxicity_held_out(tables):
    learn = [(i, t, y) for i, t, _, _, y in tables if y is not None and part(i, 5)]
    model = toxicity.fit(learn)
    held = [(t, y) for i, t, _, _, y in tables if y is not None and not part(i, 5)]
    score = toxicity.score_texts(model, toxicity.Words(model["row_of"], model["vectors"]), [t for t, _ in held])
    assert np.mean([(s >= 0.5) == y for s, (_, y) in zip(score, held)]) > 0.9


def test_threshold_lies_in_the_gap():
    assert toxicity._threshold(np.array([-3.0] * 9 + [1.0] * 9), np.array([0] * 9 + [1] * 9)) == -1
    assert toxicity._threshold(np.array([1.0]), np.array([1])) is None


def test_language_held_out(tables):
    model = langid.fit([(t, lang) for i, t, lang, _, _ in tables if part(i, 4) != 2])
    held = [(t, lang) for i, t, lang, _, _ in tables if part(i, 4) == 2]
    found = langid.predict(model, [t for t, _ in held])
    assert np.mean([f == lang for f, (_, lang) in zip(found[0], held)]) > 0.97 and (found[1] >= 0).all() and (found[1] <= 1).all()


def test_families():
    assert langid.family_of("de") == langid.family_of("en-GB") == "germanic" and langid.family_of("es") == "romance" and langid.family_of("qq") == "qq"


def test_ftrl_learns_and_stays_sparse():
    rows_ = [(i, "good plain words here" if i % 2 else "BAD!! BAD!! ###", i % 2) for i in range(200)]
    weights, _ = quality.fit(rows_)
    assert 0 < (weights != 0).sum() < 200


def check(found, n_rows, *columns):
    assert len(found) == n_rows and all(0 <= r["score"] <= 1 for r in found)
    same = [tuple(r[c] for c in columns) for r in found if r["doc_id"] == 2]
    assert len(same) == 2 and same[0] == same[1]


def test_odd_quality(spark):
    found = quality.quality_scores(odd(spark, "score", "predicted", "y"), labels(spark)).collect()
    check(found, len(rows()), "score", "predicted")
    assert all(r["y"] == "theirs" and r["predicted"] == int(r["score"] >= 0.5) for r in found) and any(r["doc_id"] == 2**60 + 1 for r in found)
    assert {r["score"] for r in quality.quality_scores(odd(spark), no_labels(spark)).collect()} == {0.5}
    assert quality.query(none(spark), no_labels(spark)).count() == 0
    assert len(quality.query(odd(spark), labels(spark)).collect()) == len(rows())


def test_odd_toxicity(spark):
    found = toxicity.toxicity_scores(odd(spark, "score", "predicted"), labels(spark)).collect()
    check(found, len(rows()), "score", "predicted")
    assert len({r["score"] for r in found if r["text"] in (None, "")}) == 1
    assert toxicity.query(none(spark), no_labels(spark)).count() == 0
    assert len(toxicity.query(odd(spark), no_labels(spark)).collect()) == len(rows())


def test_odd_languages(spark):
    found = langid.languages(odd(spark, "lang_pred", "score")).collect()
    check(found, len(rows()), "score", "lang_pred")
    by_text = {r["text"]: r for r in found}
    for text in (None, "", " \n\t ", "!!! 123 ..."):
        assert by_text[text]["lang_pred"] == "und" and by_text[text]["score"] == 0
    assert {r["lang_pred"] for r in found} <= {"en", "de", "und"}
    assert langid.query(none(spark)).count() == 0
    unknown = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.languages(unknown).collect()} == {"und"}


def test_training_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    own = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = labelled_texts(docs, own, "quality", own.doc_id >= 0, 100, 1, 1000)
    assert 100 < len(got) < 300 and got == labelled_texts(docs.repartition(7), own, "quality", own.doc_id >= 0, 100, 1, 1000)


TEXTS = ["", "a", "Eins zwei DREI!! vier?", "the quick brown fox 42 jumps; the QUICK fox", "é ü 漢字 ok... \u1e9e", "der schnelle fuchs und die katze", "x " * 300]


def test_quality_score_by_hand():
    """Each n-gram of a text by itself, in whole numbers."""
    weights, bias = quality.fit([(i, t * (1 + i % 3), i % 2) for i, t in enumerate(TEXTS * 6)])
    hashes, ends = quality.NGramHasher()(TEXTS)
    word_hash, shape_hash = quality.xxhash.xxh64_intdigest, lambda w: quality.xxhash.xxh64_intdigest(quality._shape(w), seed=1)
    p1, p2, p3, top = int(quality._P1), int(quality._P2), int(quality._P3), 2**64
    for text, low, high in zip(TEXTS, [0, *ends[:-1]], ends, strict=True):
        words, want = quality.WORD.findall(text), []
        for i, w in enumerate(words):
            before, shape = word_hash(words[i - 1]) if i else 0, shape_hash(w)
            pair = ((shape_hash(words[i - 1]) if i else 0) * p2 + shape) % top
            last = ((shape_hash(words[i - 2]) if i > 1 else 0) * p2 + shape_hash(words[i - 1])) % top if i else 0
            triple = (last * p3 + shape) % top
            want += [(x * p1 % top) >> (64 - quality.BITS) for x in (word_hash(w), (before * p2 + word_hash(w)) % top, pair ^ p2, triple ^ p3)]
        assert hashes[low:high].tolist() == want
        mean = sum(float(weights[k]) for k in want) / max(1, len(want)) ** 0.5
        assert abs(quality._segments(weights[hashes], ends)[TEXTS.index(text)] / max(1, high - low) ** 0.5 - mean) < 1e-6


def test_language_by_hand():
    """Family by all duels, then the language within it, from margins that are added up gram by gram."""
    samples = [(f"{t} {k}", lang) for k in range(20) for t, lang in (("the fox and the dog", "en"), ("der fuchs und die katze", "de"), ("el zorro y los perros", "es"), ("le renard et les chiens", "fr"))]
    model, texts = langid.fit(samples), ["the dogs", "die hunde und", "los gatos", "les chats et", "123", "", "der zorro"]
    x, has = langid.gram_counts(texts)
    got, score = langid.predict(model, texts)
    for i, text in enumerate(texts):
        def winner(group, row=x[i]):
            votes = {}
            for k, (g, p, q) in enumerate(model["pairs"]):
                if g == group:
                    m = sum(float(v) * float(model["weights"][at, k]) for at, v in enumerate(row) if v)
                    for name, margin in ((p, m), (q, -m)):
                        old = votes.get(name, (0, 0.0))
                        votes[name] = (old[0] + (margin > 0), old[1] + margin)
            return max(model["groups"][group], key=lambda n: votes.get(n, (0, 0.0)))
        assert has[i] == any(map(str.isalpha, text))
        assert got[i] == (winner(winner("")) if has[i] else "und") and 0 <= score[i] <= 1
    naive = {}
    low = "ab, c"  # every run of one to three letters, with the edges of words as one sign
    for n in (1, 2, 3):
        naive[n] = len(low)
    row, _ = langid.gram_counts([low])
    assert abs((row**2).sum() - 1) < 1e-5


def test_toxicity_score_by_hand():
    """Windows of each text one by one: the largest value of each filter, then the sum."""
    rows_ = [(i, ("bad awful words here " if i % 2 else "a fine and good day ") * (1 + i % 3) + f"n{i}", i % 2) for i in range(80)]
    model = toxicity.fit(rows_)
    texts = ["a fine day", "awful bad words", "", "unknown", "bad"]
    words = toxicity.Words(model["row_of"], model["vectors"])
    got = toxicity.score_texts(model, words, texts)
    for text, s in zip(texts, got, strict=True):
        vectors = [np.zeros(toxicity.DIM)] * 2
        for w in toxicity.WORD.findall(text.lower()):
            vectors.append(sum(model["vectors"][model["row_of"].get(b, 0)].astype(float) for b in toxicity.buckets(w) if b >= 0))
        vectors += [np.zeros(toxicity.DIM)] * 2
        top = [max(sum(vectors[at + j] @ model["w"][k][j][:, f] for j in range(width)) for at in range(len(vectors) - 2)) for k, width in enumerate(toxicity.WIDTHS) for f in range(toxicity.FILTERS)]
        z = np.maximum(np.array(top) + model["b"], 0) @ model["out"] + model["bias"] - model["cut"].get("und", model["cut_of_others"])
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-4


def test_thresholds_follow_predicted_languages():
    rows_ = []
    for i in range(240):
        base, toxic = ("the dog and the fox run " if i // 3 % 2 else "der hund und die katze laufen ") * 2, i * 7 % 11 > 5
        rows_.append((i, base + ("grim vile " if toxic else "calm kind "), int(toxic)))
    known = langid.fit([(t, "en" if i // 3 % 2 else "de") for i, t, _ in rows_])
    model = toxicity.fit(rows_, known)
    assert set(model["cut"]) == {"en", "de"} and toxicity.text_langs(model, ["the dog and the fox", "der hund und die katze"]) == ["en", "de"]
