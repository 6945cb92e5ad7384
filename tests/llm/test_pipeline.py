import random

import numpy as np

import corpus_pipeline as cp
from lexiloom.llm import decontaminate, ngram_join
from lexiloom.llm.common import materialise, table
from tests.llm.odd import none, odd
from tests.llm.test_decontaminate import passage_rows

DATA = "/root/testdata/sf0.001"


def test_each_stage_decides(spark):
    docs = table(spark, DATA, "documents")
    kept = [docs]
    for name, stage in cp.STAGES:
        kept.append(materialise(stage(spark, kept[-1], DATA), name))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and all(k.columns == docs.columns for k in kept[:-1])
    bad = {r.doc_id for r in table(spark, DATA, "labels").where("quality = 0").collect()}
    good = {r.doc_id for r in table(spark, DATA, "labels").where("quality = 1").collect()}
    assert len(ids[1] & bad) <= 0.1 * len(bad) and len(good - ids[1]) <= 0.05 * len(good) and len(ids[2]) == len(ids[1])
    classes = {r.doc_id: r.class_id for r in ngram_join.query(kept[2]).collect()}
    assert ids[3] == set(classes.values()) and kept[3].count() == len(ids[3])
    leaks = {r.doc_id for r in decontaminate.query(kept[3], table(spark, DATA, "benchmark")).collect() if r.contaminated}
    assert ids[4] == ids[3] - leaks and leaks
    run = cp.run(spark, DATA)
    assert sorted(map(repr, run.select("doc_id", "copy").collect())) == sorted(map(repr, kept[5].select("doc_id", "copy").collect()))


def test_odd_rows(spark):
    for name, stage in cp.STAGES:
        found = stage(spark, odd(spark), DATA).collect()
        assert len({r.doc_id for r in found}) >= 1, name
        assert stage(spark, none(spark), DATA).count() == 0, name
    kept = cp.near_duplicate_stage(spark, odd(spark), DATA).collect()
    assert sum(r.doc_id == 2 for r in kept) == 0 and sum(r.doc_id == 1 for r in kept) == 1
    assert [r.text for r in kept if r.doc_id is None] == [None]  # the other one's text is near that of row 1


def test_decontamination_learns_from_all_rows(spark, monkeypatch):
    """The stage's latent space is that of every row it is given, copies among them, not of some thousands."""
    monkeypatch.setattr(decontaminate, "RANK", 3)
    monkeypatch.setattr(decontaminate, "EXTRA", 20)  # as many vectors as words: no approximation
    rng = random.Random(10)
    words = [f"w{k}" for k in range(16)]
    texts = [" ".join(rng.choices(words, weights=[1 + (k + i // 1500) % 5 for k in range(16)], k=rng.randrange(4, 20))) for i in range(6500)]
    texts += texts[-500:]
    items = [" ".join(words[:9]), " ".join(words[7:])]
    own = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i // 2, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    seen, fit = [], decontaminate.latent_basis

    def watched(docs, vocab, idf, *rest):
        seen.append((vocab, idf, fit(docs, vocab, idf, *rest)))
        return seen[-1][2]

    monkeypatch.setattr(cp, "table", lambda *_: own)
    monkeypatch.setattr(decontaminate, "latent_basis", watched)
    cp.decontamination_stage(spark, docs, DATA)
    (vocab, idf, basis), = seen
    a = np.array(list(passage_rows(texts, vocab))) * idf
    b = np.array([np.bincount([vocab[w] for w in t.split()], minlength=16) * idf for t in items])
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    best = np.linalg.eigh(a.T @ a / (a * a).sum() + b.T @ b / (b * b).sum())[1][:, -3:]
    assert np.abs(basis @ basis.T - best @ best.T).max() < 1e-9
