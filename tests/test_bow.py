import math
import random
from collections import Counter

import pytest

from lexiloom.operators import bow, layout, tfidf
from lexiloom.sources import corpus

DOCS = [(1, "b a b\nc 9"), (2, "a a d"), (3, "a b"), (4, None), (5, "")]


def terms(spark):
    return bow.doc_terms(bow.tokens(spark.createDataFrame(DOCS, "doc_id long, text string")))


def test_counts(spark):
    got = {(r.doc_id, r.word): r.cnt for r in terms(spark).collect()}
    assert got == {(i, w): n for i, t in DOCS if t for w, n in Counter(t.split()).items()}
    assert {(r.doc_id, r.unique_words, r.total_words) for r in bow.doc_totals(terms(spark)).collect()} == {(1, 4, 5), (2, 2, 3), (3, 2, 2), (None, 8, 10)}


def test_vocabulary_puts_digits_last(spark):
    rows = bow.vocabulary(terms(spark)).orderBy("word_idx").collect()
    assert [(r.word_idx, r.word, r.df) for r in rows] == [(0, "a", 3), (1, "b", 2), (2, "c", 1), (3, "d", 1), (4, "9", 1)]


def test_inverted_index(spark):
    t = terms(spark)
    index = {r.word_idx: (r.occ, r.df, r.postings) for r in bow.inverted_index(bow.doc_matrix(t, bow.vocabulary(t))).collect()}
    assert index[0] == (4, 3, {1: 0, 2: 0, 3: 0}) and index[4] == (1, 1, {1: 3})


def test_tfidf(spark):
    got = {(r.doc_id, r.word): r.tfidf for r in tfidf.tfidf(terms(spark), 5).collect()}
    assert math.isclose(got[1, "c"], math.log(5) / 5) and math.isclose(got[1, "b"], 0.4 * math.log(2)) and got[1, "a"] == 0
    top = tfidf.top_words(tfidf.tfidf(terms(spark), 5), 1).collect()
    assert {(r.doc_id, r.word) for r in top} == {(1, "c"), (2, "d"), (3, "b")}


def test_filters(spark):
    words = bow.tokens(spark.createDataFrame(DOCS, "doc_id long, text string"))
    some = spark.createDataFrame([("a",), ("b",)], "word string")
    assert {r.word for r in bow.without(words, some).collect()} == {"c", "d", "9"}
    assert bow.only(words, some).count() == 7


def test_roles():
    assert layout.roles(10, 0.6, 100) == (4, 6) and layout.roles(2, 0.6, 100) == (1, 1) and layout.roles(10, 0.01, 100) == (9, 1) and layout.roles(10, 0.2, 3) == (3, 7)


def test_bundles_against_a_loop(spark):
    """Each worker's words by owner: the most frequent one left and the least frequent ones left, until none is left."""
    rows = [(r, w, (w * 7 + r) % 11, w % 2) for r in range(3) for w in range(23 + r) if (w + r) % 5]
    df = spark.createDataFrame(rows, "prank int, word_idx int, occ long, pw int")
    for b in (1, 3, 8):
        want = []
        for r in range(3):
            made = []
            for pw in range(2):
                left = [w for _, w in sorted((o, w) for p, w, o, q in rows if (p, q) == (r, pw))]
                while left:
                    first = [left.pop()] + [left.pop(0) for _ in range(min(b - 1, len(left)))]
                    made.append((first + [-1] * (b - len(first)), pw))
            for n, (own, pw) in enumerate(sorted(made)):
                want += [(r, n, slot, w, pw) for slot, w in enumerate(own)]
        bundles = layout.word_bundles(df, b)
        assert sorted(tuple(x) for x in bundles.collect()) == sorted(want)
        heads = {r: [w for p, _, slot, w, _ in sorted(want) if p == r and slot == 0] for r in range(3)}
        start = {r: next((i for i, w in enumerate(h) if w >= r * (25 // 3)), len(h) - 1) for r, h in heads.items()}
        assert {x.prank: x.bundle for x in layout.queue_start(bundles, 25, 3).collect()} == start


def test_ingest_and_lists(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    listed = spark.createDataFrame([("a",), ("zebra",), ("b",)], "word string")
    stop = corpus.word_list(spark.createDataFrame([(1, "x\n4\n5\nb\na")], "doc_id long, text string"))
    assert [r.word for r in stop.collect()] == ["b"]
    terms, vocab = corpus.ingest(docs, "dictionary", stop, listed)
    assert [(r.word_idx, r.word, r.df, r.occ) for r in vocab.orderBy("word_idx").collect()] == [(0, "a", 3, 4), (1, "zebra", 0, 0)] and terms.count() == 3
    assert [sorted(map(tuple, corpus.ingest(docs, m)[0].collect())) for m in ("serial", "parallel")] == [sorted(map(tuple, bow.doc_terms(bow.tokens(docs)).collect()))] * 2
    for bad in ({"mode": "other"}, {"mode": "dictionary"}, {"dictionary": listed}):
        with pytest.raises(ValueError):
            corpus.ingest(docs, **bad)
    assert [r.doc_id for r in corpus.document_slice(docs, 1, 2).collect()] == [2, 3]


def test_no_way_of_ingesting_has_one_task_read_all(spark):
    docs = spark.createDataFrame([(i, f"w{i} a") for i in range(40)], "doc_id long, text string").repartition(4)
    for mode in ("serial", "parallel"):
        terms, _ = corpus.ingest(docs, mode)
        assert len(terms.inputFiles()) == 4 and terms.count() == 80


def test_terms_of_texts(spark):
    """Counted where texts are, odd ones too: the same as of the tokens; ids that repeat are merged."""
    rng = random.Random(1)
    some = list("aBz9Z'~\t\r\n  ,.!?\"-_:;(){}éüñ’“語🙂İſK\u2003\x00\x85")
    docs = [(i % 390, "".join(rng.choice(some) for _ in range(rng.randrange(120)))) for i in range(400)] + [(None, "a b"), (None, "a"), (7, None)]
    for rows in (docs, docs[:390]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want, got = (sorted(map(repr, x.collect())) for x in (bow.doc_terms(bow.tokens(df)), bow.text_terms(df)))
        assert got == want
        whole, vocab = bow.text_terms(df, places=True), bow.vocabulary(bow.text_terms(df))
        slots = {(r.doc_id, r.word): r.slot for r in bow.doc_matrix(bow.text_terms(df), vocab).join(vocab.select("word", "word_idx"), "word_idx").collect()}
        totals = {r.doc_id: r.total_words for r in bow.doc_totals(bow.text_terms(df)).collect() if r.doc_id is not None} | {None: 3}
        assert all(r.slot == slots[r.doc_id, r.word] and r.total == totals[r.doc_id] for r in whole.collect())


def test_index_matrix_by_hand(spark):
    """Wide rows are made of runs of -1, not slot by slot."""
    blocks = spark.createDataFrame([(d, d // 10) for d in range(20)], "doc_id long, proc int")
    cells = [(d, w, (d * 3 + w) % 7, 1 + d % 2) for d in range(20) for w in range(6) if (d * w) % 4 == 1 or (w == 5 and d in (0, 9, 10))]
    got = bow.index_matrix(spark.createDataFrame(cells, "doc_id long, word_idx int, slot int, cnt long"), blocks)
    want = {}
    for d, w, slot, cnt in cells:
        row = want.setdefault((d // 10, w), [0, ["-1"] * 10])
        row[0] += cnt
        row[1][d % 10] = str(slot)
    assert {(r.prank, r.word_idx): [r.occ, r.slots.split(",")] for r in got.collect()} == want
    assert "sequence" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "repeat(-1," in plan


def test_blocks_of_terms(spark):
    """Blocks are told by their ends, without an exchange; by a join where an id is there twice."""
    terms = spark.createDataFrame([(d, f"w{d % 3}", 1) for d in range(11)], "doc_id long, word string, cnt long")
    for ids in (list(range(11)), [*range(11), 3]):
        blocks = layout.doc_blocks(spark.createDataFrame([(i,) for i in ids], "doc_id long"), 4).cache()
        got = layout.with_block(terms, blocks)
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (len(ids) > 11)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, terms.join(blocks, "doc_id").collect()))
