import pytest
from pyspark.errors import AnalysisException

from lexiloom.operators import bow
from lexiloom.plans.fixtures import DOCUMENTS
from lexiloom.sources import corpus
from lexiloom.streaming import word_counts
from pyspark.sql import functions as F


def docs(spark):
    return spark.createDataFrame(list(DOCUMENTS.items()), "doc_id long, text string")


def test_row_ranges(spark):
    got = {r.doc_id: (r["mode"], r.body) for r in corpus.row_range(docs(spark), True).collect()}
    assert got[-1] == ("gutenberg", "body one\nbody two") and got[-2] == ("header", "four\nfive") and got[-3] == ("gutenberg", "HOLDER") and got[-5] == ("gutenberg", "e f")
    assert {r.doc_id: r["mode"] for r in corpus.row_range(docs(spark)).collect()}[-1] == "whole"


def test_titles(spark):
    got = {r.doc_id: r.title for r in corpus.titles(docs(spark), F.lit("none")).collect()}
    assert (got[-1], got[-4], got[-3]) == ("A Book", "Second", "none")


def test_licences(spark):
    got = {r.doc_id: r.score for r in corpus.licence_scan(docs(spark)).collect()}
    assert [got[-10 - k] for k in range(8)] == [3] * 8
    assert [got[-20 - k] for k in range(8)] == [2, 1, 1, 1, 1, 1, 1, 1] and got[-1] == 0


def test_folder(spark, tmp_path):
    for name in ("b.txt", "a.txt", ".hidden"):
        (tmp_path / name).write_text(f"in {name}\nx")
    rows = corpus.read_folder(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.name) for r in rows] == [(0, "a.txt"), (1, "b.txt")] and rows[0].text == "in a.txt\nx"
    assert corpus.read_folder(spark, str(tmp_path), 1).count() == 1
    assert corpus.count_files(spark, str(tmp_path)) == 2 and corpus.count_files(spark, str(tmp_path), 1) == 1
    with pytest.raises(AnalysisException):
        corpus.count_files(spark, str(tmp_path / "absent"))


def test_made_up_corpus_as_files(spark, tmp_path):
    corpus.write_corpus(corpus.topic_corpus(spark, n_docs=2, n_words=20), str(tmp_path / "made"))
    files = sorted((tmp_path / "made").glob("doc_id=*/part-*"))
    texts = [f.read_text() for f in files]
    assert len(texts) == 2 and all(t.startswith("\n\n\n") and len(t.split()) == 20 for t in texts)


def test_timed(spark):
    from lexiloom.plans import report

    made, seconds = report.timed(lambda: spark.range(10))
    assert made.count() == 10 and seconds > 0


def test_stream(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    word_counts.follow(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = word_counts.document_frequencies(spark.read.parquet(str(tmp_path / "out")))
    assert {(r.word, r.df, r.occ) for r in got.collect()} == {("a", 1, 2), ("b", 2, 2)}
    assert bow.vocabulary(spark.read.parquet(str(tmp_path / "out"))).count() == 2


def test_run_info(spark):
    from lexiloom.plans import report

    terms = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (2, "b", 4)], "doc_id long, word string, cnt long")
    row = report.dated(report.run_info(terms, 3, "serial", 10, 100, 5)).first()
    assert (row.n_docs, row.n_words, row.n_tokens, row.method) == (3, 2, 7, "serial") and len(row["day"]) == 11 and len(row["time"]) == 8
