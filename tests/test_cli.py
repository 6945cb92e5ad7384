import pytest

from lexiloom import cli


@pytest.fixture
def folder(tmp_path):
    for name, text in (("a.txt", "Title: First\none two two the"), ("b.txt", "three four four the"), ("c.txt", "five six the")):
        (tmp_path / name).write_text(text)
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "stop").write_text("the\n")
    return tmp_path


def test_tfidf(spark, folder):
    (best,) = cli.run(spark, ["tfidf", "-d", f"{folder}/*.txt", "-x", "1", "-w", str(folder / "lists" / "stop")])
    assert [(r.title, r.word) for r in best.collect()] == [("First", "two"), ("b.txt", "four"), ("c.txt", "five")]


def test_lda(spark, folder):
    info, topics = cli.run(spark, ["lda", "-d", f"{folder}/*.txt", "-m", "2", "-i", "1", "-t", "2", "-s", "7", "-p"])
    row = info.first()
    assert (row.method, row.seed, row.topics, row.iterations, row.n_docs) == ("block", 7, 2, 1, 2) and topics.count() >= 0
    (info,) = cli.run(spark, ["lda", "-d", f"{folder}/*.txt", "-i", "0", "-D", str(folder / "lists" / "stop")])
    assert info.first().n_words == 1


def test_others(spark, folder):
    scanned, summary = cli.run(spark, ["licence", "-d", f"{folder}/*.txt"])
    assert scanned.count() == 3 and tuple(summary.first()) == (3, 0)
    sigma, check = cli.run(spark, ["svd", "-n", "5", "-k", "3", "-e"])
    assert sigma.count() == 3 and check.first().errors == 0


def test_arguments_are_checked():
    for bad in (["lda", "-d", "x", "-t", "0"], ["lda", "-d", "x", "-i", "-1"], ["tfidf"], ["lda", "-d", "x", "-M", "other"], ["tfidf", "-d", "x", "-m", "-2"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
