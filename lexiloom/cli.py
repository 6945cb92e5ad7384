"""Command line: python -m lexiloom.cli tfidf|lda|licence|svd ..."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.store import kept
from lexiloom.operators import bow, lda, linalg, tfidf
from lexiloom.plans import report
from lexiloom.sources import corpus


def _positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def _not_negative(text: str) -> int:
    if (n := int(text)) < 0:
        raise argparse.ArgumentTypeError("must be 0 or more")
    return n


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexiloom")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("tfidf", "lda", "licence"):
        one = commands.add_parser(name)
        one.add_argument("-d", dest="folder", required=True, help="folder of text files")
        one.add_argument("-m", dest="most", type=_not_negative, default=0, help="files at most; 0: all")
        if name != "licence":
            one.add_argument("-g", dest="gutenberg", action="store_true", help="cut texts to what stands between start and end markers")
            one.add_argument("-w", dest="stop", help="stop file")
            one.add_argument("-x", dest="top", type=_positive, default=10, help="words that are shown")
        if name == "lda":
            one.add_argument("-D", dest="dictionary", help="file of the words that count")
            one.add_argument("-i", dest="iterations", type=_not_negative, default=100)
            one.add_argument("-t", dest="topics", type=_positive, default=10)
            one.add_argument("-s", dest="seed", type=int, default=1)
            one.add_argument("-M", dest="mode", choices=("serial", "ad", "block", "bundles"), default="block")
            one.add_argument("-p", dest="show", action="store_true", help="show the topics' words")
    one = commands.add_parser("svd")
    one.add_argument("-f", dest="file", help="matrix file; without one a random matrix is made")
    one.add_argument("-n", dest="rows", type=_positive, default=4)
    one.add_argument("-k", dest="columns", type=_positive, default=4)
    one.add_argument("-s", dest="seed", type=int, default=1)
    one.add_argument("-e", dest="check", action="store_true", help="check that the product is the matrix")
    return out


def _list(spark: SparkSession, path: str | None, gutenberg: bool) -> DataFrame | None:
    if path is None:
        return None
    return corpus.word_list(spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("doc_id"), F.col("value").alias("text")), gutenberg)


def run(spark: SparkSession, given: Sequence[str]) -> list[DataFrame]:
    """What the command gives, as DataFrames to show, in order."""
    a = parser().parse_args(given)
    if a.command == "svd":
        matrix = corpus.read_matrix(spark, a.file) if a.file else corpus.random_matrix(spark, a.rows, a.columns, a.seed)
        return [linalg.singular_values(matrix)] + ([linalg.reconstruction_error(matrix)] if a.check else [])
    docs = corpus.read_folder(spark, a.folder, a.most)
    if a.command == "licence":
        scanned = corpus.licence_scan(docs).join(docs.select("doc_id", "name"), "doc_id").select("name", "score", "pass")
        return [scanned, corpus.licence_summary(docs)]
    texts = kept(corpus.row_range(docs, a.gutenberg).select("doc_id", "name", F.col("body").alias("text")), "texts")
    stop = _list(spark, a.stop, a.gutenberg)
    if a.command == "tfidf":
        terms, _ = corpus.ingest(texts, stop=stop)
        best = tfidf.top_words(tfidf.tfidf(terms, texts.count()), a.top)
        return [best.join(corpus.titles(docs, F.col("name")), "doc_id").select("doc_id", "title", "rank", "word", "tfidf").orderBy("doc_id", "rank")]
    listed = _list(spark, a.dictionary, False)
    terms, vocab = corpus.ingest(texts, "parallel" if listed is None else "dictionary", stop, listed)
    vocab = kept(vocab, "vocab")
    matrix = kept(bow.doc_matrix(terms, vocab), "matrix")
    state = lda.fit(matrix, max(1, vocab.count()), a.topics, a.iterations, a.seed, a.mode)
    info = report.dated(report.run_info(terms, texts.count(), a.mode, a.topics, a.iterations, a.seed))
    return [info] + ([lda.top_words(lda.phi(state, vocab, a.topics), vocab, a.top)] if a.show else [])


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    for made in run(spark, sys.argv[1:]):
        _, seconds = report.timed(lambda made=made: made)
        made.show(1_000, truncate=False)
        print(f"{seconds:.2f} s")


if __name__ == "__main__":
    main()
