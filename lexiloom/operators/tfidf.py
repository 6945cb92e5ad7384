"""Term and document frequencies, TF-IDF, the most characteristic words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.text import bucket


def term_frequencies(terms: DataFrame) -> DataFrame:
    """Adds tf: the word's share of its document's words. terms may have these as total already (see bow.text_terms)."""
    if "total" in terms.columns:
        return terms.withColumn("tf", F.col("cnt") / F.col("total"))
    return terms.withColumn("tf", F.col("cnt") / F.sum("cnt").over(W.partitionBy("doc_id")))


def inverse_frequencies(terms: DataFrame, n_docs: int) -> DataFrame:
    """word, df, idf = ln(floor(n_docs / df)), unsmoothed: 0 for words of more than half of the documents."""
    return terms.groupBy("word").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.expr(f"{n_docs}L div df").cast("double")))


def tfidf(terms: DataFrame, n_docs: int) -> DataFrame:
    """doc_id, word, cnt, tf, df, idf, tfidf."""
    # A task's share of the words is hashed; its share of the terms, which is far larger, needn't be sorted for the join.
    joined = term_frequencies(terms).join(inverse_frequencies(terms, n_docs).hint("shuffle_hash"), "word")
    return joined.select("doc_id", "word", "cnt", "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def top_words(scored: DataFrame, x: int = 10) -> DataFrame:
    """doc_id, rank (from 1), word, tfidf: each document's words of the highest scores over 0, ties in vocabulary order."""
    last = (bucket(F.col("word")) == 26).cast("int")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("tfidf"), last, "word"))
    return scored.where("tfidf > 0").withColumn("rank", rank).where(F.col("rank") <= x).select("doc_id", "rank", "word", "tfidf")


def dump(scored: DataFrame) -> DataFrame:
    """doc_id, bucket, word, cnt, tf, idf, tfidf in order of documents, buckets and words."""
    last = bucket(F.col("word")).cast("int")
    return scored.select("doc_id", last.alias("bucket"), "word", "cnt", "tf", "idf", "tfidf").orderBy("doc_id", "bucket", "word")
