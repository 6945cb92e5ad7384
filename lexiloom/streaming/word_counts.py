"""Word counts of a growing corpus: new documents' counts are appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import bow


def follow(new_docs: DataFrame, table: str, checkpoint: str):
    """Starts a query over a stream of doc_id, text that writes each batch's doc_terms under its own folder of table.

    A batch that is run again after a failure replaces its folder, so that no document counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        bow.doc_terms(bow.tokens(batch)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return new_docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_frequencies(terms: DataFrame) -> DataFrame:
    """word, df, occ over all batches so far."""
    return terms.groupBy("word").agg(F.countDistinct("doc_id").alias("df"), F.sum("cnt").alias("occ"))
