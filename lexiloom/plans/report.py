"""What a run of the topic model worked on."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_info(terms: DataFrame, n_docs: int, method: str, topics: int, iterations: int, seed: int) -> DataFrame:
    """One row: method, seed, topics, iterations, n_docs, n_words, n_tokens. terms: doc_id, word, cnt."""
    sizes = terms.groupBy("word").agg(F.sum("cnt").alias("cnt")).agg(F.count("*").alias("n_words"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_tokens"))
    fixed = {"method": method, "seed": seed, "topics": topics, "iterations": iterations, "n_docs": n_docs}
    return sizes.select(*(F.lit(v).alias(c) for c, v in fixed.items()), "n_words", "n_tokens")


def dated(info: DataFrame) -> DataFrame:
    """Adds the day (like 05 Mar 2024) and the time of day at which the row is made."""
    now = F.current_timestamp()
    return info.withColumn("day", F.date_format(now, "dd MMM yyyy")).withColumn("time", F.date_format(now, "HH:mm:ss"))


def timed(step: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """What a step gives, and the seconds that computing all of it took."""
    began = time.perf_counter()
    made = step()
    made.write.format("noop").mode("overwrite").save()
    return made, time.perf_counter() - began
