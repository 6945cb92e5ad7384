"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINE = 10**15  # steps of a sampling hash: enough to draw thousands of rows from any number
_OWN_SCRATCH: list[str] = []
_WRITTEN: list[str] = []  # scratch paths of this process, in order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset (tests on one machine) a folder
    of this process is used; on any other master an unset folder is an error, since executors could not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="scratch-"))
        atexit.register(shutil.rmtree, _OWN_SCRATCH[0], True)
    return "file://" + _OWN_SCRATCH[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def scratch_mark() -> int:
    return len(_WRITTEN)


def release(spark: SparkSession, mark: int) -> None:
    """Deletes what this process has written as scratch since the mark, but for the last table. Only for those that know
    that nothing reads the others any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in _WRITTEN[mark:-1]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _WRITTEN[mark:-1]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: str, n: int):
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def bounded_rows(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the key, so that reruns agree. Only for fitting classifiers."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(FINE)) < FINE * most // n)


def sampled_texts(docs: DataFrame, most: int, seed: int) -> DataFrame:
    """doc_id, text of about ``most`` different rows of docs at most, chosen by a hash of both, so that reruns agree;
    copies of a row are one row, however many there are and even without an id."""
    rows, n = docs.select("doc_id", "text"), docs.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(FINE)) < FINE * most // n)
    return rows.dropDuplicates(["doc_id", "text"])


def sum_slices(parts: DataFrame, height: int, width: int, n_tasks: int) -> np.ndarray:
    """A height x width matrix, on the driver: the sum of those that tasks give in slices (slice: first row, sums: rows
    of doubles). Slices are added up in two steps, each of about the root of n_tasks parts, so that what one task
    receives grows with that root only."""
    fan = max(1, math.isqrt(n_tasks))

    def meet(key, pdf):
        return pd.DataFrame({"slice": [key[0]], "sums": [sum(np.frombuffer(b) for b in pdf["sums"]).tobytes()]})

    if fan > 1:
        some = parts.withColumn("part", F.spark_partition_id() % fan).groupBy("slice", "part")
        parts = some.applyInPandas(meet, "slice long, sums binary")
    out = np.zeros((height, width))
    for r in parts.groupBy("slice").applyInPandas(meet, "slice long, sums binary").toLocalIterator():
        rows = np.frombuffer(r["sums"]).reshape(-1, width)
        out[r["slice"] : r["slice"] + len(rows)] = rows
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn, most: int, seed: int, longest: int) -> list:
    """(doc_id, text, label) of a bounded sample of labelled documents, sorted by a hash of the id.

    docs: doc_id, text. labels: doc_id and the label column (0/1; other values and nulls are left out; of several
    labels of a document the largest counts). learn: condition on doc_id. Each class gives about ``most`` rows at
    most, in proportion; texts over ``longest`` code points aren't learned from, so the driver gets
    2 * most * longest code points at the very most.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    parts = [bounded_rows(chosen.where(F.col("y") == y), "doc_id", most, seed) for y in (0, 1)]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # at most about 2 * most ids
    found = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text").join(ids, "doc_id")
    rows = [(int(r[0]), r[1], int(r[2])) for r in found.toPandas().itertuples(index=False)]
    mix = np.array([r[0] for r in rows], dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    order = sorted(range(len(rows)), key=lambda i: (int(mix[i]), rows[i][0], rows[i][1]))
    return [rows[i] for i in order]


def chunks(pdf, chars: int = 4_000_000):
    """Slices of a frame whose texts hold about so many code points, one row at least: bounds an operator's arrays."""
    lengths = pdf["text"].str.len().fillna(0).to_numpy()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > chars:
            yield pdf.iloc[start:i]
            start, total = i, 0
        total += n
    if start < len(pdf):
        yield pdf.iloc[start:]


def with_columns(docs: DataFrame, types: dict[str, str], make, chars: int = 4_000_000, keep_text: bool = True) -> DataFrame:
    """docs with columns computed from the column text; every other column passes through as it is.

    make() gives, in each task, a function from a list of texts (null: empty) to one list or array for each of the new
    columns. Arrow batches are cut so that a call gets about ``chars`` code points, one text at least. Without keep_text the texts don't come back.
    """
    kept = docs.drop(*types)
    schema = kept.drop(*([] if keep_text else ["text"])).select("*", *(F.lit(None).cast(t).alias(c) for c, t in types.items())).schema

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        compute, arrow = make(), to_arrow_schema(schema)
        fields = [arrow.field(i) for i in range(len(arrow) - len(types), len(arrow))]
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at)
            batch = batch if keep_text else batch.drop_columns(["text"])
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            start = total = 0
            ends = []
            for i, n in enumerate(lengths):
                if i > start and total + n > chars:
                    ends.append(i)
                    start, total = i, 0
                total += n
            start = 0
            for end in [*ends, len(lengths)]:
                if end > start:
                    part = batch.slice(start, end - start)
                    found = compute([t or "" for t in texts.slice(start, end - start).to_pylist()])
                    new = [pa.array(x, type=f.type) for x, f in zip(found, fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *types])
                start = end

    return kept.mapInArrow(run, schema)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
