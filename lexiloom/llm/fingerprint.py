"""Document fingerprints: improbable byte windows, in chained Bloom filters that are compared by their common bits."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import chunks, with_columns

WINDOW = 16  # bytes in a feature
NEAR, OFTEN = 32, 8  # a feature is the rarest of NEAR windows in a row, and so in OFTEN such rows at least
# Of a million windows of prose, how many have 0, 1, 2, ... pairs of equal bytes (see repetition). Windows with
# more pairs than the last are runs and rules rather than words, and are taken only where there is nothing else.
PROSE = (
    37, 1081, 7691, 24609, 51701, 86027, 112336, 124567, 130777, 115389, 92908, 76836, 47650, 38312, 24922, 18014, 10800, 10038, 7648, 5239, 2898,
    2277, 1004,
)
BITS, HASHES, FEATURES = 2048, 5, 160  # of one filter; the chain grows by a filter for each FEATURES features
ROWS_A_PART = 4_000
_M = np.uint64(0x9E3779B97F4A7C15)
_RANK = np.append(np.argsort(np.argsort(PROSE, kind="stable"), kind="stable"), len(PROSE)).astype(np.uint64)


def window_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of WINDOW bytes, built by doubling."""
    h, power, width = (b.astype(np.uint64) + np.uint64(1)) * _M, _M, 1
    while width < WINDOW:
        h = h[:-width] * power + h[width:]
        power = np.uint64(int(power) ** 2 % 2**64 | 1)
        width *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def repetition(b: np.ndarray) -> np.ndarray:
    """For each window, its pairs of equal bytes: sum of c (c - 1) / 2 over byte counts c. Collision entropy, the
    negative log of the chance that two of its bytes are equal, falls as this grows."""
    n = len(b) - WINDOW + 1
    out = np.zeros(n, np.int32)
    for d in range(1, WINDOW):
        run = np.concatenate((np.zeros(1, np.int32), np.cumsum(b[:-d] == b[d:], dtype=np.int32)))
        out += run[WINDOW - d : WINDOW - d + n] - run[:n]
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values (all if there are fewer)."""
    if len(x) <= width:
        return x.min(keepdims=True)
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def features(data: bytes) -> np.ndarray:
    """Hashes of the selected windows, in order of place. Each run of NEAR windows (shorter at the ends) has a rarest: the
    one whose collision entropy is the rarest by PROSE, be it high or low, among equals the one of the least hash. Windows
    that are so in OFTEN runs are selected. A text shorter than a window is one feature."""
    if not data:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    if len(b) < WINDOW:
        return window_hashes(np.concatenate((b, np.full(WINDOW - len(b), 255, np.uint8))))
    key = (_RANK[np.minimum(repetition(b), len(PROSE))] << np.uint64(40)) | (window_hashes(b) >> np.uint64(24))
    edge = np.full(NEAR - 1, np.iinfo(np.uint64).max, np.uint64)
    least = _sliding_min(np.concatenate((edge, key, edge)), NEAR)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    often = np.diff(np.append(starts, len(least))) >= OFTEN
    return least[starts[often]] * _M


def chain(found: np.ndarray) -> np.ndarray:
    """Bloom filters (rows of BITS / 64 words) of FEATURES features each, in order; the last may hold fewer."""
    n = -(-len(found) // FEATURES)
    bits = np.zeros(n * BITS, np.uint8)
    which = np.arange(len(found)) // FEATURES * BITS
    for k in range(HASHES):
        bits[which + ((found >> np.uint64(9 + 11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64).reshape(n, BITS // 64)


def to_string(filters: np.ndarray, n_features: int) -> str:
    return f"{n_features}:" + filters.tobytes().hex()


def _within(a: np.ndarray, b: np.ndarray) -> float:
    """Each filter of a is held against all of b: bits in common beyond what chance gives, over the most that there
    could be. The best of each counts, weighed by its bits."""
    of_b = np.bitwise_count(b).sum(axis=1).astype(np.float64)
    total = weight = 0.0
    for row in a:
        own = float(np.bitwise_count(row).sum())
        both = np.bitwise_count(b & row).sum(axis=1)
        chance = own * of_b / BITS
        best = ((both - chance) / np.maximum(np.minimum(own, of_b) - chance, 1e-9)).max()
        total += own * min(1.0, max(0.0, float(best)))
        weight += own
    return total / weight


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the shorter chain within the longer, or the mean of both ways if they are as long. Equal chains give 1,
    as do two empty ones, and an empty and a filled one give 0."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) == len(b):
        return _within(a, b) if len(a) == 1 else (_within(a, b) + _within(b, a)) / 2
    return _within(a, b) if len(a) < len(b) else _within(b, a)


def edited(text: str, after: str) -> str:
    """The last half (rounded down) of the code points gives way to as many first ones of the next text, or all."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds n_chars, fingerprint (count of features, then the filters in hex) to each row of docs (doc_id, text; other
    columns stay, n_chars and fingerprint are replaced). Null texts count as empty: no features. Whole texts are read,
    in bounded memory but for one text's own arrays. Equal texts have equal fingerprints, whatever the corpus."""

    def make():
        def run(texts):
            found = [features(t.encode("utf-8", "surrogatepass")) for t in texts]
            return [len(t) for t in texts], [to_string(chain(f), len(f)) for f in found]

        return run

    return with_columns(docs, {"n_chars": "long", "fingerprint": "string"}, make)


def beside_next(docs: DataFrame) -> DataFrame:
    """The result of query(): each row of docs (doc_id, text) beside the next in descending order of doc_id (null last;
    among equal ids by descending text), the first being next after the last.

    Ids alone give bounds of about ROWS_A_PART rows each; a part is sorted in one task of its own, and holds a second copy
    of the first row of the part after it. The driver gets two rows of ids a part. Rows of one id, null ones too, share a
    part. Null texts count as empty; a text's own arrays (some 50 bytes a character) are held for one text at a time.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"))
    n = ids.count()
    if not n:
        bounds: list[int] = []
    else:
        parts = max(1, min(100_000, n // ROWS_A_PART))
        bounds = sorted({int(x) for x in ids.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    edges = np.array(bounds, dtype=np.int64)
    given = spark.sparkContext.broadcast(edges)

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(len(given.value) - np.searchsorted(given.value, x.to_numpy(np.int64), side="right"), dtype="int32")

    firsts = ids.withColumn("part", part_of("id")).groupBy("part").agg(F.max("id").alias("id")).orderBy("part").toPandas()
    order, tops = firsts["part"].tolist(), firsts["id"].tolist()
    # A part's last row needs the first row of the part after it: those rows go to both.
    extra = spark.createDataFrame([(int(tops[(k + 1) % len(order)]), int(order[k])) for k in range(len(order))] or [(0, 0)], "top long, also int")
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"), "doc_id", "text").withColumn("part", part_of("id"))
    lead = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"), "text").join(F.broadcast(extra), F.col("id") == F.col("top"))
    lead = lead.groupBy("also").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    lead = lead.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("doc_id"), "text", F.col("also").alias("part"))
    dealt = rows.unionByName(lead).withColumn("text", F.coalesce("text", F.lit("")))
    dealt = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.desc_nulls_last("id"), F.desc("text"))
    # Ids go to Python as text, in which nulls don't turn the others into floating point numbers.
    dealt = dealt.select("part", F.col("id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(frames):
        held = None  # (part, doc_id, text, filters, count) of the row that waits for the next one
        for pdf in frames:
            for piece in chunks(pdf, 2_000_000):
                out = []
                for part, row_id, doc_id, text in zip(piece["part"], piece["id"], piece["doc_id"], piece["text"], strict=True):
                    found = features(text.encode("utf-8", "surrogatepass"))
                    own = chain(found)
                    if held and held[0] == part:
                        other = edited(held[2], text).encode("utf-8", "surrogatepass")
                        of_other = features(other)
                        filters = chain(of_other)
                        out.append((held[1], len(held[2]), hashlib.sha256(other).hexdigest(), to_string(held[3], held[4]), to_string(filters, len(of_other)), likeness(held[3], filters), likeness(held[3], own)))
                    held = None if row_id is None else (part, doc_id, text, own, len(found))
                frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                yield frame.astype({"n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    return dealt.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    return beside_next(docs.select("doc_id", "text"))
