"""Token counts through a cache: texts are encoded once for each digest of their content and the tokenizer's version."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from importlib import metadata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexiloom.llm.common import chunks, materialise, scratch_path

LIMIT = 512
# Characters on whose classes all Unicode versions agree; texts of these alone can take the faster of two equal encoders.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞]")


def version_of(path: str) -> str:
    """Digest of the tokenizer's file, and of its library's name and version: an upgrade finds no counts of the old one."""
    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{kind} {metadata.version(kind)}".encode() + b"\0" + f.read()).hexdigest()


class TokenCounter:
    """Counts the tokens of texts: .json by tokenizers, .model by sentencepiece, with no begin, end or added special
    tokens, no truncation and no padding; special strings in a text are what the library makes of them by default.

    ranks, for a byte-level BPE .json: the file with the same vocabulary as ranks, and the pattern its words are split
    by. Texts without special strings whose characters' classes are beyond doubt are then encoded by tiktoken, which
    gives the same tokens some five times faster.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.fast = self.special = None
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.slow = lambda text: len(own.encode(text))
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.slow = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = [line.split() for line in f]
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
            added = tokenizer.get_added_tokens_decoder().values()
            self.special = [t.content for t in added]

    def __call__(self, text: str) -> int:
        if self.fast is None or _OTHER.search(text) or any(s in text for s in self.special):
            return self.slow(text)
        return len(self.fast.encode_ordinary(text))


def token_counts(docs: DataFrame, path: str, cache: str | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of the whole text, null being empty, for each row of docs (doc_id, text; no
    other column is read, so clashing ones are no matter). Repeated rows, rows with null ids and rows of one id with
    different texts each have the counts of their own text. Very long texts are encoded whole, one at a time.

    cache is a folder that all executors share, kept from call to call: a Parquet table of version, digest and
    n_tokens. Digests are SHA-256 of the content, normalised by null becoming the empty text and by nothing else,
    since anything else could change a count. Only distinct texts that the cache lacks are encoded, each once, and
    appended. Without cache one is made for this call. A run that fails before its append leaves the cache as it was;
    rows that two runs append at once count once.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = version_of(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    own_digest = F.unhex(F.sha2(text, 256))
    keyed = materialise(docs.select("doc_id", own_digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    try:
        known = spark.read.schema("version string, digest binary, n_tokens long").parquet(cache).where(F.col("version") == version)
    except AnalysisException:  # no cache yet
        known = spark.createDataFrame([], "version string, digest binary, n_tokens long")
    misses = keyed.groupBy("digest").agg(F.min("doc_id").alias("of")).join(known.select("digest"), "digest", "left_anti")
    misses = materialise(misses, "misses")
    # Texts are dealt by id and digest to the misses, which are the small side that no task sorts or holds texts for.
    texts = docs.select("doc_id", text.alias("text"), own_digest.alias("own"))
    texts = texts.join(misses.hint("shuffle_hash"), (F.col("own") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("digest", "text")

    def encode(frames):
        counter, seen = TokenCounter(path, ranks, pattern), set()  # rows equal in id and text meet here, and one is encoded
        for pdf in frames:
            new = ~pdf["digest"].duplicated() & ~pdf["digest"].isin(seen)
            seen.update(pdf["digest"][new])
            for part in chunks(pdf[new]):
                yield pd.DataFrame({"digest": part["digest"], "n_tokens": [counter(t) for t in part["text"]]})

    counted = texts.mapInPandas(encode, "digest binary, n_tokens long").dropDuplicates(["digest"])
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    stored = spark.read.schema("version string, digest binary, n_tokens long").parquet(cache).where(F.col("version") == version)
    stored = materialise(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens")


def query(docs: DataFrame, folder) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document. folder: gives the place of a tokenizer's file."""
    from public_tokenizers import PATTERN

    found = token_counts(docs, folder("byte_bpe_50k.json"), ranks=folder("byte_bpe_50k.tiktoken"), pattern=PATTERN)
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
