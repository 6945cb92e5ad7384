"""Topic models by collapsed Gibbs sampling."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.store import kept
from lexiloom.functions.text import hash_int
from lexiloom.operators import bow

ALPHA = GAMMA = 1.0
MOST_DRAWN = 500_000  # occurrences that are held at once, besides those of the last batch
PART_TOKENS = 2_000_000  # of a part of the state, about, so that a part's memory doesn't grow with the corpus


def initial_topics(matrix: DataFrame, k: int, *by: str) -> DataFrame:
    """Adds z, a topic for each occurrence, from an md5 of the columns ``by`` and the occurrence's number (from 1)."""
    return matrix.withColumn("z", F.transform(F.sequence(F.lit(1), F.col("cnt").cast("int")), lambda i: hash_int(k, *(F.col(c) for c in by), i)))


def topic_counts(state: DataFrame, by: str | None, k: int) -> DataFrame:
    """(by, n) with n an array of k counts: how often each topic stands in z. Without ``by``, of everything."""

    def count(t: int) -> Column:
        return F.sum(F.size(F.filter("z", lambda x: x == t)))

    sums = F.array(*map(count, range(k))).alias("n")
    return state.groupBy(by).agg(sums) if by else state.agg(sums)


def long_counts(state: DataFrame, *by: str) -> DataFrame:
    """(by..., k, n) without zeros."""
    return state.select(*by, F.explode("z").alias("k")).groupBy(*by, "k").agg(F.count("*").alias("n"))


def phi(state: DataFrame, vocab: DataFrame, k: int, gamma: float = GAMMA) -> DataFrame:
    """word_idx, k, n, phi = (n + gamma) / (n_k + V gamma) for every word and topic, zeros included."""
    return phi_of(topic_counts(state, "word_idx", k), vocab, k, gamma)


def phi_of(counts: DataFrame, vocab: DataFrame, k: int, gamma: float = GAMMA) -> DataFrame:
    """phi from the words' counts (word_idx, n: array)."""
    dense = kept(vocab.select("word_idx").join(counts, "word_idx", "left"), "dense")  # used twice
    cells = dense.select("word_idx", F.posexplode(F.coalesce("n", F.array_repeat(F.lit(0).cast("long"), k))).alias("k", "n"))
    totals = cells.groupBy("k").agg((F.sum("n") + F.count("*") * gamma).alias("total"))  # k rows
    return cells.join(F.broadcast(totals), "k").select("word_idx", "k", "n", ((F.col("n") + gamma) / F.col("total")).alias("phi"))


def theta(state: DataFrame, k: int, alpha: float = ALPHA) -> DataFrame:
    """doc_id, k, theta = (n + alpha) / (all n of the document + K alpha)."""
    return theta_of(topic_counts(state, "doc_id", k), k, alpha)


def theta_of(counts: DataFrame, k: int, alpha: float = ALPHA) -> DataFrame:
    """theta from the documents' counts (doc_id, n: array)."""
    n = counts.withColumn("total", F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b) + k * alpha)
    return n.select("doc_id", "total", F.posexplode("n").alias("k", "n")).select("doc_id", "k", ((F.col("n") + alpha) / F.col("total")).alias("theta"))


def top_words(phis: DataFrame, vocab: DataFrame, x: int = 10, least: int = 3) -> DataFrame:
    """topic (from 1), rank, word, word_idx, n: each topic's words of the highest phi, ties by word_idx; topics whose
    first word stands there ``least`` times or less are left out."""
    order = W.partitionBy("k").orderBy(F.desc("phi"), "word_idx")
    best = phis.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= x)
    best = best.withColumn("most", F.max(F.when(F.col("rank") == 1, F.col("n"))).over(W.partitionBy("k"))).where(F.col("most") > least)
    return best.join(vocab.select("word_idx", "word"), "word_idx").select((F.col("k") + 1).alias("topic"), "rank", "word", "word_idx", "n")


_ROTATED = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_WORD_OF = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_start(blocks: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of messages of one block each (16 columns of words, padded), all at once."""
    out = np.empty(len(blocks), np.int64)
    for at in range(0, len(blocks), 8_192):  # what fits the cache
        m = np.ascontiguousarray(blocks[at : at + 8_192].T)
        a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in _START)
        for i in range(64):
            f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
            f += a
            f += _ADDED[i]
            f += m[_WORD_OF[i]]
            a, d, c = d, c, b
            b = b + ((f << np.uint32(_ROTATED[i])) | (f >> np.uint32(32 - _ROTATED[i])))
        out[at : at + 8_192] = (a + _START[0]).byteswap()
    return out


def md5_numbers(docs: list, words: list[bytes], cnts: np.ndarray, tag: bytes = b"") -> np.ndarray:
    """For each occurrence the first 32 bits of an md5 of document, word, its number (from 1) and the tag, as hash_uniform
    and hash_int take them (a null document is left out)."""
    starts = [w + b"|" if d is None else b"%d|%b|" % (d, w) for d, w in zip(docs, words, strict=True)]
    cnts = np.asarray(cnts, np.int64)
    if not cnts.sum():
        return np.zeros(0, np.int64)
    long = np.fromiter(map(len, starts), np.int64, len(starts))
    row = np.repeat(np.arange(len(cnts)), cnts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(cnts) - cnts, cnts) + 1
    out, padded = np.empty(len(row), np.int64), np.array(starts, "S64").view(np.uint8).reshape(-1, 64)
    digits = np.ones(len(row), np.int64)
    for p in range(1, 10):
        digits += nth >= 10**p
    ends = long[row] + digits
    one = ends + len(tag) <= 55  # what is one block of md5; longer ones are rare
    for some in np.array_split(np.flatnonzero(one), max(1, len(row) // 200_000)):
        block, line = padded[row[some]], np.arange(len(some))
        number, end = nth[some], ends[some]
        for p in range(int(digits[some].max(initial=1))):
            has = digits[some] > p
            block[line[has], end[has] - 1 - p] = 48 + number[has] // 10**p % 10
        for t, byte in enumerate(tag + b"\x80"):
            block[line, end + t] = byte
        block[:, 56:] = ((end + len(tag)) * 8).astype("<u8")[:, None].view(np.uint8)
        out[some] = _md5_start(block.view("<u4"))
    for i in np.flatnonzero(~one):
        out[i] = int.from_bytes(hashlib.md5(starts[row[i]] + b"%d" % nth[i] + tag).digest()[:4], "big")
    return out


def hashed_counts(terms: DataFrame, k: int, *by: str) -> DataFrame:
    """long_counts of initial_topics by doc_id and word, without the topics themselves: by doc_id, by word or of all.
    terms: doc_id (a number), word, cnt."""
    counted, fields = _hashing(terms.schema, k, *by)
    parts = terms.select("doc_id", "word", F.col("cnt").cast("long").alias("cnt")).mapInArrow(counted, fields)
    return parts.groupBy(*by, "k").agg(F.sum("n").alias("n"))


def hashed_counts_of_texts(docs: DataFrame, k: int, *by: str) -> DataFrame:
    """The same from texts (doc_id, text), whose terms don't leave Python unless an id repeats."""
    counted, fields = _hashing(docs.schema, k, *by)
    return bow.text_terms(docs, then=counted, fields=fields).groupBy(*by, "k").agg(F.sum("n").alias("n"))


def _hashing(schema, k: int, *by: str):
    """What hashed_counts does with batches of terms, and its fields; sums by key and k are still to be made."""

    def counted(batches):
        keys, zs, n = [], [], 0
        for batch in batches:
            docs, words, cnts = batch.column("doc_id"), batch.column("word").cast(pa.binary()), batch.column("cnt").to_numpy(zero_copy_only=False)
            zs.append(np.repeat(np.arange(len(cnts)), cnts) * k + md5_numbers(docs.to_pylist(), words.to_pylist(), cnts) % k)
            keys.append(batch.column(by[0]) if by else pa.nulls(len(cnts), pa.int32()))
            n += len(zs[-1])
            if n >= MOST_DRAWN:
                yield summed(keys, zs)
                keys, zs, n = [], [], 0
        if n:
            yield summed(keys, zs)

    def summed(keys, zs):
        column, at = pa.chunked_array(keys).combine_chunks(), np.cumsum([0] + [len(x) for x in keys[:-1]])
        code = column.dictionary_encode(null_encoding="encode") if by else None
        rows = np.concatenate([z + o * k for z, o in zip(zs, at, strict=True)])
        own = code.indices.to_numpy(zero_copy_only=False).astype(np.int64) if by else np.zeros(len(column), np.int64)
        found, many = np.unique(own[rows // k] * k + rows % k, return_counts=True)
        kind = {"k": pa.array(found % k, pa.int32()), "n": pa.array(many, pa.int64())}
        return pa.RecordBatch.from_pydict(({by[0]: code.dictionary.take(pa.array(found // k, pa.int64()))} if by else {}) | kind)

    fields = [f"{c} {'string' if c == 'word' else schema[c].dataType.simpleString()}" for c in by] + ["k int", "n long"]
    return counted, ", ".join(fields)


def dense_counts(counts: DataFrame, by: str, k: int) -> DataFrame:
    """(by, n) with n an array of k counts, from long counts (by, k, n)."""
    sums = F.array(*(F.coalesce(F.sum(F.when(F.col("k") == t, F.col("n"))), F.lit(0).cast("long")) for t in range(k)))
    return counts.groupBy(by).agg(sums.alias("n"))


def _uniforms(doc, word, nth, seed: int, sweep_no: int) -> np.ndarray:
    """Uniforms that depend on nothing but what they are drawn for: a lost task draws the same again."""
    x = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x += nth.astype(np.uint64) * np.uint64(0x165667B19E3779F9) + np.uint64((seed * 1_000_003 + sweep_no) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


class _Part:
    """A part of the state: the rows of the documents that were dealt together, as arrays, and a topic for each token."""

    def __init__(self, docs, words, cnts, z):
        self.docs, self.words, self.cnts, self.z = docs, words, cnts, z
        self.row = np.repeat(np.arange(len(docs)), cnts)
        self.nth = np.arange(len(self.row)) - np.repeat(np.cumsum(cnts) - cnts, cnts)

    @classmethod
    def opened(cls, row: dict) -> _Part:
        """From a written row. words are places in names, the part's words, which are in order of buckets."""
        kinds = (("docs", np.int64), ("at", np.int32), ("cnts", np.int32), ("zs", np.int16))
        own = cls(*(np.frombuffer(row[c], kind).astype(np.int64 if c == "zs" else kind) for c, kind in kinds))
        own.names, own.u, own.ids = row["names"], np.frombuffer(row["us"], np.uint32), np.frombuffer(row["ids"], np.int64)
        return own

    def written(self, part: int, k: int, buckets: int, state: bool = True) -> pa.Table:
        """The part as one row (if state), and its topic counts as a row for each bucket of words."""
        own, rows = self.ids % buckets, []
        if state:
            rows.append({"part": part, "bucket": -1, "names": self.names} | {c: np.ascontiguousarray(x, kind).tobytes() for c, x, kind in (("docs", self.docs, np.int64), ("at", self.words, np.int32), ("cnts", self.cnts, np.int32), ("zs", self.z, np.int16), ("us", self.u, np.uint32), ("ids", self.ids, np.int64))})
        n = self.counts(k)
        cuts = np.flatnonzero(np.diff(own)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
            if a < b:
                rows.append({"part": part, "bucket": int(own[a]), "names": self.names.slice(a, b - a), "n": n[a:b].astype(np.int32).tobytes()})
        return _table(rows, self.names.type)

    def counts(self, k: int) -> np.ndarray:
        return np.bincount(self.words[self.row].astype(np.int64) * k + self.z, minlength=len(self.names) * k).reshape(-1, k)

    def swept(self, words, n_w, n_t, k, n_words, alpha, gamma, u, step: int, of=None) -> None:
        """Draws new topics, ``step`` tokens at a time, against the counts n_w of words and n_t of all tokens, which follow
        after each step; of: the tokens to draw (None: all), in order of documents or, if given, as given."""
        docs, d = np.unique(self.docs, return_inverse=True)
        w, z = np.searchsorted(words, self.words)[self.row], self.z
        d, a_w, a_t = d[self.row], n_w + float(gamma), n_t + float(n_words * gamma)
        a_d = np.bincount(d * k + z, minlength=len(docs) * k).reshape(-1, k) + float(alpha)
        flat_d, flat_w = a_d.reshape(-1), a_w.reshape(-1)
        of = np.arange(len(z)) if of is None else of
        for at in range(0, len(of), step):
            s = of[at : at + step]
            old, dd, ww = z[s], d[s] * k, w[s] * k
            p = a_d[d[s]]
            p *= a_w[w[s]]
            p /= a_t
            p[np.arange(len(s)), old] = (flat_d[dd + old] - 1) * (flat_w[ww + old] - 1) / (a_t[old] - 1)  # less itself
            np.maximum(p, 0, out=p)
            np.cumsum(p, axis=1, out=p)
            new = np.minimum(np.count_nonzero(p < (u[s] * p[:, -1])[:, None], axis=1), k - 1)
            for flat, at_row in ((flat_d, dd), (flat_w, ww)):  # a step costs its own tokens, not all counts
                np.add.at(flat, at_row + new, 1.0)
                np.add.at(flat, at_row + old, -1.0)
            a_t += np.bincount(new, minlength=k) - np.bincount(old, minlength=k)
            z[s] = new


def bundle_round(words: np.ndarray, part: int, n_parts: int, rounds: int) -> np.ndarray:
    """In which of a sweep's rounds a worker draws each word. Words go in bundles by a hash, the same for all workers; a
    worker starts at its own place in the circle of bundles, so that at any time few workers draw the same words."""
    bundle = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % rounds
    return (bundle - part * rounds // n_parts) % rounds


_FIELDS = ("part int", "bucket int", "names array<{}>", "docs binary", "at binary", "cnts binary", "zs binary", "us binary", "ids binary", "n binary")


def _ids(names: pa.Array) -> np.ndarray:
    """A number for each word: its index, or a hash of its letters (of words of one number only draws are alike)."""
    if pa.types.is_integer(names.type):
        return names.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.fromiter(map(zlib.crc32, names.cast(pa.binary()).to_pylist()), np.int64, len(names))


def _table(rows: list[dict], kind: pa.DataType) -> pa.Table:
    """Rows with the columns of _FIELDS; names are arrays of the kind."""
    out = {}
    for field in _FIELDS:
        name, sort = field.split()
        if name == "names":
            sizes = np.cumsum([0] + [len(r["names"]) for r in rows])
            values = pa.concat_arrays([r["names"] for r in rows]) if rows else pa.array([], kind)
            out[name] = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
        else:
            out[name] = pa.array([r.get(name) for r in rows], pa.int32() if sort == "int" else pa.binary())
    return pa.table(out)


def _names(column: pa.ChunkedArray) -> pa.Array:
    """The values of a column of lists, in order."""
    return pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], column.type.value_type)


def _totals(written: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, int]:
    """The parts' counts summed over all parts, as a row of the same words for each part and bucket; the topics' totals and
    the number of words."""

    def summed(table: pa.Table) -> pa.Table:
        names = _names(table["names"])
        codes = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        n = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["n"]]).reshape(-1, k)
        total = np.stack([np.bincount(codes, weights=n[:, t]) for t in range(k)], axis=1).astype(np.int64)  # exact below 2**53
        sized = total.astype(np.int32) if total.max() < 2**31 else total
        ends = np.cumsum(pc.list_value_length(table["names"]).to_numpy())
        rows = [sized[codes[a:b]].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        bucket = table["bucket"][0].as_py()
        own = total.sum(axis=0).tobytes()
        return pa.table({
            "part": pa.array([*table["part"].to_pylist(), -1], pa.int32()), "bucket": pa.array([bucket] * (len(rows) + 1), pa.int32()),
            "n": pa.array([*rows, own], pa.binary()), "words": pa.array([0] * len(rows) + [len(total)], pa.int64()),
        })

    counts = written.where("bucket >= 0").select("part", "bucket", "names", "n")
    totals = kept(counts.groupBy("bucket").applyInArrow(summed, "part int, bucket int, n binary, words long"), "totals")
    each = totals.where("part = -1").select("n", "words").collect()  # a row for each bucket
    n_t = np.sum([np.frombuffer(r.n, np.int64) for r in each], axis=0) if each else np.zeros(k, np.int64)
    return totals.where("part >= 0").drop("words"), n_t, sum(r.words for r in each)


def _fetched(ids: np.ndarray, asked: pa.Table, k: int, buckets: int) -> np.ndarray:
    """The totals of a part's words, in their order, which is that of the buckets."""
    many, out = np.bincount(ids % buckets, minlength=buckets), []
    for bucket, n in sorted(zip(asked["bucket"].to_pylist(), asked["n"].to_pylist(), strict=True)):
        out.append(np.frombuffer(n, np.int32 if len(n) == 4 * k * many[bucket] else np.int64).astype(np.int64))
    return np.concatenate(out).reshape(-1, k)


def _begun(table: pa.Table, part: int, word: str, buckets: int) -> _Part:
    """A part of rows doc_id, word, cnt in order of documents and words; words are in order of their buckets."""
    coded = table[word].combine_chunks().dictionary_encode()
    names = coded.dictionary
    ids = _ids(names)
    order = np.lexsort((pc.rank(names, tiebreaker="first").to_numpy(), ids % buckets))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    docs, at = table["doc_id"].to_numpy().astype(np.int64), place[coded.indices.to_numpy()]
    by = np.unique(docs, return_inverse=True)[1].astype(np.int64)
    rows = np.argsort(by * len(order) + at)
    own = _Part(docs[rows], at[rows], table["cnt"].to_numpy().astype(np.int32)[rows], None)
    own.names, own.u, own.ids, own.rows = names.take(pa.array(order)), np.zeros(0, np.uint32), ids[order], rows
    return own


def _sizes(terms: DataFrame, parts: int | None) -> tuple[int, int]:
    """How many parts, at least as many as shuffles have, and how many buckets of words."""
    if not parts:
        tokens = terms.agg(F.sum("cnt")).first()[0] or 0
        parts = max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS))
    return parts, max(1, parts // 2)


def sync_sweep(terms: DataFrame, k: int, by: str, alpha: float = ALPHA, gamma: float = GAMMA, tag: str = "1") -> DataFrame:
    """Counts (by, k, n), by doc_id or word, after one synchronous sweep from initial_topics of doc_id and word: every
    occurrence draws its topic against the counts of the state before, less itself, with the md5 uniform of document, word,
    occurrence and tag. terms: doc_id, word, cnt, of which those without doc_id count, but aren't drawn.

    p(t) ~ (n_dt + alpha) (n_wt + gamma) / (n_t + V gamma). The state is kept in parts as by fit.
    """
    n_parts, buckets = _sizes(terms, None)
    fields = ", ".join(_FIELDS).format("string")

    def begin(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        own = _begun(table.set_column(0, "doc_id", pc.fill_null(table["doc_id"], 0)), part, "word", buckets)
        docs = table["doc_id"].take(pa.array(own.rows))
        words = own.names.cast(pa.binary()).take(pa.array(own.words)).to_pylist()
        ids, cnts = docs.to_pylist(), own.cnts
        own.z = md5_numbers(ids, words, cnts) % k
        own.u = md5_numbers(ids, words, cnts, b"|" + tag.encode())
        n = own.written(part, k, buckets, state=False)
        known = docs.is_valid().to_numpy()
        if not known.all():
            whole, z = own, own.z[known[own.row]]
            own = _Part(own.docs[known], own.words[known], own.cnts[known], z)
            own.u, own.names, own.ids = whole.u[known[whole.row]], whole.names, whole.ids
        return pa.concat_tables([own.written(part, k, buckets).slice(0, 1), n])

    dealt = terms.select(F.col("doc_id").cast("long").alias("doc_id"), "word", F.col("cnt").cast("long").alias("cnt"), F.pmod(F.hash("doc_id"), F.lit(n_parts)).alias("part"))
    written = kept(dealt.groupBy("part").applyInArrow(begin, fields), "lda")
    totals, n_t, n_words = _totals(written, k)

    def drawn(state: pa.Table, asked: pa.Table) -> pa.Table:
        own = _Part.opened(state.drop_columns(["names"]).to_pylist()[0] | {"names": _names(state["names"])})
        n_w = _fetched(own.ids, asked, k, buckets)
        docs, d = np.unique(own.docs, return_inverse=True)
        d, w, u = d[own.row], own.words[own.row], own.u / 2.0**32
        n_d = np.bincount(d * k + own.z, minlength=len(docs) * k).reshape(-1, k)
        new = np.empty(len(own.z), np.int64)
        for at in range(0, len(new), 100_000):
            s = slice(at, at + 100_000)
            less = (own.z[s, None] == np.arange(k)).astype(np.int64)
            c = np.cumsum((n_d[d[s]] - less + alpha) * (n_w[w[s]] - less + gamma) / (n_t - less + n_words * gamma), axis=1)
            new[s] = np.minimum((c < (u[s] * c[:, -1])[:, None]).sum(axis=1), k - 1)
        key = d if by == "doc_id" else w
        found, n = np.unique(key * np.int64(k) + new, return_counts=True)
        keys = pa.array(docs[found // k]) if by == "doc_id" else own.names.take(pa.array(found // k))
        return pa.table({by: keys, "k": pa.array(found % k, pa.int32()), "n": pa.array(n, pa.int64())})

    state = written.where("bucket < 0").drop("n", "bucket")
    found = state.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(drawn, f"{by} {'long' if by == 'doc_id' else 'string'}, k int, n long")
    return found if by == "doc_id" else found.groupBy(by, "k").agg(F.sum("n").alias("n"))  # a document is in one part


def fit(
    matrix: DataFrame, n_words: int, k: int = 10, iterations: int = 100, seed: int = 1, mode: str = "block", parts: int | None = None,
    blocks: int = 20, alpha: float = ALPHA, gamma: float = GAMMA, rounds: int = 4,
) -> DataFrame:
    """The state (doc_id, word_idx, cnt, z) after so many sweeps from random topics.

    mode "serial": one part, one token after the other. "ad": parts side by side, each one token after the other against
    the counts at the sweep's start. "block": likewise, but a part's tokens in ``blocks`` steps, in vectors. "bundles":
    model-parallel sampling. A sweep has ``rounds`` rounds; in each a part draws the tokens of one bundle of words, word
    by word, against counts of these words fetched for the round, and its changes are merged before the next round. Parts
    start at different bundles of the circle, so counts are stale by a round at most and mostly not at all.

    Documents are dealt out by id once, and a part is one row of arrays: some 14 bytes a token. Each round is one job. It
    writes the parts and, for each part and bucket of words, the words' counts as one row of arrays; the sums of a bucket
    come back to the parts likewise, so nothing of the vocabulary's size is gathered anywhere, and no row is made for a
    word. Only the k totals go through the driver. The number of parts rises with the corpus (see PART_TOKENS).
    """
    word = "word_idx" if "word_idx" in matrix.columns else "word"
    return _unpacked(fit_parts(matrix, n_words, k, iterations, seed, mode, parts, blocks, alpha, gamma, rounds), word)


def fit_parts(
    matrix: DataFrame, n_words: int, k: int = 10, iterations: int = 100, seed: int = 1, mode: str = "block", parts: int | None = None,
    blocks: int = 20, alpha: float = ALPHA, gamma: float = GAMMA, rounds: int = 4,
) -> DataFrame:
    """The state of fit as it is kept, in parts. matrix has the words as word_idx or, without that, as word."""
    if mode not in ("serial", "ad", "block", "bundles"):
        raise ValueError(f"no such mode: {mode}")
    if not 1 <= k < 2**15 or iterations < 0 or rounds < 1:
        raise ValueError("k must be 1 to 32,767, iterations 0 or more, rounds 1 or more")
    n_parts, buckets = _sizes(matrix, 1 if mode == "serial" else parts)
    word = "word_idx" if "word_idx" in matrix.columns else "word"
    fields = ", ".join(_FIELDS).format("int" if word == "word_idx" else "string")

    def begin(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        own = _begun(table, part, word, buckets)
        own.z = (_uniforms(own.docs[own.row], own.ids[own.words[own.row]], own.nth, seed, -1) * k).astype(np.int64)
        return own.written(part, k, buckets)

    dealt = matrix.select("doc_id", word, F.col("cnt").cast("int").alias("cnt"), F.pmod(F.hash("doc_id"), F.lit(n_parts)).alias("part"))
    written = kept(dealt.groupBy("part").applyInArrow(begin, fields), "lda")

    def drawn(n_t: np.ndarray, sweep_no: int, r: int):
        def run(state: pa.Table, asked: pa.Table) -> pa.Table:
            part, own = state["part"][0].as_py(), _Part.opened(state.drop_columns(["names"]).to_pylist()[0] | {"names": _names(state["names"])})
            n_w, ids = _fetched(own.ids, asked, k, buckets), own.ids
            u = _uniforms(own.docs[own.row], ids[own.words[own.row]], own.nth, seed, sweep_no)
            n, of = len(own.z), None
            step = 1 if mode in ("serial", "ad") else max(1, -(-n // blocks))
            if mode == "bundles":
                at = np.flatnonzero(bundle_round(ids, part, n_parts, rounds)[own.words[own.row]] == r)
                of = at[np.argsort(own.words[own.row[at]], kind="stable")]  # word by word, and its documents in turn
                step = max(1, -(-n // (blocks * rounds)))
            own.swept(np.arange(len(ids)), n_w, n_t, k, n_words, alpha, gamma, u, step, of)
            return own.written(part, k, buckets)

        return run

    for sweep_no in range(iterations):
        for r in range(rounds if mode == "bundles" else 1):
            totals, n_t, _ = _totals(written, k)
            state = written.where("bucket < 0").drop("n", "bucket")
            written = kept(state.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(drawn(n_t, sweep_no, r), fields), "lda")
    return written


def _unpacked(written: DataFrame, word: str) -> DataFrame:
    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = _Part.opened(row.drop_columns(["names"]).to_pylist()[0] | {"names": row["names"].flatten()})
                ends = np.concatenate([[0], np.cumsum(own.cnts)])
                for at in range(0, len(own.docs), 20_000):
                    s = slice(at, at + 20_000)
                    upto = ends[at : at + 20_001]
                    z = pa.ListArray.from_arrays(pa.array(upto - upto[0], pa.int32()), pa.array(own.z[upto[0] : upto[-1]], pa.int32()))
                    words = own.names.take(pa.array(own.words[s]))
                    yield pa.record_batch([pa.array(own.docs[s]), words, pa.array(own.cnts[s], pa.int64()), z], names=["doc_id", word, "cnt", "z"])

    parts = written.where("bucket < 0").select("names", "docs", "at", "cnts", "zs", "us", "ids")
    return parts.mapInArrow(unpack, f"doc_id long, {word} {'int' if word == 'word_idx' else 'string'}, cnt long, z array<int>")


def part_counts(written: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """long_counts of a state in parts (see fit_parts): by doc_id, by the words (word_idx or word) or of all."""
    kind = {"doc_id": "long", "word_idx": "int", "word": "string"}

    def counted(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = _Part.opened(row.drop_columns(["names"]).to_pylist()[0] | {"names": row["names"].flatten()})
                docs, d = np.unique(own.docs, return_inverse=True)
                key = d[own.row] if by == "doc_id" else own.words[own.row] if by else np.zeros(len(own.z), np.int64)
                found, n = np.unique(key.astype(np.int64) * k + own.z, return_counts=True)
                keys = {} if not by else {by: pa.array(docs[found // k]) if by == "doc_id" else own.names.take(pa.array(found // k))}
                yield pa.RecordBatch.from_pydict(keys | {"k": pa.array(found % k, pa.int32()), "n": pa.array(n, pa.int64())})

    fields = ([f"{by} {kind[by]}"] if by else []) + ["k int", "n long"]
    counts = written.where("bucket < 0").select("names", "docs", "at", "cnts", "zs", "us", "ids").mapInArrow(counted, ", ".join(fields))
    return counts.groupBy(*[by] if by else [], "k").agg(F.sum("n").alias("n"))


def zero_counters(vocab: DataFrame, k: int) -> DataFrame:
    """word_idx, k, n = 0 for every word and topic: counters before anything is counted."""
    return vocab.select("word_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k")).withColumn("n", F.lit(0).cast("long"))


def condensed_counts(state: DataFrame, placement: DataFrame) -> DataFrame:
    """pw, row_in_pw, k, n: each word worker's counts by the word's row in its own matrix, without zeros."""
    return placed_counts(long_counts(state, "word_idx"), placement)


def placed_counts(counts: DataFrame, placement: DataFrame) -> DataFrame:
    """The same from the words' counts (word_idx, k, n)."""
    return counts.join(placement.select("word_idx", "pw", "row_in_pw"), "word_idx").select("pw", "row_in_pw", "k", "n")
