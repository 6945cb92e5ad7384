"""N-gram Jaccard join: a MinHash LSH forest for candidates, exact Jaccard similarity of word shingles for links."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import chunks, materialise, with_columns
from lexiloom.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH = 16, 6  # prefix tries, and the length of their signatures
TARGET_RECALL = 0.999
SMALL = 16  # prefix groups up to this size compare all their members by signature, larger ones with three leaders
PACK, PACK_SHINGLES = 1024, 2_000_000  # texts, and shingles, that are compared all with all in one place
DENSE = 100  # a cell of a dense product costs so much less than a pair that is counted by itself
LOOSE = 0.5  # least similarity, estimated from signatures, of texts that are compared exactly
_P = np.uint64(0x9E3779B97F4A7C15)
_MEMO_MAX = 500_000
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def depth_needed(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Matched prefixes are shortened from DEPTH until pairs at the threshold are found with the target recall."""
    for depth in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**depth) ** TREES >= target:
            return depth
    return 1


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(words: list[bytes], memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of SHINGLE words; a shorter text is one run, no words give none."""
    n = min(len(words), SHINGLE)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * _P + w[j : len(words) - n + 1 + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def signature(found: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minimum hashes of a nonempty shingle set."""
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(found), 2048):
        mixed = (found[None, k : k + 2048] * _A[:, None] + _B[:, None]) >> np.uint64(32)
        out = np.minimum(out, mixed.min(axis=1))
    return out.astype(np.uint32)


def text_digest():
    """128 bits that name a text's sequence of words; null where there are none."""
    words = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(words) > 0, F.substring(F.unhex(F.sha2(words, 256)), 1, 16))


def _signer():
    memo = _WordHash()

    def sign(texts):
        if len(memo) > _MEMO_MAX:
            memo.clear()
        signs = []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split()
            signs.append(signature(shingles(words, memo)).tobytes() if words else None)
        return (signs,)

    return sign


def _sets(frames):
    memo = _WordHash()
    for pdf in frames:
        for part in chunks(pdf, 2_000_000):
            if len(memo) > _MEMO_MAX:
                memo.clear()
            yield part[["rep"]].assign(found=[shingles(t.encode("utf-8", "surrogatepass").split(), memo).tobytes() for t in part["text"]])


def _alike(a: str, b: str):
    """Share of equal minimum hashes of two signatures, in Arrow batches."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series(dtype="float64")
        p, q = (np.frombuffer(b"".join(v), np.uint32).reshape(len(v), -1) for v in (x, y))
        return pd.Series((p == q).mean(axis=1))

    return share(a, b)


def candidate_pairs(reps: DataFrame, depth: int) -> DataFrame:
    """a, b (a < b): texts that share a prefix of this depth in some tree and may be alike by their signatures.

    Prefixes are shortened from DEPTH down to depth, as far as the target recall asks for. Where the group of a prefix
    has up to SMALL members, all of them are paired; where it is larger, the next longer prefixes split it further, and
    each member is paired with the leader of its group at every depth. A leader is the member that shares most long
    prefixes in all trees, so one amid the group. Rows: a few times TREES for each text, however large the groups. Group
    sizes and leaders are written before they are joined, so that adaptive execution may split the join's hot keys.
    reps: rep, sign.
    """
    depths = range(depth, DEPTH + 1)
    keys = [F.xxhash64("t", F.lit(d), F.substring(F.col("sign"), F.col("t") * (4 * DEPTH) + 1, F.lit(4 * d))).alias(f"k{d}") for d in depths]
    trees = reps.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("rep", *keys)
    left, pairs = trees, []
    for d in depths:  # members of large groups go on to the next longer prefix
        sizes = materialise(left.groupBy(f"k{d}").agg(F.count("*").alias("n")).where("n > 1"), "forest")
        shared = materialise(left.join(sizes, f"k{d}"), "forest")
        small = shared.where(F.col("n") <= SMALL).groupBy(f"k{d}").agg(F.array_sort(F.collect_set("rep")).alias("m"))
        small = small.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
        pairs.append(small)
        left = shared.where(F.col("n") > SMALL).drop("n")
        if d == depth:
            large = left
    long = materialise(large.groupBy(f"k{DEPTH}").agg(F.count("*").alias("w")).where("w > 1"), "forest")
    weight = materialise(large.join(long, f"k{DEPTH}").groupBy("rep").agg(F.sum("w").alias("w")), "forest")
    weighed = large.join(weight, "rep", "left").withColumn("w", F.coalesce("w", F.lit(0)))
    weighed = materialise(weighed.select("rep", "w", F.explode(F.array(*(f"k{d}" for d in depths))).alias("k")), "forest")
    lead = weighed.groupBy("k").agg(F.max(F.struct("w", -F.col("rep"))).alias("top")).select("k", (-F.col("top.col2")).alias("lead"))
    stars = weighed.join(materialise(lead, "forest"), "k").where("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"))
    for more in pairs:
        stars = stars.unionByName(more)
    found = stars.distinct()
    left, right = reps.select(F.col("rep").alias("a"), F.col("sign").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("sign").alias("sb"))
    return found.join(left, "a").join(right, "b").where(_alike("sa", "sb") >= LOOSE).select("a", "b")


def _common(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many shingles each set of a has in common with each set of b (None: of a; the diagonal is of no use then).

    A shingle of few sets adds to its pairs one by one, one of many sets takes a column of a dense product."""
    if b is None and len(a) == 2:
        return np.full((2, 2), np.intersect1d(a[0], a[1], assume_unique=True).size, np.float32)
    both = a if b is None else [*a, *b]
    of = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column = np.unique(np.concatenate(both), return_inverse=True)
    right = np.arange(len(of)) if b is None else np.flatnonzero(of >= len(a))
    left = np.arange(len(of)) if b is None else np.flatnonzero(of < len(a))
    n_a, n_b, width = len(a), len(a) if b is None else len(b), int(column.max()) + 1
    in_a, in_b = np.bincount(column[left], minlength=width), np.bincount(column[right], minlength=width)
    used = (in_a > 0) & (in_b > 0) & (in_a + in_b > (2 if b is None else 1))
    dense = used & (in_a.astype(np.float64) * in_b * DENSE > n_a * n_b)
    out = np.zeros((n_a, n_b), np.float32)
    at = np.cumsum(dense) - 1
    step = max(1, 4_000_000 // (n_a + n_b))
    for k in range(0, int(dense.sum()), step):
        parts = []
        for side, n, first in ((left, n_a, 0), (right, n_b, 0 if b is None else n_a)):
            own = side[dense[column[side]] & (at[column[side]] >= k) & (at[column[side]] < k + step)]
            x = np.zeros((n, min(step, int(dense.sum()) - k)), np.float32)
            x[of[own] - first, at[column[own]] - k] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    sparse = used & ~dense
    right = right[sparse[column[right]]]
    right = right[np.argsort(column[right], kind="stable")]
    start = np.cumsum(np.bincount(column[right], minlength=width)) - np.bincount(column[right], minlength=width)
    left = left[sparse[column[left]]]
    ends = np.cumsum(times := in_b[column[left]])
    low = 0
    while low < len(left):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 4_000_000, side="right")))
        n = times[low:high]
        i = np.repeat(left[low:high], n)
        j = right[np.repeat(start[column[left[low:high]]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        cell = of[i] * n_b + of[j] - (0 if b is None else n_a)
        out += np.bincount(cell, minlength=n_a * n_b).reshape(n_a, n_b)
        low = high
    return out


def _linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return common >= threshold * (a[:, None] + b[None, :] - common) - 1e-9


def _parts_of(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each of the names the least one that links lead to."""
    least, most = names.copy(), np.iinfo(np.int64).max
    while True:
        step = np.minimum(least, np.where(linked, least[None, :], most).min(axis=1, initial=most))
        if (step == least).all():
            return least
        least = step


def _within(unit: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All pairs of each pack of a unit, exactly: links of each text by rows and its component in the pack. Where a
    group has further packs, the pack itself comes out too, in one row."""
    out = []
    for (root, pack), g in unit.groupby(["root", "pack"], sort=False):
        sets = [np.frombuffer(f, np.uint64) for f in g["found"]]
        rep, rows, sizes = g["rep"].to_numpy(), g["n"].to_numpy(), np.array([len(s) for s in sets], np.int64)
        linked = _linked(_common(sets), sizes, sizes, threshold) if len(sets) > 1 else np.zeros((1, 1), bool)
        np.fill_diagonal(linked, False)
        links, least, packs = linked @ rows, _parts_of(linked, rep), int(g["packs"].iloc[0])
        out.append(pd.DataFrame({"root": root, "pack": pack, "packs": packs, "rep": rep, "links": links, "least": least, "blob": None}))
        if packs > 1:
            blob = np.concatenate((np.array([len(rep)]), rep, rows, least, sizes)).astype(np.int64).tobytes() + np.concatenate(sets).tobytes()
            out.append(pd.DataFrame({"root": [root], "pack": [pack], "packs": [packs], "rep": [-1], "links": [0], "least": [-1], "blob": [blob]}))
    return pd.concat(out)


def _opened(blob: bytes):
    """rep, rows, least and sets of a pack."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    rep, rows, least, sizes = np.frombuffer(blob, np.int64, 4 * n, 8).reshape(4, n)
    return rep, rows, least, np.split(np.frombuffer(blob, np.uint64, -1, 8 * (4 * n + 1)), np.cumsum(sizes)[:-1])


def _across(threshold: float):
    """For pairs of packs of one group: links of each text to the other pack's, in one row for each pack; which
    components of the two packs are linked."""

    def run(frames):
        for pdf in frames:
            for root, i, j, p, q in pdf[["root", "i", "j", "p", "q"]].itertuples(index=False):
                (_, rows_a, least_a, a), (_, rows_b, least_b, b) = _opened(p), _opened(q)
                linked = _linked(_common(a, b), np.array([len(s) for s in a]), np.array([len(s) for s in b]), threshold)
                x, y = np.nonzero(linked)
                edges = np.unique(np.stack([least_a[x], least_b[y]], axis=1), axis=0).tolist()
                counts = (linked @ rows_b).astype(np.int64).tobytes(), (rows_a @ linked).astype(np.int64).tobytes()
                edges = [{"a": e[0], "b": e[1]} for e in edges]
                yield pd.DataFrame({"root": [root] * 2, "pack": [i, j], "counts": counts, "edges": [edges, []]})

    return run


def _added(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """A pack's texts with the sums of their links to all other packs."""
    rep = _opened(next(b for b in pdf["blob"] if b is not None))[0]
    return pd.DataFrame({"rep": rep, "links": sum(np.frombuffer(c, np.int64) for c in pdf["counts"] if c is not None)})


def exact_links(groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rep, links, root for texts with links; groups: rep, n (its rows), root (texts are compared within one), found.

    A group's texts are dealt to packs of about PACK texts or PACK_SHINGLES shingles. Pairs within a pack are compared
    where the pack is gathered, and small groups share tasks. Packs of a larger group then meet two by two as one row
    each: what is moved and written is a row for each text and one for each pair of packs, and never one for a pair of
    texts or for a text and a pack. Components are joined by the links between the components of packs.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"), F.sum(F.length("found") / 8).alias("weight"))
    packs = F.ceil(F.greatest(F.col("size") / PACK, F.col("weight") / PACK_SHINGLES)).cast("int")
    dealt = groups.join(sizes.select("root", packs.alias("packs")), "root")
    dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("rep"), F.col("packs")).cast("int"))
    n_units = max(64, groups.count() // 200)
    unit = F.when(F.col("packs") == 1, F.pmod(F.xxhash64("root"), F.lit(n_units))).otherwise(F.xxhash64("root", "pack"))
    schema = "root long, pack int, packs int, rep long, links long, least long, blob binary"
    found = materialise(dealt.withColumn("unit", unit).groupBy("unit").applyInPandas(lambda u: _within(u, threshold), schema), "links")
    members, whole = found.where("blob is null"), found.where("blob is not null").select("root", "pack", "packs", "blob")
    first = whole.withColumn("j", F.explode(F.sequence(F.col("pack"), F.col("packs") - 1))).where("j > pack")
    pairs = first.select("root", F.col("pack").alias("i"), "j", F.col("blob").alias("p"))
    pairs = pairs.join(whole.select("root", F.col("pack").alias("j"), F.col("blob").alias("q")), ["root", "j"]).select("root", "i", "j", "p", "q")
    across = pairs.repartition("root", "i", "j").mapInPandas(_across(threshold), "root long, pack int, counts binary, edges array<struct<a:long,b:long>>")
    across = materialise(across, "links")
    parts = across.select("root", "pack", "counts", F.lit(None).cast("binary").alias("blob"))
    parts = parts.unionByName(whole.select("root", "pack", F.lit(None).cast("binary").alias("counts"), "blob"))
    more = parts.groupBy("root", "pack").applyInPandas(_added, "rep long, links long").withColumnRenamed("links", "more")
    roots = components(across.select(F.explode("edges").alias("e")).select("e.a", "e.b"))
    out = members.join(more, "rep", "left").join(roots, members.least == roots.v, "left")
    return out.select("rep", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce(roots["root"], "least").alias("root")).where("links > 0")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, text) as doc_id and digest, and their texts: digest, text_id (its least doc_id), same (its
    rows), links, root (null: no link to another text; else a number that the texts of one class share)."""
    signed = with_columns(docs.select("doc_id", text_digest().alias("digest"), "text"), {"sign": "binary"}, _signer, 2_000_000, keep_text=False)
    signed = materialise(signed, "signatures")
    usable = signed.where(F.col("digest").isNotNull())
    reps = usable.groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n"), F.first("sign").alias("sign"))
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()), "texts")  # numbers hold once written
    pairs = candidate_pairs(reps.select("rep", "sign"), depth_needed(threshold, target))
    groups = components(pairs).withColumnRenamed("v", "rep").join(reps.select("rep", "n", "digest", "text_id"), "rep")
    wanted = groups.select("rep", F.col("digest").alias("_digest"), "text_id").hint("shuffle_hash")
    texts = docs.select("doc_id", text_digest().alias("digest"), "text").where("digest is not null")
    texts = texts.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("text_id"))).select("rep", "text")
    sets = materialise(texts.mapInPandas(_sets, "rep long, found binary"), "shingles").groupBy("rep").agg(F.first("found").alias("found"))
    links = materialise(exact_links(groups.select("rep", "n", "root").join(sets, "rep"), threshold), "linked")
    return signed.select("doc_id", "digest"), reps.select("rep", "digest", "text_id", F.col("n").alias("same")).join(links, "rep", "left").drop("rep")


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links, text_id for each row of docs (doc_id, text).

    Two rows link if the Jaccard similarity of their texts' sets of five-word shingles (words: runs of bytes other
    than ASCII white space, case kept) is at least threshold; equal word sequences always link. n_links counts a
    row's links to other rows, class_id is the least doc_id that links lead to, text_id the least one with the same
    words. A text of one to four words is one shingle. Null texts and texts without words link to nothing and are
    classes of their own. Rows are told apart by their texts and not by their ids: repeated rows link to each other,
    rows with a null id link like others (text_id and class_id are null where no row has an id), and rows of one id
    with different texts have the links of their own texts.
    """
    rows, texts = text_classes(docs, threshold, target)
    classes = texts.where("root is not null").groupBy("root").agg(F.min("text_id").alias("class_id"))
    texts = texts.join(classes, "root", "left").withColumn("class_id", F.coalesce("class_id", "text_id"))
    joined = rows.join(texts.select("digest", "text_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("same") - 1).alias("n_links")), "digest", "left")
    alone = F.col("digest").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
    )


def first_of_classes(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """The rows of docs (doc_id, text; other columns stay) less all but one of each class: the one of the least doc_id
    (null last), of equal ids the text of the least digest. Of rows equal in id and words one stays, picked by a hash of
    all its columns. Every row without words stays."""
    _, texts = text_classes(docs, threshold, target)
    order = F.struct(F.col("text_id").isNull().alias("late"), "text_id", "digest")
    own_class = F.when(F.col("root").isNull(), F.col("digest")).alias("alone")  # texts without links are classes of their own
    kept = texts.groupBy("root", own_class).agg(F.min(order).alias("first"))
    kept = materialise(kept.select(F.col("first.text_id").alias("_id"), F.col("first.digest").alias("_first")), "kept")
    own = docs.withColumn("_digest", text_digest())
    same = (F.col("_digest") == F.col("_first")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    found = own.where("_digest is not null").join(kept.hint("shuffle_hash"), same, "left_semi")
    # Rows equal in id and words: found by their ids and digests alone, and only where there are any are whole rows grouped.
    repeated = docs.select("doc_id", text_digest().alias("_digest")).where("_digest is not null").groupBy("doc_id", "_digest").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialise(repeated.select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_first")), "repeated")
    if not repeated.isEmpty():
        twice = found.join(repeated, same, "left_semi")
        whole = F.struct(*(F.col(c) for c in docs.columns))
        once = twice.groupBy("doc_id", "_digest").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
        found = found.join(repeated, same, "left_anti").select(*docs.columns).unionByName(once)
    return found.select(*docs.columns).unionByName(own.where("_digest is null").select(*docs.columns))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and text_id for every document."""
    return ngram_join(docs)
