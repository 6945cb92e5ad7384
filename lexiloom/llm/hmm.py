"""LM scoring: a hidden Markov language model by Baum-Welch, and exact sequence likelihoods by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import chunks, crc_mod, materialise, sum_slices

STATES, ROUNDS = 8, 3
FREQUENT, RARE = 8191, 256  # word classes: frequent words each of their own, others by their last two bytes
SEED_DOCS = 500  # texts, by a hash over all, that the states start from; Baum-Welch then learns from all
SEGMENT, STRAIGHT = 512, 1024
DOCS_A_BUCKET = 4_000
END = 0


def tokens(text: str | None) -> list[bytes]:
    """Words of a text: runs other than ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _RareClass(dict):
    def __missing__(self, tail: bytes) -> int:
        k = self[tail] = 1 + FREQUENT + zlib.crc32(tail) % RARE
        return k


def _key(doc_id, text: str | None) -> int:
    """A row's key: rows of one id and text count as one."""
    return xxhash.xxh64_intdigest(f"{doc_id}:".encode() + (text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def frequent_words(docs: DataFrame) -> tuple[dict[bytes, int], list[int], np.ndarray]:
    """The commonest words of all rows, as classes 1 to FREQUENT (of equally common ones the least bytes); the least
    SEED_DOCS values of _seed_hash among texts of over 20 words; and how often each of the words stands there, by class
    (0, the end: 0). Tasks count, and their counts meet by word."""

    def count(frames):
        counts, least = Counter(), []
        for pdf in frames:
            for part in chunks(pdf, 6_000_000):
                usable = []
                for text, h in zip(part["text"], part["h"], strict=True):
                    counts.update(words := tokens(text))
                    if len(words) > 20:
                        usable.append(h)
                least = sorted({*least, *usable})[:SEED_DOCS]
                if len(counts) > 300_000 or sum(map(len, counts)) > 30_000_000:
                    yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})
        # Hashes travel as words counted below 0; no word has the space in front.
        yield pd.DataFrame({"word": [b" " + (h + (1 << 63)).to_bytes(8, "big") for h in least], "n": -1})

    # Histograms bound what is sorted for either limit: a few rows more than it, from however many tasks.
    counted = docs.select("text", _seed_hash()).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    step = F.when(F.col("n") > 0, -F.floor(F.log2("n") * 16)).otherwise(F.conv(F.hex(F.substring("word", 2, 2)), 16, 10).cast("long"))
    counted = materialise(counted.withColumn("kind", F.col("n") > 0).withColumn("step", step), "words")
    steps, rows = counted.groupBy("kind", "step").agg(F.count("*").alias("times")).toPandas(), []
    for kind, most, order in ((True, FREQUENT, [F.desc("n"), F.col("word")]), (False, SEED_DOCS, [F.col("word")])):
        own = steps[steps["kind"] == kind].sort_values("step")
        enough = own["step"][own["times"].cumsum() >= most]
        best = counted.where(F.col("kind") == kind).where(F.col("step") <= int(enough.iloc[0]) if len(enough) else F.lit(True))
        rows += [(bytes(r["word"]), r["n"]) for r in best.orderBy(*order).limit(most).collect()]
    words = sorted((-n, w) for w, n in rows if n > 0)
    times = np.zeros(1 + FREQUENT, np.int64)
    times[1 : 1 + len(words)] = [-n for n, _ in words]
    return {w: k + 1 for k, (_, w) in enumerate(words)}, sorted(int.from_bytes(w[1:], "big") - (1 << 63) for w, n in rows if n < 0), times


def _seed_hash():
    return F.xxhash64("doc_id", "text", F.lit(9)).alias("h")


def seed_counts(encoded: DataFrame, hashes: list[int]) -> np.ndarray:
    """Word classes' counts in the whole texts of these hashes (texts x classes), by hash. encoded: h, codes."""
    n_classes = 1 + FREQUENT + RARE
    if not hashes:
        return np.zeros((0, n_classes), np.float32)
    near = encoded.where(F.col("h") <= max(hashes)).groupBy("h").agg(F.min("codes").alias("codes")).where(F.col("h").isin(hashes)).orderBy("h")
    return np.stack([np.bincount(_decoded(r["codes"]), minlength=n_classes) for r in near.toLocalIterator()]).astype(np.float32)


def _pack(hashes, keys, times, classes) -> bytes:
    """Occurrences as columns: hash, row key, occurrences (negative: not learned from), class."""
    return len(keys).to_bytes(8, "little") + b"".join(p.tobytes() for p in (hashes, keys, times, classes))


def _unpack(blob: bytes):
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in (np.uint64, np.int64, np.int32, np.uint8):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _decoded(codes: bytes) -> np.ndarray:
    return np.frombuffer(codes, np.uint16).astype(np.int64)


def _encoded(frequent: dict[bytes, int], n_buckets: int):
    """Tokenises every text once. Rows of kind 0: a text's key, word classes and how many of its tokens those of the rare
    words are; of kind 1: rare words' occurrences by bucket of their hash."""

    def run(frames):
        rare_class = _RareClass()
        for pdf in frames:
            for part in chunks(pdf, 6_000_000):
                words, times, kinds, own, rares = [], [], [], [], []
                for text, train in zip(part["text"], part["train"], strict=True):
                    whole = tokens(text)
                    own.append(_codes(whole, frequent, rare_class).tobytes())
                    found = Counter(w for w in whole if w not in frequent)
                    rares.append(len(found))
                    words += map(xxhash.xxh64_intdigest, found)
                    times += found.values() if train else [-n for n in found.values()]
                    kinds += [rare_class[w[-2:]] for w in found]
                keys = np.array([_key(i, t) for i, t in zip(part["doc_id"], part["text"], strict=True)], np.int64)
                yield pd.DataFrame({"kind": 0, "doc_id": part["doc_id"], "train": part["train"], "h": part["h"], "key": keys, "codes": own, "bucket": -1, "blob": None})
                if not words:
                    continue
                hashes, keys = np.array(words, dtype=np.uint64), np.repeat(keys, rares)
                times, kinds = np.array(times, np.int32), (np.array(kinds) - 1 - FREQUENT).astype(np.uint8)
                bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows = [(int(bucket[o[0]]), _pack(hashes[o], keys[o], times[o], kinds[o])) for o in np.split(order, edges[1:])]
                yield pd.DataFrame({"kind": 1, "doc_id": None, "train": False, "h": 0, "key": 0, "codes": None, "bucket": [r[0] for r in rows], "blob": [r[1] for r in rows]})

    return run


def _count(key, pdf):
    """From a bucket's occurrences, by row: sum of log10(count + 0.1) over its tokens there, and how many are known; by
    class (kind 1): sum of counts, and number of words."""
    hashes, keys, times, kinds = (np.concatenate(x) for x in zip(*map(_unpack, pdf["blob"]), strict=True))
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    c = np.bincount(word, np.maximum(times, 0))
    n = np.abs(times)
    rows, of = np.unique(keys, return_inverse=True)
    logs = np.bincount(of, n * np.log10(c + 0.1)[word])
    known = np.bincount(of, n * (c > 0)[word]).astype(np.int64)
    out = pd.DataFrame({"kind": 0, "key": rows, "logs": logs, "known": known})
    types = np.bincount(kinds[first][c > 0], minlength=RARE)
    sums = np.bincount(kinds[first], c, minlength=RARE)
    classes = pd.DataFrame({"kind": 1, "key": 1 + FREQUENT + np.arange(RARE), "logs": sums, "known": types.astype(np.int64)})
    return pd.concat([out, classes[classes["known"] > 0]])


def _codes(words: list[bytes], frequent: dict[bytes, int], rare_class: dict) -> np.ndarray:
    """Word classes of a text, the end last."""
    get = frequent.get
    return np.array([get(w) or rare_class[w[-2:]] for w in words] + [END], dtype=np.uint16)


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side, longest first (step x sequence); how many go on at each step; their order."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((lengths.max(), len(sequences)), np.int64)
    for k, i in enumerate(order):
        out[: lengths[i], k] = sequences[i]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
    return out, active, order


class Hmm:
    """start (S), move (S x S) and emit (classes x S), all strictly positive."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, sequences: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sequences and state weights before their first token: log of the sum and the normalised end weights."""
        x, active, order = _padded(sequences)
        a, log = starts[order].copy(), np.zeros(len(sequences))
        for t, n in enumerate(active):
            a[:n] = (a[:n] if t == 0 else a[:n] @ self.move) * self.emit[x[t, :n]]
            total = a[:n].sum(axis=1)
            a[:n] /= total[:, None]
            log[:n] += np.log(total)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return log[back], a[back]

    def likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural logs of the sequences' probabilities. Long ones are cut into segments, each run from every state at
        once, and the segments' matrices multiplied: the same sum, in fewer steps."""
        out = np.zeros(len(sequences))
        short = [i for i, s in enumerate(sequences) if len(s) <= STRAIGHT]
        if short:
            out[short] = self.forward([sequences[i] for i in short], np.tile(self.start, (len(short), 1)))[0]
        long = [i for i, s in enumerate(sequences) if len(s) > STRAIGHT]
        if not long:
            return out
        later = [[sequences[i][k : k + SEGMENT] for k in range(SEGMENT, len(sequences[i]), SEGMENT)] for i in long]
        first_logs, first_ends = self.forward([sequences[i][:SEGMENT] for i in long], np.tile(self.start, (len(long), 1)))
        parts = [p for own in later for p in own]
        logs, ends = self.forward([p for p in parts for _ in range(STATES)], np.tile(self.move, (len(parts), 1)))
        logs, ends = logs.reshape(-1, STATES), ends.reshape(-1, STATES, STATES)
        at = 0
        for i, own, total, v in zip(long, later, first_logs, first_ends, strict=True):
            for k in range(at, at + len(own)):
                most = logs[k].max()
                v = (v * np.exp(logs[k] - most)) @ ends[k]
                norm = v.sum()
                total += most + np.log(norm)
                v = v / norm
            at += len(own)
            out[i] = total
        return out

    def counts(self, sequences: list[np.ndarray], starts: np.ndarray, start, move, emit) -> None:
        """Adds the sequences' expected counts (Baum-Welch) to start, move and emit."""
        x, active, order = _padded(sequences)
        a, scale, seen = starts[order].copy(), [], []
        for t, n in enumerate(active):
            a[:n] = (a[:n] if t == 0 else a[:n] @ self.move) * self.emit[x[t, :n]]
            total = a[:n].sum(axis=1)
            a[:n] /= total[:, None]
            scale.append(total)
            seen.append(a[:n].copy())
        b = np.ones_like(a)
        gammas = [None] * len(active)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            gammas[t] = seen[t] * b[:n]
            if t:
                ahead = self.emit[x[t, :n]] * b[:n] / scale[t][:, None]
                move += self.move * (seen[t - 1][:n].T @ ahead)
                b[:n] = ahead @ self.move.T
        start += gammas[0].sum(axis=0)
        at, gamma = np.concatenate([x[t, :n] for t, n in enumerate(active)]), np.concatenate(gammas)
        for s in range(STATES):
            emit[:, s] += np.bincount(at, gamma[:, s], minlength=len(emit))


def initial(mass: np.ndarray, seeds: np.ndarray, rng_seed: int = 9, rounds: int = 8) -> Hmm:
    """A start for Baum-Welch: states that last, each with the classes of one cluster of the seed texts (rows of
    counts by class; k-means by cosine, from texts far apart) mixed with all classes' masses."""
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    emit = mass[:, None] * np.random.default_rng(rng_seed).gamma(20.0, 0.05, (len(mass), STATES))
    if len(seeds) >= STATES:
        x = np.sqrt(seeds)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        picked = [0]
        while len(picked) < STATES:
            picked.append(int((unit @ unit[picked].T).max(axis=1).argmin()))
        centres = unit[picked]
        for _ in range(rounds):
            of = (unit @ centres.T).argmax(axis=1)
            centres = np.stack([unit[of == s].sum(axis=0) if (of == s).any() else centres[s] for s in range(STATES)])
            centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        counts = np.stack([(x[of == s] ** 2).sum(axis=0) + 1e-9 for s in range(STATES)], axis=1)
        emit = emit + counts / counts.sum(axis=0)
    return Hmm(np.full(STATES, 1.0 / STATES), move, emit / emit.sum(axis=0))


def _parts(frames, tokens_at_once: int = 400_000):
    """Slices of frames whose codes hold about so many tokens, one row at least."""
    for pdf in frames:
        ends = np.cumsum(pdf["codes"].str.len().to_numpy() // 2)
        low = 0
        while low < len(pdf):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + tokens_at_once, side="right")))
            yield pdf.iloc[low:high]
            low = high


def baum_welch_round(encoded: DataFrame, model: Hmm, mass: np.ndarray, n_tasks: int) -> Hmm:
    """One round over all texts (codes): tasks add up expected counts, which meet by slices of classes, in two steps, and
    then here (classes x states, whatever the input). Texts over SEGMENT tokens are learned in segments."""
    given = encoded.sparkSession.sparkContext.broadcast(model)
    height = len(mass) + STATES + 1

    def add(frames):
        model, total = given.value, np.zeros((height, STATES))
        start, move, emit = total[:1], total[1 : 1 + STATES], total[1 + STATES :]
        later = np.linalg.matrix_power(model.move, 64)[0]
        for part in _parts(frames):
            whole = [_decoded(c) for c in part["codes"]]
            first, rest = [s[:SEGMENT] for s in whole], [s[k : k + SEGMENT] for s in whole for k in range(SEGMENT, len(s), SEGMENT)]
            model.counts(first, np.tile(model.start, (len(first), 1)), start[0], move, emit)
            if rest:
                model.counts(rest, np.tile(later, (len(rest), 1)), np.zeros(STATES), move, emit)
        for k in range(0, height, 512):
            yield pd.DataFrame({"slice": [k], "sums": [total[k : k + 512].tobytes()]})

    total = sum_slices(encoded.select("codes").mapInPandas(add, "slice long, sums binary"), height, STATES, n_tasks)
    start, move, emit = total[0] + 0.1, total[1 : 1 + STATES] + 0.1, total[1 + STATES :] + mass[:, None]
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def score_texts(docs: DataFrame, train, rounds: int = ROUNDS) -> DataFrame:
    """Scores every row of docs (doc_id, text); the rows where train holds (null: they don't) are learned from.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score. A text's tokens are its words (see tokens)
    and one end. base_score sums log10((c + 0.1) / D), D = N + 0.1 (V + 1), with c a token's count over all training
    rows, N all their tokens, V how many differ. The model emits word classes from hidden states; within its class a
    word has its share (c + 0.1) / D of the class's mass, where every class of rare words has room for one unknown
    word: score = log10 P(classes) + base_score - sum of log10 of the classes' masses.
    Null and empty texts are the end alone. Without training rows N is 0 and all tokens are unknown. Rows equal in id
    and text get equal scores, and train as often as they stand there.

    Texts are tokenised twice: to find the frequent words, and to be written as word classes, which all later steps
    read. Counts of words outside the frequent ones are made by one exchange of occurrences by hash (64 bits tell words
    apart), whose results go back to rows by one more; frequent words, which would make hot keys, are counted within
    tasks.
    """
    # Ids travel as text, in which nulls don't turn the others into floating point numbers.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    n_docs, n_train = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    frequent, hashes, times = frequent_words(rows.where("train"))
    n_buckets = max(64, n_docs // DOCS_A_BUCKET)
    schema = "kind int, doc_id string, train boolean, h long, key long, codes binary, bucket long, blob binary"
    written = materialise(rows.withColumn("h", _seed_hash()).mapInPandas(_encoded(frequent, n_buckets), schema), "encoded")
    encoded = written.where("kind = 0")
    counted = written.where("kind = 1").select("bucket", "blob").groupBy("bucket").applyInPandas(_count, "kind int, key long, logs double, known long")
    counted = materialise(counted, "word-counts")

    sums = counted.where("kind = 1").groupBy("key").agg(F.sum("logs").alias("c"), F.sum("known").alias("types")).toPandas()
    n_classes = 1 + FREQUENT + RARE
    c, types = np.zeros(n_classes), np.zeros(n_classes)
    c[sums["key"].to_numpy(np.int64)], types[sums["key"].to_numpy(np.int64)] = sums["c"], sums["types"]
    c[: 1 + FREQUENT], c[END] = times, n_train
    types[: 1 + FREQUENT] = c[: 1 + FREQUENT] > 0
    n, v = int(c.sum()), int(types.sum())
    divisor = n + 0.1 * (v + 1)
    # Classes without a word here, such as frequent ones where few words differ, keep a little mass.
    mass = (c + 0.1 * np.maximum(types, 1) + 0.1 * (np.arange(n_classes) > FREQUENT)) / divisor
    model = initial(mass / mass.sum(), seed_counts(encoded.where("train"), hashes))
    if n:
        learn = encoded.where("train")
        n_tasks = learn.rdd.getNumPartitions()  # nothing is run for this
        for _ in range(rounds):
            model = baum_welch_round(learn, model, mass / mass.sum(), n_tasks)

    logs = np.log10(c + 0.1)
    given = docs.sparkSession.sparkContext.broadcast((model, logs, np.log10(mass), c > 0))

    def score(frames):
        model, logs, masses, known = given.value
        for part in _parts(frames):
            whole = [_decoded(c) for c in part["codes"]]
            own = [s[s <= FREQUENT] for s in whole]
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "key": part["key"], "n_tokens": [len(s) for s in whole],
                "own_known": [int(known[s].sum()) for s in own], "own_logs": [float(logs[s].sum()) for s in own],
                "gain": model.likelihoods(whole) / np.log(10) - [float(masses[s].sum()) for s in whole],
            })

    scored = encoded.select("doc_id", "key", "codes").mapInPandas(score, "doc_id string, key long, n_tokens long, own_known long, own_logs double, gain double")
    scored = materialise(scored, "scores")
    same = scored.groupBy("key").agg(F.count("*").alias("same"))
    rare = counted.where("kind = 0").groupBy("key").agg(F.sum("logs").alias("rare_logs"), F.sum("known").alias("rare_known"))
    rare = rare.join(same, "key").select("key", (F.col("rare_logs") / F.col("same")).alias("rare_logs"), (F.col("rare_known") / F.col("same")).cast("long").alias("rare_known"))
    out = scored.join(rare, "key", "left").withColumns({"rare_logs": F.coalesce("rare_logs", F.lit(0.0)), "rare_known": F.coalesce("rare_known", F.lit(0))})
    base = F.col("own_logs") + F.col("rare_logs") - F.col("n_tokens") * F.lit(float(np.log10(divisor)))
    return out.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_tokens", (F.col("own_known") + F.col("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 10 is 0), n_tokens, n_known, train_tokens, base_score, score."""
    found = score_texts(docs, crc_mod("doc_id", 10) != 0)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
