"""Benchmark decontamination: latent semantic retrieval of passages, then longest-common-subsequence and answer checks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import chunks, sum_slices, with_columns

WORD = re.compile(r"\w+")
ASCII_SPACED = bytes(k if k > 127 or WORD.match(chr(k)) else 32 for k in range(256))
ASCII_LOWER = ASCII_SPACED.lower()
ASCII = bytes(range(128))
APART = re.compile(r"[^\w ]")
HEAD = 16  # bytes of a word that are compared as two numbers; the rest of longer words is compared as it is
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WINDOW, STRIDE = 32, 8
RANK, EXTRA = 96, 16
COSINE = 0.5  # least cosine, in the latent space, of a passage and an item that are compared word by word
COVERAGE, ANSWER = 0.6, 0.5
FIT_TASKS = 32  # the SVD is fitted by so many tasks at most, or by more if each still has words enough:
FIT_WORDS = 1_000  # times the vocabulary's size, which is that of each task's sums
AT_ONCE = 512  # blocks of words whose rows are added up at a time, so that they stay in the processor's cache
ITEMS_AT_ONCE = 5_000  # cosines are taken of so many items at a time; results don't depend on it
MOST_ITEM_WORDS = 20_000_000  # of a benchmark, all of which is broadcast
SHORT = 5  # items of fewer words are found by their exact word sequence alone
LEAST = 3  # words of items in a passage that is looked at: COVERAGE of SHORT words
DENSEST = 0.6  # a leak's densest passage holds this share at least of COVERAGE of the item's words (of those of a passage, if it is longer)


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and _, in lower case. Where ASCII alone parts them, splitting gives the same words faster."""
    text = text.lower()
    spaced = text.encode("utf-8", "surrogatepass").translate(ASCII_SPACED).decode("utf-8", "surrogatepass")
    return spaced.split() if spaced.isascii() or not APART.search(spaced) else WORD.findall(text)


def masks(words: list) -> dict:
    """For each word the places where it stands, as bits."""
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(a: list, b: list, places: dict | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming. places: masks(a)."""
    get = (masks(a) if places is None else places).get
    full = row = (1 << len(a)) - 1
    for w in b:
        if m := get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def is_leak(item: list, region: list, places: dict | None = None) -> tuple[bool, float]:
    """Whether the region holds the item, and how much of it: COVERAGE of all its words in order, and ANSWER of its
    last quarter, where a question's answer stands. No more words can stand there in order than stand there at all: where
    those are too few, they are the share given."""
    share = sum(map(set(region).__contains__, item)) / len(item)
    if share < COVERAGE:
        return False, share
    share = lcs(item, region, places) / len(item)
    if share < COVERAGE:
        return False, share
    answer = item[-max(3, len(item) // 4) :]
    return lcs(answer, region) / len(answer) >= ANSWER, share


def _raw(text: str) -> bytes:
    """The same words with spaces between them, as UTF-8; ASCII signs and capitals are still in it."""
    if text.isascii():
        return text.encode()
    raw = text.lower().encode("utf-8", "surrogatepass")
    if APART.search(raw.translate(None, ASCII).decode("utf-8", "surrogatepass")):
        return " ".join(words_of(text)).encode("utf-8", "surrogatepass")
    return raw


def _cut(parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts as one string of words and spaces; how many words each part has; where each word starts and ends in the
    string; its first 8 bytes and the next 8, as numbers (0 where there are no more)."""
    raw = b" ".join([b"", *parts, b" " * 2 * HEAD]).translate(ASCII_LOWER)
    raw += b" " * (-len(raw) % 8)
    inside = np.frombuffer(raw, np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2].copy(), edges[1::2].copy()
    bounds = np.cumsum([1, *(len(x) + 1 for x in parts)])
    eights, at, shift = np.frombuffer(raw, "<u8"), start >> 3, ((start & 7) << 3).astype(np.uint64)
    first, second, third = eights[at], eights[at + 1], eights[at + 2]
    up = np.uint64(63) - shift
    low, high = (first >> shift) | (second << np.uint64(1) << up), (second >> shift) | (third << np.uint64(1) << up)
    bits = np.minimum(end - start, HEAD) << 3
    keep = np.array([(1 << k) - 1 for k in range(64)] + [(1 << 64) - 1] * 65, np.uint64)
    return raw, np.diff(np.searchsorted(start, bounds)), start, end, low & keep[bits], high & keep[np.maximum(bits - 64, 0)]


class Lookup:
    """A vocabulary that finds the words of many texts at once: each word's place in a table comes from its first HEAD
    bytes; words of one place stand one after the other and are compared in turn. Words with more bytes are looked up by
    all of them where one of the vocabulary begins alike."""

    def __init__(self, vocab: dict[str, int]):
        words = [w.encode("utf-8", "surrogatepass") for w in vocab]
        self.longer = {w: k for w, k in zip(words, vocab.values(), strict=True) if len(w) > HEAD}
        _, _, start, end, low, high = _cut(words)
        long = end - start > HEAD
        ids = np.where(long, -2, np.fromiter(vocab.values(), np.int64, len(vocab)))
        self.shift = np.uint64(64 - max(12, (8 * len(vocab)).bit_length()))
        slots = self._slots(low, high, long)
        order = np.argsort(slots, kind="stable")
        self.low, self.high, self.long, self.ids, slots = low[order], high[order], long[order], ids[order], slots[order]
        self.more = np.concatenate((slots[1:] == slots[:-1], [False]))  # whether the next one has the same place
        self.heads = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.heads[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]

    def _slots(self, low, high, long):
        return (((low + long) * P1 ^ high * P2) * P1 >> self.shift).astype(np.int64)

    def __call__(self, whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of all texts, one after the other (-1: not in the vocabulary); how many each text has."""
        raw, sizes, start, end, low, high = _cut([_raw(t) for t in whole])
        long = end - start > HEAD
        out = np.full(len(start), -1, np.int64)
        at = self.heads[self._slots(low, high, long)]
        left = np.flatnonzero(at >= 0)
        at = at[left]
        while len(left):
            same = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (self.long[at] == long[left])
            out[left[same]] = self.ids[at[same]]
            on = ~same & self.more[at]
            left, at = left[on], at[on] + 1
        for k in np.flatnonzero(out == -2).tolist():
            out[k] = self.longer.get(raw[start[k] : end[k]], -1)
        return out, sizes


def _stream(whole: list[str], lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (-1: in no item); where each text starts. WINDOW of -1 or more stand before and after each text,
    and texts start at multiples of STRIDE, so a text's windows hold its words alone and are the same whatever texts
    stand beside it."""
    found, sizes = lookup(whole)
    room = sizes + WINDOW + -sizes % STRIDE
    starts = WINDOW + np.cumsum(room) - room
    ids = np.full(WINDOW + int(room.sum()), -1, np.int64)
    ids[np.arange(len(found)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)] = found
    return ids, starts


def _blocks(ids: np.ndarray) -> np.ndarray:
    return np.concatenate((ids, np.full(-len(ids) % STRIDE, -1))).reshape(-1, STRIDE)


def _passages(blocks: np.ndarray, words: np.ndarray, times: int = 1) -> np.ndarray:
    """Every window, STRIDE apart, as the sum of its words' rows (the last row of ``words`` is for -1). Each word is
    looked up once, in its block of STRIDE words; windows are sums of neighbouring blocks. With times = 2 neighbouring
    windows are summed once more: all those that hold the block in the middle."""
    near = WINDOW // STRIDE
    n = max(0, len(blocks) - times * (near - 1))
    out = np.empty((n, words.shape[1]), words.dtype)
    for k in range(0, n, AT_ONCE):
        some = blocks[k : min(n, k + AT_ONCE) + times * (near - 1)]
        sums = words[some[:, 0]]
        for j in range(1, STRIDE):
            sums += words[some[:, j]]
        for _ in range(times):
            m = len(sums) - near + 1
            single, sums = sums, sums[:m].copy()
            for j in range(1, near):
                sums += single[j : m + j]
        out[k : k + AT_ONCE] = sums
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_counts(docs: DataFrame, vocab: dict[str, int]) -> tuple[np.ndarray, int, int]:
    """In how many documents each word of the items stands, over all documents; how many documents and words there are."""
    known = docs.sparkSession.sparkContext.broadcast(vocab)

    def count(frames):
        lookup, height = Lookup(known.value), len(known.value)
        have = np.zeros(height + 2, np.int64)
        for part in (part for pdf in frames for part in chunks(pdf, 2_000_000)):
            ids, sizes = lookup(part["text"].fillna("").tolist())
            both = np.sort((np.repeat(np.arange(len(sizes)) * height, sizes) + ids)[ids >= 0])  # text and word
            have[:height] += np.bincount(both[np.flatnonzero(np.diff(both, prepend=-1))] % height, minlength=height)
            have[height:] += len(part), len(ids)
        at = np.flatnonzero(have)
        yield pd.DataFrame({"word": at, "n": have[at]})

    sums = docs.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocab) + 2, np.int64)
    out[sums["word"].to_numpy(dtype=np.int64)] = sums["n"]
    return out[:-2], int(out[-2]), int(out[-1])


def passage_sums(docs: DataFrame, vocab: dict[str, int], idf: np.ndarray, onto: np.ndarray, n_tasks: int) -> np.ndarray:
    """A'(A onto), A being the TF-IDF passages of all documents. Tasks add up those of their documents; there are n_tasks
    at most, since what each gives is of the vocabulary's size, however few documents it has."""
    height, width = onto.shape
    given = docs.sparkSession.sparkContext.broadcast((vocab, np.concatenate((onto * idf[:, None], np.zeros((1, width))))))

    def add(frames):
        vocab, rows = given.value
        lookup = Lookup(vocab)
        total = np.zeros((height, width))
        for part in (part for pdf in frames for part in chunks(pdf, 2_000_000)):
            ids, _ = _stream(part["text"].fillna("").tolist(), lookup)
            around = _passages(_blocks(ids), rows, 2)  # begins with the windows around the fourth block; words stand after that
            at = np.flatnonzero(ids >= 0)
            at = at[np.argsort(ids[at].astype(np.uint16) if height <= 1 << 16 else ids[at], kind="stable")]  # each word's places are together; 16 bits sort faster
            low = np.flatnonzero(np.diff(ids[at], prepend=-1))
            block = at // STRIDE - WINDOW // STRIDE + 1
            for w, a, b in zip(ids[at[low]].tolist(), low.tolist(), [*low[1:].tolist(), len(at)], strict=False):
                total[w] += around.take(block[a:b], axis=0).sum(axis=0)
        total *= idf[:, None]
        for k in range(0, height, 256):
            if total[k : k + 256].any():
                yield pd.DataFrame({"slice": [k], "sums": [total[k : k + 256].tobytes()]})

    return sum_slices(docs.select("text").coalesce(n_tasks).mapInPandas(add, "slice long, sums binary"), height, width, n_tasks)


def latent_basis(docs: DataFrame, vocab: dict[str, int], idf: np.ndarray, items: list[np.ndarray], n_words: int = 0) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF passages, by a randomised SVD.

    The passages are those of all documents (of n_words words), and all items, which count for as much. One pass gives
    A'A times random vectors; the eigenvectors are those of the Nyström approximation of A'A, which needs no more of A.
    The driver gets words x (RANK + EXTRA) sums, bounded by the benchmark's words.
    """
    width = min(RANK + EXTRA, len(vocab))
    onto = np.linalg.qr(np.random.default_rng(3).normal(size=(len(vocab), width)))[0]
    own = np.zeros(onto.shape)  # the same of the items, each of length 1
    for ids in items:
        words, times = np.unique(ids, return_counts=True)
        x = times * idf[words]
        x /= max(np.linalg.norm(x), 1e-12)
        own[words] += x[:, None] * (x @ onto[words])
    found = passage_sums(docs, vocab, idf, onto, max(FIT_TASKS, n_words // (FIT_WORDS * len(vocab))))
    both = sum(z / max((onto * z).sum(), 1e-12) for z in (found, own))
    core = onto.T @ both
    values, turn = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-12 * values[-1]  # no passage and no item has a part in the other directions
    return np.linalg.svd(both @ (turn[:, kept] / np.sqrt(values[kept])), full_matrices=False)[0][:, :RANK]


def _verbatim(ids: np.ndarray, items: list[np.ndarray], anchors: np.ndarray):
    """(start, item) wherever the words of an item stand in ids one after the other; anchors: the place in each item of
    its rarest word, where the comparison begins."""
    wanted = np.array([i[a] for i, a in zip(items, anchors, strict=True)])
    marked = np.zeros(int(max(i.max() for i in items)) + 2, bool)  # the last one is for -1
    marked[wanted] = True
    at = np.flatnonzero(marked[np.where(ids < len(marked) - 1, ids, -1)])
    at = at[np.argsort(ids[at], kind="stable")]
    low, high = np.searchsorted(ids[at], wanted, side="left"), np.searchsorted(ids[at], wanted, side="right")
    for k, (item, anchor) in enumerate(zip(items, anchors, strict=True)):
        start = at[low[k] : high[k]] - anchor
        start = start[(start >= 0) & (start + len(item) <= len(ids))]
        for j, w in enumerate(item):
            if not len(start):
                break
            start = start[ids[start + j] == w]
        for s in start.tolist():
            yield s, k


def _search(docs: DataFrame, items: list[tuple[int, list[str]]]) -> DataFrame:
    """item_ids and coverage for each row of docs: one vocabulary, weighting and basis for all items, one pass."""
    items = sorted(items, key=lambda x: len(x[1]) < SHORT)  # short ones last: the latent search leaves them out
    vocab = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}))}
    ids = [np.array([vocab[w] for w in words]) for _, words in items]
    have, n, n_words = document_counts(docs, vocab)
    anchors = np.array([int(have[i].argmin()) for i in ids])
    long = [i for i in ids if len(i) >= SHORT]
    rows = latent = useful = None
    if long:
        idf, useful = np.zeros(len(vocab)), np.zeros(len(vocab) + 1, np.int8)
        own = np.unique(np.concatenate(long))
        idf[own], useful[own] = np.log((n + 1) / (have[own] + 0.5)), 1
        basis = latent_basis(docs, vocab, idf, long, n_words)
        latent = _unit(np.stack([(basis[i] * idf[i][:, None]).sum(axis=0) for i in long])).astype(np.float32)
        rows = np.concatenate((basis * idf[:, None], np.zeros((1, basis.shape[1])))).astype(np.float32)
    model = docs.sparkSession.sparkContext.broadcast((vocab, rows, latent, items, useful, ids, anchors))
    at_once = ITEMS_AT_ONCE

    def near(passages):
        """Passages and items whose cosine is COSINE or more."""
        latent = model.value[2]
        step = max(1, 20_000_000 // min(at_once, len(latent)))
        for k in range(0, len(passages), step):
            unit = _unit(passages[k : k + step])
            for m in range(0, len(latent), at_once):
                some = latent[m : m + at_once]
                p, i = np.divmod(np.flatnonzero(unit @ some.T >= COSINE), len(some))
                yield p + k, i + m

    def make():
        vocab, rows, latent, items, useful, item_ids, anchors = model.value
        lookup = Lookup(vocab)
        words_in = np.zeros((len(latent) if rows is not None else 0, len(vocab) + 1), bool)
        least = np.zeros(len(words_in))
        for k, own in enumerate(item_ids[: len(words_in)]):
            words_in[k, own], least[k] = True, DENSEST * COVERAGE * min(len(own), WINDOW - STRIDE)

        def held(blocks, p, i):
            """Those pairs of passages and items in which the passage has words enough of the item."""
            keep = np.zeros(len(p), bool)
            for k in range(0, len(p), 100_000):
                at, own = p[k : k + 100_000], i[k : k + 100_000]
                keep[k : k + 100_000] = sum(words_in[own[:, None], blocks[at + j]].sum(axis=1) for j in range(WINDOW // STRIDE)) >= least[own]
            return p[keep], i[keep]

        places_of = [masks(words) for _, words in items]

        def search(whole):
            ids, starts = _stream(whole, lookup)
            texts: dict[int, list[str]] = {}  # the words of those that are compared word by word
            hits: list[tuple] = []
            if rows is not None:
                blocks = _blocks(ids)
                known = useful[blocks].sum(axis=1)
                known = sum(known[j : len(known) - WINDOW // STRIDE + 1 + j] for j in range(WINDOW // STRIDE))
                which = np.flatnonzero(known >= LEAST)
                hits = [held(blocks, which[p], i) for p, i in near(_passages(blocks, rows)[which])]
            found: list[list[int]] = [[] for _ in whole]
            best = [0.0] * len(whole)
            for start, i in _verbatim(ids, item_ids, anchors):
                d = int(np.searchsorted(starts, start, side="right")) - 1
                found[d].append(items[i][0])
                best[d] = 1.0
            places_near: dict[tuple[int, int], list[int]] = {}
            for p, i in hits:
                at = p * STRIDE
                d = np.searchsorted(starts, at + WINDOW - 1, side="right") - 1  # a window may begin in the padding before its text
                for key in zip(d.tolist(), i.tolist(), (at - starts[d]).tolist(), strict=True):
                    places_near.setdefault(key[:2], []).append(key[2])
            for (d, i), places in places_near.items():
                item_id, words = items[i]
                if d not in texts:
                    texts[d] = words_of(whole[d])
                done = -WINDOW
                for place in places:  # ascending
                    if place < done:
                        continue
                    reach = len(words) + STRIDE
                    last = place + WINDOW
                    for q in places:  # windows that touch are one region, up to the length of an item more
                        if place <= q <= last and q - place <= len(words):
                            last = max(last, q + WINDOW)
                    region = texts[d][max(0, place - reach) : last + reach]
                    leak, share = is_leak(words, region, places_of[i])
                    if leak:
                        best[d] = max(best[d], share)
                        found[d].append(item_id)
                        break
                    done = last - WINDOW
            return [sorted(set(f)) for f in found], best

        return search

    return with_columns(docs, {"item_ids": "array<long>", "coverage": "double"}, make, 2_000_000)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds item_ids (benchmark items that the text holds, by id) and coverage (the largest share of a found item's
    words that stand there in order; 0 where none is found) to each row of docs (doc_id, text; other columns stay).

    Words are runs of letters, digits and _, in lower case. Items (item_id, text) without an id or without words are left
    out, repeated ones count once. Every item is found where its words stand one after the other, which is all that is
    looked for with fewer than SHORT words; longer ones are found by the latent search besides. Null and empty texts hold
    nothing, nor does any text where no items are left. Passages are windows of 32 words, 8 apart, of whole texts, the
    first with a text's first 8 words; those with fewer than LEAST words of items hold too little of any. Repeated rows and
    rows with null or repeated ids are looked at like others. The benchmark is broadcast; one of over MOST_ITEM_WORDS words
    is an error. Clashing columns are replaced.
    """
    given = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = given.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if size > MOST_ITEM_WORDS:
        raise ValueError(f"{size} words are too many for one benchmark: split it")
    items = [(int(r["item_id"]), w) for r in given.orderBy("item_id", "text").toLocalIterator() if (w := words_of(r["text"]))]
    if not items:
        return docs.withColumns({"item_ids": F.array().cast("array<long>"), "coverage": F.lit(0.0)})
    return _search(docs, items)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, coverage for every document."""
    found = contaminated(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "coverage")
