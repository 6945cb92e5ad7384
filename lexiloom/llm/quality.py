"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import re
from array import array

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import crc_mod, labelled_texts, sigmoid, with_columns

BITS = 20
WORD = re.compile(r"\w+|[^\w\s]+")
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MEMO_MAX = 500_000


def _shape(word: str) -> str:
    if word.isdigit():
        return "digits"
    if not word[0].isalnum() and word[0] != "_":
        return "sign:" + word[:3]
    kind = "lower" if word.islower() else "upper" if word.isupper() and len(word) > 1 else "title" if word.istitle() else "mixed"
    return f"{kind}:{min(len(word) // 4, 5)}"


class _Memo(dict):
    """word -> index of its two hashes; emptied now and then, so that it stays small."""

    def __init__(self):
        self.words, self.shapes = array("Q"), array("Q")

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.words)
        self.words.append(xxhash.xxh64_intdigest(word))
        self.shapes.append(xxhash.xxh64_intdigest(_shape(word), seed=1))
        return at


class NGramHasher:
    """Texts to hashed n-grams: words alone and in pairs, and pairs and triples of word shapes."""

    def __init__(self, bits: int = BITS):
        self.shift, self.memo = np.uint64(64 - bits), _Memo()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts, one after the other, and where each text ends."""
        if len(self.memo) > _MEMO_MAX:
            self.memo = _Memo()
        index = self.memo.__getitem__
        words, ends = [], []
        for text in texts:
            words += map(index, WORD.findall(text))
            ends.append(len(words))
        if not words:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        word, shape = (np.frombuffer(x, dtype=np.uint64)[words] for x in (self.memo.words, self.memo.shapes))
        ends = np.array(ends)
        first = np.zeros(len(words), bool)
        first[ends[:-1][ends[:-1] < len(words)]] = True
        first[0] = True
        edge = np.where(first, np.uint64(0), np.uint64(1))
        before = np.concatenate(([np.uint64(0)], word[:-1])) * edge
        sbefore = np.concatenate(([np.uint64(0)], shape[:-1])) * edge
        pair = sbefore * _P2 + shape
        triple = (np.concatenate(([np.uint64(0)], pair[:-1])) * edge) * _P3 + shape
        found = np.stack([word * _P1, (before * _P2 + word) * _P1, (pair ^ _P2) * _P1, (triple ^ _P3) * _P1], axis=1)
        return (found >> self.shift).astype(np.int64).ravel(), 4 * ends


def _segments(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


class Ftrl:
    """Logistic regression with per-coordinate FTRL-proximal steps and L1 and L2 terms."""

    def __init__(self, bits: int = BITS, alpha=0.3, beta=1.0, l1=0.02, l2=0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.zb, self.nb = 0.0, 0.0

    def weights(self, at):
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.zb / ((self.beta + self.nb**0.5) / self.alpha)

    def learn(self, at, x, y, weight=1.0) -> None:
        w, b = self.weights(at), self.bias
        g = weight * (sigmoid(w @ x + b) - y)
        for_each = g * x
        self.z[at] += for_each - (np.sqrt(self.n[at] + for_each**2) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += for_each**2
        self.zb += g - ((self.nb + g * g) ** 0.5 - self.nb**0.5) / self.alpha * b
        self.nb += g * g


def fit(rows: list[tuple[int, str, int]], bits: int = BITS, epochs: int = 2) -> tuple[np.ndarray, float]:
    """Weights and bias from (doc_id, text, label) rows, taken in the order given. No rows: all weights 0."""
    model, hasher = Ftrl(bits), NGramHasher(bits)
    examples = []
    for _, text, y in rows:
        at, counts = np.unique(hasher([text])[0], return_counts=True)
        examples.append((at, counts / max(1.0, counts.sum()) ** 0.5, y))
    for _ in range(epochs):
        for at, x, y in examples:
            model.learn(at, x, y)
    return model.weights(slice(None)).astype(np.float32), model.bias


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = 3000, longest: int = 100_000, learn=None, keep_text: bool = True) -> DataFrame:
    """Scores every whole text of docs (doc_id, text; other columns stay) for quality.

    Adds score (0 to 1) and predicted (1 if score >= 0.5). Trained on at most about ``most`` labelled documents of
    each class (labels: doc_id, quality), of ``longest`` code points at most each; the condition learn limits
    their ids. Null and empty texts are scored by the bias alone; without labels every score is 0.5. Repeated rows
    get equal scores; clashing columns are replaced.
    """
    learn = F.lit(True) if learn is None else learn
    weights, bias = fit(labelled_texts(docs, labels, "quality", learn, most, 10, longest))
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 4 MB, whatever the input

    def make():
        weights, bias = model.value
        hasher = NGramHasher()

        def score(texts):
            hashes, ends = hasher(texts)
            sizes = np.diff(np.concatenate(([0], ends)))
            scores = sigmoid(_segments(weights[hashes], ends) / np.sqrt(np.maximum(sizes, 1)) + bias)
            return scores, (scores >= 0.5).astype(np.int32)

        return score

    return with_columns(docs, {"score": "double", "predicted": "int"}, make, 4_000_000, keep_text)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 3 is 1), score, predicted for every document."""
    found = quality_scores(docs.select("doc_id", "text"), labels, learn=crc_mod("doc_id", 3) != 1, keep_text=False)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
