"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds by the language
that the language ID operator finds in a text."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import langid
from lexiloom.llm.common import crc_mod, labelled_texts, sigmoid, with_columns

WORD = re.compile(r"\w+")
DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
PREFIXES = (5, 4, 3)
LEAST_DOCS = 5
LANG_DOCS = 250
_MEMO_MAX = 300_000
def buckets(word: str) -> list[int]:
    """Hashed features of a word: itself and its first letters."""
    return [xxhash.xxh32_intdigest(word)] + [xxhash.xxh32_intdigest(word[:n], seed=n) if len(word) > n else -1 for n in PREFIXES]


class _Rows(dict):
    """first letters -> row of their hash"""

    def __init__(self, row_of: dict[int, int], seed: int):
        self.row_of, self.seed = row_of, seed

    def __missing__(self, start: str) -> int:
        row = self[start] = self.row_of.get(xxhash.xxh32_intdigest(start, seed=self.seed), 0)
        return row


class Words(dict):
    """word -> index of its embedding; 0 is the padding between texts."""

    def __init__(self, row_of: dict[int, int], vectors: np.ndarray):
        self.row_of, self.vectors = row_of, vectors
        self.five, self.four, self.three = (_Rows(row_of, n) for n in PREFIXES)
        self.rows, self.table = [(0, 0, 0, 0)], np.zeros((1, DIM), np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.rows)
        n, whole = len(word), self.row_of.get(xxhash.xxh32_intdigest(word), 0)
        self.rows.append((whole, self.five[word[:5]] if n > 5 else 0, self.four[word[:4]] if n > 4 else 0, self.three[word[:3]] if n > 3 else 0))
        return at

    def embedded(self) -> np.ndarray:
        if len(new := self.rows[len(self.table) :]):
            self.table = np.concatenate((self.table, self.vectors[np.array(new)].sum(axis=1)))
        return self.table


def _index(words: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of all texts, two paddings before each and at the end; where each text starts."""
    ids, starts, at = [], [], words.__getitem__
    for text in texts:
        starts.append(len(ids))
        ids += (0, 0)
        ids += map(at, WORD.findall(text.lower()))
    return np.array([*ids, 0, 0]), np.array(starts)


def _convolve(x: np.ndarray, model: dict) -> np.ndarray:
    """One row for each place: the values of all filters whose window starts there."""
    n = len(x) - 2
    all_at_once = x @ np.concatenate([part for w in model["w"] for part in w], axis=1)
    out, at = np.empty((n, FILTERS * len(WIDTHS)), np.float32), 0
    for k, w in enumerate(WIDTHS):
        own = out[:, k * FILTERS : (k + 1) * FILTERS]
        own[:] = all_at_once[:n, at : at + FILTERS]
        for j in range(1, w):
            own += all_at_once[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
        at += w * FILTERS
    return out


def _logits(model: dict, ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    most = np.maximum.reduceat(_convolve(table[ids], model), starts, axis=0)
    return np.maximum(most + model["b"], 0) @ model["out"] + model["bias"]


def text_langs(model: dict, texts: list[str]) -> list[str]:
    """The language of each text, by its letters alone; the same for all where none was learned."""
    if model["languages"] is None:
        return ["und"] * len(texts)
    return [x for k in range(0, len(texts), 256) for x in langid.predict(model["languages"], texts[k : k + 256])[0]]


def _threshold(logits: np.ndarray, y: np.ndarray) -> float | None:
    """The cut with the fewest errors, amid the widest gap that has so few; None where either class has under 8 rows."""
    if y.sum() < 8 or (1 - y).sum() < 8:
        return None
    order = np.argsort(logits, kind="stable")
    z, t = logits[order], y[order]
    errors = np.concatenate(([0], np.cumsum(t))) + (1 - t).sum() - np.concatenate(([0], np.cumsum(1 - t)))
    inner = np.arange(1, len(z))
    best = inner[errors[inner] == errors[inner].min()]
    k = best[np.argmax(z[best] - z[best - 1])]
    return float((z[k] + z[k - 1]) / 2)


def fit(rows: list[tuple[int, str, int]], languages: dict | None = None, epochs: int = 5, seed: int = 5) -> dict:
    """Trains on three quarters of (doc_id, text, label) rows, taken in the order given; the rest sets the thresholds: one
    for each language that the model ``languages`` finds in them, and one for all others."""
    rng = np.random.default_rng(seed)
    learn = [r for i, r in enumerate(rows) if i % 4]
    seen: dict[int, int] = {}
    for _, text, _ in learn:
        for b in {b for w in set(WORD.findall(text.lower())) for b in buckets(w)}:
            seen[b] = seen.get(b, 0) + 1
    row_of = {b: k + 1 for k, b in enumerate(sorted(b for b, n in seen.items() if n >= LEAST_DOCS and b >= 0))}
    vectors = rng.normal(0, 0.05, (len(row_of) + 1, DIM)).astype(np.float32)
    vectors[0] = 0
    n_out = FILTERS * len(WIDTHS)
    model = {
        "w": [[rng.normal(0, 0.3, (DIM, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS],
        "b": np.zeros(n_out, np.float32), "out": rng.normal(0, 0.3, n_out).astype(np.float32), "bias": np.float32(0),
    }
    words = Words(row_of, vectors)
    texts = [(_index(words, [t])[0], y) for _, t, y in learn]
    rows_of = np.array(words.rows)
    square = {"e": np.full(len(vectors), 0.01, np.float32)}
    weigh = {y: len(learn) / (2 * max(1, sum(r[2] == y for r in learn))) for y in (0, 1)}

    def step(name, value, grad, rate=0.05):
        square[name] = square.get(name, 0.01) + grad**2
        value -= rate * grad / np.sqrt(square[name])
        return value

    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 16)):
            if not len(batch):
                continue
            ids = np.concatenate([texts[i][0] for i in batch])
            starts = np.concatenate(([0], np.cumsum([len(texts[i][0]) for i in batch])[:-1]))
            y = np.array([texts[i][1] for i in batch])
            x = vectors[rows_of[ids]].sum(axis=1)
            conv = _convolve(x, model)
            ends = np.append(starts[1:], len(conv))
            top = np.stack([s + conv[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
            pooled = np.take_along_axis(conv, top, axis=0) + model["b"]
            hidden = np.maximum(pooled, 0)
            g = (sigmoid(hidden @ model["out"] + model["bias"]) - y) * np.array([weigh[v] for v in y]) / len(batch)
            gh = g[:, None] * model["out"] * (pooled > 0)
            model["out"] = step("out", model["out"], hidden.T @ g + 1e-4 * model["out"]).astype(np.float32)
            model["bias"] = np.float32(step("bias", model["bias"], g.sum()))
            model["b"] = step("b", model["b"], gh.sum(axis=0)).astype(np.float32)
            at, grads = [], []
            for k, w in enumerate(WIDTHS):
                gk, tk = gh[:, k * FILTERS : (k + 1) * FILTERS], top[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    at.append(ids[tk + j].ravel())
                    grads.append((gk[:, :, None] * model["w"][k][j].T[None]).reshape(-1, DIM))
                    model["w"][k][j] = step(f"w{k}{j}", model["w"][k][j], np.einsum("bf,bfd->df", gk, x[tk + j])).astype(np.float32)
            touched = rows_of[np.concatenate(at)]
            rows_hit, inverse = np.unique(touched.ravel(), return_inverse=True)
            sums = np.zeros((len(rows_hit), DIM))
            np.add.at(sums, inverse, np.repeat(np.concatenate(grads), rows_of.shape[1], axis=0))
            square["e"][rows_hit] += (sums**2).mean(axis=1)
            vectors[rows_hit] -= (0.1 * sums / np.sqrt(square["e"][rows_hit])[:, None]).astype(np.float32)
            vectors[0] = 0
    model |= {"row_of": row_of, "vectors": vectors, "languages": languages, "cut": {}, "cut_of_others": 0.0}
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    if held:
        words = Words(row_of, vectors)
        ids, starts = _index(words, [t for _, t, _ in held])
        logits, y = _logits(model, ids, starts, words.embedded()), np.array([r[2] for r in held])
        model["cut_of_others"] = _threshold(logits, y) or 0.0
        langs = np.array(text_langs(model, [t for _, t, _ in held]), dtype=object)
        for lang in sorted(set(langs)):
            own = _threshold(logits[langs == lang], y[langs == lang])
            if own is not None:
                model["cut"][lang] = own
    return model


def score_texts(model: dict, words: Words, texts: list[str]) -> np.ndarray:
    """1 / (1 + exp(cut of the text's language - logit)): 0.5 at that language's threshold."""
    ids, starts = _index(words, texts)
    cut = np.array([model["cut"].get(lang, model["cut_of_others"]) for lang in text_langs(model, texts)])
    return sigmoid(_logits(model, ids, starts, words.embedded()) - cut)


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = 2500, longest: int = 50_000, learn=None, keep_text: bool = True) -> DataFrame:
    """Scores every whole text of docs (doc_id, text; other columns stay) for toxicity.

    Adds score (0 to 1) and predicted (1 if score >= 0.5). Trained on at most about ``most`` labelled documents of
    each class (labels: doc_id, toxic), of ``longest`` code points at most each; the condition learn limits their
    ids. Where docs has a column lang, a language model is learned from it too (of at most about LANG_DOCS documents of each
    language that meet learn), and a text's predicted language picks its threshold; lang itself is no input of a score.
    Null texts count as empty; those have a score like any text without known words. Texts are scored whole, one very
    long one at a time (some 40 bytes a character). Repeated rows get equal scores; clashing columns are replaced.
    """
    learn = F.lit(True) if learn is None else learn
    rows = labelled_texts(docs, labels, "toxic", learn, most, 5, longest)
    known = langid.fit(langid.training_sample(docs, learn, LANG_DOCS, longest)) if "lang" in docs.columns else None
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, known))  # bounded by the samples

    def make():
        m = model.value
        words = Words(m["row_of"], m["vectors"])

        def score(texts):
            nonlocal words
            if len(words) > _MEMO_MAX:
                words = Words(m["row_of"], m["vectors"])
            scores = score_texts(m, words, texts)
            return scores, (scores >= 0.5).astype(np.int32)

        return score

    return with_columns(docs, {"score": "double", "predicted": "int"}, make, 1_000_000, keep_text)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 5 is 0), score, predicted for every document."""
    found = toxicity_scores(docs.select("doc_id", "text", "lang"), labels, learn=crc_mod("doc_id", 5) != 0, keep_text=False)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
