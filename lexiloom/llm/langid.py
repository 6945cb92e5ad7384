"""Language ID in two steps: the language family first, then the language within it, each by one-versus-one linear SVMs."""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import FINE, crc_mod, sigmoid, with_columns

BITS = 14
POWER = 0.9
# Language families by ISO 639-1 code. A language that is missing here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "dravidian": "kn ml ta te",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms su tl",
    "sinitic": "zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Damped counts of hashed letter 1- to 3-grams, each row of length 1; whether a text has letters."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    letter = _letters()[points]
    c = np.where(letter, points, 0).astype(np.uint32)
    b = np.concatenate(([np.uint32(0)], c[:-1]))  # each text starts after a \0
    a = np.concatenate(([np.uint32(0)], b[:-1])) * (b != 0)
    used = (c != 0) | (b != 0)
    a, b, c, of_used = a[used], b[used], c[used], of[used].astype(np.int64) << BITS
    shift = np.uint32(32 - BITS)
    two = (b * np.uint32(0x85EBCA6B) + c + np.uint32(1)) * np.uint32(0x9E3779B1)
    three = ((a * np.uint32(0xC2B2AE35) + b) * np.uint32(0x85EBCA6B) + c + np.uint32(7)) * np.uint32(0x27D4EB2F)
    one = ((c + np.uint32(13)) * np.uint32(0x165667B1))[c != 0]
    keys = np.concatenate((of_used + (two >> shift), of_used + (three >> shift), of_used[c != 0] + (one >> shift)))
    x = np.bincount(keys, minlength=len(low) << BITS).astype(np.float32).reshape(len(low), 1 << BITS) ** POWER
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x, np.bincount(of[letter], minlength=len(low)) > 0


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, regular: float = 1e-4) -> np.ndarray:
    """A linear SVM by averaged stochastic subgradient steps (Pegasos); rows are sparse, y is 1 or -1, classes weigh alike."""
    w, total, step = np.zeros(1 << BITS), np.zeros(1 << BITS), 0
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (1, -1)}
    scale, n_avg = 1.0, 0
    order = np.random.default_rng(1)
    for epoch in range(epochs):
        for i in order.permutation(len(rows)):
            step += 1
            eta = 1.0 / (regular * (step + 1.0 / regular))
            at, x = rows[i]
            margin = y[i] * scale * (w[at] @ x)
            scale *= 1 - eta * regular
            if margin < 1:
                w[at] += eta * share[y[i]] * y[i] * x / scale
        if epoch >= epochs // 2:
            total += w * scale
            n_avg += 1
    return (total / max(1, n_avg)).astype(np.float32)


def fit(samples: list[tuple[str, str]]) -> dict:
    """The model of (text, lang) rows: families, their languages and one SVM for each pair at either level."""
    samples = [(t, lang) for t, lang in samples if any(map(str.isalpha, t))]
    rows, langs = [], np.array([lang for _, lang in samples], dtype=object)
    for k in range(0, len(samples), 64):
        for x in gram_counts([t for t, _ in samples[k : k + 64]])[0]:
            at = np.flatnonzero(x)
            rows.append((at, x[at]))
    families = np.array([family_of(x) for x in langs], dtype=object)
    groups = {"": sorted(set(families))} | {f: sorted(set(langs[families == f])) for f in sorted(set(families))}
    pairs, weights = [], []
    for group, members in groups.items():
        names = families if group == "" else langs
        for p, q in itertools.combinations(members, 2):
            of = np.flatnonzero((names == p) | (names == q)) if group == "" else np.flatnonzero((families == group) & ((names == p) | (names == q)))
            pairs.append((group, p, q))
            weights.append(_svm([rows[i] for i in of], np.where(names[of] == p, 1, -1)))
    return {"groups": groups, "pairs": pairs, "weights": np.stack(weights, axis=1) if weights else np.zeros((1 << BITS, 0), np.float32)}


def _winners(model: dict, group: str, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the member of the group with the most votes (ties: the larger sum of margins), and how sure that is."""
    members = model["groups"][group]
    votes = np.zeros((len(margins), len(members)))
    sums = np.zeros_like(votes)
    least = np.ones_like(votes) * np.inf
    for k, (g, p, q) in enumerate(model["pairs"]):
        if g == group:
            for name, m in ((p, margins[:, k]), (q, -margins[:, k])):
                j = members.index(name)
                votes[:, j] += m > 0
                sums[:, j] += m
                least[:, j] = np.minimum(least[:, j], m)
    best = np.argmax(votes + 0.4 * np.tanh(sums / max(1, len(members))), axis=1)
    return best, sigmoid(4 * least[np.arange(len(best)), best])


def predict(model: dict, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 where there are no letters or nothing was learned."""
    x, has = gram_counts(texts)
    margins = x @ model["weights"]
    out, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    if not model["groups"][""]:
        return list(out), score
    family, sure = _winners(model, "", margins)
    for f, name in enumerate(model["groups"][""]):
        if len(of := np.flatnonzero((family == f) & has)):
            best, within = _winners(model, name, margins[of])
            out[of] = np.array(model["groups"][name], dtype=object)[best]
            score[of] = sure[of] * within
    return list(out), score


def training_sample(docs: DataFrame, learn, most: int, longest: int) -> list[tuple[str, str]]:
    """About ``most`` documents of each language at most, chosen by a hash of doc_id; in an order that reruns repeat."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest) & learn).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count()  # a row for each language
    known = known.join(F.broadcast(sizes.select("lang", (F.lit(float(FINE) * most) / F.col("count")).alias("below"))), "lang")
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FINE)) < F.col("below")).select("doc_id", "text", "lang").toPandas()
    picked = picked.sort_values(["doc_id", "lang", "text"])
    return list(zip(picked["text"], picked["lang"], strict=True))


def languages(docs: DataFrame, most: int = 500, longest: int = 50_000, learn=None, keep_text: bool = True) -> DataFrame:
    """Predicts the language of every whole text of docs (doc_id, text, lang; other columns stay).

    Adds lang_pred and score (0 to 1). Learns from about ``most`` documents of each language at most, of ``longest``
    code points at most each; the condition learn limits them. Null texts and those without letters give ``und``
    and 0, and so does everything where no language is given. Repeated rows get equal results; clashing columns are
    replaced.
    """
    fitted = fit(training_sample(docs, F.lit(True) if learn is None else learn, most, longest))
    model = docs.sparkSession.sparkContext.broadcast(fitted)  # 64 kB for each pair of families, or of languages in one

    def make():
        def run(texts):
            found = [predict(model.value, texts[k : k + 256]) for k in range(0, len(texts), 256)]
            return [x for f in found for x in f[0]], np.concatenate([f[1] for f in found])

        return run

    return with_columns(docs, {"lang_pred": "string", "score": "double"}, make, 1_000_000, keep_text)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 4 is 2), lang_pred, score for every document."""
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    found = languages(docs.select("doc_id", "text", "lang"), learn=crc_mod("doc_id", 4) != 2, keep_text=False)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
