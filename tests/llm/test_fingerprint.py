import hashlib
import random
from collections import Counter

import numpy as np

from lexiloom.llm import fingerprint as f
from tests.llm.odd import none, odd, rows


def test_repetition_and_hashes():
    data = np.frombuffer(random.Random(1).randbytes(300) + b"abab" * 30, np.uint8)
    want = [sum(c * (c - 1) // 2 for c in Counter(data[i : i + f.WINDOW].tolist()).values()) for i in range(len(data) - f.WINDOW + 1)]
    assert f.repetition(data).tolist() == want
    hashes = f.window_hashes(data)
    assert hashes[10] == f.window_hashes(data[10 : 10 + f.WINDOW])[0] and len(set(hashes[:280].tolist())) == 280


def test_features_against_brute_force():
    """Every run of windows, one by one, picks the window of the rarest entropy; those picked often enough are features."""
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(60))
    for text in (prose, prose + "=" * 60 + prose[:90], "ab" * 40, "0123456789abcdefghij", "seventeen letters"):
        data = text.encode()
        windows = [data[i : i + f.WINDOW] for i in range(len(data) - f.WINDOW + 1)]
        pairs = [sum(c * (c - 1) // 2 for c in Counter(w).values()) for w in windows]
        common = [f.PROSE[r] if r < len(f.PROSE) else 10**9 for r in pairs]
        hashes = [int(f.window_hashes(np.frombuffer(w, np.uint8))[0]) for w in windows]
        picked = Counter()
        for i in range(1 - f.NEAR, len(windows)):
            run = range(max(0, i), min(len(windows), i + f.NEAR))
            picked[min(run, key=lambda k: (common[k], hashes[k] >> 24))] += 1
        assert len(f.features(data)) <= sum(n >= f.OFTEN for n in picked.values()) and len(f.features(data)) > 0
        want = [((int(f._RANK[min(pairs[k], len(f.PROSE))]) << 40 | hashes[k] >> 24) * int(f._M)) % 2**64 for k in sorted(picked) if picked[k] >= f.OFTEN]
        assert set(f.features(data).tolist()) == set(want)


def test_likeness_by_hand():
    a, b = (np.zeros((1, f.BITS // 64), np.uint64) for _ in range(2))
    a[0, :4], b[0, 2:6] = 2**64 - 1, 2**64 - 1  # 256 bits each, 128 in common
    chance = 256 * 256 / f.BITS
    assert abs(f.likeness(a, b) - (128 - chance) / (256 - chance)) < 1e-12 and f.likeness(a, a.copy()) == 1
    empty = np.zeros((1, f.BITS // 64), np.uint64)
    empty[0, 9] = 1
    assert f.likeness(a, empty) == 0


def test_likeness_follows_overlap():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(900))
    other = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(900))
    of = lambda t: f.chain(f.features(t.encode()))
    half = f.edited(text, other)
    assert f.likeness(of(text), of(text)) == 1 and 0.35 < f.likeness(of(text), of(half)) < 0.7 and f.likeness(of(text), of(other)) < 0.1
    assert f.likeness(of(""), of("")) == 1 and f.likeness(of(""), of("abc")) == 0
    assert f.likeness(of(text), of(half)) == f.likeness(of(half), of(text))


def by_hand(docs):
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 2
        e = (t[: len(t) - n] + after[:n]).encode()
        a = f.features(t.encode())
        out.append((i, len(t), hashlib.sha256(e).hexdigest(), f.to_string(f.chain(a), len(a)), f.likeness(f.chain(a), f.chain(f.features(after.encode())))))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in f.query(df).collect()), key=repr)


def test_next_document(spark, monkeypatch):
    docs = [(r[0], r[1]) for r in rows()]
    assert found(odd(spark, "part", "id")) == by_hand(docs)
    monkeypatch.setattr(f, "ROWS_A_PART", 2)
    assert found(odd(spark)) == by_hand(docs)
    assert f.query(none(spark)).count() == 0
    one = spark.createDataFrame([(1, "only one text")], "doc_id long, text string")
    assert found(one) == by_hand([(1, "only one text")])


def test_operator_keeps_columns(spark):
    got = f.fingerprints(odd(spark, "fingerprint", "mine")).collect()
    assert len(got) == len(rows()) and all(r.mine == "theirs" for r in got) and {r.fingerprint for r in got if not r.text} == {"0:"}
