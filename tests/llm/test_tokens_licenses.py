import random

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm import license_scan as ls
from lexiloom.llm import token_counts as tc
from tests.llm.odd import none, odd, rows

BPE, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
OWN = Tokenizer.from_file(BPE)
FAST = tc.TokenCounter(BPE, RANKS, P.PATTERN)


def count(text):
    return len(OWN.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_counts_of_any_text(text):
    assert FAST(text) == count(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t'.,aZéßñ01—’“x\r!", max_size=120))
def test_counts_of_plain_text(text):
    assert FAST(text) == count(text)


def test_special_strings():
    for text in ("a<|endoftext|>b", "<|endoftext|>", "<|endoftext|", " x", "x" * 5000):
        assert FAST(text) == count(text)


def test_sentencepiece():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    assert tc.TokenCounter(path)("Hello there <s>") == len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello there <s>"))


def test_cache(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    first = tc.token_counts(odd(spark, "digest", "n_tokens", "of"), BPE, cache, RANKS, P.PATTERN).collect()
    texts = [r[1] or "" for r in rows()]
    assert sorted((r.n_bytes, r.n_tokens) for r in first) == sorted((len(t.encode()), count(t)) for t in texts)
    assert spark.read.parquet(cache).count() == len(set(texts))
    again = tc.token_counts(odd(spark), BPE, cache, RANKS, P.PATTERN).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and spark.read.parquet(cache).count() == len(set(texts))
    more = spark.createDataFrame([(1, "a new text"), (2, "word")], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens) for r in tc.token_counts(more, BPE, cache).collect()} == {(1, count("a new text")), (2, count("word"))}
    assert spark.read.parquet(cache).count() == len(set(texts)) + 1
    tc.token_counts(more, P.path("word_bpe_49k.json"), cache).count()  # another tokenizer has counts of its own
    assert spark.read.parquet(cache).count() == len(set(texts)) + 3
    assert tc.token_counts(none(spark), BPE).count() == 0


def test_rows_without_ids_and_with_clashing_ones(spark, tmp_path):
    """Null ids don't square rows, ids with several texts keep their counts, and each text is encoded once."""
    docs = [(None, f"text {k % 7}") for k in range(3_000)] + [(1, "a"), (1, "a b c"), (1, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    cache = str(tmp_path / "cache")
    got = tc.token_counts(df, BPE, cache).groupBy("doc_id", "n_bytes", "n_tokens").count().collect()
    want = {(None, 6, count("text 1")): 3_000, (1, 1, count("a")): 2, (1, 5, count("a b c")): 1}
    assert {(r.doc_id, r.n_bytes, r.n_tokens): r["count"] for r in got} == want
    assert spark.read.parquet(cache).count() == 9


def test_a_known_text_is_not_encoded(spark, tmp_path, monkeypatch):
    cache, df = str(tmp_path / "cache"), spark.createDataFrame([(1, "one"), (2, "two words")], "doc_id long, text string")
    first = sorted(map(tuple, tc.token_counts(df, BPE, cache).collect()))
    written = spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 100)
    written.write.parquet(cache + "-shifted")  # counts that only the cache can give
    assert [(i, b, n + 100) for i, b, n in first] == sorted(map(tuple, tc.token_counts(df, BPE, cache + "-shifted").collect()))
    monkeypatch.setattr(tc.metadata, "version", lambda name: "0.0")  # another version's counts aren't taken
    assert first == sorted(map(tuple, tc.token_counts(df, BPE, cache + "-shifted").collect()))


def test_alignment():
    assert ls.longest_increasing([3, 1, 2, 9, 4]) == [1, 2, 4] and ls.longest_increasing([]) == []
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        got = ls.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert ls.patience(list("xabcy"), list("abc")) == [(1, 0), (2, 1), (3, 2)]


def test_licenses(spark):
    filler = " ".join(f"word{k} the under" for k in range(300))
    docs = [(k, f"{filler}\n{t}\n{filler}" + (f"\n{t}" if k % 2 else "")) for k, t in enumerate(ls.TEMPLATES.values())]
    docs += [(100, ls.TEMPLATES["MIT"].replace("free of charge", "at no cost").replace("merge", "join")), (101, filler), (102, "the MIT License is released")]
    got = {r.doc_id: r for r in ls.query(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, name in enumerate(ls.TEMPLATES):
        assert got[k].license == name and got[k].coverage == 1
    assert got[100].license == "MIT" and 0.9 < got[100].coverage < 1 and got[101].license is None and got[102].license is None
    first = got[0]
    assert ls.words_of(docs[0][1])[first["first"] : first["last"] + 1] == ls.words_of(ls.TEMPLATES["Apache-2.0 notice"])


def test_noisy_templates_against_whole_alignment():
    """What an alignment of the noisy template alone covers well, a scan of a long text around it finds."""
    rng, own = random.Random(7), {name: ls.words_of(t) for name, t in ls.TEMPLATES.items()}
    common = ["the", "of", "and", "software", "license", "to", "copy"] + [f"f{k}" for k in range(200)]
    missed = tried = 0
    for _ in range(150):
        name = rng.choice(list(own))
        noisy = []
        for w in own[name]:
            u = rng.random()
            noisy += [w] if u > 0.09 else [] if u < 0.03 else ["other"] if u < 0.06 else [w, "more"]
        alone = ls.coverage(noisy, own[name])[0]
        before, after = ([rng.choice(common) for _ in range(rng.randrange(300))] for _ in range(2))
        if alone >= 0.8:
            tried += 1
            missed += name not in {x[0] for x in ls.scan(before + noisy + after, own, 0.75)}
        assert not ls.scan(before + after, own, 0.75)
    assert tried > 100 and missed <= 0.02 * tried


def test_odd_licenses(spark):
    found = ls.licenses(odd(spark, "found")).collect()
    assert len(found) == len(rows()) and all(r.found == [] for r in found)
    assert ls.query(none(spark)).count() == 0
    assert all(r.found == [] for r in ls.licenses(odd(spark), {"empty": " .. "}).collect())
