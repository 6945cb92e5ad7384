import duckdb
from pyspark.sql import functions as F

from lexiloom.llm import mixing
from tests.llm.odd import none, odd, rows


def by_hand(sizes, weights):
    """Shares by weight; what is over a source's limit goes round again."""
    total, limit, target, open_ = sum(sizes), [3 * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > limit[i]}
        for i in over or open_:
            target[i] = float(limit[i]) if over else share[i]
        open_ -= over or set(open_)
    return target


def test_targets(spark):
    for sizes in ([100, 10, 10, 10], [5, 0, 900], [10, 1000, 1000, 3], [7], [0, 0]):
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in mixing.source_targets(df).orderBy("source").collect()]
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, by_hand(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])))


def test_odd(spark):
    found = mixing.query(odd(spark)).collect()
    assert len(found) == len(rows()) and all(0 <= r.taken <= 3 * r["size"] for r in found) and all(r.taken % max(1, r["size"]) == 0 for r in found)
    assert sum(r.taken for r in found) <= sum(r["size"] for r in found)
    again = mixing.query(odd(spark).repartition(5)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    assert mixing.query(none(spark)).count() == 0 and mixing.mixed(none(spark)).count() == 0


def test_mix_has_the_copies_that_are_counted(spark):
    docs = odd(spark, "size", "copy", "finish", "mark")
    mix = mixing.mixed(docs).collect()
    words = sum(len((r.text or "").encode().split()) for r in mix)
    assert words == sum(r.taken for r in mixing.query(odd(spark)).collect()) and all(r.mark == "theirs" and 1 <= r.copy <= 3 for r in mix)
    assert [r.finish for r in mix] == sorted(r.finish for r in mix)


def test_near_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 17), f"s{min(i % 10, 4)}") for i in range(3000)], "doc_id long, text string, source string")
    rows_ = mixing.scheduled(mixing.sized(docs)).selectExpr("src", "target", "copies * size as taken").groupBy("src", "target").sum("taken").collect()
    assert all(abs(r[2] - r.target) <= 40 for r in rows_)


def test_oracle(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 13), f"s{i % 5}" if i % 7 else None) for i in range(500)], "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    theirs = con.execute(mixing.ORACLE)
    names = [d[0] for d in theirs.description]
    assert sorted(tuple(r[c] for c in names) for r in mixing.query(docs).collect()) == sorted(theirs.fetchall())


def test_rows_are_told_apart_by_their_texts(spark):
    """Ids that repeat or are null, in two sources and with equal sizes: each row comes as often as itself is taken."""
    docs = [(i % 5 if i % 3 else None, f"word{i} two three", f"s{i % 2}") for i in range(300)]
    docs += [(7, "the same text", "s0")] * 4 + [(None, "same text too", "s1")] * 3
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(docs)], "doc_id long, text string, source string, other long")
    mix = mixing.mixed(df.repartition(3)).collect()
    taken = {}
    for r in mixing.scheduled(mixing.sized(df)).collect():
        taken.setdefault((r.doc_id, r.key), []).append(r.copies)
    keys = {(r.doc_id, r.text, r.source): r.key for r in mixing.sized(df).collect()}
    got = {}
    for r in mix:
        at = r.doc_id, keys[r.doc_id, r.text, r.source]
        got[at] = got.get(at, 0) + 1
    assert got == {k: sum(v) for k, v in taken.items() if sum(v)} and all(r.copy <= 3 for r in mix)
    assert len({(r.doc_id, r.text, r.source, r.finish, r.copy) for r in mix if r.text not in ("the same text", "same text too")}) == len([r for r in mix if r.text not in ("the same text", "same text too")])
    again = mixing.mixed(df.repartition(5)).collect()
    assert sorted(map(repr, mix)) == sorted(map(repr, again))


def test_many_rows_without_ids(spark):
    df = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a text "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    mix = mixing.mixed(df)
    assert mix.count() == 10_000 and mix.select("text").distinct().count() == 10_000
