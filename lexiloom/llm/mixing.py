"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
_PARTS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """Adds size, the number of words of the text (0 for null), and key, a digest of source and text by which rows of one
    id, or without one, are told apart."""
    docs = docs.withColumn("key", F.md5(F.concat_ws("|", F.coalesce(F.octet_length("source"), F.lit(-1)), "source", F.coalesce(F.octet_length("text"), F.lit(-1)), "text").cast("binary")))
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sources: DataFrame) -> DataFrame:
    """Targets of sources (source, source_size): a row for each source, so small that windows over all of it do.

    Weights are WEIGHTS in turn, by the sources' code points with null last. The total of all sizes is shared by
    weight; no target exceeds MOST_COPIES times its source's size, and what is over goes to the others by weight.
    In order of limit / weight, the sources up to the first whose limit lies above its share are at their limits.
    Adds src (its place, from 0), weight and target.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_limit = W.orderBy("ratio", "src")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sources.withColumn("src", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int")).cast("long")
    )
    ranked = ranked.withColumn("cap", F.col("source_size") * MOST_COPIES).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = left.cast("double") / F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("total", total).withColumn("share", share)
    level = F.max(F.when(F.col("ratio") > F.col("share"), F.col("share"))).over(everything)
    return ranked.withColumn("target", F.when(F.col("ratio") <= F.col("share"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))).select(
        "source", "source_size", "src", "weight", "target", "total"
    )


def finish_times(docs: DataFrame, seed: int = 4) -> DataFrame:
    """doc_id, key, size, source_size, src, target, total, mark and through for each row of docs (doc_id, source, size, key).

    through: words of the source up to and with this document, in an order shuffled by mark, an md5 of seed and id (where
    that is null, of seed and key).
    The running sum has two steps, so that no window holds a whole source: sums of the 4096 parts that the first
    digits of mark give, then rows within a part.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), "key"))).cast("binary"))
    rows = docs.select("doc_id", "source", "size", "key", mark.alias("mark"))
    rows = materialise(rows.withColumn("part", F.conv(F.substring("mark", 1, 3), 16, 10).cast("int")), "mix-sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.part", "before", "t.*")
    within = W.partitionBy("src", "part").orderBy("mark", "doc_id", "size", "key").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.alias("r").join(parts.alias("q"), (F.col("r.part") == F.col("q.part")) & F.col("r.source").eqNullSafe(F.col("q.source")))
    joined = joined.select("doc_id", "size", "key", "mark", F.col("q.part").alias("part"), "before", "source_size", "src", "target", "total")
    return joined.withColumn("through", F.col("before") + F.sum("size").over(within)).drop("before", "part")


def _place(copy) -> list:
    """A copy's place in the queue: finish time first, then what tells equal ones apart."""
    finish = (F.col("through") + copy * F.col("source_size")) / F.col("target")
    return [finish.alias("finish"), F.col("src"), F.col("mark"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("size"), F.col("key"), copy.cast("int").alias("copy")]


def _last_place(rows: DataFrame):
    """The place of the last copy that the mix takes, as a struct; None if it takes none.

    In order of their places, copies are taken as long as the sum of sizes is within the total. The end is found by
    sums over ranges of finish times, refined once; only copies in the last range are sorted.
    """
    copies = rows.where(F.col("size") > 0).withColumn("copy", F.explode(F.array(*map(F.lit, range(MOST_COPIES)))))
    inside = copies.select(*_place(F.col("copy")), "total")
    low, width, used = 0.0, 4.0 / _PARTS, 0
    for _ in range(2):
        k = F.least(F.floor((F.col("finish") - low) / width), F.lit(_PARTS - 1))
        sums = inside.groupBy(k.alias("k")).agg(F.sum("size").alias("n"), F.max("total").alias("total"))
        ends = sums.withColumn("upto", F.sum("n").over(W.orderBy("k")) + used).where(F.col("upto") >= F.col("total"))
        end = ends.orderBy("k").first()
        if end is None:
            break
        inside, used = inside.where(k == end["k"]), end["upto"] - end["n"]
        if end["k"] == _PARTS - 1:  # whatever comes late is in one range
            break
        low, width = low + end["k"] * width, width / _PARTS
    names = [c for c in inside.columns if c != "total"]
    running = F.sum("size").over(W.orderBy(*names).rowsBetween(W.unboundedPreceding, 0)) + used
    last = inside.withColumn("upto", running).where(F.col("upto") <= F.col("total")).orderBy(*(F.desc(c) for c in names)).first()
    if last is None:  # the range's first copy is already too much: the place before it
        last = inside.orderBy(*names).first()
        return None if last is None else _literal(inside, last.asDict() | {"copy": -1})
    return _literal(inside, last.asDict())


def _literal(like: DataFrame, values: dict):
    return F.struct(*(F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in like.schema if f.name != "total"))


def scheduled(docs: DataFrame, seed: int = 4) -> DataFrame:
    """The rows of finish_times with copies (how many the mix takes, 0 to MOST_COPIES)."""
    rows = materialise(finish_times(docs, seed), "mix-finish")
    last = _last_place(rows)
    if last is None:
        return rows.withColumn("copies", F.lit(0))
    taken = [F.when((F.col("size") > 0) & (F.struct(*_place(F.lit(copy))) <= last), 1).otherwise(0) for copy in range(MOST_COPIES)]
    return rows.withColumn("copies", sum(taken[1:], taken[0]))


def mixed(docs: DataFrame, seed: int = 4) -> DataFrame:
    """The mix itself: rows of docs (doc_id, source, text, ...), each as often as it is taken, with copy (from 1) and
    finish, its virtual finish time, range-sorted by finish.

    Null texts and texts without words are never taken; where there are no words at all, nothing is. Null ids and
    sources are values of their own. Rows are told apart by id, source and text, so rows of one id, or without one, come
    as often as they themselves are taken. Rows equal in all three share what they are taken together: of m such rows
    the i-th, by the other columns, has every m-th place from the i-th on. Columns size, key, copy and finish are replaced.
    """
    own = sized(docs.drop("size", "key", "copy", "finish"))
    finish = (F.col("through") + (F.col("copy") - 1) * F.col("source_size")) / F.col("target")
    picked = scheduled(own, seed).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    picked = picked.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct(finish.alias("finish"), "copy"))).alias("_places"))
    picked = picked.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_places")
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    rows = own.where("size > 0").drop("size")
    # A place of a row that stands alone is its own; only rows that have equals are numbered, and only where there are any.
    repeated = own.where("size > 0").groupBy("doc_id", "key").agg(F.count("*").alias("_m")).where("_m > 1")
    repeated = materialise(repeated.select(F.col("doc_id").alias("_id2"), F.col("key").alias("_key2"), "_m"), "mix-repeated")
    both = rows.join(picked.hint("shuffle_hash"), same).drop("_id", "_key")
    if not repeated.isEmpty():
        twice = (F.col("key") == F.col("_key2")) & F.col("doc_id").eqNullSafe(F.col("_id2"))
        both = both.join(repeated, twice, "left").drop("_id2", "_key2")
        others = [c for c in docs.columns if c not in ("size", "key", "copy", "finish")]
        nth = F.row_number().over(W.partitionBy("doc_id", "key").orderBy(F.xxhash64(*others))) - 1
        alone, equal = both.where("_m is null"), both.where("_m is not null").withColumn("_nth", nth)
        every = F.filter("_places", lambda x, i: i % F.col("_m") == F.col("_nth"))
        both = alone.drop("_m").unionByName(equal.withColumn("_places", every).drop("_m", "_nth"))
    taken = both.withColumn("_place", F.explode("_places")).drop("_places", "key")
    return taken.withColumns({"copy": F.col("_place.copy"), "finish": F.col("_place.finish")}).drop("_place").orderBy("finish", "source", "doc_id", "copy")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) for every document."""
    rows = scheduled(sized(docs.select("doc_id", "source", "text")).drop("text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('4:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark
  FROM documents),
sources AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / CAST(weight AS DOUBLE) AS ratio FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src,
           [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM sized GROUP BY source)),
shared AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share
  FROM sources),
targets AS (
  SELECT source, source_size, src, total,
         CASE WHEN ratio <= share THEN CAST(cap AS DOUBLE)
              ELSE max(CASE WHEN ratio > share THEN share END) OVER () * weight END AS target
  FROM shared),
through AS (
  SELECT s.doc_id, s.size, s.mark, t.source_size, t.src, t.total, t.target,
         CAST(sum(s.size) OVER (PARTITION BY t.src ORDER BY s.mark, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS through
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CAST(through + copy * source_size AS DOUBLE) / target AS finish
  FROM through, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0),
running AS (
  SELECT doc_id, mark, size, total,
         sum(size) OVER (ORDER BY finish, src, mark, coalesce(doc_id, 0), size, copy ROWS UNBOUNDED PRECEDING) AS upto
  FROM copies),
kept AS (
  SELECT doc_id, sum(size) AS taken FROM running WHERE upto <= total GROUP BY doc_id)
SELECT t.doc_id, t.size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM through t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
