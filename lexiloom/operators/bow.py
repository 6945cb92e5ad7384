"""Words per document: tokens, counts, vocabulary, encoded documents, inverted index."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.store import kept
from lexiloom.functions.text import LONGEST_WORD, bucket, normalise, raw_words, words_of

MOST_ROWS = 100_000  # of a batch of counts, besides those of its last text


def tokens(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, word for each word of the text; the order of words is of no matter to anything here."""
    raw = df.select(ident, F.explode(raw_words(F.col(text))).alias("raw")).where("raw <> ''")
    return raw.select(ident, normalise(F.col("raw")).alias("word")).where(F.length("word").between(1, LONGEST_WORD))


def without(words: DataFrame, stop: DataFrame) -> DataFrame:
    """Drops the words of a stop list (column word). The optimiser broadcasts a list that is small."""
    return words.join(stop.select("word").distinct(), "word", "left_anti").select(*words.columns)


def only(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Keeps the words of a dictionary (column word)."""
    return words.join(dictionary.select("word").distinct(), "word", "left_semi").select(*words.columns)


def doc_terms(words: DataFrame, ident: str = "doc_id") -> DataFrame:
    return words.groupBy(ident, "word").agg(F.count("*").alias("cnt"))


def row_terms(df: DataFrame, ident: str = "doc_id", text: str = "text", places: bool = False, then=None, fields: str = "") -> DataFrame:
    """ident, word, cnt for each word of each row's text, counted where the row is: the same words as of tokens. places: and
    slot, the word's place (from 0) in the vocabulary order of the text's words, and total, how many words the text has.
    then: what is made of the batches, with these fields, before they leave Python."""

    def counted(batches):
        for batch in batches:
            texts, rows, words, cnts, slots, totals = batch.column(1).cast(pa.binary()), [], [], [], [], []
            for i, text in enumerate(texts):
                if (found := text.as_py()) is not None:
                    own = Counter(words_of(found))
                    if places:
                        order = sorted(own)
                        a, z = bisect_left(order, b"a"), bisect_left(order, b"{")
                        order = order[a:z] + order[:a] + order[z:]
                        words += order
                        cnts += map(own.__getitem__, order)
                        slots += range(len(order))
                        totals += [own.total()] * len(order)
                    else:
                        words += own.keys()
                        cnts += own.values()
                    rows += [i] * len(own)
                if len(words) >= MOST_ROWS or i == len(texts) - 1:
                    idents = batch.column(0).take(pa.array(rows, pa.int32()))
                    more = [pa.array(slots, pa.int32()), pa.array(totals, pa.int64())] if places else []
                    yield pa.record_batch([idents, pa.array(words, pa.binary()).cast(pa.string()), pa.array(cnts, pa.int64()), *more], names=names)
                    rows, words, cnts, slots, totals = [], [], [], [], []

    names = [ident, "word", "cnt"] + (["slot", "total"] if places else [])
    kind = df.select(ident).schema[0].dataType.simpleString()
    own = f"`{ident}` {kind}, word string, cnt long" + (", slot int, total long" if places else "")
    texts = df.select(ident, F.col(text).cast("string"))
    return texts.mapInArrow(lambda batches: then(counted(batches)), fields) if then else texts.mapInArrow(counted, own)


def text_terms(df: DataFrame, ident: str = "doc_id", text: str = "text", places: bool = False, then=None, fields: str = "") -> DataFrame:
    """doc_terms of the tokens of df; places, then, fields: see row_terms. A text is counted where it is read; counts are exchanged only if
    an ident is there more than once, which is looked up at once."""
    if df.groupBy(ident).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return row_terms(df, ident, text, places, then, fields)
    terms = row_terms(df, ident, text).groupBy(ident, "word").agg(F.sum("cnt").alias("cnt"))
    if not places:
        return terms.mapInArrow(then, fields) if then else terms
    last = (bucket(F.col("word")) == 26).cast("int")
    slot = F.row_number().over(W.partitionBy(ident).orderBy(last, "word")) - 1
    return terms.withColumn("slot", slot).withColumn("total", F.sum("cnt").over(W.partitionBy(ident)))


def doc_totals(terms: DataFrame) -> DataFrame:
    """doc_id (null: all documents), unique_words, total_words. Documents are summed before the grand total is."""
    return terms.rollup("doc_id").agg(F.count("*").alias("unique_words"), F.sum("cnt").alias("total_words"))


def ranked(df: DataFrame, order: list[Column], part: Column, name: str) -> DataFrame:
    """Numbers all rows from 0 by order, without one task seeing them all: ``part`` is a coarse key that rises with the
    order; rows are numbered within parts, and parts are offset by the counts of those before."""
    parted = df.withColumn("_part", part)
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parted.join(offsets, "_part").withColumn(name, F.col("_off") + within - 1).drop("_part", "_off")


def vocabulary(terms: DataFrame) -> DataFrame:
    """word_idx (from 0), word, df (documents that hold it), occ: words from a letter a-z first, each by bytes."""
    return vocabulary_of(terms.groupBy("word").agg(F.count("*").alias("df"), F.sum("cnt").alias("occ")))


def vocabulary_of(words: DataFrame) -> DataFrame:
    """Numbers words (word, df, occ) in vocabulary order."""
    words = kept(words, "words")
    last = (bucket(F.col("word")) == 26).cast("int")
    part = F.concat(last.cast("string"), F.substring("word", 1, 3))
    return ranked(words, [last, F.col("word")], part, "word_idx").select(F.col("word_idx").cast("int"), "word", "df", "occ")


def doc_matrix(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, slot (from 0, by word_idx), word_idx, cnt."""
    encoded = terms.join(vocab.select("word", "word_idx"), "word")
    slot = F.row_number().over(W.partitionBy("doc_id").orderBy("word_idx")) - 1
    return encoded.select("doc_id", slot.alias("slot"), "word_idx", "cnt")


def fixed_vocabulary(dictionary: DataFrame, terms: DataFrame) -> DataFrame:
    """word_idx, word, df, occ for every word of a dictionary (column word), be it in the documents or not."""
    found = terms.groupBy("word").agg(F.count("*").alias("df"), F.sum("cnt").alias("occ"))
    every = dictionary.select("word").distinct().join(found, "word", "left")
    none = F.lit(0).cast("long")
    return vocabulary_of(every.select("word", F.coalesce("df", none).alias("df"), F.coalesce("occ", none).alias("occ")))


def wanted_of(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, word_idx of those words (column word) that the vocabulary has."""
    return vocab.join(words.select("word").distinct(), "word").select("word", "word_idx")


def probe(index: DataFrame, words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, doc_id, slot: where the words (column word) stand, by an index of postings."""
    wanted = wanted_of(words, vocab)
    return index.join(wanted, "word_idx").select("word", F.explode("postings").alias("doc_id", "slot"))


def index_matrix(matrix: DataFrame, blocks: DataFrame) -> DataFrame:
    """prank, word_idx, occ, slots: each worker's index as a dense row for each of its words, one slot for each of its
    documents in order of id, -1 where the word isn't. blocks: doc_id, proc. As wide as a worker has documents: slots is text,
    with commas, put together from the word's postings and the runs of -1 between them."""
    place = F.row_number().over(W.partitionBy("proc").orderBy("doc_id")) - 1
    placed = kept(blocks.select("doc_id", "proc", place.alias("place")), "places")
    wide = placed.groupBy("proc").agg(F.count("*").cast("int").alias("wide"))  # a row for each worker
    grouped = matrix.join(placed, "doc_id").groupBy("proc", "word_idx").agg(
        F.sum("cnt").alias("occ"), F.sort_array(F.collect_list(F.struct("place", "slot"))).alias("at")
    )

    def after_gap(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("at"), i - 1)["place"], F.lit(-1))
        return F.concat(F.repeat(F.lit("-1,"), x["place"] - before - 1), x["slot"].cast("string"))

    rest = F.repeat(F.lit(",-1"), F.col("wide") - F.element_at("at", -1)["place"] - 1)
    slots = F.concat(F.array_join(F.transform("at", after_gap), ","), rest)
    return grouped.join(F.broadcast(wide), "proc").select(F.col("proc").alias("prank"), "word_idx", "occ", slots.alias("slots"))


def inverted_index(matrix: DataFrame, word: str = "word_idx") -> DataFrame:
    """word_idx, occ, df, postings (doc_id -> slot); word: the column that has the words. A word in very many documents has a long row: use matrix itself,
    partitioned by word_idx, where that matters."""
    pairs = F.sort_array(F.collect_list(F.struct("doc_id", "slot")))
    grouped = matrix.groupBy(word).agg(F.sum("cnt").alias("occ"), F.count("*").alias("df"), F.map_from_entries(pairs).alias("postings"))
    return grouped.select(word, "occ", "df", "postings")


def vocabulary_union(*words: DataFrame) -> DataFrame:
    """The distinct words of several corpora."""
    out = words[0].select("word").distinct()
    for w in words[1:]:
        out = out.union(w.select("word").distinct())
    return out.distinct()
