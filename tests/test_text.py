import pytest

from lexiloom.functions.text import bucket
from lexiloom.operators import bow
from pyspark.sql import functions as F

CASES = {
    '"Hello,': "hello", "mother-in-law": "mother", "don't": "don't", "don’t": "don't", "naïve": "na'e", "été": "t", "[note]": "[note]", "a\tb": "a\tb",
    "2017": "2017", "a.b": "a", "x" * 27: "x" * 27, "Été.fin": "t",
}


@pytest.mark.parametrize("dropped", ["—", "...", "x" * 28, ""])
def test_dropped(spark, dropped):
    df = spark.createDataFrame([(1, dropped)], "doc_id long, text string")
    assert bow.tokens(df).count() == 0


def test_normalised(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: r["word"] for r in bow.tokens(df).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_bucket(spark):
    df = spark.createDataFrame([("a",), ("z1",), ("{",), ("'t",), ("9",)], "word string")
    assert [r[0] for r in df.select(bucket(F.col("word"))).collect()] == [0, 25, 26, 26, 26]
