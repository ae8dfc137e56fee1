"""CSV and text endpoints with awkward values."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampNTZType

from grainwise.sources.io import read_csv, write_csv, write_labelling_text
from grainwise.sources.schemas import MARKETPLACE

SCHEMA = StructType(
    [StructField("id", IntegerType()), StructField("t", StringType()), StructField("ts", TimestampNTZType())]
)


def test_text_survives_a_roundtrip(spark, tmp_path):
    texts = ['two\nlines', 'say ""hi""', '"', " padded ", "a,b;c", "back\\slash", "no break", "tail\\", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    write_csv(df, str(tmp_path / "out"))
    got = {r.id: r.t for r in read_csv(spark, str(tmp_path / "out"), SCHEMA).collect()}
    assert got == dict(enumerate(texts))


def test_bad_timestamps_null_one_field(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,t,ts\n1,"a ""quoted""\nline",2018-01-02 03:04:05\n2,b,not a date\n3,c,\n')
    got = [(r.id, r.t, str(r.ts)) for r in read_csv(spark, str(path), SCHEMA).orderBy("id").collect()]
    assert got == [(1, 'a "quoted"\nline', "2018-01-02 03:04:05"), (2, "b", "None"), (3, "c", "None")]


def test_labelling_text(spark, tmp_path):
    df = spark.createDataFrame([(0, "first text"), (1, "second")], "idx int, text string").coalesce(1)
    write_labelling_text(df, str(tmp_path / "txt"))
    written = "".join(open(p).read() for p in glob.glob(str(tmp_path / "txt" / "part-*")))
    assert written == "0\tfirst text\n1\tsecond\n"


def test_declared_shapes():
    assert {n: len(s.fields) for n, s in MARKETPLACE.items()} == {
        "orders": 8, "order_items": 7, "order_payments": 5, "order_reviews": 7, "products": 9,
        "sellers": 4, "customers": 5, "geolocation": 5, "category_translation": 2,
    }
