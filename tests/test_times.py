from conftest import rows
from pyspark.sql import functions as F

from millrace.functions.times import clean_hash, parse_time, utc_text


def test_spellings_of_one_moment(spark):
    texts = ["2026-01-07T19:43:19Z", "2026-01-07 19:43:19", "2026-01-07T20:43:19+01:00", "2026-01-07T16:43:19-0300", "20260107T194319Z", "1767814999", "1767814999000", "2026-01-07T19:43:19.000000+00:00", " 2026-01-07T19:43:19Z "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(utc_text(parse_time("t")).alias("t")).distinct()
    assert rows(df) == [("2026-01-07T19:43:19Z",)]


def test_no_time_is_null(spark):
    df = spark.createDataFrame([(None,), ("",), ("soon",), ("12",), ("2026-13-45T99:99:99Z",)], "t string").select(parse_time("t").alias("t"))
    assert [r["t"] for r in df.collect()] == [None] * 5


def test_day_alone_is_midnight_utc(spark):
    assert spark.createDataFrame([("2026-02-03",)], "t string").select(utc_text(parse_time("t"))).first()[0] == "2026-02-03T00:00:00Z"


def test_hash_spellings(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(h,), (h.upper(),), ("sha256:" + h,), (" SHA-256: " + h,)], "h string").select(clean_hash("h").alias("h")).distinct()
    assert rows(df) == [(h,)]
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("ab",)], "h string").select(clean_hash(F.col("h"))).collect()] == [None] * 3
