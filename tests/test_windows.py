"""Sliced windows equal plain windows, whatever the slice and however hot the key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from portolan.operators import rank


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(9)
    rows = [(i, "hot" if i % 3 else rnd.choice("abc"), rnd.randrange(5000), float(rnd.randrange(100))) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id int, key string, s int, value double")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s").cache()


def same(a, b, *cols):
    pick = lambda df: sorted(tuple(r) for r in df.select("event_id", *cols).collect())
    assert pick(a) == pick(b)


@pytest.mark.parametrize("n, slice_seconds", [(1, 100), (3, 7), (10, 60), (10, 100000)])
def test_rolling(series, n, slice_seconds):
    w = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(-(n - 1), 0)
    got = rank.rolling(series, ["key"], ["ts", "event_id"], "ts", n, {"c": F.count("*"), "s": F.sum("value")}, slice_seconds)
    same(got, series.select("*", F.count("*").over(w).alias("c"), F.sum("value").over(w).alias("s")), "c", "s")


@pytest.mark.parametrize("slice_seconds", [7, 500, 100000])
def test_next_row(series, slice_seconds):
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    got = rank.next_row(series, ["key"], ["ts", "event_id"], "ts", {"after": "event_id"}, slice_seconds)
    same(got, series.withColumn("after", F.lead("event_id").over(w)), "after")


def test_trailing(series):
    w = Window.partitionBy("key").orderBy(F.col("ts").cast("long")).rangeBetween(-59, 0)
    same(rank.trailing_count(series, ["key"], "ts", 60, "c"), series.withColumn("c", F.count("*").over(w)), "c")


def test_dense_trailing(series, monkeypatch):
    """Frames that hold too many rows are cut into shorter slices."""
    w = Window.partitionBy("key").orderBy(F.col("ts").cast("long")).rangeBetween(-1999, 0)
    want = series.withColumn("c", F.count("*").over(w))
    monkeypatch.setattr(rank, "ROWS_PER_SLICE", 20)
    same(rank.trailing_count(series, ["key"], "ts", 2000, "c"), want, "c")


def test_automatic_slices(series, monkeypatch):
    monkeypatch.setattr(rank, "ROWS_PER_SLICE", 20)
    assert 1 < rank.slice_width(series, ["key"], "ts") < 500
    w = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(-4, 0)
    got = rank.rolling(series, ["key"], ["ts", "event_id"], "ts", 5, {"s": F.sum("value")})
    same(got, series.withColumn("s", F.sum("value").over(w)), "s")


def test_with_rank(series):
    w = Window.partitionBy("key").orderBy("value", "event_id")
    got = rank.with_rank(series.repartition(7), ["key"], ["value", "event_id"])
    same(got, series.withColumn("rank", F.row_number().over(w)), "rank")
