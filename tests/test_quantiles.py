"""Ranks and quantiles in parts against those of whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from qpanel.operators.quantiles import quantiles, tiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = [("large", i, rng.gauss(0, 1)) for i in range(3000)] + [("ties", i, float(rng.choice([0, 0, 0, 1, 2]))) for i in range(500)]
    made += [("one", 0, 5.0), ("few", 0, 2.0), ("few", 1, 1.0), ("few", 2, 4.0), ("none", 0, None), ("none", 1, None)]
    return spark.createDataFrame(made, "g string, i int, x double").repartition(5)


def test_quantiles_are_those_of_percentile(rows):
    shares = [0.0, 0.05, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(rows, ["g"], "x", shares).collect()}
    want = {r["g"]: r["q"] for r in rows.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert set(want) - set(got) == {"none"}
    for g, q in got.items():
        assert q == pytest.approx(want[g], abs=1e-12)


@pytest.mark.parametrize("n", [3, 10])
def test_tiles_are_those_of_ntile(rows, n):
    present = rows.filter("x IS NOT NULL")
    want = present.withColumn("t", F.ntile(n).over(Window.partitionBy("g").orderBy("x", "i")))
    key = lambda df: sorted((r["g"], r["i"], r["t"]) for r in df.collect())
    assert key(tiles(present, ["g"], "x", ["i"], n, "t")) == key(want)


def test_empty_table(rows):
    assert quantiles(rows.filter("false"), ["g"], "x", [0.5]).count() == 0
    assert tiles(rows.filter("false"), ["g"], "x", ["i"]).count() == 0
