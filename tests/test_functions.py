"""Draws and joins of hubs."""

from pyspark.sql import functions as F

from unravel import functions


def test_hub_join(spark):
    rows = [(1, i) for i in range(37)] + [(2, 5), (3, 6), (3, 7), (None, 8)]
    a, b = spark.createDataFrame(rows, "k long, x long"), spark.createDataFrame([(k, x + 100) for k, x in rows if k != 2] + [(9, 1)], "k long, y long")
    want = sorted((r.k, r.x, r.y) for r in a.join(b, "k").collect())
    for hub in (1, 3, 36, 37, 1000):
        assert sorted((r.k, r.x, r.y) for r in functions.hub_join(a, b, ["k"], hub).collect()) == want


def test_draws(spark):
    got = [r.d for r in spark.range(2000).select(functions.draw(3, F.col("id")).alias("d")).collect()]
    assert len(set(got)) == 2000 and all(0 <= d < functions.PRIME for d in got)
    assert 900 < sum(d % 2 for d in got) < 1100 and 150 < sum(d % 10 == 3 for d in got) < 250
    h = (3 * 48271 + 17) % functions.PRIME
    assert got[17] == (h * h + 12 * h) % functions.PRIME * 48271 % functions.PRIME
