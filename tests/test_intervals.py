"""Points in intervals against comparing all of them."""

import random

import pytest

from riskloom.operators.intervals import stab

POINTS = "k string, v array<bigint>"
INTERVALS = "k string, low array<bigint>, high array<bigint>, id int"


@pytest.mark.parametrize("hot", [False, True])
def test_stab_equals_comparing_all(spark, hot):
    rng = random.Random(5)
    version = lambda: [rng.randint(0, 4) for _ in range(rng.randint(1, 3))]
    key = lambda: "hot" if hot and rng.random() < 0.8 else rng.choice("abc")
    points = [(k, list(v)) for k, v in {(key(), tuple(version())) for _ in range(150)}]
    intervals = [(key(), rng.choice([None, version()]), rng.choice([None, version()]), i) for i in range(60)]
    intervals += [("a", None, None, 60), ("none", None, None, 61), ("a", [1], [1], 62), (None, None, None, 63), *intervals[:3]]
    rows = stab(spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS), ["k"], "v", "low", "high")
    assert rows.columns == ["k", "id", "v"]
    assert sorted(tuple(r) for r in rows.collect()) == sorted(
        (k, i, v) for k, v in points for key_, low, high, i in intervals
        if k == key_ and (low is None or v >= low) and (high is None or v < high)
    )


def test_stab_without_rows(spark):
    points, none = spark.createDataFrame([("a", [1])], POINTS), spark.createDataFrame([], INTERVALS)
    assert stab(points, none, ["k"], "v", "low", "high").count() == 0
    one = spark.createDataFrame([("a", None, None, 1)], INTERVALS)
    assert stab(points.limit(0), one, ["k"], "v", "low", "high").count() == 0
