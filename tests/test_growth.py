"""Steps that must not depend on a table's being small."""

import pytest
from pyspark.sql import functions as F

from stratus.operators import contours as C, joins as J


@pytest.fixture
def points(spark):
    x = spark.range(200).select(F.lit(1).alias("line"), "id", (F.pmod(F.col("id") * 37, F.lit(360)) - 180.0).alias("lon"), (F.pmod(F.col("id") * 11, F.lit(120)) - 60.0).alias("lat"))
    return x.withColumn("cyclic", F.lit(False))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [lambda p: C.sphere_pairs(p, ["line"], "id", 8e5), lambda p: J.close_pairs(p, ["line"], "id", "lon", "lat", 20.0)])
def test_exploded_sides_are_not_broadcast(points, make):
    pairs = make(points)
    assert pairs.count() > 0
    assert "Broadcast" not in _plan(pairs)

