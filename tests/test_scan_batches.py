"""Scans go by batches of blocks: no Python call a key."""

import numpy as np
from pyspark.sql import functions as F

from stratus.operators import automata


def test_scan_calls_no_python_by_group(spark):
    far = np.abs(np.subtract.outer(np.arange(4), np.arange(4))).astype(float)
    df = spark.range(3000).select((F.col("id") % 500).alias("k"), F.floor(F.col("id") / 500).alias("t"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("x"))
    for steps in (4, 1024):  # several blocks a key, or one
        out = automata.scan(df, ["k"], "t", "x", *automata.greedy_runs(far, 1.0), steps)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 3000
