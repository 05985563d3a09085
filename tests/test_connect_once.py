"""Ties of paths are worked out once, whatever reads them."""

from stratus.operators import tracking as TR


def test_connect_reads_stored_ties(spark):
    cross = spark.createDataFrame([(0, 1, 1, 2, 1e5, 0.5), (0, 2, 2, 1, 1e5, 0.5), (0, 1, 3, 4, 9e6, 0.5)], "member int, step bigint, jet_id bigint, jet_id_right bigint, dist double, lon_overlap double")
    out = TR.connect(cross, ["member"], "step", 8e6, 0.0)
    assert "9000000.0" not in out._jdf.queryExecution().optimizedPlan().toString() and "8000000.0" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.step, r.jet_id, r.spell) for r in out.collect()) == [(1, 1, 0), (2, 2, 0), (3, 1, 0)]
