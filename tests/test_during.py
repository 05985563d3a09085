"""Random places of spells meet their series by stretches."""

from pyspark.sql import functions as F

from stratus.operators import aggregate as A


def _row(spark, n, length, draws):
    x = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 7 != 3, F.pmod(F.col("id") * 37, F.lit(101)) / 10.0).alias("v"))
    spells = x.where(F.col("t").between(90, 89 + length)).select("k", F.lit(5).alias("spell"), "t")
    out = A.during_pvalues(spells, x, ["k"], "t", "v", draws)
    rows = [None if i % 7 == 3 else i * 37 % 101 / 10 for i in range(n)]
    mean = lambda a: (lambda v: sum(v) / len(v))([v for v in rows[a : a + length] if v is not None])
    hashes = spark.range(draws).select(F.pmod(F.xxhash64(F.lit(0), F.col("id").cast("int"), F.lit(5), F.lit(1)), F.lit(n - length + 1)).alias("a")).collect()
    want = sum(0.5 if abs(mean(r.a) - mean(90)) < 1e-9 else float(mean(r.a) < mean(90)) for r in hashes) / draws
    return out, want


def test_places_over_many_stretches(spark):
    for length in (2, 40, 150):
        out, want = _row(spark, 300, length, 60)
        got = out.collect()
        assert len(got) == 1 and got[0].len == length and abs(got[0].p - want) < 1e-9


def test_places_are_not_spread_by_step(spark):
    """The rows that a draw is spread over are its stretches."""
    out, _ = _row(spark, 300, 40, 60)
    assert "__q" in out._jdf.queryExecution().optimizedPlan().toString()
