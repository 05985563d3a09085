"""Hand-made sequences."""

from pyspark.sql import functions as F

from stratus.operators import sequence as Q


def rows(spark, text, group="a", skip=()):
    data = [(group, i, {"T": True, "F": False, "N": None}[c]) for i, c in enumerate(text) if i not in skip]
    return spark.createDataFrame(data, "g string, step bigint, cond boolean")


def inside(spark, text, hole, **more):
    out = Q.mark_runs(rows(spark, text), F.col("cond"), ["g"], "step", hole, **more).orderBy("step").collect()
    return "".join("T" if r.inside else "F" for r in out)


def test_holes(spark):
    assert inside(spark, "TTFTFFFT", 0) == "TTFTFFFT"
    assert inside(spark, "TTFTFFFT", 1) == "TTTTFFFT"
    assert inside(spark, "TTFTFFFT", 3) == "TTTTTTTT"
    assert inside(spark, "FTTF", 1) == "FTTT"
    assert inside(spark, "FTTF", 1, fill_trailing=False) == "FTTF"
    assert inside(spark, "TNT", 2) == "TFT"
    assert inside(spark, "FFF", 3) == "FFF"


def test_jump_breaks_runs(spark):
    df = rows(spark, "TTTTT", skip=(2,))
    out = Q.get_spells(df, F.col("cond"), ["g"], "step").orderBy("step").collect()
    assert [(r.step, r.spell, r.len) for r in out] == [(0, 0, 2), (1, 0, 2), (4, 1, 1)]


def test_spells_and_extension(spark):
    spells = Q.get_spells(rows(spark, "FTTTFTTTTTF"), F.col("cond"), ["g"], "step", min_len=4)
    assert [(r.step, r.relative_index, r.len) for r in spells.orderBy("step").collect()] == [(5, 0, 5), (6, 1, 5), (7, 2, 5), (8, 3, 5), (9, 4, 5)]
    out = Q.extend_spells(spells, ["g"], "step", before=2).orderBy("step").collect()
    assert [r.relative_index for r in out] == [-2, -1, 0, 1, 2, 3, 4]


def test_run_lengths_sum_to_group(spark):
    runs = Q.run_lengths(rows(spark, "TTFTFFFT"), F.col("cond"), ["g"], "step").orderBy("start").collect()
    assert [(r.start, r.len, r.value) for r in runs] == [(0, 2, True), (2, 1, False), (3, 1, True), (4, 3, False), (7, 1, True)]


def test_lags_do_not_leak(spark):
    df = spark.createDataFrame([(m, s, float(10 * m + s)) for m in (0, 1) for s in (0, 1, 3, 4)], "member int, step bigint, value double")
    out = {(r.member, r.step): r.value for r in Q.lags(df, ["value"], ["member"], "step", [1]).collect()}
    assert out == {(0, 0): None, (0, 1): 0.0, (0, 3): None, (0, 4): 3.0, (1, 0): None, (1, 1): 10.0, (1, 3): None, (1, 4): 13.0}


def test_periodic_rolling_wraps(spark):
    df = spark.range(1, 366).select(F.col("id").alias("doy"), F.col("id").cast("double").alias("v"))
    out = {r.doy: r.v for r in Q.periodic_rolling(df, 3, {"v": F.avg("v")}, "doy", [], 365).collect()}
    assert abs(out[1] - (365 + 1 + 2) / 3) < 1e-9 and abs(out[365] - (364 + 365 + 1) / 3) < 1e-9 and abs(out[100] - 100) < 1e-9


def test_label_spells_with_distance(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([0, 1, 0, 2, 2, 2])], "g int, o bigint, label int")
    near = {(a, b): float(abs(a - b)) for a in range(3) for b in range(3)}
    out = Q.label_spells(df, ["g"], "o", "label", near, sigma=1.0).orderBy("first").collect()
    assert [(r.first, r.last, r.len, r.value) for r in out] == [(0, 2, 3, 0), (3, 5, 3, 2)]


def test_tracked_latitude(spark):
    df = spark.createDataFrame([(0, x, y, -abs(y - (5 + x))) for x in range(5) for y in range(12)], "g int, ilon int, ilat int, v int")
    out = {r.ilon: r.ilat for r in Q.tracked_latitude(df, ["g"], "ilon", "ilat", "v").collect()}
    assert out == {x: 5 + x for x in range(5)}
