"""Ordered sequences: runs, spells, lags, rolling and detrending.

Every function takes its grouping keys and a unique order within them. ``step`` columns are whole numbers; where one
step is missing, runs break.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .automata import greedy_runs, scan


def _over(keys: list[str], order: str | list[str]):
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def run_id(df: DataFrame, col: str | Column, keys: list[str], order: str, name: str = "run") -> DataFrame:
    """0-based number of the run of equal values."""
    w = _over(keys, order)
    value = F.col(col) if isinstance(col, str) else col
    df = df.withColumn("__v", value).withColumn("__new", (~F.col("__v").eqNullSafe(F.lag("__v").over(w))).cast("bigint"))
    first = F.row_number().over(w) == 1
    return df.withColumn(name, F.sum(F.when(first, 0).otherwise(F.col("__new"))).over(w)).drop("__v", "__new")


def run_lengths(df: DataFrame, cond: Column, keys: list[str], order: str) -> DataFrame:
    """keys, start (0-based row), len, value: one row a run."""
    w = _over(keys, order)
    rows = run_id(df.withColumn("value", cond), "value", keys, order).withColumn("__i", F.row_number().over(w) - 1)
    return rows.groupBy(*keys, "run").agg(F.min("__i").cast("bigint").alias("start"), F.count("*").alias("len"), F.first("value").alias("value")).drop("run")


def mark_runs(df: DataFrame, cond: Column, keys: list[str], order: str = "step", hole_size: int = 0, fill_trailing: bool = True, dt: int = 1) -> DataFrame:
    """``df`` with ``inside`` (the condition with short holes filled) and ``run`` (number of the run of it).

    A hole is a run of false of at most ``hole_size`` rows that does not begin the group. The row after a jump of the
    order by more than ``dt`` is false and no part of a hole; null conditions are neither.
    """
    w = _over(keys, order)
    df = df.withColumn("__jump", F.coalesce(F.col(order) - F.lag(order).over(w) > dt, F.lit(False)))
    yes = F.coalesce(cond & ~F.col("__jump"), F.lit(False))
    no = F.coalesce(~cond & ~F.col("__jump"), F.lit(False))
    df = df.withColumn("__yes", yes).withColumn("__no", no).withColumn("__i", F.row_number().over(w))
    df = run_id(df, "__no", keys, order, "__r")
    hole = Window.partitionBy(*keys, "__r")
    short = F.col("__no") & (F.count("*").over(hole) <= hole_size) & (F.min("__i").over(hole) > 1)
    if not fill_trailing:
        short = short & (F.max("__i").over(hole) < F.max("__i").over(Window.partitionBy(*keys)))
    df = df.withColumn("inside", F.col("__yes") | short)
    return run_id(df, "inside", keys, order, "run").drop("__jump", "__yes", "__no", "__i", "__r")


def get_spells(df: DataFrame, cond: Column, keys: list[str], order: str = "step", hole_size: int = 0, min_len: int = 1, dt: int = 1) -> DataFrame:
    """Rows inside runs of at least ``min_len`` rows, with ``spell`` (0-based in the group), ``relative_index``, ``len``.

    Times ride along in the windows, which share one partitioning: one shuffle in all.
    """
    marked = mark_runs(df, cond, keys, order, hole_size, dt=dt)
    run = Window.partitionBy(*keys, "run")
    inside = marked.withColumn("len", F.sum(F.col("inside").cast("bigint")).over(run)).where(F.col("inside") & (F.col("len") >= min_len))
    inside = inside.withColumn("relative_index", F.row_number().over(run.orderBy(order)).cast("bigint") - 1)
    return inside.withColumn("spell", F.dense_rank().over(_over(keys, "run")).cast("bigint") - 1).drop("inside", "run")


def spell_summary(spells: DataFrame, keys: list[str], order: str = "step", value: str | None = None) -> DataFrame:
    aggs = [F.min(order).alias("first"), F.max(order).alias("last"), F.first("len").alias("len")] + ([F.max(value).alias("peak")] if value else [])
    return spells.groupBy(*keys, "spell").agg(*aggs)


def extend_spells(spells: DataFrame, keys: list[str], order: str = "step", before: int = 0, after: int = 0, dt: int = 1) -> DataFrame:
    """A regular axis from ``before`` steps before each spell to ``after`` steps after it."""
    ends = spells.groupBy(*keys, "spell").agg(F.min(order).alias("__a"), F.max(order).alias("__b"), F.first("len").alias("len"))
    steps = F.sequence(F.col("__a") - before * dt, F.col("__b") + after * dt, F.lit(dt).cast("bigint"))
    return ends.select(*keys, "spell", "len", "__a", F.explode(steps).alias(order)).withColumn("relative_index", ((F.col(order) - F.col("__a")) / dt).cast("bigint")).drop("__a")


def explode_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumn("index", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))


def group_index(df: DataFrame, keys: list[str], order: str, name: str = "index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(_over(keys, order)).cast("bigint") - 1)


def central_diff(col: str | Column, keys: list[str], order: str) -> Column:
    """Half the difference of the neighbours; one-sided at the ends."""
    w = _over(keys, order)
    c = F.col(col) if isinstance(col, str) else col
    ahead, behind = F.lead(c).over(w), F.lag(c).over(w)
    return F.coalesce((ahead - behind) / 2, ahead - c, c - behind)


def periodic_diff(col: str, keys: list[str], order: str, period: float) -> Column:
    """:func:`central_diff` of a value that wraps: each step is the shorter way round."""
    w = _over(keys, order)
    short = lambda d: F.pmod(d + period / 2, F.lit(float(period))) - period / 2
    ahead, behind = short(F.lead(col).over(w) - F.col(col)), short(F.col(col) - F.lag(col).over(w))
    return F.coalesce((ahead + behind) / 2, ahead, behind)


def onset_lags(df: DataFrame, spells: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """For each of the first ``n`` steps of a spell a column with the spell's length at that step, 0 elsewhere."""
    marks = spells.where(F.col("relative_index") < n).select(*keys, order, F.col("relative_index").alias("__k"), F.col("len").alias("__len"))
    joined = df.select(*keys, order).join(marks, [*keys, order], "left")
    return joined.select(*keys, order, *[F.when(F.col("__k") == k, F.col("__len")).otherwise(0).alias(f"lag_{k}") for k in range(n)])


def season_onset(df: DataFrame, cond: Column, keys: list[str], order: str, min_len: int) -> DataFrame:
    """First step of the first run of at least ``min_len`` steps of each key."""
    return get_spells(df, cond, keys, order, 0, min_len).groupBy(*keys).agg(F.min(order).alias("onset"))


def directional_diff(df: DataFrame, col: str, by: str, keys: list[str], name: str) -> DataFrame:
    """Derivative of ``col`` along the axis ``by``."""
    return df.withColumn(name, central_diff(col, keys, by) / central_diff(by, keys, by))


def rolling(df: DataFrame, aggs: dict[str, Column], keys: list[str], order: str, before: int, after: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-before, after)
    return df.withColumns({n: a.over(w) for n, a in aggs.items()})


def periodic_rolling(df: DataFrame, win: int, aggs: dict[str, Column], dim: str, keys: list[str], period: int) -> DataFrame:
    """Rolling aggregates over a cyclic key: [-win // 2, win - win // 2 - 1] around each, wrapped."""
    h = win // 2
    wrap = F.explode(F.array(F.lit(0), F.lit(period), F.lit(-period)))
    padded = df.withColumn("__o", wrap).withColumn("__d", F.col(dim) + F.col("__o")).where(F.col("__d").between(1 - h, period + win))
    w = Window.partitionBy(*keys).orderBy("__d").rangeBetween(-h, win - h - 1)
    return padded.withColumns({n: a.over(w) for n, a in aggs.items()}).where("__o = 0").drop("__o", "__d")


def timescales(df: DataFrame, cols: list[str], keys: list[str], order: str, periods: list[int]) -> DataFrame:
    """Trailing means over (t - p, t], a row for each period in ``timescale``: one sort for all periods."""
    part = Window.partitionBy(*keys).orderBy(order)
    means = df.withColumns({f"__{p}_{c}": F.avg(c).over(part.rangeBetween(1 - p, 0)) for p in periods for c in cols})
    block = F.explode(F.array(*[F.struct(F.lit(p).alias("timescale"), *[F.col(f"__{p}_{c}").alias(c) for c in cols]) for p in periods])).alias("__b")
    return means.select(*[c for c in df.columns if c not in cols], block).select(*[F.col(f"__b.{c}").alias(c) if c in cols else F.col(c) for c in df.columns], "__b.timescale")


def lags(df: DataFrame, cols: list[str], keys: list[str], order: str, steps: list[int], dt: int = 1) -> DataFrame:
    """Values ``lag`` steps earlier, a block of rows for each lag; null over a jump of the order or the group's start."""
    w = _over(keys, order)
    cut = df.withColumn("__j", F.coalesce((F.col(order) - F.lag(order).over(w) > dt).cast("bigint"), F.lit(0)))
    cut = cut.withColumn("__s", F.sum("__j").over(w))
    part = Window.partitionBy(*keys, "__s").orderBy(order)
    late = cut.withColumns({f"__{k}_{c}": F.lag(c, k).over(part) for k in steps for c in cols})
    block = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), *[F.col(f"__{k}_{c}").alias(c) for c in cols]) for k in steps])).alias("__b")
    return late.select(*[c for c in df.columns if c not in cols], block).select(*[F.col(f"__b.{c}").alias(c) if c in cols else F.col(c) for c in df.columns], "__b.lag")


def detrend(df: DataFrame, cols: list[str], keys: list[str], order: str) -> DataFrame:
    """Residuals of straight lines in the order."""
    x = F.col(order).cast("double")
    fits = df.groupBy(*keys).agg(*[f(F.col(c), x).alias(f"__{k}_{c}") for c in cols for f, k in ((F.regr_slope, "a"), (F.regr_intercept, "b"))])
    joined = df.join(fits, keys) if keys else df.crossJoin(F.broadcast(fits))
    return joined.select(*[(F.col(c) - F.col(f"__a_{c}") * x - F.col(f"__b_{c}")).alias(c) if c in cols else c for c in df.columns])


def interpolate(df: DataFrame, col: str, keys: list[str], order: str, how: str = "linear") -> DataFrame:
    """Fill nulls between known values; the ends stay null. Ties of ``nearest`` go to the earlier value."""
    back = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _over(keys, order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(col).isNotNull(), F.col(order))
    df = df.withColumns({"__v0": F.last(col, True).over(back), "__v1": F.first(col, True).over(ahead), "__t0": F.last(at, True).over(back), "__t1": F.first(at, True).over(ahead)})
    share = (F.col(order) - F.col("__t0")) / (F.col("__t1") - F.col("__t0"))
    between = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * share if how == "linear" else F.when(share <= 0.5, F.col("__v0")).otherwise(F.col("__v1"))
    inner = F.col("__v0").isNotNull() & F.col("__v1").isNotNull()
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.col(col)).when(inner, between)).drop("__v0", "__v1", "__t0", "__t1")


def lon_steps(df: DataFrame, keys: list[str], order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Signed and absolute longitude steps over the shorter way, their sum with the latitude step, and the order that
    begins after the largest step."""
    w = _over(keys, order)
    signed = F.pmod(F.col(lon) - F.lag(lon).over(w) + 180.0, F.lit(360.0)) - 180.0
    df = df.withColumn("signed_step", signed).withColumn("lon_step", F.abs("signed_step"))
    df = df.withColumn("l1_step", F.col("lon_step") + F.abs(F.col(lat) - F.lag(lat).over(w)))
    whole = Window.partitionBy(*keys)
    start = F.max_by(F.col(order), F.struct(F.coalesce("l1_step", F.lit(-1.0)), -F.col(order))).over(whole)
    n = F.count("*").over(whole)
    return df.withColumn("new_index", F.pmod(F.col(order) - start, n))


def split_on_gap(df: DataFrame, keys: list[str], order: str, step: Column, limit: float, name: str = "part") -> DataFrame:
    """A new part where the step exceeds the limit."""
    df = df.withColumn("__g", F.coalesce((step > limit).cast("bigint"), F.lit(0)))
    return df.withColumn(name, F.sum("__g").over(_over(keys, order))).drop("__g")


def rank_last(df: DataFrame, value: str, sample: str, last: int, keys: list[str]) -> DataFrame:
    """Average rank of the observed sample ``last`` among all, by group, without a sort of the group."""
    seen = df.where(F.col(sample) == last).select(*keys, F.col(value).alias("__x"))
    joined = df.join(seen, keys)
    rank = F.sum((F.col(value) < F.col("__x")).cast("double")) + (F.sum((F.col(value) == F.col("__x")).cast("double")) + 1) / 2
    return joined.groupBy(*keys).agg(rank.alias("rank"), F.count("*").alias("n"))


def fir_filter(df: DataFrame, col: str, keys: list[str], order: str, weights: list[float], name: str) -> DataFrame:
    """Centred weighted sum over an odd number of steps; null where a step is missing."""
    h, w = len(weights) // 2, Window.partitionBy(*keys).orderBy(order)
    shift = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
    total = sum((shift(col, k) * float(weights[k + h]) for k in range(-h, h + 1)), F.lit(0.0))
    whole = (shift(order, h) - shift(order, -h)) == 2 * h  # the orders are distinct whole numbers
    return df.withColumn(name, F.when(whole, total))


def label_spells(df: DataFrame, keys: list[str], order: str, label: str, distances: dict[tuple[int, int], float] | None = None, sigma: float = 0.0, min_len: int = 1) -> DataFrame:
    """Greedy runs of labels that stay within ``sigma`` of the run's first label; value is the most frequent label.

    With sigma 0 these are plain runs; else an automaton of a state a label scans each group by blocks, and ``run`` counts
    the runs of the group. Orders are then distinct whole numbers; the labels are those of a map, few of them.
    """
    if sigma <= 0 or not distances:
        rows = run_id(df, label, keys, order)
        out = rows.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("len"), F.mode(label, True).alias("value"))
        return out.where(F.col("len") >= min_len)
    names = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())
    table = np.full((len(names) + 1, len(names) + 1), np.nan)  # the last stands for null
    for i, a in enumerate(names):
        for k, b in enumerate(names):
            table[i, k] = distances.get((a, b), np.nan)
    number = F.create_map(*[F.lit(x) for i, a in enumerate(names) for x in (a, i)])[F.col(label)] if names else F.lit(None)
    rows = scan(df.select(*keys, order, F.coalesce(number, F.lit(len(names))).alias("__l")), keys, order, "__l", *greedy_runs(table, sigma))
    back = F.element_at(F.array(*[F.lit(x) for x in (*names, None)]).cast(f"array<{dict(df.dtypes)[label]}>"), (F.col("__l") + 1).cast("int"))
    out = rows.withColumn("__v", back).groupBy(*keys, "since").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("len"), F.mode("__v", True).alias("value"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("since")).cast("bigint") - 1
    return out.withColumn("run", number).where(F.col("len") >= min_len).select(*keys, "run", "first", "last", "len", "value")


def label_jumps(df: DataFrame, keys: list[str], order: str, label: str, distances: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """How often a label follows another one, and with ``distances`` how far all changes go together."""
    before = F.lag(label).over(_over(keys, order))
    rows = df.withColumn("__m", (F.col(label) != before).cast("bigint"))
    if distances is None:
        return rows.groupBy(*keys).agg(F.sum("__m").alias("jumps"))
    far = F.create_map(*[F.lit(x) for (a, b), d in distances.items() for x in (f"{a},{b}", float(d))])
    rows = rows.withColumn("__d", far[F.concat_ws(",", before, F.col(label))])
    return rows.groupBy(*keys).agg(F.sum("__m").alias("jumps"), F.sum("__d").alias("distance"))


def longest_stays(df: DataFrame, keys: list[str], order: str, label: str, group: str, spells: DataFrame, q: float = 0.9) -> DataFrame:
    """By spell the longest stay in one label, against all windows of as many rows that start in the same group (a month).

    ``df`` has keys, order, label and group; ``spells`` has spell, keys, the order of its first row and ``len``. Columns:
    spell, len, longest, windows, threshold (the q-quantile of the windows' longest stays), significant. Windows that the
    series ends within are left out; so are spells that do.
    """
    most = spells.agg(F.max("len")).first()[0] or 1
    ahead = F.collect_list(F.struct(F.col(label).alias("l"))).over(_over(keys, order).rowsBetween(0, int(most) - 1))
    starts = df.select(*keys, order, F.col(group).alias("__g"), ahead.alias("__w"))

    def stay(n):
        begin = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.struct(F.lit(None).cast(dict(df.dtypes)[label]).alias("l")).alias("last"))

        def step(acc, x):
            now = F.when(acc.last.eqNullSafe(x), acc.now + 1).otherwise(1)
            return F.struct(now.alias("now"), F.greatest(acc.best, now).alias("best"), x.alias("last"))

        return F.aggregate(F.slice("__w", 1, n), begin, step, lambda a: a.best).cast("bigint")

    whole = F.size("__w") >= F.col("len")
    own = spells.select("spell", *keys, order, F.col("len").cast("int").alias("len")).join(starts, [*keys, order]).where(whole)
    own = own.select("spell", "len", "__g", stay(F.col("len")).alias("longest"))
    asked = own.select("len", "__g").distinct()
    other = starts.join(F.broadcast(asked), "__g").where(whole).select("__g", "len", stay(F.col("len")).alias("__s"))  # lengths by groups, a few hundred rows
    drawn = other.groupBy("__g", "len", "__s").agg(F.count("*").alias("__n"))
    drawn = drawn.groupBy("__g", "len").agg(F.percentile("__s", q, F.col("__n")).alias("threshold"), F.sum("__n").alias("windows"))
    return own.join(drawn, ["__g", "len"]).select("spell", "len", "longest", "windows", "threshold", (F.col("longest") >= F.col("threshold")).alias("significant"))


def decorrelation(acf: DataFrame, lag: str = "lag", rho: str = "rho") -> DataFrame:
    """First lag under 1/e, 1 + 2 * sum of correlations, and the sum with triangular weights."""
    n = acf.agg((F.max(lag) + 1).cast("double").alias("__n"))
    j = acf.crossJoin(F.broadcast(n))
    pos = F.col(lag) > 0
    return j.agg(
        F.min(F.when(F.col(rho) < F.exp(F.lit(-1.0)), F.col(lag))).cast("bigint").alias("e_folding"),
        (1 + 2 * F.sum(F.when(pos, F.col(rho)).otherwise(0.0))).alias("integral"),
        (1 + 2 * F.sum(F.when(pos, (1 - F.col(lag) / F.col("__n")) * F.col(rho)).otherwise(0.0))).alias("triangular"),
    )


def tracked_latitude(field: DataFrame, keys: list[str], x: str, y: str, value: str, reach: int = 2) -> DataFrame:
    """From the middle column outward, the row of the largest value within ``reach`` rows of the last one.

    A fold over each key's columns, whose number the grid bounds.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(y).alias("y"), F.col(value).alias("v"))))
    cols = field.groupBy(*keys, x).agg(rows.alias("rows"))
    seq = cols.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col("rows")))).alias("cols"))
    best = lambda r: F.array_max(F.transform(r, lambda c: F.struct(c.v.alias("v"), (-c.y).alias("y"))))
    middle = (F.size("cols") / 2).cast("int") + 1
    seq = seq.withColumn("m", F.element_at("cols", middle))
    first = -best(F.col("m.rows")).y

    def walk(part):
        def step(acc, c):
            at = -best(F.filter(c.rows, lambda r: F.abs(r.y - acc.at) <= reach)).y
            at = F.coalesce(at, acc.at)
            return F.struct(at.alias("at"), F.concat(acc.path, F.array(F.struct(c.x.alias("x"), at.alias("y")))).alias("path"))

        empty = F.filter(F.array(F.struct(F.col("m.x").alias("x"), first.alias("y"))), lambda _: F.lit(False))
        return F.aggregate(part, F.struct(first.alias("at"), empty.alias("path")), step, lambda a: a.path)

    east = walk(F.slice("cols", middle + 1, F.size("cols")))
    west = walk(F.reverse(F.slice("cols", 1, middle - 1)))
    here = F.array(F.struct(F.col("m.x").alias("x"), first.alias("y")))
    path = seq.select(*keys, F.explode(F.concat(here, east, west)).alias("p"))
    return path.select(*keys, F.col("p.x").alias(x), F.col("p.y").alias(y))
