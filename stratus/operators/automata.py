"""Scans of long series by small automata, as a parallel prefix: no series needs a single row, group or task.

The axis is cut into blocks of whole steps. A block is a map from each state in which it may be entered to the state in
which it is left; blocks of blocks compose such maps, and the states then go back down. The number of states is a
parameter (the labels of a map), the number of levels the logarithm of the axis.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import cut_lineage

#: Steps of a block, and blocks of a block.
STEPS = 1024


def walk(delta: np.ndarray, breaks: np.ndarray, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, each=None) -> tuple[np.ndarray, np.ndarray]:
    """States after the last symbol of many blocks and the places of their last breaks in them (-1: none), a step of all
    blocks at once. Block i holds ``size[i]`` symbols from ``begin[i]`` on; ``state`` has a row a block and a column for each
    state in which it may be entered. ``each`` takes the places, states and last breaks after every step."""
    order = np.argsort(size, kind="stable")
    size, begin, state = size[order], begin[order], state[order]
    last = np.full(state.shape, -1)
    for j in range(size[-1] if len(size) else 0):
        live = slice(np.searchsorted(size, j, "right"), None)
        x, now = symbols[begin[live] + j][:, None], state[live]
        last[live] = np.where(breaks[now, x], j, last[live])
        state[live] = delta[now, x]
        if each:
            each(begin[live] + j, state[live], np.where(last[live] < 0, -1, begin[live, None] + last[live]))
    last = np.where(last < 0, -1, begin[:, None] + last)
    back = np.argsort(order, kind="stable")
    return state[back], last[back]


def _block(order: str, low: int, steps: int):
    return F.floor((F.col(order) - F.lit(low)) / steps).cast("bigint")


def _packed(rows: DataFrame, keys: list[str], order: str, symbol: str) -> DataFrame:
    """keys, block, ``q``: the rows of a block in order, at most as many as it has steps."""
    return rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(symbol).alias("x")))).alias("q"))


def _unpacked(q: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Orders, symbols, and where each block begins and how many rows it has."""
    flat, ends = q.flatten(), np.concatenate(([0], np.cumsum(q.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return flat.field("t").to_numpy(zero_copy_only=False), flat.field("x").to_numpy(zero_copy_only=False), ends[:-1], np.diff(ends)


def _lists(x: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)


def _block_maps(packed: DataFrame, keys: list[str], delta: np.ndarray, breaks: np.ndarray) -> DataFrame:
    """By entering state the state at a block's end and the step of the last break in it (null: none)."""
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}

    def run(batches):
        for batch in batches:
            t, x, begin, size = _unpacked(batch.column("q"))
            state, last = walk(delta, breaks, x, begin, size, np.tile(np.arange(len(delta)), (len(size), 1)))
            ends = np.arange(len(size) + 1) * len(delta)
            since = pa.array(t[np.maximum(last, 0)].ravel(), mask=(last < 0).ravel())
            columns = [batch.column(k) for k in (*keys, "block")] + [_lists(pa.array(state.ravel()), ends), _lists(since, ends)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "block", "ends", "since"])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["block bigint, ends array<bigint>, since array<bigint>"])
    return packed.mapInArrow(run, schema)


def _above(maps: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """The maps of each block of blocks, in order; at most ``steps`` of them."""
    seq = F.array_sort(F.collect_list(F.struct("block", "ends", "since")))
    return maps.groupBy(*keys, F.floor(F.col("block") / steps).cast("bigint").alias("above")).agg(seq.alias("q"))


def _composed(maps: DataFrame, keys: list[str], n: int, steps: int) -> DataFrame:
    start = F.struct(F.array(*[F.lit(i).cast("bigint") for i in range(n)]).alias("ends"), F.array(*[F.lit(None).cast("bigint") for _ in range(n)]).alias("since"))

    def step(acc, m):
        since = F.zip_with(acc.ends, acc.since, lambda e, s: F.coalesce(F.element_at(m.since, (e + 1).cast("int")), s))
        return F.struct(F.transform(acc.ends, lambda e: F.element_at(m.ends, (e + 1).cast("int"))).alias("ends"), since.alias("since"))

    folded = _above(maps, keys, steps).withColumn("m", F.aggregate("q", start, step))
    return folded.select(*keys, F.col("above").alias("block"), "m.ends", "m.since")


def _entered(maps: DataFrame, above: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Entering state and last break of each block from those of the block of blocks around it."""
    joined = _above(maps, keys, steps).join(above.withColumnRenamed("block", "above"), [*keys, "above"])
    first = F.struct("state", "since", F.array().cast("array<struct<block:bigint,state:bigint,since:bigint>>").alias("out"))

    def step(acc, m):
        at = (acc.state + 1).cast("int")
        here = F.struct(m["block"].alias("block"), acc.state.alias("state"), acc.since.alias("since"))
        return F.struct(F.element_at(m.ends, at).alias("state"), F.coalesce(F.element_at(m.since, at), acc.since).alias("since"), F.concat(acc.out, F.array(here)).alias("out"))

    return joined.select(*keys, F.explode(F.aggregate("q", first, step, lambda a: a.out)).alias("o")).select(*keys, "o.block", "o.state", "o.since")


def scan(df: DataFrame, keys: list[str], order: str, symbol: str, delta: np.ndarray, breaks: np.ndarray, steps: int = STEPS) -> DataFrame:
    """keys, order, symbol, ``state`` after the row, and ``since``, the order of the last break up to the row (null before the
    first), of an automaton that starts each key in state 0.

    ``delta[state, symbol]`` is the next state, ``breaks[state, symbol]`` whether the row breaks. Orders are distinct whole
    numbers within a key, so a block of so many steps bounds its rows; symbols are whole numbers below the tables' width.
    Rows without an order or a symbol are left out.
    """
    delta, breaks = np.asarray(delta, np.int64), np.asarray(breaks, bool)
    rows = df.dropna(subset=[*keys, order, symbol]).select(*keys, F.col(order).cast("bigint").alias(order), F.col(symbol).cast("bigint").alias(symbol))
    low, high = rows.agg(F.min(order), F.max(order)).first()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    packed, blocks = _packed(rows.withColumn("block", _block(order, low or 0, steps)), keys, order, symbol), ((high or 0) - (low or 0)) // steps
    start = (F.lit(0).cast("bigint").alias("state"), F.lit(None).cast("bigint").alias("since"))
    if blocks == 0:  # each key is one block, entered in state 0
        packed = packed.select("*", *start)
    else:
        levels = [cut_lineage(_block_maps(packed, keys, delta, breaks))]
        while blocks > 0:
            levels.append(cut_lineage(_composed(levels[-1], keys, len(delta), steps)))
            blocks //= steps
        entered = levels[-1].select(*keys, "block", *start)
        for maps in levels[-2::-1]:
            entered = _entered(maps, entered, keys, steps)
        packed = packed.join(entered, [*keys, "block"])

    def run(batches):
        for batch in batches:
            t, x, begin, size = _unpacked(batch.column("q"))
            after, broke = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)

            def keep(at, state, last):
                after[at], broke[at] = state[:, 0], last[:, 0]

            walk(delta, breaks, x, begin, size, batch.column("state").to_numpy(zero_copy_only=False)[:, None].copy(), keep)
            before, known = batch.column("since").fill_null(0).to_numpy(zero_copy_only=False), batch.column("since").is_valid().to_numpy(zero_copy_only=False)
            since = np.where(broke >= 0, t[np.maximum(broke, 0)], np.repeat(before, size))
            since = pa.array(since, mask=(broke < 0) & ~np.repeat(known, size))
            out = pa.StructArray.from_arrays([pa.array(t), pa.array(x), pa.array(after), since], ["t", "x", "state", "since"])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], _lists(out, np.append(begin, len(t)))], [*keys, "o"])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["o array<struct<t: bigint, x: bigint, state: bigint, since: bigint>>"])
    out = packed.mapInArrow(run, schema).select(*keys, F.explode("o").alias("o"))
    return out.select(*keys, F.col("o.t").alias(order), F.col("o.x").alias(symbol), "o.state", "o.since")


def greedy_runs(distances: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(delta, breaks) of runs that last while the distance from their first label is at most ``sigma``: state 0 is no run, state
    s + 1 a run that began with label s. A null distance lets only the label itself stay."""
    n = len(distances)
    near = np.where(np.isnan(distances), np.eye(n, dtype=bool), distances <= sigma)
    delta = np.tile(np.arange(1, n + 1), (n + 1, 1))
    delta[1:][near] = np.repeat(np.arange(1, n + 1), near.sum(axis=1))
    return delta, np.concatenate((np.ones((1, n), bool), ~near))
