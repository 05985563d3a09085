"""Mixing sources to target weights, with DataFrame functions only.

Words are counted once a document and summed by source. Each source's target is its weight's part of all words, stopped at
a multiple of what it has; what is above goes to the others by weight. A document is then emitted as often as its source's
rate says: the whole part of the rate, and once more if a number that its id and text are hashed to lies below the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratus.operators.graph import numbered

from .shared import stored

SPACES = " \t\n\x0b\x0c\r"
#: Of sources that hold more than one row in so many there are fewer than that; names beyond so many bytes are not broadcast.
HEAVY, NAME_BYTES = 4096, 1024


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 9 to 13; 0 for null. Holds one letter a word, no list of words."""
    begun = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.length(F.regexp_replace(begun, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")).cast("bigint")


def draw(seed: int, *cols: Column) -> Column:
    """A number from 0 up to 1 by 52 bits of the hash of a row's values; rows of equal values draw alike."""
    joined = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 100, most: int = 3) -> DataFrame:
    """``sizes`` (source, source_size, n) with each source's target and rate.

    Sources by code point, null last, take the weights in turn and share ``percent`` of all words; no target is above
    ``most`` times its source's size. The sharing is one level: a source gets weight times level, or its limit, and each
    round raises the level by what the sources at their limit leave over.
    """
    order = [F.col("source").asc_nulls_last()]
    weighed = numbered(sizes, order, "place").withColumn("w", F.element_at(F.lit([int(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    table = stored(weighed.select("source", "source_size", "n", F.col("w").cast("bigint").alias("w")), "mix-sources")
    limit = F.col("source_size") * most
    level = stopped = 0.0
    while True:
        at_limit = limit <= F.col("w") * F.lit(level)
        r = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(at_limit, limit)).alias("held"), F.sum(F.when(~at_limit, F.col("w"))).alias("free"), F.count_if(at_limit).alias("stopped")).first()
        if not r["free"] or level and r["stopped"] == stopped:
            break
        level, stopped = ((r["all"] or 0) * percent / 100 - (r["held"] or 0)) / r["free"], r["stopped"]
    target = F.least(F.col("w") * F.lit(level), limit.cast("double")) if r["free"] else limit.cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return table.withColumn("target", target).withColumn("rate", rate)


def with_rates(rows: DataFrame, targets: DataFrame, source: str, name: str) -> DataFrame:
    """``rows`` with the struct (source_size, target, rate) of their source as column ``name``, which is not among theirs.

    Sources that hold more than one row in 4096 number under 4096, so they are broadcast and their rows stay where they
    are; the rows of other sources, if there are more sources than that, are joined by merge.
    """
    known = targets.agg(F.count("*"), F.sum("n")).first()
    few = F.lit(known[0] <= HEAVY) | (F.col("n") * HEAVY > (known[1] or 0))
    heavy, key = few & F.coalesce(F.octet_length("source") <= NAME_BYTES, F.lit(True)), name + "_key"
    about = F.struct("source_size", "target", "rate").alias(name)
    big, small = targets.where(heavy).select(F.col("source").alias(key), about), targets.where(~heavy).select(F.col("source").alias(key), about)
    same = F.col(source).eqNullSafe(F.col(key))
    out = rows.join(F.broadcast(big), same).drop(key)
    if small.isEmpty():
        return out
    rest = rows.join(F.broadcast(big.select(key)), same, "left_anti")
    return out.unionByName(rest.join(small.hint("merge"), same).drop(key))


def copies(rate: Column, chance: Column) -> Column:
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))


def mix_report(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 100, most: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What :func:`mix` takes of each document: id, size, source_size, target, rate, copies, taken (words, repeats counted).

    A null text has no words. Sources without words have target and rate 0. Rows that repeat an id and a text draw alike.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(seed, F.col(id_col), F.col(text_col)).alias("chance"))
    rows = stored(rows, "mix-rows")
    rated = with_rates(rows, source_targets(_sizes(rows), weights, percent, most), "source", "of").withColumn("copies", copies(F.col("of.rate"), F.col("chance")))
    return rated.select("id", "size", "of.source_size", "of.target", "of.rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 100, most: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns as they are; no row of sources whose rate is 0."""
    rows = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = source_targets(_sizes(rows), weights, percent, most)
    name = "mix" + "_" * max(map(len, docs.columns))  # longer than any column's name
    times = copies(F.col(f"{name}.rate"), draw(seed, F.col(id_col), F.col(text_col)))
    return with_rates(docs, targets, source_col, name).withColumn(name, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
