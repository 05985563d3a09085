"""Exact duplicates by distributed MSD radix partitioning.

Every document starts in one group. A round splits each open group by its documents' next bytes (a block of them at a
time, wider from round to round); a group that holds one document, or whose documents have no bytes left, is closed.
Documents compare by their bytes only; no digest takes part in the decision. The blocks are counted with partial
aggregation, so copies collapse before the shuffle, and only blocks that at least two documents share are written and
joined back. The first round moves no text but its blocks; the texts of the documents that it leaves open move once,
to a table on which the later rounds work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import Tables

FIRST_BLOCK, BLOCK_GROWTH, WIDEST_BLOCK = 64, 4, 1 << 20


def _blocks(width: int) -> list[Column]:
    return [F.substring("rest", 1, width).alias("block"), (F.length("rest") <= width).alias("ended")]


def _split(rows: DataFrame, stored, *more: str) -> DataFrame:
    """``rows`` (id, sha, grp, block, ended) with the new group, and the size and largest id of the group; null if alone."""
    shared = rows.groupBy("grp", "block", "ended").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    shared = stored(shared.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
    joined = rows.join(shared, ["grp", "block", "ended"], "left").withColumn("going", ~F.col("ended") & F.col("n").isNotNull())
    return joined.select("id", "sha", "keep_id", "n", "going", F.col("next").alias("grp"), *more)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays; a null id is smaller than any other, and a group of null ids keeps
    null. A null text counts as empty; all empty texts form one group. Rows that repeat both id and text count each in
    ``group_size`` and share one verdict. An empty table gives an empty result. Other columns are ignored.
    """
    return _groups(docs, id_col, text_col, Tables(docs.sparkSession).stored)


def _groups(docs: DataFrame, id_col: str, text_col: str, stored) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), text.alias("rest"), F.lit(-1).cast("bigint").alias("grp"))
    split = stored(_split(rows.select("id", "sha", "grp", *_blocks(FIRST_BLOCK)), stored), "radix-split")
    closed = [split.where("not going")]
    going = split.where("going").select(F.col("id").alias("i"), F.col("sha").alias("s"), F.col("grp").alias("g")).distinct()
    if not going.isEmpty():
        later = rows.select("id", "sha", F.expr(f"substring(rest, {FIRST_BLOCK + 1})").alias("rest"))
        # merge: the open documents grow with the corpus; id and digest only say which row is meant
        open_ = later.join(going.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")))
        state, width = stored(open_.select("id", "sha", F.col("g").alias("grp"), "rest"), "radix-open"), FIRST_BLOCK
        while not state.isEmpty():
            width = min(width * BLOCK_GROWTH, WIDEST_BLOCK)
            later = F.expr(f"substring(rest, {width + 1})")
            split = _split(state.select("id", "sha", "grp", *_blocks(width), later.alias("rest")), stored, "rest")
            split = stored(split.withColumn("rest", F.when(F.col("going"), F.col("rest"))), "radix-split")
            closed.append(split.where("not going"))
            state = split.where("going").select("id", "sha", "grp", "rest")
    out = [
        part.select(
            F.col("id").alias(id_col),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
            (F.col("n").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
        for part in closed
    ]
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, that which :func:`exact_groups` keeps; all columns stay.

    Of kept rows that repeat both id and text, or have null ids, the one whose columns hash least stays.
    """
    tables = Tables(docs.sparkSession)
    copies = _groups(docs, id_col, text_col, tables.stored).where("group_size > 1")
    copies = copies.groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    # of a copy that goes all rows go, and of one that stays more than once all but one
    copies = tables.stored(copies.where("not stays or n > 1").drop("n"), "radix-copies")
    tables.drop(keep=(copies,))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("sha"), F.struct("*").alias("row"))
    which = copies.select(F.col("id").alias("i"), F.col("sha").alias("s"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s"))
    alone = rows.join(which, same, "left_anti").select("row.*")
    repeated = copies.where("stays").select(F.col("id").alias("i"), F.col("sha").alias("s"))
    if repeated.isEmpty():
        return alone
    order = F.xxhash64(*[F.col("row").getField(c).cast("string") for c in docs.columns])
    one = rows.join(repeated, same).groupBy("i", "s").agg(F.min_by("row", order).alias("row"))
    return alone.unionByName(one.select("row.*"))
