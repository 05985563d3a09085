"""A corpus in five stages, each over all that the stage before kept. A stage's intermediate tables are deleted when the
next one begins, and its input when its result is written.

quality classifier, exact dedup, n-gram Jaccard join, suffix-array dedup, packing.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratus.llm import exact_dedup, jaccard, packing, quality, suffix_dedup
from stratus.llm.queries import tokenizer_file
from stratus.llm.shared import StageTables, delete, fresh_path

#: No stage but the second has an SQL form.
ORACLE_SQL = None


_tables = StageTables()


def stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with _tables.stage(spark, docs):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repeated strings cut out, but for characters that a cut would part; ``n_chars`` follows.
    Texts of which nothing is left go. Columns stay as they are."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup.remove_repeats(docs, keep=others, characters=True)
    cut = cut.where((F.length("kept") > 0) | (F.size("spans") == 0))
    cut = cut.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("bigint"))
    return cut.select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES:
        path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
        f(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
