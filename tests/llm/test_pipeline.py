"""The pipeline's stages, each against a brute-force version on what the stage before kept."""

import random

import corpus_pipeline
from stratus.llm import quality

from .test_operators import brute_components, brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    step = lambda name, df: spark.createDataFrame(stage[name](spark, df, SF).toPandas(), docs.schema)
    good = step("quality classifier", docs)
    verdict = {r.doc_id for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
    assert {r.doc_id for r in good.collect()} == verdict and good.columns == columns
    once = step("exact dedup", good)
    last = {}
    for r in good.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert {r.doc_id for r in once.collect()} == set(last.values())
    near = step("n-gram Jaccard join", once)
    want = brute_components([(r.doc_id, r.text) for r in once.collect()])
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in want.items() if i == c}
    cut = step("suffix-array dedup", near)
    rows = sorted(near.collect(), key=lambda r: r.doc_id)
    kept = {r.doc_id: n - gone for r, (n, gone, _, _) in zip(rows, brute_repeats([r.text for r in rows]))}
    got = {r.doc_id: len(r.text.encode()) for r in cut.collect()}
    assert set(got) == {i for i, n in kept.items() if n} and all(kept[i] <= n <= kept[i] + 6 * 9 for i, n in got.items()) and cut.columns == columns
    packed = stage["packing"](spark, cut, SF)
    assert {r.doc_id for r in packed.collect()} == set(got)


def test_repeated_rows_stay_once(spark):
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long_, short, other = ("".join(random.Random(seed).choices("abcdefgh ", k=k)) for seed, k in enumerate((400, 50, 300)))
    rows = [(1, long_, "en", "a"), (1, long_, "en", "a"), (1, long_, "de", "b"), (2, short, "en", "a"), (2, short, "en", "a"), (None, other, "en", "a"), (None, other, "en", "b")]
    rows += [(None, short, "en", "a"), (None, "", "en", "a"), (None, None, "en", "a"), (3, "alone " * 9, "en", "a")]
    rows = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    once = stage["exact dedup"](spark, rows, SF)
    assert once.columns == rows.columns and once.schema == rows.schema
    want = sorted([("1", long_), ("2", short), ("None", other), ("None", ""), ("3", "alone " * 9)])
    assert sorted((str(r.doc_id), r.text or "") for r in once.collect()) == want
    near = stage["n-gram Jaccard join"](spark, once, SF)
    cut = stage["suffix-array dedup"](spark, near, SF)
    assert sorted((str(r.doc_id), r.text) for r in cut.collect()) == want
