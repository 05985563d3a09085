"""Words made to share a linear hash, repeated ids with different texts, and extreme ids."""

import random
import zlib

import numpy as np
import pytest

from stratus.llm import jaccard, packing, queries, suffix_dedup, token_files, word_encoder
from tests.llm.test_operators import brute_components, brute_repeats, corpus

A, B = "aedacaeadaacafecabab", "baaaadacadaaaaaaaaca"


def test_word_ids_are_told_apart():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = word_encoder.WordEncoder(queries.tokenizer_file(name))
        whole = lambda t: encoder._bytes(encoder.tok.encode(t, add_special_tokens=False).ids)
        texts = [f"one {A} two", f"one {B} two", f"{B}\n{A} {B}", f"{A} {A}{B}"]
        assert encoder.encode(texts) == [whole(t) for t in texts] == encoder.encode(texts)


def test_equal_hashes_do_not_make_words_equal(monkeypatch):
    """All words of one hash: what is found is another word, and its text goes to the library whole."""
    monkeypatch.setattr(word_encoder, "range_hash", lambda prefix, start, end: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(word_encoder, "mix", lambda x: np.full(len(x), 8, np.uint64))
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "a", "b" * 64, "c" * 65, "epsilon!"]) for _ in range(5)) + rng.choice(["", "\nz"]) for _ in range(20)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = word_encoder.WordEncoder(queries.tokenizer_file(name))
        assert encoder.encode(texts) == [encoder._bytes(encoder.tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_links_of_crafted_words(spark):
    texts = [f"w x {A} y z", f"w x {B} y z", f"w x {A} y z", "w x y z v", f"{A} {A} {B} {A} {A}", f"{A} {B} {B} {A} {A}"]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(corpus(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts))).items()}


def test_repeats_of_crafted_words(spark):
    rng = random.Random(4)
    pad = lambda n: "".join(rng.choice("abcdef ghij") for _ in range(n))
    texts = []
    for _ in range(12):
        head, tail = pad(150), pad(150)
        texts += [head + A + tail, head + B + tail]
    want = brute_repeats(texts)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(corpus(spark, texts)).collect()}
    assert got == {i: w[1:] for i, w in enumerate(want)}
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(corpus(spark, texts), length=300)


def test_one_id_with_different_texts(spark):
    base = [f"w{i}" for i in range(40)]
    near = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    texts = [" ".join(base), near(0), "q r s t u v", "q r s t u v w", "lonely words in a text here", "alone", "alone", near(39), "q r s t u v"]
    ids = [4, 4, 4, 2, 9, 9, 9, 7, 11]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(corpus(spark, texts, ids)).collect())
    size = lambda t: len({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}) or 1
    # near(0) and near(39) differ from the base by one and five shingles; the one id 4 ties its texts, and doc 11 repeats one of them
    want = sorted((i, size(t), 9 if i == 9 else 4 if i in (4, 7, 11) else 2) for i, t in zip(ids, texts))
    assert got == want
    assert jaccard.keep_one_of_each(corpus(spark, texts, ids)).select("doc_id").distinct().count() == len({c for _, _, c in want})


def test_extreme_and_repeated_ids(spark):
    texts, ids = ["a b", None, "c", "d e f", "d e f", "g"], [-(2**63), None, 2**63 - 1, 5, 5, None]
    got = token_files.token_file_documents(corpus(spark, texts, ids), queries.tokenizer_file("byte_bpe_50k.json")).collect()
    encoder = word_encoder.WordEncoder(queries.tokenizer_file("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.append(np.frombuffer(encoder.encode([t or ""])[0], encoder.dtype), 2).astype("<u4"))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, -(2**63), 5, 5, 2**63 - 1]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=key) == sorted(((i, crc(t)) for i, t in zip(ids, texts)), key=key)
    packed = packing.packed_pieces(corpus(spark, texts, ids), queries.tokenizer_file("word_bpe_49k.json")).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
