"""Mixing, centroid clustering and alignment against SQL, brute force and odd inputs."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.llm import alignment, centroids, mixing, queries
from tests.llm.test_operators import SF, odd_texts

CLASHING = "doc_id bigint, text string, source string, size string, __size string, w string, chance string, id string, pair string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "a", "b", "c", "d", "e", "f") for i, t, s in rows], CLASHING)


@pytest.mark.parametrize("name", ["op11_mixing", "op12_centroids"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns).collect()
    key = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r)
    assert sorted(map(key, got)) == sorted(map(key, want.fetchall()))


def shares(sizes, percent, weights=(5, 2, 1), most=3):
    """Targets by handing on what is above the limit, again and again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()) * percent / 100, set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = {s for s in free if target[s] >= most * sizes[s]}
        if not above:
            return target | {s: most * sizes[s] for s in stopped}
        stopped |= above


@pytest.mark.parametrize("heavy", [4096, 3])
def test_mixing(spark, monkeypatch, heavy):
    monkeypatch.setattr(mixing, "HEAVY", heavy)
    rng = random.Random(heavy)
    names = ["é", "z", "Z", "", None, "a", "x" * 2000, "\U0001f600", "￿", "empty"]
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40))) + "\t\n", names[min(int(rng.expovariate(0.5)), 8)]) for i in range(3000)]
    rows += [(3000, None, "empty"), (3001, " \x0b\n", "empty"), (None, "a b c", "z"), (None, "a b c", "z"), (7, "other text", "a"), (3002, "long " * 100_000, "a")]
    sizes, by_doc = collections.Counter(), collections.defaultdict(list)
    for i, t, s in rows:
        n = len([x for x in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x])
        sizes[s] += n
        by_doc[i, t, s].append(n)
    docs = documents(spark, rows)
    got = mixing.mix_report(docs).collect()
    target = shares(sizes, 100)
    source = collections.defaultdict(list)
    for i, t, s in rows:
        source[i].append(s)
    assert sorted(r["size"] for r in got) == sorted(n for v in by_doc.values() for n in v)
    taken = collections.Counter()
    for r in got:
        s = next(s for s in source[r.id] if sizes[s] == r.source_size and abs(target[s] - r.target) < 1e-6)
        taken[s] += r.taken
        assert r.taken == r.copies * r["size"] <= 3 * r["size"] and r.copies in (int(r.rate), int(r.rate) + 1)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-3
    for s in sizes:
        if s != "a" and sizes[s] > 2000:
            assert abs(taken[s] - target[s]) < 0.15 * target[s] + 100
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs.repartition(3)).collect()))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix_report(docs, percent=300).agg(F.min("rate"), F.max("rate")).first() == (0.0, 3.0)
    assert mixing.mix_report(documents(spark, [])).count() == 0 == mixing.mix(documents(spark, [])).count()
    none = mixing.mix_report(documents(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0)] * 2


def brute_clusters(rows, k, rounds, dims=64):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((-1 if i is None else i), nearest(v)[1], nearest(v)[0]) for i, v in kept), c


def test_clusters(spark):
    rng = np.random.default_rng(1)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f(rng.standard_normal(64))) for i in range(150)] + [(200 + i, f(rng.integers(-2, 3, 64) / 64)) for i in range(60)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [1.0] * 63 + [float("nan")]), (305, [1.0] * 63 + [float("inf")]), (None, f([0.5] * 64)), (5, rows[7][1]), (5, rows[5][1])]
    rows += [(400 + i, rows[3][1]) for i in range(80)]
    schema = "vec_id bigint, embedding array<float>, cluster string, id string, v string, c string"
    table = lambda r: spark.createDataFrame([(i, v, "x", "y", "z", "w") for i, v in r], schema)
    for k, some in ((16, rows), (16, rows + [(500, f([3e38] + [0.0] * 63)), (501, f([-3e38] * 64)), (502, [5e7] * 64)]), (7, rows[:5])):
        want, c = brute_clusters(some, k, 3)
        got = centroids.cluster_report(table(some), k=k).collect()
        assert sorted((-1 if r.id is None else r.id, r.cluster, r.distance) for r in got) == [(i, j, d if d < 2**63 else None) for i, j, d in want]
        inertia = [sum(d for _, o, d in want if o == j) for j in range(len(c))]
        assert all(r.cluster_inertia == (inertia[r.cluster] if inertia[r.cluster] < 2**63 else None) for r in got)
        assert {r.inertia for r in got} == {sum(inertia) if sum(inertia) < 2**63 else None}
        assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest() for r in got)
    assert centroids.cluster_report(table([])).count() == 0 == centroids.cluster_report(table(rows[211:215])).count()


def test_zero_goes_to_the_smaller_number():
    fight = centroids.Tournament([[0, 0], [4, 0], [0, 4], [4, 4], [0, 0]], 2)
    points = np.array([[x, y] for x in range(-1, 6) for y in range(-1, 6)])
    best, far = fight.nearest(points)
    want = [min((int(((p - c) ** 2).sum()), j) for j, c in enumerate(fight.exact.astype(int))) for p in points]
    assert [(d, j) for j, d in zip(best.tolist(), far.tolist())] == want


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters = alignment._byte_letters()
    rows, links = [], []
    for t in texts:
        t = t or ""
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        want = (" " + t).encode()
        if not t or b"".join(ba) != want or b"".join(bb) != want:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ea, eb = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
        cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
        own = [(x, y) for x, e, s in zip(ia, ea, ba) for y, g, u in zip(ib, eb, bb) if e - len(s) < g and g - len(u) < e] if len(ia) < 4000 else None
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, e in zip(ia, ea) if low < e <= c) + "|" + ",".join(str(i) for i, e in zip(ib, eb) if low < e <= c)) if len(ia) < 4000 else None
            low = c
        rows.append((len(ia), len(ib), len(cuts), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    count = collections.Counter(x for own in links for x in own)
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = [(*r, sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own)) for r, own in zip(rows, links)]
    pairs = {x: (sum(x in own for own in map(set, links)), n, n == best[x[1]]) for x, n in count.items()}
    return out, pairs


ODD = [
    "  two spaces first", "ends with space ", "in  side", "a\n b", "a \nb", "tab\t and", "x  y", "x  y", "z  z", "under▁score", "▁", "<|endoftext|> and <s> <0x41> <unk>", "nul \x00 here", "\x1c \x1d a",
    "emoji \U0001f600\U0001f600 ok", "日本語 テキスト", "é" * 200, "don't we'll I'm", "   ", " ", "\n", "a" * 3000, "x \x85y", "12345 67,890.12", "fin​ ​al", "CamelCase foo_bar  \n\n\n    indented", "ﬁ ligature ́ mark",
]


def check_alignment(spark, texts, **patch):
    want, pairs = brute_alignment(texts)
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    rows, scores = alignment.align(docs, queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model"))
    got = {r.id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in rows.collect()}
    assert {i: got[i] for i in range(len(texts)) if got[i] != want[i]} == {} and len(got) == len(texts)
    assert {(r.a, r.b): (r.docs, r.links, r.best) for r in scores.collect()} == pairs


def test_alignment(spark):
    rng = random.Random(3)
    texts = ODD + odd_texts() + odd_texts(5)
    letters = ["a", "B", "9", " ", "  ", "\n", "\t", "'", "é", "▁", " ", ".", "\U0001f600", "\x00", "<"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    check_alignment(spark, texts + texts[:40])


def test_alignment_in_small_chunks_forgetting_words(spark, monkeypatch):
    """Workers are forked from this process only at times, so the batch interface is used directly as well."""
    words = alignment.Aligner(queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    texts = ODD + odd_texts(2)
    want, _ = brute_alignment(texts)
    for start in range(0, len(texts), 3):
        numbers, digests, doc, _ = words.batch([t or "" for t in texts[start : start + 3]])
        assert [(*map(int, n), d) for n, d in zip(numbers, digests)] == [w[:5] for w in want[start : start + 3]]
        assert np.bincount(doc, minlength=len(digests)).tolist() == numbers[:, 3].tolist()


def test_containers():
    rng = np.random.default_rng(2)
    key = np.unique(np.concatenate((rng.integers(0, 40 * alignment.CHUNK_DOCS, 3000), np.arange(alignment.CHUNK_DOCS // 2) * 2 + 50 * alignment.CHUNK_DOCS)))
    pair, doc, times = key // alignment.CHUNK_DOCS, key % alignment.CHUNK_DOCS, rng.geometric(0.4, len(key))
    back = collections.Counter()
    for c in alignment.containers(pair, doc, times):
        dense = c.column(2)[0].as_py()
        row, d = alignment.members(dense, c.column(4))
        assert np.bincount(row, minlength=c.num_rows).tolist() == c.column(3).to_pylist()
        for r, x in zip(row.tolist(), np.asarray(d).tolist()):
            plane = c.column(1)[r].as_py()
            back[c.column(0)[r].as_py(), x] += 1 if plane == 0 else 1 << (plane - 1)
    assert back == dict(zip(zip(pair.tolist(), doc.tolist()), times.tolist()))


def test_alignment_of_odd_rows(spark):
    rows, scores = alignment.align(documents(spark, []), queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model"))
    assert rows.count() == 0 == scores.count()
    odd = documents(spark, [(None, "same text", "a"), (None, "same text", "a"), (4, "same text", "b"), (4, None, "b"), (-(2**63), "word " * 60_000 + "end", "c")])
    rows, _ = alignment.align(odd, queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model"))
    got = sorted(((r.id is None, r.id or 0, r.n_a, r.n_groups, r.count_sum) for r in rows.collect()))
    assert [g[2] for g in got] == [60_001, 0, 2, 2, 2] and got[0][4] == 60_000**2 + 1
