"""Corpus operators against brute force, round trips and odd inputs."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.llm import chroma, exact_dedup, induced_sort, jaccard, packing, piece_codec, quality, queries, shingles, suffix_dedup, token_files, url_filter, warc, word_encoder

SF = "/root/testdata/sf0.001"
WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
SCHEMA = "doc_id bigint, text string, id string, row string, key string, grp string"


def corpus(spark, texts, ids=None):
    """Documents with more columns whose names operators might use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", None, "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def odd_texts(seed=0):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(120)]
    out = [None, "", " \n\t ", "one", "one two", "One TWO", "a" * 5000, "a" * 700, " ".join(base), " ".join(base), " ".join(base).upper()]
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w[rng.randint(0, 30) :]))
    out += [" ".join(rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 80))) for _ in range(15)]
    return out + ["x" * 150 + out[8], "é" * 300, "\x00 nul", "tail " * 60]


EMPTY = []


def test_exact_groups(spark):
    texts = odd_texts() + odd_texts(1) + ["q" * 70, "q" * 71, "q" * 64, "q" * 320, "q" * 321, "q" * 320]
    ids = [*range(len(texts) - 2), None, 3]
    got = exact_dedup.exact_groups(corpus(spark, texts, ids)).collect()
    groups = collections.defaultdict(list)
    for i, t in zip(ids, texts):
        groups[t or ""].append(i)
    assert len(got) == len(texts)
    for r in got:
        members = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        keep = max((m for m in members if m is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(members), r.doc_id == keep)
    assert exact_dedup.exact_groups(corpus(spark, EMPTY)).count() == 0
    kept = exact_dedup.drop_exact_copies(corpus(spark, texts, range(len(texts))))
    odd = spark.createDataFrame([(1, "a", "p", 1.0), (2, "a", "q", 2.0), (2, "a", "r", 3.0)], "doc_id bigint, text string, __id string, row double")
    assert [(r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(odd).collect()] == [(2, "a")]
    assert kept.count() == len(groups) and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def brute_components(rows):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())) for i, t in rows}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * both >= 75 * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates(spark, seed):
    texts = odd_texts(seed) + odd_texts(seed + 5)
    want = brute_components(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(corpus(spark, texts)).collect()}
    assert got == want
    kept = jaccard.keep_one_of_each(corpus(spark, texts))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_odd_ids(spark):
    out = jaccard.near_duplicates(corpus(spark, ["a b c d e f", "a b c d e f", None], [None, 4, 4])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in out if r.n_shingles) == [(False, 4), (True, None)]
    assert jaccard.near_duplicates(corpus(spark, EMPTY)).count() == 0


def test_slices_of_a_key_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROW_MEMBERS", 3)
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 2)
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        w = [f"w{i}" for i in range(100)]
        for i in rng.sample(range(100), 1):
            w[i] = f"v{rng.randrange(5)}"
        texts.append(" ".join(w))
    links = {(a, b) for b in range(40) for a in range(b) if len(set(brute_components([(a, texts[a]), (b, texts[b])]).values())) == 1}
    rows = corpus(spark, texts).select("doc_id", "text")
    about = jaccard.shingle_info(rows, 5).withColumnRenamed("n_shingles", "size")
    found = jaccard.key_groups(rows, 5, 75, 100, 8).cache()
    ties = {(r.lead, r.member) for r in found.where("member is not null").collect()}
    apart = lambda df, c: df.withColumn(f"part_{c}", F.col(c))
    tried = {(r.a, r.b) for r in jaccard._across(found, lambda df, c: df, apart, about, 75, lambda df, _: df).collect()}
    assert len(links - ties) > 100 and links <= tried | ties
    want = brute_components(list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(corpus(spark, texts)).collect()} == want


def test_linked_sets_share_keys_and_sketches_bound():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.choice([5, 6, 8, 12, 33, 150, 400])
        a = [f"w{rng.randrange(400)}" for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, max(1, n // 25))):
            b[rng.randrange(len(b))] = "new"
        doc, h = shingles.shingle_sets([" ".join(a).encode(), " ".join(b).encode()])
        x, y = h[doc == 0], h[doc == 1]
        both = len(np.intersect1d(x, y))
        union = len(x) + len(y) - both
        if 100 * both >= 75 * union:
            lows = jaccard.bands(75, 500)
            assert np.intersect1d(jaccard.set_keys(x, lows, 75), jaccard.set_keys(y, lows, 75)).size
        p, q = (np.frombuffer(jaccard.sketch(s), "<u8")[None] for s in (x, y))
        w = min(p.shape[1], q.shape[1])
        assert np.bitwise_count(jaccard.fold(p, w) ^ jaccard.fold(q, w)).sum() <= union - both


def brute_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[j : j + length] for t in raw for j in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    texts = odd_texts() + [f"{i} " * 40 + passage + f" {i}" * 50 for i in range(6)] + [passage[:199], passage[:200], passage[30:] + passage[:100]]
    want = dict(enumerate(brute_repeats(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(corpus(spark, texts)).collect()}
    assert got == want
    assert suffix_dedup.repeat_report(corpus(spark, EMPTY)).count() == 0
    assert suffix_dedup.repeat_report(corpus(spark, [None, "b"], [None, None])).count() == 2


def test_long_text_is_read_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BITS", 11)
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(9000)).encode()
    runs = [(int(s) + k, int(h)) for _, start, n, h, *_ in suffix_dedup._runs([text], 200, 40) for s, m, h in zip(start, n, h) for k in range(m)]
    assert [p for p, _ in sorted(runs)] == list(range(9000 - 199))


def test_long_text_after_short_ones(spark, monkeypatch):
    rng = random.Random(2)
    short, long_ = (bytes(rng.choices(b"abcdefgh ", k=k)) for k in (100, 3 << 20))
    parts = suffix_dedup._runs([short, short, long_], 200, 40), suffix_dedup._runs([long_], 200, 40)
    mixed, alone = ([np.concatenate(x) for x in list(zip(*p))[1:]] for p in parts)
    assert all((x == y).all() for x, y in zip(mixed, alone))
    passage = "".join(rng.choices("ijklmnop", k=230))
    texts = [short.decode(), f"{long_.decode()}<{passage}>", f"{{{passage}}}"]
    got = {r.doc_id: [(x.begin, x.end) for x in r.spans] for r in suffix_dedup.remove_repeats(corpus(spark, texts).coalesce(1)).collect()}
    at = len(long_) + 1
    assert got == {0: [], 1: [(at, at + 230)], 2: [(1, 231)]}
    monkeypatch.setattr(suffix_dedup, "PIECE_BITS", 11)
    texts = [bytes(rng.choices(b"abc", k=k)) for k in (100, 1500, 900, 5000, 300)]
    places = lambda texts: sorted((int(d), int(s) + k, int(h)) for doc, start, n, h, *_ in suffix_dedup._runs(texts, 200, 40) for d, s, m, h in zip(doc, start, n, h) for k in range(m))
    assert places(texts) == [(d, p, h) for d, t in enumerate(texts) for _, p, h in places([t])]


def test_frequent_anchors_are_parted(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_REGIONS", 3)
    rng = random.Random(8)
    text = lambda k: "".join(rng.choices("abcdefghij ", k=k))
    passage, other = text(500), text(30)
    texts = [text(rng.randint(0, 90)) + passage[rng.randint(0, 30) :] + text(rng.randint(0, 90)) for _ in range(25)]
    texts += [texts[0][:320] + text(50), other + texts[1], other + texts[1][10:] + "x", passage * 3, "ab" * 400, "ab" * 333 + "c"]
    want = dict(enumerate(brute_repeats(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    runs = suffix_dedup.repeated_anchors(rows.withColumnRenamed("doc_id", "key"), 200, 40, 4)
    assert runs.where("hot and kind > 0").count() > 20
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(rows).collect()} == want


def test_cut_characters_stay_whole(spark):
    passage = "é€" * 60
    texts = ["è" + passage + "₭", "ê" + passage + "₮"]  # neighbours that begin or end with equal bytes
    rows = suffix_dedup.remove_repeats(corpus(spark, texts), characters=True).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == ["è₭", "ê₮"]
    assert [r.kept.decode("utf-8", "ignore") for r in suffix_dedup.remove_repeats(corpus(spark, texts)).orderBy("doc_id").collect()] != [r.kept for r in rows]


@pytest.mark.parametrize("in_memory", [1 << 20, 2])
@pytest.mark.parametrize("block", [1 << 17, 5])
def test_induced_sort(tmp_path, monkeypatch, in_memory, block):
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    rng = random.Random(5)
    scratch = induced_sort.Scratch(str(tmp_path), held=64 if block == 5 else 1 << 20)
    for _ in range(60):
        t = [rng.randint(1, rng.choice([1, 2, 3, 10])) for _ in range(rng.randint(1, 100))]
        if rng.random() < 0.3:
            t = t[:5] * rng.randint(1, 40)
        t.append(0)
        text = np.array(t, "<u2")
        seeds = induced_sort.sorted_seeds(text, scratch, in_memory)
        lcp = np.zeros(len(seeds), np.uint8)
        lcp[1:] = induced_sort.common_prefix(text, seeds[:-1], seeds[1:])
        pos, common = [], []
        induced_sort.induce(text, seeds, lcp, scratch, lambda p, c, _: (pos.extend(p.tolist()), common.extend(c.tolist())))
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert pos[::-1] == order

        def shared(a, b):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            return k

        assert common == [0, *(min(255, shared(order[i], order[i - 1])) for i in range(len(order) - 1, 0, -1))]


def test_recursion_on_files(tmp_path):
    """A string whose names do not fit the sort in memory, with arrays and queues in files."""
    base = np.random.default_rng(0).integers(2, 258, 150_000).astype("<u2")
    text = np.concatenate((base, base[:70_000], base[50_000:], [0])).astype("<u2")
    got = induced_sort.repeated_starts(text, 200, induced_sort.Scratch(str(tmp_path), held=1 << 16), 1000)
    seen = collections.Counter(text[i : i + 200].tobytes() for i in range(len(text) - 199))
    assert got[: len(text) - 199].tolist() == [seen[text[i : i + 200].tobytes()] > 1 for i in range(len(text) - 199)]


def test_queue_spills(tmp_path):
    q = induced_sort.SpillQueue(str(tmp_path), buffer=100)
    for k in range(50):
        rows = np.zeros(3, induced_sort.TUPLE)
        rows["pos"] = k
        q.push(k % 2, rows)
    want = [k for k in range(1, 50, 2) for _ in range(3)]
    assert q.file is not None and q.take(1, 4)["pos"].tolist() == want[:4] and q.take(1, 5, last=True)["pos"].tolist() == want[-5:]
    assert q.take(1)["pos"].tolist() == want[4:-5] and not len(q.take(1))
    q.close()


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file(name))


def test_special_tokens_in_texts():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok = tokenizer(name)
        texts = ["a <|endoftext|> b", "x<|endoftext|>", "É <|ENDOFTEXT|> ok", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endoftext|", "plain words, here", "", " "]
        for as_text in (False, True):
            tok.encode_special_tokens = as_text
            encoder = word_encoder.WordEncoder(queries.tokenizer_file(name), as_text)
            assert encoder.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("limit", [40, 800_000])
def test_odd_texts_and_forgotten_words(name, limit):
    tok, rng = tokenizer(name), random.Random(3)
    encoder = word_encoder.WordEncoder(queries.tokenizer_file(name), memo_limit=limit)
    bits = ["a", "b", " ", " ", "c", "D", "\n", "'s", ".", ",", "!", "é", "1", "\t", "<|endoftext|>", "日本", "\u2003", "\x1c", "İ", "ﬁ", "x" * 70, "\r\n", "don't", "  "]
    for _ in range(40):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(30)]
        assert encoder.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]
    assert limit > 40 or len(encoder.table.hashes) <= 500


def test_token_files(spark):
    texts = odd_texts() + ["a  b", " lead", "trail ", "x\n\ny", "it's ok!?", "<|endoftext|>"]
    tok, at = tokenizer("byte_bpe_50k.json"), 0
    got = {r.doc_id: r for r in token_files.token_file_documents(corpus(spark, texts), queries.tokenizer_file("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_file_documents(corpus(spark, EMPTY), queries.tokenizer_file("byte_bpe_50k.json")).count() == 0
    assert {r.doc_id for r in token_files.token_file_documents(corpus(spark, ["a", "b"], [None, 7]), queries.tokenizer_file("byte_bpe_50k.json")).collect()} == {None, 7}


def test_packing(spark):
    texts = odd_texts() * 3 + ["word " * 3000]
    path, tok = queries.tokenizer_file("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    rows = packing.packed_pieces(corpus(spark, texts), path).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.packed_pieces(corpus(spark, EMPTY), path).count() == 0


def test_hilbert_neighbours():
    cells = np.array([[a, b] for a in range(16) for b in range(16)])
    order = cells[np.argsort(packing.hilbert_key(cells, 4))]
    assert len(set(packing.hilbert_key(cells, 4))) == 256 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://a/", "x"), (1, None, "x"), (2, "http://b\r\n/%", None), (9, "u", ""), (None, "n", "x"), (5, "é", "ü" * 9000), (5, "é", "ü" * 9000)], "page_id bigint, url string, html string")
    back = warc.read_archives(warc.write_archives(pages, warc.fresh_path(spark, "warc"))).collect()
    assert len(back) == 7
    of = {(r.page_id, r.url): r for r in back}
    assert of[3, "http://a/"].refers_to == 1 and of[3, "http://a/"].record_type == "revisit" and of[3, "http://a/"].payload is None
    assert of[1, None].record_type == "response" and of[1, None].payload == b"x" and of[9, "u"].refers_to == 2
    assert of[2, "http://b\r\n/%"].payload_bytes == 0 and of[None, "n"].record_type == "response"
    assert of[5, "é"].payload_digest == base64.b32encode(hashlib.sha1(("ü" * 9000).encode()).digest()).decode()
    assert {r.record_type for r in warc.archive_round_trip(pages, min_revisit_bytes=2).where("page_id <> 5").collect()} == {"response"}
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_lost_records_are_noticed(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    archives = warc.write_archives(pages, warc.fresh_path(spark, "warc"))
    path = archives.first().path.removeprefix("file:").replace("///", "/")
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[: raw.rindex(b"\x1f\x8b\x08")])  # cut at a member's end
    with pytest.raises(Exception, match="19 records where 20 were written"):
        warc.read_archives(archives).collect()


def brute_warc(rows):
    first = {}
    for i, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    out = set()
    for i, html in rows:
        raw, lead = (html or "").encode(), first[html or ""]
        out.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == lead else "revisit", None if i == lead else lead))
    return out


def test_warc_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert {tuple(r) for r in warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == brute_warc(rows)
    odd = spark.createDataFrame([(i, "u", t, "x") for i, t in enumerate(["a", None, "", "a", "é", "a", "é"])], "page_id bigint, url string, html string, digest string")
    assert {tuple(r) for r in warc.archive_round_trip(odd).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == brute_warc([(r.page_id, r.html) for r in odd.collect()])


def test_damaged_records_are_refused():
    raw = warc.record_bytes(1, "u", b"payload", None)
    body = zlib.decompress(raw, 31)
    assert warc.parse_record(body)["payload"] == b"payload"
    for bad in (body.replace(b"payload", b"pay1oad"), body[:-1], body + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def judge(url, rules=url_filter.RULES):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en", "http://myexample.com/en/", "https://a.b.net/fr/x", "http://net/es/", "http://x.org/en/", "http://a://b.com/", "http://é.com/ü?q", "http://com", "http://com/", "http://.com/", "http://example.com:80/en/", "a\nhttp://b.com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(3, "http://")], "page_id bigint, url string")
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id])
    assert url_filter.judge_urls(pages.where("false")).count() == 0
    long_ = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "example.com/en/x"), (2, "http://" + "a." * 20_000 + "net/fr/"), (3, "http://" + "net." * 3000 + "x/es/")], "page_id bigint, url string")
    assert {r.page_id: r.rule for r in url_filter.judge_urls(long_).collect()} == {1: "example.com/en/", 2: "net/fr/", 3: None}


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 3000, 7)]
    levels = url_filter.build_cascade(universe, listed)
    got = {r.key for r in universe.where(url_filter.is_listed(levels, F.col("key"))).collect()}
    assert got == set(listed) and len(levels) > 1


def test_chroma(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((60, 64))
    vectors[20:40] = vectors[:20] + 0.01 * rng.standard_normal((20, 64))
    media = chroma.recordings(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, None), (60, None), (61, [])], "vec_id bigint, embedding array<double>"))
    rows = chroma.align(media, every=5).collect()
    match = {(r.rec_id, r.other_id): r for r in rows if r.kind == "match"}
    near = [(i, i + 20) for i in range(0, 20, 5)]
    assert sum(p in match for p in near) >= 0.9 * len(near)
    for a, b in near:
        if (a, b) in match:
            assert match[a, b].frames == 2 * (b % 9 - a % 9)
    prints = {r.id: np.frombuffer(r["print"], "<u4") for r in chroma.fingerprints(media, "id", "audio").where("id is not null").collect()}
    brute = set()
    for a in range(0, 60, 5):
        for b in range(60):
            best = min((e / (32 * n) for n, e in (chroma.bit_errors(prints[a], prints[b], o) for o in range(-20, 21)) if n >= chroma.LEAST_OVERLAP), default=1)
            if a != b and best <= chroma.MOST_ERRORS:
                brute.add((a, b))
    assert len(brute & match.keys()) >= 0.9 * len(brute)
    assert {r.rec_id for r in rows if r.kind == "member"} == set(range(62))


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = quality.score_quality(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").collect()
    right = sum(r.keep == (r.quality == 1) for r in scored) / len(scored)
    clean = [r for r in scored if r.quality == 1]
    assert right >= 0.93 and sum(r.keep for r in clean) >= 0.97 * len(clean)


def test_posteriors_against_brute_force(spark):
    """The formulas over the logits that come out: every document against the evidence of the others of its site."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    e = [r.quality if r.quality is not None else 1 / (1 + np.exp(-r.doc_logit)) for r in rows]
    rate = np.mean(e)

    def sums(key):
        out = collections.defaultdict(lambda: [0.0, 0])
        for r, x in zip(rows, e):
            out[key(r)][0] += x
            out[key(r)][1] += 1
        return out

    def strength(groups, prior):
        big = {k: v for k, v in groups.items() if v[1] > 1}
        n = sum(v[1] for v in big.values())
        spread = sum(v[1] * (v[0] / v[1] - prior[k]) ** 2 for k, v in big.items())
        noise, scale = (sum(w * prior[k] * (1 - prior[k]) for k, w in x) for x in ([(k, 1) for k in big], [(k, v[1]) for k, v in big.items()]))
        between = (spread - noise) / n
        return min(1e6, max(1.0, scale / n / between - 1)) if between > 1e-12 else 1e6

    hosts, paths = sums(lambda r: r.source), sums(lambda r: (r.source, r.lang))
    outer = strength(hosts, dict.fromkeys(hosts, rate))
    inner = strength(paths, {k: (hosts[k[0]][0] + outer * rate) / (hosts[k[0]][1] + outer) for k in paths})
    logit = lambda p: np.log(p / (1 - p))
    for r, x in zip(rows, e):
        host = (hosts[r.source][0] - x + outer * rate) / (hosts[r.source][1] - 1 + outer)
        path = (paths[r.source, r.lang][0] - x + inner * host) / (paths[r.source, r.lang][1] - 1 + inner)
        score = 1 / (1 + np.exp(-(r.doc_logit + logit(path) - logit(rate))))
        assert abs(r.host_rate - host) < 1e-9 and abs(r.path_rate - path) < 1e-9 and abs(r.score - score) < 1e-9 and r.keep == (r.score >= 0.5)


def test_sparse_sites_shrink(spark):
    docs = spark.createDataFrame([(i, "plain text", "big" if i < 400 else "tiny", "p") for i in range(401)], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)] + [(400, 0), (None, 1)], "doc_id bigint, quality int")
    rates = {r.source: r.path_rate for r in quality.score_quality(docs, labels).join(docs.select("doc_id", "source"), "doc_id").collect()}
    assert 0.3 < rates["tiny"] < 0.5 and abs(rates["big"] - 0.5) < 0.05
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "s", None)], docs.schema)
    assert quality.score_quality(odd, labels.where("false")).where("keep").count() == 2
    assert quality.keep_good(docs.where("false"), labels).count() == 0


def test_pieces(spark):
    model = queries.tokenizer_file("piece_bpe_32k.model")
    texts = odd_texts() + ["  two", "end  ", "a\n\nb\t c", "日本 語", "<s> <0x0A>", "😀", " " * 30_000, "a" + " " * 9_999 + "b", "x" * 4_000]
    codec = piece_codec.PieceCodec(model)
    want = [np.array(x, "<u4").tobytes() for x in codec.sp.encode([t or "" for t in texts])]
    assert codec.encode([t or "" for t in texts]) == want
    rows = piece_codec.decode_pieces(piece_codec.encode_pieces(corpus(spark, texts), model), model).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in rows} == {i: (w, t or "") for i, (w, t) in enumerate(zip(want, texts))}
    assert piece_codec.piece_report(corpus(spark, EMPTY), model).count() == 0


def test_unigram_segmentation_is_the_best():
    codec = piece_codec.PieceCodec.__new__(piece_codec.PieceCodec)
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(14)} | {"a", "b"})
    codec.ids = {p: i for i, p in enumerate(pieces)}
    codec.scores = {p: -rng.random() * 3 for p in pieces}
    codec.longest, codec.merging, codec.memo, codec.byte_ids = 4, False, {}, {}
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(40)})
    codec._segment(words)

    def best(w):
        return max((codec.scores[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in codec.scores), default=-1e9) if w else 0.0

    for w in words:
        got = sum(codec.scores[pieces[i]] for i in np.frombuffer(codec.memo[w], "<u4"))
        assert abs(got - best(w)) < 1e-9
