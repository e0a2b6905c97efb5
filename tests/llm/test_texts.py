"""Operators 1, 2, 3, 5, 7 and 10 against brute force, with odd texts."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tempora.llm import common, packing, quality, rangecoder, sharding, simhash, tokenfile, tokens, urlfilter
from tempora.llm.queries import URL_RULES, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, part int, key string, length string, _b int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    None, "", " ", "one", "one two", "The quick brown fox jumps over the lazy dog near the river bank", "the QUICK brown fox jumps over the lazy dog near the river bank",
    "tabs\tand\nlines\r\nand\x0bmore\x0c", "é É ünïcode ÀÉ", "<|endoftext|> as text", "  double  spaces ", "same text", "same text", "same text", LONG, LONG + " tail", "\u00a0non breaking\u2003space", "🙂 emoji 🙂",
]


def docs(spark, texts=TEXTS, ids=None):
    rows = [(ids[i] if ids else i, t, None, None, None, "x", "r", 1, "k", "l", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """With a null doc_id and a repeated row."""
    return docs(spark, [*TEXTS, "null id", TEXTS[5]], [*range(len(TEXTS)), None, 5])


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in w]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(s))


@pytest.mark.parametrize("tile", [65_536, 3])
def test_simhash_groups(spark, tile):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(400)]
    long_texts = [" ".join(rng.choice(vocabulary, 400)) for _ in range(12)]
    texts = TEXTS + long_texts + [" ".join(t.split()[:-1] + ["other"]) for t in long_texts]
    df = docs(spark, [*texts, "null id", texts[5]], [*range(len(texts)), None, 5])
    rows = [(i, fingerprint(t)) for i, t in [*enumerate(texts), (None, "null id"), (5, texts[5])]]
    n = len(rows)
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    want = sorted([(rows[i][0], f"{rows[i][1]:016x}", min((rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None), default=None)) for i in range(n)], key=str)
    marked = common.materialize(simhash.fingerprints(df), "test")
    assert sorted([f"{r.fp & (1 << 64) - 1:016x}" for r in marked.collect()]) == sorted(w[1] for w in want)
    if tile == 3:  # several tiles of a bit count
        fps = marked.select("fp").distinct()
        got = simhash.fingerprint_links(fps, 3, tile).collect()
        plain = {(a.fp, b.fp) for a in fps.collect() for b in fps.collect() if a.fp < b.fp and ((a.fp ^ b.fp) & (1 << 64) - 1).bit_count() <= 3}
        assert {tuple(sorted((r.a, r.b))) for r in got} <= plain and bool(got) == bool(plain)
    found = simhash.near_duplicates(df).select("doc_id", simhash.hex64("fp").alias("f"), "component_id").collect()
    assert sorted(map(tuple, found), key=str) == want
    assert len(set(w[2] for w in want)) < n - 6


def test_no_documents(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert simhash.near_duplicates(none).count() == sharding.shard(none, 4).count() == quality.classify(none, labels).count() == 0
    assert tokenfile.token_files(none, tokenizer("byte_bpe_50k.json")).count() == packing.pack(none, tokenizer("word_bpe_49k.json")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert urlfilter.judge(pages, rules).count() == 0


def test_shards_are_even_and_gapless(spark):
    rng = np.random.default_rng(1)
    texts = TEXTS[:14] + ["x" * int(k) for k in rng.pareto(1.2, 3000) * 40 % 3000] + ["hot text"] * 4000 + ["warm text"] * 1600
    df = docs(spark, [*texts, "null id", texts[5]], [*range(len(texts)), None, 5])
    got = sharding.shard(df, 8, ranges_per_shard=24, sample=4000).collect()
    assert len(got) == len(texts) + 2
    sizes = np.bincount([r.shard for r in got], [r["size"] for r in got], 8)
    assert sizes.max() <= 1.03 * sizes.mean() and sizes.min() >= 0.97 * sizes.mean()
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    raw = [(i, (t or "").encode()) for i, t in [*enumerate(texts), (None, "null id"), (5, texts[5])]]
    assert sorted([(r.doc_id, r["size"], r.text_crc32) for r in got], key=str) == sorted([(i, len(t) + 16, zlib.crc32(t)) for i, t in raw], key=str)
    bytes_of, shards_of = {}, {}
    for r in got:
        bytes_of[r.text_crc32] = bytes_of.get(r.text_crc32, 0) + r["size"]
        shards_of.setdefault(r.text_crc32, set()).add(r.shard)
    share = sum(bytes_of.values()) / 8
    assert bytes_of[zlib.crc32(b"hot text")] > share > bytes_of[zlib.crc32(b"warm text")] > share / 2
    assert {t for t, s in shards_of.items() if len(s) > 1} == {zlib.crc32(b"hot text")}


def plain_shards(rows, shards, ranges, sample, rounds):
    """The operator's steps in plain loops over rows of (doc_id, key, row, size, hash of each turn)."""
    total, wanted = sum(r[3] for r in rows), shards * ranges
    share, most = total / shards, 1.5 * total / wanted

    def draw(own, size, expected, turn):
        return sorted((k, r, max(float(s), max(1, size) / expected)) for _, k, r, s, *h in own if h[turn] % (1 << 30) / (1 << 30) < s * (expected / max(1, size)))

    def quantiles(drawn, parts):
        out, step = set(), np.array([w for *_, w in drawn]).sum() / parts if drawn else 0
        for i in range(1, parts if drawn else 1):
            seen = 0.0
            for key, row, w in drawn:
                seen += w
                if seen >= step * i or (key, row, w) == drawn[-1]:
                    out.add((key, row if bytes_of[key] > share else -1))
                    break
        return out

    bytes_of = {}
    for _, k, _, s, *_ in rows:
        bytes_of[k] = bytes_of.get(k, 0) + s
    splits = quantiles(draw(rows, total, sample, 0), wanted)
    for turn in range(1, rounds + 1):
        parts = {}
        for r in rows:
            parts.setdefault(sum(split <= (r[1], r[2]) for split in splits), []).append(r)
        sizes = {p: sum(r[3] for r in own) for p, own in parts.items()}
        over = {p for p, own in parts.items() if sizes[p] > most and len(own) > 1}
        if not over or turn == rounds:
            break
        drawn = draw([r for p in over for r in parts[p]], sum(sizes[p] for p in over), min(sample, 200 * len(over) + 1000), turn)
        more = set()
        for p in over:
            own = {(r[1], r[2]) for r in parts[p]}
            more |= quantiles([d for d in drawn if d[:2] in own], math.ceil(sizes[p] / (total / wanted)))
        if more <= splits:
            break
        splits |= more
    load, shard_of = [0] * shards, {}
    for p in sorted(parts, key=lambda p: (-sizes[p], p)):
        emptiest = min(range(shards), key=lambda s: (load[s], s))
        load[emptiest] += sizes[p]
        shard_of.update({r[0]: emptiest for r in parts[p]})
    return shard_of, len(splits)


@pytest.mark.parametrize("shards,ranges,sample", [(5, 4, 40), (3, 10, 400), (7, 1, 30)])
def test_shards_by_plain_loops(spark, shards, ranges, sample):
    """Splitters, subdivision and assignment; a group of equal texts over a share is divided, a smaller one is not."""
    rng = random.Random(shards)
    texts = ["x" * rng.randint(0, 400) + str(k) for k in range(260)] + ["hot text " * 20] * 240 + ["a pair"] * 9 + [None] * 5 + ["y" * 30_000]
    rng.shuffle(texts)
    df = docs(spark, texts)
    rows = sharding.records(df)
    seen = [tuple(r) for r in rows.select("doc_id", "key", "row", "size", *[F.xxhash64("key", "row", F.lit(t)) for t in range(4)]).collect()]
    want, splits = plain_shards(seen, shards, ranges, sample, 4)
    got = {r.doc_id: r.shard for r in sharding.shard(df, shards, ranges_per_shard=ranges, sample=sample).collect()}
    assert got == want and splits > 0
    assert len({got[i] for i, t in enumerate(texts) if t == "a pair"}) == 1
    assert ranges == 1 or len({got[i] for i, t in enumerate(texts) if t and t.startswith("hot")}) > 1


def test_a_long_text_takes_a_shard(spark):
    got = sharding.shard(docs(spark, [LONG, *TEXTS[:14]] + ["short"] * 20), 3).collect()
    own = next(r for r in got if r.doc_id == 0)
    assert len(got) == 35 and own["size"] == len(LONG) + 16
    assert sum(r["size"] for r in got if r.shard == own.shard) - own["size"] <= sum(r["size"] for r in got) / 100


def judge_plainly(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("limit", [50_000, 1])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    urls = [None, "", "nothing", "http://", "http://Example.ORG/es/x?y=://z", "https://a.example.org/en/12#t", "http://example.com", "http://x.com/fr/", "http://x.com/de/?q", "http://evilexample.org/es/", "ftp://org/es", "a://b://c/d", "http://x.net/\nline", "http://x.com/fr/", "http://..com/fr/1", "HTTP://É.COM/de/ü"]
    pages = spark.createDataFrame([(i if i else None, u, None, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string")
    rules = [*URL_RULES, ("x.com", "/", "block"), ("x.com", "/", "allow")]
    table = spark.createDataFrame([*rules, (None, "/", "block"), *rules], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, table).collect()}
    assert got == {(i if i else None): judge_plainly(u, rules) for i, u in enumerate(urls)}
    none = urlfilter.judge(pages, table.limit(0), "block").collect()
    assert len(none) == len(urls) and {(r.rule, r.verdict) for r in none} == {(None, "block")}


def plain_ids(name):
    """text -> ids as bytes, by the library as it is."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer(name))
    return lambda t: np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


SPECIAL = ["a b <|endoftext|> c", "<|startoftext|>", "x<|startoftext|>y <|endoftext|>", "a <|endoftext|", "<|ENDOFTEXT|> b"]
MIXED = ["it's don't we'll", "a\n\nb", "x.\ny", "ÀÉ ßẞ İ", "1,234.5 (x) -y", "\n start", "end \n", "Word word WORD word, Word!?", "\u0149x ß² ½ a", "nul\x00 byte", "l'été d'une", "a\n,b ,c\n'd", "\n", "n\no p\nq"]


@pytest.mark.parametrize("name,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(monkeypatch, name, keeps):
    plain, own = plain_ids(name), tokens.Encoder(tokenizer(name), keeps, limit=300)
    rng = np.random.default_rng(8)
    marks = list("aBcé ß1.,'\n-¿ ")
    drawn = ["".join(rng.choice(marks, int(n))) for n in rng.integers(0, 40, 2000)]
    texts = [*TEXTS, *SPECIAL, *MIXED, *drawn]
    for together, some in ((64, texts), (3, texts[::-1]), (64, texts[:300])):
        monkeypatch.setattr(tokens, "_TOGETHER", together)
        ids, ends = own.encode(pa.array(some, pa.string()))
        assert len(ends) == len(some) + 1
        for t, lo, hi in zip(some, ends, ends[1:]):
            assert ids[lo:hi].tobytes() == plain(t), t
    assert plain(SPECIAL[0]) == np.array({True: [64, 275, 220, 50256, 269]}.get(keeps) or own.lib.encode(SPECIAL[0], add_special_tokens=False).ids, "<u4").tobytes()
    assert [x.tolist() for x in own.encode(pa.array([], pa.string()))] == [[], [0]]


@pytest.mark.parametrize("ids", [[], [0], [5] * 10_000, list(range(3000)), [2**32 - 1, 0, 2**19, 7] * 900, "random", "text"])
def test_range_coder_round_trip(ids):
    rng = np.random.default_rng(2)
    if ids == "random":
        ids = rng.integers(0, 50_257, 40_000)
    elif ids == "text":
        ids = np.tile(rng.integers(0, 900, 700), 100)
    ids = np.array(ids, np.uint32)
    data = rangecoder.encode(ids)
    assert np.array_equal(rangecoder.decode(data), ids)
    if len(ids) > 60_000:
        assert len(data) < len(ids)  # well under a byte an id where contexts repeat
    if len(data) > 40:
        with pytest.raises(Exception):  # noqa: B017  a checksum, or what the damage makes of the block
            rangecoder.decode(data[:-5] + bytes(5 if x == 0 else 0 for x in data[-5:]))


def test_blocks_are_independent(monkeypatch):
    monkeypatch.setattr(rangecoder, "BLOCK", 1000)
    ids = np.arange(3500, dtype=np.uint32) % 37
    data = rangecoder.encode(ids)
    first, size = rangecoder._decode_block(memoryview(data))
    assert np.array_equal(first, ids[:1000])
    assert np.array_equal(rangecoder.decode(data[size:]), ids[1000:])


def test_token_files(spark):
    plain = plain_ids("byte_bpe_50k.json")
    ids = [*range(len(TEXTS + SPECIAL)), None, 5]
    texts = [*TEXTS, *SPECIAL, "null id", TEXTS[5]]
    got = tokenfile.token_files(docs(spark, texts, ids), tokenizer("byte_bpe_50k.json")).collect()
    end = np.array([2], "<u4").tobytes()
    parts = {(i, zlib.crc32(plain(t) + end), len(plain(t)) // 4 + 1) for i, t in zip(ids, texts)}
    assert {(r.doc_id, r.ids_crc32, r.n_tokens) for r in got} == parts and len(got) == len(ids)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)


@pytest.mark.parametrize("size,small,groups", [(2048, 384, 1024), (64, 16, 5)])
def test_packing(spark, size, small, groups):
    plain = plain_ids("word_bpe_49k.json")
    rng = np.random.default_rng(3)
    texts = TEXTS + SPECIAL + [" ".join(rng.choice(["a", "cat", "dog", "house", "tree"], int(n))) for n in rng.integers(0, 150, 400)]
    df = docs(spark, [*texts, "null id", texts[5]], [*range(len(texts)), None, 5])
    got = packing.pack(df, tokenizer("word_bpe_49k.json"), size=size, small=small, groups=groups).collect()
    want = []
    for i, t in [*enumerate(texts), (None, "null id"), (5, texts[5])]:
        ids = plain(t) + bytes(4)
        n = len(ids) // 4
        want += [(i, p, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)])) for p, s in enumerate(range(0, n, size))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.03 * total / size + 2


def best_fit_decreasing(histogram, size):
    rooms, bins = [0] * (size + 1), 0
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            room = next((r for r in range(n, size + 1) if rooms[r]), None)
            if room is None:
                room, bins = size, bins + 1
            else:
                rooms[room] -= 1
            rooms[room - n] += 1
    return bins


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(4)
    histogram = {int(n): int(c) for n, c in zip(rng.permutation(2048)[:300] + 1, rng.integers(1, 50, 300))}
    rows = packing.plan(histogram, 2048, 384, 4096)
    for n, c in histogram.items():
        ranks = sorted((r, k) for m, r, k, _, _ in rows if m == n)
        assert [r for r, _ in ranks] == list(np.cumsum([0, *[k for _, k in ranks[:-1]]])) and sum(k for _, k in ranks) == c
    fill = {}
    for n, _, k, first, _ in rows:
        for s in range(first, first + k):
            fill[s] = fill.get(s, 0) + n
    assert max(fill.values()) <= 2048 and len(fill) <= 1.005 * best_fit_decreasing(histogram, 2048)


def test_a_thousand_pieces_are_rounded_in_groups():
    rng = np.random.default_rng(6)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, 2049, 1000), return_counts=True))}
    large = sum(c for n, c in histogram.items() if n > 1000)
    grouped = packing.grouping(histogram, 1000, 48)
    assert len(grouped) <= 48 and all(sum(c for _, c in parts) >= large // 48 for top, parts in grouped.items() if top != min(grouped))
    assert any(n < top for top, parts in grouped.items() for n, _ in parts) and all(n <= top for top, parts in grouped.items() for n, _ in parts)
    fill = {}
    for n, _, k, first, _ in packing.plan(histogram, 2048, 1000, 48):
        for s in range(first, first + k):
            fill[s] = fill.get(s, 0) + n
    assert max(fill.values()) <= 2048 and len(fill) <= 1.01 * best_fit_decreasing(histogram, 2048)


def test_configurations_are_the_optimum_of_a_small_program():
    """Sizes 6, 5, 4 in room 10: pairs of 5, and 6 with 4; what is left of 4s stands in pairs."""
    got = packing.configurations([6, 5, 4], [30, 21, 50], 10)
    assert abs(sum(t for _, t in got) - (30 + 10.5 + 10)) < 1e-6
    assert all(sum(n * k for n, k in zip([6, 5, 4], c)) <= 10 for c, _ in got)


def test_quality_learns_and_never_sees_held_out(spark):
    rng = np.random.default_rng(5)
    good, bad = ["meadow", "river", "gently", "because", "therefore", "light"], ["buy", "click", "$$$", "free!!!", "xx", "win"]
    texts = [" ".join(rng.choice(good if i % 2 else bad, 30)) for i in range(600)]
    df = docs(spark, [*texts, None, "", LONG], [*range(600), 600, 601, None])
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(600)] + [(None, 1, 0, "y"), (3, None, 0, "z")], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(600) if got[i].held_out]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0] and not got[None].held_out
    assert np.mean([(got[i].score > 0.5) == (i % 2 == 1) for i in held]) > 0.95
    flipped = labels.selectExpr("doc_id", f"case when doc_id in ({','.join(map(str, held))}) then 1 - quality else quality end as quality")
    again = {r.doc_id: r.score for r in quality.classify(df, flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in held)


def test_quality_without_labels(spark):
    got = quality.classify(docs(spark), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(TEXTS) and {round(r.score, 6) for r in got} == {0.5}


def test_word_vectors_features_and_scores_by_hand(spark):
    """Context sums, pooling and the forward pass in plain loops over words."""
    texts = [*TEXTS[:14], "a b a, b... c_c 12x\ty", "l'été -- über 3.5%", "  "]
    words_of = lambda t: [xxhash.xxh32_intdigest(w) % quality.BUCKETS for blank in (t or "").split() for w in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", blank)]
    places, signs = quality.index_vectors()
    own, around = np.zeros((quality.BUCKETS, quality.DIMS)), np.zeros((quality.BUCKETS, quality.DIMS))
    for b in range(quality.BUCKETS):
        for at, sign in zip(places[b], signs[b]):
            own[b, at] += sign
    for t in texts:
        words = words_of(t)
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    for at, sign in zip(places[words[j]], signs[words[j]]):
                        around[w, at] += sign
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    vectors = (unit(own) + unit(around)).astype(np.float32)
    assert np.allclose(quality.word_vectors(docs(spark, texts)), vectors, atol=1e-6)
    both = np.hstack([vectors, vectors * vectors])
    pooled = quality.pool(pa.array(texts, pa.string()), both)
    for t, x in zip(texts, pooled):
        words, blanks = words_of(t), (t or "").split()
        want = [*np.mean([both[w] for w in words], 0), len(set(blanks)) / len(blanks), np.log1p(len(words)) / 10] if words else np.zeros(quality.FEATURES)
        assert np.allclose(x, want, atol=1e-5), t
    rng = np.random.default_rng(3)
    net = quality.Network().fit(rng.normal(size=(200, quality.FEATURES)), rng.integers(0, 2, 200))
    for x in pooled.astype(np.float64):
        hidden = [np.tanh(sum((x[i] - net.mean[i]) / net.spread[i] * net.w1[i, h] for i in range(len(x))) + net.b1[h]) for h in range(net.hidden)]
        assert abs(net.score(x[None, :])[0] - 1 / (1 + np.exp(-(np.dot(hidden, net.w2) + net.b2) / net.temperature))) < 1e-9


def test_token_files_roll_over_and_have_several_blocks(spark):
    plain, end = plain_ids("byte_bpe_50k.json"), np.array([2], "<u4").tobytes()
    texts = ["w1 w2 " * 350_000, "", None, *[f"text number {i}" for i in range(60)]]
    folder = common.scratch(spark, "rolled")
    manifest = common.materialize(tokenfile.write_files(docs(spark, texts), folder, tokenizer("byte_bpe_50k.json"), True, ids_per_file=100), "manifest")
    sizes = [r.n_tokens for r in manifest.collect()]
    assert len(sizes) >= 4 and max(sizes) > rangecoder.BLOCK and sorted(sizes)[-2] <= 100
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenfile.read_files(spark, folder, manifest).collect()}
    assert got == {i: (len(plain(t)) // 4 + 1, zlib.crc32(plain(t) + end)) for i, t in enumerate(texts)}
