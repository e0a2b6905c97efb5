"""Operators 11, 12 and 13 against brute force and the library, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from operator import mul

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import divergence, negatives, pieces, queries

from .test_search import odd_vectors, usable

DOCS = "doc_id long, text string, lang string, source string, term string, n long, g int, block int, ids int, decoded int"


def docs(spark, rows):
    """rows: text, lang, source; the other columns bear names that the operators use inside."""
    return spark.createDataFrame([(i, *r, "x", 1, 2, 3, 4, 5) for i, r in enumerate(rows)], DOCS)


def odd_docs(seed=5):
    rng = random.Random(seed)
    words = ["Apple", "apple", "pear-tree", "don't", "été", "ÉTÉ", "日本", "x1y2", "naïve", "zz", "B", "ﬁ", "a b", "kiwi", "fig"]
    rows = [(" ".join(rng.choices(words, [rng.random() for _ in words], k=rng.randint(0, 30))), rng.choice(["en", "fr", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "s3", "s3", None, ""])) for _ in range(120)]
    rows += [(None, "en", "s9"), ("", "de", "s1"), ("1 2 3", "de", "s2"), ("once only", "de", "s3"), ("lone lone lone", "it", "s1"), ("lone", "it", "s1"), ("lone", "it", "s1")]
    return rows + [("word " * 40_000 + "Zebra", "en", "s1"), ("\u0000NUL\u0001a[b]", "en", "s1")] + rows[:3] * 2


def brute_audit(rows, least=3, top=200):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    langs = defaultdict(lambda: defaultdict(list))
    for t, lang, source in rows:
        langs[lang or ""][source or ""].append(terms(t))
    out = []
    for lang, groups in langs.items():
        held = Counter(w for texts in groups.values() for t in texts for w in set(t))
        kept = sorted(w for w in held if held[w] >= least)
        counts = {s: Counter(w for t in texts for w in t if held[w] >= least) for s, texts in groups.items()}
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in groups:
            gain = lambda w, other: (p[s][w] - other[w]) ** 2 // other[w]
            pair = [(sum(gain(w, p[o]) for w in kept), o) for o in groups if o != s]
            term = [(gain(w, q), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 3, "cells": 20, "pairs": 7}, {"block_terms": 1, "pairs": 1, "top": 2}])
def test_divergence(spark, monkeypatch, sizes):
    monkeypatch.setattr(divergence, "GROUP_BYTES", 2000)
    monkeypatch.setattr(divergence, "_MERGED", 2)
    rows = odd_docs()
    got = divergence.audit(docs(spark, rows), 3, **({"top": 200} | sizes))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 3, sizes.get("top", 200))


def test_divergence_of_nothing(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    assert sorted(map(tuple, divergence.audit(docs(spark, [(None, None, "a"), ("b", "", "b")])).collect())) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_beyond_doubles():
    counts, total = np.array([0, 10**12 + 7, 8 * 10**15]), np.array([9 * 10**15 - 1])
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(total[0]) for c in counts]


def odd_texts(seed=6):
    rng = random.Random(seed)
    words = "the of and Überraschung naïveté antidisestablishmentarianism http://x.y/z?q=1 don't 3.14159 日本語テキスト привет 👩‍👩‍👧‍👦 é ﷽ ​ <s> </s> <unk> <0x0A> ▁ ▁▁a \x00 ﻿ aaaaaaaaaaaaaaaa lllIIIlll".split(" ")
    texts = [rng.choice(["", " ", "\n", "  "]) + "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t", "", "     ", "\r\n"]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(100)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x400, 0x4FF), rng.randint(0x3040, 0x30FF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(60)]
    return texts + [None, "", " ", "  ", " " * 33, " " * 100 + "x", "x" * 5000, "ab" * 3000, "\n" * 50, "word " * 20_000, "The end", "The end", "The end "]


def plain_pieces(lib, text):
    ids = lib.encode(text or "") + [lib.eos_id()]
    decoded = lib.decode(ids)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("group,limit", [(16 << 20, 300_000), (500, 5)])
def test_pieces_equal_the_library(spark, monkeypatch, group, limit):
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(pieces, "GROUP_BYTES", group)
    path = queries.tokenizer("piece_bpe_32k.model")
    lib, model, texts = SentencePieceProcessor(model_file=path), pieces.Pieces(path, limit), odd_texts()
    ids, places = model.encode(pa.array(texts, pa.string()))
    for t, lo, hi in zip(texts, places, places[1:]):
        assert ids[lo:hi].tolist() == lib.encode(t or ""), t
    got = pieces.digests(pieces.encode(docs(spark, [(t, "en", "s") for t in texts]), path)).collect()
    assert sorted(map(tuple, got)) == [(i, *plain_pieces(lib, t)) for i, t in enumerate(texts)]
    assert pieces.encode(docs(spark, []), path).count() == 0
    ids_sliced, _ = model.encode(pa.array(texts, pa.string()).slice(7, 20))
    assert ids_sliced.tolist() == [i for t in texts[7:27] for i in lib.encode(t or "")]


def test_failed_places_are_left_once():
    """A vocabulary whose longest matches mislead: each word's pieces equal those of merging, and there are ways back."""
    model = pieces.Pieces.__new__(pieces.Pieces)
    rng, letters = random.Random(2), "abc"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(60)})
    rng.shuffle(words)
    model.score, model.ids = {w: -float(k // 2) for k, w in enumerate(words)}, dict.fromkeys([*words, *letters], 0)  # some scores are equal
    model.pairs, model.shorter, model.limit = {}, {}, 1000
    import ahocorasick

    model.automaton = ahocorasick.Automaton()
    for w in model.ids:
        model.automaton.add_word(w, len(w))
    model.automaton.make_automaton()
    greedy = 0
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        got = model.split(text)
        assert got == model.merged(text)
        greedy += got[0] != max((w for w in model.ids if text.startswith(w)), key=len)
    assert greedy > 20


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.tokenizer("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "m.model"))


VECTORS = "vec_id long, embedding array<double>, label int, row string, rows int, block int, window int, score int"


def labelled(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "r", 1, 2, 3, 4) for i, v, label in rows], VECTORS)


def brute_negatives(rows, is_anchor, positives=5, negatives_=5, low=80):
    own = [(i, [math.floor(256 * Fraction(x)) for x in v], label) for i, v, label in rows if usable(v, True) and label is not None]
    width = max((len(v) for _, v, _ in own), default=0)
    own = [(i, v + [0] * (width - len(v)), label) for i, v, label in own]
    order = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for a, (anchor, v, label) in enumerate(own):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = [(sum(map(mul, v, w)), i, other == label) for b, (i, w, other) in enumerate(own) if b != a]
        for score, positive, _ in order([x for x in scored if x[2]])[:positives]:
            hard = order([x for x in scored if not x[2] and low * score <= 100 * x[0] <= 100 * score])[:negatives_]
            out += [(anchor, positive, r, i, score, s) for r, (s, i, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def mixed(seed=8):
    rng = np.random.default_rng(seed)
    rows = [(i, v, int(rng.integers(0, 3))) for i, v in odd_vectors(seed)]
    rows[5] = (*rows[5][:2], None)
    return rows + [(300 + i, rows[0][1], i % 2) for i in range(60)]  # one vector, many times, in two labels


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "anchor_rows": 3, "chunk_blocks": 2}, {"block_rows": 1, "positives": 2, "negatives": 1}])
def test_negatives(spark, sizes):
    rows = mixed()
    got = negatives.mine(labelled(spark, rows), F.col("vec_id") % 10 == 0, **sizes)
    want = brute_negatives(rows, lambda i: i % 10 == 0, sizes.get("positives", 5), sizes.get("negatives", 5))
    assert want and sorted(map(tuple, got.collect()), key=str) == want


def test_negatives_digit_by_digit(spark, monkeypatch):
    """Two bits a digit and thousands of equal scores: selection goes through many rounds and keeps the smallest ids."""
    monkeypatch.setattr(negatives, "DIGIT", 2)
    rows = [(i, [1.0, (i % 7) / 16], i % 2) for i in range(400)]
    rows += [(1000 + i, [0.9, i / 4096], i % 3) for i in range(100)]
    got = negatives.mine(labelled(spark, rows), F.col("vec_id") % 50 == 0, block_rows=64)
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows, lambda i: i % 50 == 0)


def test_negatives_of_large_components_and_of_nothing(spark):
    rows = [(i, [1e5 - i, float(i % 3), 1 / 256], i % 2) for i in range(30)]  # products beyond 2**49, told apart by single steps
    rows += [(40 + i, [4e5, float(i), 2.0**-8], i % 2) for i in range(10)]
    assert sorted(map(tuple, negatives.mine(labelled(spark, rows), F.col("vec_id") % 5 == 0).collect()), key=str) == brute_negatives(rows, lambda i: i % 5 == 0)
    assert negatives.mine(labelled(spark, []), F.lit(True)).count() == 0
    assert negatives.mine(labelled(spark, [(1, None, 1), (None, [1.0], 1), (3, [1.0], None)]), F.col("vec_id") > 0).count() == 0
    assert negatives.mine(labelled(spark, [(1, [-1.0], 1), (2, [1.0], 1), (3, [-1.0], 2)]), F.col("vec_id") == 1).count() == 0  # a positive of negative score
    with pytest.raises(Exception, match="vector 77"):
        negatives.mine(labelled(spark, [(77, [1e12], 1), (2, [1.0], 1)]), F.lit(True))
