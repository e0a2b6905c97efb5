"""Operators 4 and 6 against brute force, with odd vectors."""

import math
from fractions import Fraction
from operator import mul

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import neighbours, topk

SCHEMA = "vec_id long, embedding array<float>, label int, row string, unit int, block int, cid int"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "r", 1, 2, 3) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def usable(v, zero_ok):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero_ok or any(v))


def odd_vectors(seed=1, n=150, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)).astype(np.float32)
    base[10:20] = base[0] + rng.normal(scale=0.02, size=(10, d))  # near copies
    base[20:60] = base[1] + rng.normal(scale=0.15, size=(40, d))  # a looser group
    base[60:70] = base[2]  # exact copies
    rows = [(i, list(map(float, v))) for i, v in enumerate(base)]
    rows += [(200, None), (201, [0.0] * d), (202, [None] + [1.0] * (d - 1)), (203, [float("nan")] * d), (204, [float("inf")] + [0.0] * (d - 1)), (205, []), (50, rows[0][1]), (50, rows[0][1]), (None, rows[5][1])]
    return rows


def brute_links(rows, threshold):
    n = len(rows)
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if usable(v, False) else None for _, v in rows]
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(linked[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("k,tile", [(8, 512), (3, 8)])
def test_links_and_components(spark, monkeypatch, k, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    rows = odd_vectors()
    got = neighbours.near_duplicates(table(spark, rows), 0.9, k=k).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute_links(rows, 0.9)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def adjacent_groups(seed=3, m=40, d=24):
    """Two groups of m different vectors, above 0.97 within and about 0.92 across; and loose vectors around them."""
    rng = np.random.default_rng(seed)
    centre = np.zeros((2, d))
    centre[0, 0], centre[1, 0], centre[1, 1] = 1, np.cos(0.37), np.sin(0.37)
    group = np.repeat(centre, m, 0) + rng.normal(scale=0.012, size=(2 * m, d))
    return [(i, v.tolist()) for i, v in enumerate(np.r_[group, rng.normal(size=(100, d))].astype(np.float32))]


def test_links_across_dense_groups(spark):
    rows = adjacent_groups()
    want = brute_links(rows, 0.9)
    assert next(w for w in want if w[0] == 40)[2] == 0  # one component
    got = neighbours.near_duplicates(table(spark, rows), 0.9).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == want


@pytest.mark.parametrize("tile", [512, 8])
def test_bridges_between_saturated_components(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in adjacent_groups()[:80]}
    unit[80] = -unit[0]
    ids = [*range(0, 81)]
    group = {i: [j for j in ids if j // 40 == i // 40 and j != i] for i in ids}
    near = lambda i: sorted((-float(unit[i] @ unit[j]), j) for j in group[i])[:8]
    lists = spark.createDataFrame([(i, near(i)) for i in ids], "u long, near array<struct<d: double, w: long>>")
    classes = spark.createDataFrame([(i, 1, bytearray(unit[i].tobytes())) for i in ids], "cid long, copies long, unit binary")
    found = spark.createDataFrame([(i, i // 40 * 40) for i in ids], "id long, component long")
    got = neighbours.bridges(lists, neighbours.in_components(classes, found), 8, 0.9).collect()
    assert got and all(r.a < 40 <= r.b < 80 and unit[r.a] @ unit[r.b] >= 0.9 for r in got)


def test_audit_counts_small_groups_on_their_own(spark):
    """A dense group has nearly all links; the pairs beside it are all missed."""
    rng = np.random.default_rng(4)
    group = rng.normal(size=16) + rng.normal(scale=0.02, size=(200, 16))
    loose = rng.normal(size=(20, 16))
    x = np.r_[group, loose, loose + rng.normal(scale=0.02, size=(20, 16))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(i, 1, bytearray(v.tobytes())) for i, v in enumerate(x)], "cid long, copies long, unit binary")
    true = (x @ x.T >= 0.9).sum(1) - 1
    links = lambda kept: spark.createDataFrame([(i, int(true[i])) for i in range(len(x)) if kept(i)], "cid long, links long")
    assert neighbours.recall(classes, links(lambda i: True), 0.9) == 1
    assert neighbours.recall(classes, links(lambda i: i < 200), 0.9) == 0
    assert neighbours.recall(classes, links(lambda i: i >= 100), 0.9) < 0.6


def lone_pairs(seed=6, n=3000, pairs=200, d=64):
    """Loose vectors, the first of them in pairs just above the threshold: only their neighbours' neighbours lead to them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, 2 * pairs, 2):
        a = x[i] / np.linalg.norm(x[i])
        other = rng.normal(size=d)
        other -= other @ a * a
        c = 0.901 + 0.03 * rng.random()
        x[i + 1] = c * a + np.sqrt(1 - c * c) * other / np.linalg.norm(other)
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


def test_rounds_find_what_the_buckets_miss(spark, caplog):
    """The buckets miss a twentieth of the pairs and more; with rounds, all are found at the first attempt."""
    rows = lone_pairs()
    units = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for _, v in rows]
    classes = spark.createDataFrame([(i, bytearray(u.tobytes())) for i, u in enumerate(units)], "cid long, unit binary").repartition(8)
    lists = neighbours.graph(classes, len(rows), 16, 4, 0, 1, 0.9)[0].collect()
    near = {r.u: {y.w for y in r.near} for r in lists}
    assert sum(i + 1 in near.get(i, ()) for i in range(0, 400, 2)) <= 190
    with caplog.at_level("INFO", neighbours.__name__):
        got = neighbours.near_duplicates(table(spark, rows), 0.9).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == sorted([(i, int(i < 400), i - i % 2 if i < 400 else i) for i in range(len(rows))], key=str)
    assert [r.args[1:] for r in caplog.records if r.args and len(r.args) == 3] == [(16, 4)]


@pytest.mark.parametrize("group", [256, 20])
def test_short_recall_ends_in_exact_comparison(spark, monkeypatch, group):
    """Lists that find next to nothing, an audit that is never content: all classes are compared."""
    monkeypatch.setattr(neighbours, "GROUP", group)
    monkeypatch.setattr(neighbours, "recall", lambda *_, **__: 0.5)
    monkeypatch.setattr(neighbours, "plane_bits", lambda n: 30)
    rows = odd_vectors() + [(300, [1.0, 0.0]), (301, [1.0, 0.1]), (302, [0.0, 1.0])]  # of another length
    got = neighbours.near_duplicates(table(spark, rows), 0.9, tables=1, rounds=0, attempts=1).collect()
    assert [r.n_links for r in got if r.vec_id in (300, 301, 302)].count(1) == 2
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got if (r.vec_id or 0) < 300], key=str) == brute_links(rows[:-3], 0.9)


def test_audit_weighs_strata(spark):
    """Of 4,000 classes two in a thousand link, a sample by chance would hardly meet them; half of these are missed."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 48))
    x[1:8:2] = x[0:8:2] + rng.normal(scale=0.02, size=(4, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(i, 1, bytearray(v.tobytes())) for i, v in enumerate(x)], "cid long, copies long, unit binary")
    links = spark.createDataFrame([(i, 1) for i in range(4)], "cid long, links long")
    best = lambda i: float(x[i] @ x[i ^ 1]) if i < 4 else 0.85 if i < 8 else 0.4
    lists = spark.createDataFrame([(i, [(-best(i), i ^ 1, 0)]) for i in range(4000)], "u long, near array<struct<d: double, w: long, born: int>>")
    assert neighbours.recall(classes, links, 0.9, lists=lists) == 0.5
    none = classes.where("cid >= 8")
    assert neighbours.recall(none, links.where("false"), 0.9, lists=lists) is None


def test_parts_of_a_large_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 6)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 16))
    x[30:45] = x[:15] + rng.normal(scale=0.05, size=(15, 16))  # lone pairs
    x[45:] = x[44] + rng.normal(scale=0.03, size=(15, 16))  # a dense group
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "cid long, unit binary")
    lists = neighbours.graph(classes, 60, 8, 1, 0, 1, 0.9)[0].collect()
    near = {r.u: {y.w for y in r.near} for r in lists}
    assert all(i + 30 in near[i] and i in near[i + 30] for i in range(14))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = neighbours.near_duplicates(table(spark, rows), 0.9, tables=1, rounds=0, attempts=1).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute_links(rows, 0.9)


def test_no_vectors(spark):
    assert neighbours.near_duplicates(table(spark, [])).count() == 0
    assert topk.search(table(spark, []), F.lit(True)).count() == 0
    alone = neighbours.near_duplicates(table(spark, [(1, None), (2, [1.0, 0.0])])).collect()
    assert sorted(map(tuple, alone)) == [(1, 0, 1, True), (2, 0, 2, True)]


def brute_top(rows, k, is_query):
    ints = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if usable(v, True)]
    d = max(len(v) for _, v in ints)
    ints = [(i, v + [0] * (d - len(v))) for i, v in ints]
    want = {}
    for q, (qid, qv) in enumerate(ints):
        if qid is not None and is_query(qid):
            best = sorted((-sum(map(mul, qv, v)), i is None, i or 0) for p, (i, v) in enumerate(ints) if p != q)[:k]
            want.setdefault(qid, []).extend((n, None if none else i, -s) for n, (s, none, i) in enumerate(best, 1))
    return {q: sorted(v, key=str) for q, v in want.items()}


def found_top(df, condition, k, **sizes):
    got = {}
    for r in topk.search(df, condition, k, **sizes).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v, key=str) for q, v in got.items()}


@pytest.mark.parametrize("block_rows,query_rows,k,chunk", [(4096, 512, 5, 8), (16, 7, 5, 2), (1, 4, 2, 40), (40, 50, 1000, 1)])
def test_top_products(spark, block_rows, query_rows, k, chunk):
    rows = odd_vectors(2, 90)
    got = found_top(table(spark, rows), F.col("vec_id") % 10 == 0, k, block_rows=block_rows, query_rows=query_rows, chunk_blocks=chunk, tasks=6)
    assert got == brute_top(rows, k, lambda i: i % 10 == 0)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_products_of_large_components(spark, kind):
    """Products far above 2**53, whose order single steps decide; a score beyond a long is an error."""
    rows = [(1, [1e6, 1.0]), (2, [2e6, 1.0]), (3, [2e6, 1.0 + 2**-8]), (4, [2e6, 1.0]), (5, [-1e6, 3.0]), (6, [0.0, 2.0**20])]
    rows += [(i, [2e6 - i, float(i)]) for i in range(7, 40)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for sizes in ({}, {"block_rows": 4, "query_rows": 3, "chunk_blocks": 2}):
        assert found_top(df, F.lit(True), 5, **sizes) == brute_top(rows, 5, lambda i: True)
    assert {r.score for r in topk.search(df.where("vec_id < 3"), F.lit(True)).collect()} == {131072000000065536}
    far = spark.createDataFrame([(1, [1e9]), (2, [1e9])], f"vec_id long, embedding array<{kind}>")
    with pytest.raises(Exception, match="beyond a long"):
        topk.search(far, F.lit(True)).collect()


def block_of(x):
    n, d = x.shape
    number = lambda v: np.asarray(v, "<i8").tobytes()
    return topk.Block({"n": n, "dims": d, "ids": number(range(n)), "known": bytes([1] * n), "rows": number(range(n)), "lists": np.argsort(x, 0).T.astype("<i4").tobytes(), "x": x.astype("<f8").tobytes()})


def best_of(x, q, skip, bar, k=5):
    score = x @ q
    return {v for v in sorted(range(len(x)), key=lambda v: -score[v]) if v != skip and score[v] >= bar} if bar > -np.inf else set(np.argsort(-np.where(np.arange(len(x)) == skip, -np.inf, score))[:k].tolist())


def test_bounds_stop_early_without_losing_any():
    """One list decides: less than half of the entries of the lists are read, and of lists without weight none."""
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (3000, 16)).astype(np.float64)
    x[:, 0] = rng.permutation(3000)
    block = block_of(x)
    for q, skip in ((np.array([50.0] + [1.0] * 15), 7), (np.array([-50.0] + [1.0] * 15), -1), (np.array([50.0] + [0.0] * 15), -1)):
        for bar in (-np.inf, np.sort(x @ q)[-5]):
            found, reads = topk.candidates(block, q, bar, skip, 5)
            assert best_of(x, q, skip, bar) <= set(found.tolist()) and skip not in found
            assert len(found) <= 60 and reads < x.size / 2 and reads <= 3000 * np.count_nonzero(q)
    none = np.zeros(16)
    assert len(topk.candidates(block, none, -np.inf, 3, 5)[0]) == 2999 and topk.candidates(block, none, -np.inf, 3, 5)[1] == 0
    assert topk.candidates(block, none, 1.0, -1, 5)[1] == 0 == topk.candidates(block, np.ones(16), 1e9, -1, 5)[1]


@pytest.mark.parametrize("d", [1, 5, 40])
def test_candidates_hold_the_best_whatever_decides(d):
    """Lists with ties, constant lists and weights of any size; a query's own dimensions may be fewer than the block's."""
    rng = np.random.default_rng(d)
    for _ in range(30):
        n = int(rng.integers(1, 400))
        x = np.floor(rng.normal(size=(n, d)) * rng.choice([0, 1, 30, 1e4], d))
        q = np.floor(rng.normal(size=int(rng.integers(1, d + 1))) * rng.choice([0, 2, 500]))
        skip = int(rng.integers(-1, n))
        score = x[:, : len(q)] @ q
        kth = np.sort(np.delete(score, skip) if skip >= 0 else score)[::-1][:5]
        for bar in (-np.inf, *kth[4:], 1.0):
            found, reads = topk.candidates(block_of(x), q, bar, skip, 5)
            floor = max(bar, kth[-1]) if len(kth) == 5 and bar == -np.inf else bar
            want = {v for v in range(n) if v != skip and score[v] >= floor}
            assert want <= set(found.tolist()) and skip not in found and reads <= x.size


def test_queries_of_a_block_read_its_lists_together(monkeypatch):
    """Forty queries, some with a bar, cost as many looks as one at most twice over, not forty times as many."""
    rng, looks, read = np.random.default_rng(11), [], topk._read
    x, q = np.floor(rng.normal(size=(2000, 24)) * 256), np.floor(rng.normal(size=(40, 24)) * 256)
    monkeypatch.setattr(topk, "_read", lambda *a: looks.append(1) or read(*a))
    skips, bars = np.where(np.arange(40) % 2, np.arange(40), -1), np.where(np.arange(40) % 3, -np.inf, np.sort(x @ q.T, 0)[-5])
    found = topk.candidates_of(block_of(x), q, bars, skips, 5)
    assert len(looks) <= 20
    for i, (rows, reads) in enumerate(found):
        assert best_of(x, q[i], skips[i], bars[i]) <= set(rows.tolist()) and skips[i] not in rows and reads <= x.size
