"""Operators 8 and 9, the pipeline, and the subpackage's SQL."""

import hashlib
import importlib
import math
import os
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from tempora.llm import chat, mixing, urlfilter
from tempora.llm.common import components

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def conversations(spark, logs, extra=()):
    rows = [(c, t, role, text, 1, "x") for c, turns in logs.items() for t, (role, text) in enumerate(turns)]
    return spark.createDataFrame([*rows, *extra], "conv_id long, turn long, role string, text string, pos int, h1 string")


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "more")
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b, a], 6: [a, (None, None)], 7: [a, b, ("user", "other")], 8: [("user", "hi ")]}
    got = {r.conv_id: r.text for r in chat.render(conversations(spark, logs, [(None, 0, "user", "lost", 1, "x")])).collect()}
    assert sorted(got) == [3, 5, 6, 7, 8]
    assert got[3] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\nmore\n<|end|>\n"
    assert got[6].endswith("<|unknown|>\n\n<|end|>\n")


def test_long_conversations_come_in_parts(spark):
    turns = [("user", f"t{i}") for i in range(1300)]
    got = sorted(chat.render(conversations(spark, {1: turns, 2: turns[:700]})).collect(), key=lambda r: r.part)
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(1, 0, 1300), (1, 1, 1300), (1, 2, 1300)]
    assert "".join(r.text for r in got) == "".join(f"<|user|>\nt{i}\n<|end|>\n" for i in range(1300))


def test_no_conversations(spark):
    assert chat.render(conversations(spark, {})).count() == 0


def test_null_and_repeated_turns(spark):
    """Null turn numbers come first, equal ones by role and text; equal turns are turns."""
    long = "long " * 200_000
    extra = [(1, None, "user", "b", 1, "x"), (1, None, "user", "a", 1, "x"), (1, 5, "user", "z", 1, "x"), (1, 5, "assistant", long, 1, "x"), (1, 5, "assistant", long, 1, "x")]
    extra += [(2, 0, "user", "a", 1, "x"), (2, 1, "user", "b", 1, "x"), (3, 0, "user", "a", 1, "x"), (3, 1, "user", "b", 1, "x"), (3, 2, "assistant", long, 1, "x")]
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.render(conversations(spark, {}, extra)).collect()}
    line = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"
    assert got == {1: (5, line("user", "a") + line("user", "b") + 2 * line("assistant", long) + line("user", "z"))}


def test_urls_with_many_rules_have_no_hot_task(spark, monkeypatch):
    """The shuffled way, with a host that a third of the pages have, gives what the broadcast one does."""
    rules = spark.createDataFrame([(f"h{i}.org", f"/{'x' * (i % 9)}", "block") for i in range(60)] + [("org", "/", "allow"), ("hot.org", "/a/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, "http://hot.org/a/b" if i % 3 == 0 else f"http://w.h{i % 70}.org/xxxx{i}") for i in range(300)], "page_id long, url string")
    plain = sorted(map(tuple, urlfilter.judge(pages, rules).collect()), key=str)
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 3)
    assert sorted(map(tuple, urlfilter.judge(pages, rules).collect()), key=str) == plain
    assert {v for i, *_, v in plain if i % 3 == 0} == {"block"}


def test_hot_keys_join_as_others_do(spark, monkeypatch):
    from tempora.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(k % 20 if k % 2 else 99, k) for k in range(400)], "k long, v long")
    table = rows.groupBy("k").count().withColumnRenamed("k", "k")
    got = common.join_hot(rows, table.where("k <> 7"), "k", "count")
    assert sorted(map(tuple, got.select("k", "v", "count").collect())) == sorted(map(tuple, rows.join(table, "k").where("k <> 7").select("k", "v", "count").collect()))
    assert got.count() == 380


def draw(doc_id, text, mean, seed):
    draws = max(1, math.ceil(mean / 16))
    m, n = mean / draws, 0
    for k in range(1, draws + 1):
        u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{hashlib.md5(text.encode()).hexdigest()}:{k}".encode()).hexdigest()[:13], 16) / (1 << 52)
        p = c = math.exp(-m)
        steps = 0
        while c <= u and steps <= 80:
            steps += 1
            p *= m / steps
            c += p
        n += steps
    return n


@pytest.mark.parametrize("weights,rest,size", [({"a": 0.5, "b": 0.0}, 0.5, 1.0), ({}, 1.0, 3.0), ({"c": 0.9}, 0.1, 40.0), ({"a": 0.0}, 0.0, 1.0)])
@pytest.mark.parametrize("broadcast", [1000, 3])
def test_poisson_counts(spark, monkeypatch, weights, rest, size, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    monkeypatch.setattr(mixing, "_BLOCK", broadcast)
    rows = [(i if i != 7 else None, f"t{i}", None, s, None, i, "n", "u") for i, s in enumerate("a" * 150 + "b" * 30 + "c" * 15)] + [(500, "n", None, None, 1, 2, "n", "u"), (3, "again", "x", "a", 1, 2, "n", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy long, _n string, _source string")
    got = mixing.mix(df, weights, rest, size, 9)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_n", "_source", "copy", "shuffle_key"]
    counts = {}
    for r in got.collect():
        counts[r.text] = counts.get(r.text, 0) + 1
        assert r._n == "n" and r._source == "u"
    number = {}
    for r in rows:
        number[r[3]] = number.get(r[3], 0) + 1
    free = [s for s in number if s not in weights]
    whole = sum(w for s, w in weights.items() if s in number) + (rest if free else 0)
    want = {}
    for r in rows:
        share = weights[r[3]] if r[3] in weights else rest / len(free)
        n = draw(r[0], r[1], share / whole * size * len(rows) / number[r[3]], 9) if whole else 0
        if n:
            want[r[1]] = n
    assert counts == want


def test_rows_without_ids_are_spread_and_rare_sources_repeat(spark):
    df = spark.createDataFrame([(None, f"text {i}" if i % 2 else "x" * i, "a") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(df, {}, 1.0, 2.0).collect()
    assert len({r.shuffle_key for r in got}) == len(got) > 400  # a key for each copy: none keeps rows without ids together
    one = mixing.mix(df.where("text = 'text 7'"), {"a": 1.0}, 0.0, 1_000_000.0)
    n, different, least, most = one.agg(F.count("*"), F.countDistinct("copy"), F.min("copy"), F.max("copy")).first()
    assert n == different and abs(n - 1_000_000) < 6_000 and least == 1 and most > 80 * 62_000


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty, {"a": 1.0}, 0.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(empty, {"a": -1.0}, 0.0)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, k) for k in range(1, 50)] + [(7, 7), (None, 3), (1, 0)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 0 for k in range(50)}}


@tables
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > 0
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert sorted(map(tuple, p.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


@tables
def test_stages_against_brute_force(spark):
    """The near-duplicate, mixing and packing stages in plain Python, on what the stage before kept."""
    import corpus_pipeline as p
    from tempora.llm import queries

    from .test_texts import fingerprint, plain_ids

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    first = {}
    for r, c in zip(rows, label):
        first[c] = min(first.get(c, r.doc_id), r.doc_id)
    single = p.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in single) == sorted(first.values()) and len(single) < len(rows)
    docs = spark.createDataFrame(single, docs.schema)
    mixed = p.mix_sources(spark, docs, SF).collect()
    number = {}
    for r in single:
        number[r.source] = number.get(r.source, 0) + 1
    free = [s for s in number if s not in queries.MIX_WEIGHTS]
    whole = sum(w for s, w in queries.MIX_WEIGHTS.items() if s in number) + (queries.MIX_REST if free else 0)
    want = []
    for r in single:
        share = queries.MIX_WEIGHTS.get(r.source, queries.MIX_REST / max(1, len(free)))
        want += [r.doc_id] * draw(r.doc_id, r.text or "", share / whole * queries.MIX_SIZE * len(single) / number[r.source], queries.MIX_SEED)
    assert sorted(r.doc_id for r in mixed) == sorted(want)
    packed = p.pack_sequences(spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    plain, pieces = plain_ids("word_bpe_49k.json"), []
    for r in mixed:
        ids = plain(r.text) + bytes(4)
        pieces += [(r.doc_id, k, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])) for k, at in enumerate(range(0, len(ids), 8192))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(pieces)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *[o + n for o, n in sorted(parts)]]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    total = sum(n for *_, n, _ in pieces)
    assert len(places) <= -(-total // 2048) * 1.01 + 1


@tables
@pytest.mark.parametrize("empty", [True, False])
def test_stages_take_odd_documents(spark, empty):
    import corpus_pipeline as p

    rows = [] if empty else [(1, None, None, None, None, 1), (2, "", "en", "src0", 0, 1), (None, "no id", "en", None, 5, 1), (3, "word " * 20_000, "de", "src1", 100_000, 1), (3, "word " * 20_000, "de", "src1", 100_000, 1), (4, "tie", "", "", None, 1), (5, "tie", "", "", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id long")
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns or name == "pack", name
        assert not empty or not got
        if name == "quality":
            assert {r.doc_id for r in got} <= {1, 2, 3, 4, 5, None}
        if name == "simhash":
            assert len(got) <= len({(r.doc_id, r.text) for r in docs.collect()})
        docs = docs if empty else spark.createDataFrame(got, out.schema)


@tables
def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline as p

    rows = [(1, "one two three four", None, None, None), (2, "one two three four", None, None, None), (2, "one two three four", None, None, None), (None, "quite another text here", None, None, None), (None, "quite another text here", None, None, None), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in p.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == [1, 5, None]


@tables
def test_near_duplicate_stage_decides_by_row(spark):
    import corpus_pipeline as p

    near, others = "one two three four", [f"{w} text of its own {w} {w}" for w in ("blue", "green", "red", "white")]
    rows = [(3, near), (7, near), (7, others[0]), (8, others[1]), (8, others[2]), (None, others[3]), (None, "again a different one"), (None, near), (None, None)]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in p.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r not in [(7, near), (None, near)]], key=str)


@tables
def test_quality_stage_decides_by_row(spark):
    import corpus_pipeline as p
    from tempora.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).join(docs.select("doc_id", "text"), "doc_id").orderBy("score").collect()
    bad, good = scores[0].text, scores[-1].text
    assert scores[0].predicted == 0 and scores[-1].predicted == 1
    more = spark.createDataFrame([(i, t, None, "odd", None) for i in (None, 10**6) for t in (bad, good)], docs.schema)
    got = p.drop_low_quality(spark, docs.union(more), SF).where("source = 'odd'").collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([(None, good), (10**6, good)], key=str)


@tables
def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tempora.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got, cursor = QUERIES[name](spark, SF), con.execute(sql)
        names = [d[0] for d in cursor.description]
        rows = sorted([str([r[names.index(c)] for c in sorted(names)]) for r in cursor.fetchall()])
        assert sorted(got.columns) == sorted(names), name
        assert sorted([str([r[c] for c in sorted(names)]) for r in got.collect()]) == rows, name


def test_the_rest_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['tempora.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'm2_training_load' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    assert importlib.util.find_spec("tempora.llm")
