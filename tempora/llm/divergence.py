"""Operator 11: how far sources of a language differ in their terms, by dense matrices of blocks of terms.

Terms are counted per (lang, source) inside the tasks that read the texts. The kept terms of a language are dealt to
blocks by hash; a block becomes a numpy int64 matrix of groups by terms, in which all pairs of groups are compared by
broadcasting. Blocks give partial sums of the pairs, which Spark adds, and each group's best terms, whose lists are
merged in two steps. A task holds at most about `cells` cells, whatever the vocabulary or the number of sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, batch, grouped, join_hot, materialize

#: Bytes of texts whose terms are counted together.
GROUP_BYTES = 16 << 20
#: Terms in a block, and cells (groups times terms) and pairs of groups that a task holds, about.
BLOCK_TERMS, CELLS, PAIRS = 4096, 1 << 22, 1 << 20
#: Lists of best terms that meet in the first of two steps.
_MERGED = 256
_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTS = "lang string, block long, kind string, g long, h long, term string, value long"
#: What each byte becomes: A-Z small letters, a-z and all bytes of other than ASCII characters themselves, the rest a blank.
_BYTES = np.full(256, 32, np.uint8)
_BYTES[128:] = np.arange(128, 256)
_BYTES[97:123] = _BYTES[65:91] = np.arange(97, 123)


def terms_of(texts: pa.Array) -> pa.Array:
    """Of each text (nulls count as empty) its terms, and empty strings between them."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.string())])
    offsets, data = texts.buffers()[1:]
    clean = _BYTES[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    return pc.split_pattern(pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(clean), offset=texts.offset), " ")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group of rows (lang, source, text) its terms, how often and in how many rows; and each group with a null term."""
    schema = arrow(_COUNTS)
    for b in grouped(batches, 2, GROUP_BYTES):
        lists = terms_of(b.column(2))
        found = lists.flatten().dictionary_encode()
        words, code = found.dictionary, found.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        empty = pc.index(words, "").as_py()
        full = code != empty
        size = max(1, len(words))
        seen, times = np.unique(row[full] * size + code[full], return_counts=True)
        langs, sources = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        cells, own = np.unique(group[seen // size] * size + seen % size, return_inverse=True)
        n, docs = np.zeros(len(cells), np.int64), np.bincount(own, minlength=len(cells))
        np.add.at(n, own, times)
        groups = np.unique(group)
        at = np.r_[cells // size, groups]
        term = pa.concat_arrays([words.take(pa.array(cells % size)), pa.nulls(len(groups), pa.string())])
        none = np.zeros(len(groups), np.int64)
        columns = {"lang": langs.dictionary.take(pa.array(at // len(sources.dictionary))), "source": sources.dictionary.take(pa.array(at % len(sources.dictionary))), "term": term, "n": np.r_[n, none], "docs": np.r_[docs, none]}
        yield batch(columns, schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it); a group that occurs has one row of a null term too."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(empty("lang"), empty("source"), "text").mapInArrow(_count, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (counts + 1) / total), by long division: exact for totals up to 9e15."""
    rest = counts + 1
    out = rest // total
    rest = rest - out * total
    for _ in range(3):
        rest = rest * 1000
        digits = rest // total
        out, rest = out * 1000 + digits, rest - digits * total
    return out + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q)."""
    return (p - q) ** 2 // q


def compare(terms: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """One block of a language's terms: partial sums of its strip's groups against all, and their best terms.

    terms: term, g, n, lang_n; groups, one row a group: g, total, lang_total, in_strip."""
    groups = groups.sort_by("g")
    total, strip = groups["total"].to_numpy(), np.flatnonzero(groups["in_strip"].to_numpy())
    found = terms["term"].combine_chunks().dictionary_encode()
    names = found.dictionary.take(pc.sort_indices(found.dictionary.cast(pa.binary())))  # in order of their bytes
    column = pc.index_in(terms["term"].combine_chunks(), value_set=names).to_numpy()
    n, lang_n = np.zeros((len(total), len(names)), np.int64), np.zeros(len(names), np.int64)
    n[terms["g"].to_numpy(), column] = terms["n"].to_numpy()
    lang_n[column] = terms["lang_n"].to_numpy()
    p, q = shares(n, total[:, None]), shares(lang_n, groups["lang_total"].to_numpy()[:1])
    rows: dict[str, list] = {"kind": [], "g": [], "h": [], "term": [], "value": []}

    def add(kind: str, g: np.ndarray, h: np.ndarray | None, term: pa.Array | None, value: np.ndarray) -> None:
        none = lambda kind_: pa.nulls(len(value), kind_)
        for name, x in (("kind", pa.array([kind] * len(value), pa.string())), ("g", pa.array(g, pa.int64())), ("h", none(pa.int64()) if h is None else pa.array(h)), ("term", none(pa.string()) if term is None else term), ("value", pa.array(value))):
            rows[name].append(x)

    step = max(1, CELLS // max(1, p.size))
    for lo in range(0, len(strip), step):
        own = strip[lo : lo + step]
        sums = gain(p[own, None, :], p[None, :, :]).sum(2)
        i, j = np.nonzero(own[:, None] != np.arange(len(total))[None, :])
        add("pair", own[i], j, None, sums[i, j])
    for g in strip.tolist():
        at = np.flatnonzero((n[g] > 0) & (p[g] > q))
        value = gain(p[g, at], q[at])
        best = np.argsort(-value, kind="stable")[:top]
        add("term", np.full(len(best), g), None, names.take(pa.array(at[best])), value[best])
    head = groups.slice(0, 1).select(["lang", "block"]).to_pylist()[0]
    whole = {name: pa.concat_arrays(parts) for name, parts in rows.items()}
    return pa.table([pa.array([head[f.name]] * len(whole["g"]), f.type) if f.name in head else whole[f.name] for f in arrow(_PARTS)], schema=arrow(_PARTS))


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, block_terms: int = BLOCK_TERMS, cells: int = CELLS, pairs: int = PAIRS) -> DataFrame:
    """How the sources of each language differ: lang, source, part, item, value, rank.

    Terms are runs of letters a-z (A-Z become small) and of characters beyond ASCII. A language keeps those in at least
    least_docs of its documents, V in number. A group (lang, source), or the whole language, gives a kept term the share
    p = 1 + floor(10**9 * (occurrences + 1) / (N + V)), N its occurrences of kept terms; all is exact in whole numbers.
    Part `pair`: each other source of the language as item, the value the sum of floor((p - q)**2 / q) over all kept terms,
    p the group's share and q the item's. Part `term`: each kept term that the group has and that is more frequent there
    than in the language (q), by the same measure, the first `top`. Ranks begin with 1, by value descending and the item's
    UTF-8 bytes.

    Null lang, source and text count as empty, so null and empty are one group. Each row is a document, repeated ones
    too. A group without terms has pairs (a language without kept terms: of value 0) and no term rows; a single source
    has no pairs; no documents give no rows. Of docs only text, lang and source are read."""
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    first = F.row_number().over(of_term.orderBy("source")) == 1
    kept = counts.withColumn("first", first).where((F.col("_docs") >= least_docs) | F.col("term").isNull())
    kept = materialize(kept.select("lang", "source", "term", "n", "lang_n", "first"), "terms")
    real = F.col("term").isNotNull()
    langs = kept.groupBy("lang").agg(F.sum("n").alias("_lang_n"), F.count_if(real & F.col("first")).alias("_v"), F.count_if(~real).alias("_groups"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("_n"), F.count_if(real).alias("rows")).join(langs, "lang")
    per_block = F.greatest(F.lit(1), F.least(F.lit(block_terms), F.floor(F.lit(cells) / F.col("_groups"))))
    strip = F.greatest(F.lit(1), F.floor(F.lit(pairs) / F.col("_groups")))
    groups = own.select(
        "lang", "source", "rows", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("g"),
        (F.col("_n") + F.col("_v")).alias("total"), (F.col("_lang_n") + F.col("_v")).alias("lang_total"), "_v", "_groups",
        F.ceil(F.col("_v") / per_block).cast("long").alias("blocks"), strip.cast("long").alias("strip"), F.ceil(F.col("_groups") / strip).cast("long").alias("strips"),
    )
    groups = materialize(groups, "groups")
    numbers = lambda stop: F.explode(F.sequence(F.lit(0).cast("long"), F.col(stop) - 1))
    at = join_hot(kept.where(real), groups.select("lang", "source", "rows", "g", "blocks", "strips"), ["lang", "source"], "rows")
    at = at.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), numbers("strips").alias("strip"), "term", "g", "n", "lang_n")
    sides = groups.where("_v > 0").select("*", numbers("blocks").alias("block")).select("*", numbers("strips").alias("at_strip"))
    in_strip = (F.floor(F.col("g") / F.col("strip")) == F.col("at_strip")).alias("in_strip")
    sides = sides.select(*[F.col(c).alias(to) for c, to in (("lang", "lang"), ("block", "block"), ("at_strip", "strip"), ("g", "g"), ("total", "total"), ("lang_total", "lang_total"))], in_strip)
    key = ["lang", "block", "strip"]
    met = at.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(lambda terms, own_: compare(terms, own_, top), _PARTS)
    parts = materialize(met, "parts")

    name = groups.select("lang", "g", "source")
    other = name.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    summed = parts.where("kind = 'pair'").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    pair = summed.join(name, ["lang", "g"]).join(other, ["lang", "h"]).select("lang", "source", "item", "value")
    bare = groups.where("_v = 0").select("lang", "source")  # nothing to add up: all other sources at 0
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    order = (F.desc("value"), F.asc("item"))
    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    pair = pair.union(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranks)
    heaps = parts.where("kind = 'term'").withColumn("_at", F.pmod("block", F.lit(_MERGED)))
    for some in (["lang", "g", "_at"], ["lang", "g"]):
        heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*some).orderBy(F.desc("value"), F.asc("term")))).where(F.col("rank") <= top)
    term = heaps.join(name, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair.union(term)
