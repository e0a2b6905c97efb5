"""Operator 5: SimHash near-duplicates by exact comparison in tiles.

Each text has a 64-bit fingerprint. Different fingerprints are dealt to tiles by their number of set bits, and a pair of
tiles is compared only if those numbers differ by at most the radius. Within a pair of tiles fingerprints are grouped
by the set bits of their four 16-bit quarters, and groups are compared, by exclusive-or and bit counts in numpy, only if
those differ by at most the radius in sum. Both bounds hold for every pair within the radius, so none is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batch, components, grouped, join_hot, materialize, merge_labels

#: Bytes of texts whose fingerprints are taken together.
GROUP_BYTES = 8 << 20
#: Tasks that compare pairs of tiles, at most.
TASKS = 20_000
_LOW = np.uint64(0x0101010101010101)


def _fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """Per array of 64-bit hashes the bits that are set in over half of them; zero for none."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, sizes = np.concatenate([hashes[k] for k in full]), sizes[full]
    parts = -(-sizes // 255)  # byte-wide counters hold 255 hashes
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & _LOW, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        most = (2 * counts > sizes[:, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= most[:, byte] << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, key: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every whole text, and the binary column `key` if named.

    Words are what stands between ASCII white space, A-Z lower-cased; a null text has none, and no words mean zero."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in grouped(batches, 1, GROUP_BYTES):
            hashes = []
            for text in b.column(1).to_pylist():
                w = (text or "").encode().lower().split()
                if len(w) < words:
                    shingles = [b" ".join(w)] if w else []
                else:
                    shingles = map(b" ".join, zip(*(w[k:] for k in range(words))))
                hashes.append(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_fingerprints(hashes).view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *carried])

    carried = [key] if key else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried).mapInArrow(rows, ", ".join(["doc_id long", "fp long", *[f"{c} binary" for c in carried]]))


def _groups(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted fps by the set bits of their quarters; where groups start (and the end); the groups' four counts."""
    quarters = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    code = quarters @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return order, np.r_[starts, len(fps)], quarters[order][starts]


def links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in a, index in a then b) that connect all that links within radius connect; a and b of uint64."""
    both = np.concatenate([a, b])
    labels = np.arange(len(both))
    got_i, got_j = [], []
    oa, sa, qa = _groups(a)
    ob, sb, qb = _groups(b)
    for g in range(len(qa)):
        near = np.flatnonzero(np.abs(qb - qa[g]).sum(1) <= radius)
        if not len(near):
            continue
        cols = np.concatenate([ob[sb[k] : sb[k + 1]] for k in near])
        mine = oa[sa[g] : sa[g + 1]]
        other = b[cols]
        for lo in range(0, len(mine), 256):
            x = mine[lo : lo + 256]
            for at in range(0, len(cols), 4096):
                i, j = np.nonzero(np.bitwise_count(a[x][:, None] ^ other[None, at : at + 4096]) <= radius)
                if len(i):
                    ki, kj = merge_labels(labels, x[i], len(a) + cols[at + j])
                    got_i.append(ki)
                    got_j.append(kj)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *got_i]), np.concatenate([none, *got_j])


def fingerprint_links(fps: DataFrame, radius: int = 3, tile_rows: int = 65_536) -> DataFrame:
    """fps: different fingerprints (fp). Links (a, b) that connect what links of at most `radius` differing bits connect.

    A tile holds about tile_rows fingerprints of one bit count; the plan of tiles comes from at most 65 counts."""
    spark = fps.sparkSession
    t = fps.withColumn("_p", F.bit_count("fp"))
    tiles = {r[0]: -(-r[1] // tile_rows) for r in t.groupBy("_p").count().collect()}
    if not tiles:
        return spark.createDataFrame([], "a long, b long")
    count = F.create_map(*[F.lit(x) for p, k in tiles.items() for x in (p, k)])
    t = t.withColumn("_k", F.pmod(F.xxhash64("fp"), count[F.col("_p")]).cast("int"))
    packed = materialize(t.groupBy("_p", "_k").agg(F.collect_list("fp").alias("fps")), "tiles")
    # a pair of tiles is a key: the first of the pair goes to all tiles of its bit count from itself on and of up to radius
    # more bits, the second to all that have it as second, so that each tile is sent once to each pair
    both, last = F.col("_p") == F.col("_q"), lambda c: count[F.col(c)].cast("int") - 1
    one = packed.withColumn("_q", F.explode(F.sequence("_p", F.col("_p") + radius))).where(F.col("_q").isin(list(tiles)))
    one = one.withColumn("_j", F.explode(F.sequence(F.when(both, F.col("_k")).otherwise(0), last("_q")))).withColumnRenamed("fps", "x")
    other = packed.select(F.col("_p").alias("_q"), F.col("_k").alias("_j"), F.col("fps").alias("y")).withColumn("_p", F.explode(F.sequence(F.col("_q") - radius, F.col("_q")))).where(F.col("_p").isin(list(tiles)))
    other = other.withColumn("_k", F.explode(F.sequence(F.lit(0), F.when(both, F.col("_j")).otherwise(last("_p")))))
    pairs = sum(k * (k + 1) // 2 + sum(k * tiles.get(p + r, 0) for r in range(1, radius + 1)) for p, k in tiles.items())
    key, parts = ["_p", "_k", "_q", "_j"], min(pairs, TASKS)
    spread = one.repartition(parts, *key).join(other.repartition(parts, *key).hint("shuffle_hash"), key).select("x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow("a long, b long")
        for batch_ in batches:
            for x, y in zip(batch_.column(0), batch_.column(1)):
                a, b = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                i, j = links(a, b, radius)
                both = np.concatenate([a, b]).view(np.int64)
                yield batch({"a": both[i], "b": both[j]}, schema)

    return spread.mapInArrow(compare, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, key: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp, component_id (smallest doc_id reachable by links, itself included).

    Texts of equal fingerprints count once in the comparison. Rows of null doc_id take part and never name a component
    that has other doc_ids; repeated rows are repeated; no documents give no rows. With `key`, a binary column of docs, this
    and component are returned too: component differs where groups differ, whatever their doc_ids."""
    marked = materialize(fingerprints(docs, words, key=key), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_rows")), "distinct")
    found = components(fingerprint_links(fps.select("fp"), radius), "simhash")
    joined = materialize(fps.join(found, fps["fp"] == found["id"], "left").select("fp", "least", "_rows", F.coalesce("component", "fp").alias("component")), "joined")
    named = materialize(joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_fps")), "named")
    names = materialize(join_hot(joined.drop("least"), named, "component", "_fps").drop("_fps"), "names")
    return join_hot(marked, names, "fp", "_rows").select("doc_id", "fp", "component_id", *(["component", key] if key else []))


def hex64(fp: str) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
