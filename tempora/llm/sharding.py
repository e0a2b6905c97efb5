"""Operator 2: sharding by sampled splitters, with shards of nearly equal bytes.

Records are ordered by (hash of the text, row number). A size-weighted sample of a bounded expected size gives quantile
boundaries that cut this order into many more ranges than shards; a group of equal texts stays in one range unless it
alone has, by count, more bytes than a shard's equal share. The exact bytes of every range are counted, overfull ranges are subdivided by
samples of their own, and whole ranges go to shards, largest first to the emptiest. Texts are never shuffled."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked

OVERHEAD = 16


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and OVERHEAD), text_crc32 (null text: that of no bytes), key, row: one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")).withColumn("row", F.monotonically_increasing_id())


def _position(splits: np.ndarray):
    """A function of key and row: how many splits (sorted rows of key, row) are at or before it."""
    keys, rows = splits[:, 0], splits[:, 1]

    @F.pandas_udf("int")
    def position(key: pd.Series, row: pd.Series) -> pd.Series:
        k, r = key.to_numpy(np.int64), row.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for at in np.unique(lo[lo < hi]):
            same = np.flatnonzero((lo == at) & (lo < hi))
            lo[same] += np.searchsorted(rows[at : hi[same[0]]], r[same], "right")
        return pd.Series(lo.astype(np.int32))

    return position


def _draw(rows: DataFrame, total: int, expected: int, turn: int) -> pd.DataFrame:
    """key, row, weight (in bytes that it stands for): each record by a chance in proportion to its size, about
    `expected` in all."""
    chance = F.col("size") * F.lit(expected / max(1, total))
    drawn = rows.where((F.pmod(F.xxhash64("key", "row", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)) < chance)
    return drawn.select("key", "row", F.greatest(F.col("size").cast("double"), F.lit(max(1, total) / expected)).alias("weight")).toPandas().sort_values(["key", "row"], ignore_index=True)


def _quantiles(sample: pd.DataFrame, parts: int, divisible: set[int]) -> list[tuple[int, int]]:
    """Up to parts - 1 boundaries; at the start of a group of equal texts unless its key is divisible."""
    if not len(sample) or parts < 2:
        return []
    w = sample["weight"].to_numpy()
    cum, share = np.cumsum(w), w.sum() / parts
    at = np.searchsorted(cum, share * np.arange(1, parts), "left")
    out = []
    for k in np.unique(np.minimum(at, len(sample) - 1)):
        key, row = int(sample["key"][k]), int(sample["row"][k])
        out.append((key, row) if key in divisible else (key, -1))
    return out


def _oversize(rows: DataFrame, sample: pd.DataFrame, share: float) -> set[int]:
    """The keys whose groups have more bytes than `share`, by count. The sample only names whom to count: with tens of
    thousands of draws, a group of a whole share never shows less than half of it."""
    heavy = sample.groupby("key")["weight"].sum()
    suspects = [int(k) for k in heavy.index[heavy > share / 2]]  # fewer than two for each shard
    counted = rows.where(F.col("key").isin(suspects)).groupBy("key").agg(F.sum("size").alias("s")).where(F.col("s") > share)
    return {r["key"] for r in counted.collect()} if suspects else set()


def assign(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Ranges to shards: largest first, to the shard with the fewest bytes."""
    heap, out = [(0, s) for s in range(shards)], {}
    for part, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        had, s = heapq.heappop(heap)
        out[part] = s
        heapq.heappush(heap, (had + size, s))
    return out


def shard(docs: DataFrame, shards: int = 40, ranges_per_shard: int = 48, sample: int = 60_000, rounds: int = 4) -> DataFrame:
    """Every row of docs (doc_id, text) to a shard: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Equal texts share a shard, unless their group has more bytes than a shard's equal share: such a hot group is divided, as
    sizes come first. Null texts have no bytes; repeated rows and ties are told apart by row number; no documents give no rows. The sample
    and the ranges are bounded by parameters, whatever the number of documents."""
    rows = materialize(records(docs), "records")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = shards * ranges_per_shard
    most, first = 1.5 * total / wanted, _draw(rows, total, sample, 0)
    divisible = _oversize(rows, first, total / shards)
    splits = sorted(set(_quantiles(first, wanted, divisible)))
    for turn in range(1, rounds + 1):
        at = _position(np.array(splits or np.zeros((0, 2)), np.int64).reshape(-1, 2))
        placed = rows.withColumn("part", at("key", "row"))
        counted = {r[0]: (r[1], r[2]) for r in placed.groupBy("part").agg(F.sum("size"), F.count("*")).collect()}
        over = {p: s for p, (s, c) in counted.items() if s > most and c > 1}
        if not over or turn == rounds:
            break
        chosen = placed.where(F.col("part").isin(list(over)))
        drawn = _draw(chosen, sum(over.values()), min(sample, 200 * len(over) + 1000), turn)
        drawn["part"] = _part_of(drawn, splits)
        more = {q for p, own in drawn.groupby("part") for q in _quantiles(own.reset_index(drop=True), int(-(-over.get(p, 0) // (total / wanted))), divisible)}
        grown = sorted(set(splits) | more)
        if len(grown) == len(splits):
            break
        splits = grown
    shard_of = assign({p: s for p, (s, _) in counted.items()}, shards)
    table = np.zeros(len(splits) + 1, np.int32)
    for p, s in shard_of.items():
        table[p] = s

    @F.pandas_udf("int")
    def to_shard(part: pd.Series) -> pd.Series:
        return pd.Series(table[part.to_numpy(np.int64)])

    put = placed.withColumn("shard", to_shard("part")).select("doc_id", "size", "text_crc32", "shard", "key", "row")
    return ranked(put, ["shard"], [F.col("key"), F.col("row")], "slot", F.col("row")).select("doc_id", "size", "text_crc32", "shard", "slot")


def _part_of(drawn: pd.DataFrame, splits: list[tuple[int, int]]) -> np.ndarray:
    import bisect

    return np.array([bisect.bisect_right(splits, (k, r)) for k, r in zip(drawn["key"], drawn["row"])], np.int64)
