"""Operator 13: hard negatives by distributed radix selection over integer scores.

A window is a range of scores of one anchor, over rows of its own label (to find its positives) or of other labels (the
negatives of one positive). Its kth best score is located without sorting or gathering: tasks count the scores of their
vectors by the leading digit of their distance from the window's top, Spark adds these histograms, the digit in which
the kth score falls narrows the window, and the next digit follows. When few scores are left in the digit, or none of
its bits, only rows at or above it are gathered, and of them at most k for a window and a task.

Vectors lie in packed blocks, blocks in chunks; packed anchors go to each chunk, vectors are not copied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, batch, discard, materialize, stored
from .topk import _numbers

#: Bits of a digit.
DIGIT = 8
_PACKED = "block long, rows array<long>, ids array<long>, labels array<int>, dims long, square double, x binary"
_ASKED = "window long, at int, top long, lo long, hi long, same boolean, shift int"
_GATHERED = "window long, row long, vec_id long, score long"


def packed(vectors: DataFrame, count: int, scale: float) -> DataFrame:
    """vectors (row, vec_id, label, embedding) of finite components as `count` blocks, dealt by row; components are
    floor(scale * x). square is the largest square of a vector's length: no product in a block exceeds it and another's
    on average."""
    schema = pa.schema([("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("dims", pa.int64()), ("square", pa.float64()), ("x", pa.binary())])
    members = vectors.groupBy(F.pmod(F.xxhash64("row"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("row", "vec_id", "label", "embedding")).alias("members"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = b.column("members")[k].values
                x = _numbers(own.field("embedding"), scale)
                squares = np.einsum("ij,ij->i", x, x)
                if squares.max(initial=0) >= 2.0**60:
                    raise ValueError(f"vector {own.field('vec_id')[int(squares.argmax())]} is too long: its products may not fit a long")
                lists = [pa.array([own.field(c).to_pylist()], schema.field(f).type) for c, f in (("row", "rows"), ("vec_id", "ids"), ("label", "labels"))]
                yield pa.RecordBatch.from_arrays([b.column("block").slice(k, 1), *lists, pa.array([x.shape[1]]), pa.array([squares.max(initial=0)]), pa.array([x.astype("<f8").tobytes()])], schema=schema)

    return members.mapInArrow(pack, _PACKED)


def _vectors(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.array(row[f"{side}rows"], np.int64)
    return np.frombuffer(row[f"{side}x"], "<f8").reshape(len(rows), row[f"{side}dims"]), rows, np.array(row[f"{side}labels"], np.int64)


def _scores(x: np.ndarray, q: np.ndarray, square: float) -> np.ndarray:
    """All products of q with x as longs. Sums of products stay within the lengths' product: below 2**53 doubles are exact."""
    d = max(x.shape[1], q.shape[1])
    x, q = (np.hstack([v, np.zeros((len(v), d - v.shape[1]))]) if v.shape[1] < d else v for v in (x, q))
    return (q @ x.T).astype(np.int64) if square < 2.0**53 else q.astype(np.int64) @ x.astype(np.int64).T


def _met(row: dict) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Per window of a block of anchors: the window, the places in the block of vectors in its range, and their scores."""
    x, rows, labels = _vectors(row, "")
    q, own, own_labels = _vectors(row, "q_")
    score = _scores(x, q, max(row["square"], row["q_square"]))
    for w in row["windows"]:
        s, at = score[w["at"]], w["at"]
        ok = (s >= w["lo"]) & (s <= w["hi"]) & ((labels == own_labels[at]) == w["same"]) & (rows != own[at])
        places = np.flatnonzero(ok)
        yield w, places, s[places]


def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of scores by window and digit, added up over a few blocks before they leave."""
    schema, held = arrow("window long, digit int, n long"), {}

    def out() -> pa.RecordBatch:
        digits = {w: np.flatnonzero(c) for w, c in held.items()}
        ids = np.repeat(np.fromiter(held, np.int64, len(held)), [len(d) for d in digits.values()])
        none = np.zeros(0, np.int64)
        got = batch({"window": ids, "digit": np.concatenate([none, *digits.values()]), "n": np.concatenate([none, *[held[w][d] for w, d in digits.items()]])}, schema)
        held.clear()
        return got

    for b in batches:
        for row in (r for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            for w, _, s in _met(row):
                counts = np.bincount((w["hi"] - s) >> w["shift"], minlength=1 << DIGIT)
                held[w["window"]] = held[w["window"]] + counts if w["window"] in held else counts
            if len(held) > 20_000:
                yield out()
    yield out()


def gatherer(k: int):
    """Rows in the windows' ranges, of a window at most the k best that a task has met."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = arrow(_GATHERED), {}

        def out() -> pa.RecordBatch:
            rows = [(w, *r) for w, own in held.items() for r in own]
            held.clear()
            return batch({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)

        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                ids, rows = row["ids"], row["rows"]
                key = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)
                for w, places, s in _met(row):
                    best = np.lexsort((np.array(rows)[places], key[places], -s))[:k] if len(places) else places
                    new = [(rows[p], ids[p], int(v)) for p, v in zip(places[best].tolist(), s[best])]
                    if new:
                        held[w["window"]] = sorted(held.get(w["window"], []) + new, key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))[:k]
                if len(held) > 20_000:
                    yield out()
        yield out()

    return gather


class Search:
    """Packed vectors and anchors, and the selection of windows over them."""

    def __init__(self, vectors: DataFrame, anchor: Column, scale: float, block_rows: int, anchor_rows: int, chunk_blocks: int):
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding", F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
        own = materialize(own.where(finite & F.col("label").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "vectors")
        n, anchors = own.agg(F.count("*"), F.count_if("is_anchor")).first()
        self.spark, self.anchors = vectors.sparkSession, anchors
        if not anchors:
            return
        blocks = -(-n // block_rows)
        self.chunks = max(-(-blocks // chunk_blocks), min(blocks, 64))
        self.data = materialize(packed(own, blocks, scale), "blocks").withColumn("_chunk", F.pmod("block", F.lit(self.chunks)))
        self.asked = materialize(packed(own.where("is_anchor"), -(-anchors // anchor_rows), scale), "anchors")
        self.bound = int(self.data.agg(F.max("square")).first()[0]) + 1

    def each(self) -> DataFrame:
        """One row an anchor: number (unique), block, at (its place there), row, vec_id."""
        return self.asked.select("block", F.posexplode(F.arrays_zip("rows", "ids")).alias("at", "_a")).select(
            (F.col("block") * (1 << 20) + F.col("at")).alias("number"), "block", "at", F.col("_a.rows").alias("row"), F.col("_a.ids").alias("vec_id")
        )

    def meet(self, windows: DataFrame) -> DataFrame:
        """Blocks of vectors beside each block of anchors with its windows (block and the columns of _ASKED)."""
        names = [c.split()[0] for c in _ASKED.split(", ")]
        own = windows.groupBy("block").agg(F.collect_list(F.struct(*names)).alias("windows"))
        chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.chunks - 1).cast("long")))
        asked = self.asked.join(own, "block").select(*[F.col(c).alias(f"q_{c}") for c in self.asked.columns if c not in ("ids", "block")], "windows", chunks.alias("_chunk"))
        sides = self.data.repartition(self.chunks, "_chunk").hint("shuffle_hash"), asked.repartition(self.chunks, "_chunk")
        return sides[1].join(sides[0], "_chunk").drop("_chunk", "block")

    def first(self, windows: DataFrame, k: int) -> DataFrame:
        """The k best rows of each window (window, block, at, lo, hi, same): window, row, vec_id, score, rank.

        Equal scores rank by smaller vec_id, null ones last, then by row."""
        bits = F.ceil(F.log2(F.col("hi").cast("double") - F.col("lo").cast("double") + 1)) + 1
        state = windows.select("window", "block", "at", F.col("hi").alias("top"), "lo", "hi", "same", F.greatest(F.lit(0), bits - DIGIT).cast("int").alias("shift"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open"))
        state, path = stored(state, "windows")
        while state.where("open").limit(1).count():
            counts = self.meet(state.where("open")).mapInArrow(histograms, "window long, digit int, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
            up_to = F.sum("n").over(Window.partitionBy("window").orderBy("digit"))
            reached = counts.withColumn("upto", up_to).join(state.select("window", "need"), "window").where("upto >= need")
            reached = reached.groupBy("window").agg(F.min(F.struct("digit", "upto", "n")).alias("r")).select("window", "r.*")
            digit = F.col("digit").cast("long")
            low = F.greatest("lo", F.expr("hi - shiftleft(cast(digit + 1 as bigint), shift) + 1"))
            last = (F.col("shift") == 0) | (F.col("upto") <= 8 * k)  # its exact score, or few enough to gather
            new = state.join(reached, "window", "left").select(
                "window", "block", "at", "top", "same",
                F.when(F.col("open") & digit.isNotNull(), low).otherwise(F.col("lo")).alias("lo"),
                F.when(F.col("open") & digit.isNotNull(), F.expr("hi - shiftleft(cast(digit as bigint), shift)")).otherwise(F.col("hi")).alias("hi"),
                F.greatest(F.lit(0), F.col("shift") - DIGIT).alias("shift"),
                F.when(digit.isNotNull(), F.col("need") - (F.col("upto") - F.col("n"))).otherwise(F.col("need")).alias("need"),
                (F.col("open") & digit.isNotNull() & ~last).alias("open"),
            ).select(state.columns)
            state, after = stored(new, "windows")
            discard(self.spark, path)
            path = after
        found = self.meet(state.withColumn("hi", F.col("top"))).mapInArrow(gatherer(k), _GATHERED)
        order = Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0, block_rows: int = 2048, anchor_rows: int = 128, chunk_blocks: int = 32) -> DataFrame:
    """Hard negatives of vectors (vec_id, label, embedding): anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    `anchor` is a condition on vectors' columns. Scores are inner products of floor(scale * x), exact whole numbers. An
    anchor's positives are its first `positives` other rows of its label by score, ties by smaller vec_id; for each, its
    negatives are the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= 100 *
    positive_score (all, if fewer), ranked from 1. A positive without such rows, as each of negative score, has no rows.

    Rows with a null label, a null vector or a null or non-finite component take no part; an empty vector, or a missing
    last component, counts as zeros. Rows of equal vec_id are rows of their own, also as anchors; a null vec_id comes last
    among equals. A vector whose square is 2**60 or more is a ValueError that names it. No anchors give no rows. Other columns
    are ignored. Hot labels and equal vectors make no difference to the layout: rows are dealt by number."""
    search = Search(vectors, anchor, scale, block_rows, anchor_rows, chunk_blocks)
    if not search.anchors:
        return search.spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    each = search.each()
    whole = each.select(F.col("number").alias("window"), "block", "at", F.lit(-search.bound).cast("long").alias("lo"), F.lit(search.bound).cast("long").alias("hi"), F.lit(True).alias("same"))
    found = search.first(whole, positives).select(F.col("window").alias("number"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank")
    pairs = each.join(found, "number").select((F.col("number") * positives + F.col("rank") - 1).alias("window"), "block", "at", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    pairs = materialize(pairs, "pairs")
    # the least whole number that is low / 100 of the score or more, without products that overflow
    least = F.expr(f"(positive_score div 100) * {low} + cast(ceil(positive_score % 100 * {low} / 100D) as bigint)")
    ranges = pairs.select("window", "block", "at", least.alias("lo"), F.col("positive_score").alias("hi"), F.lit(False).alias("same")).where("lo <= hi")
    hard = search.first(ranges, negatives).select("window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(hard, "window").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
