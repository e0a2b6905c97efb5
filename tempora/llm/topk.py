"""Operator 6: exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors become whole numbers and are dealt to blocks of bounded size, queries likewise. For a block of vectors every
dimension is a sorted list, stored with the block. The queries of a block read the lists together, each list from the end
that a query's sign favours and all lists to one depth, a stretch at a time. An entry that is read counts in its vector's
bounds with its value; what is unread counts in the upper bound as the value read last, in the lower one as the list's other
end. The bar of a query is its k-th score so far, at first its k-th lower bound: it stops when few enough vectors can still reach
it, and those scores are resolved exactly. A task carries its queries' bars from block to block, and a first block that all
queries read gives every task a bar to begin with. Each block meets each block of queries once, by an equi-join; no pair of
single rows is ever a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, batch, materialize

#: Share of each list that is read before the first look at the bounds, how much further each next look is, and the
#: queries that read together.
FIRST, FURTHER, TOGETHER = 1 / 16, 1.5, 512
#: Components from here on are refused: bounds of their products could overflow a double.
LARGEST = 1e150
_BLOCK = "block long, n long, dims long, ids binary, known binary, rows binary, lists binary, x binary"
_FOUND = "query_row long, query_id long, vec_id long, row long, score long"
_LONG = 1 << 63


def _numbers(lists: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of every vector, as doubles that hold these whole numbers exactly; shorter ones end in zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) > LARGEST:
        raise ValueError(f"components above {LARGEST} have no inner product here")
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def blocks(vectors: DataFrame, count: int, scale: float) -> DataFrame:
    """vectors (row, vec_id, embedding) of finite components, dealt to `count` blocks by their row."""
    members = vectors.groupBy(F.pmod(F.xxhash64("row"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("row", "vec_id", "embedding")).alias("members"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(_BLOCK)
        for b in batches:
            for k in range(b.num_rows):
                own = b.column("members")[k].values
                ids, x = own.field("vec_id"), _numbers(own.field("embedding"), scale)
                yield batch({"block": [b.column("block")[k].as_py()], "n": [len(x)], "dims": [x.shape[1]], "ids": [ids.fill_null(0).to_numpy().astype("<i8").tobytes()], "known": [ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], "rows": [own.field("row").to_numpy().astype("<i8").tobytes()], "lists": [np.argsort(x, 0).T.astype("<i4").tobytes()], "x": [x.astype("<f8").tobytes()]}, schema)

    return members.mapInArrow(packed, _BLOCK)


class Block:
    """One row of `blocks`: vectors, and per dimension its list of values in ascending order."""

    def __init__(self, row: dict):
        self.x = np.frombuffer(row["x"], "<f8").reshape(row["n"], row["dims"])
        self.ids, self.rows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
        self.known = np.frombuffer(row["known"], np.uint8) == 1
        self.order = np.frombuffer(row["lists"], "<i4").reshape(row["dims"], row["n"]).astype(np.int64)
        self.values = np.take_along_axis(self.x.T, self.order, 1)


def _read(block: Block, d: int, depth: int, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """By how much the entries read of each of d lists exceed `top`, those of the upper end, and `bottom`, the lower end: a
    row a list and end, a column a vector, 0 where nothing was read."""
    n, out = len(block.x), np.zeros((2 * d, len(block.x)))
    np.put_along_axis(out[:d], block.order[:d, n - depth :], block.values[:d, n - depth :] - top[:, None], 1)
    np.put_along_axis(out[d:], block.order[:d, :depth], block.values[:d, :depth] - bottom[:, None], 1)
    return out


def candidates_of(block: Block, queries: np.ndarray, bars: np.ndarray, skips: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
    """For each query the vectors of the block that hold all whose product with it reaches its bar and, of these, the k
    best; and how many entries of lists were read to find them.

    The bar is the k-th lower bound where it is -inf. `skips` are the vectors that may not be found, or -1. Lists whose
    weight is zero are not read. Every other list is first read to FIRST of its length, then to FURTHER times as much, until
    few vectors are left."""
    n, d = len(block.x), queries.shape[1]
    weights, values = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]), block.values[:d]
    lowest, highest = values[:, 0], values[:, -1]
    least, most = weights @ np.r_[lowest, highest], weights @ np.r_[highest, lowest]
    slack = np.abs(queries) @ np.maximum(np.abs(lowest), np.abs(highest)) * (d + 4) * 2.0**-48  # sums of doubles err by less
    used, few, depth = np.count_nonzero(queries, 1), max(4 * k, n // 64), max(1, int(n * FIRST))
    found = [(np.zeros(0, np.int64), 0)] * len(queries)
    going = np.flatnonzero(most + slack >= bars)  # the others need not read
    while len(going):
        top, bottom = values[:, n - depth], values[:, depth - 1]  # read last
        w, reach = weights[going], bars[going]
        upper = w @ _read(block, d, depth, top, bottom)
        upper += (w @ np.r_[top, bottom])[:, None]
        none = np.flatnonzero(np.isneginf(reach)) if n > k + 1 else []
        if len(none):
            lower = w[none] @ _read(block, d, depth, lowest, highest)
            own = skips[going[none]]
            lower[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
            reach[none] = least[going[none]] + np.partition(lower, n - k, 1)[:, n - k] - slack[going[none]]
        may = upper >= (reach - slack[going])[:, None]
        done = (np.count_nonzero(may, 1) <= few) | (depth == n)
        for i in np.flatnonzero(done):
            left = np.flatnonzero(may[i])
            found[going[i]] = left[left != skips[going[i]]], int(depth * used[going[i]])
        going, depth = going[~done], min(n, max(depth + 1, int(depth * FURTHER)))
    return found


def candidates(block: Block, q: np.ndarray, bar: float, skip: int, k: int) -> tuple[np.ndarray, int]:
    """The same of one query."""
    return candidates_of(block, q[None, : block.x.shape[1]], np.array([bar]), np.array([skip]), k)[0]


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise inner products as longs; what is below them counts as the least long, what is above is an error."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1]) < 2.0**53:
        return np.einsum("ij,ij->i", x, q).astype(np.int64)
    sums = [sum(int(s) * int(t) for s, t in zip(u, v)) for u, v in zip(x.tolist(), q.tolist())]
    if max(sums, default=0) >= _LONG:
        raise ValueError(f"an inner product of {max(sums)} is beyond a long")
    return np.array([max(s, -_LONG) for s in sums], np.int64)


class Best:
    """The best k of each query of a block of queries, among the blocks met so far."""

    def __init__(self, queries: Block, k: int, bar: np.ndarray):
        self.queries, self.k, self.bar = queries, k, bar
        none = np.zeros(0, np.int64)
        self.at, self.score, self.ids, self.rows, self.known = none, none, none, none, none == 1

    def meet(self, block: Block) -> None:
        dims = min(block.x.shape[1], self.queries.x.shape[1])  # further components meet zeros
        x, q = block.x[:, :dims], self.queries.x[:, :dims]
        order = np.argsort(block.rows)
        place = np.minimum(np.searchsorted(block.rows[order], self.queries.rows), len(order) - 1)
        skip = np.where(block.rows[order][place] == self.queries.rows, order[place], -1)
        parts = [slice(lo, lo + TOGETHER) for lo in range(0, len(q), TOGETHER)]
        found = [f for s in parts for f, _ in candidates_of(block, q[s], self.bar[s], skip[s], self.k)]
        i, j = np.repeat(np.arange(len(q)), [len(f) for f in found]), np.concatenate(found)
        scores = [_exact(x[j[lo : lo + 65_536]], q[i[lo : lo + 65_536]]) for lo in range(0, len(i), 65_536)]
        self.add(i, np.concatenate([np.zeros(0, np.int64), *scores]), block.ids[j], block.rows[j], block.known[j])

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, known: np.ndarray) -> None:
        """Keep each query's k best by score, then vec_id (null last), then row; its k-th score is its bar."""
        at, score, ids, rows, known = (np.r_[had, new] for had, new in ((self.at, at), (self.score, score), (self.ids, ids), (self.rows, rows), (self.known, known)))
        order = np.lexsort((rows, ids, ~known, ~score, at))  # ~score is -score - 1, which no long overflows
        own = at[order]
        first = np.searchsorted(own, own, "left")
        keep = order[np.arange(len(own)) - first < self.k]
        self.at, self.score, self.ids, self.rows, self.known = at[keep], score[keep], ids[keep], rows[keep], known[keep]
        last = np.flatnonzero(np.bincount(self.at, minlength=len(self.bar)) == self.k)
        if len(last):
            kth = self.score[np.searchsorted(self.at, last, "right") - 1]
            self.bar[last] = np.maximum(self.bar[last], np.nextafter(kth.astype(np.float64), -np.inf))

    def found(self) -> pa.RecordBatch:
        if (self.score == -_LONG).any():
            raise ValueError("an inner product is below a long")
        queries = self.queries
        return batch({"query_row": queries.rows[self.at], "query_id": queries.ids[self.at], "vec_id": pa.array(self.ids, pa.int64(), mask=~self.known), "row": self.rows, "score": self.score}, arrow(_FOUND))


def search(vectors: DataFrame, query: Column, k: int = 5, scale: float = 256.0, block_rows: int = 4096, query_rows: int = 512, chunk_blocks: int = 8, tasks: int = 20_000) -> DataFrame:
    """The k highest integer inner products of each query row of vectors (vec_id, embedding): query_id, rank, vec_id, score.

    `query` is a condition on vectors' columns that marks the queries. Components are floor(scale * x), products and sums
    exact at any size; a score among the k highest that a long can't hold, or a component above LARGEST, is a ValueError.
    Vectors that are null or hold null, NaN or infinite components take no part; an empty vector, or a missing last
    component, counts as zeros. A row is never its own match, but rows of equal vec_id or equal vectors match each
    other; equal scores rank by smaller vec_id, null vec_ids last. With fewer than k other rows all are returned; no
    queries give no rows. Other columns are ignored.

    A block holds about block_rows vectors or query_rows queries. Blocks of vectors form chunks of about chunk_blocks, and
    a task compares one block of queries with one chunk (or several, beyond `tasks`)."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(query, F.lit(False)).alias("is_query")).where(finite)
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries = own.agg(F.count("*"), F.count_if("is_query")).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks, n_asked = -(-n // block_rows), -(-n_queries // query_rows)
    chunks = -(-n_blocks // chunk_blocks)
    data = materialize(blocks(own, n_blocks, scale), "blocks")
    asked = blocks(own.where("is_query"), n_asked, scale)
    least = data.agg(F.min("block")).first()[0]
    first = spark.sparkContext.broadcast(data.where(F.col("block") == least).first().asDict())  # one block

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's bar after the first block."""
        block = Block(first.value)
        for b in batches:
            bars = []
            for row in b.to_pylist():
                best = Best(Block(row), k, np.full(row["n"], -np.inf))
                best.meet(block)
                bars.append(best.bar.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bars, pa.binary())], names=[*b.schema.names, "bar"])

    asked = materialize(asked.mapInArrow(start, f"{_BLOCK}, bar binary"), "queries")
    # every block of queries goes to every chunk, every block of vectors to every block of queries: one task's work is a key
    at = lambda stop: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stop - 1).cast("long")))
    left = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], at(chunks).alias("_chunk"))
    right = data.withColumn("_chunk", F.pmod(F.xxhash64("block"), F.lit(chunks))).withColumn("_to", at(n_asked))
    parts = min(tasks, chunks * n_asked)
    met = right.repartition(parts, "_to", "_chunk").join(left.repartition(parts, "q_block", "_chunk").hint("shuffle_hash"), (right["_to"] == left["q_block"]) & (right["_chunk"] == left["_chunk"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}  # k entries a query of the task
        for b in batches:
            for k_ in range(b.num_rows):
                row = b.slice(k_, 1).to_pylist()[0]
                asks = row["q_block"]
                if asks not in best:
                    best[asks] = Best(Block({c[2:]: v for c, v in row.items() if c[:2] == "q_"}), k, np.frombuffer(row["q_bar"], np.float64).copy())
                best[asks].meet(Block(row))
        for one in best.values():
            yield one.found()

    found = met.select(*data.columns, *[c for c in left.columns if c != "_chunk"]).mapInArrow(compare, _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
