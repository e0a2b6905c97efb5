"""Operator 1: a quality classifier on random-indexing word vectors.

Words and runs of marks are hashed to BUCKETS rows. A bucket has a fixed sparse random index vector; its word vector is
that plus the sum of the index vectors of the words around it in the whole corpus. A document is the mean of its word
vectors and of their squares, which a two-layer network, trained in numpy on a bounded sample of labelled rows, turns
into a score; its temperature is fitted on labelled rows kept from the training."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, batch, grouped, slices

BUCKETS, DIMS, ACTIVE, WINDOW = 1 << 15, 32, 2, 2
FEATURES = 2 * DIMS + 2
#: Labelled rows used at most; a fixed bound, so that training costs the same at every size.
TRAIN_ROWS = 30_000
#: Bytes of texts whose words are looked up together.
GROUP_BYTES = 16 << 20
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_LETTERS_MARKS = r"^(?P<w>\pL+)(?P<t>[!-/:-@\[-^`{-~]*)$"
_SUMS = ", ".join(f"v{k} long" for k in range(DIMS))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the ACTIVE places of its index vector and their signs, from a fixed seed."""
    rng = np.random.default_rng(42)
    return rng.integers(0, DIMS, (BUCKETS, ACTIVE)), rng.choice([-1.0, 1.0], (BUCKETS, ACTIVE))


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all texts' words; where each text's begin, and the end; and of what stands between blanks a number
    for each different thing, and where each text's begin. A thing is looked up once for all texts; nothing is kept."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts.fill_null("")))  # of a blank text one empty thing without words
    found = lists.flatten().dictionary_encode()
    known, lengths = _hashed(found.dictionary)
    at = found.indices.to_numpy().astype(np.int64)
    own = lengths[at]
    ends, first = np.r_[0, np.cumsum(own)], np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))]
    place = np.repeat((np.cumsum(lengths) - lengths)[at] - ends[:-1], own)
    return known[place + np.arange(len(place))], ends[first], at, first


def _hashed(things: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words of each thing, one after another, and how many each has. Letters with marks after them
    are two words; other things are taken apart one by one."""
    split = pc.extract_regex(things, _LETTERS_MARKS)
    simple = split.is_valid().to_numpy(zero_copy_only=False)
    two = split.filter(pa.array(simple))
    tails = pc.struct_field(two, "t").dictionary_encode()
    marked = pc.greater(pc.binary_length(pc.struct_field(two, "t")), 0).to_numpy(zero_copy_only=False)
    odd = list(map(_WORD.findall, things.filter(pa.array(~simple)).to_pylist()))
    lengths = np.empty(len(things), np.int64)
    lengths[simple], lengths[~simple] = 1 + marked, np.fromiter(map(len, odd), np.int64, len(odd))
    starts = np.cumsum(lengths) - lengths
    known = np.empty(int(lengths.sum()), np.int32)
    known[starts[simple]] = _buckets(pc.struct_field(two, "w").to_pylist())
    known[starts[simple][marked] + 1] = _buckets(tails.dictionary.to_pylist())[tails.indices.to_numpy()[marked]]
    rest = lengths[~simple]
    known[np.repeat(starts[~simple] - (np.cumsum(rest) - rest), rest) + np.arange(rest.sum())] = _buckets(chain.from_iterable(odd))
    return known, lengths


def _buckets(words: Iterable[str]) -> np.ndarray:
    from xxhash import xxh32_intdigest

    return (np.fromiter(map(xxh32_intdigest, words), np.uint32) % np.uint32(BUCKETS)).astype(np.int32)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one task: rows of bucket and vector, BUCKETS at most."""
    places, signs = index_vectors()
    places, signs = np.vstack([places, np.zeros((1, ACTIVE), np.int64)]), np.vstack([signs, np.zeros((1, ACTIVE))])
    total, seen = np.zeros((BUCKETS + 1) * DIMS), np.zeros(BUCKETS + 1, bool)
    for b in grouped(batches, 0, GROUP_BYTES):
        own, ends, _, _ = buckets_of(b.column(0))
        n = len(ends) - 1
        words = np.full(len(own) + WINDOW * n, BUCKETS)  # no word between texts: it keeps them apart
        words[np.arange(len(own)) + WINDOW * np.repeat(np.arange(n), np.diff(ends))] = own
        seen[own] = True
        for lo in range(0, len(words), 1 << 20):
            part = words[lo : lo + (1 << 20) + WINDOW]
            for k in range(1, WINDOW + 1):
                left, right = part[: min(1 << 20, len(part) - k)], part[k : k + (1 << 20)]
                for to, of in ((right, left), (left, right)):
                    for j in range(ACTIVE):
                        total += np.bincount(to * DIMS + places[of, j], signs[of, j], len(total))
    rows = np.flatnonzero(seen[:BUCKETS])
    got = total.reshape(-1, DIMS)[rows].astype(np.int64)
    yield batch({"bucket": rows, **{f"v{k}": got[:, k] for k in range(DIMS)}}, arrow(f"bucket long, {_SUMS}"))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS: the sums over all documents, a table of fixed size, each row at unit length plus its index vector."""
    sums = docs.select("text").mapInArrow(_contexts, f"bucket long, {_SUMS}").groupBy("bucket").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIMS)])
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMS))
    np.add.at(own, (np.arange(BUCKETS)[:, None], places), signs)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    table = sums.toPandas()
    around = np.zeros((BUCKETS, DIMS))
    around[table["bucket"].to_numpy(np.int64)] = table.drop(columns="bucket").to_numpy(np.float64)
    return (own + around / np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per text the means of its word vectors and of their squares (vectors has both), the share of different things
    between blanks, the log length; zeros for a text without words."""
    words, ends, things, first = buckets_of(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for k in np.flatnonzero(np.diff(ends)).tolist():
        lo, hi = int(ends[k]), int(ends[k + 1])
        for at in range(lo, hi, 4096):
            out[k, : 2 * DIMS] += vectors[words[at : min(hi, at + 4096)]].sum(0) / np.float32(hi - lo)
        own = np.sort(things[first[k] : first[k + 1]])
        out[k, -2], out[k, -1] = (1 + np.count_nonzero(np.diff(own))) / len(own), np.log1p(hi - lo) / 10
    return out


class Network:
    """Two layers, tanh between them; standardised inputs; a temperature for the output."""

    def __init__(self, hidden: int = 48, seed: int = 7):
        self.hidden, self.seed, self.temperature = hidden, seed, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.spread) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, size: int = 256, rate: float = 3e-3) -> Network:
        """Adam on the logistic loss; every fifth row is kept for the temperature. One label only: that label's share."""
        rng, x = np.random.default_rng(self.seed), x.astype(np.float64)
        n, d = x.shape[0], x.shape[1] if x.size else FEATURES
        self.mean = x.mean(0) if n else np.zeros(d)
        self.spread = np.maximum(x.std(0), 1e-6) if n else np.ones(d)
        self.w1, self.b1 = rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, self.hidden**-0.5, self.hidden), 0.0
        if n < 10 or y.min() == y.max():
            self.w2[:] = 0
            p = (y.sum() + 1) / (n + 2)
            self.b2 = float(np.log(p / (1 - p)))
            return self
        kept = np.arange(n) % 5 == 4
        xt, yt = ((x - self.mean) / self.spread)[~kept], y[~kept].astype(np.float64)
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(xt))
            for lo in range(0, len(xt), size):
                xb, yb = xt[order[lo : lo + size]], yt[order[lo : lo + size]]
                h = np.tanh(xb @ params[0] + params[1])
                e = (1 / (1 + np.exp(-(h @ params[2] + params[3][0]))) - yb) / len(xb)
                back = e[:, None] * params[2] * (1 - h * h)
                grads = [xb.T @ back + 1e-4 * params[0], back.sum(0), h.T @ e + 1e-4 * params[2], np.array([e.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.b2 = float(params[3][0])
        z, y = self.logits(x[kept]), y[kept]
        loss = lambda s: np.logaddexp(0, np.where(y == 1, -z, z) / s).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: Broadcast, rows: int = TRAIN_ROWS) -> Network:
    """Fit on at most `rows` labelled rows that aren't held out: those of the smallest hashes of doc_id."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    @F.arrow_udf("binary")
    def pooled(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for part in slices(texts, GROUP_BYTES) for x in pool(part, vectors.value)], pa.binary())

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", pooled("text").alias("x"))
    got = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "x", "quality").limit(rows).select("x", "quality").toPandas()
    x = np.array([np.frombuffer(b, np.float32) for b in got["x"]]).reshape(-1, FEATURES)
    return Network().fit(x, got["quality"].to_numpy(np.int64))


def scorer(docs: DataFrame, labels: DataFrame) -> Callable[[Column], Column]:
    """Learn from all texts of docs (doc_id, text) and the labels (doc_id, quality); give the score as a function of a text column.

    A label with a null part is skipped; rows of a held-out doc_id never reach the training. A null or empty text scores as
    a text without words. Without usable labels every score is 0.5. Only a text decides: equal texts score alike."""
    context = docs.sparkSession.sparkContext
    vectors = word_vectors(docs)
    vectors = context.broadcast(np.hstack([vectors, vectors * vectors]))  # BUCKETS x 2 DIMS floats, 8 MB
    net = context.broadcast(train(docs, labels, vectors))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([net.value.score(pool(part, vectors.value)) for part in slices(texts, GROUP_BYTES)]), pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score every row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Nulls and missing labels as in `scorer`; other columns are ignored; no documents give no rows."""
    score = scorer(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
