"""Operator 4: near-duplicate embeddings by NN-descent.

Equal directions form one class. Classes start with the neighbours that a few tables of random-hyperplane buckets give them,
whatever their number; then, round by round, the neighbours of a class (and those that have it as neighbour) are compared with
one another and better ones enter their lists. Only lists with a member of the last round are compared again. Pairs of the
threshold are edges, confirmed in double precision, and edges make components. Lists of fixed length saturate in dense
groups, so the edges are more than the lists' pairs: every bucket and every local join gives a spanning forest of all its
links, and components whose saturated lists could meet, by the angle of their pivots and their radii, are compared in tiles.
Within a component every list is enlarged to the whole component: members within half the threshold's angle of the
component's pivot link with one another by the triangle inequality and are only counted, the others are compared with
all members in tiles. Recall is audited on a bounded sample of classes against all, drawn by strata (dense and small
groups, classes with a neighbour just below the threshold, the rest) and weighed by their sizes, as the share of linked
classes whose count is complete, small groups on their own. If it is short, the lists go on from where they are with twice
the length and as many more buckets; what is still short after the last attempt is compared exactly, in tiles of all classes,
which costs the square of their number."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batch, components, join_hot, materialize, merge_labels

#: Rows of a bucket or tile that one numpy comparison takes at most (about).
GROUP, TILE = 256, 512
#: Classes whose links the audit counts by brute force, at most; a stratum gives a quarter.
AUDITED = 1024
#: Refinement ends with the round that changes a smaller share of all list entries than this.
SETTLED = 0.05
#: near says whether the pair may enter u's list; the others only connect.
_CANDIDATES = "u long, w long, s double, near boolean"
#: Single precision differs from double by less than this.
SLACK = 1e-4
_LOG = logging.getLogger(__name__)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and the vector at unit length as bytes of doubles; null where it links with nothing."""
    for b in batches:
        lists = b.column("embedding")
        valid, out = lists.is_valid().to_numpy(zero_copy_only=False), []
        offsets = lists.offsets.to_numpy()
        flat = lists.values
        bad = ~flat.is_valid().to_numpy(zero_copy_only=False)
        x = flat.cast(pa.float64()).fill_null(0).to_numpy()
        bad |= ~np.isfinite(x)
        for ok, lo, hi in zip(valid, offsets, offsets[1:]):
            v = x[lo:hi]
            largest = np.abs(v).max(initial=0)
            if not ok or not largest or bad[lo:hi].any():
                out.append(None)
            else:
                v = v / largest
                out.append((v / np.linalg.norm(v) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _matrix(values: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Vectors of one length, given as bytes, as rows."""
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), -1)


def _single(unit: bytes) -> bytes:
    return np.frombuffer(unit, "<f8").astype("<f4").tobytes()


def _buckets(tables: int, bits: int, seed: int):
    """Each class once per table, with the signs of its products with the table's random hyperplanes as bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, units = b.column("cid").to_numpy(), b.column("unit").to_pylist()
            dims = np.array([len(u) for u in units])
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(units[k] for k in own), "<f8").reshape(len(own), -1)
                planes = np.random.default_rng([seed, int(d)]).normal(size=(x.shape[1], tables * max(1, bits)))
                signs = (x @ planes > 0).reshape(len(own), tables, -1)[:, :, :bits]
                code = signs @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(own), tables), np.int64)
                v = pa.array([_single(units[k]) for k in own], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(np.full(len(own), d, np.int32)), pa.array(code[:, t]), pa.array(ids[own]), v], names=["t", "dims", "code", "cid", "v"])

    return rows


def _lists(column: pa.Array) -> Iterator[pa.Array]:
    for k in range(len(column)):
        yield column[k].values


def _forest(s: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, that connect what the links in a square of similarities connect; those in doubt are all given."""
    i, j = np.nonzero(np.triu(s >= threshold - SLACK, 1))
    sure = s[i, j] >= threshold + SLACK
    a, b = merge_labels(np.arange(len(s)), i[sure], j[sure])
    return np.r_[a, i[~sure]], np.r_[b, j[~sure]]


def _start(keep: int, threshold: float):
    """Per bucket the `keep` nearest of each member within it, and a forest of its links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members in _lists(b.column("members")):
                n = len(members)
                if n < 2:
                    continue
                ids, v = members.field("cid").to_numpy(), _matrix(members.field("v"), "<f4")
                s = v @ v.T
                np.fill_diagonal(s, -2)
                near = np.argpartition(-s, min(keep, n - 1) - 1, 1)[:, : min(keep, n - 1)]
                i, j = _forest(s, threshold)
                u, w = np.r_[np.repeat(ids, near.shape[1]), ids[i]], np.r_[ids[near].ravel(), ids[j]]
                yield batch({"u": u, "w": w, "s": np.r_[np.take_along_axis(s, near, 1).ravel(), s[i, j]].astype(np.float64), "near": np.arange(len(u)) < near.size}, arrow(_CANDIDATES))

    return rows


def _core(threshold: float):
    """Whether a member links surely with all that lie as near to its bucket's pivot, as far as single precision tells."""
    within = np.cos(np.arccos(threshold) / 2) + SLACK

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [np.frombuffer(x, "<f4") @ np.frombuffer(y, "<f4") >= within for x, y in zip(b.column("v").to_pylist(), b.column("pivot").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(near, bool))], names=[*b.schema.names, "core"])

    return rows


def _start_across(keep: int, threshold: float):
    """As _start, for the members of two parts of a bucket: each one's nearest in the other part, and a forest of links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, other in zip(_lists(b.column("one")), _lists(b.column("other"))):
                x, y = one.field("cid").to_numpy(), other.field("cid").to_numpy()
                s = _matrix(one.field("v"), "<f4") @ _matrix(other.field("v"), "<f4").T
                i, j = np.nonzero(s >= threshold - SLACK)
                sure = s[i, j] >= threshold + SLACK
                fi, fj = merge_labels(np.arange(len(x) + len(y)), i[sure], len(x) + j[sure])
                got = [(x[np.r_[fi, i[~sure]]], y[np.r_[fj - len(x), j[~sure]]], s[np.r_[fi, i[~sure]], np.r_[fj - len(x), j[~sure]]], False)]
                for u, w, to in ((x, y, s), (y, x, s.T)):
                    m = min(keep, len(w))
                    near = np.argpartition(-to, m - 1, 1)[:, :m]
                    got.append((np.repeat(u, m), w[near].ravel(), np.take_along_axis(to, near, 1).ravel(), True))
                u, w, s = (np.concatenate([g[k] for g in got]) for k in range(3))
                yield batch({"u": u, "w": w, "s": s.astype(np.float64), "near": np.repeat([g[3] for g in got], [len(g[0]) for g in got])}, arrow(_CANDIDATES))

    return rows


def _large_buckets(keyed: DataFrame, large: DataFrame, key: list[str], keep: int, threshold: float) -> DataFrame:
    """Candidates of the buckets in `large`: their parts within themselves and, in tiles, with one another.

    Members within half the threshold's angle of the bucket's pivot all link: each is paired with the pivot, and their
    parts aren't compared with one another, so that a dense group costs no square of its size."""
    pivots = keyed.join(large, key, "left_semi").groupBy(*key).agg(F.min_by(F.struct("cid", "v"), F.xxhash64("cid", "t")).alias("p"))
    members = keyed.join(pivots, key).select(*key, "cid", "v", F.col("p.cid").alias("pivot_cid"), F.col("p.v").alias("pivot"))
    members = materialize(members.mapInArrow(_core(threshold), "t int, dims int, code long, cid long, v binary, pivot_cid long, pivot binary, core boolean").drop("pivot"), "large")
    stars = members.where("core and cid <> pivot_cid").select(F.col("cid").alias("u"), F.col("pivot_cid").alias("w"), F.lit(1.0).alias("s"), F.lit(False).alias("near"))
    count = members.groupBy(*key, "core").agg(F.ceil(F.count("*") / GROUP).alias("n"))
    parts = members.join(count, [*key, "core"]).groupBy(*key, "core", F.pmod(F.xxhash64("cid", "t"), "n").alias("part")).agg(F.collect_list(F.struct("cid", "v")).alias("members"))
    parts = materialize(parts, "parts")
    within = parts.select("members").mapInArrow(_start(keep, threshold), _CANDIDATES)
    one = parts.where("not core").select(*key, F.col("part").alias("i"), F.col("members").alias("one"))
    others = parts.select(*key, "core", "part").withColumnsRenamed({"part": "j"})
    pairs = one.select(*key, "i").join(others, key).where("core or i < j").join(one, [*key, "i"])
    across = pairs.join(parts.select(*key, "core", F.col("part").alias("j"), F.col("members").alias("other")), [*key, "core", "j"])
    return within.union(stars).union(across.select("one", "other").mapInArrow(_start_across(keep, threshold), _CANDIDATES))


def _local_join(threshold: float):
    """Per list of neighbours: pairs (u, w) within it where w is nearer to u than the last of u's list, and not in it; and
    a forest of its links."""
    schema = arrow(_CANDIDATES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple] = []
            for members in _lists(b.column("members")):
                if len(members) < 2:
                    continue
                ids, last, v = members.field("m").to_numpy(), members.field("last").to_numpy(), _matrix(members.field("v"), "<f4")
                s = v @ v.T
                better = s > last[:, None]
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                had = _matrix(members.field("near"), "<i8")
                new = ~(had[i] == ids[j][:, None]).any(1)
                fi, fj = _forest(s, threshold)
                unlisted = ~(had[fi] == ids[fj][:, None]).any(1) & ~(had[fj] == ids[fi][:, None]).any(1)
                for x, y, near in ((i[new], j[new], True), (fi[unlisted], fj[unlisted], False)):
                    if len(x):
                        got.append((ids[x], ids[y], s[x, y].astype(np.float64), np.full(len(x), near)))
            if got:
                u, w, s, near = (np.concatenate(c) for c in zip(*got))
                _, first = np.unique(np.stack([u, w, near]), axis=1, return_index=True)
                yield batch({"u": u[first], "w": w[first], "s": s[first], "near": near[first]}, schema)

    return rows


def _pack_near(k: int):
    """The ids of a list, k of them (-1 where it is shorter), as bytes; and what a better neighbour has to exceed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, last = [], []
            for x in b.column("near").to_pylist():
                ids = np.full(k, -1, "<i8")
                ids[: len(x)] = [y["w"] for y in x]
                near.append(ids.tobytes())
                last.append(-x[-1]["d"] if len(x) == k else -2.0)
            yield pa.RecordBatch.from_arrays([b.column("u"), pa.array(near, pa.binary()), pa.array(last, pa.float64())], names=["u", "near", "last"])

    return rows


def _nearest(candidates: DataFrame, k: int) -> DataFrame:
    """u and near: its k nearest of different candidates, as structs (d, w, born) of minus similarity, id and round."""
    return candidates.groupBy("u").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("d"), "w", "born"))), 1, k).alias("near"))


def _links(candidates: DataFrame, threshold: float) -> DataFrame:
    return candidates.where(F.col("s") >= threshold - SLACK).select(F.least("u", "w").alias("a"), F.greatest("u", "w").alias("b"))


def plane_bits(n: int) -> int:
    """Hyperplanes a table, so that a bucket has about 64 of n classes."""
    return int(np.clip(np.ceil(np.log2(max(1, n) / 64)), 0, 40))


def graph(classes: DataFrame, n: int, k: int, tables: int, rounds: int, seed: int, threshold: float, had: DataFrame | None = None, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph of classes (cid, unit): u, near; and pairs (a, b) to confirm: all that were met and connect.

    `had` is a graph to go on from, beside the buckets. With bits = 0 a table is one bucket, so that all classes are compared."""
    bits = plane_bits(n) if bits is None else bits
    keyed = classes.select("cid", "unit").mapInArrow(_buckets(tables, bits, seed), "t int, dims int, code long, cid long, v binary")
    keyed = materialize(keyed, "buckets")
    key = ["t", "dims", "code"]
    large = keyed.groupBy(*key).count().where(F.col("count") > 2 * GROUP)
    keep = max(2, k // 2)
    whole = keyed.join(large, key, "left_anti").groupBy(*key).agg(F.collect_list(F.struct("cid", "v")).alias("members"))
    found = whole.select("members").mapInArrow(_start(keep, threshold), _CANDIDATES).union(_large_buckets(keyed, large, key, keep, threshold))
    found = materialize(found, "candidates")
    begin = found.where("near").select("u", "w", "s")
    if had is not None:
        begin = begin.union(had.select("u", F.explode("near").alias("x")).select("u", "x.w", -F.col("x.d")))
    lists, met = materialize(_nearest(begin.withColumn("born", F.lit(0)), k), "graph"), _links(found, threshold)
    v = keyed.where("t = 0").select(F.col("cid").alias("m"), "v")
    for born in range(1, rounds + 1):
        forward = lists.select("u", F.explode("near").alias("x")).select("u", "x.w", "x.born")
        fresh = forward.where(F.col("born") == born - 1)  # a list none of whose members is new has nothing new to compare
        touched = fresh.select(F.col("u").alias("p")).union(fresh.select("w")).distinct()
        fan_in = forward.groupBy("w").count().where(F.col("count") > 4 * k).select("w", F.ceil(F.col("count") / (4 * k)).alias("parts"))
        # a class's list: its neighbours and itself, and those that have it as neighbour, in parts where they are many
        backward = forward.join(fan_in, "w", "left").select(F.col("w").alias("p"), F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).alias("part"), F.col("u").alias("m"))
        zero = F.lit(0).cast("long").alias("part")
        all_lists = forward.select(F.col("u").alias("p"), zero, F.col("w").alias("m")).union(lists.select(F.col("u").alias("p"), zero, F.col("u").alias("m"))).union(backward).distinct()
        about = lists.select("u", "near").mapInArrow(_pack_near(k), "u long, near binary, last double").withColumnRenamed("u", "m").join(v, "m")
        joined = all_lists.join(touched, "p", "left_semi").join(about, "m").groupBy("p", "part").agg(F.collect_list(F.struct("m", "last", "near", "v")).alias("members"))
        new = materialize(joined.select("members").mapInArrow(_local_join(threshold), _CANDIDATES), "candidates")
        met = met.union(_links(new, threshold))
        new = new.where("near").select("u", "w", "s").withColumn("born", F.lit(born))
        known = lists.select("u", F.explode("near").alias("x")).select("u", "x.w", (-F.col("x.d")).alias("s"), "x.born")
        lists = materialize(_nearest(known.union(new), k), "graph")
        if lists.agg(F.coalesce(F.sum(F.size(F.filter("near", lambda x: x["born"] == born))), F.lit(0))).first()[0] <= SETTLED * n * k:
            break
    return lists, met


def threshold_edges(met: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of those met whose cosine in double precision reaches the threshold."""
    pairs = met.distinct()
    a, b = (classes.select(F.col("cid").alias(c), F.col("unit").alias(f"unit_{c}")) for c in "ab")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = [bool(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8") >= threshold) for x, y in zip(t.column("unit_a").to_pylist(), t.column("unit_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "unit_a", "unit_b").mapInArrow(confirmed, "a long, b long")


def _angles(column: str):
    """Adds the angle between unit and pivot to the columns (component, cid, unit, pivot), in this order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle = [np.arccos(np.clip(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8"), -1, 1)) for x, y in zip(b.column("unit").to_pylist(), b.column("pivot").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle, pa.float64())], names=[*b.schema.names, column])

    return rows


def _meeting(threshold: float):
    """Pairs (a, b), a < b, of the balls of two tiles that are near enough for a link between them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for one, other in zip(_lists(t.column("one")), _lists(t.column("other"))):
                x, y = one.field("component").to_numpy(), other.field("component").to_numpy()
                angle = np.arccos(np.clip(_matrix(one.field("pivot")) @ _matrix(other.field("pivot")).T, -1, 1))
                reach = one.field("radius").to_numpy()[:, None] + other.field("radius").to_numpy() + np.arccos(threshold) + 1e-6
                i, j = np.nonzero((angle <= reach) & (x[:, None] != y))
                yield batch({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j])}, arrow("a long, b long"))

    return rows


def _bridge(threshold: float):
    """One link (a, b) of the members of two tiles, if there is any: each lies in one component."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for one, other in zip(_lists(t.column("one")), _lists(t.column("other"))):
                s = _matrix(one.field("unit")) @ _matrix(other.field("unit")).T
                i, j = np.unravel_index(s.argmax(), s.shape)
                if s[i, j] >= threshold:
                    yield batch({"a": [one.field("cid")[int(i)].as_py()], "b": [other.field("cid")[int(j)].as_py()]}, arrow("a long, b long"))

    return rows


def in_components(classes: DataFrame, found: DataFrame) -> DataFrame:
    """component, cid, copies, unit, pivot (that of the class that names the component) of each class in a component, stored."""
    own = materialize(classes.select("cid", "copies", "unit").join(found.select(F.col("id").alias("cid"), "component"), "cid"), "placed")
    sizes = own.groupBy("component").agg(F.count("*").alias("size"))
    pivots = materialize(sizes.join(classes.select(F.col("cid").alias("component"), F.col("unit").alias("pivot")), "component"), "pivots")
    return materialize(join_hot(own, pivots, "component", "size").select("component", "cid", "copies", "unit", "pivot"), "placed")


def bridges(lists: DataFrame, placed: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links (a, b) between components that full lists can hide: both ends have k nearer links of their own.

    A link to a class whose list still ends below the threshold is in that list. So only classes of saturated lists are
    compared, and of these only the components whose balls about their pivots come within the threshold's angle."""
    full = lists.where((F.size("near") >= k) & (F.element_at("near", -1)["d"] <= SLACK - threshold)).select(F.col("u").alias("cid"))
    members = placed.select("component", "cid", "unit", "pivot").join(full, "cid")
    members = members.select("component", "cid", "unit", "pivot").mapInArrow(_angles("angle"), "component long, cid long, unit binary, pivot binary, angle double")
    members = materialize(members, "saturated")
    balls = members.groupBy("component").agg(F.first("pivot").alias("pivot"), F.max("angle").alias("radius"), F.count("*").alias("size")).withColumn("dims", F.length("pivot"))
    balls = materialize(balls, "balls")
    count = balls.groupBy("dims").agg(F.ceil(F.count("*") / (2 * TILE)).alias("n"))
    dealt = balls.join(count, "dims").groupBy("dims", "n", F.pmod(F.xxhash64("component"), "n").alias("i")).agg(F.collect_list(F.struct("component", "pivot", "radius")).alias("one"))
    later = dealt.select("dims", F.col("i").alias("j"), F.col("one").alias("other"))
    near = dealt.withColumn("j", F.explode(F.sequence("i", F.col("n") - 1))).join(later, ["dims", "j"])
    near = materialize(near.select("one", "other").mapInArrow(_meeting(threshold), "a long, b long").distinct(), "meeting")
    tiled = join_hot(members.drop("pivot", "angle"), balls.select("component", "size"), "component", "size").withColumn("n", F.ceil(F.col("size") / TILE))
    tiles = tiled.groupBy("component", F.pmod(F.xxhash64("cid"), "n").alias("tile")).agg(F.collect_list(F.struct("cid", "unit")).alias("members"))
    one, other = (tiles.select(F.col("component").alias(c), F.col("members").alias(name)) for c, name in (("a", "one"), ("b", "other")))
    return near.join(one, "a").join(other, "b").select("one", "other").mapInArrow(_bridge(threshold), "a long, b long")


def _radius(threshold: float):
    """Whether a member lies surely within half the threshold's angle of its component's pivot."""
    within = np.arccos(threshold) / 2 - 1e-6

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle = [np.arccos(np.clip(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8"), -1, 1)) for x, y in zip(b.column("unit").to_pylist(), b.column("pivot").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("component", "cid", "copies", "unit")] + [pa.array(np.array(angle, np.float64) <= within, pa.bool_())], names=["component", "cid", "copies", "unit", "core"])

    return rows


def _tile_links(threshold: float):
    """Links of the outer members of a tile with all members of another, in rows (cid, links) that Spark adds up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for outer, others in zip(_lists(b.column("outer")), _lists(b.column("members"))):
                x, y = _matrix(outer.field("unit")), _matrix(others.field("unit"))
                ids_x, ids_y = outer.field("cid").to_numpy(), others.field("cid").to_numpy()
                linked = (x @ y.T >= threshold) & (ids_x[:, None] != ids_y[None, :])
                core = others.field("core").to_numpy(zero_copy_only=False)
                yield batch({"cid": np.r_[ids_x, ids_y[core]], "links": np.r_[linked @ others.field("copies").to_numpy(), outer.field("copies").to_numpy() @ linked[:, core]]}, arrow("cid long, links long"))

    return rows


def enlarge(placed: DataFrame, threshold: float) -> DataFrame:
    """component, cid, links: of each class in a component the vectors of other classes that it links with."""
    members = materialize(placed.select("component", "cid", "copies", "unit", "pivot").mapInArrow(_radius(threshold), "component long, cid long, copies long, unit binary, core boolean"), "members")
    sizes = members.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies"), F.count("*").alias("size"), F.count_if(~F.col("core")).alias("n_outer"))
    sizes = materialize(sizes, "sizes")
    tiled = join_hot(members, sizes.select("component", "size", F.col("n_outer")), "component", "size").where("n_outer > 0")
    tiles, outer_tiles = F.ceil(F.col("size") / TILE), F.ceil(F.col("n_outer") / TILE)
    row = F.struct("cid", "copies", "unit", "core")
    a = tiled.where("not core").groupBy("component", F.pmod(F.xxhash64("cid"), outer_tiles).alias("i"), tiles.alias("n")).agg(F.collect_list(F.struct("cid", "copies", "unit")).alias("outer"))
    b = tiled.groupBy("component", F.pmod(F.xxhash64("cid"), tiles).alias("j")).agg(F.collect_list(row).alias("members"))
    pairs = a.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).join(b, ["component", "j"])
    outer = pairs.select("outer", "members").mapInArrow(_tile_links(threshold), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("outer_links"))
    own = join_hot(members.drop("unit"), sizes.select("component", "core_copies", "size"), "component", "size").join(outer, "cid", "left")
    inner = F.when(F.col("core"), F.col("core_copies") - F.col("copies")).otherwise(0)
    return own.select("component", "cid", (inner + F.coalesce("outer_links", F.lit(0))).cast("long").alias("links"))


def _strata(classes: DataFrame, links: DataFrame, lists: DataFrame | None, threshold: float, k: int) -> DataFrame:
    """cid, copies, unit, links and the stratum of each class: many links, few, a known neighbour just below the threshold, or none of these."""
    own = classes.select("cid", "copies", "unit").join(links, "cid", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    best = F.lit(None).cast("double")
    if lists is not None:
        own, best = own.join(lists.select(F.col("u").alias("cid"), (-F.col("near")[0]["d"]).alias("best")), "cid", "left"), F.col("best")
    stratum = F.when(F.col("links") > k, 0).when(F.col("links") > 0, 1).when(best >= threshold - 0.1, 2).otherwise(3)
    return own.select("cid", "copies", "unit", "links", stratum.alias("stratum"))


def recall(classes: DataFrame, links: DataFrame, threshold: float, k: int = 8, sample: int = AUDITED, lists: DataFrame | None = None) -> float | None:
    """Share of the classes that link with others and whose links are all counted, estimated by comparing a sample with all
    classes: the lesser of the shares among those that link with at most k other classes and among the rest, so that dense
    groups don't hide what small ones lack. None if no sampled class links.

    A quarter of the sample comes from each stratum of `_strata` (those of the smallest hashes of their ids), and a
    sampled class counts for as many as its stratum has for one in the sample."""
    own = materialize(_strata(classes, links, lists, threshold, k), "strata")
    sizes = {r["stratum"]: r["count"] for r in own.groupBy("stratum").count().collect()}  # four rows
    picked = [own.where(F.col("stratum") == h).orderBy(F.xxhash64("cid"), "cid").limit(max(1, sample // 4)).select("cid", "unit", "stratum").toPandas() for h in sorted(sizes)]  # `sample` vectors
    ids, units = np.concatenate([np.zeros(0, np.int64), *[p["cid"].to_numpy(np.int64) for p in picked]]), [bytes(u) for p in picked for u in p["unit"]]
    weight = {int(p["stratum"].iloc[0]): sizes[p["stratum"].iloc[0]] / len(p) for p in picked}
    asked = classes.sparkSession.sparkContext.broadcast((ids, units))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = asked.value
        lengths = np.array([len(u) for u in units])
        matrices = {d: (np.flatnonzero(lengths == d), np.frombuffer(b"".join(u for u in units if len(u) == d), "<f8").reshape(int((lengths == d).sum()), -1)) for d in np.unique(lengths)}
        total, others = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for b in batches:
            own, copies = b.column("unit").to_pylist(), b.column("copies").to_numpy()
            dims = np.array([len(u) for u in own])
            for d in np.unique(dims):
                if d in matrices:
                    at = np.flatnonzero(dims == d)
                    x = np.frombuffer(b"".join(own[k] for k in at), "<f8").reshape(len(at), -1)
                    linked = matrices[d][1] @ x.T >= threshold
                    total[matrices[d][0]] += linked @ copies[at]
                    others[matrices[d][0]] += linked.sum(1)
        yield batch({"cid": ids, "links": total, "others": others}, arrow("cid long, links long, others long"))

    true = classes.select("unit", "copies").mapInArrow(count, "cid long, links long, others long").groupBy("cid").agg(F.sum("links").alias("true"), (F.sum("others") - 1).alias("others"))
    both = true.join(own.select("cid", "copies", "links", "stratum"), "cid").where("others > 0").select("stratum", (F.col("others") <= k).alias("small"), (F.col("links") + F.col("copies") >= F.col("true")).alias("complete"))
    linked, complete = {}, {}
    for r in both.collect():  # one row a sampled class
        linked[r["small"]] = linked.get(r["small"], 0) + weight[r["stratum"]]
        complete[r["small"]] = complete.get(r["small"], 0) + weight[r["stratum"]] * r["complete"]
    return min((complete[small] / linked[small] for small in linked), default=None)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = 16, tables: int = 4, rounds: int = 12, target: float = 0.995, attempts: int = 3) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links counts the other rows whose cosine reaches the threshold (in double precision), component_id is the smallest
    vec_id reachable by links, kept says whether that is the row's own. Vectors that are null, empty or zero, or hold
    null, NaN or infinite components, link with nothing, nor do vectors of different lengths. Rows of a null vec_id link
    but never name a component, and aren't kept; repeated rows link with each other; no rows give no rows. Other columns
    are ignored. Refinement ends when a round changes few lists, after `rounds` at most; where the audit is below `target`,
    `k` and `tables` double and refinement goes on, and after `attempts` all classes are compared exactly."""
    spark = vectors.sparkSession
    rows = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_units, "vec_id long, unit binary"), "units")
    classes = rows.where("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, known, lists, lengths = classes.count(), None, None, k
    for attempt in range(1, attempts + 2):
        exact = attempt > attempts
        lists, met = graph(classes, n, k, 1, 0, attempt, threshold, bits=0) if exact else graph(classes, n, k, tables, rounds, attempt, threshold, lists)
        edges = threshold_edges(met, classes, threshold)
        edges = known = materialize(edges if known is None else edges.union(known).distinct(), "edges")
        placed = in_components(classes, components(edges, "near"))
        if not exact:
            hidden = materialize(bridges(lists, placed, k, threshold), "bridges")
            if not hidden.isEmpty():
                known = edges.union(hidden)
                placed = in_components(classes, components(known, "near"))
        linked = materialize(enlarge(placed, threshold), "links")
        if exact:
            _LOG.warning("recall was short of %.4f: all classes were compared", target)
            break
        got = recall(classes, linked.select("cid", "links"), threshold, lengths, lists=lists)
        _LOG.info("recall %s with lists of %d and %d tables", "unmeasured, no sampled class links" if got is None else f"{got:.4f}", k, tables)
        if got is None or got >= target:
            break
        k, tables = 2 * k, 2 * tables
    named = classes.select("unit", "least", "copies", "cid").join(linked, "cid", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "cid")), "named")  # a class without links is its own
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "least")
    named = join_hot(named, least, "component", "size").select("unit", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = join_hot(rows.where("unit is not null"), materialize(named, "named"), "unit", "copies").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.union(rows.where("unit is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
