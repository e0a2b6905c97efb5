"""Operator 9: mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is its target share over its actual share. Each row draws its count from the Poisson
distribution of that mean, inverted at a uniform number hashed from the seed, the row's doc_id and its text, is exploded by
its count, and all copies are dealt to partitions by a hash and sorted by it there. A large mean is the sum of several
draws, each a row of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A mean above this is the sum of several draws of at most this mean each.
_STEP = 16.0
#: Counts at which the inverse stops: beyond them a draw of mean _STEP has less than 1e-15 of its weight. Also what the
#: copies of one draw are numbered by.
_MOST = 80
#: Draws of a row that are exploded in the task that reads it; rows with more are dealt anew by blocks of so many.
_BLOCK = 1024
#: Sources up to this number are broadcast (81 doubles each, under 1 MB); of more, those that have more than one in so many
#: of all rows are.
BROADCAST_SOURCES = 1000


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1), from the first 13 hexadecimal digits of an MD5; null parts count as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def thresholds(mean: Column) -> Column:
    """The cumulative probabilities of counts 0, 1, ... of a Poisson distribution of this mean."""
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_MOST)), first, add, lambda acc: acc["c"])


def rates(docs: DataFrame, weights: dict[str, float], rest: float, size: float) -> tuple[DataFrame, int, int]:
    """A table of sources, each with its rows and mean repetitions (target share times `size` times all rows, over its
    rows); how many rows and how many sources there are.

    Sources without a weight share `rest` equally; a null source is a source. Weights are normalised over the sources
    that exist, so absent ones leave no gap; if all are zero, nothing is repeated."""
    if rest < 0 or size < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights, rest and size must not be negative")
    counts = materialize(docs.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_rows")), "sources")
    given = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, float(w))]) if weights else None
    table = counts.withColumn("_w", given[F.col("_source")] if weights else F.lit(None).cast("double"))
    rows, sources, free, sure = table.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.count("*"), F.count_if(F.col("_w").isNull()), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    whole = sure + (float(rest) if free else 0.0)
    share = F.coalesce("_w", F.lit(float(rest) / free)) if free else F.col("_w")
    mean = share / F.lit(whole) * F.lit(float(size)) * F.lit(rows) / F.col("_rows") if whole else F.lit(0.0)
    return table.select("_source", "_rows", mean.alias("_mean")), rows, sources


def mix(docs: DataFrame, weights: dict[str, float], rest: float, size: float = 1.0, seed: int = 9) -> DataFrame:
    """All columns of docs, and copy, shuffle_key: each row as often as it is drawn, dealt and sorted by shuffle_key.

    Rows of equal doc_id and text are one document and draw alike, whatever else differs; a null doc_id, and a null text,
    counts as an empty one, so texts without doc_id draw by their texts. Copies are numbered from 1, those of a row's
    second draw from 81, and so on: a row has one draw for each 16 of its source's mean repetitions. shuffle_key is the MD5
    of seed, doc_id, text and copy. A weight of zero drops its source, as the target asks; no documents give no rows; a
    text of any length is carried, not looked into. A source with few rows and a large weight repeats them as often as it
    takes: the draws of one row are then dealt to many tasks. Columns of docs named copy or shuffle_key give way to these;
    all others are returned as they are, whatever their names."""
    table, rows, sources = rates(docs, weights, rest, size)
    table = table.withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("_mean") / _STEP)).cast("long"))
    most = table.agg(F.max("_draws")).first()[0]
    table = table.withColumn("_cdf", thresholds(F.col("_mean") / F.col("_draws"))).select("_source", "_rows", "_draws", "_cdf")
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"))
    met = lambda rates_: F.col("_doc.source").eqNullSafe(rates_["_source"])
    if sources <= BROADCAST_SOURCES:
        joined = whole.join(F.broadcast(table), met(table))
    else:  # rows of a large source stay where they are, only those of small ones are dealt by source
        large, small = table.where(F.col("_rows") * BROADCAST_SOURCES > rows), table.where(F.col("_rows") * BROADCAST_SOURCES <= rows)
        joined = whole.join(F.broadcast(large), met(large)).union(whole.join(F.broadcast(large), met(large), "left_anti").join(small, met(small)))
    text = F.md5(F.coalesce(F.col("_doc.text"), F.lit("")).cast("binary")) if "text" in columns else F.lit("")
    joined = joined.withColumn("_text", text)
    numbers = lambda first, last: F.explode(F.sequence(first, last))
    one = F.lit(1).cast("long")
    draws = joined.where(F.col("_draws") <= _BLOCK).withColumn("_k", numbers(one, F.col("_draws")))
    if most and most > _BLOCK:
        first = F.col("_b") * _BLOCK + 1
        many = joined.where(F.col("_draws") > _BLOCK).withColumn("_b", numbers(F.lit(0).cast("long"), F.floor((F.col("_draws") - 1) / _BLOCK)))
        many = many.repartition(F.xxhash64("_text", "_doc.doc_id", "_b"))
        draws = draws.union(many.withColumn("_k", numbers(first, F.least("_draws", first + (_BLOCK - 1)))).drop("_b"))
    # a uniform number is hashed once per draw: it is bound before the filter that compares it
    count = F.aggregate(F.array(uniform(seed, F.col("_doc.doc_id"), F.col("_text"), F.col("_k"))), F.lit(0), lambda acc, u: acc + F.size(F.filter("_cdf", lambda c: c <= u)))
    drawn = draws.withColumn("_n", count).where("_n > 0").select("_doc", "_text", "_k", "_n")
    copies = drawn.withColumn("_i", numbers(one, F.col("_n").cast("long"))).select("_doc", "_text", ((F.col("_k") - 1) * _MOST + F.col("_i")).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col("_doc.doc_id").cast("string"), F.lit("")), "_text", F.col("copy").cast("string")))
    out = copies.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns], "copy", order.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
