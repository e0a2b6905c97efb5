"""Operator 8: collapse of logged conversation snapshots, then chat formatting, in DataFrame functions only.

A chat log holds a conversation once for each turn at which it was saved. Each turn gets a rolling hash of its
conversation up to there, a running sum of position-bound turn hashes; a conversation whose whole hash is a shorter
prefix of another one goes by an anti-join, of equal ones the smallest conv_id stays, and the rest are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize

#: Turns rendered into one row.
PART_TURNS = 512
_MOD = 1 << 40


def _hash(seed: int) -> Column:
    """Of a turn at its position: two of these make a key of 80 bits."""
    return F.pmod(F.xxhash64(F.lit(seed), "pos", "role", "text"), F.lit(_MOD))


def turns(conversations: DataFrame, bucket: int = 1024) -> DataFrame:
    """conv_id, pos (from 1, by turn, role, text), role, text, h1, h2 (hash of the turns up to this one).

    Null turns come first, a null role is `unknown`, a null text empty. A conversation is numbered and summed in
    buckets of turn numbers, and the buckets' totals are added, so that no task needs a whole conversation."""
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("_b", F.floor(F.coalesce("turn", F.lit(-1)) / bucket))
    inner, before = Window.partitionBy("conv_id", "_b").orderBy("turn", "role", "text"), Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "_b").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    t = t.join(sizes, ["conv_id", "_b"]).withColumn("pos", F.row_number().over(inner) + F.col("_base"))
    t = t.withColumn("_h1", _hash(1)).withColumn("_h2", _hash(2))
    sums = t.groupBy("conv_id", "_b").agg(F.sum("_h1").alias("_s1"), F.sum("_h2").alias("_s2"))
    for k in ("1", "2"):
        sums = sums.withColumn(f"_a{k}", F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)))
    upto = Window.partitionBy("conv_id", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(sums.drop("_s1", "_s2"), ["conv_id", "_b"])
    return t.select("conv_id", "pos", "role", "text", *[(F.sum(f"_h{k}").over(upto) + F.col(f"_a{k}")).alias(f"h{k}") for k in ("1", "2")])


def collapse(all_turns: DataFrame) -> DataFrame:
    """The conv_ids to keep, with n_turns: maximal conversations, once each. all_turns is a stored table."""
    whole = all_turns.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("w")).select("conv_id", "w.*")
    single = whole.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    ends = materialize(whole.select("conv_id", F.col("pos").alias("last")), "ends")
    inner = join_hot(all_turns.select("conv_id", "pos", "h1", "h2"), ends, "conv_id", "last").where("pos < last").select("pos", "h1", "h2").distinct()
    return single.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def render(conversations: DataFrame, start: str = "<|{role}|>\n", end: str = "<|end|>\n", part_turns: int = PART_TURNS) -> DataFrame:
    """Rendered maximal conversations: conv_id, part (from 0), n_turns, text; parts of one conversation join in order.

    A part has part_turns turns, so that no row holds an unbounded conversation; shorter conversations are part 0 alone.
    Rows of null conv_id belong to no conversation and are left out; repeated turns are turns; no turns give no rows."""
    t = materialize(turns(conversations), "turns")
    kept = join_hot(t.select("conv_id", "pos", "role", "text"), materialize(collapse(t), "kept"), "conv_id", "n_turns")
    opening, closing = start.split("{role}")
    line = F.concat(F.lit(opening), F.col("role"), F.lit(closing), F.col("text"), F.lit("\n" + end))
    parts = kept.groupBy("conv_id", "n_turns", F.floor((F.col("pos") - 1) / part_turns).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("text"))
