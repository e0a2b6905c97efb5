"""Operator 3: URL allow and block rules by hashed expressions.

Each URL is expanded into host suffixes and path prefixes, of the label counts and path lengths that rules have.
Expressions meet rules in an equi-join on a short hash prefix; then full digests are compared, and the longest rule that
is left decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast (under 10 MB); more go through a shuffled join.
BROADCAST_RULES = 50_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_chars: int = 8) -> DataFrame:
    """Judge each row of pages (page_id, url) by rules (host, path, verdict): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest host + path wins; ties go
    to the longer host, then to block. Without a rule that fits: null and `default`. Rules with a null part are skipped;
    repeated rules are one; repeated pages are judged each; columns of pages other than these are ignored."""
    legal = rules.where("host is not null and path is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    legal = legal.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block is after allow
    n_rules = legal.limit(BROADCAST_RULES + 1).count()
    host, path = split_url(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if not n_rules:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "hosts")
    # which path lengths the rules have for each number of labels: a row for each number, which names bound
    shapes = legal.groupBy((F.length("r_host") - F.length(F.translate("r_host", ".", "")) + 1).alias("_labels")).agg(F.collect_set(F.length("r_path")).alias("_lengths"))
    shapes = shapes.select("_labels", F.array_sort("_lengths").alias("_lengths"))
    suffixes = base.withColumn("_labels", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\."))))).join(F.broadcast(shapes), "_labels")
    spread = suffixes.withColumn("_chars", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))))
    short_host, short_path = F.expr("substring_index(host, '.', -_labels)"), F.expr("substr(path, 1, _chars)")
    spread = spread.withColumn("digest", _digest(short_host, short_path)).withColumn("short", F.substring("digest", 1, prefix_chars))
    known = legal.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, prefix_chars))
    known = known.withColumn("r_rank", F.struct((F.length("r_host") + F.length("r_path")).alias("l"), F.length("r_host").alias("h"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule")))
    page = ["page_id", "host", "path", "row"]
    if n_rules <= BROADCAST_RULES:
        met = spread.join(F.broadcast(known), spread["short"] == known["r_short"]).where("digest = r_digest").select(*page, "r_rank")
    else:  # expressions meet the rules once each; those that rules confirm come back to the pages, hot ones by broadcast
        each = spread.groupBy("short", "digest").agg(F.count("*").alias("_rows"))
        hits = each.join(known, each["short"] == known["r_short"]).where("digest = r_digest").select("digest", "_rows", "r_rank")
        met = join_hot(spread.select(*page, "digest"), materialize(hits, "hits"), "digest", "_rows").select(*page, "r_rank")
    best = met.unionByName(base.withColumn("r_rank", F.lit(None))).groupBy(*page).agg(F.max("r_rank").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
