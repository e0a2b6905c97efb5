"""Keyed tables on plain files: last write wins, merge of columns, one metric's change, difference and union by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; order ascends. Aggregated before the shuffle, so a hot key stays small."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*[k if k in keys else f"_row.{k}" for k in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables' rows, the highest version of each key; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col(version), F.col("_new")]).drop("_new")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new row's values where it has some, the old ones elsewhere; columns of either side are kept."""
    rest = [c for c in dict.fromkeys(old.columns + new.columns) if c not in keys]
    a, b = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_old")), new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_new"))
    pick = [F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("_new", new), ("_old", old)) if c in df.columns]).alias(c) for c in rest]
    return a.join(b, keys, "full_outer").select(*keys, *pick)


def change_metric(rows: DataFrame, keys: list[str], order: list[str], metric: str, value: Column) -> DataFrame:
    """Each key's newest row with one metric changed: what a partial update stores."""
    return latest(rows, keys, [F.col(o) for o in order]).withColumn(metric, value)


def sanitized(rows: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, nested columns left out."""
    flat = [(c, kind) for c, kind in rows.dtypes if not kind.startswith(("struct", "array", "map"))]
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return rows.select(*[F.when(~bad(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in flat])


def later_source_wins(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by key; rows of later tables replace those of earlier ones."""
    both = tables[0].withColumn("_source", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        both = both.unionByName(t.withColumn("_source", F.lit(i)), allowMissingColumns=True)
    rest = F.struct(*[c for c in both.columns if c not in keys])
    return latest(both, keys, [F.col("_source"), F.xxhash64(rest)]).drop("_source")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def complete(rows: DataFrame, required: list[str], allowed: list[str]) -> DataFrame:
    """Rows with all required fields, cut to the allowed ones; absent optional ones are null."""
    return rows.dropna(subset=required).select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in allowed])


#: What an ingested workout's ledger row has besides its key, athlete_id and workout_id.
LEDGER = ("source_file_name", "source_etag", "source_ctag", "file_sha256", "ingest_version")


def ledger_backfill(workouts: DataFrame, ledger: DataFrame, version: str, now: Column) -> DataFrame:
    """The ledger rows of workouts that were ingested before there was a ledger: what a row has stays, what it lacks comes
    from its workout.

    A workout's key is its ingestion_id, else source_item_id, else file_sha256; without key, athlete or workout_id it has no
    row. Of several workouts of a key the newest ingested counts, of equals the greater workout_id."""
    key = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("ingestion_id", "source_item_id", "file_sha256")])
    own = workouts.withColumn("ingestion_key", key).where("ingestion_key is not null and athlete_id is not null and workout_id is not null")
    own = latest(own, ["athlete_id", "ingestion_key"], [F.col("ingested_at_utc"), F.col("workout_id")])
    at = F.coalesce("ingested_at_utc", now)
    made = own.select("athlete_id", "ingestion_key", F.lit("ingested").alias("status"), at.alias("first_seen_at_utc"), at.alias("last_attempt_at_utc"), at.alias("ingested_at_utc"), F.lit(0).alias("retry_count"), "workout_id", *[F.coalesce(c, F.lit(version)).alias(c) if c == "ingest_version" else F.col(c) for c in LEDGER])
    known = ledger.select("athlete_id", "ingestion_key", F.struct(*[c for c in ledger.columns if c not in ("athlete_id", "ingestion_key")]).alias("_old"))
    pick = [F.coalesce(f"_old.{c}", c).alias(c) if c in ledger.columns else F.col(c) for c in made.columns if c not in ("athlete_id", "ingestion_key")]
    return made.join(known, ["athlete_id", "ingestion_key"], "left").select("athlete_id", "ingestion_key", *pick)
