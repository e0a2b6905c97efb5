"""From raw documents to packed training sequences: quality, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and gives a DataFrame that is written
as Parquet and read again for the next; all but the last give the columns of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import mixing, packing, quality, simhash
from tempora.llm.common import materialize, table
from tempora.llm.queries import KEPT_SCORE, MIX_REST, MIX_SEED, MIX_SIZE, MIX_WEIGHTS, PACK_END, PACK_SIZE, tokenizer


def keyed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """doc_id, text and _key of each row; and the key as an expression on docs.

    doc_id and key identify a row for these stages, however often it is read again: what they decide follows from the
    text, and rows of one doc_id and one text are the same document. A null text has a key of its own."""
    key = F.unhex(F.coalesce(F.md5(docs["text"].cast("binary")), F.lit("")))
    return docs.select(docs["doc_id"], docs["text"], key.alias("_key")), key


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its own text, whatever its doc_id."""
    score = quality.scorer(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(docs["text"]) >= KEPT_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays, that of the smallest doc_id (null is the last) and then of the least MD5.

    Of rows with that doc_id and text the least of the other columns stays. Null and empty texts have fingerprint zero and
    are one group; no documents give none."""
    rows, key = keyed(docs)
    found = simhash.near_duplicates(rows, key="_key").groupBy("component", F.col("doc_id").alias("_id"), "_key").agg(F.count("*").alias("_rows"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_key", "_rows")).alias("_first")).select("_first.*")
    ids = materialize(first, "kept")
    # hashed, not sorted: the side of texts passes by the small side
    kept, own = docs.join(ids.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(ids["_id"]) & (key == ids["_key"])), [docs[c] for c in docs.columns]
    single, repeated = kept.where(ids["_rows"] == 1).select(own), kept.where(ids["_rows"] > 1).select(own)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = repeated.groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_rest"))  # the same whenever it is read again
    return single.union(least.select(*[F.col(f"_rest.`{c}`") if c in rest else F.col(f"`{c}`") for c in docs.columns]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight draws it, dealt and sorted by hash.

    A null source is a source; rows of equal doc_id and text draw alike; no documents give none."""
    return mixing.mix(docs, MIX_WEIGHTS, MIX_REST, MIX_SIZE, MIX_SEED).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training: which piece of which document goes where.

    A null or empty text is its end token; copies of a document and rows without doc_id are packed each by itself."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=PACK_END, size=PACK_SIZE)


STAGES = [("quality", drop_low_quality), ("simhash", drop_near_duplicates), ("mix", mix_sources), ("pack", pack_sequences)]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
