"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import running_total, text_or_empty

#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """Weighted rendezvous score ``-weight / ln(u)``, u uniform in (0, 1) from the key and the shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double")
    return -weight / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53)))


def rendezvous(key: str | Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """Shard of a key: the one that scores highest.  A shard more (or a heavier one) can only win keys, so no record
    moves between the shards that were there before.  A null key is a key like any other."""
    if shards < 1 or (weights is not None and (len(weights) != shards or min(weights) <= 0)):
        raise ValueError("there must be at least one shard, and a positive weight for each")
    key = F.col(key) if isinstance(key, str) else key
    heavy = F.array(*[F.lit(float(w)) for w in weights or [1.0] * shards])
    scored = F.transform(
        heavy, lambda w, i: F.struct(_score(key, i, w).alias("score"), (-i).alias("last"))
    )
    return (-F.array_max(scored)["last"]).cast("int")


def assign(
    docs: DataFrame, key: str = "doc_id", shards: int = 40, weights: Sequence[float] | None = None, into: str = "shard"
) -> DataFrame:
    """Every row with its shard, no shuffle.  Rows of equal key, null among them, share a shard; a column of the name ``into`` is
    replaced, others stay; no rows give none."""
    return docs.withColumn(into, rendezvous(key, shards, weights))


def shard_slots(docs: DataFrame, shards: int = 40, grown: int | None = None) -> DataFrame:
    """A narrow plan of a sharded corpus: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 without gaps in each shard.  They are numbered by hash bucket, so neither a shard nor a
    group of copies is ever in one task.  Null text: size 16, crc 0.  Rows with equal doc_id share a shard; equal
    rows take neighbouring slots.  Other columns, whatever their names, are left behind; no rows, no slots."""
    text = text_or_empty("text")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(RECORD_BYTES)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = assign(assign(rows, shards=shards), shards=grown or shards + 1, into="grown_shard")
    rows = rows.withColumn("__one", F.lit(1).cast("long"))
    numbered = running_total(rows, ["shard"], ["doc_id", "text_crc32", "size"], "__one", "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
