"""Op 3. Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a uniform number u from an MD5 digest and the score -weight/ln(u); the highest score wins.
A shard's score never depends on the other shards, so adding one moves rows only into it, and in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findling.llm.common import free_name

#: Slots are counted separately in 2**RANGE_BITS ranges of the key hash, for each shard.
RANGE_BITS = 12
_HEX = 13  # hex digits of a digest that a double holds exactly


def key_hash(key: Column) -> Column:
    """52-bit hash of a key's text form; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), 1, _HEX), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard (0-based) of a key. Equal scores, which need equal digests, go to the lowest shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scored = []
    for shard, weight in enumerate(weights):
        digest = F.md5(F.encode(F.concat(text, F.lit(f"#{shard}")), "UTF-8"))
        u = (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**_HEX))
        scored.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.greatest(*scored)["shard"] if len(scored) > 1 else F.lit(0)).cast("int")


def assign_shards(docs: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Adds shard, and grown_shard under the weights `grown`, to every row; columns of these names are replaced. No shuffle."""
    out = docs.withColumn("shard", rendezvous(F.col(key), weights))
    return out.withColumn("grown_shard", rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int"))


def numbered(rows: DataFrame, key: str, ties: Sequence[str] = ()) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard, in the order of the key's hash, then key, then `ties`.

    Rows are numbered inside hash ranges; the ranges' sizes (at most 2**RANGE_BITS rows a shard, whatever the input) give the offsets.
    """
    held: list[str] = []
    for name in ("_hash", "_range", "_row", "_before"):
        held.append(free_name(name, [*rows.columns, *held]))
    hashed, part, row, start = held
    ranged = rows.withColumn(hashed, key_hash(F.col(key))).withColumn(part, F.shiftright(hashed, 4 * _HEX - RANGE_BITS).cast("int"))
    sizes = ranged.groupBy("shard", part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("shard", part, F.coalesce(before, F.lit(0)).alias(start))
    within = F.row_number().over(W.partitionBy("shard", part).orderBy(hashed, key, *ties))
    return ranged.withColumn(row, within).join(F.broadcast(offsets), ["shard", part]).withColumn("slot", F.col(start) + F.col(row) - 1).drop(*held)


def shard_table(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    A null text has size 1 and checksum 0; long texts count whole; a null doc_id is the empty key; equal rows get different
    slots; an empty table gives an empty one; other columns are ignored.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign_shards(slim, "doc_id", [1.0] * shards, [1.0] * (shards + 1))
    out = numbered(placed, "doc_id", ("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str, weights: Sequence[float]) -> None:
    """Writes whole rows into one folder for each shard, named by the column `shard`, with underscores if docs has one."""
    name = free_name("shard", docs.columns)
    docs.withColumn(name, rendezvous(F.col(key), weights)).write.partitionBy(name).mode("overwrite").parquet(path)


def _sql_shard(shards: int) -> str:
    terms = ", ".join(f"{{'s': -1.0 / ln((('0x' || substr(md5(k || '#{s}'), 1, {_HEX}))::BIGINT::DOUBLE + 0.5) / {float(16**_HEX)!r}), 'n': {-s}}}" for s in range(shards))
    return f"-(list_max([{terms}]).n)"

