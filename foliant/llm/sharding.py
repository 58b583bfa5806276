"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record's key is its id as text. Each shard gives each key a score, ln(u) / weight with u drawn by hashing key and shard
to (0, 1), and the greatest score wins. So a shard's part of the keys goes with its weight, a row's shard
follows from its key and the weights alone, and a shard that is added, or grows, only takes rows into itself.

The shard is an expression of one row: no shuffle, nothing to keep. Only gapless slots need an order over each
shard's rows: slim rows without texts are sorted by ranges of (shard, hashed key, ...) once, each row is counted in
its range, and the ranges' counts, one row for each range and shard, give the offsets. A shard, or a key that
holds a third of all rows, is cut into as many ranges as it fills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import free_name, stored

SHARDS = 40
SEED = 29
#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: monotonically_increasing_id() has the partition above these bits, and the row's place in it below.
PLACE_BITS = 33


def key_hash(key: Column, seed: int = SEED) -> Column:
    """Hash of a record key of any simple type by its text, so 7 and '7' are one key; null is a key of its own."""
    return F.xxhash64(F.lit(seed), key.cast("string"), key.isNull())


def score(hashed: Column, shard: int, weight: float) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(hashed, F.lit(shard)), 12).cast("double") + 0.5) / float(1 << 52)
    return F.log(unit) / F.lit(float(weight))


def with_shard(df: DataFrame, weights: Sequence[float], hashed: str, name: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """df with the shard of each row from its column of hashed keys; grown: a column for the shard with one shard more.

    Shards of weight 0 get no row. A tie, which 52 bits make all but impossible, goes to the smaller shard.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights) or grown_weight <= 0:
        raise ValueError("weights: none below 0, one above")
    live = [(k, w) for k, w in enumerate(weights) if w > 0]
    numbers = F.array(*(F.lit(k) for k, _ in live))
    # projections of their own: the scores are worked out once for each row
    scores, best = free_name(df.columns, "scores"), free_name(df.columns, "best")
    out = df.withColumn(scores, F.array(*(score(F.col(hashed), k, w) for k, w in live))).withColumn(best, F.array_max(scores))
    out = out.withColumn(name, F.get(numbers, F.array_position(scores, F.col(best)).cast("int") - 1))
    if grown:
        more = score(F.col(hashed), len(weights), grown_weight)
        out = out.withColumn(grown, F.when(more > F.col(best), F.lit(len(weights))).otherwise(F.col(name)))
    return out.drop(scores, best)


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """One row for each row of docs: the key column, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16; a null text has none, and the checksum of none. slot numbers a shard's rows from 0
    without gaps, in the order of hashed key, checksum and size; rows alike in all of these are numbered in any order, so
    reruns differ at most in which of them is which. All rows of one key, null too, are in one shard. grown_shard is the shard
    with one more of weight 1. An empty table gives none. Only the two named columns are read.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    slim = docs.select(
        F.col(f"`{key}`").alias("record"), (F.octet_length(whole).cast("long") + OVERHEAD).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"), key_hash(F.col(f"`{key}`"), seed).alias("hashed"), F.monotonically_increasing_id().alias("at"),
    )
    slim = stored(with_shard(slim, weights, "hashed", "shard", "grown_shard"), "sharded")
    order = ["shard", "hashed", "text_crc32", "size", "at"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # placed once and written: what a later read of a part sees does not depend on how Spark deals it
    placed = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("part", F.shiftright("place", PLACE_BITS).cast("int")), "placed")
    runs = placed.groupBy("part", "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # ranges hold whole stretches of the order, so there are at most parts + len(weights) runs: safe to broadcast
    runs = runs.select("part", "shard", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(runs), ["part", "shard"]).select(
        F.col("record").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard"
    )


def moves(docs: DataFrame, before: Sequence[float], after: Sequence[float], key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The rows of docs whose shard changes with the weights, with all their columns, and shard_before, shard_after. No shuffle."""
    names = list(docs.columns)
    hashed, old, new = (free_name(names, n) for n in ("hashed_key", "shard_before", "shard_after"))
    both = with_shard(with_shard(docs.withColumn(hashed, key_hash(F.col(f"`{key}`"), seed)), before, hashed, old), after, hashed, new)
    return both.filter(F.col(old) != F.col(new)).drop(hashed)


def loads(assigned: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """For each shard, empty ones too: weight, n_rows, n_bytes and both as parts of all (null if there are none)."""
    shards = assigned.sparkSession.createDataFrame(list(enumerate(map(float, weights))), "shard int, weight double")
    found = assigned.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
    out = shards.join(found, "shard", "left").fillna(0, ["n_rows", "n_bytes"])
    total = out.agg(*(F.nullif(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in ("n_rows", "n_bytes")))  # one row
    share = [(F.col(c) / F.col(f"all_{c}")).alias(f"{c[2:]}_part") for c in ("n_rows", "n_bytes")]
    return out.join(F.broadcast(total)).select("shard", "weight", "n_rows", "n_bytes", *share)


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", files: int = 1, seed: int = SEED) -> None:
    """Writes docs as Parquet, a folder shard=n for each shard, each in `files` files that rows are dealt to by their place of reading.

    So no task writes more than a files-th of a shard, whatever key is hot. The column is called shard, or _shard and so on
    where docs has one of that name.
    """
    names = list(docs.columns)
    hashed, shard, deal = (free_name(names, n) for n in ("hashed_key", "shard", "deal"))
    out = with_shard(docs.withColumn(hashed, key_hash(F.col(f"`{key}`"), seed)), weights, hashed, shard)
    out = out.withColumn(deal, F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    out.repartition(len(weights) * files, shard, deal).drop(hashed, deal).write.partitionBy(shard).parquet(path)
