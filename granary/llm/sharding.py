"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a hash u in (0, 1) and the score -ln(u) / weight; the shard with the least score takes the
record. A new shard can only win records for itself, so a change of the shard count moves the least possible share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit, written


def rendezvous(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard of a key: an index into weights (all above 0). A null key hashes as the empty string."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a weight above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((-F.log(unit(seed, name, F.lit(str(i)))) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*scores))["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: float = 1.0, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512, range_rows: int = 10_000) -> DataFrame:
    """One row per row of docs: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The law is `key`: doc_id and the weights decide, nothing else, so equal keys (and repeated rows) share a shard.
    grown_shard is the shard once another of weight grown has joined. size is the text's UTF-8 bytes plus 1 (a null text has none, and the
    empty text's CRC). slot counts a shard's rows without gaps from 0, in the order of a hash bucket, then of id, size
    and CRC; rows equal in all of these are counted first and take consecutive slots. A group of more than range_rows is
    dealt to tasks in ranges of slots, so that none has to be written out by one task. Whole texts count, however long. An empty table
    gives an empty result; other columns aren't read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    seen = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown]).alias("grown_shard"),
    )
    equal = seen.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("n"))
    equal = equal.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * buckets rows, whatever the input's size.
    offsets = equal.groupBy("shard", "bucket").agg(F.sum("n").alias("total")).select("shard", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = equal.withColumn("end", F.sum("n").over(within)).join(F.broadcast(offsets), ["shard", "bucket"])
    first = F.col("offset") + F.col("end") - F.col("n")
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", first.alias("first"), (first + F.col("n") - 1).alias("last")), "placed")
    large = F.col("last") - F.col("first") >= range_rows
    ranges = placed.filter(large).withColumn("first", F.explode(F.sequence("first", "last", F.lit(range_rows).cast("long"))))
    ranges = ranges.withColumn("last", F.least("last", F.col("first") + range_rows - 1)).repartition("shard", "first")
    dealt = placed.filter(~large).unionByName(ranges)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("first", "last")).alias("slot"), "grown_shard")
