"""Sharding by jump consistent hashing [native].

Lamping and Veach's jump hash: a 64-bit linear congruential generator seeded by the key yields the successive shard
counts at which the key would move; the last one below the shard count is its shard. No ring or table is kept, and
going from n to n + 1 shards moves a key either to shard n or not at all. The generator's wrapped product is taken in
decimal(38, 0), where it is exact: 2**64 * 2862933555777941757 + 1 < 10**38.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import text_or_empty

#: Fixed values of the generator.
MULTIPLIER = 2862933555777941757
MODULUS = 1 << 64

#: Parts of a shard that are numbered on their own, so that no task orders a whole shard.
PARTS = 256


def jump(key: Column, shards: int) -> Column:
    """Shard of a long key (null counts as 0) among `shards`, as int. One step of the fold for each possible jump."""
    start = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(38,0)")
    start = F.when(start < 0, start + F.lit(str(MODULUS)).cast("decimal(38,0)")).otherwise(start).cast("decimal(38,0)")
    state = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), start.alias("k"))

    def moved(s: Column) -> Column:
        product = (s.k.cast("decimal(20,0)") * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")).cast("decimal(38,0)")
        k = ((product + F.lit(1)) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(38,0)")
        high = F.floor(k / F.lit(str(1 << 33)).cast("decimal(10,0)")).cast("double")
        return F.struct(s.j.alias("b"), F.floor((s.j + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1))).cast("long").alias("j"), k.alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, lambda s, _: F.when(s.j < shards, moved(s)).otherwise(s), lambda s: s.b.cast("int"))


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law (`key`), shard, slot, grown_shard (with one shard more).

    size is the text's UTF-8 bytes plus 16, a null text counts as empty; a null id takes the shard of 0. slot numbers
    each shard's rows from 0 without gaps: rows are dealt to PARTS parts of a shard by a hash of the id, the parts are
    numbered by windows of their own and moved up by the counts of the parts before. Repeated rows each have a slot.
    Other columns of docs are ignored. An empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_t")).select(
        "doc_id", (F.octet_length("_t") + 16).cast("long").alias("size"), F.crc32(F.col("_t").cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns({
        "law": F.lit("key"), "shard": jump(F.col("doc_id"), shards), "grown_shard": jump(F.col("doc_id"), shards + 1),
        "part": F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"),
    })
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most shards * PARTS rows
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).select("shard", "part", "base")
    own = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("own", own).join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("base") + F.col("own")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id") -> None:
    """Writes docs as Parquet under path/shard=N; existing files of other shards stay."""
    shard = jump(F.col(id_col), shards)
    docs.withColumn("shard", shard).repartition(shards, "shard").write.partitionBy("shard").mode("append").parquet(path)
