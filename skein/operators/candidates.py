"""Choosing the messages that a judge is asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.splits import shuffled


def remainder(messages: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """messages whose surrogate key is not among the chosen: equal texts under other keys stay."""
    return messages.join(chosen.select(key), key, "left_anti")


def cap_candidates(messages: DataFrame, hit: Column, key: str, most: int, seed: str = "42") -> DataFrame:
    """At most 3 * most messages with a 0-based column ord: hits first, by key; if they are fewer than most, up to 2 * most
    others in shuffled order follow. Each part is a top-k, so no task holds more than 3 * most rows."""
    marked = messages.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    hits = marked.where("_hit").orderBy(key).limit(3 * most).withColumn("_rank", F.row_number().over(W.orderBy(key)))
    others = marked.where("NOT _hit").withColumn("_h", shuffled(F.col(key), seed)).orderBy("_h", key).limit(2 * most)
    others = others.withColumn("_rank", F.row_number().over(W.orderBy("_h", key))).drop("_h")
    few = hits.agg((F.count("*") < most).alias("_few"))
    both = hits.unionByName(others.join(F.broadcast(few), F.col("_few")).drop("_few"))
    ranked = both.withColumn("ord", F.row_number().over(W.orderBy(F.desc("_hit"), "_rank")) - 1)
    return ranked.where(F.col("ord") < 3 * most).drop("_hit", "_rank")
