"""A global order as data: gapless ordinals without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.shared import stable, unused, written

#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def with_ordinals(df: DataFrame, *keys: str, name: str = "ord", first: int = 0, parts: int | None = None) -> DataFrame:
    """df with its place in the order of the keys, a long column from `first` on without gaps.

    keys: columns, `-` before those that fall (nulls last both ways). The rows are dealt to `parts` ranges of the keys by
    sampled splitters (one shuffle) and sorted inside; a range counts on from the ranges before it, by a table of a row for
    each range. The place in the input is the last key: equal keys keep the input's order, and rows of one key alone are
    still dealt to all ranges. Splitters may differ from run to run, so the dealt rows are written before they are counted.
    An empty table gives an empty result.
    """
    tie, at = unused(df, "_tie", "_at")
    rows = stable(df, "ordered").withColumn(tie, F.monotonically_increasing_id())
    sort = [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys]
    ranges = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *sort, tie).sortWithinPartitions(*sort, tie)
    placed = written(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright(at, PLACE_BITS).alias("_part"), F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_range"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range: broadcast
    joined = placed.join(F.broadcast(before), F.shiftright(at, PLACE_BITS) == F.col("_range"))
    return joined.select(*[placed[f"`{c}`"] for c in df.columns], (F.col("_before") + place + first).alias(name))
