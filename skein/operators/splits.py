"""Shuffled three-way splits with exact sizes, ranks without a global sort in one task; splits that keep copies together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.ordering import with_ordinals
from skein.shared import unused

TRAIN, VAL = 0.5, 0.25


def shuffled(key: Column, seed: str = "42") -> Column:
    """A text whose order is a shuffle of the keys, reproducible."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)).cast("binary"))


def hash_rank(df: DataFrame, key: str, seed: str = "42", name: str = "rank") -> DataFrame:
    """df with its 0-based rank in the shuffled order, ties by key.

    The first three digits of the hash cut the order into 4,096 slices that are ranked side by side and moved up by the
    counts of the slices before.
    """
    rows = df.withColumn("_h", shuffled(F.col(key), seed)).withColumn("_slice", F.substring("_h", 1, 3))
    counts = rows.groupBy("_slice").agg(F.count("*").alias("_n"))  # at most 4,096 rows
    before = counts.select(F.col("_slice").alias("_s"), (F.sum("_n").over(W.orderBy("_slice")) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_slice").orderBy("_h", key)))
    out = ranked.join(F.broadcast(before), ranked["_slice"] == before["_s"])
    return out.withColumn(name, F.col("_r") - 1 + F.col("_before")).drop("_h", "_slice", "_s", "_n", "_r", "_before")


def split_sizes(n: Column, train: float = TRAIN, val: float = VAL) -> tuple[Column, Column]:
    """Rows of train and of val of n rows: the whole part of the share, at least 1; the rest is holdout."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(train))).cast("long"), F.greatest(F.lit(1), F.floor(n * F.lit(val))).cast("long")


def split_members(df: DataFrame, key: str, seed: str = "42", train: float = TRAIN, val: float = VAL) -> DataFrame:
    """df with a column split: train, val or holdout, by rank in the shuffled order."""
    return split_by_rank(hash_rank(df, key, seed, "_rank"), "_rank", df.agg(F.count("*").alias("_total")), train, val)


def split_by_rank(ranked: DataFrame, rank: str, total: DataFrame, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """ranked with a column split in the place of its 0-based rank; total: one row _total, the number of rows."""
    a, b = split_sizes(F.col("_total"), train, val)
    split = F.when(F.col(rank) < a, "train").when(F.col(rank) < a + b, "val").otherwise("holdout")
    return ranked.join(F.broadcast(total)).withColumn("split", split).drop(rank, "_total")  # total is one row


def planned_classes(classes: list[tuple[int, int]], targets: list[int]) -> list[list[int]]:
    """How many of each class of equal groups each target takes; classes: (size, groups), targets: rows.

    The largest size comes first. A target gets its share of a class by what it still lacks, rounded down, and the groups left
    over (fewer than there are targets) go one by one to the target that lacks most then. So no target is over its size by more
    than one group, what large groups have left open is closed by smaller ones, and where the smallest groups are many enough
    each target ends within one of those of its size (exactly, if they are single rows).
    """
    lack, out = list(targets), []
    for size, n in sorted(classes, reverse=True):
        room = [max(x, 0) for x in lack]
        take = [n * x // sum(room) if sum(room) else 0 for x in room]
        lack = [x - size * k for x, k in zip(lack, take)]
        for _ in range(n - sum(take)):
            k = max(range(len(lack)), key=lambda i: (lack[i], -i))
            take[k], lack[k] = take[k] + 1, lack[k] - size
        out.append(take)
    return out


def split_groups(df: DataFrame, group: Column, seed: str = "42", train: float = TRAIN, val: float = VAL) -> DataFrame:
    """df with a column split in which rows of one group (a text, a digest; null is a group too) are in one split.

    Sizes are split_sizes() of all rows, as near as whole groups come to them (planned_classes). Groups are ordered by size,
    the largest first, and shuffled within a size; their ordinals and a plan of a row for each size and split tell the split. The
    plan is made on the driver of a count for each distinct size: sizes that differ sum up to all rows, so there are fewer of
    them than the root of twice that number. A group that holds much of all rows costs one counted row, but its rows' join.
    """
    key, size, n, split, place = unused(df, "_key", "_size", "_n", "_split", "_place")
    rows = df.withColumn(key, F.coalesce(F.sha2(group.cast("string").cast("binary"), 256), F.lit("")))
    groups = rows.groupBy(key).agg(F.count("*").alias(size)).withColumn("_h", shuffled(F.col(key), seed))
    ordered = with_ordinals(groups, f"-{size}", "_h", key, name=place)
    classes = sorted(((r[0], r[1]) for r in ordered.groupBy(size).count().collect()), reverse=True)
    total = sum(s * k for s, k in classes)
    a, b = max(1, int(total * train)), max(1, int(total * val))
    takes, plan, at = planned_classes(classes, [a, b, total - a - b]), [], 0
    for (s, _), take in zip(classes, takes):
        for name, k in zip(("train", "val", "holdout"), take):
            plan.append((s, at, at + k, name))
            at += k
    planned = df.sparkSession.createDataFrame(plan, "s long, lo long, hi long, name string")
    inside = (F.col(size) == F.col("s")) & (F.col(place) >= F.col("lo")) & (F.col(place) < F.col("hi"))
    named = ordered.join(F.broadcast(planned), inside).select(F.col(key).alias(n), F.col("name").alias("split"))
    return rows.join(named, F.col(key) == F.col(n)).select(*[rows[f"`{c}`"] for c in df.columns], "split")


def union_splits(train: DataFrame, val: DataFrame, holdout: DataFrame) -> DataFrame:
    """All examples in one table, with their split."""
    return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val"))).unionByName(holdout.withColumn("split", F.lit("holdout")))
