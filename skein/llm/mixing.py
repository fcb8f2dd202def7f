"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / quality, with u from a hash of its id: in order of rising keys, documents of higher
quality (mean word length, share of letters, variety of words) tend to come first. A source's target is a share of the words by weight, at most CAP times the source's size
(what is above goes to the other sources by weight). Complete epochs take every document of the source; the rest of
the target is a budget that documents fill in order of their keys.

No source is sorted as a whole: keys fall into BUCKETS slices whose word counts are prefix-summed, and only the one
slice in which a source's budget ends is ordered. The plan is a row per source, small enough for Spark to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import text_or_empty, written

#: Fixed values of the contract: weights in turn, words of the mix as a share of all, most repeats of a source.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2

BUCKETS = 8192


def measures(text: Column) -> Column:
    """A struct of a text's words, distinct words, characters and letters (those of no ASCII count as letters)."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    letters = F.length(F.regexp_replace(text, "[\\x00-@\\[-`{-\\x7F]+", ""))
    return F.struct(F.size(words).cast("long").alias("size"), F.size(F.array_distinct(words)).alias("distinct"), F.length(text).alias("chars"), letters.alias("letters"))


def quality(m: Column) -> Column:
    """Between 0 and 1, of measures(): how near the mean word is to 6 characters (with its blank), how many of the characters are
    letters, and how varied the words are for so many (the ratio of logarithms, which length hardly changes). 1 for no words."""
    near = 1.0 / (1.0 + F.abs(m["chars"] / m["size"] - 6.0) / 2.0)
    plain = 0.1 + 0.9 * (m["letters"] / m["chars"])
    varied = F.log(1.0 + m["distinct"]) / F.log(1.0 + m["size"])
    return F.when(m["size"] > 0, near * plain * varied).otherwise(F.lit(1.0))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, source, size, key of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), measures(text_or_empty(text_col)).alias("_m"))
    return rows.select("doc_id", "source", "_m.size", _key(F.col("doc_id"), F.col("_m"), seed).alias("key"))


def _key(doc_id: Column, m: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / quality(m)


def _bucket(key: Column) -> Column:
    return F.least(F.floor((1.0 - F.exp(-key)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def allot(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: targets by weight, none above cap times its source.

    Sources are ordered by the level at which each is full; the first one that the remaining words, dealt to the
    sources from it on, would not fill gives the level of all from it on.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_level = W.orderBy(F.asc_nulls_last("source")), W.orderBy("full_at", F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn))
    per = per.withColumn("most", F.col("source_size") * float(cap)).withColumn("full_at", F.col("most") / F.col("weight"))
    total, before, after = F.sum("source_size").over(W.partitionBy()), by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumns({
        "place": F.row_number().over(by_level),
        "level": (total * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    })
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(W.partitionBy())
    return per.withColumn("first", first).select(
        "source", "source_size", F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("most")).otherwise(F.col("first.level") * F.col("weight")).alias("target")
    )


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row per source: source, source_size, target, epochs, bucket, cut_key, cut_id.

    Beside its epochs a document is taken if its key's bucket is below `bucket`, or equal and (key, doc_id) not above
    the cut (null: none of that bucket). The budget's last document is taken if that brings the sum nearer.
    """
    goals = written(allot(sized, weights, share, cap).coalesce(1), "mix-goals")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    slices = sized.groupBy("source", _bucket(F.col("key")).alias("bucket")).agg(F.sum("size").alias("n"))
    slices = slices.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n"))
    g, s = goals.alias("g"), slices.alias("s")
    ends = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).where("before <= budget").groupBy("g.source").agg(
        F.max(F.struct("bucket", "before", "budget")).alias("at")).select("source", "at.*")
    ends = written(ends.coalesce(1), "mix-ends")
    z, e = sized.alias("z"), ends.alias("e")
    last = (
        z.join(e, F.col("z.source").eqNullSafe(F.col("e.source")) & (_bucket(F.col("z.key")) == F.col("e.bucket")))
        .groupBy("e.source", "e.before", "e.budget", "z.key", "z.doc_id").agg(F.sum("size").alias("n"))
        .withColumn("sum", F.sum("n").over(W.partitionBy("source").orderBy("key", "doc_id")))
        .where("before + sum - n / 2.0D <= budget").groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("cut"))
    )
    out = goals.alias("g").join(ends.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").join(last.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left")
    return written(out.select("g.source", "g.source_size", "g.target", "g.epochs", F.coalesce("e.bucket", F.lit(-1)).alias("bucket"), F.col("l.cut.key").alias("cut_key"), F.col("l.cut.doc_id").alias("cut_id")).coalesce(1), "mix-plan")


def _selected(key: Column, doc_id: Column) -> Column:
    at = _bucket(key)
    below = (key < F.col("p.cut_key")) | ((key == F.col("p.cut_key")) & (doc_id.isNull() | (doc_id <= F.col("p.cut_id"))))
    return F.coalesce((at < F.col("p.bucket")) | ((at == F.col("p.bucket")) & below), F.lit(False))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Null text has size 0, the null source is a source of its own (last in order). Rows that repeat an id (or lack one)
    have one key and are taken together. Other columns are ignored. An empty table gives an empty result.
    """
    sized = written(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    z, p = sized.alias("z"), plan(sized).alias("p")
    times = F.col("p.epochs") + _selected(F.col("z.key"), F.col("z.doc_id")).cast("long")
    return z.join(p, F.col("z.source").eqNullSafe(F.col("p.source"))).select(
        "z.doc_id", "z.size", "p.source_size", "p.target", (times * F.col("z.size")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names.

    Nulls, ties and repeated rows as in mix(); a text without words is taken as often as its source has whole epochs, and once more
    where it is selected, at most CAP times. An empty table stays empty. docs is read twice, once for sizes and once for rows; no
    text is shuffled, as the plan is a row per source.
    """
    p = plan(written(sizes(docs), "mix-sizes")).alias("p")
    names = docs.columns
    keyed = docs.alias("z").select(F.struct(*[F.col(f"z.`{c}`") for c in names]).alias("row"), F.col("z.source").alias("_s"), F.col("z.doc_id").alias("_i"), measures(text_or_empty("z.text")).alias("_m"))
    keyed = keyed.select("row", "_s", "_i", _key(F.col("_i"), F.col("_m"), "mix").alias("_k")).alias("y")
    times = F.least(F.col("p.epochs") + _selected(F.col("y._k"), F.col("y._i")).cast("long"), F.lit(CAP))  # also for texts without words
    rows = keyed.join(p, F.col("y._s").eqNullSafe(F.col("p.source"))).select("y.row", times.alias("_t")).where("_t > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_t")))).select("row.*")
