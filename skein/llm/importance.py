"""Importance resampling towards a target distribution over hashed n-grams.

Features are all runs of 1 to 3 consecutive words; a feature's bucket is its CRC-32 modulo BUCKETS. The corpus and the target
are counted by bucket; a bucket's gain is the log ratio of the two smoothed shares, and a document's weight is the sum of
gains over its features. Gumbel noise from a hash of the id is added and the highest scores are drawn, which samples
without replacement in proportion to the weights. CRCs of runs are composed from those of words (see crc.py), and no n-gram is
ever spelled out.

Texts are read twice, once for the counts and once for the weights; what is kept between is one number a bucket. Only ids and
numbers are shuffled. The ranks are ordinals over ranges of scores, so no task sorts all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import release, stable, text_or_empty, written
from skein.llm.crc import run_crcs, words_of
from skein.operators.ordering import with_ordinals

#: Fixed values of the contract.
BUCKETS, WORDS, SEED, LEAST_WORDS, PERCENT = 10_000, 3, "42", 20, 5

#: Bytes of texts that are taken apart at a time; a longer text is one piece.
PIECE = 2 << 20


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of consecutive texts, of PIECE bytes or one text."""
    whole = texts.cast(pa.large_binary())
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(whole):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, side="right")) - 1)
        yield at, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def bucket_counts(texts: DataFrame, text: Column, buckets: int = BUCKETS, most: int = WORDS) -> DataFrame:
    """bucket, n: the features of all texts (no null among them), by bucket; a row for each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, data, bounds in _pieces(b.column(0)):
                for crc, _ in run_crcs(*words_of(data, bounds), most):
                    n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])
        release()

    return texts.select(text.alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of each of the buckets: the floor of 1000 times the log ratio of smoothed shares. Both inputs: bucket, n."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", s.alias("s"), t.alias("t"))
    all_s, all_t = (F.coalesce(F.sum(c), F.lit(0.0)) for c in ("s", "t"))
    totals = both.agg(all_s.alias("all_s"), all_t.alias("all_t"))  # one row
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def bucket_numbers(gains: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gains as an array: a number for each bucket, whatever the corpus."""
    out = np.zeros(buckets, np.int64)
    for bucket, gain in gains.collect():
        out[bucket] = gain
    return out


def weighed(docs: DataFrame, gains: np.ndarray, most: int = WORDS) -> DataFrame:
    """docs, whose last column is a text (no null), with n_words, n_features and weight in its place."""
    buckets = np.uint32(len(gains))
    keep = docs.columns[:-1]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_words long, n_features long, weight long"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = np.zeros((3, b.num_rows), np.int64)
            for at, data, bounds in _pieces(b.column(b.num_columns - 1)):
                here = slice(at, at + len(bounds) - 1)
                runs = run_crcs(*words_of(data, bounds), most)
                n_words[here] = np.bincount(runs[0][1], minlength=len(bounds) - 1)
                for crc, row in runs:
                    n_features[here] += np.bincount(row, minlength=len(bounds) - 1)
                    np.add.at(weight[here], row, gains[crc % buckets])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, (n_words, n_features, weight))], names=[*keep, "n_words", "n_features", "weight"])
        release()

    return docs.mapInArrow(weigh, schema)


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise of a key in thousandths, as long: from the first 32 bits of sha256(`<seed>:<key>`); a null key counts as empty."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def _ranked(rows: DataFrame, target: DataFrame, target_text_col: str, buckets: int, most: int, seed: str, least_words: int, percent: int) -> DataFrame:
    """rows (of which doc_id is one column and a text, without nulls, the last) with n_words, n_features, weight, score and rank."""
    corpus = bucket_counts(rows, F.col(rows.columns[-1]), buckets, most)
    wanted = bucket_counts(target, text_or_empty(target_text_col), buckets, most)
    gains = bucket_numbers(bucket_gains(corpus, wanted, buckets), buckets)
    scored = written(weighed(rows, gains, most).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    placed = with_ordinals(scored.withColumn("unfit", ~fit), "unfit", "-score", "doc_id", name="place", first=1)
    return placed.withColumn("rank", F.when(~F.col("unfit") & (F.col("place") <= drawn), F.col("place"))).drop("unfit", "place")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, most: int = WORDS, seed: str = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (1 for the highest score; null unless drawn).

    Of the documents with at least least_words words, percent in a hundred (rounded down) are drawn. A null text counts as
    empty: no features, weight 0. A null id is one key, after all others of equal score. Rows of equal score and id are each a
    row and keep the input's order. Other columns of both tables are ignored. An empty target makes all its shares equal; an empty docs
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return _ranked(rows, target, target_text_col, buckets, most, seed, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, most: int = WORDS, seed: str = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """The drawn rows of docs themselves, with all their columns; nulls and ties as in resample()."""
    fixed = stable(docs, "rows")
    rid = F.monotonically_increasing_id()
    rows = fixed.select(rid.alias("rid"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    drawn = _ranked(rows, target, target_text_col, buckets, most, seed, least_words, percent).where("rank IS NOT NULL").select("rid")
    return fixed.select(rid.alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(drawn, "rid", "left_semi").select("row.*")
