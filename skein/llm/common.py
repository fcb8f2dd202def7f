"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.shared import discard, fresh_path, stable, unused, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "SPACES", "crc_mod", "discard", "documents", "fresh_path", "lower_ascii", "release", "small_batches", "stable", "text_or_empty", "unused", "written"]

#: The white space of the contracts: blank, and tab to carriage return.
SPACES = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id gives null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % mod


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, nothing else (the C locale's rule; other letters stay as they are)."""
    for k in range(26):
        col = F.replace(col, F.lit(chr(65 + k)), F.lit(chr(97 + k)))
    return col


#: Most rows and bytes of text that a Python worker gets at a time; long texts make Spark's 10,000 rows too many.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


@contextmanager
def small_batches(spark: SparkSession, keep: bool = False) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS and BATCH_BYTES for the jobs that run inside; smaller settings stay.

    keep: the session keeps them, for results that are computed when the caller asks for them.
    """
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        size = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            before[key] = now
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, now in ({} if keep else before).items():
            if now is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, now)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system; workers stay for later stages, which may be the JVM's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
