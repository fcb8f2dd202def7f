"""Document fingerprints by consistent weighted sampling (Ioffe).

A text is a set of words weighted by how often they occur. For each word and each of SAMPLES samples, gamma-distributed
r and c and a uniform b are drawn from the word's hash; t = floor(ln(weight) / r + b) and the word of the smallest
ln(c) - r (t - b) - r is the sample, together with t. Two texts agree in a sample with a probability equal to the
generalised Jaccard similarity of their weighted words: the sum of the smaller weights over that of the larger.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = 64
#: Words whose draws a worker keeps: 3 x SAMPLES floats each, 46 MB at most.
KEPT = 60_000
#: Rows of a bucket of neighbouring ids, and the most buckets (beyond which they get larger; a bucket is streamed, not held).
BUCKET_ROWS, MAX_BUCKETS = 4000, 32768
#: Ids that are drawn for each bucket, from which the buckets' ends are taken.
SPREAD = 16

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: uniform bits from counters."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Signatures of weighted word sets; keeps the draws of words it has seen, up to KEPT."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.counters = np.arange(1, 3 * samples + 1, dtype=np.uint64) * _STEP
        self.reset(0)

    def reset(self, least: int) -> None:
        self.row: dict[bytes, int] = {}
        n = max(KEPT, least)
        self.r, self.once, self.b = (np.empty((n, self.samples), dtype=np.float32) for _ in range(3))
        self.hash = np.empty(n, dtype=np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        start, h = len(self.row), np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
        bits = mixed_bits(h[:, None] + self.counters[None, :]).reshape(len(words), 3, self.samples)
        low = ((bits & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
        high = ((bits[:, :2] >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
        gamma = -np.log(low[:, :2] * high)  # the product of two uniforms: shape 2, scale 1
        at = slice(start, start + len(words))
        r, b = np.maximum(gamma[:, 0], np.float32(1e-6)), low[:, 2]
        # `once`: ln(c) - r (t - b) - r at t = 0, which is t for a word that occurs once, as ln(1) is 0 and b below 1.
        self.r[at], self.once[at], self.b[at], self.hash[at] = r, np.log(np.maximum(gamma[:, 1], np.float32(1e-30))) + r * (b - 1), b, h
        for k, w in enumerate(words):
            self.row[w] = start + k

    def signature(self, text: str) -> np.ndarray:
        """uint32 samples; all 0 for a text without words, never 0 otherwise."""
        counts = Counter(text.encode("utf-8", "replace").split())
        if not counts:
            return np.zeros(self.samples, dtype=np.uint32)
        new = [w for w in counts if w not in self.row]
        if len(self.row) + len(new) > len(self.hash):
            self.reset(len(counts))
            new = list(counts)
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.row.__getitem__, counts), dtype=np.int64, count=len(counts))
        times = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
        best, sig_w, sig_t = np.full(self.samples, np.inf, dtype=np.float32), np.zeros(self.samples, dtype=np.uint64), np.zeros(self.samples, dtype=np.int64)
        order = np.argsort(self.hash[rows])  # equal sets in equal order, whatever the texts' word order
        rows, times, j = rows[order], times[order], np.arange(self.samples)
        for k in range(0, len(rows), 8192):
            at, n = rows[k : k + 8192], times[k : k + 8192]
            a = self.once[at]
            more = np.flatnonzero(n > 1)
            r = self.r[at[more]]
            t = np.floor(np.log(n[more])[:, None] / r + self.b[at[more]])
            a[more] -= r * t
            i = a.argmin(axis=0)
            steps = np.zeros(len(at), dtype=np.int64)
            steps[more] = np.arange(len(more))
            own_t = np.where(n[i] > 1, t[steps[i], j] if len(more) else 0, 0).astype(np.int64)
            better = a[i, j] < best
            best[better], sig_w[better], sig_t[better] = a[i, j][better], self.hash[at[i]][better], own_t[better]
        mixed = mixed_bits(sig_w + sig_t.astype(np.uint64) * _STEP)
        return (mixed >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: the estimate of generalised Jaccard similarity; 1 for two texts without words."""
    return float((a == b).mean())


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), in any order. Null text counts as empty."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        s = Sampler(samples)
        return pd.Series([hexed(s.signature(t or "")) for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col).cast("string")).alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """The last half (floor) of the code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(bounds: np.ndarray):
    """Rows to their buckets: ids above bounds[k - 1] up to bounds[k], null ids with the lowest. The row that follows a
    bucket's last one, which is the next bucket's first (or the very first one), comes along as a guest."""
    at = {int(b): k for k, b in enumerate(bounds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                out: list[tuple] = []
                for i, text in zip(b.column(0).slice(s, 1000).to_pylist(), b.column(1).slice(s, 1000)):
                    z = pack((text.as_py() or "").encode("utf-8", "replace"))
                    out.append((0 if i is None else int(np.searchsorted(bounds, i)), False, i, z))
                    if i is not None and i in at:
                        out.append(((at[i] + 1) % len(bounds), True, i, z))
                    elif i is None and not len(bounds):
                        out.append((0, True, i, z))
                yield _batch(out, DEALT)

    return run


DEALT = {"bucket": pa.int32(), "guest": pa.bool_(), "doc_id": pa.int64(), "z": pa.binary()}
COMPARED = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(),
    "near_next": pa.float64(),
}


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(fields.values())], names=list(fields))


def _compared(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, unpack = Sampler(samples), zstandard.ZstdDecompressor().decompress
        last = None
        for b in batches:
            out: list[tuple] = []
            for bucket, guest, doc_id, z in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                text = unpack(z.as_py()).decode("utf-8")
                sig = sampler.signature(text)
                if last is not None and last[0] == bucket:
                    _, i, before, own = last
                    new = edited(before, text)
                    other = sampler.signature(new)
                    out.append((i, len(before), hashlib.sha256(new.encode("utf-8")).hexdigest(), hexed(own), hexed(other), likeness(own, other), likeness(own, sig)))
                last = None if guest else (bucket, doc_id, text, sig)
            yield _batch(out, COMPARED)

    return run


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id, after the last the first; a single document is its own next.
    Null ids come last, rows that repeat an id in order of their packed texts. Null text counts as empty. Other columns
    are ignored. An empty table gives an empty result.

    Ids are cut into buckets at existing ids (quantiles of a sample), so that each bucket's first document is known
    without sorting; texts are packed and shuffled once, buckets are dealt evenly to the tasks, each is streamed in order.
    Rows cross into Python as Arrow columns: ids keep all their bits beside nulls.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, most = rows.agg(F.count("doc_id"), F.max("doc_id")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MAX_BUCKETS, n // BUCKET_ROWS + 1)
    parts = -(-parts // tasks) * tasks if parts > tasks else parts  # as many for each task
    # SPREAD ids a bucket, drawn by a hash; every SPREAD-th of them in order ends a bucket, the largest id the last one.
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (SPREAD * parts)))) == 0).select("doc_id").distinct() if parts > 1 else None
    ids = sorted(r.doc_id for r in drawn.where("doc_id IS NOT NULL").toLocalIterator()) if drawn else []
    bounds = np.array(sorted({*ids[SPREAD - 1 :: SPREAD], most}), dtype=np.int64) if n else np.array([], dtype=np.int64)
    dealt = rows.mapInArrow(_dealt(bounds), "bucket int, guest boolean, doc_id long, z binary")
    ordered = dealt.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "z")
    return ordered.mapInArrow(
        _compared(samples), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
