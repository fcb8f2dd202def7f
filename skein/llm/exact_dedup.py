"""Exact deduplication over a log-structured merge index [native].

Digests are taken in MEMTABLES portions of the input. A portion is a memtable: it is flushed as one run, a table of
(digest, first, n) in files sorted by digest; `first` is the smallest identifier, n the rows. All portions of one input are
flushed by one job, each to files of its own, and so are their filters: bitmaps that are sent to the tasks. Compaction probes
each run's digests against the filters of the others; those that may be in several runs are merged by a hash aggregate that
keeps the smallest identifier, all else is in one run only and passes as it is.

The digests that occur more than once give the hits. Only hits' texts are read again; they are shuffled, joined with the
text of the row that stays, and compared byte for byte. A hit whose bytes differ (a digest collision) is grouped by its
own text instead.

Only DataFrame functions run; a hot digest is one row a task after map-side combining, and the verification join is
one that adaptive execution can split. Filters have two bits a key in FILTER_SHARE bits a key, up to 2**FILTER_BITS in
all: beyond that they let more rows through, and results stay the same.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import discard, fresh_path, stable, text_or_empty, unused, written

#: Portions that are flushed as runs.
MEMTABLES = 4
#: Bits of a filter for each key, and log2 of the least and most bits in all (2**28 bits are 32 MB).
FILTER_SHARE, FILTER_LEAST, FILTER_BITS = 16, 18, 28


def normalised(col: Column) -> Column:
    """Each run of blank, tab, line feed, vertical tab, form feed or carriage return becomes one space."""
    for ch in "\t\n\x0b\x0c\r":
        col = F.replace(col, F.lit(ch), F.lit(" "))
    return F.regexp_replace(col, " {2,}", " ")


def _bits(key: Column, seed: int, log2: int) -> Column:
    return F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << log2) - 1))


def build_filters(keys: DataFrame, key: str, log2: int, group: str | None = None) -> DataFrame:
    """A row for each value of group (0 without one) that has keys: run, filter, an array of 2**log2 / 64 longs with two bits for
    each key."""
    words = (1 << log2) // 64
    used = (
        keys.select((F.col(group) if group else F.lit(0)).alias("_run"), F.explode(F.array(*[_bits(F.col(key), seed, log2) for seed in (7, 8)])).alias("_b"))
        .select("_run", F.shiftright("_b", 6).alias("_w"), F.expr("shiftleft(1L, cast(_b & 63 as int))").alias("_v"))
        .groupBy("_run", "_w").agg(F.bit_or("_v").alias("_v"))
    )
    # Blocks of 512 words first, so that a task gathers no more than a block's words or a filter's blocks at a time.
    block = F.map_from_entries(F.collect_list(F.struct(F.col("_w").bitwiseAND(F.lit(511)).cast("int"), "_v")))
    blocks = used.groupBy("_run", F.shiftright("_w", 9).cast("int").alias("_hi")).agg(block.alias("_m"))
    size = min(words, 512)
    zero = F.lit(0).cast("long")
    dense = blocks.select("_run", "_hi", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), zero)).alias("_a"))
    whole = dense.groupBy("_run").agg(F.map_from_entries(F.collect_list(F.struct("_hi", "_a"))).alias("_m"))
    none = F.array_repeat(zero, size)
    full = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(words // size - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), none)))
    return whole.select(F.col("_run").alias("run"), full.alias("filter"))


def _log2(n: int) -> int:
    return min(FILTER_BITS, max(FILTER_LEAST, (FILTER_SHARE * n - 1).bit_length()))


def _test(view: str, run: int, log2: int) -> Callable[[Column], Column]:
    def test(col: Column) -> Column:
        def has(seed: int) -> Column:
            bit = _bits(col, seed, log2)
            word = F.get(F.expr(f"(SELECT filter FROM {view} WHERE run = {run})"), F.shiftright(bit, 6).cast("int"))
            return F.coalesce(F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))

        return has(7) & has(8)

    return test


def probes(keys: DataFrame, key: str, groups: int, n: int, group: str | None = None) -> list[Callable[[Column], Column]]:
    """For each value of group from 0 on a test of columns against a filter of its keys, sized for n of them: false only for what is
    surely not among them. One job."""
    log2, view = _log2(n), f"skein_filter_{uuid.uuid4().hex}"
    written(build_filters(keys, key, log2, group).coalesce(1), "filter").createOrReplaceTempView(view)
    return [_test(view, k, log2) for k in range(groups)]


def probe(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """probes() for one filter of all keys, counted first."""
    n = keys.count()
    return probes(keys, key, 1, n)[0] if n else lambda col: F.lit(False)


class MergeIndex:
    """Runs of sorted digests under one folder of the shared store.

    flush() adds a run, flush_portions() several by one job; compact() merges all runs to one (it may be called at any time, and
    runs be flushed after it), and lookup() finds digests: a run's filter is probed before the run is read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "lsm")
        self.runs: list[DataFrame] = []
        self.filters: list[Callable[[Column], Column]] = []  # of the first runs; made when first asked for
        self.made = 0

    def _tests(self) -> list[Callable[[Column], Column]]:
        self.filters += [probe(run, "digest") for run in self.runs[len(self.filters) :]]
        return self.filters

    def _path(self) -> str:
        self.made += 1
        return f"{self.path}/flush-{self.made:05d}"

    def flush(self, entries: DataFrame, expected: int | None = None) -> None:
        """Flushes entries (digest binary, doc_id, rid) as one run; a digest is one row of it. expected: about how many, for a filter
        that is made at once."""
        self.flush_portions(entries, F.lit(0), 1, expected)

    def flush_portions(self, entries: DataFrame, portion: Column, portions: int, expected: int | None = None) -> None:
        """Flushes entries as a run for each portion (from 0 on) that has any, and if their number is known their filters."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rid")).alias("first")
        rows, path = entries.groupBy(portion.cast("int").alias("run"), "digest").agg(first, F.count("*").alias("n")), self._path()
        rows.sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(path)
        places = [self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={k}") for k in range(portions)]
        filled = [k for k, x in enumerate(places) if x.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(x)]
        if expected is not None:
            tests, table = self._tests(), self.spark.read.schema(rows.schema).parquet(path)
            self.filters = tests + [t for k, t in enumerate(probes(table, "digest", portions, -(-expected // portions), "run")) if k in filled]
        self.runs += [self.spark.read.schema(rows.drop("run").schema).parquet(f"{path}/run={k}") for k in filled]

    def compact(self) -> DataFrame:
        """Merges all runs to one: digest, first, n; no rows if there are none."""
        if not self.runs:
            return self.spark.createDataFrame([], "digest binary, first struct<void: boolean, doc_id: long, rid: long>, n long")
        if len(self.runs) > 1:
            tests, alone, again = self._tests(), None, None
            for k, run in enumerate(self.runs):
                others = functools.reduce(Column.__or__, [test(F.col("digest")) for i, test in enumerate(tests) if i != k])
                marked = run.withColumn("again", others)
                alone, again = (marked if x is None else x.union(marked) for x in (alone, again))
            merged = again.where("again").groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
            whole, path = alone.where("NOT again").drop("again").union(merged), self._path()
            whole.sortWithinPartitions("digest").write.parquet(path)
            self.runs, self.filters = [self.spark.read.schema(whole.schema).parquet(path)], []
        return self.runs[0].select("digest", "first", "n")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The given rows (digest and any others) whose digest is in the index, with first and n of each run that has it."""
        found = None
        for run, test in zip(self.runs, self._tests()):
            own = digests.where(test(F.col("digest"))).join(run.select("digest", "first", "n"), "digest")
            found = own if found is None else found.union(own)
        assert found is not None, "flush() comes first"
        return found


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtables: int = MEMTABLES) -> DataFrame:
    """One row per input row: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The row with the smallest id of a group stays; a null id comes last, and of rows that
    repeat an id the first one read stays, so exactly one row of a group has kept = true. keep_id is null only where
    all ids of a group are. Other columns of docs are ignored, whatever their names. An empty table gives an empty
    result. rid numbers the input rows: it is monotonically_increasing_id() of docs, of stable(docs) where docs is no scan.
    """
    spark = docs.sparkSession
    docs = stable(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), normalised(text_or_empty(text_col)).alias("norm"))
    digest = F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest")
    entries = written(rows.select("doc_id", "rid", digest), "dedup-entries")
    index = MergeIndex(spark)
    index.flush_portions(entries, F.pmod(F.shiftright("rid", 33), F.lit(memtables)), memtables, entries.count())
    groups = written(index.compact().where("n > 1").select("digest", F.col("first.rid").alias("keep_rid")), "dedup-groups")

    # Rows that the filter of repeated digests lacks are surely alone; all that follows is about the others.
    again = probe(groups, "digest")(F.col("digest"))
    alone, members = entries.where(~again), written(entries.where(again), "dedup-members")
    hits = written(rows.where(probe(members, "rid")(F.col("rid"))).select("rid", digest, "norm"), "dedup-hits")
    keepers = hits.join(groups.withColumnRenamed("keep_rid", "rid"), ["digest", "rid"]).select("digest", F.col("norm").alias("keep_norm"))
    wrong = written(hits.join(keepers, "digest").where(F.col("norm") != F.col("keep_norm")).select("rid", F.col("norm").alias("own")), "dedup-collisions")
    discard(hits)
    verified = members.withColumn("own", F.lit(None).cast("string")) if wrong.isEmpty() else written(members.join(wrong, "rid", "left"), "dedup-verified")
    final = verified.groupBy("digest", "own").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rid")).alias("first"), F.count("*").alias("group_size")
    )
    v, g = verified.alias("v"), final.alias("g")
    repeated = v.join(g, (F.col("v.digest") == F.col("g.digest")) & F.col("v.own").eqNullSafe(F.col("g.own"))).select(
        "v.rid", "v.doc_id", F.col("g.first.doc_id").alias("keep_id"), "g.group_size", (F.col("v.rid") == F.col("g.first.rid")).alias("kept"), "v.digest"
    )
    single = alone.select("rid", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return repeated.union(single).select("rid", "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, a stable scan, without the rows whose number (monotonically_increasing_id() of docs) is in gone's only column.

    Nulls in docs, repeated rows and columns of whatever name stay as they are; an empty gone takes nothing away.
    """
    (rid,) = unused(docs, "_skein_rid")
    gone = gone.toDF(rid)
    maybe = probe(gone, rid)(F.col(rid))
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    return numbered.where(~maybe).unionByName(numbered.where(maybe).join(gone, rid, "left_anti")).drop(rid)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() does not keep; all columns of docs. docs is written first if it is no scan.

    Nulls, ties, repeated rows and an empty table are treated as exact_dedup() says. Rows that the filter of dropped row
    numbers surely lacks pass as they are; the others alone are joined.
    """
    docs = stable(docs)
    return without_rows(docs, written(exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select("rid"), "dedup-gone"))
