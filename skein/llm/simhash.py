"""SimHash near-deduplication through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its segments. The Manhattan distance of two such points is a lower
bound of the fingerprints' Hamming distance, so all links lie within that distance on the integer grid. The range join
works on the grid: two points within distance 2 meet in a cell within 1 of both, so each distinct fingerprint is entered
in its own cell and in those above and below it, and fingerprints of one cell are compared exactly. Of several cells
in which a pair meets one counts, so each pair is made once. With 16 segments of 4 bits two unrelated fingerprints are
compared with a probability of about 3e-7.

For more than 2 bits the fingerprint is cut into parts: of two parts one differs in at most half the bits, so up to 5 bits
take two grids of 32-bit parts.

A second fingerprint from the same shingles, their hashes mixed once more, finds pairs that the first one misses; both grids
are one join.

Equal fingerprints are one point, so copies are never paired; components run over distinct fingerprints only.

The pipeline's stage drops by the Jaccard similarity of 5-word shingle sets. Its points are the distinct sets. They are linked
as above first: by fingerprints of their 5-word shingles that are equal or within MAX_BITS on the grid, each link verified on
the sets. A pair of similarity 0.8 differs in about 10 bits, so pairs are left that no grid of a few bits finds; an exact
comparison follows for them, of sets that share a bucket: the hash of ROWS minima of the set under as many hash functions,
BANDS of them a set. Two sets of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS, which is 0.9993 at 0.8. So that
a large group of near copies takes a few pairs a point and not all pairs, points are first compared with a leader of each
bucket, in up to LEADERS turns: the point that meets most others, then ones by a hash; points that fingerprints or turns have put
in one component are not compared again. At last the points of buckets with more than one component are compared wherever two of
them share one of their rarest shingles, which two sets of the similarity always do (prefix filtering), and sets that share only
a common passage do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import discard, release, small_batches, stable, written
from skein.llm.components import components
from skein.llm.exact_dedup import probe, without_rows

SHINGLE, SEED, MAX_BITS, SEGMENTS = 3, 42, 2, 16
#: The near-copies stage: texts are linked from this Jaccard similarity of their WORDS-word shingles; BANDS buckets of ROWS minima give the candidates.
WORDS, SIMILARITY, BANDS, ROWS, LEADERS = 5, 0.8, 24, 6, 8
#: Share of a turn's pairs that have to be links for leaders to get another turn; whatever they leave is compared in the end.
FEW = 0.05
#: Shingle hashes that are unpacked at a time.
CHUNK = 1 << 14


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other uniform bits from a hash: splitmix64's finaliser."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of a whole text's space-joined shingles with repeats: A-Z lower-cased, words between ASCII white space. Fewer words
    than a shingle: the whole sequence; none: no hashes."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    n = min(shingle, len(w))
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in zip(*(w[k:] for k in range(n)))), dtype=np.uint64, count=len(w) - n + 1)


def fingerprint(text: str | None, shingle: int = SHINGLE, tables: int = 1) -> list[int]:
    """Fingerprints of a whole text, by its shingle_hashes()."""
    return majority(shingle_hashes(text, shingle), tables)


def majority(h: np.ndarray, tables: int = 1) -> list[int]:
    """Fingerprints of shingle hashes: a bit is set if it is set in over half of them (in the second fingerprint: of the mixed
    ones). No hashes: 0."""
    out = []
    for t in range(tables):
        h = _mixed(h) if t else h
        set_ = np.zeros(64, dtype=np.int64)
        for k in range(0, len(h), CHUNK):
            bits = np.unpackbits(h[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_ += bits.sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(set_ * 2 > len(h), bitorder="little").tobytes(), "little"))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tables: int = 1) -> DataFrame:
    """One row per input row: doc_id, rid (monotonically_increasing_id() of docs), fp (the 64 bits as a signed long), and
    more, the other tables' fingerprints."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("string").alias("text"))

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        out = pd.Series([np.array(fingerprint(t, shingle, tables), dtype=np.uint64).astype(np.int64) for t in texts], dtype=object)
        release()
        return out

    return rows.select("doc_id", "rid", of("text").alias("all")).select("doc_id", "rid", F.get("all", F.lit(0)).alias("fp"), F.slice("all", 2, tables).alias("more"))


def _cells(parts: int, segments: int, tables: int):
    """For each part of each fingerprint its own cell (step 0) and the cells one step up and down in segment k (step k and
    -k, from 1): table, part and place as one number."""
    width = 64 // parts // segments
    around = np.concatenate((np.zeros((1, segments), dtype=np.int64), np.eye(segments, dtype=np.int64), -np.eye(segments, dtype=np.int64)))
    step = np.concatenate(([0], np.arange(1, segments + 1), -np.arange(1, segments + 1))).astype(np.int8)
    scale = np.array([(width + 3) ** k for k in range(segments)], dtype=np.int64)  # counts -1 to width + 1
    grid = np.arange(tables * parts, dtype=np.int64).reshape(tables, parts)
    grid = ((grid // parts << 1) + grid % parts) << 60

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["fp", "fp2"][:tables]
        for b in batches:
            for k in range(0, len(b), 2048):
                fp = np.ascontiguousarray(b[names].to_numpy()[k : k + 2048].astype(np.int64))
                bits = np.unpackbits(fp.view(np.uint8).reshape(len(fp), tables, 8), axis=2, bitorder="little").reshape(len(fp), tables, parts, segments, width)
                own = ((bits.sum(axis=4, dtype=np.int64) + 1) * scale).sum(axis=3) + grid
                cell = own[..., None] + (around * scale).sum(axis=1)
                shape = cell.shape
                cols = {"cell": cell, "step": step} | {n: fp[:, i, None, None, None] for i, n in enumerate(names)}
                yield pd.DataFrame({n: np.broadcast_to(c, shape).ravel() for n, c in cols.items()})
        release()

    return run


def link(points: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, tables: int = 1) -> DataFrame:
    """Pairs (a, b), each once, of distinct fingerprints (column fp) that differ in at most max_bits bits, which is at most
    5; with two tables also those whose other fingerprints (fp2) do. To discard() them deletes the cells that they are read from.

    A pair is made in the first table and part that differs in at most 2 bits, in the cell between the two points: the own
    cell of equal points, the upper one's own cell, the cell above one and below the other (of two such cells the
    lower), or the cell above both.
    """
    if max_bits > 5 or tables > 2:
        raise ValueError("at most 5 bits and two tables")
    parts, names = (1 if max_bits <= 2 else 2), ["fp", "fp2"][:tables]
    schema = "cell long, step byte, " + ", ".join(f"{n} long" for n in names)
    cells = written(points.select(*names).mapInPandas(_cells(parts, segments, tables), schema), "simhash-cells")
    x, y, bits = cells.alias("x"), cells.alias("y"), 64 // parts
    table, part = F.shiftright("x.cell", 61), F.shiftright("x.cell", 60).bitwiseAND(F.lit(1))
    here = F.lit(False)
    before = F.lit(False)
    for t, n in enumerate(names):
        diff = F.col(f"x.{n}").bitwiseXOR(F.col(f"y.{n}"))
        close = [F.bit_count(diff.bitwiseAND(F.lit(-1 if parts == 1 else (1 << bits) - 1 if k == 0 else -(1 << bits)))) <= 2 for k in range(parts)]
        near = F.bit_count(diff) <= max_bits
        first = (part == 0) & close[0] if parts == 1 else ((part == 0) & close[0]) | ((part == 1) & close[1] & ~close[0])
        here = here | ((table == t) & near & first & ~before)
        before = before | near
    up, other, once = F.col("x.step"), F.col("y.step"), F.col("x.fp") < F.col("y.fp")
    met = ((up == 0) & (other == 0) & once) | ((up == 0) & (other > 0)) | ((up > 0) & (other > 0) & (up != other) & once) | ((up > 0) & (other < 0) & (up <= -other))
    pairs = x.join(y, (F.col("x.cell") == F.col("y.cell")) & met & here).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))
    pairs._skein_path = cells._skein_path
    return pairs


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle_hashes()."""
    return np.unique(shingle_hashes(text, words)).astype(np.int64)


_RNG = np.random.default_rng(SEED)
_TIMES, _PLUS = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(shingles: np.ndarray) -> np.ndarray:
    """The BANDS buckets of a shingle set; none of the empty set."""
    h, least = shingles.astype(np.uint64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    if not len(h):
        return np.empty(0, np.int64)
    for k in range(0, len(h), 256):
        least = np.minimum(least, (_TIMES[:, None] * h[k : k + 256] + _PLUS[:, None]).min(axis=1))
    band = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        band = _mixed(band ^ row)
    return band.astype(np.int64)


def _shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: doc_id, rid, digest (128 bits) and size of the shingle set, its buckets, and the fingerprint of the
    same shingles with repeats (fp)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("string").alias("text"))

    @F.pandas_udf("digest binary, size int, buckets array<long>, fp long")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            h = shingle_hashes(t, WORDS)
            s = np.unique(h).astype(np.int64)
            found.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), buckets(s), np.array(majority(h), dtype=np.uint64).astype(np.int64)[0]))
        digest, size, own, fp = zip(*found) if found else ((),) * 4
        out = pd.DataFrame({"digest": digest, "size": size, "buckets": pd.Series(own, dtype=object), "fp": fp})
        release()
        return out

    return rows.select("doc_id", "rid", of("text").alias("s")).select("doc_id", "rid", "s.*")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """p, set: the shingle sets of the rows whose numbers are wanted (column p). A filter of fixed size over them finds the rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("p"), F.col(text_col).cast("string").alias("text"))

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        out = pd.Series([shingle_set(t) for t in texts], dtype=object)
        release()
        return out

    return rows.where(probe(wanted, "p")(F.col("p"))).join(wanted, "p").select("p", sets("text").alias("set"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least `similarity`."""
    both = pairs.join(sets.select(F.col("p").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("p").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= (F.size("sa") + F.size("sb") - shared) * F.lit(similarity)).select("a", "b")


def _rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """sets (p, set, size, c) -> p, size, c, h, at: of each set the rarest shingles that other sets have too, as many as two sets of
    the similarity must have one of in common (n - ceil(similarity * n) + 1, those that no other set has counted in), with their places from 1."""
    every = sets.select("p", "size", "c", F.explode("set").alias("h"))
    known = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    own = W.partitionBy("p")
    ranked = every.join(known, "h").withColumns({"place": F.row_number().over(own.orderBy("n", "h")), "k": F.count("*").over(own)})
    return ranked.where(F.col("size") - F.col("k") + F.col("place") <= F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - 1e-9) + 1).select("p", "size", "c", "h", (F.col("size") - F.col("k") + F.col("place")).alias("at"))


def _fit(x: str, y: str, similarity: float) -> Column:
    """Whether sets of these sizes can have the similarity."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(similarity)


def _near_fingerprints(points: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of points (p, size, fp) by the links of their fingerprints, written: the first point of each fingerprint with its
    others, and with the first ones of those within MAX_BITS, where sizes allow the similarity."""
    first = written(points.groupBy("fp").agg(F.min(F.struct("p", "size")).alias("first")), "near-first")
    linked = link(first.select("fp"))
    x, y = (first.select(F.col("fp").alias(fp), F.col("first").alias(name)) for fp, name in (("a", "x"), ("b", "y")))
    equal = points.join(first, "fp").select(F.col("first").alias("x"), F.struct("p", "size").alias("y")).where("x.p < y.p")
    met = equal.union(linked.join(x, "a").join(y, "b").select("x", "y")).where(_fit("x.size", "y.size", similarity))
    out = written(met.select(F.least("x.p", "y.p").alias("a"), F.greatest("x.p", "y.p").alias("b")), "near-pairs")
    discard(first, linked)
    return out


def _similar(points: DataFrame, docs: DataFrame, similarity: float, text_col: str) -> DataFrame:
    """points (p, size, buckets, fp) -> (node, component) over the verified links of points whose fingerprints are linked or that
    share a bucket."""
    tried = _near_fingerprints(points.select("p", "size", "fp"), similarity)
    own = points.select("p", "size", F.explode("buckets").alias("bucket"))
    shared = own.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    live = written(own.join(shared, "bucket"), "near-buckets")
    central = written(live.groupBy("p").agg(F.sum("n").alias("met")), "near-central")
    shared, live = live, written(live.join(central, "p").select("bucket", "p", "size", "met"), "near-live")
    discard(shared)
    wanted = written(central.select("p").union(tried.select("a")).union(tried.select("b")).distinct(), "near-wanted")
    with small_batches(docs.sparkSession):
        sets = written(_sets(docs, wanted, text_col), "near-sets")
    links = written(_verified(tried, sets, similarity), "near-links")
    found, turn, more, scrap = components(links), 0, True, [tried, links]

    while more:
        more = turn < LEADERS
        now = live.join(found.withColumnRenamed("node", "p"), "p", "left").select("bucket", "p", "size", "met", F.coalesce("component", "p").alias("c"))
        if more:
            order = F.xxhash64("p", "bucket", F.lit(turn)) if turn else -F.col("met")
            first = now.groupBy("bucket").agg(F.min(F.struct(order, "p", "size", "c")).alias("lead"))
            met = now.join(first, "bucket").where((F.col("lead.c") != F.col("c")) & _fit("lead.size", "size", similarity))
            made = met.select(F.least("p", "lead.p").alias("a"), F.greatest("p", "lead.p").alias("b"))
        else:
            apart = now.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
            rest = written(_rarest(sets.join(now.join(apart, "bucket", "left_semi").select("p", "size", "c").distinct(), "p"), similarity), "near-rarest")
            x, y = rest.alias("x"), rest.alias("y")
            owed = F.ceil((F.col("x.size") + F.col("y.size")) * F.lit(similarity / (1 + similarity)) - 1e-9)  # shingles in common: the first of them leaves room for the others
            room = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) + 1 >= owed
            met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.p") < F.col("y.p")) & (F.col("x.c") != F.col("y.c")) & room & _fit("x.size", "y.size", similarity))
            made = met.select(F.col("x.p").alias("a"), F.col("y.p").alias("b"))
        pairs = written(made.distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs")
        links = written(_verified(pairs, sets, similarity), "near-links")
        tried, scrap = tried.union(pairs), [*scrap, pairs, links]
        made = links.count()
        if made:
            found = components(found.toDF("a", "b").union(links))
        turn = turn + 1 if made > FEW * pairs.count() else LEADERS  # else the comparison of all that are left is cheaper
    discard(live, central, wanted, sets, *scrap)
    return found


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, tables: int = 1) -> DataFrame:
    """One row per input row: doc_id, rid, fingerprint (hex), component_id, kept.

    Texts are linked if their fingerprints are equal or differ in at most max_bits bits (with two tables, either
    fingerprint).

    component_id is the smallest doc_id reachable over links, null only where all ids are; the row with that id is
    kept, the first one read where rows repeat it. Texts without words (null, empty, white space) have fingerprint 0,
    which is linked like any other. Other columns are ignored. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        marked = written(fingerprints(docs, id_col, text_col, shingle, tables), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rid", "more")).alias("first")
    points = written(marked.groupBy("fp").agg(first).withColumn("fp2", F.get("first.more", F.lit(0))), "simhash-points")
    pairs = link(points, max_bits, tables=tables)
    found = components(pairs)
    by_fp = points.join(found, points["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    leader = by_fp.groupBy("c").agg(F.min("first").alias("lead"))
    named = written(by_fp.join(leader, "c").select("fp", "lead"), "simhash-named")
    return marked.join(named, "fp").select(
        "doc_id", "rid", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("lead.doc_id").alias("component_id"), (F.col("rid") == F.col("lead.rid")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies; all columns of docs. docs is written first if it is no scan.

    Rows are linked if their 5-word shingle sets are equal or have a Jaccard similarity of at least `similarity`: by their
    fingerprints first, then what those miss (see the module). Of those
    reachable over links the row with the smallest doc_id stays, the first one read where rows repeat it, a null id last. Texts
    without words (null ones too) are equal to each other. An empty table stays empty. Rows that the filter of dropped row
    numbers surely lacks pass as they are; the others alone are joined.
    """
    docs = stable(docs)
    with small_batches(docs.sparkSession):
        marked = written(_shingled(docs, id_col, text_col), "near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rid", "size", "buckets", "fp")).alias("first")
    points = written(marked.groupBy("digest").agg(first).select("digest", "first.*").withColumnRenamed("rid", "p"), "near-points")
    found = _similar(points, docs, similarity, text_col)
    by_set = points.join(found, points["p"] == found["node"], "left").select("digest", F.struct("void", "doc_id", "p").alias("own"), F.coalesce("component", "p").alias("c"))
    leader = by_set.groupBy("c").agg(F.min("own").alias("lead"))
    named = written(by_set.join(leader, "c").select("digest", F.col("lead.p").alias("lead")), "near-named")
    gone = written(marked.join(named, "digest").where(F.col("rid") != F.col("lead")).select("rid"), "near-gone")
    discard(marked, points, named)
    return without_rows(docs, gone)
