"""Exact and near deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest

from skein.llm import exact_dedup, simhash
from skein.llm.common import stable, written
from skein.llm.components import components


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_matches_brute_force(docs):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    groups: dict[str, list[int]] = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        groups.setdefault(normal(t), []).append(i)
    for g in groups.values():
        for i in g:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), i == min(g)) and r.text_sha256 == hashlib.sha256(normal(texts[i]).encode()).hexdigest()
    assert exact_dedup.drop_copies(docs).count() == len(groups)


def test_exact_edges(edges, empty):
    got = exact_dedup.exact_dedup(edges).collect()
    assert len(got) == edges.count()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    hello = by[hashlib.sha256(b"Hello there world").hexdigest()]
    assert {r.keep_id for r in hello} == {-9}
    void = by[hashlib.sha256(b"").hexdigest()]
    assert {r.doc_id for r in void} == {2, 3, None} and {r.keep_id for r in void} == {2}
    assert len(by[hashlib.sha256(b"word").hexdigest()]) == 3
    kept = exact_dedup.drop_copies(edges)
    assert kept.columns == edges.columns and kept.count() == len(by)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_collisions_are_told_apart_by_bytes(spark, monkeypatch, tmp_path):
    """With a digest that always collides, groups still follow the bytes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00"))
    rows = [(k, t) for k, t in enumerate(["a", "b", "a", "c", "b", "a"])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert got == {0: (0, 3), 2: (0, 3), 5: (0, 3), 1: (1, 2), 4: (1, 2), 3: (3, 1)}


def test_index_takes_several_runs(spark):
    index = exact_dedup.MergeIndex(spark)
    for lo in (0, 5):
        index.flush(spark.range(lo, lo + 10).selectExpr("unhex(md5(cast(id AS string))) AS digest", "id AS doc_id", "id AS rid"))
    level = {r.first.doc_id: r.n for r in index.compact().collect()}
    assert level == {i: 2 if 5 <= i < 10 else 1 for i in range(15)}
    assert index.lookup(spark.sql("SELECT unhex(md5('7')) AS digest UNION ALL SELECT unhex(md5('99'))")).count() == 1


def test_index_lookup_and_compaction_again(spark):
    """Runs flushed after a compaction are found and merged too."""
    index = exact_dedup.MergeIndex(spark)
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("unhex(md5(cast(id AS string))) AS digest", "id AS doc_id", "id AS rid")
    index.flush(rows(0, 20))
    index.flush(rows(10, 30))
    index.compact()
    index.flush(rows(25, 40), expected=15)
    found = index.lookup(rows(5, 60)).groupBy("doc_id").agg({"n": "sum"}).collect()
    assert {r[0]: r[1] for r in found} == {i: (10 <= i < 20) + (25 <= i < 30) + 1 for i in range(5, 40)}
    assert {r["first"].doc_id: r.n for r in index.compact().collect()} == {i: (10 <= i < 20) + (25 <= i < 30) + 1 for i in range(40)}
    assert len(index.runs) == 1


@pytest.mark.parametrize("memtables", [1, 3])
def test_portions_give_the_same_groups(docs, memtables):
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs.repartition(5), memtables=memtables).collect()} == want


def test_rows_of_a_shuffled_input_are_written_first(spark, docs):
    assert stable(docs.where("doc_id > 3").select("doc_id", "text")) is not None and not hasattr(stable(docs), "_skein_path")
    for other in (docs.orderBy("text"), docs.repartition(3), docs.where("rand() > 2"), docs.limit(5)):
        assert hasattr(stable(other), "_skein_path")
    assert exact_dedup.drop_copies(docs.orderBy("text")).count() == exact_dedup.drop_copies(docs).count()


def test_filter_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(0, 3000, 3)
    hit = exact_dedup.probe(keys, "id")
    marked = spark.range(3000).select("id", hit(F.col("id")).alias("hit"))
    assert marked.where("id % 3 = 0 AND NOT hit").count() == 0 and marked.where("id % 3 <> 0 AND hit").count() < 5


def brute_components(fps):
    a = np.array(fps, dtype=np.uint64)
    parent = list(range(len(a)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
            parent[find(i)] = find(int(j))
    return [find(i) for i in range(len(a))]


def test_fingerprint_definition():
    import xxhash

    text = "The Quick\x0bbrown\tÉ FOX jumps the quick BROWN é fox The Quick brown"
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == [want] and simhash.fingerprint(text, tables=2)[0] == want != simhash.fingerprint(text, tables=2)[1]
    assert simhash.fingerprint("", tables=2) == simhash.fingerprint(None, tables=2) == simhash.fingerprint(" \n", tables=2) == [0, 0]
    assert simhash.fingerprint("One two") == [xxhash.xxh64_intdigest(b"one two", 42)]


def test_near_matches_brute_force(docs):
    got = simhash.near_dedup(docs).collect()
    roots = brute_components([int(r.fingerprint, 16) for r in got])
    least: dict[int, int] = {}
    for r, c in zip(got, roots):
        least[c] = min(least.get(c, 1 << 62), r.doc_id)
    assert all(r.component_id == least[c] and r.kept == (r.doc_id == least[c]) for r, c in zip(got, roots))


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_links_match_brute_force(spark, bits):
    """Each pair once, whatever the bits, with fingerprints crowded around a few."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    pts = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            v = b
            for _ in range(int(rng.integers(1, 4))):
                v ^= 1 << int(rng.integers(0, 64))
            pts.add(v)
    pts |= {int(base[0]) ^ (1 << k) for k in range(64)}
    a = np.array(sorted(pts), dtype=np.uint64)
    signed = a.astype(np.int64)
    want = {tuple(sorted((int(signed[i]), int(signed[j])))) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits) if i != j}
    got = [tuple(r) for r in simhash.link(spark.createDataFrame([(int(x),) for x in signed], "fp long"), bits).collect()]
    assert set(got) == want and len(got) == len(want) > 60


@pytest.mark.parametrize("bits", [2, 5])
def test_two_tables_link_each_pair_once(spark, bits):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (30, 2), dtype=np.uint64)
    rows = {}
    for a, b in base.tolist():
        for _ in range(12):
            x, y = a, b
            for _ in range(int(rng.integers(0, 6))):
                x ^= 1 << int(rng.integers(0, 64))
            for _ in range(int(rng.integers(0, 6))):
                y ^= 1 << int(rng.integers(0, 64))
            rows[x] = y
    f = np.array(sorted(rows.items()), dtype=np.uint64)
    signed = f.astype(np.int64)
    want = set()
    for i in range(len(f)):
        near = (np.bitwise_count(f ^ f[i]) <= bits).any(axis=1)
        want |= {tuple(sorted((int(signed[i, 0]), int(signed[j, 0])))) for j in np.flatnonzero(near) if j != i}
    got = [tuple(r) for r in simhash.link(spark.createDataFrame([tuple(map(int, x)) for x in signed], "fp long, fp2 long"), bits, tables=2).collect()]
    assert set(got) == want and len(got) == len(want) > 30


def test_stage_verifies_similarity(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(5000)]
    base = [list(rng.choice(words, 400)) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        c = list(b)
        c[200] = "changed"
        texts.append(" ".join(c))
    path = str(tmp_path / "t")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.read.parquet(path)).collect()}
    assert set(range(40)) <= kept  # unrelated documents and first copies stay
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    assert all(len(sets[k] & sets[40 + k]) / len(sets[k] | sets[40 + k]) > 0.95 for k in range(20))
    assert len(kept) <= 46  # one changed word of 400 moves few bits


def jaccard_components(texts, at=0.8):
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    parent, pairs = list(range(len(sets))), []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= at * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((j, i))
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return pairs, [find(i) for i in range(len(sets))]


def test_stage_finds_pairs_at_the_similarity(spark, tmp_path):
    """Near copies of similarity 0.8 to 0.9, against brute force; a group of copies of copies too."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(60)]
    for t in texts[:60]:
        c = t.split()
        for at in rng.choice(300, int(rng.integers(3, 7)), replace=False):
            c[at] = "changed"
        texts.append(" ".join(c))
    for _ in range(40):
        c = texts[-1].split() if rng.random() < 0.5 else texts[0].split()
        for at in rng.choice(300, 4, replace=False):
            c[at] = str(rng.choice(words))
        texts.append(" ".join(c))
    pairs, roots = jaccard_components(texts)
    assert len([k for k in range(60) if (k, 60 + k) in pairs]) > 40
    path = str(tmp_path / "t")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.read.parquet(path)).collect()}
    want = {k for k, r in enumerate(roots) if k == r}
    assert want <= kept and len(kept - want) <= 1


def test_stage_keeps_other_texts_of_the_same_fingerprint(spark, tmp_path):
    """A line repeated many times decides the fingerprint; bodies that differ still stay."""
    body = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    texts = ["buy it now " * 200 + b for b in (*body, body[0] + " ")]
    assert len({simhash.fingerprint(t)[0] for t in texts}) == 1
    path = str(tmp_path / "t")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    assert {r.doc_id for r in simhash.drop_near_copies(spark.read.parquet(path)).collect()} == {0, 1}


def test_stage_links_by_fingerprints(spark, tmp_path, monkeypatch):
    """Without any bucket, near copies within the bits of the method are still found, and links of other bodies still fail."""
    rng = np.random.default_rng(10)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(5000)], 400)) for _ in range(30)]
    texts += [t + " end" for t in texts] + ["buy it now " * 200 + " ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    path = str(tmp_path / "t")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    own = simhash._shingled
    monkeypatch.setattr(simhash, "_shingled", lambda *args: own(*args).selectExpr("doc_id", "rid", "digest", "size", "array_except(buckets, buckets) AS buckets", "fp"))
    fps = np.array([simhash.fingerprint(t, simhash.WORDS)[0] for t in texts], dtype=np.uint64)
    near = np.bitwise_count(fps[:30] ^ fps[30:60]) <= simhash.MAX_BITS
    assert near.sum() > 20 and fps[60] == fps[61]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.read.parquet(path)).collect()}
    assert kept == set(range(62)) - {30 + int(k) for k in np.flatnonzero(near)}


def test_near_edges(edges, empty):
    got = simhash.near_dedup(edges).collect()
    assert len(got) == edges.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {2, 3, 4, None} and {r.component_id for r in zero} == {2} and sum(r.kept for r in zero) == 1
    assert simhash.drop_near_copies(edges).columns == edges.columns
    assert simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (260, 2))] + [(k, k + 1) for k in range(n, n + 100)] + [(5, 5), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and set(got) == {x for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_written_tables_go_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert all(f.startswith(("file:" + shared, "file://" + shared)) for f in written(spark.range(3), "x").inputFiles())
