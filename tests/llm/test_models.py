"""Mixing, language ID, fingerprints, language model, piece sampling, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import fingerprints, language_id, mixing, piece_sampling, queries, recurrent_lm

# ---- mixing


def brute_targets(sizes):
    """Water-filling by rounds: what is above a cap goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, full, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = 2.0 * sizes[s]
        left -= sum(full[s] for s in over)
        open_ -= over
    return full


def check_mix(rows):
    got = mixing.mix(rows).collect()
    assert len(got) == rows.count()
    source = {r.doc_id: r.source for r in rows.collect()}
    texts = Counter((r.doc_id, len((r.text or "").encode().split())) for r in rows.collect())
    assert Counter((r.doc_id, r.size) for r in got) == texts
    return got, source


def test_mixing(docs):
    got, source = check_mix(docs)
    sizes: dict = {}
    for r in got:
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
    want = brute_targets(sizes)
    taken: dict = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
        if want[s] >= sizes[s]:
            assert r.taken >= r.size  # whole epochs come first
    for s in want:
        assert abs(taken[s] - want[s]) <= max(r.size for r in got if source[r.doc_id] == s) / 2 + 1e-6
    assert Counter((r.doc_id, r.taken) for r in mixing.mix(docs).collect()) == Counter((r.doc_id, r.taken) for r in got)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert all(times[r.doc_id] * r.size == r.taken for r in got if r.size)


def test_quality_matches_brute_force(spark):
    good = "the garden has a small pump that checks each bed and opens its valve when the soil is dry"
    texts = [good, " ".join([good] * 20), "spam " * 200, "1234 5678 %%%% ---- " * 10, "x" * 500, "é ß 日本 😀", "a", "", " \t\n", "...", good.upper()]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.q for r in rows.select(mixing.quality(mixing.measures(F.col("t"))).alias("q")).collect()]

    def brute(t):
        words = [w for w in re.split("[\\x20\\x09-\\x0D]+", t) if w]
        letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in t)
        if not words:
            return 1.0
        return 1 / (1 + abs(len(t) / len(words) - 6) / 2) * (0.1 + 0.9 * letters / len(t)) * math.log(1 + len(set(words))) / math.log(1 + len(words))

    assert got == pytest.approx([brute(t) for t in texts])
    assert got[0] > got[1] > got[2] and got[0] > got[3] and got[0] > got[4] and all(0 < q <= 1 for q in got)


def test_mixing_prefers_quality(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, "words of fair length here ok").otherwise("w w w w w w").alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    more = rows.unionByName(spark.createDataFrame([(10**6 + k, t, "x " * 40_000, "en", 1) for k, t in enumerate("ab")], "doc_id long, source string, text string, lang string, n_chars int"))
    taken = Counter(r.doc_id % 2 for r in mixing.mix(more).collect() if r.doc_id < 10**6 and r.taken > r.size)
    assert 150 < taken[0] + taken[1] < 300 and taken[0] > 1.2 * taken[1]


def test_mixing_edges(edges, empty):
    check_mix(edges)
    assert mixing.mixed(edges).columns == edges.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# ---- language ID


def test_language(docs):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark, edges, empty):
    got = language_id.identify(edges).collect()
    assert len(got) == edges.count()
    by = {r.doc_id: r for r in got}
    assert by[2].lang_pred == by[3].lang_pred == by[10].lang_pred == "und" and by[10].score == 0.0 and not by[None].held_out
    assert language_id.identify(empty).count() == 0
    unlabelled = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert language_id.keep_identified(edges).columns == edges.columns
    assert 2 not in {r.doc_id for r in language_id.keep_identified(edges).collect()}


def test_letters_and_grams():
    x = language_id.letters("Ab1 c")
    assert [chr(c) if c != language_id.EDGE else "_" for c in x.tolist()] == list("_ab_c_")
    assert len(language_id.gram_codes(x)) == 3 + 5 + 3 and len(set(language_id.gram_codes(x).tolist())) == 11
    assert len(language_id.letters("12 !")) == 1 and len(language_id.letters("𝐀𐐀")) == 4


def brute_grams(text):
    """n-grams of letters within words, word ends marked, as the numbers that ties go by."""
    words, word = [], ""
    for c in text or "":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words, word = [*words, word], ""
    x = [language_id.EDGE]
    for w in [*words, *([word] if word else [])]:
        x += [*map(ord, w), language_id.EDGE]
    out = [c for c in x if c != language_id.EDGE]
    out += [(a << 21) + b for a, b in zip(x, x[1:])]
    return out + [(((a << 21) + b) << 21) + c & (1 << 64) - 1 for a, b, c in zip(x, x[1:], x[2:]) if b != language_id.EDGE]


def brute_profile(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[: language_id.PROFILE]]


def test_language_matches_brute_force(docs):
    """Profiles by plain counting, and the out-of-place distance gram by gram."""
    rows = docs.collect()
    counts: dict[str, Counter] = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.text is not None and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    places = {lang: {g: k for k, g in enumerate(brute_profile(c))} for lang, c in counts.items()}
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for r in rows[::3]:
        own = brute_profile(Counter(brute_grams(r.text)))
        far = {lang: sum(min(abs(k - p[g]), language_id.PROFILE) if g in p else language_id.PROFILE for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(far), key=far.get) if own else "und"
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 - far[best] / (language_id.PROFILE * len(own)) if own else 0.0)


def test_bounded_sample_learns_the_same(docs):
    whole, some = language_id.learn(docs), language_id.learn(docs, max_docs=20)
    assert whole.langs == some.langs and len(some.codes) > 100


# ---- fingerprints


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    keys = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in keys) / max(1, sum(max(a[w], b[w]) for w in keys))


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(5)
    sampler, words = fingerprints.Sampler(1024), [f"w{k}" for k in range(60)]
    for _ in range(8):
        a, b = (" ".join(rng.choice(words, 80, p=(p := rng.dirichlet(np.ones(60) * 0.4)))) for _ in range(2))
        b = a + " " + b if rng.random() < 0.5 else b
        got, want = fingerprints.likeness(sampler.signature(a), sampler.signature(b)), jaccard(a, b)
        assert abs(got - want) < 5 * math.sqrt(want * (1 - want) / 1024) + 0.01


def test_fingerprint_order_and_reset():
    sampler = fingerprints.Sampler()
    a = sampler.signature("b a a c")
    sampler.reset(0)
    assert (sampler.signature("a c b a") == a).all() and not sampler.signature("").any() and sampler.signature("x").all()


def test_next_documents(docs):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs).collect()}
    s = fingerprints.Sampler()
    for k, r in enumerate(rows):
        after = rows[(k + 1) % len(rows)].text
        half = len(r.text) // 2
        new = r.text[: len(r.text) - half] + after[:half]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(new.encode()).hexdigest())
        assert g.fingerprint == fingerprints.hexed(s.signature(r.text)) and g.edited_fingerprint == fingerprints.hexed(s.signature(new))
        assert g.near_edited == fingerprints.likeness(s.signature(r.text), s.signature(new)) and g.near_next == fingerprints.likeness(s.signature(r.text), s.signature(after))


def test_buckets_meet_at_their_ends(docs, monkeypatch):
    want = {r.doc_id: tuple(r) for r in fingerprints.compare_with_next(docs).collect()}
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    assert {r.doc_id: tuple(r) for r in fingerprints.compare_with_next(docs).collect()} == want


def test_fingerprint_edges(spark, edges, empty):
    got = fingerprints.compare_with_next(edges).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in edges.collect())
    assert fingerprints.compare_with_next(empty).count() == 0
    one = fingerprints.compare_with_next(edges.where("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"Hello the" + b"Hello th").hexdigest()
    assert fingerprints.compare_with_next(edges.where("doc_id IS NULL")).count() == 2
    assert {r.fingerprint for r in fingerprints.fingerprint(edges).collect()} == {r.fingerprint for r in got}


def test_large_ids_beside_nulls(spark):
    """All rows come back with the ids they had, also above 2**53 and beside a null in one partition."""
    ids = [2**53 + 1, 2**53 + 3, None, 3, -(2**60) - 1]
    rows = spark.createDataFrame([(i, f"text of {i}", "en") for i in ids], "doc_id long, text string, lang string").coalesce(1)
    got = fingerprints.compare_with_next(rows).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)
    want = {i: f"text of {i}" for i in ids}
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    for i, after in zip(order, [*order[1:], order[0]]):
        new = fingerprints.edited(want[i], want[after])
        assert next(r.edited_sha256 for r in got if r.doc_id == i) == hashlib.sha256(new.encode()).hexdigest()


# ---- language model


def test_gradients():
    rng = np.random.default_rng(0)
    net = recurrent_lm.Network.start(rng.random(recurrent_lm.SYMBOLS) * 100)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, to, ok = rng.integers(0, recurrent_lm.SYMBOLS, (6, 4)), rng.integers(0, recurrent_lm.SYMBOLS, (6, 4)), rng.random((6, 4)) > 0.2
    h = rng.standard_normal((4, recurrent_lm.HIDDEN))
    d, _, _ = net.gradients(ids, to, ok, h)
    for k, g in d.items():
        i = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        own = net.p[k][i]
        loss = []
        for e in (1e-4, -1e-4):
            net.p[k][i] = own + e
            loss.append(net.gradients(ids, to, ok, h)[2])
        net.p[k][i] = own
        assert (loss[0] - loss[1]) / 2e-4 == pytest.approx(g[i], rel=1e-2, abs=2e-5)


def test_network_is_a_distribution_and_carries_state():
    rng = np.random.default_rng(1)
    net = recurrent_lm.Network.start(rng.random(recurrent_lm.SYMBOLS) * 100)
    h = np.repeat(rng.standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32), recurrent_lm.SYMBOLS, 0)
    assert np.exp(net.log_p(h, np.arange(recurrent_lm.SYMBOLS))).sum() == pytest.approx(1, abs=1e-5)
    rows = [np.append(rng.integers(1, recurrent_lm.SYMBOLS, n), 0).astype(np.int16) for n in (0, 1, 5, 40, 7, 900)]

    def alone(r):
        h, x, s = np.zeros((1, recurrent_lm.HIDDEN), np.float32), 0, 0.0
        for w in r:
            h = net.step(net.p["x"][[x]], h)
            s += net.log_p(h, np.array([w]))[0]
            x = w
        return s / math.log(10)

    assert recurrent_lm.score_symbols(net, rows) == pytest.approx([alone(r) for r in rows], abs=1e-3)


@pytest.mark.parametrize("dictionary", [recurrent_lm.DICTIONARY, 50])
def test_scores(docs, monkeypatch, dictionary):
    """The base matches brute force with the rare words in the dictionary and joined; the network beats it."""
    monkeypatch.setattr(recurrent_lm.frequent, "__defaults__", (dictionary,))
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    total, kinds = sum(counts.values()), len(counts)
    got = recurrent_lm.score_documents(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        assert r.base_score == pytest.approx(base, abs=1e-6) and (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out]
    if dictionary > 1000:
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_trained_score_is_the_networks(docs, monkeypatch):
    """The score of a document, symbol by symbol with the trained network, words without a symbol by their unigram share."""
    kept, train = {}, recurrent_lm.train
    monkeypatch.setattr(recurrent_lm, "train", lambda coded, lexicon: kept.setdefault("net", train(coded, kept.setdefault("lexicon", lexicon))))
    rows = docs.collect()
    got = {r.doc_id: r for r in recurrent_lm.score_documents(docs).collect()}
    net, lexicon = kept["net"], kept["lexicon"]
    counts = Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 for w in [*(r.text or "").encode().lower().split(), b""])
    base = lambda w: math.log10((counts[w] + 0.1) / lexicon.floor)
    symbol = {w: int(lexicon.symbol[k]) for w, k in lexicon.words.items() if lexicon.symbol[k] != recurrent_lm.OTHER}
    inside = sum(10 ** base(w) for w in symbol)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:: len(rows) // 6]:
        h, x, total = np.zeros((1, recurrent_lm.HIDDEN), np.float32), recurrent_lm.END, 0.0
        for w in [*(r.text or "").encode().lower().split(), b""]:
            h = net.step(net.p["x"][[x]], h)
            x = symbol.get(w, recurrent_lm.OTHER)
            total += net.log_p(h, np.array([x]))[0] / math.log(10) + (base(w) - math.log10(1 - inside) if x == recurrent_lm.OTHER else 0.0)
        assert got[r.doc_id].score == pytest.approx(total, rel=1e-4, abs=2e-3)
    assert sum(r.score - r.base_score for r in got.values() if r.held_out) / sum(r.n_tokens for r in got.values() if r.held_out) > 0.02


def test_lanes_give_every_token_once():
    rng = np.random.default_rng(2)
    rows = [np.append(rng.integers(1, 9, n), 0) for n in (0, 700, 1, 2, 33, 5, 0, 64, 63, 1300)]
    for lanes, window in ((1, 4), (3, 16), (64, 8)):
        out, last = {k: [] for k in range(len(rows))}, None
        for kept, ids, target, owner in recurrent_lm.Lanes(enumerate(rows), lanes, window):
            before = np.zeros(ids.shape[1], dtype=int) if kept is None else last[kept]
            assert (ids[0] == before).all() and (ids[1:] == target[:-1]).all()
            for t, own in zip(target.T.tolist(), owner.T.tolist()):
                for s, k in zip(t, own):
                    if k >= 0:
                        out[k].append(s)
            last = target[-1]
        assert all(out[k] == r.tolist() for k, r in enumerate(rows))


def test_training_reads_whole_texts():
    """Every token of every text is trained on in each epoch, long texts too."""
    texts = [" ".join(f"w{k % 9}" for k in range(n)) for n in (0, 1, 31, 32, 33, 700)]
    counts = Counter(w for t in texts for w in [*t.split(), ""])
    words = [("", counts.pop("")), *counts.most_common()]
    total = sum(n for _, n in words)
    lexicon = recurrent_lm.Lexicon(words, total, len(words))
    made = recurrent_lm._symbols(lexicon)
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    rows = pd.concat([b.to_pandas() for b in made([batch])])
    assert sum(len(x) // 2 - 1 for x in rows.iloc[:, 1]) == total
    net = recurrent_lm.Network.start(lexicon.counts)
    assert next(recurrent_lm._training(net.pack())(iter([rows])))["n"][0] == total


def test_training_is_the_same_at_every_size(spark, docs, monkeypatch):
    """All tokens are in one of ROUNDS parts, with few shards and many; networks are averaged in groups like all at once."""
    seen = []
    average = recurrent_lm.averaged
    monkeypatch.setattr(recurrent_lm, "averaged", lambda nets: (seen.append((nets.count(), nets.agg(F.sum("n")).first()[0] or 0)), average(nets))[1])
    for shard, many in ((4_000_000, 1), (2000, 4)):
        monkeypatch.setattr(recurrent_lm, "SHARD_TOKENS", shard)
        seen.clear()
        got = recurrent_lm.score_documents(docs).agg(F.max("train_tokens").alias("n"), F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
        assert len(seen) == recurrent_lm.ROUNDS and sum(n for _, n in seen) == got.n and min(k for k, _ in seen) >= many
        assert got.score == got.score
    rng = np.random.default_rng(1)
    rows = [(int(n), rng.random(50).astype(np.float32).tobytes()) for n in rng.integers(1, 9, 30)]
    nets = spark.createDataFrame(rows, "n long, net binary")
    want = sum(np.frombuffer(b, np.float32).astype(float) * n for n, b in rows) / sum(n for n, _ in rows)
    for fan in (2, 7, 64):
        monkeypatch.setattr(recurrent_lm, "FAN", fan)
        assert np.allclose(np.frombuffer(average(nets), np.float32), want, atol=1e-6)
    assert average(nets.limit(0)) is None


def test_lm_edges(spark, edges, empty):
    got = recurrent_lm.score_documents(edges).collect()
    assert len(got) == edges.count() and all(math.isfinite(r.score) and r.score <= 1e-6 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert recurrent_lm.score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = recurrent_lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (only.n_known, only.train_tokens, only.base_score, only.score) == (0, 0, 0.0, 0.0)


# ---- pieces


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.load_pieces()


def every_segmentation(vocab, pieces, text):
    marked = piece_sampling.MARK + text.replace(" ", piece_sampling.MARK) if text else ""
    table = {p: i for i, (p, _) in enumerate(pieces) if not p.startswith("<0x") and p not in ("<unk>", "<s>", "</s>")}

    def rest(k):
        if k == len(marked):
            yield (), 0.0
        for n in range(1, min(16, len(marked) - k) + 1):
            part = marked[k : k + n]
            if part in table:
                e, w = (table[part],), vocab.weight[table[part]]
            elif n == 1:
                e, w = tuple(int(vocab.bytes_at[c]) for c in part.encode()), vocab.byte_weight * len(part.encode())
            else:
                continue
            for more, v in rest(k + n):
                yield e + more, w + v

    return dict(rest(0))


@pytest.mark.parametrize("text", ["hi the", "a\nb  c", "é€", "the", ""])
def test_samples_follow_the_lattice(pieces, text):
    s = piece_sampling.Segmenter(pieces, 3)
    every = every_segmentation(s.vocab, pieces, text)
    z = np.logaddexp.reduce(list(every.values()))
    n = 3000
    got = s.sample([k * 7919 for k in range(n)], [text] * n)
    p = {k: math.exp(v - z) for k, v in every.items()}
    for r in got:
        ids = [tuple(x[0].tolist()) for x in r]
        assert len(set(ids)) == len(ids) == min(3, len(every)) and all(abs(x[1] - (every[i] - z)) < 1e-6 for i, x in zip(ids, r))
        assert all(a[2] >= b[2] for a, b in zip(r, r[1:])) and all(x[3] <= 0 for x in r)
    first = Counter(tuple(r[0][0].tolist()) for r in got)
    two = Counter(tuple(x[0].tolist()) for r in got for x in r[:2])
    for k in sorted(p, key=p.get)[-4:]:
        assert abs(first[k] / n - p[k]) < 5 * math.sqrt(p[k] * (1 - p[k]) / n) + 1e-3
        want = p[k] + sum(q * p[k] / (1 - q) for i, q in p.items() if i != k and q < 1 - 1e-12)
        assert abs(two[k] / n - want) < 5 * math.sqrt(max(0, want * (1 - want)) / n) + 3e-3


def test_round_trip_and_reproduction(spark, docs, pieces):
    rows = piece_sampling.encode_samples(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = piece_sampling.decode(rows).collect()
    assert all(r.decoded == texts[r.doc_id] and r.n_pieces == len(r.ids) for r in got)
    assert {r.doc_id for r in got if r.sample == 1} == set(texts)
    few = docs.where("doc_id % 7 = 0")  # other batches, same samples
    again = {(r.doc_id, r.sample): tuple(r.ids) for r in piece_sampling.encode_samples(few).collect()}
    assert again == {(r.doc_id, r.sample): tuple(r.ids) for r in got if r.doc_id % 7 == 0}


def test_piece_edges(edges, empty, pieces):
    got = piece_sampling.decode(piece_sampling.encode_samples(edges)).collect()
    texts = [(r.doc_id, r.text or "") for r in edges.collect()]
    assert {(r.doc_id, r.decoded) for r in got} == set(texts)
    assert piece_sampling.encode_samples(empty).count() == 0
    s = piece_sampling.Segmenter(pieces, 2)
    for t in ("", " ", "  a  ", "▁x ▁▁", "a\t\n b", "日本 語 😀", " lead", "x" * 3000, "a\U0010ffffb", "\U0010ffff ▁\U0010ffff▁"):
        assert all(piece_sampling.decoded(s.vocab.raw, x[0]) == t for x in s.sample([5], [t])[0])


def test_kept_lattices_change_no_sample(pieces, docs):
    """Units that a worker keeps from earlier batches have the same samples as new ones."""
    texts = [r.text or "" for r in docs.collect()][:60]
    kept, fresh = piece_sampling.Segmenter(pieces, 2), [piece_sampling.Segmenter(pieces, 2) for _ in range(3)]
    for lot in range(3):
        part = texts[lot * 20 : lot * 20 + 40]
        a, b = kept.sample(list(range(len(part))), part), fresh[lot].sample(list(range(len(part))), part)
        assert all((x[0] == y[0]).all() and x[1:] == pytest.approx(y[1:]) for r, q in zip(a, b) for x, y in zip(r, q))
    assert len(kept.known) > 100 and not fresh[0].known


def test_round_trip_flag_and_copies(spark):
    text = "a row of words that has many segmentations, one more than once"
    rows = spark.createDataFrame([(1, text), (1, text), (2, "\U0010ffff▁ x"), (3, None)], "doc_id long, text string").coalesce(1)
    got = piece_sampling.encode_samples(rows).collect()
    assert all(r.round_trip for r in got)
    firsts = [(tuple(r.ids), r.perturbed) for r in got if r.doc_id == 1 and r.sample == 1]
    assert len(firsts) == 2 and firsts[0] != firsts[1]  # copies have samples of their own


def test_copies_have_the_same_samples_in_any_order(spark, tmp_path):
    rows = [(i, f"text of document {i} with some words to cut up") for i in range(6)]
    rows += [rows[1]] * 4 + [rows[2]] + [(3, "another text of the same id")] + [(None, "no id")] * 3 + [(None, None)] * 2
    found = []
    for k in range(3):
        random.Random(k).shuffle(rows)
        spark.createDataFrame(rows, "doc_id long, text string").repartition(k + 1).write.parquet(path := str(tmp_path / str(k)))
        got = piece_sampling.encode_samples(spark.read.parquet(path)).collect()
        found.append(sorted((r.doc_id or -1, r.sample, tuple(r.ids), round(r.log_prob, 9), round(r.perturbed, 9)) for r in got))
        ones = {r.perturbed for r in got if r.doc_id == 1 and r.sample == 1}
        assert len(ones) == 5
    assert found[0] == found[1] == found[2]


def test_session_settings_stay(spark, docs):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    piece_sampling.encode_samples(docs.limit(5)).count()
    language_id.identify(docs).count()
    assert [spark.conf.get(k) for k in keys] == before


def test_language_labels_are_bounded(spark):
    rows = spark.createDataFrame([(k, "der die das und ein" if k % 2 else "the and of a to", ("de" if k % 2 else "en") if k < 60 else f"odd{k}") for k in range(90)], "doc_id long, text string, lang string")
    assert language_id.learn(rows, max_langs=2).langs == ["de", "en"]
    assert len(language_id.learn(rows).langs) > 10


# ---- pipeline


def test_pipeline(spark, docs, edges, empty, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "encoding"]
    for name, rows in (("docs", docs), ("edges", edges), ("empty", empty)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, sf)
            if k < 4:
                assert out.columns == rows.columns
            out.write.parquet(path := str(tmp_path / f"{name}{k}"))
            before, rows = rows, spark.read.parquet(path)
            if k < 3:
                assert rows.count() <= before.count()
        assert (rows.count() > 0) == (name != "empty")
    kept = spark.read.parquet(str(tmp_path / "docs0"))
    assert kept.count() >= 0.98 * docs.count()


def test_queries_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{k}" for k in range(1, 14)] and set(queries.ORACLE) <= set(queries.QUERIES)


def test_encoding_takes_few_words_at_a_time(monkeypatch):
    """What a worker holds besides its vocabulary follows the words it segments at a time."""

    seen, own = [], piece_sampling.Segmenter.sample
    monkeypatch.setattr(piece_sampling.Segmenter, "sample", lambda self, keys, texts: seen.append(sum(len(t.split()) for t in texts)) or own(self, keys, texts))
    texts = [" ".join(f"w{k % 97}" for k in range(2000))] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array(texts)], names=["doc_id", "key", "text"])
    made = sum(b.num_rows for b in piece_sampling._encoder(piece_sampling.Vocabulary(piece_sampling.load_pieces()), 2)([batch]))
    assert made == 80 and sum(seen) == 80_000 and max(seen) <= 50_000
