"""Relational operators on small tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.text import exact_match
from skein.operators import candidates, gates, pairing, rendering, scoring, splits
from skein.operators.ordering import with_ordinals

TURNS = "conv_id long, turn long, role string, text string"


def turns(spark, *rows):
    return spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(rows)], TURNS)


def test_first_response(spark):
    t = turns(spark, ("assistant", "early"), ("user", "first question"), ("assistant", None), ("tool", "x"), ("assistant", "one"), ("assistant", "two"), ("user", "short"), ("assistant", "lost"), ("user", "second question"), ("user", "third password=abc"), ("user", "fourth question"), ("assistant", "token=0123456789"))
    got = {r.task_input: r.assistant_response for r in pairing.pair_first_response(t).collect()}
    assert got == {"first question": "one", "second question": ""}


def test_all_responses(spark):
    t = turns(spark, ("assistant", "early"), ("user", "q"), ("assistant", "one"), ("assistant", ""), ("assistant", "two"), ("user", ""), ("assistant", "lost"), ("user", "unanswered"), ("user", "secret=x"), ("assistant", "a"), ("user", "last"), ("assistant", "b"))
    assert {r.task_input: r.assistant_response for r in pairing.pair_all_responses(t).collect()} == {"q": "one\ntwo", "last": "b"}


def test_long_conversation_is_cut_into_blocks(spark):
    n = 3 * pairing.BLOCK
    t = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("message no "), F.col("id").cast("string")).alias("text"))
    got = pairing.pair_first_response(t)
    assert got.count() == n // 3
    assert got.where(F.concat(F.lit("message no "), (F.col("turn") + 1).cast("string")) != F.col("assistant_response")).count() == 0


@pytest.mark.parametrize("n, sizes", [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (5, (2, 1, 2)), (10, (5, 2, 3)), (20, (10, 5, 5))])
def test_split_sizes(spark, n, sizes):
    got = {r.split: r["count"] for r in splits.split_members(spark.range(n), "id").groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "val", "holdout")) == sizes


def test_candidates(spark):
    rows = spark.range(100)
    few = candidates.cap_candidates(rows, F.col("id") < 3, "id", 10).orderBy("ord").collect()
    assert [r.id for r in few[:3]] == [0, 1, 2] and len(few) == 23 and len({r.id for r in few}) == 23 and [r.ord for r in few] == list(range(23))
    many = candidates.cap_candidates(rows, F.col("id") < 50, "id", 10).orderBy("ord").collect()
    assert [r.id for r in many] == list(range(30))


def test_remainder_keeps_equal_texts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, text string")
    assert sorted(r.k for r in candidates.remainder(rows, rows.where("k = 1"), "k").collect()) == [2, 3]


def test_rates_and_regression(spark):
    p = spark.createDataFrame([("memory", " Memory"), ("memory", "memory"), ("memory", "x"), ("terminal", "terminal"), ("terminal", "")], "correct_tool string, selected_tool string")
    assert {r.tool: r.rate for r in scoring.group_accuracy(p).collect()} == pytest.approx({"memory": 2 / 3, "terminal": 0.5})
    assert scoring.group_accuracy(p.limit(0)).count() == 0
    assert tuple(scoring.overall_accuracy(p).first()) == (5, 3, 0.6) and tuple(scoring.overall_accuracy(p.where("false")).first()) == (0, 0, 0.0)
    assert tuple(scoring.mean_score(spark.createDataFrame([], "score double")).first()) == (0, 0.0)
    base = spark.createDataFrame([("a", 0.8), ("b", 0.8), ("c", 0.8), ("d", 0.8), ("gone", 0.5)], "tool string, rate double")
    after = spark.createDataFrame([("a", 0.79), ("b", 0.78), ("c", 0.7799), ("d", 0.77), ("new", 0.0)], "tool string, rate double")
    rates = scoring.compare_rates(base, after)
    assert {r.tool for r in scoring.regressions(rates).where("regressed").collect()} == {"c", "d", "gone"}
    v = scoring.regression_verdict(rates).first()
    assert (v.passed, v.n_tools, v.regressed_tools) == (False, 5, "c,d,gone")
    assert scoring.regression_verdict(rates.where("tool = 'b'")).first().passed


def test_coverage_names_pairs(spark):
    tools = spark.createDataFrame([(0, "A"), (1, "b "), (2, "a"), (3, "None")], "ord int, tool string")
    ex = spark.createDataFrame([("A",)] * 5 + [("b ",)], "correct_tool string")
    assert [(r.tool, r.n) for r in scoring.coverage(tools, ex).collect()] == [("b ", 1), ("a", 0), ("None", 0)]
    names = spark.createDataFrame([(" B",), ("a",), ("zzz",)], "name string")
    assert {r.name: r.resolved for r in scoring.resolve_names(names, tools).collect()} == {" B": "b ", "a": "A"}
    pairs = spark.createDataFrame([(1, ["a", "B"]), (2, ["a"]), (3, ["a", "nope"]), (4, ["a", "A"])], "id int, tools array<string>")
    assert {(r.id, r.tool_a, r.tool_b) for r in scoring.resolve_pairs(pairs, tools).collect()} == {(1, "A", "b "), (4, "A", "A")}


def test_quotas(spark):
    rows = spark.createDataFrame([("default_agent_identity", 0), ("other", 1)] + [(f"platform_hints.p{k}", 2 + k) for k in range(9)], "section_id string, ord int")
    got = {r.section_id: r.target for r in scoring.quotas(rows).collect()}
    assert got == {"default_agent_identity": 20} | {f"platform_hints.p{k}": 3 if k < 2 else 2 for k in range(9)}


def test_gates(spark):
    head = "---\nname: a\ndescription: b\n---\n"
    rows = spark.createDataFrame([
        (1, "tool_description", "x" * 500, None), (2, "tool_description", "x" * 501, ""), (3, "param_description", "x" * 12, "x" * 10), (4, "other", "x" * 13, "x" * 10),
        (5, "skill", head + "y", "z" * 100), (6, "skill", "no front", None), (7, "skill", "  \n", None), (8, "other", None, None), (9, "skill", "---\nname: a\n---", None),
    ], "id int, artifact_type string, text string, baseline_text string")
    got = {(r.id, r.constraint_name): (r.passed, r.message) for r in gates.gate_report(rows).collect()}
    assert got[1, "size_limit"] == (True, "Size OK: 500/500 chars") and got[2, "size_limit"] == (False, "Size exceeded: 501/500 chars (1 over)")
    assert (2, "growth_limit") not in got and got[3, "growth_limit"] == (True, "Growth OK: +20.0% (max +20.0%)") and got[4, "growth_limit"] == (False, "Growth exceeded: +30.0% (max +20.0%)")
    assert got[5, "growth_limit"][0] and got[5, "skill_structure"][0] and not got[6, "skill_structure"][0] and not got[7, "non_empty"][0] and not got[8, "non_empty"][0]
    assert got[9, "skill_structure"][1] == "Skill missing: description field" and (4, "skill_structure") not in got
    assert {r.id: r.passed for r in gates.all_passed(gates.gate_report(rows), "id").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False, 8: False, 9: False}


def test_rendering(spark):
    tools = spark.createDataFrame([(1, "b", None), (0, "a", "does")], "ord int, tool string, description string")
    assert tuple(rendering.render_tools(tools).first()) == ("- a: does\n- b: Tool: b", "a, b")
    s = spark.createDataFrame([(0, "x", "X"), (1, "y", "Y"), (2, "z", "Z")], "ord int, section_id string, text string")
    assert {r.active: r.context for r in rendering.frozen_context(s).collect()}["y"] == "[x]: X\n\n[z]: Z"
    a = spark.createDataFrame([("k", "1\n2"), ("same", "t"), ("only", "q")], "name string, text string")
    b = spark.createDataFrame([("k", "1\n3"), ("same", "t")], "name string, text string")
    got = rendering.diffs(a, b).collect()
    assert [r.name for r in got] == ["k"] and "-2\n+3" in got[0].diff


def test_empty_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert pairing.pair_first_response(empty).count() == 0 and pairing.pair_all_responses(empty).count() == 0
    assert scoring.regression_verdict(scoring.compare_rates(spark.createDataFrame([], "tool string, rate double"), spark.createDataFrame([], "tool string, rate double"))).first().passed


def test_ordinals(spark):
    """Gapless, by the keys, whatever the ranges; rows of one key keep the input's order and are dealt to all ranges."""
    rows = [(k % 5 if k % 7 else None, "x" if k % 3 else "y", k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, k int").repartition(3)
    for parts in (1, 4, 40):
        got = with_ordinals(df, "-a", "b", "k", name="place", first=1, parts=parts).collect()
        want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))
        assert [tuple(r[:3]) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 501))
    one = with_ordinals(spark.range(10_000).select(F.lit(1).alias("same"), "id", F.lit("_tie").alias("_tie"), F.lit("_at").alias("_at")), "same", parts=8)
    assert one.columns == ["same", "id", "_tie", "_at", "ord"] and all(r.id == r.ord for r in one.collect())
    sizes = [r["count"] for r in one.select(F.floor(F.col("ord") / 1250).alias("eighth")).groupBy("eighth").count().collect()]
    assert sizes == [1250] * 8 and with_ordinals(df.limit(0), "a").count() == 0


def test_planned_classes():
    rng = random.Random(2)
    for _ in range(400):
        sizes = Counter(rng.choice((1, 1, 1, 2, 3, 8, 40)) for _ in range(rng.randrange(1, 60)))
        total = sum(s * n for s, n in sizes.items())
        targets = [max(1, total // 2), max(1, total // 4)]
        targets.append(total - sum(targets))
        takes = splits.planned_classes(list(sizes.items()), targets)
        order = sorted(sizes, reverse=True)
        assert [sum(t) for t in takes] == [sizes[s] for s in order]
        got = [sum(s * t[k] for s, t in zip(order, takes)) for k in range(3)]
        assert all(g - t <= max(order) for g, t in zip(got, targets))
        if sizes[1] >= sum(s for s in order if s > 1) * 3 + 3:  # enough single rows to close all gaps
            assert got == targets


def test_groups_stay_together(spark):
    texts = ["hot"] * 40 + [None] * 5 + [f"pair {k // 2}" for k in range(20)] + [f"one {k}" for k in range(60)]
    rows = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "id int, text string, _key string, split_ string").repartition(5)
    got = splits.split_groups(rows, F.col("text"))
    assert got.columns == [*rows.columns, "split"]
    found = got.collect()
    assert Counter(r.split for r in found) == {"train": 62, "val": 31, "holdout": 32} and len({(r.text, r.split) for r in found}) == len(set(texts))
    assert {(r.id, r.split) for r in splits.split_groups(rows.orderBy("text"), F.col("text")).collect()} == {(r.id, r.split) for r in found}
    assert splits.split_groups(rows.limit(0), F.col("text")).count() == 0 and splits.split_groups(rows.limit(1), F.col("text")).first().split == "train"


def test_spans_cut_contexts(spark):
    rows = [(p, k, f"s{k}", "😀 text " * (k % 3)) for p in range(4) for k in range(p)]
    s = spark.createDataFrame(rows, "p int, ord int, section_id string, text string")
    want = {(p, i): "\n\n".join(f"[{j}]: {u}" for q, _, j, u in rows if q == p and j != i) for p, _, i, _ in rows}
    assert {(r.p, r.active): r.context for r in rendering.frozen_context(s, "p").collect()} == want


def brute_weights(key, replicates, seed="42"):
    """Poisson(1) by the inverse of its distribution function."""
    out = []
    for r in range(replicates):
        u, k, p = int(hashlib.md5(f"{key}:{seed}:{r // 4}".encode()).hexdigest()[r % 4 * 8 :][:8], 16) / 2**32, 0, math.exp(-1)
        total = p
        while u >= total and k < 10:
            k += 1
            p /= k
            total += p
        out.append(k)
    return out


def test_rate_intervals_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", "a", None]), rng.choice(["a", "b"]), rng.choice(["a", "b", None])) for k in range(300)] + [(300, "rare", "rare", "x")]
    paired = spark.createDataFrame(rows, "id long, correct_tool string, baseline_tool string, evolved_tool string").repartition(5)
    got = {r.tool: r for r in scoring.regression_report(scoring.rate_intervals(paired, "id", replicates=50)).collect()}
    norm = lambda x: (x or "").strip().lower()
    hit = {k: (norm(c) == norm(b)) - (norm(c) == norm(e)) for k, c, b, e in rows}
    exact = {r.k: r.lost for r in paired.select(F.col("id").alias("k"), (exact_match(F.col("correct_tool"), F.col("baseline_tool")).cast("long") - exact_match(F.col("correct_tool"), F.col("evolved_tool")).cast("long")).alias("lost")).collect()}
    assert exact == hit
    weights = {k: brute_weights(k, 50) for k, *_ in rows}
    for tool in {c for _, c, *_ in rows}:
        own = [k for k, c, *_ in rows if c == tool]
        deltas = []
        for r in range(50):
            n = sum(weights[k][r] for k in own)
            if n:
                deltas.append(sum(weights[k][r] * hit[k] for k in own) / n)
        low, high = np.quantile(deltas, [0.025, 0.975])
        r = got[tool]
        assert (r.n, r.delta, r.low, r.high) == (len(own), pytest.approx(sum(hit[k] for k in own) / len(own)), pytest.approx(low), pytest.approx(high))
        assert r.regressed == (r.delta > 0.02) and r.certain == ((r.low > 0.02) if r.regressed else (r.high <= 0.02))
    every = [w for k in range(4000) for w in brute_weights(k, 4)]
    assert abs(sum(every) / len(every) - 1) < 0.03 and scoring.rate_intervals(paired.limit(0), "id").count() == 0
