"""Whole flows with the offline model, the judge's columns, the registered queries, and the stream."""

import datetime
import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skein import queries
from skein.operators import pairing, rendering
from skein.plans import answers, flows, generate, judge
from skein.streaming.events import pair_stream
from skein.streaming.pairs import Pairer, pair_events, state_store


def relevance_model(requests):
    """By message: good, bad JSON, a failure, or not relevant."""
    out = []
    for r in requests:
        m = r["message"]
        if "fail" in m:
            out.append(RuntimeError("down"))
        elif "junk" in m:
            out.append({"scoring": "no json"})
        else:
            out.append({"scoring": "Sure: " + json.dumps({"relevant": "skip" not in m, "expected_behavior": " do ", "difficulty": "HARD", "category": ""})})
    return out


def _messages(spark, *texts):
    return spark.createDataFrame([(k, t, "sessions", "") for k, t in enumerate(texts)], "key long, task_input string, source string, assistant_response string")


def test_mining(spark):
    m = _messages(spark, "good deploy", "junk deploy", "fail deploy", "skip deploy", "good other", None)
    got = flows.mine(m, "deploy", "", "key", relevance_model, most=5).orderBy("key").collect()
    assert [(r.key, r.difficulty, r.category, r.expected_behavior) for r in got] == [(0, "hard", "general", "do"), (4, "hard", "general", "do")]
    scored = judge.score_relevance(m.where("task_input IS NOT NULL"), relevance_model, "skill")
    assert {r.key for r in scored.where("failed").collect()} == {1, 2}


def test_mining_stops_early(spark):
    m = _messages(spark, *[f"deploy {k}" for k in range(40)])
    got = flows.mine(m, "deploy", "", "key", relevance_model, most=10, chunk=5)
    assert [r.key for r in got.orderBy("ord").collect()] == list(range(10))
    splits = flows.mined_splits(got, "key")
    assert {r.split: r["count"] for r in splits.groupBy("split").count().collect()} == {"train": 5, "val": 2, "holdout": 3}
    with pytest.raises(ValueError):
        flows.mined_splits(got.limit(2), "key")


class Counting:
    """A model that leaves a file for each request it gets."""

    def __init__(self, folder, inner):
        self.folder, self.inner = str(folder), inner

    def __call__(self, requests):
        for r in requests:
            Path(self.folder, uuid.uuid4().hex).write_text(json.dumps(r))
        return self.inner(requests)

    def asked(self):
        return [json.loads(p.read_text()) for p in Path(self.folder).iterdir()]


@pytest.mark.parametrize("skip", [0, 1, 3, 9])
def test_mining_asks_about_few(spark, tmp_path, skip):
    """The same examples as asking one at a time, with fewer than twice the calls; `skip` of each ten candidates are refused."""
    texts = [f"{'skip' if k % 10 < skip else 'take'} deploy {k}" for k in range(60)]
    model = Counting(tmp_path, relevance_model)
    got = flows.mine(_messages(spark, *texts), "deploy", "", "key", model, most=20).orderBy("ord").collect()
    accepted = [k for k, t in enumerate(texts) if t.startswith("take")]
    assert [r.key for r in got] == accepted[:20]
    one_by_one = accepted[19] + 1 if len(accepted) >= 20 else 60
    assert len(got) == min(20, len(accepted)) and one_by_one <= len(model.asked()) < 2 * one_by_one
    assert flows.mine(_messages(spark), "deploy", "", "key", model, most=20).count() == 0


def test_chunks_are_bounded():
    for most in (1, 7, 50):
        for asked in range(200):
            for accepted in range(min(asked, most - 1) + 1):
                n = flows.next_chunk(asked, accepted, most)
                assert most - accepted <= n <= max(most - accepted, asked)


def test_stored_answers(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    model = Counting(tmp_path / "calls", lambda rs: [RuntimeError("down") if r["message"] == "bad" and r["extra"] == "" else {"out": r["message"] + "!", "more": None} for r in rs])
    stored = answers.Stored(model, str(tmp_path / "kept"), "m1")
    rows = spark.createDataFrame([(k, m, 1.5 if k % 2 else None, "x", "y") for k, m in enumerate(["a", "b", "a", "bad", "b", "a", None, "", "bad"])], "key long, message string, extra double, _digest string, digest string").repartition(3)

    def run(df=rows, store=stored):
        got = judge.ask(df, store, "t", {"message": "message", "extra": "extra"}, ["out", "more"])
        assert got.columns == [*df.columns, "out", "more", "failed"]
        return {r.key: (r.out, r.failed) for r in got.collect()}

    want = {0: ("a!", False), 1: ("b!", False), 2: ("a!", False), 3: ("bad!", False), 4: ("b!", False), 5: ("a!", False), 6: ("!", False), 7: ("!", False), 8: (None, True)}
    assert run() == want
    assert sorted((r["message"], r["extra"]) for r in model.asked()) == [("", ""), ("", "1.5"), ("a", ""), ("a", "1.5"), ("b", ""), ("b", "1.5"), ("bad", ""), ("bad", "1.5")]
    assert run() == want and len(model.asked()) == 9  # the failed one alone again
    fresh = answers.Stored(lambda rs: [ValueError("no call") for _ in rs], str(tmp_path / "kept"), "m1")
    assert run(rows.where("key <> 8"), fresh) == {k: v for k, v in want.items() if k != 8}
    assert run(store=answers.Stored(model, str(tmp_path / "kept"), "m2")) == want and len(model.asked()) == 17
    (tmp_path / "kept" / "task=t" / "batch=open").mkdir()  # of a job that did not end
    before = stored.answers(spark, "t").count()
    stored.compact(spark, "t")
    assert stored.answers(spark, "t").count() == before == 14 and len(list((tmp_path / "kept" / "task=t").iterdir())) == 1
    assert run(rows.limit(0)) == {}


def test_judged_tools(spark):
    tools = spark.createDataFrame([(0, "search", "find words in files"), (1, "deploy", "ship the service")], "ord int, tool string, description string")
    worse = tools.withColumn("description", F.when(F.col("tool") == "deploy", "x" * 600).otherwise(F.col("description")))
    hold = spark.createDataFrame([("find words", "search"), ("ship service", "deploy")], "task_description string, correct_tool string")
    same = flows.judge_tools(tools, tools, hold)
    assert same["verdict"].first().passed and same["passed"].where("NOT passed").count() == 0 and {r.rate for r in same["accuracy"].collect()} == {1.0}
    bad = flows.judge_tools(tools, worse, hold)
    assert bad["verdict"].first().regressed_tools == "deploy" and [r.tool for r in bad["passed"].where("NOT passed").collect()] == ["deploy"]


def test_judged_sections_and_skill(spark):
    s = spark.createDataFrame([(0, "a", "be kind"), (1, "b", "be short")], "ord int, section_id string, text string")
    hold = spark.createDataFrame([("a", "hello", "be kind hello")], "section_id string, user_message string, expected_behavior string")
    got = flows.judge_sections(s, s.withColumn("text", F.lit("none")), hold)
    scores = {r.which: r["mean"] for r in got["scores"].collect()}
    assert scores["baseline"] > scores["evolved"] and got["gates"].count() == 4
    skill = spark.createDataFrame([("n", "---\nname: n\ndescription: d\n---\n\nbody\n", "name: n\ndescription: d")], "name string, raw string, frontmatter string")
    tasks = spark.createDataFrame([("do it", "do it")], "task_input string, expected_behavior string")
    out = flows.judge_skill(skill, "new body " * 9, tasks)
    assert out["passed"].where("passed").count() == 0  # grew by over a fifth
    assert out["gates"].where("constraint_name = 'skill_structure' AND passed").count() == 1
    assert flows.judge_skill(skill, "body", tasks)["passed"].first().passed


def test_claims_fail_closed(spark):
    pairs = spark.createDataFrame([("ok",), ("false claims",), ("unclear",), ("error",)], "original string").withColumn("evolved", F.col("original"))

    def model(requests):
        said = {"ok": {"verdict": "False"}, "false claims": {"verdict": "True"}, "unclear": {"verdict": "hm"}, "error": ValueError()}
        return [said[r["original"]] for r in requests]

    assert {r.original: r.factual_ok for r in judge.check_claims(pairs, model).collect()} == {"ok": True, "false claims": False, "unclear": False, "error": False}
    assert {r.original: r.role_ok for r in judge.check_role(pairs, model).collect()} == {"ok": False, "false claims": True, "unclear": False, "error": False}


def test_generation_and_metric(spark):
    subjects = spark.createDataFrame([("t", "about", "2", "easy")], "name string, about string, n string, level string")
    got = judge.generate_examples(subjects, judge.OfflineModel(), "name", "about", "n", "level").collect()
    assert len(got) == 2 and got[0].difficulty == "easy"
    rows = spark.createDataFrame([("t", "a b", "a b", "s"), ("t", "a b", " ", "s")], "task_input string, expected string, output string, skill string")
    for quick in (True, False):
        assert {r.output: r.score for r in judge.metric(rows, judge.OfflineModel(), "expected", "output", quick).collect()} == {"a b": 1.0, " ": 0.0}


def test_queries_have_sql():
    assert set(queries.ORACLE) == set(queries.QUERIES)


def test_stream(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    one = [(1, 0, "user", "q1"), (1, 1, "assistant", "a"), (2, 0, "assistant", "early"), (2, 1, "user", "x")]
    two = [(1, 2, "assistant", "b"), (1, 3, "user", "q2"), (2, 2, "user", "y"), (2, 3, "assistant", "z"), (2, 4, "user", "end")]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a timeout in processing time asks for empty batches without end
    out = str(tmp_path / "out")

    def run():
        stream = pair_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(60)
        finally:
            query.stop()

    for rows in (one, two):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, 0, "q1", "a\nb"), (2, 2, "y", "z")}


def test_keys_cross_a_call_unchanged(spark):
    """Long keys beside a null keep all their bits."""
    keys = [2**53 + 1, 2**53 + 3, None, 7]
    rows = spark.createDataFrame([(k, "m", 1.5, [k or 0]) for k in keys], "key long, message string, x double, list array<long>").coalesce(1)
    got = judge.ask(rows, lambda requests: [{"out": r["message"]} for r in requests], "t", {"message": "message"}, ["out"]).collect()
    assert sorted((r.key or 0, r.out, r.list[0], r.failed) for r in got) == sorted((k or 0, "m", k or 0, False) for k in keys)


TOOLS = [(0, "Read", "reads a file"), (1, "write ", "writes a file"), (2, "READ", "the second of its name"), (3, "run", "runs a command")]


class Writer:
    """Answers by tool: some fail, some hold no array, some name tools that do not exist."""

    def __call__(self, requests):
        return [getattr(self, r["task"])(r) for r in requests]

    def similar(self, r):
        return {"pairs": json.dumps([{"tools": ["read", "WRITE"], "overlap": "files"}, {"tools": ["read"]}, {"tools": ["read", "gone"]}, {"tools": ["run", "run"]}, 5])}

    def tool_tasks(self, r):
        if r["name"] == "run" and r["level"] == "hard":
            return RuntimeError("down")
        if r["name"] == "run":
            return {"tasks": "no array"}
        return {"tasks": json.dumps([{"task_description": f"{r['name']} {r['level']}", "confuser_tools": ["run"], "correct_params": {"a": [1]}}, {"correct_tool": "x"}, {"task_description": "  "}][: int(r["n"])])}

    def confuser_tasks(self, r):
        return {"tasks": json.dumps([{"task_description": "which", "correct_tool": " read ", "reason": "why"}, {"task_description": "other", "correct_tool": "Write"}, {"task_description": "none", "correct_tool": "zz"}])}


def test_tool_dataset(spark):
    tools = spark.createDataFrame(TOOLS, "ord int, tool string, description string")
    pairs = generate.similar_tools(tools, Writer())
    assert [(r.tools, r.overlap) for r in pairs.collect()] == [(["read", "WRITE"], "files"), (["read"], ""), (["read", "gone"], ""), (["run", "run"], "")]
    own = generate.tool_tasks(tools, Writer()).collect()
    assert {(r.correct_tool, r.difficulty) for r in own} == {(t, d) for t in ("Read", "write ") for d in ("easy", "medium", "hard")}
    assert len(own) == 3 * (2 + 3 + 1) and {r.correct_params for r in own} == {'{"a":[1]}', "{}"} and {tuple(r.confuser_tools) for r in own} == {("run",), ()}
    hard = generate.confuser_tasks(pairs, tools, Writer()).collect()
    assert sorted((r.correct_tool, r.confuser_tools[0], r.reason) for r in hard) == [("Read", "run", ""), ("Read", "run", "why")][1:] + [("Read", "write ", "why"), ("write ", "Read", ""), ("write ", "run", "")]
    few = generate.supplement(generate.tool_tasks(tools, Writer()), tools, Writer()).collect()
    assert {r.correct_tool for r in few} == {"READ"} and all(r.confuser_tools == [] and r.difficulty == "medium" for r in few)
    every = generate.tool_dataset(tools, Writer()).collect()
    assert {r.split for r in every} == {"train", "val", "holdout"} and all(r.task_description.strip() for r in every)


def test_scenarios_and_cases(spark):
    sections = spark.createDataFrame([("memory_guidance", 0, "remember"), ("odd", 1, "none"), ("platform_hints.a", 2, "x")], "section_id string, ord int, text string")
    got = generate.section_scenarios(sections, judge.OfflineModel()).collect()
    assert {k: sum(r.section_id == k for r in got) for k in ("memory_guidance", "odd", "platform_hints.a")} == {"memory_guidance": 15, "odd": 0, "platform_hints.a": 20}
    assert {r.difficulty for r in got} == {"easy", "medium"}
    blank = lambda requests: [{"scenarios": '[{"user_message": " "}, {"user_message": "m"}]'} for _ in requests]
    assert {(r.user_message, r.expected_behavior, r.difficulty) for r in generate.section_scenarios(sections, blank).collect()} == {("m", "", "medium")}
    one = spark.createDataFrame([("text", "skill", "3")], "text string, artifact_type string, n string")
    assert [r.task_input for r in generate.test_cases(one, judge.OfflineModel()).collect()] == ["skill 0: text", "skill 1: text", "skill 2: text"]
    some = lambda requests: [{"cases": '[{"task_input": "t", "expected_behavior": "e", "category": "c"}, {"task_input": "t"}, {"expected_behavior": "e"}]'} for _ in requests]
    assert [tuple(r) for r in generate.test_cases(one, some).collect()] == [("t", "e", "medium", "c", "synthetic")]
    for bad in (lambda requests: [{"cases": "nothing"} for _ in requests], lambda requests: [ValueError("down") for _ in requests]):
        with pytest.raises(Exception, match="JSON array|failed"):
            generate.test_cases(one, bad).collect()


def test_saved_runs(spark, tmp_path):
    metrics, evolved = spark.createDataFrame([(1, 0.5)], "n int, mean double"), spark.createDataFrame([("b", "B"), ("a", "A\n1")], "name string, text string")
    changes = spark.createDataFrame([("b", "+B"), ("a", "+A")], "name string, diff string")
    good = rendering.save_run(str(tmp_path), "20260101_000000", metrics, evolved, changes)
    bad = rendering.save_run(str(tmp_path), "20260101_000000", metrics, evolved, changes, failed=True)
    assert bad.endswith("/FAILED_20260101_000000") and not (tmp_path / "FAILED_20260101_000000" / "evolved").exists()
    text = next((tmp_path / "20260101_000000" / "evolved").glob("part-*")).read_text()
    assert json.loads(text) == [{"name": "a", "text": "A\n1"}, {"name": "b", "text": "B"}] and "\n" in text.strip()
    assert next((tmp_path / "20260101_000000" / "diff").glob("part-*")).read_text().splitlines() == ["+A", "+B"]
    assert spark.read.json(f"{good}/metrics").first().status == "OK" and not spark.read.json(f"{bad}/metrics").first().constraints_passed


def test_pairs_by_event_time(spark, tmp_path):
    """Rows in disorder, rows that are too late, silence in event time, a conversation that goes on after it, a restart."""
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    at = lambda minutes: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minutes)
    user, said = (lambda c, t, x, m: (c, t, "user", x, at(m))), (lambda c, t, x, m: (c, t, "assistant", x, at(m)))
    lots = [
        [said(1, 2, "b", 2), user(1, 0, "first question", 0), said(1, 1, "a", 1), user(2, 0, "password=hunter2", 0), said(2, 1, "no", 1)],
        [user(1, 5, "second question", 5), said(1, 4, "d", 4), said(1, 3, None, 3), user(3, 0, "never answered", 6)],
        [said(1, 6, "e", 6), user(4, 0, "far ahead in time", 300)],
        [user(1, 9, "too late a question", 20), said(4, 1, "yes", 301)],
        [user(1, 20, "after the silence", 310), said(1, 21, "f", 311), user(4, 2, "x", 312)],
        [(9, 0, "system", "", at(5000))], [(9, 1, "system", "", at(9000))],
    ]
    got = {}
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    for every in (True, False):
        source, out, state = (str(tmp_path / f"{x}{every}") for x in ("in", "out", "state"))
        for k, lot in enumerate(lots):
            if not every:  # whether a row is late depends on where a query's batches end, which is fixed for W2 only
                lot = [r for r in lot if r[3] != "too late a question"]
            spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(source)
            if not every and k + 1 < len(lots):
                continue  # one query for all lots; for W2 one for each lot, from the state that the one before has left
            stream = pair_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), every=every)
            with state_store(spark):
                run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            assert run.awaitTermination(120)
        got[every] = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    assert got[True] == [(1, 0, "first question", "a\nb\nd"), (1, 5, "second question", "e"), (1, 20, "after the silence", "f"), (4, 0, "far ahead in time", "yes")]
    assert got[False] == [(1, 0, "first question", "a"), (1, 5, "second question", "e"), (1, 20, "after the silence", "f"), (3, 0, "never answered", ""), (4, 0, "far ahead in time", "yes")]


@pytest.mark.parametrize("name", ["w1_replayed_stream", "w2_replayed_stream"])
def test_replay_of_long_conversations(spark, tmp_path, monkeypatch, name):
    """Files and batches go by the rows, not by the longest conversation; no turn is late, whichever files a batch takes."""
    roles = ["user", "assistant", "assistant", "user", "assistant"]
    rows = [(c, t, roles[(t + c) % 5], f"turn {t} of conversation {c}") for c in range(40) for t in range(3 + c % 4)]
    rows += [(100, t, roles[t % 5], f"turn {t} of the long conversation") for t in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    made = {}
    monkeypatch.setattr(queries, "fresh_path", lambda spark, what: made.setdefault(what, str(tmp_path / what)))
    monkeypatch.setattr(queries, "LOT_ROWS", 50, raising=False)
    monkeypatch.setattr(queries, "BATCH_FILES", 1, raising=False)
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert len(list(Path(made["turns"]).glob("part-*"))) <= 20  # 67 lots
    pair = pairing.pair_first_response if name.startswith("w1") else pairing.pair_all_responses
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pair(spark.read.parquet(str(tmp_path / "conversations.parquet"))).collect()))


def test_groups_of_lots():
    assert queries._lot_groups([], 10) == []
    assert queries._lot_groups([(0, 25), (1, 9), (2, 1), (3, 1), (7, 30), (8, 10), (9, 1)], 10) == [(0, 0), (1, 2), (3, 3), (7, 7), (8, 8), (9, 9)]
    assert queries._lot_groups([(k, 1) for k in range(100)], 50) == [(0, 49), (50, 99)]


def test_calls_of_the_state_store():
    """A batch reads and writes a conversation once, however many turns it has; its one timer is set again when it expires early."""

    class Store:
        def __init__(self):
            self.calls, self.value = [], None

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.calls.append("clear")
            self.value = None

        def registerTimer(self, ms):
            self.calls.append(ms)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    rows = lambda *turns: iter([Row(turn=t, role="assistant" if t % 2 else "user", text=f"text {t}", ms=t * 1000) for t in turns])
    store, pairer = Store(), Pairer(10_000, False)
    pairer.init(store)
    steps = [
        (lambda: pairer.handleInputRows((7,), rows(3, 1, 0, 2), At(0)), ["get", "update", 13_000], []),
        (lambda: pairer.handleInputRows((7,), rows(5, 4), At(3000)), ["get", "update"], [(7, 0, "text 0", "text 1")]),
        (lambda: pairer.handleExpiredTimer((7,), At(14_000), None), ["get", 15_000], []),
        (lambda: pairer.handleExpiredTimer((7,), At(16_000), None), ["get", "clear"], [(7, 2, "text 2", "text 3"), (7, 4, "text 4", "text 5")]),
        (lambda: pairer.handleInputRows((7,), rows(40), At(16_000)), ["get", "update", 50_000], []),
    ]
    for step, calls, out in steps:
        store.calls = []
        assert [tuple(r) for r in step()] == out and sorted(map(str, store.calls)) == sorted(map(str, calls))
