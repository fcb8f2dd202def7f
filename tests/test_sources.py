"""File sources and sinks on temporary folders."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions.text import SECRETS
from skein.sources import commits, datasets, sessions, settings, skills, source_code

SECRET = re.compile("|".join(SECRETS), re.I)


def test_history(spark, tmp_path):
    lines = [
        json.dumps({"display": "a long question", "timestamp": 5, "project": "/p", "sessionId": "s"}), "", "{bad", json.dumps({"display": "short"}), json.dumps({"display": "password=hunter2 please"}),
        json.dumps({"display": "another question"}), json.dumps({"timestamp": 1}), json.dumps({"display": ["not", "text", "at all"]}), "[1]",
    ]
    (tmp_path / "h.jsonl").write_text("\n".join(lines))
    got = sessions.read_history(spark, str(tmp_path / "h.jsonl")).collect()
    assert {(r.task_input, r.project, r.session_id, r.timestamp) for r in got} == {("a long question", "/p", "s", 5), ("another question", "", "", 0)}
    assert sessions.read_history(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "many.jsonl").write_text("\n".join(json.dumps({"display": f"question number {i}"}) for i in range(100)))
    assert sessions.read_history(spark, str(tmp_path / "many.jsonl"), limit=5).count() == 5


def _events(folder, *events):
    folder.mkdir(parents=True)
    (folder / "events.jsonl").write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events))


def test_events(spark, tmp_path):
    user, said = (lambda t: {"type": "user.message", "data": {"content": t}}), (lambda t: {"type": "assistant.message", "data": {"content": t}})
    _events(tmp_path / "one", said("early"), user("q1"), said("a"), "{bad", said("b"), user("q2"), user("q3 token=0123456789"), said("c"), {"type": "other"}, user(""), said("lost"), user("q4"), said("secret=1"))
    (tmp_path / "one" / "workspace.yaml").write_text("id: 1\ncwd: /home/x: y \ncwd: /no\n")
    _events(tmp_path / "two words", user("q5"), said("d"))
    _events(tmp_path / "empty")
    got = sessions.read_events(spark, str(tmp_path))
    assert {(r.session_id, r.task_input, r.assistant_response, r.project) for r in got.collect()} == {("one", "q1", "a\nb", "/home/x: y"), ("two words", "q5", "d", "")}
    assert sessions.read_events(spark, str(tmp_path), limit=1).count() == 1
    assert sessions.read_events(spark, str(tmp_path / "none")).count() == 0


def brute_events(lines):
    """The pairs of one file, read line by line; anything that goes wrong ends it."""
    pairs, asked, said = [], None, None

    def save():
        if asked and said:
            if not SECRET.search(asked) and not SECRET.search(said):
                pairs.append((asked, said))

    try:
        for line in lines:
            try:
                event = json.loads(line)
            except ValueError:
                continue
            kind, data = event.get("type", ""), event.get("data", {})
            if kind == "user.message":
                save()
                asked, said = data.get("content", ""), None
            elif kind == "assistant.message":
                content = data.get("content", "")
                if content and asked:
                    if said:
                        said += "\n" + content
                    else:
                        said = content
        save()
    except Exception:
        pass
    return pairs


def test_events_end_at_the_first_failure(spark):
    """All files of up to four events out of these, against brute force."""
    rng = random.Random(3)
    contents = ['"text"', '"more text"', '"secret=1"', '""', "null", "0", "false", "[]", "{}", '["x"]', '{"k": 1}', "7", "true", None]
    events = [json.dumps({"type": "other", "data": 3}), "[1, 2]", "null", '"x"', "{bad", "", "5"]
    for role in ("user", "assistant"):
        events += [f'{{"type": "{role}.message", "data": {{"content": {c}}}}}' if c is not None else f'{{"type": "{role}.message", "data": {{}}}}' for c in contents]
        events += [f'{{"type": "{role}.message"}}'] + [f'{{"type": "{role}.message", "data": {d}}}' for d in ("null", '"t"', "[1]")]
    plain = [f'{{"type": "{r}.message", "data": {{"content": "{r} {k}"}}}}' for r in ("user", "assistant") for k in range(3)]
    files = [(str(k), [rng.choice(plain if rng.random() < 0.6 else events) for _ in range(rng.randrange(9))]) for k in range(1500)]
    table = spark.createDataFrame([(k, rng.choice(("\n", "\r\n")).join(x)) for k, x in files], "session_id string, value string")
    got = {}
    for r in sessions.parse_events(table, spark.createDataFrame([], "session_id string, project string")).orderBy("session_id", "turn").collect():
        got.setdefault(r.session_id, []).append((r.task_input, r.assistant_response))
    want = {k: brute_events(x) for k, x in files}
    assert got == {k: x for k, x in want.items() if x} and len(got) > 200


def test_session_files(spark, tmp_path):
    def put(name, data, when):
        (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data))
        os.utime(tmp_path / name, (when, when))

    m = lambda *t: [{"role": r, "content": c} for r, c in t]
    put("old.json", {"session_id": "S", "messages": m(("user", "first question"), ("assistant", None), ("tool", "x"), ("assistant", "answer"), ("user", "short"), ("user", "no answer here"))}, 1000)
    put("new.json", {"messages": m(("user", ["parts", "are", "no text"]), ("user", "newest question"), ("assistant", {"k": 1}), ("assistant", "yes"))}, 2000)
    put("bad.json", "{nope", 3000)
    put("none.json", {"messages": []}, 3000)
    got = sessions.read_sessions(spark, str(tmp_path))
    assert {(r.session_id, r.task_input, r.assistant_response) for r in got.collect()} == {("S", "first question", "answer"), ("S", "no answer here", ""), ("new", "newest question", "yes")}
    assert [r.task_input for r in sessions.read_sessions(spark, str(tmp_path), limit=2).collect()] == ["newest question", "first question"]
    both = sessions.read_sources(spark, {"sessions": str(tmp_path)}, ["unknown", "sessions", "events"])
    assert both.count() == 3 and both.columns == sessions.MESSAGE.fieldNames()


def test_datasets(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "e", "easy", "c", "s", "train"), ("t2", "e", None, None, None, "train")], "task_input string, expected_behavior string, difficulty string, category string, source string, split string")
    out = str(tmp_path / "d")
    datasets.save_dataset(rows, out)
    assert [x for x in sorted(os.listdir(commits.current(spark, out))) if "=" in x] == ["split=holdout", "split=train", "split=val"]
    back = {r.task_input: (r.difficulty, r.category, r.source, r.split) for r in datasets.load_dataset(spark, out).collect()}
    assert back == {"t1": ("easy", "c", "s", "train"), "t2": ("medium", "general", "synthetic", "train")}
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps({"task_input": f"t{i}", "expected_behavior": "e", "extra": 1}) for i in range(10)) + "\n\n")
    got = datasets.load_golden(spark, str(tmp_path / "g.jsonl"))
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 5, "val": 2, "holdout": 3}
    with pytest.raises(FileNotFoundError):
        datasets.load_golden(spark, str(tmp_path / "nothing"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "train.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        datasets.load_dataset(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "req.jsonl").write_text('{"task_input": "only"}')
    with pytest.raises(Exception, match="expected_behavior"):
        datasets.read_lines(spark, str(tmp_path / "req.jsonl")).collect()
    (tmp_path / "tool.jsonl").write_text(json.dumps({"task_description": "t", "correct_tool": "x", "correct_params": {"a": {"b": [1]}}, "confuser_tools": ["y"]}))
    tool = datasets.read_lines(spark, str(tmp_path / "tool.jsonl"), "tool").first()
    assert json.loads(tool.correct_params) == {"a": {"b": [1]}} and tool.confuser_tools == ["y"] and tool.difficulty == "medium"


def test_skills(spark, tmp_path):
    raw = "\n---\nname: first\nname: 'my skill'\ndescription: \"a: b\"\n---\n\n# Body\n---\nmore\n"
    (tmp_path / "cat" / "alpha").mkdir(parents=True)
    (tmp_path / "cat" / "alpha" / "SKILL.md").write_text(raw)
    (tmp_path / "beta").mkdir()
    (tmp_path / "beta" / "SKILL.md").write_text("just text")
    s = skills.read_skills(spark, f"{tmp_path}/*/*/SKILL.md").first()
    assert (s.name, s.description, s.body) == ("my skill", "a: b", "# Body\n---\nmore")
    plain = skills.read_skills(spark, f"{tmp_path}/beta/SKILL.md").first()
    assert (plain.frontmatter, plain.body, plain.name) == ("", "just text", "")
    every = skills.read_skills(spark, f"{tmp_path}/*/SKILL.md").unionByName(skills.read_skills(spark, f"{tmp_path}/*/*/SKILL.md"))
    assert skills.find_skill(every, "beta").first().raw == "just text" and skills.find_skill(every, "first").first().name == "my skill" and skills.find_skill(every, "zzz").count() == 0
    assert skills.installed_skill(spark, str(tmp_path), "alpha").first().name == "my skill"
    with pytest.raises(FileNotFoundError):
        skills.installed_skill(spark, str(tmp_path), "gamma")


SOURCE = '''
import registry
LONG = ("variable "
        "text")
# a comment with { and "
ONE_SCHEMA = {
    "name": "one",
    "description": "Says \\"hi\\".",
    "parameters": {"type": "object", "properties": {
        "path": {"type": "string", "description": ("a " "path")},
        "mode": {"enum": ["r", "w"], "description": """Mode"""},
    }, "required": ["path"]},
}
MANY_SCHEMAS = [
    {"name": "two", "description": ("Two "
        "parts {}")},
    {"name": "three", "description": """Triple
quoted"""},
    {"name": "four", "description": LONG},
    {"description": "no name"},
]
other_schema = {"name": "no"}
registry.register(ONE_SCHEMA)
'''


def test_tools(spark, tmp_path):
    (tmp_path / "a.py").write_text(SOURCE)
    (tmp_path / "b.py").write_text("x = 1")
    files = source_code.tool_files(spark, str(tmp_path))
    assert files.count() == 1
    got = {r.name: r for r in source_code.extract_tools(files).collect()}
    assert {k: (v.description, v.desc_format) for k, v in got.items()} == {
        "one": ('Says "hi".', "single_line"), "two": ("Two parts {}", "paren_concat"), "three": ("Triple\nquoted", "triple_quote"), "four": ("variable text", "variable_ref"),
    }
    params = {p.name: p for p in got["one"].params}
    assert params["path"].required and params["path"].type == "string" and params["path"].description == "a path" and params["mode"].enum == ["r", "w"] and not params["mode"].required
    assert source_code.tools_of("x", "not python (") == [] and source_code.tools_of("x", "") == []


@pytest.mark.parametrize("tool", ["one", "two", "three", "four"])
@pytest.mark.parametrize("text", ['new "text" \\ with\nlines\tand quotes"', "x " * 100, "", 'ends with """'])
def test_tool_write_back(tool, text):
    after = source_code.write_tool_description(SOURCE, tool, text)
    got = {t["name"]: t for t in source_code.tools_of("x", after)}
    before = {t["name"]: t for t in source_code.tools_of("x", SOURCE)}
    assert got.pop(tool)["description"] == text
    before.pop(tool)
    assert got == before
    with pytest.raises(KeyError):
        source_code.write_tool_description(SOURCE, "nope", text)


PROMPT = '''"""Doc."""
DEFAULT_AGENT_IDENTITY = (
    "You are é "
    "an agent."
)
MEMORY_GUIDANCE = "Remember."
OTHER = "no"
PLATFORM_HINTS = {"chat": "Be short.",
    "mail": (
        "Be "
        "polite."
    ),
    "n": 1}
'''


def test_sections(spark):
    files = spark.createDataFrame([("p.py", PROMPT)], "path string, source string")
    got = source_code.extract_sections(files).collect()
    assert [(r.section_id, r.text, r.char_count) for r in got] == [("default_agent_identity", "You are é an agent.", 19), ("memory_guidance", "Remember.", 9), ("platform_hints.chat", "Be short.", 9), ("platform_hints.mail", "Be polite.", 10)]
    after = PROMPT
    for r in got:
        after = source_code.write_section(after, r.section_id, f"new é {r.section_id} " * 9)
    assert [(s["section_id"], s["text"]) for s in source_code.sections_of("p.py", after)] == [(r.section_id, f"new é {r.section_id} " * 9) for r in got]
    with pytest.raises(KeyError):
        source_code.write_section(PROMPT, "platform_hints.none", "x")
    odd = spark.createDataFrame([("a.py", "not python ("), ("b.py", PROMPT), ("c.py", "")], "path string, source string")
    assert source_code.extract_sections(odd).count() == 4  # a file that is no Python has no sections and stops nothing


def test_settings(monkeypatch, tmp_path):
    for k in ("SKEIN_API_BASE", "SKEIN_API_KEY", "SKEIN_MODEL"):
        monkeypatch.delenv(k, raising=False)
    assert settings.load_settings().iterations == 10 and settings.load_settings().service == {}
    assert settings.load_settings(iterations=0).iterations == 10 and settings.load_settings(iterations=3).iterations == 3
    monkeypatch.setenv("SKEIN_MODEL", "env")
    s = settings.load_settings(api_base="http://x")
    assert (s.eval_model, s.judge_model, s.service) == ("env", "env", {"api_base": "http://x"})
    assert settings.load_settings(model="cli").optimizer_model == "cli"


def _example(spark, *names, split="train"):
    return spark.createDataFrame([(n, "e", split) for n in names], "task_input string, expected_behavior string, split string").withColumns({c: F.lit("x") for c in ("difficulty", "category", "source")})


def test_datasets_are_replaced_as_a_whole(spark, tmp_path):
    folder, read = str(tmp_path / "set"), lambda: sorted((r.task_input, r.split) for r in datasets.load_dataset(spark, folder).collect())
    assert read() == []
    for version in range(4):
        datasets.save_dataset(_example(spark, f"a{version}", f"b{version}").unionByName(_example(spark, f"c{version}", split="val")), folder)
        assert read() == [(f"a{version}", "train"), (f"b{version}", "train"), (f"c{version}", "val")]
    open_reader, before = datasets.load_dataset(spark, folder), sorted(os.listdir(folder))
    assert len([x for x in before if x.startswith("version-")]) == commits.KEPT and all(os.path.isdir(f"{commits.current(spark, folder)}/split={x}") for x in datasets.SPLITS)
    broken = _example(spark, *map(str, range(20))).repartition(4).withColumn("category", F.when(F.col("task_input") == "7", F.raise_error(F.lit("boom")).cast("string")).otherwise("x"))
    with pytest.raises(Exception, match="boom"):
        datasets.save_dataset(broken, folder)
    assert read()[0] == ("a3", "train") and sorted(os.listdir(folder)) == before
    datasets.save_dataset(_example(spark, "new"), folder)
    assert read() == [("new", "train")] and open_reader.count() == 3  # the version that a reader has open stays
    (tmp_path / "set" / "version-of a writer that died").mkdir()
    assert read() == [("new", "train")]


def test_two_writers_commit_one_after_the_other(spark, tmp_path):
    folder = str(tmp_path / "set")
    with commits.replacing(spark, folder) as one:
        _example(spark, "slow").drop("split").write.json(f"{one}/split=train")
        datasets.save_dataset(_example(spark, "fast"), folder)
        assert [r.task_input for r in datasets.load_dataset(spark, folder).collect()] == ["fast"]
    assert [r.task_input for r in datasets.load_dataset(spark, folder).collect()] == ["slow"]
    (tmp_path / "set" / "_commits" / f"{3:020d}.json").write_text(json.dumps({"version": "version-x"}))
    log = commits._log
    try:  # a writer that has looked at the log just before another one committed
        seen = [log(spark, folder)[:2]]
        commits._log = lambda *a: seen.pop() if seen else log(*a)
        commits._switch(spark, folder, "version-y")
    finally:
        commits._log = log
    assert log(spark, folder)[-1] == f"{4:020d}.json" and commits.current(spark, folder).endswith("version-y")


def test_published_folders(spark, tmp_path):
    folder = str(tmp_path / "run")
    for text in ("one", "two"):
        with commits.publishing(spark, folder) as path:
            spark.createDataFrame([(text,)], "value string").write.text(f"{path}/t")
            assert not os.path.exists(f"{folder}/t") or spark.read.text(f"{folder}/t").first().value == "one"
        assert spark.read.text(f"{folder}/t").first().value == text
    with pytest.raises(ValueError), commits.publishing(spark, folder):
        raise ValueError("no")
    assert spark.read.text(f"{folder}/t").first().value == "two" and os.listdir(tmp_path) == ["run"]


def test_golden_splits_do_not_depend_on_files(spark, tmp_path):
    rows = _example(spark, *[str(k % 30) for k in range(60)]).drop("split")
    found = []
    for k, parts in enumerate((1, 5)):
        rows.repartition(parts).write.json(str(tmp_path / str(k) / "golden.jsonl"))
        found.append(sorted((r.task_input, r.split) for r in datasets.load_golden(spark, str(tmp_path / str(k))).collect()))
    assert found[0] == found[1] and [sum(s == x for _, s in found[0]) for x in datasets.SPLITS] == [30, 15, 15]


def test_limits_stop_reading(spark, tmp_path, monkeypatch):
    """Of 60 files in order, those are opened that hold the messages asked for, and not many more."""
    turn = lambda k, i: [{"role": "user", "content": f"question {k} number {i}"}, {"role": "assistant", "content": f"answer {k}"}]
    for k in range(60):
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / "s" / f"a[{k}] *{{x}}.json").write_text(json.dumps({"messages": [m for i in range(k % 3) for m in turn(k, i)]}) if k % 10 else "{bad")
        os.utime(tmp_path / "s" / f"a[{k}] *{{x}}.json", (1000 + k // 2, 1000 + k // 2))
        _events(tmp_path / "e" / f"s {k:02d}", *[{"type": f"{m['role']}.message", "data": {"content": m["content"]}} for i in range(k % 3) for m in turn(k, i)])
    opened, plain = [], sessions.whole_files

    def counting(session, paths):
        out = plain(session, paths)
        if "workspace" not in paths[0]:
            opened.append(len(paths))
        return out

    every = {name: read(spark, str(tmp_path / name[0])).count() for name, read in (("sessions", sessions.read_sessions), ("events", sessions.read_events))}
    monkeypatch.setattr(sessions, "whole_files", counting)
    for name, read, order in (("s", sessions.read_sessions, list(range(59, -1, -1))), ("e", sessions.read_events, [k for k in range(60) if k % 3])):  # Spark lists no empty files
        order.sort(key=lambda k: (-(k // 2), f"a[{k}]")) if name == "s" else None
        want = [f"question {k} number {i}" for k in order for i in range(k % 3) if k % 10 or name == "e"]
        for limit in (3, 20, 500):
            opened.clear()
            assert [r.task_input for r in read(spark, str(tmp_path / name), limit=limit).collect()] == want[:limit]
            need = next((n for n in range(1, 61) if len([q for q in want if int(q.split()[1]) in order[:n]]) >= limit), len(order))
            assert need <= sum(opened) <= max(spark.sparkContext.defaultParallelism, 3 * need)
    assert every["events"] == len([q for k in range(60) for q in range(k % 3)])


def test_files_are_opened_once(spark, tmp_path):
    """Parsing goes over the texts several times, over a table of them and not over the files; the session's settings stay."""
    for k in range(3):
        (tmp_path / f"s{k}").mkdir()
        said = [("user", f"a question of number {k}"), ("assistant", f"answer {k}")]
        (tmp_path / f"s{k}" / "events.jsonl").write_text("\n".join(json.dumps({"type": f"{r}.message", "data": {"content": t}}) for r, t in said + [("user", "the end of it")]))
        (tmp_path / f"s{k}.json").write_text(json.dumps({"messages": [{"role": r, "content": t} for r, t in said]}))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    for found in (sessions.read_events(spark, str(tmp_path)), sessions.read_sessions(spark, str(tmp_path))):
        assert not [f for f in found.inputFiles() if f.endswith((".json", ".jsonl"))]
        assert {r.assistant_response for r in found.collect()} == {f"answer {k}" for k in range(3)}
    assert spark.conf.get(key) == before
    assert sessions.read_events(spark, str(tmp_path), name="none").count() == sessions.read_events(spark, str(tmp_path), limit=2, name="none").count() == 0
    assert sessions.read_sessions(spark, str(tmp_path / "none"), limit=2).count() == 0
