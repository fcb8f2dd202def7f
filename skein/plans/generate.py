"""Evaluation datasets that a model writes: test cases of an artifact, tasks for tools, scenarios for prompt sections.

Each call is a row of requests (judge.ask), its answer a JSON array that is read by columns. A call that fails costs its
own examples only, but for the two on which all others rest (test cases, similar tools), which stop the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.jsonx import extract_array
from skein.functions.text import has_value, is_blank
from skein.operators.rendering import render_tools
from skein.operators.scoring import coverage, quotas, resolve_names, resolve_pairs
from skein.operators.splits import split_members
from skein.plans.judge import Model, ask

#: Tasks a tool by difficulty, tasks a pair of similar tools, tasks for a tool with few examples, the mix asked of scenarios.
PLAN = {"easy": 2, "medium": 3, "hard": 1}
PAIR_TASKS, MORE_TASKS, MORE_LEVEL = 7, 3, "medium"
MIX = "easy:30%,medium:50%,hard:20%"

TASK = "task_description string, correct_tool string, correct_params string, confuser_tools array<string>, reason string"
EXAMPLE = ("task_description", "correct_tool", "correct_params", "difficulty", "confuser_tools", "reason", "source")


def _or(c: str | Column, default) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, default if isinstance(default, Column) else F.lit(default))


def _items(asked: DataFrame, answer: str, schema: str) -> DataFrame:
    """A row for each object of the answers' arrays, its fields beside the other columns; answers without an array give none,
    elements that are no objects are left out. schema: of an object."""
    each = asked.withColumn("_item", F.explode(F.from_json(extract_array(F.col(answer)), "array<string>"))).drop(answer, "failed")
    return each.where(F.col("_item").startswith("{")).withColumn("_item", F.from_json("_item", schema)).select("*", "_item.*").drop("_item")


def _required(asked: DataFrame, answer: str) -> DataFrame:
    """asked, whose failed calls stop the job."""
    return asked.withColumn(answer, F.when(F.col("failed"), F.raise_error(F.lit("the call failed")).cast("string")).otherwise(F.col(answer)))


def with_splits(examples: DataFrame, seed: str = "42") -> DataFrame:
    """examples with their split, shuffled by their content."""
    return split_members(examples.withColumn("_key", F.to_json(F.struct(*examples.columns))), "_key", seed).drop("_key")


def test_cases(artifacts: DataFrame, model: Model, text: str = "text", kind: str = "artifact_type", n: str = "n") -> DataFrame:
    """artifacts' other columns, task_input, expected_behavior, difficulty, category, source: n cases asked for each artifact.

    The answer has to hold a JSON array, a call must not fail; cases without a task or expectation are left out.
    """
    asked = _required(ask(artifacts, model, "test_cases", {"artifact": text, "type": kind, "n": n}, ["cases"]), "cases")
    strict = F.from_json(extract_array(F.col("cases"), strict=True), "array<struct<task_input:string,expected_behavior:string,difficulty:string,category:string>>")
    out = asked.select(*[c for c in artifacts.columns if c not in (text, kind, n)], F.inline(strict)).where(has_value(F.col("task_input"), F.col("expected_behavior")))
    return out.withColumns({"difficulty": _or("difficulty", "medium"), "category": _or("category", "general"), "source": F.lit("synthetic")})


def similar_tools(tools: DataFrame, model: Model) -> DataFrame:
    """tools (array), overlap: the pairs that the model sees in the list of tools (ord, tool, description), one call."""
    asked = _required(ask(render_tools(tools).select("summaries"), model, "similar", {"tools": "summaries"}, ["pairs"]), "pairs")
    return _items(asked, "pairs", "tools array<string>, overlap string").select("tools", _or("overlap", "").alias("overlap"))


def _as_examples(rows: DataFrame, correct: Column, difficulty: Column, confusers: Column, reason: Column) -> DataFrame:
    return rows.select(
        _or("task_description", "").alias("task_description"), correct.alias("correct_tool"), _or("correct_params", "{}").alias("correct_params"), difficulty.alias("difficulty"),
        confusers.alias("confuser_tools"), reason.alias("reason"), F.lit("synthetic").alias("source"),
    )


def _asked_tasks(tools: DataFrame, wanted: DataFrame, model: Model) -> DataFrame:
    """wanted: tool, level, n; the answers' tasks, with the tool and level."""
    names = render_tools(tools).select("names")  # one row
    rows = wanted.join(tools.select("tool", "description"), "tool").withColumn("n", F.col("n").cast("string")).join(names)
    asked = ask(rows, model, "tool_tasks", {"name": "tool", "description": "description", "tools": "names", "level": "level", "n": "n"}, ["tasks"])
    return _items(asked.select("tool", "level", "tasks", "failed"), "tasks", TASK)


def tool_tasks(tools: DataFrame, model: Model) -> DataFrame:
    """Examples (EXAMPLE) for each tool by PLAN; the tool is named as the list's first tool of that name."""
    plan = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(v).alias("n")) for k, v in PLAN.items()]))
    got = _asked_tasks(tools, tools.select("tool", plan.alias("p")).select("tool", "p.*"), model)
    named = resolve_names(got, tools.select("ord", "tool"), "tool")
    none = F.array().cast("array<string>")
    return _as_examples(named, F.col("resolved"), F.col("level"), _or("confuser_tools", none), F.lit(""))


def confuser_tasks(pairs: DataFrame, tools: DataFrame, model: Model) -> DataFrame:
    """Hard examples (EXAMPLE) for pairs of similar tools, PAIR_TASKS asked for each; the other tool of the pair confuses. Pairs
    that are not two known tools, and tasks whose tool is unknown, are left out."""
    known = resolve_pairs(pairs, tools.select("ord", "tool")).withColumn("n", F.lit(str(PAIR_TASKS)))
    for side in ("a", "b"):
        known = known.join(tools.select(F.col("tool").alias(f"tool_{side}"), F.col("description").alias(f"about_{side}")), f"tool_{side}")
    asked = ask(known, model, "confuser_tasks", {"a": "tool_a", "about_a": "about_a", "b": "tool_b", "about_b": "about_b", "overlap": "overlap", "n": "n"}, ["tasks"])
    got = resolve_names(_items(asked.select("tool_a", "tool_b", "tasks", "failed"), "tasks", TASK), tools.select("ord", "tool"), "correct_tool")
    other = F.when(F.col("resolved") == F.col("tool_a"), F.col("tool_b")).otherwise(F.col("tool_a"))
    return _as_examples(got, F.col("resolved"), F.lit("hard"), F.array(other), _or("reason", ""))


def supplement(examples: DataFrame, tools: DataFrame, model: Model) -> DataFrame:
    """More examples (EXAMPLE) for the tools that examples cover too little, MORE_TASKS asked for each; they are not counted again."""
    few = coverage(tools.select("ord", "tool"), examples).select("tool", F.lit(MORE_LEVEL).alias("level"), F.lit(MORE_TASKS).alias("n"))
    none = F.array().cast("array<string>")
    return _as_examples(_asked_tasks(tools, few, model), F.col("tool"), F.col("level"), none, F.lit(""))


def tool_dataset(tools: DataFrame, model: Model, seed: str = "42") -> DataFrame:
    """Examples of all tools (ord, tool, description) with their split: tasks a tool, tasks for similar tools, and more where
    there are few; tasks without a description are left out."""
    some = tool_tasks(tools, model).unionByName(confuser_tasks(similar_tools(tools, model), tools, model))
    every = some.unionByName(supplement(some, tools, model))
    return with_splits(every.where(~is_blank(F.col("task_description"))), seed)


def section_scenarios(sections: DataFrame, model: Model) -> DataFrame:
    """section_id, user_message, expected_behavior, difficulty, source: scenarios for sections (section_id, ord, text) by quota.

    The number that comes back is not enforced; scenarios without a message are left out, sections without a quota too.
    """
    rows = quotas(sections).join(sections.select("section_id", "text"), "section_id").select("section_id", "text", F.col("target").cast("string").alias("n"), F.lit(MIX).alias("mix"))
    asked = ask(rows, model, "scenarios", {"text": "text", "section": "section_id", "n": "n", "mix": "mix"}, ["scenarios"])
    got = _items(asked.select("section_id", "scenarios", "failed"), "scenarios", "user_message string, expected_behavior string, difficulty string")
    out = got.select("section_id", _or("user_message", "").alias("user_message"), _or("expected_behavior", "").alias("expected_behavior"), _or("difficulty", "medium").alias("difficulty"), F.lit("synthetic").alias("source"))
    return out.where(~is_blank(F.col("user_message")))
