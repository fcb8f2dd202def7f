"""The flows: mining examples from sessions, and judging evolved tool descriptions, prompt sections and skills.

What an optimizer made comes in as the evolved table or text; the optimizers themselves are outside.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import has_value, is_relevant
from skein.operators.candidates import cap_candidates
from skein.operators.gates import all_passed, gate_report
from skein.operators.ordering import with_ordinals
from skein.operators.rendering import frozen_context, reassemble_skill, render_tools
from skein.operators.scoring import compare_rates, group_accuracy, mean_score, overall_accuracy, regression_verdict
from skein.operators.splits import split_members
from skein.plans.judge import Model, OfflineModel, ask, check_claims, check_role, metric, score_relevance
from skein.shared import discard, written

#: Fixed value: fewer examples than this are not split.
MIN_DATASET = 3


def candidates_of(messages: DataFrame, skill_name: str, skill_text: str, key: str, most: int = 50) -> DataFrame:
    """Messages with a task and a source that a judge is asked about, ranked by ord."""
    whole = messages.where(has_value(F.col("task_input"), F.col("source")))
    return cap_candidates(whole, is_relevant(F.col("task_input"), skill_name, skill_text), key, most)


def next_chunk(asked: int, accepted: int, most: int) -> int:
    """How many candidates to ask about next: as many as should yield what is missing at the rate so far, at least what is
    missing, and never more than have been asked about or are missing. So in all fewer than twice as many are asked about as
    one at a time would take."""
    need = most - accepted
    hoped = -(-need * asked // accepted) if accepted else asked
    return max(need, min(hoped, asked))


def mine(messages: DataFrame, skill_name: str, skill_text: str, key: str, model: Model | None = None, most: int = 50, chunk: int | None = None) -> DataFrame:
    """Examples (task_input, expected_behavior, difficulty, category, source, key, ord), at most `most`, the first accepted in
    order.

    Candidates are scored a chunk of ranks at a time (next_chunk, or a fixed size) until enough are accepted; later ones are not
    asked about. Each chunk is written once and only its numbers of rows come to the driver; of the last one the rows are kept
    whose place among its accepted ones is within what was missing.
    """
    ranked = written(candidates_of(messages, skill_name, skill_text, key, most), "candidates")
    n, asked, accepted, parts = ranked.count(), 0, 0, []
    while not parts or (accepted < most and asked < n):
        end = asked + (chunk or next_chunk(asked, accepted, most))
        part = ranked.where((F.col("ord") >= asked) & (F.col("ord") < end))
        scored = score_relevance(part, model or OfflineModel(), skill_text).where("example IS NOT NULL")
        got = written(scored.select("example.*", "source", key, "ord"), "accepted")
        more = got.count()
        if accepted + more > most:
            got = with_ordinals(got, "ord", name="_place", first=1).where(F.col("_place") <= most - accepted).drop("_place")
        parts.append(got)
        asked, accepted = end, accepted + more
    discard(ranked)
    return functools.reduce(DataFrame.unionByName, parts)


def mined_splits(examples: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """Examples with their split; ValueError for fewer than MIN_DATASET."""
    if examples.limit(MIN_DATASET).count() < MIN_DATASET:
        raise ValueError(f"fewer than {MIN_DATASET} examples")
    return split_members(examples, key, seed)


def paired(baseline: DataFrame, evolved: DataFrame, key: str, text: str) -> DataFrame:
    """key, original, evolved of what both sides have."""
    return baseline.select(key, F.col(text).alias("original")).join(evolved.select(key, F.col(text).alias("evolved")), key)


def active_examples(examples: DataFrame, section_id: str | None) -> DataFrame:
    """The examples of the section that is worked on; all without one."""
    return examples if section_id is None else examples.where(F.col("section_id") == section_id)


def each_candidate(candidates: DataFrame, examples: DataFrame) -> DataFrame:
    """Each example with each candidate (a baseline and what evolved from it: a few rows)."""
    return examples.join(candidates)


def answer(rows: DataFrame, model: Model, context: str, message: str) -> DataFrame:
    """rows with the model's output to a message, given a context (a skill, or a prompt's sections)."""
    return ask(rows, model, "respond", {"context": context, "message": message}, ["output"]).drop("failed")


def answer_sections(sections: DataFrame, examples: DataFrame, model: Model) -> DataFrame:
    """examples with skill (their section's text), context (that and the other sections) and output."""
    context = frozen_context(sections).withColumnRenamed("active", "section_id")
    shown = context.join(sections, "section_id").select("section_id", F.concat_ws("\n\n", F.col("text"), F.nullif("context", F.lit(""))).alias("context"), F.col("text").alias("skill"))
    return answer(examples.join(shown, "section_id"), model, "context", "user_message")


def predict_tools(examples: DataFrame, tools: DataFrame, model: Model) -> DataFrame:
    """examples with selected_tool, given the list of a candidate's tools (one row, so it is sent to all tasks)."""
    shown = render_tools(tools).select("summaries")
    asked = ask(examples.join(shown), model, "select", {"message": "task_description", "tools": "summaries"}, ["selected"])
    return asked.withColumnRenamed("selected", "selected_tool").drop("summaries", "failed")


def judge_tools(baseline: DataFrame, evolved: DataFrame, holdout: DataFrame, model: Model | None = None) -> dict[str, DataFrame]:
    """baseline, evolved: ord, tool, description; holdout: task_description, correct_tool. Tables: gates, claims,
    accuracy (baseline and evolved), rates, verdict."""
    model = model or OfflineModel()
    both = paired(baseline, evolved, "tool", "description")
    gates = gate_report(evolved.select("tool", F.col("description").alias("text"), F.lit("tool_description").alias("artifact_type")).join(both.select("tool", F.col("original").alias("baseline_text")), "tool", "left"))
    before, after = predict_tools(holdout, baseline, model), predict_tools(holdout, evolved, model)
    rates = compare_rates(group_accuracy(before), group_accuracy(after))
    accuracy = overall_accuracy(before).withColumn("which", F.lit("baseline")).unionByName(overall_accuracy(after).withColumn("which", F.lit("evolved")))
    return {"gates": gates, "passed": all_passed(gates, "tool"), "claims": check_claims(both, model), "accuracy": accuracy, "rates": rates, "verdict": regression_verdict(rates)}


def judge_sections(baseline: DataFrame, evolved: DataFrame, holdout: DataFrame, model: Model | None = None) -> dict[str, DataFrame]:
    """baseline, evolved: ord, section_id, text; holdout: section_id, user_message, expected_behavior. Each example runs
    with its own section active: the section's text and the others as context both reach the answer."""
    model = model or OfflineModel()
    both = paired(baseline, evolved, "section_id", "text")
    gates = gate_report(both.select("section_id", F.col("evolved").alias("text"), F.lit("section").alias("artifact_type"), F.col("original").alias("baseline_text"))).where("constraint_name IN ('growth_limit', 'non_empty')")

    def mean(sections: DataFrame, which: str) -> DataFrame:
        answered = answer_sections(sections, holdout, model)
        return mean_score(metric(answered, model, "expected_behavior", "output", False, "user_message")).withColumn("which", F.lit(which))

    return {"gates": gates, "passed": all_passed(gates, "section_id"), "roles": check_role(both, model), "scores": mean(baseline, "baseline").unionByName(mean(evolved, "evolved"))}


def judge_skill(skill: DataFrame, evolved_body: str, holdout: DataFrame, model: Model | None = None) -> dict[str, DataFrame]:
    """skill: the one row of a parsed skill; holdout: task_input, expected_behavior. The gates see the whole file put
    together again, front matter included; the candidate's text is what the model is shown."""
    model = model or OfflineModel()
    texts = skill.select("name", F.col("raw").alias("baseline_text"), reassemble_skill(F.col("frontmatter"), F.lit(evolved_body)).alias("text"), F.lit("skill").alias("artifact_type"))
    gates = gate_report(texts)

    shown = texts.select(F.inline(F.array(*[F.struct(F.lit(w).alias("which"), F.col(c).alias("context")) for w, c in (("baseline", "baseline_text"), ("evolved", "text"))])))
    scored = metric(answer(each_candidate(shown, holdout), model, "context", "task_input"), model, "expected_behavior", "output", True)
    means = [mean_score(scored.where(F.col("which") == w)).withColumn("which", F.lit(w)) for w in ("baseline", "evolved")]
    return {"gates": gates, "passed": all_passed(gates, "name"), "scores": means[0].unionByName(means[1])}
