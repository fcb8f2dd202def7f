"""Calls of a language model as one batch operator, with an offline stand-in.

A model is a picklable callable from a list of requests (dict of strings) to a list of answers of the same length (dict of
strings, or an Exception for a failed one). ask() runs it by Arrow batches and returns answers as columns. As equal rows and a
task that is run again ask again, expensive models belong in answers.Stored, which keeps their answers by request.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.jsonx import extract_array, extract_object
from skein.functions.text import composite, is_blank, length_penalty, parse_bool, parse_score, shortened, token_overlap, validated

Model = Callable[[list[dict[str, str]]], list]


class OfflineModel:
    """Answers from the request alone, by shared words and hashes: for tests, and never a measure of quality."""

    def __call__(self, requests: list[dict[str, str]]) -> list[dict[str, str]]:
        return [getattr(self, r["task"])(r) for r in requests]

    @staticmethod
    def _share(a: str, b: str) -> float:
        want, got = set(a.lower().split()), set(b.lower().split())
        return len(want & got) / len(want) if want else 0.0

    def relevance(self, r: dict) -> dict:
        ok = self._share(r["message"], r["skill"]) > 0
        return {"scoring": json.dumps({"relevant": ok, "expected_behavior": f"Answers: {r['message'][:80]}", "difficulty": "medium", "category": "general"})}

    def rubric(self, r: dict) -> dict:
        s = f"{self._share(r['expected'], r['output']):.4f}"
        return {"correctness": s, "procedure_following": s, "conciseness": s, "feedback": "offline"}

    def select(self, r: dict) -> dict:
        lines = [x[2:].split(": ", 1) for x in r["tools"].split("\n") if x.startswith("- ")]
        best = max(lines, key=lambda x: (self._share(r["message"], " ".join(x)), x[0]), default=[""])
        return {"selected": best[0]}

    def respond(self, r: dict) -> dict:
        return {"output": f"{r['context'][:200]} {r['message']}".strip()}

    def factual(self, r: dict) -> dict:
        return {"verdict": str(not set(r["evolved"].lower().split()) <= set(r["original"].lower().split())), "explanation": "offline"}

    def role(self, r: dict) -> dict:
        return {"verdict": str(self._share(r["original"], r["evolved"]) >= 0.3), "explanation": "offline"}

    def test_cases(self, r: dict) -> dict:
        return {"cases": "Cases: " + json.dumps([{"task_input": f"{r['type']} {i}: {r['artifact'][:20]}", "expected_behavior": f"does {i}"} for i in range(int(r["n"]))])}

    def similar(self, r: dict) -> dict:
        names = [x[2:].split(": ", 1)[0] for x in r["tools"].split("\n") if x.startswith("- ")]
        return {"pairs": json.dumps([{"tools": [a.upper(), b], "overlap": f"{a} or {b}"} for a, b in zip(names[::2], names[1::2])])}

    def tool_tasks(self, r: dict) -> dict:
        return {"tasks": json.dumps([{"task_description": f"{r['level']} {i} for {r['name']}", "correct_params": {"i": i}} for i in range(int(r["n"]))])}

    def confuser_tasks(self, r: dict) -> dict:
        return {"tasks": json.dumps([{"task_description": f"{r['overlap']} {i}", "correct_tool": (r["a"], r["b"], "no tool")[i % 3], "reason": f"case {i}"} for i in range(int(r["n"]))])}

    def scenarios(self, r: dict) -> dict:
        return {"scenarios": json.dumps([{"user_message": f"{r['section']} {i}", "expected_behavior": r["text"][:20], "difficulty": "easy" if i % 2 else None} for i in range(int(r["n"]))])}

    def generate(self, r: dict) -> dict:
        key = hashlib.md5(r["about"].encode()).hexdigest()[:6]
        return {"items": json.dumps([{"task_input": f"{r['name']} {key} {i}", "expected_behavior": f"uses {r['name']}", "difficulty": r.get("level", "medium")} for i in range(int(r["n"]))])}


def ask(rows: DataFrame, model: Model, task: str, inputs: dict[str, str], outputs: list[str], batch: int = 64) -> DataFrame:
    """rows with a string column for each output (null where the call failed) and failed.

    inputs: names of the request's fields, and the columns that fill them. A model that keeps its answers (answers.Stored) is
    asked at once, and only what it has no answer to.
    """
    if hasattr(model, "ask_stored"):
        return model.ask_stored(rows, task, inputs, outputs, batch)
    return ask_each(rows, model, task, inputs, outputs, batch)


def ask_each(rows: DataFrame, model: Model, task: str, inputs: dict[str, str], outputs: list[str], batch: int = 64) -> DataFrame:
    """ask() with a call for every row, whenever the result is computed."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(o, T.StringType()) for o in outputs), T.StructField("failed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)  # other columns pass as they are
                cols = [part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs.values()]
                sent = [{"task": task} | {name: "" if v is None or v != v else str(v) for name, v in zip(inputs, vals)} for vals in zip(*cols)]
                try:
                    got = model(sent)
                except Exception as e:  # a call that fails is an error of its rows, not of the job
                    got = [e] * len(sent)
                bad = [isinstance(g, Exception) for g in got]
                answers = [pa.array([None if f else g.get(name) for f, g in zip(bad, got)], pa.string()) for name in outputs]
                yield pa.RecordBatch.from_arrays([*part.columns, *answers, pa.array(bad, pa.bool_())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def score_relevance(candidates: DataFrame, model: Model, skill_text: str) -> DataFrame:
    """candidates with failed and example (null unless relevant and valid): the model's JSON is read and validated.

    An answer that holds no JSON object is a failure, as a failed call is.
    """
    parts = shortened(F.lit(skill_text), F.col("task_input"), F.col("assistant_response"))
    asked = ask(candidates.withColumn("_p", F.to_json(parts)).withColumns({k: F.get_json_object("_p", f"$.{k}") for k in ("skill", "message", "response")}).drop("_p"), model, "relevance", {"skill": "skill", "message": "message", "response": "response"}, ["scoring"])
    read = asked.withColumn("_json", extract_object(F.col("scoring")))
    field = {k: F.get_json_object("_json", f"$.{k}") for k in ("relevant", "expected_behavior", "difficulty", "category")}
    relevant = ~F.coalesce(field["relevant"], F.lit("false")).isin("false", "0", "", "null", "[]", "{}", "0.0")
    example = F.when(relevant, validated(F.col("task_input"), field["expected_behavior"], field["difficulty"], field["category"]))
    out = read.withColumn("failed", F.col("failed") | F.col("_json").isNull()).withColumn("example", example)
    return out.drop("_json", "scoring", "skill", "message", "response")


def score_rubric(rows: DataFrame, model: Model, task: str, expected: str, output: str, skill: str, size: str | None = None, limit: str | None = None) -> DataFrame:
    """rows with correctness, procedure_following, conciseness, length_penalty, feedback, composite."""
    asked = ask(rows, model, "rubric", {"input": task, "expected": expected, "output": output, "skill": skill}, ["correctness", "procedure_following", "conciseness", "feedback"])
    parts = {k: parse_score(F.col(k)) for k in ("correctness", "procedure_following", "conciseness")}
    penalty = length_penalty(F.col(size), F.col(limit)) if size and limit else F.lit(0.0)
    scored = asked.drop("failed").withColumns(parts | {"length_penalty": penalty})
    return scored.withColumn("composite", composite(*(F.col(c) for c in (*parts, "length_penalty"))))


def metric(rows: DataFrame, model: Model, expected: str, output: str, quick: bool, task: str = "task_input", skill: str = "skill") -> DataFrame:
    """rows with score: 0 for a blank output, the words' overlap if quick, else the rubric's composite."""
    if quick:
        return rows.withColumn("score", token_overlap(F.col(expected), F.col(output)))
    judged = score_rubric(rows, model, task, expected, output, skill)
    return judged.withColumn("score", F.when(is_blank(F.col(output)), 0.0).otherwise(F.col("composite")))


def check_claims(pairs: DataFrame, model: Model, original: str = "original", evolved: str = "evolved") -> DataFrame:
    """pairs with factual_ok. An answer that cannot be read, and a failed call, do not pass."""
    asked = ask(pairs, model, "factual", {"original": original, "evolved": evolved}, ["verdict", "explanation"])
    known = F.lower(F.trim("verdict")).isin("true", "yes", "1", "false", "no", "0")
    return asked.withColumn("factual_ok", F.coalesce(known & ~parse_bool(F.col("verdict")), F.lit(False))).drop("verdict", "explanation", "failed")


def check_role(pairs: DataFrame, model: Model, original: str = "original", evolved: str = "evolved") -> DataFrame:
    """pairs with role_ok: only an affirmative answer passes."""
    asked = ask(pairs, model, "role", {"original": original, "evolved": evolved}, ["verdict", "explanation"])
    return asked.withColumn("role_ok", parse_bool(F.col("verdict"))).drop("verdict", "explanation", "failed")


def generate_examples(subjects: DataFrame, model: Model, name: str, about: str, n: str, level: str) -> DataFrame:
    """A row per generated example: subjects' columns, task_input, expected_behavior, difficulty; failures give none, and
    examples without a task or expectation are left out. The number that was asked for is not enforced."""
    asked = ask(subjects, model, "generate", {"name": name, "about": about, "n": n, "level": level}, ["items"])
    each = asked.withColumn("_i", F.from_json(extract_array(F.col("items")), "array<struct<task_input:string,expected_behavior:string,difficulty:string>>"))
    out = each.select(*subjects.columns, F.inline("_i"))
    return out.where(~is_blank(F.col("task_input")) & (F.length("expected_behavior") > 0))
