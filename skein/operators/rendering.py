"""Texts rendered from tables: tool lists, frozen context, diffs, skills."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.commits import publishing


def _joined(order: str, text: str, sep: str) -> Column:
    """The texts of a group in order, joined. A group here is a prompt's parts: some dozens of rows."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def render_tools(tools: DataFrame, *by: str) -> DataFrame:
    """summaries (`- name: description` lines) and names (comma-joined), in order of ord; a missing description is `Tool: name`."""
    line = F.concat(F.lit("- "), F.col("tool"), F.lit(": "), F.coalesce("description", F.concat(F.lit("Tool: "), F.col("tool"))))
    return tools.withColumn("_line", line).groupBy(*by).agg(_joined("ord", "_line", "\n").alias("summaries"), _joined("ord", "tool", ", ").alias("names"))


def prompt_spans(sections: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(by, _prompt) and (by, active, _first, _size): each prompt once, all sections as `[id]: text` with a blank line between, and
    where each one stands in it with the blank line that goes when it is cut out (first counts from 1).

    The sections of a prompt are gathered once (by prompt: some dozens); what is shuffled grows with the sections' text.
    """
    line = F.concat(F.lit("["), F.col("section_id"), F.lit("]: "), F.col("text"))
    parts = sections.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", "section_id", line.alias("line")))).alias("_all"))
    prompts = parts.select(*by, F.array_join(F.transform("_all", lambda x: x["line"]), "\n\n").alias("_prompt"))
    sizes = F.transform("_all", lambda x: F.struct(x["section_id"].alias("id"), (F.length(x["line"]) + 2).alias("size")))
    before = lambda k: F.aggregate(F.slice(F.col("_sizes"), F.lit(1), k), F.lit(0), lambda sum_, x: sum_ + x["size"])
    each = parts.select(*by, sizes.alias("_sizes")).select(*by, F.posexplode(F.transform("_sizes", lambda x, k: F.struct(x["id"].alias("active"), (before(k) + 1).alias("_first"), x["size"].alias("_size")))))
    return prompts, each.select(*by, "col.*")


def without_span(prompt: Column, first: Column, size: Column) -> Column:
    """A prompt with a span cut out: for a section of prompt_spans(), its frozen context."""
    rest = F.concat(F.substr(prompt, F.lit(1), first - 1), F.substr(prompt, first + size))
    return F.when(first + size > F.length(prompt) + 1, F.substr(prompt, F.lit(1), F.greatest(first - 3, F.lit(0)))).otherwise(rest)


def frozen_context(sections: DataFrame, *by: str) -> DataFrame:
    """For each section as the active one: by, active, context with all others as `[id]: text`, blank line between, in order.

    A section's context is cut out of the prompt where it is needed (prompt_spans): contexts are made after the last shuffle.
    """
    prompts, spans = prompt_spans(sections, *by)
    both = spans.join(prompts, list(by)) if by else spans.join(F.broadcast(prompts))  # one prompt
    return both.select(*by, "active", without_span(F.col("_prompt"), F.col("_first"), F.col("_size")).alias("context"))


def unified_diff(original: str | None, evolved: str | None, name: str) -> str:
    """A unified diff with three lines of context, `` for equal texts."""
    a, b = (original or "").splitlines(), (evolved or "").splitlines()
    return "\n".join(difflib.unified_diff(a, b, fromfile=f"original/{name}", tofile=f"evolved/{name}", lineterm=""))


def diffs(original: DataFrame, evolved: DataFrame, key: str = "name", text: str = "text") -> DataFrame:
    """key, diff of the texts that both sides have and that differ."""

    @F.pandas_udf("string")
    def diff(names: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([unified_diff(x, y, n) for n, x, y in zip(names, a, b)], dtype=object)

    both = original.select(key, F.col(text).alias("_a")).join(evolved.select(key, F.col(text).alias("_b")), key).where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(key, diff(F.col(key).cast("string"), "_a", "_b").alias("diff")).where("diff <> ''")


def reassemble_skill(frontmatter: Column, body: Column) -> Column:
    return F.concat(F.lit("---\n"), frontmatter, F.lit("\n---\n\n"), body, F.lit("\n"))


def run_folder(folder: str, stamp: str, failed: bool = False) -> str:
    """Where a run's results go: under its stamp, or FAILED and the stamp."""
    return f"{folder}/{'FAILED_' if failed else ''}{stamp}"


def save_run(folder: str, stamp: str, metrics: DataFrame, evolved: DataFrame | None = None, changes: DataFrame | None = None, failed: bool = False) -> str:
    """Writes a run's one-row metrics, the evolved texts (name, description or text) as one JSON array and the diffs (name, diff)
    as text, and returns the folder. A failed run has metrics only, with failed status and without passed gates.

    The folder appears with all of its files, or not at all if a task fails; one that was there is replaced as a whole. Evolved
    texts and diffs are a prompt's or a tool list's: some dozens of rows.
    """
    out = run_folder(folder, stamp, failed)
    with publishing(metrics.sparkSession, out) as path:
        status = metrics.withColumns({"timestamp": F.lit(stamp), "status": F.lit("FAILED" if failed else "OK"), "constraints_passed": F.lit(not failed)})
        status.coalesce(1).write.json(f"{path}/metrics")
        if evolved is not None and not failed:
            rows = F.sort_array(F.collect_list(F.struct(*evolved.columns)))
            evolved.agg(F.to_json(rows, {"pretty": "true"}).alias("value")).coalesce(1).write.text(f"{path}/evolved")
        if changes is not None and not failed:
            changes.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "diff"))), lambda x: x["diff"]), "\n").alias("value")).coalesce(1).write.text(f"{path}/diff")
    return out
