"""Gates on artifacts: size, growth, emptiness, structure; as columns and as a report of one row a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import strip

#: Characters allowed by type (others as a skill), and growth over the baseline.
LIMITS = {"skill": 15_000, "tool_description": 500, "param_description": 200}
MAX_GROWTH = 0.2


def size_limit(kind: Column) -> Column:
    out = F.lit(LIMITS["skill"])
    for k, n in LIMITS.items():
        out = F.when(kind == k, F.lit(n)).otherwise(out)
    return out


def size_ok(text: Column, kind: Column) -> Column:
    return F.length(text) <= size_limit(kind)


def grown_by(size: Column, baseline: Column) -> Column:
    """Growth of a size as a share of the baseline's."""
    return (size - baseline).cast("double") / F.greatest(F.lit(1), baseline)


def growth(text: Column, baseline: Column) -> Column:
    """Growth in characters as a share of the baseline's."""
    return grown_by(F.length(text), F.length(baseline))


def growth_ok(text: Column, baseline: Column, most: float = MAX_GROWTH) -> Column:
    return growth(text, baseline) <= F.lit(most)


def non_empty(text: Column) -> Column:
    return F.length(strip(text)) > 0


def structure_parts(text: Column) -> tuple[Column, Column, Column]:
    """Front matter, name and description: the latter in the first 500 characters, and only with front matter."""
    head = F.substring(text, 1, 500)
    front = strip(text).startswith("---")
    return front, front & head.contains("name:"), front & head.contains("description:")


def structure_ok(text: Column) -> Column:
    a, b, c = structure_parts(text)
    return a & b & c


def _percent(x: Column) -> Column:
    return F.format_string("%+.1f%%", x * 100)


def facts(text: Column) -> Column:
    """struct<chars, blank, front, name, described>: all that the gates ask of a text (null: empty). Join these, not texts."""
    t = F.coalesce(text, F.lit(""))
    front, name, described = structure_parts(t)
    return F.struct(F.length(t).alias("chars"), (~non_empty(t)).alias("blank"), front.alias("front"), name.alias("name"), described.alias("described"))


def gate_report(artifacts: DataFrame, text: str = "text", kind: str = "artifact_type", baseline: str = "baseline_text", most: float = MAX_GROWTH) -> DataFrame:
    """A row for each artifact and gate that applies: all columns of artifacts, gate (order), constraint_name, passed, message.

    text: a text or its facts(); baseline: a text or its length. Growth applies where there is a non-empty baseline,
    structure to skills. A null text counts as empty.
    """
    types = dict(artifacts.dtypes)
    fact = F.col(text) if types[text].startswith("struct") else facts(F.col(text))
    base = F.length(baseline) if types[baseline] == "string" else F.col(baseline)
    k, n, limit = F.col(kind), fact["chars"], size_limit(F.col(kind))
    counted = F.concat(n.cast("string"), F.lit("/"), limit.cast("string"), F.lit(" chars"))
    over = F.concat(F.lit(" ("), (n - limit).cast("string"), F.lit(" over)"))
    allowed = F.lit(f" (max {most:+.1%})")
    a, name, desc = fact["front"], fact["name"], fact["described"]
    missing = F.concat_ws(", ", F.when(~a, F.lit("YAML frontmatter (---)")), F.when(~name, F.lit("name field")), F.when(~desc, F.lit("description field")))

    # Messages and gate names below are fixed values.
    def gate(i: int, what: str, ok: Column, good: Column, bad: Column, applies: Column) -> Column:
        return F.when(applies, F.struct(F.lit(i).alias("gate"), F.lit(what).alias("constraint_name"), ok.alias("passed"), F.when(ok, good).otherwise(bad).alias("message")))

    yes = F.lit(True)
    grown = grown_by(n, base)
    gates = F.array_compact(F.array(
        gate(1, "size_limit", n <= limit, F.concat(F.lit("Size OK: "), counted), F.concat(F.lit("Size exceeded: "), counted, over), yes),
        gate(2, "growth_limit", grown <= F.lit(most), F.concat(F.lit("Growth OK: "), _percent(grown), allowed), F.concat(F.lit("Growth exceeded: "), _percent(grown), allowed), base > 0),
        gate(3, "non_empty", ~fact["blank"], F.lit("Artifact is non-empty"), F.lit("Artifact is empty"), yes),
        gate(4, "skill_structure", a & name & desc, F.lit("Skill has valid frontmatter (name + description)"), F.concat(F.lit("Skill missing: "), missing), k == "skill"),
    ))
    return artifacts.select("*", F.inline(gates))


def all_passed(report: DataFrame, key: str) -> DataFrame:
    """key, gates, passed: whether an artifact passed all its gates."""
    return report.groupBy(key).agg(F.count("*").alias("gates"), F.bool_and("passed").alias("passed"))
