"""Rates, means, coverage, name resolution and the regression gate."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import exact_match, strip
from skein.shared import unused

#: The drop in a rate that still passes, and the examples that a tool needs.
THRESHOLD, MIN_EXAMPLES = 0.02, 3

#: Scenarios by section; those of FAMILY are shared by its members.
WEIGHTS = {
    "default_agent_identity": 20,
    "memory_guidance": 15,
    "skills_guidance": 15,
    "platform_hints": 20,
    "session_search_guidance": 10,
}
FAMILY = "platform_hints"


def group_accuracy(predictions: DataFrame, correct: str = "correct_tool", selected: str = "selected_tool") -> DataFrame:
    """tool, total, rate: matches are without case and blank space around, groups by the name as it is."""
    return predictions.groupBy(F.col(correct).alias("tool")).agg(F.count("*").alias("total"), F.avg(exact_match(F.col(correct), F.col(selected))).alias("rate"))


def overall_accuracy(predictions: DataFrame, correct: str = "correct_tool", selected: str = "selected_tool") -> DataFrame:
    """One row n, hits, rate; 0 for no predictions."""
    hits = F.coalesce(F.sum(exact_match(F.col(correct), F.col(selected)).cast("long")), F.lit(0))
    return predictions.agg(F.count("*").alias("n"), hits.alias("hits")).withColumn("rate", F.col("hits") / F.greatest("n", F.lit(1)))


def mean_score(scores: DataFrame, col: str = "score") -> DataFrame:
    """One row n, mean; 0 for no scores."""
    return scores.agg(F.count("*").alias("n"), F.coalesce(F.avg(col), F.lit(0.0)).alias("mean"))


def source_counts(examples: DataFrame, col: str = "source") -> DataFrame:
    return examples.groupBy(col).agg(F.count("*").alias("n")).orderBy(col)


def compare_rates(baseline: DataFrame, evolved: DataFrame) -> DataFrame:
    """tool, baseline_rate, evolved_rate, delta: all tools of the baseline, an evolved rate that is missing is 0; tools that
    only the other side has are left out. delta is rounded to 10 places, so that 0.80 - 0.78 is 0.02."""
    b = baseline.select("tool", F.col("rate").alias("baseline_rate"))
    e = evolved.select("tool", F.col("rate").alias("evolved_rate"))
    out = b.join(e, "tool", "left").withColumn("evolved_rate", F.coalesce("evolved_rate", F.lit(0.0)))
    return out.withColumn("delta", F.round(F.col("baseline_rate") - F.col("evolved_rate"), 10))


def regressions(rates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rates with a column regressed: the rate dropped by more than the threshold."""
    return rates.withColumn("regressed", F.col("delta") > F.lit(threshold))


def regression_verdict(rates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: passed, n_tools, regressed_tools (sorted, comma-joined), message."""
    bad = F.array_sort(F.collect_list(F.when(F.col("regressed"), F.col("tool"))))
    out = regressions(rates, threshold).agg(F.count("*").alias("n_tools"), bad.alias("_bad"))
    names = F.array_join("_bad", ", ")
    percent = f"{threshold:.0%}"
    # The messages are fixed values.
    text = F.when(F.size("_bad") == 0, F.concat(F.lit("All "), F.col("n_tools").cast("string"), F.lit(f" tools within {percent} regression threshold"))).otherwise(
        F.concat(F.lit("Regression detected in "), F.size("_bad").cast("string"), F.lit(" tool(s): "), names, F.lit(f" (threshold: {percent})"))
    )
    return out.select((F.size("_bad") == 0).alias("passed"), "n_tools", F.array_join("_bad", ",").alias("regressed_tools"), text.alias("message"))


#: Resamples, the share of them between the ends of an interval, and the values of a 32-bit number from which on a Poisson(1)
#: weight is 1, 2, 3... (its distribution function in steps of 2**-32).
REPLICATES, LEVEL = 200, 0.95
_STEPS = [int(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) * 2**32) for n in range(10)]


def resample_weights(df: DataFrame, key: str, replicates: int = REPLICATES, seed: str = "42") -> DataFrame:
    """df's rows, each `replicates` times, with columns replicate (from 0) and weight: how often the row is in that resample.

    Weights are Poisson(1) by a hash of key, seed and replicate, as of a bootstrap of very many rows: no row has to know of any
    other, and a row has the same weights wherever it is read. A null key counts as empty.
    """
    group, digest, part = unused(df, "_group", "_digest", "_part")
    each = df.withColumn(group, F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))))
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}:"), F.col(group).cast("string"))
    four = each.withColumn(digest, F.md5(text.cast("binary"))).withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(3))))
    value = F.conv(F.substr(digest, F.col(part) * 8 + 1, F.lit(8)), 16, 10).cast("long")
    weight = functools.reduce(Column.__add__, [(value >= F.lit(t)).cast("int") for t in _STEPS])
    out = four.withColumns({"replicate": F.col(group) * 4 + F.col(part), "weight": weight}).drop(group, digest, part)
    return out.where(F.col("replicate") < replicates)


def rate_intervals(paired: DataFrame, key: str, correct: str = "correct_tool", baseline: str = "baseline_tool", evolved: str = "evolved_tool", replicates: int = REPLICATES, level: float = LEVEL, seed: str = "42") -> DataFrame:
    """tool, n, delta, low, high: the drop in each tool's rate from baseline to evolved answers to the same examples, and the
    interval that `level` of its paired bootstrap resamples lie in (interpolated quantiles, rounded to 10 places).

    Both answers of an example have its weight, so what they share cancels out. Rows meet as sums of weights by tool and
    replicate, combined before they are shuffled. A tool without rows in a resample has no difference there.
    """
    hit = lambda c: exact_match(F.col(correct), F.col(c)).cast("long")
    rows = paired.select(F.col(key).alias("key"), F.col(correct).alias("tool"), (hit(baseline) - hit(evolved)).alias("lost"))
    drawn = resample_weights(rows, "key", replicates, seed).groupBy("tool", "replicate").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("lost")).alias("lost")).where("n > 0")
    tail = (1 - level) / 2
    ends = drawn.groupBy("tool").agg(F.percentile(F.col("lost") / F.col("n"), F.array(F.lit(tail), F.lit(1 - tail))).alias("ends"))
    point = rows.groupBy("tool").agg(F.count("*").alias("n"), F.round(F.avg("lost"), 10).alias("delta"))
    a, b = point.alias("a"), ends.alias("b")
    bound = lambda k: F.round(F.get("b.ends", F.lit(k)), 10)
    return a.join(b, F.col("a.tool").eqNullSafe(F.col("b.tool")), "left").select("a.tool", "a.n", "a.delta", bound(0).alias("low"), bound(1).alias("high"))


def regression_report(intervals: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """intervals (rate_intervals) with regressed, the gate's verdict on the difference itself, and certain: whether the whole
    interval is on the verdict's side of the threshold."""
    bad = F.col("delta") > F.lit(threshold)
    return intervals.withColumns({"regressed": bad, "certain": F.when(bad, F.col("low") > F.lit(threshold)).otherwise(F.col("high") <= F.lit(threshold))})


def coverage(tools: DataFrame, examples: DataFrame, least: int = MIN_EXAMPLES) -> DataFrame:
    """ord, tool, n of the tools with fewer than `least` examples, none included, in the list's order."""
    n = examples.groupBy(F.col("correct_tool").alias("tool")).agg(F.count("*").alias("n"))
    return tools.join(n, "tool", "left").select("ord", "tool", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least).orderBy("ord")


def normal_name(c: Column) -> Column:
    return F.lower(strip(c))


def resolve_names(rows: DataFrame, tools: DataFrame, col: str = "name") -> DataFrame:
    """rows with a column resolved, the list's spelling of the name (of several the first in order); others are dropped.

    The list (ord, tool) is reduced to one row a normal name before the join, so rows are never multiplied.
    """
    first = tools.groupBy(normal_name(F.col("tool")).alias("_key")).agg(F.min(F.struct("ord", "tool")).alias("_first"))
    return rows.withColumn("_key", normal_name(F.col(col))).join(first, "_key").withColumn("resolved", F.col("_first.tool")).drop("_key", "_first")


def resolve_pairs(pairs: DataFrame, tools: DataFrame, col: str = "tools") -> DataFrame:
    """pairs (an array column) of exactly two names that both resolve, with columns tool_a and tool_b."""
    two = pairs.where(F.size(col) == 2).withColumns({"_a": F.get(col, F.lit(0)), "_b": F.get(col, F.lit(1))})
    one = resolve_names(two, tools, "_a").withColumnRenamed("resolved", "tool_a")
    return resolve_names(one, tools, "_b").withColumnRenamed("resolved", "tool_b").drop("_a", "_b")


def enrich(examples: DataFrame, sections: DataFrame) -> DataFrame:
    """examples with their section's text, null where there is none."""
    return examples.join(sections.select("section_id", F.col("text").alias("section_text")), "section_id", "left")


def error_rate(scored: DataFrame, candidates: Column) -> DataFrame:
    """One row errors, rate: failures among all candidates, those not reached included."""
    return scored.agg(F.coalesce(F.sum(F.col("failed").cast("long")), F.lit(0)).alias("errors")).withColumn("rate", F.col("errors") / F.greatest(candidates, F.lit(1)))


def quotas(sections: DataFrame) -> DataFrame:
    """section_id, ord, target: fixed weights by section; a family's weight is dealt to its members, what is left over goes
    to the first ones. Sections without a weight get no row."""
    family = F.col("section_id").startswith(FAMILY + ".")
    fixed = F.lit(None).cast("long")
    for name, n in WEIGHTS.items():
        fixed = F.when(F.col("section_id") == name, F.lit(n)).otherwise(fixed)
    # A prompt has some dozens of sections; the family's window is over those.
    w = W.partitionBy(family)
    place, n, total = F.row_number().over(w.orderBy("ord")) - 1, F.count("*").over(w), F.lit(WEIGHTS[FAMILY])
    share = F.floor(total / n) + (place < total % n).cast("long")
    return sections.withColumn("target", F.when(family, share).otherwise(fixed).cast("long")).where("target IS NOT NULL").select("section_id", "ord", "target")
