"""Column functions on texts: secrets, relevance, validation, scores.

Blank space is Unicode white space and the separators U+001C to U+001F, lengths count code points.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\s\\x1c-\\x1f]"

#: Texts that hold one of these are secrets, in any case.
SECRETS = [
    r"sk-ant-api\S+",
    r"sk-or-v1-\S+",
    r"sk-\S{20,}",
    r"ghp_\S+",
    r"ghu_\S+",
    r"xoxb-\S+",
    r"xapp-\S+",
    r"ntn_\S+",
    r"AKIA[0-9A-Z]{16}",
    r"Bearer\s+\S{20,}",
    r"-----BEGIN\s+(RSA\s+)?PRIVATE\sKEY-----",
    r"ANTHROPIC_API_KEY",
    r"OPENAI_API_KEY",
    r"OPENROUTER_API_KEY",
    r"SLACK_BOT_TOKEN",
    r"GITHUB_TOKEN",
    r"AWS_SECRET_ACCESS_KEY",
    r"DATABASE_URL",
    r"\bpassword\s*[=:]\s*\S+",
    r"\bsecret\s*[=:]\s*\S+",
    r"\btoken\s*[=:]\s*\S{10,}",
]

#: Each pattern has one of these in it, in lower case. They are rare in prose, so few texts are searched for the patterns.
LITERALS = ["sk-", "ghp_", "ghu_", "xoxb-", "xapp-", "ntn_", "akia", "bearer", "-----begin", "_api_key", "token", "secret", "database_url", "password"]
#: Characters that match an ASCII letter in any case and that lower() does not turn into it alone.
FOLDED = ["\u017f", "\u0130", "\u0131", "\u212a"]

#: Fixed values of example validation.
DIFFICULTIES, MAX_TASK, MIN_LENGTH = ("easy", "medium", "hard"), 2000, 10


def strip(c: Column) -> Column:
    """Without blank space at both ends."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+\\z", "")


def tokens(c: Column) -> Column:
    """Pieces between blank space; none for a blank text."""
    return F.filter(F.split(c, f"(?U){SPACE}+"), lambda x: x != "")


def is_blank(c: Column) -> Column:
    """Null, empty or only blank space."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def contains_secret(c: Column) -> Column:
    """True if a secret's pattern is found anywhere; null is none.

    The patterns are one compiled expression, which takes long as it ignores case in all of Unicode. It runs on texts that hold
    one of LITERALS, without which nothing matches, or one of FOLDED, beside which a literal is not seen in lower case.
    """
    some = functools.partial(functools.reduce, Column.__or__)
    near = F.exists(F.array(F.lower(c)), lambda low: some([low.contains(x) for x in LITERALS])) | some([c.contains(x) for x in FOLDED])
    return F.when(near, c.rlike("(?iuU)(" + "|".join(SECRETS) + ")")).otherwise(F.lit(False))


def long_enough(c: Column, least: int = MIN_LENGTH) -> Column:
    return F.coalesce(F.length(c) >= least, F.lit(False))


def has_value(*cols: Column) -> Column:
    """All are neither null nor empty."""
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce(F.length(c) > 0, F.lit(False))
    return out


def keywords(skill_text: str) -> list[str]:
    """Words of over four letters a-z in the first 500 characters, other characters taken out of each; sorted."""
    out = {"".join(ch for ch in w if "a" <= ch <= "z") for w in skill_text[:500].lower().split()}
    return sorted(w for w in out if len(w) > 4)


def is_relevant(c: Column, skill_name: str, skill_text: str) -> Column:
    """A cheap guess whether a message concerns a skill.

    True if the skill's name (- and _ as blanks) stands in the message, or one of its words of over three characters,
    or at least two of the skill text's keywords are words of the message. An empty name stands in any message.
    """
    low = F.lower(c)
    name = skill_name.lower().replace("-", " ").replace("_", " ")
    hit = low.contains(name)
    for w in sorted({w for w in name.split() if len(w) > 3}):
        hit = hit | low.contains(w)
    if found := keywords(skill_text):
        own = tokens(F.regexp_replace(low, "(?U)[^a-z\\s\\x1c-\\x1f]", ""))
        hit = hit | (F.size(F.array_intersect(own, F.array(*map(F.lit, found)))) >= 2)
    return F.coalesce(hit, F.lit(False))


def validated(task: Column, expected: Column, difficulty: Column, category: Column) -> Column:
    """struct<task_input, expected_behavior, difficulty, category>, or null for a blank task or expectation."""
    level = F.lower(strip(difficulty))
    kind = strip(category)
    ok = ~is_blank(task) & ~is_blank(expected)
    return F.when(ok, F.struct(
        F.substring(task, 1, MAX_TASK).alias("task_input"), strip(expected).alias("expected_behavior"),
        F.when(level.isin(*DIFFICULTIES), level).otherwise("medium").alias("difficulty"),
        F.when(F.length(kind) > 0, kind).otherwise("general").alias("category"),
    ))


def shortened(skill: Column, message: Column, response: Column) -> Column:
    """What a judge is shown: 800, 1000 and 1000 characters."""
    return F.struct(F.substring(skill, 1, 800).alias("skill"), F.substring(message, 1, 1000).alias("message"), F.substring(F.coalesce(response, F.lit("")), 1, 1000).alias("response"))


def clamped(x: Column) -> Column:
    """To 0..1; not-a-number gives 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def parse_score(raw: Column) -> Column:
    """A judge's score, clamped to 0..1: decimal notation with an exponent or single underscores between digits, inf and
    nan in any case and with a sign, blank space around; anything else, null too, is 0.5."""
    s = F.lower(strip(raw))
    digits = "\\d+(_\\d+)*"
    number = s.rlike(f"^[+-]?({digits}(\\.({digits})?)?|\\.{digits})(e[+-]?{digits})?\\z")
    return (
        F.when(number, clamped(F.replace(s, F.lit("_"), F.lit("")).try_cast("double")))
        .when(s.rlike("^\\+?inf(inity)?\\z"), 1.0).when(s.rlike("^-inf(inity)?\\z"), 0.0).when(s.rlike("^[+-]?nan\\z"), 0.0).otherwise(0.5)
    )


def parse_bool(raw: Column) -> Column:
    """True for true, yes or 1 in any case, blank space around; anything else, null too, is false."""
    return F.coalesce(F.lower(strip(raw)).isin("true", "yes", "1"), F.lit(False))


def length_penalty(size: Column, most: Column) -> Column:
    """0 up to 90 % of the limit, then rising to 0.3 at 100 %; 0 where a size or limit is missing."""
    ratio = size.cast("double") / most
    return F.coalesce(F.when(ratio > 0.9, F.least(F.lit(0.3), (ratio - 0.9) * 3.0)), F.lit(0.0))


def composite(correctness: Column, procedure: Column, conciseness: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.5 * correctness + 0.3 * procedure + 0.2 * conciseness - penalty)


def token_overlap(expected: Column, output: Column) -> Column:
    """0 for a blank output, 0.5 without expected words, else 0.3 and 0.7 of the share of expected words in the output."""
    want, got = (F.array_distinct(tokens(F.lower(F.coalesce(c, F.lit(""))))) for c in (expected, output))
    share = F.size(F.array_intersect(want, got)) / F.size(want)
    return F.when(is_blank(output), 0.0).when(F.size(want) == 0, 0.5).otherwise(clamped(0.3 + 0.7 * share))


def exact_match(expected: Column, selected: Column) -> Column:
    """1.0 if equal without case and blank space around; two missing values are equal."""
    a, b = (F.lower(strip(F.coalesce(c, F.lit("")))) for c in (expected, selected))
    return F.when(a == b, 1.0).otherwise(0.0)


def wrapped(text: str, width: int = 70) -> list[str]:
    """Pieces of a text of at most width characters, cut after blanks, which stay with the piece before; a longer word
    stands alone. Joined they give the text again."""
    out, line = [], ""
    for part in text.replace(" ", " \0").split("\0"):
        if line and len(line) + len(part.rstrip(" ")) > width:
            out.append(line)
            line = ""
        line += part
    return [*out, line] if line or not out else out


def quoted(text: str) -> str:
    """A text as the inside of a double-quoted Python literal."""
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
