"""Skill files: front matter between --- lines, then a body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import strip
from skein.sources.sessions import missing


def parse_skill(raw: Column) -> Column:
    """struct<raw, frontmatter, body, name, description>.

    A text that begins with --- (after blank space) and has a second --- has front matter between them; otherwise all of
    it is the body. Of several name or description lines the last one counts; blank space and quotes around are taken off.
    """
    parts = F.split(raw, "---", 3)
    has = strip(raw).startswith("---") & (F.size(parts) == 3)
    front = F.when(has, strip(F.get(parts, F.lit(1)))).otherwise("")

    def value(key: str) -> Column:
        lines = F.filter(F.split(front, "\n"), lambda line: strip(line).startswith(f"{key}:"))
        last = F.try_element_at(lines, F.lit(-1))
        text = strip(F.regexp_replace(last, "(?s)^[^:]*:", ""))
        return F.coalesce(F.regexp_replace(text, "^['\"]+|['\"]+\\z", ""), F.lit(""))

    return F.struct(raw.alias("raw"), front.alias("frontmatter"), F.when(has, strip(F.get(parts, F.lit(2)))).otherwise(raw).alias("body"), value("name").alias("name"), value("description").alias("description"))


def read_skills(spark: SparkSession, pattern: str) -> DataFrame:
    """path, raw, frontmatter, body, name, description of the files that match the pattern."""
    if missing(spark, pattern):
        return spark.createDataFrame([], "path string, raw string, frontmatter string, body string, name string, description string")
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parse_skill(F.col("value")).alias("s"))
    return files.select("path", "s.*")


def find_skill(skills: DataFrame, name: str) -> DataFrame:
    """At most one row of skills: the file whose folder has the name, else one whose first 500 characters hold
    `name: <name>`, with or without double quotes; of several the first path."""
    folder = F.url_decode(F.regexp_extract("path", "([^/]*)/[^/]*$", 1))
    head = F.substring("raw", 1, 500)
    rank = F.when(folder == name, 1).when(head.contains(f"name: {name}") | head.contains(f'name: "{name}"'), 2)
    return skills.withColumn("_rank", rank).where("_rank IS NOT NULL").orderBy("_rank", "path").limit(1).drop("_rank")


def installed_skill(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The one row of folder/name/SKILL.md, else of the first folder/*/name/SKILL.md; FileNotFoundError if there is none."""
    for pattern in (f"{folder}/{name}/SKILL.md", f"{folder}/*/{name}/SKILL.md"):
        if not missing(spark, pattern):
            return read_skills(spark, pattern).orderBy("path").limit(1)
    raise FileNotFoundError(f"no skill {name} under {folder}")
