"""Evaluation datasets: three JSON-lines splits under one folder, or one golden file that is split when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.ordering import with_ordinals
from skein.operators.splits import shuffled, split_by_rank
from skein.schemas import DEFAULTS, EVAL_EXAMPLE, SECTION_EXAMPLE, TOOL_EXAMPLE
from skein.sources.commits import current, replacing
from skein.sources.sessions import missing

SPLITS = ("train", "val", "holdout")
KINDS: dict[str, T.StructType] = {"eval": EVAL_EXAMPLE, "tool": TOOL_EXAMPLE, "section": SECTION_EXAMPLE}


def _checked(df: DataFrame, kind: str) -> DataFrame:
    """Defaults filled in; a required field that is missing stops the read."""
    out = []
    for f in KINDS[kind]:
        c = F.col(f.name)
        if f.name in DEFAULTS[kind]:
            value = DEFAULTS[kind][f.name]
            default = F.array().cast(f.dataType) if value == [] else F.lit(value)
            out.append(F.coalesce(c, default).alias(f.name))
        else:
            out.append(F.coalesce(c, F.raise_error(F.lit(f"required field {f.name} is missing")).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def read_lines(spark: SparkSession, path: str, kind: str = "eval") -> DataFrame:
    """Examples of a JSON-lines file: blank lines skipped, unknown keys dropped, a malformed line stops the read."""
    return _checked(spark.read.schema(KINDS[kind]).option("mode", "FAILFAST").json(path), kind)


def load_dataset(spark: SparkSession, folder: str, kind: str = "eval") -> DataFrame:
    """All splits that are there, with a column split: those of the committed version, or else of the folder itself."""
    out = spark.createDataFrame([], KINDS[kind]).withColumn("split", F.lit(""))
    at = current(spark, folder)
    for name in SPLITS:
        for path in (f"{at}/{name}.jsonl", f"{at}/split={name}"):
            if not missing(spark, path):
                out = out.unionByName(read_lines(spark, path, kind).withColumn("split", F.lit(name)))
                break
    return out


def save_dataset(examples: DataFrame, folder: str) -> None:
    """Writes JSON lines as a new version with folders split=<name>, all three even if empty, in one pass over the examples; it
    replaces what was there at once when all are written, and not at all if a task fails."""
    spark = examples.sparkSession
    with replacing(spark, folder) as path:
        examples.where(F.col("split").isin(*SPLITS)).write.partitionBy("split").json(path)
        for name in SPLITS:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/split={name}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def load_golden(spark: SparkSession, path: str, kind: str = "eval", seed: str = "42") -> DataFrame:
    """The splits under path if train is there; else the .jsonl file itself or path/golden.jsonl, shuffled and split."""
    at = current(spark, path)
    if not all(missing(spark, p) for p in (f"{at}/train.jsonl", f"{at}/split=train")):
        return load_dataset(spark, path, kind)
    one = path if path.endswith(".jsonl") else f"{path}/golden.jsonl"
    if missing(spark, one):
        raise FileNotFoundError(f"no dataset at {path}")
    rows = read_lines(spark, one, kind)
    content = F.to_json(F.struct(*rows.columns))
    # Equal rows are alike, so an order by content gives the same splits whatever the layout of the files.
    ranked = with_ordinals(rows.withColumns({"_h": shuffled(content, seed), "_content": content}), "_h", "_content", name="_rank").drop("_h", "_content")
    return split_by_rank(ranked, "_rank", rows.agg(F.count("*").alias("_total")))
