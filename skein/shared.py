"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where files go if spark.checkpoint.dir is unset, which is an error outside local mode.
DEFAULT = "/tmp/checkpoints/skein"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a default where that is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = DEFAULT
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() has made and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._skein_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Plans whose rows come in the same order whenever they are read.
_SCANS = {"LogicalRelation", "Relation", "Project", "Filter", "Union", "LocalRelation", "Range", "SubqueryAlias", "View"}


def stable(df: DataFrame, name: str = "rows") -> DataFrame:
    """df if it is a scan (with deterministic projections, filters and unions), whose rows monotonically_increasing_id()
    numbers alike each time; else df written as a table."""

    def scan(plan) -> bool:
        children = plan.children()
        kind = plan.getClass().getSimpleName()
        fixed = kind in _SCANS or (kind == "LogicalRDD" and "ParallelCollectionRDD" in plan.rdd().toDebugString())
        return fixed and plan.deterministic() and all(scan(children.apply(k)) for k in range(children.size()))

    return df if scan(df._jdf.queryExecution().analyzed()) else written(df, name)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, or the name with as many underscores after it as make it a column that df lacks (names differ by case too)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
