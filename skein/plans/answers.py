"""Kept answers: a model that is asked each distinct request once, over all rows, retries and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.judge import Model, ask_each
from skein.shared import discard, unused, written

SCHEMA = "digest string, answer string, asked_at timestamp"

#: Requests a task: what a task that is lost asks again at most.
PER_TASK = 1024


class Stored:
    """A model with a folder of its answers, which any store that Spark writes can hold.

    ask() on it computes at once: rows are reduced to their distinct requests, those with an answer in the folder are left out,
    the rest are asked in tasks of PER_TASK requests, and their answers are appended as one batch that counts when its job is
    done. Failed calls are not kept, so a later run asks them again. If two runs answered the same request, the earlier
    answer holds. name stands for the model and its settings: answers of another name are not used.
    """

    def __init__(self, model: Model, path: str, name: str = ""):
        self.model, self.path, self.name = model, path.rstrip("/"), name

    def answers(self, spark: SparkSession, task: str) -> DataFrame:
        """digest, answer (JSON) of a task: one row a request; batches whose job did not end are no part of it."""
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        pattern = fs_path(f"{self.path}/task={task}/*/_SUCCESS")
        done = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        batches = [str(x.getPath().getParent()) for x in done or []]
        if not batches:
            return spark.createDataFrame([], "digest string, answer string")
        kept = spark.read.schema(SCHEMA).parquet(*batches)
        return kept.groupBy("digest").agg(F.min_by("answer", F.struct("asked_at", "answer")).alias("answer"))

    def compact(self, spark: SparkSession, task: str) -> None:
        """All batches of a task as one. For when no run uses the folder."""
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        top = fs_path(f"{self.path}/task={task}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        old = [x.getPath() for x in fs.listStatus(top)] if fs.exists(top) else []
        self.answers(spark, task).withColumn("asked_at", F.current_timestamp()).write.parquet(self._batch(task))
        for path in old:
            fs.delete(path, True)

    def _batch(self, task: str) -> str:
        return f"{self.path}/task={task}/batch={uuid.uuid4().hex}"

    def ask_stored(self, rows: DataFrame, task: str, inputs: dict[str, str], outputs: list[str], batch: int) -> DataFrame:
        """What judge.ask() returns for this model."""
        (digest,) = unused(rows, "_digest")
        parts = [F.lit(x) for x in (self.name, task, ",".join(outputs))] + [F.coalesce(F.col(inputs[k]).cast("string"), F.lit("")) for k in sorted(inputs)]
        request = F.to_json(F.array(*parts))  # no two lists of texts have one JSON text
        keyed = rows.withColumn(digest, F.sha2(request.cast("binary"), 256))
        fields = sorted(set(inputs.values()))
        distinct = keyed.groupBy(F.col(digest).alias("digest")).agg(*[F.first(F.col(c)).alias(f"in{k}") for k, c in enumerate(fields)])
        spark = rows.sparkSession
        known = self.answers(spark, task)
        pending = written(distinct.join(known.select("digest"), "digest", "left_anti"), "requests")
        n = pending.count()
        if n:
            places = {name: f"in{fields.index(c)}" for name, c in inputs.items()}
            asked = ask_each(pending.repartition(-(-n // PER_TASK), "digest"), self.model, task, places, outputs, batch)
            answer = F.to_json(F.struct(*[F.col(o).alias(o) for o in outputs]))
            asked.where("NOT failed").select("digest", answer.alias("answer"), F.current_timestamp().alias("asked_at")).write.parquet(self._batch(task))
            known = self.answers(spark, task)
        discard(pending)
        kept = known.select(F.col("digest").alias(digest), F.from_json("answer", ", ".join(f"`{o}` string" for o in outputs)).alias("_answer"))
        joined = keyed.join(kept, digest, "left")
        return joined.select(*[keyed[f"`{c}`"] for c in rows.columns], *[F.col(f"_answer.`{o}`").alias(o) for o in outputs], F.col("_answer").isNull().alias("failed"))
