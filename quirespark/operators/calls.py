"""Calls that cost money, made once: a log that keeps each task's answers as the task ends.

Open rows are dealt to tasks of a bounded number of calls, and tasks to waves of so many as may ask at a time; a wave is one
Spark job that appends to the log. Its files are committed task by task (the committer's second algorithm moves them when a
task commits, not when the job does), so a run that is killed loses the calls of unfinished tasks only; the next run asks for
what has no answer yet. Rows whose call failed, which have a null answer, are asked again in further rounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.sources import store

#: Answers that a task makes before it commits.
PER_TASK = 64


def answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a log, those of killed runs too."""
    parts = [f"{path}/{n}" for n in store.children(spark, path) if any(f.startswith("part-") for f in store.children(spark, f"{path}/{n}"))]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def logged(
    asked: DataFrame, model: Callable[[DataFrame], DataFrame], path: str, keys: list[str], into: str = "output", rounds: int = 2, workers: int | None = None, per_task: int = PER_TASK
) -> DataFrame:
    """``asked`` with the model's answers ``into``, null where all ``rounds`` failed, from the log in ``path``.

    ``keys`` are whole numbers or strings without null that tell rows apart, and what they stand for: rows that repeat them are
    asked once. ``asked`` is read once for each wave, so write it before if it is costly or not stable. At most ``workers``
    tasks ask at a time.
    """
    spark, path = asked.sparkSession, path.rstrip("/")
    kinds = ", ".join(f"`{c}` {k}" for c, k in asked.select(*keys).dtypes) + f", `{into}` string"
    for _ in range(rounds):
        done = answers(spark, path, kinds).filter(F.col(into).isNotNull()).select(*keys)
        open_ = asked.dropDuplicates(keys).join(done, keys, "left_anti")
        n = open_.count()
        if not n:
            break
        tasks = -(-n // per_task)
        waves = -(-tasks // workers) if workers else 1
        run = uuid.uuid4().hex[:12]
        for wave in range(waves):
            own = open_.filter(F.pmod(F.xxhash64(*keys), F.lit(waves)) == wave).repartition(-(-tasks // waves), F.xxhash64(*keys))
            out = model(own).select(*keys, F.col(into).cast("string").alias(into))
            out.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{path}/{run}-{wave}")
    known = answers(spark, path, kinds).groupBy(*keys).agg(F.max(into).alias(into))  # two runs at a time may both have an answer
    return asked.drop(into).join(known, keys, "left")
