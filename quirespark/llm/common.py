"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in every operator here.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` names it.

    Inside a lambda, an outer column is put in again for every element once projections collapse; a
    lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. ``lower`` is far quicker and agrees on pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text without nulls, in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder: the one its settings name, else, on a local master only, a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quirespark-"))
    return spark


def settled(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and kept in the shared checkpoint folder, its lineage cut."""
    with_checkpoints(frame.sparkSession)
    return frame.checkpoint(eager=True)


def measured(frame: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``settled``, with aggregates of the rows, which are taken as the rows are written."""
    seen = Observation()
    first, *more = (c.alias(n) for n, c in {"rows": F.count("*"), **metrics}.items())
    return settled(frame.observe(seen, first, *more)), seen.get


def released(frame: DataFrame) -> None:
    """Deletes the files of a settled frame that nothing will read again."""
    kept = frame._jdf.queryExecution().analyzed().collectLeaves().head().rdd()
    file = kept.getCheckpointFile()
    if file.isDefined():
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until it is none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def place_of(frame: DataFrame, column: str) -> int:
    """Where ``column``, in any case that Spark takes for it, stands among the columns."""
    name = frame.select(F.col(column)).columns[0]
    return frame.columns.index(name) if name in frame.columns else [c.lower() for c in frame.columns].index(name.lower())


def small_enough(frame: DataFrame, most: int) -> bool:
    """Whether ``frame`` has at most ``most`` rows; what justifies a broadcast."""
    return frame.limit(most + 1).count() <= most
