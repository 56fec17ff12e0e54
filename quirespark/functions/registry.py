"""Kernels under names of their own, for use in SQL, and progress of a running query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import kernels

KERNELS = {
    "quire_headings": kernels.headings_udf,
    "quire_table_rows": kernels.table_rows_udf,
    "quire_table_widths": kernels.table_widths_udf,
    "quire_equations": kernels.equations_udf,
    "quire_tables": kernels.tables_udf,
    "quire_table_blocks": kernels.table_blocks_udf,
    "quire_stretches": kernels.stretches_udf,
    "quire_without_echoes": kernels.without_echoes_udf,
}


def register(spark: SparkSession) -> list[str]:
    """Makes the kernels SQL functions of a session; their names."""
    for name, kernel in KERNELS.items():
        spark.udf.register(name, kernel())
    return [*KERNELS]


def observed(rows: DataFrame, then: Callable[[dict], None], **metrics) -> tuple[DataFrame, Callable[[], None]]:
    """``rows`` with running aggregates, and a function that hands them to ``then`` once the query has run."""
    seen = Observation()
    named = [F.count("*").alias("rows"), *(c.alias(n) for n, c in metrics.items())]
    return rows.observe(seen, *named), lambda: then(seen.get)
