"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import measured, released, settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that is not the least of its component; the component is its least node.

    An edge has a low and a high end. In each round every high end follows its low end's least lower neighbour, and
    then the lower neighbours of each node are tied to the least of them. Neither adds an edge or parts what was
    connected, and ends only ever fall, until each component is a star around its least node; that takes rounds in
    the order of the logarithm of a component's size. A round is one plan and one checkpoint, which also says
    whether an end fell. A hub costs one partial minimum a task and, in joins, what the adaptive planner splits.
    """
    now, seen = measured(edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low < high"))
    fell = seen["rows"]
    while fell:
        last, (now, seen) = now, measured(_round(now), fell=F.sum(F.col("fell").cast("int")))
        released(last)
        now, fell = now.select("low", "high"), seen["fell"]
    named = settled(now.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component")))
    released(now)
    return named


def _round(edges: DataFrame) -> DataFrame:
    least = lambda e: e.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
    lower = least(edges)
    stars = edges.join(lower, edges["low"] == lower["node"], "left").select(F.coalesce("least", "low").alias("low"), "high", F.col("least").isNotNull().alias("fell"))
    lower = least(stars)
    tied = stars.join(lower, stars["high"] == lower["node"])
    top = F.col("low") == F.col("least")
    return tied.select(F.col("least").alias("low"), F.when(top, F.col("high")).otherwise(F.col("low")).alias("high"), (F.col("fell") | ~top).alias("fell"))
