"""Events that fire together, as incidents: chains of indices at most a gap apart, over tables, metrics and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_incidents(events: DataFrame, gap: int = 1) -> DataFrame:
    """events with incident, a number from 0 in order of index within each run.

    The chains are found on the distinct indices of a run, which are as few as its checkpoints.
    """
    w = Window.partitionBy("run").orderBy("idx")
    chained = events.select("run", "idx").distinct().withColumn("_new", F.coalesce((F.col("idx") - F.lag("idx").over(w) > gap).cast("int"), F.lit(0)))
    return events.join(chained.select("run", "idx", F.sum("_new").over(w).alias("incident")), ["run", "idx"])


def incidents(events: DataFrame, gap: int = 1) -> DataFrame:
    """A row an incident: severity and headline of its strongest event, size, tables, distinct steps."""
    head = F.max_by(F.struct("tbl", "metric", "method", "step"), F.struct("severity", -F.col("idx"), "tbl", "metric", "method")).alias("head")
    return assign_incidents(events, gap).groupBy("run", "incident").agg(
        F.max("severity").alias("severity"), F.count("*").alias("n_events"), F.array_sort(F.collect_set("tbl")).alias("tables"),
        F.array_sort(F.collect_set("step")).alias("steps"), head,
    )
