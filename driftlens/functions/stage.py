"""Cutting the lineage of intermediate results that several branches of a plan read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint, so that it is computed once and plans over it stay short.

    It lies in the folder that spark.checkpoint.dir names; only where none is set, under the warehouse.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()
