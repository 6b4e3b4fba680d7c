"""Checkpoint rows as a table bucketed by id, so that consecutive checkpoints meet without a shuffle.

Rows are dealt once, when a checkpoint is written. All rows of an id, whatever their checkpoint, lie in one bucket, which is what
windows and joins by (run, tbl, id) ask for: of ``id_pairs`` and ``churn_counts`` over such a table only counts are shuffled.
A new checkpoint is appended with the same number of buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.sources.trajectories import SCHEMA

KEY = ("run", "tbl", "id")


def write_bucketed(rows: DataFrame, name: str, buckets: int, mode: str = "error") -> None:
    """Rows as a table of so many buckets, each in order of its ids; one file a bucket and write."""
    own = rows.select(*[F.col(c).cast(kind) for c, kind in (f.split() for f in SCHEMA.split(", "))])
    dealt = own.repartition(buckets, *KEY).sortWithinPartitions(*KEY, "ckpt")
    dealt.write.mode(mode).format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY, "ckpt").saveAsTable(name)


def append_checkpoint(rows: DataFrame, name: str) -> None:
    """Add the rows of new checkpoints, dealt like those of the table."""
    write_bucketed(rows, name, buckets_of(rows.sparkSession, name), "append")


def buckets_of(spark: SparkSession, name: str) -> int:
    return next(int(r.data_type) for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Num Buckets")
