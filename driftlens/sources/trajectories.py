"""Checkpoint rows: (run, tbl, ckpt, step, id, slot, cnt, vec), one row a resident id of a table in a checkpoint.

``read_rows`` reads them from Parquet; the others derive trajectories from ordinary event and fact tables. ``ckpt``
numbers a run's checkpoints 0, 1, 2, ...; a null ``cnt`` means that the table keeps no counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions.sums import cut, joined

SCHEMA = "run string, tbl string, ckpt int, step long, id long, slot long, cnt long, vec array<float>"
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")
FIRST = 4  # checkpoints of the events trajectory stand at the end of every second day from the eighth on, up to the last event


def read_rows(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Rows written as Parquet, at best partitioned by run, tbl and ckpt so that filters prune files."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows if table is None else rows.where(F.col("tbl") == table)


def write_rows(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Rows as Parquet by run, tbl and ckpt; the checkpoints written are marked complete."""
    own = rows.select(*[F.col(c).cast(kind) for c, kind in (f.split() for f in SCHEMA.split(", "))])
    own.write.mode(mode).partitionBy("run", "tbl", "ckpt").parquet(path)
    mark_complete(rows.sparkSession, path, [r.ckpt for r in rows.select("ckpt").distinct().collect()])


def _marks(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_complete")
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def mark_complete(spark: SparkSession, path: str, numbers: list[int]) -> None:
    """Say that all files of these checkpoints are there; readers of the rows do not see the marks."""
    folder, fs, jvm = _marks(spark, path)
    for number in numbers:
        fs.create(jvm.org.apache.hadoop.fs.Path(folder, str(number))).close()


def complete_marks(spark: SparkSession, path: str) -> set[int]:
    folder, fs, _ = _marks(spark, path)
    return {int(s.getPath().getName()) for s in fs.listStatus(folder)} if fs.exists(folder) else set()


def drop_empty_slots(rows: DataFrame, delimiter: int = 2**63 - 1) -> DataFrame:
    """Without the padding of a fixed-size id map."""
    return rows.where(F.col("id") != delimiter)


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Ids that stand twice in one table of one checkpoint; a sound trajectory has none."""
    return rows.groupBy("run", "tbl", "ckpt", "id").agg(F.count("*").alias("n")).where("n > 1")


def checkpoint_index(paths: DataFrame) -> DataFrame:
    """run, path, ckpt: the place of each checkpoint folder in the order of its path."""
    return paths.withColumn("ckpt", (F.row_number().over(Window.partitionBy("run").orderBy("path")) - 1).cast("int"))


def table_of(key: Column) -> Column:
    return F.when(key % 3 == 0, "a").otherwise("b")


def events_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as embedding rows: cumulative value by event type, residents by activity in the last seven days.

    Slots and counts are planted so that moves (id + k divisible by 17) and re-admissions (id + 3k by 29) occur.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    # sums are cut in two, so that whoever did the same has the same values, whatever order tasks add them up in
    parts = [part.alias(f"{side}{i}") for i, t in enumerate(EVENT_TYPES) for side, part in zip("vr", cut(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)), strict=True)]
    sums = [F.sum(f"{side}{i}").alias(f"{side}{i}") for i in range(len(EVENT_TYPES)) for side in "vr"]
    daily = events.select(F.col("user_id").alias("id"), day.alias("day"), *parts).groupBy("id", "day").agg(F.count("*").alias("n"), *sums)
    # one row: how many residents there are, and the last checkpoint
    last = F.greatest(F.ceil(F.max("day") / 2), F.lit(FIRST)).alias("last")
    bounds = F.broadcast(daily.agg(F.floor(F.count_distinct("id") * 2 / 3).alias("cap"), last).withColumn("_all", F.lit(1)))
    k = F.explode(F.sequence(F.greatest(F.ceil(F.col("day") / 2), F.lit(FIRST)), F.col("last"))).alias("k")
    each = daily.withColumn("_all", F.lit(1)).join(bounds, "_all").select(*daily.columns, k)
    total = each.groupBy("k", "id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("day") > 2 * F.col("k") - 7, F.col("n")).otherwise(0)).alias("recent"), *sums)
    # residents are the cap most active users of a checkpoint: windows span one count of recent events, and how many
    # users had more is summed over the counts that occur
    active = total.where("recent > 0")
    levels = active.groupBy("k", "recent").agg(F.count("*").alias("users"))
    above = F.coalesce(F.sum("users").over(Window.partitionBy("k").orderBy(F.desc("recent")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = levels.withColumns({"above": above, "_all": F.lit(1)}).join(bounds, "_all").withColumn("room", F.col("cap") - F.col("above")).where("room > 0").select("k", "recent", "room")
    order = Window.partitionBy("k", "recent").orderBy("id")
    ranked = active.join(room, ["k", "recent"]).withColumn("r", F.row_number().over(order))
    k, key = F.col("k"), F.col("id")
    return ranked.where(F.col("r") <= F.col("room")).select(
        F.lit("e").alias("run"), table_of(key).alias("tbl"), (k - FIRST).cast("int").alias("ckpt"), (2 * k).cast("long").alias("step"), "id",
        F.when((key + k) % 17 == 0, key + 1).otherwise(key).alias("slot"), F.when((key + 3 * k) % 29 == 0, 0).otherwise(F.col("n")).cast("long").alias("cnt"),
        F.array(*[joined(F.col(f"v{i}"), F.col(f"r{i}")) for i in range(len(EVENT_TYPES))]).alias("vec"),
    )


def lineitem_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as embedding rows: what each quarter shipped of them; the count is that of the quarter's lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    quarter = ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1).cast("int")
    sums = [F.sum(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return lines.groupBy(quarter.alias("ckpt"), F.col("l_partkey").alias("id")).agg(F.count("*").alias("cnt"), F.array(*sums).alias("vec")).select(F.lit("l").alias("run"), F.lit("parts").alias("tbl"), "ckpt", F.col("ckpt").cast("long").alias("step"), "id", F.col("id").alias("slot"), "cnt", "vec")


def embeddings_trajectory(spark: SparkSession, sf_dir: str, checkpoints: int = 4) -> DataFrame:
    """The embeddings table with a planted drift: each checkpoint turns the first eight coordinates into others."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    k = F.explode(F.sequence(F.lit(0), F.lit(checkpoints - 1))).alias("ckpt")
    drift = F.transform("v", lambda x, i: F.when(i < 8, x * (1 + F.col("ckpt") * 0.5)).otherwise(x * (1 - 0.05 * F.col("ckpt"))))
    return base.select("*", k).select(F.lit("v").alias("run"), F.lit("vectors").alias("tbl"), "ckpt", (F.col("ckpt") * 100).cast("long").alias("step"), "id", F.col("id").alias("slot"), (F.col("ckpt") * (1 + F.col("id") % 7)).cast("long").alias("cnt"), drift.alias("vec"))
