"""Consecutive checkpoints joined by id: the measure of what stayed, came, went, moved and was let in again.

Identity is the id, never the slot. All pairs of all runs and tables come from one shuffle on (run, tbl, id): a row
sees its id's rows in the checkpoints before and after by lag and lead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["run", "tbl", "pair"]
STATUSES = ("clean", "slot_moved", "readmitted", "inserted", "evicted")


def pair_tables(rows: DataFrame) -> DataFrame:
    """run, tbl, pair, n_prev, n_cur, counted, step: tables that stand in both checkpoints of a pair."""
    own = rows.groupBy("run", "tbl", "ckpt").agg(F.count("*").alias("n"), (F.count("cnt") > 0).alias("has"), F.max("step").alias("step"))
    prev = own.select("run", "tbl", F.col("ckpt").alias("pair"), F.col("n").alias("n_prev"), F.col("has").alias("_had"))
    cur = own.select("run", "tbl", (F.col("ckpt") - 1).alias("pair"), F.col("n").alias("n_cur"), "has", F.coalesce("step", (F.col("ckpt") - 1).cast("long")).alias("step"))
    return prev.join(cur, PAIR).select(*PAIR, "n_prev", "n_cur", (F.col("has") & F.col("_had")).alias("counted"), "step")


def id_pairs(rows: DataFrame, vectors: bool = True) -> DataFrame:
    """run, tbl, pair, step, id, prev, cur (slot, cnt, vec), dcount, status of every id in either checkpoint of a pair.

    Without vectors the scan leaves them out. dcount is 0 where either side keeps no counts.
    """
    here = F.struct("slot", "cnt", *(["vec"] if vectors else []))
    own = rows.select("run", "tbl", "ckpt", "id", here.alias("here"))
    w = Window.partitionBy("run", "tbl", "id").orderBy("ckpt")
    seen = own.withColumns({"_before": F.lag("ckpt").over(w), "_was": F.lag("here").over(w), "_next": F.lead("ckpt").over(w)})
    none = F.lit(None).cast(seen.schema["here"].dataType)
    came = F.struct((F.col("ckpt") - 1).alias("pair"), F.when(F.col("_before") == F.col("ckpt") - 1, F.col("_was")).alias("prev"), F.col("here").alias("cur"))
    went = F.struct(F.col("ckpt").alias("pair"), F.col("here").alias("prev"), none.alias("cur"))
    both = F.explode(F.array_compact(F.array(came, F.when(~F.col("_next").eqNullSafe(F.col("ckpt") + 1), went)))).alias("x")
    pairs = seen.select("run", "tbl", "id", both).select("run", "tbl", "x.pair", "id", "x.prev", "x.cur")
    counted = pairs.join(pair_tables(rows).select(*PAIR, "counted", "step"), PAIR)
    dcount = F.when(F.col("counted"), F.coalesce(F.col("cur.cnt"), F.lit(-1)) - F.coalesce(F.col("prev.cnt"), F.lit(-1))).otherwise(0).cast("long")
    status = (
        F.when(F.col("prev").isNull(), "inserted").when(F.col("cur").isNull(), "evicted")
        .when(F.col("prev.slot") != F.col("cur.slot"), "slot_moved").when(F.col("dcount") < 0, "readmitted").otherwise("clean")
    )
    return counted.withColumn("dcount", F.when(F.col("prev").isNull() | F.col("cur").isNull(), F.lit(None).cast("long")).otherwise(dcount)).withColumn("status", status).drop("counted")


def ids_with(pairs: DataFrame, status: str) -> DataFrame:
    """run, tbl, pair, id of one status."""
    return pairs.where(F.col("status") == status).select(*PAIR, "id")


def churn_counts(rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Cardinalities of each pair, from pairs (id_pairs) where given; n_clean counts ids with a stable slot not let in again."""
    pairs = id_pairs(rows, vectors=False) if pairs is None else pairs
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    sides = [F.count_if(F.col("status") != "inserted").alias("n_prev"), F.count_if(F.col("status") != "evicted").alias("n_cur")]
    counted = pairs.groupBy(*PAIR).agg(*counts, *sides, F.max("step").alias("step"))
    return counted.withColumn("n_survivors", F.col("n_clean") + F.col("n_slot_moved") + F.col("n_readmitted"))


def churn_rates(counts: DataFrame) -> DataFrame:
    """Rates of insertion and eviction over the current residents, of moves and re-admissions over the survivors."""
    residents, survivors = F.greatest("n_cur", F.lit(1)), F.greatest("n_survivors", F.lit(1))
    return counts.select(
        *PAIR, "step", (F.col("n_inserted") / residents).alias("inserted_rate"), (F.col("n_evicted") / residents).alias("evicted_rate"),
        (F.col("n_slot_moved") / survivors).alias("slot_moved_rate"), (F.col("n_readmitted") / survivors).alias("readmit_rate"),
    )


def look_up(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (run, tbl, ckpt, id) with slot and cnt of resident ids, -1 for others."""
    return wanted.join(rows.select("run", "tbl", "ckpt", "id", "slot", "cnt"), ["run", "tbl", "ckpt", "id"], "left").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("slot", "cnt")})


def gather(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (run, tbl, ckpt, id) with vec; an id that is not resident is an error."""
    found = wanted.join(rows.select("run", "tbl", "ckpt", "id", "vec"), ["run", "tbl", "ckpt", "id"], "left")
    missing = F.raise_error(F.concat(F.lit("not resident: "), F.col("id").cast("string"))).cast(rows.schema["vec"].dataType)
    return found.withColumn("vec", F.when(F.col("vec").isNull(), missing).otherwise(F.col("vec")))
