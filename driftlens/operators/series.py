"""One scalar series for each table and metric, from the pairs of a trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.stage import settle
from driftlens.functions.sums import total
from driftlens.operators.geometry import dense_deltas, dense_spectra, geometry, spectra
from driftlens.operators.movement import freq_residual, frozen_score, measured, movement_summary, score_tails
from driftlens.operators.pairs import PAIR, churn_counts, churn_rates, id_pairs

CHURN = ("inserted_rate", "evicted_rate", "slot_moved_rate", "readmit_rate")
MOVEMENT = ("mover_frac", "delta_p50", "delta_p95", "delta_max", "freq_resid_max", "n_freq_resid_hi", "frozen_max")
GEOMETRY = ("effective_rank", "anisotropy", "mean_row_norm")
DENSE = "dense:"  # tables of whole tensors bear this prefix


def features(rows: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """A row a pair with its features; shape (run, tbl, ckpt, effective_rank, anisotropy) adds those of the current side."""
    # one narrow table: the vectors are shuffled once, and all that follows reads a few numbers an id
    kept = settle(id_pairs(rows).select(*PAIR, "step", "id", "status", *measured()))
    moves = kept.where("status = 'clean'").drop("status", "step", "norm")
    scored = settle(frozen_score(freq_residual(moves)))
    norms = kept.where("status <> 'evicted'").groupBy(*PAIR).agg((total(F.col("norm")) / F.count("norm")).alias("mean_row_norm"))
    out = churn_rates(churn_counts(rows, kept)).join(movement_summary(moves), PAIR, "left").join(score_tails(scored), PAIR, "left").join(norms, PAIR, "left")
    if shape is not None:
        out = out.join(shape.select("run", "tbl", (F.col("ckpt") - 1).alias("pair"), "effective_rank", "anisotropy"), PAIR, "left")
    return settle(out.na.fill(0.0, list(MOVEMENT)))


def to_series(wide: DataFrame) -> DataFrame:
    """run, tbl, metric, idx, step, value."""
    metrics = [c for c in (*CHURN, *MOVEMENT, *GEOMETRY, "rel_delta_norm", "cosine") if c in wide.columns]
    long = wide.select(*PAIR, "step", *[F.col(c).cast("double") for c in metrics]).unpivot([*PAIR, "step"], metrics, "metric", "value")
    return long.select("run", "tbl", "metric", F.col("pair").alias("idx"), "step", "value")


def fill_gaps(series: DataFrame) -> DataFrame:
    """The same with a null value at every index of the run at which a table's metric is missing."""
    steps = series.groupBy("run", "idx").agg(F.max("step").alias("step"))
    length = steps.groupBy("run").agg(F.max("idx").alias("last"))
    keys = series.select("run", "tbl", "metric").distinct().join(length, "run")
    every = keys.select("run", "tbl", "metric", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("idx")).join(steps, ["run", "idx"])
    return every.join(series.select("run", "tbl", "metric", "idx", "value"), ["run", "tbl", "metric", "idx"], "left").select("run", "tbl", "metric", "idx", "step", "value")


def dense_features(rows: DataFrame) -> DataFrame:
    """run, tbl, pair, step, rel_delta_norm, cosine, effective_rank (of the current side) of whole tensors."""
    steps = rows.groupBy("run", "tbl", (F.col("ckpt") - 1).alias("pair")).agg(F.coalesce(F.max("step"), F.max("ckpt") - 1).cast("long").alias("step"))
    ranks = dense_spectra(rows).select("run", "tbl", (F.col("ckpt") - 1).alias("pair"), "effective_rank")
    return dense_deltas(rows).drop("delta_norm").join(steps, PAIR).join(ranks, PAIR, "left")


def run_series(rows: DataFrame, with_geometry: bool = True) -> DataFrame:
    """All series of a run without gaps: tables of ids, and whole tensors under the prefix DENSE."""
    ids, tensors = rows.where(~F.col("tbl").startswith(DENSE)), rows.where(F.col("tbl").startswith(DENSE))
    shape = geometry(spectra(ids)) if with_geometry else None
    return fill_gaps(to_series(features(ids, shape)).unionByName(to_series(dense_features(tensors))))
