"""Thresholds from clean runs and detection power from corrupted ones; a run is just a key, so all go in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions.stage import settle
from driftlens.operators.detect import METHODS, PERMISSIVE, detect
from driftlens.operators.mutate import gaussian, inject_trials
from driftlens.operators.series import features, fill_gaps, to_series


def synthetic_trajectories(spark: SparkSession, seeds: int, n: int = 48, dim: int = 8, steps: int = 20, drift: float = 0.01) -> DataFrame:
    """Clean runs: ids of different training frequency that walk at random, farther the more often they are trained."""
    ids = spark.range(seeds * n).select((F.col("id") / n).cast("int").alias("seed"), (F.col("id") % n + 1).alias("id"))
    freq = 1 + F.pmod(F.xxhash64(F.lit("freq"), "seed", "id"), F.lit(39))
    rows = ids.withColumn("freq", freq).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("ckpt"))
    size = F.when(F.col("ckpt") == 0, 0.2).otherwise(F.col("freq") / 20.0 * drift)
    step = F.transform(gaussian(0, F.lit(dim), F.col("seed"), F.col("id"), F.col("ckpt")), lambda e: e * size)
    w = Window.partitionBy("seed", "id").orderBy("ckpt").rowsBetween(Window.unboundedPreceding, 0)
    walked = rows.withColumn("e", step).select("seed", "id", "freq", "ckpt", *[F.sum(F.col("e")[i]).over(w).alias(f"x{i}") for i in range(dim)])
    return walked.select(F.concat(F.lit("syn-"), F.col("seed").cast("string")).alias("run"), F.lit("emb").alias("tbl"), "ckpt", F.col("ckpt").cast("long").alias("step"), "id", (F.col("id") - 1).alias("slot"), (F.col("freq") * (F.col("ckpt") + 1)).alias("cnt"), F.array(*[f"x{i}" for i in range(dim)]).alias("vec"))


def permissive_events(rows: DataFrame) -> DataFrame:
    return detect(fill_gaps(to_series(features(rows))), **PERMISSIVE)


def run_maxima(events: DataFrame, runs: DataFrame) -> DataFrame:
    """run, method, worst for every run (0 without an event)."""
    every = runs.select("run", F.explode(F.array(*map(F.lit, METHODS))).alias("method"))
    worst = events.groupBy("run", "method").agg(F.max(F.abs("score")).alias("worst"))
    return every.join(worst, ["run", "method"], "left").na.fill(0.0, ["worst"])


def thresholds(maxima: DataFrame, target_fpr: float = 0.05) -> DataFrame:
    """method, threshold: what a share of target_fpr of the clean runs exceeds somewhere."""
    return maxima.groupBy("method").agg(F.percentile("worst", 1 - target_fpr).alias("threshold"))


def p_values(events: DataFrame, pool: DataFrame) -> DataFrame:
    """events with p: the share of the clean pool (method, score) at least as severe; 1 without a pool.

    Ranks come from one sort of pool and events together, not from comparing each with each.
    """
    w = Window.partitionBy("method").orderBy(F.desc("_s"), "_own").rangeBetween(Window.unboundedPreceding, 0)
    both = events.withColumns({"_s": F.abs("score"), "_own": F.lit(1)}).unionByName(pool.select("method", F.abs("score").alias("_s"), F.lit(0).alias("_own")), allowMissingColumns=True)
    total = pool.groupBy("method").agg(F.count("*").alias("_n"))
    ranked = both.withColumn("_above", F.sum(1 - F.col("_own")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_own = 1")
    return ranked.join(total, "method", "left").withColumn("p", F.coalesce(F.col("_above") / F.col("_n"), F.lit(1.0))).drop("_s", "_own", "_above", "_n")


def local_severity(events: DataFrame, trials: DataFrame) -> DataFrame:
    """trials (run, tbl, first, last, ...) with method and the greatest score in their index span (0 without)."""
    every = trials.withColumn("method", F.explode(F.array(*map(F.lit, METHODS))))
    inside = events.join(trials.select("run", "tbl", "first", "last"), ["run", "tbl"]).where("idx between first and last")
    worst = inside.groupBy("run", "method").agg(F.max(F.abs("score")).alias("severity"))
    return every.join(worst, ["run", "method"], "left").na.fill(0.0, ["severity"])


def power(severities: DataFrame, bars: DataFrame) -> DataFrame:
    """label, magnitude, method, tpr."""
    return severities.join(bars, "method").groupBy("label", "magnitude", "method").agg(F.avg((F.col("severity") >= F.col("threshold")).cast("double")).alias("tpr"))


def least_detectable(found: DataFrame, bar: float = 0.9) -> DataFrame:
    """label, method, magnitude: the least that is found in a share of bar; infinite if none is."""
    return found.groupBy("label", "method").agg(F.coalesce(F.min(F.when(F.col("tpr") >= bar, F.col("magnitude"))), F.lit(float("inf"))).alias("magnitude"))


def battery(magnitudes: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0), n_ids: int = 6) -> list[dict]:
    """Kinds of corruption to try: scrambling and noise at each magnitude, freezing and zeroing, once and for good."""
    sized = [(kind, m) for kind in ("scramble", "noise") for m in magnitudes] + [("freeze", 1.0), ("zero", 1.0)]
    return [{"label": f"{kind}{'-on' if on else ''}", "kind": kind, "magnitude": m, "n_ids": n_ids, "persistent": on} for on in (False, True) for kind, m in sized]


def drawn_trials(clean: DataFrame, kinds: list[dict], each: int, seed: int = 0) -> DataFrame:
    """trial, run, tbl, step, last and each kind's fields: as many trials a kind, of runs, tables and steps drawn by hash.

    Steps leave out a run's first two checkpoints and its last one; runs of fewer than four have no trial.
    """
    spark = clean.sparkSession
    spans = clean.groupBy("run", "tbl").agg(F.max("ckpt").alias("last")).where("last >= 3")
    spans = spans.withColumn("place", F.row_number().over(Window.orderBy("run", "tbl")) - 1)  # a row a run and table
    total = spans.count()
    wanted = spark.createDataFrame(kinds, "label string, kind string, magnitude double, n_ids int, persistent boolean") if kinds else None
    if not total or wanted is None:
        return spark.createDataFrame([], "trial string, run string, tbl string, step int, last int, label string, kind string, magnitude double, n_ids int, persistent boolean, seed long")
    numbered = wanted.select("*", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k"))
    h = F.xxhash64(F.lit(seed), "label", "magnitude", "k")
    placed = numbered.withColumns({"seed": h, "place": F.pmod(h, F.lit(total)).cast("int")}).join(spans, "place")
    step = (F.lit(2) + F.pmod(F.xxhash64("seed", F.lit(1)), F.col("last") - 2)).cast("int")
    name = F.concat_ws("-", F.lit("trial"), "label", F.col("magnitude").cast("string"), F.col("k").cast("string"))
    return placed.select(name.alias("trial"), "run", "tbl", step.alias("step"), "last", "label", "kind", "magnitude", "n_ids", "persistent", "seed")


def run_trials(clean: DataFrame, trials: DataFrame) -> DataFrame:
    """Severities of each trial: its run's table, corrupted, under the trial's name. The plan is one, however many trials."""
    own = clean.join(trials.select("trial", "run", "tbl"), ["run", "tbl"])
    rows = settle(own.withColumn("run", F.col("trial")).select(*clean.columns))
    bad = inject_trials(rows, trials)
    spans = trials.select(F.col("trial").alias("run"), "tbl", (F.col("step") - 1).alias("first"), F.when(F.col("persistent"), F.col("last") - 1).otherwise(F.col("step")).alias("last"), "label", "magnitude")
    return local_severity(permissive_events(bad), spans)


@dataclass
class Calibration:
    """maxima (run, method, worst), pool (method, score of clean runs), bars (method, threshold), power, least detectable."""

    target_fpr: float
    maxima: DataFrame
    pool: DataFrame
    bars: DataFrame
    power: DataFrame
    least: DataFrame


def run_calibration(clean: DataFrame, kinds: list[dict], each: int = 40, target_fpr: float = 0.05, seed: int = 0) -> Calibration:
    """Thresholds from clean runs and the power of the detectors at them, from trials drawn on the same runs."""
    clean = settle(clean)
    events = settle(permissive_events(clean))
    maxima = settle(run_maxima(events, clean.select("run").distinct()))
    bars = settle(thresholds(maxima, target_fpr))
    found = settle(power(run_trials(clean, settle(drawn_trials(clean, kinds, each, seed))), bars))
    return Calibration(target_fpr, maxima, events.select("method", F.abs("score").alias("score")), bars, found, least_detectable(found))


def derive_parameters(found: Calibration, provenance: str) -> dict:
    """What a calibration file holds; detect.read_thresholds reads it."""
    return {"provenance": provenance, "target_fpr": found.target_fpr, "methods": {r.method: {"threshold": r.threshold} for r in found.bars.orderBy("method").collect()}}


def calibration_text(found: Calibration) -> str:
    pool = found.pool.groupBy("method").agg(F.percentile("score", 0.5).alias("p50"), F.percentile("score", 0.99).alias("p99"), F.count("*").alias("n"))
    lines = [f"thresholds at a false-positive rate of {found.target_fpr} a run"]
    for r in found.bars.join(pool, "method", "left").orderBy("method").collect():
        lines.append(f"  {r.method}: {r.threshold:.3f}" + (f"; clean scores: median {r.p50:.2f}, p99 {r.p99:.2f}, {r.n} of them" if r.n else "; no clean event"))
    for r in found.power.groupBy("label", "magnitude").agg(F.array_sort(F.collect_list(F.struct("method", "tpr"))).alias("m")).orderBy("label", "magnitude").collect():
        lines.append(f"  {r.label} at {r.magnitude:g}: " + ", ".join(f"{m.method} {m.tpr:.2f}" for m in r.m))
    for r in found.least.where(F.col("magnitude") < float("inf")).orderBy("label", "method").collect():
        lines.append(f"  {r.label}: {r.method} finds nine in ten from {r.magnitude:g} typical norms on")
    return "\n".join(lines) + "\n"


def seed_statistics(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mean, sd (of the sample), n over seeds of results (seed, keys, value)."""
    return results.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def paired_contrast(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """mean, sd, wins, n of the difference of two results (seed, value) within each seed that both have."""
    both = left.select("seed", F.col(value).alias("a")).join(right.select("seed", F.col(value).alias("b")), "seed").withColumn("d", F.col("a") - F.col("b"))
    return both.agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("wins"), F.count("d").alias("n"))
