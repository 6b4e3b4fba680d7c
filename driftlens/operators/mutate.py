"""Planted corruption of known ids, to measure whether detectors find it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.ranks import quantiles
from driftlens.functions.vectors import EPS, norm

KINDS = ("scramble", "zero", "noise", "freeze")
KEY = ["run", "tbl", "ckpt", "id"]


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash, the same wherever the row is computed."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def gaussian(seed: int, size: Column, *keys: Column) -> Column:
    """An array of standard normal numbers that depends on seed and keys alone (Box-Muller)."""
    one = lambda i: F.sqrt(-2 * F.ln(_uniform(F.lit(seed), F.lit(0), *keys, i))) * F.cos(2 * math.pi * _uniform(F.lit(seed), F.lit(1), *keys, i))
    return F.transform(F.sequence(F.lit(1), size), one)


def typical_norm(rows: DataFrame) -> DataFrame:
    """run, tbl, ckpt, typical: the lower median of the row norms, 1 where that is 0."""
    found = quantiles(rows, ["run", "tbl", "ckpt"], norm(F.col("vec")), {"typical": 0.5}, lower=True)
    return found.withColumn("typical", F.when(F.col("typical") == 0, 1.0).otherwise(F.col("typical")))


def set_rows(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows with the vectors of new (run, tbl, ckpt, id, vec) in place of their own."""
    own = new.select(*KEY, F.col("vec").cast(rows.schema["vec"].dataType).alias("_new"))
    return rows.join(own, KEY, "left").withColumn("vec", F.coalesce("_new", "vec")).select(*rows.columns)


def mutated(rows: DataFrame, targets: DataFrame, kind: str, magnitude: float = 1.0, seed: int = 0) -> DataFrame:
    """New vectors for targets (run, tbl, ckpt, id); a target that is not resident raises."""
    if kind not in KINDS or kind == "freeze":
        raise ValueError(f"unknown kind {kind!r}")
    found = targets.join(rows.select(*KEY, "vec"), KEY, "left").join(typical_norm(rows), ["run", "tbl", "ckpt"], "left")
    size = F.size("vec")
    noise = gaussian(seed, size, F.col("id"))
    scale = F.col("typical") * magnitude
    if kind == "zero":
        vec = F.transform("vec", lambda x: x.cast("double") * 0.0)
    elif kind == "noise":
        vec = F.zip_with("vec", noise, lambda x, e: x.cast("double") + e * scale)
    else:
        vec = F.transform("_noise", lambda e: e / (norm(F.col("_noise")) + EPS) * scale)
    missing = F.raise_error(F.concat(F.lit("not resident: "), F.col("id").cast("string"))).cast("array<double>")
    return found.withColumn("_noise", noise).select(*KEY, F.when(F.col("vec").isNull(), missing).otherwise(vec).alias("vec"))


def choose_ids(rows: DataFrame, n: int, kind: str, seed: int = 0) -> DataFrame:
    """run, tbl, ckpt, id of n ids: the most trained for a freeze, else in hash order; ties go to the lower id."""
    first = F.desc("cnt") if kind == "freeze" else F.xxhash64(F.lit(seed), "id")
    return rows.orderBy(first, "id").limit(n).select(*KEY)


def inject_trials(rows: DataFrame, trials: DataFrame) -> DataFrame:
    """rows of all trials (run is the trial's name), each corrupted at its step, or from there on where persistent.

    trials: trial, tbl, kind, magnitude, n_ids, step, persistent, seed. The ids are the most trained ones for a freeze,
    else those first in hash order; ties go to the lower id. A frozen id keeps the vector of the checkpoint before.
    """
    plan = trials.select(F.col("trial").alias("run"), "tbl", "kind", "magnitude", "n_ids", "step", "persistent", "seed")
    most = plan.agg(F.coalesce(F.max("n_ids"), F.lit(0))).first()[0]
    named = plan.withColumnRenamed("step", "at")
    base = rows.join(named, ["run", "tbl"]).where(F.col("ckpt") == F.col("at"))
    first = F.when(F.col("kind") == "freeze", -F.coalesce("cnt", F.lit(0))).otherwise(F.xxhash64("seed", "id"))
    # a literal bound first, so that every task keeps its first ids only and no table is ordered whole
    ranked = base.withColumn("_r", F.row_number().over(Window.partitionBy("run", "tbl").orderBy(first, "id"))).where(F.col("_r") <= F.lit(most))
    chosen = ranked.where(F.col("_r") <= F.col("n_ids"))
    typical = typical_norm(base.select("run", "tbl", "ckpt", "vec")).drop("ckpt")
    before = rows.join(named, ["run", "tbl"]).where(F.col("ckpt") == F.col("at") - 1).select("run", "tbl", "id", F.col("vec").cast("array<double>").alias("_before"))
    found = chosen.join(typical, ["run", "tbl"]).join(before, ["run", "tbl", "id"], "left")
    found = found.withColumn("_noise", gaussian(0, F.size("vec"), F.col("seed"), F.col("id")))
    scale = F.col("typical") * F.col("magnitude")
    own = F.col("vec").cast("array<double>")
    vec = (
        F.when(F.col("kind") == "zero", F.transform(own, lambda x: x * 0.0))
        .when(F.col("kind") == "noise", F.zip_with(own, "_noise", lambda x, e: x + e * scale))
        .when(F.col("kind") == "scramble", F.transform("_noise", lambda e: e / (norm(F.col("_noise")) + EPS) * scale))
        .otherwise(F.coalesce("_before", own))
    )
    target = found.select("run", "tbl", "id", "at", "persistent", vec.alias("vec"))
    spread = rows.select(*KEY).join(target, ["run", "tbl", "id"]).where((F.col("ckpt") == F.col("at")) | (F.col("persistent") & (F.col("ckpt") > F.col("at"))))
    return set_rows(rows, spread.select(*KEY, "vec"))


def inject(rows: DataFrame, kind: str, step: int, n_ids: int, magnitude: float = 1.0, persistent: bool = False, seed: int = 0) -> DataFrame:
    """One run's rows with n_ids of one table corrupted at checkpoint step, or from there on."""
    base = rows.where(F.col("ckpt") == step)
    chosen = choose_ids(base, n_ids, kind, seed)
    if kind == "freeze":
        before = rows.where(F.col("ckpt") == step - 1).select("run", "tbl", "id", F.col("vec").cast("array<double>").alias("vec"))
        target = chosen.drop("ckpt").join(before, ["run", "tbl", "id"])
    else:
        target = mutated(base, chosen, kind, magnitude, seed).drop("ckpt")
    at = rows.where(F.col("ckpt") >= step if persistent else F.col("ckpt") == step).select(*KEY)
    return set_rows(rows, at.join(target, ["run", "tbl", "id"]))
