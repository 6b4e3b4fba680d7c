"""KLL sketches of values by key: kept, merged over checkpoints and runs, and asked for quantiles and p-values.

A sketch has a few kilobytes whatever it has seen. Its ranks are off by ``rank_error(k)`` at the utmost, with 99 % confidence; up
to k values it is exact. Merging loses nothing beyond that. The exact ways (``ranks.quantiles``, ``calibrate.p_values``) stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, GRID = 1024, 500


def rank_error(k: int = K) -> float:
    """The bound for the rank of one value, as published with the sketch."""
    return 2.296 / k**0.9723


def sketched(values: DataFrame, keys: list[str], value: str = "value", k: int = K) -> DataFrame:
    """keys, n, sketch of the finite values of each key."""
    v = F.col(value).cast("double")
    good = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return good.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, sketch over all sketches of each key."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """All columns but the sketch, and p, value: the value below which that share lies."""
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in shares])).alias("q")
    return sketches.select("*", each).select(*[c for c in sketches.columns if c != "sketch"], "q.p", "q.value")


def p_values(events: DataFrame, pools: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """events with p: the share of the key's pool (n, sketch of sizes of scores) at least as great as the score's size; 1 without a pool.

    A pool is a row a key; its join carries GRID quantiles to each event, so p is off by the sketch's bound and half a step of the grid.
    """
    ranks = F.array(*[F.lit((j + 0.5) / GRID) for j in range(GRID)])
    held = pools.select(*keys, F.kll_sketch_get_quantile_double("sketch", ranks).alias("_curve"))
    below = F.size(F.filter("_curve", lambda q: q < F.abs(score))) / GRID
    return events.join(held, keys, "left").withColumn("p", F.when(F.col("_curve").isNull(), 1.0).otherwise(1 - below)).drop("_curve")
