"""Ranks, order statistics and robust scales over DataFrames, without gathering a group in one task.

Values of a group are dealt into BUCKETS buckets by approximate quantiles of its different values. The quantiles only
choose the bounds; counts of the buckets before a value's own and its place in its own give exact ranks, so no window
spans a whole group, whatever the values look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
BUCKETS = 256  # a power of two
#: Rows of a group up to which one aggregate may hold all its values; beyond it order statistics are found by buckets.
HELD = 2_000_000


def _counted(df: DataFrame, keys: list[str], value: Column) -> tuple[DataFrame, DataFrame]:
    """(keys, _value, _n, _bucket) of the different values, and (keys, _bucket, _size, _before) of the buckets."""
    counts = df.groupBy(*keys, value.alias("_value")).agg(F.count("*").alias("_n"))
    bounds = counts.groupBy(*keys).agg(F.percentile_approx(F.col("_value").cast("double"), [k / BUCKETS for k in range(1, BUCKETS)], 5_000).alias("_bounds"))
    halves = F.array(*[F.lit(BUCKETS >> k) for k in range(1, BUCKETS.bit_length())])
    # how many bounds lie below the value, by bisection
    bucket = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get("_bounds", at + half - 1) < F.col("_value"), at + half).otherwise(at))
    placed = counts.join(bounds, keys).withColumn("_bucket", bucket).drop("_bounds")
    sizes = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, sizes.withColumn("_before", before)


def _inside(keys: list[str]) -> Column:
    """How many rows of its bucket have a lower value."""
    own = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(own), F.lit(0))


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: counted once, it may be passed on as most for all that follows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def average_rank(df: DataFrame, keys: list[str], value: str, name: str, held: int = HELD, most: int | None = None) -> DataFrame:
    """df with 1-based average ranks of value among its keys; equal values share their mean rank, null ones have no row.

    Where every group has at most held rows, one window a group ranks them; else buckets do. Both ways give the same.
    """
    if (largest(df, keys) if most is None else most) <= held:
        ordered, same = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value).orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.where(F.col(value).isNotNull()).withColumn(name, F.rank().over(ordered) + (F.count("*").over(same) - 1) / 2)
    counts, sizes = _counted(df, keys, F.col(value))
    placed = counts.withColumn("_in", _inside(keys)).join(sizes, [*keys, "_bucket"])
    ranked = placed.select(*keys, F.col("_value").alias(value), (F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranked, [*keys, value])


def _exact_rest(a: Column, b: Column) -> Column:
    """What rounding took from the product of two doubles, by Dekker's and Veltkamp's halves."""
    halves = []
    for x in (a, b):
        high = 134217729.0 * x - (134217729.0 * x - x)
        halves.append((high, x - high))
    (ah, al), (bh, bl) = halves
    return ((ah * bh - a * b) + ah * bl + al * bh) + al * bl


def _between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part, rounded once after the second product: the last bit that the SQL twins give as well."""
    first, second = low * (1 - part), high * part
    total = first + second
    back = total - first
    rest = (first - (total - back)) + (second - back) + _exact_rest(low, 1 - part)
    # halves of huge values overflow
    return F.nanvl(total + rest, total)


def quantiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, float], held: int = HELD, most: int | None = None, lower: bool = False) -> DataFrame:
    """keys and the wanted quantiles of value by name: interpolated between neighbours, or with lower the least value that so many don't exceed.

    Where every group has at most held rows, one aggregate a group takes them; else only the buckets that hold them are
    ordered. Both ways give the same.
    """
    own = df.select(*keys, value.cast("double").alias("_v")).where("_v is not null")
    if (largest(own, keys) if most is None else most) <= held:
        if lower or set(wanted.values()) <= {0.0, 0.5, 1.0}:
            one = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY _v)") if lower else F.percentile("_v", p)
            return own.groupBy(*keys).agg(*[one(p).alias(name) for name, p in wanted.items()])
        whole = Window.partitionBy(*keys)
        placed = own.withColumns({"_at": F.row_number().over(whole.orderBy("_v")) - 1, "_last": F.count("*").over(whole) - 1})
        sides = [F.max(F.when(F.col("_at") == edge(F.col("_last") * p), F.col("_v"))).alias(f"{side}{i}") for i, p in enumerate(wanted.values()) for side, edge in (("_low", F.floor), ("_high", F.ceil))]
        ends = placed.groupBy(*keys).agg(F.max("_last").alias("_last"), *sides)
        return ends.select(*keys, *[_between(F.col(f"_low{i}"), F.col(f"_high{i}"), F.col("_last") * p % 1).alias(name) for i, (name, p) in enumerate(wanted.items())])
    counts, sizes = _counted(own, keys, F.col("_v"))
    totals = sizes.groupBy(*keys).agg(F.sum("_size").alias("_all"))
    # the neighbours' places, from 0 on
    place = lambda name, at, part, side: F.struct(F.lit(name).alias("name"), at.cast("long").alias("at"), part.alias("part"), F.lit(side).alias("side"))
    if lower:
        places = F.array(*[place(name, F.greatest(F.ceil(F.col("_all") * p) - 1, F.lit(0)), F.lit(0.0), 0) for name, p in wanted.items()])
    else:
        places = F.array(*[place(name, edge((F.col("_all") - 1) * p), (F.col("_all") - 1) * p % 1, side) for name, p in wanted.items() for side, edge in enumerate((F.floor, F.ceil))])
    asked = sizes.join(totals, keys).withColumn("t", F.explode(places)).where("t.at >= _before and t.at < _before + _size").select(*keys, "_bucket", "_before", "t")
    near = counts.join(asked.select(*keys, "_bucket", "_before").distinct(), [*keys, "_bucket"]).withColumn("_from", F.col("_before") + _inside(keys)).drop("_before")
    found = near.join(asked.drop("_before"), [*keys, "_bucket"]).where("t.at >= _from and t.at < _from + _n")
    if lower:
        each = found.groupBy(*keys, F.col("t.name").alias("name")).agg(F.max("_value").alias("q"))
    else:
        ends = [F.max(F.when(F.col("t.side") == side, F.col("_value"))).alias(name) for side, name in enumerate(("_low", "_high"))]
        both = found.groupBy(*keys, F.col("t.name").alias("name")).agg(F.max("t.part").alias("_part"), *ends)
        each = both.select(*keys, "name", _between(F.col("_low"), F.col("_high"), F.col("_part")).alias("q"))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in wanted])


def robust_z(df: DataFrame, keys: list[str], value: str, name: str, clip: float | None = None) -> DataFrame:
    """df with (value - median) / scale: scale is 1.4826 times the median absolute deviation, or the population
    deviation where that vanishes; 0 where both do. df is read several times."""
    most = largest(df, keys)
    centre = quantiles(df, keys, F.col(value), {"_m": 0.5}, most=most).join(df.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd")), keys)
    off = df.join(centre, keys).withColumn("_off", F.abs(F.col(value) - F.col("_m")))
    mad = quantiles(off, keys, F.col("_off"), {"_mad": 0.5}, most=most).withColumn("_mad", 1.4826 * F.col("_mad"))
    spread = off.join(mad, keys)
    scale = F.when(F.col("_mad") < EPS, F.col("_sd")).otherwise(F.col("_mad"))
    z = (F.col(value) - F.col("_m")) / F.nullif(scale, F.lit(0.0))
    z = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)) if clip else z
    return spread.withColumn(name, F.when(scale < EPS, 0.0).otherwise(z)).drop("_m", "_sd", "_off", "_mad")
