"""Movement of ids that stayed: lengths, cosines, and scores of how it compares with their training frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.ranks import EPS, average_rank, largest, quantiles, robust_z
from driftlens.functions.stage import settle
from driftlens.functions.sums import total
from driftlens.functions.vectors import cosine, delta_norm, norm
from driftlens.operators.pairs import PAIR

CLIP, HIGH = 25.0, 4.0


def measured() -> list[Column]:
    """dcount, dn (length of the movement), cos, cnt and norm (both of the current side) of id_pairs' rows."""
    p, c = F.col("prev.vec"), F.col("cur.vec")
    return [F.col("dcount"), delta_norm(p, c).alias("dn"), cosine(p, c).alias("cos"), F.col("cur.cnt").alias("cnt"), norm(c).alias("norm")]


def movement(pairs: DataFrame) -> DataFrame:
    """run, tbl, pair, id, dcount, dn, cos, cnt of the clean ids."""
    return pairs.where("status = 'clean'").select(*PAIR, "id", *measured()).drop("norm")


def freq_residual(moves: DataFrame) -> DataFrame:
    """moves with freq_residual: the robust z of log dn against its line on log1p of the count's growth.

    Ids that did not move score 0, as do pairs with fewer than three movers; where all grew alike the line is flat.
    """
    movers = moves.where("dn > 0").select(*PAIR, "id", F.ln("dn").alias("y"), F.log1p(F.greatest("dcount", F.lit(0)).cast("double")).alias("x"))
    centre = movers.groupBy(*PAIR).agg(F.count("*").alias("n"), F.min("x").alias("x0")).join(quantiles(movers, PAIR, F.col("y"), {"my": 0.5}), PAIR)
    # sums around a centre that, like them, doesn't hang on the order of rows
    u, v = F.col("x") - F.col("x0"), F.col("y") - F.col("my")
    near = settle(movers.join(centre.where("n >= 3"), PAIR).select(*PAIR, "id", "n", u.alias("u"), v.alias("v")))
    sums = near.groupBy(*PAIR).agg(F.max("n").alias("n"), *[total(F.expr(e)).alias(name) for name, e in {"su": "u", "sv": "v", "suu": "u * u", "suv": "u * v"}.items()])
    uu, uv = F.col("suu") - F.col("su") * F.col("su") / F.col("n"), F.col("suv") - F.col("su") * F.col("sv") / F.col("n")
    fit = sums.select(*PAIR, (F.sqrt(F.greatest(uu, F.lit(0.0)) / F.col("n")) < EPS).alias("flat"), (uv / F.nullif(uu, F.lit(0.0))).alias("b"), (F.col("su") / F.col("n")).alias("mu"), (F.col("sv") / F.col("n")).alias("mv"))
    line = F.when(F.col("flat"), F.lit(0.0)).otherwise(F.col("mv") + F.col("b") * (F.col("u") - F.col("mu")))
    off = settle(near.join(fit, PAIR).select(*PAIR, "id", (F.col("v") - line).alias("r")))
    scored = robust_z(off, PAIR, "r", "freq_residual", CLIP).select(*PAIR, "id", "freq_residual")
    return moves.join(scored, [*PAIR, "id"], "left").withColumn("freq_residual", F.coalesce("freq_residual", F.lit(0.0)))


def frozen_score(moves: DataFrame) -> DataFrame:
    """moves with frozen: percentile rank of the count's growth less that of the movement; 0 for a lone id."""
    moves = settle(moves)
    n = moves.groupBy(*PAIR).agg(F.count("*").alias("_count"))
    most = largest(moves, PAIR)
    ranked = average_rank(average_rank(moves, PAIR, "dcount", "rank_dcount", most=most), PAIR, "dn", "rank_dn", most=most).join(n, PAIR)
    score = (F.col("rank_dcount") - F.col("rank_dn")) / F.nullif(F.col("_count") - 1, F.lit(0))
    return ranked.withColumn("frozen", F.coalesce(score, F.lit(0.0))).drop("_count")


def top_k(scored: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k highest of each pair with their place; ties go to the lower id."""
    order = Window.partitionBy(*PAIR).orderBy(F.desc(by), "id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nominated(scored: DataFrame, wanted: DataFrame, scores: list[str]) -> DataFrame:
    """wanted (run, tbl, id) with n, the pairs in which the id is clean, and the mean of each score over these; null where n is 0."""
    means = scored.groupBy("run", "tbl", "id").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in scores])
    return wanted.join(means, ["run", "tbl", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def movement_summary(moves: DataFrame) -> DataFrame:
    """mover_frac and the median, 95th percentile and maximum of the movement; 0 where a pair has no clean id."""
    sums = moves.groupBy(*PAIR).agg(F.avg((F.col("dn") > 0).cast("double")).alias("mover_frac"), F.max("dn").alias("delta_max"))
    return sums.join(quantiles(moves, PAIR, F.col("dn"), {"delta_p50": 0.5, "delta_p95": 0.95}), PAIR, "left")


def score_tails(scored: DataFrame) -> DataFrame:
    """Greatest residual, residuals of HIGH and more either way, greatest frozen score."""
    return scored.groupBy(*PAIR).agg(F.max("freq_residual").alias("freq_resid_max"), F.count_if(F.abs("freq_residual") >= HIGH).alias("n_freq_resid_hi"), F.max("frozen").alias("frozen_max"))


def mean_row_norm(rows: DataFrame) -> DataFrame:
    """run, tbl, pair (whose current checkpoint it is), mean_row_norm over all residents."""
    return rows.groupBy("run", "tbl", (F.col("ckpt") - 1).alias("pair")).agg(F.avg(norm(F.col("vec"))).alias("mean_row_norm"))
