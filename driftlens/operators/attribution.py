"""Why a table moved: a common shift, a common rotation, popularity, or change of single ids.

One pass sums moments of the clean pairs, a small task a pair aligns the two sides (orthogonal Procrustes), a second
pass measures what movement is left and regresses its logarithm on training counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.matrices import apply_by_key
from driftlens.functions.moments import assemble, moments
from driftlens.functions.ranks import robust_z
from driftlens.functions.stage import settle
from driftlens.operators.pairs import PAIR

EPS, LEAST, CLIP = 1e-12, 8, 25.0
_ALIGN = "run string, tbl string, pair int, n long, mean_shift_norm double, rotation_magnitude double, frac_translation double, frac_rotation double, frac_aligned double, rotation array<double>, mean_prev array<double>, mean_cur array<double>"


def align(n: int, s: np.ndarray, ss: np.ndarray) -> dict:
    """Procrustes from the moments of rows (prev, cur) of 2 d numbers: rotation, shift and the energies they explain."""
    d = len(s) // 2
    centred = ss - np.outer(s, s) / n
    pp, cc, cp = np.trace(centred[:d, :d]), np.trace(centred[d:, d:]), centred[d:, :d]
    u, sigma, vt = np.linalg.svd(cp)
    shift = (s[d:] - s[:d]) / n
    apart = max(0.0, pp + cc - 2 * np.trace(cp))
    left = max(0.0, pp + cc - 2 * sigma.sum())
    total = apart + n * (shift**2).sum() + EPS
    return {
        "mean_shift_norm": float(np.linalg.norm(shift)), "rotation_magnitude": float(np.linalg.norm(u @ vt - np.eye(d))),
        "frac_translation": float(n * (shift**2).sum() / total), "frac_rotation": float((apart - left) / total), "frac_aligned": float(left / total),
        "rotation": (u @ vt).ravel(), "mean_prev": s[:d] / n, "mean_cur": s[d:] / n,
    }


def procrustes(pairs: DataFrame) -> DataFrame:
    """A row for each pair and table with LEAST clean ids or more."""
    clean = pairs.where("status = 'clean'").select(*PAIR, F.concat(F.col("prev.vec").cast("array<double>"), F.col("cur.vec").cast("array<double>")).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        return pdf[[*PAIR, "n"]].assign(**{k: [v] for k, v in align(r["n"], *assemble(r["tiles"])).items()})

    return moments(clean, PAIR, "v").where(F.col("n") >= LEAST).groupBy(*PAIR).applyInPandas(run, _ALIGN)


def aligned_movement(pairs: DataFrame, aligned: DataFrame) -> DataFrame:
    """run, tbl, pair, id, dcount, cnt, aligned_dn: movement after shift and rotation are taken out."""

    def run(pdf: pd.DataFrame, own: dict) -> pd.DataFrame:
        before, after = own["mean_prev"], own["mean_cur"]
        left = np.stack(pdf["p"].to_list()) - before - (np.stack(pdf["c"].to_list()) - after) @ own["rotation"].reshape(len(before), -1)
        return pdf[[*PAIR, "id", "dcount", "cnt"]].assign(aligned_dn=np.linalg.norm(left, axis=1))

    own = pairs.where("status = 'clean'").select(*PAIR, "id", "dcount", F.col("cur.cnt").alias("cnt"), F.col("prev.vec").cast("array<double>").alias("p"), F.col("cur.vec").cast("array<double>").alias("c"))
    return apply_by_key(own, aligned.select(*PAIR, "rotation", "mean_prev", "mean_cur"), PAIR, run, "run string, tbl string, pair int, id long, dcount long, cnt long, aligned_dn double")


def popularity_fit(moved: DataFrame) -> DataFrame:
    """run, tbl, pair, coef, r2: log movement on log1p of the count's growth and, where counts are kept, of the count."""
    y, x1, x2 = F.ln("aligned_dn"), F.log1p(F.greatest("dcount", F.lit(0)).cast("double")), F.log1p(F.greatest("cnt", F.lit(0)).cast("double"))
    rows = moved.where("aligned_dn > 0").select(*PAIR, F.array(F.lit(1.0), x1, F.coalesce(x2, F.lit(0.0)), y).alias("v"), F.col("cnt").isNotNull().cast("int").alias("has"))
    counted = rows.groupBy(*PAIR).agg((F.min("has") > 0).alias("counted"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        ss, n = assemble(r["tiles"])[1], r["n"]
        use = 3 if r["counted"] else 2
        coef = np.zeros(3)
        r2 = 0.0
        if n >= use - 1 + 3:
            coef[:use] = np.linalg.pinv(ss[:use, :use], hermitian=True, rcond=1e-12) @ ss[:use, 3]
            total = ss[3, 3] - ss[0, 3] ** 2 / n
            rest = ss[3, 3] - 2 * coef[:use] @ ss[:use, 3] + coef[:use] @ ss[:use, :use] @ coef[:use]
            r2 = float(1 - rest / total) if total > EPS else 0.0
        return pdf[[*PAIR, "n"]].assign(coef=[coef], r2=r2, fitted=bool(n >= use - 1 + 3))

    schema = "run string, tbl string, pair int, n long, coef array<double>, r2 double, fitted boolean"
    return moments(rows, PAIR, "v").join(counted, PAIR).groupBy(*PAIR).applyInPandas(run, schema)


def idiosyncratic(moved: DataFrame, fit: DataFrame) -> DataFrame:
    """run, tbl, pair, id, idiosyncratic: robust z of the movement that popularity does not explain; 0 without movement."""
    x1, x2 = F.log1p(F.greatest("dcount", F.lit(0)).cast("double")), F.coalesce(F.log1p(F.greatest("cnt", F.lit(0)).cast("double")), F.lit(0.0))
    off = moved.where("aligned_dn > 0").join(fit.where("fitted").select(*PAIR, "coef"), PAIR)
    off = settle(off.select(*PAIR, "id", (F.ln("aligned_dn") - F.col("coef")[0] - F.col("coef")[1] * x1 - F.col("coef")[2] * x2).alias("r")))
    scored = robust_z(off, PAIR, "r", "idiosyncratic", CLIP).select(*PAIR, "id", "idiosyncratic")
    return moved.join(scored, [*PAIR, "id"], "left").withColumn("idiosyncratic", F.coalesce("idiosyncratic", F.lit(0.0)))


def attribution(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A summary a pair and table, and the scores of its ids. Fewer than LEAST clean ids: all movement is unexplained."""
    aligned = settle(procrustes(pairs))
    moved = settle(aligned_movement(pairs, aligned))
    fit = settle(popularity_fit(moved))
    every = pairs.select(*PAIR).distinct().join(aligned.drop("rotation", "mean_prev", "mean_cur"), PAIR, "left").join(fit.select(*PAIR, "r2"), PAIR, "left")
    zero = {"n": 0, "mean_shift_norm": 0.0, "rotation_magnitude": 0.0, "frac_translation": 0.0, "frac_rotation": 0.0, "frac_aligned": 1.0, "r2": 0.0}
    summary = every.na.fill(zero).withColumn("frac_global", F.col("frac_translation") + F.col("frac_rotation")).withColumnRenamed("r2", "popularity_r2")
    return summary, idiosyncratic(moved, fit)


def auc(scored: DataFrame, score: str, positive: str, keys: list[str]) -> DataFrame:
    """keys, auc: the chance that a positive row scores above another, ties half; 0.5 where a class is empty."""
    from driftlens.functions.ranks import average_rank

    ranked = average_rank(scored, keys, score, "_rank")
    sums = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(positive), F.col("_rank")).otherwise(0.0)).alias("r"), F.count_if(positive).alias("p"), F.count("*").alias("n"))
    both = F.col("p") * (F.col("n") - F.col("p"))
    return sums.select(*keys, F.when(both == 0, 0.5).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(both, F.lit(0))).alias("auc"))
