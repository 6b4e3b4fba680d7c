"""Covariance spectra of tables and what follows from them.

A table is reduced to its count, sum and sum of outer products (``functions.moments``): each task adds up its rows, Spark adds
the tasks' sums. All residents count, none are sampled. The eigenvalues of the dim x dim result are taken in one small task a
table and checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.matrices import apply_by_key
from driftlens.functions.moments import TILE_ROWS, add_tiles, assemble, cut_tiles, moments
from driftlens.functions.stage import settle
from driftlens.functions.wide import singular_summary
from driftlens.operators.pairs import PAIR

EPS = 1e-12
TABLE = ["run", "tbl", "ckpt"]
LEVELS = (0.90, 0.95, 0.99)
GRAM, COLUMNS = 2048, 512  # side of the greatest Gram matrix that one task takes apart; columns of a block of row products
def covariance(n: int, s: np.ndarray, ss: np.ndarray) -> np.ndarray:
    d = len(s)
    return (ss - np.outer(s, s) / n) / (n - 1) if n > 1 else np.zeros((d, d))


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the greatest down, none negative, and their vectors as columns."""
    values, vectors = np.linalg.eigh(cov)
    return np.maximum(values[::-1], 0), vectors[:, ::-1]


@dataclass
class Shape:
    """What a spectrum says of a table: held is the share of variance in the leading directions, one entry a direction."""

    held: np.ndarray
    effective_rank: float = 0.0  # the exponential of the entropy of the shares
    anisotropy: float = 0.0  # how far the first share is above an even one

    def directions(self, energy: float) -> int:
        """How many directions hold that share of the variance; 0 for a table without variance."""
        return min(len(self.held), 1 + int((self.held < energy - 1e-9).sum())) if self.effective_rank else 0


def shape_of(spectrum: np.ndarray) -> Shape:
    """The shape of a spectrum in descending order; a zero spectrum has rank 0 and no direction."""
    values = np.asarray(spectrum, float)
    total = values.sum()
    if not total > EPS:
        return Shape(np.zeros(len(values)))
    share = values / total
    log = np.log(share, out=np.zeros_like(share), where=share > EPS)
    return Shape(share.cumsum(), float(np.exp(-share @ log)), float(share[0] * len(share)))


def spectra(rows: DataFrame) -> DataFrame:
    """run, tbl, ckpt, n, spectrum, basis (eigenvectors as columns, row by row)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        values, vectors = eigen(covariance(r["n"], *assemble(r["tiles"])))
        return pdf[[*TABLE, "n"]].assign(spectrum=[values], basis=[vectors.ravel()])

    return settle(moments(rows, TABLE).groupBy(*TABLE).applyInPandas(run, "run string, tbl string, ckpt int, n long, spectrum array<double>, basis array<double>"))


def geometry(found: DataFrame) -> DataFrame:
    """run, tbl, ckpt, n, effective_rank, anisotropy, rank95 from spectra."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = [shape_of(s) for s in pdf["spectrum"]]
            yield pdf[[*TABLE, "n"]].assign(effective_rank=[s.effective_rank for s in own], anisotropy=[s.anisotropy for s in own], rank95=[s.directions(0.95) for s in own])

    return found.select(*TABLE, "n", "spectrum").mapInPandas(run, "run string, tbl string, ckpt int, n long, effective_rank double, anisotropy double, rank95 int")


def overlap(prev: np.ndarray, prev_basis: np.ndarray, cur: np.ndarray, cur_basis: np.ndarray) -> float:
    """Variance of the current table along the previous 90 % directions, against the most that as many could hold."""
    old = prev_basis[:, : shape_of(prev).directions(0.90)]
    best = cur[: old.shape[1]].sum()
    covariance_now = cur_basis @ np.diag(cur) @ cur_basis.T
    return min(1.0, float(np.trace(old.T @ covariance_now @ old) / best)) if best > EPS else 1.0


def subspace_overlap(found: DataFrame) -> DataFrame:
    """run, tbl, pair, overlap of consecutive checkpoints; 1 where either has fewer than two rows."""
    prev = found.select("run", "tbl", F.col("ckpt").alias("pair"), F.col("n").alias("n0"), F.col("spectrum").alias("s0"), F.col("basis").alias("b0"))
    both = prev.join(found.select("run", "tbl", (F.col("ckpt") - 1).alias("pair"), "n", "spectrum", "basis"), PAIR)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                d = len(r.spectrum)
                out.append(1.0 if min(r.n0, r.n) < 2 else overlap(np.asarray(r.s0), np.asarray(r.b0).reshape(d, d), np.asarray(r.spectrum), np.asarray(r.basis).reshape(d, d)))
            yield pdf[PAIR].assign(overlap=out)

    return both.mapInPandas(run, "run string, tbl string, pair int, overlap double")


def stable_since(steps: list, ranks: list[int], slack: int = 1, least: int = 3):
    """The step from which on the rank stays within slack of its last value; None for a shorter tail than least."""
    k = len(ranks)
    while k and abs(ranks[k - 1] - ranks[-1]) <= slack:
        k -= 1
    return steps[k] if len(ranks) - k >= least else None


def spectral_report(found: DataFrame, steps: DataFrame) -> DataFrame:
    """A row a table: ranks at 90, 95 and 99 % and effective rank by checkpoint, final energy curve, stable step.

    Tables are those of the run's first checkpoint; steps is run, tbl, ckpt, step.
    """
    first = found.groupBy("run").agg(F.min("ckpt").alias("ckpt"))
    tables = found.join(first, ["run", "ckpt"], "left_semi").select("run", "tbl")
    own = found.select(*TABLE, "spectrum").join(steps, TABLE).join(tables, ["run", "tbl"], "left_semi")
    schema = "run string, tbl string, steps array<long>, rank90 array<int>, rank95 array<int>, rank99 array<int>, effective_rank array<double>, energy array<double>, stable_since long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ckpt")
        shapes = [shape_of(s) for s in pdf["spectrum"]]
        at = {p: [s.directions(p) for s in shapes] for p in LEVELS}
        step = [int(c if pd.isna(s) else s) for c, s in zip(pdf["ckpt"], pdf["step"], strict=True)]
        row = [pdf["run"].iloc[0], pdf["tbl"].iloc[0], step, at[0.90], at[0.95], at[0.99], [s.effective_rank for s in shapes], shapes[-1].held, stable_since(step, at[0.95])]
        return pd.DataFrame([row], columns=["run", "tbl", "steps", "rank90", "rank95", "rank99", "effective_rank", "energy", "stable_since"])

    return own.groupBy("run", "tbl").applyInPandas(run, schema)


def project_deltas(pairs: DataFrame, found: DataFrame, rank: int, basis_table: str | None = None, weighted: bool = False) -> DataFrame:
    """run, tbl, pair, id, projected: the movement's length in the leading directions of the current side.

    basis_table takes another table's directions. weighted gives the root of the movement's quadratic form in the
    covariance instead, over all directions.
    """
    keys = ["run", "pair"] if basis_table else PAIR
    sides = found if basis_table is None else found.where(F.col("tbl") == basis_table)
    sides = sides.withColumn("pair", F.col("ckpt") - 1).select(*keys, "spectrum", "basis")

    def run(pdf: pd.DataFrame, own: dict) -> pd.DataFrame:
        vectors = own["basis"].reshape(len(own["spectrum"]), -1)
        seen = np.stack(pdf["d"].to_list()) @ (vectors * np.sqrt(own["spectrum"]) if weighted else vectors[:, :rank])
        return pdf[[*PAIR, "id"]].assign(projected=np.linalg.norm(seen, axis=1))

    delta = F.zip_with("prev.vec", "cur.vec", lambda x, y: y.cast("double") - x.cast("double")).alias("d")
    return apply_by_key(pairs.where("status = 'clean'").select(*PAIR, "id", delta), sides, keys, run, "run string, tbl string, pair int, id long, projected double")


def dense_deltas(rows: DataFrame) -> DataFrame:
    """run, tbl, pair, delta_norm, rel_delta_norm, cosine of whole tensors (their rows: id, vec) of equal shape."""
    from driftlens.functions.vectors import dot

    shape = rows.groupBy("run", "tbl", "ckpt").agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("width"))
    same = shape.alias("a").join(shape.alias("b"), F.expr("a.run = b.run and a.tbl = b.tbl and b.ckpt = a.ckpt + 1 and a.rows = b.rows and a.width = b.width")).select("a.run", "a.tbl", F.col("a.ckpt").alias("pair"))
    prev = rows.select("run", "tbl", F.col("ckpt").alias("pair"), "id", F.col("vec").alias("p"))
    cur = rows.select("run", "tbl", (F.col("ckpt") - 1).alias("pair"), "id", F.col("vec").alias("c"))
    both = prev.join(cur, [*PAIR, "id"]).join(same, PAIR, "left_semi")
    pp, cc, pc = dot(F.col("p"), F.col("p")), dot(F.col("c"), F.col("c")), dot(F.col("p"), F.col("c"))
    delta = F.zip_with("p", "c", lambda x, y: y.cast("double") - x.cast("double"))
    sums = both.select(*PAIR, pp.alias("pp"), cc.alias("cc"), pc.alias("pc"), dot(delta, delta).alias("dd")).groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("pp", "cc", "pc", "dd")])
    return sums.select(*PAIR, F.sqrt("dd").alias("delta_norm"), (F.sqrt("dd") / (F.sqrt("pp") + EPS)).alias("rel_delta_norm"), (F.col("pc") / (F.sqrt("pp") * F.sqrt("cc") + EPS)).alias("cosine"))


def _values(matrix: np.ndarray) -> tuple[float, float]:
    """Spectral norm and effective rank of a tensor from the Gram matrix of either of its sides."""
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(matrix)[::-1], 0))
    return float(values[0]) if len(values) else 0.0, shape_of(values).effective_rank


_DENSE = "run string, tbl string, ckpt int, spectral_norm double, effective_rank double"


def _from_tiles(summed: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        norm, rank = _values(assemble(pdf["tiles"].iloc[0])[1])
        return pdf[TABLE].assign(spectral_norm=norm, effective_rank=rank)

    return summed.groupBy(*TABLE).applyInPandas(run, _DENSE)


def row_products(rows: DataFrame) -> DataFrame:
    """run, tbl, ckpt, n, tiles of the products of all rows with each other, for tensors of few rows: columns are dealt in blocks."""
    block = F.explode(F.sequence(F.lit(0), F.floor((F.size("vec") - 1) / COLUMNS).cast("int"))).alias("block")
    cut = rows.where(F.size("vec") > 0).select(*TABLE, "id", "vec", block).select(*TABLE, "id", "block", F.slice("vec", F.col("block") * COLUMNS + 1, COLUMNS).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("id")["v"].to_list()).astype(float)
        key = pdf[[*TABLE, "block"]].iloc[0].to_list()
        return pd.DataFrame([[*key[:3], i, j, key[3], 0, s, v] for i, j, s, v in cut_tiles(x @ x.T, np.zeros(len(x)))], columns=[*TABLE, "i", "j", "task", "n", "s", "v"])

    return add_tiles(cut.groupBy(*TABLE, "block").applyInPandas(run, f"run string, tbl string, ckpt int, {TILE_ROWS}"), TABLE)


def dense_spectra(rows: DataFrame, most: int = GRAM) -> DataFrame:
    """run, tbl, ckpt, spectral_norm, effective_rank from the singular values of whole tensors.

    Where the short side has most values at the utmost, they are those of its exact Gram matrix; where both sides are longer,
    they come from ``wide.singular_summary``, whose error is a percent or so. Tensors without a value have none.
    """
    width = F.coalesce(F.max(F.size("vec")), F.lit(0))
    shapes = settle(rows.groupBy(*TABLE).agg(F.count("*").alias("_rows"), width.alias("_width")))
    way = F.when(F.col("_width") == 0, "none").when(F.least("_rows", "_width") > most, "wide").when(F.col("_width") <= F.col("_rows"), "columns").otherwise("rows")
    shapes = shapes.select(*TABLE, way.alias("_way"))
    found = rows.sparkSession.createDataFrame([], _DENSE)
    own = rows.join(shapes, TABLE)
    by = {"columns": lambda r: _from_tiles(moments(r, TABLE)), "rows": lambda r: _from_tiles(row_products(r)), "wide": lambda r: singular_summary(r, TABLE).select(*found.columns)}
    for r in shapes.select("_way").distinct().collect():  # four at most
        if r._way in by:
            found = found.unionByName(by[r._way](own.where(F.col("_way") == r._way).select(*TABLE, "id", "vec")))
    return found
