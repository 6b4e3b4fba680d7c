"""Frequent-Directions sketches: a few rows that stand for all vectors of a key, in one pass, and merged without another.

A sketch B of ``size`` rows knows of the vectors A that in every direction their squared length lies between that of B and that
of B plus ``lost``; lost is kept with it and is at most energy / (size + 1), the energy being the sum of all squares. Keys with no
more directions than size lose nothing. Count, sum and energy are exact, so what follows for a covariance has the same bound.
Sketches of checkpoints, days or runs are stored and merged later; the rows are not read again. The exact ways
(``moments``, ``geometry.spectra``) stay; they hold width ** 2 values a key where a sketch holds size * width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.moments import key_schema

SIZE, FAN = 64, 64
_ROW = "n long, energy double, lost double, width int, s array<double>, sketch array<double>"


def shrink(rows: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """At most size rows in place of the given ones, and by how much their squares fall short at the utmost in any direction."""
    if len(rows) <= size:
        return rows, 0.0
    _, values, directions = np.linalg.svd(rows, full_matrices=False)
    cut = float(values[size] ** 2) if len(values) > size else 0.0
    kept = np.sqrt(np.maximum(values[:size] ** 2 - cut, 0))
    return kept[:, None] * directions[:size], cut


class Sketch:
    """The running sketch of one key; rows wait until as many have come as the sketch holds."""

    def __init__(self, size: int, width: int):
        self.size, self.n, self.energy, self.lost = size, 0, 0.0, 0.0
        self.s, self.rows = np.zeros(width), np.zeros((0, width))

    def add(self, x: np.ndarray, lost: float = 0.0) -> None:
        """Take in rows, or those of another sketch with what it has lost."""
        self.lost += lost
        for at in range(0, len(x), self.size):
            self.rows = np.concatenate([self.rows, x[at : at + self.size]])
            if len(self.rows) >= 2 * self.size:
                self._cut()

    def _cut(self) -> None:
        self.rows, cut = shrink(self.rows, self.size)
        self.lost += cut

    def row(self) -> list:
        self._cut()
        return [self.n, self.energy, self.lost, len(self.s), self.s, self.rows.ravel()]


def _merge(size: int, keys: list[str], more: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task", "n", "energy"], kind="stable")
        whole = Sketch(size, int(pdf["width"].iloc[0]))
        for r in pdf.itertuples():
            whole.add(np.asarray(r.sketch, float).reshape(-1, r.width), r.lost)
            whole.n, whole.energy, whole.s = whole.n + r.n, whole.energy + r.energy, whole.s + np.asarray(r.s, float)
        return pd.DataFrame([[*pdf[[*keys, *more]].iloc[0], *whole.row()]], columns=[*keys, *more, "n", "energy", "lost", "width", "s", "sketch"])

    return run


def _add_up(partial: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One sketch a key from rows with a task number, FAN tasks a group at a time."""
    schema = key_schema(partial, keys)
    for _ in range(2):
        dealt = partial.withColumn("task", F.floor(F.col("task") / FAN).cast("int"))
        partial = dealt.groupBy(*keys, "task").applyInPandas(_merge(size, keys, ["task"]), f"{schema}, task int, {_ROW}")
    return partial.groupBy(*keys).applyInPandas(_merge(size, keys, []), f"{schema}, {_ROW}")


def sketched(rows: DataFrame, keys: list[str], size: int = SIZE, vec: str = "vec") -> DataFrame:
    """keys, n, energy, lost, width, s, sketch of the vectors of each key; null and empty ones and those with a value not finite are left out."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Sketch] = {}
        for pdf in frames:
            for key, own in pdf.groupby(keys, dropna=False, sort=False):
                x = np.stack(own["v"].to_list()).astype(float)
                one = held.setdefault(key, Sketch(size, x.shape[1]))
                one.add(x)
                one.n, one.energy, one.s = one.n + len(x), one.energy + float((x * x).sum()), one.s + x.sum(0)
        task = TaskContext.get().partitionId()
        for key, one in held.items():
            yield pd.DataFrame([[*key, task, *one.row()]], columns=[*keys, "task", "n", "energy", "lost", "width", "s", "sketch"])

    own = rows.select(*keys, F.col(vec).cast("array<double>").alias("v"))
    own = own.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return _add_up(own.mapInPandas(partial, f"{key_schema(rows, keys)}, task int, {_ROW}"), keys, size)


def merged(sketches: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """One sketch a key from all its stored sketches."""
    names = [c.split()[0] for c in _ROW.split(", ")]
    # dealt by content, so that a lost task's rows come to the same groups again
    return _add_up(sketches.select(*keys, F.pmod(F.xxhash64("n", "energy", "s"), F.lit(FAN * FAN)).cast("int").alias("task"), *names), keys, size)


def principal(n: int, s: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variances and directions (columns) of the sketched covariance, from the greatest down; no width x width array is made."""
    span, r = np.linalg.qr(np.vstack([sketch, s / np.sqrt(n)]).T)
    values, vectors = np.linalg.eigh((r[:, :-1] @ r[:, :-1].T - np.outer(r[:, -1], r[:, -1])) / (n - 1))
    return np.maximum(values[::-1], 0), span @ vectors[:, ::-1]


def variance(n: int, energy: float, s: np.ndarray) -> float:
    """The exact sum of variances."""
    return max(0.0, (energy - float(s @ s) / n) / (n - 1))


def spectra(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, spectrum (leading variances), error (by how much each is too small at the utmost), total (the exact sum of all)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = [(r.n, r.energy, np.asarray(r.s), np.asarray(r.sketch).reshape(-1, r.width), r.lost) for r in pdf.itertuples()]
            spectrum = [principal(n, s, b)[0] if n > 1 else np.zeros(len(b)) for n, _, s, b, _ in own]
            yield pdf[[*keys, "n"]].assign(spectrum=spectrum, error=[lost / max(1, n - 1) for n, *_, lost in own], total=[variance(n, e, s) if n > 1 else 0.0 for n, e, s, *_ in own])

    return found.mapInPandas(run, f"{key_schema(found, keys)}, n long, spectrum array<double>, error double, total double")


def held(prev: Sketch, cur: Sketch, energy: float = 0.90) -> tuple[float, float, float]:
    """What the previous leading directions hold of the current variance, against the most that as many could; with its bounds.

    As many directions are taken as hold that share of the exact variance, or all that the sketch has. 1 where either side
    has fewer than two vectors or none of it varies.
    """
    if len(prev.s) != len(cur.s):
        raise ValueError("checkpoints of different widths have no overlap")
    if min(prev.n, cur.n) < 2:
        return 1.0, 1.0, 1.0
    values, old = principal(prev.n, prev.s, prev.rows)
    total = variance(prev.n, prev.energy, prev.s)
    k = min(len(values), 1 + int((values.cumsum() < (energy - 1e-9) * total).sum())) if total > 1e-12 else 0
    now, new = principal(cur.n, cur.s, cur.rows)
    own, best = float((((old[:, :k].T @ new) ** 2) @ now).sum()), float(now[:k].sum())
    if best <= 1e-12:
        return 1.0, 1.0, 1.0
    slack = k * cur.lost / (cur.n - 1)
    return min(1.0, own / best), own / (best + slack), min(1.0, (own + slack) / best)


def overlaps(found: DataFrame, energy: float = 0.90) -> DataFrame:
    """run, tbl, pair, overlap, low, high of consecutive checkpoints from their sketches (keys run, tbl, ckpt).

    low and high bound what the exact covariance of the current side would give for the sketched directions of the previous one.
    """
    names = ["n", "energy", "lost", "width", "s", "sketch"]
    prev = found.select("run", "tbl", F.col("ckpt").alias("pair"), F.struct(*names).alias("prev"))
    both = prev.join(found.select("run", "tbl", (F.col("ckpt") - 1).alias("pair"), F.struct(*names).alias("cur")), ["run", "tbl", "pair"])

    def opened(x) -> Sketch:
        one = Sketch(SIZE, x["width"])
        one.n, one.energy, one.lost, one.s = x["n"], x["energy"], x["lost"], np.asarray(x["s"])
        one.rows = np.asarray(x["sketch"]).reshape(-1, x["width"])
        return one

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = [held(opened(a), opened(b), energy) for a, b in zip(pdf["prev"], pdf["cur"], strict=True)]
            yield pdf[["run", "tbl", "pair"]].assign(**{name: [o[i] for o in own] for i, name in enumerate(("overlap", "low", "high"))})

    return both.mapInPandas(run, "run string, tbl string, pair int, overlap double, low double, high double")
