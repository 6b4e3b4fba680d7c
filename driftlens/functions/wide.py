"""Singular values of matrices too large for a Gram matrix: Krylov spaces over distributed rows.

Blocks of vectors are multiplied by X'X, all vectors of all matrices in one pass over the rows; each pass adds up what the tasks
made in slices of fixed fan-in. A random block, multiplied POWER times, spans the leading directions. From each of its
directions, and from PROBES random vectors without them, Lanczos steps go on: a start's tridiagonal matrix gives nodes and
weights by which sums over the spectrum are taken, exactly along the leading directions and by an average over the probes for
the rest (stochastic Lanczos quadrature). The greatest node is the spectral norm. The driver holds the starts' bases: STEPS x
(LEADING + PROBES) x width numbers a matrix, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.moments import FAN, add_arrays, key_schema

LEADING, POWER, PROBES, STEPS, SLICE, SEED = 12, 2, 12, 40, 4096, 11


def products(rows: DataFrame, keys: list[str], vectors: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
    """X'(X V) for the rows X and vectors V of each key."""
    held = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            for key, own in pdf.groupby(keys, sort=False):
                x = np.stack(own["vec"].to_list()).astype(float)
                made = x.T @ (x @ held.value[key])
                total[key] = made if key not in total else total[key] + made
        task = TaskContext.get().partitionId()
        for key, made in total.items():
            flat = made.ravel()
            for at in range(0, len(flat), SLICE):
                yield pd.DataFrame([[*key, at, task, flat[at : at + SLICE]]], columns=[*keys, "at", "task", "v"])

    part = rows.select(*keys, "vec").mapInPandas(run, f"{key_schema(rows, keys)}, at int, task int, v array<double>")
    some = part.groupBy(*keys, "at", F.floor(F.col("task") / FAN).alias("share")).agg(add_arrays("v").alias("v"))
    found = {k: np.zeros(v.size) for k, v in vectors.items()}
    for r in some.groupBy(*keys, "at").agg(add_arrays("v").alias("v")).toLocalIterator():
        found[tuple(r[k] for k in keys)][r["at"] : r["at"] + len(r.v)] = r.v
    held.destroy()
    return {k: found[k].reshape(v.shape) for k, v in vectors.items()}


class Lanczos:
    """The bases and tridiagonal matrices of one matrix's starts, each orthogonalised against its whole basis."""

    def __init__(self, leading: np.ndarray, rng: np.random.Generator):
        probes = rng.choice([-1.0, 1.0], (len(leading), PROBES))
        probes -= leading @ (leading.T @ probes)
        starts = np.concatenate([leading, probes], 1)
        size = np.linalg.norm(starts, axis=0)
        self.weight = np.concatenate([np.ones(leading.shape[1]), size[leading.shape[1] :] ** 2 / PROBES])
        self.alive = size > 1e-9
        self.basis, self.diagonal, self.beside = [np.where(self.alive, starts / np.where(self.alive, size, 1.0), 0.0)], [], []
        self.scale = 0.0

    def advance(self, product: np.ndarray) -> None:
        """Take in X'X times the last vectors."""
        self.diagonal.append((self.basis[-1] * product).sum(0))
        held = np.stack(self.basis)
        for _ in range(2):
            product = product - np.einsum("kwp,kp->wp", held, np.einsum("kwp,wp->kp", held, product))
        size = np.linalg.norm(product, axis=0)
        # a start whose space is exhausted stays where it is
        self.scale = max(self.scale, float(self.diagonal[-1].max()))
        self.alive &= size > 1e-10 * self.scale
        self.beside.append(np.where(self.alive, size, 0.0))
        self.basis.append(np.where(self.alive, product / np.where(size > 0, size, 1.0), 0.0))

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and weights by which sums over the spectrum of X'X are taken."""
        nodes, weights = [], []
        for p in range(len(self.weight)):
            steps = next((k + 1 for k in range(len(self.diagonal)) if self.beside[k][p] == 0), len(self.diagonal))
            off = [b[p] for b in self.beside[: steps - 1]]
            value, vector = np.linalg.eigh(np.diag([d[p] for d in self.diagonal[:steps]]) + np.diag(off, 1) + np.diag(off, -1))
            nodes.append(np.maximum(value, 0))
            weights.append(vector[0] ** 2 * self.weight[p])
        return np.concatenate(nodes), np.concatenate(weights)


def singular_summary(rows: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """keys, spectral_norm, effective_rank of matrices of rows (keys, vec), a driver's loop of steps passes."""
    spark = rows.sparkSession
    rng = np.random.default_rng(SEED)
    widths = {tuple(r[k] for k in keys): r.width for r in rows.groupBy(*keys).agg(F.max(F.size("vec")).alias("width")).orderBy(*keys).collect()}
    block = {k: np.linalg.qr(rng.normal(size=(w, min(w, LEADING))))[0] for k, w in widths.items()}
    for _ in range(POWER):
        block = {k: np.linalg.qr(v)[0] for k, v in products(rows, keys, block).items()}
    state = {k: Lanczos(v, rng) for k, v in block.items()}
    for _ in range(min(steps, max(widths.values(), default=0))):
        for k, made in products(rows, keys, {k: s.basis[-1] for k, s in state.items()}).items():
            state[k].advance(made)
    found = []
    for k, s in state.items():
        nodes, weights = s.nodes()
        value = np.sqrt(nodes)
        total = float(weights @ value)
        if total <= 1e-12:
            found.append((*k, 0.0, 0.0))
            continue
        log = np.log(value, out=np.zeros_like(value), where=value > 1e-12)
        # the entropy of the shares value / total
        entropy = np.log(total) - float(weights @ (value * log)) / total
        found.append((*k, float(value.max()), float(np.exp(entropy))))
    return spark.createDataFrame(found, f"{key_schema(rows, keys)}, spectral_norm double, effective_rank double")
