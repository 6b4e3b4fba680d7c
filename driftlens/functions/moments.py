"""Sums of vectors and outer products by key, for any width: tiles that are added up in a tree of fixed fan-in.

Every task adds up its rows and tells, for each key, the tiles on and above the diagonal, TILE wide. Tiles of FAN tasks
are added in one group, then these sums, so no group holds more than FAN tiles (or, of the second level, tasks / FAN). A key's
tiles come together only at the end; tables up to TILE wide have one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE, FAN = 64, 1024
TILE_ROWS = "i int, j int, task int, n long, s array<double>, v array<double>"


def key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def add_arrays(column: str) -> Column:
    """The sum of a group's arrays of equal length."""
    held = F.collect_list(column)
    return F.aggregate(F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(0))), F.get(held, 0), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))


def cut_tiles(matrix: np.ndarray, sums: np.ndarray) -> Iterator[tuple]:
    """(i, j, s, v): tiles of a symmetric matrix, and with those on the diagonal their share of the sums."""
    d = len(matrix)
    for i in range(0, d, TILE):
        for j in range(i, d, TILE):
            yield i // TILE, j // TILE, sums[i : i + TILE] if i == j else sums[:0], matrix[i : i + TILE, j : j + TILE].ravel()


def add_tiles(partial: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, tiles from rows (keys, i, j, task, n, s, v)."""
    sums = [F.sum("n").alias("n"), add_arrays("s").alias("s"), add_arrays("v").alias("v")]
    some = partial.groupBy(*keys, "i", "j", F.floor(F.col("task") / FAN).alias("share")).agg(*sums)
    every = some.groupBy(*keys, "i", "j").agg(*sums)
    return every.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(F.struct("i", "j", "s", "v")).alias("tiles"))


def moments(rows: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """keys, n and tiles (see ``assemble``) of the sum and the sum of outer products of the vectors; null ones are left out."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in frames:
            for key, own in pdf.groupby(keys, dropna=False, sort=False):
                x = np.stack(own["v"].to_list()).astype(float)
                add = [len(x), x.sum(0), x.T @ x]
                held[key] = add if key not in held else [a + b for a, b in zip(held[key], add, strict=True)]
        task = TaskContext.get().partitionId()
        for key, (n, s, ss) in held.items():
            yield pd.DataFrame([[*key, i, j, task, n, own, v] for i, j, own, v in cut_tiles(ss, s)], columns=[*keys, "i", "j", "task", "n", "s", "v"])

    own = rows.select(*keys, F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    return add_tiles(own.mapInPandas(partial, f"{key_schema(rows, keys)}, {TILE_ROWS}"), keys)


def cells(found: DataFrame) -> DataFrame:
    """A row for each value on and above the diagonal: all columns of found but tiles, and i, j, value, sum_i, sum_j."""
    names = [c for c in found.columns if c != "tiles"]
    sums = F.flatten(F.transform(F.array_sort(F.filter("tiles", lambda t: t["i"] == t["j"])), lambda t: t["s"]))
    each = found.select(*names, sums.alias("_s"), F.explode("tiles").alias("t")).select("*", F.posexplode("t.v").alias("_at", "value"))
    wide = F.floor(F.size("t.v") / F.least(F.lit(TILE), F.size("_s") - F.col("t.i") * TILE))
    i, j = F.col("t.i") * TILE + F.floor(F.col("_at") / wide), F.col("t.j") * TILE + F.col("_at") % wide
    placed = each.withColumns({"i": i.cast("int"), "j": j.cast("int")}).where("j >= i")
    return placed.select(*names, "i", "j", "value", F.get("_s", F.col("i")).alias("sum_i"), F.get("_s", F.col("j")).alias("sum_j"))


def assemble(tiles) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the symmetric matrix of a key's tiles."""
    own = sorted(((t["i"], t["j"], np.asarray(t["s"], float), np.asarray(t["v"], float)) for t in tiles), key=lambda t: t[:2])
    s = np.concatenate([t[2] for t in own if t[0] == t[1]])
    matrix = np.zeros((len(s), len(s)))
    for i, j, _, v in own:
        a, b = i * TILE, j * TILE
        tile = v.reshape(min(TILE, len(s) - a), -1)
        matrix[a : a + tile.shape[0], b : b + tile.shape[1]] = tile
        matrix[b : b + tile.shape[1], a : a + tile.shape[0]] = tile.T
    return s, matrix
