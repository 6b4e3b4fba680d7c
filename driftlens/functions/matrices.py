"""Applying a matrix for each key to the rows of that key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64_000_000
GROUP = 50_000  # rows of one key that meet its matrix in one group


def apply_by_key(rows: DataFrame, matrices: DataFrame, keys: list[str], function: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """function(rows of one key, its row of matrices) for all keys that both have; rows have an id, matrices array columns.

    The arrays' size is counted first. Up to most bytes they are broadcast and rows stay where they are; beyond that the
    two are brought together by key, and a key's rows are dealt over groups of about GROUP rows.
    """
    arrays = [c for c, kind in matrices.dtypes if kind.startswith("array")]
    size = matrices.agg(F.coalesce(F.sum(sum(F.size(c) for c in arrays)), F.lit(0))).first()[0]

    def as_dict(row) -> dict:
        return {c: np.asarray(row[c]) if c in arrays else row[c] for c in names}

    names = matrices.columns
    if 8 * size <= most:
        held = rows.sparkSession.sparkContext.broadcast({tuple(r[k] for k in keys): as_dict(r) for r in matrices.collect()})

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for key, at in pdf.groupby(keys, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    if key in held.value:
                        yield function(pdf.iloc[at], held.value[key])

        return rows.mapInPandas(each, schema)

    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / GROUP).alias("_parts"))
    dealt = rows.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64("id"), "_parts")).drop("_parts")
    spread = matrices.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")

    kinds = {"string": object, "double": float}
    none = pd.DataFrame({c: pd.Series([], dtype=kinds.get(kind, np.int64)) for c, kind in (f.split() for f in schema.split(", "))})

    def both(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return function(pdf.drop(columns="_part"), as_dict(own.iloc[0])) if len(pdf) and len(own) else none

    return dealt.groupBy(*keys, "_part").cogroup(spread.groupBy(*keys, "_part")).applyInPandas(both, schema)
