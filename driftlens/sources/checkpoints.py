"""One reader for all kinds of checkpoints: the first registered format that knows a folder reads it.

``datasource.register_source`` makes ``spark.read.format("checkpoints")`` known, which reads all built-in formats (``datasource``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.sources import trajectories
from driftlens.sources.datasource import read_run
from driftlens.sources.layouts import checkpoints_of, has_id_map


@dataclass(frozen=True)
class Format:
    """A kind of checkpoint: a cheap look whether a folder is one, and the reader of its rows (trajectories.SCHEMA)."""

    name: str
    can_load: Callable[[SparkSession, str], bool]
    read: Callable[..., DataFrame]  # (spark, path, run, table=...)


FORMATS: list[Format] = []


def register(kind: Format) -> Format:
    FORMATS.append(kind)
    return kind


def format_of(spark: SparkSession, path: str) -> Format:
    for kind in FORMATS:
        if kind.can_load(spark, path):
            return kind
    raise ValueError(f"no registered format can read {path!r}")


def read_checkpoints(spark: SparkSession, path: str, run: str = "run", table: str | None = None) -> DataFrame:
    """Rows of every checkpoint under path; a table filter is passed on to the scan where the format can prune by it."""
    rows = format_of(spark, path).read(spark, path, run, **({} if table is None else {"table": table}))
    return rows if table is None else rows.where(F.col("tbl") == table)


def _is_rows(spark: SparkSession, path: str) -> bool:
    try:
        return {"tbl", "ckpt", "id", "vec"} <= set(spark.read.parquet(path).columns)
    except Exception as e:  # noqa: BLE001
        if any(known in str(e) for known in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "CONFLICTING_DIRECTORY")):
            return False
        raise


def _has(sharded: bool) -> Callable[[SparkSession, str], bool]:
    return lambda spark, path: any(c.sharded == sharded for c in checkpoints_of(path)[:1]) and has_id_map(path)


register(Format("state_dict", _has(False), read_run))
register(Format("sharded", _has(True), read_run))
register(Format("rows", _is_rows, lambda spark, path, run, **options: trajectories.read_rows(spark, path, options.get("table"))))
