"""Helpers the corpus operators share: reading tables, shared intermediate tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(range(256)).lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster names it.

    Only where that is unset, as in local tests, the session's warehouse is used instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    # shuffle files go with the write that made them, where this Spark can do that
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    known = spark.conf.isModifiable(setting)
    before = spark.conf.get(setting, "false") if known else ""
    if known:
        spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if known:
            spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


HOT_KEYS = 4096


def skew_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str = "n", most: int = HOT_KEYS) -> DataFrame:
    """rows joined with groups (one row a key, with how many rows it has; materialised), without a hot key in one task.

    Keys with more than one in ``most`` of all rows are fewer than ``most``, so they may be broadcast and their rows are
    not shuffled at all; the others meet by a shuffle in which no key has more than that share.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = groups.where(F.col(count) * most > total)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(count) * most <= total), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def small_batches(spark: SparkSession, records: int = 1000) -> None:
    """Keep an Arrow batch of whole texts to a few MB; the setting only bounds memory, never results."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty, without decoding."""
    values = column.cast(pa.large_binary())
    for value in values.to_pylist():
        yield b"" if value is None else value


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array, and the n + 1 offsets of the texts in it (null: empty)."""
    texts = list(utf8(column))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def give_back() -> None:
    """Return to the system what numpy and Arrow have freed; Spark keeps idle Python workers, and each would hold its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # malloc_trim is glibc's
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(function: Callable) -> Callable:
    """A function for mapInArrow whose freed memory is given back at the end of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to a dict of columns (or an iterator of such)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = function(batch)
                for columns in [made] if isinstance(made, dict) else made:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(trimmed(run), kind)


def ascii_lower(text) -> F.Column:
    """Lower-case A-Z only, as a Spark expression."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
