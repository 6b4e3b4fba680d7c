"""A Spark data source for checkpoints: ``spark.read.format("checkpoints").option("run", name).load(path)``.

Rows are those of ``trajectories.SCHEMA``, whichever layout lies under path: state dicts, sharded folders or Parquet rows.
A partition is a range of a table's slots (of Parquet: a row group): it goes through the id map a block at a time, keeps the
ids of its slots and then reads the rows of the weight in order, so neither a map nor a weight nor a chunk is ever held whole.
Ranges have LEAST to MOST slots, a sixteenth of the table between; as every range goes through the whole map, that bounds what is
read to about six times the weight of a table of a billion slots and 64 values. Filters on run, tbl and ckpt, and the options
``table`` and ``ckpt``, leave out partitions before any of their files is opened.

Ids whose slot is beyond the weight have no row. A null ``cnt`` means that a table keeps no counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from driftlens.sources.archives import open_path, read_parts
from driftlens.sources.layouts import COUNTS, DELIMITER, EMPTY, IDS, SLOTS, Table, checkpoints_of, tables_of
from driftlens.sources.trajectories import SCHEMA

NAME = "checkpoints"
LEAST, MOST, SHARES = 1 << 20, 1 << 24, 16
BLOCK, FRAME = 1 << 18, 1 << 14  # places of a map, rows of a weight that are held at a time
_ARROW = pa.schema([("run", pa.string()), ("tbl", pa.string()), ("ckpt", pa.int32()), ("step", pa.int64()), ("id", pa.int64()), ("slot", pa.int64()), ("cnt", pa.int64()), ("vec", pa.list_(pa.float32()))])


class SlotRange(NamedTuple):
    run: str
    ckpt: int
    step: int | None
    table: Table
    low: int
    high: int

    @property
    def tbl(self) -> str:
        return self.table.name

    def batches(self) -> Iterator[pa.RecordBatch]:
        table = self.table
        if not table.maps:
            for a in range(self.low, self.high, FRAME):
                at = np.arange(a, min(a + FRAME, self.high))
                yield self._batch(at, at, None, read_parts(table.vectors, a, int(at[-1]) + 1))
            return
        end = int(read_parts(table.maps[DELIMITER], 0, 1)[0, 0]) if DELIMITER in table.maps else EMPTY
        names, kept = [b for b in (IDS, SLOTS, COUNTS) if b in table.maps], []
        for a in range(0, table.size(IDS), BLOCK):
            block = [read_parts(table.maps[b], a, a + BLOCK)[:, 0].astype(np.int64) for b in names]
            own = (block[0] != end) & (block[1] >= self.low) & (block[1] < self.high)
            kept.append([x[own] for x in block])
        found = [np.concatenate(x) for x in zip(*kept, strict=True)] if kept else [np.zeros(0, np.int64)] * len(names)
        order = np.argsort(found[1], kind="stable")
        ids, slots, *counts = (x[order] for x in found)
        for a in range(self.low, self.high, FRAME):
            i, j = np.searchsorted(slots, [a, a + FRAME])
            if i < j:
                first, last = int(slots[i]), int(slots[j - 1])
                rows = read_parts(table.vectors, first, last + 1)
                for s in range(i, j, FRAME):  # several ids may share a slot
                    part = slice(s, min(s + FRAME, j))
                    yield self._batch(ids[part], slots[part], counts[0][part] if counts else None, rows[slots[part] - first])

    def _batch(self, ids, slots, counts, vectors) -> pa.RecordBatch:
        n = len(ids)
        flat = np.ascontiguousarray(vectors, "<f4")
        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype=np.int32)[: n + 1]), pa.array(flat.ravel())) if flat.shape[1] else pa.array([[]] * n, pa.list_(pa.float32()))
        whole = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
        return pa.RecordBatch.from_arrays([
            whole(self.run, pa.string()), whole(self.tbl, pa.string()), whole(self.ckpt, pa.int32()), whole(self.step, pa.int64()),
            pa.array(ids), pa.array(slots), pa.nulls(n, pa.int64()) if counts is None else pa.array(counts), vec,
        ], schema=_ARROW)


class RowGroup(NamedTuple):
    """A row group of a Parquet file, and the values of the columns that its folders name."""

    path: str
    group: int
    named: dict

    @property
    def run(self):
        return self.named.get("run")

    @property
    def tbl(self):
        return self.named.get("tbl")

    @property
    def ckpt(self):
        return self.named.get("ckpt")

    def batches(self) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, inside = open_path(self.path)
        with store.open_input_file(inside) as f:
            for batch in pq.ParquetFile(f).iter_batches(FRAME, row_groups=[self.group]):
                columns = [pa.repeat(pa.scalar(self.named[c.name], c.type), batch.num_rows) if c.name in self.named else batch.column(c.name).cast(c.type) if c.name in batch.schema.names else pa.nulls(batch.num_rows, c.type) for c in _ARROW]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def row_groups(path: str) -> Iterator[tuple[str, dict]]:
    """Parquet files under path and what their folders say."""
    import pyarrow.fs as fs

    store, inside = open_path(path)
    for f in sorted(store.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True)), key=lambda f: f.path):
        below = f.path.removeprefix(inside)
        if f.is_file and f.base_name.endswith(".parquet") and not re.search(r"/[_.]", below):
            named = {k: None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in (x.split("=", 1) for x in below.split("/") if "=" in x)}
            yield path + below, {k: int(v) if k == "ckpt" and v is not None else v for k, v in named.items() if k in ("run", "tbl", "ckpt")}


_TESTS = {
    EqualTo: lambda v, f: v == f.value, EqualNullSafe: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
}


class CheckpointReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.run = options["path"].rstrip("/"), options.get("run", "run")
        self.tests = []
        if "table" in options:
            self.tests.append(("tbl", lambda v, own=options["table"]: v == own))
        if "ckpt" in options:
            self.tests.append(("ckpt", lambda v, own=int(options["ckpt"]): v == own))

    def pushFilters(self, filters):
        """What leaves out partitions is noted; Spark tests all filters again."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("run",), ("tbl",), ("ckpt",)):
                self.tests.append((f.attribute[0], lambda v, f=f: _TESTS[type(f)](v, f)))
            yield f

    def wanted(self, **known) -> bool:
        """Whether a partition with these values may hold rows that are asked for; what is not known may."""
        return all(known.get(name) is None or test(known[name]) for name, test in self.tests)

    def partitions(self):
        found = checkpoints_of(self.path)
        made: list = []
        for ckpt, checkpoint in enumerate(found):
            if self.wanted(run=self.run, ckpt=ckpt):
                made += self._slot_ranges(ckpt, checkpoint)
        if not found:
            import pyarrow.parquet as pq

            for path, named in row_groups(self.path):
                if self.wanted(**named):
                    store, inside = open_path(path)
                    with store.open_input_file(inside) as f:
                        made += [RowGroup(path, g, named) for g in range(pq.ParquetFile(f).num_row_groups)]
        return [InputPartition(p) for p in made] or [InputPartition(None)]

    def _slot_ranges(self, ckpt: int, checkpoint) -> Iterator[SlotRange]:
        step = checkpoint.step()
        for table in tables_of(checkpoint.tensors()):
            if self.wanted(tbl=table.name):
                share = min(MOST, max(LEAST, -(-table.slots // SHARES)))
                for low in range(0, table.slots, share):
                    yield SlotRange(self.run, ckpt, step, table, low, min(low + share, table.slots))

    def read(self, partition):
        yield from partition.value.batches() if partition.value is not None else ()


class CheckpointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CheckpointReader:
        return CheckpointReader(self.options)


def register_source(spark: SparkSession) -> None:
    """Make the format known to a session, which must push filters to Python sources, as Spark refuses this one otherwise."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CheckpointSource)


def read_run(spark: SparkSession, path: str, run: str = "run", **options: str) -> DataFrame:
    """Rows of all checkpoints under path, numbered in the order of their folders' names."""
    if not checkpoints_of(path):
        raise FileNotFoundError(f"no checkpoint under {path}")
    register_source(spark)
    return spark.read.format(NAME).option("run", run).options(**options).load(path)
