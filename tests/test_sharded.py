import io
import pickle
import sys
import types
import zipfile
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pytest

from driftlens.operators.pairs import churn_counts
from driftlens.sources import datasource
from driftlens.sources.checkpoints import format_of, read_checkpoints
from driftlens.sources.datasource import CheckpointReader, read_run, register_source
from driftlens.sources.layouts import COUNTS, DELIMITER, EMPTY, IDS, MAP_PREFIX, SLOTS, WEIGHT_PREFIX, has_id_map
from driftlens.sources.trajectories import write_rows
from test_state_dicts import Tensor, Writer, state, write_state


@pytest.fixture
def format_modules(monkeypatch):
    """Stand-ins for the modules whose classes the metadata's pickle names."""
    names = {n: types.ModuleType(n) for n in ("torch", "torch.distributed", "torch.distributed.checkpoint", "torch.distributed.checkpoint.metadata", "torch.distributed.checkpoint.filesystem")}
    for n, m in names.items():
        monkeypatch.setitem(sys.modules, n, m)

    def add(module, made):
        made.__module__, made.__qualname__ = module, made.__name__
        setattr(names[module], made.__name__, made)
        return made

    meta = "torch.distributed.checkpoint.metadata"

    class Size(tuple):
        def __reduce__(self):
            return Size, (tuple(self),)

    @dataclass
    class TensorStorageMetadata:
        properties: Any
        size: Any
        chunks: list

    @dataclass
    class BytesStorageMetadata:
        pass

    @dataclass
    class ChunkStorageMetadata:
        offsets: Any
        sizes: Any

    @dataclass(frozen=True)
    class MetadataIndex:
        fqn: str
        offset: Any = None
        index: Any = field(hash=False, compare=False, default=None)

    @dataclass
    class Metadata:
        state_dict_metadata: dict
        planner_data: Any
        storage_data: dict

    @dataclass
    class _StorageInfo:
        relative_path: str
        offset: int
        length: int

    add("torch", Size)
    for c in (TensorStorageMetadata, BytesStorageMetadata, ChunkStorageMetadata, MetadataIndex, Metadata):
        add(meta, c)
    add("torch.distributed.checkpoint.filesystem", _StorageInfo)
    return types.SimpleNamespace(**{c.__name__: c for c in (Size, TensorStorageMetadata, BytesStorageMetadata, ChunkStorageMetadata, MetadataIndex, Metadata, _StorageInfo)})


def archive(value):
    out, body = io.BytesIO(), io.BytesIO()
    Writer(body, 2).dump(Tensor("0", value))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/data.pkl", body.getvalue())
        z.writestr("archive/data/0", value.tobytes())
    return out.getvalue()


def write_shards(folder, tensors, m, ranks=2):
    """tensors by name, cut into row ranges over so many files; one-row tensors are kept whole in the first."""
    folder.mkdir(parents=True)
    files, known, stored = [b""] * ranks, {}, {}
    for name, value in tensors.items():
        parts = [0, len(value)] if len(value) == 1 else [len(value) * k // ranks for k in range(ranks + 1)]
        chunks = []
        for rank, (a, b) in enumerate(zip(parts, parts[1:])):
            offset, size = (m.Size([x, *[0] * (value.ndim - 1)]) if i == 0 else m.Size([x, *value.shape[1:]]) for i, x in enumerate((a, b - a)))
            raw = archive(np.ascontiguousarray(value[a:b]))
            chunks.append(m.ChunkStorageMetadata(offset, size))
            stored[m.MetadataIndex(name, offset, rank)] = m._StorageInfo(f"__{rank}_0.distcp", len(files[rank]), len(raw))
            files[rank] += raw
        known[name] = m.TensorStorageMetadata(None, m.Size(value.shape), chunks)
    known["note"] = m.BytesStorageMetadata()
    stored[m.MetadataIndex("note")] = m._StorageInfo("__0_0.distcp", 0, 1)
    for rank, raw in enumerate(files):
        (folder / f"__{rank}_0.distcp").write_bytes(raw)
    (folder / ".metadata").write_bytes(pickle.dumps(m.Metadata(known, {}, stored)))


def tensors(ids, slots, counts, weight):
    pad = len(weight) - len(ids)
    p = MAP_PREFIX + "t."
    return {
        p + IDS: np.array([*ids, *[EMPTY] * pad], "<i8"), p + SLOTS: np.array([*slots, *[0] * pad], "<i8"), p + COUNTS: np.array([*counts, *[0] * pad], "<i8"), p + DELIMITER: np.array([EMPTY], "<i8"),
        WEIGHT_PREFIX + "t.weight": weight, WEIGHT_PREFIX + "plain.weight": weight[:2], "tower.bias": np.array([1, 2, 3], "<f4"),
    }


def test_sharded_run(spark, tmp_path, format_modules):
    weight = np.arange(28, dtype="<f4").reshape(7, 4)
    write_shards(tmp_path / "run/ckpt_000", tensors([10, 20, 30], [4, 2, 6], [7, 3, 1], weight), format_modules)
    write_shards(tmp_path / "run/ckpt_001", tensors([10, 20, 40, 50], [4, 2, 0, 5], [9, 3, 1, 1], weight + 1), format_modules, 3)
    path = str(tmp_path / "run")
    (tmp_path / "run/ckpt_001/meta.json").write_text('{"global_step": 150}')
    assert has_id_map(f"{path}/ckpt_000") and format_of(spark, path).name == "sharded"
    found = read_checkpoints(spark, path, table="t")
    rows = {(r.ckpt, r.id): (r.slot, r.cnt, r.vec) for r in found.collect()}
    assert rows[0, 30] == (6, 1, weight[6].tolist()) and rows[1, 10] == (4, 9, (weight[4] + 1).tolist()) and len(rows) == 7
    c = churn_counts(found).first()
    assert (c.n_survivors, c.n_inserted, c.n_evicted) == (2, 2, 1)
    assert {(r.ckpt, r.step) for r in found.select("ckpt", "step").distinct().collect()} == {(0, None), (1, 150)}
    other = {(r.tbl, r.ckpt, r.id): r.vec for r in read_checkpoints(spark, path).where("tbl <> 't'").collect()}
    assert other["dense:tower.bias", 1, 2] == [3.0] and other[f"dense:{WEIGHT_PREFIX}plain.weight", 0, 1] == weight[1].tolist()
    (tmp_path / "run/ckpt_000/.metadata").write_bytes(pickle.dumps(print))
    assert not has_id_map(f"{path}/ckpt_000")


def test_the_reader_finds_the_format(spark, tmp_path):
    write_state(tmp_path / "single/ckpt_000/state_dict.pt", state([10], [1], [2], np.ones((3, 2), "<f4")))
    write_state(tmp_path / "single/ckpt_000/checkpoint.pt", state([11], [1], [2], np.ones((3, 2), "<f4")))
    rows = read_checkpoints(spark, str(tmp_path / "single"), table="t")
    assert [(r.run, r.id) for r in rows.collect()] == [("run", 10)]
    assert format_of(spark, str(tmp_path / "single/ckpt_000/checkpoint.pt")).name == "state_dict"
    assert read_checkpoints(spark, str(tmp_path / "single/ckpt_000/checkpoint.pt"), table="t").first().id == 11
    write_rows(rows, str(tmp_path / "rows"))
    assert format_of(spark, str(tmp_path / "rows")).name == "rows"
    for name in ("rows/none", "single/none"):
        with pytest.raises(ValueError, match="no registered format"):
            read_checkpoints(spark, str(tmp_path / name))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        read_run(spark, str(tmp_path / "empty"))


def opened(path, **options):
    """The stored tensors that a reader with these options opens, and its partitions."""
    partitions = [p.value for p in CheckpointReader({"path": path, **options}).partitions()]
    return {(part.path, part.at) for p in partitions if p for parts in (*p.table.maps.values(), p.table.vectors) for part in parts}, partitions


def test_filters_leave_files_unopened(spark, tmp_path, format_modules):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    weight = np.arange(28, dtype="<f4").reshape(7, 4)
    for k in range(3):
        write_shards(tmp_path / f"run/ckpt_{k:03}", tensors([10, 20, 30], [4, 2, 6], [7, 3, 1], weight + k), format_modules)
    path = str(tmp_path / "run")
    every, _ = opened(path)
    assert len(every) == 3 * (4 * 2 + 1 + 2 + 2)  # ids, slots, counts and weight by two ranks, the delimiter by one, two dense tensors by two
    own, _ = opened(path, table="t", ckpt="1")
    assert len(own) == 9 and all("/ckpt_001/" in p for p, _ in own)
    assert opened(path, table="dense:tower.bias", ckpt="0")[0] < every and len(opened(path, table="dense:tower.bias", ckpt="0")[0]) == 2
    reader = CheckpointReader({"path": path, "run": "a"})
    filters = [EqualTo(("tbl",), "t"), GreaterThan(("ckpt",), 0), In(("ckpt",), (1, 5)), StringContains(("tbl",), "x"), EqualTo(("id",), 3)]
    assert list(reader.pushFilters(filters)) == filters
    assert [(p.value.ckpt, p.value.tbl) for p in reader.partitions()] == [(1, "t")]
    reader.pushFilters([EqualTo(("run",), "b")])
    assert len([*reader.pushFilters([EqualTo(("run",), "b")])]) == 1 and [p.value for p in reader.partitions()] == [None]
    # the other checkpoints' files are gone: whoever opens them fails
    for p in (tmp_path / "run").glob("ckpt_00[02]/*.distcp"):
        p.unlink()
    register_source(spark)
    found = spark.read.format("checkpoints").option("run", "r").load(path)
    assert sorted((r.run, r.ckpt, r.id, r.slot, r.cnt) for r in found.where("tbl = 't' and ckpt = 1").collect()) == [("r", 1, 10, 4, 7), ("r", 1, 20, 2, 3), ("r", 1, 30, 6, 1)]
    assert found.where("run = 'x'").count() == 0
    assert spark.read.format("checkpoints").option("table", "t").option("ckpt", 1).load(path).count() == 3


@pytest.mark.parametrize("layout", ["single", "sharded", "rows"])
def test_one_source_reads_all_layouts(spark, tmp_path, format_modules, layout):
    rng = np.random.default_rng(4)
    weight, slots = rng.normal(size=(40, 3)).astype("<f4"), rng.permutation(40)[:25]
    slots[3] = slots[5]  # two ids with one slot
    for k in range(2):
        t = tensors(list(range(100, 125)), slots, list(range(25)), weight + np.float32(k))
        if layout == "sharded":
            write_shards(tmp_path / f"run/ckpt_{k:03}", t, format_modules, 3)
        else:
            write_state(tmp_path / f"run/ckpt_{k:03}/state_dict.pt", t)
    path = str(tmp_path / "run")
    if layout == "rows":
        write_rows(read_run(spark, path), str(tmp_path / "rows"))
        path = str(tmp_path / "rows")
    register_source(spark)
    found = spark.read.format("checkpoints").load(path)
    got = {(r.ckpt, r.id): (r.slot, r.cnt, r.vec) for r in found.where("tbl = 't'").collect()}
    assert got == {(k, 100 + i): (int(s), i, (weight[s] + np.float32(k)).tolist()) for k in range(2) for i, s in enumerate(slots)}
    assert found.where("tbl like 'dense:%'").count() == 2 * (2 + 3) and {r.run for r in found.select("run").distinct().collect()} == {"run"}
    assert spark.read.format("checkpoints").option("table", "t").load(path).count() == 50


def test_ranges_bound_what_is_held(tmp_path, monkeypatch):
    for name, value in (("LEAST", 5), ("MOST", 7), ("BLOCK", 4), ("FRAME", 3)):
        monkeypatch.setattr(datasource, name, value)
    weight, slots = np.arange(80, dtype="<f4").reshape(40, 2), list(range(39, 9, -1))
    write_state(tmp_path / "c/state_dict.pt", tensors(list(range(30)), slots, [1] * 30, weight))
    most, read = 0, datasource.read_parts

    def counted(parts, a, b):
        nonlocal most
        most = max(most, b - a)
        return read(parts, a, b)

    monkeypatch.setattr(datasource, "read_parts", counted)
    _, partitions = opened(str(tmp_path), table="t")
    assert [(p.low, p.high) for p in partitions] == [(a, min(a + 5, 40)) for a in range(0, 40, 5)]
    rows = [r for p in partitions for b in p.batches() for r in b.to_pylist()]
    assert [(r["id"], r["slot"], r["vec"]) for r in rows] == [(39 - s, s, weight[s].tolist()) for s in range(10, 40)]
    assert most == 4
